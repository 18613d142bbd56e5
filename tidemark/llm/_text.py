"""Vectorised text primitives on Arrow string buffers.

Words, word hashes and hashes of word n-grams are computed for a whole batch of
documents with numpy, straight from the UTF-8 bytes; no Python string is made
per word. Memory is bounded by cutting a batch at document borders into slices
of about ``SLICE`` bytes (a longer document forms a slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[b for b in range(128) if not chr(b).isalnum()]] = True

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        base, size = _BASES[kind], max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= 4 * SLICE:  # powers for an outsized document aren't kept
            _POWERS[kind] = have
    return have[0][:n], have[1][:n]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE):
    """The batch in pieces of about ``limit`` bytes of ``column``, cut between rows."""
    if not batch.num_rows:
        return
    ends = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings at the given places of ``data``; they must be UTF-8."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])


def sums(keys, *values: np.ndarray):
    """Distinct rows of the arrays ``keys`` in order, the sums of the values over each, and the place of one of each."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[order[at]] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values], order[at]


class Words:
    """The words of a batch of documents.

    ``start``/``end`` are byte positions, ``first`` has the first word of each
    document (and the number of all words at its end), ``doc`` each word's row.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, letters_only: bool = False, gaps: np.ndarray | None = None):
        """``gaps``: which of the 256 bytes part words, in place of white space."""
        n = len(data)
        full = ~((_PUNCT if letters_only else _SPACE) if gaps is None else gaps)[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = full[:-1], full[1:]
            inner = offs[(offs > 0) & (offs < n)]
            before[inner] = False
            after[inner - 1] = False
        self.data, self.offs = data, offs
        self.start = np.flatnonzero(full & ~before)
        self.end = np.flatnonzero(full & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _powers("byte", n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they are in one document."""
        m = len(hashes)
        inside = np.arange(m) + n <= self.first[1:][self.doc] if m else np.zeros(0, bool)
        out = np.zeros(m, U64)
        if m >= n:
            up, down = _powers("word", m + 1)
            total = np.zeros(m + 1, U64)
            np.cumsum(hashes * up[:m], out=total[1:])
            out[: m - n + 1] = mix((total[n:] - total[: m - n + 1]) * down[: m - n + 1])
        return out, inside


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """``out[i] = min(x[i : i + width])``; past the end, of what is there."""
    return _sliding(x, width, np.minimum)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return _sliding(x, width, np.maximum)


def _sliding(x, width, op):
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:])
        have += step
    return out
