"""Dense features of whole texts, a slice of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm import _text


def _set(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return out


# Byte classes.
CLASSES = {
    "upper": _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _set("abcdefghijklmnopqrstuvwxyz"),
    "digit": _set("0123456789"),
    "symbol": _set("#$%&*+<=>@\\^_|~{}[]"),
    "stop": _set(".,;:"),
    "shout": _set("!?"),
    "pipe": _set("|"),
    "wide": _set(bytes(range(128, 256))),
    "space": _set(" \t\n\x0b\x0c\r"),
    "line": _set("\n"),
}
SURFACE = (
    "log_words", "word_length", "upper", "digit", "symbol", "stop", "shout", "pipe", "wide", "space",
    "distinct", "repeat_grams", "repeat_lines", "line_words", "long_words", "shouted_words", "same_byte",
)


class Slice:
    """A slice of documents with what several features need."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.data, self.offs = _text.utf8(texts)
        self.n = len(texts)
        self.words = _text.Words(self.data, self.offs)
        self.hashes = self.words.hashes()

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's bytes."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.offs])


def repeated(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many of each document's hashes have occurred in it before."""
    both = _text.mix(hashes ^ _text.mix(doc.astype(np.uint64)))
    _, first = np.unique(both, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def surface(s: Slice) -> np.ndarray:
    """One row of ``SURFACE`` per document; zeros for an empty one."""
    w, n = s.words, s.n
    count = {k: s.per_doc(v[s.data]) for k, v in CLASSES.items()}
    size = np.maximum(np.diff(s.offs), 1)
    words = np.maximum(w.count, 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
    lengths = w.end - w.start
    grams, inside = w.grams(s.hashes, 5)
    lines = _lines(s)
    last = s.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    same = np.zeros(len(s.data), np.int64)
    if len(same):
        same[1:] = (s.data[1:] == s.data[:-1]) & (CLASSES["lower"][s.data[1:]] == 0)
    by = lambda mask: np.bincount(w.doc[mask], minlength=n)
    return np.column_stack([
        np.log1p(w.count), (size - count["space"]) / words, count["upper"] / letters, count["digit"] / size, count["symbol"] / size,
        count["stop"] / words, count["shout"] / words, count["pipe"] / words, count["wide"] / letters, count["space"] / size,
        1 - repeated(w.doc, s.hashes, n) / words,
        repeated(w.doc[inside], grams[inside], n) / np.maximum(by(inside), 1),
        lines[1] / np.maximum(lines[0], 1), w.count / np.maximum(lines[0], 1), by(lengths > 24) / words,
        by((last == 33) | (last == 63)) / words, s.per_doc(same) / size,
    ]).astype(np.float64)


def _lines(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of the document (by their words)."""
    w = s.words
    if not len(w.start):
        return np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
    breaks = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(s.data == 10, out=breaks[1:])
    line = breaks[w.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(new)
    step = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
    sums = np.add.reduceat(s.hashes * (_text.mix(step.astype(np.uint64)) | np.uint64(1)), at)
    return np.bincount(w.doc[at], minlength=s.n), repeated(w.doc[at], sums, s.n)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))
