"""Token-ID files with fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A file has the
documents of one range of ids in ascending order: a header, the documents' ids
and token counts, a bit for each that has no id, the byte offset of each block of
``BLOCK`` tokens, then the blocks. Any token is found from its index alone, and a block is unpacked with
a few numpy operations. Files are written by executors to the shared folder
under a name of the attempt, then renamed, so a task that runs twice leaves
one whole file; a manifest of one row per file has the tokens before each.

With a tokenizer that normalises and splits as ``SPLITTING`` says, words between
ASCII white space are tokenised apart and remembered: no token spans white space,
so ids are those of the whole text. Any other tokenizer gets whole texts.

Null and empty texts have the end id alone. Rows with equal ids keep the order
of their texts; null ids come first and stay null. Ids must be whole numbers. An
empty table makes no files and an empty result. Other columns of the input may
have any name.
"""

from __future__ import annotations

import bisect
import functools
import gc
import itertools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _spark, _text

MAGIC = b"TIDETOK2"
HEADER = struct.Struct("<8sIIqqq")  # magic, bits, block, documents, tokens, blocks
BLOCK = 4096  # tokens; a multiple of 8, so a block ends at a byte
END_ID = 2
REMEMBERED = 400_000  # words, and as many of their letters, in a worker process: about 150 MB
FILE_MB = 64
TOKENIZER = "word_bpe_49k.json"
# How the tokenizer that words are taken apart for normalises and splits texts.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Lower-case precomposed Latin letters, common signs after them, and the rest of each line.
LATIN = re.compile("^([a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]*)([.,;:!?]*)(.*)$", re.MULTILINE).findall


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Least significant bit first, no gaps, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK, missing: np.ndarray | None = None):
    """The parts of a file, in order; ``missing`` says which documents have no id."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id is over the vocabulary")
    n_blocks = -(-len(ids) // block)
    size = block * bits // 8
    yield HEADER.pack(MAGIC, bits, block, len(doc_ids), len(ids), n_blocks)
    yield doc_ids.astype("<i8").tobytes()
    yield counts.astype("<i8").tobytes()
    yield np.packbits(np.zeros(len(doc_ids), bool) if missing is None else missing, bitorder="little").tobytes()
    yield (np.arange(n_blocks + 1, dtype="<i8") * size).tobytes()
    for at in range(0, len(ids), block):
        yield pack(ids[at : at + block], bits)


class TokenFile:
    """Reads a file's index; tokens are read and unpacked by block when asked for."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block, n, self.n_tokens, self.n_blocks = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        flags = -(-n // 8)
        raw = self._read(HEADER.size, 16 * n + flags + 8 * (self.n_blocks + 1))
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        self.missing = np.unpackbits(np.frombuffer(raw, np.uint8, flags, 16 * n), count=n, bitorder="little").astype(bool)
        self.offsets = np.frombuffer(raw, "<i8", self.n_blocks + 1, 16 * n + flags)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.data_at = HEADER.size + len(raw)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Tokens ``first`` to before ``last`` of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        n = min(b * self.block, self.n_tokens) - a * self.block
        raw = self._read(self.data_at + int(self.offsets[a]), -(-n * self.bits // 8))
        return unpack(raw, n, self.bits)[first - a * self.block : last - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow can open by a uri; a bare path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


class Encoder:
    """Ids of texts; words once met are remembered, up to ``REMEMBERED`` of them.

    The tokenizer splits letters from the signs after them and puts them in lower
    case. A word of Latin letters and common signs is therefore put together from
    its lower-case letters, which go straight to the tokenizer's model, and its
    signs; all other words go to the tokenizer whole.
    """

    def __init__(self, tokenizer: str = TOKENIZER):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = _tokenizer(tokenizer)
        self.bits = width(self.tokenizer.get_vocab_size())
        self.model = Tokenizer(self.tokenizer.model)
        self.bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shape = json.loads(self.tokenizer.to_str())
        self.by_words = all(shape[k] == v for k, v in SPLITTING.items())
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of each word, from one call."""
        coded = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, "<u4").tobytes()
        of = np.array(coded.word_ids, np.int64) if ids else np.zeros(0, np.int64)
        ends = (np.searchsorted(of, np.arange(len(words) + 1)) * 4).tolist()
        return [ids[p:q] for p, q in zip(ends[:-1], ends[1:], strict=True)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met before."""
        lower = b"\n".join(words).decode("utf-8").lower()
        parts = LATIN(lower)  # letters, signs, what else there is
        if len(parts) != len(words):  # a word has a character that the pattern takes for a line's end
            parts = [("", "", "x")] * len(words)
        plain = [k for k, (stem, _, rest) in enumerate(parts) if stem and not rest]
        need = {parts[k][0] for k in plain}
        signs = {parts[k][1] for k in plain} - {""}
        stems = {x: self.stems[x] for x in need.union(signs).intersection(self.stems)}
        stems[""] = b""
        if order := list(signs.difference(stems)):
            stems.update(zip(order, self._encode(order, self.tokenizer), strict=True))
        if new := list(need.difference(stems)):
            # the model reads bytes as printable characters, ASCII letters as themselves; the line break's is U+010A
            new.sort(key=str.isascii)
            wide = bisect.bisect_left(new, True, key=str.isascii)
            shown = self.bytewise.pre_tokenize_str("\n".join(new[:wide]))[0][0].split("\u010a") if wide else []
            stems.update(zip(new, self._encode(shown + new[wide:], self.model), strict=True))
        if len(self.stems) + len(new) <= REMEMBERED:
            self.stems.update(stems)
        made = {words[k]: stems[parts[k][0]] + stems[parts[k][1]] for k in plain}
        if len(made) < len(words):
            whole = [w for w in words if w not in made]
            made.update(zip(whole, self._encode([w.decode("utf-8") for w in whole], self.tokenizer), strict=True))
        return made

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        if not self.by_words:
            coded = (self.tokenizer.encode(t.decode("utf-8"), add_special_tokens=False) for t in texts)
            return [np.array(c.ids, "<u4").tobytes() for c in coded]
        split = [t.split() for t in texts]
        words = list(itertools.chain.from_iterable(split))
        ids = list(map(self.known.get, words))
        if missing := [k for k, x in enumerate(ids) if x is None]:
            made = self._learn(list({words[k] for k in missing}))
            for k in missing:
                ids[k] = made[words[k]]
            if len(self.known) + len(made) <= REMEMBERED:
                self.known.update(made)
        out, at = [], 0
        for own in split:
            out.append(b"".join(ids[at : at + len(own)]))
            at += len(own)
        return out


@functools.cache
def encoder_of(tokenizer: str) -> Encoder:
    """One for each worker process, whichever tasks it runs."""
    return Encoder(tokenizer)


def _publish(store: fs.FileSystem, attempt: str, target: str) -> None:
    """Gives the file its name; one that is there already is from another attempt of the task, and equal."""
    there = lambda: store.get_file_info(target).type == fs.FileType.File
    if not there():
        try:
            store.move(attempt, target)
            return
        except OSError:  # another attempt was first
            if not there():
                raise
    store.delete_file(attempt)


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, order: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Writes the files of ``docs`` in the order of ``order``; their manifest: ``file, n_docs, n_tokens, before``."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    if docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be a whole number: files hold ids of 64 bits")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(order, names, strict=True)], F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # texts' hashes part rows of one id, or of none, among the files
    rows = rows.withColumn("_tie", F.xxhash64("_text")).repartitionByRange(files, *names, "_tie").sortWithinPartitions(*names, "_tie").select("_id", "_text")

    def run(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        kind = "<u4" if encoder.bits > 16 else "<u2"
        place, files_made = TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, size = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), kind)
            store, top = opened(path)
            store.create_dir(top, recursive=True)
            name = f"tokens-{place:06d}-{files_made:05d}.bin"
            attempt = f"{top}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(attempt) as out:
                missing = np.array([x is None for x in doc_ids])
                for part in encode_file(np.array([x or 0 for x in doc_ids], np.int64), np.array(counts), ids, encoder.bits, missing=missing):
                    out.write(part)
            _publish(store, attempt, f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]})

        gc.disable()  # nothing here makes cycles, and the remembered words are long to walk
        try:
            for batch in batches:
                doc_ids += batch.column(0).to_pylist()
                data, offs = _text.utf8(batch.column(1))
                raw = data.tobytes()
                for ids in encoder([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]):
                    ids += end
                    counts.append(len(ids) // 4)
                    parts.append(np.frombuffer(ids, "<u4").astype(kind).tobytes())
                    size += len(parts[-1])
                if size >= FILE_MB << 20:
                    yield flush()
                    files_made += 1
                    doc_ids, counts, parts, size = [], [], [], 0
            if doc_ids:
                yield flush()
        finally:
            gc.enable()

    made = rows.mapInArrow(run, "file string, n_docs long, n_tokens long").collect()  # one row per file
    before, out = 0, []
    for r in sorted(made, key=lambda r: r["file"]):
        out.append((r["file"], r["n_docs"], r["n_tokens"], before))
        before += r["n_tokens"]
    return spark.createDataFrame(out, "file string, n_docs long, n_tokens long, before long")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def run(batches):
        store, top = opened(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as file:
                    f = TokenFile(file)
                    step = 2000
                    for a in range(0, len(f.counts), step):
                        b = min(a + step, len(f.counts))
                        first = int(f.starts[a])
                        ids = f.tokens(first, int(f.starts[b])).astype("<u4", copy=False)
                        crc = [zlib.crc32(ids[int(f.starts[i]) - first : int(f.starts[i + 1]) - first].tobytes()) for i in range(a, b)]
                        yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[a:b], mask=f.missing[a:b]), pa.array(f.starts[a:b] + before), pa.array(f.counts[a:b]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    spark = docs.sparkSession
    path = path or _spark.shared_dir(spark)
    return read(spark, path, write(docs, path, **how))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"))
