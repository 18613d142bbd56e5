"""Language identification with hyperdimensional profiles.

Each letter has a random +-1 vector of ``DIMENSIONS``. A letter trigram is the
product of its letters' vectors, permuted (rotated) by their place; a document
is the sum (bundle) of its trigrams' vectors over the whole text, a language
the bundle of its training documents, each with the same total weight. A
document gets the language with the highest cosine.

Bundling is linear, so training only sums trigram counts by language (a table
bounded by the alphabet, ``SYMBOLS ** 3`` rows a language) and a task bundles each
language's vector from them; only the vectors come to the driver. Scoring counts a slice of documents' trigrams at
once and bundles by one matrix product.

Null or empty texts and texts without letters: ``und``, score 0. Rows with a
null language are scored but not learned from. With no training rows every
text is ``und``. Repeated rows count as rows; other columns may have any name.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _spark, _text

DIMENSIONS = 1024
SYMBOLS = 64  # 0: no letter; 1-26: a-z; the other letters share the rest by code point
SHARPNESS = 20.0
GRAMS = 4096  # vectors held at once
WEIGHT = 1 << 32  # of a training document, spread over its trigrams; a text in Arrow has less than half as many


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            out[i] = i - 96 if 97 <= i <= 122 else 27 + i * 0x9E3779B1 % 0x100000000 % (SYMBOLS - 27)
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    x = _letters()
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    out = np.roll(x, 2, axis=1)[a]
    out *= np.roll(x, 1, axis=1)[b]
    out *= x[c]
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and code of each trigram, and which documents have a letter."""
    data, offs = _text.utf8(pc.binary_join_element_wise(" ", pc.utf8_lower(texts.fill_null("")), " ", ""))
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = heads[offs]
    sym = _symbols()[points]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    letters = np.bincount(doc, weights=sym > 0, minlength=len(offs) - 1) > 0
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0  # one mark after a word stands for what is between words
    keep[bounds[:-1]] = True  # and one before the first
    sym, doc = sym[keep].astype(np.int64), doc[keep]
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    same = doc[:-2] == doc[2:]
    return doc[:-2][same], code[same], letters


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and unit vectors from the rows of ``docs`` with a language."""
    _spark.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _text.slices(batch, "text"):
                doc, code, _ = trigrams(part.column(1))
                size = np.bincount(doc, minlength=part.num_rows)
                weight = np.floor(WEIGHT / np.maximum(size, 1))[doc]
                names = part.column(0).dictionary_encode()
                of = names.indices.to_numpy()[doc]
                for i, name in enumerate(names.dictionary.to_pylist()):
                    mine = of == i
                    total[name] = total.get(name, 0) + np.bincount(code[mine], weights=weight[mine], minlength=SYMBOLS**3)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(sums[at].astype(np.int64))], ["lang", "code", "n"])

    def bundle(key, table):
        table = table.sort_by("code")
        codes, n = table.column("code").to_numpy(), table.column("n").to_numpy().astype(float)
        vector = np.zeros(DIMENSIONS)
        for at in range(0, len(codes), GRAMS):
            vector += n[at : at + GRAMS] @ gram_vectors(codes[at : at + GRAMS])
        return pa.Table.from_pydict({"lang": [key[0].as_py()], "vector": [vector.tolist()]})

    sums = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    bundled = sums.groupBy("lang").applyInArrow(bundle, "lang string, vector array<double>").orderBy("lang").collect()  # one row a language
    names = [r["lang"] for r in bundled]
    vectors = np.array([r["vector"] for r in bundled]).reshape(-1, DIMENSIONS)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return names, (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def cosines(texts: pa.Array, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text's bundle with each profile; which texts have a letter."""
    doc, code, letters = trigrams(texts)
    n = len(texts)
    there = np.bincount(code, minlength=SYMBOLS**3) > 0
    grams = np.flatnonzero(there)
    place = np.cumsum(there) - 1
    dots = np.zeros((n, DIMENSIONS), np.float32)
    for at in range(0, len(grams), GRAMS):
        own = (place[code] >= at) & (place[code] < at + GRAMS) if len(grams) > GRAMS else slice(None)
        vectors = gram_vectors(grams[at : at + GRAMS])
        m = len(vectors)
        counts = np.bincount(doc[own] * m + place[code[own]] - at, minlength=n * m).reshape(n, m).astype(np.float32)
        dots += counts @ vectors
    norm = np.linalg.norm(dots, axis=1, keepdims=True)
    return (dots / np.where(norm > 0, norm, 1)) @ profiles.T, letters


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "similarity")) -> DataFrame:
    """``keep`` with the language, its score (share of a softmax over the cosines) and the cosine, as ``names``."""
    spark = docs.sparkSession
    _spark.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept, whole = docs.select(*[F.col(f"`{c}`") for c in keep]), f"text{uuid.uuid4().hex}"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(whole))

    def predict(batches):
        langs, profiles = shared.value
        for batch in batches:
            for part in _text.slices(batch, whole):
                n = part.num_rows
                lang, score, near = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if langs:
                    cos, letters = cosines(part.column(part.num_columns - 1), profiles)
                    best = cos.argmax(axis=1)
                    e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
                    lang = np.where(letters, np.array(langs, object)[best], "und")
                    score = np.where(letters, 1 / e.sum(axis=1), 0.0)
                    near = np.where(letters, cos.max(axis=1), 0.0)
                more = [pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float)), pa.array(near.astype(float))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], [*part.schema.names[:-1], *names])

    schema = kept.schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return rows.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs = docs.withColumn("held_out", _spark.fixed_remainder(F.col("doc_id"), 4) == 2)
    model = learn(docs.filter(~F.col("held_out")))
    return identify(docs, model, keep=("doc_id", "held_out"))
