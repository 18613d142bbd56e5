"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (a fixed list, and words that the labelled rows
show to be toxic), how often lexicon words stand near the second person,
capitals, punctuation and obfuscated spellings, besides the surface features.
Trees are grown on quantile bins by logistic loss; calibration is isotonic, on
scores that each fold of the labelled rows gets from words and trees learned
without it.

Learning uses at most ``MAX_LABELLED`` labelled rows, those with the lowest
hash of their id, and keeps the ``LEARNED`` words that stand out most; scoring
reads whole texts of all rows. A null or empty text
has the features of an empty document. With one label only, the score is that
label's share. Repeated rows count as rows; rows with null ids or labels aren't
learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _features, _spark, _text
from tidemark.llm.quality_ranking import MAX_LABELLED, apply, labelled

# Insults, and words for the second person.
INSULTS = (
    "idiot idiots moron morons loser losers stupid dumb fool fools clown clowns scum trash garbage pathetic worthless "
    "disgusting vermin filth imbecile cretin dimwit jerk bastard pig pigs rat rats hate ugly liar coward "
    "dumm dummkopf trottel arschloch idioten depp abschaum wertlos connard salaud crétin débile imbécile ordure "
    "tonto estúpido idiota imbécil basura inútil cabrón"
).split()
SECOND_PERSON = "you your yours yourself u ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
LEET = str.maketrans("013457@$!|", "oieastasil")

NEAR = 5  # words
LEARNED = 400  # words at most, a bound for the model
TREES, DEPTH, RATE, BINS, LEAST, L2, FOLDS = 80, 3, 0.15, 32, 20, 1.0, 4


def _hashes(words) -> np.ndarray:
    data, offs = _text.utf8(pa.array(list(words)))
    w = _text.Words(data, offs)
    return np.sort(w.hashes())


_FIXED = {}


def _fixed() -> dict[str, np.ndarray]:
    if not _FIXED:
        _FIXED.update(insults=_hashes(INSULTS), you=_hashes(SECOND_PERSON))
    return _FIXED


def _within(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[at] == x


def _plain(texts: pa.Array) -> tuple[_text.Words, np.ndarray]:
    """Lower-case words of letters and digits, with their hashes."""
    w = _text.Words(*_text.utf8(_features.lowered(texts)), letters_only=True)
    return w, w.hashes()


def _obfuscated(s: _features.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Words with digits or symbols between letters, and those of them that spell an insult."""
    w, n = s.words, s.n
    letter = (_features.CLASSES["lower"] + _features.CLASSES["upper"] + _features.CLASSES["wide"])[s.data]
    odd = (_features.CLASSES["digit"] + _features.CLASSES["symbol"] + _features.CLASSES["shout"] + _features.CLASSES["stop"])[s.data]
    inner = np.zeros(len(s.data) + 1, np.int64)
    if len(s.data) > 2:
        between = (odd[1:-1] > 0) & (letter[:-2] > 0) & (letter[2:] > 0)
        inner[2:-1] = np.cumsum(between)
        inner[-1] = inner[-2]
    marked = np.flatnonzero((inner[w.end - 1] - inner[np.minimum(w.start + 1, w.end - 1)]) > 0) if len(w.end) else np.zeros(0, np.int64)
    spelled = np.zeros(n, np.int64)
    raw = s.data.tobytes()
    known = set(INSULTS)
    for k in marked:
        word = raw[w.start[k] : w.end[k]].decode("utf-8", "replace").lower()
        flat = "".join(c for c in word.translate(LEET) if c.isalpha())
        bare = "".join(c for c in word if c.isalpha())
        spelled[w.doc[k]] += flat in known or bare in known
    return np.bincount(w.doc[marked], minlength=n), spelled


def features(texts: pa.Array, lexicons: list[np.ndarray]) -> np.ndarray:
    """Features of each text; those of each lexicon side by side, as many columns for each."""
    s = _features.Slice(texts)
    w, h = _plain(texts)
    n, words = s.n, np.maximum(w.count, 1)
    fixed = _fixed()
    bad = _within(h, fixed["insults"])
    you = _within(h, fixed["you"]).astype(np.int64)
    before = np.zeros(len(h) + 1, np.int64)
    np.cumsum(you, out=before[1:])
    low = np.maximum(np.arange(len(h)) - NEAR, w.first[:-1][w.doc]) if len(h) else np.zeros(0, np.int64)
    high = np.minimum(np.arange(len(h)) + NEAR + 1, w.first[1:][w.doc]) if len(h) else np.zeros(0, np.int64)
    close = before[high] > before[low]
    by = lambda mask: np.bincount(w.doc[mask], minlength=n)
    odd, spelled = _obfuscated(s)
    common = [by(bad), by(bad) / words, by(bad & close) / words, by(you > 0) / words, odd / words, spelled, spelled / words, _features.surface(s)]
    out = []
    for learned in lexicons:
        own = _within(h, learned)
        kinds = np.bincount(w.doc[own], minlength=n) - _features.repeated(w.doc[own], h[own], n)
        out += [by(own), by(own) / words, kinds, by(own & close) / words, (by(bad) + spelled + by(own)) / words, *common]
    return np.column_stack(out).astype(np.float64)


def fold_of(key: str) -> Column:
    """The fold of a labelled row, by a hash of its id."""
    return F.pmod(F.xxhash64(key, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def lexicons(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bound: int) -> list[np.ndarray]:
    """Hashes of the words whose share of toxic rows stands out most: for each fold among the others' labelled rows, then among all."""
    key = F.col(f"`{doc_id}`")
    marks = labels.select(key.alias("_id"), F.col(f"`{label}`").cast("double").alias("_y")).dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(bound)
    marks = marks.withColumn("_fold", fold_of("_id"))
    sums = {r["_fold"]: (r["a"], r["n"]) for r in marks.groupBy("_fold").agg(F.sum("_y").alias("a"), F.count("*").alias("n")).collect()}
    rows = docs.select(key.alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(marks), "_id").select("_y", "_text", "_fold")

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                w, h = _plain(part.column(1))
                pairs = np.unique(np.rec.fromarrays([h, w.doc], names="h,d"))
                y, fold = part.column(0).to_numpy()[pairs.d], part.column(2).to_numpy()[pairs.d]
                word, which = np.unique(pairs.h, return_inverse=True)
                at = which * FOLDS + fold
                size = len(word) * FOLDS
                a, b = np.bincount(at, weights=y, minlength=size).reshape(-1, FOLDS), np.bincount(at, minlength=size).astype(float).reshape(-1, FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, a.T), *map(pa.array, b.T)], names)

    names = ["h", *[f"{c}{k}" for c in "an" for k in range(FOLDS)]]
    counts = rows.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'h' else 'double'}" for c in names)).groupBy("h").agg(*[F.sum(c).alias(c) for c in names[1:]])
    counts = _spark.stored(counts.filter(f"{' + '.join(names[1 : FOLDS + 1])} >= 3"))
    out = []
    for left_out in [*range(FOLDS), None]:
        own = [k for k in range(FOLDS) if k != left_out]
        total, toxic = sum(sums.get(k, (0, 0))[1] for k in own), sum(sums.get(k, (0, 0))[0] for k in own)
        if not 0 < toxic < total:
            out.append(np.zeros(0, np.uint64))
            continue
        base = toxic / total
        a, n = (sum((F.col(f"{c}{k}") for k in own), F.lit(0.0)) for c in "an")
        # toxic rows among the word's rows against what its rows would have by chance, in standard deviations
        z = (F.col("a") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
        best = counts.select("h", a.alias("a"), n.alias("n")).filter("a >= 3").withColumn("z", z).filter((F.col("z") > 3) & (F.col("a") > 0.5 * F.col("n")))
        found = best.orderBy(F.desc("z"), "h").limit(LEARNED).toPandas()
        out.append(np.sort(found["h"].to_numpy(np.int64).view(np.uint64)))
    return out


@dataclass(frozen=True)
class Trees:
    base: float
    edges: list
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def _binned(x: np.ndarray, edges: list) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, np.int64)


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[:-1])) for c in x.T]
    binned = _binned(x, edges)
    n, d = binned.shape
    width = BINS + 1
    flat = binned + np.arange(d) * width
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    margin = np.full(n, base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, leaf = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (leaves, float)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == k)
                cut[t, k] = width  # all go left unless a split helps
                if len(mine) >= 2 * LEAST:
                    size = d * width
                    at = flat[mine].ravel()
                    sums = [np.bincount(at, weights=np.repeat(v, d), minlength=size).reshape(d, width).cumsum(axis=1) for v in (g[mine], h[mine], np.ones(len(mine)))]
                    (gl, hl, nl), (ga, ha, na) = sums, (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                    gain[(nl < LEAST) | (na - nl < LEAST)] = 0
                    if gain.max() > 1e-9:
                        feature[t, k], cut[t, k] = divmod(int(gain.argmax()), width)
                node[mine] = 2 * k + 1 + (binned[mine, feature[t, k]] > cut[t, k])
        place = node - inner
        value = np.bincount(place, weights=g, minlength=leaves) / (np.bincount(place, weights=h, minlength=leaves) + L2)
        leaf[t] = RATE * value
        margin += leaf[t][place]
    return Trees(base, edges, feature, cut, leaf)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing step fit of ``y`` on ``margin`` (pool adjacent violators)."""
    at, which = np.unique(margin, return_inverse=True)
    n = np.bincount(which).astype(float)
    blocks: list[list[float]] = []  # mean, weight, last knot
    for a, m, w in zip(at, np.bincount(which, weights=y) / n, n, strict=True):
        blocks.append([m, w, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, a2 = blocks.pop()
            m1, w1, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, a2])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass(frozen=True)
class Model:
    share: float
    trees: Trees | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margin(x)
        step = self.values[np.minimum(np.searchsorted(self.knots, margin), len(self.knots) - 1)]
        return 0.999 * step + 0.001 / (1 + np.exp(-margin))  # the margin orders what a step holds level


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """``x`` has the features with each fold's lexicon, then those with the whole one."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(float(y.mean()) if len(y) else 0.0)
    each = np.split(x, FOLDS + 1, axis=1)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.all():
            continue
        own = y[rest]
        # with one label only there are no trees: all rows of the fold get the same margin
        margin[~rest] = grow(each[k][rest], own).margin(each[k][~rest]) if len(set(own)) > 1 else 0.0
    return Model(float(y.mean()), grow(each[-1], y), *isotonic(margin, y))


def detect(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = MAX_LABELLED) -> DataFrame:
    """Every row of ``docs`` with its ``score``, learned from the rows of ``labels``."""
    _spark.small_batches(docs.sparkSession)
    learned = lexicons(docs, labels, doc_id, text, label, bound)
    x, y, fold = labelled(docs, labels, label, lambda texts: features(texts, learned), doc_id, text, bound, fold_of)
    return apply(docs, fit(x, y, fold), lambda texts: features(texts, learned[-1:]), keep, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _spark.table(spark, sf_dir, "labels")
    held = _spark.fixed_remainder(F.col("doc_id"), 5) == 0
    scored = detect(docs.withColumn("held_out", held), labels.filter(~held), keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
