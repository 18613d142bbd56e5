"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and reads again for the next.
All but the last return the columns of ``documents``. Documents leave only by a
stage's decision: texts without a letter or like no learned language (if any is
learned), all but one of each near-duplicate class, and those with a benchmark
item's text.
Mixing keeps every document and decides their order, which is the order of rows
in its files; the token files follow it (the place of a row in its file names
it), or ascending ids where the input isn't read from files.

Near duplicates and matches with a benchmark are told apart by id and text, so rows
with a null id and rows that share an id are judged like others; of equal rows one
stays. Empty input gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _spark, decontaminate, language_id, near_dedup, pfair, token_files


#: A document is like no learned language below this share of what all but a hundredth of the language's own reach.
FAR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(f"{c}{uuid.uuid4().hex}" for c in ("lang", "score", "cosine"))
    lang_of, _, near = names
    model = language_id.learn(docs)
    if not model[0]:  # no document has a language: there is nothing to judge by
        return docs
    seen = _spark.stored(language_id.identify(docs, model, keep=tuple(docs.columns), names=names))
    known = F.when(F.col("lang") == F.col(lang_of), F.col(near))
    least = {r[lang_of]: FAR * r["c"] for r in seen.groupBy(lang_of).agg(F.percentile_approx(known, 0.01).alias("c")).collect() if r["c"] is not None}
    enough = F.lit(0.0)
    for lang, cosine in least.items():  # one for each language
        enough = F.when(F.col(lang_of) == lang, cosine).otherwise(enough)
    return seen.filter((F.col(lang_of) != "und") & (F.col(near) > 0) & (F.col(near) >= enough)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = f"name{uuid.uuid4().hex}"  # of a row: its id and text
    own = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = decontaminate.contaminated(own.select(name, "text"), _spark.table(spark, sf_dir, "benchmark"), doc_id=name)
    return own.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    output = tuple(f"{c}{uuid.uuid4().hex}" for c in ("block", "slot", "position"))
    placed = pfair.mix(docs, output=output)
    return placed.repartitionByRange(n, output[2]).sortWithinPartitions(output[2]).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")  # by number: names sort otherwise from 100,000 on
        placed = docs.select("doc_id", "text", part.alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = ("_file", "_row")
    except AnalysisException:  # not read from files
        placed, order = docs, ("doc_id",)
    return token_files.write_and_read(placed, order=order)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _spark.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
