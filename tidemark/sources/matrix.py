"""A cache of made tables that knows by digests what it was made from.

A source is a folder of Parquet files. The digest of a file is of its path in the
folder, its length and its footer, which has the schema and every row group's sizes and
statistics. Files are dealt into parts by their path; the digest of a part is of its files
and of the recipe, and names the folder that holds what was made of it. The root is of
all parts. A hit reads names, lengths and footers on the driver and starts no job; after
a change only the parts that it touches are made again.

What is made of a part must depend on the part alone (row-local columns, lookups in
fixed tables). For anything else ``parts=1`` makes the whole table one part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources.tables import object_hash


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, store, path, start: int, size: int) -> bytes:
    stream = store.open(path)
    try:
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def digests(spark: SparkSession, source: str) -> dict[str, str]:
    """The digest of each Parquet file below a folder, or of one file, by its path there."""
    top, store = _store(spark, source)
    out, files = {}, store.listFiles(top, True)
    prefix = store.makeQualified(top).toString().rstrip("/")
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString().removeprefix(prefix).lstrip("/")
        if any(p.startswith(("_", ".")) for p in name.split("/")) or (name and not name.endswith(".parquet")):
            continue
        n = f.getLen()
        size = int.from_bytes(_read(spark, store, f.getPath(), n - 8, 4), "little")
        out[name] = object_hash([name, n, _read(spark, store, f.getPath(), n - 8 - size, size).hex()])
    return out


def _manifest(spark: SparkSession, path: str) -> dict | None:
    where, store = _store(spark, f"{path.rstrip('/')}/manifest.json")
    if not store.exists(where):
        return None
    return json.loads(_read(spark, store, where, 0, store.getFileStatus(where).getLen()))


def _write(spark: SparkSession, path: str, value: dict) -> None:
    where, store = _store(spark, f"{path.rstrip('/')}/manifest.json")
    beside, _ = _store(spark, f"{path.rstrip('/')}/manifest.json.new")
    stream = store.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()
    store.delete(where, False)
    store.rename(beside, where)


def cached(spark: SparkSession, source: str, recipe: dict, make: Callable[[DataFrame], DataFrame], path: str, parts: int = 64) -> tuple[DataFrame, int]:
    """What ``make`` makes of the source's rows, and how many parts had to be made; ``recipe`` says all that ``make`` depends on."""
    files = digests(spark, source)
    if not files:
        raise ValueError(f"no Parquet files in {source}")
    whole = spark.read.parquet(source) if parts == 1 else None
    dealt: dict[int, list[str]] = {}
    for name in sorted(files):
        dealt.setdefault(zlib.crc32(name.encode()) % parts, []).append(name)
    wanted = {object_hash([recipe, parts, [files[n] for n in names]]): names for names in dealt.values()}
    root = object_hash(sorted(wanted))
    found = _manifest(spark, path)
    here = set(found["parts"]) if found else set()
    missing = {d: names for d, names in wanted.items() if d not in here}
    kind = StructType.fromJson(found["schema"]) if found and not missing else None
    for digest, names in missing.items():
        rows = whole if whole is not None else spark.read.parquet(*[f"{source.rstrip('/')}/{n}" if n else source for n in names])
        made = make(rows)
        kind = made.schema
        made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{digest}")
    if missing or found["root"] != root:
        _write(spark, path, {"root": root, "parts": sorted(wanted), "schema": kind.jsonValue() if kind else found["schema"], "recipe": recipe})
        for digest in here - set(wanted):
            where, store = _store(spark, f"{path.rstrip('/')}/{digest}")
            store.delete(where, True)
    kind = kind or StructType.fromJson(found["schema"])
    return spark.read.schema(kind).parquet(*[f"{path.rstrip('/')}/{d}" for d in sorted(wanted)]), len(missing)
