"""Stored tables on plain Parquet: a company's rows are replaced as a whole, and a load becomes visible at once.

A table is kept in buckets by its key, each a folder of Parquet files. A version is a small file that names the folder of
every bucket; versions are numbered and never written over. A load writes the buckets it touches to new folders and then
renames one finished version file into place, so readers see the old or the new version whole, whenever a job ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from larkspur.operators.vectors import embedded, pending

#: Buckets of a new table.
BUCKETS = 64


def replaced(old: DataFrame, new: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of all keys in ``fetched``, and ``new``'s rows of those keys.

    ``fetched`` holds the keys whose fetch succeeded: a key without new rows loses its old ones, a key that failed keeps
    them. Rows without a key stay. Repeated keys in ``fetched`` count once.
    """
    keys = fetched.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new.join(keys, key, "left_semi"), allowMissingColumns=True)


def carry_vectors(new: DataFrame, old: DataFrame, text: str, vector: str, key: str = "nct_id") -> DataFrame:
    """Fill missing vectors of ``new`` from ``old`` rows with the same key and the same text; of several the greatest."""
    known = old.where(F.col(vector).isNotNull()).select(key, F.sha2(text, 256).alias("__h"), F.col(vector).alias("__v")).groupBy(key, "__h").agg(F.max("__v").alias("__v"))
    both = new.withColumn("__h", F.sha2(text, 256)).join(known, [key, "__h"], "left")
    return both.withColumn(vector, F.coalesce(vector, "__v")).select(*new.columns)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _files(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def _version(spark: SparkSession, root: str, name: str) -> dict | None:
    """The newest version, ``{number, key, buckets, schema, parts}``, or None where the table was never published."""
    folder = f"{root}/{name}/versions"
    numbers = _listed(spark, folder)
    if not numbers:
        if _files(spark, folder)[1].exists(_files(spark, folder)[0]):
            raise RuntimeError(f"{folder} holds no version any more; the table is not taken for an empty one")
        return None
    return {"number": int(numbers[-1])} | json.loads(spark.read.text(f"{folder}/{numbers[-1]}", wholetext=True).first()[0])


def _publish(spark: SparkSession, root: str, name: str, number: int, version: dict) -> None:
    """Put a finished version file in place by one rename, which fails if another writer has taken the number."""
    draft, fs = _files(spark, f"{root}/{name}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    final, _ = _files(spark, f"{root}/{name}/versions/{number:012d}")
    fs.mkdirs(final.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    kept = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, kept)


def _read(spark: SparkSession, version: dict, paths: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(version["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The version last published, or None where there never was one."""
    version = _version(spark, root, name)
    return None if version is None else _read(spark, version, sorted(version["parts"].values()))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rewrite(spark: SparkSession, root: str, name: str, before: dict | None, key: str, buckets: int, touched: list[int], rows: DataFrame) -> None:
    """Write the rows of the touched buckets and publish a version that takes the other buckets over as they are.

    Rows are gathered by bucket, and a bucket with very many rows is split over several tasks while it is written.
    """
    folder = f"{root}/{name}/data/{uuid.uuid4().hex}"
    rows.withColumn("__bucket", _bucket(key, buckets)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(folder)
    written = {d.split("=")[1]: f"{folder}/{d}" for d in _listed(spark, folder) if d.startswith("__bucket=")}
    kept = {b: p for b, p in (before or {"parts": {}})["parts"].items() if int(b) not in touched}
    number = before["number"] + 1 if before else 1
    _publish(spark, root, name, number, {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": kept | written})


def ingest(
    spark: SparkSession, root: str, name: str, new: DataFrame, fetched: DataFrame, key: str = "company_ticker",
    carry: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Replace the rows of the fetched keys in the stored table and publish the result.

    Only the buckets of fetched keys are read and written. carry: ``(row key, text, vector)`` columns; a new row without a
    vector keeps the one that the old row with its key and text had. Null keys in ``fetched`` count for nothing. A load
    that is run again leaves the same table.
    """
    before = _version(spark, root, name)
    buckets = before["buckets"] if before else BUCKETS
    keys = fetched.select(key).where(F.col(key).isNotNull()).distinct()
    # Bucket numbers, at most as many as there are buckets.
    touched = sorted(r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect())
    paths = [before["parts"][str(b)] for b in touched if str(b) in before["parts"]] if before else []
    if paths:
        old = _read(spark, before, paths)
        rows = replaced(old, carry_vectors(new, old, carry[1], carry[2], carry[0]) if carry else new, keys, key)
    else:
        rows = new.join(keys, key, "left_semi")
    _rewrite(spark, root, name, before, key, buckets, touched, rows.select(*new.columns))
    return current(spark, root, name)


def embed_stored(spark: SparkSession, root: str, name: str, embed: Callable[[list[str]], np.ndarray], id_col: str, text: str, vector: str) -> DataFrame:
    """Fill the vectors that stored rows with a text lack, and publish; only buckets with such rows are written.

    ``embed`` gets texts in batches within the tasks. Rows without a text stay without a vector; ids must be unique.
    """
    before = _version(spark, root, name)
    if before is None:
        raise ValueError(f"no table {name} under {root}")
    key, buckets = before["key"], before["buckets"]
    touched = sorted(r[0] for r in pending(current(spark, root, name), text, vector).select(_bucket(key, buckets)).distinct().collect())
    if touched:
        rows = _read(spark, before, [before["parts"][str(b)] for b in touched])
        made = embedded(pending(rows, text, vector), embed, id_col, text).withColumnRenamed("vector", "__made")
        filled = rows.join(made, id_col, "left").withColumn(vector, F.coalesce(vector, F.col("__made"))).select(*rows.columns)
        _rewrite(spark, root, name, before, key, buckets, touched, filled)
    return current(spark, root, name)


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Delete all but the ``keep`` newest versions and the folders that only they name; returns how many folders went.

    Readers of a deleted version fail, and so would a load in progress, so this runs apart from loads.
    """
    versions = _listed(spark, f"{root}/{name}/versions")
    read = lambda v: json.loads(spark.read.text(f"{root}/{name}/versions/{v}", wholetext=True).first()[0])["parts"].values()
    used = {p.rsplit("/", 2)[-2] for v in versions[-keep:] for p in read(v)}
    gone = [f"data/{d}" for d in _listed(spark, f"{root}/{name}/data") if d not in used]
    for path in [*(f"versions/{v}" for v in versions[:-keep]), *gone]:
        at, fs = _files(spark, f"{root}/{name}/{path}")
        fs.delete(at, True)
    return len(gone)
