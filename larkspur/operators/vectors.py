"""Exact search of vectors by cosine: one query, or a set of queries against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Rows and queries per block of a search with many queries.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(v: Column, size: int) -> Column:
    """A vector of the wanted length, without nulls and NaN, not all zero."""
    return v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def topk(rows: DataFrame, query: list[float], k: int, floor: float, id_col: str = "id", vector: str = "v") -> DataFrame:
    """The k rows most similar to the query, then those of them with a cosine of at least ``floor``.

    Equal scores go to the smaller id. Rows without a usable vector of the query's length don't count; a query that is all
    zero finds nothing. Rows of one study under several companies are all kept.
    """
    length = float(np.sqrt(np.sum(np.square(np.asarray(query, float)))))
    if not length:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    dot = F.aggregate(F.zip_with(vector, unit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = rows.where(usable(F.col(vector), len(query))).withColumn("score", dot / norm(F.col(vector)))
    return scored.orderBy(F.desc("score"), id_col).limit(k).where(F.col("score") >= floor)


def topk_per_query(rows: DataFrame, queries: DataFrame, k: int, floor: float, size: int) -> DataFrame:
    """``(query_id, id, score)``: for each query (query_id, v) its k most similar rows (id, v), score >= floor, in order
    of score and then id; a row with the query's own id is not its neighbour.

    Both sides are cut into blocks by their number; each pair of blocks is one matrix product, of which only the k best
    rows of a query go on. Unusable vectors on either side give nothing.
    """
    rows = rows.where(usable(F.col("v"), size)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    queries = queries.where(usable(F.col("v"), size)).select(F.col("query_id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    row_blocks = -(-rows.count() // BLOCK_ROWS) or 1
    query_blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select(slot(row_blocks).alias("r"), spread(query_blocks).alias("q"), F.lit(False).alias("asks"), "id", "v")
    right = queries.select(spread(row_blocks).alias("r"), slot(query_blocks).alias("q"), F.lit(True).alias("asks"), "id", "v")

    def search(group: pa.Table) -> pa.Table:
        asks, ids = group["asks"].to_numpy(), group["id"].to_numpy()
        v = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, size).astype(np.float64)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        own, wanted = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.array_split(wanted, max(1, len(wanted) // 256)):
            s = u[part] @ u[own].T
            s[ids[part][:, None] == ids[own][None, :]] = -2.0
            for i, q in enumerate(part):
                near = np.flatnonzero(s[i] >= floor)
                near = near[np.lexsort((ids[own[near]], -np.round(s[i][near], 9)))][:k]
                out.append((np.full(len(near), ids[q]), ids[own[near]], s[i][near]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = left.unionByName(right).groupBy("r", "q").applyInArrow(search, "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pending(rows: DataFrame, text: str, vector: str) -> DataFrame:
    """Rows with a text and without a vector."""
    return rows.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(vector).isNull())


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], id_col: str, text: str, batch: int = 100) -> DataFrame:
    """``(id, vector)`` of all rows, by a function that embeds a list of texts, called in batches within the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({id_col: part[id_col], "vector": list(np.asarray(embed(list(part[text])), np.float32))})

    return rows.select(F.col(id_col).cast("long").alias(id_col), text).mapInPandas(run, f"{id_col} long, vector array<float>")


@F.pandas_udf(T.BinaryType())
def packed(v: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats; null stays null."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(b: pd.Series) -> pd.Series:
    """The vector in a text of little-endian 32-bit floats; null, and a length that is no multiple of four, give null."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def kept_index(rows: DataFrame, size: int, path: str) -> DataFrame:
    """Usable vectors at unit length, written once to ``path`` and read from there by every search: ``(id, v)``.

    Rows of another length are left out, so that no search meets them.
    """
    good = rows.where(usable(F.col("v"), size)).select("id", F.col("v").cast("array<double>").alias("v")).withColumn("__n", norm(F.col("v")))
    good.select("id", F.transform("v", lambda x: x / F.col("__n")).alias("v")).write.parquet(path)
    return rows.sparkSession.read.schema("id long, v array<double>").parquet(path)
