"""Filtered listing and exact vector search over a catalogue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from carrel.functions.vector import Embedder, distance, literal, score
from carrel.operators.predicates import blanks_dropped, predicate


def filtered(df: DataFrame, filters: dict[str, Any] | None, variant: str | None = None) -> DataFrame:
    p = predicate(df, filters, variant)
    return df if p is None else df.filter(p)


def listing(df: DataFrame, filters: dict[str, Any] | None, n: int | None = 10, order: str = "seq", variant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first n matches in order, their total before truncation as one row total_found). None or 0: all."""
    if n is not None and n < 0:
        raise ValueError("n must not be negative")
    found = filtered(df, filters, variant)
    total = found.agg(F.count("*").alias("total_found"))
    return (found.orderBy(order).limit(n) if n else found.orderBy(order)), total


def nearest(df: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", filters: dict[str, Any] | None = None, metric: str = "l2") -> DataFrame:
    """The k rows nearest to one query, with distance and score; ties by key. Sorting and limit fuse to a top-k per task."""
    if k <= 0:
        raise ValueError("k must be positive")
    found = filtered(df, filters).withColumn("distance", distance(F.col(vector), literal(query), metric))
    # rows without a distance sort last and go after the limit: a filter below it would be pushed down and work the distance out twice
    found = found.orderBy(F.col("distance").asc_nulls_last(), key).limit(k).filter(F.col("distance").isNotNull())
    return found.withColumn("score", score(F.col("distance")))


def nearest_batch(df: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding", block: int = 10_000, metric: str = "l2") -> DataFrame:
    """(query_id, key, distance, rank, score): the k rows nearest to each of a stated set of queries; ties by key. Null vectors, and those of another length, are near to nothing.

    Queries are counted first and sent to the executors in blocks of about ``block``, dealt by the hash of their id, each in a scan of its own (rows that share an id are in one block).
    Distances are worked out in Arrow batches, the same sums in the same order as ``distance``. A task keeps its k best of a query before the shuffle, so what moves is
    tasks * queries * k rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    place = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_nearest_block(df, asked if blocks == 1 else asked.filter(place == i), k, key, vector, metric) for i in range(blocks)]
    while len(parts) > 1:  # in pairs, as a long chain would be a deep plan
        parts = [reduce(DataFrame.unionByName, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    ranked = parts[0].withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key)))
    return ranked.filter(F.col("rank") <= k).withColumn("score", score(F.col("distance")))


def _nearest_block(df: DataFrame, asked: DataFrame, k: int, key: str, vector: str, metric: str) -> DataFrame:
    """(query_id, key, distance): for each task and query of one block the k nearest rows."""
    spark = df.sparkSession
    rows = asked.collect()  # a block at most
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in sorted({len(r["v"]) for r in rows}):
        mine = [i for i, r in enumerate(rows) if len(r["v"]) == n]
        by_size[n] = np.array(mine), np.array([rows[i]["v"] for i in mine], float).reshape(len(mine), n)
    ids = pa.array([r["query_id"] for r in rows], to_arrow_type(asked.schema["query_id"].dataType))
    shared = spark.sparkContext.broadcast((by_size, ids))
    names = ["query_id", key, "distance"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, ids = shared.value
        held: pa.Table | None = None
        for batch in batches:
            vectors = batch.column(vector)
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            new = [] if held is None else [held]
            for n, (queries, q) in groups.items():
                at = np.flatnonzero(sizes == n)
                x = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)
                for a in range(0, len(at) if n else 0, TILE):
                    for b in range(0, len(q), TILE):
                        d = distances(x[a : a + TILE], q[b : b + TILE], metric)
                        rank = np.minimum(k, d.shape[0]) - 1
                        limit = np.partition(np.where(np.isnan(d), np.inf, d), rank, axis=0)[rank]
                        row, col = np.nonzero(d <= limit)  # ties at the limit are all kept
                        new.append(pa.table([pa.array(queries[b + col]), batch.column(key).take(pa.array(at[a + row])), pa.array(d[row, col])], names=names))
            if new:
                held = best(pa.concat_tables(new), k, key)
        if held is not None and held.num_rows:
            yield from held.set_column(0, "query_id", ids.take(held.column("query_id").combine_chunks())).to_batches()

    ddl = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(key, df.schema[key].dataType), StructField("distance", DoubleType())])
    return df.select(key, vector).mapInArrow(task, ddl)


#: Rows and queries whose distances are worked out at once.
TILE = 512


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows and queries; sums run from the first place to the last, as ``distance`` has them. nan where a cosine has a zero vector."""

    def summed(a: np.ndarray, b: np.ndarray, f) -> np.ndarray:
        out = f(a[..., 0], b[..., 0]) + 0.0
        for j in range(1, a.shape[-1]):
            out += f(a[..., j], b[..., j])
        return out

    if metric == "l2":
        return summed(x[:, None], q[None], lambda a, b: (a - b) * (a - b))
    with np.errstate(invalid="ignore", divide="ignore"):
        sizes = np.sqrt(summed(x, x, np.multiply))[:, None] * np.sqrt(summed(q, q, np.multiply))
        return 1 - summed(x[:, None], q[None], np.multiply) / sizes


def best(t: pa.Table, k: int, key: str) -> pa.Table:
    """The rows of the k least (distance, key) of each query."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("query_id", "distance", key)], null_placement="at_start"))
    query = t.column("query_id").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return t.filter(pa.array(place < k))


def shaped(df: DataFrame, id_col: str, cid: Column, summary: Column, metadata: Column, with_score: bool) -> DataFrame:
    """The columns of a hit."""
    cols = [F.col(id_col).alias("id"), F.coalesce(cid, F.lit("")).alias("cid")]
    return df.select(*cols, *([F.col("score")] if with_score else []), summary.alias("summary"), metadata.alias("metadata"))


def search(df: DataFrame, query: str | None = None, filters: dict[str, Any] | None = None, n: int | None = None, *, embedder: Embedder, text: str, key: str) -> DataFrame:
    """Routes a request: filters and a query rank the matches, filters alone list them, a query alone ranks all."""
    filters = blanks_dropped(filters or {})
    query = (query or "").strip()
    if not query:
        if not filters:
            raise ValueError("a query or a filter is needed")
        return listing(df, filters, 10 if n is None else n, key)[0]
    ranked = filtered(df, filters).withColumn("_v", embedder.column(F.col(text)))
    return nearest(ranked, embedder.vector(query), n or (10 if filters else 5), key, "_v").drop("_v")
