"""The corpus pipeline: five stages from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

1. quality: documents that the classifier scores below its ``THRESHOLD`` go. It learns from the labels' training fold.
2. near_dedup: one row of each component of near duplicates stays, the one with the smallest doc_id, nulls last, and then the one whose other columns sort first
   (five-word shingles, similarity 0.8). Rows count by themselves where they share a doc_id or have none; of rows with the same doc_id and text one stays.
3. decontaminate: documents that share a window of 10 words with a benchmark item go.
4. secrets: found spans are replaced by a mark in the text, and n_chars is counted again; no document goes.
5. mix: the word targets of the sources that are left and how many words of each document the mix takes.

Rows with a null text are kept by stages 2 to 4. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import table, written
from carrel.llm.decontaminate import contaminated_spans
from carrel.llm.dedup import near_duplicates, only
from carrel.llm.mixing import mix
from carrel.llm.quality import THRESHOLD, corpus_model, scored
from carrel.llm.secrets import redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scored(docs.select(*COLUMNS), corpus_model(spark, sf_dir)).filter(F.col("score") >= THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        found = written(near_duplicates(docs).select("doc_id", "component_id"), "pipeline-components")
        # Only ids meet the texts.
        return only(docs, found.filter("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")
    rows = keyed(docs)
    found = written(near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select("doc_id", "component_id"), "pipeline-components")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("row")).unionByName(again(rows)).distinct()
    return only(rows, gone, "row", "left_anti").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of their own for each row, in the order of doc_id (nulls last), then of the other columns; written, so that the numbers stay."""
    order = [F.col("doc_id").asc_nulls_last(), *COLUMNS[1:]]
    d = docs.withColumn("place", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, order[0], *COLUMNS[1:], "place")
    return written(d.sortWithinPartitions(*order, "place").drop("place").withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def again(rows: DataFrame) -> DataFrame:
    """row of the rows that repeat the doc_id and text of an earlier one; near_duplicates links no texts without words."""
    r = rows.filter("doc_id IS NOT NULL").select("row", "doc_id", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("digest"))
    first = r.groupBy("doc_id", "digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return r.join(first, ["doc_id", "digest"]).filter("row > first").select("row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contaminated_spans(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(F.size("spans") == 0).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = redacted(docs.select(*COLUMNS))
    return d.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mixed)]

#: The classifier is learned, so SQL cannot express the pipeline; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
