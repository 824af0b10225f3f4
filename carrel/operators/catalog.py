"""The document catalogue: envelope, free metadata as a variant, and a typed view of the common keys."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.functions.binding import let
from carrel.functions.text import compose, split_tags

SCHEMA = "doc_id string, seq long, cid string, dataset_title string, document string, metadata variant, added_ms long"


def merged(base: dict[str, Any], metadata: dict[str, Any] | None) -> dict[str, Any]:
    """The request's own metadata overrides cid and title."""
    return base | (metadata or {})


def merged_maps(base: Column, metadata: Column) -> Column:
    """``merged`` over map columns: the request's own keys override; a null map adds nothing."""
    empty = F.create_map().cast("map<string,string>")
    return let(F.coalesce(metadata, empty), lambda m: F.map_concat(F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.map_contains_key(m, k)), m))


def entries(spark: SparkSession, requests: list[dict[str, Any]], first_seq: int = 0, now_ms: int = 0) -> DataFrame:
    """Catalogue rows of store requests (summary, dataset_title, cid, metadata)."""
    rows = []
    for i, r in enumerate(requests):
        m = merged({"cid": r["cid"], "dataset_title": r["dataset_title"]}, r.get("metadata"))
        rows.append((first_seq + i, r["cid"], r["dataset_title"], r["summary"], m.get("disease_tags"), json.dumps(m), now_ms))
    df = spark.createDataFrame(rows, "seq long, cid string, dataset_title string, summary string, tags string, meta string, added_ms long")
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """SCHEMA of (seq, cid, dataset_title, summary, tags, meta JSON text, added_ms); the id is a hash of what is stored, so reruns agree."""
    ident = F.sha2(F.concat_ws("\u0001", "cid", "dataset_title", F.col("seq").cast("string")).cast("binary"), 256)
    return df.select(
        ident.alias("doc_id"), "seq", "cid", "dataset_title", compose(F.col("dataset_title"), F.col("summary"), F.col("tags")).alias("document"),
        F.parse_json(F.coalesce("meta", F.lit("{}"))).alias("metadata"), "added_ms",
    )


def typed_view(df: DataFrame) -> DataFrame:
    """df with the common metadata keys as columns of their own; absent ones are null. Prices stay text beside the number."""
    get = lambda key, kind: F.try_variant_get("metadata", f"$.{key}", kind)
    return df.withColumns({
        "file_name": get("fileName", "string"), "file_size": get("fileSize", "long"), "file_type": get("fileType", "string"),
        "upload_ts": F.try_to_timestamp(get("uploadDate", "string")), "wallet": get("walletAddress", "string"), "tx_hash": get("transactionHash", "string"),
        "encrypted": get("encrypted", "boolean"), "price": get("price", "string"), "price_eth": F.expr("try_cast(try_variant_get(metadata, '$.price', 'string') AS decimal(20,18))"),
        "data_type": get("dataType", "string"), "gender": get("gender", "string"), "data_source": get("dataSource", "string"), "preview_hash": get("previewHash", "string"),
        "disease_tags": split_tags(get("disease_tags", "string")),
    })


def append(df: DataFrame, path: str) -> None:
    """Adds rows; a variant is kept as JSON text, which every Parquet reader knows."""
    df.withColumn("metadata", F.to_json("metadata")).write.mode("append").parquet(path)


def open_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue at a path, empty if nothing is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA.replace("variant", "string")).withColumn("metadata", F.parse_json("metadata"))
    return spark.read.schema(SCHEMA.replace("variant", "string")).parquet(path).withColumn("metadata", F.parse_json("metadata"))


def preview_available(preview_hash: Column, file_type: Column) -> Column:
    return F.coalesce((preview_hash != "") & F.contains(file_type, F.lit("spreadsheet")), F.lit(False))


def status(spark: SparkSession, **flags: bool) -> DataFrame:
    """One row: the service's state and which parts are available."""
    names = sorted(flags)
    return spark.createDataFrame([("healthy", *[flags[n] for n in names])], "status string" + "".join(f", {n} boolean" for n in names))
