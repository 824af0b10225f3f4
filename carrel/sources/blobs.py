"""A content-addressed store: blobs under the hash of their bytes, as a Parquet table. Stands for pinning and fetching by content id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cid(content: Column) -> Column:
    return F.concat(F.lit("b"), F.sha2(content.cast("binary"), 256))


def pin(blobs: DataFrame, path: str, uploaded_at: Column | None = None) -> DataFrame:
    """Writes (cid, content, encrypted, uploaded_at) of blobs(name, content) and returns (name, cid). Equal contents have one cid; reading drops repeats."""
    d = blobs.withColumn("cid", cid(F.col("content")))
    stored = d.select("cid", F.col("content").cast("binary").alias("content"), F.lit(True).alias("encrypted"), (uploaded_at if uploaded_at is not None else F.current_timestamp()).alias("uploaded_at"))
    stored.write.mode("append").parquet(path)
    return d.select("name", "cid")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted(cid, ...) with content; null where nothing is stored."""
    stored = spark.read.parquet(path).select("cid", "content").dropDuplicates(["cid"])
    return wanted.join(stored, "cid", "left")


def encoded(content: Column) -> Column:
    return F.base64(content)


def decoded(text: Column) -> Column:
    return F.unbase64(text)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the images that can be redacted."""
    f = spark.read.format("binaryFile").load(path)
    return f.filter(F.col("path").rlike(r"(?i)\.(jpe?g|png)$")).select("path", "content")


def write_files(files: DataFrame, folder: str, prefix: str = "") -> int:
    """Writes (file, content) rows as files below a folder, each under a temporary name first, so a retried task leaves whole files. Returns how many."""

    def put(rows) -> None:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for r in rows:
            name = f"{prefix}{r['file'].rpartition('/')[2]}"
            part = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            system.move(part, f"{root}/{name}")

    files.select("file", "content").foreachPartition(put)
    return files.count()
