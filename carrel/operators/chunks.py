"""Cutting payloads into chunks, encrypting them in parallel, and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.functions.binding import let
from carrel.functions.crypto import decrypt, encrypt, header, is_chunked, read_header, stream, stream_chunks


def cut(df: DataFrame, key: str, text: str, size: Column) -> DataFrame:
    """(key, chunk_idx, n_chunks, data): a row for each chunk of size characters; an empty text is one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    d = df.select(F.col(key), F.col(text).alias("_t"), size.cast("int").alias("_s"), n.alias("n_chunks"))
    d = d.select(key, "_t", "_s", "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_idx"))
    return d.select(key, "chunk_idx", "n_chunks", F.substring(F.col("_t"), F.col("chunk_idx") * F.col("_s") + 1, F.col("_s")).alias("data"))


def joined(chunks: DataFrame, key: str) -> DataFrame:
    """(key, text, complete): the chunks of a key in order; complete if none is missing."""
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "data"))).alias("x"), F.max("n_chunks").alias("n"))
    return g.select(key, F.array_join(F.transform("x", lambda r: r["data"]), "").alias("text"), (F.size("x") == F.col("n")).alias("complete"))


def sealed(text: Column, key: Column, passphrase: str, size: int) -> Column:
    """A text in the chunked encrypted format; the salts are made from the row's key and the chunk's place."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    salt = lambda i: F.unhex(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), i.cast("string")).cast("binary")), 1, 16))
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: encrypt(F.substring(text, i * size + 1, F.lit(size)), passphrase, salt(i)))
    return stream(header(n, F.length(text), F.lit(size)), chunks)


def opened(blob: Column, passphrase: str) -> Column:
    """The text of a blob in either format, told apart by its separators; null if it cannot be opened or a chunk is missing."""
    # one chunk has no separator between chunks; its header still tells
    total = read_header(blob)["totalChunks"]
    whole = lambda parts, n: F.when((F.size(parts) == n) & ~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    many = lambda n: let(F.transform(stream_chunks(blob), lambda c: decrypt(c, passphrase)), lambda parts: whole(parts, n))
    return let(total, lambda n: F.when(is_chunked(blob) | F.coalesce(n == 1, F.lit(False)), many(n)).otherwise(decrypt(blob, passphrase)))


def total_bytes(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, total_bytes) of chunks (key, data): partial sums, no text leaves its task."""
    size = F.octet_length(F.coalesce("data", F.lit(""))).cast("long")
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum(size).alias("total_bytes"))
