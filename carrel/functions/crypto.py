"""Passphrase encryption in the salted OpenSSL format, and the chunked stream format around it. The key is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrel.functions.binding import let

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
#: The separators of the chunked format.
CHUNK_SEPARATOR = "|CHUNK_SEPARATOR|"
METADATA_SEPARATOR = "|METADATA_SEPARATOR|"


def chunk_size(n: Column) -> Column:
    """Bytes of a chunk by the size of its file."""
    return F.when(n < 10 * MB, 512 * KB).when(n < 100 * MB, MB).when(n < GB, 2 * MB).otherwise(4 * MB).cast("long")


def chunk_count(n: Column) -> Column:
    return F.ceil(n / chunk_size(n)).cast("long")


def is_chunked_size(n: Column) -> Column:
    return n > 5 * MB


def _derived(password: Column, salt: Column) -> Column:
    """48 bytes of key and initial vector: a chain of MD5 over the last hash, password and salt. Each link is worked out once."""
    link = lambda *before: F.unhex(F.md5(F.concat(*before, password, salt)))
    return let(link(), lambda a: let(link(a), lambda b: F.concat(a, b, link(b))))


def encrypt(text: Column, passphrase: str, salt: Column) -> Column:
    """base64 of Salted__, 8 bytes of salt and AES-256-CBC of the text. The salt must differ from row to row."""
    sealed = lambda key: F.aes_encrypt(text.cast("binary"), F.substring(key, 1, 32), F.lit("CBC"), F.lit("PKCS"), F.substring(key, 33, 16))
    return let(salt, lambda s: F.base64(F.concat(F.lit("Salted__").cast("binary"), s, F.substring(let(_derived(F.lit(passphrase).cast("binary"), s), sealed), 17, 2147483647))))


def decrypt(blob: Column, passphrase: str) -> Column:
    """The text of encrypt() or of any blob in that format; null where it cannot be opened."""

    def opened(raw: Column, key: Column) -> Column:
        sealed = F.concat(F.substring(key, 33, 16), F.substring(raw, 17, 2147483647))
        text = F.try_aes_decrypt(sealed, F.substring(key, 1, 32), F.lit("CBC"), F.lit("PKCS"))
        return F.when(F.substring(raw, 1, 8) == F.lit("Salted__").cast("binary"), text).cast("string")

    with_key = lambda raw: let(_derived(F.lit(passphrase).cast("binary"), F.substring(raw, 9, 8)), lambda key: opened(raw, key))
    return let(F.try_to_binary(blob, F.lit("base64")), with_key)


def is_chunked(blob: Column) -> Column:
    """Whether a blob has both separators."""
    return F.contains(blob, F.lit(METADATA_SEPARATOR)) & F.contains(blob, F.lit(CHUNK_SEPARATOR))


def header(total: Column, size: Column, chunk: Column) -> Column:
    return F.to_json(F.struct(total.alias("totalChunks"), size.alias("originalSize"), chunk.alias("chunkSize"), F.lit(True).alias("encrypted")))


def read_header(blob: Column) -> Column:
    return F.from_json(F.substring_index(blob, METADATA_SEPARATOR, 1), "totalChunks int, originalSize long, chunkSize int, encrypted boolean")


def stream(meta: Column, chunks: Column) -> Column:
    return F.concat(meta, F.lit(METADATA_SEPARATOR), F.array_join(chunks, CHUNK_SEPARATOR))


def stream_chunks(blob: Column) -> Column:
    body = F.substr(blob, F.locate(METADATA_SEPARATOR, blob) + len(METADATA_SEPARATOR))
    return F.split(body, CHUNK_SEPARATOR.replace("|", r"\|"), -1)


def progress(i: Column, n: Column) -> Column:
    return (i + 1) / n * 100
