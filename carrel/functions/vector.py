"""Vector distances as expressions, and embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrel.functions.binding import let


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Null for vectors of unequal length."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), _sum(d))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors or unequal lengths."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Smaller is nearer: squared l2, or one minus the cosine."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    return squared_l2(a, b) if metric == "l2" else 1 - cosine(a, b)


def score(d: Column) -> Column:
    return 1 / (1 + d)


class Embedder(Protocol):
    """Text to vector, as a column and as numbers; both must agree."""

    dim: int

    def column(self, text: Column) -> Column: ...

    def vector(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Counts of words by hash bucket: deterministic, built from expressions. It stands in where no model is at hand; its ranks mean nothing beyond shared words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
        at = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % self.dim).cast("int"))
        if self.dim > 256:
            return let(at, lambda b: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double")))
        # a bucket is a character; it holds as many words as taking its character away shortens the string
        signs = F.array(*[F.lit(chr(i)) for i in range(self.dim)])
        left = lambda s, x: F.length(F.replace(s, x, F.lit("")))
        return let(F.array_join(F.transform(at, F.char), ""), lambda s: F.transform(signs, lambda x: (F.length(s) - left(s, x)).cast("double")))

    def vector(self, text: str) -> list[float]:
        import re

        out = [0.0] * self.dim
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        return out
