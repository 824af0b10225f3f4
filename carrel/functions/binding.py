"""A value that an expression uses several times, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value). The value is the element of an array of one, so that it is evaluated once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]
