"""Exact conversion between ether and wei, within decimal(38)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEI = "decimal(38,0)"


def wei(eth: Column) -> Column:
    """Ether (text or number below 100) to wei; decimal(20,18) times decimal(19,0) loses no digit."""
    return (eth.cast("decimal(20,18)") * F.lit("1000000000000000000").cast("decimal(19,0)")).cast(WEI)


def ether(w: Column) -> Column:
    """Wei to ether, exact: the digits are shifted, not divided."""
    digits = F.lpad(F.abs(w).cast(WEI).cast("string"), 39, "0")
    sign = F.when(w < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.left(digits, F.lit(21)), F.lit("."), F.right(digits, F.lit(18))).cast("decimal(38,18)")
