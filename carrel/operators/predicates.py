"""Compiles filter dictionaries to Spark predicates: equality on typed values, conjunction, and the comparison operators.

``{"lang": "en"}``, ``{"price": {"$gt": 1}}``, ``{"$or": [{...}, {...}]}``. Keys that are columns use the column, so that they reach the scan; other keys are looked up
in a variant column with their type, where 1 and "1" differ. An unknown key matches nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")


def typed(variant: Column, key: str, value: Any) -> tuple[Column, Column]:
    """(the key's value as the type of the literal, whether it has that type); numbers compare with numbers."""
    if "'" in key and '"' in key:
        return F.lit(None).cast("string"), F.lit(False)  # a path has no way to write such a key
    path = f'$["{key}"]' if "'" in key else f"$['{key}']"
    found = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    if isinstance(value, bool):
        return F.try_variant_get(variant, path, "boolean"), found == "BOOLEAN"
    if isinstance(value, int | float):
        return F.try_variant_get(variant, path, "double"), found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.try_variant_get(variant, path, "string"), found == "STRING"


def compare(c: Column, op: str, value: Any) -> Column:
    if op in ("$in", "$nin"):
        inside = c.isin(list(value)) if value else F.lit(False)
        return inside if op == "$in" else ~inside
    return {"$eq": c.__eq__, "$ne": c.__ne__, "$gt": c.__gt__, "$gte": c.__ge__, "$lt": c.__lt__, "$lte": c.__le__}[op](value)


def kind_of(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "text"


def in_variant(variant: Column, key: str, op: str, value: Any) -> Column:
    """A test of a variant's key. The values of $in and $nin may be of several types, and each is compared with values of its own only; a value of no type in an $nin list is
    in none of it."""
    if op not in ("$in", "$nin"):
        c, same = typed(variant, key, value)
        return same & compare(c, op, value)
    groups: dict[str, list] = {}
    for v in value:
        groups.setdefault(kind_of(v), []).append(v)
    inside = F.lit(False)
    for values in groups.values():
        c, same = typed(variant, key, values[0])
        inside = inside | F.coalesce(same & c.isin(values), F.lit(False))
    if op == "$in":
        return inside
    there, _ = typed(variant, key, "")
    return there.isNotNull() & ~inside


def one(df: DataFrame, key: str, test: Any, variant: str | None) -> Column:
    tests = test if isinstance(test, dict) else {"$eq": test}
    if not tests or any(op not in OPERATORS for op in tests):
        raise ValueError(f"unknown operator in {test!r}")
    out = []
    for op, value in tests.items():
        if key in df.columns:
            out.append(compare(F.col(key), op, value))
        elif variant is None:
            out.append(F.lit(False))
        else:
            out.append(in_variant(F.col(variant), key, op, value))
    return reduce(Column.__and__, out)


def predicate(df: DataFrame, filters: dict[str, Any] | None, variant: str | None = None) -> Column | None:
    """The predicate of a filter dictionary over df; None for an empty one (all rows). Unknown (null) counts as no match in a filter."""
    parts = []
    for key, test in (filters or {}).items():
        if key in ("$and", "$or"):
            inner = [p if (p := predicate(df, x, variant)) is not None else F.lit(True) for x in test]
            if not inner:
                raise ValueError(f"{key} needs a list of filters")
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, inner))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key!r}")
        else:
            parts.append(one(df, key, test, variant))
    return reduce(Column.__and__, parts) if parts else None


def blanks_dropped(filters: dict[str, Any]) -> dict[str, Any]:
    """Filters as a form sends them: without the fields that were left empty."""
    return {k: v for k, v in filters.items() if v not in (None, "", [], {})}
