"""Pseudonymizing tables: columns found by their headers, one pseudonym for each row, previews.

Modes. ``compat`` (default) keeps two known gaps: rows whose id is empty, zero or absent stay unmasked, and headers are matched by substrings with underscores kept.
``strict`` closes them: such rows are masked by their place, and underscores count as spaces.

Which of the cases holds is decided for each sheet: with an id column the row's pseudonym is that of its normalized id; without one it is the wallet's (same for all rows) if a
wallet is given, else one for each row made from (salt, file, sheet, row), so that reruns agree. All masked cells of a row get the same pseudonym. It is a plain
hash, so the same id reads the same in all sheets and files and no join is needed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from carrel.functions.text import normal_id, pseudonym

#: Words that mark a header as personal.
KEYWORDS = (
    "dob", "date of birth", "address", "phone", "mobile", "email", "ssn", "social security", "mrn", "medical record", "health plan", "license", "account number", "ip address",
    "device id", "biometric", "photo", "facial", "fingerprint", "signature", "first name", "last name", "name",
)


def _clean(header: str, strict: bool) -> str:
    h = header.lower()
    return h.replace("_", " ") if strict else h


def id_column(headers: Sequence[object], strict: bool = False) -> int | None:
    """Place of the patient id column: the last text header with both words."""
    found = [i for i, h in enumerate(headers) if isinstance(h, str) and "patient" in _clean(h, strict) and "id" in _clean(h, strict)]
    return found[-1] if found else None


def personal_columns(headers: Sequence[object], strict: bool = False) -> list[int]:
    """Places of the columns to mask, the id column among them."""
    out = []
    ident = id_column(headers, strict)
    for i, h in enumerate(headers):
        if not isinstance(h, str):
            continue
        low = _clean(h, strict)
        tight = re.sub(r"\s+", "", low)
        if i == ident or any(k in low or k.replace(" ", "") in tight for k in KEYWORDS):
            out.append(i)
    return out


def has_id(c: Column, numeric: bool = False) -> Column:
    """Whether an id counts as given: neither absent, empty, zero (as a number) nor false."""
    s = c.cast("string")
    zero = (c == 0) if numeric else F.lit(False)
    return F.coalesce(c.isNotNull() & (s != "") & ~zero, F.lit(False))


def numeric_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}


def filled(cells: list[Column]) -> Column:
    """Whether any cell of a row is neither absent nor empty."""
    out = F.lit(False)
    for c in cells:
        out = out | F.coalesce(c.cast("string") != "", F.lit(False))
    return out


def masked(df: DataFrame, headers: dict[str, str] | None = None, *, wallet: str | None = None, row_key: Sequence[str] = (), salt: str = "", mode: str = "compat", hash_len: int = 8, key: str | None = None) -> DataFrame:
    """A wide sheet with its personal columns masked: one projection, no shuffle.

    headers: what the columns are called in the sheet (default: their names). row_key: columns that tell rows apart, for sheets with neither ids nor wallet.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == "strict"
    shown = [(headers or {}).get(c, c) for c in df.columns]
    mine = [df.columns[i] for i in personal_columns(shown, strict)]
    ident = id_column(shown, strict)
    numeric = numeric_columns(df)
    by_row = F.concat_ws("\u0001", F.lit(salt), *[F.col(c).cast("string") for c in row_key or df.columns])
    if ident is not None:
        c = df.columns[ident]
        name = pseudonym(normal_id(F.col(c)), hash_len, key)
        rule = has_id(F.col(c), c in numeric)
        if strict:
            name, rule = F.when(rule, name).otherwise(pseudonym(by_row, hash_len, key)), filled([F.col(x) for x in df.columns])
    else:
        name = pseudonym(F.lit(wallet) if wallet else by_row, hash_len, key)
        rule = filled([F.col(x) for x in df.columns])
    put = {c: F.when(rule & F.col(c).isNotNull(), name).otherwise(F.col(c).cast("string")) for c in mine}
    return df.select(*[put[c].alias(c) if c in put else F.col(c) for c in df.columns])


def masked_cells(df: DataFrame, *, wallet: str | None = None, salt: str = "", mode: str = "compat", hash_len: int = 8, key: str | None = None) -> DataFrame:
    """Long sheets (file, sheet, row_idx, headers array, cells array), row 0 the header, masked: the cases chosen by the headers that travel with each row. Sheets without rows pass."""
    low = F.transform("headers", lambda h: F.lower(F.replace(h, F.lit("_"), F.lit(" ")) if mode == "strict" else h))
    is_id = F.transform(low, lambda h: F.coalesce(F.contains(h, F.lit("patient")) & F.contains(h, F.lit("id")), F.lit(False)))
    ident = F.size(is_id) - F.array_position(F.reverse(is_id), True).cast("int")  # size: none
    ident = F.when(F.array_contains(is_id, True), ident).otherwise(F.lit(-1))
    tight = lambda h: F.regexp_replace(h, r"\s+", "")

    def personal(h: Column) -> Column:
        out = F.lit(False)
        for k in KEYWORDS:
            out = out | F.contains(h, F.lit(k)) | F.contains(tight(h), F.lit(k.replace(" ", "")))
        return F.coalesce(out, F.lit(False))

    df = df.withColumn("_ident", ident).withColumn("_mine", F.transform(low, lambda h, i: personal(h) | (i == F.col("_ident"))))
    cell = F.get("cells", F.col("_ident"))
    row = pseudonym(F.concat_ws("\u0001", F.lit(salt), "file", "sheet", F.col("row_idx").cast("string")), hash_len, key)
    by_id = pseudonym(normal_id(cell), hash_len, key)
    given = has_id(cell) & ~F.coalesce(cell.rlike(r"^-?0+(\.0+)?$"), F.lit(False))
    any_cell = F.exists("cells", lambda c: F.coalesce(c != "", F.lit(False)))
    other = pseudonym(F.lit(wallet), hash_len, key) if wallet else row
    name = F.when(F.col("_ident") >= 0, F.when(given, by_id).otherwise(row)).otherwise(other)
    rule = F.when(F.col("_ident") >= 0, given if mode == "compat" else any_cell).otherwise(any_cell) & (F.col("row_idx") > 0)
    df = df.withColumn("_name", name).withColumn("_rule", rule)
    cells = F.transform("cells", lambda c, i: F.when(F.col("_rule") & c.isNotNull() & F.coalesce(F.get("_mine", i), F.lit(False)), F.col("_name")).otherwise(c))
    return df.withColumn("cells", cells).drop("_ident", "_mine", "_name", "_rule")


def identifiers(frames: list[tuple[DataFrame, str]], hash_len: int = 8, key: str | None = None) -> DataFrame:
    """The distinct normalized ids of several (frame, id column) and their pseudonyms: the crosswalk."""
    out = None
    for df, c in frames:
        one = df.filter(has_id(F.col(c), c in numeric_columns(df))).select(normal_id(F.col(c)).alias("norm_id"))
        out = one if out is None else out.unionByName(one)
    return out.distinct().withColumn("pseudonym", pseudonym(F.col("norm_id"), hash_len, key))


def preview_rows(total: int) -> int:
    """Rows of a preview for a sheet of total rows, both with the header."""
    return min(total, max(5, min(50, math.ceil(total * 0.05))))


def preview(df: DataFrame, order: str) -> DataFrame:
    """The first data rows of a wide sheet: a twentieth, 5 to 50 rows, the header counted. The count is a separate aggregation; the limit a top-k."""
    return df.orderBy(order).limit(preview_rows(df.count() + 1) - 1)
