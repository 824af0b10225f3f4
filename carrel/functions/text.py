"""Scalar text functions: pseudonyms, normalizing, composing and taking apart the indexed text, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts and the byte order mark, at both ends.
EDGES = r"(?U)^[\s﻿]+|[\s﻿]+$"


def trim_all(c: Column) -> Column:
    """Trims all white space, not only spaces."""
    return F.regexp_replace(c, EDGES, "")


def pseudonym(c: Column, hash_len: int = 8, key: str | None = None) -> Column:
    """WID_ and the first hexadecimal digits of the sha256. With a key the hash is salted; without one, short hashes of guessable ids can be searched."""
    salted = c if key is None else F.concat(F.lit(key), F.lit("\u0000"), c)
    return F.concat(F.lit("WID_"), F.substring(F.sha2(salted.cast("binary"), 256), 1, hash_len))


def canonical_number(c: Column) -> Column:
    """A cell's text as a spreadsheet shows its number: 7.0 and 007 become 7; other texts stay."""
    plain = c.rlike(r"^-?\d{1,15}(\.0+)?$")
    digits = F.regexp_replace(F.regexp_replace(c, r"\.0+$", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(plain, F.when(digits == "-0", F.lit("0")).otherwise(digits)).otherwise(c)


def normal_id(c: Column) -> Column:
    """Lower case, trimmed; numbers in their canonical form first."""
    return trim_all(F.lower(canonical_number(c.cast("string"))))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def compose(title: Column, summary: Column, tags: Column | None = None) -> Column:
    """The text that is indexed for a document."""
    body = F.concat(F.lit("Dataset Title: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    if tags is None:
        return body
    return F.concat(body, F.when(F.coalesce(tags, F.lit("")) != "", F.concat(F.lit("\nDisease Tags: "), tags)).otherwise(F.lit("")))


def title_of(text: Column) -> Column:
    return trim_all(F.regexp_extract(text, r"(?m)^Dataset Title:\s*(.+?)$", 1))


def summary_of(text: Column) -> Column:
    return trim_all(F.regexp_extract(text, r"(?s)^Dataset Title:\s*.+?\n(.+?)(?:\nDisease Tags:|\z)", 1))


def type_label(c: Column) -> Column:
    """application/pdf to PDF."""
    return F.upper(F.element_at(F.split(c, "/"), -1))


def size_kb(c: Column) -> Column:
    return F.format_string("%.1f", c / F.lit(1024.0))


def local_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Null where the text is no timestamp."""
    return F.date_format(F.try_to_timestamp(c), pattern)


def short_wallet(c: Column, tail: bool = True) -> Column:
    """0x1234...abcd; without tail the form of log lines."""
    return F.concat(F.left(c, F.lit(6)), F.lit("..."), F.right(c, F.lit(4)) if tail else F.lit(""))


def extension(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, r"\."), -1))


#: Formats and MIME types of spreadsheets by extension.
FORMATS = {
    "xls": ("xls", "application/vnd.ms-excel"),
    "csv": ("csv", "text/csv"),
    "ods": ("ods", "application/vnd.oasis.opendocument.spreadsheet"),
    "tsv": ("txt", "text/tab-separated-values"),
    "xlsm": ("xlsm", "application/vnd.ms-excel.sheet.macroEnabled.12"),
    "xlsb": ("xlsb", "application/vnd.ms-excel.sheet.binary.macroEnabled.12"),
    "xlsx": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
}


def output_format(name: Column) -> tuple[Column, Column]:
    """(format, MIME type) of the file written for an input of this name; xlsx where the extension is not known."""
    lookup = lambda i: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v[i])]), extension(name)), F.lit(FORMATS["xlsx"][i])
    )
    return lookup(0), lookup(1)


def joined_tags(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def split_tags(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ", "))


def preview_cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("—"))


def header_label(c: Column, i: Column) -> Column:
    """A blank header reads Column 1, 2, ..."""
    return first_filled(c, F.concat(F.lit("Column "), (i + 1).cast("string")))
