"""Checks of uploads: which files are taken, and what a request must state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrel.functions.text import FORMATS, trim_all

#: The largest upload; MIME types that are taken besides those of the formats.
LARGEST = 10 << 30
OTHER_MIME = ("application/csv",)
IMAGES = ("image/jpeg", "image/jpg", "image/png")
EXTENSIONS = ("xlsx", "xls", "csv", "ods", "tsv", "xlsm", "xlsb")


def is_spreadsheet(name: Column, mime: Column) -> Column:
    """By extension or MIME type; either will do."""
    by_name = name.rlike(r"(?i)\.(" + "|".join(EXTENSIONS) + r")$")
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(mime.isin(*[m for _, m in FORMATS.values()], *OTHER_MIME), F.lit(False))


def is_allowed_size(n: Column, largest: int = LARGEST) -> Column:
    return n <= largest


def is_image(mime: Column) -> Column:
    return F.coalesce(mime.startswith("image/") & mime.isin(*IMAGES), F.lit(False))


def wants_preview(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.xlsx?$"), F.lit(False))


def leading_number(c: Column) -> Column:
    """The number at the start of a text; null without one."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def error(wallet: Column, file: Column, title: Column, summary: Column, tags: Column, data_type: Column, data_source: Column, price: Column) -> Column:
    """The first thing that is wrong with a request, or null. Gender is optional."""
    blank = lambda c: F.coalesce(trim_all(c), F.lit("")) == ""
    return (
        F.when(F.coalesce(wallet, F.lit("")) == "", "wallet").when(F.coalesce(file, F.lit("")) == "", "file").when(blank(title), "title").when(blank(summary), "summary")
        .when(F.coalesce(F.size(tags), F.lit(0)) <= 0, "tags").when(F.coalesce(data_type, F.lit("")) == "", "data_type").when(F.coalesce(data_source, F.lit("")) == "", "data_source")
        .when((F.coalesce(price.cast("string"), F.lit("")) == "") | F.coalesce(leading_number(price) <= 0, F.lit(False)), "price")
    )


#: Vocabularies of the upload form.
DATA_TYPES = ("Personal", "Institution")
GENDERS = ("Male", "Female", "Other")
DATA_SOURCES = (
    "Hospital", "Clinic", "Laboratory", "Research Institution", "Medical Device", "Electronic Health Record", "Patient Self-Reported", "Insurance Claims", "Other",
)


def tags_added(tags: Column, tag: Column) -> Column:
    return F.array_union(tags, F.array(tag))


def tag_removed(tags: Column, place: Column) -> Column:
    return F.filter(tags, lambda x, i: i != place)


def output_name(name: Column, with_preview: bool = False) -> Column:
    return F.concat(F.lit("anonymized_" if with_preview else "phi_anonymized_"), name)


def preview_name(name: Column) -> Column:
    return F.concat(F.lit("preview_"), name)
