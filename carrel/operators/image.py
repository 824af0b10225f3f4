"""Redacting images: recognition is plugged in, the decision which word boxes to cover is an expression.

Either one ``Redactor`` does it all, or a ``WordReader`` (character recognition) gives words with their boxes, an ``EntityReader`` names personal entities in their text, and the
boxes of the chosen words are painted over. PNG images are decoded here; another ``decode`` may be given for other kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.functions import png
from carrel.functions.binding import let

#: Entity labels that are covered.
LABELS = ("PERSON", "ORG", "GPE", "DATE", "LOC", "FAC", "NORP")


class Redactor(Protocol):
    """Covers personal text in an image."""

    def redact(self, content: bytes) -> bytes: ...


class WordReader(Protocol):
    """Words of an image (RGB, height x width x 3), each (text, left, top, width, height)."""

    def words(self, pixels: np.ndarray) -> list[tuple[str, int, int, int, int]]: ...


class EntityReader(Protocol):
    """Entities of a text, each (text, label)."""

    def entities(self, text: str) -> list[tuple[str, str]]: ...


WORDS = "array<struct<text:string,left:int,top:int,width:int,height:int>>"
ENTITIES = "array<struct<text:string,label:string>>"


def ocr_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def entity_texts(entities: Column) -> Column:
    """Distinct stripped texts of the entities (text, label) with covered labels."""
    return F.array_distinct(F.transform(F.filter(entities, lambda e: e["label"].isin(*LABELS)), lambda e: F.trim(e["text"])))


def among(words: Column, names: Column) -> Column:
    """The words whose stripped text is one of the names, blank ones aside. The names are sorted once for each row and searched by halving, so a row of n words takes n log n steps."""
    halves = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def found(texts: Column, steps: Column, x: Column) -> Column:
        upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(texts, at + step - 1) <= x, at + step).otherwise(at))  # how many of the texts are x or before it
        return (x != "") & (F.get(texts, upto - 1) == x)

    def search(texts: Column) -> Column:
        steps = F.filter(halves, lambda h: h <= F.size(texts))
        return let(steps, lambda s: F.filter(words, lambda w: let(F.trim(w["text"]), lambda x: found(texts, s, x))))

    return let(F.sort_array(F.array_compact(names)), search)


def boxes(words: Column, entities: Column) -> Column:
    """The words (text, left, top, width, height) to cover: those that are a whole entity. An entity of two words covers none; see strict_boxes."""
    return among(words, entity_texts(entities))


def strict_boxes(words: Column, entities: Column) -> Column:
    """Also covers the words of entities of several words."""
    return among(words, F.array_distinct(F.flatten(F.transform(entity_texts(entities), lambda t: F.split(t, r"\s+")))))


def redacted(images: DataFrame, redactor: Redactor) -> DataFrame:
    """(path, content) of binaryFile rows, covered by the plugged-in redactor. One image is in memory at a time per row of a batch."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b.path, "content": [redactor.redact(bytes(c)) for c in b.content]})

    return images.select("path", "content").mapInPandas(task, "path string, content binary")


def recognized(images: DataFrame, reader: WordReader, decode: Callable[[bytes], np.ndarray] = png.decode) -> DataFrame:
    """images(path, content, ...) with words and error; an image that cannot be decoded has no words and the reason as its error."""
    schema = images.withColumn("words", F.lit(None).cast(WORDS)).withColumn("error", F.lit(None).cast("string")).schema

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, errors = [], []
            for c in b.content:
                try:
                    found.append([dict(zip(("text", "left", "top", "width", "height"), w, strict=True)) for w in reader.words(decode(bytes(c)))])
                    errors.append(None)
                except Exception as e:  # one bad image must not end the job
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(words=found, error=errors)

    return images.mapInPandas(task, schema)


def with_entities(df: DataFrame, reader: EntityReader, text: str = "text") -> DataFrame:
    """df with the entities of a text column."""
    schema = df.withColumn("entities", F.lit(None).cast(ENTITIES)).schema

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(entities=[[{"text": t, "label": l} for t, l in reader.entities(x or "")] for x in b[text]])

    return df.mapInPandas(task, schema)


def covered(images: DataFrame, decode: Callable[[bytes], np.ndarray] = png.decode) -> DataFrame:
    """images(path, content, boxes, error) as (path, content, error) with the boxes painted over, as PNG; an image with an error has no content, so that nothing uncovered is passed on."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, found, error in zip(b.content, b.boxes, b.error, strict=True):
                boxes_ = [(w["left"], w["top"], w["width"], w["height"]) for w in found]
                out.append(None if error is not None else png.encode(png.painted(decode(bytes(c)), boxes_)))
            yield pd.DataFrame({"path": b.path, "content": out, "error": b.error})

    return images.select("path", "content", "boxes", "error").mapInPandas(task, "path string, content binary, error string")


def redacted_words(images: DataFrame, reader: WordReader, entities: EntityReader, strict: bool = False, decode: Callable[[bytes], np.ndarray] = png.decode) -> DataFrame:
    """(path, content, error): images with the words painted over that are personal entities; strict also covers the words of entities of several words."""
    d = recognized(images.select("path", "content"), reader, decode)
    d = with_entities(d.withColumn("text", ocr_text(F.col("words"))), entities)
    rule = strict_boxes if strict else boxes
    return covered(d.withColumn("boxes", rule(F.col("words"), F.col("entities"))), decode)
