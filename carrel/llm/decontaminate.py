"""Benchmark decontamination by winnowing.

Both sides are cut into words; the hashes of k-grams are winnowed: of each w consecutive k-grams the one with the least hash (the rightmost
of equals) is kept. Any shared span of k + w - 1 words or more (the window length) holds a kept k-gram on both sides at the same place, so
joining on kept hashes misses none. Each hit is extended word by word to both ends; runs at least as long as the window count.
Items shorter than a window are one window of their own length: all grams of that length are kept (w = 1).

A benchmark of at most ``BLOCK_BYTES`` of text, counted before, is one index that is broadcast: documents are joined with it in one scan without a shuffle, each on its own, so no key
can be hot. A larger one is a table of fingerprints; those of the distinct texts are joined with it by a shuffle, both dealt by hash and salt, as a common passage may be in any part of
either. Hits meet the texts of their item and document pair by pair and are extended there; only what is found goes back to the documents.

Nulls: a null text has no words and no hits; an item without words has no window; a null item_id reads ``null``. Items that share an
item_id count once. Repeated documents are separate rows; a null doc_id is kept. No items: nothing is hit. Extra columns of documents are carried along.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import ascii_lower, spread, table, written
from carrel.llm.wordhash import ALNUM, gram_hashes, normal, word_hashes

K, WINDOW = 5, 10
BLOCK_BYTES = 32 << 20


def winnow(g: np.ndarray, begin: np.ndarray, end: np.ndarray, w: int) -> np.ndarray:
    """Positions in g kept by winnowing; begin and end: the grams of each text."""
    if not len(g):
        return np.zeros(0, np.int64)
    inside = np.zeros(len(g) + 1, np.int64)
    full = end - begin >= w
    np.add.at(inside, begin[full], 1)
    np.add.at(inside, end[full] - w + 1, -1)
    first = np.flatnonzero(np.cumsum(inside)[:-1] > 0)  # windows that lie in one text
    best, at = g[first + w - 1], first + w - 1
    for j in range(w - 2, -1, -1):
        less = g[first + j] < best
        best, at = np.where(less, g[first + j], best), np.where(less, first + j, at)
    return np.unique(at)


class Index:
    """Fingerprints of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        self.ids = [i for i, _ in items]
        datas = [normal(t, ALNUM) for _, t in items]
        self.words = [d.split() for d in datas]
        self.lens = np.array([len(x) for x in self.words], np.int64)
        h, off = word_hashes(datas)
        self.by_length = {}  # gram length: hashes in order, their items and places
        for n in sorted({min(int(x), window) for x in self.lens if x}):
            grams = k if n == window else n
            rows = []
            for i in np.flatnonzero(np.minimum(self.lens, window) == n):
                g = gram_hashes(h[off[i] : off[i + 1]], grams)
                kept = winnow(g, np.array([0]), np.array([len(g)]), n - grams + 1)
                rows.append((g[kept], np.full(len(kept), i), kept))
            g, i, p = (np.concatenate(x) for x in zip(*rows, strict=True))
            o = np.argsort(g, kind="stable")
            self.by_length[n] = (grams, g[o], i[o], p[o])

    def hits(self, h: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """(place, item, place in item) of equal fingerprints by text."""
        found = defaultdict(list)
        for n, (grams, keys, items, places) in self.by_length.items():
            g = gram_hashes(h, grams)
            begin = np.minimum(off[:-1], len(g))
            end = np.clip(off[1:] - grams + 1, begin, len(g))
            kept = winnow(g, begin, end, n - grams + 1)
            lo, hi = np.searchsorted(keys, g[kept]), np.searchsorted(keys, g[kept], "right")
            some = hi > lo
            for at, a, b in zip(kept[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                d = int(np.searchsorted(off, at, "right")) - 1
                found[d] += [(at - int(off[d]), int(items[j]), int(places[j])) for j in range(a, b)]
        return found

    def extend(self, words: list[bytes], hits: list[tuple[int, int, int]], mask: np.ndarray) -> set[str]:
        """Marks the words of shared windows and returns the ids of their items."""
        found, upto = set(), {}
        for at, i, p in hits:
            if at < upto.get((i, at - p), -1):
                continue  # an earlier hit on this diagonal reached over it
            item, n = self.words[i], min(int(self.lens[i]), self.window)
            a, b = at, at
            while b < len(words) and b - at + p < len(item) and words[b] == item[b - at + p]:
                b += 1
            while a > 0 and p - (at - a) > 0 and words[a - 1] == item[p - (at - a) - 1]:
                a -= 1
            upto[i, at - p] = max(b, at + 1)
            if b - a >= n:
                mask[a:b] = True
                found.add(self.ids[i])
        return found


def spans_of(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


FOUND = ("n_words", "spans", "items")
SPANS_DDL = "array<struct<start:int,end:int>>"


def contaminated_spans(docs: DataFrame, bench: DataFrame, k: int = K, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, ...) with n_words, spans array<struct<start, end>> of hit words and items array<string>; columns of these names are replaced."""
    docs = docs.drop(*FOUND)
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return scanned(docs, items, k, window) if size <= block_bytes else joined(docs, items, k, window)


def scanned(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """contaminated_spans() by an index of all items that every task holds."""
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], k, window))  # BLOCK_BYTES of text at most
    names = docs.columns
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS_DDL).alias("spans"), F.array().cast("array<string>").alias("items"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                datas = [normal(t, ALNUM) for t in rows.column("text").to_pylist()]
                h, off = word_hashes(datas)
                spans, found = [[] for _ in datas], [[] for _ in datas]
                for d, hits in index.value.hits(h, off).items():
                    mask = np.zeros(int(off[d + 1] - off[d]), bool)
                    found[d] = sorted(index.value.extend(datas[d].split(), hits, mask))
                    spans[d] = spans_of(mask)
                new = [pa.array(np.diff(off), pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], *new], names=[*names, *FOUND])

    return out.mapInArrow(task, out.schema)


#: Parts that a fingerprint, an item or a text is dealt to in the joins.
SALTS = 8


def prints(texts: DataFrame, key: str, lengths: list[int] | None, k: int, window: int) -> DataFrame:
    """(key, n, g, place): the kept grams of texts(key, text) for windows of n words; lengths: of all these, or of each text's own."""
    schema = texts.select(F.col(key), F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("place")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                h, off = word_hashes([normal(t, ALNUM) for t in rows.column("text").to_pylist()])
                own = np.minimum(np.diff(off), window)
                for n in lengths if lengths is not None else np.unique(own[own > 0]).tolist():
                    grams = k if n == window else n
                    g = gram_hashes(h, grams)
                    begin = np.minimum(off[:-1], len(g))
                    end = np.clip(off[1:] - grams + 1, begin, len(g))
                    if lengths is None:
                        end = np.where(own == n, end, begin)
                    kept = winnow(g, begin, end, n - grams + 1)
                    of = np.searchsorted(off, kept, "right") - 1
                    cols = [rows.column(key).take(pa.array(of)), pa.array(np.full(len(kept), n, np.int32)), pa.array(g[kept].view(np.int64)), pa.array((kept - off[of]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=[key, "n", "g", "place"])

    return texts.select(key, "text").mapInArrow(task, schema)


def salted(one: DataFrame, many: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The join of two frames, whose rows of one key are dealt to ``SALTS`` parts: many's by the hash of a column, one's repeated."""
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(one, [*keys, "salt"]).drop("salt")


def joined(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """contaminated_spans() by a join of fingerprints."""
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "leaks-items")
    of_items = written(prints(items, "item", None, k, window).withColumnRenamed("place", "i_place"), "leaks-prints")
    lengths = sorted(r["n"] for r in of_items.select("n").distinct().collect())  # window at most
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = docs.select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    hits = salted(of_items, prints(texts, "key", lengths, k, window), ["n", "g"], "key")
    hits = written(hits.groupBy("key", "item").agg(F.collect_list(F.struct("place", "i_place")).alias("at")), "leaks-hits")
    pairs = salted(items.select("item", "item_id", F.col("text").alias("i_text")), hits, ["item"], "key")
    pairs = pairs.join(texts, "key").select("key", "text", "item_id", "i_text", "at")
    schema = f"key string, item_id string, spans {SPANS_DDL}"

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                index, words = Index([(r["item_id"], r["i_text"])], k, window), normal(r["text"], ALNUM).split()
                mask = np.zeros(len(words), bool)
                at = sorted((x["place"], 0, x["i_place"]) for x in r["at"])
                rows += [{"key": r["key"], "item_id": i, "spans": spans_of(mask)} for i in index.extend(words, at, mask)]
            names = ["key", "item_id", "spans"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, (pa.string(), pa.string(), SPANS), strict=True))))

    found = pairs.mapInArrow(extended, schema).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = written(found.withColumn("spans", united(F.col("spans"))), "leaks-found").withColumnRenamed("key", "__key")
    words = F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = docs.withColumn("n_words", words).withColumn("__key", key).join(found, "__key", "left").drop("__key")
    none = {"spans": F.array().cast(SPANS_DDL), "items": F.array().cast("array<string>")}
    return out.select(*docs.columns, "n_words", *[F.coalesce(c, none[c]).alias(c) for c in ("spans", "items")])


def united(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap as one."""

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPANS_DDL), step)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words."""
    d = contaminated_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return d.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract word for word, for tests."""
    cut = {i: normal(t, ALNUM).split() for i, t in items}
    windows = defaultdict(set)
    for i, w in cut.items():
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    lens = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = normal(t, ALNUM).split()
        hit, found = set(), set()
        for n in lens:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


#: Words and windows as strings; for DuckDB.
OP2_SQL = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, lens, unnest(generate_series(1, len(w) - n + 1)) AS u(i)),
hit AS (SELECT dg.doc_id, dg.n, dg.i, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hit) h, unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
