"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is the trie of all byte contexts up to ``ORDER`` bytes of the training texts. A text is read as its words, lower-cased, with one
space between, and an end symbol; contexts at the start of a text are filled up with a start symbol. A symbol is coded in the longest context that was seen: either
by its estimate there or, if it was not seen there, by an escape to the context one byte shorter, where the symbols that the longer one offered are excluded; below
order 0 all symbols not excluded are equally likely. Orders below the highest count in how many longer contexts a symbol followed (update exclusion).

Escape estimate. Of each count n of a context ``discount(n)`` is set aside, E in all; of T, the sum of counts. The mass E / T is spread by the estimates of the order below:
what falls on symbols seen here adds to their estimate (they inherit from the shorter context), the rest is the escape,

    p(s) = (n - discount(n) + E * lower(s)) / T        for a symbol seen here,
    escape = E / T * (1 - sum of lower(s) over the symbols seen here).

An escaped symbol costs escape * lower(s) / (1 - that sum), by exclusion, which is E / T * lower(s): so one formula holds for all symbols, with n = 0 for those not seen, and
the costs of a whole table of grams are worked out from order 0 upwards without a list of excluded symbols. ``Trie`` walks down with explicit escapes and exclusion.

Two modes: ``corpus_scores`` learns from the training rows of the corpus and scores every row with that model (pretrained), ``Trie`` codes a
text from an empty or given trie while it learns (adaptive); the trie is also the brute force in the tests.

Distributed form. The cost of a symbol depends only on its (ORDER + 1)-gram, so a text's score is a sum over its grams:
1. One scan cuts the corpus into chunks of about ``CHUNK_BYTES``; each gives its distinct grams and word hashes with training counts, and its texts,
   compressed. 2. Counts are summed by gram. 3. Grams are dealt by the two bytes before the symbol: everything a gram needs from orders 2 and up lies in its
   part; orders 0 and 1 are at most 65,536 counts, which are broadcast. 4. Costs and word counts go back to the chunks that asked, and each chunk is scored.
Nothing of the size of the model or the corpus meets in one task or the driver; a frequent gram has one row per chunk.

Words are counted by 64-bit hashes. Nulls: a null text is empty (an end symbol only), a null doc_id trains in fold 0; repeated rows count and are scored
each; an empty table gives no rows; without training rows all symbols are equally likely. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import fold, spread, table, written
from carrel.llm.wordhash import SPACED, block_hashes, normal

ORDER = 5
CHUNK_BYTES = 32 << 20
#: Bytes of text that are turned into grams at once; longer texts are cut at words, each piece with the bytes before it.
BLOB_BYTES = 1 << 19
#: Bytes that UTF-8 never uses.
PAD, END = 0xFF, 0xFE
#: Symbols below order 0: all bytes but PAD.
SYMBOLS = 255
#: The share of a count that is set aside for the order below: this times its square root, and at most MOST of it.
DISCOUNT, MOST = 0.6, 0.95
#: Rows of grams that a task of step 3 reads, about, and that are priced at once.
PART_ROWS = 400_000


def symbols(text: str | None) -> bytes:
    """The text as the model reads it."""
    return b" ".join(normal(text, SPACED).split()) + bytes([END])


def pieces(data: bytes, order: int = ORDER, size: int = BLOB_BYTES) -> Iterator[bytes]:
    """A text in symbols() as parts that begin with the order bytes before them; cut after spaces."""
    at, before = 0, bytes([PAD]) * order
    while at < len(data):
        end = data.find(b" ", at + size) + 1 if len(data) - at > 2 * size else 0
        end = end or len(data)
        yield before + data[at:end]
        before = (before + data[max(at, end - order) : end])[-order:] if order else b""
        at = end


def pack(parts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams of pieces(), one for each symbol, as numbers; and how many each piece has."""
    a = np.frombuffer(b"".join(parts), np.uint8)
    lens = np.array([len(p) - order for p in parts], np.int64)
    g = np.zeros(max(0, len(a) - order), np.int64)
    for j in range(order + 1):
        np.left_shift(g, 8, out=g)
        g |= a[j : len(g) + j]
    # the symbol of g[i] is a[i + order]; the first of each piece stands order bytes after its start
    own = np.ones(len(g), bool)
    for k in range(order):
        own[np.cumsum(lens + order)[:-1] - order + k] = False
    return g[own], lens


def words(parts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of pieces(), and how many each piece has."""
    a = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    own = (a != 32) & (a != END)
    for k in range(order):
        own[ends - [len(p) for p in parts] + k] = False
    h, starts = block_hashes(a, own)
    return h.view(np.int64), np.diff(np.searchsorted(starts, ends), prepend=0)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of n."""
    if not len(keys):
        return keys, n
    o = np.argsort(keys)
    k = keys[o]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n[o], first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with how often they occur. Sorting alone is several times as fast as sorting places."""
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, len(k)))


def found(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key in a sorted table; 0 where it has none."""
    if not len(table):
        return np.zeros(len(keys), values.dtype)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, values[i], 0)


class Lookup:
    """Places of keys in an array of distinct ones, by hash tables of one key a slot; keys that lose a slot go to the next table."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(np.uint64)
        self.tables, left = [], np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 1)
            m = np.uint64(self.MULTIPLIERS[len(self.tables) % 4] + 2 * (len(self.tables) // 4))
            shift = np.uint64(64 - bits)
            at = (self.keys[left] * m) >> shift
            slots = np.full(1 << bits, -1, np.int32)
            slots[at] = left
            self.tables.append((m, shift, slots))
            left = left[slots[at] != left]

    def places(self, asked: np.ndarray) -> np.ndarray:
        """All asked keys must be there."""
        q = asked.view(np.uint64)
        out = np.zeros(len(q), np.int32)
        rest = None
        for m, shift, slots in self.tables:
            x = q if rest is None else q[rest]
            i = slots[(x * m) >> shift]
            miss = self.keys[i] != x
            if rest is None:
                out, rest = i, np.flatnonzero(miss)
            else:
                out[rest] = i
                rest = rest[miss]
            if not len(rest):
                break
        return out


class Part:
    """Distinct keys with training counts that grow block by block in bounded memory."""

    HELD = 700_000

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw: tuple[list, list] = ([], [])
        self.held = 0

    def add(self, keys: np.ndarray, trained: np.ndarray) -> None:
        """trained: which of the keys are from training texts."""
        self.raw[1].append(keys[trained])
        self.raw[0].append(keys[~trained])
        self.held += len(keys)
        if self.held > self.HELD:
            self.flush()

    def flush(self) -> None:
        new = [counted(np.concatenate(x)) if x else (self.keys[:0], self.n[:0]) for x in self.raw]
        keys = np.concatenate([self.keys, new[1][0], new[0][0]])
        self.keys, self.n = summed(keys, np.concatenate([self.n, new[1][1], np.zeros(len(new[0][0]), np.int64)]))
        self.raw, self.held = ([], []), 0


#: kind 0: gram, 1: word, 2: pieces of texts (doc: their place in the chunk).
CHUNKS = pa.schema([
    ("kind", pa.int8()), ("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64()),
    ("doc", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("blob", pa.binary()),
])
CHUNKS_DDL = "kind byte, chunk long, key long, n long, doc array<int>, doc_id array<long>, held_out array<boolean>, sizes array<int>, blob binary"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, held_out) of batches, of which only a slice is turned into Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield from zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True)


def chunked(order: int, chunk_bytes: int, blob_bytes: int):
    """Step 1, for mapInArrow over (doc_id, text, held_out)."""

    def keyed(chunk: int, kind: int, part: Part) -> Iterator[pa.RecordBatch]:
        part.flush()
        for at in range(0, len(part.keys), 100_000):
            k, n = part.keys[at : at + 100_000], part.n[at : at + 100_000]
            cols = [pa.array(np.full(len(k), kind, np.int8)), pa.array(np.full(len(k), chunk)), pa.array(k), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols + [pa.nulls(len(k), f.type) for f in list(CHUNKS)[4:]], schema=CHUNKS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=5)
        new = lambda: (uuid.uuid4().int >> 65, Part(), Part(), 0, 0)
        chunk, grams, tokens, size, doc = new()
        rows, held, n = [], [], 0  # of the blob: (doc, doc_id, held_out) and the pieces

        def emit() -> pa.RecordBatch:
            trained = np.array([not r[2] for r in rows])
            for part, (keys, lens) in ((grams, pack(held, order)), (tokens, words(held, order))):
                part.add(keys, np.repeat(trained, lens))
            row = {"kind": 2, "chunk": chunk, "sizes": [len(p) for p in held], "blob": codec.compress(b"".join(held), asbytes=True)}
            return pa.RecordBatch.from_pylist([row | dict(zip(("doc", "doc_id", "held_out"), map(list, zip(*rows, strict=True)), strict=True))], CHUNKS)

        for i, text, h in rows_of(batches):
            for p in pieces(symbols(text), order, blob_bytes):
                rows.append((doc, i, h))
                held.append(p)
                n += len(p)
                if n >= blob_bytes:
                    yield emit()
                    size += n
                    rows, held, n = [], [], 0
            doc += 1
            if size >= chunk_bytes:
                if held:
                    yield emit()
                    rows, held, n = [], [], 0
                yield from keyed(chunk, 0, grams)
                yield from keyed(chunk, 1, tokens)
                chunk, grams, tokens, size, doc = new()
        if held:
            yield emit()
        yield from keyed(chunk, 0, grams)
        yield from keyed(chunk, 1, tokens)

    return task


def discount(n: np.ndarray) -> np.ndarray:
    return np.minimum(MOST * n, DISCOUNT * np.sqrt(n))


def shorter(k: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of order o - 1 and their counts, from the distinct grams of order o."""
    return summed(k & ((1 << 8 * o) - 1), np.ones(len(k), np.int64))


def blended(p: np.ndarray, mine: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Estimates of one order from those of the order below; mine: the grams asked for, k and c: all grams of the order, sorted, and their counts."""
    if not len(k):
        return p
    context, aside = k >> 8, discount(c.astype(float))
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    t, e = np.add.reduceat(c.astype(float), first), np.add.reduceat(aside, first)
    i = np.minimum(np.searchsorted(context[first], mine >> 8), len(first) - 1)
    return np.where(context[first][i] == mine >> 8, (found(mine, k, c - aside) + e[i] * p) / t[i], p)


class LowOrders:
    """Orders 0 to 2 of the model: the counts of the three-byte sequences that occur, 2^24 at most."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        o = np.argsort(keys)
        self.orders = [(keys[o], n[o])]
        for order in (2, 1):
            self.orders.insert(0, shorter(self.orders[0][0], order))

    def estimates(self, keys: np.ndarray) -> np.ndarray:
        """Of the last symbol of each gram by the two bytes before it."""
        low, at = np.unique(keys & 0xFFFFFF, return_inverse=True)
        p = np.full(len(low), 1 / SYMBOLS)
        for o, (k, c) in enumerate(self.orders):
            p = blended(p, low & ((1 << 8 * (o + 1)) - 1), k, c)
        return p[at]


def low_orders(grams: DataFrame, order: int) -> LowOrders:
    seen = grams.filter("n > 0")
    if order > 2:
        seen = seen.select(F.col("key").bitwiseAND(0xFFFFFFFF).alias("key")).distinct().withColumn("n", F.lit(1))
    t = seen.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").cast("long").alias("n")).toArrow()
    return LowOrders(t.column("key").to_numpy(), t.column("n").to_numpy())


def costs(keys: np.ndarray, n: np.ndarray, low: LowOrders, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last symbol of each gram, in the order of keys.

    keys and n hold all grams of one or more contexts of three bytes; those with n = 0 are only asked for.
    """
    orders = [summed(keys[n > 0], n[n > 0])]
    for o in range(order, 3, -1):
        orders.insert(0, shorter(orders[0][0], o))
    p = low.estimates(keys)
    for o, (k, c) in enumerate(orders[: order - 2], 3):
        p = blended(p, keys & ((1 << 8 * (o + 1)) - 1), k, c)
    return np.log10(p)


def groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of rows that are ordered by their three bytes of context: whole contexts, about size rows at once."""
    held, rows = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        k, c = zip(*held, strict=True)
        return np.concatenate(k), np.concatenate(c)

    for b in batches:
        held.append((b.column("key").to_numpy(), b.column("n").to_numpy()))
        rows += b.num_rows
        if rows >= size:
            k, c = joined()
            context = k >> 8 & 0xFFFFFF
            cut = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
            if cut:
                yield k[:cut], c[:cut]
            held, rows = [(k[cut:], c[cut:])], len(k) - cut
    if rows:
        yield joined()


def corpus_scores(docs: DataFrame, held_out: Column, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, blob_bytes: int = BLOB_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text). order: 2 to 6."""
    if not 2 <= order <= 6:
        raise ValueError("a gram of order + 1 bytes must fit a number")
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    d = d.coalesce(max(spark.sparkContext.defaultParallelism, int(size // chunk_bytes) + 1))
    chunks = written(d.mapInArrow(chunked(order, chunk_bytes, blob_bytes), CHUNKS_DDL), "lm-chunks")
    keys = chunks.filter("kind < 2").select("kind", "chunk", "key", "n")
    counts = written(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    # a text is counted where its first piece stands
    firsts = chunks.filter("kind = 2").select("chunk", F.explode(F.filter(F.arrays_zip("doc", "held_out"), lambda x: ~x["held_out"])).alias("x")).select("chunk", "x.doc").distinct()
    trained = firsts.count()
    kinds = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("seen"), F.count("*").alias("rows")).collect()}
    tokens = int(kinds[1]["n"] if 1 in kinds else 0) + int(trained)
    types = int(kinds[1]["seen"] if 1 in kinds else 0) + (trained > 0)
    grams = counts.filter("kind = 0").select("key", "n")
    low = spark.sparkContext.broadcast(low_orders(grams, order))
    parts = max(spark.sparkContext.defaultParallelism, int(kinds[0]["rows"] if 0 in kinds else 0) // PART_ROWS + 1)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in groups(batches, PART_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int8)), pa.array(k), pa.array(costs(k, n, low.value, order))], names=["kind", "key", "value"])

    context = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    model = grams.repartition(parts, context).sortWithinPartitions(context).mapInArrow(priced, "kind byte, key long, value double")
    model = model.unionByName(counts.filter("kind = 1").select("kind", "key", F.col("n").cast("double").alias("value")))
    asked = keys.select("kind", "chunk", "key").join(model, ["kind", "key"]).select("chunk", "kind", "key", "value")
    blobs = chunks.filter("kind = 2").select(F.col("chunk").alias("of_chunk"), "doc", "doc_id", "held_out", "sizes", "blob")
    share = math.log10(tokens + 0.5 * (types + 1))
    out = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def scored(texts: pa.Table, values: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return out.empty_table()
        kind, key, value = (values.column(x).to_numpy() for x in ("kind", "key", "value"))
        grams, vocabulary = Lookup(key[kind == 0]), Lookup(key[kind == 1])
        cost, seen = value[kind == 0], value[kind == 1]
        base = np.log10(seen + 0.5) - share
        del kind, key, value
        n = 1 + max(max(x) for x in texts.column("doc").to_pylist())
        sums = {c: np.zeros(n) for c in ("n", "known", "base", "score")}
        ids, held = [None] * n, [False] * n
        for row in range(texts.num_rows):
            one = {c: texts.column(c)[row].as_py() for c in texts.column_names}
            data = pa.decompress(one["blob"], sum(one["sizes"]), "zstd", asbytes=True)
            ends = np.cumsum(one["sizes"]).tolist()
            parts = [data[e - k : e] for e, k in zip(ends, one["sizes"], strict=True)]
            doc = np.array(one["doc"])
            for d, i, h in zip(one["doc"], one["doc_id"], one["held_out"], strict=True):
                ids[d], held[d] = i, h
            g, lens = pack(parts, order)
            np.add.at(sums["score"], doc, np.add.reduceat(cost[grams.places(g)], np.cumsum(lens) - lens))
            h, lens = words(parts, order)
            at, of = vocabulary.places(h), np.repeat(doc, lens)
            sums["n"] += np.bincount(of, minlength=n)
            sums["known"] += np.bincount(of, seen[at] > 0, n)
            sums["base"] += np.bincount(of, base[at], n)
        cols = [
            pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sums["n"].astype(np.int64) + 1), pa.array(sums["known"].astype(np.int64) + int(trained > 0)),
            pa.array(np.full(n, tokens)), pa.array(sums["base"] + math.log10(trained + 0.5) - share), pa.array(sums["score"]),
        ]
        del texts, values, grams, vocabulary, cost, seen, base
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(cols, schema=out)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blobs.groupBy("of_chunk").cogroup(asked.groupBy("chunk")).applyInArrow(scored, ddl)


class Trie:
    """An adaptive PPM model in plain Python: counts by context, the same estimates; for single texts and tests."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def contexts(self, data: bytes, at: int) -> list[bytes]:
        """Of the highest order first."""
        h = (bytes([PAD]) * self.order + data)[at : at + self.order]
        return [h[self.order - o :] for o in range(self.order, -1, -1)]

    def learn(self, data: bytes, at: int) -> None:
        """Update exclusion: a shorter context counts only what is new in the longer one."""
        for c in self.contexts(data, at):
            n = self.counts[c]
            n[data[at]] += 1
            if n[data[at]] > 1:
                break

    def estimates(self, contexts: list[bytes]) -> dict[int, float]:
        """Of every symbol in the longest of some contexts (longest first); those of the shorter ones are spread over what is set aside."""
        if not contexts:
            return dict.fromkeys((s for s in range(256) if s != PAD), 1 / SYMBOLS)
        lower = self.estimates(contexts[1:])
        n = self.counts.get(contexts[0])
        if not n:
            return lower
        t, e = sum(n.values()), sum(float(discount(np.float64(x))) for x in n.values())
        return {s: (n[s] - float(discount(np.float64(n[s]))) if s in n else 0) / t + e / t * p for s, p in lower.items()}

    def cost(self, data: bytes, at: int) -> float:
        """log10 probability of the symbol at a place: escapes from context to context, each excluding what it offered."""
        excluded: set[int] = set()
        out, contexts = 0.0, self.contexts(data, at)
        for i, c in enumerate(contexts):
            offered = set(self.counts.get(c, ())) - excluded
            if not offered:
                continue
            p = self.estimates(contexts[i:])
            left = 1 - sum(p[s] for s in excluded)
            if data[at] in offered:
                return out + math.log10(p[data[at]] / left)
            excluded |= offered
            out += math.log10((1 - sum(p[s] for s in excluded)) / left)
        return out - math.log10(SYMBOLS - len(excluded))

    def train(self, text: str | None) -> None:
        data = symbols(text)
        for at in range(len(data)):
            self.learn(data, at)

    def score(self, text: str | None, adapt: bool = False) -> float:
        """log10 probability of the text; learns from each symbol after coding it if adapt."""
        data = symbols(text)
        total = 0.0
        for at in range(len(data)):
            total += self.cost(data, at)
            if adapt:
                self.learn(data, at)
        return total


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the model of those whose crc32 is not 1 modulo 5."""
    return corpus_scores(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), fold(F.col("doc_id"), 5) == 1)
