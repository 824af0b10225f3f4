"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by what it says, as shares of its words and of its letter triples by hash bucket (``BUCKETS`` each), and by how
it is written: shares of its bytes and words (letters of either case, digits, symbols, repeated words, word triples seen before in the document, ...). It is encoded by a small tanh layer, weighted by gated attention
(softmax over the document of w . (tanh(V h) * sigmoid(U h))), and the weighted sum of the encodings is scored by a logistic unit. Encoder, attention and
scorer are learned together from document labels.

Training takes at most ``TRAIN_DOCS`` labelled documents of each label, those of least hash, from the rows outside the held-out fold, and of a long one ``TRAIN_PASSAGES`` passages, evenly
spaced; passages are described on the executors, only their features reach the driver. The prior of the labels in the whole training fold is restored after training on equal numbers. Weights are a few thousand numbers.
Scoring is one scan over whole texts without a shuffle.

Nulls: a null text is empty; an empty text is one passage of zeros and gets a score like any other. Rows without a label or with a null doc_id do not train; repeated labels count each.
Without labels of both kinds every score is the share of label 1 (0.5 without any). An empty table gives no rows. Extra columns are carried along.
Texts above ``LONG_BYTES`` are described block by block, to bound the arrays of bytes; blocks end with a passage, and words are compared over the whole text, so the features are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import fold, spread, table, written
from carrel.llm.wordhash import U, block_hashes, gram_hashes, mix

PASSAGE = 32
TRAIN_DOCS = 3000
HIDDEN, GATE = 24, 12
EPOCHS, STEP = 30, 0.01
TRAIN_PASSAGES = 64
LONG_BYTES = 4 << 20
#: Hash buckets of words, and of letter triples.
BUCKETS = 64
#: How many times smaller the features of content are made than those of form, of which there are fewer: few labels then do not fit chance words.
CONTENT = 4.0
THRESHOLD = 0.7

#: Byte classes: white space, upper, lower, digit, full stop and comma, exclamation and question, bar, line feed, beyond ASCII, other symbols.
WHITE, UPPER, LOWER, DIGIT, STOP, SHOUT, BAR, LINE, HIGH, SYMBOL = range(10)


def _class(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return HIGH
    if c == "\n":
        return LINE
    if c == " " or 9 <= b <= 13:
        return WHITE
    if c.isupper():
        return UPPER
    if c.islower():
        return LOWER
    if c.isdigit():
        return DIGIT
    return STOP if c in ".," else SHOUT if c in "!?" else BAR if c == "|" else SYMBOL


CLASSES = np.array([_class(b) for b in range(256)], np.uint8)
FEATURES = 10 + 11 + 2 * BUCKETS
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


def words_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in an array of bytes."""
    cls = CLASSES[a]
    return block_hashes(a, (cls != WHITE) & (cls != LINE))


def repeats(h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Which words are the one before, the one before that, and the first of a triple that the document had already; doc: the text of each word."""

    def back(k: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
        return same

    seen = np.zeros(len(h), bool)
    g = gram_hashes(h, 3)
    if len(g):
        _, firsts = np.unique(mix(g + doc[: len(g)].astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
        seen[: len(g)] = True
        seen[firsts] = False
        seen[: len(g)] &= doc[: len(g)] == doc[2:]
    return [back(1), back(2), seen]


def passages(a: np.ndarray, h: np.ndarray, starts: np.ndarray, again: list[np.ndarray], pid: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Features of passages. a: their bytes, one passage after the other, which begin at ``at``; pid: the passage of each word; total: the words of each passage's text."""
    size, cls = len(at), CLASSES[a]
    by_class = [np.add.reduceat((cls == c).astype(np.int32), at) for c in range(10)]
    n_bytes = np.maximum(1, np.diff(np.append(at, len(a))))
    count = lambda x: np.bincount(pid, x, size) if len(pid) else np.zeros(size)
    words = count(None)
    w = np.maximum(1, words)
    inside = (cls != WHITE) & (cls != LINE)
    lens = np.add.reduceat(inside.astype(np.int32), starts) if len(starts) else starts
    upper = np.add.reduceat((cls == UPPER).astype(np.int32), starts) if len(starts) else starts
    lower = np.add.reduceat((cls == LOWER).astype(np.int32), starts) if len(starts) else starts
    letters = upper + lower + (np.add.reduceat((cls == HIGH).astype(np.int32), starts) if len(starts) else 0)
    distinct = np.zeros(size)
    if len(h):
        _, i = np.unique(mix(h + pid.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
        distinct = np.bincount(pid[i], minlength=size)
    cols = [c / n_bytes for c in by_class] + [
        *[count(x) / w for x in again], distinct / w, count(lens.astype(float)) / w / 16, count(letters == 0) / w,
        count((upper > 1) & (lower == 0)) / w, count(lens <= 2) / w, np.log1p(words) / 4, np.log1p(total) / 10, (total == 0).astype(float),
    ]
    by_word = np.bincount(pid * BUCKETS + (h >> U(32)).astype(np.int64) % BUCKETS, minlength=size * BUCKETS).reshape(size, BUCKETS)
    three = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:]) if len(a) > 2 else np.zeros(0, int)
    b = LOWERED[a]
    bucket = (triple(b[three], b[three + 1], b[three + 2]) % BUCKETS).astype(np.int64)
    of = np.zeros(len(a), np.int32)
    of[at[1:]] = 1
    by_triple = np.bincount(np.cumsum(of)[three] * BUCKETS + bucket, minlength=size * BUCKETS).reshape(size, BUCKETS)
    # of a whole passage's words, and over some triples more than there are, so that a few words say little
    shares = [by_word / PASSAGE, by_triple / (by_triple.sum(axis=1, keepdims=True) + BUCKETS)]
    return np.concatenate([np.stack(cols, axis=1), *shares], axis=1).astype(np.float32)


def triple(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A hash of three bytes, as 32-bit numbers."""
    h = (x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA6B)) ^ (z * np.uint32(0xC2B2AE35))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)


def described(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts one after the other, and the number of passages of each text (one at least)."""
    a = np.frombuffer(b" ".join(datas) + b" ", np.uint8)
    h, starts = words_of(a)
    begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in datas])))
    off = np.searchsorted(starts, begin)
    n = np.diff(off)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per)))  # first passage of each text
    doc = np.repeat(np.arange(len(datas)), n)
    place = np.arange(len(h)) - off[doc]
    pid = first[doc] + place // PASSAGE
    at = np.zeros(int(first[-1]), np.int64)
    at[first[:-1]] = begin[:-1]
    lead = (place % PASSAGE == 0) & (place > 0)
    at[pid[lead]] = starts[lead]
    return passages(a, h, starts, repeats(h, doc), pid, at, np.repeat(n, per)), per


def described_long(data: bytes, block: int) -> np.ndarray:
    """described() of one long text; arrays of bytes are of about block bytes, arrays of words of the whole text."""
    hashes, places, at = [], [], 0
    while at < len(data):
        end = data.find(b" ", at + block) if len(data) - at > block else len(data)
        end = len(data) if end < 0 else end
        h, starts = words_of(np.frombuffer(data[at:end] + b" ", np.uint8))
        hashes.append(h)
        places.append(starts + at)
        at = end
    h, starts = np.concatenate(hashes), np.concatenate(places)
    again = repeats(h, np.zeros(len(h), np.int64))
    leads = starts[::PASSAGE].copy()
    leads[:1] = 0
    out, i = [], 0
    while i < len(leads):
        k = max(i + 1, int(np.searchsorted(leads, leads[i] + block)))
        end = int(leads[k]) if k < len(leads) else len(data)
        a = np.frombuffer(data[leads[i] : end] + (b"" if k < len(leads) else b" "), np.uint8)
        mine = slice(i * PASSAGE, k * PASSAGE)
        pid = np.arange(len(h[mine])) // PASSAGE
        out.append(passages(a, h[mine], starts[mine] - leads[i], [x[mine] for x in again], pid, leads[i:k] - leads[i], np.full(min(k, len(leads)) - i, len(h))))
        i = k
    return np.concatenate(out) if out else described([data])[0]


def bags(texts: list[str | None], long: int = LONG_BYTES) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places of texts, passage features, passages of each) in blocks of bounded size."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        d = (t or "").encode("utf-8", "surrogatepass")
        if len(d) > long:
            x = described_long(d, long)
            yield [i], x, np.array([len(x)])
            continue
        at.append(i)
        held.append(d)
        size += len(d)
        if size > 1 << 20:
            yield at, *described(held)
            at, held, size = [], [], 0
    if held:
        yield at, *described(held)


class Model:
    """Encoder, gated attention and scorer."""

    SHAPES = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "G": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k == "w" else np.zeros(s) for k, s in self.SHAPES.items()}
        self.p["c"] = r.normal(0, 0.1, HIDDEN)
        self.mean, self.scale, self.shift = np.zeros(FEATURES), np.ones(FEATURES), 0.0

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(per) - per
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (v * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), per))
        a = e / np.repeat(np.add.reduceat(e, first), per)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "v": v, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def scores(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, per)["logit"] + self.shift, -30, 30)))

    def gradients(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, per)
        first = np.cumsum(per) - per
        out = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        dz = out[:, None] * p["c"]
        dz_p = np.repeat(dz, per, axis=0)
        da = (dz_p * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), per))
        dv = de[:, None] * p["w"] * f["g"] * (1 - f["v"] ** 2)
        dg = de[:, None] * p["w"] * f["v"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz_p + dv @ p["V"].T + dg @ p["G"].T
        ds = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ ds, "b": ds.sum(axis=0), "V": f["h"].T @ dv, "G": f["h"].T @ dg, "w": ((f["v"] * f["g"]) * de[:, None]).sum(axis=0),
            "c": f["z"].T @ out, "d": np.array([out.sum()]),
        }

    def fit(self, docs: list[tuple[np.ndarray, int]], prior: float, seed: int = 1) -> Model:
        """Adam on batches of 128 documents; docs: passage features and label."""
        every = np.concatenate([x for x, _ in docs])
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        self.scale[-2 * BUCKETS :] *= CONTENT
        y = np.array([l for _, l in docs], float)
        share = y.mean()
        if not 0 < share < 1:
            self.p["c"][:], self.shift = 0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
            return self
        r = np.random.default_rng(seed)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(docs))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                g = self.gradients(np.concatenate([docs[i][0] for i in part]), np.array([len(docs[i][0]) for i in part]), y[part])
                t += 1
                for k, v in self.p.items():
                    d = g[k] + 1e-4 * v
                    m[k], s[k] = 0.9 * m[k] + 0.1 * d, 0.999 * s[k] + 0.001 * d * d
                    v -= STEP * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        # from equal numbers back to the shares of the labels
        self.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        return self


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = TRAIN_DOCS) -> Model:
    """A model from the usable rows of docs(doc_id, text) and labels(doc_id, quality)."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    picked = None
    for y in (0, 1):
        part = rows.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.unionByName(part)
    picked = written(picked, "quality-labels")  # 2 * per_label rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("quality").to_pylist()
            for at, x, per in bags(batch.column("text").to_pylist()):
                begin = np.cumsum(per) - per
                some = lambda n: np.unique(np.linspace(0, n - 1, TRAIN_PASSAGES).astype(int)) if n > TRAIN_PASSAGES else slice(0, n)
                rows = [x[b : b + n][some(n)].tobytes() for b, n in zip(begin, per, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([label[i] for i in at], pa.int32()), pa.array(rows, pa.binary())], names=["quality", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text").mapInArrow(features, "quality int, x binary")
    got = sorted(((bytes(r["x"]), r["quality"]) for r in sample.toLocalIterator()), key=lambda r: (r[1], r[0]))
    bag = [(np.frombuffer(x, np.float32).reshape(-1, FEATURES), y) for x, y in got]
    return Model().fit(bag, prior) if bag else Model().fit([(np.zeros((1, FEATURES), np.float32), 1)], prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with a column score; a column of that name is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, x, per in bags(batch.column("text").to_pylist()):
                out[at] = shared.value.scores(x, per)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(task, schema)


HELD_OUT = 2


def corpus_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the documents whose crc32 is not 2 modulo 4."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != HELD_OUT)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; threshold 0.7."""
    d = scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), corpus_model(spark, sf_dir))
    return d.select(
        "doc_id", (fold(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
