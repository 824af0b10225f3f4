"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Signatures. Each text becomes the set of hashes of its k-word shingles and a signature of ``BANDS * ROWS`` minima. Texts with the same words are one
   node, represented by their smallest doc_id, so copies cost one row.
2. Candidates. Nodes that agree on a band share a bucket. A bucket does not emit its pairs: its members are dealt to ``LEADERS`` salts, the smallest id of each
   salt is a leader, and every member is paired with the leaders (linear in the bucket; minima are combined before the shuffle).
3. Verification. Signatures of a pair are compared batch by batch. After each batch the posterior of the similarity (uniform prior) bounds the
   probability that it reaches the threshold; below ``MISS`` the pair is dropped. Survivors are verified exactly on their full sets.
4. Components of the links: few of them, counted first, in one task; more by alternating large and small stars, each round written.
5. The rest. Where the non-leaders of a bucket are still in several components, links between them may be missing. Those outside the largest component of
   their bucket are a query set that is compared, in blocks and without emitting pairs, with all members of other components that they share buckets with, by
   signatures and then on full sets. Then components once more.

A link is missed only if its pair shares no band (probability (1 - 0.8^5)^32 = 3e-6 at the threshold, less above it) or is dropped in 3 (about MISS).

Nulls and edges: a null or empty text, or one without words, has the empty set and is linked with nothing. A text of fewer than k words has one shingle, the whole
sequence. Rows with one doc_id are one node with several texts. A row with a null doc_id joins the component of rows with the same words; words that only such rows have
are linked with nothing, and their component is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import spread, table, written
from carrel.llm.wordhash import SPACED, digest, gram_hashes, mix, normal, powers, word_hashes

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
LEADERS = 2
BATCH = 32
MISS = 1e-6
#: Ids or buckets (numbers) that are broadcast, counted first; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Links that are united in one task (about 100 bytes each there).
TASK_EDGES = 500_000
#: Shingles and members of a block that is compared in one task.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 18, 256
#: Tasks that the pairs of blocks are dealt to, at most.
BLOCK_TASKS = 20_000
U = np.uint64


@lru_cache(1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 63, HASHES, np.uint64) * U(2) + U(1), r.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text's word hashes, in order."""
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else h


def signature(s: np.ndarray) -> np.ndarray:
    a, b = seeds()
    out = np.full(HASHES, 0xFFFFFFFF, U)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, ((s[at : at + 2048, None] * a + b) >> U(32)).min(axis=0))
    return out.astype(np.uint32)


def bands(sigs: np.ndarray) -> np.ndarray:
    """A hash of each band of each signature."""
    s = sigs.reshape(-1, BANDS, ROWS).astype(U)
    p = powers(ROWS + 1)
    return mix((s * p[1 : ROWS + 1]).sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93)).view(np.int64)


@lru_cache(16)
def least_matches(threshold: float, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared hashes a pair with fewer than m equal ones has P(similarity >= threshold) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is the probability of at most m successes in n + 1 draws.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, p, m = 0.0, (1 - threshold) ** (n + 1), 0
        while True:
            tail += p
            if tail >= miss:
                break
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((n, m))
    return tuple(out)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signatures survive the sequential comparison."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for n, m in least_matches(threshold):
        equal[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


SIGNED = "doc_id long, n_shingles long, key binary, bands array<long>, sig binary"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """SIGNED for every row of docs(doc_id, text); key, bands and sig are null without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                datas = [normal(t, SPACED) for t in rows.column("text").to_pylist()]
                h, off = word_hashes(datas)
                sets = [shingles(h[a:b], k) for a, b in zip(off[:-1], off[1:], strict=True)]
                some = [len(s) > 0 for s in sets]
                sigs = np.array([signature(s) if n else np.zeros(HASHES, np.uint32) for s, n in zip(sets, some, strict=True)], np.uint32).reshape(-1, HASHES)
                of = bands(sigs).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(d) if n else None for d, n in zip(datas, some, strict=True)], pa.binary()),
                        pa.array([x if n else None for x, n in zip(of, some, strict=True)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if n else None for x, n in zip(sigs, some, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key", "bands", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SIGNED)


def only(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is (left_semi) or is not (left_anti) in keys, a frame of that column. Few keys are broadcast, counted first; more are joined by a shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, key, how)


#: Parts that the rows of a key are dealt to where the other side of a join is too large to be broadcast.
SALTS = 16


def beside(df: DataFrame, one: DataFrame, key: str, by: str = "id") -> DataFrame:
    """df with the columns of one, a frame of one row for each key at most (inner join). A key may hold any part of df: its rows are not dealt by the key alone.

    Few rows of one are broadcast, counted first; more are repeated for each of ``SALTS`` parts, into which df's rows go by the hash of ``by``.
    """
    if one.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(one), key)
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(one, [key, "__salt"]).drop("__salt")


def members(pairs: DataFrame) -> DataFrame:
    """The distinct ids in pairs(a, b)."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles binary) of the documents whose ids are in ids(id), one row for each distinct set."""
    d = only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                h, off = word_hashes([normal(t, SPACED) for t in rows.column("text").to_pylist()])
                sets = [shingles(h[a:b], k).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return d.mapInArrow(task, "id long, shingles binary").filter(F.length("shingles") > 0)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    hundredths = round(threshold * 100)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= hundredths * (len(x) + len(y) - n))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long").distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large or small star round over edges (a > b): every node's (larger, or smaller) neighbours are tied to its least one."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        e = e.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    e = e.join(least, "u")
    out = e.filter("v > u") if large else e.filter("v <> m")
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (a, b) of one task, by union and find."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := parent.setdefault(root, root)) != root:
            root = y
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], names=["node", "component"])


def components(links: DataFrame, limit: int = 50) -> DataFrame:
    """(node, component) of the nodes in links(a, b): the smallest node that each can reach.

    Up to ``TASK_EDGES`` links, counted first, are united in one task; more go through rounds of alternating stars, each written.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "dedup-edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    if before[0] <= TASK_EDGES:
        return written(edges.coalesce(1).mapInArrow(united, "node long, component long"), "dedup-components")
    for _ in range(limit):
        if not before[0]:
            break
        edges = written(star(star(edges, True), False), "dedup-edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def leader_pairs(buckets: DataFrame, leaders: int) -> DataFrame:
    """Distinct pairs a > b of the members of buckets(bucket, id) with their bucket's leaders, and no others."""
    heads = buckets.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("salt")).agg(F.min("id").alias("head"))
    heads = written(heads.groupBy("bucket").agg(F.collect_set("head").alias("heads")), "dedup-heads")  # as many as salts at most
    p = beside(buckets, heads, "bucket").select("id", F.explode("heads").alias("head")).filter("id <> head")
    return p.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct()


def screened(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs that survive the size bound and the sequential comparison of signatures."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9).select("a", "b", "sa", "sb")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint32).reshape(-1, HASHES) for x in ("sa", "sb"))
                kept = pa.array(similar(a, b, threshold))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return both.mapInArrow(task, "a long, b long").distinct()


def unsettled(buckets: DataFrame, labels: DataFrame, leaders: int) -> DataFrame:
    """(bucket, id, component, query) of the non-leaders of buckets whose non-leaders are in several components.

    query: not in the largest component of the bucket. A link still missing has such a member, and both its members share such a bucket.
    """
    heads = buckets.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("salt")).agg(F.min("id").alias("id"))
    members = buckets.join(heads.select("bucket", "id"), ["bucket", "id"], "left_anti")
    members = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = written(members, "dedup-members")
    per = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = per.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest")).filter("parts > 1")
    return beside(members, written(open_, "dedup-open"), "bucket").select("bucket", "id", "component", (F.col("component") != F.col("largest")).alias("query"))


def compared(queries: list[dict], data: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links between queries and rows of data of other components: enough of them to tie the components that have any."""
    hundredths = round(threshold * 100)
    sets = [np.frombuffer(r["shingles"], U) for r in data]
    sizes = np.array([len(x) for x in sets])
    sigs = np.array([signature(x) for x in sets])
    parts = np.array([r["component"] for r in data])
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    links = []
    for q in queries:
        mine = np.frombuffer(q["shingles"], U)
        near = (parts != q["component"]) & (100 * np.minimum(sizes, len(mine)) >= hundredths * np.maximum(sizes, len(mine)))
        found = np.flatnonzero(near)
        if not len(found):
            continue
        found = found[similar(np.broadcast_to(signature(mine), (len(found), HASHES)), sigs[found], threshold)]
        if not len(found):
            continue
        has = np.zeros(len(tokens), bool)
        i = np.minimum(np.searchsorted(tokens, mine), len(tokens) - 1)
        has[i[tokens[i] == mine]] = True
        for x in found:
            n = int(has[at[begin[x] : begin[x] + sizes[x]]].sum())
            if 100 * n >= hundredths * (len(mine) + int(sizes[x]) - n):
                a, b = top(q["component"]), top(int(parts[x]))
                if a != b:
                    parent[a] = b
                    links.append((q["id"], data[x]["id"]))
    return links


def settled(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The missing links (a, b) among unsettled members.

    Members that share buckets, directly or through others, are a cluster. Its queries are compared with all its members in blocks of at most about
    ``BLOCK_TOKENS`` shingles and ``BLOCK_ROWS`` members, each pair of blocks a task of its own: by signatures first, then exactly. Only links that tie components leave a task.
    """
    heads = written(rest.groupBy("bucket").agg(F.min("id").alias("head")), "dedup-heads")
    ties = beside(rest, heads, "bucket").select(F.col("id").alias("a"), F.col("head").alias("b"))
    clusters = components(ties).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    rows = rest.groupBy("id", "component").agg(F.max("query").alias("query")).join(clusters, "id").join(sets, "id")
    rows = written(rows.withColumn("n", F.length("shingles") / 8), "dedup-rows")
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(F.sum(n), F.lit(0)) / BLOCK_TOKENS), F.ceil(F.count(n) / BLOCK_ROWS)).cast("int")
    per = rows.groupBy("cluster").agg(blocks(F.col("n")).alias("d_blocks"), blocks(F.when(F.col("query"), F.col("n"))).alias("q_blocks"))
    per = written(per.filter("q_blocks > 0"), "dedup-clusters")
    tasks = per.agg(F.sum(F.col("d_blocks").cast("double") * F.col("q_blocks"))).first()[0] or 1
    rows = beside(rows, per, "cluster")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["cluster", "id", "component", "shingles"]
    q = rows.filter("query").select(*base, F.lit(True).alias("query"), own("q_blocks").alias("qb"), every("d_blocks").alias("db"))
    d = rows.select(*base, F.lit(False).alias("query"), every("q_blocks").alias("qb"), own("d_blocks").alias("db"))

    def task(t: pa.Table) -> pa.Table:
        r = t.select(["id", "component", "query", "shingles"]).to_pylist()
        data = [x for x in r if not x["query"]]
        links = compared([x for x in r if x["query"]], data, threshold) if data else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    # dealt by pair of blocks, about two tasks for each: a frame that is dealt by cluster already would be taken as it is, and small tasks be joined
    dealt = q.unionByName(d).repartition(int(min(BLOCK_TASKS, 2 * tasks)), "cluster", "qb", "db")
    return dealt.groupBy("cluster", "qb", "db").applyInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, leaders: int = LEADERS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    sigs = written(signed(docs, k), "dedup-signatures")
    reps = sigs.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    reps = written(reps, "dedup-texts")
    nodes = reps.filter("id IS NOT NULL")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "id")
    shared = written(buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket"), "dedup-shared")
    # most buckets have one member; while the others are few, their members are found without another shuffle
    buckets = written(only(buckets, shared, "bucket"), "dedup-buckets")
    pairs = written(leader_pairs(buckets, leaders), "dedup-candidates")
    pairs = written(screened(pairs, only(nodes, members(pairs), "id"), threshold), "dedup-pairs")
    links = written(confirmed(pairs, sets_of(docs, members(pairs), k), threshold), "dedup-links")
    labels = components(links)
    rest = written(unsettled(buckets, labels, leaders), "dedup-rest")
    if not rest.isEmpty():
        more = settled(rest, sets_of(docs, rest.select("id").distinct(), k), threshold)
        # links found before, as ties of nodes to their components
        ties = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(ties.unionByName(more))
    classes = reps.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("key", F.coalesce("component", "id").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, similarity 0.8."""
    d = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=2, threshold=0.8)
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Links by counting shared shingles, components by closure; for DuckDB.
OP4_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 1))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.df, s.g) AS k FROM s JOIN df USING (g) JOIN n USING (doc_id)),
p AS (SELECT * FROM o WHERE k <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
