"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces (DataFrame functions only).

A text is cut without loss into sections (after empty lines), paragraphs (after line feeds) and pieces (runs of up to four words that end early at punctuation), the leaves. A
leaf's hash is the sha256 of its text, that of a paragraph the sha256 of its leaves' hashes, that of a section of its paragraphs' hashes, the root of the sections'
hashes: equal roots mean equal texts, and comparing two trees from the root down visits only branches that differ, which locates edits.

The fingerprint carries the root and the tree: after a colon its sections, divided by ``/``, of paragraphs, divided by ``.``, of leaves, ``LEAF`` hexadecimal digits each. So
two fingerprints tell without the texts whether these are equal, how alike they are and where they part. The likeness is the share of their distinct leaves that both
trees have, over all leaves; equal branches have equal leaves, so they need not be entered. ``first_edit`` goes down the first branch that differs. A fingerprint's
length is in proportion to the text's (about a third). Leaves are told apart by 32 bits: of n leaves against m others about n * m / 2^32 agree by chance.

``with_next`` finds each document's successor in descending doc_id without a global sort in one task: distinct ids are range partitioned, written, ordered within
their part, and the parts' first ids (one row each) tie the parts. The successor sends only the text that is asked for.

Nulls: a null text is empty; a null doc_id comes last. Rows that share a doc_id have the same successor, the next distinct id; where several rows have that id, the
one whose asked-for text sorts first is taken. A single id succeeds itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrel.functions.binding import let
from carrel.llm.common import table, written

#: Digits of a leaf in a fingerprint.
LEAF = 8
#: Stands for a null doc_id: below all ids.
LEAST = -(1 << 63)
PIECE = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?;:,][\x20\x09-\x0D]+){0,3}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
#: Where a section ends; split there, as a repeated group would recurse line by line.
SECTION_END = r"(?<=(?:^|\n)\n)"
#: The same sections as matches, for DuckDB.
SECTION = r"(?:[^\n]+\n)*\n|(?s:.+)"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def joined(hashes: Column) -> Column:
    return sha(F.array_join(hashes, ""))


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, leaves array<string>>>>>: the sections of a text."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), sha)
    paragraph = lambda p: let(leaves(p), lambda l: F.struct(joined(l).alias("hash"), l.alias("leaves")))
    paragraphs = lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), paragraph)
    section = lambda s: let(paragraphs(s), lambda p: F.struct(joined(F.transform(p, lambda x: x["hash"])).alias("hash"), p.alias("paragraphs")))
    return F.transform(F.filter(F.split(text, SECTION_END, -1), lambda s: s != ""), section)


def root(t: Column) -> Column:
    return joined(F.transform(t, lambda s: s["hash"]))


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: where the second tree has paragraphs that the first lacks; sections found in both are not entered."""
    known, old = F.transform(a, lambda s: s["hash"]), F.flatten(F.transform(a, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    at = F.transform(b, lambda s, i: F.struct(i.alias("section"), s["hash"].alias("hash"), s["paragraphs"].alias("paragraphs")))
    changed = F.filter(at, lambda s: ~F.array_contains(known, s["hash"]))
    return F.flatten(F.transform(changed, lambda s: F.filter(
        F.transform(s["paragraphs"], lambda p, j: F.struct(s["section"].alias("section"), F.when(~F.array_contains(old, p["hash"]), j).alias("paragraph"))),
        lambda x: x["paragraph"].isNotNull())))


def fingerprint(text: Column) -> Column:
    short = lambda p: F.array_join(F.transform(p["leaves"], lambda l: F.left(l, F.lit(LEAF))), "")
    shown = lambda t: F.array_join(F.transform(t, lambda s: F.array_join(F.transform(s["paragraphs"], short), ".")), "/")
    return let(tree(text), lambda t: F.concat(root(t), F.lit(":"), shown(t)))


def body(fp: Column) -> Column:
    return F.substr(fp, F.lit(66))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1; 1 for equal ones."""
    leaves = lambda fp: F.array_distinct(F.regexp_extract_all(body(fp), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))
    share = lambda x, y, n: F.coalesce(F.try_divide(n.cast("double"), F.size(x) + F.size(y) - n), F.lit(0.0))
    both = let(leaves(a), lambda x: let(leaves(b), lambda y: let(F.size(F.array_intersect(x, y)), lambda n: share(x, y, n))))
    return F.when(a == b, F.lit(1.0)).otherwise(both)


def first_edit(a: Column, b: Column) -> Column:
    """section.paragraph.leaf, from 0, where two fingerprints begin to differ; empty for equal ones."""

    def parting(x: Column, y: Column) -> Column:
        """The first place at which two arrays differ; they are not equal."""
        places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
        return F.get(F.filter(places, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))), F.lit(0))

    def below(x: Column, y: Column, cuts: list, shown: list[Column]) -> Column:
        if not cuts:
            return F.concat_ws(".", *[c.cast("string") for c in shown])
        cut, *rest = cuts
        part = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
        return let(cut(x), lambda xs: let(cut(y), lambda ys: let(parting(xs, ys), lambda i: below(part(xs, i), part(ys, i), rest, [*shown, i]))))

    cuts = [lambda c: F.split(c, "/", -1), lambda c: F.split(c, r"\.", -1), lambda c: F.regexp_extract_all(c, F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))]
    return F.when(body(a) == body(b), F.lit("")).otherwise(below(body(a), body(b), cuts, []))


def successors(docs: DataFrame) -> DataFrame:
    """(key, next, need): the next key in descending order, wrapping around, and half of the longest text of the key."""
    spark = docs.sparkSession
    ids = docs.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = written(ids.repartitionByRange(parts, F.col("key").desc()).withColumn("part", F.spark_partition_id()), "merkle-ids")
    first = ids.groupBy("part").agg(F.max("key").alias("first"))  # a row for each part
    first = first.withColumn("after", F.lead("first").over(Window.orderBy("part"))).withColumn("top", F.max("first").over(Window.partitionBy()))
    step = F.lead("key").over(Window.partitionBy("part").orderBy(F.col("key").desc()))
    out = ids.withColumn("step", step).join(first, "part")
    return out.select("key", F.coalesce("step", "after", "top").alias("next"), F.floor(F.col("n") / 2).cast("int").alias("need"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text (as far as it is asked for), next_fingerprint for every row of docs(doc_id, text).

    Both joins take the same columns of docs, so that the texts are shuffled once.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    asked = successors(d).select(F.col("next").alias("key"), F.col("key").alias("by"), "need")
    given = d.join(asked, "key").select("by", F.struct(F.left("text", F.col("need")).alias("text"), fingerprint(F.col("text")).alias("fp")).alias("next"))
    given = given.groupBy(F.col("by").alias("key")).agg(F.min("next").alias("next"))
    doc_id = F.nullif(F.col("key"), F.lit(LEAST)).alias("doc_id")
    return d.join(given, "key").select(doc_id, "text", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fingerprint"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and the next documents."""
    d = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    d = d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), sha(F.col("edited")).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    return d.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"),
    )


def _q(s: str) -> str:
    return s.replace("'", "''")


def _join(x: str, by: str = "") -> str:
    return f"coalesce(list_aggregate({x}, 'string_agg', '{by}'), '')"


def _tree_sql(t: str) -> str:
    """A list of sections of paragraphs of leaves."""
    leaves = f"list_transform(regexp_extract_all(p, '{_q(PIECE)}'), lambda x: sha256(x))"
    return f"list_transform(regexp_extract_all({t}, '{_q(SECTION)}'), lambda s: list_transform(regexp_extract_all(s, '{_q(PARAGRAPH)}'), lambda p: {leaves}))"


def _fp_sql(tree: str) -> str:
    hashes = f"list_transform({tree}, lambda s: sha256({_join('list_transform(s, lambda p: sha256(' + _join('p') + '))')}))"
    short = _join(f"list_transform(p, lambda x: substr(x, 1, {LEAF}))")
    shown = _join(f"list_transform({tree}, lambda s: {_join(f'list_transform(s, lambda p: {short})', '.')})", "/")
    return f"sha256({_join(hashes)}) || ':' || {shown}"


def _leaves_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '[0-9a-f]{{{LEAF}}}')"


def _like_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct({_leaves_sql(f'substr({c}, 66)')})" for c in (a, b))
    n = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce({n}::DOUBLE / nullif(len({x}) + len({y}) - {n}, 0), 0.0) END"


def _part_sql(x: str, y: str) -> str:
    return f"list_filter(range(0, greatest(len({x}), len({y}))), lambda i: {x}[i + 1] IS DISTINCT FROM {y}[i + 1])[1]"


OP3_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS ed FROM n),
x AS (SELECT *, {_tree_sql('t')} AS a, {_tree_sql('ed')} AS b, {_tree_sql('nt')} AS c FROM e),
f AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, {_fp_sql('a')} AS fingerprint,
  {_fp_sql('b')} AS edited_fingerprint, {_fp_sql('c')} AS nf FROM x),
s AS (SELECT *, string_split(substr(fingerprint, 66), '/') AS sa, string_split(substr(edited_fingerprint, 66), '/') AS sb FROM f),
si AS (SELECT *, {_part_sql('sa', 'sb')} AS i FROM s),
p AS (SELECT *, string_split(coalesce(sa[i + 1], ''), '.') AS pa, string_split(coalesce(sb[i + 1], ''), '.') AS pb FROM si),
pj AS (SELECT *, {_part_sql('pa', 'pb')} AS j FROM p),
l AS (SELECT *, {_leaves_sql("coalesce(pa[j + 1], '')")} AS la, {_leaves_sql("coalesce(pb[j + 1], '')")} AS lb FROM pj)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_like_sql('fingerprint', 'edited_fingerprint')} AS near_edited,
  {_like_sql('fingerprint', 'nf')} AS near_next,
  CASE WHEN i IS NULL THEN '' ELSE concat_ws('.', i, j, {_part_sql('la', 'lb')}) END AS first_edit FROM l"""
