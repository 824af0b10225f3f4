"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a word target by weight (a share of the whole, capped at ``max_epochs`` times its size, the excess reshared by weight). With r = target / size, every
document gets floor(r) certain whole copies; the remaining words are drawn by Pareto order sampling with unequal probabilities: the odds that a document is
included once more are proportional to its size, odds_i = c * size_i. Documents are ranked by the odds of a uniform number divided by their inclusion odds, and the
smallest ranks are taken until the target is met. The factor c of a source is the same for all its documents, so it does not change their order; it is what the
target makes it: the rank at which the sample ends. ``inclusion`` is then c * size / (1 + c * size), with which totals over documents can be estimated from the
sample (each taken one counts 1 / inclusion). The sample size is fixed in words, so the last document is taken only as far as the target needs.

Scale: no window runs over a whole source. Ranks are mapped to (0, 1) and read as digits of base ``DIGIT``: words are summed by (source, digit), which is combined before the
shuffle, the digit in which a source's target falls is found, and only its documents are looked at with the next digit, until no source has more than ``EXACT`` documents left
(or the digits end); those are ordered exactly. So windows see DIGIT rows a source and EXACT documents, whatever the size of the table, unless more documents than that share a rank.
The uniform number is a hash of the seed and the doc_id, so reruns and lost executors give the same mix.

Nulls: a null text has size 0; a null source is a source of its own and comes last; a null doc_id hashes as 'null'. A document of size 0 ranks last and takes nothing.
Repeated rows are separate documents; rows equal in rank, doc_id and size are interchangeable. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrel.llm.common import n_words, spread, table, written

#: Buckets of a step of the search for the end of a sample, and the steps.
DIGIT, STEPS = 256, 5
#: Documents of a source that are ordered in one window.
EXACT = 20_000
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, filled, target): water-filling in closed form over the table of sources.

    The windows here run over one row per source, after aggregation.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("filled"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_w", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))
    s = s.withColumn("first", F.min(fits).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("first.level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", "filled", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def sample_ends(ranked: DataFrame, exact: int, steps: int) -> DataFrame:
    """(e_source, e_low, e_high, e_before): where the sample of each source that needs one ends: among its documents with e_low <= place < e_high, before which e_before words are taken.

    ranked: (source, size, rest, place) with place in [0, 1). One pass over the documents still in question for each digit.
    """
    left, ends, width = ranked.filter("rest > 0"), None, 1.0
    for step in range(steps):
        width /= DIGIT
        digit = F.floor(F.col("place") / F.lit(width)).cast("long")
        keys = ["source"] + ([] if ends is None else ["e_before"])
        per = left.groupBy(*keys, digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("digit")) - F.col("words") + (F.lit(0) if ends is None else F.col("e_before"))
        per = per.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        found = per.select(
            F.col("source").alias("e_source"), (F.col("digit") * F.lit(width)).alias("e_low"), ((F.col("digit") + 1) * F.lit(width)).alias("e_high"),
            F.col("before").cast("long").alias("e_before"), "n",
        )
        ends = written(found, "mix-ends")  # a row for each source
        if step + 1 == steps or (ends.agg(F.max("n")).first()[0] or 0) <= exact:
            break
        columns = ["source", "size", "rest", "place"]
        left = ranked.join(ends.drop("n"), same("source", "e_source")).filter("place >= e_low AND place < e_high").select(*columns, "e_before")
    return ends.drop("n")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED, exact: int = EXACT, steps: int = STEPS
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, inclusion, taken for every row of docs(doc_id, text, source)."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, share, max_epochs)
    targets = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = targets.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("copies") * F.col("source_size")))
    targets = written(targets.withColumnRenamed("source", "t_source"), "mix-targets")
    u = uniform(F.col("doc_id"), seed)
    rank = (u / (1 - u)) / F.nullif(F.col("size"), F.lit(0))  # of sizes alone: the factor of the source does not change the order
    ranked = sizes.join(targets, same("source", "t_source")).withColumn("rank", F.coalesce(rank, F.lit(float("inf"))))
    spread = F.col("rank") * F.col("source_size") / F.col("filled")
    place = F.when(F.col("size") > 0, F.least(spread / (1 + spread), F.lit(1 - 2.0**-52))).otherwise(F.lit(1.0))
    ranked = ranked.withColumn("place", place).select("doc_id", "source", "size", "source_size", "target", "copies", "rest", "rank", "place")
    ends = sample_ends(ranked, exact, steps)
    ranked = ranked.join(ends, same("source", "e_source"), "left")
    at_end = F.coalesce((F.col("place") >= F.col("e_low")) & (F.col("place") < F.col("e_high")), F.lit(False))
    within = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size")
    seen = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("e_before")
    cut = ranked.filter(at_end).withColumn("seen", seen).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("seen"))))
    cut = written(cut, "mix-cut")  # EXACT rows a source, about
    last = cut.filter("extra > 0").groupBy("source").agg(F.max("rank").alias("c")).select(F.col("source").alias("c_source"), "c")
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "extra"]
    whole = ranked.filter(~at_end).withColumn("extra", F.when(F.col("place") < F.col("e_low"), F.col("size")).otherwise(F.lit(0)))
    out = whole.select(*columns).unionByName(cut.select(*columns)).join(last, same("source", "c_source"), "left")
    odds = F.coalesce(F.col("c") * F.col("size"), F.lit(0.0))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (odds / (1 + odds)).alias("inclusion"),
        (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents mixed by weights 5, 2, 1 to 150 % of all words."""
    return mix(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken", "inclusion")


#: Rows of a table or CTE named docs(doc_id, source, size), mixed the same way.
MIX_SQL = f"""
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  source_size * 2.0::DOUBLE AS cap FROM src),
levels AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM weighed),
leveled AS (SELECT *, (budget - capped) / open_w AS lev FROM levels),
water AS (SELECT arg_min(lev, cap / w) AS lev FROM leveled WHERE lev * w <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM water) * w, cap)) AS target FROM weighed),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
rest AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - copies * source_size) AS rest FROM plan),
odds AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.copies, r.rest,
  (('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source),
filled AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN (u / (1 - u)) / size ELSE 'inf'::DOUBLE END, doc_id NULLS LAST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM odds)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, rest - seen)) AS BIGINT) AS taken, o / (1 + o) AS inclusion
FROM (SELECT *, coalesce(max(CASE WHEN size > 0 AND rest > seen THEN (u / (1 - u)) / size END) OVER (PARTITION BY source) * size, 0) AS o FROM filled)
"""

OP7_SQL = f"""WITH docs AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
{MIX_SQL}"""
