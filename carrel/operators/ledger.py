"""A marketplace ledger as an append-only log of events; prices, owners, earnings and listings are derived from it.

Events: (seq, kind, doc, actor, amount): ``list`` (actor registers doc at price amount; the latest price and owner hold, whoever lists), ``buy`` (actor pays amount for doc) and
``withdraw`` (actor takes out what it earned). seq is a total order. A purchase is accepted if it pays the price of the moment; an unlisted document has price 0 and
no owner. The full payment goes to the owner of the moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN_PRICE = "Error"


EVENTS = "seq long, kind string, doc string, actor string, amount decimal(38,0)"


def append(events: DataFrame, path: str) -> None:
    """Adds events to a ledger at a path. Nothing that was written is changed; amounts below zero and unknown kinds raise before anything is written."""
    bad = events.filter((F.col("amount") < 0) | ~F.coalesce(F.col("kind").isin("list", "buy", "withdraw"), F.lit(False)) | F.col("seq").isNull())
    if not bad.isEmpty():
        raise ValueError("an event of no kind, without a place, or of a negative amount")
    events.write.mode("append").parquet(path)


def opened(spark: SparkSession, path: str, schema: str | StructType = EVENTS) -> DataFrame:
    """The events of a ledger; empty where nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def latest(events: DataFrame) -> DataFrame:
    """(doc, price, owner) as listed last. Partial aggregates, no sort."""
    e = events.filter(F.col("kind") == "list")
    return e.groupBy("doc").agg(F.max_by("amount", "seq").alias("price"), F.max_by("actor", "seq").alias("owner"))


def purchases(events: DataFrame, period: Column | None = None) -> DataFrame:
    """(seq, doc, buyer, amount, price, owner, accepted): each purchase with price and owner of its moment.

    period: a coarse time that never falls as seq rises, such as the month. With it, a document's events are ordered within a period only, each period starting from what the earlier
    ones left (one row for each document and period), so a document with a large part of all events is spread over its periods.
    """
    e = events.filter(F.col("kind").isin("list", "buy")).withColumn("_period", F.lit(0) if period is None else period)
    listed = F.when(F.col("kind") == "list", F.struct("amount", "actor"))
    now = Window.partitionBy("doc", "_period").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_now", F.last(listed, ignorenulls=True).over(now))
    if period is not None:
        left = e.groupBy("doc", "_period").agg(F.max_by(listed, F.when(listed.isNotNull(), F.col("seq"))).alias("_left"))
        before = Window.partitionBy("doc").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("_left", F.last("_left", ignorenulls=True).over(before))
        e = e.join(left, ["doc", "_period"]).withColumn("_now", F.coalesce("_now", "_left"))
    price = F.coalesce("_now.amount", F.lit(0).cast(events.schema["amount"].dataType))
    return e.filter(F.col("kind") == "buy").select("seq", "doc", F.col("actor").alias("buyer"), "amount", price.alias("price"), F.col("_now.actor").alias("owner"), (F.col("amount") >= price).alias("accepted"))


def earned(events: DataFrame, period: Column | None = None) -> DataFrame:
    """(owner, earned, sales) of accepted purchases; a null owner collects those of unlisted documents."""
    return purchases(events, period).filter("accepted").groupBy("owner").agg(F.sum("amount").alias("earned"), F.count("*").alias("sales"))


def balances(credits: DataFrame) -> DataFrame:
    """(owner, balance, withdrawn) from (seq, owner, kind credit or withdraw, amount): what came after the last withdrawal, and before it.

    A withdrawal that finds nothing is rejected; it takes nothing out, so it need not be told apart.
    """
    last = credits.groupBy("owner").agg(F.max(F.when(F.col("kind") == "withdraw", F.col("seq"))).alias("last"))
    c = credits.filter(F.col("kind") == "credit").join(last, "owner")
    after = F.col("last").isNull() | (F.col("seq") > F.col("last"))
    zero = F.lit(0).cast(credits.schema["amount"].dataType)
    return c.groupBy("owner").agg(F.sum(F.when(after, F.col("amount")).otherwise(zero)).alias("balance"), F.sum(F.when(after, zero).otherwise(F.col("amount"))).alias("withdrawn"))


def listed(events: DataFrame, period: Column | None = None) -> DataFrame:
    """(owner, place, doc): what each actor listed, a row for each listing, numbered in order from 1, repeats kept.

    With a period (a coarse time that never falls as seq rises) rows are numbered within a period and start from the count of the earlier ones, so an owner with a large part of
    all listings is spread over its periods.
    """
    e = events.filter(F.col("kind") == "list").select(F.col("actor").alias("owner"), "seq", "doc", (F.lit(0) if period is None else period).alias("_period"))
    place = F.row_number().over(Window.partitionBy("owner", "_period").orderBy("seq")).cast("long")
    if period is None:
        return e.select("owner", place.alias("place"), "doc")
    before = Window.partitionBy("owner").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    counts = e.groupBy("owner", "_period").agg(F.count("*").alias("_n")).select("owner", "_period", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    c = counts.select(F.col("owner").alias("_o"), F.col("_period").alias("_p"), "_before")
    e = e.withColumn("place", place).join(c, F.col("owner").eqNullSafe(F.col("_o")) & F.col("_period").eqNullSafe(F.col("_p")))
    return e.select("owner", (F.col("place") + F.col("_before")).alias("place"), "doc")


def listings(events: DataFrame) -> DataFrame:
    """(owner, docs array); for owners whose listings fit one row, see ``listed`` for others: what each actor listed, in order, repeats kept."""
    e = events.filter(F.col("kind") == "list").groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("seq", "doc"))).alias("x"))
    return e.select(F.col("actor").alias("owner"), F.transform("x", lambda r: r["doc"]).alias("docs"))


def with_prices(docs: DataFrame, prices: DataFrame, doc: str, meta_price: str | None = None) -> DataFrame:
    """docs with price_text: the metadata's price, else the ledger's, else a mark. The planner picks the join by size."""
    j = docs.join(prices.select(F.col("doc").alias(doc), F.col("price").alias("_p")), doc, "left")
    known = [F.nullif(F.col(meta_price), F.lit(""))] if meta_price else []
    return j.withColumn("price_text", F.coalesce(*known, F.col("_p").cast("string"), F.lit(UNKNOWN_PRICE))).drop("_p")
