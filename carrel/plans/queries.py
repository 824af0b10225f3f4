"""Registered queries: the engine's operators over the driver's tables, each with the SQL that states its result.

The tables hold no health data, so concepts are mapped: customers stand for patients, line items for listings (and purchases where they were returned), events for credits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrel.functions import crypto, money, text, vector
from carrel.operators import catalog, chunks, image, ledger, phi, search, uploads
from carrel.operators.predicates import blanks_dropped
from carrel.session import scratch, spread, table
from carrel.sources import blobs, workbook
from carrel.streaming.ledger import daily_credits, ingest, kept, running_earnings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WALLET = "0xAbC0000000000000000000000000000000001234"
QUERY_TEXT = "the and of with this"
PASS = "correct horse"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


L2_SQL = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


@query(f"""SELECT vec_id, label, d AS distance, 1 / (1 + d) AS score FROM (SELECT e.vec_id, e.label, {L2_SQL} AS d
  FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q) ORDER BY d, vec_id LIMIT 5""")
def vector_topk(spark, sf_dir):
    return search.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 5, "vec_id").select("vec_id", "label", "distance", "score")


@query(f"""SELECT vec_id, label, d AS distance, 1 / (1 + d) AS score FROM (SELECT e.vec_id, e.label, {L2_SQL} AS d
  FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3) ORDER BY d, vec_id LIMIT 5""")
def vector_topk_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, first_vector(spark, sf_dir), 5, "vec_id", filters={"label": 3}).select("vec_id", "label", "distance", "score")


@query("""SELECT vec_id, round(c, 9) AS cosine FROM (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE)))) AS c
  FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q) ORDER BY c DESC, vec_id LIMIT 5""")
def vector_topk_cosine(spark, sf_dir):
    found = search.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 5, "vec_id", metric="cosine")
    return found.select("vec_id", F.round(1 - F.col("distance"), 9).alias("cosine"))


@query(f"""SELECT query_id, vec_id, distance, rank, 1 / (1 + distance) AS score FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {L2_SQL} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2_SQL}, e.vec_id)::INT AS rank
  FROM embeddings e, (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5""")
def vector_topk_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.nearest_batch(e, e.filter("vec_id % 20 = 0"), 5, "vec_id", "vec_id")


_QUERY_WORDS = ", ".join(f"'{w}'" for w in QUERY_TEXT.split())


@query(f"""WITH q AS (SELECT list_transform([{_QUERY_WORDS}], lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS b),
d AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS b FROM documents),
s AS (SELECT doc_id, list_sum(list_transform(range(64), lambda i: (len(list_filter(d.b, lambda x: x = i)) - len(list_filter(q.b, lambda x: x = i)))::DOUBLE
  * (len(list_filter(d.b, lambda x: x = i)) - len(list_filter(q.b, lambda x: x = i)))::DOUBLE)) AS distance FROM d, q)
SELECT doc_id, distance, 1 / (1 + distance) AS score FROM s ORDER BY distance, doc_id LIMIT 5""")
def text_topk(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.search(d, QUERY_TEXT, embedder=vector.HashingEmbedder(), text="text", key="doc_id").select("doc_id", "distance", "score")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 10")
def filter_single(spark, sf_dir):
    return search.listing(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), {"lang": "en"}, order="doc_id")[0]


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src0' ORDER BY doc_id LIMIT 10")
def filter_and(spark, sf_dir):
    return search.listing(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), {"lang": "en", "source": "src0"}, order="doc_id")[0]


@query("SELECT count(*) AS total_found FROM documents WHERE lang = 'en' AND source = 'src0'")
def filter_total_found(spark, sf_dir):
    return search.listing(table(spark, sf_dir, "documents"), {"lang": "en", "source": "src0"}, order="doc_id")[1]


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def filter_empty(spark, sf_dir):
    return search.listing(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), {}, n=0, order="doc_id")[0]


def with_props(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("meta", F.parse_json("props"))


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.ageRange') = '30-40' OR CAST(json_extract(props, '$.k') AS BIGINT) < 5")
def filter_unknown_key(spark, sf_dir):
    """A key that no row has matches nothing; the other side of the choice still does."""
    return search.filtered(with_props(spark, sf_dir), {"$or": [{"ageRange": "30-40"}, {"k": {"$lt": 5}}]}, "meta").select("event_id", "event_type")


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
  WHERE (CAST(json_extract(props, '$.k') AS BIGINT) > 90 OR event_type IN ('error', 'signup')) AND CAST(json_extract(props, '$.k') AS BIGINT) <> 95""")
def filter_ops(spark, sf_dir):
    f = {"$or": [{"k": {"$gt": 90}}, {"event_type": {"$in": ["error", "signup"]}}], "k": {"$ne": 95}}
    return search.filtered(with_props(spark, sf_dir), f, "meta").select("event_id", "event_type", F.try_variant_get("meta", "$.k", "long").alias("k"))


@query("""SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE CASE WHEN event_id % 3 = 0 THEN k < 50 ELSE k >= 50 END""")
def filter_typed(spark, sf_dir):
    """A number is not its text: of a list of texts below 50 and numbers from 50 up, each matches its own type."""
    e = table(spark, sf_dir, "events").withColumn("as_text", F.regexp_replace("props", r"(\d+)", '"$1"'))
    e = e.withColumn("meta", F.parse_json(F.when(F.col("event_id") % 3 == 0, F.col("as_text")).otherwise(F.col("props"))))
    found = search.filtered(e, {"k": {"$in": [*[str(i) for i in range(50)], *range(50, 100)]}}, "meta")
    return found.select("event_id", F.try_variant_get("meta", "$.k", "string").cast("long").alias("k"))


def _wid(x: str) -> str:
    return f"'WID_' || substr(sha256({x}), 1, 8)"


@query(f"""SELECT CASE WHEN c_custkey <> 0 THEN {_wid("CAST(c_custkey AS VARCHAR)")} ELSE CAST(c_custkey AS VARCHAR) END AS c_custkey,
  CASE WHEN c_custkey <> 0 THEN {_wid("CAST(c_custkey AS VARCHAR)")} ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM customer""")
def phi_patient_id(spark, sf_dir):
    """Customer 0 stays unmasked, as an id of zero counts as none (compat mode)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return phi.masked(c, {"c_custkey": "Patient ID", "c_name": "Name"})


@query(f"""SELECT CASE WHEN c_custkey <> 0 THEN {_wid("CAST(c_custkey AS VARCHAR)")} ELSE {_wid("'' || chr(1) || '0'")} END AS c_custkey,
  CASE WHEN c_custkey <> 0 THEN {_wid("CAST(c_custkey AS VARCHAR)")} ELSE {_wid("'' || chr(1) || '0'")} END AS c_name, c_nationkey, c_mktsegment FROM customer""")
def phi_strict(spark, sf_dir):
    """Strict mode leaves no row unmasked."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return phi.masked(c, {"c_custkey": "Patient ID", "c_name": "Name"}, mode="strict", row_key=["c_custkey"])


@query(f"SELECT s_suppkey, {_wid(chr(39) + WALLET + chr(39))} AS s_name, s_nationkey FROM supplier")
def phi_wallet(spark, sf_dir):
    return phi.masked(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), {"s_name": "Full Name"}, wallet=WALLET)


@query(f"""SELECT s_suppkey, {_wid("'run-1' || chr(1) || CAST(s_suppkey AS VARCHAR)")} AS s_name, s_nationkey FROM supplier""")
def phi_row_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return phi.masked(s, {"s_name": "Full Name"}, row_key=["s_suppkey"], salt="run-1")


@query(f"""SELECT DISTINCT k AS norm_id, {_wid("k")} AS pseudonym FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey <> 0)""")
def phi_cross_sheet(spark, sf_dir):
    return phi.identifiers([(table(spark, sf_dir, "orders"), "o_custkey"), (table(spark, sf_dir, "customer"), "c_custkey")])


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey <> 0 AND c_custkey IS NOT NULL THEN {_wid("CAST(o_custkey AS VARCHAR)")} END AS pseudonym
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def phi_crosswalk(spark, sf_dir):
    walk = phi.identifiers([(table(spark, sf_dir, "customer"), "c_custkey")])
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.normal_id(F.col("o_custkey")).alias("norm_id"))
    return o.join(walk, "norm_id", "left").select("o_orderkey", "pseudonym")


@query("""WITH h AS (SELECT ['Patient ID', 'Visit', 'Phone Number'] AS headers),
r AS (SELECT c_custkey, [CAST(c_custkey AS VARCHAR), c_mktsegment, c_name] AS cells FROM customer)
SELECT c_custkey AS row_idx, CASE WHEN c_custkey = 0 THEN cells[1] ELSE """ + _wid("cells[1]") + """ END AS c0, cells[2] AS c1,
  CASE WHEN c_custkey = 0 THEN cells[3] ELSE """ + _wid("cells[1]") + """ END AS c2 FROM r""")
def phi_long_form(spark, sf_dir):
    """Sheets as rows of cells; the zero id stays unmasked here too."""
    c = table(spark, sf_dir, "customer").select(
        F.lit("book.xlsx").alias("file"), F.lit("Sheet1").alias("sheet"), (F.col("c_custkey") + 1).alias("row_idx"),
        F.array(F.lit("Patient ID"), F.lit("Visit"), F.lit("Phone Number")).alias("headers"), F.array(F.col("c_custkey").cast("string"), "c_mktsegment", "c_name").alias("cells"),
    )
    m = phi.masked_cells(c)
    return m.select((F.col("row_idx") - 1).alias("row_idx"), *[F.col("cells")[i].alias(f"c{i}") for i in range(3)])


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey
  LIMIT (SELECT CAST(greatest(5, least(50, ceil((count(*) + 1) * 0.05))) - 1 AS BIGINT) FROM orders)""")
def preview_head(spark, sf_dir):
    return phi.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


def composed(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    tags = F.when(F.col("doc_id") % 3 != 0, F.concat_ws(", ", F.col("lang"), F.col("source")))
    return d.select("doc_id", text.compose(F.concat_ws(" ", "source", F.col("doc_id").cast("string")), F.col("text"), tags).alias("document"))


_COMPOSED = """(SELECT doc_id, text, source, 'Dataset Title: ' || source || ' ' || doc_id || chr(10) || text
  || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || 'Disease Tags: ' || lang || ', ' || source ELSE '' END AS document FROM documents)"""


@query(f"SELECT doc_id, sha256(document) AS sha, CAST(length(document) AS BIGINT) AS n FROM {_COMPOSED}")
def doc_compose(spark, sf_dir):
    return composed(spark, sf_dir).select("doc_id", F.sha2(F.col("document").cast("binary"), 256).alias("sha"), F.length("document").cast("long").alias("n"))


@query(f"""SELECT doc_id, regexp_extract(document, '(?m)^Dataset Title:\\s*(.+?)$', 1) AS title,
  sha256(regexp_replace(regexp_extract(document, '(?s)^Dataset Title:\\s*.+?\\n(.+?)(?:\\nDisease Tags:|\\z)', 1), '^\\s+|\\s+$', '', 'g')) AS summary_sha FROM {_COMPOSED}""")
def doc_extract(spark, sf_dir):
    c = composed(spark, sf_dir)
    return c.select("doc_id", text.title_of(F.col("document")).alias("title"), F.sha2(text.summary_of(F.col("document")).cast("binary"), 256).alias("summary_sha"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Document ' || (doc_id + 1) ELSE source END AS title, 'X-' || upper(lang) AS kind, n_chars / 1024.0::DOUBLE AS kb FROM documents""")
def doc_shape(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("source"))
    return d.select(
        "doc_id", text.first_filled(F.lit(None).cast("string"), name, F.concat(F.lit("Document "), (F.col("doc_id") + 1).cast("string"))).alias("title"),
        text.type_label(F.concat(F.lit("text/x-"), F.col("lang"))).alias("kind"), (F.col("n_chars") / F.lit(1024.0)).alias("kb"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'wallet' WHEN doc_id % 7 = 0 THEN 'file' WHEN doc_id % 13 = 0 THEN 'title' WHEN n_chars < 300 THEN 'tags'
  WHEN source = 'src3' THEN 'data_source' WHEN doc_id % 5 = 0 THEN 'price' END AS error FROM documents""")
def validate_uploads(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    drop = lambda rule, c: F.when(rule, F.lit("")).otherwise(c)
    e = uploads.error(
        drop(k % 11 == 0, F.lit(WALLET)), drop(k % 7 == 0, F.lit("a.csv")), F.when(k % 13 == 0, F.lit(" \t\n")).otherwise(F.col("source")), F.lit("x"),
        F.when(F.col("n_chars") < 300, F.array().cast("array<string>")).otherwise(F.array("lang")), F.lit("Personal"), drop(F.col("source") == "src3", F.col("source")),
        F.when(k % 5 == 0, F.lit("0.0 ETH")).otherwise(F.lit("0.10")),
    )
    return d.select("doc_id", e.alias("error"))


@query("""SELECT doc_id, ext, doc_id % 8 <> 7 OR doc_id % 3 = 0 AS spreadsheet, doc_id % 8 < 2 AS preview,
  CASE doc_id % 8 WHEN 1 THEN 'xls' WHEN 2 THEN 'csv' WHEN 3 THEN 'ods' WHEN 4 THEN 'txt' WHEN 5 THEN 'xlsm' WHEN 6 THEN 'xlsb' ELSE 'xlsx' END AS format, 'phi_anonymized_' || name AS output
  FROM (SELECT doc_id, ['xlsx', 'XLS', 'csv', 'ods', 'tsv', 'xlsm', 'xlsb', 'pdf'][doc_id % 8 + 1] AS e, lower(e) AS ext, 'file.' || doc_id || '.' || e AS name FROM documents)""")
def upload_gates(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    ext = F.get(F.array(*[F.lit(x) for x in ("xlsx", "XLS", "csv", "ods", "tsv", "xlsm", "xlsb", "pdf")]), (k % 8).cast("int"))
    name = F.concat(F.lit("file."), k.cast("string"), F.lit("."), ext)
    mime = F.when(k % 3 == 0, F.lit("text/csv")).otherwise(F.lit("application/pdf"))
    return d.select(
        "doc_id", text.extension(name).alias("ext"), uploads.is_spreadsheet(name, mime).alias("spreadsheet"), uploads.wants_preview(name).alias("preview"),
        text.output_format(name)[0].alias("format"), uploads.output_name(name).alias("output"),
    )


@query("""SELECT doc_id, ['image/png', 'image/gif', 'text/png', 'image/jpeg'][doc_id % 4 + 1] AS mime, doc_id % 4 IN (0, 3) AS image,
  doc_id % 2 = 0 AND doc_id % 3 <> 0 AS preview FROM documents""")
def image_gate(spark, sf_dir):
    k = F.col("doc_id")
    mime = F.get(F.array(*[F.lit(x) for x in ("image/png", "image/gif", "text/png", "image/jpeg")]), (k % 4).cast("int"))
    has = catalog.preview_available(F.when(k % 2 == 0, F.lit("Qm")), F.when(k % 3 == 0, F.lit("application/vnd.ms-excel")).otherwise(F.lit(text.FORMATS["xlsx"][1])))
    return table(spark, sf_dir, "documents").select("doc_id", mime.alias("mime"), uploads.is_image(mime).alias("image"), has.alias("preview"))


def ledger_events(spark, sf_dir, buys: bool = False) -> DataFrame:
    """Line items as listings of parts by suppliers; returned ones as purchases by the order if buys."""
    kind = F.when(F.col("l_returnflag") == "R", "buy").otherwise("list") if buys else F.lit("list")
    actor = F.when(kind == "buy", F.col("l_orderkey")).otherwise(F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"), kind.alias("kind"), F.col("l_partkey").alias("doc"), actor.alias("actor"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )


_SEQ = "(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)"


@query("""SELECT l_partkey AS doc, count(*) FILTER (l_returnflag <> 'R') AS listings, count(*) FILTER (l_returnflag = 'R') AS purchases, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amounts
  FROM lineitem GROUP BY 1""")
def ledger_append(spark, sf_dir):
    """Listings, then purchases, appended to a ledger that is opened before it is there, and read again."""
    path, e = scratch(spark, "ledger"), ledger_events(spark, sf_dir, True)
    assert ledger.opened(spark, path, e.schema).isEmpty()
    for kind in ("list", "buy"):
        ledger.append(e.filter(F.col("kind") == kind), path)
    count = lambda k: F.count_if(F.col("kind") == k)
    return ledger.opened(spark, path, e.schema).groupBy("doc").agg(count("list").alias("listings"), count("buy").alias("purchases"), F.sum("amount").cast("double").alias("amounts"))


@query(f"""SELECT l_partkey AS doc, CAST(arg_max(CAST(l_extendedprice AS DECIMAL(18,2)), {_SEQ}) AS DOUBLE) AS price, arg_max(l_suppkey, {_SEQ}) AS owner FROM lineitem GROUP BY 1""")
def ledger_latest_price(spark, sf_dir):
    return ledger.latest(ledger_events(spark, sf_dir)).select("doc", F.col("price").cast("double").alias("price"), "owner")


_ASOF = """(SELECT *, coalesce(last_value(CASE WHEN kind = 'list' THEN amount END IGNORE NULLS) OVER w, 0) AS price, last_value(CASE WHEN kind = 'list' THEN actor END IGNORE NULLS) OVER w AS owner
  FROM (SELECT l_partkey AS doc, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'buy' ELSE 'list' END AS kind,
    CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE l_suppkey END AS actor, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate, l_suppkey, l_extendedprice FROM lineitem)
  WINDOW w AS (PARTITION BY doc ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"SELECT owner, CAST(sum(amount) AS DOUBLE) AS earned, count(*) AS sales FROM {_ASOF} WHERE kind = 'buy' AND amount >= price GROUP BY owner")
def ledger_earnings(spark, sf_dir):
    return ledger.earned(ledger_events(spark, sf_dir, True), F.trunc("seq.l_shipdate", "quarter")).select("owner", F.col("earned").cast("double").alias("earned"), "sales")


@query(f"""SELECT doc, count(*) AS purchases, count(*) FILTER (amount >= price) AS accepted, count(*) FILTER (owner IS NULL) AS unlisted FROM {_ASOF} WHERE kind = 'buy' GROUP BY doc""")
def ledger_purchases(spark, sf_dir):
    p = ledger.purchases(ledger_events(spark, sf_dir, True), F.trunc("seq.l_shipdate", "quarter"))
    return p.groupBy("doc").agg(F.count("*").alias("purchases"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("owner").isNull()).alias("unlisted"))


@query("""WITH e AS (SELECT user_id AS owner, event_type, CAST(round(value * 100) AS BIGINT) AS amount, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup')),
l AS (SELECT owner, max((ts, event_id)) FILTER (event_type = 'signup') AS last FROM e GROUP BY owner)
SELECT e.owner, CAST(sum(CASE WHEN last IS NULL OR (ts, event_id) > last THEN amount ELSE 0 END) AS BIGINT) AS balance,
  CAST(sum(CASE WHEN last IS NULL OR (ts, event_id) > last THEN 0 ELSE amount END) AS BIGINT) AS withdrawn FROM e JOIN l USING (owner) WHERE event_type = 'purchase' GROUP BY e.owner""")
def ledger_withdraw(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    kind = F.when(F.col("event_type") == "purchase", "credit").otherwise("withdraw")
    c = e.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("owner"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return ledger.balances(c)


@query("""SELECT l_suppkey AS owner, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_partkey) AS place, l_partkey AS doc FROM lineitem""")
def ledger_my_docs(spark, sf_dir):
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    e = table(spark, sf_dir, "lineitem").select(seq.alias("seq"), F.lit("list").alias("kind"), F.col("l_partkey").alias("doc"), F.col("l_suppkey").alias("actor"))
    return ledger.listed(e, F.trunc("seq.l_shipdate", "quarter"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '0.5' ELSE coalesce(CAST(price AS VARCHAR), 'Error') END AS price_text FROM part LEFT JOIN
  (SELECT l_partkey, arg_max(CAST(l_extendedprice AS DECIMAL(18,2)), {_SEQ}) AS price FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def ledger_price_join(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"), F.lit("list").alias("kind"), F.col("l_partkey").alias("doc"),
                 F.col("l_suppkey").alias("actor"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.lit("0.5")).otherwise(F.lit("")).alias("meta"))
    return ledger.with_prices(p, ledger.latest(e), "p_partkey", "meta").select("p_partkey", "price_text")


@query("""SELECT p_partkey, CAST(CAST(round(p_retailprice * 100) AS HUGEINT) * 10000000000000::HUGEINT AS VARCHAR) AS wei, TRUE AS same FROM part""")
def wei_roundtrip(spark, sf_dir):
    eth = (F.round(F.col("p_retailprice") * 100).cast("long").cast("decimal(18,0)") * F.lit("0.00001").cast("decimal(6,5)")).cast("decimal(20,18)")
    p = table(spark, sf_dir, "part").select("p_partkey", eth.alias("eth"))
    return p.select("p_partkey", money.wei(F.col("eth")).cast("string").alias("wei"), (money.ether(money.wei(F.col("eth"))) == F.col("eth")).alias("same"))


@query("""SELECT doc_id, n, CASE WHEN n < 10485760 THEN 524288 WHEN n < 104857600 THEN 1048576 WHEN n < 1073741824 THEN 2097152 ELSE 4194304 END::BIGINT AS chunk,
  CAST(ceil(n / (CASE WHEN n < 10485760 THEN 524288 WHEN n < 104857600 THEN 1048576 WHEN n < 1073741824 THEN 2097152 ELSE 4194304 END)::DOUBLE) AS BIGINT) AS chunks, n > 5242880 AS chunked
  FROM (SELECT doc_id, n_chars * 50000 AS n FROM documents)""")
def chunk_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 50000).alias("n"))
    n = F.col("n")
    return d.select("doc_id", "n", crypto.chunk_size(n).alias("chunk"), crypto.chunk_count(n).alias("chunks"), crypto.is_chunked_size(n).alias("chunked"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 512.0)) AS BIGINT) AS n_chunks, sha256(text) AS sha, TRUE AS complete FROM documents")
def chunk_roundtrip(spark, sf_dir):
    c = chunks.cut(table(spark, sf_dir, "documents"), "doc_id", "text", F.lit(512))
    n = c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    j = chunks.joined(c, "doc_id").join(n, "doc_id")
    return j.select("doc_id", "n_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "complete")


@query("SELECT doc_id, sha256(text) AS sha, TRUE AS hidden FROM documents")
def aes_roundtrip(spark, sf_dir):
    """Documents in the chunked encrypted format and back. hidden: the blob does not hold the text; a text of few letters may stand in it by chance."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select("doc_id", "text", chunks.sealed(F.col("text"), F.col("doc_id"), PASS, 4096).alias("blob"))
    hidden = ~F.contains("blob", F.col("text")) | (F.length("text") < 16)
    return d.select("doc_id", F.sha2(chunks.opened(F.col("blob"), PASS).cast("binary"), 256).alias("sha"), hidden.alias("hidden"))


@query(f"SELECT c_custkey, '{WALLET[:6]}...' || right('{WALLET}' || c_custkey, 4) AS wallet FROM customer")
def wallet_short(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.short_wallet(F.concat(F.lit(WALLET), F.col("c_custkey").cast("string"))).alias("wallet"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, sha256(array_to_string(w[1:1] || w[3:], ', ')) AS removed, CAST(len(list_distinct(w)) + CASE WHEN list_contains(w, 'the') THEN 0 ELSE 1 END AS INT) AS n_added FROM t""")
def tags_ops(spark, sf_dir):
    """The words of a text play its tags."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    removed = F.sha2(text.joined_tags(uploads.tag_removed(F.col("w"), F.lit(1))).cast("binary"), 256)
    return d.select("doc_id", removed.alias("removed"), F.size(uploads.tags_added(F.col("w"), F.lit("the"))).alias("n_added"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
e AS (SELECT doc_id, w, list_distinct(list_filter(w, lambda x: length(x) >= 10)) AS names FROM t)
SELECT doc_id, CAST(len(list_filter(w, lambda x: list_contains(names, x))) AS INT) AS covered, sha256(array_to_string(w, ' ')) AS ocr_sha FROM e""")
def ocr_word_mask(spark, sf_dir):
    """Words of ten letters and more play the entities."""
    w = F.split("text", " ")
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.transform(w, lambda x, i: F.struct(x.alias("text"), i.alias("left"), F.lit(0).alias("top"), F.length(x).alias("width"), F.lit(1).alias("height"))).alias("words"),
        F.transform(w, lambda x: F.struct(x.alias("text"), F.when(F.length(x) >= 10, "PERSON").otherwise("CARDINAL").alias("label"))).alias("entities"),
    )
    return d.select("doc_id", F.size(image.boxes(F.col("words"), F.col("entities"))).alias("covered"), F.sha2(image.ocr_text(F.col("words")).cast("binary"), 256).alias("ocr_sha"))


@query("""SELECT doc_id, 'b' || sha256(text) AS cid, TRUE AS fetched FROM documents""")
def blob_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", blobs.encoded(F.col("text").cast("binary")).alias("b64"), "text")
    back = blobs.decoded(F.col("b64"))
    return d.select("doc_id", blobs.cid(back).alias("cid"), (back.cast("string") == F.col("text")).alias("fetched"))


def streamed(spark, sf_dir, name) -> DataFrame:
    """One of the tables as a stream of all its files: a single file, or a folder, however nested."""
    batch = table(spark, sf_dir, name)
    one_file = batch.inputFiles()[0].endswith(f"/{name}.parquet")
    s = spark.readStream.schema(batch.schema)
    return s.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else s.option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The result of a stream that is run to its end, in a memory table; for small results."""
    name = f"stream_{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS credits, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def stream_credit_daily(spark, sf_dir):
    """A stream over the events, run to its end into a memory table (a row for each day)."""
    s = streamed(spark, sf_dir, "events")
    out = daily_credits(s.withColumn("value", F.round(F.col("value") * 100).cast("long")))
    return drained(out, "complete").select(F.to_date("day").alias("day"), "credits", F.col("total").alias("cents"))


@query("""SELECT user_id AS owner, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS earned FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def stream_running_earnings(spark, sf_dir):
    """The state of a stream after its last event: a row for each owner, written to a table as it changes."""
    s = streamed(spark, sf_dir, "events").filter("event_type = 'purchase'")
    running = running_earnings(s.select(F.col("user_id").alias("owner"), F.round(F.col("value") * 100).cast("long").alias("amount")))
    folder = scratch(spark, "earnings")
    kept(running, f"{folder}/state", f"{folder}/check").awaitTermination()
    return spark.read.schema(running.schema).parquet(f"{folder}/state")


@query("SELECT doc_id, sha256(text) AS sha, n_chars FROM documents")
def stream_ingest(spark, sf_dir):
    """A stream of documents appended to a catalogue."""
    folder = scratch(spark, "ingest")
    s = streamed(spark, sf_dir, "documents")
    ingest(s.select("doc_id", "text", "n_chars"), f"{folder}/rows", f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "n_chars")


def requests(spark, sf_dir) -> DataFrame:
    """Documents as store requests; every third one states a cid of its own in its metadata."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    own = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("cid"), F.concat(F.lit("own-"), k)))
    base = F.create_map(F.lit("cid"), F.concat(F.lit("c"), k), F.lit("dataset_title"), F.col("source"), F.lit("dataType"), F.col("lang"), F.lit("price"), F.col("n_chars").cast("string"))
    return d.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("c"), k).alias("cid"), F.col("source").alias("dataset_title"), F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("tags"), F.to_json(catalog.merged_maps(base, own)).alias("meta"), (F.col("doc_id") * 1000).alias("added_ms"),
    )


_STORED = """(SELECT sha256(concat_ws(chr(1), 'c' || doc_id, source, CAST(doc_id AS VARCHAR))) AS id, doc_id AS seq, source AS title, lang, n_chars,
  CASE WHEN doc_id % 3 = 0 THEN 'own-' || doc_id ELSE 'c' || doc_id END AS cid, doc_id * 1000 AS added_ms,
  'Dataset Title: ' || source || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Disease Tags: ' || lang ELSE '' END AS document FROM documents)"""


@query(f"SELECT id, seq, title, sha256(document) AS sha, lang AS data_type, CAST(n_chars AS VARCHAR) AS price, cid AS meta_cid, added_ms FROM {_STORED}")
def catalog_append(spark, sf_dir):
    """Store requests appended in two batches to a catalogue that is opened before it is there, and read again; ids from what is stored, metadata overriding the request."""
    path = scratch(spark, "catalog")
    rows = catalog.stored(requests(spark, sf_dir))
    assert catalog.open_catalog(spark, path).isEmpty()
    for part in (0, 1):
        catalog.append(rows.filter(F.col("seq") % 2 == part), path)
    c = catalog.typed_view(catalog.open_catalog(spark, path))
    return c.select(
        F.col("doc_id").alias("id"), "seq", F.col("dataset_title").alias("title"), F.sha2(F.col("document").cast("binary"), 256).alias("sha"), "data_type", "price",
        F.try_variant_get("metadata", "$.cid", "string").alias("meta_cid"), "added_ms",
    )


@query(f"SELECT id, cid, sha256(regexp_replace(regexp_extract(document, '(?s)^Dataset Title:\\s*.+?\\n(.+?)(?:\\nDisease Tags:|\\z)', 1), '^\\s+|\\s+$', '', 'g')) AS summary, title AS meta_title FROM {_STORED}")
def hit_shape(spark, sf_dir):
    """The columns of a hit: cid, summary and metadata out of what is stored."""
    rows = catalog.stored(requests(spark, sf_dir))
    hits = search.shaped(rows, "doc_id", F.try_variant_get("metadata", "$.cid", "string"), text.summary_of(F.col("document")), F.col("metadata"), False)
    return hits.select("id", "cid", F.sha2(F.col("summary").cast("binary"), 256).alias("summary"), F.try_variant_get("metadata", "$.dataset_title", "string").alias("meta_title"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_blanks(spark, sf_dir):
    """A form's filters without the fields that were left empty."""
    form = {"lang": "en", "source": "", "gender": None, "tags": []}
    return search.filtered(table(spark, sf_dir, "documents"), blanks_dropped(form)).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE event_type END AS cid, CAST(user_id AS VARCHAR) AS title, event_id % 2 = 0 AS extra FROM events")
def metadata_merge(spark, sf_dir):
    base = F.create_map(F.lit("cid"), F.col("event_type"), F.lit("title"), F.col("user_id").cast("string"))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("cid"), F.lit("own"), F.lit("extra"), F.lit("x")))
    m = table(spark, sf_dir, "events").withColumn("m", catalog.merged_maps(base, own))
    return m.select("event_id", F.try_element_at("m", F.lit("cid")).alias("cid"), F.try_element_at("m", F.lit("title")).alias("title"), F.map_contains_key("m", "extra").alias("extra"))


@query("SELECT doc_id, n_chars * 4000000 AS bytes, n_chars * 4000000 <= 10737418240 AS allowed FROM documents")
def size_gate(spark, sf_dir):
    n = F.col("n_chars") * 4000000
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("bytes"), uploads.is_allowed_size(n).alias("allowed"))


@query("""SELECT doc_id, printf('%.1f', floor(n_chars * 10 / 1024.0::DOUBLE + 0.5) / 10) AS kb, 'preview_file.' || doc_id AS preview,
  CASE WHEN doc_id % 3 = 0 THEN '—' ELSE source END AS cell, CASE WHEN doc_id % 2 = 0 THEN 'Column ' || (doc_id + 1) ELSE lang END AS header, (doc_id + 1) / n_chars::DOUBLE * 100 AS progress FROM documents""")
def shown_values(spark, sf_dir):
    """Sizes, names, cells, headers and progress as they are shown."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.size_kb(F.col("n_chars")).alias("kb"), uploads.preview_name(F.concat(F.lit("file."), k.cast("string"))).alias("preview"),
        text.preview_cell(F.when(k % 3 != 0, F.col("source"))).alias("cell"), text.header_label(F.when(k % 2 != 0, F.col("lang")).otherwise(F.lit("")), k).alias("header"),
        crypto.progress(k, F.col("n_chars")).alias("progress"),
    )


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, epoch_us(ts) // 1000 AS ms FROM events")
def shown_dates(spark, sf_dir):
    """Dates out of texts, null where a text is none; times as milliseconds."""
    said = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("no date"))
    return table(spark, sf_dir, "events").select("event_id", text.local_date(said).alias("day"), F.unix_millis(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")).alias("ms"))


@query("""SELECT doc_id, 'b' || sha256(text) AS cid, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""")
def blob_pin_fetch(spark, sf_dir):
    """Documents pinned in a store and fetched by their ids."""
    path = scratch(spark, "blobs")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    got = blobs.fetch(spark, path, blobs.pin(d, path))
    return got.select(F.col("name").cast("long").alias("doc_id"), "cid", F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 700.0)) AS BIGINT) AS n_chunks, CAST(octet_length(encode(text)) AS BIGINT) AS total_bytes FROM documents")
def chunk_bytes(spark, sf_dir):
    return chunks.total_bytes(chunks.cut(table(spark, sf_dir, "documents"), "doc_id", "text", F.lit(700)), "doc_id")


@query("""WITH b AS (SELECT r_regionkey AS k, r_name || '.' || ['xlsx', 'ods', 'xls', 'xlsb', 'xlsm'][r_regionkey + 1] AS file FROM region)
SELECT file, 'nations' AS sheet, count(n_nationkey) AS total_rows, 2 AS total_columns, count(n_nationkey) AS masked FROM b LEFT JOIN nation ON n_regionkey = k GROUP BY file
UNION ALL SELECT file, 'notes', 0, 0, 0 FROM b UNION ALL SELECT file, 'heads', 0, 3, 0 FROM b""")
def workbook_roundtrip(spark, sf_dir):
    """A workbook for each region, each in another format, with an empty sheet and one of headers only: written, read, masked, written and read again."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    kinds = F.array(*[F.lit(x) for x in ("xlsx", "ods", "xls", "xlsb", "xlsm")])
    book = r.select(F.col("r_regionkey").alias("k"), F.concat("r_name", F.lit("."), F.get(kinds, F.col("r_regionkey"))).alias("file"))
    head = lambda sheet, i, cells: book.select("file", F.lit(sheet).alias("sheet"), F.lit(i).alias("sheet_idx"), F.lit(0 if cells else None).cast("long").alias("row_idx"), F.array(*map(F.lit, cells)).cast("array<string>").alias("cells"))
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long")
    body = n.withColumn("row_idx", row).join(book, F.col("n_regionkey") == F.col("k")).select(
        "file", F.lit("nations").alias("sheet"), F.lit(0).alias("sheet_idx"), "row_idx", F.array("n_name", F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).alias("cells"))
    rows = reduce(DataFrame.unionByName, [head("nations", 0, ["Nation", "Patient ID"]), body, head("notes", 1, []), head("heads", 2, ["a", "b", "c"])])
    for step in ("in", "out"):
        folder = scratch(spark, f"books-{step}")
        blobs.write_files(workbook.workbook_files(rows), folder)
        rows = workbook.read_workbooks(spark, folder)
        if step == "in":
            rows = phi.masked_cells(workbook.with_headers(rows)).drop("headers")
    rows = rows.withColumn("file", F.element_at(F.split("file", "/"), -1))
    masked = rows.groupBy("file", "sheet").agg(F.count_if(F.exists("cells", lambda c: c.rlike("^WID_[0-9a-f]{8}$"))).alias("masked"))
    return workbook.sheet_shapes(rows).join(masked, ["file", "sheet"]).select("file", "sheet", "total_rows", "total_columns", "masked")


@query("SELECT 'healthy' AS status, TRUE AS embedder, FALSE AS redactor")
def service_status(spark, sf_dir):
    return catalog.status(spark, embedder=True, redactor=False)
