"""Scalar functions and uploads, with expectations worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from carrel.functions import crypto, money, text, vector
from carrel.functions.binding import let
from carrel.functions.vector import HashingEmbedder
from carrel.operators import uploads
from carrel.session import scratch, spread


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def lit(x):
    return F.lit(x)


def test_pseudonyms_and_ids(spark):
    r = one(
        spark, a=text.pseudonym(lit("abc")), b=text.normal_id(lit("  P1\t﻿")), c=text.normal_id(lit(7.0)), d=text.normal_id(lit("007")), e=text.normal_id(lit("7.50")),
        f=text.pseudonym(text.normal_id(lit("   "))), g=text.pseudonym(lit("abc"), 12), h=text.pseudonym(lit("abc"), key="k"), i=text.normal_id(lit("-0")),
    )
    assert r["a"] == "WID_ba7816bf" and (r["b"], r["c"], r["d"], r["e"], r["i"]) == ("p1", "7", "7", "7.50", "0")
    assert r["f"] == "WID_" + hashlib.sha256(b"").hexdigest()[:8] and r["g"] == "WID_ba7816bf8f01" and r["h"] != r["a"]


@pytest.mark.parametrize(
    ("title", "summary", "tags"), [("Heart", "A study", "Cancer, Stroke"), ("T", "two\nlines", None), ("x", "ends with\n", ""), ("a", "has\nDisease Tags: inside", "Other")]
)
def test_composed_text_is_taken_apart(spark, title, summary, tags):
    doc = text.compose(lit(title), lit(summary), F.lit(tags).cast("string"))
    r = one(spark, doc=doc, title=text.title_of(doc), summary=text.summary_of(doc))
    assert r["doc"] == f"Dataset Title: {title}\n{summary}" + (f"\nDisease Tags: {tags}" if tags else "")
    assert r["title"] == title and r["summary"] == summary.split("\nDisease Tags:")[0].strip()


def test_text_without_marks(spark):
    assert one(spark, t=text.title_of(lit("plain")), s=text.summary_of(lit("plain"))) == {"t": "", "s": ""}


def test_formatting(spark):
    r = one(
        spark, kind=text.type_label(lit("application/pdf")), kb=text.size_kb(lit(1536)), day=text.local_date(lit("2024-03-05T10:11:12.000Z")), bad=text.local_date(lit("soon")),
        wallet=text.short_wallet(lit("0x1234567890abcd")), log=text.short_wallet(lit("0x1234567890abcd"), False), ext=text.extension(lit("a.b.CSV")), none=text.extension(lit("noext")),
        first=text.first_filled(lit(None).cast("string"), lit(""), lit("x")), empty=text.first_filled(lit("")), cell=text.preview_cell(lit(None)), head=text.header_label(lit(""), lit(2)),
        tags=text.joined_tags(F.array(lit("a"), lit("b (c, d)"))), back=text.split_tags(lit("a, b")), no=text.split_tags(lit(None).cast("string")),
    )
    assert (r["kind"], r["kb"], r["day"], r["bad"]) == ("PDF", "1.5", "2024-03-05", None)
    assert (r["wallet"], r["log"], r["ext"], r["none"]) == ("0x1234...abcd", "0x1234...", "csv", "noext")
    assert (r["first"], r["empty"], r["cell"], r["head"]) == ("x", "", "—", "Column 3") and (r["tags"], r["back"], r["no"]) == ("a, b (c, d)", ["a", "b"], [])


def test_output_formats(spark):
    names = ["a.xls", "a.csv", "a.ods", "a.TSV", "a.xlsm", "a.xlsb", "a.xlsx", "a.pdf", "a"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in d.select(*text.output_format(F.col("n"))).collect()]
    assert [g[0] for g in got] == ["xls", "csv", "ods", "txt", "xlsm", "xlsb", "xlsx", "xlsx", "xlsx"] and got[3][1] == "text/tab-separated-values"


def test_vectors(spark):
    a, b = vector.literal([1, 2, 2]), vector.literal([0, 0, 0])
    r = one(spark, l2=vector.squared_l2(a, b), same=vector.score(vector.squared_l2(a, a)), cos=vector.cosine(a, a), zero=vector.cosine(a, b), bad=vector.squared_l2(a, vector.literal([1])))
    assert r == {"l2": 9.0, "same": 1.0, "cos": pytest.approx(1.0), "zero": None, "bad": None}
    e = vector.HashingEmbedder(16)
    assert one(spark, v=e.column(lit("To be, or not TO be")))["v"] == e.vector("To be, or not TO be") and sum(e.vector("a b")) == 2
    with pytest.raises(ValueError, match="metric"):
        vector.distance(a, b, "dot")


def test_money(spark):
    for eth, wei in (("0.000000000000000001", "1"), ("1.5", "1500000000000000000"), ("99.999999999999999999", "99999999999999999999")):
        r = one(spark, w=money.wei(lit(eth)).cast("string"), back=(money.ether(money.wei(lit(eth))) == lit(eth).cast("decimal(20,18)")))
        assert r == {"w": wei, "back": True}
    assert str(one(spark, e=money.ether(lit("100000000000000000000000001").cast("decimal(38,0)")))["e"]) == "100000000.000000000000000001"


@pytest.mark.parametrize(
    ("n", "size", "count", "chunked"),
    [(5 << 20, 512 << 10, 10, False), ((5 << 20) + 1, 512 << 10, 11, True), ((10 << 20) - 1, 512 << 10, 20, True), (10 << 20, 1 << 20, 10, True), (100 << 20, 2 << 20, 50, True), (1 << 30, 4 << 20, 256, True)],
)
def test_chunk_plan(spark, n, size, count, chunked):
    c = lit(n)
    assert one(spark, a=crypto.chunk_size(c), b=crypto.chunk_count(c), c=crypto.is_chunked_size(c)) == {"a": size, "b": count, "c": chunked}


#: From: printf 'hello world' | openssl enc -aes-256-cbc -md md5 -S 0102030405060708 -pass pass:secret (with its Salted__ head).
def test_decrypts_the_salted_format(spark):
    sealed = crypto.encrypt(lit("hello world"), "secret", F.unhex(lit("0102030405060708")))
    r = one(spark, s=sealed, t=crypto.decrypt(sealed, "secret"), wrong=crypto.decrypt(sealed, "other"), junk=crypto.decrypt(lit("not base64!"), "x"), plain=crypto.decrypt(lit("aGVsbG8="), "x"))
    assert r["t"] == "hello world" and r["s"].startswith("U2FsdGVkX1") and r["junk"] is None and r["plain"] is None and r["wrong"] != "hello world"


def test_upload_gates(spark):
    d = spark.createDataFrame([("a.XLSX", "x/y"), ("a.pdf", "text/csv"), ("a.pdf", "x/y"), ("xlsx", None), ("a.png", "image/png"), ("a.gif", "image/gif")], "n string, m string")
    got = d.select(uploads.is_spreadsheet(F.col("n"), F.col("m")), uploads.is_image(F.col("m")), uploads.wants_preview(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (True, False, False), (False, False, False), (False, False, False), (False, True, False), (False, False, False)]
    assert one(spark, a=uploads.is_allowed_size(lit(10 << 30)), b=uploads.is_allowed_size(lit((10 << 30) + 1))) == {"a": True, "b": False}


GOOD = {"wallet": "0x1", "file": "f.csv", "title": "t", "summary": "s", "tags": ["Cancer"], "data_type": "Personal", "data_source": "Clinic", "price": "0.1"}


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, None), ({"wallet": ""}, "wallet"), ({"file": None}, "file"), ({"title": " \n"}, "title"), ({"summary": " "}, "summary"), ({"tags": []}, "tags"), ({"data_type": ""}, "data_type"),
     ({"data_source": None}, "data_source"), ({"price": "0"}, "price"), ({"price": "-1 ETH"}, "price"), ({"price": ""}, "price"), ({"price": "0.5 ETH"}, None), ({"price": "abc"}, None), ({"wallet": "", "price": "0"}, "wallet")],
)
def test_validation_names_the_first_error(spark, change, want):
    r = GOOD | change
    d = spark.createDataFrame([tuple(r.values())], "wallet string, file string, title string, summary string, tags array<string>, data_type string, data_source string, price string")
    assert d.select(uploads.error(*[F.col(k) for k in r]).alias("e")).first().e == want


def test_tags_and_names(spark):
    t = F.array(lit("a"), lit("b"))
    r = one(spark, a=uploads.tags_added(t, lit("b")), b=uploads.tags_added(t, lit("c")), c=uploads.tag_removed(t, lit(0)), d=uploads.output_name(lit("x.csv")), e=uploads.output_name(lit("x.csv"), True), f=uploads.preview_name(lit("x.csv")))
    assert r == {"a": ["a", "b"], "b": ["a", "b", "c"], "c": ["b"], "d": "phi_anonymized_x.csv", "e": "anonymized_x.csv", "f": "preview_x.csv"}


def test_bound_values_are_worked_out_once(spark):
    d = spark.range(3).select(let(F.col("id") + 1, lambda x: F.struct((x * x).alias("a"), F.transform(F.array(F.lit(1), F.lit(2)), lambda y: x + y).alias("b"))).alias("r"), let(F.lit(None), lambda x: x.isNull()).alias("n"))
    assert [(r.r.a, r.r.b, r.n) for r in d.collect()] == [(1, [2, 3], True), (4, [3, 4], True), (9, [4, 5], True)]
    assert spark.range(1).select(let(F.rand(), lambda x: (x - x) == 0).alias("same")).first().same  # two draws would differ


def test_small_scans_are_spread(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(at)
    one = spread(spark.read.parquet(at))
    assert "RepartitionByExpression" in one._jdf.queryExecution().toString() or "Repartition" in one._jdf.queryExecution().toString()
    assert one.agg(F.sum("id")).first()[0] == 499500
    spark.range(1000).repartition(64).write.mode("overwrite").parquet(at)
    assert "Repartition" not in spread(spark.read.parquet(at))._jdf.queryExecution().toString()


def test_scratch_paths_are_below_the_shared_folder(spark):
    a, b = scratch(spark, "x"), scratch(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


@pytest.mark.parametrize("dim", [1, 64, 256, 300])
def test_embedder_counts_words_by_bucket(spark, dim):
    e = HashingEmbedder(dim)
    texts = ["the cat, The CAT 12 é", "", None, "a " * 500]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(e.column(F.col("t")).alias("v")).collect()]
    assert got == [e.vector(t or "") for t in texts]
