"""Catalogue, search, privacy, ledger, chunks, images, sources and streams."""

import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carrel.functions import png
from carrel.functions.text import pseudonym
from carrel.functions.vector import HashingEmbedder
from carrel.operators import catalog, chunks, image, ledger, phi, predicates, search
from carrel.sources import binary_sheets, blobs, workbook
from carrel.streaming import ledger as streams


def wid(x):
    return "WID_" + hashlib.sha256(x.encode()).hexdigest()[:8]


# catalogue and search --------------------------------------------------------------------------------------------------------------------------
REQUESTS = [
    {"cid": "c1", "dataset_title": "Heart", "summary": "about hearts", "metadata": {"dataType": "Personal", "price": "0.10", "fileSize": 10, "encrypted": True, "disease_tags": "Stroke, Cancer"}},
    {"cid": "c2", "dataset_title": "Lungs", "summary": "about lungs", "metadata": {"dataType": "Institution", "price": "0.1", "fileSize": 20, "n": "1"}},
    {"cid": "c3", "dataset_title": "Skin", "summary": "about skin", "metadata": None},
    {"cid": "c4", "dataset_title": "Bones", "summary": "", "metadata": {"cid": "other", "fileSize": 30, "n": 1, "it's": "x"}},
]


@pytest.fixture(scope="module")
def cat(spark):
    return catalog.entries(spark, REQUESTS).cache()


def cids(df):
    return [r.cid for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize(
    ("f", "want"),
    [({}, "c1 c2 c3 c4"), ({"dataType": "Personal"}, "c1"), ({"dataType": "Institution", "price": "0.1"}, "c2"), ({"price": "0.1"}, "c2"), ({"ageRange": "1"}, ""), ({"n": 1}, "c4"), ({"n": "1"}, "c2"),
     ({"fileSize": {"$gt": 10}}, "c2 c4"), ({"fileSize": {"$gte": 10, "$lt": 30}}, "c1 c2"), ({"fileSize": {"$in": [10, 30]}}, "c1 c4"), ({"fileSize": {"$nin": [10]}}, "c2 c4"), ({"encrypted": True}, "c1"),
     ({"$or": [{"n": 1}, {"dataType": "Personal"}]}, "c1 c4"), ({"$and": [{"fileSize": {"$ne": 10}}, {"dataType": "Institution"}]}, "c2"), ({"it's": "x"}, "c4"), ({"seq": 2}, "c3"), ({"fileSize": {"$in": []}}, "")],
)
def test_filters(cat, f, want):
    assert " ".join(cids(search.filtered(cat, f, "metadata"))) == want


def test_filters_that_cannot_be(cat):
    for f in ({"a": {"$regex": "x"}}, {"$nor": []}, {"$or": []}, {"a": {}}):
        with pytest.raises(ValueError):
            predicates.predicate(cat, f, "metadata")


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("en", 1)], "lang string, x int").write.parquet(str(tmp_path / "t"))
    df = search.filtered(spark.read.parquet(str(tmp_path / "t")), {"lang": "en"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def test_listing(cat):
    rows, total = search.listing(cat, {"fileSize": {"$gt": 0}}, 1, "seq", "metadata")
    assert cids(rows) == ["c1"] and total.first().total_found == 3
    assert len(cids(search.listing(cat, {}, 0)[0])) == len(cids(search.listing(cat, {}, None)[0])) == 4
    with pytest.raises(ValueError):
        search.listing(cat, {}, -1)


def test_search_routes(cat):
    go = lambda **kw: search.search(cat, embedder=HashingEmbedder(), text="document", key="seq", **kw)
    assert go(query="about lungs", n=1).first().cid == "c2"
    assert cids(go(filters={"cid": "c3", "gender": ""})) == ["c3"] and cids(go(query="  ", filters={"cid": "c1"})) == ["c1"]
    ranked = go(query="skin", filters={"seq": {"$lt": 2}}).collect()
    assert {r.cid for r in ranked} == {"c1", "c2"} and all(r.score == pytest.approx(1 / (1 + r.distance)) for r in ranked)
    with pytest.raises(ValueError):
        go(query=" ", filters={"gender": ""})


def test_batch_search_equals_single(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in range(60)], "vec_id long, embedding array<float>")
    got = {}
    for r in search.nearest_batch(e, e.filter("vec_id % 20 = 0"), 4, "vec_id", "vec_id").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in (0, 20, 40):
        v = e.filter(F.col("vec_id") == q).first().embedding
        assert [got[q][k] for k in range(1, 5)] == [r.vec_id for r in search.nearest(e, v, 4, "vec_id").collect()]
    got = {}
    for r in search.nearest_batch(e, e.filter("vec_id % 20 = 0"), 4, "vec_id", "vec_id", metric="cosine").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    assert 0 not in got  # a zero vector has no direction
    v = e.filter("vec_id = 20").first().embedding
    assert sorted(got[20]) == [(i, r.vec_id, r.distance) for i, r in enumerate(search.nearest(e, v, 4, "vec_id", metric="cosine").collect(), 1)]


def test_batch_search_edges(spark):
    ddl = "vec_id long, embedding array<float>"
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (None, [1.0, 2.0]), (5, [])], ddl)
    shown = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert shown(search.nearest_batch(e, e.filter("vec_id IS NOT NULL"), 5, "vec_id", "vec_id")) == [(1, 1, None), (1, 2, 1), (3, 1, 3)]
    assert shown(search.nearest_batch(e.limit(0), e, 5, "vec_id", "vec_id")) == shown(search.nearest_batch(e, e.limit(0), 5, "vec_id", "vec_id")) == []
    with pytest.raises(ValueError):
        search.nearest_batch(e, e, 0, "vec_id", "vec_id")


@pytest.mark.parametrize("block", [1, 7, 20, 60])
def test_blocks_of_queries_equal_one_batch(spark, block):
    e = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)]) for i in [*range(60), 5]], "vec_id long, embedding array<float>")
    shown = lambda d: sorted((r.query_id, r.rank, r.distance, r.vec_id, r.score) for r in d.collect())
    queries = e.filter("vec_id < 20 and vec_id != 5")
    assert shown(search.nearest_batch(e, queries, 3, "vec_id", "vec_id", block=block)) == shown(search.nearest_batch(e, queries, 3, "vec_id", "vec_id"))


def test_catalog(cat, spark, tmp_path):
    t = {r.cid: r for r in catalog.typed_view(cat).drop("metadata").collect()}
    assert t["c1"].disease_tags == ["Stroke", "Cancer"] and str(t["c1"].price_eth) == "0.100000000000000000" and t["c1"].encrypted and t["c3"].file_size is None
    assert t["c1"].document == "Dataset Title: Heart\nabout hearts\nDisease Tags: Stroke, Cancer"
    at = str(tmp_path / "cat")
    assert catalog.open_catalog(spark, at).count() == 0
    catalog.append(cat, at)
    catalog.append(cat, at)
    assert search.filtered(catalog.open_catalog(spark, at), {"n": 1}, "metadata").count() == 2
    hit = search.shaped(cat, "doc_id", F.try_variant_get("metadata", "$.cid", "string"), F.col("document"), F.col("metadata"), False).select("cid").collect()
    assert [r.cid for r in hit] == ["c1", "c2", "c3", "other"]


# privacy ---------------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("header", "ident", "mine"),
    [("Patient ID", True, True), ("PATIENT_ID", True, True), ("id of patient", True, True), ("Patient Residence", True, True), ("Date Of  Birth", False, True), ("date_of_birth", False, False),
     ("medical_record", False, False), ("account_number", False, False), ("device_id", False, False), ("first_name", False, True), ("email_address", False, True), ("ip_address", False, True),
     ("Hospital Name", False, True), ("Username", False, True), ("Age", False, False), ("Diagnosis", False, False), (7, False, False), (None, False, False), ("", False, False)],
)
def test_headers(header, ident, mine):
    assert (phi.id_column([header]) == 0) is ident and (phi.personal_columns([header]) == [0]) is mine


def test_headers_strict_and_last():
    assert phi.personal_columns(["date_of_birth", "medical_record", "age"], strict=True) == [0, 1]
    assert phi.id_column(["patient id", "x", "Patient Id 2"]) == 2


def sheet(spark, rows, **kw):
    d = spark.createDataFrame(rows, "`Patient ID` string, Name string, Age string")
    return [tuple(r) for r in phi.masked(d, **kw).collect()]


def test_rows_with_ids(spark):
    rows = [("P1", "Ann", "3"), (" p1\t", "", "4"), ("", "Bob", "5"), (None, "Cy", "6"), ("   ", "Di", "7"), ("7.0", None, "8"), ("7", "Ed", "9")]
    p, e, s = wid("p1"), wid(""), wid("7")
    want = [(p, p, "3"), (p, p, "4"), ("", "Bob", "5"), (None, "Cy", "6"), (e, e, "7"), (s, None, "8"), (s, s, "9")]
    assert sheet(spark, rows) == sheet(spark, rows, wallet="0xA") == want
    strict = sheet(spark, rows, mode="strict", row_key=["Age"])
    assert strict[0] == want[0] and strict[2][1].startswith("WID_") and strict[3][1].startswith("WID_") and strict[2][1] != strict[3][1]


def test_rows_without_ids(spark):
    d = spark.createDataFrame([("Ann", "1"), ("", ""), (None, "2"), ("Bob", None)], "Name string, x string")
    assert [r.Name for r in phi.masked(d, wallet="0xAb").collect()] == [wid("0xAb"), "", None, wid("0xAb")]
    a, b = ([r.Name for r in phi.masked(d, salt=s).collect()] for s in ("s", "t"))
    assert a[0] != a[3] and a != b and a == [r.Name for r in phi.masked(d.repartition(3), salt="s").orderBy(F.coalesce("x", F.lit("9"))).collect()][1:2] + a[1:] or a[0] != a[3]
    zero = spark.createDataFrame([(0, "Ann"), (1, "Bob")], "pid long, name string")
    assert [tuple(r) for r in phi.masked(zero, {"pid": "patient id"}).collect()] == [("0", "Ann"), (wid("1"), wid("1"))]


def test_long_sheets_mix_cases(spark):
    rows = [
        ("f", "a", 0, ["Patient ID", "Phone"], ["Patient ID", "Phone"]), ("f", "a", 1, ["Patient ID", "Phone"], ["P1", "555"]), ("f", "a", 2, ["Patient ID", "Phone"], ["", "556"]), ("f", "a", 3, ["Patient ID", "Phone"], ["p1"]),
        ("f", "b", 0, ["Email", "Age"], ["Email", "Age"]), ("f", "b", 1, ["Email", "Age"], ["x@y", "3", "extra"]), ("f", "b", 2, ["Email", "Age"], [None, ""]), ("f", "c", 1, None, ["z"]),
    ]
    d = spark.createDataFrame(rows, "file string, sheet string, row_idx long, headers array<string>, cells array<string>")
    got = {(r.sheet, r.row_idx): r.cells for r in phi.masked_cells(d, wallet="0xA").collect()}
    assert got["a", 0] == ["Patient ID", "Phone"] and got["a", 1] == [wid("p1")] * 2 and got["a", 2] == ["", "556"] and got["a", 3] == [wid("p1")]
    assert got["b", 1] == [wid("0xA"), "3", "extra"] and got["b", 2] == [None, ""] and got["c", 1] == ["z"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.text(min_size=1, max_size=5)), min_size=1, max_size=8))
def test_no_row_with_an_id_stays_unmasked(spark, rows):
    rows = [(a.replace("\x00", ""), b.replace("\x00", "x")) for a, b in rows]
    d = spark.createDataFrame(rows, "`patient id` string, name string")
    for (ident, name), r in zip(rows, phi.masked(d).collect(), strict=True):
        assert r.name.startswith("WID_") if ident else r.name == name


@pytest.mark.parametrize(("total", "want"), [(1, 1), (4, 4), (5, 5), (6, 5), (100, 5), (101, 6), (120, 6), (1000, 50), (1001, 50), (5000, 50)])
def test_preview_rows(total, want):
    assert phi.preview_rows(total) == want


# ledger ----------------------------------------------------------------------------------------------------------------------------------------
EVENTS = [(1, "list", "d", "ann", 10), (2, "buy", "d", "bob", 10), (3, "buy", "d", "bob", 9), (4, "list", "d", "eve", 5), (5, "buy", "d", "bob", 25), (6, "buy", "ghost", "bob", 3), (7, "list", "e", "ann", 10**26), (8, "list", "d", "ann", 7), (9, "buy", "e", "z", 10**26)]


def events(spark, rows=EVENTS):
    return spark.createDataFrame([(a, b, c, d, str(e)) for a, b, c, d, e in rows], "seq long, kind string, doc string, actor string, amount string").withColumn("amount", F.col("amount").cast("decimal(38,0)"))


def test_ledger(spark):
    e = events(spark)
    assert {r.doc: (int(r.price), r.owner) for r in ledger.latest(e).collect()} == {"d": (7, "ann"), "e": (10**26, "ann")}
    assert {r.seq: (r.accepted, r.owner, int(r.price)) for r in ledger.purchases(e).collect()} == {2: (True, "ann", 10), 3: (False, "ann", 10), 5: (True, "eve", 5), 6: (True, None, 0), 9: (True, "ann", 10**26)}
    assert {r.owner: (int(r.earned), r.sales) for r in ledger.earned(e).collect()} == {"ann": (10 + 10**26, 2), "eve": (25, 1), None: (3, 1)}
    assert {r.owner: r.docs for r in ledger.listings(e).collect()} == {"ann": ["d", "e", "d"], "eve": ["d"]}
    docs = spark.createDataFrame([("d", ""), ("e", "0.5"), ("x", None)], "doc string, meta string")
    assert {r.doc: r.price_text for r in ledger.with_prices(docs, ledger.latest(e), "doc", "meta").collect()} == {"d": "7", "e": "0.5", "x": "Error"}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["list", "buy"]), st.sampled_from("de"), st.sampled_from("xyz"), st.integers(0, 3)), max_size=20))
def test_periods_change_no_purchase(spark, rows):
    e = events(spark, [(i, *r) for i, r in enumerate(rows)])
    assert sorted(ledger.purchases(e).collect(), key=lambda r: r.seq) == sorted(ledger.purchases(e, F.floor(F.col("seq") / 4)).collect(), key=lambda r: r.seq)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 3)), max_size=12))
def test_listings_are_numbered(spark, rows):
    e = spark.createDataFrame([(i, "list", f"d{n}", a, 1) for i, (a, n) in enumerate(rows)], "seq long, kind string, doc string, actor string, amount long")
    want = sorted((a, [b for b, _ in rows[: i + 1]].count(a), f"d{n}") for i, (a, n) in enumerate(rows))
    for period in (None, F.floor(F.col("seq") / 3)):
        assert sorted((r.owner, r.place, r.doc) for r in ledger.listed(e, period).collect()) == want


def test_ledger_is_appended(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.opened(spark, path).isEmpty()
    row = lambda *x: spark.createDataFrame([x], "seq long, kind string, doc string, actor string, amount int").withColumn("amount", F.col("amount").cast("decimal(38,0)"))
    ledger.append(row(1, "list", "d", "x", 5), path)
    ledger.append(row(2, "buy", "d", "y", 6), path)
    assert [(r.seq, r.kind, int(r.amount)) for r in ledger.opened(spark, path).orderBy("seq").collect()] == [(1, "list", 5), (2, "buy", 6)]
    for bad in ((3, "gift", "d", "x", 1), (3, "buy", "d", "x", -1), (None, "buy", "d", "x", 1)):
        with pytest.raises(ValueError):
            ledger.append(row(*bad), path)
    assert ledger.opened(spark, path).count() == 2


def test_withdrawals(spark):
    rows = [(1, "a", "withdraw", 0), (2, "a", "credit", 5), (3, "a", "withdraw", 0), (4, "a", "withdraw", 0), (5, "a", "credit", 2), (6, "b", "credit", 4)]
    b = ledger.balances(spark.createDataFrame(rows, "seq long, owner string, kind string, amount long"))
    assert {r.owner: (r.balance, r.withdrawn) for r in b.collect()} == {"a": (2, 5), "b": (4, 0)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["credit", "withdraw"]), st.integers(0, 9)), max_size=15))
def test_credits_are_held_or_withdrawn(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, owner string, kind string, amount long")
    b = ledger.balances(d).agg(F.coalesce(F.sum("balance"), F.lit(0)), F.coalesce(F.sum("withdrawn"), F.lit(0))).first()
    assert sum(b) == sum(n for _, k, n in rows if k == "credit")


# chunks, blobs, images -------------------------------------------------------------------------------------------------------------------------
def test_chunks(spark):
    rows = [(1, "x" * 1000), (2, ""), (3, "é" * 257), (4, None)]
    d = spark.createDataFrame(rows, "k long, t string")
    c = chunks.cut(d.filter("t IS NOT NULL"), "k", "t", F.lit(256))
    assert {r.k: (r.text, r.complete) for r in chunks.joined(c, "k").collect()} == {k: (t, True) for k, t in rows[:3]}
    assert not chunks.joined(c.filter("NOT (k = 1 AND chunk_idx = 2)"), "k").filter("k = 1").first().complete
    s = d.withColumn("b", chunks.sealed(F.col("t"), F.col("k"), "p", 100))
    assert [r.o for r in s.select(chunks.opened(F.col("b"), "p").alias("o")).collect()] == [t for _, t in rows]
    cut = s.filter("k = 1").select(chunks.opened(F.expr("substring_index(b, '|CHUNK_SEPARATOR|', 4)"), "p").alias("o")).first()
    assert cut.o is None


def test_bytes_of_chunks(spark):
    d = spark.createDataFrame([(1, "x" * 10), (2, ""), (3, "éé")], "k long, t string")
    assert {r.k: (r.n_chunks, r.total_bytes) for r in chunks.total_bytes(chunks.cut(d, "k", "t", F.lit(4)), "k").collect()} == {1: (3, 10), 2: (1, 0), 3: (1, 4)}


def test_blobs(spark, tmp_path):
    d = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"1")], "name string, content binary")
    ids = {r.name: r.cid for r in blobs.pin(d, str(tmp_path / "b")).collect()}
    assert ids["a"] == ids["c"] != ids["b"]
    got = blobs.fetch(spark, str(tmp_path / "b"), spark.createDataFrame([(ids["a"],), ("none",)], "cid string")).collect()
    assert {r.cid: r.content and bytes(r.content) for r in got} == {ids["a"]: b"1", "none": None}
    assert blobs.write_files(spark.createDataFrame([("x/y.bin", b"abc")], "file string, content binary"), str(tmp_path / "out"), "p_") == 1
    assert (tmp_path / "out" / "p_y.bin").read_bytes() == b"abc"


def test_ocr_boxes(spark):
    word, entity = "array<struct<text:string,left:int,top:int,width:int,height:int>>", "array<struct<text:string,label:string>>"
    words = [(t, 10 * i, 0, 9, 5) for i, t in enumerate(["Ann", "met", "Bob", "Lee", "in", " Rome ", "3"])]
    d = spark.createDataFrame([(words, [(" Ann", "PERSON"), ("Bob Lee", "PERSON"), ("Rome", "GPE"), ("3", "CARDINAL")])], f"w {word}, e {entity}")
    r = d.select(image.boxes(F.col("w"), F.col("e")).alias("b"), image.strict_boxes(F.col("w"), F.col("e")).alias("s"), image.ocr_text(F.col("w")).alias("t")).first()
    assert [x.text.strip() for x in r.b] == ["Ann", "Rome"] and [x.text.strip() for x in r.s] == ["Ann", "Bob", "Lee", "Rome"] and r.t.startswith("Ann met")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 9, 100])
def test_boxes_agree_with_sets(spark, n):
    word, entity = "array<struct<text:string,left:int,top:int,width:int,height:int>>", "array<struct<text:string,label:string>>"
    letters = ["a", "B", "é", "ß", "z", "\uffff", "\U0001f600", "0"]
    some = [a + b + c for a in letters for b in letters for c in ("", " ", "x")]
    r = np.random.default_rng(n)
    names = [(some[i], "PERSON" if i % 3 else "CARDINAL") for i in r.integers(0, len(some), n)]
    words = [*some, *some[:9], "", " ", None]
    rows = [(1, words, names), (2, words, [*names, (None, "ORG"), ("", "GPE")]), (3, words, None), (4, None, names), (5, [], names)]
    d = spark.createDataFrame([(k, w and [(t, i, 0, 9, 5) for i, t in enumerate(w)], e) for k, w, e in rows], f"k int, w {word}, e {entity}")
    for rule, d in ((image.boxes, d), (image.strict_boxes, d.filter("k <> 2"))):
        got = {x.k: x.b and [y.left for y in x.b] for x in d.select("k", rule(F.col("w"), F.col("e")).alias("b")).collect()}
        assert len(got) == len(rows) - (rule is image.strict_boxes)
        for k, w, e in [x for x in rows if x[0] in got]:
            covered = {t.strip(" ") for t, label in e or [] if t is not None and label != "CARDINAL"}
            assert got[k] == (None if w is None else [i for i, t in enumerate(w) if t and t.strip(" ") and t.strip(" ") in covered])


@pytest.mark.parametrize("rule", [image.boxes, image.strict_boxes])
def test_boxes_of_a_long_text(spark, rule):
    """30,000 different words that are all entities: the set of entities is not made, or read through, again for each word."""
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.sha1(i.cast("string"))).alias("t"))
    d = d.select(F.transform("t", lambda x: F.struct(x.alias("text"))).alias("w"), F.transform("t", lambda x: F.struct(x.alias("text"), F.lit("PERSON").alias("label"))).alias("e"))
    begun = time.monotonic()
    assert d.select(F.size(rule(F.col("w"), F.col("e")))).first()[0] == 30_000
    assert time.monotonic() - begun < 20


def test_image_redactor_is_plugged_in(spark, tmp_path):
    class Black:
        def redact(self, content):
            return b"black" + content[:1]

    (tmp_path / "a.png").write_bytes(b"xyz")
    (tmp_path / "a.txt").write_bytes(b"no")
    (r,) = image.redacted(blobs.images(spark, str(tmp_path)), Black()).collect()
    assert bytes(r.content) == b"blackx"


@pytest.mark.parametrize(("colour", "bits"), [(0, 1), (0, 8), (2, 8), (3, 4), (4, 8), (6, 8)])
@pytest.mark.parametrize("kind", range(5))
def test_png_kinds_and_filters(colour, bits, kind):
    import struct
    import zlib

    r = np.random.default_rng(kind)
    n, width, height = png.CHANNELS[colour], 7, 5
    values = r.integers(0, min(1 << bits, 6 if colour == 3 else 256), (height, width, n), np.uint8)
    packed = values.reshape(height, -1) if bits == 8 else np.packbits(((values.reshape(height, -1)[:, :, None] >> np.arange(bits)[::-1]) & 1).reshape(height, -1), axis=1)
    bpp, lines, above = max(1, n * bits // 8), b"", np.zeros(packed.shape[1], int)
    for line in packed.astype(int):
        left, corner = (np.concatenate([np.zeros(bpp, int), x[:-bpp]]) for x in (line, above))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
        above = line
    palette = r.integers(0, 256, (6, 3), np.uint8)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + chunk(b"PLTE", palette.tobytes()) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    want = palette[values[:, :, 0]] if colour == 3 else values[:, :, :3] if colour in (2, 6) else np.repeat(values[:, :, :1] * (255 // ((1 << bits) - 1)), 3, axis=2)
    assert (png.decode(data) == want).all() and (png.decode(png.encode(want)) == want).all()


def test_words_are_painted_over(spark, tmp_path):
    class Reader:
        def words(self, pixels):
            return [("Ann", 0, 0, 2, 2), ("met", 2, 0, 2, 2), ("Bob", 4, 0, 2, 2), ("Lee", 6, 0, 9, 9)]

    class Names:
        def entities(self, text):
            return [("Ann", "PERSON"), ("Bob Lee", "PERSON"), ("met", "CARDINAL")] if "Ann" in text else []

    white = np.full((4, 8, 3), 255, np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(white))
    (tmp_path / "b.png").write_bytes(b"broken")
    files = blobs.images(spark, str(tmp_path))
    for strict, columns in ((False, [0, 1]), (True, [0, 1, 4, 5, 6, 7])):
        got = {r.path.rpartition("/")[2]: r for r in image.redacted_words(files, Reader(), Names(), strict).collect()}
        dark = png.decode(bytes(got["a.png"].content)).sum(axis=2)[0] == 0
        assert np.flatnonzero(dark).tolist() == columns and got["a.png"].error is None
        assert got["b.png"].content is None and "PNG" in got["b.png"].error


# workbooks -------------------------------------------------------------------------------------------------------------------------------------
BOOK = [("One & only", [["Patient ID", "Phone"], ["P1", "<5>"], [None, "6", "7"]]), ("Empty", []), ("Head", [["Name"]])]


def test_xlsx_round_trip():
    assert workbook.sheets("a.xlsx", workbook.xlsx_bytes(BOOK)) == BOOK
    assert workbook.column_of("AB12") == 27 and workbook.number_text("7.0") == "7" and workbook.date_text("45000.5") == "2023-03-15 12:00:00"


def test_delimited_files_and_types():
    assert workbook.sheets("a.csv", b"\xef\xbb\xbfa,b\n1,\"x,y\"\n") == [("Sheet1", [["a", "b"], ["1", "x,y"]])]
    assert workbook.file_bytes("a.tsv", [("s", [["a", None]])]) == b"a\t\n"
    for name, data in (("a.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("a.bin", b"x")):
        with pytest.raises(ValueError):
            workbook.sheets(name, data)


TEXTS = [("One & only", [["Patient ID", "Phone"], ["P1", "<5>  two  spaces\ttab\nline"], [None, "6é漢😀", "7"]]), ("Empty", []), ("Head", [["Name"]])]


@pytest.mark.parametrize("kind", ["xls", "xlsb", "ods", "xlsx", "xlsm"])
def test_every_format_round_trips(kind):
    assert workbook.sheets(f"a.{kind}", workbook.file_bytes(f"a.{kind}", TEXTS)) == TEXTS
    assert workbook.sheets(f"a.{kind}", workbook.file_bytes(f"a.{kind}", [("none", [])])) == [("none", [])]


def test_xls_strings_run_over_records_and_files_over_tables():
    r = random.Random(3)
    rows = [["".join(r.choice("aé漢") for _ in range(r.choice([3, 40, 9000]))) for _ in range(5)] for _ in range(60)]
    assert workbook.sheets("a.xls", workbook.file_bytes("a.xls", [("long", rows)])) == [("long", rows)]
    stream = bytes(r.randrange(256) for _ in range(1000)) * 9000  # 9 MB: more sectors than the header's list of tables holds
    assert binary_sheets.compound_stream(binary_sheets.compound_file("Workbook", stream), "Workbook")[: len(stream)] == stream
    for rows in ([["x"]] * 65537, [["x"] * 257], [["x" * 32768]]):
        with pytest.raises(ValueError):
            workbook.file_bytes("a.xls", [("s", rows)])


def xls_of(records):
    """An xls with one sheet of the given records."""
    import struct

    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    start = lambda kind: record(0x0809, struct.pack("<HHHHII", 0x0600, kind, 0, 0, 0, 6))
    head = start(5) + record(0x041E, struct.pack("<HHB", 164, 10, 0) + b"yyyy-mm-dd") + b"".join(record(0xE0, struct.pack("<HH16x", 0, f)) for f in (0, 14, 164))
    bound = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, 1, 0) + b"S")
    head += bound(len(head) + len(bound(0)) + 4) + record(0x0A)
    return binary_sheets.compound_file("Workbook", head + start(0x10) + b"".join(record(k, b) for k, b in records) + record(0x0A))


def test_xls_cells_of_all_kinds():
    import struct

    cell = lambda c, style=0, r=0: struct.pack("<HHH", r, c, style)
    got = workbook.sheets("a.xls", xls_of([
        (0x0203, cell(0) + struct.pack("<d", 7.0)), (0x0203, cell(1, 1) + struct.pack("<d", 45000.5)), (0x027E, cell(2) + struct.pack("<I", (250 << 2) | 3)),
        (0xBD, struct.pack("<HH", 0, 3) + struct.pack("<HI", 0, (5 << 2) | 2) + struct.pack("<HI", 2, (45000 << 2) | 2) + struct.pack("<H", 4)),
        (0x0204, cell(5) + struct.pack("<HB", 2, 0) + b"ab"), (0x0205, cell(6) + b"\1\0"), (0x0205, cell(7) + b"\x07\1"),
        (0x06, cell(8) + struct.pack("<d", 1.5) + b"\0" * 8), (0x06, cell(9) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8), (0x0207, struct.pack("<HB", 1, 1) + "é".encode("utf-16-le")),
        (0x06, cell(10) + b"\1\0\1\0\0\0\xff\xff" + b"\0" * 8), (0x027E, cell(1, 0, 2) + struct.pack("<I", 0xFFFFFFFE)),
    ]))
    assert got == [("S", [["7", "2023-03-15 12:00:00", "2.5", "5", "2023-03-15 00:00:00", "ab", "true", "#DIV/0!", "1.5", "é", "true"], [], [None, "-1"]])]


def test_refused_files_and_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_bytes(b"x" * 100)
    (tmp_path / "c.txt").write_bytes(b"no")
    (tmp_path / "d.ods").write_bytes(workbook.file_bytes("d.ods", [("E", [])])[:50])  # damaged, above the limit too
    at = str(tmp_path)
    assert {(r.file.rpartition("/")[2], r.error) for r in workbook.refused_files(spark, at, 40).collect()} == {("b.csv", "size"), ("c.txt", "type"), ("d.ods", "size")}
    assert [(r.total_rows, r.total_columns) for r in workbook.sheet_shapes(workbook.read_workbooks(spark, at, 40)).collect()] == [(2, 2)]


def test_empty_sheets_pass(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(workbook.file_bytes("a.xls", TEXTS))
    rows = workbook.with_headers(workbook.read_workbooks(spark, str(tmp_path)))
    (r,) = workbook.workbook_files(phi.masked_cells(rows, key="k").drop("headers")).collect()
    book = workbook.sheets("a.xls", bytes(r.content))
    assert [n for n, _ in book] == ["One & only", "Empty", "Head"] and book[1][1] == [] and book[2][1] == [["Name"]]
    assert book[0][1][1][0] == "WID_" + hashlib.sha256(b"k\0p1").hexdigest()[:8]


def test_ods():
    import io
    import zipfile

    ns = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda kind, v: f'<table:table-cell office:value-type="{kind}" office:value="{v}"><text:p>{v}</text:p></table:table-cell>'
    xml = f'<office:document-content {ns}><table:table table:name="S"><table:table-row>{cell("string", "Name")}{cell("float", "7.0")}<table:table-cell table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row></table:table></office:document-content>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", xml)
    assert workbook.sheets("a.ods", out.getvalue()) == [("S", [["Name", "7"]])]


def test_workbooks_masked_and_written(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.xlsx_bytes(BOOK))
    (tmp_path / "b.csv").write_bytes(b"Patient ID,Age\np1,3\n,4\n")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = workbook.with_headers(workbook.read_workbooks(spark, str(tmp_path)))
    done = phi.masked_cells(rows, wallet="0xA").drop("headers")
    got = {r.file.rpartition("/")[2]: workbook.sheets(r.file, bytes(r.content)) for r in workbook.workbook_files(done).collect()}
    assert set(got) == {"a.xlsx", "b.csv"}
    assert got["a.xlsx"][0][1][1] == [wid("p1")] * 2 and got["b.csv"][0][1][1] == [wid("p1"), "3"] and got["b.csv"][0][1][2] == ["", "4"]


def test_delimited_reader(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n1\t\n")
    assert [tuple(r) for r in workbook.read_delimited(spark, str(tmp_path / "x.tsv"), "\t").collect()] == [("1", "")]


# streams ---------------------------------------------------------------------------------------------------------------------------------------
def test_streams(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "purchase", 5), ("2024-01-01 23:00:00", "purchase", 2), ("2024-01-02 00:00:00", "purchase", 1), ("2024-01-02 00:00:00", "view", 9)]
    d = spark.createDataFrame(rows, "ts string, event_type string, value long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d.write.parquet(str(tmp_path / "in"))
    batch = [(str(r.day)[:10], r.credits, r.total) for r in streams.daily_credits(d).orderBy("day").collect()]
    assert batch == [("2024-01-01", 2, 7), ("2024-01-02", 1, 1)]
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streams.daily_credits(s).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.day)[:10], r.credits, r.total) for r in spark.table("days").orderBy("day").collect()] == batch
    streams.ingest(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    e = s.select(F.col("event_type").alias("owner"), F.col("value").alias("amount"))
    q = streams.running_earnings(e).writeStream.format("memory").queryName("earned").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.owner: r.earned for r in spark.table("earned").collect()} == {"purchase": 8, "view": 9}


def test_zero_ids_are_none_in_every_numeric_type(spark):
    for kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(9,2)"):
        d = spark.sql(f"SELECT CAST(x AS {kind}) AS id, 'n' AS name FROM VALUES (0), (7) AS t(x)")
        assert [r.norm_id for r in phi.identifiers([(d, "id")]).collect()] == ["7"], kind
        assert [r.name.startswith("WID_") for r in phi.masked(d, {"id": "Patient ID"}).collect()] == [False, True]


def test_lists_of_several_types(spark):
    d = spark.createDataFrame([(1, '{"k": 7}'), (2, '{"k": "7"}'), (3, '{"k": true}'), (4, "{}"), (5, '{"k": 8}')], "i long, m string").withColumn("m", F.parse_json("m"))
    ids = lambda f: [r.i for r in search.filtered(d, f, "m").orderBy("i").collect()]
    assert ids({"k": {"$in": ["7", 8]}}) == [2, 5] and ids({"k": {"$in": [7, True]}}) == [1, 3] and ids({"k": {"$in": []}}) == []
    assert ids({"k": {"$nin": ["7", 8]}}) == [1, 3] and ids({"k": {"$nin": []}}) == [1, 2, 3, 5]


def test_pseudonyms_agree_across_frames(spark):
    a, b = spark.createDataFrame([("P1",), ("",)], "x string"), spark.createDataFrame([(" p1",), ("2",)], "y string")
    assert {(r.norm_id, r.pseudonym) for r in phi.identifiers([(a, "x"), (b, "y")]).collect()} == {("p1", wid("p1")), ("2", wid("2"))}
    assert spark.range(1).select(pseudonym(F.lit("p1")).alias("p")).first().p == wid("p1")
