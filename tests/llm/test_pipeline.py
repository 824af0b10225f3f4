"""The pipeline's stages against brute force on a small corpus with planted cases."""

import random
import re

import corpus_pipeline as pipeline
from carrel.llm import secrets


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        rows.append((i, text(r.randint(40, 90)) if good else " ".join(["&&& $$$ ***"] * 30) + f" {i}", "en", f"s{i % 3}", 1))
        labels.append((i, int(good), 0))
    copy = rows[1][1]
    rows += [(1001, copy, "en", "s0", 1), (1002, copy + " end", "en", "s0", 1), (1003, text(40) + " " + item + " " + text(5), "en", "s1", 1), (1004, text(50) + " password: hunter22 " + text(9), "en", "s2", 1)]
    rows += [rows[2], (None, "a row without an id " + text(30), None, None, None), (None, None, None, None, None)]
    doc = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*x, "extra") for x in rows], doc + ", score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, text(15))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert tuple(docs.columns) == pipeline.COLUMNS
        every = docs.collect()
        kept[name] = {x.doc_id: x for x in every if x.doc_id is not None}
        assert name == "quality" or len(every) - len(kept[name]) == nulls
        nulls = len(every) - len(kept[name]) - (name == "quality")  # there doc 2 is still twice
    clean = {x[0] for x in rows if x[0] is not None and (x[0] >= 1000 or x[0] % 5)}
    assert set(kept["quality"]) == clean
    assert set(kept["near_dedup"]) == clean - {1001, 1002}
    assert set(kept["decontaminate"]) == clean - {1001, 1002, 1003} == set(kept["secrets"])
    for i, x in kept["secrets"].items():
        assert not secrets.brute_force(x.text) and x.n_chars == len(x.text)
        assert (x.text == kept["decontaminate"][i].text) == (i != 1004)
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} - {None} == set(kept["secrets"])
    out = [x for x in out if x.doc_id is not None]
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) for i, x in kept["secrets"].items()}
    assert all(x.size == words[x.doc_id] and x.taken <= 2 * x.size for x in out) and abs(sum(x.taken for x in out) / sum(words.values()) - 1.5) < 0.02


def test_near_dedup_drops_rows_not_ids(spark):
    r = random.Random(13)
    a, b, c, d = (" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (4, c), (4, c), (5, None), (5, None), (5, ""), (None, d), (None, d), (None, d + " end"), (None, a), (None, None)]
    doc = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)], doc).repartition(3)
    got = sorted((str(x.doc_id), str(x.text)) for x in pipeline.near_dedup(spark, pipeline.written(frame, "rows"), "").collect())
    assert got == sorted((str(i), str(t)) for i, t in [(1, a), (2, b), (4, c), (5, None), (5, ""), (None, d), (None, None)])


def test_empty_tables_pass(spark, tmp_path):
    doc = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], doc).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
