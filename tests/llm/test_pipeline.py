"""The pipeline on a small planted corpus: what each stage takes and what it leaves."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng, docs, labels = random.Random(1), [], []
    vocab = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(3 + i % 6)) for i in range(3000)]
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60, 200))]
        bad = i % 4 == 0
        docs.append((i, " ".join(x + "$$$" for x in w) if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1, 0))
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    clean = {i: t for i, t in docs if i % 4}
    docs += [(1000 + i, clean[i]) for i in (1, 2, 3)]  # copies
    near = clean[5].split()
    near[3] = "changed"
    docs += [(1010, " ".join(near))]
    docs += [(1020 + k, " ".join(rng.choice(vocab) for _ in range(60)) + " " + passage) for k in range(3)]
    docs += [(2000, None), (2001, ""), (2002, "too short")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    for n, (name, stage) in enumerate(pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        assert n == 4 or df.columns == columns
        df.write.parquet(f"{tmp_path}/{n}")
        df = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = {r.doc_id for r in df.select("doc_id").collect()}
    assert not kept["quality_rules"] & {2000, 2001, 2002}
    assert not {i for i in kept["quality_classifier"] if i < 300 and i % 4 == 0}
    assert set(clean) <= kept["quality_classifier"]
    assert not kept["near_duplicates"] & {1001, 1002, 1003, 1010}
    assert set(clean) <= kept["near_duplicates"]
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert passage[60:-80] in cut[1020].text and all(passage[60:-80] not in cut[1020 + k].text for k in (1, 2))
    assert all(cut[i].text == t for i, t in clean.items())
    assert kept["best_fit_packing"] == kept["substring_dedup"]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == kept["best_fit_packing"]


def test_near_duplicates_keep_rows_without_or_with_one_doc_id(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(6)) for _ in range(3000)]
    text = lambda: [rng.choice(vocab) for _ in range(120)]
    a, b, c, lone = text(), text(), text(), text()
    changed = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(1, " ".join(a)), (5, changed(a)), (5, " ".join(b)), (6, changed(b)), (5, " ".join(c)), (5, " ".join(c)), (7, changed(c))]
    rows += [(8, ""), (8, " ".join(lone)), (8, changed(lone)), (None, " ".join(text())), (None, changed(a)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    of_eight = [x for x in got if x[0] == 8]
    want = [(1, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), *[x for x in rows if x[0] is None]]
    assert [x for x in got if x[0] != 8] == sorted(want, key=str)
    assert len(of_eight) == 2 and (8, "") in of_eight


CLASHES = ("score", "text_", "_id", "_doc", "_again", "_removed", "_m", "_q_text", "row", "text_hash", "kept_id", "node", "key", "_beside", "component_id")


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(3 + i % 6)) for i in range(2000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(40)]
    texts += [texts[3], texts[4] + " tail", None, ""]
    rows = [(i, t, len(t or ""), *(f"{c}{i}" for c in CLASHES)) for i, t in enumerate(texts)] + [(None, texts[5], 9, *CLASHES)]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    of = {r[0]: r for r in rows}
    for n, (name, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got or name == "quality_classifier"
        for r in got:
            assert tuple(r)[3:] == of[r.doc_id][3:], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        assert [r.doc_id for r in got].count(None) == 1 or n < 2
    assert pipeline.best_fit_packing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(rows)
    assert pipeline.best_fit_packing(spark, docs.limit(0), str(tmp_path)).count() == 0
