"""Each operator against brute force on small inputs: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dynofleet.llm import boosting, chunking, hosts, licences, neighbours, packing, rules, setjoin, subword, suffixes
from dynofleet.llm.textops import slices

tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = tokenizers.path("piece_bpe_32k.model"), tokenizers.path("word_bpe_49k.json")
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, distinct: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnorstuw") for _ in range(3 + i % 6)) for i in (rng.randrange(distinct) for _ in range(n))]


def corpus() -> list[tuple]:
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (6, "two words"), (7, "ÄÖ ü ﬁ 日本 語\r\n x"), (8, "a" * 3000), (9, "ab " * 2000)]
    base = words(90, 1)
    for i in range(10, 60):  # near copies of one text, with one to eight changed words
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = rng.choice(["zzq", "qqz", f"w{rng.randrange(30)}"])
        rows.append((i, " ".join(w)))
    passage = " ".join(words(60, 2))
    rows += [(i, " ".join(words(40, i)) + " " + passage + "\n" + " ".join(words(30, i + 500))) for i in range(60, 75)]
    rows += [(i, rows[70][1]) for i in range(75, 80)] + [(80, " ".join(words(9000, 80)))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0.5, [1]) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score double, ids array<int>").repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_sentencepiece(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in subword.round_trip_digests(docs, PIECES).collect()}
    encoded = subword.encode(docs, PIECES)
    back = {r.doc_id: r.text for r in subword.decode(encoded, PIECES).collect()}
    for i, text in corpus():
        ids = lib.encode(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back[i] == lib.decode(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert subword.round_trip_digests(empty(spark), PIECES).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS, capacity=512, task_items=20).collect()
    by_doc, by_bin, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, text in corpus():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == [(k, len(ids[k : k + 512])) for k in range(0, len(ids), 512)]
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for items in by_bin.values():
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_bin) <= 1.15 * -(-total // 512) + 1
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_of_one_partition_merges_open_bins(spark):
    source = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(20)], "doc_id long, text string").coalesce(1)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, "4")
    try:
        rows = packing.pack(source, WORDS, task_items=4).collect()
    finally:
        spark.conf.set(batch, old)
    assert {r.doc_id for r in rows} == set(range(20))
    assert len({r.sequence_id for r in rows}) == 1, "all fit one sequence"


@pytest.mark.parametrize(("k", "num", "key_cost"), [(3, 90, 100), (5, 80, 100), (1, 70, 0), (3, 90, 0)])
def test_set_join(spark, docs, k, num, key_cost, monkeypatch):
    monkeypatch.setattr(setjoin, "KEY_COST", key_cost)  # 0: all stars are keyed
    sets = {}
    for i, text in corpus():
        w = [x.lower() for x in SPLIT.findall((text or "").encode())]
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            common = len(sets[x] & sets[y])
            if x < y and common and 100 * common >= num * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                of[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_duplicates(docs, k, num, 100).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert setjoin.near_duplicates(empty(spark), k, num, 100).count() == 0


def test_empty_segments_keep_the_key_of_their_place():
    bands = setjoin.Bands(80, 100, 200)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (20, 60, 180)]
    bounds = np.cumsum([0, *map(len, sets)])
    for deletions in (False, True):
        layouts = [setjoin.Layout(40, 40, deletions)] * (len(bands.lows) - 1)
        owner, key, whole = setjoin.index_keys(np.concatenate(sets), bounds, bands, layouts)
        assert not (key == 0).any()
        assert all(len(set(key[(owner == i) & whole])) == (whole & (owner == i)).sum() for i in range(3))


def test_suffixes(spark, docs):
    got = {r.doc_id: r for r in suffixes.deduplicated(docs).collect()}
    seen, n = set(), 0
    for i, text in sorted(corpus()):
        data = (text or "").encode()
        mark = np.zeros(len(data) + 1, int)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                mark[a] += 1
                mark[a + 100] -= 1
            seen.add(data[a : a + 100])
        gone = mark.cumsum()[:-1] > 0
        n += int(gone.sum())
        assert got[i].n_removed == gone.sum()
        assert got[i].kept == np.frombuffer(data, np.uint8)[~gone].tobytes()
    assert n > 1000
    assert suffixes.deduplicated(empty(spark)).count() == 0


def test_hot_minimisers(spark, docs, monkeypatch):
    want = {r.doc_id: r.kept for r in suffixes.deduplicated(docs).collect()}
    monkeypatch.setattr(suffixes, "HOT_STRETCHES", 3)
    assert {r.doc_id: r.kept for r in suffixes.deduplicated(docs).collect()} == want


def test_chunks(spark, docs):
    got = {r.doc_id: r for r in chunking.removal_digests(docs).collect()}
    assert all(got[i].n_removed > 150 for i in range(61, 75)), "the shared passage goes everywhere but in its first text"
    assert got[60].n_removed == 0
    assert all(got[i].n_removed == got[i].n_bytes for i in range(76, 80)), "copies go whole"
    assert got[1].n_bytes == got[2].n_bytes == 0
    assert got[4].n_removed == got[80].n_removed == 0
    cut = chunking.deduplicated(docs)
    assert cut.columns == [*docs.columns, "_removed"]
    assert chunking.removal_digests(empty(spark)).count() == 0


def test_chunks_tile_and_resist_shifts():
    text = " ".join(words(3000, 9))
    a, b = (next(slices(pa.array([t]), 1 << 30)) for t in (text, "shifted " + text))
    (s1, e1, _), (s2, e2, _) = chunking.chunks(a), chunking.chunks(b)
    assert (s1[1:] == e1[:-1]).all() and s1[0] == 0 and e1[-1] == len(text)
    one, two = ({text_[x:y] for x, y in zip(s, e, strict=True)} for text_, s, e in ((text, s1, e1), ("shifted " + text, s2, e2)))
    assert len(one - two) <= 3


@pytest.mark.parametrize("blank", [" ", ""])
def test_chunks_catch_short_passages_to_their_ends(spark, blank):
    rows, want, script = [], {}, [chr(c) for c in range(0x4E00, 0x5A00)]
    for i in range(300):
        rng = random.Random(i)
        text = lambda n, s: " ".join(words(n, s)) if blank else "".join(rng.choice(script) for _ in range(2 * n))  # noqa: E731, B023
        passage = blank + text(51, 9000 + i) + blank
        rows += [(2 * i, text(40, 2 * i) + passage + text(30, 20000 + i)), (2 * i + 1, text(35, 2 * i + 1) + passage + text(45, 30000 + i))]
        want[2 * i + 1] = len(passage.encode())
    got = {r.doc_id: r.n_removed for r in chunking.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[2 * i] == 0 for i in range(300))
    less = [i for i, n in want.items() if got[i] < n - 1]  # a blank at an end may not stand beside the same text
    assert not less, f"{len(less)} of {len(want)} passages are left in part"
    assert all(got[i] <= n + 8 for i, n in want.items())


def test_chunks_of_rows_that_share_a_doc_id(spark):
    one, two = " ".join(words(60, 1)), " ".join(words(60, 2))
    rows = [(1, "a " + one), (2, "b " + two), (3, " ".join(words(20, 3)) + " " + one), (3, " ".join(words(25, 4)) + " " + two), (None, one)]
    got = {(r.doc_id, r.text) for r in chunking.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for x in got if x[0] in (1, 2, None)} == {rows[0], rows[1], rows[4]}
    assert {t.strip() for i, t in got if i == 3} == {" ".join(words(20, 3)), " ".join(words(25, 4))}


def labelled(spark, n=600):
    rng, docs, labels = random.Random(5), [], []
    for i in range(n):
        good = i % 3 > 0
        w = words(rng.randrange(30, 200), i, 5000)
        docs.append((i, " ".join(w if good else [x + rng.choice(["###", "$$$", "%%%"]) for x in w])))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_on_held_out_labels(spark, docs):
    texts, labels = labelled(spark)
    model = boosting.learn(texts, labels)
    rows = boosting.score(texts, model).withColumn("held", boosting.held_out()).join(labels, "doc_id").filter("held").collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert len(rows) > 80 and right / len(rows) > 0.95
    odd = boosting.score(docs, model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd)
    none = boosting.learn(empty(spark), labels)
    assert boosting.score(empty(spark), none).count() == 0


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    t = boosting.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=5)
    for row, got in zip(x, t.score(x), strict=True):
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + int(row[f[n]] > c[n])
            total += leaf[n - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_rules(spark, docs):
    texts, labels = labelled(spark)
    found = rules.learn(texts, labels)
    assert found
    rows = rules.judged(texts, found).join(labels, "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)
    got = {r.doc_id: r for r in rules.judged(docs, found).collect()}
    for i, text in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = defaultdict(list)
        for a in range(len(w) - 4):
            at[tuple(w[a : a + 5])].append(a)
        repeated = {j for places in at.values() if len(places) > 1 for a in places for j in range(a, a + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert rules.learn(empty(spark), labels) == []
    assert rules.judged(empty(spark), []).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[7]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9020, [float("nan")] * 16), (9040, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, found = x.astype(float), 0
    for q in range(0, 1500, 50):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:10]
        assert len(got[q]) == 10
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in got[q])
        found += len({v for v, _ in got[q]} & set(best.tolist()))
    assert found / 300 >= 0.9
    assert set(got) == set(range(0, 1500, 50))
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert neighbours.search(few, F.lit(True), k=10).count() == 20
    assert neighbours.search(table.filter("vec_id > 9000"), F.lit(True), k=10).filter("vec_id < 9040").count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/1?q#f"), (2, "http://a.example.com/en/x"), (3, "http://example.com/de/"), (4, "x.net/es/1"), (5, None), (6, "https://b.net/es/"),
    (7, "https://c.org/p#x/y"), (8, "https://d.org"), (9, "https://com"), (10, "ftp://notcom.comx/"), (11, "https://c.org/q"), (12, "https://e.org/1"),
]


def test_url_filter(spark):
    given = [hosts.UrlRule(*x) for x in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"))]
    html = {7: '<a href="https://b.net/es/">spam</a>', 3: '<a href="//e.org/1">good</a>'}
    pages = spark.createDataFrame([(i, u, html.get(i)) for i, u in URLS], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judged(pages, given).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("net/es/", "block")
    assert got[7] == ("c.org", "/p", None, "block") and got[11][3] == "block", "it links to a blocked host"
    assert got[8] == ("d.org", "", None, "allow") and got[9][2] is None and got[10][2] is None
    assert got[12][3] == "allow"
    assert hosts.judged(pages.limit(0), given).count() == 0


def test_licences(spark):
    texts = [(1, None), (2, ""), (3, " ".join(words(500, 3)))]
    for i, (name, t) in enumerate(licences.TEMPLATES.items()):
        texts.append((10 + i, " ".join(words(37 + i, i)) + " " + t.upper().replace(" ", "\n") + " " + " ".join(words(200, i + 50))))
        texts.append((50 + i, " ".join(t.split()[: len(t.split()) // 3]) + " " + " ".join(words(50, i + 90))))
    found = defaultdict(set)
    for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found[r.doc_id].add(r.license)
        assert r.containment >= 0.8
    for i, name in enumerate(licences.TEMPLATES):
        assert name in found[10 + i]
        assert name not in found[50 + i]
    assert not found[1] and not found[2] and not found[3]
    assert licences.scan(empty(spark)).count() == 0
