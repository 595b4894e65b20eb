"""Cases that once went wrong, or could: texts written to collide, graphs with cycles, borderline notices."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from dynofleet.llm import boosting, chunking, hosts, licences, rules, setjoin, suffixes
from dynofleet.llm.textops import hash_spans, slices


def thue_morse(n: int, zero: str = "a", one: str = "b") -> str:
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


T, C = thue_morse(2048), thue_morse(2048, "b", "a")


def test_spans_that_collide_for_sums_of_powers_get_other_hashes():
    data = np.frombuffer((T + C).encode(), np.uint8)
    for n in (8, 64, 512, 1024, 2048):
        for seed in (0, 1):
            one, two = hash_spans(data, np.array([0, 2048]), np.array([n, 2048 + n]), seed)
            assert one != two
            again, other = hash_spans(data[:n].copy(), np.array([0]), np.array([n]), seed)[0], hash_spans(data, np.array([0]), np.array([n]), 1 - seed)[0]
            assert again == one and other != one


def test_operators_on_colliding_texts(spark):
    rows = [(1, T), (2, C), (3, f"{T} x {C} y {C} x {T} y"), (4, f"{T} x {T} y {T} x {T} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_duplicates(docs, 3, 90, 100).collect()}
    sets = {i: (w := t.split(), {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))})[1] for i, t in rows}
    assert got == {i: (len(s), i) for i, s in sets.items()}
    cut = {r.doc_id: r.kept for r in suffixes.deduplicated(docs).collect()}
    seen = set()
    for i, t in rows:
        data, mark = t.encode(), np.zeros(len(t) + 1, int)
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                mark[a] += 1
                mark[a + 100] -= 1
            seen.add(data[a : a + 100])
        assert cut[i] == np.frombuffer(data, np.uint8)[mark.cumsum()[:-1] == 0].tobytes()
    earlier = ""
    for r in chunking.deduplicated(docs).orderBy("doc_id").collect():
        text = dict(rows)[r.doc_id]
        for x, y in r._removed:
            assert all(text[k : k + 8] in earlier + text[: k + 7] for k in range(x, y - 8)), "what is cut stands earlier"
        earlier += text + "\n"
    found = licences.scan(docs, {"t": f"{T} {C} {T}"})
    assert found.count() == 0, "no text holds it"


def test_page_rank_against_a_loop(spark):
    rng = random.Random(2)
    names = [f"h{i}" for i in range(12)]  # h9 to h11 have no links out; h0 to h3 are a ring
    links = {(names[i], names[(i + 1) % 4]): 2.0 for i in range(4)} | {(names[rng.randrange(9)], names[rng.randrange(12)]): float(1 + k % 3) for k in range(20)}
    links = {k: w for k, w in links.items() if k[0] != k[1]}
    seeds = {"trust": {"h0": 0.75, "h10": 0.25}, "distrust": {"h5": 1.0}}
    edges = [("trust", a, b, w) for (a, b), w in links.items()] + [("distrust", b, a, w) for (a, b), w in links.items()]
    got = defaultdict(dict)
    for r in hosts.propagate(
        spark.createDataFrame(edges, "kind string, src string, dst string, weight double"), spark.createDataFrame([(k, h, s) for k, of in seeds.items() for h, s in of.items()], "kind string, host string, seed double"), close=1e-9
    ).collect():
        got[r.kind][r.host] = r.score
    for kind, of in seeds.items():
        out = defaultdict(float)
        for k, a, _, w in edges:
            out[a] += w * (k == kind)
        score = dict(of)
        for _ in range(400):
            new = defaultdict(float)
            for k, a, b, w in edges:
                if k == kind:
                    new[b] += 0.85 * score.get(a, 0.0) * w / out[a]
            rest = 1 - sum(new.values())
            for h, s in of.items():
                new[h] += s * rest
            score = dict(new)
        assert all(abs(got[kind].get(h, 0.0) - score.get(h, 0.0)) < 1e-6 for h in names), kind
        assert abs(sum(got[kind].values()) - 1) < 1e-6


def test_licences_against_all_windows():
    rng, words = random.Random(4), ["".join(random.Random(i).choice("abcdefgh") for _ in range(5)) for i in range(900)]
    t = licences.Templates(licences.TEMPLATES)
    want = got = 0
    for n in range(150):
        name = rng.choice(t.names)
        notice = re.findall(r"[A-Za-z0-9]+", licences.TEMPLATES[name])
        for _ in range(rng.randrange(max(1, len(notice) // 12) + 1)):  # near and beyond the limit
            notice[rng.randrange(len(notice))] = rng.choice(words)
        text = " ".join([rng.choice(words) for _ in range(rng.randrange(60))] + notice + [rng.choice(words) for _ in range(rng.randrange(60))])
        s = next(slices(pa.array([text])))
        _, _, hashed, bounds = s.words(lower=True, apart=licences._APART)
        grams, _ = licences.shingles(hashed, bounds, licences.SHINGLE)
        best = {}
        for width, of in t.classes.items():
            step = width // 4
            for lo in range(0, len(grams), step):
                for k in of:
                    share = float(np.isin(t.sets[k], grams[lo : lo + 5 * step]).mean())
                    if share >= licences.CONTAINED:
                        best[k] = max(share, best.get(k, 0.0))
        found = {k: share for _, k, share, _ in licences.found_in(s, t, licences.CONTAINED)}
        assert all(best[k] >= share for k, share in found.items())
        want, got = want + len(best), got + sum(k in found for k in best)
    assert want > 150 and got >= want * 0.995


def test_counts_of_rules_and_statistics_against_loops(spark):
    rng = random.Random(6)
    pieces = ["word", "Word", "A#b", "$$", "x<y>", "", " ", "it's", "9|8", "ﬁ日本", "%&*"]
    texts = ["\n".join(" ".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))) for _ in range(120)] + ["\n\n \n", "a\r\na\r\na", "\x0b\x0c", "x" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.judged(docs, []).collect():
        text = texts[r.doc_id]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>"), repr(text)
        assert r.n_dup_lines == len(lines) - len(set(lines)), repr(text)
        assert r.word_chars == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text)))
    s = next(slices(pa.array(texts), 1 << 30))
    one = boosting.statistics(s)
    for i, text in enumerate(texts):
        alone = boosting.statistics(next(slices(pa.array([text]))))
        assert np.allclose(one[i], alone[0]), "a text's statistics don't depend on its neighbours"


def test_repeated_rows_keep_what_comes_first(spark):
    rng = random.Random(11)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = word(80), word(70), word(60)
    rows = [(1, a)] * 3 + [(2, b + a)] * 2 + [(3, c)] * 40 + [(4, a[:300] + c)] + [(5, "ab " * 400)] * 2 + [(6, a), (6, a), (6, b)]
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(r.doc_id, r.n_bytes): r for r in suffixes.deduplicated(docs).collect()}
        assert suffixes.deduplicated(docs).count() == len(rows)
        assert got[1, len(a)].n_removed == 0 and got[3, len(c)].n_removed == 0
        assert got[2, len(a + b)].kept.decode() == b and got[4, 300 + len(c)].n_removed == 300 + len(c)
        assert got[5, 1200].n_removed == 1200 - 3 and got[6, len(a)].n_removed == len(a)
