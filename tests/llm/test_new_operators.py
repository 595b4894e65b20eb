"""Whitening, repair and fingerprints against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dynofleet.llm import phrases, repair, whitening

BLANKS = " \t\n\x0b\x0c\r"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
EMBEDDINGS = "vec_id long, embedding array<double>, n int, component string"
CONVERSATIONS = "conv_id long, turn long, role string, text string, cost string, kind int"


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) / 9
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist()), (None, base[6].tolist())]
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] + [0.0] * 11), (904, [float("inf")] * 12), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in rows + odd], EMBEDDINGS).repartition(3)
    got = whitening.whitened(df, most=8).collect()
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((x - total / n).T, bias=True))
    order = np.argsort(-values)[:8]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    deviation = {i: int(d) for i, d in zip([i for i, _ in rows], ((n * x - total).astype(object) ** 2).sum(axis=1))}
    assert all(int(r.deviation) == deviation[r.vec_id] for r in got)
    white = {(r.vec_id, r.component): r.whitened for r in got}
    for k, o in enumerate(order):
        want = (x - total / n) @ vectors[:, o] / np.sqrt(values[o])
        sign = np.sign(want[0] * white[0, k + 1])
        assert np.allclose([white[i, k + 1] * sign for i, _ in rows], want, atol=1e-9)
        assert all(abs(r.explained - values[o] / values.sum()) < 1e-12 for r in got if r.component == k + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    only = F.struct("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    assert whitening.whitened(df.limit(0)).select(only).count() == 0
    one = whitening.whitened(df.filter("vec_id = 7")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, None)] * 8


def test_whitening_is_exact_beyond_longs(spark):
    rows = [(1, [1e8, -3.5]), (2, [-9e8, 2.25]), (3, [5e8, 1e9])]
    df = spark.createDataFrame([(a, b, 0, "") for a, b in rows], EMBEDDINGS)
    x = np.array([[int(v * 1024) + 100_000 for v in b] for _, b in rows], dtype=object)
    centred = 3 * x - x.sum(axis=0)
    got = whitening.whitened(df).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == {i + 1: int((c * c).sum()) for i, c in enumerate(centred)}
    cov = np.array([[float((centred[:, i] * centred[:, j]).sum()) / 27 for j in (0, 1)] for i in (0, 1)])
    assert np.allclose(sorted({r.explained for r in got}), np.linalg.eigvalsh(cov) / np.trace(cov))
    with pytest.raises(Exception, match="2\\^30"):
        whitening.whitened(spark.createDataFrame([(1, [2e9], 0, "")], EMBEDDINGS)).collect()


def cheapest(rows: list[tuple], faults: list[str]) -> tuple:
    """Row by row with whole edit strings: cost, edits, repaired rows."""
    best = {0: (0, "", ())}

    def offer(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserts(at):
        for _ in range(3):
            for q, (cost, edits, out) in list(at.items()):
                for i, name in (("u", "user"), ("a", "assistant")):
                    if (q, i) in MOVES:
                        offer(at, MOVES[q, i], (cost + 3, edits + "I", (*out, (name, ""))))
        return at

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, edits, out) in inserts(best).items():
            offer(after, q, (cost + 4, edits + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (q, role[:1]) in MOVES:
                offer(after, MOVES[q, role[:1]], (cost + more, edits + "K", (*out, (role, text))))
            for i, name in (("u", "user"), ("a", "assistant")):
                if (q, i) in MOVES:
                    offer(after, MOVES[q, i], (cost + more + 3, edits + "R", (*out, (name, text))))
        best = after
    inserts(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])


def brute_repair(rows: list[tuple]) -> dict:
    word = lambda v: " " if v is None else str(v)
    by = {}
    for conv, turn, role, text in rows:
        here = by.setdefault(conv, [])
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else word(role), "" if kind == 1 else re.sub("[.!?]", "", word(text)) if kind == 2 else word(text)
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns, seen, faults = [t for t, _, _ in rs if t is not None], set(), []
        for _, role, text in rs:
            rest = text.rstrip(BLANKS)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, edits, made = cheapest(rs, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def conversation(rng: random.Random, conv, n: int) -> list[tuple]:
    role = lambda i: rng.choice(["system", "user", "assistant", "tool", None, "", "sys", "u"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2]
    text = lambda i: rng.choice(["Hi.", "yes", "  ", "", "what? \t", "no!", "a.\x85", None, f"ok {rng.randrange(9)}.", f"fine {i}."])
    return [(conv, rng.choice([i, i, i, i * 2, None]), role(i), text(i)) for i in range(n)]


def conversations() -> list[tuple]:
    rng = random.Random(1)
    rows = [r for c in range(120) for r in conversation(rng, c, rng.randrange(1, 14))] + conversation(rng, None, 400) + conversation(rng, 1 << 60, 20)
    return rows + rows[:50] + [(7000 + k, 0, "user", f"{'word ' * 30_000}{k}") for k in range(2)]


@pytest.mark.parametrize("segment", [4096, 7])
def test_repair_against_a_walk_with_whole_strings(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "FAN", 3 if segment == 7 else 32)
    rows = conversations()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if segment == 7 else 37)
    got = repair.repaired(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(5)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repair(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_a_very_long_conversation_and_of_none(spark):
    rows = conversation(random.Random(5), 3, 20_000) + conversation(random.Random(6), 4, 3)
    got = repair.repaired(spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repair(rows)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0)], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_grammar_keeps_the_product():
    rng = random.Random(2)
    g = repair.Grammar()
    for pair in ("ua", "Ua", "xx"):
        g.add(pair)
    g.add(g.rules[0][1] * 2)
    for _ in range(200):
        s = "".join(rng.choice(repair.SYMBOLS) for _ in range(rng.randrange(1, 12)))
        plain = repair.symbol_matrix(s[0])
        for c in s[1:]:
            plain = repair.product(plain, repair.symbol_matrix(c))
        assert g.matrix(s) == plain


def slow_levels(data: bytes) -> list[list[int]]:
    """The names of every level of one text, by plain loops."""
    m = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    odd, names, out = 0x9E3779B97F4A7C15, list(data), []
    while not out or len(out[-1]) > 1:
        runs = []
        for v in names:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        values = [int(phrases._FIRST[v]) if not out else v for v, _ in runs]
        values = [mixed(v ^ odd * k & m) if k > 1 else v for v, (_, k) in zip(values, runs)]
        label = [v for v, _ in runs]
        for _ in range(4 if out else 3):
            label = [2 * (bit := (d & -d).bit_length() - 1) + (v >> bit & 1) for v, d in zip(label, (v ^ u for v, u in zip(label, [label[0] ^ 1, *label])))]
        cut = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        assert len(set(label)) <= 6 and all(b - a <= 12 for a, b in zip(cut, [*cut[1:], len(label)]))
        names = [mixed(sum(mixed(values[i] + odd * (i - a + 1) & m) for i in range(a, b)) & m) for a, b in zip(cut, [*cut[1:], len(label)])]
        out.append(names)
    return out


def test_phrases_against_loops_and_shifts():
    rng = random.Random(7)
    texts = [b"", b"a", b"ab", b"aaaa", b"abab" * 40, "Ä日本 𝄞 ".encode() * 9] + [bytes(rng.choice(b"abcde  \n") for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    names, of = phrases.signatures(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for i, t in enumerate(texts):
        levels = slow_levels(t) if t else [[]]
        want = [v for k, level in enumerate(levels, 1) for v in level if k >= phrases.LOWEST] or levels[-1]
        assert sorted(names[of == i].tolist()) == sorted(want)
    part = bytes(rng.choice(b"abcdefghij klmno") for _ in range(3000))
    for before in (1, 2, 3, 5, 7, 64, 501):  # the names inside of a passage don't depend on where it stands
        other = bytes(rng.choice(b"qrstuvw") for _ in range(before)) + part + bytes(rng.choice(b"qrstuvw") for _ in range(before))
        a, b = (set(slow_levels(t)[1]) for t in (part, other))
        assert len(a - b) <= 6 and len(a) > 300


def test_fingerprints_of_documents_in_order(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 120))) for i in range(0, 600, 3)] + [(600, None), (603, ""), (606, text(40_000)), (609, "日本語 ÄÖ 𝄞" * 30), (-5, "one"), (None, "no id"), (None, "nor this")]
    rows += [(300, f"again {k} " + text(30)) for k in range(300)] + [(303, "the same")] * 40 + [(9, rows[3][1])]
    schema = "doc_id long, text string, fingerprint string, range int, digest string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).repartition(5)
    keyed = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, keyed[r], r[1] or ""))
    texts = [t or "" for _, t in ordered]
    want = []
    sketch = phrases.sketches([t.encode() for t in texts])
    for k, (i, _) in enumerate(ordered):
        after = texts[(k + 1) % len(texts)]
        n = len(texts[k])
        cut = texts[k][: n - n // 4] + after[: n // 4]
        own = phrases.sketches([cut.encode()])
        near = [float(phrases.likeness(sketch[k : k + 1], o)[0]) for o in (own, sketch[(k + 1) % len(texts)][None])]
        want.append((i, n, hashlib.sha256(cut.encode()).hexdigest(), phrases.written(sketch[k : k + 1])[0], phrases.written(own)[0], *near))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    for ranges in (1, 7, 40):
        got = [tuple(r) for r in phrases.fingerprinted(df, ranges).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    big = [w for w in want if w[1] > 300]
    assert min(w[5] for w in big) > 0.35 and max(w[6] for w in big if w[0] not in (9, 300, 303)) < 0.15
    assert phrases.fingerprinted(df.limit(0)).collect() == []
    alone = phrases.fingerprinted(df.filter("doc_id = -5")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in alone] == [(3, 1.0, 1.0)]
    parts = phrases.in_order(df, 40)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 80, "the id with 300 texts is spread"
