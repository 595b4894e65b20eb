"""Image comparisons by page digest against loops over whole contents."""

import numpy as np

from dynofleet.operators import revisions
from dynofleet.sources import images


def flash(rng, size=524288):
    data = np.zeros(size, np.uint8)
    data[0x503] = 1
    for i in range(7):
        start = 0x8000 + 0x1234 * i
        data[0x514 + 8 * i : 0x51C + 8 * i] = np.frombuffer((start.to_bytes(4, "big") + (start + 0x11FF).to_bytes(4, "big")), np.uint8)
    data[0x30000:0x34000] = rng.integers(0, 256, 0x4000)
    return data


def by_loop(x, y):
    n = min(len(x), len(y))
    differ = np.frombuffer(x, np.uint8)[:n] != np.frombuffer(y, np.uint8)[:n]
    total = int(differ.sum()) + abs(len(x) - len(y))
    found = images.read_image("", x)
    if len(x) != len(y) or not found["detected"]:
        return total, None
    spans = [("header", 0, 0x4000), ("eeprom", 0x4000, 0x4000), ("system", 0x20000, images.SYSTEM_LENGTH[n])]
    spans += [(s["name"], s["start"], s["length"]) for s in found["segments"] if not s["error"]]
    return total, {m: int(differ[p : p + k].sum()) for m, p, k in spans}


def test_pages_equal_loops(spark):
    rng = np.random.default_rng(3)
    data = {}
    for i in range(6):
        x = flash(rng, 1048576 if i == 5 else 524288)
        # Edits at page ends, in runs across pages, and in single places.
        for at in (0xFFF, 0x1000, 0x8000 + 0x1234 * (i % 7) - 1, *rng.integers(0x600, len(x) - 9000, 20).tolist()):
            x[at : at + int(rng.choice([1, 2, 5000]))] ^= int(rng.integers(1, 256))
        data[f"{i}.bin"] = x.tobytes()
    data |= {"copy.bin": data["0.bin"], "cut.bin": data["0.bin"][:300_001], "tiny.bin": b"\x07" * 10, "empty.bin": b"", "null.bin": None}
    odd = flash(rng)
    odd[0x514:0x518] = 0xFF  # a segment out of range
    data["odd.bin"], data["odd2.bin"] = odd.tobytes(), (odd ^ (np.arange(len(odd)) > 0x40000).astype(np.uint8)).tobytes()
    names = list(data)
    pairs = [(a, b) for a in names for b in names if a <= b] + [("0.bin", "1.bin"), ("0.bin", "gone.bin"), (None, "0.bin")]
    frame = spark.createDataFrame(list(data.items()), "path string, content binary")
    got = images.compare_images(spark.createDataFrame(pairs, "a string, b string"), frame).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(p for p in pairs if p[0] and p[1] in data)
    for r in got:
        total, regions = by_loop(data[r.a] or b"", data[r.b] or b"")
        assert (r.total_changed, r.identical) == (total, total == 0), (r.a, r.b)
        assert (None if r.regions is None else {x.name: x.changed for x in r.regions}) == regions, (r.a, r.b)
    assert not images.compare_images(spark.createDataFrame([], "a string, b string"), frame).count()


def test_only_wanted_pages_are_fetched(spark):
    rng = np.random.default_rng(4)
    contents = [(f"{i}", rng.integers(0, 256, 40_000).astype(np.uint8).tobytes()) for i in range(20)]
    frame = spark.createDataFrame(contents, "path string, content binary")
    digests = images.image_facts(frame).filter("path = '7'").selectExpr("explode(slice(digests, 9, 2)) as digest")
    got = {bytes(r.bytes) for r in images.fetch_pages(frame.unionByName(frame), digests).collect()}
    assert got == {contents[7][1][32768:36864], contents[7][1][36864:]}


def test_revisions_in_order(spark):
    rng = np.random.default_rng(5)
    base = flash(rng)
    second = base.copy()
    second[0x9000] ^= 1
    rows = [("car", "stock.bin", "s", base), ("car", "v010_b.bin", "t", second), ("car", "v002_a.bin", "u", base), ("car", "v1000.bin", "v", base), ("van", "v001.bin", "w", second)]
    frame = spark.createDataFrame([(v, n, p, x.tobytes()) for v, n, p, x in rows], "vehicle string, name string, path string, content binary")
    got = sorted((r.a, r.b, r.total_changed) for r in revisions.compare_revisions(frame).collect())
    assert got == [("s", "u", 0), ("t", "v", 1), ("u", "t", 1)]


def test_images_made_from_few_rows_spread_and_stay_out_of_plans(spark):
    from dynofleet.plans import flash

    made = flash.flash_images(spark, "/root/testdata/sf0.1")
    assert made.rdd.getNumPartitions() == 16  # before: the one of the supplier file
    assert len(made._jdf.queryExecution().toString()) < 200_000  # before: half a megabyte of zeros in each step
    sizes = {r[0]: r[1] for r in made.selectExpr("octet_length(content) as n").groupBy("n").count().collect()}
    assert sizes == {flash.SIZE: 857, flash.SHORT: 143}


def test_facts_of_segments_at_the_end(spark):
    data = np.zeros(524288, np.uint8)
    data[0x503] = 1
    ends = [(0, 1), (524286, 524287), (524280, 524288), (9, 9), (9, 8), (0xFFFFFFFF, 0xFFFFFFFF), (5, 524287)]
    data[0x514 : 0x514 + 56] = np.frombuffer(b"".join(a.to_bytes(4, "big") + b.to_bytes(4, "big") for a, b in ends), np.uint8)
    data[-2:] = 3
    (row,) = images.image_facts(spark.createDataFrame([("x", data.tobytes())], "path string, content binary")).collect()
    assert [s.start for s in row.spans] == [0, 0x4000, 0x20000, 0, 524286, None, None, None, None, 5]
    assert [s.cal_id for s in row.spans][3:] == [0, None, None, None, None, None, 0]
    assert len(row.digests) == 128 and row.os_id == 0
