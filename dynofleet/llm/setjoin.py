"""Exact Jaccard self-join of shingle sets, by universe-partition pigeonhole.

Sets are grouped into size bands so that two sets that reach the threshold lie in the same or in
neighbouring bands. A band pair has a bound H on the size of the symmetric difference. The universe
of hashes is cut into segments, and a set is indexed by what it holds in some of them:

* subsets: with H + 1 + E segments, two linked sets agree on at least E + 1 of them. Each set
  indexes its H + 1 heaviest segments (most tokens, ties by content). Among the segments on which
  two sets agree the heaviest can't be one of the E lightest of either, so it is indexed by both.
* one-deletion neighbourhoods: with H // 2 + 1 segments, some segment differs by one token at most;
  each set indexes its segments and all that are left by deleting one token.

Which layout, and how many spare segments E, is chosen for every band pair by cost: rows indexed and
pairs expected from chance, from the counts of distinct sets by band, which Spark has counted.

Equal sets collapse to one node before anything is compared. A group of nodes with one key is a star:
its most popular node, the pivot q, is compared with the others, so comparisons grow with index rows.
A pair is first tried on odd sketches (parities of hashed tokens): the bits in which they differ are at
most the tokens in which the sets differ, so what they exclude is excluded for certain, by a
thirtieth of the bytes. What passes is verified on the whole sets.

Stars whose other nodes lie in different components then go on. The others of a star are compared with one another
by sketch, in the join itself, as long as that costs less than their keys would: a comparison of two sketches
takes a KEY_COST-th of a key, so a node has at most 2 * KEY_COST * (H + 1) of them in a star, and what doesn't pass
makes no row. In larger stars the others are keyed by what they differ in from q. For x let P(x) be the tokens that q
lacks, and M(x) those of q that x lacks; links differ in H tokens at most, and of two nodes that both link to q
nothing more is asked.

* A pair that shares a token of P shares one of the H + 1 first ones, in hash order, of both.
* A pair that shares none differs in |P(x)| + |P(y)| + |M(x) ^ M(y)| <= H tokens. If x doesn't link to q,
  it follows that y has fewer tokens than q (|P(y)| < |M(y)|), that M(x) and M(y) overlap, and that they share one
  of the H - |P| + 1 first tokens of M of each. So x asks with these, and y answers with its own.

Nodes that don't link to q ask those that share a key, by sketch in the join again. Groups that hold the same nodes are
one group. Near copies of one text, changed in different places, share hardly any key; the comparisons left are
askers times holders of a key, which grows beyond the rows only where many texts share one edit and still link to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.llm.common import forget, sized_broadcast, stored
from dynofleet.llm.components import components
from dynofleet.llm.textops import Slice, distinct_by_text, mix, shingles, slices

#: Chance that a set holds a given token of another one; and what a candidate pair costs in index rows.
SHARED_TOKEN, PAIR_COST = 0.01, 20.0
#: Comparisons of two sketches in a join that cost as much as making and dealing out one key (measured: some 10 us and 0.1 us).
KEY_COST = 100
#: Tells the two halves of a key apart where a segment holds no token and both sums are 0.
_APART = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Layout:
    """How the band pair (band, band + 1) is indexed: ``keep`` of ``segments``, or all with one deletion."""

    segments: int
    keep: int
    deletions: bool


class Bands:
    """Size bands and the difference bound of neighbouring bands, for a threshold num / den."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * den // num + 1)
        self.lows = np.array(lows, dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def differ(self, band: int) -> int:
        """Largest symmetric difference of linked sets, the smaller one being in ``band``."""
        return (int(self.lows[band + 1]) - 1) * (self.den - self.num) // self.num

    def layouts(self, count_by_band: dict[int, int]) -> list[Layout | None]:
        return [self._layout(b, count_by_band.get(b, 0) + count_by_band.get(b + 1, 0)) for b in range(len(self.lows) - 1)]

    def _layout(self, band: int, nodes: int) -> Layout | None:
        h, size = self.differ(band), float(self.lows[band + 1] - 1)
        if h == 0 or nodes < 2:
            return None  # only equal sets, which are one node

        def chance(t: float, least: int, deletion: bool) -> float:
            # Poisson number of tokens in a segment; all of them must be shared, all but one with a deletion.
            p, out = math.exp(-t), 0.0
            for k in range(80):
                if k >= least:
                    out += p * (SHARED_TOKEN**k + (2 * k * SHARED_TOKEN ** (k - 1) if deletion and k else 0))
                p *= t / (k + 1)
            return out

        best, best_cost = Layout(h + 1, h + 1, False), math.inf
        for spare in sorted({0, 1, *(math.ceil(h * x) for x in (0.1, 0.2, 0.3, 0.4))}):
            m = h + 1 + spare
            t, p, below, least = size / m, math.exp(-size / m), 0.0, 0
            while below + p < spare / m:  # the lightest segments, as many as are spared
                below, least = below + p, least + 1
                p *= t / least
            cost = h + 1 + PAIR_COST * nodes * (h + 1) * chance(t, least, False)
            if cost < best_cost:
                best, best_cost = Layout(m, h + 1, False), cost
        m = h // 2 + 1
        cost = m + size + PAIR_COST * nodes * m * chance(size / m, 0, True)
        return Layout(m, m, True) if cost < best_cost else best


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))[bounds])


def text_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z lower-cased), and their offsets."""
    _, _, words, bounds = s.words(lower=True)
    return distinct_by_text(*shingles(words, bounds, k))


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums for each set."""
    one = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        return _sums(mix(values + one), bounds).view(np.int64), _sums(mix(values ^ one), bounds).view(np.int64)


def index_keys(values: np.ndarray, bounds: np.ndarray, bands: Bands, layouts: list[Layout | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, key, is the key a whole segment) for all sets and both band pairs of each."""
    if seed:
        with np.errstate(over="ignore"):
            values, bounds = distinct_by_text(mix(values + np.uint64(seed)), bounds)
    sizes = np.diff(bounds)
    band = bands.of(sizes)
    token = mix(values)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for below in (0, 1):
        pair = band - below
        of = [layouts[p] if 0 <= p < len(layouts) and n else None for p, n in zip(pair, sizes, strict=True)]
        m = np.array([x.segments if x else 0 for x in of], dtype=np.int64)
        use = np.repeat(m > 0, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[use]
        first = np.concatenate(([0], np.cumsum(m)))
        # Sorted hashes fall into rising segments, so every segment is a run.
        segment = first[owner] + ((values[use] >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(segment, minlength=int(first[-1]))
        at = np.concatenate(([0], np.cumsum(count)))
        held = token[use]
        total = _sums(held, at)
        seg_owner = np.repeat(np.arange(len(sizes)), m)
        seg_no = np.arange(int(first[-1])) - first[seg_owner]
        with np.errstate(over="ignore"):
            place = mix((pair[seg_owner].astype(np.uint64) << np.uint64(32)) + seg_no.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            key = mix(total + place) ^ mix(count.astype(np.uint64) + place + _APART)  # an empty segment keeps the key of its place
        order = np.lexsort((key, -count, seg_owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[seg_owner[order]]
        keep = np.array([x.keep if x else 0 for x in of], dtype=np.int64)
        chosen = rank < keep[seg_owner]
        out.append((seg_owner[chosen], key[chosen], np.ones(int(chosen.sum()), dtype=bool)))
        deletes = np.array([bool(x and x.deletions) for x in of])
        if deletes.any():
            drop = deletes[owner]
            s = segment[drop]
            with np.errstate(over="ignore"):
                less = mix(total[s] - held[drop] + place[s]) ^ mix((count[s] - 1).astype(np.uint64) + place[s] + _APART)
            out.append((owner[drop], less, np.zeros(len(less), dtype=bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def set_table(docs: DataFrame, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, d1, d2: size and digests of the shingle set of every text; then the columns ``also``."""
    more = T.StructType([docs.schema[c] for c in also])
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, n_shingles long, d1 long, d2 long").fields, *more.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                values, bounds = text_sets(s, k)
                d1, d2 = digests(values, bounds)
                part = batch.slice(s.lo, s.n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), *map(part.column, also)], names=["doc_id", "n_shingles", "d1", "d2", *also])

    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(work, schema)


def _index(docs: DataFrame, k: int, bands: Bands, layouts: list[Layout | None]) -> DataFrame:
    """key, doc: index rows of all texts; of equal sets in one slice only the first is indexed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for s in slices(batch.column("text")):
                values, bounds = text_sets(s, k)
                d1, _ = digests(values, bounds)
                _, first = np.unique(d1, return_index=True)
                alone = np.zeros(s.n, dtype=bool)
                alone[first] = True
                sizes = np.where(alone, np.diff(bounds), 0)
                values = values[np.repeat(alone, np.diff(bounds))]
                owner, key, _ = index_keys(values, np.concatenate(([0], np.cumsum(sizes))), bands, layouts)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[s.lo : s.hi][owner])], names=["key", "doc"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc is not null").mapInArrow(work, "key long, doc long")


def _shared(index: DataFrame) -> DataFrame:
    """Index rows whose key two texts hold; they may have the same set, or one doc_id.

    One exchange by key, sorted; a stream over the sorted rows that remembers one row tells them,
    so most rows end here and a common key takes no memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = waiting = None  # the key that goes on, and its doc while one row holds it so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            same = np.append(last is not None and key[0] == last, key[1:] == key[:-1])
            rows = np.flatnonzero(same | np.append(same[1:], False))
            keys, docs = key[rows], doc[rows]
            if same[0] and waiting is not None:
                keys, docs = np.append(keys, last), np.append(docs, waiting)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs)], names=["key", "doc"])
            # The last row waits if it began its key and nothing has followed it yet.
            waiting = None if same[-1] else doc[-1]
            last = key[-1]

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(work, "key long, doc long")


#: A set as a node: two digests of 64 bits.
NODE = "struct<d1: long, d2: long>"


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Odd sketches: bit i is the parity of the tokens hashed to i, over a power of two of bits, at least two a token and 64 * WORDS."""
    sizes = np.diff(bounds)
    bits = np.array([max(64 * WORDS, 1 << int(2 * n - 1).bit_length()) if n else 64 * WORDS for n in sizes], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(bits)))
    at = (mix(values ^ _APART) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], sizes)
    packed = np.packbits(np.bincount(at, minlength=int(first[-1])).astype(np.uint8) & 1, bitorder="little")
    return [packed[x:y].tobytes() for x, y in zip(first[:-1] // 8, first[1:] // 8, strict=True)]


def differ_at_least(one: np.ndarray, two: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the other's length."""
    if len(one) > len(two):
        one, two = two, one
    if len(two) > len(one):
        two = np.bitwise_xor.reduce(two.reshape(-1, len(one)))
    return int(np.bitwise_count(one ^ two).sum())


#: Words of a brief: a sketch folded so that it can stand in every row, of the size that sketches have at least.
WORDS = 16
BRIEF = "struct<" + ", ".join(f"w{i}: long" for i in range(WORDS)) + ">"


def _briefs(found: list[bytes]) -> pa.StructArray:
    folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, WORDS)) for x in found]
    words = np.concatenate(folded).reshape(-1, WORDS) if folded else np.zeros((0, WORDS), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)], names=[f"w{i}" for i in range(WORDS)])


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Do sizes and brief sketches of nodes x and y (columns n and brief with their names) allow a link?"""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    apart = F.lit(0)
    for i in range(WORDS):
        apart = apart + F.bit_count(F.col(f"brief{x}.w{i}").bitwiseXOR(F.col(f"brief{y}.w{i}")))
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (apart * (den + num) <= (nx + ny) * (den - num))


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, n, brief, sketch, held (the sorted shingle hashes) of ``nodes`` (node, doc); twice where rows repeat doc_id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                values, bounds = text_sets(s, k)
                d1, d2 = digests(values, bounds)
                node = batch.column("node").slice(s.lo, s.n)
                # Of rows with one doc_id only those that hold the set meant.
                same = (d1 == node.field("d1").to_numpy()) & (d2 == node.field("d2").to_numpy())
                held = [values[bounds[i] : bounds[i + 1]].tobytes() for i in range(s.n)]
                odd = sketches(values, bounds)
                part = pa.RecordBatch.from_arrays([node, pa.array(np.diff(bounds)), _briefs(odd), pa.array(odd, pa.binary()), pa.array(held, pa.binary())], names=["node", "n", "brief", "sketch", "held"])
                yield part.filter(pa.array(same))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    return texts.join(sized_broadcast(nodes), "doc").select("node", "text").mapInArrow(work, f"node {NODE}, n long, brief {BRIEF}, sketch binary, held binary")


def _with(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with sizes and ``column`` of both; sizes too far apart for a link are left to the caller."""
    of = lambda node: sets.select(F.col("node").alias(node), F.col("n").alias(f"n{node}"), F.col(column).alias(f"s{node}"))
    return pairs.join(of("b"), "b").join(of("a"), "a")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among pairs (a, b): by size, by sketch, then den * common >= num * union on the whole sets. Stored."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (den - num) // (den + num)
            ok = [differ_at_least(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= m for x, y, m in zip(batch.column("sa"), batch.column("sb"), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(one) - int(_only(one, two).sum())
                ok.append(den * common >= num * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pair = f"a {NODE}, b {NODE}"
    near = _with(pairs, sets, "sketch").filter(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    left = stored(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(sketched, pair))
    found = stored(_with(left, _of_pairs(left, sets), "held").select("a", "b", "sa", "sb").mapInArrow(whole, pair))
    forget(left)
    return found


def _of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that pairs (a, b) name."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return sets.join(sized_broadcast(named), "node", "left_semi")


def _only(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the sorted values ``one`` are not in ``two``."""
    if not len(two):
        return np.ones(len(one), dtype=bool)
    return two[np.minimum(np.searchsorted(two, one), len(two) - 1)] != one


def difference_keys(pivot: np.ndarray, other: np.ndarray, num: int, den: int, salt: np.uint64) -> tuple[np.ndarray, int, bool]:
    """Keys of a node by what it differs in from its pivot; how many of them are of P; does it link to the pivot?"""
    more, less = other[_only(other, pivot)], pivot[_only(pivot, other)]
    common = len(other) - len(more)
    linked = den * common >= num * (len(pivot) + len(other) - common)
    most = len(other) * (den - num) // num
    with np.errstate(over="ignore"):
        plus = np.sort(mix(more + salt))[: most + 1]
        minus = np.sort(mix(~less + salt))[: max(most - len(more) + 1, 0)] if not linked or len(more) < len(less) else plus[:0]
    return np.concatenate((plus, minus)), len(plus), linked


_KEYED = f"key long, node {NODE}, asks boolean, answers boolean"


def _keyed(star: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The keys of the others of stars (a: pivot, b: other)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, asks, answers = [], [], [], []
            salts = mix(batch.column("a").field("d1").to_numpy().view(np.uint64))
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                pivot, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                key, n_plus, linked = difference_keys(pivot, other, num, den, salts[i])
                keys.append(key)
                sizes.append(len(key))
                asks.append(not linked)
                answers.append((np.arange(len(key)) < n_plus) | (len(other) < len(pivot)))
            if not sizes:
                continue
            row = np.repeat(np.arange(batch.num_rows), sizes)
            cols = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("b").take(pa.array(row)), pa.array(np.array(asks)[row]), pa.array(np.concatenate(answers))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "asks", "answers"])

    return _with(star, _of_pairs(star, sets), "held").select("a", "b", "sa", "sb").mapInArrow(work, _KEYED)


def _once(groups: DataFrame, *flags: str) -> DataFrame:
    """key, n: one key of those whose groups hold the same nodes in the same roles."""
    one, two = F.xxhash64("node", *flags), F.xxhash64(F.lit(1), "node", *flags)
    return groups.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2")).filter("n > 1").groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", "n")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``rows`` with the component of ``node``: the node itself where no link is known."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def links(docs: DataFrame, table: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links (a, b) that connect what the threshold connects; a node is the pair of digests of a set.

    Rows that share a doc_id may hold different sets, so doc_id only says where to find one text of a
    set. Sets that only rows without doc_id hold have no links. ``table``: what ``set_table`` gives, stored. None where no two sets can be linked.
    """
    node = F.struct("d1", "d2").alias("node")
    known = table.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", node)
    nodes = stored(known.groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc")))
    largest = nodes.agg(F.max("n")).first()[0]
    if not largest:
        return None
    bands = Bands(num, den, largest)
    # One row a band: their number grows with the logarithm of the largest set.
    lows = [int(x) for x in bands.lows]
    band = F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= F.col("n"))) - 1
    counts = {r["band"]: r["count"] for r in nodes.groupBy(band.alias("band")).count().collect()}
    layouts = bands.layouts(counts)

    found = stored(_shared(_index(docs, k, bands, layouts)).join(known.select(F.col("doc_id").alias("doc"), "node"), "doc").select("key", "node").distinct())
    groups = stored(found.join(_once(found).select("key"), "key", "left_semi"))
    forget(found)
    sets = stored(_sets(docs, groups.select("node").distinct().join(nodes, "node").select("node", "doc"), k))

    # Every group and its most popular node, with which the others are compared.
    weight = groups.groupBy("node").agg(F.count("*").alias("weight"))
    pivots = groups.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    star = stored(groups.select("key", F.col("node").alias("b")).join(pivots, "key").filter("a <> b").select("a", "b").distinct())
    forget(groups)
    all_links = _verified(star, sets, num, den)
    labels = stored(components(all_links))

    # Stars whose other nodes lie in several components: compared among themselves, or keyed where that is cheaper.
    member = _labelled(star, labels, "b", "cb").join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("brief").alias("briefb")), "b")
    sized = member.groupBy("a").agg(F.count("*").alias("others"), F.min("nb").alias("least"), F.min("cb").alias("lo"), F.max("cb").alias("hi")).filter("lo < hi")
    few = F.col("others") - 1 <= 2 * KEY_COST * (F.floor(F.col("least") * (den - num) / num) + 1)
    member = stored(member.join(sized.select("a", few.alias("few")), "a"))
    side = lambda x: [F.col("b").alias(x), F.col("cb").alias(f"c{x}"), F.col("nb").alias(f"n{x}"), F.col("briefb").alias(f"brief{x}")]
    small, others = member.filter("few").select("a", *side("x")), member.filter("few").select(F.col("a").alias("star"), *side("y"))
    apart = (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _may_link("x", "y", num, den)
    rest = small.join(others, (F.col("a") == F.col("star")) & apart).select(F.col("x").alias("a"), F.col("y").alias("b"))

    keyed = stored(_keyed(member.filter("not few").select("a", "b"), sets, num, den).distinct())
    held = _labelled(keyed, labels, "node", "label")
    asked = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("asks").alias("ask"), F.max("answers").alias("answer")).filter("lo < hi and ask and answer")
    live = asked.join(_once(keyed, "asks", "answers"), "key", "left_semi").select("key")
    groups = stored(held.join(live, "key", "left_semi").join(sets.select("node", F.col("n").alias("nb"), F.col("brief").alias("briefb")), "node").select("key", F.col("node").alias("b"), F.col("label").alias("cb"), "nb", "briefb", "asks", "answers"))
    askers, holders = groups.filter("asks").select("key", *side("x")), groups.filter("answers").select(F.col("key").alias("same"), *side("y"))
    more = askers.join(holders, (F.col("key") == F.col("same")) & (F.col("cx") != F.col("cy")) & _may_link("x", "y", num, den)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = rest.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    all_links = all_links.unionByName(_verified(pairs, sets, num, den))
    for x in (star, member, keyed, groups, labels, nodes, sets):
        forget(x)
    return all_links


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are runs outside 0x20 and 0x09-0x0D, A-Z lower-cased; a set is the distinct ``k``-word
    shingles, or all words as one where there are fewer. Sets link when den * common >= num * union.
    component_id is the smallest doc_id that links reach. Null, empty and blank texts have no
    shingles and are alone; equal rows are in one component; an empty table gives no rows.
    Sets are compared by 64-bit hashes of shingles (two sets of n share one by chance in n * n of 2 ** 64
    cases); equal sets are found by 128 bits of digest.
    """
    return grouped(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, k: int, num: int, den: int, also: tuple[str, ...] = ()) -> DataFrame:
    """What ``near_duplicates`` gives, the columns ``also``, and ``group_id``, which tells components apart.

    Two components may have one smallest doc_id, as rows that share a doc_id may hold different texts.
    group_id is null where there are no shingles.
    """
    sized = stored(set_table(docs, k, also))
    found = links(docs, sized, k, num, den)
    nodes = sized.filter("n_shingles > 0").groupBy(F.struct("d1", "d2").alias("node")).agg(F.min("doc_id").alias("component"), F.count("*").alias("copies"))
    if found is not None:
        # Of every linked node the smallest node and doc_id that links reach.
        reached = stored(components(found).select("node", F.col("component").alias("head")))
        smallest = reached.join(nodes, "node").groupBy("head").agg(F.min("component").alias("smallest"))
        nodes = nodes.join(reached.join(smallest, "head"), "node", "left")
    else:
        nodes = nodes.withColumn("head", F.lit(None).cast(NODE)).withColumn("smallest", F.lit(None).cast("long"))
    # Sets that stand alone need no join: the rest is what has copies or links.
    known = nodes.filter("copies > 1 or head is not null").select("node.d1", "node.d2", F.coalesce("smallest", "component").alias("component"), F.coalesce("head", "node").alias("group"))
    group = F.when(F.col("n_shingles") > 0, F.coalesce("group", F.struct("d1", "d2"))).alias("group_id")
    return sized.join(known, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), group, *also)
