"""Repair of conversations: the cheapest edits after which roles alternate, blank and repeated rows are gone.

Roles count by their initial: s, u, a, or others. A conversation is in order if its initials read ``(s?(ua)+)?``. The edits are
K (keep, 0), R (set the role to user or assistant, 3), D (delete, 4; the only one for blank and duplicate rows) and I (insert
an empty user or assistant row, 3); a truncated row that stays costs 3 more. Of equally cheap edits the ASCII-least win.

A row is one symbol out of nine (initial and fault), and a conversation a string of symbols. A symbol acts on the
four states of the pattern as a matrix over (cost, edits): its product is the sum of costs and the concatenation of edits, its
sum the smaller cost, then the lesser edits. (Two different edits of equal cost over the same rows are never one the
beginning of the other, as a further I would cost more; so the lesser stays the lesser whatever follows, and products may
be taken in any order.) Re-Pair replaces the most frequent pairs of symbols by new ones, round after round; each rule
gets the product of its two sides' matrices once, and every conversation is the product of what is left of its string.
Equal strings are worked out once.

At scale: rows without text are brought in order by range, so a conversation of any length spreads over tasks; each task
cuts its part into pieces of SEGMENT symbols at most, and pieces of one conversation are multiplied in a tree. Identical rows are
counted before they are shuffled. Texts move once, to be hashed in order: that is one stream a conversation, as
SHA-256 is, and holds a row and the edits.

Nulls: conv_id null is a conversation of its own; a null role or text is one space; a null turn comes first. Rows of one turn
stand by role and then by ``digest``, so repeated rows are next to each other. A conversation without rows
after damage has zeros, empty edits and the hash of the empty string. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.llm.common import stored

#: Symbols of one piece of a conversation; pieces that are multiplied in one step.
SEGMENT, FAN = 4096, 32
#: Rounds of Re-Pair, and rules that each may add.
ROUNDS, RULES = 8, 24
DELETE, INSERT, RETAG, CUT = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a; and where a row of an initial leads.
STATES, ENDS = 4, (0, 3)
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEVER = 1 << 60

Matrix = tuple[tuple[tuple[int, str], ...], ...]


def symbol_matrix(symbol: str) -> Matrix:
    """What the row of ``symbol`` costs between states, inserts before it included. Capitals are truncated, x has to go."""
    best = [[(NEVER, "")] * STATES for _ in range(STATES)]
    for p in range(STATES):
        reach = {p: (0, "")}
        for _ in range(STATES - 1):
            for a, (cost, edits) in list(reach.items()):
                for to in {b for initial in "ua" for b in [MOVES[initial].get(a)] if b is not None}:
                    reach[to] = min(reach.get(to, (NEVER, "")), (cost + INSERT, edits + "I"))
        for a, (cost, edits) in reach.items():
            ways = [(a, DELETE, "D")] if symbol else [(a, 0, "")]
            if symbol and symbol != "x":
                more = CUT if symbol.isupper() else 0
                ways += [(to, more, "K") for to in [MOVES.get(symbol.lower(), {}).get(a)] if to is not None]
                ways += [(to, RETAG + more, "R") for initial in "ua" for to in [MOVES[initial].get(a)] if to is not None]
            for to, extra, edit in ways:
                best[p][to] = min(best[p][to], (cost + extra, edits + edit))
    return tuple(map(tuple, best))


def product(left: Matrix, right: Matrix) -> Matrix:
    """Of every two states the cheapest way through both, the ASCII-least among equals."""
    return tuple(
        tuple(min((row[k][0] + right[k][q][0], row[k][1] + right[k][q][1]) for k in range(STATES)) if any(row[k][0] < NEVER and right[k][q][0] < NEVER for k in range(STATES)) else (NEVER, "") for q in range(STATES)) for row in left
    )


SYMBOLS = "suaoSUAOx"
LAST = symbol_matrix("")  # after the last row only inserts are left


class Grammar:
    """Rules of Re-Pair, in order, and a matrix for every symbol and rule."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrices: dict[str, Matrix] = {s: symbol_matrix(s) for s in SYMBOLS}

    def add(self, pair: str) -> None:
        name = chr(0xE000 + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        out = None
        for s in self.compress(symbols):
            out = self.matrices[s] if out is None else product(out, self.matrices[s])
        return out or tuple(tuple((0, "") if p == q else (NEVER, "") for q in range(STATES)) for p in range(STATES))


def outcome(m: Matrix) -> tuple[int, str]:
    """Cost and edits of a whole conversation: from nothing to an end of the pattern, inserts at the end included."""
    return min(product(m[:1], LAST)[0][q] for q in ENDS)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage by crc32(``conv_id:turn``) % 20; dropped ones have no copies."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def digest() -> Column:
    """What two rows share if role and text are equal, and where rows of one turn and role stand."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, symbol, blank, first: one row for all identical ones, without text.

    ``first``: no equal role and text stands at an earlier turn of the conversation.
    """
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    light = rows.select("conv_id", "turn", "role", digest().alias("digest"), (last == "").alias("blank"), F.when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter)).alias("symbol"), "copies")
    one = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("symbol").alias("symbol"))
    one = stored(one)  # read three times
    kept = one.filter("n > 0 and not blank")
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    starts = kept.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(turn).alias("start"))
    # A plain join on conversation and digest: partial minima first, and large keys are split by AQE.
    marked = kept.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).withColumn("first", turn == F.col("start")).drop("c", "d", "start")
    return marked.unionByName(one.filter("n = 0 or blank").withColumn("first", F.lit(False)))


_PIECE = "part int, piece long, symbols string, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low_turn long, high_turn long, first_role string, last_role string"


def pieces(ordered: DataFrame) -> DataFrame:
    """Pieces of conversations from rows in order: symbols, counts and what stands at their ends."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_PIECE}"
    target = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _PIECE.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, started, conv = TaskContext.get().partitionId(), 0, False, None
        done: list[tuple] = []
        symbols: list[str] = []
        counts = [0] * 5  # blank, duplicate, truncated, illegal, turns
        low = high = first = last = None

        def close() -> None:
            nonlocal symbols, counts, low, high, first, last, piece
            done.append((conv, part, piece, "".join(symbols), len(symbols), *counts, low, high, first, last))
            piece += 1
            symbols, counts, low, high, first, last = [], [0] * 5, None, None, None, None

        def emit(like: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * (len(target) + 1)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like.type), *(pa.array(c, f.type) for c, f in zip(columns[1:], target, strict=True))], ["conv_id", *target.names])

        like = None
        for b in batches:
            like = b.column(0)
            for c, turn, n, blank, new, symbol in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not started or c != conv:
                    if started:
                        close()
                    conv, started = c, True
                role = symbol.lower()
                for k in range(n):
                    if len(symbols) == SEGMENT:
                        close()
                    fault = 0 if blank else 1 if k or not new else 2 if symbol.isupper() else None
                    if fault is not None:
                        counts[fault] += 1
                    symbols.append("x" if fault in (0, 1) else symbol)
                    if last is not None and last + role not in ("su", "ua", "au"):
                        counts[3] += 1
                    if turn is not None and turn != high:
                        counts[4] += 1
                        low, high = turn if low is None else low, turn
                    first, last = first or role, role
            yield emit(like)
        if started:
            close()
            yield emit(like)

    return ordered.mapInArrow(task, schema)


def learn_grammar(strings: DataFrame) -> Grammar:
    """Re-Pair over the distinct strings of all conversations: every round counts all pairs and names the most frequent ones.

    The driver sees counts of pairs of symbols, of which there are at most the square of symbols and rules.
    """
    grammar = Grammar()
    for _ in range(ROUNDS):
        rules = grammar

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter = Counter()
            for b in batches:
                for s in b["symbols"]:
                    s = rules.compress(s)
                    found.update(map("".join, zip(s, s[1:])))
            yield pd.DataFrame(found.items(), columns=["pair", "n"])

        top = strings.select("symbols").mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        top = top.orderBy(F.desc("n"), "pair").limit(4 * RULES).collect()
        heads, tails, added = set(), set(), 0
        for r in top:  # pairs that don't compete for the same symbols in this round
            a, b = r.pair
            if a not in tails and b not in heads and added < RULES:
                heads.add(a)
                tails.add(b)
                grammar.add(r.pair)
                added += 1
        if not added:
            break
    return grammar


_CELLS = "cost array<long>, edits array<string>"


def _flat(m: Matrix) -> tuple[list[int], list[str]]:
    return [c for row in m for c, _ in row], [e for row in m for _, e in row]


def _matrix(cost, edits) -> Matrix:
    return tuple(tuple((int(cost[STATES * p + q]), edits[STATES * p + q]) for q in range(STATES)) for p in range(STATES))


def solved(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """symbols, total and audit (cost and edits if the string is a whole conversation), and its matrix."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [grammar.matrix(s) for s in b["symbols"]]
            whole = [outcome(m) for m in found]
            flat = [_flat(m) for m in found]
            yield pd.DataFrame({"symbols": b["symbols"], "total": [w[0] for w in whole], "audit": [w[1] for w in whole], "cost": [f[0] for f in flat], "edits": [f[1] for f in flat]})

    return strings.select("symbols").mapInPandas(task, f"symbols string, total long, audit string, {_CELLS}")


def _multiplied(parts: DataFrame, kind: str) -> DataFrame:
    """conv_id, total, audit of conversations in several pieces: FAN following matrices become one, round after round."""
    parts = stored(parts)
    while parts.agg(F.max("k")).first()[0]:

        def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = None
            for cost, edits in rows.sort_values("k")[["cost", "edits"]].itertuples(index=False):
                m = _matrix(cost, edits)
                out = m if out is None else product(out, m)
            cost, edits = _flat(out)
            return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "k": [int(key[1])], "cost": [cost], "edits": [edits]})

        up = F.floor(F.col("k") / FAN).cast("long")
        parts = stored(parts.withColumn("up", up).groupBy("conv_id", "up").applyInPandas(step, f"conv_id {kind}, k long, {_CELLS}"))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [outcome(_matrix(c, e)) for c, e in zip(b.column("cost").to_pylist(), b.column("edits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.string())], ["conv_id", "total", "audit"])

    return parts.select("conv_id", "cost", "edits").mapInArrow(end, f"conv_id {kind}, total long, audit string")


def repaired_hashes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` (conv_id, audit, ...) with repaired_sha256: each conversation's edits lead its rows in one sorted stream."""
    rest = [c for c in plans.columns if c not in ("conv_id", "audit")]
    lines = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest().alias("digest"), "text", "copies", F.lit(None).cast("string").alias("audit"), *(F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in rest))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), "audit", *rest)
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    stream = stream.select("conv_id", "kind", "role", "text", "copies", "audit", *rest)
    fields = [stream.schema["conv_id"], *(stream.schema[c] for c in rest)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", audit string, repaired_sha256 string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, audit, at, length, place = None, None, "", 0, 0, 0
        hashes: list[str] = []

        def say(role: str, text: str) -> None:
            nonlocal place
            state.update(f"{'' if not place else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            place += 1

        def turn_of() -> str:
            return "user" if (place + odd) % 2 == 0 else "assistant"

        def inserts() -> None:
            nonlocal at
            while at < length and audit[at] == "I":
                say(turn_of(), "")
                at += 1

        odd = 0
        for b in batches:
            kinds = b.column(1).to_numpy()
            heads_at = np.flatnonzero(kinds == 0).tolist()
            closed, hashes = [], []
            roles, texts, copies, audits = b.column(2), b.column(3), b.column(4).to_numpy(), b.column(5)
            for i in range(b.num_rows):
                if kinds[i] == 0:
                    if state is not None:
                        inserts()
                        closed.append(held)
                        hashes.append(state.hexdigest())
                    state, audit, at, place = hashlib.sha256(), audits[i].as_py(), 0, 0
                    length, odd = len(audit), (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with s
                    held = pa.RecordBatch.from_arrays([c.slice(i, 1) for c in b.columns], b.schema.names)  # batches differ in what may be null
                    continue
                role, text = None, None
                for _ in range(copies[i]):
                    inserts()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        text = texts[i].as_py() if text is None else text
                        role = roles[i].as_py() if role is None else role
                        say(role if edit == "K" else turn_of(), text)
            if closed:
                yield _heads(closed, hashes)
            if heads_at:
                held = pa.RecordBatch.from_arrays([c.take(pa.array([0])) for c in held.columns], held.schema.names)  # not the whole batch
        if state is not None:
            inserts()
            yield _heads([held], [state.hexdigest()])

    def _heads(rows: list[pa.RecordBatch], hashes: list[str]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        columns = [t.column("conv_id"), *(t.column(c) for c in rest), t.column("audit"), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *rest, "audit", "repaired_sha256"])

    return stream.mapInArrow(task, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost, edits and the hash of what they make of it."""
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    light = stored(facts(rows).withColumn("turn", F.col("turn").cast("long")))
    spread = max(8, 2 * int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("conv_id", "turn", "role", "digest")
    ordered = light.repartitionByRange(spread, *order).sortWithinPartitions(*order).select("conv_id", "turn", "n", "blank", "first", "symbol")
    cut = stored(pieces(ordered))
    strings = stored(cut.select("symbols").distinct())
    found = stored(solved(strings, learn_grammar(strings)))
    # Neighbouring pieces may share a turn or meet in an illegal pair; rows of no length stand for conversations without rows.
    w = Window.partitionBy("conv_id").orderBy("part", "piece")
    there = cut.filter("rows > 0").withColumns({"k": F.row_number().over(w) - 1, "many": F.count("*").over(Window.partitionBy("conv_id")), "before": F.lag("last_role").over(w), "until": F.max("high_turn").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    seam = F.when(F.col("before").isNotNull() & ~F.concat("before", "first_role").isin("su", "ua", "au"), 1).otherwise(0)
    again = F.when(F.col("until") == F.col("low_turn"), 1).otherwise(0)
    there = there.join(found.select("symbols", "total", "audit"), "symbols")
    total = lambda c: F.sum(c).cast("long").alias(c)
    counts = there.withColumns({"illegal": F.col("illegal") + seam, "turns": F.col("turns") - again}).groupBy("conv_id").agg(
        *map(total, ("blank", "duplicate", "truncated", "illegal")),
        F.coalesce(F.max("high_turn") - F.min("low_turn") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        F.max(F.when(F.col("many") == 1, F.struct("total", "audit"))).alias("one"),
    )
    parts = there.filter("many > 1").drop("total", "audit").join(found.select("symbols", "cost", "edits"), "symbols").select("conv_id", F.col("k").cast("long"), "cost", "edits")
    long_ = _multiplied(parts, kind).withColumnRenamed("conv_id", "c").select("c", F.struct("total", "audit").alias("several"))
    none = cut.groupBy("conv_id").agg(F.max("rows").alias("m")).filter("m = 0").select("conv_id")
    zero = F.lit(0).cast("long")
    plans = counts.join(long_, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumn("plan", F.coalesce("one", "several"))
    plans = plans.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("plan.total").alias("cost"), F.col("plan.audit").alias("audit"))
    plans = plans.unionByName(none.select("conv_id", *(zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit")))
    out = repaired_hashes(rows, stored(plans))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
