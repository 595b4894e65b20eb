"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics of a text are built-in functions over its own words, without an exchange: repeated
windows are found by hashing every five-word window, and only texts in which a hash comes twice
sort them. The list is learned by sequential covering: Spark counts labelled rows by statistic,
bin and label; from these few counts the driver picks the next condition; a rule is grown on two
thirds of the rows, cut back on the rest, and its rows leave before the next one is sought.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Statistics that conditions are about, as expressions over the struct that ``measured`` adds.
STATISTICS = {
    "symbols_per_word": "n_symbols / n_words",
    "symbols_per_char": "n_symbols / word_chars",
    "word_length": "word_chars / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "shouts_per_word": "n_shouts / n_words",
    "distinct_words_share": "n_distinct_words / n_words",
    "repeated_words_share": "n_repeat_words / n_words",
    "dup_lines_share": "n_dup_lines / n_lines",
    "n_words": "n_words",
}


def _count_of(text: Column, chars: str) -> Column:
    """How often single-byte characters occur."""
    out = F.lit(0).cast("long")
    for c in chars:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out


def measured(docs: DataFrame, name: str = "_m") -> DataFrame:
    """Adds the struct ``name`` with the counts of every whole text (null: no words, all counts 0).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines (lines with a word),
    n_capitals, n_digits, n_shouts, n_distinct_words. Columns of ``docs`` with such names stay as they are.
    """
    text, words, grams = F.col("_q_text"), F.col("_q_words"), F.col("_q_grams")
    window = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    trimmed = F.btrim(text, F.lit(SPACES))
    step1 = docs.withColumn("_q_text", F.coalesce(F.col("text"), F.lit("")))
    step2 = step1.withColumns(
        {
            "_q_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
            "_q_lines": F.filter(F.split(text, "\n"), has_word),
        }
    )
    step3 = step2.withColumn(
        "_q_grams",
        F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")),
    )
    # Windows with their places in order of hash, only where some hash comes twice.
    step4 = step3.withColumn(
        "_q_sorted",
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    s = F.col("_q_sorted")
    twice = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
    step5 = step4.withColumn("_q_places", F.when(s.isNotNull(), F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))))
    # Each window covers five words; those that the window before has covered count once.
    covered = F.aggregate(
        "_q_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    lines = F.col("_q_lines")
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        (F.char_length(text) - _count_of(text, SPACES)).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace(text, "[^0-9]+", "")).cast("long").alias("n_digits"),
        _count_of(text, "!?").alias("n_shouts"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
    )
    # Through an array of one: else a later filter on the counts is pushed below and computes them all again.
    return step5.withColumn(name, F.explode(F.array(counts))).drop("_q_text", "_q_words", "_q_lines", "_q_grams", "_q_sorted", "_q_places")


def base_failed(name: str = "_m") -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    n = F.col(f"{name}.n_words")
    return (n < 10) | (100 * F.col(f"{name}.n_repeat_words") > 20 * n)


def _statistic(which: str, name: str = "_m") -> Column:
    """The value of a statistic; 0 where its divisor is 0."""
    parts = [F.col(f"{name}.{p}").cast("double") for p in STATISTICS[which].split(" / ")]
    return parts[0] if len(parts) == 1 else F.coalesce(F.try_divide(parts[0], parts[1]), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def holds(self, name: str = "_m") -> Column:
        value = _statistic(self.statistic, name)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, name: str = "_m") -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(name)
    return out


def verdict(rules: list[Rule], name: str = "_m") -> Column:
    """The list as one ordered conditional: a row that meets a rule goes, any other row stays."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(_all(rule, name), False)
    return out.otherwise(True)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    bins: int = 40,
    max_rules: int = 8,
    max_conditions: int = 3,
    least_rows: int = 5,
    clean_share: float = 0.02,
) -> list[Rule]:
    """Learns rules for label 0 of ``quality`` from at most ``fit_rows`` labelled rows, none of them held out.

    The rows are chosen by a hash of doc_id. A rule is kept if at least ``least_rows`` bad rows and
    at most ``clean_share`` of good ones are among those that it takes. No labels, or no bad rows
    left: no (more) rules.
    """
    chosen = (
        labels.filter(~held_out() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = stored(rows.select("_m", "good", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune")))
    names = list(STATISTICS)
    cuts_at = [k / bins for k in range(1, bins)]
    of_all = [F.percentile_approx(_statistic(s), F.array(*map(F.lit, cuts_at)), 2000).alias(f"q{i}") for i, s in enumerate(names)]
    of_bad = [F.percentile_approx(F.when(F.col("good") == 0, _statistic(s)), F.array(*map(F.lit, cuts_at[::4])), 2000).alias(f"b{i}") for i, s in enumerate(names)]
    found = rows.agg(*of_all, *of_bad).first()
    cuts = [sorted({*(found[f"q{i}"] or []), *(found[f"b{i}"] or [])}) for i in range(len(names))]
    # Bin of a value: how many cuts lie below it, so "value <= cut k" is "bin <= k".
    below = lambda v: lambda cut: cut < v
    bin_of = lambda i: F.size(F.filter(F.array(*map(F.lit, cuts[i])), below(_statistic(names[i]))))
    binned = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), bin_of(i).alias("bin"), _statistic(names[i]).alias("value")) for i in range(len(names)) if cuts[i])))
    rules: list[Rule] = []
    while cuts != [[]] * len(names) and len(rules) < max_rules:
        left = rows.filter(verdict(rules))
        rule: Rule = ()
        while len(rule) < max_conditions:
            grown = left.filter(~F.col("prune") & _all(rule)).select("good", binned.alias("x")).groupBy("x.f", "x.bin", "good")
            counts = grown.agg(F.count("*").alias("count"), F.min("x.value").alias("lo"), F.max("x.value").alias("hi")).collect()
            best = _best_condition(counts, names, cuts)
            if best is None:
                break
            # The cut moves to the middle of the gap between the values on its two sides.
            f = names.index(best.statistic)
            k = cuts[f].index(best.cut)
            lo, hi = max(r["hi"] for r in counts if r["f"] == f and r["bin"] <= k), min(r["lo"] for r in counts if r["f"] == f and r["bin"] > k)
            rule = (*rule, Condition(best.statistic, best.above, (lo + hi) / 2))
        rule, bad, good = _cut_back(left, rule)
        if not rule or bad < least_rows or good > clean_share * (bad + good):
            break
        rules.append(rule)
    return rules


def _best_condition(counts: list, names: list[str], cuts: list[list[float]]) -> Condition | None:
    """The condition of the greatest information gain over what the rule takes now (FOIL's measure)."""
    tally = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in range(len(names))}
    for r in counts:
        tally[r["f"]][r["bin"]][1 if r["good"] else 0] += r["count"]
    best, best_gain = None, 1e-6
    for f, by_bin in tally.items():
        bad, good = (sum(x[k] for x in by_bin) for k in (0, 1))
        if not bad or not good:
            continue
        before = math.log2(bad / (bad + good))
        low = [0, 0]
        for k, cut in enumerate(cuts[f]):
            low = [low[0] + by_bin[k][0], low[1] + by_bin[k][1]]
            for above, (b, g) in ((False, low), (True, [bad - low[0], good - low[1]])):
                gain = b * (math.log2(b / (b + g)) - before) if b else 0
                if gain > best_gain:
                    best, best_gain = Condition(names[f], above, cut), gain
    return best


def _cut_back(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The shortest beginning of the rule with the best (bad - good) / (bad + good) on rows it wasn't grown on; and how
    many bad and good ones of all rows it takes. One pass."""
    if not rule:
        return rule, 0, 0
    tallies = []
    for k in range(1, len(rule) + 1):
        hit, bad = _all(rule[:k]), F.col("good") == 0
        tallies += [F.count_if(hit & bad & F.col("prune")).alias(f"b{k}"), F.count_if(hit & ~bad & F.col("prune")).alias(f"g{k}"), F.count_if(hit & bad).alias(f"all_b{k}"), F.count_if(hit & ~bad).alias(f"all_g{k}")]
    found = rows.agg(*tallies).first()
    worth = {k: (found[f"b{k}"] - found[f"g{k}"]) / max(1, found[f"b{k}"] + found[f"g{k}"]) for k in range(1, len(rule) + 1)}
    best = max(worth, key=lambda k: (worth[k], -k))
    return rule[:best], found[f"all_b{best}"], found[f"all_g{best}"]


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed and kept (false if base_failed, else the list's verdict) of every row."""
    failed = base_failed()
    return measured(docs.select("doc_id", "text")).select(
        "doc_id",
        *(F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )
