"""Which column of a log plays which role, which of them carry data, and in what units.

log_channel: log_id, ordinal, header. log_sample: log_id, row_no, ordinal, value_num, value_str.
Roles are not exclusive: one column can play two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.functions.roles import BANKS, FLAGS, PATTERNS, REQUIRED
from dynofleet.functions.units import detect_unit, flag_on, quantity_of


def role_candidates(channels: DataFrame) -> DataFrame:
    """log_id, role, ordinal, header: every column that fits a role. No join: the patterns are constants."""
    roles = F.filter(
        F.array(*(F.when(F.col("header").rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(role)) for role, ps in PATTERNS.items())), lambda r: r.isNotNull()
    )
    return channels.select("log_id", F.explode(roles).alias("role"), "ordinal", "header")


def detect_roles(channels: DataFrame) -> DataFrame:
    """log_id, role, ordinals: the lowest column of a role, all of them for trims."""
    out = role_candidates(channels).groupBy("log_id", "role").agg(F.sort_array(F.collect_set("ordinal")).alias("o"))
    return out.select("log_id", "role", F.when(F.col("role").isin(*BANKS), F.col("o")).otherwise(F.slice("o", 1, 1)).alias("ordinals"))


def live_columns(samples: DataFrame) -> DataFrame:
    """log_id, ordinal of the columns with a number at least once; one pass for all roles."""
    return samples.filter("value_num is not null").select("log_id", "ordinal").distinct()


def live_channels(channels: DataFrame, samples: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """log_id, role, ordinal, header of the columns in use: the first live candidate, every live bank.

    ``overrides`` (log_id, role, ordinal) replace a role's candidates; a dead override leaves it unused.
    """
    found = role_candidates(channels)
    if overrides is not None:
        named = overrides.join(channels, ["log_id", "ordinal"]).select("log_id", "role", "ordinal", "header")
        found = found.join(overrides.select("log_id", "role"), ["log_id", "role"], "left_anti").unionByName(named)
    live = found.join(live_columns(samples), ["log_id", "ordinal"], "left_semi")
    w = Window.partitionBy("log_id", "role").orderBy("ordinal")
    ranked = live.withColumn("k", F.row_number().over(w))
    return ranked.filter(F.col("role").isin(*BANKS) | (F.col("k") == 1)).select("log_id", "role", "ordinal", "header")


def silent_channels(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """log_id, role, header, superseded: columns of a role without a number.

    ``superseded``: the live column used instead, null if there is none (then only the role's first
    column is reported); trims are reported only where all banks are dead.
    """
    found = role_candidates(channels)
    used = live_channels(channels, samples).groupBy("log_id", "role").agg(F.min_by("header", "ordinal").alias("superseded"))
    dead = found.join(live_columns(samples), ["log_id", "ordinal"], "left_anti").join(used, ["log_id", "role"], "left")
    w = Window.partitionBy("log_id", "role").orderBy("ordinal")
    ranked = dead.withColumn("k", F.row_number().over(w))
    keep = F.when(F.col("superseded").isNull(), F.col("k") == 1).otherwise(~F.col("role").isin(*BANKS))
    return ranked.filter(keep).select("log_id", "role", "header", "superseded")


def empty_channels(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """Columns without any number."""
    return channels.join(live_columns(samples), ["log_id", "ordinal"], "left_anti").select("log_id", "ordinal", "header")


def missing_roles(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """log_id, role: required roles that no live column plays."""
    wanted = channels.select("log_id").distinct().select("log_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("role"))
    return wanted.join(live_channels(channels, samples), ["log_id", "role"], "left_anti")


def channel_units(used: DataFrame) -> DataFrame:
    """Adds unit, quantity and whether it can be converted, as the header states it."""
    unit = detect_unit(F.col("header"))
    return used.withColumn("unit", unit).withColumn("quantity", quantity_of(F.col("unit"))).withColumn("convertible", F.col("quantity").isNotNull())


def bank_average(used: DataFrame, samples: DataFrame) -> DataFrame:
    """log_id, row_no, role, value: samples by role, the mean of the banks that a row carries."""
    rows = samples.filter("value_num is not null").join(used.select("log_id", "role", "ordinal"), ["log_id", "ordinal"])
    return rows.groupBy("log_id", "row_no", "role").agg((F.sum(F.col("value_num").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("value"))


def wide_log(used: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per log row and one column per role, null where the role is not there.

    Flags are boolean, set by a number or a word; trims are the mean of the banks that a row carries.
    One aggregation by row, so a log is shuffled once; rows without a sample of any role are kept.
    """
    rows = samples.join(used.select("log_id", "role", "ordinal"), ["log_id", "ordinal"], "left")
    number = F.col("value_num")

    def of(role: str) -> Column:
        here = F.col("role") == role
        if role in FLAGS:
            return F.max(F.when(here, flag_on(number, F.col("value_str"))))
        if role in BANKS:
            return F.sum(F.when(here, number.cast("decimal(18,6)"))).cast("double") / F.count_if(here & number.isNotNull())
        return F.max(F.when(here, number))

    columns = [(F.when(F.count_if((F.col("role") == r) & number.isNotNull()) > 0, of(r)) if r in BANKS else of(r)).alias(r) for r in PATTERNS]
    return rows.groupBy("log_id", "row_no").agg(*columns)


def wide_rows(used: DataFrame, rows: DataFrame) -> DataFrame:
    """``wide_log`` of ``logs.parse_rows``: columns are picked from the arrays of a row, so rows meet only where their log's channels stand."""
    role, at = F.col("role"), F.col("ordinal").cast("int")
    of = lambda r: F.collect_list(F.when(role == r, at)) if r in BANKS else F.min(F.when(role == r, at))
    places = used.groupBy("log_id").agg(*(of(r).alias(f"at_{r}") for r in PATTERNS))
    value = lambda i: F.get("values", i)
    cents = lambda x: x.cast("decimal(18,6)")

    def column(r: str) -> Column:
        place = F.col(f"at_{r}")
        if r in FLAGS:
            return F.when(place < F.size("values"), flag_on(value(place), F.get("words", place)))  # null in rows too short to hold it
        if r in BANKS:
            there = F.filter(F.transform(place, value), lambda x: x.isNotNull())
            total = F.aggregate(there, F.lit(0).cast("decimal(28,6)"), lambda acc, x: (acc + cents(x)).cast("decimal(28,6)"))
            mean = F.when(F.size(there) > 0, total.cast("double") / F.size(there))
            return F.when(F.size(place) == 1, cents(value(F.get(place, F.lit(0)))).cast("double")).otherwise(mean)
        return value(place)

    return rows.join(places, "log_id", "left").select("log_id", "row_no", *(column(r).alias(r) for r in PATTERNS))


def live_cells(rows: DataFrame) -> DataFrame:
    """``live_columns`` of ``logs.parse_rows``."""
    return rows.select("log_id", F.posexplode("values").alias("ordinal", "value_num")).filter("value_num is not null").select("log_id", "ordinal").distinct()


def log_density(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """log_id, rows, density (3 places) and sparse: filled cells of rows x headers, sparse below 0.9 before rounding.

    ``samples``: log_sample, or what ``logs.parse_rows`` gives.
    """
    n = channels.groupBy("log_id").agg(F.count("*").alias("headers"))
    if "filled" in samples.columns:
        counts = [F.sum("filled").alias("filled"), F.count("*").alias("rows")]
    else:
        counts = [F.count_if(F.col("value_num").isNotNull() | F.col("value_str").isNotNull()).alias("filled"), F.countDistinct("row_no").alias("rows")]
    got = samples.groupBy("log_id").agg(*counts)
    raw = F.col("filled") / (F.col("rows") * F.col("headers"))
    return n.join(got, "log_id").select("log_id", "rows", F.round(raw, 3).alias("density"), (raw < 0.9).alias("sparse"))


def log_warnings(used: DataFrame, silent: DataFrame, logs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """log_id, warnings: what was not checked, inferred or dead, in words.

    ``settings``: what ``analysis.log_settings`` gives; it tells where the commanded mixture stands for a missing flag.
    """
    ect = channel_units(used).filter("role = 'ect'").groupBy("log_id").agg(F.min_by(F.struct("header", "quantity"), "ordinal").alias("ect"))
    dead = silent.select(
        "log_id",
        F.when(F.col("superseded").isNotNull(), F.format_string("column '%s' holds no samples; '%s' plays %s instead", "header", "superseded", "role"))
        .otherwise(F.format_string("column '%s' holds no samples; %s was not checked", "header", "role"))
        .alias("text"),
    )
    words = dead.groupBy("log_id").agg(F.sort_array(F.collect_list("text")).alias("dead"))
    cold = F.when(F.col("ect").isNull(), "no coolant temperature: warm-up was not checked").when(F.col("ect.quantity").isNull() | (F.col("ect.quantity") != "temperature"), F.format_string("coolant temperature '%s' states no unit: warm-up was not checked", "ect.header"))
    joined = logs.select("log_id").distinct().join(ect, "log_id", "left").join(words, "log_id", "left")
    said = [cold]
    if settings is not None:
        joined = joined.join(settings.select("log_id", "pe_scale", "commanded"), "log_id", "left")
        said.append(F.when(F.col("pe_scale").isNotNull(), F.format_string("no enrichment or closed-loop flag: rows in which '%s' commands richer than stoichiometric count as enrichment", "commanded")))
    return joined.select("log_id", F.concat(F.array_compact(F.array(*said)), F.coalesce("dead", F.array().cast("array<string>"))).alias("warnings"))


def ect_threshold(used: DataFrame, value: float = 160.0, unit: str = "°F") -> DataFrame:
    """log_id, threshold: the warm-up limit in the unit of the log, to one place; null (no guard) without a unit."""
    from dynofleet.functions.numbers import half_away
    from dynofleet.functions.units import convert

    ect = channel_units(used).filter("role = 'ect'")
    known = F.col("quantity") == "temperature"
    return ect.select("log_id", F.when(known, half_away(convert(F.lit(value), F.lit(unit), F.when(known, F.col("unit"))), 1)).alias("threshold"))
