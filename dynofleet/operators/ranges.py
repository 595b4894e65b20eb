"""Windows over the rows of a log that spread one long log over many tasks.

A log is cut into ranges of so many row numbers, and windows run by log and range. What a window must know from before its
range is carried there: the last row of the range before (``lagged``, ``led``), or a count of all earlier ranges
(``running_count``). Those are one row a range, found by partial aggregation. Results equal the plain window's by log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Row numbers of one range.
ROWS = 65_536
#: The column that names the range, for those who go on with it.
RANGE = "range_"


def in_ranges(df: DataFrame, order: str = "row_no", rows: int | None = None) -> DataFrame:
    """Adds ``range_``, the range of a row's number."""
    return df.withColumn(RANGE, F.floor(F.col(order) / (rows or ROWS)).cast("long"))


def by_range(keys: Sequence[str] = ("log_id",), order: str = "row_no") -> Window:
    return Window.partitionBy(*keys, RANGE).orderBy(order)


def _neighbour(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, rows: int | None, back: bool) -> DataFrame:
    df = in_ranges(df, order, rows)
    row = F.struct(*(F.col(c) for c in dict.fromkeys((*columns, order))))
    ends = df.groupBy(*keys, RANGE).agg((F.max_by if back else F.min_by)(row, F.col(order)).alias("end_"))
    across = Window.partitionBy(*keys).orderBy(RANGE)
    carried = ends.select(*keys, (F.lead if back else F.lag)(RANGE).over(across).alias(RANGE), "end_").filter(F.col(RANGE).isNotNull())
    near = (F.lag if back else F.lead)(row).over(by_range(keys, order))
    return df.join(carried, [*keys, RANGE], "left").withColumn("near_", F.coalesce(near, F.col("end_"))).drop("end_")


def lagged(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("log_id",), order: str = "row_no", rows: int | None = None) -> DataFrame:
    """Adds ``near_``, a struct of ``columns`` and the row number of the row before, null in a log's first row; and ``range_``."""
    return _neighbour(df, columns, keys, order, rows, True)


def led(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("log_id",), order: str = "row_no", rows: int | None = None) -> DataFrame:
    """Adds ``near_``, the same of the row after; and ``range_``."""
    return _neighbour(df, columns, keys, order, rows, False)


def running_count(df: DataFrame, flag: Column, name: str, keys: Sequence[str] = ("log_id",), order: str = "row_no", rows: int | None = None) -> DataFrame:
    """Adds ``name``: how many rows up to this one have ``flag``."""
    df = in_ranges(df, order, rows).withColumn("flag_", F.coalesce(flag, F.lit(False)).cast("long"))
    sums = df.groupBy(*keys, RANGE).agg(F.sum("flag_").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(*keys, RANGE, before.alias("before_")).filter("before_ is not null")
    own = F.sum("flag_").over(by_range(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(carried, [*keys, RANGE], "left").withColumn(name, own + F.coalesce("before_", F.lit(0))).drop("flag_", "before_", RANGE)


def numbered(df: DataFrame, name: str, keys: Sequence[str] = ("log_id",), order: str = "line_no", rows: int | None = None) -> DataFrame:
    """Adds ``name``: the number of a row in its log, from 1, in order of ``order``."""
    return running_count(df, F.lit(True), name, keys, order, rows)
