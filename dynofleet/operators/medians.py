"""Exact upper medians of positive numbers by group, for groups of any size.

Equal values are counted first. A histogram on a logarithmic scale (bins of less than 0.02 %) tells in which bin the
median of a group stands, and only that bin's values are put in order. No task holds all values of a group:
counting is spread by value, a histogram has at most as many rows as bins, and the last window streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins for every doubling.
BINS = 4096


def upper_medians(values: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """keys, ``name``: of n positive values of a group the one with floor(n / 2) others before it; groups without any have no row.

    Values that are null, zero or negative don't count.
    """
    v = F.col(value)
    counted = values.filter(v > 0).groupBy(*keys, v.alias("v_")).agg(F.count("*").alias("c_"))
    counted = counted.withColumn("bin_", F.floor(F.log2("v_") * BINS).cast("long"))
    bins = counted.groupBy(*keys, "bin_").agg(F.sum("c_").alias("n_"))
    group, rising = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin_")
    placed = bins.withColumns({"until_": F.sum("n_").over(rising), "at_": F.floor(F.sum("n_").over(group) / 2)})
    chosen = placed.filter((F.col("at_") < F.col("until_")) & (F.col("at_") >= F.col("until_") - F.col("n_"))).select(*keys, "bin_", (F.col("at_") - F.col("until_") + F.col("n_")).alias("at_"))
    near = counted.join(chosen, [*keys, "bin_"]).withColumn("until_", F.sum("c_").over(Window.partitionBy(*keys).orderBy("v_")))
    return near.filter((F.col("at_") < F.col("until_")) & (F.col("at_") >= F.col("until_") - F.col("c_"))).select(*keys, F.col("v_").alias(name))
