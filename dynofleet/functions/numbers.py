"""Rounding and summing that give the same digits on every engine and in every order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column, places: int = 0) -> Column:
    """Ties away from zero, on the binary value: sign(x) * floor(|x| * 10^places + 0.5) / 10^places."""
    scale = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale + F.lit(0.0)


def exact_sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(18,6)")).cast("double")


def exact_mean(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def step_down(x: Column, width: float) -> Column:
    """Lower edge of the bin of ``x``; negative values go down."""
    return F.floor(x / float(width)).cast("double") * float(width)
