"""Equations over arrays equal those over columns, and ten thousand of them leave the plan as it is."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dynofleet.functions.equations import compile_equation, evaluate, postfix
from dynofleet.sources import definitions


def test_arrays_equal_columns(spark):
    texts = ["", "X", "X*0.1", "(X-128)*0.5", "X/4+10", "-X+5", "2*-X", "-X^2", "2^3^2-X", "X/(X-3)", "X/0", "(X+1)/(2-X)/2", "X^0.5", "10^400*X", "+X--X", "A*B+.5"]
    x = np.array([-3.0, 0.0, 1.0, 2.0, 3.0, 128.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    rows = df.select(*(compile_equation(t, F.col("x")).alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for i, t in enumerate(texts):
        assert np.allclose([r[i] for r in rows], evaluate(t, x), rtol=1e-14), t
    assert postfix("2*-X") == (2.0, "X", "neg", "*")
    for wrong in ("X+", "(X", "X X", "X$", "*2"):
        with pytest.raises(ValueError):
            postfix(wrong)


def test_many_equations_leave_the_plan_as_it_is(spark):
    columns = "os_id long, table_id string, axis string, address long, bits int, signed boolean, lsb_first boolean, floating boolean, rows long, cols long, index_count long, major_stride double, minor_stride double, decimals int, equation string"

    def axes(n):
        return spark.createDataFrame([(1, f"t{i}", "z", i % 50, 8, False, False, False, 1, 1, None, None, None, 4, f"X*{i}+{i % 7}/2") for i in range(n)], columns)

    images = spark.createDataFrame([("a", 1, bytearray(range(50)))], "image_id string, os_id long, content binary")
    plan = lambda n: re.sub(r"#\d+L?", "", definitions.read_elements(images, axes(n))._jdf.queryExecution().optimizedPlan().toString())
    assert plan(10_000) == plan(10)
    got = {r.table_id: r.value for r in definitions.read_elements(images, axes(3000)).collect()}
    assert got == pytest.approx({f"t{i}": (i % 50) * i + i % 7 / 2 for i in range(3000)})
