"""What changed from one calibration of a vehicle to the next: bytes by region, cells by table.

images: vehicle, name, path, content. Names of revisions begin with v and their number; others (stock files) come before the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.sources.definitions import cell_diff, labelled_cells, read_elements, top_changed_tables
from dynofleet.sources.images import compare_images
from dynofleet.sources.tables import dropped, written


def revision_pairs(files: DataFrame) -> DataFrame:
    """vehicle, a, b, name_a, name_b: every file of a vehicle after its first, with the one before it by revision number, then name.

    The window streams over names; contents take no part.
    """
    number = F.coalesce(F.regexp_extract("name", r"^v(\d{3,})", 1).try_cast("long"), F.lit(0))
    w = Window.partitionBy("vehicle").orderBy(number, "name", "path")
    before = files.select("vehicle", F.lag("path").over(w).alias("a"), F.col("path").alias("b"), F.lag("name").over(w).alias("name_a"), F.col("name").alias("name_b"))
    return before.filter("a is not null")


def table_changes(pairs: DataFrame, images: DataFrame, axes: DataFrame) -> DataFrame:
    """What ``cell_diff`` gives of pairs (a, b, os_a, os_b) of one system that has a definition; images: path, content."""
    same = pairs.filter("os_a = os_b").join(axes.select(F.col("os_id").alias("os_a")).distinct(), "os_a", "left_semi").select("a", "b", "os_a")
    named = same.select(F.explode(F.array("a", "b")).alias("path"), F.col("os_a").alias("os_id")).distinct()
    elements = written(read_elements(images.select("path", "content").join(named, "path").select(F.col("path").alias("image_id"), "os_id", "content"), axes))
    cells = written(labelled_cells(elements, axes))
    out = written(cell_diff(cells, same.select("a", "b").distinct()))
    dropped(elements, cells)
    return out


def compare_revisions(images: DataFrame, axes: DataFrame | None = None, most: int = 200) -> DataFrame:
    """A row for every pair of ``revision_pairs``: what ``compare_images`` gives, tables_changed, cells_changed, tables.

    tables: the ``most`` tables with most changed cells (table_id, changed, max_delta, avg_delta), most first. It is null, and so
    are the counts, where the systems differ or have no definition, and empty where both images are equal. ``axes``: those of one definition
    a system. Cells are only read of images that differ.
    """
    pairs = written(revision_pairs(images.select("vehicle", "name", "path")))
    compared = compare_images(pairs.select("a", "b").distinct(), images)
    out = pairs.join(compared, ["a", "b"])
    if axes is None:
        return out
    axes = written(axes)
    diff = table_changes(compared.filter("not identical"), images, axes)
    counts = diff.groupBy("a", "b").agg(F.count_if(F.col("changed") > 0).alias("tables_changed"), F.sum("changed").alias("cells_changed"))
    ranked = top_changed_tables(diff, most).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rank", "table_id", "changed", "max_delta", "avg_delta"))).alias("ranked"))
    tables = F.transform("ranked", lambda t: F.struct(t["table_id"].alias("table_id"), t["changed"].alias("changed"), t["max_delta"].alias("max_delta"), t["avg_delta"].alias("avg_delta")))
    none = F.array().cast("array<struct<table_id:string,changed:bigint,max_delta:double,avg_delta:double>>")
    known = axes.select(F.col("os_id").alias("os_a"), F.lit(True).alias("defined")).distinct()
    out = out.join(known, "os_a", "left").join(counts, ["a", "b"], "left").join(ranked, ["a", "b"], "left")
    zero = F.when(F.col("defined") & (F.col("os_a") == F.col("os_b")), F.lit(0))
    return out.withColumns({"tables_changed": F.coalesce("tables_changed", zero.cast("long")), "cells_changed": F.coalesce("cells_changed", zero.cast("long")), "tables": F.coalesce(tables, F.when(zero.isNotNull(), none))}).drop("defined", "ranked")
