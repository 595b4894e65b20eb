"""Files written from the tables and read back: sources and sinks end to end, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynofleet.operators import scrub
from dynofleet.operators.report import write_readings
from dynofleet.plans import dense, flash
from dynofleet.plans.standins import table
from dynofleet.sources import files, images, splits
from dynofleet.sources.tables import dropped, shared_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def named(path: str) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def in_folders(ending: str) -> F.Column:
    """A file for each document, a thousand a folder at most, so that many tasks can list them."""
    return F.concat(F.expr("doc_id div 1000").cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(ending))


#: Bytes of disk that the files of one portion take, in blocks of 4 KB.
PORTION = 256 << 20


def portions(logs: DataFrame) -> list[DataFrame]:
    """``logs`` (doc_id, name, content) in ranges of doc_id: as few of 1, 2, 4, 8 as take PORTION each, else 8; together they hold every row, none is empty.

    Each is dealt to many tasks, as files take far more time to write than rows to read, of which a task may read very many.
    """
    eighths = F.percentile_approx("doc_id", [i / 8 for i in range(1, 8)], 10_000)
    n, size, at, last = logs.agg(F.count("*"), F.sum(F.ceil(F.octet_length("content") / 4096) * 4096), eighths, F.max("doc_id")).first()
    many = next((k for k in (1, 2, 4) if (size or 0) <= k * PORTION), 8)
    bounds = sorted({x for x in (at or [])[8 // many - 1 :: 8 // many] if x < last})
    key, places = F.col("doc_id"), [None, *bounds, None]
    within = lambda a, b: (F.lit(True) if a is None else key > a) & (F.lit(True) if b is None else key <= b)
    some = [logs.filter(within(a, b) | key.isNull() if a is None else within(a, b)) for a, b in zip(places, places[1:], strict=False)] if n else []
    tasks = max(logs.sparkSession.sparkContext.defaultParallelism, n // many // files.FILES)
    return [x.repartition(tasks, "name") for x in some]


# ---- texts play logs: a header with two columns that tell a place, a vehicle number, notes, then the text
@query(
    "write_scrubbed",
    """WITH t AS (SELECT doc_id, 'Time,RPM' || chr(10) || doc_id || ',900' || chr(10) || 'Notes:' || chr(10) || replace(text, ',', ';') AS text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id || '.csv' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM t""",
)
def _(spark, d):
    """Portion by portion: a text stands in two files until it is hashed, and a file takes a block of disk at least."""
    docs = table(spark, d, "documents").filter("text is not null")
    vin = F.concat(F.lit("1ZZTEST99Z"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    text = F.concat_ws("\n", F.lit("Time,RPM,GPS Latitude,GPS Longitude"), F.concat(F.col("doc_id").cast("string"), F.lit(",900,51.5,"), vin), F.concat(F.lit("Notes: seen "), vin, F.lit(" today")), F.translate("text", ",", ";"))
    logs, found, schema = docs.select("doc_id", in_folders(".csv").alias("name"), text.alias("content")), folder(spark), "name string, size long, sha256 string"
    some_of = portions(logs)
    for some in some_of:
        source, target = folder(spark), folder(spark)
        try:
            splits.write_files(some, source)
            scrub.write_scrubbed(spark, source, target)
            listed = files.listed_files(spark, target)
            files.hashed_files(listed).select(named("path").alias("name"), "size", "sha256").write.mode("append").parquet(found)
            dropped(listed)
        finally:
            for made in (source, target):
                files.removed(spark, made)
    return spark.read.schema(schema).parquet(found) if some_of else spark.createDataFrame([], schema)


@query("write_readings", dense.SQL["maf_bins"].replace("SELECT log_id, bin_from", "SELECT '2026-01-' || lpad(CAST(log_id % 28 + 1 AS VARCHAR), 2, '0') AS log_date, log_id, bin_from", 1))
def _(spark, d):
    bins = dense.QUERIES["maf_bins"](spark, d).withColumn("log_date", F.concat(F.lit("2026-01-"), F.lpad((F.col("log_id") % 28 + 1).cast("string"), 2, "0")))
    path = folder(spark)
    write_readings({"bins": bins}, path)
    write_readings({"bins": bins.filter("log_date < '2026-01-10'")}, path)  # only these days are replaced
    return spark.read.option("inferSchema", False).parquet(f"{path}/bins").withColumn("log_date", F.date_format("log_date", "yyyy-MM-dd"))


@query("read_images", flash.SQL["image_header"])
def _(spark, d):
    path = folder(spark)
    splits.write_files(flash.flash_images(spark, d).select(F.col("path").alias("name"), "content"), path)
    splits.write_files(table(spark, d, "nation").select(F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").alias("content")), path)
    read = images.analyze_images(files.read_images(spark, path))
    return read.select(named("path").alias("path"), "length", "kind", "detected", "os_id", "os_version")


@query("file_inventory", "SELECT doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """A first inventory, a third of the files written anew, and a second one that reads only those."""
    path = folder(spark)
    docs = table(spark, d, "documents").filter("text is not null")
    named_ = docs.select(in_folders(".txt").alias("name"), F.col("text").alias("content"), (F.col("doc_id") % 3 == 0).alias("third"))
    splits.write_files(named_.withColumn("content", F.when(F.col("third"), F.concat("content", F.lit(" old"))).otherwise(F.col("content"))), path)
    first = files.file_inventory(spark, path)
    known = f"{folder(spark)}/manifest"
    first.write.parquet(known)
    splits.write_files(named_.filter("third"), path)
    return files.file_inventory(spark, path, spark.read.parquet(known)).select("name", "size", "sha256")


@query("read_formulas", "SELECT 'f' || p_partkey AS id, p_name AS name, p_type AS category, 'X*' || p_size AS expression, ['RPM', 'IPW'][p_partkey % 2 + 1] AS first_input FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    one = F.struct(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.concat(F.lit("X*"), F.col("p_size").cast("string")).alias("expression"), F.array(F.when(F.col("p_partkey") % 2 == 0, "RPM").otherwise("IPW"), F.lit("MAP")).alias("inputs"))
    stores = part.groupBy((F.col("p_partkey") % 50).alias("store")).agg(F.collect_list(one).alias("parameters"))
    path = folder(spark)
    splits.write_files(stores.select(F.concat(F.lit("store-"), F.col("store").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("parameters")).alias("content")), path)
    return files.read_formulas(spark, path).select("id", "name", "category", "expression", F.get("inputs", F.lit(0)).alias("first_input"))
