"""File sources: images, inventories, and the names and records that carry revisions and dates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dynofleet.sources.tables import written


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of raw ``.bin`` images; other files can't be analysed and aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def located(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before such paths in a log_id."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file://"
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs, inside, path.split("://")[0] + "://" if "://" in path else "file://"


#: Files and bytes of one task.
FILES, BYTES = 2_000, 64 << 20


def dealt(files: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``files`` dealt by ``keys`` to as many tasks as their number and size ask for; such a table is too small for Spark to see the work in it.

    ``like``: rows of the same number and size that cost less to count.
    """
    counted = files if like is None else like
    size = F.sum("size") if "size" in counted.columns else F.lit(0)
    n, total = counted.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, n // FILES, total // BYTES), *keys)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each folder; a file stands for itself. Names that begin with . or _ are left out, as by Spark's own sources."""
    for b in batches:
        for at in b.column("path").to_pylist():
            fs, inside, _ = located(at)
            own = fs.get_file_info(inside)
            found = fs.get_file_info(pafs.FileSelector(inside)) if own.type == pafs.FileType.Directory else [own]
            for i in range(0, len(found), 10_000):
                some = [f for f in found[i : i + 10_000] if f is own or not (f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name)]
                paths = [at if f is own else f"{at.rstrip('/')}/{f.base_name}" for f in some]
                times = pa.array([f.mtime_ns // 1_000_000 * 1000 if f.mtime_ns is not None else None for f in some], pa.int64()).cast(pa.timestamp("us", "UTC"))
                columns = [pa.array(paths, pa.string()), pa.array([f.size for f in some], pa.int64()), times, pa.array([f.type == pafs.FileType.Directory for f in some], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "size", "modified", "folder"])


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of all files under ``path``; no content is read.

    Tasks list the folders, level by level, into tables: the driver sees how many folders a level has, and no file.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(root) or []
    if not there:
        raise FileNotFoundError(path)
    level, n, found, at = spark.range(1).select(F.explode(F.lit([f.getPath().toString() for f in there])).alias("path")), len(there), None, []
    while n:
        listed = written(level.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // 100)), "path").mapInArrow(_entries, "path string, size long, modified timestamp, folder boolean"))
        files, level = listed.filter("not folder").drop("folder"), listed.filter("folder").select("path")
        found, n = files if found is None else found.union(files), level.count()
        at += listed._written_at
    found._written_at = at
    return found


def removed(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path``, if it is there; tasks delete what stands in it."""
    fs, inside, before = located(path)
    if fs.get_file_info(inside).type == pafs.FileType.NotFound:
        return
    within = [before + f.path for f in fs.get_file_info(pafs.FileSelector(inside)) if f.type == pafs.FileType.Directory]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("path").to_pylist():
                fs, folder, _ = located(at)
                if fs.get_file_info(folder).type != pafs.FileType.NotFound:  # another attempt of the task may have been here
                    fs.delete_dir(folder)
            yield pa.RecordBatch.from_pydict({"removed": [b.num_rows]})

    if within:
        dealt(spark.createDataFrame([(x,) for x in within], "path string"), "path").mapInArrow(task, "removed long").collect()
    fs.delete_dir(inside)


def hashed_files(files: DataFrame) -> DataFrame:
    """``files`` with sha256 of what each path holds, null where it can't be read; files are streamed, of any size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                fs, inside, _ = located(path)
                digest = hashlib.sha256()
                try:
                    with fs.open_input_stream(inside) as file:
                        while block := file.read(1 << 20):
                            digest.update(block)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "sha256"])

    return dealt(files, "path").mapInArrow(task, StructType([*files.schema.fields, StructField("sha256", StringType())]))


def file_inventory(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """name, path, size, modified, sha256 of all files, newest name first.

    ``known``: an inventory made before. Files whose path, size and time are in it keep their hash (unless it is null); only the others are read.
    """
    key, files = ["path", "size", "modified"], listed_files(spark, path)
    if known is None:
        hashed = hashed_files(files)
    else:
        same = known.filter("sha256 is not null").select(*key, "sha256")
        hashed = files.join(same, key).unionByName(hashed_files(files.join(same, key, "left_anti")))
    return hashed.select(F.element_at(F.split("path", "/"), -1).alias("name"), *key, "sha256").orderBy(F.desc("name"))


def date_in(name: Column) -> Column:
    """The first date of a file name, as text; empty without one."""
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)


def revision_of(name: Column) -> Column:
    """The revision that a tune file's name begins with; null without one."""
    return F.nullif(F.regexp_extract(name, r"^(v\d{3})", 1), F.lit(""))


def log_revision_of(name: Column) -> Column:
    """The revision that a datalog's name holds; null without one."""
    return F.nullif(F.regexp_extract(name, r"_(v\d{3})_", 1), F.lit(""))


def read_flash_log(spark: SparkSession, path: str) -> DataFrame:
    """file, date, rev, adapter, notes from ``| date | revision | adapter | notes |`` lines."""
    return flash_rows(spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")))


# Fixed value: a row of the flash log.
FLASH_ROW = r"^\|\s*(\d{4}-\d{2}-\d{2})\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|$"


def flash_rows(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("line", FLASH_ROW, i)
    rest = [c for c in lines.columns if c != "line"]
    return lines.filter(F.col("line").rlike(FLASH_ROW)).select(*rest, part(1).alias("date"), part(2).alias("rev"), part(3).alias("adapter"), part(4).alias("notes"))


def flash_detail(adapter: Column, notes: Column) -> Column:
    """Adapter and notes in one; an em dash stands for no notes."""
    return F.array_join(F.filter(F.array(adapter, F.when(notes != "—", notes).otherwise("")), lambda x: x != ""), " · ")


def session_goal(text: Column) -> Column:
    """The goal line of session notes, else the revision line; null without either."""
    # The labels of both lines.
    line = lambda label: F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\*\*{label}:\*\*[ \t]*(.*)$", 1)), F.lit(""))
    return F.coalesce(line("Goal for this session"), line("Tune revision flashed"))


def current_state(profile: Column) -> Column:
    """struct<current_revision, last_flashed> from a vehicle profile; placeholders are empty."""

    def bullet(label: str) -> Column:
        # How a bullet is written, and what stands in for no value.
        v = F.trim(F.regexp_extract(profile, rf"(?m)^- {label}: (.*)$", 1))
        return F.when(v.rlike(r"^[—-]?\s*(\(stock\))?$"), "").otherwise(v)

    return F.struct(bullet("Current tune revision").alias("current_revision"), bullet("Last flashed").alias("last_flashed"))


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored formula of JSON files {parameters: [...]}."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("parameters").alias("p")).select("p.*")
