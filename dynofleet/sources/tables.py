"""Tables written on the way: a cut of the lineage that lost executors don't undo, instead of a cache that nothing frees."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a session on one machine without that setting gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="dynofleet-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; several readings of it compute it once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = [path]
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` (and listings made of them) that nothing reads any more."""
    for df in tables:
        for path in getattr(df, "_written_at", []):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
