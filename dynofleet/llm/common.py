"""What the operators share: written tables that cut lineage, and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes up to which one side of a join is sent to all executors.
BROADCAST_BYTES = 24_000_000


def sized_broadcast(keys: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``keys``, stored, and marked for broadcast if they take BROADCAST_BYTES at most; beyond that a join shuffles them.

    ``row_bytes``: what a row takes in an executor's table.
    """
    kept = stored(keys)
    return F.broadcast(kept) if kept.count() * row_bytes <= BROADCAST_BYTES else kept


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests, a laptop) is a local one made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="dynofleet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a reliable cut of the lineage.

    A table instead of ``checkpoint()`` as it is columnar and compressed, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
