"""Tables stored in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder, removed when the driver's process ends.

    Without spark.checkpoint.dir a temporary folder serves in local mode, and only there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="auditlake-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/auditlake-tables/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under a fresh path and read back, with attributes of its own."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str, each: int = 2_000) -> DataFrame:
    """rows dealt by key to tasks of about `each`: for short rows that cost much, whose files are few and small."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass
