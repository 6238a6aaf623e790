"""Session settings the library relies on, and scratch space every node can reach."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Settings that decide results, not speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "millrace") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in {**SEMANTIC_CONF, **LOCAL_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions)}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="millrace-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(where)
    return where


#: Folders of tables that this process has materialized and not yet discarded.
_TABLES: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _forget_all() -> None:
    for folder, spark in list(_TABLES.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone; then the folder's owner clears it
            _delete(spark, folder)


atexit.register(_forget_all)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in shared storage, deleted when the process ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid4().hex}"
    _TABLES[folder] = spark
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, as a table in shared storage: survives the loss of any executor."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._millrace_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    folder = df._millrace_folder
    _delete(df.sparkSession, folder)
    _TABLES.pop(folder, None)
