"""Files in object stores: locations, work units and scans."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.spec import scheme_of

EXTENSIONS = {"parquet": (".parquet",), "ndjson": (".ndjson", ".jsonl", ".json")}
SAMPLE_RECORDS = 1000
#: Hadoop settings and the environment variables they come from: fixed values.
CREDENTIALS = {
    "fs.s3a.access.key": "AWS_ACCESS_KEY_ID",
    "fs.s3a.secret.key": "AWS_SECRET_ACCESS_KEY",
    "fs.s3a.session.token": "AWS_SESSION_TOKEN",
    "fs.s3a.endpoint": "AWS_ENDPOINT_URL",
    "google.cloud.auth.service.account.json.keyfile": "GOOGLE_APPLICATION_CREDENTIALS",
}


@dataclass(frozen=True, order=True)
class WorkUnit:
    """One immutable file."""

    url: str
    size: int
    modified_millis: int


def hadoop_url(url: str) -> str:
    """The same place under the scheme Hadoop's connectors use."""
    scheme = scheme_of(url)
    if scheme is None:
        raise ValueError(f"the scheme of {url} is not supported")
    if scheme == "s3":
        return re.sub(r"(?i)^s3://", "s3a://", url)
    if scheme == "az":
        found = re.match(r"(?i)https://([^/.]+)\.(?:blob|dfs)\.([^/]+)/([^/]+)/?(.*)", url)
        return f"abfss://{found[3]}@{found[1]}.dfs.{found[2]}/{found[4]}" if found else re.sub(r"(?i)^(az|azure|adl|abfs)://", "abfss://", url)
    return url if "://" in url else "file://" + os.path.abspath(url)


def use_environment_credentials(spark: SparkSession) -> None:
    """Credentials come from the environment alone."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, name in CREDENTIALS.items():
        if os.environ.get(name):
            conf.set(key, os.environ[name])


def list_work_units(spark: SparkSession, url: str, kind: str) -> list[WorkUnit]:
    """Files of the format's extensions right in the folder (or the one file), by path."""
    where = hadoop_url(url)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.getFileStatus(path)
    statuses = store.listStatus(path) if found.isDirectory() else [found]
    units = []
    for s in statuses:
        name = s.getPath().getName()
        if s.isFile() and (not found.isDirectory() or name.lower().endswith(EXTENSIONS[kind]) and not name.startswith(("_", "."))):
            units.append(WorkUnit(unquote(s.getPath().toString()), s.getLen(), s.getModificationTime()))
    return sorted(units)


def read(spark: SparkSession, units: Iterable[WorkUnit | str], kind: str) -> DataFrame:
    """One scan over the files. NDJSON has the schema of its first records; a line that does not fit it is an error."""
    paths = [u.url if isinstance(u, WorkUnit) else hadoop_url(u) for u in units]
    if not paths:
        raise ValueError("there is no file to read")
    if kind == "parquet":
        return spark.read.parquet(*paths)
    head = spark.read.text(paths[0]).limit(SAMPLE_RECORDS)
    sample = "\n".join(r["value"] for r in head.collect())  # SAMPLE_RECORDS lines
    return spark.read.schema(_schema_of(spark, sample)).option("mode", "FAILFAST").json(paths)


def _schema_of(spark: SparkSession, sample: str):
    rows = [(line,) for line in sample.split("\n") if line.strip()]
    return spark.read.json(spark.createDataFrame(rows or [("{}",)], "value string").rdd.map(lambda r: r[0])).schema
