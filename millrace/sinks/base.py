"""Sinks: data is staged first and becomes visible in `publish`; dropping a sink leaves nothing behind."""

from __future__ import annotations

import os
import re
from typing import Protocol
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.relational import last_write_wins

#: What the database sinks take.
MATRIX = {"int": "integer", "bigint": "bigint", "double": "double precision", "string": "text", "boolean": "boolean", "timestamp": "timestamptz", "timestamp_ntz": "timestamptz"}
MAX_COLUMNS = 32767


class Sink(Protocol):
    def stage(self, df: DataFrame) -> None: ...

    def publish(self) -> None: ...

    def drop(self) -> None: ...


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_target(target: str) -> str:
    return ".".join(quote(p) for p in target.split("."))


def check_schema(schema: T.StructType) -> None:
    if len(schema) > MAX_COLUMNS:
        raise ValueError(f"{len(schema)} columns, more than {MAX_COLUMNS}")
    wrong = [f"`{f.name}` ({f.dataType.simpleString()})" for f in schema if f.dataType.simpleString() not in MATRIX]
    if wrong:
        raise ValueError(f"the sink does not take {', '.join(wrong)}")


class ParquetSink:
    """A folder of Parquet files. Staged beside the target; append moves files in, upsert writes a new folder and swaps it."""

    def __init__(self, spark: SparkSession, target: str, mode: str = "append", keys: tuple[str, ...] = ()) -> None:
        self.spark, self.target, self.mode, self.keys = spark, target.rstrip("/"), mode, tuple(keys)
        self.staged = f"{self.target}__stage_{uuid4().hex}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path, path(self.target).getFileSystem(conf)

    def stage(self, df: DataFrame) -> None:
        if self.mode == "upsert":
            missing = [k for k in self.keys if k not in df.columns]
            if missing:
                raise ValueError(f"key column(s) not in the data: {', '.join(missing)}")
            df = last_write_wins(df.withColumn("__seq", F.monotonically_increasing_id()), self.keys, "__seq").drop("__seq")
        df.write.parquet(self.staged)

    def publish(self) -> None:
        path, fs = self._fs()
        target, staged = path(self.target), path(self.staged)
        if self.mode == "upsert" and fs.exists(target):
            new, old = self.spark.read.parquet(self.staged), self.spark.read.parquet(self.target)
            merged = f"{self.target}__merged_{uuid4().hex}"
            old.join(new.select(*self.keys), list(self.keys), "left_anti").select(*new.columns).unionByName(new).write.parquet(merged)
            aside = path(f"{self.target}__old_{uuid4().hex}")
            fs.rename(target, aside)
            fs.rename(path(merged), target)
            fs.delete(aside, True)
            self.drop()
            return
        if not fs.exists(target):
            fs.rename(staged, target)
            return
        tag = uuid4().hex
        for s in fs.listStatus(staged):
            if s.getPath().getName().startswith("part-"):
                fs.rename(s.getPath(), path(target, f"{s.getPath().getName().removesuffix('.parquet')}-{tag}.parquet"))
        self.drop()

    def drop(self) -> None:
        path, fs = self._fs()
        fs.delete(path(self.staged), True)


class JdbcSink:
    """PostgreSQL over JDBC: rows go to a staging table, then one transaction on the driver moves them to the target."""

    def __init__(self, spark: SparkSession, target: str, mode: str = "append", keys: tuple[str, ...] = (), dsn_env: str = "MILLRACE_POSTGRES_DSN") -> None:
        self.url = os.environ.get(dsn_env)
        if not self.url:
            raise RuntimeError(f"the environment variable {dsn_env} is not set")
        self.spark, self.target, self.mode, self.keys = spark, target, mode, tuple(keys)
        self.staged = f"{target}__stage_{uuid4().hex[:12]}"
        self.columns: list[str] = []

    def stage(self, df: DataFrame) -> None:
        check_schema(df.schema)
        self.columns = df.columns
        df.withColumn("__seq", F.monotonically_increasing_id()).write.jdbc(self.url, quote_target(self.staged), "error")

    def statements(self) -> list[str]:
        """What one transaction runs at publish."""
        names, stage, target = ", ".join(map(quote, self.columns)), quote_target(self.staged), quote_target(self.target)
        if self.mode == "append":
            insert = f"INSERT INTO {target} ({names}) SELECT {names} FROM {stage} ORDER BY \"__seq\""
        else:
            keys = ", ".join(map(quote, self.keys))
            rest = [c for c in self.columns if c not in self.keys]
            action = "NOTHING" if not rest else "UPDATE SET " + ", ".join(f"{quote(c)} = EXCLUDED.{quote(c)}" for c in rest)
            insert = f"INSERT INTO {target} ({names}) SELECT DISTINCT ON ({keys}) {names} FROM {stage} ORDER BY {keys}, \"__seq\" DESC ON CONFLICT ({keys}) DO {action}"
        return [insert, f"DROP TABLE {stage}"]

    def _run(self, statements: list[str]) -> None:
        connection = self.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(self.url)
        try:
            connection.setAutoCommit(False)
            for s in statements:
                connection.createStatement().execute(s)
            connection.commit()
        finally:
            connection.close()

    def publish(self) -> None:
        self._run(self.statements())

    def drop(self) -> None:
        self._run([f"DROP TABLE IF EXISTS {quote_target(self.staged)}"])


class FlightSqlSink:
    """Declared and checked; its wire client is not installed."""

    def __init__(self, endpoint: str, target: str, token_env: str = "MILLRACE_FLIGHT_SQL_TOKEN") -> None:
        self.endpoint, self.parts, self.token = endpoint, parse_target(target), os.environ.get(token_env)

    def stage(self, df: DataFrame) -> None:
        raise NotImplementedError("the Flight SQL client is not installed")

    def publish(self) -> None:
        raise NotImplementedError("the Flight SQL client is not installed")

    def drop(self) -> None:
        pass


def parse_target(target: str) -> list[str]:
    parts = target.split(".")
    if len(parts) not in (2, 3) or not all(re.search(r"\S", p) for p in parts):
        raise ValueError(f"`{target}` should have two or three parts")
    return parts


def commit_barrier_problems(spark: SparkSession, sink_for, count, df: DataFrame) -> list[str]:
    """Conformance of a sink: rows are invisible until publish, are all there after it, and a dropped sink leaks nothing."""
    wrong, before, n = [], count(), df.count()
    dropped = sink_for()
    dropped.stage(df)
    dropped.drop()
    if count() != before:
        wrong.append("a dropped sink left rows")
    sink = sink_for()
    sink.stage(df)
    if count() != before:
        wrong.append("rows are visible before publish")
    sink.publish()
    if count() != before + n:
        wrong.append(f"{count() - before} rows after publish instead of {n}")
    return wrong


def rows_in(spark: SparkSession, target: str) -> int:
    try:
        return spark.read.parquet(target).count()
    except AnalysisException:
        return 0
