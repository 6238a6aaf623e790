"""The inference ledger and its review queue: SQLite on the driver alone, in a file. Executors get snapshots, never the file."""

from __future__ import annotations

import json
import shutil
import sqlite3
import tempfile
import time
import weakref
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.session import new_folder

#: Rows that the driver holds at once when the ledger becomes a table.
PART = 50_000
#: Writes, or keys marked, that a private ledger has in one transaction.
MARKED = 10_000

_TABLES = """
CREATE TABLE IF NOT EXISTS work_items (
  work_key TEXT PRIMARY KEY, state TEXT NOT NULL CHECK (state IN ('pending', 'submitted', 'completed', 'failed')),
  spec_json TEXT NOT NULL, request_id TEXT, output_json TEXT, provider TEXT, model TEXT, input_tokens INTEGER,
  output_tokens INTEGER, validation TEXT, error TEXT, created_at INTEGER NOT NULL, updated_at INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS review_queue (
  work_key TEXT PRIMARY KEY REFERENCES work_items(work_key), transform_id TEXT NOT NULL, reason TEXT NOT NULL, raw_output TEXT,
  status TEXT NOT NULL DEFAULT 'pending' CHECK (status IN ('pending', 'accepted', 'rejected')), created_at INTEGER NOT NULL, decided_at INTEGER);
"""


@dataclass(frozen=True)
class Result:
    output: str
    provider: str
    model: str
    request_id: str
    input_tokens: int
    output_tokens: int
    validation: str = "valid"


class Ledger:
    """Without a path, a file of its own that goes with it; nobody else reads that one, so it keeps specs packed."""

    def __init__(self, path: str | None = None) -> None:
        self.private = path is None
        if path is None:
            folder = tempfile.mkdtemp(prefix="ledger-")
            weakref.finalize(self, shutil.rmtree, folder, ignore_errors=True)
            path = f"{folder}/ledger.db"
        if path.startswith(("postgres://", "postgresql://")):
            raise NotImplementedError("a shared ledger needs a PostgreSQL driver, which is not installed")
        self.db = sqlite3.connect(path)
        self.db.execute("PRAGMA journal_mode=WAL")
        self.db.execute(f"PRAGMA synchronous={'OFF' if self.private else 'NORMAL'}")
        self.db.execute("PRAGMA cache_size=-32000")
        self.db.executescript(_TABLES)
        self._writes = 0

    def _write(self, sql: str, *values: object) -> bool:
        """For good at once; a private ledger ends with the run anyway, and many writes are one transaction."""
        if not self.private:
            with self.db:
                return self.db.execute(sql, values).rowcount > 0
        self._writes += 1
        if self._writes % MARKED == 0:
            self.db.commit()
        return self.db.execute(sql, values).rowcount > 0

    @staticmethod
    def _now() -> int:
        return int(time.time() * 1000)

    def _packed(self, spec: str) -> str | bytes:
        return zlib.compress(spec.encode(), 1) if self.private else spec

    @staticmethod
    def _dict(cursor: sqlite3.Cursor, row: tuple) -> dict:
        found = dict(zip([d[0] for d in cursor.description], row, strict=True))
        return found | ({"spec_json": zlib.decompress(spec).decode()} if isinstance(spec := found["spec_json"], bytes) else {})

    def ensure_pending(self, key: str, spec: str) -> bool:
        now = self._now()
        return self._write("INSERT INTO work_items (work_key, state, spec_json, created_at, updated_at) VALUES (?, 'pending', ?, ?, ?) ON CONFLICT DO NOTHING", key, self._packed(spec), now, now)

    def ensure_all_pending(self, items: Iterable[tuple[str, str]]) -> None:
        """(key, spec) of many, in one transaction."""
        now = self._now()
        self.db.commit()
        with self.db:
            self.db.executemany("INSERT INTO work_items (work_key, state, spec_json, created_at, updated_at) VALUES (?, 'pending', ?, ?, ?) ON CONFLICT DO NOTHING", ((k, self._packed(spec), now, now) for k, spec in items))

    def state(self, key: str) -> str | None:
        row = self.db.execute("SELECT state FROM work_items WHERE work_key = ?", (key,)).fetchone()
        return row and row[0]

    def item(self, key: str) -> dict | None:
        cursor = self.db.execute("SELECT * FROM work_items WHERE work_key = ?", (key,))
        row = cursor.fetchone()
        return row and self._dict(cursor, row)

    def inputs(self, key: str) -> dict:
        """The inputs of an item, from its spec."""
        return json.loads(self.item(key)["spec_json"])["inputs"]

    def states(self, keys: Iterable[str]) -> dict[str, tuple[str, str | None]]:
        """(state, output) of the known ones among keys."""
        keys, found = list(keys), {}
        for i in range(0, len(keys), 500):
            part = keys[i : i + 500]
            marks = ",".join("?" * len(part))
            found |= {k: (s, o) for k, s, o in self.db.execute(f"SELECT work_key, state, output_json FROM work_items WHERE work_key IN ({marks})", part)}
        return found

    def mark_submitted(self, key: str, request_id: str) -> bool:
        return self._write("UPDATE work_items SET state = 'submitted', request_id = ?, updated_at = ? WHERE work_key = ? AND state IN ('pending', 'submitted', 'failed')", request_id, self._now(), key)

    def complete(self, key: str, r: Result) -> bool:
        """Records a result once; a completed item never changes."""
        return self._write(
            "UPDATE work_items SET state = 'completed', output_json = ?, provider = ?, model = ?, request_id = ?, input_tokens = ?, output_tokens = ?, validation = ?, error = NULL, updated_at = ? WHERE work_key = ? AND state <> 'completed'",
            r.output, r.provider, r.model, r.request_id, r.input_tokens, r.output_tokens, r.validation, self._now(), key,
        )

    def mark_failed(self, key: str, error: str) -> bool:
        return self._write("UPDATE work_items SET state = 'failed', error = ?, updated_at = ? WHERE work_key = ? AND state <> 'completed'", error, self._now(), key)

    def jobs(self) -> list[str]:
        """Batch jobs that items wait for."""
        return [job for (job,) in self.db.execute("SELECT DISTINCT request_id FROM work_items WHERE state = 'submitted' AND request_id NOT IN ('', 'online') ORDER BY 1")]

    def waits_for(self, key: str, job: str) -> bool:
        return self.db.execute("SELECT 1 FROM work_items WHERE work_key = ? AND state = 'submitted' AND request_id = ?", (key, job)).fetchone() is not None

    def mark_job_failed(self, job: str, error: str) -> bool:
        return self._write("UPDATE work_items SET state = 'failed', error = ?, updated_at = ? WHERE state = 'submitted' AND request_id = ?", error, self._now(), job)

    def counts(self) -> dict[str, int]:
        found = dict(self.db.execute("SELECT state, count(*) FROM work_items GROUP BY state"))
        return {s: found.get(s, 0) for s in ("pending", "submitted", "completed", "failed")}

    def enqueue_review(self, key: str, step: str, reason: str, raw: str | None) -> bool:
        return self._write("INSERT INTO review_queue (work_key, transform_id, reason, raw_output, created_at) VALUES (?, ?, ?, ?, ?) ON CONFLICT DO NOTHING", key, step, reason, raw, self._now())

    def review_status(self, key: str) -> str | None:
        row = self.db.execute("SELECT status FROM review_queue WHERE work_key = ?", (key,)).fetchone()
        return row and row[0]

    def withheld(self, keys: Iterable[str]) -> set[str]:
        """Those that wait for a decision or were rejected."""
        return {k for k in keys if self.review_status(k) in ("pending", "rejected")}

    def reviews(self, status: str = "pending") -> list[dict]:
        cursor = self.db.execute("SELECT r.work_key, r.transform_id, r.reason, r.raw_output, r.created_at, w.spec_json FROM review_queue r JOIN work_items w USING (work_key) WHERE r.status = ? ORDER BY r.created_at, r.work_key", (status,))
        return [self._dict(cursor, row) for row in cursor]

    def review_counts(self) -> dict[str, int]:
        found = dict(self.db.execute("SELECT status, count(*) FROM review_queue GROUP BY status"))
        return {s: found.get(s, 0) for s in ("pending", "accepted", "rejected")}

    def decide(self, key: str, status: str) -> bool:
        return self._write("UPDATE review_queue SET status = ?, decided_at = ? WHERE work_key = ? AND status = 'pending'", status, self._now(), key)

    def find(self, prefix: str) -> str:
        """The one pending key that starts with prefix."""
        found = [r["work_key"] for r in self.reviews() if r["work_key"].startswith(prefix)]
        if len(found) != 1:
            raise LookupError(f"{len(found)} pending reviews start with `{prefix}`")
        return found[0]

    def mark_all_submitted(self, keys: Iterable[str], request_id: str) -> None:
        """All in one transaction: a job is either known for all of its items or for none. A private ledger ends with the run
        anyway, and writes no second copy of itself for that."""
        now = self._now()
        self.db.commit()
        for part in batched(keys, MARKED) if self.private else [keys]:
            with self.db:
                self.db.executemany("UPDATE work_items SET state = 'submitted', request_id = ?, updated_at = ? WHERE work_key = ? AND state <> 'completed'", ((request_id, now, k) for k in part))

    def _table(self, spark: SparkSession, columns: str, rows: str) -> DataFrame:
        """A query's rows as a table in shared storage, carried over in parts of PART rows."""
        fields = [pa.field(name, {"string": pa.string(), "long": pa.int64()}[kind]) for name, kind in (c.split() for c in columns.split(", "))]
        cursor = self.db.execute(f"SELECT {', '.join(f.name for f in fields)} FROM {rows}")
        table = lambda part: spark.createDataFrame(pa.table([pa.array([r[i] for r in part], f.type) for i, f in enumerate(fields)], pa.schema(fields)), columns)
        part = cursor.fetchmany(PART)
        if len(part) < PART:
            return table(part)
        folder = new_folder(spark, "ledger")
        while part:
            table(part).coalesce(1).write.mode("append").parquet(folder)
            part = cursor.fetchmany(PART)
        return spark.read.schema(columns).parquet(folder)

    def snapshot(self, spark: SparkSession, where: str = "true") -> DataFrame:
        """The items as a table."""
        columns = "work_key string, state string, request_id string, output_json string, provider string, model string, input_tokens long, output_tokens long, validation string, error string"
        return self._table(spark, columns, f"work_items WHERE {where}")

    def answers(self, spark: SparkSession) -> DataFrame:
        """Keys and outputs of completed work."""
        return self._table(spark, "work_key string, output_json string", "work_items WHERE state = 'completed'")

    def completed_keys(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "work_key string", "work_items WHERE state = 'completed'")

    def reviews_table(self, spark: SparkSession, status: str = "pending") -> DataFrame:
        """The reviews of a status with their items' state, as a table."""
        columns = "work_key string, transform_id string, reason string, raw_output string, status string, state string"
        return self._table(spark, columns, f"review_queue JOIN work_items USING (work_key) WHERE status = '{status}'")

    def withheld_keys(self, spark: SparkSession) -> DataFrame:
        """Keys that wait for a decision or were rejected."""
        return self._table(spark, "work_key string", "review_queue WHERE status IN ('pending', 'rejected')")
