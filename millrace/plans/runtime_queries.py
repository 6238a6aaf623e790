"""Queries that run the runtime itself: ledger, semantic step, checkpoint log, sinks and compiler, on the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational, semantic
from millrace.operators.ledger import Ledger, Result
from millrace.operators.providers import MockProvider
from millrace.plans import compiler
from millrace.session import new_folder
from millrace.sinks.base import ParquetSink
from millrace.sources.object_store import WorkUnit
from millrace.streaming.checkpoint import CheckpointLog

INSTRUCTION = "classify the record"
FIELDS = [{"name": "vendor", "type": "utf8"}, {"name": "amount", "type": "int64"}]
CAP, CEILING, LONGEST = 64, 20_000, 500


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _step(**options) -> semantic.Step:
    return semantic.Step(id="extract", operation="ai.extract", inputs=["text"], instruction=INSTRUCTION, fields=FIELDS, model="mock-1", **options)


def semantic_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents twice, through one ledger: what each pass counts."""
    docs, ledger, provider, passes = _documents(spark, sf_dir), Ledger(), MockProvider(), []
    for number in (1, 2):
        rows, n = semantic.apply(docs, _step(), provider, ledger)
        passes.append((number, n.seen, n.calls, n.tokens, n.reused, rows.count()))
    return spark.createDataFrame(passes, "pass int, seen long, calls long, tokens long, reused long, rows_out long")


def semantic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one batch job, row by row."""
    rows, _ = semantic.apply(_documents(spark, sf_dir), _step(mode="batch"), MockProvider(), Ledger())
    return rows.select("doc_id", "vendor", "amount")


def semantic_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger has when the run's ceiling stops it."""
    ledger = Ledger()
    try:
        semantic.apply(_documents(spark, sf_dir), _step(max_run_tokens=CEILING, max_output_tokens=CAP), MockProvider(), ledger, F.col("doc_id"))
    except semantic.CeilingReached:
        pass
    return spark.createDataFrame([tuple(ledger.counts().values())], "pending long, submitted long, completed long, failed long")


def semantic_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs over the budget go to review: which rows are withheld, and what the queue says of them."""
    docs, ledger = _documents(spark, sf_dir), Ledger()
    rows, n = semantic.apply(docs, _step(on_invalid="review", max_input_tokens=LONGEST), MockProvider(), ledger)
    held = docs.join(rows.select("doc_id"), "doc_id", "left_anti")
    counts = ledger.review_counts()
    return held.select("doc_id", F.lit(n.withheld).cast("long").alias("withheld"), F.lit(counts["pending"]).cast("long").alias("queued"))


def _filled(spark: SparkSession, sf_dir: str) -> Ledger:
    """A ledger of the documents, brought to the states that stand for their labels by its own transitions."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ledger, keys = Ledger(), []
    for r in _documents(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left").toLocalIterator():
        key = str(r["doc_id"])
        keys.append((key, "{}"))
        if len(keys) == 1 or r["quality"] is not None:
            ledger.ensure_all_pending(keys)
            keys = [keys[-1]]
        if r["quality"] is None:
            continue
        ledger.mark_submitted(key, "job-1")
        if r["quality"] == 1:
            ledger.complete(key, Result("{}", "mock", "mock-1", "job-1", 1, 1))
        elif r["toxic"] != 1:
            ledger.mark_failed(key, "low quality")
            ledger.enqueue_review(key, "extract", "low quality", None)
            if r["doc_id"] % 3 == 0:
                ledger.decide(key, "accepted")
    ledger.ensure_all_pending(keys)
    return ledger


def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(_filled(spark, sf_dir).counts().values())], "pending long, submitted long, completed long, failed long")


def review_queue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reviews with their items and the documents they are about."""
    queue = _filled(spark, sf_dir).reviews_table(spark).select(F.col("work_key").cast("long").alias("doc_id"), "state")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return queue.join(docs, "doc_id")


def workunit_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the log has no completion of, after some were done by an earlier run."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 rows
    done = {r["r_regionkey"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey < 2").collect()}
    units = {WorkUnit(r["n_name"], 10 + r["n_nationkey"], 5): r["n_regionkey"] in done for r in nations}
    folder = new_folder(spark, "checkpoint")
    first = CheckpointLog(folder)
    first.claim("demo", units, "run-1")
    first.complete("demo", [u for u, ended in units.items() if ended], "run-1")
    left = CheckpointLog(folder).pending("demo", units)
    return spark.createDataFrame([(u.url,) for u in left], "url string")


def _document(sf_dir: str, transforms: list[dict], **sinks) -> dict:
    return {
        "apiVersion": "millrace/v1alpha1",
        "kind": "Pipeline",
        "metadata": {"name": "demo"},
        "spec": {"source": {"type": "object_store", "url": f"{sf_dir}/events.parquet", "format": {"type": "parquet"}}, "transforms": transforms} | sinks,
    }


def fanout_tee_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's rows to two sinks, one behind a filter of its own: rows that each was given, and holds."""
    folder = new_folder(spark, "tee")
    steps = [{"id": "some", "type": "sql", "query": "SELECT event_id, value FROM input"}, {"id": "high", "type": "sql", "from": "some", "query": "SELECT event_id FROM input WHERE value > 50"}]
    sinks = [{"id": "all", "type": "parquet", "from": "some", "target": f"{folder}/all"}, {"id": "high-only", "type": "parquet", "from": "high", "target": f"{folder}/high"}]
    said = compiler.run(spark, _document(sf_dir, steps, sinks=sinks)).rows_out
    there = {"all": spark.read.parquet(f"{folder}/all").count(), "high-only": spark.read.parquet(f"{folder}/high").count()}
    return spark.createDataFrame([(k, said[k], there[k]) for k in there], "sink string, rows_out long, rows_there long")


def smoke_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smoke run's rows: as many as it is allowed, at most."""
    folder = new_folder(spark, "smoke")
    summary = compiler.run(spark, _document(sf_dir, [{"id": "a", "type": "sql", "query": "SELECT event_id FROM input"}], sink={"type": "parquet", "target": f"{folder}/out"}), smoke=True)
    return spark.createDataFrame([(summary.rows_in, spark.read.parquet(f"{folder}/out").count())], "rows_in long, rows_out long")


def append_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered once, and some of it again: an append sink keeps both."""
    rows, target = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), f"{new_folder(spark, 'append')}/out"
    for part in (rows, rows.where("o_orderstatus = 'O'")):
        sink = ParquetSink(spark, target)
        sink.stage(part)
        sink.publish()
    return spark.read.parquet(target).groupBy("o_orderkey").agg(F.count("*").alias("copies"))


def upsert_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered once, and some of it again with other values: an upsert sink keeps the last of each key."""
    rows, target = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus"), f"{new_folder(spark, 'upsert')}/out"
    for part in (rows, rows.where("o_orderstatus = 'O'").withColumn("o_totalprice", -F.col("o_totalprice"))):
        sink = ParquetSink(spark, target, "upsert", ("o_orderkey",))
        sink.stage(part)
        sink.publish()
    return spark.read.parquet(target).select("o_orderkey", "o_totalprice")


def eval_weighted(predicted: DataFrame) -> DataFrame:
    """The weighted mean of the fields' accuracies: label 3, validity 1."""
    measured = predicted.agg(relational.accuracy(F.col("expected") == F.col("predicted")).alias("label"), relational.accuracy(F.col("valid")).alias("valid")).first()
    score = relational.weighted_score(measured.asDict(), {"label": 3.0})
    return predicted.sparkSession.createDataFrame([(round(score, 9),)], "weighted_score double")
