"""From a pipeline document to DataFrames, and a run with its commit barrier."""

from __future__ import annotations

import importlib
import os
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import arrow_step, dispatch, semantic, sql_step
from millrace.operators.ledger import Ledger
from millrace.operators.providers import provider_for
from millrace.plans import spec as S
from millrace.session import materialize
from millrace.sinks.base import FlightSqlSink, JdbcSink, ParquetSink
from millrace.sources import object_store
from millrace.streaming.checkpoint import CheckpointLog

SMOKE_ROWS, SMOKE_TOKENS = 100, 50_000


@dataclass
class Summary:
    rows_in: int = 0
    rows_out: dict[str, int] = field(default_factory=dict)
    steps: dict[str, semantic.Counters] = field(default_factory=dict)
    units: int = 0
    nothing_to_do: bool = False


def ledger_path() -> str:
    return os.environ.get("MILLRACE_LEDGER_PATH") or os.path.join(os.getcwd(), "millrace-ledger.db")


def semantic_step(spark: SparkSession, t: Mapping, models: Mapping, smoke: bool = False) -> tuple[semantic.Step, object]:
    """The step and its provider; what can't run is refused here."""
    model = models[t["model"]]
    provider, budget, d = provider_for(model), t.get("budget") or {}, t.get("dispatch") or {}
    hints = dispatch.Hints(d.get("expectedRecords"), d.get("deadlineSeconds"), d.get("inputTokensPerRecord", dispatch.INPUT_TOKENS), d.get("outputTokensPerRecord", dispatch.OUTPUT_TOKENS), d.get("rateCard"))
    mode = dispatch.resolve_mode(spark, t.get("execution", "auto"), hints, provider.id, provider.has_batch)
    ceiling = budget.get("maxRunTokens")
    if smoke:
        ceiling = min(ceiling or SMOKE_TOKENS, SMOKE_TOKENS)
    step = semantic.Step(
        t["id"], t["type"], list(t["inputs"]), t["instruction"], [dict(f) for f in t["output"]["fields"]], model["model"],
        (t.get("validation") or {}).get("onInvalid", "fail"), budget.get("maxInputTokensPerRecord"), budget.get("maxOutputTokensPerRecord"), ceiling,
        (t.get("breaker") or {}).get("maxConsecutiveInvalid", 25), mode,
    )
    return step, provider


def _function(component: str):
    """A packaged function as `module:attribute`; its module names its output schema in the function's `schema`."""
    path = arrow_step.parse_component(component).path
    if path is None:
        raise NotImplementedError(f"`{component}` names an artifact of a registry, which has no client here; give module:attribute")
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def apply_transform(df: DataFrame, t: Mapping, spec: Mapping, ledger: Ledger | None, summary: Summary, smoke: bool) -> DataFrame:
    if t["type"] == "sql":
        return sql_step.run(df, t["query"], t["id"])
    if t["type"] == "wasm":
        component = arrow_step.parse_component(t["component"])
        allow = [*((spec.get("runtime") or {}).get("wasmOciAllowlist") or []), *filter(None, os.environ.get("MILLRACE_OCI_ALLOWLIST", "").split(","))]
        if not arrow_step.allowed(component, allow):
            raise PermissionError(f"step `{t['id']}`: its component is not on the allow-list")
        function, limits = _function(t["component"]), t.get("limits") or {}
        return arrow_step.run(df, function, function.schema(df), arrow_step.Limits(limits.get("maxInputBytes", arrow_step.MAX_BATCH_BYTES), limits.get("maxOutputBytes", arrow_step.MAX_BATCH_BYTES)))
    step, provider = semantic_step(df.sparkSession, t, spec["models"], smoke)
    out, summary.steps[t["id"]] = semantic.apply(df, step, provider, ledger)
    return out


def make_sink(spark: SparkSession, s: Mapping):
    mode, keys = s.get("mode", "append"), tuple(s.get("keys") or ())
    if s["type"] == "parquet":
        return ParquetSink(spark, s["target"], mode, keys)
    if s["type"] == "postgres":
        return JdbcSink(spark, s["target"], mode, keys, s.get("dsnEnv", "MILLRACE_POSTGRES_DSN"))
    return FlightSqlSink(s["endpoint"], s["target"], s.get("tokenEnv", "MILLRACE_FLIGHT_SQL_TOKEN"))


def run(spark: SparkSession, doc: Mapping, smoke: bool = False, smoke_rows: int = SMOKE_ROWS, ledger: Ledger | None = None) -> Summary:
    """Stage every sink, publish all, then mark the files done. A failure before publishing leaves no trace in any sink; one
    between two publications leaves the files unmarked, so a replay delivers again."""
    spec, name, summary, run_id = doc["spec"], doc["metadata"]["name"], Summary(), uuid4().hex
    kind = spec["source"]["format"]["type"]
    object_store.use_environment_credentials(spark)
    units = object_store.list_work_units(spark, spec["source"]["url"], kind)
    checkpoint = (spec.get("runtime") or {}).get("checkpoint")
    log = CheckpointLog(checkpoint["url"]) if checkpoint and not smoke else None
    if log:
        units = log.pending(name, units)
        if not units:
            summary.nothing_to_do = True
            return summary
        log.claim(name, units, run_id)
    summary.units = len(units)
    source = object_store.read(spark, units, kind)
    if smoke:
        source = source.limit(smoke_rows)
    frames = {"source": source}
    steps, bound = S.edges(spec)
    readers = Counter(p for _, p in [*steps, *bound])
    if any(t["type"].startswith("ai.") for t in spec.get("transforms") or []):
        ledger = ledger or Ledger(ledger_path())
    for (step, parent), t in zip(steps, spec.get("transforms") or [], strict=True):
        frames[step] = apply_transform(frames[parent], t, spec, ledger, summary, smoke)
        if readers[step] > 1 and t["type"] != "sql":
            frames[step] = materialize(frames[step])
    sinks, configs = [], [spec["sink"]] if spec.get("sink") else spec["sinks"]
    try:
        for (sink_id, parent), config in zip(bound, configs, strict=True):
            sink, counted = make_sink(spark, config), Observation()
            sinks.append(sink)
            sink.stage(frames[parent].observe(counted, F.count(F.lit(1)).alias("n")))
            summary.rows_out[sink_id] = counted.get["n"]
    except Exception:
        for sink in sinks:
            sink.drop()
        raise
    summary.rows_in = source.count()
    for sink in sinks:
        sink.publish()
    if log:
        log.complete(name, units, run_id)
    return summary


def explain(doc: Mapping) -> list[str]:
    """The plan's stages in words, without touching any data."""
    spec = doc["spec"]
    steps, bound = S.edges(spec)
    lines = [f"source: {spec['source']['format']['type']} at {spec['source']['url']}"]
    for (i, parent), t in zip(steps, spec.get("transforms") or [], strict=True):
        lines.append(f"{i}: {t['type']} from {parent}" + (f", model {t['model']}, on invalid {(t.get('validation') or {}).get('onInvalid', 'fail')}" if t["type"].startswith("ai.") else ""))
    configs = [spec["sink"]] if spec.get("sink") else spec.get("sinks") or []
    lines += [f"{i}: {s['type']} {s.get('mode', 'append')} to {s['target']} from {p}" for (i, p), s in zip(bound, configs, strict=True)]
    return lines
