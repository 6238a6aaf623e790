import json
import os

import pytest
import yaml

from millrace import cli
from millrace.operators import arrow_step, dispatch
from millrace.operators.ledger import Ledger
from millrace.plans import compiler, registry
from millrace.plans import spec as S
from millrace.sinks import base as sinks
from millrace.sources import generators, object_store
from millrace.streaming.checkpoint import CheckpointLog
from millrace.streaming.incremental import available_now


def document(**spec):
    return {
        "apiVersion": "millrace/v1alpha1", "kind": "Pipeline", "metadata": {"name": "demo"},
        "spec": {"models": {"m": {"provider": "mock", "model": "mock-1"}}, "source": {"type": "object_store", "url": "/tmp/in", "format": {"type": "parquet"}}, "transforms": [{"id": "a", "type": "sql", "query": "SELECT * FROM input"}], "sink": {"type": "parquet", "target": "/tmp/out"}} | spec,
    }


AI = {"id": "c", "type": "ai.classify", "model": "m", "inputs": ["description"], "instruction": "classify", "output": {"fields": [{"name": "category", "type": "utf8"}]}}


def issues(doc):
    return S.validate(S.load(yaml.safe_dump(doc)))


def test_a_valid_document():
    assert issues(document()) == []
    assert issues(document(transforms=[], sink={"type": "postgres", "target": "s.t", "mode": "upsert", "keys": ["id"]})) == []


@pytest.mark.parametrize(
    ("spec", "path"),
    [
        ({"sink": None}, "spec: exactly one"),
        ({"transforms": [AI | {"model": "other"}]}, "spec.transforms[0].model"),
        ({"transforms": [AI | {"inputs": []}]}, "spec.transforms[0].inputs"),
        ({"transforms": [AI | {"type": "ai.generate"}]}, "spec.transforms[0].output.fields[0]"),
        ({"transforms": [{"id": "a", "type": "sql", "query": " "}]}, "spec.transforms[0].query"),
        ({"transforms": [{"id": "a", "type": "sql", "query": "SELECT 1", "from": "b"}]}, "spec: `a` reads from `b`"),
        ({"transforms": [{"id": "a", "type": "sql", "query": "SELECT 1", "from": "a"}]}, "spec: `a` reads from itself"),
        ({"transforms": [{"id": "a", "type": "sql", "query": "SELECT 1", "from": "b"}, {"id": "b", "type": "sql", "query": "SELECT 1", "from": "a"}]}, "spec: `a` is part of"),
        ({"transforms": [{"id": "a", "type": "sql", "query": "SELECT 1"}, {"id": "b", "type": "sql", "query": "SELECT 1", "from": "source"}]}, "spec: nothing reads from `a`"),
        ({"sink": {"type": "postgres", "target": "t"}}, "spec.sink.target"),
        ({"sink": {"type": "postgres", "target": "s.t", "mode": "upsert"}}, "spec.sink.keys"),
        ({"sink": {"type": "flightSql", "endpoint": "ftp://x", "target": "a.b", "mode": "upsert"}}, "spec.sink.endpoint"),
        ({"source": {"type": "object_store", "url": "ftp://x", "format": {"type": "parquet"}}}, "spec.source.url"),
        ({"source": {"type": "object_store", "url": "s3://b/x", "format": {"type": "parquet"}}, "runtime": {"residency": {"allowedLocations": ["eu"]}}}, "spec.source.location"),
        ({"runtime": {"targetBatchBytes": 10, "maxInflightBytes": 5}}, "spec.runtime.maxInflightBytes"),
    ],
)
def test_issues(spec, path):
    assert any(i.startswith(path) for i in issues(document(**spec))), issues(document(**spec))


def test_strict_loading_reports_everything():
    doc = document()
    doc["spec"]["extra"], doc["spec"]["source"]["url"] = 1, 3
    with pytest.raises(S.SpecError) as e:
        S.load(yaml.safe_dump(doc))
    assert len(e.value.issues) == 2
    with pytest.raises(S.SpecError):
        S.load("a: 1\na: 2")
    assert json.dumps(S.json_schema())


def test_urls():
    assert object_store.hadoop_url("S3://b/k") == "s3a://b/k"
    assert object_store.hadoop_url("https://acc.blob.core.windows.net/c/p/x") == "abfss://c@acc.dfs.core.windows.net/p/x"
    assert S.scheme_of("https://example.com/x") is None


@pytest.fixture
def folder(spark, tmp_path):
    generators.tickets(spark, 40).coalesce(2).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_run_with_checkpoint_and_fan_out(spark, folder):
    doc = document(
        source={"type": "object_store", "url": str(folder / "in"), "format": {"type": "parquet"}},
        transforms=[{"id": "low", "type": "sql", "query": "SELECT id, description FROM input WHERE id < 10"}, AI],
        sink=None,
        sinks=[{"id": "x", "type": "parquet", "target": str(folder / "x"), "from": "low"}, {"id": "y", "type": "parquet", "target": str(folder / "y")}],
        runtime={"checkpoint": {"url": f"file://{folder}/ck"}},
    )
    doc["spec"].pop("sink")
    assert issues(doc) == []
    ledger = Ledger()
    smoke = compiler.run(spark, doc, smoke=True, smoke_rows=5, ledger=ledger)
    assert smoke.rows_in == 5
    s = compiler.run(spark, doc, ledger=ledger)
    assert s.rows_out["x"] == 10 and s.rows_out["y"] == 10 and s.rows_in == 40
    assert compiler.run(spark, doc, ledger=ledger).nothing_to_do
    generators.tickets(spark, 3).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    s = compiler.run(spark, doc, ledger=ledger)
    assert s.units == 1 and s.steps["c"].calls == 0 and s.steps["c"].reused == 3
    assert "category" in spark.read.parquet(str(folder / "y")).columns
    assert any("ai.classify" in line for line in compiler.explain(doc))


def test_failed_run_commits_nothing(spark, folder):
    doc = document(source={"type": "object_store", "url": str(folder / "in"), "format": {"type": "parquet"}}, transforms=[{"id": "bad", "type": "sql", "query": "SELECT CAST(description AS BIGINT) AS n FROM input"}], sink={"type": "parquet", "target": str(folder / "out")}, runtime={"checkpoint": {"url": str(folder / "ck")}})
    with pytest.raises(Exception):
        compiler.run(spark, doc)
    assert not [p for p in os.listdir(folder) if p.startswith("out")]
    assert not CheckpointLog(str(folder / "ck")).done


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1, "s": "x"}\n{"v": 2, "s": null}\n')
    (tmp_path / "skip.txt").write_text("no")
    units = object_store.list_work_units(spark, str(tmp_path), "ndjson")
    assert len(units) == 1
    assert object_store.read(spark, units, "ndjson").agg({"v": "sum"}).first()[0] == 3


def test_sink_conformance_and_upsert(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, label string")
    for _ in range(2):
        assert sinks.commit_barrier_problems(spark, lambda: sinks.ParquetSink(spark, target), lambda: sinks.rows_in(spark, target), df) == []
    up = sinks.ParquetSink(spark, str(tmp_path / "u"), "upsert", ("id",))
    up.stage(df)
    up.publish()
    up = sinks.ParquetSink(spark, str(tmp_path / "u"), "upsert", ("id",))
    up.stage(spark.createDataFrame([(1, "x"), (4, "d"), (1, "y")], "id long, label string").coalesce(1))
    up.publish()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "u")).collect()), key=lambda r: r[0]) == [(1, "y"), (2, None), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        sinks.ParquetSink(spark, str(tmp_path / "v"), "upsert", ("nope",)).stage(df)
    with pytest.raises(ValueError):
        sinks.check_schema(spark.createDataFrame([([1],)], "a array<int>").schema)


def test_jdbc_statements(spark, monkeypatch):
    monkeypatch.setenv("DSN", "jdbc:postgresql://x/y")
    s = sinks.JdbcSink(spark, 'a.b"c', "upsert", ("id",), "DSN")
    s.columns = ["id", "v"]
    assert s.statements()[0].startswith('INSERT INTO "a"."b""c" ("id", "v") SELECT DISTINCT ON ("id")') and s.statements()[0].endswith('DO UPDATE SET "v" = EXCLUDED."v"')


def test_checkpoint_log_survives_a_torn_line(tmp_path):
    unit = object_store.WorkUnit("file:///a", 1, 2)
    log = CheckpointLog(str(tmp_path))
    log.claim("p", [unit], "r")
    log.complete("p", [unit], "r")
    with open(log.path, "a") as f:
        f.write('{"compl')
    again = CheckpointLog(str(tmp_path))
    assert again.pending("p", [unit]) == []
    assert again.pending("p", [object_store.WorkUnit("file:///a", 1, 3)])
    lines = open(log.path).read().splitlines()
    with open(log.path, "w") as f:
        f.write(lines[0][:10] + "\n" + lines[1] + "\n")
    with pytest.raises(RuntimeError):
        CheckpointLog(str(tmp_path))


def test_a_checkpoint_log_is_local():
    with pytest.raises(ValueError):
        CheckpointLog("s3://bucket/state")


def test_components_of_a_registry_are_refused_in_words():
    with pytest.raises(NotImplementedError, match="registry"):
        compiler._function("oci://reg.io/team/f@sha256:" + "a" * 64)


def test_arrow_steps(spark):
    assert arrow_step.conformance(arrow_step.gross("amount")) == []
    df = spark.range(10).selectExpr("id", "id * 1.5D AS amount")
    with pytest.raises(Exception):
        arrow_step.run(df, lambda b: b, "id long, amount double", arrow_step.Limits(max_output_bytes=1)).collect()
    digest = "a" * 64
    c = arrow_step.parse_component(f"oci://reg.io/team/f@sha256:{digest}")
    assert arrow_step.allowed(c, ["reg.io/team"]) and arrow_step.allowed(c, [f"sha256:{digest}"]) and not arrow_step.allowed(c, ["reg.io/te"]) and not arrow_step.allowed(c, [])
    with pytest.raises(ValueError):
        arrow_step.parse_component("oci://reg.io/team/f:latest")


def test_dispatch(spark):
    rows = {(r.rate_card, r.records, r.deadline): r.recommended for r in dispatch.frontier(spark).collect()}
    assert len(rows) == 24 and rows["openai-compat-stub", 100_000, 300] == "online" and rows["openai-compat-stub", 100, 86_400] == "batch"
    assert dispatch.resolve_mode(spark, "auto", dispatch.Hints(), "mock", True) == "online"
    assert dispatch.resolve_mode(spark, "auto", dispatch.Hints(1000, 3600), "mock", True) == "batch"
    with pytest.raises(ValueError):
        dispatch.resolve_mode(spark, "batch", dispatch.Hints(), "openai-compat", False)
    assert "| mock | 100000 | 300s | batch | 540.0000 | 156.2 |" in dispatch.to_markdown(dispatch.frontier(spark))


def test_stream_of_files(spark, folder):
    from millrace.operators import sql_step

    schema = spark.read.parquet(str(folder / "in")).schema
    run = lambda: available_now(spark, str(folder / "in"), schema, "parquet", lambda d: sql_step.run(d, "SELECT id * 2 AS twice FROM input"), str(folder / "s"), str(folder / "c"))
    run()
    run()
    assert spark.read.parquet(str(folder / "s")).count() == 40


def test_cli(tmp_path, capsys):
    path = tmp_path / "p.yaml"
    path.write_text(yaml.safe_dump(document()))
    assert cli.main(["validate", str(path)]) == 0 and cli.main(["explain", str(path), "--json"]) == 0
    bad = document()
    bad["kind"] = "Other"
    path.write_text(yaml.safe_dump(bad))
    assert cli.main(["validate", str(path)]) == 2
    assert cli.main(["inspect", "connector", "parquet"]) == 0 and cli.main(["inspect", "connector", "none"]) == 1
    assert registry.find("adbc")["level"] == "planned"
