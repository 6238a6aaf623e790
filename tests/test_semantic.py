import ctypes
import gc
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate, relational, review, semantic
from millrace.operators.ledger import Ledger
from millrace.operators.providers import MockProvider, Provider, ProviderFault, Request, Response

FIELDS = [{"name": "category", "type": "utf8"}, {"name": "score", "type": "float64"}]


def step(**kw):
    return semantic.Step(**({"id": "s", "operation": "ai.classify", "inputs": ["description"], "instruction": "classify the ticket", "fields": FIELDS, "model": "mock-1"} | kw))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, description string")


class Scripted(Provider):
    id, has_batch = "mock", False

    def __init__(self, answers):
        self.answers, self.calls = answers, 0

    def invoke(self, request: Request) -> Response:
        self.calls += 1
        text = self.answers[(self.calls - 1) % len(self.answers)]
        return Response(text, 1, 1, f"r{self.calls}")


GOOD, BAD = '{"category": "a", "score": 1}', "nothing"


@pytest.mark.parametrize("mode", ["online", "batch"])
def test_work_is_paid_for_once(spark, mode):
    provider, ledger = MockProvider(), Ledger()
    df = rows(spark, [f"dup-{i % 20:04d}" for i in range(200)])
    out, n = semantic.apply(df, step(mode=mode), provider, ledger)
    assert out.columns == ["id", "description", "category", "score"]
    assert out.count() == 200 and provider.calls == n.calls == 20 and (n.seen, n.reused) == (200, 180)
    again, n = semantic.apply(df, step(mode=mode), provider, ledger)
    assert provider.calls == 20 and (n.calls, n.reused, n.tokens) == (0, 200, 0) and again.count() == 200
    assert ledger.counts() == {"pending": 0, "submitted": 0, "completed": 20, "failed": 0}


def test_material_changes_are_new_work(spark):
    df = rows(spark, ["x"])
    keys = {semantic.keyed(df, s, "mock").first()["__key"] for s in (step(), step(operation="ai.extract"), step(instruction="other"), step(model="m2"), step(max_output_tokens=9))}
    assert len(keys) == 5


def test_breaker_counts_invalid_outputs_in_a_row(spark):
    provider = Scripted([BAD])
    with pytest.raises(semantic.BreakerTripped):
        semantic.apply(rows(spark, [f"t{i}" for i in range(5)]), step(on_invalid="drop", max_consecutive_invalid=3), provider, Ledger())
    assert provider.calls == 3
    provider = Scripted([BAD, BAD, GOOD])
    out, n = semantic.apply(rows(spark, [f"t{i}" for i in range(6)]), step(on_invalid="drop", max_consecutive_invalid=3), provider, Ledger())
    assert (out.count(), n.dropped) == (2, 4)
    # In the order of arrival, so every third answer is good.
    assert sorted(r["description"] for r in out.collect()) == ["t2", "t5"]


def test_a_batch_is_held_to_the_ceiling_as_a_whole(spark):
    provider, ledger, df = MockProvider(), Ledger(), rows(spark, [f"t{i}" for i in range(50)])
    with pytest.raises(semantic.CeilingReached):
        semantic.apply(df, step(mode="batch", max_run_tokens=1000), provider, ledger)
    assert provider.calls == 0 and ledger.counts()["submitted"] == 0
    out, n = semantic.apply(df, step(mode="batch", max_run_tokens=100_000), provider, ledger)
    assert out.count() == n.calls == 50


def test_jobs_of_other_inputs_are_taken_up_too(spark):
    provider, ledger = MockProvider(), Ledger()
    semantic.POLL_SECONDS = 0
    left = semantic.keyed(rows(spark, ["old"]), step(mode="batch"), "mock").first()
    job = provider.submit_batch([(left["__key"], Request("classify the ticket", json.loads(left["__inputs"]), step().schema))])
    ledger.ensure_pending(left["__key"], left["__spec"])
    ledger.mark_submitted(left["__key"], job)
    out, n = semantic.apply(rows(spark, ["new"]), step(mode="batch"), provider, ledger)
    assert out.count() == 1 and ledger.counts()["completed"] == 2 and n.calls == 1


def test_a_long_ledger_is_carried_over_in_parts(spark, monkeypatch):
    from millrace.operators import ledger as module

    monkeypatch.setattr(module, "PART", 7)
    provider, ledger, df = MockProvider(), Ledger(), rows(spark, [f"t{i}" for i in range(30)])
    semantic.apply(df, step(), provider, ledger)
    out, n = semantic.apply(df, step(), provider, ledger)
    assert out.count() == 30 and n.calls == 0 and ledger.snapshot(spark).count() == 30


def test_budgets_and_ceiling(spark):
    provider = MockProvider()
    out, n = semantic.apply(rows(spark, ["x" * 4000, "y"]), step(on_invalid="drop", max_input_tokens=200), provider, Ledger())
    assert provider.calls == 1 and n.dropped == 1 and out.count() == 1
    with pytest.raises(semantic.CeilingReached):
        semantic.apply(rows(spark, ["a", "b"]), step(max_run_tokens=10), provider, Ledger())
    with pytest.raises(semantic.InvalidOutput):
        semantic.apply(rows(spark, ["a"]), step(max_output_tokens=0), provider, Ledger())


def test_review_withholds_until_a_person_decides(spark):
    ledger, provider, df = Ledger(), Scripted([BAD]), rows(spark, ["a", "b"])
    out, n = semantic.apply(df, step(on_invalid="review"), provider, ledger)
    assert out.count() == 0 and n.withheld == 2 and ledger.review_counts()["pending"] == 2
    first, second = (r["work_key"] for r in ledger.reviews())
    with pytest.raises(ValueError):
        review.accept(ledger, first, '{"category": 1}')
    review.accept(ledger, first, GOOD)
    review.reject(ledger, second)
    out, _ = semantic.apply(df, step(on_invalid="review"), provider, ledger)
    assert out.count() == 1 and provider.calls == 2
    assert ledger.item(first)["provider"] == "human-review"
    assert review.export(ledger) == ""


def test_interrupted_batch_is_taken_up(spark):
    provider, ledger, df = MockProvider(), Ledger(), rows(spark, ["a", "b", "c"])
    semantic.POLL_SECONDS = 0
    asked = [(r["__key"], Request("classify the ticket", json.loads(r["__inputs"]), step().schema)) for r in semantic.keyed(df, step(mode="batch"), "mock").collect()]
    job = provider.submit_batch(asked)
    for key, _ in asked:
        ledger.ensure_pending(key, "{}")
        ledger.mark_submitted(key, job)
    out, n = semantic.apply(df, step(mode="batch"), provider, ledger)
    assert out.count() == 3 and provider.calls == 3 and n.calls == 0


def test_provider_fault_fails_the_item(spark):
    class Broken(Scripted):
        def invoke(self, request):
            raise ProviderFault("timeout", "late")

    ledger = Ledger()
    with pytest.raises(ProviderFault):
        semantic.apply(rows(spark, ["a"]), step(), Broken([]), ledger)
    assert ledger.counts()["failed"] == 1


def test_completed_items_never_change():
    from millrace.operators.ledger import Result

    ledger = Ledger()
    ledger.ensure_pending("k", "{}")
    assert not ledger.ensure_pending("k", "{}")
    assert ledger.complete("k", Result("1", "p", "m", "r", 1, 1))
    assert not ledger.complete("k", Result("2", "p", "m", "r", 1, 1))
    assert not ledger.mark_failed("k", "late") and not ledger.mark_submitted("k", "x")
    assert ledger.state("k") == "completed"


def test_reuse_report(spark):
    from millrace.operators import reuse

    found = {s.id: s for s in reuse.suite(spark, step())}
    numbers = lambda s: (s.records, s.calls, s.reused)
    assert [numbers(found[k]) for k in ("first_pass", "replay", "incremental", "duplicates")] == [(50, 50, 0), (50, 0, 50), (45, 10, 35), (200, 20, 180)]
    assert found["replay"].tokens == 0 and found["first_pass"].tokens > 0 and found["replay"].reuse_percent == 100
    assert found["duplicates"].savings_percent == pytest.approx(90) and found["duplicates"].reuse_percent == pytest.approx(90)
    assert len(json.loads(reuse.as_json(list(found.values())))["scenarios"]) == 4


def test_answers_in_code_fences_are_taken(spark):
    out, n = semantic.apply(rows(spark, ["a"]), step(), Scripted(["```json\n" + GOOD + "\n```"]), Ledger())
    assert out.first()["category"] == "a" and n.calls == 1


def test_timestamp_outputs_are_refused():
    with pytest.raises(ValueError):
        step(fields=[{"name": "t", "type": "timestamp"}])


def test_macro_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a"), ("b", "b")], "e string, p string")
    assert relational.macro_f1(df, "e", "p").first()[0] == pytest.approx((2 / 3 + 0.8) / 2)


def test_evaluation(spark, tmp_path):
    corpus = {"name": "c", "instruction": "do", "fields": [{"name": "category", "type": "utf8"}, {"name": "urgent", "type": "bool"}], "weights": {"category": 3}, "items": [{"id": str(i), "input": {"d": f"t{i}"}, "expected": {"category": " A ", "urgent": True}} for i in range(4)]}
    answers = ['{"category": "a", "urgent": true}', '{"category": "b", "urgent": true}', "x", '{"category": "a", "urgent": false}']
    items, report = evaluate.run(spark, corpus, Scripted(answers), prices=(1.0, 2.0))
    assert report["schemaValid"] == 3 and [f["accuracy"] for f in report["fields"]] == [0.5, 0.5] and report["weightedScore"] == 0.5
    assert report["costUsd"] == pytest.approx(12e-6)
    assert evaluate.persist(items, report, str(tmp_path), "m/1").endswith("-mock-m_1")
    with pytest.raises(ValueError):
        evaluate.load_corpus("fields: [{name: a, type: utf8}]\nitems: [{id: x, expected: {}}]")


def memory(what):
    return int(re.search(rf"{what}:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1000


def grown(run):
    """MB that this process takes beyond what it had, at most, while run runs."""
    run(1)  # what is imported and kept anyway
    gc.collect()
    ctypes.CDLL(None).malloc_trim(0)
    Path("/proc/self/clear_refs").write_text("5")
    before = memory("VmRSS")
    run(800)
    return memory("VmHWM") - before


def long_texts(spark, n):
    """80 MB of texts for 800 rows."""
    return spark.range(n).select("id", F.repeat(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(n))), 256), 1600).alias("description"))


def test_a_batch_is_not_held_in_memory(spark):
    def run(n):
        out, found = semantic.apply(long_texts(spark, n), step(mode="batch"), MockProvider(), Ledger())
        assert found.calls == out.count() == n

    assert grown(run) < 40


def test_work_of_passes_through_one_ledger_is_not_held_in_memory(spark):
    def run(n):
        provider, ledger = MockProvider(), Ledger()
        for calls in (n, 0):
            _, found = semantic.apply(long_texts(spark, n), step(), provider, ledger)
            assert (found.seen, found.calls) == (n, calls)

    assert grown(run) < 40


def test_work_in_review_is_not_held_in_memory(spark):
    def run(n):
        ledger = Ledger()
        _, found = semantic.apply(long_texts(spark, n), step(on_invalid="review", max_input_tokens=100), MockProvider(), ledger)
        assert found.withheld == ledger.review_counts()["pending"] == n

    assert grown(run) < 40


def test_packed_specs_are_read_whole():
    ledger, spec = Ledger(), '{"inputs":{"description":"é\\u0000"},"model":"m"}'
    ledger.ensure_pending("k", spec)
    ledger.enqueue_review("k", "s", "odd", None)
    assert ledger.item("k")["spec_json"] == ledger.reviews()[0]["spec_json"] == spec and ledger.inputs("k") == {"description": "é\0"}


def test_arrival_is_the_queries_order_not_the_scans(spark, tmp_path):
    from millrace.plans import catalog, runtime_queries
    from tests.compare import duck, rows as plain

    folder = tmp_path / "documents.parquet"
    texts = spark.createDataFrame([(i, f"text {i} " + "word " * (20 * i)) for i in range(1, 200)] + [(None, "none")], "doc_id long, text string")
    for part in ("doc_id <= 20", "doc_id > 20 OR doc_id IS NULL"):  # Spark reads the larger file first
        texts.where(part).coalesce(1).write.mode("append").parquet(str(folder))
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    expected = con.execute(catalog.ORACLES["semantic_ceiling"]).fetch_df()
    assert plain(runtime_queries.semantic_ceiling(spark, str(tmp_path)).toPandas()) == plain(expected)
