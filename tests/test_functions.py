import hashlib
import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.functions.validation import problems

FIELDS = [{"name": "category", "type": "utf8", "maxChars": 5}, {"name": "n", "type": "int64", "nullable": True}]


def test_canonical_inputs_equal_python(spark):
    data = [("a", 1, True, 1.5), ('q"\\\n\x0b\x1f\\u000B', -7, False, 1e16), (None, None, None, None), ("é漢😀/", 2**60, True, 1e-7)]
    df = spark.createDataFrame(data, "text string, n long, flag boolean, x double")
    got = [r[0] for r in df.select(C.canonical_inputs(df, ["x", "text", "n", "flag"])).collect()]
    for (text, n, flag, x), line in zip(data, got, strict=True):
        rest = C.canonical_json({"flag": flag, "n": n, "text": text})[:-1]
        assert line == f'{rest},"x":{C.shortest_double(x)}}}'


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_shortest_double_is_exact(x):
    assert float(C.shortest_double(x)) == x or math.isclose(float(C.shortest_double(x)), x, rel_tol=0)


@pytest.mark.parametrize(("x", "text"), [(1.0, "1.0"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (1e-5, "0.00001"), (1.5e-7, "1.5e-7"), (123.25, "123.25"), (-0.5, "-0.5")])
def test_double_text(x, text):
    assert C.shortest_double(x) == text


def test_work_key_is_the_digest_of_the_sorted_spec(spark):
    df = spark.createDataFrame([("printer on fire", "t-1")], "description string, id string")
    spec = C.work_spec(C.canonical_inputs(df, ["id", "description"]), operation="ai.extract", instruction="classify the ticket", schema={"type": "object"}, provider="mock", model="mock-1", params={"temperature": 0})
    value = {"operation": "ai.extract", "instruction": "classify the ticket", "inputs": {"description": "printer on fire", "id": "t-1"}, "output_schema": {"type": "object"}, "provider": "mock", "model": "mock-1", "params": {"temperature": 0}}
    assert df.select(C.work_key(spec)).first()[0] == hashlib.sha256(C.canonical_json(value).encode()).hexdigest()


def test_unit_key(spark):
    from millrace.sources.object_store import WorkUnit
    from millrace.streaming.checkpoint import unit_key

    df = spark.createDataFrame([("file:///a/é.parquet", 12, 1700000000000)], "u string, s long, m long")
    got = df.select(C.unit_key("p", F.col("u"), F.col("s"), F.col("m"))).first()[0]
    assert got == unit_key("p", WorkUnit("file:///a/é.parquet", 12, 1700000000000))


def test_mock_columns_equal_the_provider(spark):
    from millrace.operators.providers import MockProvider, Request

    fields = [{"name": "b", "type": "float64"}, {"name": "a", "type": "utf8"}, {"name": "c", "type": "bool"}, {"name": "d", "type": "int64"}]
    df = spark.createDataFrame([(f"ticket-{i:04d}",) for i in range(40)], "description string")
    given = C.canonical_inputs(df, ["description"])
    values = C.mock_values(given, "do", fields)
    for r in df.select("description", *(v.alias(k) for k, v in values.items()), C.mock_text(values, fields).alias("text")).collect():
        answer = MockProvider().invoke(Request("do", {"description": r["description"]}, C.output_schema(fields)))
        assert json.loads(answer.text) == {k: r[k] for k in values}
        assert answer.text == r["text"]


@pytest.mark.parametrize(
    ("text", "wrong"),
    [
        ('{"category": "a", "n": null}', []),
        ('{"category": "a", "n": 1.0}', ["`n` should be int64, not number"]),
        ('{"category": "a", "n": true}', ["`n` should be int64, not bool"]),
        ('{"category": "toolong", "n": 1, "x": 2}', ["`category` has 7 characters, more than 5", "`x` is not declared"]),
        ('{"category": null}', ["`category` is null but not nullable", "`n` is missing"]),
        ("[1]", ["output is not a JSON object"]),
        ("NaN", ["output is not valid JSON"]),
    ],
)
def test_all_problems_are_reported(text, wrong):
    assert problems(text, FIELDS)[1] == wrong
