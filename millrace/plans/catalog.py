"""Queries over the reference tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.functions import validation
from millrace.operators import arrow_step, dispatch, relational, sql_step
from millrace.plans import runtime_queries as runtime
from millrace.plans import spec, sql_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

INSTRUCTION = "classify the record"
FIELDS = [{"name": "category", "type": "utf8"}, {"name": "score", "type": "float64"}, {"name": "urgent", "type": "bool"}]
GENERATED = [{"name": "summary", "type": "utf8", "maxChars": 9}]
PARAMS = {"max_output_tokens": None, "temperature": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _sql(name: str, source: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: sql_step.run(table(spark, sf_dir, source), text, name)
    ORACLES[name] = f"WITH input AS (SELECT * FROM {source}) SELECT * FROM ({text}) AS q"


for _name, _source, _text in sql_queries.STEPS:
    _sql(_name, _source, _text)


def _answers(df: DataFrame, inputs: list[str], fields: list[dict]) -> dict:
    """Canonical inputs, answer columns, JSON text and token counts of the deterministic provider."""
    given = C.canonical_inputs(df, inputs)
    values = C.mock_values(given, INSTRUCTION, fields)
    text = C.mock_text(values, fields)
    taken, made = C.mock_tokens(given, INSTRUCTION, text)
    return {"inputs": given, "values": values, "text": text, "input_tokens": taken, "output_tokens": made}


def _key(given, operation: str, fields: list[dict]):
    return C.work_key(C.work_spec(given, operation=operation, instruction=INSTRUCTION, schema=C.output_schema(fields), provider="mock", model="mock-1", params=PARAMS))


_SEED = "CAST(('0x' || substr(sha256({inputs} || 'classify the record'), 1, 16)) AS UBIGINT)"
_REST = C.canonical_json({"instruction": INSTRUCTION, "model": "mock-1", "operation": "ai.classify", "output_schema": C.output_schema(FIELDS), "params": PARAMS, "provider": "mock"})[1:]
_TEXT_INPUT = "to_json({'text': text})::VARCHAR"
_KEYED = f"SELECT doc_id, text, {_TEXT_INPUT} AS inputs, sha256('{{\"inputs\":' || {_TEXT_INPUT} || ',{_REST.replace(chr(39), chr(39) * 2)}') AS work_key FROM documents"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts normalised in SQL, then classified: every row with its work key and typed answer."""
    rows = sql_step.run(table(spark, sf_dir, "documents"), "SELECT doc_id, lower(trim(text)) AS text, lang FROM input WHERE text IS NOT NULL")
    a = _answers(rows, ["text"], FIELDS)
    return rows.select("doc_id", "lang", _key(a["inputs"], "ai.classify", FIELDS).alias("work_key"), *(v.alias(k) for k, v in a["values"].items()))


@query(f"SELECT conv_id, turn, sha256('{{\"inputs\":' || to_json({{'role': role, 'text': text}})::VARCHAR || ',{_REST}') AS work_key FROM conversations")
def canonical_work_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", _key(C.canonical_inputs(rows, ["text", "role"]), "ai.classify", FIELDS).alias("work_key"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.estimate_tokens(F.col("text")).alias("tokens"))


_SCHEMA_TEXT = C.canonical_json(C.output_schema(FIELDS))
_ESTIMATE = f"CAST(ceil((strlen({_TEXT_INPUT}) + {len(INSTRUCTION) + len(_SCHEMA_TEXT)}) / 4.0) AS BIGINT)"


def _estimate(df: DataFrame):
    return F.ceil((F.octet_length(C.canonical_inputs(df, ["text"])) + len(INSTRUCTION) + len(_SCHEMA_TEXT)) / F.lit(4)).cast("long")


@query(f"SELECT {_ESTIMATE} > 400 AS over, count(*) AS n, CAST(sum({_ESTIMATE} + 256) AS BIGINT) AS projected FROM documents GROUP BY 1")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(_estimate(docs).alias("est"))
    return rows.groupBy((F.col("est") > 400).alias("over")).agg(F.count("*").alias("n"), F.sum(F.col("est") + 256).alias("projected"))


@query(f"SELECT doc_id, consumed FROM (SELECT doc_id, CAST(sum({_ESTIMATE} + 256) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consumed FROM documents) WHERE consumed <= 50000")
def run_ceiling_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return relational.within_ceiling(docs.select("doc_id", (_estimate(docs) + 256).alias("cost")), F.col("cost"), ["doc_id"], 50_000).select("doc_id", "consumed")


def _mock_sql(select: str, inputs: str, source: str) -> str:
    return f"WITH r AS (SELECT *, {_SEED.format(inputs=inputs)} AS seed, strlen({inputs}) AS size FROM {source}) SELECT {select} FROM r"


@query(_mock_sql("conv_id, turn, 'category-' || printf('%04x', seed % 65535) AS category, CAST((CAST(seed AS HUGEINT) + 1) % 18446744073709551616 % 1000 AS DOUBLE) / 10 AS score, (CAST(seed AS HUGEINT) + 2) % 2 = 0 AS urgent", "to_json({'role': role, 'text': text})::VARCHAR", "conversations"))
def mock_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", *(v.alias(k) for k, v in _answers(rows, ["role", "text"], FIELDS)["values"].items()))


_MADE = "'{\"amount\":' || CAST(seed % 1000 AS VARCHAR) || ',\"vendor\":\"vendor-' || printf('%04x', (CAST(seed AS HUGEINT) + 1) % 18446744073709551616 % 65535) || '\"}'"


@query(_mock_sql(f"doc_id, CAST(seed % 1000 AS BIGINT) AS amount, CAST((size + 19) // 4 AS BIGINT) AS input_tokens, CAST(strlen({_MADE}) // 4 AS BIGINT) AS output_tokens, {_MADE} AS output", _TEXT_INPUT, "documents"))
def mock_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    a = _answers(rows, ["text"], [{"name": "vendor", "type": "utf8"}, {"name": "amount", "type": "int64"}])
    return rows.select("doc_id", a["values"]["amount"].alias("amount"), "text", a["input_tokens"].alias("input_tokens"), a["output_tokens"].alias("output_tokens"), a["text"].alias("output")).drop("text")


@query(_mock_sql("doc_id, left('summary-' || printf('%04x', seed % 65535), 9) AS summary", _TEXT_INPUT, "documents"))
def mock_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", _answers(rows, ["text"], GENERATED)["values"]["summary"].alias("summary"))


@query(f"WITH k AS ({_KEYED}) SELECT count(*) AS records, count(DISTINCT work_key) AS calls, count(*) - count(DISTINCT work_key) AS reused, round(100.0 * (count(*) - count(DISTINCT work_key)) / count(*), 6)::DOUBLE AS reuse_pct FROM k")
def dedup_dispatch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per_key = docs.select(_key(C.canonical_inputs(docs, ["text"]), "ai.classify", FIELDS).alias("work_key")).groupBy("work_key").agg(F.count("*").alias("n"))
    sums = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("calls"))
    reused = F.col("records") - F.col("calls")
    return sums.select("records", "calls", reused.alias("reused"), F.round(relational.reuse_percent(reused, F.col("records")), 6).alias("reuse_pct"))


@query("""WITH r AS (SELECT quality = 1 AS ok, row_number() OVER (ORDER BY doc_id) AS position FROM labels),
i AS (SELECT *, sum(ok::INT) OVER (ORDER BY position) AS island FROM r),
n AS (SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY island ORDER BY position) AS BIGINT) AS run FROM i)
SELECT position, run FROM n WHERE NOT ok AND run = 2""")
def breaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.breaker_trips(table(spark, sf_dir, "labels"), F.col("quality") == 1, ["doc_id"], 2)
    return rows.select(F.col("position").cast("long").alias("position"), "run")


@query("SELECT CASE WHEN quality = 1 THEN 'kept' ELSE 'withheld' END AS outcome, count(*) AS n FROM labels GROUP BY 1")
def oninvalid_policy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    kept, held = relational.split_by_policy(rows, F.when(F.col("quality") != 1, F.lit("low quality")), "review")
    both = kept.withColumn("outcome", F.lit("kept")).unionByName(held.withColumn("outcome", F.lit("withheld")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


_LEDGER = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'completed' WHEN l.toxic = 1 THEN 'submitted' ELSE 'failed' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("""WITH staged AS (SELECT 'r' || conv_id || '-' || turn AS record_id, md5(text) AS input_hash, sha256(text) AS work_key FROM conversations),
results AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'r' || conv_id || '-' || turn END AS record_id, md5(text) AS input_hash FROM conversations)
SELECT conv_id, turn, coalesce(a.k, b.k) AS work_key FROM results r
LEFT JOIN (SELECT record_id, min(work_key) AS k FROM staged GROUP BY 1) a ON a.record_id = r.record_id
LEFT JOIN (SELECT input_hash, min(work_key) AS k FROM staged GROUP BY 1) b ON b.input_hash = r.input_hash""")
def batch_result_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    record, digest = F.concat(F.lit("r"), F.col("conv_id"), F.lit("-"), F.col("turn")), F.md5(F.col("text").cast("binary"))
    staged = rows.select(record.alias("record_id"), digest.alias("input_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("work_key"))
    results = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, record).alias("record_id"), digest.alias("input_hash"))
    return relational.fallback_join(results, staged, "record_id", "input_hash", "work_key").select("conv_id", "turn", "work_key")


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return relational.last_write_wins(rows, ["o_custkey"], "o_orderkey")


@query("SELECT n_name, sha256(encode('demo') || '\\x00'::BLOB || encode('file:///data/' || n_name) || '\\x00'::BLOB || unhex(printf('%016x', n_nationkey * 1000)) || unhex(printf('%016x', CAST(1700000000000 AS BIGINT) + n_nationkey))) AS unit_key FROM nation")
def unit_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select("n_name", C.unit_key("demo", F.concat(F.lit("file:///data/"), F.col("n_name")), n * 1000, n + 1_700_000_000_000).alias("unit_key"))


_CARDS = ", ".join(f"('{k}', " + ", ".join(f"{float(x)!r}::DOUBLE" for x in dispatch.RATE_CARDS[k]) + ")" for k in dispatch.SWEEP[0])


@query(f"""WITH cards(rate_card, oi, oo, bi, bo, os, c, bf, bw, bs) AS (VALUES {_CARDS}),
g AS (SELECT *, CAST(records AS DOUBLE) AS n FROM cards, (SELECT unnest([100::BIGINT, 1000, 10000, 100000]) AS records), (SELECT unnest([300::BIGINT, 3600, 86400]) AS deadline)),
e AS (SELECT rate_card, records, deadline, (n * 800 * oi + n * 200 * oo) / 1e6 AS online_usd, ceil(n / c) * os AS online_seconds, (n * 800 * bi + n * 200 * bo) / 1e6 AS batch_usd, bf + bw + n * bs AS batch_seconds FROM g)
SELECT rate_card, records, deadline, round(online_usd, 6) AS online_usd, round(online_seconds, 6) AS online_seconds, round(batch_usd, 6) AS batch_usd, round(batch_seconds, 6) AS batch_seconds,
CASE WHEN online_seconds <= deadline AND batch_seconds <= deadline THEN CASE WHEN batch_usd < online_usd THEN 'batch' WHEN online_usd < batch_usd THEN 'online' WHEN batch_seconds <= online_seconds THEN 'batch' ELSE 'online' END
WHEN online_seconds <= deadline THEN 'online' WHEN batch_seconds <= deadline THEN 'batch' WHEN online_seconds <= batch_seconds THEN 'online' ELSE 'batch' END AS recommended FROM e""")
def dispatch_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.frontier(spark)
    return rows.withColumns({c: F.round(c, 6) for c in ("online_usd", "online_seconds", "batch_usd", "batch_seconds")})


_PRED = f"SELECT l.doc_id, CAST(l.toxic AS VARCHAR) AS expected, CAST({_SEED.format(inputs=_TEXT_INPUT)} % 2 AS VARCHAR) AS predicted, l.quality = 1 AS valid, strlen(d.text) AS latency FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expected values, the provider's seed as a prediction, the text's size as a latency."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    seed = C.mock_seed(C.canonical_inputs(rows, ["text"]), INSTRUCTION)
    return rows.select("doc_id", F.col("toxic").cast("string").alias("expected"), (seed % 2).cast("long").cast("string").alias("predicted"), (F.col("quality") == 1).alias("valid"), F.octet_length("text").alias("latency"))


@query(f"WITH p AS ({_PRED}) SELECT round(avg(CASE WHEN valid AND expected = predicted THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) FILTER (valid) AS schema_valid FROM p")
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = F.col("valid") & C.values_match(F.col("expected"), F.col("predicted"), "utf8")
    return _predicted(spark, sf_dir).agg(F.round(relational.accuracy(match), 9).alias("accuracy"), F.count_if("valid").alias("schema_valid"))


@query(f"""WITH p AS ({_PRED}), c AS (SELECT DISTINCT expected AS class FROM p WHERE expected IS NOT NULL),
f AS (SELECT class, count(*) FILTER (expected = class) AS have, count(*) FILTER (predicted = class) AS said, count(*) FILTER (expected = class AND predicted = class) AS hit FROM c, p GROUP BY class)
SELECT round(avg(CASE WHEN have + said = 0 THEN 0 ELSE 2.0::DOUBLE * hit / (have + said) END), 9) AS macro_f1 FROM f""")
def eval_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.macro_f1(_predicted(spark, sf_dir), "expected", "predicted").select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH p AS ({_PRED}) SELECT CAST(quantile_disc(latency, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(latency, 0.95) AS BIGINT) AS p95 FROM p")
def eval_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).agg(relational.percentile_nearest("latency", 0.5).cast("long").alias("p50"), relational.percentile_nearest("latency", 0.95).cast("long").alias("p95"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * 1.21::DOUBLE AS amount_gross FROM lineitem")
def arrow_udf_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return arrow_step.run(rows, arrow_step.gross("l_extendedprice"), "l_orderkey long, l_linenumber int, l_extendedprice double, amount_gross double")


_RAW = "CASE doc_id % 5 WHEN 0 THEN '{\"category\":\"a\",\"score\":1}' WHEN 1 THEN '{\"category\":3,\"score\":1.5}' WHEN 2 THEN 'no json' WHEN 3 THEN '{\"category\":\"a\"}' ELSE '{\"category\":null,\"score\":2,\"x\":1}' END"


@query("SELECT problems, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 1 THEN '`category` should be utf8, not number' WHEN 2 THEN 'output is not valid JSON' WHEN 3 THEN '`score` is missing' WHEN 4 THEN '`category` is null but not nullable; `x` is not declared' END AS problems FROM documents) GROUP BY 1")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.expr(_RAW).alias("raw"))
    checked = rows.withColumn("v", validation.validated(F.col("raw"), FIELDS[:2]))
    return checked.groupBy(F.col("v.problems").alias("problems")).agg(F.count("*").alias("n"))


@query("SELECT CAST(i AS BIGINT) AS id, ['alpha', 'beta', 'gamma', 'delta', 'error'][i % 5 + 1] AS category, (i % 100000) / 100.0::DOUBLE AS amount, i % 3 = 0 AS active, CASE WHEN i % 5 <> 0 THEN 'note-' || i END AS note FROM range(1000) t(i)")
def generated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources import generators

    return generators.bench_events(spark, 1000).drop("created_at")


@query(f"SELECT n_name, regexp_full_match(n_name, '{spec.NAME}') AS valid, regexp_full_match(lower(n_name), '{spec.NAME}') AS valid_lower FROM nation")
def name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = lambda c: c.rlike(f"^(?:{spec.NAME})$")
    return table(spark, sf_dir, "nation").select("n_name", valid(F.col("n_name")).alias("valid"), valid(F.lower("n_name")).alias("valid_lower"))


_runtime = {f.__name__: f for f in (runtime.semantic_reuse, runtime.semantic_batch, runtime.semantic_ceiling, runtime.semantic_review, runtime.ledger_counts, runtime.review_queue_join, runtime.workunit_pending, runtime.fanout_tee_counts, runtime.smoke_cap, runtime.append_replay, runtime.upsert_replay)}
QUERIES |= _runtime

#: Distinct documents in the order they arrive in, what each is estimated to take and what it takes.
_STEP_SCHEMA = C.canonical_json(C.output_schema(runtime.FIELDS))
_WORK = f"""SELECT {_TEXT_INPUT} AS inputs, text, min(doc_id) AS arrived, count(*) AS n FROM documents GROUP BY text"""
_WORK = f"""SELECT *, CAST(ceil((strlen(inputs) + {len(INSTRUCTION) + len(_STEP_SCHEMA)}) / 4.0) AS BIGINT) AS est, CAST((strlen(inputs) + 19) // 4 + strlen({_MADE}) // 4 AS BIGINT) AS tokens
FROM (SELECT *, {_SEED.format(inputs="inputs")} AS seed FROM ({_WORK}))"""
_TURNS = f"""SELECT *, row_number() OVER (ORDER BY arrived) AS turn, coalesce(sum(tokens) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + est + {runtime.CAP} > {runtime.CEILING} AS beyond FROM ({_WORK})"""

ORACLES |= {
    "semantic_reuse": f"WITH w AS ({_WORK}), s AS (SELECT CAST(sum(n) AS BIGINT) AS seen, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM w) SELECT 1 AS pass, seen, calls, tokens, seen - calls AS reused, seen AS rows_out FROM s UNION ALL SELECT 2, seen, 0, 0, seen, seen FROM s",
    "semantic_batch": _mock_sql("doc_id, 'vendor-' || printf('%04x', (CAST(seed AS HUGEINT) + 1) % 18446744073709551616 % 65535) AS vendor, CAST(seed % 1000 AS BIGINT) AS amount", _TEXT_INPUT, "documents"),
    "semantic_ceiling": f"WITH t AS ({_TURNS}), f AS (SELECT coalesce(min(turn) FILTER (beyond), count(*) + 1) AS first, count(*) AS n FROM t) SELECT CASE WHEN first <= n THEN 1 ELSE 0 END AS pending, 0 AS submitted, first - 1 AS completed, 0 AS failed FROM f",
    "semantic_review": f"WITH w AS ({_WORK}), h AS (SELECT text FROM w WHERE est > {runtime.LONGEST}) SELECT doc_id, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM w WHERE est > {runtime.LONGEST}) AS withheld, (SELECT count(*) FROM h) AS queued FROM documents WHERE text IN (SELECT text FROM h)",
    "ledger_counts": f"WITH w AS ({_LEDGER}) SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'submitted') AS submitted, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed FROM w",
    "review_queue_join": f"WITH w AS ({_LEDGER}) SELECT w.doc_id, w.state, d.source FROM w JOIN documents d USING (doc_id) WHERE w.state = 'failed' AND w.doc_id % 3 <> 0",
    "workunit_pending": "SELECT n_name AS url FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)",
    "fanout_tee_counts": "SELECT 'high-only' AS sink, count(*) AS rows_out, count(*) AS rows_there FROM events WHERE value > 50 UNION ALL SELECT 'all', count(*), count(*) FROM events",
    "smoke_cap": "SELECT least(count(*), 100) AS rows_in, least(count(*), 100) AS rows_out FROM events",
    "append_replay": "SELECT o_orderkey, count(*) AS copies FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "upsert_replay": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders",
}


@query(f"WITH p AS ({_PRED}) SELECT round((3.0::DOUBLE * avg((expected = predicted)::INT) + 1.0::DOUBLE * avg(valid::INT)) / 4.0::DOUBLE, 9) AS weighted_score FROM p")
def eval_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.eval_weighted(_predicted(spark, sf_dir))


@query("WITH input AS (SELECT * FROM orders) SELECT o_custkey, CAST(n AS BIGINT) AS n, share FROM (SELECT o_custkey, count(*) AS n, round(max(o_totalprice) / 7.0::DOUBLE, 2) AS share FROM input WHERE o_orderstatus <> 'P' GROUP BY o_custkey) WHERE n > 2")
def sql_chained_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps, each over the last one's result: one plan."""
    rows = table(spark, sf_dir, "orders")
    for text in ("SELECT o_custkey, o_totalprice FROM input WHERE o_orderstatus <> 'P'", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice) / 7.0, 2) AS share FROM input GROUP BY o_custkey", "SELECT * FROM input WHERE n > 2"):
        rows = sql_step.run(rows, text)
    return rows
