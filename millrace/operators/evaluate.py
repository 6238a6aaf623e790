"""Evaluation of a model on a labelled corpus."""

from __future__ import annotations

import json
import os
import re
import time

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.functions.validation import problems
from millrace.operators import relational
from millrace.operators.providers import Provider, Request


def load_corpus(text: str) -> dict:
    """Every item must label every declared field."""
    corpus = yaml.safe_load(text)
    names = [f["name"] for f in corpus["fields"]]
    for item in corpus["items"]:
        missing = [n for n in names if n not in item.get("expected", {})]
        if missing:
            raise ValueError(f"item `{item.get('id')}` has no label for {', '.join(missing)}")
    return corpus


def run(spark: SparkSession, corpus: dict, provider: Provider, limit: int | None = None, prices: tuple[float, float] | None = None) -> tuple[DataFrame, dict]:
    """Item table and report. Items are asked one after another; an invalid answer is a miss, a provider fault ends the run."""
    schema, rows = C.output_schema(corpus["fields"]), []
    for item in corpus["items"][:limit]:
        began = time.monotonic()
        answer = provider.invoke(Request(corpus["instruction"], item["input"], schema))
        output, wrong = problems(answer.text, corpus["fields"])
        rows.append((item["id"], not wrong, json.dumps(output), json.dumps(item["expected"]), int((time.monotonic() - began) * 1000), answer.input_tokens, answer.output_tokens))
    items = spark.createDataFrame(rows, "id string, schema_valid boolean, output string, expected string, latency_ms long, input_tokens long, output_tokens long")
    return items, report(items, corpus, provider.id, prices)


def report(items: DataFrame, corpus: dict, provider: str, prices: tuple[float, float] | None = None) -> dict:
    kinds = {"utf8": "string", "int64": "long", "float64": "double", "bool": "boolean"}
    shape = ", ".join(f"`{f['name']}` {kinds[f['type']]}" for f in corpus["fields"])
    rows = items.withColumn("e", F.from_json("expected", shape)).withColumn("p", F.from_json("output", shape))
    matches = {f["name"]: F.col("schema_valid") & C.values_match(F.col(f"e.`{f['name']}`"), F.col(f"p.`{f['name']}`"), f["type"]) for f in corpus["fields"]}
    row = rows.agg(
        F.count("*").alias("items"),
        F.count_if("schema_valid").alias("schema_valid"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        relational.percentile_nearest("latency_ms", 0.5).alias("p50"),
        relational.percentile_nearest("latency_ms", 0.95).alias("p95"),
        *(relational.accuracy(m).alias(f"accuracy_{i}") for i, m in enumerate(matches.values())),
    ).first()
    weights = corpus.get("weights", {})
    fields = []
    for i, f in enumerate(corpus["fields"]):
        own = {"field": f["name"], "weight": weights.get(f["name"], 1.0), "accuracy": row[f"accuracy_{i}"]}
        if f["type"] in ("utf8", "bool"):
            flat = rows.select(F.lower(F.trim(F.col(f"e.`{f['name']}`").cast("string"))).alias("expected"), F.lower(F.trim(F.col(f"p.`{f['name']}`").cast("string"))).alias("predicted"))
            own["macroF1"] = relational.macro_f1(flat, "expected", "predicted").first()["macro_f1"]
        fields.append(own)
    score = relational.weighted_score({f["field"]: f["accuracy"] for f in fields}, weights)
    out = {"corpus": corpus.get("name"), "provider": provider, "items": row["items"], "schemaValid": row["schema_valid"], "fields": fields, "weightedScore": score, "inputTokens": row["input_tokens"], "outputTokens": row["output_tokens"], "p50LatencyMs": row["p50"], "p95LatencyMs": row["p95"]}
    return out | ({"costUsd": (row["input_tokens"] * prices[0] + row["output_tokens"] * prices[1]) / 1e6} if prices else {})


def persist(items: DataFrame, result: dict, root: str, model: str) -> str:
    """report.json and items.jsonl in a folder named by time, provider and model."""
    stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    folder = os.path.join(root, f"{stamp}-{result['provider']}-{re.sub('[^A-Za-z0-9-]', '_', model)}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "report.json"), "w") as f:
        json.dump(result, f, indent=2)
    with open(os.path.join(folder, "items.jsonl"), "w") as f:
        f.writelines(x + "\n" for x in items.toJSON().toLocalIterator())
    return folder
