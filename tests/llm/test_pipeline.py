import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import arrow, jaccard_join, langid
from tests.llm.conftest import SF
from tests.llm.test_operators import WORDS, brute_components, brute_hits

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {r["doc_id"]: r for r in docs.collect()}, docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = Counter(r["doc_id"] for r in docs.collect())
        if name == "language":
            assert set(got) <= set(kept) and all(any(c.isalpha() for c in kept[i]["text"]) for i in got)
        elif name == "near_duplicates":
            assert got == Counter(i for i, _, c in brute_components([(i, r["text"]) for i, r in kept.items()], 5, 80) if i == c)
        elif name == "benchmark_leaks":
            bad = {i for i, r in kept.items() if (lambda n, h, _: h and 20 * h >= n)(*brute_hits(r["text"], items))}
            assert set(got) == set(kept) - bad
        elif name == "mixture":
            total = sum(len(WORDS.findall(r["text"])) for r in kept.values())
            taken = sum(len(WORDS.findall(r["text"])) for r in docs.collect())
            assert abs(taken - 1.5 * total) <= 10 and set(got) <= set(kept)
        else:
            assert got == before and docs.where("shard NOT BETWEEN 0 AND 23").count() == 0
        if name != "shards":
            assert docs.columns == columns
        kept, before = {r["doc_id"]: r for r in docs.collect()}, got


def test_language_drops_strange_scripts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, prototypes = np.random.default_rng(5), langid.learn(docs.where(~langid.held_out()))
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 10)))
    strange = [(i, " ".join(word(("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")[i % 2]) for _ in range(40))) for i in range(120)]
    assert langid.accepted(spark.createDataFrame(strange, "doc_id long, text string"), prototypes).count() <= 6
    real = docs.where(langid.held_out() & F.col("text").rlike("[A-Za-z]") & (F.char_length("text") >= langid.SHORT)).select("doc_id", "text")
    assert langid.accepted(real, prototypes).count() == real.count() > 0
    # Parts of real texts, too.
    cut = real.where(F.char_length("text") >= 200).withColumn("text", F.substring("text", 100, 60))
    assert langid.accepted(cut, prototypes).count() == cut.count() > 0


def test_benchmark_leaks_leaves_no_window(spark, tmp_path):
    item = [f"w{i}" for i in range(15)]
    filler = [f"x{i}" for i in range(600)]
    spark.createDataFrame([("b1", " ".join(item))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long, clean, short = " ".join([*filler[:300], *item, *filler[300:]]), " ".join(filler), " ".join([*item, *filler[:20]])
    texts = [(1, long), (None, long), (2, clean), (3, short), (4, None)]
    docs = spark.createDataFrame([(i, t, len(t or "") or None) for i, t in texts], "doc_id long, text string, n_chars long")
    got = pipeline.benchmark_leaks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect())
    assert kept == Counter([(1, clean, len(clean)), (None, clean, len(clean)), (2, clean, len(clean)), (4, None, None)])


def test_stages_take_odd_tables(spark, tmp_path):
    """Empty tables, rows without id, repeated rows, null and long texts, ties, and further columns."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("unit", F.lit("u")).withColumn("a.b", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, "u", 1), (None, "", "en", "s", 0, "u", 1), (7, " ".join(["lorem ipsum dolor"] * 9000), "en", None, 9, "u", 1)], real.schema)
    table = real.unionByName(real.limit(5)).unionByName(real.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd)
    for name, docs in (("none", table.limit(0)), ("odd", table)):
        for stage, run in pipeline.STAGES:
            run(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            before, docs = docs, spark.read.parquet(str(tmp_path / name / stage))
            assert stage == "shards" or docs.columns == table.columns
            assert name == "odd" or docs.count() == 0
        assert docs.count() >= (0 if name == "none" else 30)


def test_run(spark):
    rows = pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "text", "shard"} <= set(rows.columns)


#: A fresh process that counts the shingles of 14 MB as a worker does: rows out, MB that it has beyond its start at most, and at the end.
_WORKER = """
import re, threading, time
import numpy as np
import pyarrow as pa
from millrace.llm import jaccard_join

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = np.random.default_rng(3)
words = np.array([f"word{i}" for i in range(5000)])
texts = [" ".join(rng.choice(words, 400)) for _ in range(4000)]
batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2000])], ["text"]) for i in (0, 2000)]
most = before = held()

def watch():
    global most
    while True:
        most = max(most, held())
        time.sleep(0.002)

threading.Thread(target=watch, daemon=True).start()
found = list(getattr(jaccard_join, "lean", lambda f: f)(jaccard_join._sketch(5))(iter(batches)))
print(len(found), most - before, held() - before)
"""


def test_workers_of_near_duplicates_are_small():
    """At work, its arrays stay in bounds; after a task, a worker keeps next to nothing beside the jobs that follow."""
    ran = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, timeout=120, cwd=Path(pipeline.__file__).parent)
    found, most, kept = map(float, ran.stdout.split()[-3:])
    assert found == jaccard_join.SKETCH_RANGES and most < 55 and kept < 25


def test_lean_gives_back_however_a_task_ends(monkeypatch):
    called = []
    monkeypatch.setattr(arrow, "give_back", lambda: called.append(1))
    twice = arrow.lean(lambda batches: (2 * b for b in batches))
    assert list(twice(iter([1, 2]))) == [2, 4] and len(called) == 1
    broken = twice(iter([1, 2]))
    next(broken)
    broken.close()
    assert len(called) == 2
