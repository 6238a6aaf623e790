"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct byte n-grams (of the orders below, in lower case, white space as one space) hashed into
2 ** BITS places. Each feature is scaled by the log of the ratio of its smoothed rates in both classes, and a logistic
regression on the scaled features is fitted by gradient descent with decay. A text's score is the logistic of the sum of
the weights of its features.

Only the fit sees a sample: at most MAX_PER_CLASS labelled texts of each class, those with the smallest hash of their id.
It runs in one task of bounded size; every text is then scored whole.

Edge cases: null and empty texts have no n-gram and get the score of the bias alone, as do all texts if no label or only
one class is known; a document with conflicting labels counts once for each; labels without a document are ignored;
repeated rows are each scored; ties of the ids' hashes in the sample go to the smaller id; a text of any length is scored whole,
and at 0.5 exactly counts as toxic; empty tables give an untrained model, or no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import pieces, utf8
from millrace.session import materialize

ORDERS = (4, 6, 8)
BITS = 20
MAX_PER_CLASS = 2000
SMOOTHING = 0.5
DECAY = 2e-4
ROUNDS = 80
RATE = 0.1
#: A feature seen in fewer texts of the sample gets no weight.
MIN_TEXTS = 3
#: Nor does one whose log ratio is closer to 0: scaled by it, it could say next to nothing.
MIN_RATIO = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _folded(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, runs of white space as one space, and a space at both ends."""
    b = np.concatenate([[np.uint8(32)], _FOLD[raw], [np.uint8(32)]])
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep]


def ngrams(raw: np.ndarray) -> np.ndarray:
    """Places of all n-grams of the bytes, with repeats."""
    if not len(raw):
        return np.empty(0, np.int64)
    b, out = _folded(raw).astype(np.uint64), []
    for order in ORDERS:
        n = len(b) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint64)
        for k in range(order):
            h = h * np.uint64(257) + b[k : k + n]
        out.append(((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def fit(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each place and the bias. texts: their distinct places."""
    size = 1 << BITS
    weights, y = np.zeros(size, np.float32), labels.astype(np.float64)
    ones, n = y.sum(), len(y)
    if not 0 < ones < n:
        rate = (ones + 0.5) / (n + 1) if n else 0.0
        return weights, float(np.log(rate / (1 - rate))) if n else -4.0
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    toxic = np.repeat(y, lengths)
    p, total = np.bincount(flat, toxic, size), np.bincount(flat, minlength=size)
    q = total - p
    ratio = np.log((p + SMOOTHING) / (ones + 1) / ((q + SMOOTHING) / (n - ones + 1)))
    used = (total >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO)
    column = np.cumsum(used) - 1
    keep = used[flat]
    cols, rows = column[flat[keep]], np.repeat(np.arange(n), lengths)[keep]
    r = ratio[used]
    # Scale so that a typical text's features have unit length together.
    scale = 1 / np.sqrt(max(1e-9, np.median(np.bincount(rows, (r**2)[cols], n))))
    x = (r * scale)[cols]
    w, b, balance = np.zeros(len(r)), 0.0, np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    m = v = np.zeros(len(r) + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(rows, w[cols] * x, n) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / n
        g = np.append(np.bincount(cols, e[rows] * x, len(r)) + DECAY * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w * r * scale
    return weights, float(b)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in pieces(batches):
        raw, ends = utf8(batch.column("text"))
        texts += [np.unique(ngrams(raw[a:b])).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        labels += batch.column("label").to_pylist()
    weights, bias = fit(texts, np.array(labels, np.int8))
    at = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([weights[at].tobytes()]), pa.array([bias])], ["places", "weights", "bias"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    order = [F.md5(F.col("id").cast("string").cast("binary")), F.col("id")]
    sample = rows.where("label = 1").orderBy(*order).limit(MAX_PER_CLASS).unionByName(rows.where("label = 0").orderBy(*order).limit(MAX_PER_CLASS))
    model = sample.repartition(1).sortWithinPartitions("id").mapInArrow(_fit_task, "places binary, weights binary, bias double").first()
    if model is None:  # no label at all
        return fit([], np.empty(0, np.int8))
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(model["places"], np.int32)] = np.frombuffer(model["weights"], np.float32)
    return weights, model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document. The model has a fixed size, 4 MB, and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        last = np.zeros(1 << BITS, np.int64)
        for batch in pieces(batches):
            raw, ends = utf8(batch.column("text"))
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                h = ngrams(raw[ends[i] : ends[i + 1]])
                h = h[weights[h] != 0]
                place = np.arange(len(h))
                last[h] = place  # of equal places one stays, and it alone is counted
                out[i] = weights[h[last[h] == place]].sum(dtype=np.float64) + bias
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    # Only ids meet in the choice of the sample; the texts of the chosen few come after.
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    chosen = [labels.where(F.col("toxic") == k).orderBy(*order).limit(2 * MAX_PER_CLASS) for k in (0, 1)]
    chosen = materialize(chosen[0].unionByName(chosen[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 4 * MAX_PER_CLASS rows of labels at most
    model = train(sample)
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
