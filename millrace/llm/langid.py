"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters, the first
permuted (rotated) twice and the second once; a text's vector bundles (adds) those of its trigrams. A language's prototype
bundles all texts of the language, and a text gets the language whose prototype has the largest cosine with its own vector.

Vectors are made from the letter alone, so all workers agree without sharing a table. Bundles are sums of integers, so
prototypes do not depend on partitions or on their order.

Edge cases: a null text, or one without a letter, is `und` with score 0; equal cosines go to the smaller name; a language
with one text is learned like any other; without any labelled text all rows are `und`; repeated rows count as often as
they come; a text of any length is bundled whole; an empty table gives no prototypes, or no rows; other columns are carried
or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import lean, pieces, small_batches
from millrace.llm.native import quoted

DIM = 1024
SEED = 20_240_917
UNKNOWN = "und"
#: A text that shares no trigram with any language has a cosine of 0 with a deviation of 1 / sqrt(DIM), about 0.03.
#: The best of four languages stays below 0.08 for 95 to 99 of 100 texts in a strange script (1 to 5 of 100 pass); of 51,282
#: labelled texts none of SHORT characters or more came below 0.09.
MIN_SCORE = 0.08
#: Shorter texts share so few trigrams with their own language that the noise hides it: they are dropped only below MIN_SHORT.
SHORT, MIN_SHORT = 30, 0.04
#: Trigram vectors a worker keeps before it starts over; 64 MB.
KEPT = 65_536
_FOLD = None


class Space:
    """Letter and trigram vectors, made when first needed."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((4096, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dim)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """A row for each of the distinct trigram keys."""
        if len(self.rows) + len(keys) > KEPT:
            self.rows = {}
        named = keys.tolist()
        at = [self.rows.get(k, -1) for k in named]
        for i, row in enumerate(at):
            if row < 0:
                key = named[i]
                at[i] = self.rows[key] = len(self.rows)
                if at[i] >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                a, b, c = (self.letter(key >> s & 0x1FFFFF) for s in (42, 21, 0))
                self.table[at[i]] = np.roll(a, 2) * np.roll(b, 1) * c
        return self.table[at]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors, each as often as it is counted; exact, in blocks of bounded size."""
        total = np.zeros(self.dim, np.float64)
        for i in range(0, len(keys), 8192):
            block = counts[i : i + 8192].astype(np.float32)
            if block.sum(dtype=np.float64) < 2**24:  # sums of integers below that are exact in single precision
                total += block @ self.vectors(keys[i : i + 8192]).astype(np.float32)
            else:
                total += counts[i : i + 8192].astype(np.float64) @ self.vectors(keys[i : i + 8192]).astype(np.float64)
        return total


def _is_letter() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        _FOLD = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _FOLD


def trigrams(text: str | None) -> np.ndarray:
    """A key for each trigram of the letters in lower case, every run of other characters and both ends as one space."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, sums = Space(), {}
    for batch in pieces(batches):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(trigrams(text))
        for lang, keys in by_lang.items():
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            sums[lang] = sums.get(lang, 0) + space.bundle(found, counts)
    if sums:
        dims = np.tile(np.arange(DIM, dtype=np.int32), len(sums))
        values = np.concatenate([np.asarray(v) for v in sums.values()]).astype(np.int64)
        names = [lang for lang in sums for _ in range(DIM)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(dims), pa.array(values)], ["lang", "dim", "value"])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes of all languages: a number per language and dimension is all that comes to the driver."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    summed = rows.mapInArrow(lean(_learn), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    sums: dict[str, np.ndarray] = {}
    with small_batches(labelled.sparkSession):
        found = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    for r in found:
        v = np.array([x["value"] for x in r["v"]], np.float64)
        if norm := np.linalg.norm(v):
            sums[r["lang"]] = v / norm
    return dict(sorted(sums.items()))


def _judged(text: str | None, space: Space, names: list[str], matrix: np.ndarray) -> tuple[str, float]:
    """The language whose prototype is closest, and the cosine, at least 0."""
    keys, counts = np.unique(trigrams(text), return_counts=True)
    v = space.bundle(keys, counts) if len(keys) and names else None
    if v is None or not (norm := np.linalg.norm(v)):
        return UNKNOWN, 0.0
    cosines = matrix @ v / norm
    best = int(np.argmax(cosines))
    return names[best], float(min(1.0, max(0.0, cosines[best])))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score (and, as the struct `carried`, the columns to carry) for every document."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    fields = [T.StructField("id", rows.schema["_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [rows.schema[c] for c in rows.columns[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in pieces(batches, "_text"):
            langs, scores = [], []
            for text in batch.column("_text").to_pylist():
                lang, score = _judged(text, space, names, matrix)
                langs.append(lang)
                scores.append(score)
            rest = ["carried"] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *(batch.column(c) for c in rest)], ["id", "lang_pred", "score", *rest])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a learned language."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()))

    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Space()
        for column in texts:
            good = []
            for batch in pieces([pa.RecordBatch.from_arrays([column], ["text"])]):
                for text in batch.column("text").to_pylist():
                    lang, score = _judged(text, own, names, matrix)
                    good.append(lang != UNKNOWN and score >= (MIN_SHORT if len(text) < SHORT else MIN_SCORE))
            yield pa.array(good, pa.bool_())

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(judged)(texts)

    return docs.where(known(F.col(quoted(text_col))))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = learn(docs.where(~held_out()))
    return identify(docs, prototypes).select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
