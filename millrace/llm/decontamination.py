"""Benchmark decontamination.

A hash set of normalised windows of the test items is broadcast; every training token window is looked up by hash, each
hit is verified word by word against the item's window, and hit spans or whole documents are removed.

The set is broadcast only up to BYTES_PER_PASS; a larger benchmark is split by hash into so many passes over the documents,
each with a set of that size at most, so the result is the same at any size. Windows go by number; the items that have them
are looked up for the hits alone.

Edge cases: null and empty texts have no words and no hits; an item without words has no window, and one shorter than a
window is one window; items that share a window are all counted; repeated document rows are each returned; a document of
any length is one row, whose positions alone are exploded; empty tables give no rows, or no hits; other columns of either
table are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.native import ascii_lower, free_name, let, quoted, text_of
from millrace.session import materialize

WINDOW = 13
#: Windows in one broadcast, in bytes of their words; each is there once per possible offset.
BYTES_PER_PASS = 48 << 20
#: Places of the bit array that grams of windows shorter than WINDOW are sifted by before they are looked up.
SIEVE = 1 << 16
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Numbers of 8 bytes in the hits that are broadcast to the documents they are cut from: 16 MB.
BROADCAST_NUMBERS = 1 << 21
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def split_words(text: Column) -> Column:
    """Words of letters, digits and whatever is not ASCII, A-Z in lower case; an empty one where a separator leads or ends."""
    return F.split(ascii_lower(text), f"{_SEPARATORS}+")


def words_of(text: Column) -> Column:
    return F.array_remove(split_words(text), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(n, win, no, items): each distinct window of the items' words, its number, and the ids of the items that have it."""
    items = benchmark.select(F.col(quoted(id_col)).cast("string").alias("item"), words_of(text_of(F.col(quoted(text_col)))).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    wins = items.select("item", n.alias("n"), F.explode(let(F.col("words"), lambda w: F.transform(starts, lambda i: F.slice(w, i, n)))).alias("win"))
    wins = wins.groupBy("win", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return wins.withColumn("no", F.monotonically_increasing_id())


def _stride(n: int) -> tuple[int, int]:
    """A window of n words has, wherever it lies, a gram that starts at a multiple of the stride if gram + stride <= n + 1."""
    stride = (n + 1) // 2
    return n + 1 - stride, stride


def _gram(n: int, words: Column) -> Column:
    return F.xxhash64(F.lit(n), words)


def _sifted(grams: Column, hashes: DataFrame) -> Column:
    """Those of the grams whose hash has its bit; the array has SIEVE bits, whatever the windows."""
    words = [0] * (SIEVE // 64)
    for row in hashes.select(F.pmod("wh", F.lit(SIEVE)).cast("int").alias("at")).distinct().collect():  # SIEVE rows at most
        words[row["at"] // 64] |= 1 << (row["at"] % 64)
    signed = ",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)
    bits = F.split(F.lit(signed), ",").cast("array<bigint>")
    at = lambda g: F.pmod(g["h"], F.lit(SIEVE))
    return F.filter(grams, lambda g: F.getbit(F.get(bits, F.shiftright(at(g), 6).cast("int")), F.pmod(at(g), F.lit(64)).cast("int")) == 1)


def _probes(docs: DataFrame, lengths: list[int], sieves: dict[int, DataFrame]) -> DataFrame:
    """Each document with the hashes of its word grams, for each length of windows at every stride-th word: a row per gram
    (n, at, h), and one with n 0 that stands for the document."""
    kind = "array<struct<n:int,at:int,h:bigint>>"

    def grams(words: Column, n: int) -> Column:
        gram, stride = _stride(n)
        if gram == 1:  # then the stride is 1, too
            found = F.transform(words, lambda w, i: F.struct(F.lit(n).alias("n"), (i + 1).alias("at"), _gram(n, F.array(w)).alias("h")))
        else:
            starts = F.when(F.size(words) >= gram, F.sequence(F.lit(1), F.size(words) - (gram - 1), F.lit(stride)))
            found = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), _gram(n, F.slice(words, i, gram)).alias("h")))
        if n in sieves:
            found = _sifted(found, sieves[n])
        return F.coalesce(found, F.array().cast(kind))

    def hashed(words: Column) -> Column:
        itself = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")))
        blank = F.when(F.element_at(words, -1) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, 1) == ""), 1).otherwise(0)
        return F.struct(words.alias("words"), (F.size(words) - blank).alias("n_words"), F.concat(itself, *(grams(words, n) for n in lengths)).alias("grams"))

    docs = docs.select("id", "version", F.inline(F.array(let(split_words(F.col("text")), hashed))))
    return docs.select("id", "version", "words", "n_words", F.inline("grams"))


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, version, n_words, pos, n, no): a row for each document, its pos null, and one for each verified window in it.

    A document looks up one gram in every stride of its words, for each length that windows have, against the windows' grams at
    each offset below the stride, and compares words only where the hash agrees. The words themselves never leave the scanning
    stage. Few items are shorter than a window: their grams are sifted before they become rows.
    """
    cost = F.sum(F.aggregate("win", F.lit(64), lambda a, w: a + F.octet_length(w) + 16).cast("long"))
    known = {r["n"]: r["bytes"] for r in windows.groupBy("n").agg(cost.alias("bytes")).collect()}  # a row per length, WINDOW at most
    parts = []
    for n in known:
        gram, stride = _stride(n)
        offsets = F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("offset")
        parts.append(windows.where(F.col("n") == n).select("win", "n", "no", offsets).withColumn("wh", _gram(n, F.slice("win", F.col("offset") + 1, gram))))
    none = "win array<string>, n int, no long, offset int, wh long"
    keyed = reduce(DataFrame.unionByName, parts) if parts else windows.sparkSession.createDataFrame([], none)
    itself = windows.sparkSession.createDataFrame([(None, 0, None, 0, 0)], none)
    lengths, sieves = sorted(known), {n: part for n, part in zip(known, parts, strict=True) if n < WINDOW}
    passes = max(1, -(-sum(size * _stride(n)[1] for n, size in known.items()) // BYTES_PER_PASS))
    found = []
    for i in range(passes):
        part = keyed if passes == 1 else keyed.where(F.pmod(F.xxhash64("win"), F.lit(passes)) == i)
        part = F.broadcast(part.unionByName(itself) if i == 0 else part).withColumnRenamed("n", "wn")
        place = F.col("at") - 1 - F.col("offset")
        here = F.slice("words", place + 1, F.col("wn"))
        # Ordered comparisons, since an equality would become part of the join's key, to be built for every row.
        verified = (place >= 0) & (here <= F.col("win")) & (here >= F.col("win"))
        joined = _probes(docs, lengths, sieves).join(part, F.col("h") == F.col("wh")).where((F.col("n") <= F.col("wn")) & (F.col("n") >= F.col("wn")))
        joined = joined.where(F.when(F.col("n") > 0, verified).otherwise(F.col("no").isNull()))
        length = F.when(F.col("no").isNotNull(), F.col("wn"))
        found.append(joined.select("id", "version", "n_words", F.when(F.col("no").isNotNull(), place).alias("pos"), length.alias("n"), "no"))
    return reduce(DataFrame.unionByName, found)


def _covered(spans: Column) -> Column:
    """Merge sorted (pos, end) spans: {n words covered, end, merged}."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["pos"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )["n"]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, version, n_words, n_hit, items, spans (of split_words' words, from 0), contaminated for every row of docs.

    version is a hash of the text, so rows of one id with different texts are kept apart; rows equal in both are counted
    and returned as often as they came.
    """
    text = text_of(F.col(quoted(text_col)))
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    windows = materialize(item_windows(benchmark, item_col, item_text, window))
    found = materialize(scan(base, windows))
    rows = found.groupBy("id", "version").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("n").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))))).alias("spans"),
    )
    named = found.where(F.col("no").isNotNull()).select("id", "version", "no").distinct().join(windows.select("no", "items"), "no")
    named = named.groupBy(F.xxhash64("id", "version").alias("unit")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = rows.withColumn("unit", F.xxhash64("id", "version")).join(named, "unit", "left").drop("unit")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rows = rows.withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    rows = rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows.select("*", each.alias("copy")).drop("copies", "copy")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words in spans, each with what separates it from the next."""
    pieces = F.regexp_extract_all(text, F.lit(f"(^{_SEPARATORS}+|{_WORD}+{_SEPARATORS}*)"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["end"])))
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size_col: str | None = None) -> DataFrame:
    """docs without contaminated documents; with remove="spans", with every hit span cut from its text; with "both", without
    contaminated documents, and the hit spans cut from all others. size_col: gets the characters of a text that was cut."""
    if remove not in ("documents", "spans", "both"):
        raise ValueError("remove is 'documents', 'spans' or 'both'")
    found = report(docs, benchmark, id_col, text_col, item_col, item_text).where("n_hit > 0").dropDuplicates(["id", "version"])
    found = materialize(found.select(F.xxhash64("id", "version").alias("unit"), F.struct(F.col("contaminated").alias("bad"), "spans").alias("hit")))
    unit, hit = free_name(docs, "unit"), free_name(docs, "hit")
    size = found.agg(F.coalesce(F.sum(F.size("hit.spans") + 4), F.lit(0))).first()[0]  # in units of 8 bytes
    found = found.select(F.col("unit").alias(unit), F.col("hit").alias(hit))
    if size <= BROADCAST_NUMBERS:  # else the documents are moved to their hits
        found = F.broadcast(found)
    version = F.xxhash64(text_of(F.col(quoted(text_col))))
    joined = docs.withColumn(unit, F.xxhash64(F.col(quoted(id_col)), version)).join(found, unit, "left")
    if remove != "spans":
        joined = joined.where(~F.coalesce(F.col(hit)["bad"], F.lit(False)))
    cut = F.col(hit).isNotNull() if remove != "documents" else F.lit(False)
    shorter = F.when(cut, without_spans(text_of(F.col(quoted(text_col))), F.col(hit)["spans"])).otherwise(F.col(quoted(text_col)))
    out = []
    for c in docs.columns:
        value = F.col(quoted(c))
        if c == text_col:
            value = shorter
        elif c == size_col:
            value = F.when(cut, F.length(shorter).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i)
  WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM wins
), places AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, lengths, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
  WHERE len(w) >= n
), found AS (
  SELECT p.row_id, p.n, p.i, v.item_id FROM places p JOIN wins v ON p.win = v.win AND p.n = v.n
), hit AS (
  SELECT row_id, count(DISTINCT k) AS n_hit
  FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY row_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""
