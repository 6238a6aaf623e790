"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's part of the total, but no more than `max_epochs` times what it holds; what clamped sources
leave is shared anew by weight until none is above its cap. That fixed point is found in one pass over the sources in the
order in which they reach their caps. A source's target is then taken as whole repetitions of all its documents plus a
seeded draw: documents are ordered by a hash of seed, id and text, and those up to the remaining words are repeated once
more; the one document on the border gives the fraction that is missing, so that the words taken are the target, rounded.

Edge cases: null or empty texts have size 0, are never drawn in part and come with the whole repetitions; a text of any length
is one row; a null source is a source of its own, last in order; a source without words has target 0; rows that are equal in
id and text share one place in the order; those of one source that are on its border are numbered, and each takes its part,
whichever comes first; an empty table gives no rows; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.native import NOT_SPACE, count_space_words, free_name, quoted, text_of
from millrace.session import materialize

SEED = "mix-1"
#: Weights by the sources' order, repeated.
CYCLE = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Sources, at some 100 bytes each, that are broadcast.
MANY_SOURCES = 50_000


def order_key(id_col: Column, text_col: Column, seed: str = SEED) -> Column:
    """32 hex digits, even over all rows; the first three make 4096 bins per source, so that no source is sorted whole."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(text_col.cast("binary"))).cast("binary"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    rows = docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.col(quoted(source_col)).alias("src"),
        count_space_words(F.col(quoted(text_col))).alias("size"),
        order_key(F.col(quoted(id_col)), text_of(F.col(quoted(text_col))), seed).alias("key"),
    )
    return rows.withColumn("bin", F.substring("key", 1, 3))


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Weights repeating over the sources by code point, null last. One row per source comes in."""
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.get(values, F.pmod(rank, F.lit(len(cycle)))))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to (src, source_size, weight): one row per source.

    Sources reach their cap in the order of cap / weight. A source is clamped if, with all before it clamped, its part of
    what is left is above its cap; the level of the rest is what is left over their weights.
    """
    everything = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("cap", cap).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("level", left / weights).withColumn("clamped", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything)  # the first that is not clamped has the largest
    rows = rows.withColumn("free_level", level)
    target = F.when(F.col("clamped") | F.col("free_level").isNull(), F.col("cap")).otherwise(F.col("free_level") * F.col("weight"))
    return rows.select("src", "source_size", "weight", target.alias("target"))


def borders(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: source_size, target, repeats (whole), and where the draw of one more, partial repetition ends.

    Documents whose key is below border are drawn whole; those that have it share the words that are left. Only the bin that
    holds the border is looked at key by key.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    asked = targets.select("src", "source_size", "target", whole.alias("repeats"), (F.round("target").cast("long") - whole * F.col("source_size")).alias("rest"))
    before = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a source
    bins = rows.groupBy("src", "bin").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0)))
    here = (F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))
    cut = materialize(_with(bins, asked).where(here).select("src", "bin", "ahead", "rest"))
    same = F.col("r.src").eqNullSafe(F.col("c.src")) & (F.col("r.bin") == F.col("c.bin"))
    keys = rows.alias("r").join(cut.alias("c"), same).groupBy("r.src", "r.key", "c.ahead", "c.rest").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(inside), F.lit(0))).where(here)
    found = keys.select("src", F.col("key").alias("border"), (F.col("rest") - F.col("ahead")).alias("left"))
    both = F.col("a.src").eqNullSafe(F.col("f.src"))
    return materialize(asked.drop("rest").alias("a").join(found.alias("f"), both, "left").select("a.*", "f.border", "f.left"))


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source. Up to MANY_SOURCES sources are broadcast; more are joined by a shuffle, which
    Spark can split where one source has most rows."""
    other, src = sources, free_name(rows, "src")
    other = other.withColumnRenamed("src", src)
    if other.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES:
        other = F.broadcast(other)
    return rows.join(other, F.col("src").eqNullSafe(F.col(src))).drop(src)


def _extra(border: str, size: str, left: str, key: str, nth: Column | None) -> Column:
    """Words of the partial repetition that a document gives; nth: its number from 0 among those on the border."""
    if nth is None:
        return F.when(F.col(key) < F.col(border), F.col(size)).otherwise(F.lit(0)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col(size), F.col(left) - nth * F.col(size)))


def sources_of(rows: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """What borders() gives, from measured rows."""
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cycle_weights(sources)
    else:
        w = weights.select(F.col("src").alias("wsrc"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("src").eqNullSafe(F.col("wsrc"))).drop("wsrc")
    return borders(rows, materialize(water_fill(sources, share, max_epochs)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(id, src, size, source_size, target, repeats, extra) for every document of a weighted source. weights: (src, weight), else CYCLE."""
    rows = materialize(measured(docs, id_col, text_col, source_col, seed))
    joined = _with(rows, sources_of(rows, weights, share, max_epochs))
    on_border = F.coalesce(F.col("key") == F.col("border"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("src", "key").orderBy("id")) - 1
    names = ["id", "src", "size", "source_size", "target", "repeats"]
    rest = joined.where(~on_border).select(*names, _extra("border", "size", "left", "key", None).alias("extra"))
    ties = joined.where(on_border).withColumn("nth", nth).select(*names, _extra("border", "size", "left", "key", F.col("nth")).alias("extra"))
    return rest.unionByName(ties)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it was."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{NOT_SPACE}+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition, and one cut after some words for a partial one.

    Texts are not moved, but for those of the rows on a source's border, which are numbered by a hash of all their columns.
    """
    seed = options.pop("seed", SEED)
    chosen = sources_of(materialize(measured(docs, id_col, text_col, source_col, seed)), **options)
    own = [F.col(quoted(c)) for c in docs.columns]
    record = docs.select(F.struct(*own).alias("doc"), F.col(quoted(source_col)).alias("src"), order_key(F.col(quoted(id_col)), text_of(F.col(quoted(text_col))), seed).alias("key"), count_space_words(F.col(quoted(text_col))).alias("size"))
    joined = _with(record, chosen)
    on_border = F.coalesce(F.col("key") == F.col("border"), F.lit(False))
    comparable = [F.col("doc")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    nth = F.row_number().over(Window.partitionBy("src", "key").orderBy(F.xxhash64(*comparable))) - 1
    rest = joined.where(~on_border).withColumn("extra", _extra("border", "size", "left", "key", None))
    ties = joined.where(on_border).withColumn("nth", nth).withColumn("extra", _extra("border", "size", "left", "key", F.col("nth"))).drop("nth")
    rows = rest.unionByName(ties)
    full = (F.col("repeats") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("int")
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.array("extra")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), full), part)).alias("take"))
    cut, text = F.col("take") >= 0, F.col("doc")[text_col]
    shorter = F.when(cut, first_words(text_of(text), F.col("take"))).otherwise(text)
    rows = rows.select("doc", "take", shorter.alias("text"))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("text").alias(name)
        value = F.col("doc")[name]
        if name == length_col:
            value = F.when(F.col("take") >= 0, F.char_length("text").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return rows.select(*map(column, docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.col("size") * F.col("repeats") + F.col("extra")
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY src
), weighted AS (
  SELECT src, source_size, source_size * 2.0::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((row_number() OVER (ORDER BY src ASC NULLS LAST) - 1) % 3)] AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM sources
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER upto, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0.0)) AS level
  FROM weighted
  WINDOW upto AS (ORDER BY cap / weight, src ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, level * weight > cap AS clamped,
         max(CASE WHEN NOT level * weight > cap THEN level END) OVER () AS free_level
  FROM levels
), targets AS (
  SELECT src, source_size, CASE WHEN clamped OR free_level IS NULL THEN cap ELSE free_level * weight END AS target FROM filled
), placed AS (
  SELECT doc_id, src, size, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs
), drawn AS (
  SELECT doc_id, size, t.source_size, target, start,
         CASE WHEN t.source_size > 0 THEN floor(round(target) / t.source_size) ELSE 0 END AS repeats
  FROM placed p JOIN targets t ON p.src IS NOT DISTINCT FROM t.src
)
SELECT doc_id, size, source_size, target,
       CAST(size * repeats + greatest(0, least(size, CAST(round(target) AS BIGINT) - repeats * source_size - start)) AS BIGINT) AS taken
FROM drawn
"""
