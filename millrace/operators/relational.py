"""Relational pieces of the runtime: delivery, policies, budgets, breaker and evaluation measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def last_write_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row per key, that with the largest ordinal. An aggregate, so copies of a hot key are combined before the shuffle."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"key column(s) not in the data: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Target after the incoming rows replaced those of the same key; the ordinal is not kept."""
    new = last_write_wins(incoming, keys, ordinal).drop(ordinal)
    return target.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def running(df: DataFrame, values: Mapping[str, Column], order: Sequence[str], kind: str = "sum") -> DataFrame:
    """df with running sums or maxima over a global order, its own row counted.

    Rows are dealt by ranges of the order; each range is summed up, and what is ahead of it is added, so no task has to hold
    more than a range. The ranges' sums are as many rows as there are partitions.
    """
    total = {"sum": F.sum, "max": F.max}[kind]
    rows = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    rows = materialize(rows.withColumns({f"__v_{name}": value for name, value in values.items()}))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__range").agg(*(total(f"__v_{name}").alias(f"__v_{name}") for name in values))
    ahead = F.broadcast(sums.select("__range", *(total(f"__v_{name}").over(before).alias(f"__a_{name}") for name in values)))
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(ahead, "__range")
    own = lambda name: total(f"__v_{name}").over(upto)
    both = (lambda x, y: x + F.coalesce(y, F.lit(0))) if kind == "sum" else F.greatest
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(both(own(name), F.col(f"__a_{name}")).alias(name) for name in values))


def breaker_trips(df: DataFrame, valid: Column, order: Sequence[str], limit: int) -> DataFrame:
    """(position, run) of rows at which `limit` invalid outputs in a row are reached; the order is global by meaning."""
    rows = running(df.withColumn("__ok", valid), {"position": F.lit(1).cast("long")}, order)
    rows = running(rows, {"__last": F.when(F.col("__ok"), F.col("position"))}, ["position"], "max")
    rows = rows.withColumn("run", F.col("position") - F.coalesce("__last", F.lit(0)))
    return rows.where(~F.col("__ok") & (F.col("run") == limit)).select("position", "run")


def within_ceiling(df: DataFrame, cost: Column, order: Sequence[str], ceiling: int) -> DataFrame:
    """Rows dispatched before the first whose cost would pass the ceiling, at most costs."""
    return running(df, {"consumed": cost}, order).where(F.col("consumed") <= ceiling)


def split_by_policy(df: DataFrame, problems: Column, policy: str) -> tuple[DataFrame, DataFrame]:
    """(kept, withheld or dropped); policy `fail` makes any problem an error of the job that meets it."""
    bad = problems.isNotNull()
    if policy == "fail":
        checked = df.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid output: "), problems)).cast("boolean")).otherwise(F.lit(True)))
        return checked, df.limit(0)
    return df.where(~bad), df.where(bad)


def fallback_join(results: DataFrame, staged: DataFrame, record_col: str, hash_col: str, key_col: str) -> DataFrame:
    """Result lines with the staged key: by record id, else by the hash of the model's input."""
    by_id = staged.where(F.col(record_col).isNotNull()).groupBy(record_col).agg(F.min(key_col).alias("__by_id"))
    by_hash = staged.groupBy(hash_col).agg(F.min(key_col).alias("__by_hash"))
    joined = results.join(by_id, record_col, "left").join(by_hash, hash_col, "left")
    return joined.withColumn(key_col, F.coalesce("__by_id", "__by_hash")).drop("__by_id", "__by_hash")


def percentile_nearest(values: str, q: float) -> Column:
    """Nearest rank: the ceil(n * q)-th smallest, 0 if there is none."""
    return F.coalesce(F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {values})"), F.lit(0))


def accuracy(match: Column) -> Column:
    """Over all items: one without valid output is a miss."""
    return F.coalesce(F.avg(F.coalesce(match, F.lit(False)).cast("double")), F.lit(0.0))


def macro_f1(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Mean F1 over the classes of the expected labels; a null label is no class, and its rows don't count."""
    rows = df.where(F.col(expected).isNotNull())
    counts = rows.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    truth = counts.groupBy(F.col("e").alias("class")).agg(F.sum("n").alias("have"), F.sum(F.when(F.col("e") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = counts.where("p IS NOT NULL").groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    per = truth.join(said, "class", "left")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("have") + F.coalesce("said", F.lit(0))), F.lit(0.0))
    return per.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def weighted_score(accuracies: Mapping[str, float], weights: Mapping[str, float]) -> float:
    total = sum(weights.get(k, 1.0) for k in accuracies)
    return sum(weights.get(k, 1.0) * v for k, v in accuracies.items()) / total if total else 0.0


def reuse_percent(reused: Column, seen: Column) -> Column:
    return F.when(seen == 0, F.lit(100.0)).otherwise(F.lit(100.0) * reused / seen)
