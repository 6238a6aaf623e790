"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node of its component.

    Alternates between tying larger neighbours, then smaller ones, to the smallest known neighbour, until nothing
    changes, which takes about the logarithm of the nodes in rounds. Hubs are summed up before they are shuffled, and joins
    on them can be split; nothing is collected but sums. Each round is a table in shared storage, the last one's is deleted.

    Edge cases: edges of a node with itself and edges with a null end are left out; repeated edges count once; no edges
    give no rows.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.where("a != b").select(big.alias("a"), small.alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, last = mark, now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = materialize(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
