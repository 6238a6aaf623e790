"""Generated inputs: pure functions of the row's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the bench events.
CATEGORIES = ("alpha", "beta", "gamma", "delta", "error")
EPOCH_MICROS = 1_700_000_000_000_000
#: What labelled tickets are made of; any words would do.
OPENERS = ("Hello", "Hi team", "Good morning", "Urgent", "Please help", "To whom it may concern", "Hey", "Dear support")
TOPICS = (("billing", "the invoice shows a wrong amount"), ("outage", "the service does not answer"), ("login", "the password is refused"), ("shipping", "the parcel did not arrive"), ("feature", "an export to a table would help"))


def bench_events(spark: SparkSession, rows: int, files: int = 8) -> DataFrame:
    i = F.col("id")
    return spark.range(0, rows, 1, files).select(
        "id",
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 5 + 1).cast("int")).alias("category"),
        ((i % 100_000) / F.lit(100.0)).alias("amount"),
        (i % 3 == 0).alias("active"),
        F.timestamp_micros(F.lit(EPOCH_MICROS) + i * 1000).alias("created_at"),
        F.when(i % 5 != 0, F.concat(F.lit("note-"), i.cast("string"))).alias("note"),
    )


def tickets(spark: SparkSession, rows: int = 1000) -> DataFrame:
    i = F.col("id")
    return spark.range(rows).select("id", F.concat(F.lit("ticket "), i, F.lit(": subsystem "), i % 7, F.lit(" reports a fault")).alias("description"))


def labelled_tickets(spark: SparkSession, rows: int = 520) -> DataFrame:
    """A corpus for evaluation: openers and topics in turn, each with its labels."""
    i = F.col("id")
    opener = F.element_at(F.array(*map(F.lit, OPENERS)), (F.floor(i / len(TOPICS)) % len(OPENERS) + 1).cast("int"))
    topic = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TOPICS]), (i % len(TOPICS) + 1).cast("int"))
    return spark.range(rows).select(
        F.format_string("ticket-%04d", "id").alias("id"),
        F.concat(opener, F.lit(", "), topic(1), F.lit(" (case "), i % 5, F.lit(").")).alias("description"),
        topic(0).alias("category"),
        F.when(opener == "Urgent", "high").otherwise("normal").alias("priority"),
    )
