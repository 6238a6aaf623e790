"""The cost model of online and batch dispatch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rate cards (fixed values): USD per million tokens in and out, online then batch; seconds per online record, online
#: concurrency, and batch seconds: fixed, completion window, per record.
RATE_CARDS = {
    "mock": (3.0, 15.0, 1.5, 7.5, 0.05, 32, 2.0, 60.0, 0.001),
    "openai-compat-stub": (0.15, 0.60, 0.075, 0.30, 0.20, 8, 5.0, 3600.0, 0.002),
    "bedrock-illustrative": (0.25, 1.25, 0.125, 0.625, 0.35, 16, 30.0, 86400.0, 0.005),
}
ALIASES = {"openai-compat": "openai-compat-stub", "bedrock": "bedrock-illustrative"}
INPUT_TOKENS, OUTPUT_TOKENS = 800, 200
SWEEP = (("mock", "openai-compat-stub"), (100, 1_000, 10_000, 100_000), (300, 3_600, 86_400))
_COLUMNS = "rate_card string, online_in double, online_out double, batch_in double, batch_out double, online_s double, concurrency double, batch_fixed double, batch_window double, batch_s double"


def rate_cards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, v)) for k, v in RATE_CARDS.items()], _COLUMNS)


def cost(records: Column, tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (records * tokens_in * price_in + records * tokens_out * price_out) / F.lit(1e6)


def decide(workloads: DataFrame) -> DataFrame:
    """Workloads (rate card columns, records, deadline, tokens_in, tokens_out) with costs, latencies and the recommended mode."""
    n, d = F.col("records").cast("double"), F.col("deadline").cast("double")
    df = workloads.select(
        "rate_card",
        "records",
        "deadline",
        cost(n, F.col("tokens_in"), F.col("tokens_out"), F.col("online_in"), F.col("online_out")).alias("online_usd"),
        (F.ceil(n / F.greatest("concurrency", F.lit(1.0))) * F.col("online_s")).alias("online_seconds"),
        cost(n, F.col("tokens_in"), F.col("tokens_out"), F.col("batch_in"), F.col("batch_out")).alias("batch_usd"),
        F.when(n == 0, 0.0).otherwise(F.col("batch_fixed") + F.col("batch_window") + n * F.col("batch_s")).alias("batch_seconds"),
    )
    on, off = F.col("online_seconds") <= d, F.col("batch_seconds") <= d
    cheaper = F.when(F.col("batch_usd") < F.col("online_usd"), "batch").when(F.col("online_usd") < F.col("batch_usd"), "online").when(F.col("batch_seconds") <= F.col("online_seconds"), "batch").otherwise("online")
    sooner = F.when(F.col("online_seconds") <= F.col("batch_seconds"), "online").otherwise("batch")
    mode = F.when(F.col("batch_usd").isNull(), "online").when(on & off, cheaper).when(on, "online").when(off, "batch").otherwise(sooner)
    return df.withColumn("recommended", mode)


def frontier(spark: SparkSession) -> DataFrame:
    """The published sweep; its three axes are fixed lists of a few values."""
    cards, volumes, deadlines = SWEEP
    rows = [(c, *map(float, RATE_CARDS[c]), v, d, INPUT_TOKENS, OUTPUT_TOKENS) for c in cards for v in volumes for d in deadlines]
    return decide(spark.createDataFrame(rows, f"{_COLUMNS}, records long, deadline long, tokens_in long, tokens_out long"))


@dataclass(frozen=True)
class Hints:
    expected_records: int | None = None
    deadline_seconds: int | None = None
    input_tokens: int = INPUT_TOKENS
    output_tokens: int = OUTPUT_TOKENS
    rate_card: str | None = None


def resolve_mode(spark: SparkSession, execution: str, hints: Hints, provider: str, has_batch: bool) -> str:
    """online or batch for a step; `auto` without both hints, or on a provider without batch, is online."""
    if execution == "batch" and not has_batch:
        raise ValueError(f"provider `{provider}` has no batch mode")
    if execution != "auto":
        return execution
    if not has_batch or hints.expected_records is None or hints.deadline_seconds is None:
        return "online"
    card = hints.rate_card or provider
    card = ALIASES.get(card, card)
    row = (card, *map(float, RATE_CARDS[card]), hints.expected_records, hints.deadline_seconds, hints.input_tokens, hints.output_tokens)
    return decide(spark.createDataFrame([row], f"{_COLUMNS}, records long, deadline long, tokens_in long, tokens_out long")).first()["recommended"]


def to_markdown(df: DataFrame) -> str:
    """The sweep as a table; tens of rows."""
    head = "| rate card | records | deadline | recommended | online $ | online s | batch $ | batch s |\n| --- | ---: | ---: | --- | ---: | ---: | ---: | ---: |\n"
    rows = df.orderBy("rate_card", "records", "deadline").collect()
    return head + "".join(f"| {r.rate_card} | {r.records} | {r.deadline}s | {r.recommended} | {r.online_usd:.4f} | {r.online_seconds:.1f} | {r.batch_usd:.4f} | {r.batch_seconds:.1f} |\n" for r in rows)
