"""The semantic step: rows get typed answers of a model, each unit of work is paid for once.

Keys are column expressions. Rows are counted per key and joined with the ledger; the keys that it has no answer for are
resolved on the driver, in the order in which they arrived and outside Spark's retries; then answers are joined back, and
everything downstream can be run again freely. What streams through the driver is the unresolved work alone, a portion at a
time, so a ledger of completed work costs joins, not calls. Nothing on the driver grows with the work but files.
"""

from __future__ import annotations

import json
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import canonical as C
from millrace.functions.validation import problems, unfenced
from millrace.operators.ledger import Ledger, Result
from millrace.operators.providers import Provider, ProviderFault, Request, Response
from millrace.session import materialize

_SPARK = {"utf8": "string", "int64": "long", "float64": "double", "bool": "boolean"}
POLL_SECONDS, MAX_POLLS = 0.25, 2400
#: Bytes of inputs that the driver is given at once, about.
PORTION = 8_000_000


class BreakerTripped(RuntimeError):
    pass


class CeilingReached(RuntimeError):
    pass


class InvalidOutput(RuntimeError):
    pass


@dataclass
class Step:
    id: str
    operation: str
    inputs: list[str]
    instruction: str
    fields: list[dict]
    model: str
    on_invalid: str = "fail"
    max_input_tokens: int | None = None
    max_output_tokens: int | None = None
    max_run_tokens: int | None = None
    max_consecutive_invalid: int = 25
    mode: str = "online"

    def __post_init__(self) -> None:
        if any(f["type"] == "timestamp" for f in self.fields):
            raise ValueError(f"step `{self.id}`: timestamp outputs are not supported")
        self.schema = C.output_schema(self.fields)


@dataclass
class Counters:
    """Of rows, but calls and tokens: a row whose answer another one has paid for is reused."""

    seen: int = 0
    calls: int = 0
    tokens: int = 0
    reused: int = 0
    dropped: int = 0
    withheld: int = 0
    in_a_row: int = field(default=0, repr=False)


def _material(step: Step, provider: str) -> dict:
    """What of a step its work's keys depend on."""
    params = {"max_output_tokens": step.max_output_tokens, "temperature": 0}
    return {"operation": step.operation, "instruction": step.instruction, "schema": step.schema, "provider": provider, "model": step.model, "params": params}


def keyed(df: DataFrame, step: Step, provider: str) -> DataFrame:
    """df with __inputs, __spec and __key."""
    C.check_inputs(df, step.inputs, step.id)
    rows = df.withColumn("__inputs", C.canonical_inputs(df, step.inputs))
    rows = rows.withColumn("__spec", C.work_spec(F.col("__inputs"), **_material(step, provider)))
    return rows.withColumn("__key", C.work_key(F.col("__spec")))


class Resolver:
    """Resolves distinct units of work through the ledger."""

    def __init__(self, step: Step, provider: Provider, ledger: Ledger) -> None:
        self.step, self.provider, self.ledger, self.n = step, provider, ledger, Counters()

    def _invalid(self, key: str, reason: str, raw: str | None) -> None:
        if self.step.on_invalid == "fail":
            raise InvalidOutput(f"step `{self.step.id}`, work {key[:12]}: {reason}")
        if self.step.on_invalid == "review":
            self.ledger.enqueue_review(key, self.step.id, reason, raw)

    def _worst(self, inputs: str) -> int:
        """Tokens that a request may take: its input's, estimated, and its output's cap."""
        text = self.step.instruction + inputs + C.canonical_json(self.step.schema)
        return -(-len(text.encode()) // 4)

    def _over_budget(self, key: str, inputs: str) -> bool:
        estimate, most = self._worst(inputs), self.step.max_input_tokens
        if most is None or estimate <= most:
            return False
        self._invalid(key, f"its input has about {estimate} tokens, more than {most}", None)
        return True

    def _needed(self, inputs: str) -> int:
        """Tokens that a request is held to the ceiling with; none without a ceiling."""
        return 0 if self.step.max_run_tokens is None else self._worst(inputs) + (self.step.max_output_tokens or 0)

    def _reserve(self, requests: int, needed: int) -> None:
        """Nothing is sent if what it may take goes over the run's ceiling."""
        ceiling = self.step.max_run_tokens
        if ceiling is not None and self.n.tokens + needed > ceiling:
            raise CeilingReached(f"step `{self.step.id}`: {requests} requests may take {needed} tokens beyond {self.n.tokens}, more than {ceiling}")

    def _take(self, key: str, r: Response, online: bool) -> None:
        self.n.tokens += r.input_tokens + r.output_tokens
        cap = self.step.max_output_tokens
        value, wrong = (None, [f"its output has {r.output_tokens} tokens, more than {cap}"]) if cap is not None and r.output_tokens > cap else problems(unfenced(r.text), self.step.fields)
        if not wrong:
            text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            self.ledger.complete(key, Result(text, self.provider.id, self.step.model, r.request_id, r.input_tokens, r.output_tokens))
            self.n.in_a_row = 0
            return
        reason = "; ".join(wrong)
        self.ledger.mark_failed(key, reason)
        if online:
            self.n.in_a_row += 1
            if self.n.in_a_row >= self.step.max_consecutive_invalid:
                raise BreakerTripped(f"step `{self.step.id}`: {self.n.in_a_row} invalid outputs in a row")
        self._invalid(key, reason, r.text)

    def _open(self, work: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str]]:
        """(key, inputs) of what has to be dispatched."""
        for key, inputs, spec in work:
            self.ledger.ensure_pending(key, spec)
            if self.ledger.state(key) == "completed" or self.ledger.withheld([key]) or self._over_budget(key, inputs):
                continue
            yield key, inputs

    def _request(self, inputs: dict) -> Request:
        return Request(self.step.instruction, inputs, self.step.schema, self.step.max_output_tokens)

    def online(self, work: Iterator[tuple[str, str, str]]) -> None:
        for key, inputs in self._open(work):
            self._reserve(1, self._needed(inputs))
            self.ledger.mark_submitted(key, "online")
            self.n.calls += 1
            try:
                answer = self.provider.invoke(self._request(json.loads(inputs)))
            except ProviderFault as e:
                self.ledger.mark_failed(key, str(e))
                raise
            self._take(key, answer, online=True)

    def _drain(self, job: str) -> None:
        for _ in range(MAX_POLLS):
            status = self.provider.poll_batch(job)
            if status == "completed":
                for key, answer in self.provider.fetch_batch(job):
                    if not self.ledger.waits_for(key, job):
                        continue
                    if isinstance(answer, str):
                        self.ledger.mark_failed(key, answer)
                        self._invalid(key, answer, None)
                    else:
                        self._take(key, answer, online=False)
                return
            if status == "failed":
                self.ledger.mark_job_failed(job, f"batch job {job} failed")
                raise ProviderFault("server", f"batch job {job} failed")
            time.sleep(POLL_SECONDS)
        raise ProviderFault("timeout", f"batch job {job} is still running; a later run takes it up")

    def reconcile(self) -> None:
        """Takes up every job that an earlier run has left, whether this input has its keys or not. Nothing is sent."""
        for job in self.ledger.jobs():
            self._drain(job)

    def batch(self, work: Iterator[tuple[str, str, str]]) -> None:
        """All open work as one job, held to the ceiling as a whole before it is sent. Keys wait in a file, inputs in the ledger."""
        with tempfile.TemporaryFile("w+") as keys:
            asked = needed = 0
            for key, inputs in self._open(work):
                keys.write(f"{key}\n")
                asked, needed = asked + 1, needed + self._needed(inputs)
            if not asked:
                return
            self._reserve(asked, needed)
            job = self.provider.submit_batch((key, self._request(self.ledger.inputs(key))) for key in _lines(keys))
            self.n.calls += asked
            self.ledger.mark_all_submitted(_lines(keys), job)
        self._drain(job)


def _lines(file: IO[str]) -> Iterator[str]:
    file.seek(0)
    return map(str.strip, file)


def _unresolved(keys: DataFrame, ledger: Ledger) -> DataFrame:
    """The keys that the ledger has no answer for and that no review holds back."""
    spark = keys.sparkSession
    done = ledger.completed_keys(spark).select(F.col("work_key").alias("__key"))
    held = ledger.withheld_keys(spark).select(F.col("work_key").alias("__key"))
    return keys.join(done.unionByName(held), "__key", "left_anti")


def _work(rows: DataFrame, waiting: DataFrame, step: Step, provider: str) -> Iterator[tuple[str, str, str]]:
    """(key, inputs, spec) of the waiting keys in the order of arrival, a portion of about PORTION bytes on the driver at a time.

    Keys and their order are a table; a key's inputs follow from it, so texts can be dealt again without becoming one.
    """
    size = waiting.agg(F.sum("size")).first()[0]
    if size is None:
        return
    before, after = C.spec_ends(**_material(step, provider))
    order = (F.col("first").asc_nulls_last(), F.col("__key").asc())
    texts = rows.groupBy("__key").agg(F.first("__inputs").alias("__inputs")).join(waiting.select("__key", "first"), "__key")
    dealt = texts.repartitionByRange(1 + size // PORTION, *order).sortWithinPartitions(*order)
    for key, inputs in dealt.select("__key", "__inputs").toLocalIterator():
        yield key, inputs, before + inputs + after


def apply(df: DataFrame, step: Step, provider: Provider, ledger: Ledger, arrival: Column | None = None) -> tuple[DataFrame, Counters]:
    """df with the step's fields for every resolved row, and what it took.

    Rows arrive in the order of `arrival`, nulls last; without it in that of Spark's scan, which takes large files first. Rows that stay without an answer are counted as withheld if a review holds them back, else as dropped.
    """
    rows = keyed(df, step, provider.id).withColumn("__at", F.monotonically_increasing_id() if arrival is None else arrival)
    keys = materialize(rows.groupBy("__key").agg(F.min("__at").alias("first"), F.count("*").alias("rows"), F.max(F.octet_length("__inputs")).cast("long").alias("size")))
    resolver = Resolver(step, provider, ledger)
    if step.mode == "batch":
        resolver.reconcile()
    waiting = materialize(_unresolved(keys, ledger))
    work = _work(rows, waiting, step, provider.id)
    (resolver.batch if step.mode == "batch" else resolver.online)(work)
    known = materialize(ledger.answers(df.sparkSession).select(F.col("work_key").alias("__key"), F.col("output_json").alias("__output")).join(keys.select("__key"), "__key", "left_semi"))
    held = ledger.withheld_keys(df.sparkSession).select(F.col("work_key").alias("__key"), F.lit(True).alias("held"))
    n = resolver.n
    counted = keys.join(known.select("__key", F.lit(True).alias("done")), "__key", "left").join(held, "__key", "left")
    sums = counted.agg(*(F.coalesce(F.sum(F.when(c, F.col("rows")).otherwise(0)), F.lit(0)) for c in (F.lit(True), F.col("done"), F.col("done").isNull() & F.col("held"), F.col("done").isNull() & F.col("held").isNull()))).first()
    n.seen, resolved, n.withheld, n.dropped = sums
    paid = waiting.join(known.select("__key"), "__key", "left_semi").count()
    n.reused = resolved - min(paid, n.calls)
    answer = F.from_json("__output", ", ".join(f"`{f['name']}` {_SPARK[f['type']]}" for f in step.fields))
    joined = rows.join(known, "__key").withColumn("__answer", answer)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__answer.`{f['name']}`").alias(f["name"]) for f in step.fields)), n
