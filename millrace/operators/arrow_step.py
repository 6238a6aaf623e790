"""Arrow function steps: batches in, batches out, under size limits; and references to packaged components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MAX_BATCH_BYTES = 64 << 20
_OCI = re.compile(r"oci://(?P<registry>[^/@]+)/(?P<repo>[^@]+)@sha256:(?P<digest>[0-9a-f]{64})")


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = MAX_BATCH_BYTES
    max_output_bytes: int = MAX_BATCH_BYTES


class LimitExceeded(RuntimeError):
    """A batch was larger than the step allows."""


def run(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limits: Limits = Limits()) -> DataFrame:
    """function over every batch of df; it may change columns and the number of rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.nbytes > limits.max_input_bytes:
                if batch.num_rows < 2:
                    raise LimitExceeded(f"an input row has {batch.nbytes} bytes, more than {limits.max_input_bytes}")
                half = batch.num_rows // 2
                yield from apply(iter([batch.slice(0, half), batch.slice(half)]))
                continue
            out = function(batch)
            if out.nbytes > limits.max_output_bytes:
                raise LimitExceeded(f"an output batch has {out.nbytes} bytes, more than {limits.max_output_bytes}")
            yield out

    return df.mapInArrow(apply, schema)


def gross(column: str, rate: float = 1.21, name: str = "amount_gross") -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The sample function: one more column, the amount with tax."""

    def function(batch: pa.RecordBatch) -> pa.RecordBatch:
        more = pc.multiply(batch.column(column), pa.scalar(rate))
        return pa.RecordBatch.from_arrays([*batch.columns, more], [*batch.schema.names, name])

    return function


@dataclass(frozen=True)
class Component:
    """Where a packaged function comes from: a path, or an image pinned by digest."""

    path: str | None = None
    registry: str | None = None
    repository: str | None = None
    digest: str | None = None


def parse_component(text: str) -> Component:
    if not text.strip():
        raise ValueError("the component is empty")
    if not text.startswith("oci://"):
        if "://" in text and not text.startswith("file://"):
            raise ValueError("a component is a path or an oci:// reference")
        return Component(path=text.removeprefix("file://"))
    found = _OCI.fullmatch(text)
    if not found:
        raise ValueError("an oci:// reference needs registry/repository@sha256: and 64 hex digits; tags can move")
    return Component(registry=found["registry"], repository=found["repo"], digest=found["digest"])


def allowed(component: Component, allow_list: Iterable[str]) -> bool:
    """Paths always; images only if their digest or a prefix of registry/repository is listed."""
    if component.path is not None:
        return True
    name = f"{component.registry}/{component.repository}"
    for entry in (e.removeprefix("oci://").strip() for e in allow_list):
        if entry and (entry in (f"sha256:{component.digest}", component.digest, f"{name}@sha256:{component.digest}") or name == entry or name.startswith(entry.rstrip("/") + "/")):
            return True
    return False


def conformance(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> list[str]:
    """Problems of a function with the standard fixture: it must keep the rows and add amount_gross."""
    n = 20
    batch = pa.record_batch({"id": pa.array(range(n), pa.int64()), "amount": pa.array([1.5 * i for i in range(n)]), "note": pa.array([None if i % 5 == 4 else f"note-{i}" for i in range(n)])})
    out, wrong = function(batch), []
    if out.num_rows != n:
        wrong.append(f"{out.num_rows} rows instead of {n}")
    if "amount_gross" not in out.schema.names:
        wrong.append("no column amount_gross")
    return wrong
