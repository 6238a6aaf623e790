"""Canonical JSON, work keys, token estimates and the deterministic provider, as column expressions.

All of it stays in the JVM; only inputs of type double go through an Arrow function, since Java prints doubles its own way.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of columns that may be inputs of a semantic step.
INPUT_TYPES = (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType, T.TimestampType, T.TimestampNTZType)
#: Control characters whose escape has a hex letter, which Java writes in upper case.
_LETTERED = ["0b", "0e", "0f", "1a", "1b", "1c", "1d", "1e", "1f"]
_TWO_64 = 18446744073709551616


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def shortest_double(x: float | None) -> str:
    """A double with the fewest digits that give it back: plain from 1e-5 to 1e16, else with an exponent."""
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "-0.0" if str(x)[0] == "-" else "0.0"
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    if 0 < point <= 16:
        return f"{sign}{figures.ljust(point, '0')[:point]}.{figures[point:] or '0'}"
    return f"{sign}{figures[0]}{'.' + figures[1:] if figures[1:] else ''}e{point - 1}"


@F.pandas_udf(T.StringType())
def _double_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: shortest_double(None if pd.isna(x) else float(x)))


def check_inputs(df: DataFrame, columns: Iterable[str], step: str = "") -> None:
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"step `{step}`: input column `{name}` is not in its input")
        if not isinstance(df.schema[name].dataType, INPUT_TYPES):
            raise ValueError(f"step `{step}`: input column `{name}` has type {df.schema[name].dataType.simpleString()}, which can't be an input")


def canonical_inputs(df: DataFrame, columns: Iterable[str]) -> Column:
    """The canonical JSON object of a row's columns; nulls are kept, timestamps are microseconds since 1970 in UTC."""
    parts = []
    for name in sorted(columns):
        kind, col = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.DoubleType):
            value = F.coalesce(_double_text(col), F.lit("null"))
        elif isinstance(kind, T.StringType):
            # The text of a one-field object, without its braces and key.
            inner = F.to_json(F.struct(col.alias("a")), {"ignoreNullFields": "false"})
            value = F.substring(inner, F.lit(6), F.length(inner) - 6)
            hit = col.rlike("[\\x0B\\x0E\\x0F\\x1A-\\x1F]")
            fixed = value
            for code in _LETTERED:
                fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u00" + code.upper(), r"$1\\u00" + code)
            value = F.when(hit, fixed).otherwise(value)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.coalesce(F.unix_micros(col.cast("timestamp")).cast("string"), F.lit("null"))
        else:
            value = F.coalesce(col.cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(canonical_json(name) + ":"), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def output_schema(fields: Iterable[Mapping]) -> dict:
    """The JSON Schema of a step's declared fields."""
    kinds = {"utf8": "string", "int64": "integer", "float64": "number", "bool": "boolean", "timestamp": "string"}
    properties = {}
    for f in fields:
        kind = kinds[f["type"]]
        own = properties[f["name"]] = {"type": [kind, "null"] if f.get("nullable") else kind}
        if f["type"] == "utf8" and f.get("maxChars") is not None:
            own["maxLength"] = f["maxChars"]
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def spec_ends(*, operation: str, instruction: str, schema: dict, provider: str, model: str, params: dict) -> tuple[str, str]:
    """What stands before and after the canonical inputs in the canonical JSON of one unit of work."""
    rest = {"instruction": instruction, "model": model, "operation": operation, "output_schema": schema, "params": params, "provider": provider}
    return '{"inputs":', "," + canonical_json(rest)[1:]


def work_spec(inputs: Column, **material) -> Column:
    """Canonical JSON of one unit of work around the canonical inputs of a row; material as in spec_ends."""
    before, after = spec_ends(**material)
    return F.concat(F.lit(before), inputs, F.lit(after))


def work_key(spec: Column) -> Column:
    return F.sha2(spec.cast("binary"), 256)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def unit_key(pipeline: str, url: Column, size: Column, modified_millis: Column) -> Column:
    """Key of a work unit: name, 0, URL, 0, then size and time as 8 bytes each, the highest first."""
    eight = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(F.encode(F.lit(pipeline), "utf-8"), zero, F.encode(url, "utf-8"), zero, eight(size), eight(modified_millis)), 256)


def mock_seed(inputs: Column, instruction: str) -> Column:
    digest = F.sha2(F.concat(inputs, F.lit(instruction)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def mock_values(inputs: Column, instruction: str, fields: Iterable[Mapping], alphabetical: bool = True) -> dict[str, Column]:
    """What the deterministic provider answers for each field."""
    seed, fields = mock_seed(inputs, instruction), list(fields)
    ordered = sorted(fields, key=lambda f: f["name"]) if alphabetical else fields
    out = {}
    for i, f in enumerate(ordered):
        salt = (seed + F.lit(i).cast("decimal(20,0)")) % F.lit(str(_TWO_64)).cast("decimal(20,0)")
        short = lambda n: (salt % F.lit(n).cast("decimal(20,0)")).cast("long")  # noqa: B023, E731
        if f["type"] == "int64":
            value = short(1000)
        elif f["type"] == "float64":
            value = short(1000) / F.lit(10.0)
        elif f["type"] == "bool":
            value = short(2) == 0
        else:
            value = F.concat(F.lit(f["name"] + "-"), F.lpad(F.lower(F.hex(short(0xFFFF))), 4, "0"))
            if f.get("maxChars") is not None:
                value = F.substring(value, 1, f["maxChars"])
        out[f["name"]] = value
    return {f["name"]: out[f["name"]] for f in fields}


def mock_text(values: Mapping[str, Column], fields: Iterable[Mapping], alphabetical: bool = True) -> Column:
    """The answer as the provider's JSON text."""
    kinds = {f["name"]: f["type"] for f in fields}
    names = sorted(values) if alphabetical else list(values)
    parts = []
    for name in names:
        v = values[name]
        if kinds[name] in ("utf8", "timestamp"):
            v = F.concat(F.lit('"'), v, F.lit('"'))
        else:
            v = v.cast("string")
        parts.append(F.concat(F.lit(canonical_json(name) + ":"), v))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def mock_tokens(inputs: Column, instruction: str, text: Column) -> tuple[Column, Column]:
    taken = F.floor((F.lit(len(instruction.encode())) + F.octet_length(inputs)) / F.lit(4)).cast("long")
    return taken, F.floor(F.octet_length(text) / F.lit(4)).cast("long")


def strip_fences(text: Column) -> Column:
    """A model's JSON without the code fence around it."""
    t = F.trim(text)
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"```$", ""))).otherwise(t)


def values_match(expected: Column, actual: Column, kind: str) -> Column:
    """Texts trimmed and regardless of ASCII case, doubles within 1e-6, null only with null."""
    if kind == "utf8":
        fold = lambda c: F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return fold(expected).eqNullSafe(fold(actual))
    if kind == "float64":
        return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(F.abs(expected - actual) < 1e-6)
    return expected.eqNullSafe(actual)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))
