"""Strict validation of model output: every problem is reported, nothing is coerced."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FITS = {
    "utf8": lambda v: isinstance(v, str),
    "timestamp": lambda v: isinstance(v, str),
    "int64": lambda v: isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 64,
    "float64": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "bool": lambda v: isinstance(v, bool),
}


def _kind(value: object) -> str:
    if value is None:
        return "null"
    for name, types in (("bool", bool), ("number", (int, float)), ("string", str), ("array", list)):
        if isinstance(value, types):
            return name
    return "object"


def _no_constants(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def unfenced(text: str) -> str:
    """A model's answer without the code fence that some put around JSON."""
    text = text.strip()
    if not text.startswith("```"):
        return text
    return text.removeprefix("```").removeprefix("json").removesuffix("```").strip()


def problems(text: str | None, fields: Iterable[Mapping]) -> tuple[dict | None, list[str]]:
    """The output with its fields in declared order, or None and what is wrong with it."""
    try:
        value = json.loads(text or "", parse_constant=_no_constants)
    except ValueError:
        return None, ["output is not valid JSON"]
    if not isinstance(value, dict):
        return None, ["output is not a JSON object"]
    fields, wrong, out = list(fields), [], {}
    for f in fields:
        name = f["name"]
        if name not in value:
            wrong.append(f"`{name}` is missing")
        elif value[name] is None:
            if f.get("nullable"):
                out[name] = None
            else:
                wrong.append(f"`{name}` is null but not nullable")
        elif not _FITS[f["type"]](value[name]):
            wrong.append(f"`{name}` should be {f['type']}, not {_kind(value[name])}")
        elif f["type"] == "utf8" and f.get("maxChars") is not None and len(value[name]) > f["maxChars"]:
            wrong.append(f"`{name}` has {len(value[name])} characters, more than {f['maxChars']}")
        else:
            out[name] = value[name]
    declared = {f["name"] for f in fields}
    wrong += [f"`{name}` is not declared" for name in value if name not in declared]
    return (None, wrong) if wrong else (out, [])


def validated(text: Column, fields: Iterable[Mapping]) -> Column:
    """struct(output: canonical JSON or null, problems: all of them joined, or null)."""
    fields = [dict(f) for f in fields]

    @F.pandas_udf("output string, problems string")
    def check(texts: pd.Series) -> pd.DataFrame:
        found = [problems(t, fields) for t in texts]
        return pd.DataFrame({"output": [None if o is None else json.dumps(o, ensure_ascii=False, separators=(",", ":")) for o, _ in found], "problems": ["; ".join(w) or None for _, w in found]})

    return check(text)
