"""The pipeline document: strict loading, and validation that reports everything at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from typing import Any

import yaml

from millrace.operators import sql_step
from millrace.operators.arrow_step import parse_component

#: The schema, as fixed values: key -> type, "!" marks a required one. Sections are named in braces.
_SHAPES: dict[str, dict[str, str]] = {
    "document": {"apiVersion": "str!", "kind": "str!", "metadata": "{metadata}!", "spec": "{spec}!"},
    "metadata": {"name": "str!"},
    "spec": {"models": "map{model}", "source": "{source}!", "transforms": "[{transform}]", "sink": "{sink}", "sinks": "[{bound_sink}]", "runtime": "{runtime}"},
    "model": {"provider": "str!", "model": "str!", "region": "str", "baseUrl": "str", "batch": "{model_batch}"},
    "model_batch": {"roleArn": "str!", "s3Prefix": "str!"},
    "source": {"type": "str!", "url": "str!", "format": "{format}!", "location": "str"},
    "format": {"type": "str!"},
    "sql": {"id": "str!", "type": "str!", "from": "str", "query": "str!"},
    "wasm": {"id": "str!", "type": "str!", "from": "str", "component": "str!", "limits": "{limits}"},
    "limits": {"maxMemoryBytes": "int", "maxFuel": "int", "maxInputBytes": "int", "maxOutputBytes": "int"},
    "ai": {"id": "str!", "type": "str!", "from": "str", "model": "str!", "execution": "str", "dispatch": "{dispatch}", "inputs": "[str]!", "instruction": "str!", "output": "{output}!", "validation": "{validation}", "budget": "{budget}", "breaker": "{breaker}"},
    "dispatch": {"expectedRecords": "int", "deadlineSeconds": "int", "inputTokensPerRecord": "int", "outputTokensPerRecord": "int", "rateCard": "str"},
    "output": {"fields": "[{field}]!"},
    "field": {"name": "str!", "type": "str!", "nullable": "bool", "maxChars": "int"},
    "validation": {"onInvalid": "str"},
    "budget": {"maxInputTokensPerRecord": "int", "maxOutputTokensPerRecord": "int", "maxRunTokens": "int"},
    "breaker": {"maxConsecutiveInvalid": "int"},
    "postgres": {"type": "str!", "target": "str!", "mode": "str", "keys": "[str]", "dsnEnv": "str"},
    "flightSql": {"type": "str!", "endpoint": "str!", "target": "str!", "mode": "str", "tokenEnv": "str"},
    "parquet": {"type": "str!", "target": "str!", "mode": "str", "keys": "[str]"},
    "runtime": {"targetBatchBytes": "int", "maxInflightBytes": "int", "checkpoint": "{checkpoint}", "wasmOciAllowlist": "[str]", "residency": "{residency}"},
    "checkpoint": {"url": "str!"},
    "residency": {"allowedLocations": "[str]!", "allowedSchemes": "[str]"},
}
_TYPES = {"str": str, "int": int, "bool": bool}
FIELD_TYPES = ("utf8", "int64", "float64", "bool", "timestamp")
SCHEMES = {"": "file", "file": "file", "s3": "s3", "gs": "gs", "az": "az", "azure": "az", "adl": "az", "abfs": "az", "abfss": "az", "https": "az"}
AI = ("ai.extract", "ai.classify", "ai.generate")
DEFAULTS = {"targetBatchBytes": 8 << 20, "maxInflightBytes": 256 << 20}


class SpecError(ValueError):
    """All issues of a document, each as `path: what`."""

    def __init__(self, issues: list[str]) -> None:
        super().__init__("\n".join(issues))
        self.issues = issues


class _Strict(yaml.SafeLoader):
    pass


def _unique(loader: yaml.SafeLoader, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
    if twice := [k for k, n in Counter(map(str, keys)).items() if n > 1]:
        raise SpecError([f"{twice[0]}: the key is there twice"])
    return yaml.SafeLoader.construct_mapping(loader, node, deep=True)


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _unique)


def _shape(value: Any, shape: str, path: str, issues: list[str]) -> None:
    if shape == "transform":
        kind = value.get("type") if isinstance(value, Mapping) else None
        if kind not in ("sql", "wasm", *AI):
            issues.append(f"{path}.type: not a transform: {kind!r}")
            return
        shape = "ai" if kind in AI else kind
    elif shape in ("sink", "bound_sink"):
        kind = value.get("type") if isinstance(value, Mapping) else None
        if kind not in ("postgres", "flightSql", "parquet"):
            issues.append(f"{path}.type: not a sink: {kind!r}")
            return
        known = dict(_SHAPES[kind]) | ({"id": "str!", "from": "str"} if shape == "bound_sink" else {})
        _section(value, known, path, issues)
        return
    _section(value, _SHAPES[shape], path, issues)


def _section(value: Any, known: dict[str, str], path: str, issues: list[str]) -> None:
    if not isinstance(value, Mapping):
        issues.append(f"{path or 'document'}: not a mapping")
        return
    dot = f"{path}." if path else ""
    issues += [f"{dot}{k}: not a known key" for k in value if k not in known]
    for key, kind in known.items():
        if value.get(key) is None:
            if kind.endswith("!"):
                issues.append(f"{dot}{key}: is missing")
            continue
        _typed(value[key], kind.rstrip("!"), f"{dot}{key}", issues)


def _typed(value: Any, kind: str, path: str, issues: list[str]) -> None:
    if kind.startswith("["):
        if not isinstance(value, list):
            issues.append(f"{path}: not a list")
            return
        for i, x in enumerate(value):
            _typed(x, kind[1:-1], f"{path}[{i}]", issues)
    elif kind.startswith("map{"):
        if not isinstance(value, Mapping):
            issues.append(f"{path}: not a mapping")
            return
        for k, x in value.items():
            _shape(x, kind[4:-1], f"{path}.{k}", issues)
    elif kind.startswith("{"):
        _shape(value, kind[1:-1], path, issues)
    elif not isinstance(value, _TYPES[kind]) or kind == "int" and isinstance(value, bool):
        issues.append(f"{path}: should be {kind}, not {type(value).__name__}")


def load(text: str) -> dict:
    """The document as a dict; unknown keys, wrong types and missing keys are errors."""
    try:
        value = yaml.load(text, _Strict)
    except yaml.YAMLError as e:
        raise SpecError([f"document: {e}"]) from e
    issues: list[str] = []
    _shape(value, "document", "", issues)
    if issues:
        raise SpecError(issues)
    return value


def scheme_of(url: str) -> str | None:
    """file, s3, gs or az; None if it is none of them."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*)://", url)
    if not found:
        return "file"
    name = found[1].lower()
    if name == "https" and not re.match(r"https://[^/]+\.(?:blob|dfs)\.(?:core\.windows\.net|fabric\.microsoft\.com)(?:/|$)", url, re.IGNORECASE):
        return None
    return SCHEMES.get(name)


def edges(spec: Mapping) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(step, upstream) of transforms and of sinks, default wiring filled in."""
    steps = spec.get("transforms") or []
    wired, last = [], "source"
    for t in steps:
        wired.append((t["id"], t.get("from") or last))
        last = t["id"]
    if spec.get("sink"):
        return wired, [("sink", last)]
    return wired, [(s["id"], s.get("from") or last) for s in spec.get("sinks") or []]


#: A pipeline's name: a DNS label.
NAME = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def validate(doc: Mapping) -> list[str]:
    """Every issue as `path: what`; an empty list means the document can be planned."""
    out: list[str] = []
    spec = doc["spec"]
    if not re.fullmatch(r"[A-Za-z0-9.\-]+/v1alpha1", doc["apiVersion"]):
        out.append(f"apiVersion: `{doc['apiVersion']}` is not supported")
    if doc["kind"] != "Pipeline":
        out.append(f"kind: `{doc['kind']}` is not Pipeline")
    if not re.fullmatch(NAME, doc["metadata"]["name"]):
        out.append("metadata.name: 1 to 63 lower-case letters, digits and inner hyphens")
    models = spec.get("models") or {}
    for name, m in models.items():
        at = f"spec.models.{name}"
        out += [f"{at}.{k}: is empty" for k in ("provider", "model") if not m[k].strip()]
        if m["provider"].strip() and m["provider"] not in ("mock", "openai-compat", "bedrock"):
            out.append(f"{at}.provider: unknown provider `{m['provider']}`")
        if b := m.get("batch"):
            if not b["roleArn"].strip():
                out.append(f"{at}.batch.roleArn: is empty")
            if not b["s3Prefix"].startswith("s3://"):
                out.append(f"{at}.batch.s3Prefix: does not start with s3://")
    source = spec["source"]
    if source["type"] != "object_store":
        out.append(f"spec.source.type: `{source['type']}` is not object_store")
    if source["format"]["type"] not in ("parquet", "ndjson"):
        out.append(f"spec.source.format.type: `{source['format']['type']}` is neither parquet nor ndjson")
    if not source["url"].strip():
        out.append("spec.source.url: is empty")
    elif scheme_of(source["url"]) is None:
        out.append("spec.source.url: its scheme is not supported")
    if source.get("location") is not None and not source["location"].strip():
        out.append("spec.source.location: is empty")
    for i, t in enumerate(spec.get("transforms") or []):
        _transform(t, f"spec.transforms[{i}]", models, out)
    _sinks(spec, out)
    _topology(spec, out)
    _runtime(spec, models, out)
    return out


def _transform(t: Mapping, at: str, models: Mapping, out: list[str]) -> None:
    if not t["id"].strip():
        out.append(f"{at}.id: is empty")
    if t["type"] == "sql":
        try:
            sql_step.check(t["query"])
        except sql_step.InvalidData as e:
            out.append(f"{at}.query: {e}")
        return
    if t["type"] == "wasm":
        try:
            parse_component(t["component"])
        except ValueError as e:
            out.append(f"{at}.component: {e}")
        out.extend(f"{at}.limits.{k}: must be above 0" for k, v in (t.get("limits") or {}).items() if v <= 0)
        return
    if t["model"] not in models:
        out.append(f"{at}.model: `{t['model']}` is not declared in spec.models")
    if t.get("execution", "auto") not in ("auto", "online", "batch"):
        out.append(f"{at}.execution: is not auto, online or batch")
    if not t["inputs"]:
        out.append(f"{at}.inputs: needs at least one column")
    out.extend(f"{at}.inputs: `{x}` is there twice" for x, n in Counter(t["inputs"]).items() if n > 1)
    if not t["instruction"].strip():
        out.append(f"{at}.instruction: is empty")
    fields = t["output"]["fields"]
    if not fields:
        out.append(f"{at}.output.fields: needs at least one field")
    out.extend(f"{at}.output.fields: `{x}` is there twice" for x, n in Counter(f["name"] for f in fields).items() if n > 1)
    for k, f in enumerate(fields):
        here = f"{at}.output.fields[{k}]"
        if not f["name"].strip():
            out.append(f"{here}.name: is empty")
        if f["type"] not in FIELD_TYPES:
            out.append(f"{here}.type: `{f['type']}` is not a field type")
        most = f.get("maxChars")
        if most is not None and (f["type"] != "utf8" or most <= 0):
            out.append(f"{here}.maxChars: only for utf8, and above 0")
        if t["type"] == "ai.generate" and (f["type"] != "utf8" or most is None):
            out.append(f"{here}: generated fields are utf8 with maxChars")
    if (t.get("validation") or {}).get("onInvalid", "fail") not in ("fail", "drop", "review"):
        out.append(f"{at}.validation.onInvalid: is not fail, drop or review")
    budget = t.get("budget") or {}
    out.extend(f"{at}.budget.{k}: must be above 0" for k, v in budget.items() if v <= 0)
    if t["type"] == "ai.generate" and budget.get("maxOutputTokensPerRecord") is None:
        out.append(f"{at}.budget.maxOutputTokensPerRecord: generation needs it")
    if (t.get("breaker") or {}).get("maxConsecutiveInvalid", 25) <= 0:
        out.append(f"{at}.breaker.maxConsecutiveInvalid: must be above 0")


def _sinks(spec: Mapping, out: list[str]) -> None:
    if bool(spec.get("sink")) == bool(spec.get("sinks")):
        out.append("spec: exactly one of sink and sinks")
    named = [("spec.sink", spec["sink"])] if spec.get("sink") else [(f"spec.sinks[{i}]", s) for i, s in enumerate(spec.get("sinks") or [])]
    for at, s in named:
        mode, keys, parts = s.get("mode", "append"), s.get("keys") or [], s["target"].split(".")
        if mode not in ("append", "upsert"):
            out.append(f"{at}.mode: is neither append nor upsert")
        if s["type"] == "postgres" and (len(parts) != 2 or not all(p.strip() for p in parts)):
            out.append(f"{at}.target: should be schema.table")
        if s["type"] == "flightSql":
            if len(parts) not in (2, 3) or not all(p.strip() for p in parts):
                out.append(f"{at}.target: should have two or three parts")
            if not re.match(r"https?://", s["endpoint"]):
                out.append(f"{at}.endpoint: should be an http(s) URL")
            if mode != "append":
                out.append(f"{at}.mode: only append")
        elif mode == "upsert":
            if not keys:
                out.append(f"{at}.keys: upsert needs them")
            if len(set(keys)) < len(keys) or not all(k.strip() for k in keys):
                out.append(f"{at}.keys: each non-empty and once")
        elif keys:
            out.append(f"{at}.keys: only for upsert")


def _topology(spec: Mapping, out: list[str]) -> None:
    steps, sinks = edges(spec)
    ids = [i for i, _ in steps]
    out.extend(f"spec: the id `{i}` is there twice" for i, n in Counter([*ids, *(i for i, _ in sinks if spec.get("sinks"))]).items() if n > 1)
    out.extend("spec: `source` is the source's own id" for i in ids if i == "source")
    known, up = {"source", *ids}, dict(steps)
    for i, parent in [*steps, *sinks]:
        if parent not in known:
            out.append(f"spec: `{i}` reads from `{parent}`, which is not a step")
        elif parent == i:
            out.append(f"spec: `{i}` reads from itself")
    for i in ids:
        seen, at = set(), i
        while at in up and at not in seen:
            seen.add(at)
            at = up[at]
        if at != "source" and at in seen and up.get(i) != i:
            out.append(f"spec: `{i}` is part of, or hangs on, a cycle")
    read = {p for _, p in [*steps, *sinks]}
    out.extend(f"spec: nothing reads from `{i}`" for i in ids if i not in read)


def _runtime(spec: Mapping, models: Mapping, out: list[str]) -> None:
    r = DEFAULTS | (spec.get("runtime") or {})
    if r["targetBatchBytes"] <= 0:
        out.append("spec.runtime.targetBatchBytes: must be above 0")
    if r["maxInflightBytes"] < r["targetBatchBytes"]:
        out.append("spec.runtime.maxInflightBytes: less than targetBatchBytes")
    if r.get("checkpoint") and not r["checkpoint"]["url"].strip():
        out.append("spec.runtime.checkpoint.url: is empty")
    rules = r.get("residency")
    if not rules:
        return
    at, places, schemes = "spec.runtime.residency", rules["allowedLocations"], rules.get("allowedSchemes")
    if not places or not all(p.strip() for p in places):
        out.append(f"{at}.allowedLocations: needs non-empty names")
    if schemes is not None and (not schemes or not all(s.strip() for s in schemes)):
        out.append(f"{at}.allowedSchemes: needs non-empty names")
    source, scheme = spec["source"], scheme_of(spec["source"]["url"])
    if scheme and scheme != "file":
        if schemes is not None and scheme not in [SCHEMES.get(s.lower(), s.lower()) for s in schemes]:
            out.append(f"spec.source.url: scheme `{scheme}` is not allowed by residency")
        if source.get("location") is None:
            out.append("spec.source.location: residency rules need it for cloud sources")
        elif source["location"] not in places:
            out.append(f"spec.source.location: `{source['location']}` is not allowed")
    for name, m in models.items():
        if m.get("region") is not None and m["region"] not in places:
            out.append(f"spec.models.{name}.region: `{m['region']}` is not allowed")


def parse(text: str) -> dict:
    """A loaded and valid document."""
    doc = load(text)
    if issues := validate(doc):
        raise SpecError(issues)
    return doc


def json_schema() -> dict:
    """JSON Schema of the document, from the same table that loads it."""

    def of(kind: str) -> dict:
        if kind.startswith("["):
            return {"type": "array", "items": of(kind[1:-1])}
        if kind.startswith("map{"):
            return {"type": "object", "additionalProperties": {"$ref": f"#/$defs/{kind[4:-1]}"}}
        if kind.startswith("{"):
            return {"$ref": f"#/$defs/{kind[1:-1]}"}
        return {"type": {"str": "string", "int": "integer", "bool": "boolean"}[kind]}

    def section(known: dict[str, str]) -> dict:
        return {"type": "object", "properties": {k: of(v.rstrip("!")) for k, v in known.items()}, "required": [k for k, v in known.items() if v.endswith("!")], "additionalProperties": False}

    defs = {k: section(v) for k, v in _SHAPES.items() if k != "document"}
    sinks = ("postgres", "flightSql", "parquet")
    defs["transform"] = {"anyOf": [{"$ref": f"#/$defs/{k}"} for k in ("sql", "ai", "wasm")]}
    defs["sink"] = {"anyOf": [{"$ref": f"#/$defs/{k}"} for k in sinks]}
    defs["bound_sink"] = {"anyOf": [section(_SHAPES[k] | {"id": "str!", "from": "str"}) for k in sinks]}
    return section(_SHAPES["document"]) | {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": defs}
