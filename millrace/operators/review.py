"""Decisions on withheld records."""

from __future__ import annotations

import json

from millrace.functions.validation import problems
from millrace.operators.ledger import Ledger, Result

_KINDS = {"string": "utf8", "integer": "int64", "number": "float64", "boolean": "bool"}


def fields_of(schema: dict) -> list[dict]:
    """Declared fields from a step's JSON Schema."""
    fields = []
    for name, own in schema.get("properties", {}).items():
        kinds = own["type"] if isinstance(own["type"], list) else [own["type"]]
        field = {"name": name, "type": _KINDS[next(k for k in kinds if k != "null")], "nullable": "null" in kinds}
        fields.append(field | ({"maxChars": own["maxLength"]} if "maxLength" in own else {}))
    return fields


def accept(ledger: Ledger, key: str, output: str) -> str:
    """Record a corrected output as completed by a person; it must satisfy the schema of its work."""
    item = ledger.item(key)
    if item is None or ledger.review_status(key) != "pending":
        raise LookupError(f"no pending review `{key}`")
    value, wrong = problems(output, fields_of(json.loads(item["spec_json"])["output_schema"]))
    if wrong:
        raise ValueError("; ".join(wrong))
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    ledger.complete(key, Result(text, "human-review", "human", "", 0, 0, "human-accepted"))
    ledger.decide(key, "accepted")
    return text


def reject(ledger: Ledger, key: str) -> None:
    if not ledger.decide(key, "rejected"):
        raise LookupError(f"no pending review `{key}`")


def export(ledger: Ledger) -> str:
    """Pending reviews as JSON lines."""
    rows = ({"workKey": r["work_key"], "transform": r["transform_id"], "reason": r["reason"], "rawOutput": r["raw_output"], "queuedAt": r["created_at"], "spec": json.loads(r["spec_json"])} for r in ledger.reviews())
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
