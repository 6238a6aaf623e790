"""What connectors there are, and what each promises."""

from __future__ import annotations

#: Id, role, level, modes, schemes, delivery.
CONNECTORS = [
    {"id": "object_store.parquet", "role": "source", "level": "supported", "modes": ["scan"], "schemes": ["file", "s3", "gs", "az"], "delivery": "at-least-once by file"},
    {"id": "object_store.ndjson", "role": "source", "level": "supported", "modes": ["scan"], "schemes": ["file", "s3", "gs", "az"], "delivery": "at-least-once by file"},
    {"id": "parquet", "role": "sink", "level": "supported", "modes": ["append", "upsert"], "schemes": ["file", "s3", "gs", "az"], "delivery": "at-least-once, staged"},
    {"id": "postgres", "role": "sink", "level": "interface", "modes": ["append", "upsert"], "schemes": ["jdbc"], "delivery": "at-least-once, one transaction"},
    {"id": "flightSql", "role": "sink", "level": "interface", "modes": ["append"], "schemes": ["http", "https"], "delivery": "at-least-once"},
    {"id": "adbc", "role": "sink", "level": "planned", "modes": [], "schemes": [], "delivery": "none yet"},
    {"id": "sql", "role": "transform", "level": "supported", "modes": ["whole input"], "schemes": [], "delivery": "pure"},
    {"id": "ai", "role": "transform", "level": "supported", "modes": ["online", "batch"], "schemes": [], "delivery": "each unit of work once, by ledger"},
    {"id": "arrow", "role": "transform", "level": "supported", "modes": ["batch function"], "schemes": [], "delivery": "pure"},
]


def find(name: str) -> dict:
    for c in CONNECTORS:
        if c["id"] == name:
            return c
    raise LookupError(f"no connector `{name}`")
