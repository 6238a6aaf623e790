"""Work-unit checkpoints: a log of claims and completions, one JSON object a line, each flushed to disk."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterable

from millrace.sources.object_store import WorkUnit


def unit_key(pipeline: str, unit: WorkUnit) -> str:
    """Path, size and time decide: a file written anew is new work; the plan is not part of it."""
    h = hashlib.sha256(pipeline.encode() + b"\0" + unit.url.encode() + b"\0")
    h.update(unit.size.to_bytes(8, "big") + unit.modified_millis.to_bytes(8, "big", signed=True))
    return h.hexdigest()


class CheckpointLog:
    """A torn last line is cut off; one in the middle is an error."""

    def __init__(self, folder: str) -> None:
        scheme = folder.partition("://")[0] if "://" in folder else "file"
        if scheme != "file":
            raise ValueError(f"a checkpoint log is a local file of the driver, which {scheme}:// is not")
        folder = folder.removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, "checkpoint.jsonl")
        self.done: set[str] = set()
        self._load()

    def _load(self) -> None:
        if not os.path.exists(self.path):
            return
        with open(self.path, "rb") as f:
            data = f.read()
        good = 0
        for line in data.splitlines(keepends=True):
            try:
                if not line.endswith(b"\n"):
                    raise ValueError("torn")
                entry = json.loads(line)
            except ValueError as e:
                if good + len(line) < len(data):
                    raise RuntimeError(f"{self.path} is damaged at byte {good}") from e
                with open(self.path, "r+b") as f:
                    f.truncate(good)
                return
            good += len(line)
            if "completed" in entry:
                self.done.add(entry["completed"]["key"])

    def _append(self, entry: dict) -> None:
        with open(self.path, "ab") as f:
            f.write((json.dumps(entry, separators=(",", ":")) + "\n").encode())
            f.flush()
            os.fsync(f.fileno())

    def pending(self, pipeline: str, units: Iterable[WorkUnit]) -> list[WorkUnit]:
        return [u for u in units if unit_key(pipeline, u) not in self.done]

    def claim(self, pipeline: str, units: Iterable[WorkUnit], run: str) -> None:
        for u in units:
            self._append({"claimed": {"key": unit_key(pipeline, u), "unit": {"url": u.url, "size": u.size, "modifiedMillis": u.modified_millis}, "runId": run, "atMillis": int(time.time() * 1000)}})

    def complete(self, pipeline: str, units: Iterable[WorkUnit], run: str) -> None:
        for u in units:
            key = unit_key(pipeline, u)
            if key not in self.done:
                self._append({"completed": {"key": key, "runId": run, "atMillis": int(time.time() * 1000)}})
                self.done.add(key)
