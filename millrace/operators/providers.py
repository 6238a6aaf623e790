"""Model providers: the deterministic one, chat completions over HTTP, and a declared one without a client here."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from millrace.functions.canonical import canonical_json


class ProviderFault(RuntimeError):
    """kind: timeout, throttled, transport, protocol, server or unsupported."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Request:
    instruction: str
    inputs: dict
    schema: dict
    max_output_tokens: int | None = None


@dataclass(frozen=True)
class Response:
    text: str
    input_tokens: int
    output_tokens: int
    request_id: str


class Provider(ABC):
    id = ""
    has_batch = False

    @abstractmethod
    def invoke(self, request: Request) -> Response: ...

    def submit_batch(self, requests: Iterable[tuple[str, Request]]) -> str:
        """Requests are read once; more of them may come than memory holds."""
        raise ProviderFault("unsupported", f"`{self.id}` has no batch mode")

    def poll_batch(self, job: str) -> str:
        """running, completed or failed."""
        raise ProviderFault("unsupported", f"`{self.id}` has no batch mode")

    def fetch_batch(self, job: str) -> Iterator[tuple[str, Response | str]]:
        """Keys with a response, or an error's text."""
        raise ProviderFault("unsupported", f"`{self.id}` has no batch mode")


class MockProvider(Provider):
    """Answers are functions of the inputs and the instruction; batch jobs are done after some polls, their answers in a file."""

    id, has_batch = "mock", True

    def __init__(self, polls: int = 0, alphabetical: bool = True) -> None:
        self.polls, self.alphabetical, self.calls = polls, alphabetical, 0
        self.jobs: dict[str, list] = {}

    def _answer(self, request: Request) -> Response:
        given = canonical_json(request.inputs)
        seed = int.from_bytes(hashlib.sha256((given + request.instruction).encode()).digest()[:8], "big")
        properties, out = request.schema.get("properties", {}), {}
        for i, name in enumerate(sorted(properties) if self.alphabetical else properties):
            salt, own = (seed + i) % (1 << 64), properties[name]
            kind = own.get("type", "string")
            kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
            if kind == "integer":
                out[name] = salt % 1000
            elif kind == "number":
                out[name] = salt % 1000 / 10.0
            elif kind == "boolean":
                out[name] = salt % 2 == 0
            else:
                out[name] = f"{name}-{salt % 0xFFFF:04x}"[: own.get("maxLength")]
        text = json.dumps(out, separators=(",", ":"), ensure_ascii=False)
        return Response(text, (len(request.instruction.encode()) + len(given.encode())) // 4, len(text.encode()) // 4, f"mock-{seed:016x}")

    def invoke(self, request: Request) -> Response:
        self.calls += 1
        return self._answer(request)

    def submit_batch(self, requests: Iterable[tuple[str, Request]]) -> str:
        job, answers = f"mock-job-{len(self.jobs)}", tempfile.TemporaryFile("w+")
        for key, request in requests:
            self.calls += 1
            r = self._answer(request)
            answers.write(json.dumps([key, r.text, r.input_tokens, r.output_tokens, r.request_id]) + "\n")
        self.jobs[job] = [self.polls, answers]
        return job

    def poll_batch(self, job: str) -> str:
        if job not in self.jobs:
            return "failed"
        self.jobs[job][0] -= 1
        return "completed" if self.jobs[job][0] < 0 else "running"

    def fetch_batch(self, job: str) -> Iterator[tuple[str, Response | str]]:
        answers = self.jobs[job][1]
        answers.seek(0)
        for key, *response in map(json.loads, answers):
            yield key, Response(*response)


class ChatCompletions(Provider):
    """POST {base}/chat/completions in JSON mode at temperature 0; the key comes from the environment."""

    id, has_batch = "openai-compat", False

    def __init__(self, model: str, base_url: str, key_env: str = "MILLRACE_MODEL_KEY", timeout: float = 120) -> None:
        self.model, self.base, self.key_env, self.timeout = model, base_url.rstrip("/"), key_env, timeout

    def body(self, request: Request) -> dict:
        system = f"{request.instruction}\nAnswer with one JSON object for this JSON Schema: {canonical_json(request.schema)}"
        body = {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": canonical_json(request.inputs)}]}
        return body | ({"max_tokens": request.max_output_tokens} if request.max_output_tokens else {})

    def invoke(self, request: Request) -> Response:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if (key := os.environ.get(self.key_env)) else {})
        call = urllib.request.Request(f"{self.base}/chat/completions", json.dumps(self.body(request)).encode(), headers)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                value = json.load(answer)
            text = value["choices"][0]["message"]["content"]
            usage = value.get("usage", {})
        except urllib.error.HTTPError as e:
            raise ProviderFault("throttled" if e.code == 429 else "server" if e.code >= 500 else "protocol", str(e)) from e
        except TimeoutError as e:
            raise ProviderFault("timeout", str(e)) from e
        except urllib.error.URLError as e:
            raise ProviderFault("timeout" if isinstance(e.reason, TimeoutError) else "transport", str(e)) from e
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ProviderFault("protocol", f"unexpected answer: {e!r}") from e
        return Response(text, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), value.get("id", ""))


class Bedrock(Provider):
    id, has_batch = "bedrock", True

    def invoke(self, request: Request) -> Response:
        raise ProviderFault("unsupported", "no client library for this provider is installed")


def provider_for(model: dict) -> Provider:
    kinds = {"mock": lambda: MockProvider(), "openai-compat": lambda: ChatCompletions(model["model"], model.get("baseUrl") or "http://127.0.0.1:11434/v1"), "bedrock": lambda: Bedrock()}
    if model["provider"] not in kinds:
        raise ValueError(f"unknown provider `{model['provider']}`")
    return kinds[model["provider"]]()
