"""A language-model server over HTTP: a small client, with a transport that tests replace, and answers to whole tables of prompts."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame

Transport = Callable[[str, str, dict | None, float], Iterator[str]]  # method, address, body, timeout -> lines


def http(method: str, address: str, body: dict | None, timeout: float) -> Iterator[str]:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(address, data=data, method=method, headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        for line in answer:
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def approx_tokens(text: str) -> int:
    return max(1, len(text.split()))


@dataclass(frozen=True)
class Progress:
    tokens: int
    elapsed: timedelta
    fraction: float | None


@dataclass
class ModelServer:
    host: str = "http://127.0.0.1:11434"
    model: str = "llama3.2:1b-instruct-fp16"
    num_predict: int = 300
    transport: Transport = http

    def _lines(self, method: str, path: str, body: dict | None = None, timeout: float = 300) -> Iterator[str]:
        return self.transport(method, self.host.rstrip("/") + path, body, timeout)

    def _whole(self, method: str, path: str, body: dict | None = None, timeout: float = 300) -> str:
        return "\n".join(self._lines(method, path, body, timeout))

    def tags(self) -> list[str]:
        return [m.get("name", "") for m in json.loads(self._whole("GET", "/api/tags")).get("models") or []]

    def show(self) -> str:
        return self._whole("POST", "/api/show", {"name": self.model})

    def pull(self) -> Iterator[str]:
        """The states of a download, up to success; lines that aren't JSON are passed over."""
        for record in _records(self._lines("POST", "/api/pull", {"name": self.model, "stream": True})):
            if "status" in record:
                status = record["status"] or ""
                yield status
                if "success" in status.lower():
                    return

    def ensure(self) -> bool:
        """Whether the model had to be pulled."""
        if self.model.lower() in (t.lower() for t in self.tags()):
            return False
        for _ in self.pull():
            pass
        return True

    def generate(self, prompt: str) -> Iterator[str]:
        body = {"model": self.model, "prompt": prompt, "stream": True, "options": {"num_predict": self.num_predict}}
        for record in _records(self._lines("POST", "/api/generate", body)):
            if record.get("response"):
                yield record["response"]
            if record.get("done"):
                return

    def generate_text(self, prompt: str, on_progress: Callable[[Progress], None] | None = None, expected: int | None = None) -> str:
        began, tokens, parts = time.monotonic(), 0, []
        for part in self.generate(prompt):
            parts.append(part)
            tokens += approx_tokens(part)
            if on_progress:
                fraction = min(1.0, max(0.0, tokens / expected)) if expected and expected > 0 else None
                on_progress(Progress(tokens, timedelta(seconds=time.monotonic() - began), fraction))
        return "".join(parts).strip()

    def chat(self, messages: str | list[dict]) -> str:
        if isinstance(messages, str):
            messages = [{"role": "user", "content": messages}]
        answer = json.loads(self._whole("POST", "/api/chat", {"model": self.model, "stream": False, "messages": messages}, 120))
        content = (answer.get("message") or {}).get("content")
        return (content if content is not None else answer.get("response") or "").strip()


def answers(prompts: DataFrame, server: ModelServer, requests: int = 8, batch_rows: int = 100) -> DataFrame:
    """(id, answer, error) of prompts (id, and prompt or messages, an array of structs of role and content).

    Tasks send the prompts, ``requests`` at the same time at most; the server is sent to them with its transport. A prompt that is null gets no
    request and no answer. A failed one gives its error and no answer, and the others go on; a task that is run again asks again. Repeated
    rows are asked each.
    """
    column = "messages" if "messages" in prompts.columns else "prompt"

    def ask(value) -> tuple[str | None, str | None]:
        if value is None:
            return None, None
        try:
            return server.chat(value if isinstance(value, str) else [{"role": m["role"], "content": m["content"]} for m in value]), None
        except Exception as e:  # whatever a server or its connection does concerns this prompt alone
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for begin in range(0, len(b), batch_rows):
                part = b.iloc[begin : begin + batch_rows]
                found = [ask(v) for v in part[column]]
                yield pd.DataFrame({"id": part["id"], "answer": [a for a, _ in found], "error": [e for _, e in found]})

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", column).repartition(requests).mapInPandas(run, f"id {kind}, answer string, error string")


def _records(lines: Iterator[str]) -> Iterator[dict]:
    for line in lines:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict):
            yield record
