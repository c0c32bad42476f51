"""Remote texts and model services, over plain HTTP. The transport is a parameter, so tests and other clients can replace it."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.request import Request, urlopen

Transport = Callable[[str, bytes | None, dict[str, str], float], bytes]

#: Encodings in the order they are tried.
ENCODINGS = ("utf-8", "latin-1", "ascii", "utf-16")


def http(url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> bytes:
    with urlopen(Request(url, data=body, headers=headers), timeout=timeout) as answer:  # noqa: S310 - the caller names the service
        return answer.read()


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("the content is no text")


def download(url: str, timeout: float = 30, transport: Transport = http) -> str:
    return decode(transport(url, None, {}, timeout))


@dataclass
class ChatService:
    """A provider for services that take {model, messages} and answer {choices: [{message: {content}}]}; prompts go out on
    up to `workers` threads and answers keep their order."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    system: str | None = None
    options: dict = field(default_factory=dict)
    workers: int = 10
    timeout: float = 120
    transport: Transport = http

    def _one(self, prompt: str) -> str:
        said = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": said, **self.options}).encode()
        return json.loads(self.transport(self.url, body, {"Content-Type": "application/json", **self.headers}, self.timeout))["choices"][0]["message"]["content"]

    def infer(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(max(1, min(self.workers, len(prompts)))) as pool:
            return list(pool.map(self._one, prompts))


@dataclass
class GenerateService:
    """A provider for services that take one {model, prompt} at a time and answer {response}."""

    url: str
    model: str
    options: dict = field(default_factory=dict)
    timeout: float = 120
    transport: Transport = http

    def infer(self, prompts: list[str]) -> list[str]:
        bodies = (json.dumps({"model": self.model, "prompt": p, "stream": False, "options": self.options}).encode() for p in prompts)
        return [json.loads(self.transport(self.url, b, {"Content-Type": "application/json"}, self.timeout))["response"] for b in bodies]


@dataclass
class JobService:
    """A provider that hands many prompts in as jobs of at most `size`, waits for each and puts answers back by key.

    submit(rows) gives a job's name; state(name) one of "running", "done", "failed"; results(name) {key: answer}. A prompt
    without an answer gets an empty one, which the parser then reports."""

    submit: Callable[[list[dict]], str]
    state: Callable[[str], str]
    results: Callable[[str], dict[str, str]]
    wait: Callable[[float], None]
    size: int = 20_000
    poll: float = 30
    timeout: float = 3600

    def infer(self, prompts: list[str]) -> list[str]:
        rows = [{"key": f"idx-{k}", "prompt": p} for k, p in enumerate(prompts)]
        jobs, answers = [self.submit(rows[k : k + self.size]) for k in range(0, len(rows), self.size)], {}
        for job in jobs:
            waited = 0.0
            while (now := self.state(job)) == "running":
                if waited >= self.timeout:
                    raise TimeoutError(job)
                self.wait(self.poll)
                waited += self.poll
            if now != "done":
                raise RuntimeError(f"{job}: {now}")
            answers |= self.results(job)
        return [answers.get(r["key"], "") for r in rows]
