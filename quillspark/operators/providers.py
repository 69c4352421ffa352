"""Model providers over HTTP. A provider is built once a partition from a config that
holds the name of the environment variable of a key, never the key."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


class QuotaExhausted(RuntimeError):
    """The service asks for a longer wait than a job can take."""


@dataclass(frozen=True)
class ProviderConfig:
    """style: ``generate`` (prompt and system fields), ``chat`` (a list of messages) or
    ``parts`` (nested contents). retry: status codes that are tried again."""

    url: str
    model: str
    style: str = "chat"
    key_variable: str | None = None
    timeout_s: float = 300.0
    retries: int = 5
    waits_s: tuple[float, ...] = (5.0, 10.0, 15.0)
    longest_wait_s: float = 60.0
    retry: frozenset = frozenset({413, 429, 503})
    options: dict = field(default_factory=dict)


def resolve_key(given: str | None, variable: str | None, config: dict | None = None) -> str | None:
    """The argument, else the environment's, else the config's; an error if one is
    needed and none is there."""
    if not variable:
        return given
    found = given or os.environ.get(variable) or (config or {}).get(variable)
    if not found:
        raise ValueError(f"no key: set {variable}")
    return found


class HttpProvider:
    def __init__(self, config: ProviderConfig, key: str | None = None, sleep: Callable[[float], None] = time.sleep, opener: Callable = urllib.request.urlopen):
        self.config, self.sleep, self.opener = config, sleep, opener
        self.key = resolve_key(key, config.key_variable)

    def _body(self, prompt: str, system: str, temperature: float, max_tokens: int) -> dict:
        c = self.config
        if c.style == "generate":
            return {"model": c.model, "prompt": prompt, "system": system, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens, **c.options}}
        if c.style == "parts":
            return {"contents": [{"parts": [{"text": prompt}]}], "systemInstruction": {"parts": [{"text": system}]}, "generationConfig": {"temperature": temperature, "maxOutputTokens": max_tokens, **c.options}}
        return {"model": c.model, "messages": [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens, **c.options}

    def _answer(self, got: dict) -> str:
        if self.config.style == "generate":
            return got["response"]
        if self.config.style == "parts":
            return "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"])
        return got["choices"][0]["message"]["content"]

    def generate(self, prompt: str, system: str = "", temperature: float = 0.3, max_tokens: int = 8192) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.config.url, json.dumps(self._body(prompt, system, temperature, max_tokens)).encode(), headers)
        for k in range(self.config.retries + 1):
            try:
                with self.opener(request, timeout=self.config.timeout_s) as got:
                    return self._answer(json.loads(got.read()))
            except urllib.error.HTTPError as e:
                if e.code not in self.config.retry or k == self.config.retries:
                    raise
                asked = e.headers.get("retry-after") if e.headers else None
                wait = float(asked) if asked and asked.replace(".", "", 1).isdigit() else self.config.waits_s[min(k, len(self.config.waits_s) - 1)]
                if wait > self.config.longest_wait_s:
                    raise QuotaExhausted(f"asked to wait {wait:g} s") from e
                self.sleep(wait)
        raise AssertionError

    def get(self, url: str) -> dict:
        with self.opener(urllib.request.Request(url), timeout=self.config.timeout_s) as got:
            return json.loads(got.read())


def available(provider: HttpProvider, url: str) -> bool:
    """Whether the service answers."""
    try:
        provider.get(url)
    except (OSError, ValueError):
        return False
    return True


def list_models(provider: HttpProvider, url: str) -> list[str]:
    got = provider.get(url)
    return sorted(m.get("name") or m.get("id") for m in got.get("models", got.get("data", [])))


def estimate_minutes(n_tokens: int, tokens_per_s: float) -> float:
    return round(n_tokens / tokens_per_s / 60, 1)


def measured_speed(provider, prompt: str = "Count from one to one hundred in words.") -> float:
    """Tokens a second of one request, four characters a token."""
    began = time.monotonic()
    answer = provider.generate(prompt, "", 0.0, 200)
    return len(answer) / 4 / max(time.monotonic() - began, 1e-6)
