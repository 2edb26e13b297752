"""Models behind HTTP, as injectable clients. Offline the engine takes decisions and vectors from tables instead."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Chat:
    """A chat endpoint: ``shape`` makes the request's body of a prompt, ``read`` the text of the reply's body."""

    url: str
    shape: Callable[[str, str], dict]
    read: Callable[[dict], str]
    headers: tuple[tuple[str, str], ...] = ()
    timeout: float = 180.0
    attempts: int = 3
    pause: float = 0.2

    def generate(self, system_prompt: str, user_prompt: str) -> str:
        body = json.dumps(self.shape(system_prompt, user_prompt)).encode()
        for left in range(self.attempts - 1, -1, -1):
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **dict(self.headers)})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return self.read(json.load(reply))
            except (OSError, ValueError, KeyError):
                if not left:
                    raise
                time.sleep(self.pause)
        raise AssertionError


def local_chat(url: str, model: str, schema: dict | None = None) -> Chat:
    """A local server's generate call, held to a JSON schema if one is given."""
    return Chat(url, lambda s, u: {"model": model, "system": s, "prompt": u, "stream": False, "think": False} | ({"format": schema} if schema else {}), lambda r: r["response"])


def hosted_chat(url: str, model: str, key: str, temperature: float = 0.1, max_tokens: int = 1200) -> Chat:
    """The common chat-completions call; the key travels in a header."""
    shape = lambda s, u: {"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "system", "content": s}, {"role": "user", "content": u}]}
    return Chat(url, shape, lambda r: r["choices"][0]["message"]["content"], (("Authorization", f"Bearer {key}"),))


def content_chat(url: str, key: str, temperature: float = 0.1, max_tokens: int = 1200) -> Chat:
    """The generate-content form: parts within contents, instructions apart; the key travels in a header."""
    part = lambda t: {"parts": [{"text": t}]}
    shape = lambda s, u: {"systemInstruction": part(s), "contents": [{"role": "user", **part(u)}], "generationConfig": {"temperature": temperature, "maxOutputTokens": max_tokens}}
    return Chat(url, shape, lambda r: "".join(p.get("text", "") for p in r["candidates"][0]["content"]["parts"]), (("x-goog-api-key", key),))


@dataclass(frozen=True)
class Embedder:
    """An endpoint that embeds texts, a list at a time."""

    url: str
    model: str
    timeout: float = 180.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            found = json.load(reply)["embeddings"]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found


def embedded(rows: DataFrame, client, text: str = "text", batch: int = 16) -> DataFrame:
    """``rows`` with embedding: ``client.embed`` is asked for ``batch`` texts at a time; a failed call leaves nulls."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for at in range(0, len(pdf), batch):
                texts = [t or "" for t in pdf[text].iloc[at : at + batch]]
                try:
                    out += client.embed(texts)
                except (OSError, ValueError, KeyError):
                    out += [None] * len(texts)
            yield pdf.assign(embedding=out)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(ask, f"{columns}, embedding array<double>")


def replies(prompts: DataFrame, client, fallback: str | None = None, fallback_column: str | None = None) -> DataFrame:
    """prompts (id, system_prompt, user_prompt) with reply and error; a failed call gives the row's ``fallback_column`` (an extractive
    answer, say), or ``fallback``, or null, and the error's text."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            instead = pdf[fallback_column] if fallback_column else [fallback] * len(pdf)
            for s, u, other in zip(pdf["system_prompt"], pdf["user_prompt"], instead):
                try:
                    out.append((client.generate(s or "", u or ""), None))
                except Exception as e:  # noqa: BLE001 - whatever a client raises belongs to its row
                    out.append((other, f"{type(e).__name__}: {e}"))
            yield pdf.assign(reply=[x for x, _ in out], error=[e for _, e in out])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(ask, f"{columns}, reply string, error string")
