"""Model calls behind an interface, with a deterministic local stand-in.

A chat provider maps a prompt to a reply, an embedding provider a list of texts to
vectors. ``ask`` and ``embed_texts`` run them on the executors in batches, retry,
and give null (or raise) when a call keeps failing. ``LocalChat`` needs no network.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.replies import NO_ANSWER

BATCH = 64
ATTEMPTS = 4


#: what a model is told for each task; the parsers of ``functions.replies`` read what is asked for here
INSTRUCTIONS = {
    "answer": "Answer the question from the numbered passages below and from nothing else. Name the passages that you use by their numbers in "
    f"square brackets. Keep to the question's language. If the passages do not hold the answer, reply with this sentence alone: {NO_ANSWER}",
    "closed_book": "Answer the question briefly, in its language, from what you know.",
    "grade": "Grade how well the passage answers the question, from 0 (not at all) to 10 (fully). Reply with the number alone.",
    "listwise": "Order the passages by how well each answers the question, best first. Reply with their numbers alone, separated by commas.",
    "relevant": 'Does the passage help to answer the question? Reply with JSON alone: {"relevante": true} or {"relevante": false}.',
    "retrieve": "Does answering the message take a look into the documents (facts, figures, definitions), or is it small talk or common knowledge? "
    'Reply with JSON alone: {"recuperar": true or false, "motivo": "a few words"}.',
    "critique": "Judge the answer by the context. Reply with JSON alone, with the keys suporte (fully, partially or no_support: is what it claims "
    "held by the context?), utilidade (1 to 5: how useful is it for the question?), afirmacoes_sem_respaldo (a list of its claims "
    "that the context does not hold) and comentario (one sentence on why).",
    "multi_query": "Write the question in other words, with other terms for the same need, one version a line, nothing else.",
    "step_back": "Write one more general question whose answer gives the background of this one. Reply with that question alone.",
    "decompose": "Split the question into simpler ones that can each be looked up alone, one a line, nothing else. A question that is "
    "simple already stays as it is.",
    "hypothesis": "Write the text that is asked for as if it came from a document; do not say that it is made up.",
    "summary": "Summarise the passages as one text that keeps names, figures and definitions. Add nothing that they do not say.",
}


def messages(task: str, prompt: str) -> list[dict[str, str]]:
    """The instruction of a task, and the parts of a prompt under their names.

    An answer without passages is a closed-book one.
    """
    first, _, rest = prompt.partition("\x1e")
    if task == "answer" and not rest:
        task = "closed_book"
    if task == "listwise":
        rest = "\n\n".join(f"[{i}] {p}" for i, p in enumerate(rest.split("\x1d"), 1))
    name = {"critique": "Answer", "retrieve": "Message"}.get(task, "Question")
    parts = [f"{name}: {first}" if first else "", rest]
    return [
        {"role": "system", "content": INSTRUCTIONS[task]},
        {"role": "user", "content": "\n\n".join(x for x in parts if x)},
    ]


class ChatProvider(Protocol):
    def reply(self, task: str, prompt: str, temperature: float, max_tokens: int) -> str: ...


class EmbeddingProvider(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class LocalChat:
    """Replies that follow from the prompt alone: word overlap stands in for judgement."""

    def reply(self, task: str, prompt: str, temperature: float = 0.0, max_tokens: int = 100) -> str:
        question, _, rest = prompt.partition("\x1e")
        asked = set(re.findall(r"\w+", question.lower()))
        share = lambda t: len(asked & set(re.findall(r"\w+", t.lower()))) / max(1, len(asked))
        if task == "grade":
            return f"{min(10, round(10 * share(rest)))}"
        if task == "listwise":
            parts = rest.split("\x1d")
            return ",".join(str(i + 1) for i in sorted(range(len(parts)), key=lambda i: (-share(parts[i]), i)))
        if task == "relevant":
            return json.dumps({"relevante": share(rest) >= 0.2})
        if task == "retrieve":
            return json.dumps({"recuperar": bool(asked), "motivo": "local"})
        if task == "critique":
            level = "fully" if share(rest) >= 0.5 else "partially"
            return json.dumps({"suporte": level, "utilidade": 4 if level == "fully" else 3, "afirmacoes_sem_respaldo": []})
        if task in ("multi_query", "step_back", "decompose"):
            words = question.split()
            return "\n".join(f"{i + 1}. {' '.join(words[i:] + words[:i])}" for i in range(1, min(5, len(words))))
        if task == "hypothesis":
            return f"{question} {hashlib.md5(question.encode()).hexdigest()[:4]}"
        if task == "summary":
            return rest[: 2 * max_tokens]
        return f"{(rest or question)[:max_tokens]}"


@lru_cache(maxsize=8)
def _client(make: Callable, key: str, base_url: str | None):
    return make(api_key=key, base_url=base_url)


def gateway(key_variable: str, base_url: str | None):
    """The client of a gateway, one a process: its connections serve all calls of a worker."""
    if not os.environ.get(key_variable):
        raise RuntimeError(f"set {key_variable} to use a remote model")
    from openai import OpenAI

    return _client(OpenAI, os.environ[key_variable], base_url)


@dataclass(frozen=True)
class OpenAICompatibleChat:
    """Chat over an OpenAI-compatible gateway; needs the ``openai`` package and a key."""

    model: str
    base_url: str | None = None
    key_variable: str = "OPENAI_API_KEY"

    def reply(self, task: str, prompt: str, temperature: float, max_tokens: int) -> str:
        client = gateway(self.key_variable, self.base_url)
        out = client.chat.completions.create(
            model=self.model, messages=messages(task, prompt), temperature=temperature, max_tokens=max_tokens
        )
        return (out.choices[0].message.content or "").strip()


@dataclass(frozen=True)
class OpenAICompatibleEmbedder:
    model: str
    base_url: str | None = None
    key_variable: str = "OPENAI_API_KEY"

    @property
    def name(self) -> str:
        return self.model

    def embed(self, texts: list[str]) -> list[list[float]]:
        client = gateway(self.key_variable, self.base_url)
        data = client.embeddings.create(model=self.model, input=texts).data
        return [x.embedding for x in sorted(data, key=lambda x: x.index)]


def ask(provider: ChatProvider, task: str, prompt: Column, temperature: float = 0.0, max_tokens: int = 100) -> Column:
    """The reply to each prompt; null for a null prompt and for a call that fails."""

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            try:
                return provider.reply(task, p, temperature, max_tokens)
            except Exception:
                return None

        return prompts.map(one)

    return call(prompt)


def with_retries(call: Callable[[], list], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> list:
    """The call's result, tried again after 1, 2, 4, ... seconds; RuntimeError at the end."""
    for turn in range(attempts):
        try:
            return call()
        except Exception as error:
            if turn == attempts - 1:
                raise RuntimeError(f"embedding failed after {attempts} attempts") from error
            wait(2.0**turn)
    return []


def embed_batches(provider: EmbeddingProvider, texts: list[str], batch: int = BATCH, attempts: int = ATTEMPTS, wait=time.sleep) -> list[list[float]]:
    """Vectors in the order of the texts; blank texts are sent as one space."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = [t if t.strip() else " " for t in texts[i : i + batch]]
        out += with_retries(lambda p=part: provider.embed(p), attempts, wait)
    return out


def embed_texts(df: DataFrame, provider: EmbeddingProvider, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, embedding) by a remote embedder, in batches inside each task."""
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed_batches(provider, frame["text"].fillna("").tolist())
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, embedding array<double>")
