"""Inference tasks as Arrow-batched functions: a model is loaded once per worker and sees batches.

A task has a result type; a model is any class with ``load()`` and ``predict(list) -> list``. Models
are registered by task and name. Those that come with the library are deterministic stand-ins without
weights, so that pipelines can be built and tested offline.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>"
SEGMENTS = "array<struct<text:string,start_time:double,end_time:double>>"
#: Result type of every task.
TASKS = {
    "audio-text-alignment": SEGMENTS, "chat-completion": "string", "face-detection": BOXES, "face-embedding": "array<double>", "face-swap": "binary", "face-tracking": BOXES,
    "image-background-removal": "binary", "image-embedding": "array<double>", "image-generation": "binary", "image-segmentation": "array<binary>", "image-text-to-text": "string", "image-to-text": "string",
    "image-to-video": "binary", "image-upscale": "binary", "music-generation": "binary", "music-source-separation": "array<binary>", "object-detection": BOXES, "pose-detection": "array<array<double>>",
    "pose-tracking": "array<array<double>>", "speaker-diarization": "array<struct<speaker:string,start_time:double,end_time:double>>", "speech-to-text": SEGMENTS,
    "text-classification": "struct<label:string,score:double>", "text-embedding": "array<double>", "text-generation": "string", "text-reranking": "double", "text-to-speech": "binary", "text-to-text": "string",
    "text-to-video": "binary", "voice-activity-detection": "array<double>",
}
MODELS: dict[tuple[str, str], Callable[[], Any]] = {}


def model(task: str, name: str):
    """Registers a model class of a task."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")

    def add(cls):
        MODELS[task, name] = cls
        return cls

    return add


def infer(task: str, name: str, value: Column, batch: int = 256) -> Column:
    """The model's result for every value; null for null. Values go to it in batches."""
    if (task, name) not in MODELS:
        raise ValueError(f"no model {name!r} of {task!r} is registered")
    make, kind = MODELS[task, name], TASKS[task]

    def results(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = make()
        ready.load()
        for part in parts:
            known = part.dropna()
            found: list[Any] = []
            for a in range(0, len(known), batch):
                found += ready.predict(known.iloc[a : a + batch].tolist())
            out = pd.Series(found, index=known.index, dtype=object).reindex(part.index)
            yield out.where(out.notna(), None)

    if kind.startswith("struct<"):

        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for out in results(parts):
                # object columns: a batch of nulls alone has a type, too
                yield pd.DataFrame({f: pd.Series([None if x is None else x.get(f) for x in out], index=out.index, dtype=object) for f in _fields(kind)})

        return F.when(value.isNotNull(), run(value))

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from results(parts)

    return run(value)


def _fields(kind: str) -> list[str]:
    return [x.split(":")[0] for x in kind[7:-1].split(",")]


def _hashed(text: str) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") for w in re.findall(r"\w+", text.lower())]


@model("text-embedding", "hashing")
class HashingEmbedding:
    """Signed word counts in 64 dimensions, at length 1."""

    def load(self) -> None:
        self.size = 64

    def predict(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for h in _hashed(t):
                v[h % self.size] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


@model("text-classification", "length")
class LengthClassifier:
    """Calls texts short or long, the surer the further from 100 words."""

    def load(self) -> None:
        self.cut = 100

    def predict(self, texts: list[str]) -> list[dict[str, Any]]:
        out = []
        for t in texts:
            p = 1 / (1 + math.exp((self.cut - len(t.split())) / 25)) if len(t.split()) < 10_000 else 1.0
            out.append({"label": "long" if p >= 0.5 else "short", "score": max(p, 1 - p)})
        return out


@model("text-to-text", "upper")
class UpperCase:
    """The text in capitals."""

    def load(self) -> None: ...

    def predict(self, texts: list[str]) -> list[str]:
        return [t.upper() for t in texts]
