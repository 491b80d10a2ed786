"""Hooks for models: embedder, extractor and classifier run over Arrow batches; the data work around them is native."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 100) -> DataFrame:
    """``rows`` with an embedding of ``text``, asked for in batches, in order."""
    def run(frames):
        for f in frames:
            out = []
            for i in range(0, len(f), batch):
                out += embedder(f[text].iloc[i : i + batch].fillna("").tolist())
            yield f.assign(embedding=out)

    return rows.mapInPandas(run, rows.drop("embedding").schema.simpleString()[7:-1].replace(":", " ") + ", embedding array<double>")


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in without a model: hashed words, length 1."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def classify(rows: DataFrame, classifier: Callable[[list[dict]], dict], batch: int = 50) -> DataFrame:
    """(entry_id, context_type) by a classifier over batches; a batch that fails is halved until single rows fail alone."""
    def ask(items: list[dict]) -> list[tuple]:
        try:
            found = classifier(items)
            if set(found) == {i["entry_id"] for i in items}:
                return list(found.items())
        except Exception:
            pass
        if len(items) < 2:
            return []
        half = len(items) // 2
        return ask(items[:half]) + ask(items[half:])

    def run(frames):
        for f in frames:
            items = f.to_dict("records")
            rows = [r for i in range(0, len(items), batch) for r in ask(items[i : i + batch])]
            yield pd.DataFrame(rows, columns=["entry_id", "context_type"])

    return rows.mapInPandas(run, f"entry_id {rows.schema['entry_id'].dataType.simpleString()}, context_type string")


def extract(prompts: DataFrame, extractor: Callable[[str], str], parallel: int | None = None) -> DataFrame:
    """``prompts`` (conv_id, prompt) with the model's answer, null where it failed. ``parallel`` bounds how many calls go
    out at once; without it there are as many as tasks that run."""
    def one(p: str):
        try:
            return extractor(p)
        except Exception:
            return None

    def run(frames):
        for f in frames:
            yield f.assign(answer=[one(p) for p in f["prompt"]])

    spread = prompts if parallel is None else prompts.repartition(parallel)
    return spread.mapInPandas(run, "conv_id long, prompt string, answer string".replace("conv_id long", f"conv_id {prompts.schema['conv_id'].dataType.simpleString()}"))
