"""Boundaries to models: a model is a function over lists, and becomes a Column function or an embedder of DataFrames.

What a model answers is the caller's; a remote one is asked in batches from the
tasks, so that requests are as many as batches and no text goes by the driver.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vectors = Sequence[Sequence[float]] | np.ndarray


class Images(Protocol):
    """A model of images and texts in one space."""

    dim: int

    def images(self, paths: list[str]) -> Vectors: ...

    def texts(self, texts: list[str]) -> Vectors: ...


def _unit(rows: Vectors, dim: int) -> list[list[float]]:
    x = np.asarray(rows, float).reshape(-1, dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0).tolist()


def vectors(f: Callable[[list[str]], Vectors], dim: int) -> Callable[[Column], Column]:
    """A Column function of unit vectors; nulls stay null and don't reach the model."""

    @F.pandas_udf("array<double>")
    def embed(s):
        import pandas as pd

        have = s.notna()
        own = s[have].tolist()
        got = iter(_unit(f(own), dim)) if own else iter(())
        return pd.Series([next(got) if h else None for h in have])

    return embed


def captions(f: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A Column function of descriptions, of paths for instance."""

    @F.pandas_udf("string")
    def describe(s):
        import pandas as pd

        have = s.notna()
        own = s[have].tolist()
        got = iter(f(own)) if own else iter(())
        return pd.Series([next(got) if h else None for h in have], dtype=object)

    return describe


def of_images(model: Images) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions of a model's images and texts."""
    return vectors(model.images, model.dim), vectors(model.texts, model.dim)


def similarity(a: Sequence[float], b: Sequence[float]) -> float:
    """Of two unit vectors."""
    return float(np.dot(a, b)) if len(a) == len(b) else 0.0


def asked(url: str, body: dict, timeout: float = 30.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def reachable(url: str, timeout: float = 5.0) -> bool:
    try:
        with urllib.request.urlopen(f"{url}/health", timeout=timeout) as answer:
            return answer.status == 200
    except OSError:
        return False


def remote(url: str, dim: int, rows: int = 64, timeout: float = 30.0) -> Callable[[DataFrame], DataFrame]:
    """An embedder of (id, content) by a service at `url`/embed, which gets {"texts": [...]} and answers {"dense": [[...]]}; texts of a request that fails have zeros."""

    def batch(texts: list[str]) -> list[list[float]]:
        try:
            got = asked(f"{url}/embed", {"texts": texts, "return_sparse": False, "return_colbert": False}, timeout)["dense"]
            out = [[float(x) for x in v] for v in got]
            return out if len(out) == len(texts) and all(len(v) == dim for v in out) else [[0.0] * dim for _ in texts]
        except (OSError, KeyError, TypeError, ValueError):
            return [[0.0] * dim for _ in texts]

    def embed(m: DataFrame) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(batch(b.column(1).to_pylist()), pa.list_(pa.float64()))], names=["id", "embedding"])

        return m.select("id", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(kernel, f"id {dict(m.dtypes)['id']}, embedding array<double>")

    return embed
