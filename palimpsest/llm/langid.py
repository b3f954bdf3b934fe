"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3, lower case) are hashed into 2^15 buckets; document
frequencies count all documents.  The model is fitted on the driver to a bounded
sample of labelled rows, at most SAMPLE of each language, by
follow-the-regularised-leader (FTRL-Proximal) with elastic-net penalties, and its
temperature is set on a fifth of that sample which the fit doesn't see.

Defined cases: null and empty texts have no language and no confidence; a null
label is no training row; with no labelled row every language is null, with one
language every text has it with confidence 1; ties go to the language first in
order; rows are returned once each, repeated ones and those with a null doc_id
too; texts count whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

BITS, ORDERS = 15, 3
SAMPLE, EPOCHS = 400, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, in order, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    found = []
    for n in range(1, ORDERS + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)
        found.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)).astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount(np.concatenate(found), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of unit length."""
    at, counts = ngrams(text)
    x = counts * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, np.int64)
    for batch in slices(batches, "text"):
        for text in batch.column(0).to_pylist():
            df[ngrams(text)[0]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "df"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each bucket over all texts; the driver gets one number a bucket."""
    texts = docs.select("text").where("text is not null and text <> ''")
    rows = mapped(texts, _frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    n = texts.count()
    df = np.zeros(1 << BITS)
    for r in rows:
        df[r["bucket"]] = r["df"]
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def sample_of(docs: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of at most `most` labelled rows of each language, those of the least hashes of doc_id."""
    labelled = docs.where("lang is not null and text is not null and text <> '' and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a bound on the hash leaves about twice the rows that are wanted, so that the order below is of few
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * most + 50) / n) * 2.0**31)])
    h = F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1)
    few = labelled.select("lang", "text", h.alias("h"), "doc_id").where(F.col("h") < bound[F.col("lang")])
    best = few.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "doc_id", "text"))), 1, most).alias("r"))
    return [(r["lang"], x["text"]) for r in best.orderBy("lang").collect() for x in r["r"]]


def fit(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 0) -> Model:
    languages = sorted({k for k, _ in rows})
    k = len(languages)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def bias(zb, nb):  # not penalised
        return -zb / ((beta + np.sqrt(nb)) / alpha)

    if k > 1:
        data = [(languages.index(lang), *weighted(text, idf)) for lang, text in rows]
        order = np.random.default_rng(seed).permutation(len(data))
        cut = max(1, len(data) // 5) if len(data) >= 10 else 0
        held, train = order[:cut], order[cut:]
        for epoch in range(epochs):
            for i in np.random.default_rng(seed + 1 + epoch).permutation(train):
                y, at, x = data[i]
                w, b = weights(z[at], n[at]), bias(zb, nb)
                g0 = softmax(x @ w + b)
                g0[y] -= 1.0
                g = x[:, None] * g0[None, :]
                old = n[at]
                new = old + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
                n[at] = new
                zb += g0 - (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / alpha * b
                nb += g0 * g0
    w, b, t = weights(z, n), bias(zb, nb), 1.0
    if k > 1 and len(held):
        scores = np.array([data[i][2] @ w[data[i][1]] + b for i in held])
        truth = np.array([data[i][0] for i in held])

        def loss(log_t: float) -> float:
            return -np.log(softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth] + 1e-300).mean()

        low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
        for _ in range(60):  # golden section
            a, c = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, c) if loss(a) <= loss(c) else (a, high)
        t = float(np.exp((low + high) / 2))
    return Model(languages, idf, w.astype(np.float32), b, t)


def predict(text: str | None, model: Model) -> tuple[str | None, float | None]:
    if not text or not model.languages:
        return None, None
    at, x = weighted(text, model.idf)
    p = softmax((x @ model.weights[at] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], round(float(p[best]), 6)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(sample_of(docs, sample), inverse_frequencies(docs))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, confidence) for every row, by `model` or by one fitted to the labels of `docs`."""
    model = model or train(docs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [predict(text, model) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang", "confidence"])

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), kernel, "doc_id bigint, lang string, confidence double")
