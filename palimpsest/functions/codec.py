"""Compression of embeddings: quantising, delta and run-length codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp
from .vectors import once


def quantise(a: Column) -> Column:
    """STRUCT<data ARRAY<TINYINT>, scale, zero_point>: from least to greatest value in 255 steps."""
    d = a.cast("array<double>")
    span = F.array_max(d) - F.array_min(d)
    limits = F.struct(F.array_min(d).alias("low"), F.when(span == 0, F.lit(1.0)).otherwise(span / 255.0).alias("scale"))
    step = lambda q: lambda x: clamp(F.round((x - q["low"]) / q["scale"]) - 128, -128.0, 127.0).cast("tinyint")
    return once(limits, lambda q: F.struct(F.transform(d, step(q)).alias("data"), q["scale"].alias("scale"), q["low"].alias("zero_point")))


def restore(q: Column) -> Column:
    return once(q, lambda s: F.transform(s["data"], lambda x: (x.cast("double") + 128) * s["scale"] + s["zero_point"]))


def _per_row(f, kind: str):
    """A pandas UDF of a function of one value; nulls stay."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(each, kind)


def _bytes(x) -> np.ndarray:
    return np.asarray(x, np.int64).astype(np.int8)


def delta(a: Column) -> Column:
    """Differences of neighbours, wrapped to a byte; the first value stays."""
    return _per_row(lambda x: np.diff(_bytes(x), prepend=np.int8(0)).astype(np.int8), "array<tinyint>")(a)


def undelta(a: Column) -> Column:
    return _per_row(lambda x: np.cumsum(_bytes(x), dtype=np.int8), "array<tinyint>")(a)


def compress(a: Column) -> Column:
    """The quantised vector with delta-coded data."""

    def each(v: pd.Series) -> pd.DataFrame:
        rows = []
        for x in v:
            if x is None or not len(x):
                rows.append((None, None, None))
                continue
            x = np.asarray(x, float)
            low, span = x.min(), x.max() - x.min()
            scale = span / 255.0 if span else 1.0
            q = np.clip(np.floor((x - low) / scale + 0.5) - 128, -128, 127)
            rows.append((np.diff(_bytes(q), prepend=np.int8(0)).astype(np.int8), scale, low))
        return pd.DataFrame(rows, columns=["data", "scale", "zero_point"])

    return F.pandas_udf(each, "data array<tinyint>, scale double, zero_point double")(a)


def decompress(c: Column) -> Column:
    def each(data: pd.Series, scale: pd.Series, zero: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else (np.cumsum(_bytes(d), dtype=np.int8).astype(float) + 128) * s + z for d, s, z in zip(data, scale, zero)], dtype=object)

    return F.pandas_udf(each, "array<double>")(c["data"], c["scale"], c["zero_point"])


def sizes(a: Column) -> tuple[Column, Column]:
    """Bytes of a vector of 4-byte numbers, and compressed."""
    return F.size(a) * 4, F.size(a) + 8


def _encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n = np.diff(np.append(start, len(a)))
    # a run's pieces of 255 bytes at most
    pieces = -(-n // 255)
    value = np.repeat(a[start], pieces)
    last = np.cumsum(pieces) - 1
    size = np.full(len(value), 255)
    size[last] = n - 255 * (pieces - 1)
    coded, marks = size >= 4, (size < 4) & (value == 255)
    width = np.where(coded, 3, np.where(marks, 3 * size, size))
    out = np.repeat(value, width)
    at = np.cumsum(width) - width
    out[at[coded]] = 255
    out[at[coded] + 1] = size[coded]
    for k in range(3):  # FF 01 FF for each single FF
        own = at[marks & (size > k)] + 3 * k
        out[own + 1] = 1
    return out.tobytes()


def _decode(data: bytes) -> bytes:
    parts, at = [], 0
    while True:
        mark = data.find(b"\xff", at)
        if mark < 0 or mark + 2 >= len(data):
            return b"".join([*parts, data[at:]])
        parts += data[at:mark], data[mark + 2 : mark + 3] * data[mark + 1]
        at = mark + 3


def rle(data: Column) -> Column:
    """Runs of four bytes or more, and single bytes FF, as FF, length, byte."""
    return _per_row(lambda x: _encode(bytes(x)), "binary")(data)


def unrle(data: Column) -> Column:
    return _per_row(lambda x: _decode(bytes(x)), "binary")(data)
