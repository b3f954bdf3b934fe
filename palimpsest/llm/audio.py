"""Media columns: audio features as fixed-shape Arrow tensors with time spans.

A clip is headerless unsigned 8-bit mono PCM of `rate` samples a second.  Its
mean is taken off; a polyphase windowed-sinc filter brings it to 16 kHz; frames of
25 ms every 10 ms give 40 log-mel bands; the frames' energy is segmented with
hysteresis: a segment begins at a frame within ON_DB of the loudest and ends
before the first more than OFF_DB below it.  Each segment is cut into tensors of
32 frames by 40 bands; the last is filled up with the floor value.

The test tables have no audio; the registered query reads the UTF-8 bytes of each
document as the samples of a clip at 22,050 Hz.

Defined cases: a null or empty clip has no segment and no row; clips
are filled up with silence to whole frames, one at least; a constant clip is silent and has
no segment; a null id is reported as null; repeated rows are reported once each;
clips are processed whole; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

RATE_IN, RATE = 22_050, 16_000
FRAME, HOP, FFT, MELS, PATCH = 400, 160, 512, 40, 32
TAPS = 16
FLOOR = -10.0
ON_DB, OFF_DB = 12.0, 20.0
SILENT_DB = -100.0


@lru_cache(8)
def filters(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """(up, taps): for each phase the weights of the input samples around the output's place, oldest first."""
    cutoff = min(1.0, up / down)
    phase, k = np.arange(up)[:, None] / up, np.arange(taps)[None, :] - (taps // 2 - 1)
    x = phase - k  # distance in input samples
    h = cutoff * np.sinc(cutoff * x) * np.i0(8.0 * np.sqrt(np.clip(1 - (x / (taps / 2)) ** 2, 0, None))) / np.i0(8.0)
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, source: int, target: int = RATE, block: int = 65_536) -> np.ndarray:
    """Polyphase resampling; output m stands at m * source / target input samples, samples outside are 0."""
    if source == target or not len(x):
        return x.astype(np.float32)
    g = gcd(source, target)
    up, down = target // g, source // g
    h = filters(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS // 2 - 1, np.float32), x.astype(np.float32), np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for a in range(0, n, block):
        at = np.arange(a, min(n, a + block)) * down
        out[a : a + block] = np.einsum("ij,ij->i", windows[at // up], h[at % up])
    return out


@lru_cache(2)
def mel_bank() -> np.ndarray:
    """(FFT / 2 + 1, MELS) triangular filters from 20 Hz to half the rate, on the scale 2595 log10(1 + f / 700)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * RATE / FFT
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(y: np.ndarray, block: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log10 mel power, and each frame's energy in dB."""
    if not len(y):
        return np.zeros((0, MELS), np.float32), np.zeros(0, np.float32)
    # the last frame is filled up with silence, so that every sample is in a frame
    y = np.concatenate([y, np.zeros(max(0, -(-(len(y) - FRAME) // HOP)) * HOP + FRAME - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = [], []
    for a in range(0, len(frames), block):
        w = frames[a : a + block] * _HANN
        spectrum = np.fft.rfft(w, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(np.log10(np.maximum(power.astype(np.float32) @ mel_bank(), 1e-10)))
        energy.append(10 * np.log10(np.maximum((w * w).mean(axis=1), 1e-12)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, on_db: float = ON_DB, off_db: float = OFF_DB) -> list[tuple[int, int]]:
    """(first frame, frame after the last) by hysteresis."""
    if not len(energy) or energy.max() <= SILENT_DB:
        return []
    high, low = energy.max() - on_db, energy.max() - off_db
    mark = np.where(energy >= high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def clip_features(clip: bytes, rate: int = RATE_IN) -> list[tuple[int, int, float, float, int, np.ndarray]]:
    """(segment, patch, start in s, end in s, frames, tensor of PATCH x MELS) of a clip."""
    x = np.frombuffer(clip, np.uint8).astype(np.float32)
    x = (x - x.mean() if len(x) else x) / 128
    mels, energy = log_mel(resample(x, rate))
    out = []
    for s, (a, b) in enumerate(segments(energy)):
        for p, c in enumerate(range(a, b, PATCH)):
            part = mels[c : min(b, c + PATCH)]
            tensor = np.full((PATCH, MELS), FLOOR, np.float32)
            tensor[: len(part)] = part
            out.append((s, p, round(c * HOP / RATE, 4), round(((c + len(part) - 1) * HOP + FRAME) / RATE, 4), len(part), tensor))
    return out


_TENSOR = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [PATCH, MELS], "dim_names": ["frame", "mel"]})}
SCHEMA = (
    T.StructType()
    .add("id", "long")
    .add("segment", "integer")
    .add("patch", "integer")
    .add("start_s", "double")
    .add("end_s", "double")
    .add("n_frames", "integer")
    .add("features", T.ArrayType(T.FloatType(), False), True, _TENSOR)
)


def audio_features(media: DataFrame, key: str, clip: Column, rate: int = RATE_IN) -> DataFrame:
    """(id, segment, patch, start_s, end_s, n_frames, features); `features` has PATCH * MELS values a row, frame by frame, and its field names the tensor's shape."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [(i, *f) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for f in clip_features(c, rate)]
                for a in range(0, len(rows), 1000):
                    columns = list(zip(*rows[a : a + 1000]))
                    values = np.concatenate([t.ravel() for t in columns[6]])
                    tensor = pa.ListArray.from_arrays(pa.array(np.arange(len(columns[0]) + 1, dtype=np.int32) * (PATCH * MELS)), pa.array(values))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:6], (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()))), tensor], names=SCHEMA.names)

    return mapped(media.select(F.col(key).cast("bigint").alias("id"), clip.cast("binary").alias("clip")).where("clip is not null"), kernel, SCHEMA)


def tensors(features: pa.Table) -> pa.Table:
    """The table with `features` as Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS], dim_names=["frame", "mel"])
    at = features.schema.get_field_index("features")
    chunks = [pa.FixedShapeTensorArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(c.flatten().cast(pa.float32()), PATCH * MELS)) for c in features.column(at).chunks]
    return features.set_column(at, pa.field("features", kind), pa.chunked_array(chunks, kind))


def write_tensors(features: DataFrame, uri: str) -> DataFrame:
    """Writes Parquet files with the tensor type to a folder that executors share, and returns (file, rows).

    Each task attempt writes a file of its own name; only those of the attempts that succeeded are in the result, which is to be kept beside the files.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(uri)
        files.create_dir(folder, recursive=True)
        name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = tensors(pa.Table.from_batches([batch]))
            writer = writer or pq.ParquetWriter(os.path.join(folder, name), t.schema, filesystem=files)
            writer.write_table(t)
            rows += t.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "rows"])

    return mapped(features, kernel, "file string, rows bigint")
