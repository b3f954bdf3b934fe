import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import audio


@pytest.mark.parametrize("source, target", [(22_050, 16_000), (8_000, 16_000), (48_000, 16_000), (44_100, 16_000)])
def test_polyphase(source, target):
    x = np.random.default_rng(0).normal(size=700).astype(np.float32)
    got = audio.resample(x, source, target, block=100)
    g = np.gcd(source, target)
    up, down = target // g, source // g
    h, half = audio.filters(up, down), audio.TAPS // 2 - 1
    for m in range(0, len(got), 7):
        at, phase = divmod(m * down, up)
        want = sum(h[phase, k] * x[at + k - half] for k in range(audio.TAPS) if 0 <= at + k - half < len(x))
        assert abs(got[m] - want) < 1e-4
    # a tone below both limits keeps its place and size
    t = np.arange(6_000)
    tone = np.sin(2 * np.pi * 700 * t / source)
    out = audio.resample(tone, source, target)
    want = np.sin(2 * np.pi * 700 * np.arange(len(out)) / target)
    assert np.abs(out - want)[100:-100].max() < 0.05


def test_log_mel():
    y = np.random.default_rng(1).normal(size=2_100).astype(np.float32)
    mels, energy = audio.log_mel(y, block=3)
    assert [len(audio.log_mel(y[:n])[0]) for n in (1, 400, 401, 560, 561, 2_000)] == [1, 1, 2, 2, 3, 11]
    assert len(mels) == len(energy) == 12
    y = np.concatenate([y, np.zeros(60, np.float32)])  # the last 20 samples are in a frame that silence fills up
    for k in (0, 4, len(mels) - 1):
        w = y[k * audio.HOP :][: audio.FRAME] * audio._HANN
        f = np.arange(audio.FFT // 2 + 1)[:, None]
        power = np.abs((w * np.exp(-2j * np.pi * f * np.arange(audio.FRAME) / audio.FFT)).sum(axis=1)) ** 2
        assert np.allclose(mels[k], np.log10(power @ audio.mel_bank()), atol=1e-3)
    assert (audio.mel_bank().sum(axis=0) > 0).all()


def test_hysteresis():
    rng = np.random.default_rng(2)
    for _ in range(50):
        e = rng.normal(-30, 12, rng.integers(1, 80))
        want, on = [], None
        for i, x in enumerate(e):
            if on is None and x >= e.max() - 12:
                on = i
            elif on is not None and x < e.max() - 20:
                want.append((on, i))
                on = None
        if on is not None:
            want.append((on, len(e)))
        assert audio.segments(e) == want


def clip(*parts, rate=22_050):
    """8-bit PCM of (seconds, volume) tones."""
    return b"".join(np.round(128 + 120 * v * np.sin(2 * np.pi * 440 * np.arange(int(s * rate)) / rate)).astype(np.uint8).tobytes() for s, v in parts)


def test_segments_and_spans(spark):
    two = clip((0.5, 0), (0.8, 1), (0.5, 0), (0.4, 1), (0.3, 0))
    rows = [(1, two), (1, two), (2, None), (3, b""), (4, b"x"), (5, b"xy"), (None, clip((0.2, 1))), (6, b"\x80" * 9_000), (7, clip((60, 1)))]
    d = spark.createDataFrame(rows, "media_id bigint, clip binary").withColumn("segment", F.lit(0)).withColumn("id", F.lit(0))
    features = audio.audio_features(d, "media_id", F.col("clip"))
    by = {}
    for r in features.collect():
        by.setdefault(r.id, []).append(r)
        assert len(r.features) == audio.PATCH * audio.MELS and 0 < r.n_frames <= audio.PATCH
    # the few samples of 4 and 5 fall on the window's zeros: silent
    assert set(by) == {1, None, 7}
    starts = sorted({(r.segment, min(x.start_s for x in by[1] if x.segment == r.segment), max(x.end_s for x in by[1] if x.segment == r.segment)) for r in by[1]})
    assert len(starts) == 2
    assert abs(starts[0][1] - 0.5) < 0.04 and abs(starts[0][2] - 1.3) < 0.04 and abs(starts[1][1] - 1.8) < 0.04 and abs(starts[1][2] - 2.2) < 0.04
    assert sum(r.n_frames for r in by[7]) == pytest.approx(6_000, abs=5)
    assert audio.audio_features(d.limit(0), "media_id", F.col("clip")).count() == 0


def test_tensor_storage(spark, tmp_path):
    d = spark.createDataFrame([(i, clip((0.5, 1))) for i in range(5)], "media_id bigint, clip binary")
    features = audio.audio_features(d, "media_id", F.col("clip"))
    table = audio.tensors(features.toArrow())
    kind = table.schema.field("features").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.PATCH, audio.MELS]
    files = audio.write_tensors(features, f"file://{tmp_path}/t").collect()
    stored = pa.concat_tables(pq.read_table(f"{tmp_path}/t/{r.file}") for r in files)
    assert stored.num_rows == sum(r.rows for r in files) == table.num_rows
    assert stored.schema.field("features").type == kind


def test_documents_query(spark, small):
    from palimpsest.llm.queries import op7_audio_features

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {(r.id, r.segment, r.patch): r for r in op7_audio_features(spark, small).collect()}
    want = {(i, f[0], f[1]): f for i, t in texts.items() for f in audio.clip_features(t.encode())}
    assert got.keys() == want.keys()
    for k in list(want)[::20]:
        assert np.allclose(got[k].features, want[k][5].ravel()) and got[k].start_s == want[k][2]
