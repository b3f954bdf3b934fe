"""SimHash near-duplicates, candidates by pigeonring filtering.

A signature has 256 bits over the distinct lower-case words of a text.  It is a
ring of m = 32 segments of 8 bits.  For two signatures within `tau` bits, the
pigeonring principle says that from some start every prefix of the ring, l
segments long, differs in at most l * tau / m bits.  Candidates are rows that
agree in a chain of two consecutive segments, from any of the 32 starts, and in
one of the sixteen segments around it: from each start, one in a million pairs of
strangers is compared.  None within 15 bits can be missed: 17
equal segments or more stand in the ring, so two are neighbours, and sixteen
unequal ones around them would be more than 15 bits.  Beyond, the share found is
measured in the tests.
A candidate goes to the full check only if, from some start, all prefixes up to
CHAIN segments stay within their budgets.

Defined cases: null and empty texts, and texts without a word, have no
signature and are nobody's duplicates; a null doc_id is no duplicate and stays;
equal signatures are duplicates; the least doc_id of a component stays; of rows
that repeat one doc_id, one stays; an empty table gives an empty
one; very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix64, one_per_id, packed, written
from .graph import components

TAU, SEGMENTS, CHAIN = 40, 32, 8
#: Where, from the first of two equal segments, a third is looked for.
NEAR = (*range(-8, 0), *range(2, 10))
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def signatures_of(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, 4) uint64: the majority bits of the 64-bit word hashes of each row; a tie is a 1."""
    n = len(offsets) - 1
    sums = np.zeros((n, 256), np.int32)
    sizes = np.diff(offsets)
    # byte lanes hold sums of at most 255, so rows are added up in blocks of 255 words
    blocks = -(-sizes // 255)
    owner = np.repeat(np.arange(n), blocks)
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = offsets[:-1][owner] + 255 * (np.arange(len(owner)) - first)
    ends = np.minimum(starts + 255, offsets[1:][owner]) if len(owner) else starts
    for at in range(0, len(owner), 256):
        s, e, o = starts[at : at + 256], ends[at : at + 256], owner[at : at + 256]
        bits = mix64(words[s[0] : e[-1], None] * _SALTS[None, :])
        lanes = np.add.reduceat(_SPREAD[bits.view(np.uint8).reshape(-1, 32)], s - s[0], axis=0)
        np.add.at(sums, o, lanes.view(np.uint8).reshape(len(s), 256).astype(np.int32))
    return np.packbits(2 * sums >= sizes[:, None], axis=1).view(np.uint64).reshape(n, 4)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        at = words.offsets.to_numpy().astype(np.int64)
        if not len(words):
            continue
        sig = signatures_of(words.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]], at - at[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())], names=["doc_id", "sig"])


def word_set(text: F.Column) -> F.Column:
    """The hashes of the distinct words of a text; words are runs of letters and digits."""
    return F.transform(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")), lambda w: F.xxhash64(w))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig BINARY of 32 bytes), one row for each row with a doc_id and a word."""
    words = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), word_set(F.col("text")).alias("words"))
    return mapped(words.where(F.size("words") > 0), _sign, "doc_id bigint, sig binary")


def ring_ok(a: np.ndarray, b: np.ndarray, tau: int = TAU, chain: int = CHAIN) -> np.ndarray:
    """Whether, from some start on the ring of byte segments, every prefix up to `chain` segments stays within its share of `tau`."""
    d = np.bitwise_count(a ^ b)
    d = d.view(np.uint8).reshape(len(a), SEGMENTS) if d.dtype.itemsize > 1 else np.bitwise_count(a.view(np.uint8) ^ b.view(np.uint8)).reshape(len(a), SEGMENTS)
    run, ok = np.zeros((len(a), SEGMENTS), np.int16), np.ones((len(a), SEGMENTS), bool)
    for l in range(1, chain + 1):
        run += np.roll(d, 1 - l, axis=1)
        ok &= run * SEGMENTS <= l * tau
    return ok.any(axis=1)


def bucket_edges(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the candidates of each bucket, rows sorted by key; pairs already joined are skipped.

    Within a bucket, for each place near its two equal segments, rows that agree there
    too stand together: row i is held against i + 1, i + 2, ... of its like.
    """
    n = len(key)
    by = np.ascontiguousarray(sig).view(np.uint8).reshape(n, SEGMENTS)
    label = np.arange(n)
    found_a, found_b = [], []
    for place in NEAR:
        third = by[np.arange(n), ((key >> 16) + place) % SEGMENTS]
        order = np.argsort((key << 8) | third, kind="stable")
        group = ((key << 8) | third)[order]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        end = np.repeat(np.append(begin[1:], n), size)
        live = np.flatnonzero(np.repeat(size > 1, size))
        shift = 0
        while True:
            if shift in (0, 8) or shift > 8 and merged:
                # groups that are one component need no further pairs
                own = label[order]
                joined = np.minimum.reduceat(own, begin) == np.maximum.reduceat(own, begin)
                live = live[~np.repeat(joined, size)[live]]
            shift += 1
            live = live[live + shift < end[live]]
            if not len(live):
                break
            merged = False
            for at in range(0, len(live), 50_000):
                i, j = order[live[at : at + 50_000]], order[live[at : at + 50_000] + shift]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    continue
                a, b = sig[i], sig[j]
                ok = ring_ok(a, b, tau)
                i, j, a, b = i[ok], j[ok], a[ok], b[ok]
                ok = np.bitwise_count(a ^ b).sum(axis=1) <= tau
                i, j = i[ok], j[ok]
                if len(i):
                    found_a.append(ids[i])
                    found_b.append(ids[j])
                    merged = True
                    x, y = label[i], label[j]
                    while len(x):
                        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                        while (label[label] != label).any():
                            label = label[label]
                        x, y = label[x], label[y]
                        x, y = x[x != y], y[x != y]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


def _pairs(tau: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a bucket that goes on in the next batch is carried over."""
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 4)
            if carry is not None:
                key, ids, sig = (np.concatenate(x) for x in zip(carry, (key, ids, sig)))
            cut = int(np.searchsorted(key, key[-1]))
            carry = key[cut:], ids[cut:], sig[cut:]
            if cut:
                a, b = bucket_edges(key[:cut], ids[:cut], sig[:cut], tau)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if carry is not None:
            a, b = bucket_edges(*carry, tau)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return kernel


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 rows for each signature: the start on the ring above the two bytes from there."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            raw = batch.column(1).to_pylist()
            by = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SEGMENTS).astype(np.int64)
            key = (np.arange(SEGMENTS)[None, :] << 16) | (by << 8) | np.roll(by, -1, axis=1)
            ids = np.repeat(batch.column(0).to_numpy(), SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids), pa.array([s for s in raw for _ in range(SEGMENTS)], pa.binary())], names=["key", "id", "sig"])


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, kept_id): each document that goes, and the one of its group that stays."""
    sigs = written(signatures(docs), "signatures")
    heads = written(sigs.groupBy("sig").agg(F.min("doc_id").alias("id")), "signature-heads")
    same = sigs.join(heads, "sig").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    keyed = mapped(heads.select("id", "sig"), _keys, "key bigint, id bigint, sig binary")
    near = mapped(keyed.repartition("key").sortWithinPartitions("key"), _pairs(tau), "a bigint, b bigint")
    return components(same.union(near)).select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id")).distinct()


def drop_near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """`docs` without the documents that go; all columns stay as they are."""
    gone = near_duplicates(docs, tau).select(F.col("doc_id").alias("__gone"))
    rows = packed(docs)
    left = rows.join(gone, rows["__doc"] == gone["__gone"], "left_anti")
    return one_per_id(docs, left, lambda c: [F.xxhash64(c("text")), c("text")]).select("__row.*")
