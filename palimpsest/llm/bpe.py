"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 32 bytes cuts texts where its low bits are zero, so that
passages shared by documents fall into equal chunks wherever they stand.  A
chunk that occurs more than once in the corpus is encoded once; the parts of a
text between such chunks are encoded as they are.  Tokens beside a join depend
on both sides, so each join is repaired: a window around it is encoded again,
and grows until its borders agree with token borders of both sides at places
where every split of the text has a border (a graphic ASCII character before
ASCII white space).  The result equals that of encoding the whole text.

The vocabulary is a file of ranks in the format of the tiktoken library, which
does the merging; its path is a parameter.

Defined cases: a null text has null tokens, an empty one an empty list; rows
with a null doc_id, repeated rows and repeated ids are each returned; texts are
encoded whole, however long; texts that look like special tokens are ordinary;
an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, utf8, written

#: The public byte-level ranks where they are installed; each executor needs the file at the path that is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MASK = 32, (1 << 10) - 1
#: Bytes that are hashed at once.
BLOCK = 1 << 17
#: Up to so many leading chunks, their places are broadcast (12 bytes each); beyond, texts are joined to them by key.
BROADCAST_CHUNKS = 1_000_000
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Between these two bytes every split has a border: no piece goes from a visible character on to white space.
_SYNC = re.compile(rb"[\x21-\x7e][ \n\t\r]")


@lru_cache(2)
def vocabulary(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder, and the bytes of each token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), by_id


def _roll(data: np.ndarray, skip: int) -> np.ndarray:
    """The places after the first `skip` bytes behind which the hash of the last WINDOW bytes has its low bits zero."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    at = np.flatnonzero((h & np.uint32(MASK << 16)) == 0) + 1
    return at[at > skip]


def cuts(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends within each of the texts that `borders` mark in `data`, and the text of each; an end is moved on to a character's first byte."""
    at = np.concatenate([_roll(data[max(0, a - WINDOW) : a + BLOCK], min(a, WINDOW)) + max(0, a - WINDOW) for a in range(0, len(data), BLOCK)]) if len(data) else np.zeros(0, np.int64)
    for _ in range(3):
        inside = at < len(data)
        at[inside] += (data[at[inside]] & 0xC0) == 0x80
    at = np.unique(at)
    owner = np.searchsorted(borders, at, side="right") - 1
    owner = np.minimum(owner, len(borders) - 2)
    ok = (at - borders[owner] >= WINDOW) & (at < borders[owner + 1])
    return at[ok], owner[ok]


def chunks(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all chunks of all texts, each text's last end with it, and the text of each chunk; empty texts have none."""
    at, owner = cuts(data, borders)
    full = np.nonzero(np.diff(borders) > 0)[0]
    ends = np.concatenate([at, borders[full + 1]])
    who = np.concatenate([owner, full])
    order = np.lexsort((ends, who))
    return ends[order], who[order]


def _starts(ends: np.ndarray, who: np.ndarray, borders: np.ndarray) -> np.ndarray:
    starts = np.empty_like(ends)
    if len(ends):
        starts[1:] = ends[:-1]
        first = np.ones(len(ends), bool)
        first[1:] = who[1:] != who[:-1]
        starts[first] = borders[who[first]]
    return starts


def _tail(ids: np.ndarray, sizes: np.ndarray, n: int) -> int | None:
    """How many tokens stay when the last n bytes go; None if no token ends there."""
    if n == 0:
        return len(ids)
    k = len(ids)
    while n > 0 and k:
        k -= 1
        n -= sizes[ids[k]]
    return k if n == 0 else None


def _head(ids: np.ndarray, sizes: np.ndarray, n: int) -> int | None:
    """How many tokens go with the first n bytes; None if no token ends there."""
    k = 0
    while n > 0 and k < len(ids):
        n -= sizes[ids[k]]
        k += 1
    return k if n == 0 else None


def _sync_before(data: bytes, at: int, low: int) -> int:
    """The last border of every split before `at` and above `low`, else `low`."""
    width = 64
    while True:
        start = max(low, at - width)
        last = None
        for last in _SYNC.finditer(data, start, at):  # noqa: B007
            pass
        if last is not None:
            return last.start() + 1
        if start == low:
            return low
        width *= 8


def join(data: bytes, parts: list[tuple[int, int, np.ndarray]], encode, sizes: np.ndarray) -> np.ndarray:
    """The tokens of `data` from those of its parts (start, end, ids), each encoded alone."""
    if not parts:
        return np.zeros(0, np.int32)
    done: list[np.ndarray] = []
    _, end, ids = parts[0]
    low = 0  # tokens before it are settled and stand in `done`; `ids` are those from there to `end`
    for k, (start, stop, right) in enumerate(parts[1:], 1):
        m = _SYNC.search(data, max(low, end - 1))
        again = m.start() + 1 if m else len(data)
        if again == end:
            done.append(ids)
            low, ids, end = end, right, stop
            continue
        left = _sync_before(data, end, low)
        keep = _tail(ids, sizes, end - left)
        while keep is None:  # no agreement on the left: the window grows
            left = _sync_before(data, left - 1, low) if left > low else low
            keep = _tail(ids, sizes, end - left)
        while True:
            skip = _head(right, sizes, again - end) if again <= stop else None
            if again >= stop or skip is not None:
                break
            m = _SYNC.search(data, again)  # no agreement on the right: the window grows
            again = min(m.start() + 1 if m else len(data), len(data))
        done.append(ids[:keep])
        if again < stop:
            done.append(encode(data[left:again]))
            low, ids, end = again, right[skip:], stop
        else:  # the right part has no settled border: it is encoded with what precedes it
            low, ids, end = left, encode(data[left:stop]), stop
    return np.concatenate([*done, ids])


def _digest(chunk: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(chunk)
    return x - (1 << 64) if x >> 63 else x


def _encoder(path: str):
    enc, by_id = vocabulary(path)
    sizes = np.array([len(t) for t in by_id], np.int64)
    return (lambda b: np.array(enc.encode_ordinary(b.decode()), np.int32)), sizes, by_id


def _width(by_id: list[bytes]) -> str:
    return "<u2" if len(by_id) <= 1 << 16 else "<u4"


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, key, no) of every chunk."""
    for batch in slices(batches, "text"):
        data, borders = utf8(batch.column(1))
        ends, who = chunks(data, borders)
        starts = _starts(ends, who, borders)
        raw = data.tobytes()
        digest = [_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        no = np.arange(len(who)) - np.searchsorted(who, who)
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), pa.array(batch.column(0).to_numpy()[who]), pa.array(no.astype(np.int32))], names=["hash", "key", "no"])


def _encode_leaders(path: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(hash, ids) of the listed chunks of each text, ids as numbers of the least width that holds them."""
        encode, _, by_id = _encoder(path)
        width = _width(by_id)
        done: set[int] = set()
        for batch in slices(batches, "text"):
            data, borders = utf8(batch.column(0))
            ends, who = chunks(data, borders)
            starts, raw = _starts(ends, who, borders), data.tobytes()
            first = np.searchsorted(who, np.arange(batch.num_rows))
            hashes, out = [], []
            for i, (numbers, digests) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, d in zip(numbers, digests):
                    c = first[i] + n
                    chunk = raw[starts[c] : ends[c]] if c < len(who) and who[c] == i else b""
                    if chunk and d not in done and _digest(chunk) == d:  # else another text has the same key
                        done.add(d)
                        hashes.append(d)
                        out.append(encode(chunk).astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.binary())], names=["hash", "ids"])

    return kernel


def encode_text(data: bytes, starts: list[int], ends: list[int], known: dict[int, np.ndarray], encode, sizes: np.ndarray) -> np.ndarray:
    """Tokens of a text of chunks, some of which are known; runs of the others are encoded as one part."""
    if not known:
        return encode(data)
    parts, at = [], 0
    for no in sorted(known):
        if starts[no] > at:
            parts.append((at, starts[no], encode(data[at : starts[no]])))
        parts.append((starts[no], ends[no], known[no]))
        at = ends[no]
    if at < len(data):
        parts.append((at, len(data), encode(data[at:])))
    return join(data, parts, encode, sizes)


def _encode(path: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes, by_id = _encoder(path)
        width = _width(by_id)
        before: tuple = (None, None, None)
        for batch in slices(batches, "text"):
            texts = batch.column(1)
            data, borders = utf8(texts)
            reused = batch.column(2).to_pylist()
            ends, who = chunks(data, borders) if any(reused) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            starts, raw = _starts(ends, who, borders), data.tobytes()
            out, same = [], []
            for i, chunk_ids in enumerate(reused):
                own = raw[borders[i] : borders[i + 1]]
                if own == before[0]:  # rows come sorted by key, so equal texts follow one another
                    out.append(before[1])
                    same.append(before[2])
                    continue
                if chunk_ids:
                    a, b = np.searchsorted(who, [i, i + 1])
                    known = {r["no"]: np.frombuffer(r["ids"], width).astype(np.int32) for r in chunk_ids if r["no"] < b - a and _digest(raw[starts[a + r["no"]] : ends[a + r["no"]]]) == r["hash"]}
                    ids = encode_text(own, (starts[a:b] - borders[i]).tolist(), (ends[a:b] - borders[i]).tolist(), known, encode, sizes)
                else:
                    ids = encode(own)
                right = b"".join(map(by_id.__getitem__, ids.tolist())) == own
                if not right:  # two chunks of one hash
                    ids = encode(own)
                    right = b"".join(map(by_id.__getitem__, ids.tolist())) == own
                before = own, ids, right
                out.append(ids)
                same.append(right)
            n = np.array([len(x) for x in out], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            mask = pa.array(null)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)), mask=mask)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(n.astype(np.int32), mask=null), pa.array(np.array(same), mask=null)], names=["doc_id", "ids", "n_tokens", "exact"])

    return kernel


def encode_documents(docs: DataFrame, path: str = VOCABULARY, broadcast_chunks: int = BROADCAST_CHUNKS) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): the tokens of each row's text; `exact` says that they decode to the text."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    texts, none = base.where("text is not null"), base.where("text is null")
    rows = written(mapped(texts.select("key", "text"), _chunk_rows, "hash bigint, key bigint, no int"), "chunk-rows")
    # places of a chunk are told apart by text: rows that repeat a whole text share nothing by it, they are encoded as one below
    places = rows.distinct()
    repeated = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("key", "no")).alias("lead")).where("n > 1").select("hash", "lead")
    refs = written(places.join(repeated, "hash").select("hash", "key", "no", (F.struct("key", "no") == F.col("lead")).alias("leads")), "chunk-refs")
    leads = written(refs.where("leads").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "hash"))).alias("c")).select("key", F.col("c.no").alias("no"), F.col("c.hash").alias("hash")), "chunk-leads")
    # the numbers of the leading chunks, by text: broadcast within the limit, else joined by key
    few = (leads.agg(F.sum(F.size("no"))).first()[0] or 0) <= broadcast_chunks
    listed = texts.join(F.broadcast(leads) if few else leads, "key").select("text", "no", "hash")
    encoded = written(mapped(listed, _encode_leaders(path), "hash bigint, ids binary").dropDuplicates(["hash"]), "chunk-ids")
    known = refs.join(encoded, "hash").groupBy("key").agg(F.collect_list(F.struct("no", "hash", "ids")).alias("known"))
    tokens = mapped(texts.join(known.hint("merge"), "key", "left").select("doc_id", "text", "known"), _encode(path), "doc_id bigint, ids array<int>, n_tokens int, exact boolean")
    # null texts have one key and would all be one task's
    return tokens.union(none.select("doc_id", F.lit(None).cast("array<int>"), F.lit(None).cast("int"), F.lit(None).cast("boolean")))


def decode_tokens(tokens: DataFrame, path: str = VOCABULARY, ids: str = "ids", to: str = "text") -> DataFrame:
    """(doc_id, `to`): the text of each row's tokens; null for null tokens, and for those that are no text or not in the vocabulary."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = vocabulary(path)[1]

        def text(x):
            try:
                return None if x is None or any(i is None or i < 0 for i in x) else b"".join([by_id[i] for i in x]).decode()
            except (IndexError, UnicodeDecodeError):
                return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", to])

    return mapped(tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ids).alias("__ids")), kernel, f"doc_id bigint, `{to}` string")
