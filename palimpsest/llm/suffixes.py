"""Suffix-array dedup of long repeated passages, sorted deep-shallow.

Words are runs of characters other than ASCII white space.  A passage is
repeated if its L = 50 words in a row occur at another place, in another
document or in the same; the result is the union of such windows.

The suffix array is sparse but loses nothing: winnowing picks, in every window
of L words, the word with the least fingerprint of the S = 26 words from it, so
equal windows have an equal pick.  Suffixes whose first S words occur nowhere
else are dropped (they begin no repeat); the others carry the words that a
window around their pick can reach.  They are sorted by multikey quicksort to a
shallow depth, and by blind tries within the groups that are still equal there;
the longest common prefixes of neighbours, with the words before the picks, give
the repeated windows.  A fingerprint of more than HOT suffixes, such as a notice
that millions of documents hold, is not gathered in one task: its windows are
hashed and counted instead.  Words are compared by 32-bit hashes, windows thus by L of
them in a row.

Defined cases: null and empty texts and those of fewer than L words have no
repeats; rows with a null doc_id are left out; rows that repeat a doc_id are one
document (that of the least hash of the text); texts are taken whole; windows
that touch or overlap form one span; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, mix64, one_per_id, packed, slices, utf8, written

L, S = 50, 26
W = L - S + 1
LEFT, RIGHT = W - 1, L
SHALLOW, SMALL = 8, 16
#: Suffixes of one fingerprint that one task sorts, 296 bytes each.  Beyond, their windows are counted by hash, over all tasks; the results are the same.
HOT = 200_000
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_P, _Q = 0x5851F42D4C957F2D, 0x9E6C63D0876A9A47
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _powers[base] = have = out[0], out[1]
    return have[0][:n], have[1][:n]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hashes of values[start:end], equal for equal contents wherever they stand."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, and the n + 1 borders of the texts among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(borders), np.int64)
    dark = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin = dark.copy()
    begin[1:] &= ~dark[:-1]
    first = borders[:-1][np.diff(borders) > 0]
    begin[first] = dark[first]
    starts = np.flatnonzero(begin)
    stop = dark.copy()
    stop[:-1] &= ~dark[1:]
    last = borders[1:][np.diff(borders) > 0] - 1
    stop[last] = dark[last]
    ends = np.flatnonzero(stop) + 1
    return _ranges(_BYTE[data], starts, ends, _P), np.searchsorted(starts, borders)


def picks(words: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the picked words, and the fingerprints of the S words from them."""
    n = len(words) - S + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < W:
        return none
    at = np.arange(n)
    g = _ranges(words, at, at + S, _Q)
    # the least of each window of W fingerprints, by doubling
    low, width = g.copy(), 1
    while width < W:
        step = min(width, W - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    end = np.repeat(borders[1:], np.diff(borders))
    ok = np.arange(len(low)) + L <= end[: len(low)]
    low[~ok] = 0
    # a word is picked if it is the least of some window that holds it: the greatest of those windows' leasts
    high = np.concatenate([np.zeros(W - 1, np.uint64), low, np.zeros(W - 1, np.uint64)])
    width = 1
    while width < W:
        step = min(width, W - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    found = np.flatnonzero((high == g) & (high > 0))
    return found, g[found]


def _pick_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2_000_000):
        words, borders = words_of(*utf8(batch.column(1)))
        at, g = picks(words, borders)
        who = np.searchsorted(borders, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(batch.column(0).to_numpy()[who]), pa.array((at - borders[who]).astype(np.int32))], names=["fp", "doc_id", "pos"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, doc_id, pos, words): LEFT words before the pick and RIGHT from it, as 4-byte numbers; 0 stands beyond the text."""
    for batch in slices(batches, "text", 2_000_000):
        words, borders = words_of(*utf8(batch.column(1)))
        small = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        pos, fp = batch.column(2), batch.column(3)
        off = pos.offsets.to_numpy()
        p = pos.values.to_numpy()[off[0] : off[-1]]
        f = fp.values.to_numpy()[off[0] : off[-1]]
        who = np.repeat(np.arange(batch.num_rows), np.diff(off))
        ids = batch.column(0).to_numpy()[who]
        for a in range(0, len(p), 20_000):
            o = who[a : a + 20_000]
            at = (borders[o] + p[a : a + 20_000])[:, None] + np.arange(-LEFT, RIGHT)[None, :]
            inside = (at >= borders[o][:, None]) & (at < borders[o + 1][:, None])
            m = np.where(inside, small[np.clip(at, 0, max(0, len(small) - 1))], 0).astype("<u4")
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.shape[1] * 4), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(f[a : a + 20_000]), pa.array(ids[a : a + 20_000]), pa.array(p[a : a + 20_000]), raw], names=["fp", "doc_id", "pos", "words"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc_id, pos, start) of every window of L words around each pick; k1 and k2 hash the window, its pick's fingerprint and place in it."""
    back = np.arange(W)[None, :]
    for batch in slices(batches, "text", 2_000_000):
        words, borders = words_of(*utf8(batch.column(1)))
        pos, fp = batch.column(2), batch.column(3)
        off = pos.offsets.to_numpy()
        p = pos.values.to_numpy()[off[0] : off[-1]]
        f = fp.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
        who = np.repeat(np.arange(batch.num_rows), np.diff(off))
        for a in range(0, len(p), 10_000):
            o, q = who[a : a + 10_000], p[a : a + 10_000]
            start = (borders[o] + q)[:, None] - back
            row, b = np.nonzero((start >= borders[o][:, None]) & (start + L <= borders[o + 1][:, None]))
            start = start[row, b]
            k1 = mix64(_ranges(words, start, start + L, _Q) ^ f[a : a + 10_000][row])
            k2 = mix64(_ranges(words, start, start + L, _P) + b.astype(np.uint64))
            own = [batch.column(0).to_numpy()[o][row], q[row], (start - borders[o][row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *map(pa.array, own)], names=["k1", "k2", "doc_id", "pos", "start"])


def _common(a: bytes, b: bytes) -> int:
    """The length in words of the common prefix of two different strings of equal length."""
    low, high = 0, len(a) // 4 - 1
    while low < high:
        mid = (low + high) // 2
        if a[low * 4 : mid * 4 + 4] == b[low * 4 : mid * 4 + 4]:
            low = mid + 1
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings of equal length by a blind trie: a string goes down by branching words alone, is compared once with the leaf where it ends, and is put in at their first difference; equal strings share a leaf."""
    leaves: dict[bytes, list[int]] = {}
    root: _Node | bytes | None = None
    for i, s in enumerate(strings):
        same = leaves.get(s)
        if same is not None:
            same.append(i)
            continue
        leaves[s] = [i]
        if root is None:
            root = s
            continue
        node = root
        while not isinstance(node, bytes):
            d = node.depth * 4
            node = node.children.get(s[d : d + 4]) or next(iter(node.children.values()))
        depth = _common(s, node)
        parent, node = None, root
        while not isinstance(node, bytes) and node.depth < depth:
            parent, node = node, node.children[s[node.depth * 4 : node.depth * 4 + 4]]
        d = depth * 4
        if not isinstance(node, bytes) and node.depth == depth:
            node.children[s[d : d + 4]] = s
            continue
        other = node
        while not isinstance(other, bytes):
            other = next(iter(other.children.values()))
        split = _Node(depth)
        split.children = {other[d : d + 4]: node, s[d : d + 4]: s}
        if parent is None:
            root = split
        else:
            parent.children[s[parent.depth * 4 : parent.depth * 4 + 4]] = split
    order: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node, bytes):
            order += leaves[node]
        else:
            stack += [node.children[k] for k in sorted(node.children, reverse=True)]
    return order


def deep_shallow(tokens: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows of a uint32 matrix: multikey quicksort by the first `shallow` words, blind tries beyond."""
    big = np.ascontiguousarray(tokens.astype(">u4"))
    width = big.shape[1] * 4
    raw = big.tobytes()
    row = lambda i: raw[i * width : (i + 1) * width]
    cut = shallow * 4
    order: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(tokens)), 0)] if len(tokens) else []
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order.append(int(group[0]))
        elif depth == shallow:
            own = group.tolist()
            order += [own[i] for i in blind_trie([row(i) for i in own])]
        elif len(group) <= SMALL:  # small groups are sorted at once, as usual in multikey quicksort
            own = sorted(group.tolist(), key=lambda i: raw[i * width : i * width + cut])
            a = 0
            while a < len(own):
                b = a + 1
                head = raw[own[a] * width : own[a] * width + cut]
                while b < len(own) and raw[own[b] * width : own[b] * width + cut] == head:
                    b += 1
                part = own[a:b]
                order += part if b == a + 1 else [part[i] for i in blind_trie([row(i) for i in part])]
                a = b
        else:
            word = tokens[group, depth]
            pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
            less, equal, more = group[word < pivot], group[word == pivot], group[word > pivot]
            stack += [(g, d) for g, d in ((more, depth), (equal, depth + 1), (less, depth)) if len(g)]
    return np.array(order, np.int64)


def repeated_windows(fp: np.ndarray, ids: np.ndarray, pos: np.ndarray, words: np.ndarray, keep_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, end) of the repeated windows around each pick; rows are suffixes with LEFT words before the pick.  keep_first leaves out the first place of each repeat."""
    right = words[:, LEFT:]
    order = deep_shallow(right)
    right, left, ids, pos = right[order], words[order, :LEFT], ids[order], pos[order]
    n = len(order)
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), RIGHT)
    least, most = np.full(n, RIGHT), np.full(n, -1)
    before = np.zeros(n, np.uint64)
    for back in range(W):
        # windows that begin `back` words before the pick reach L - back words from it
        whole = right[:, L - back - 1] != 0
        if back:
            w = left[:, LEFT - back]
            before = mix64(before * np.uint64(_Q) + w.astype(np.uint64))
            whole &= w != 0
        run = np.concatenate([[0], np.cumsum(common < L - back)])
        at = np.flatnonzero(whole)
        by = np.lexsort((pos[at], ids[at], before[at], run[at]))
        at = at[by]
        same = (run[at][1:] == run[at][:-1]) & (before[at][1:] == before[at][:-1])
        hit = np.zeros(len(at), bool)
        hit[1:] = same
        if not keep_first:
            hit[:-1] |= same
        found = at[hit]
        least[found] = np.minimum(least[found], back)
        most[found] = back
    ok = most >= 0
    return ids[ok], pos[ok] - most[ok], pos[ok] - least[ok] + L


def _repeats(keep_first: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All suffixes of one fingerprint are in one partition."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        words = np.frombuffer(b"".join(b for c in t.column(3).chunks for b in c.to_pylist()), "<u4").reshape(-1, LEFT + RIGHT)
        ids, start, end = repeated_windows(*(t.column(k).to_numpy() for k in range(3)), words, keep_first)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "start_word", "end_word"])

    return kernel


def _hot_repeats(windows: DataFrame, keep_first: bool) -> DataFrame:
    """(doc_id, start_word, end_word): around each pick, the windows that occur again; counts are combined before they are shuffled."""
    again = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").drop("n")
    hit = windows.join(again, ["k1", "k2"])
    if keep_first:
        hit = hit.where(F.struct("doc_id", "start") != F.col("first"))
    return hit.groupBy("doc_id", "pos").agg(F.min("start").alias("start_word"), (F.max("start") + L).cast("int").alias("end_word")).drop("pos")


def repeated_passages(docs: DataFrame, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word): the spans of words that lie in a repeated window of L words."""
    rows = one_per_id(docs, packed(docs.select("doc_id", "text")), lambda c: [F.xxhash64(c("text")), c("text")])
    texts = rows.select(F.col("__doc").cast("bigint").alias("doc_id"), F.col("__row.text").alias("text")).where("doc_id is not null and text is not null")
    all_picks = mapped(texts, _pick_rows, "fp bigint, doc_id bigint, pos int")
    twice = all_picks.withColumn("n", F.count("*").over(Window.partitionBy("fp"))).where("n > 1")
    place = F.struct("pos", "fp")
    by_doc = written(twice.groupBy("doc_id").agg(*[F.collect_list(F.when(is_hot, place)).alias(c) for c, is_hot in (("cold", F.col("n") <= hot), ("hot", F.col("n") > hot))]), "suffix-picks")
    picked = lambda c: texts.join(by_doc.where(F.size(c) > 0).select("doc_id", F.col(f"{c}.pos").alias("pos"), F.col(f"{c}.fp").alias("fp")), "doc_id").select("doc_id", "text", "pos", "fp")
    suffixes = mapped(picked("cold"), _suffix_rows, "fp bigint, doc_id bigint, pos int, words binary")
    windows = mapped(suffixes.repartition("fp"), _repeats(keep_first), "doc_id bigint, start_word int, end_word int")
    if not by_doc.where("size(hot) > 0").isEmpty():
        windows = windows.union(_hot_repeats(mapped(picked("hot"), _hot_windows, "k1 bigint, k2 bigint, doc_id bigint, pos int, start int"), keep_first))
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    spans = marked.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "span").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("span")
