import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import suffixes
from palimpsest.llm.suffixes import L, LEFT, RIGHT, W, S


def brute(rows):
    """(doc_id, start, end) of the union of windows of L words that occur twice."""
    at = {}
    for i, t in rows:
        w = t.split()
        for x in range(len(w) - L + 1):
            at.setdefault(tuple(w[x : x + L]), []).append((i, x))
    marked = {}
    for places in at.values():
        if len(places) > 1:
            for i, x in places:
                marked.setdefault(i, set()).update(range(x, x + L))
    out = []
    for i, words in marked.items():
        start = last = None
        for x in sorted(words):
            if last is None or x > last + 1:
                if last is not None:
                    out.append((i, start, last + 1))
                start = x
            last = x
        out.append((i, start, last + 1))
    return sorted(out)


def spans(df):
    return sorted((r.doc_id, r.start_word, r.end_word) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=12, max_size=12), max_size=60))
def test_deep_shallow_sorts(rows):
    m = np.array(rows, np.uint32).reshape(-1, 12)
    for shallow in (1, 3, 12):
        order = suffixes.deep_shallow(m, shallow)
        assert sorted(order.tolist()) == list(range(len(m)))
        assert [m[i].tolist() for i in order] == sorted(m.tolist())


def test_deep_shallow_large_groups():
    rng = np.random.default_rng(0)
    m = rng.integers(1, 4, (3000, 10)).astype(np.uint32) * np.uint32(1_000_000_000)
    assert (m[suffixes.deep_shallow(m, 4)] == np.array(sorted(m.tolist()))).all()


def test_words():
    texts = ["", "a b", " a\tb ", "ab", "é漢 a", "  "]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w, b = suffixes.words_of(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got = [w[b[i] : b[i + 1]].tolist() for i in range(len(texts))]
    assert [len(g) for g in got] == [0, 2, 2, 1, 2, 0]
    assert got[1] == got[2] and got[4][1] == got[1][0] and len({x for g in got for x in g}) == 4


def test_equal_windows_have_equal_picks():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 900, dtype=np.uint64)
    words[500:560] = words[100:160]
    at, fp = suffixes.picks(words, np.array([0, 300, 900]))
    g = dict(zip(at.tolist(), fp.tolist()))
    for start, stop in ((0, 300), (300, 900)):
        for x in range(start, stop - L + 1):
            assert any(x <= p < x + W for p in g)
    for x in range(100, 160 - L + 1):
        assert any(p + 400 in g and g[p] == g[p + 400] for p in range(x, x + W) if p in g)
    assert all(p + S <= (300 if p < 300 else 900) for p in g)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2, 0])
def test_brute_force(made, hot):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    base = [[word() for _ in range(rng.randint(0, 260))] for _ in range(24)]
    for _ in range(30):  # passages of 45 to 90 words copied about
        a, b = rng.choice(base), rng.choice(base)
        n = rng.randint(45, 90)
        if len(a) > n:
            x = rng.randrange(len(a) - n)
            y = rng.randrange(len(b) + 1)
            b[y:y] = a[x : x + n]
    base += [["tick", "tock"] * 70, ["same"] * 130, ["same"] * 49]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    d = made([(i, t, "en", "s") for i, t in rows])
    assert spans(suffixes.repeated_passages(d, hot=hot)) == brute(rows)
    assert spans(suffixes.repeated_passages(d, True, hot)) == spans(suffixes.repeated_passages(d, True))


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert spans(suffixes.repeated_passages(docs)) == brute(rows)


def test_keep_first(made):
    p = " ".join(f"p{i}" for i in range(60))
    d = made([(3, f"x {p} y", "en", "s"), (1, p, "en", "s"), (2, f"z z {p}", "en", "s")])
    assert spans(suffixes.repeated_passages(d)) == [(1, 0, 60), (2, 2, 62), (3, 1, 61)]
    assert spans(suffixes.repeated_passages(d, keep_first=True)) == [(2, 2, 62), (3, 1, 61)]


def test_odd_rows(odd, made):
    # only the long text repeats itself; equal rows of one id are one document
    assert spans(suffixes.repeated_passages(odd)) == [(5, 0, 200_000)]
    assert suffixes.repeated_passages(odd.limit(0)).count() == 0
    p = " ".join(f"p{i}" for i in range(60))
    d = made([(1, p, "en", "s"), (1, p, "en", "s"), (None, p, "en", "s")])
    for c in ("fp", "pos", "words", "new", "span", "start_word"):
        d = d.withColumn(c, F.lit(1))
    assert spans(suffixes.repeated_passages(d)) == []
    assert spans(suffixes.repeated_passages(d.union(d.limit(1).withColumn("doc_id", F.lit(2))))) == [(1, 0, 60), (2, 0, 60)]
