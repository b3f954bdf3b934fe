from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import mixing


def test_van_der_corput():
    t = np.array([0, 1, 2, 3, 5, 2**40 + 1])
    assert mixing.van_der_corput(t).tolist() == [int(f"{x:048b}"[::-1], 2) for x in t.tolist()]


def test_oracle(spark, duck, equal, small):
    from palimpsest.llm.queries import op1_mix_sources

    equal(op1_mix_sources(spark, small), duck(mixing.ORACLE, small))


def rows(n=60):
    return [(i, " ".join(["w"] * (1 + i * 7 % 50)), "en", "abc"[i % 3] if i % 5 else "a") for i in range(n)]


def test_schedule(made):
    d = made(rows())
    got = mixing.schedule(d, {"a": 0.5, "b": 0.3, "c": 0.2, "absent": 9}, block=16).collect()
    tokens = {i: len(t.split()) for i, t, *_ in rows()}
    slots = {r.slot: r.source for r in got}
    assert sorted(slots) == list(range(len(slots)))
    # low discrepancy: every prefix holds each source within a few slots of its weight
    for n in range(1, len(slots) + 1):
        c = Counter(slots[k] for k in range(n))
        assert all(abs(c[s] - w / 9.99 * 9.99 * n) <= 6 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    # first epochs hold every token of every document once
    seen = Counter()
    for r in got:
        if r.epoch == 0:
            seen[r.doc_id] += r.tok_end - r.tok_start
    assert seen == Counter(tokens)
    # all blocks are of one size but the last of each source, and no epoch repeats one
    size, often = Counter(), Counter()
    for r in got:
        size[r.slot] += r.tok_end - r.tok_start
        often[r.source, r.epoch, r.block, r.doc_id] += 1
    assert max(often.values()) == 1
    last = {s: max(r.block for r in got if r.source == s) for s in "abc"}
    assert all(size[r.slot] == 16 for r in got if r.block < last[r.source])


def test_shortest_cover(made):
    got = mixing.schedule(made(rows()), block=16).collect()
    blocks = {s: 1 + max(r.block for r in got if r.source == s) for s in "abc"}
    top = max(r.slot for r in got)
    seen = {(r.source, r.block) for r in got if r.epoch == 0}
    assert len(seen) == sum(blocks.values())
    assert (lambda r: r.epoch == 0 and r.block == blocks[r.source] - 1)(next(r for r in got if r.slot == top))


def test_mix_documents(made, odd):
    d = made(rows())
    got = mixing.mix_documents(d, block=16)
    assert got.columns == d.columns
    n = Counter(r.doc_id for r in got.collect())
    starts = Counter(r.doc_id for r in mixing.schedule(d, block=16).where("tok_start = 0").collect())
    assert n == starts and set(n) == {r[0] for r in rows()}
    order = [r.doc_id for r in got.collect()]
    want = [r.doc_id for r in mixing.schedule(d, block=16).where("tok_start = 0").orderBy("slot", "doc_id").collect()]
    assert order == want
    got = mixing.mix_documents(odd)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {4, 5, 6, 7}
    # of the rows of id 4, one is used
    assert len({r.text for r in got.where("doc_id = 4").collect()}) == 1
    assert mixing.mix_documents(odd.limit(0)).count() == mixing.schedule(odd.limit(0)).count() == 0
    assert mixing.schedule(d, {}).count() == mixing.schedule(d, {"a": 0.0}).count() == 0


def test_rows_without_id(made):
    d = made([*rows(9), (None, "one two", "en", "a"), (None, "one two", "en", "a"), (None, "one two", "fr", None), (None, None, "en", "a"), (None, "", "en", "a")])
    got = Counter((r.doc_id, r.text, r.lang, r.source) for r in mixing.mix_documents(d, {"a": 1, "b": 1, "c": 1, "": 1}, without_id=True, block=1000).collect())
    assert set(got) == {*rows(9), (None, "one two", "en", "a"), (None, "one two", "fr", None)}
    assert got[None, "one two", "en", "a"] == 2 * got[0, "w", "en", "a"]
    plain = lambda d, **how: [r.doc_id for r in mixing.mix_documents(d, block=16, **how).collect()]
    assert plain(made(rows(9)), without_id=True) == plain(made(rows(9)))


def test_clashing_columns(made):
    d = made(rows(9))
    for c in ("slot", "n", "start", "block", "x", "k", "sid", "a.b", "range"):
        d = d.withColumn(c, F.lit(1))
    assert mixing.mix_documents(d, block=16).columns == d.columns
    assert mixing.schedule(d, block=16).count() == mixing.schedule(made(rows(9)), block=16).count()
