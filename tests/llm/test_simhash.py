import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import simhash
from palimpsest.llm.graph import components


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600), min_size=1, max_size=5))
def test_signature_is_the_majority(rows):
    words = np.array([w for r in rows for w in r], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = simhash.signatures_of(words, offsets)
    for r, sig in zip(rows, got):
        bits = np.unpackbits(simhash.mix64(np.array(r, np.uint64)[:, None] * simhash._SALTS).view(np.uint8).reshape(len(r), 32), axis=1)
        # lanes keep the order of bits in a byte
        assert (np.packbits(2 * bits.sum(0, dtype=int) >= len(r)).view(np.uint64) == sig).all()


def test_ring_keeps_all_within_tau():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, (4000, 4), dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        flip = rng.choice(256, rng.integers(0, simhash.TAU + 1), replace=False)
        bits = np.unpackbits(b[i].view(np.uint8))
        bits[flip] ^= 1
        b[i] = np.packbits(bits).view(np.uint64)
    assert simhash.ring_ok(a, b).all()
    far = rng.integers(0, 2**63, (4000, 4), dtype=np.uint64)
    assert simhash.ring_ok(a, far).mean() < 0.1


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sigs = simhash.signatures(docs).collect()
    s = np.frombuffer(b"".join(bytes(r.sig) for r in sigs), np.uint64).reshape(-1, 4)
    ids = [r.doc_id for r in sigs]
    pairs = []
    for i in range(len(s)):
        d = np.bitwise_count(s[i + 1 :] ^ s[i]).sum(axis=1)
        pairs += [(ids[i], ids[i + 1 + j], d[j]) for j in np.nonzero(d <= simhash.TAU)[0]]
    group = {r.doc_id: r.kept_id for r in simhash.near_duplicates(docs).collect()}
    same = lambda a, b: group.get(a, a) == group.get(b, b)
    assert len(pairs) > 50
    assert all(same(a, b) for a, b, d in pairs if d <= 15)
    assert np.mean([same(a, b) for a, b, _ in pairs]) >= 0.97
    exact = brute_components([(a, b) for a, b, _ in pairs], ids)
    assert all(exact[d] == exact[k] for d, k in group.items())


def found_share(distance, n=2000):
    """The share of lone random pairs at a distance that candidate search finds."""
    rng = np.random.default_rng(distance)
    a = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
    bits = np.unpackbits(a.view(np.uint8).reshape(n, 32), axis=1)
    for row in bits:
        row[rng.choice(256, distance, replace=False)] ^= 1
    sig = np.concatenate([a, np.packbits(bits, axis=1).view(np.uint64).reshape(n, 4)])
    by = sig.view(np.uint8).reshape(-1, 32).astype(np.int64)
    key = ((np.arange(32)[None, :] << 16) | (by << 8) | np.roll(by, -1, axis=1)).ravel()
    order = np.argsort(key, kind="stable")
    x, y = simhash.bucket_edges(key[order], np.repeat(np.arange(2 * n), 32)[order], np.repeat(sig, 32, axis=0)[order])
    assert (np.abs(x - y) == n).all()
    return len(set(np.minimum(x, y).tolist())) / n


def test_recall_by_distance():
    # none is lost within 15 bits; lone pairs beyond are found by these shares
    for distance, least in ((1, 1), (8, 1), (15, 1), (20, 0.999), (24, 0.995), (28, 0.99), (32, 0.96), (36, 0.92), (40, 0.82)):
        assert found_share(distance) >= least, distance


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    nodes = {x for e in edges for x in e}
    want = {n: r for n, r in brute_components(edges, nodes).items() if n != r}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_one_of_each_group_stays(made, odd):
    base = [f"word{i}" for i in range(200)]
    rows = [(10, " ".join(base), "en", "a"), (11, " ".join(base), "en", "b"), (12, " ".join(base[:-2] + ["x", "y"]), "en", "a"), (13, " ".join(f"other{i}" for i in range(200)), "en", "a")]
    d = made(rows)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(d).collect()) == [10, 13]
    assert {(r.doc_id, r.kept_id) for r in simhash.near_duplicates(d).collect()} == {(11, 10), (12, 10)}
    got = simhash.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    # of the rows of id 4 one stays; 7 equals one of them
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 2, 3, 4, 5, 6, None, None]
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_hot_group(made):
    base = [f"word{i}" for i in range(150)]
    rows = [(i, " ".join(base[:140] + [f"u{i}a", f"u{i}b"]), "en", "a") for i in range(400)]
    assert [r.doc_id for r in simhash.drop_near_duplicates(made(rows)).collect()] == [0]


@pytest.mark.parametrize("name", ["sig", "a", "b", "node", "__rank", "id", "kept_id"])
def test_clashing_columns(made, name):
    from pyspark.sql import functions as F

    d = made([(1, "a b c", "en", "s"), (2, "a b c", "en", "s"), (2, "a b c", "en", "s")]).withColumn(name, F.lit("z"))
    got = simhash.drop_near_duplicates(d)
    assert got.columns == d.columns and [r.doc_id for r in got.collect()] == [1]
