from collections import Counter

import numpy as np

import corpus_pipeline
from palimpsest.llm import bpe, mixing, quality, secrets, simhash

from .test_quality import brute as brute_quality
from .test_simhash import brute_components


def kept_by_simhash(spark, docs):
    """The least id of each component of the pairs within the threshold, by all pairs."""
    sigs = simhash.signatures(docs).collect()
    s = np.frombuffer(b"".join(bytes(r.sig) for r in sigs), np.uint64).reshape(-1, 4)
    ids = [r.doc_id for r in sigs]
    pairs = [(ids[i], ids[i + 1 + j]) for i in range(len(s)) for j in np.nonzero(np.bitwise_count(s[i + 1 :] ^ s[i]).sum(axis=1) <= simhash.TAU)[0]]
    root = brute_components(pairs, ids)
    return {i for i in ids if root[i] == i} | {r.doc_id for r in docs.collect()} - set(ids)


def test_every_stage_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "secret scans", "mixing sources", "bpe encoding"]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows, got = docs.collect(), out.collect()
        if name != "bpe encoding":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in got)
        if name == "quality rules":
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_quality([(r.doc_id, r.text, r.lang, r.source) for r in rows], quality.FLOOR, quality.SHARE, quality.MIN_KEPT)
        elif name == "simhash near-dedup":
            assert {r.doc_id for r in got} == kept_by_simhash(spark, docs) and len(got) < len(rows)
        elif name == "secret scans":
            assert {r.doc_id: r.text for r in got} == {r.doc_id: secrets.redact(r.text, secrets.scan(r.text)) for r in rows}
        elif name == "mixing sources":
            want = Counter(r.doc_id for r in mixing.schedule(docs).where("tok_start = 0").collect())
            assert Counter(r.doc_id for r in got) == want and set(want) == {r.doc_id for r in rows}
            assert {r.doc_id: r.text for r in got} == {r.doc_id: r.text for r in rows}
        else:
            enc = bpe.vocabulary(bpe.VOCABULARY)[0]
            want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in rows)
            assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.exact for r in got)
        docs = out


def test_odd_rows(spark, odd, tmp_path):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where("exact").count() == docs.count() > 0


def test_rows_without_id_are_kept(spark, odd, made, tmp_path):
    docs = odd.union(made([(None, "again and again", "en", "a"), (None, "again and again", "en", "a")]))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs, before = spark.read.parquet(str(tmp_path / str(k))), docs
        if name in ("secret scans", "mixing sources"):
            assert {(r.doc_id, r.text) for r in docs.collect()} == {(r.doc_id, r.text) for r in before.collect()}
    got = Counter((r.doc_id, r.text) for r in docs.collect())
    assert got[None, "no id here at all"] >= 1 and got[None, "again and again"] >= 2


def test_empty_table(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "ids", "n_tokens", "exact"] and out.where("not exact").count() == 0 and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
