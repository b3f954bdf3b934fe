from collections import defaultdict

import pytest

from palimpsest.llm import quality


def brute(rows, floor, share, min_kept):
    """(doc_id, text) kept, by plain loops."""
    norm = lambda x: " ".join(x.lower().replace("\t", " ").split(" ")).strip()
    import re

    norm = lambda x: re.sub("[ \t\r\f]+", " ", x.lower()).strip(" ")
    held, hosts = defaultdict(set), defaultdict(set)
    first = {}
    for i, t, _, s in rows:
        if t is None:
            continue
        hosts[s or ""].add(t)
        for line in {norm(x) for x in t.split("\n")} - {""}:
            k = (s or "", line)
            held[k].add(t)
            if i is not None:
                first[k] = min(first.get(k, i), i)
    cut = {k for k, v in held.items() if len(v) > max(floor, share * len(hosts[k[0]]))}
    out = []
    for i, t, _, s in rows:
        if t is None:
            continue
        lines = t.split("\n")
        keep = [x for x in lines if (s or "", norm(x)) not in cut or (i is not None and first.get((s or "", norm(x))) == i)]
        a, b = sum(len(norm(x)) for x in lines), sum(len(norm(x)) for x in keep)
        if b > 0 and b >= min_kept * a:
            out.append((i, "\n".join(keep)))
    return sorted(out, key=str)


ROWS = [(i, f"Share  this\tPage\nunique text number {i} is long enough\nfooter {i % 2}", "en", "h" if i < 8 else "k") for i in range(12)]
ROWS += [(20, "share this page", "en", "h"), (21, "share this page\nfooter 0", "en", "h"), (None, "share this page\nok then", "en", "h"), (22, "Share this page", "en", None)]


@pytest.mark.parametrize("broadcast_rows", [quality.BROADCAST_ROWS, -1])
def test_brute_force(made, broadcast_rows):
    got = quality.apply_quality(made(ROWS), floor=3, share=0.0, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(ROWS, 3, 0.0, quality.MIN_KEPT)
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("broadcast_rows", [quality.BROADCAST_ROWS, -1])
def test_one_id_under_two_hosts(made, broadcast_rows):
    # 5 is the first document of the line in b, not in a
    rows = [(i, f"common line here\nown line number {i}", "en", "a") for i in range(8)] + [(i, f"common line here\nown line number {i}", "en", "b") for i in range(5, 13)]
    got = quality.apply_quality(made(rows), floor=3, share=0.0, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows, 3, 0.0, quality.MIN_KEPT)
    assert {(r.doc_id, r.source) for r in got if r.text.startswith("common")} == {(0, "a"), (5, "b")}


def test_share_of_host(made):
    rows = [(i, f"common line\nown line {i}", "en", "h") for i in range(10)]
    assert brute(rows, 3, 0.95, 0.3) == sorted(((r.doc_id, r.text) for r in quality.apply_quality(made(rows), 3, 0.95).collect()), key=str)
    assert brute(rows, 3, 2.0, 0.3)[0][1].startswith("common")


def test_copies_count_once(made):
    rows = [(i, "a line that all copies hold\nand one more", "en", "h") for i in range(50)]
    assert quality.apply_quality(made(rows), floor=5).count() == 50


def test_oracle(spark, duck, equal, small):
    from palimpsest.llm.queries import op9_quality_rules

    equal(op9_quality_rules(spark, small), duck(quality.ORACLE, small))


@pytest.mark.parametrize("broadcast_rows", [quality.BROADCAST_ROWS, -1])
def test_odd_rows(odd, broadcast_rows):
    got = quality.apply_quality(odd, floor=1, broadcast_rows=broadcast_rows)
    assert got.columns == odd.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [4, 4, 4, 5, 6, 7, None]
    assert quality.apply_quality(odd.limit(0)).count() == 0


def test_clashing_columns(made):
    from pyspark.sql import functions as F

    d = made(ROWS)
    for c in ("host", "line", "gone", "row", "left", "pairs", "first", "lines", "id", "a.b"):
        d = d.withColumn(c, F.lit(1))
    assert quality.apply_quality(d, floor=3).columns == d.columns
    assert quality.apply_quality(d, floor=3).count() == quality.apply_quality(made(ROWS), floor=3).count()
