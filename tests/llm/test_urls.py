import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import urls


def brute(url, terms):
    return {t for t in terms if re.search(f"(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)", url)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*urls.STRICT, *urls.SOFT, "-", "/", ".", "a", "9", "é", "x", "sub"]), max_size=8))
def test_hits(parts):
    url = "".join(parts)
    terms = urls.SOFT | urls.STRICT
    assert urls.hits(url, urls.automaton(terms)) == brute(url, terms)


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://x.org/online-casino/a", (2, 0, True)),
        ("http://x.org/free-bonus", (0, 2, False)),
        ("http://x.org/free-bonus/click", (0, 3, True)),
        ("http://x.org/poker-bonus", (0, 2, True)),
        ("http://x.org/poker", (0, 1, False)),
        ("http://x.org/free/free", (0, 1, False)),
        ("http://freedom.org/essex", (0, 0, False)),
        ("HTTP://X.ORG/PORN", (1, 0, True)),
        ("", (0, 0, False)),
        (None, (0, 0, False)),
    ],
)
def test_rules(spark, url, want):
    r = urls.score_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string")).first()
    assert (r.strict_hits, r.soft_hits, r.rejected) == want


def test_oracle(spark, duck, equal, small):
    from palimpsest.llm.queries import op4_url_filter

    equal(op4_url_filter(spark, small), duck(urls.ORACLE, small))


def test_terms_from_a_table(spark):
    rows = [("Bad", True, 1.0), ("bad", False, 9.0), ("meh", False, 0.2), ("meh", False, 0.4), ("so", False, 0.4), (None, True, 1.0), ("", True, 1.0)]
    strict, soft = urls.read_terms(spark.createDataFrame(rows, "term string, strict boolean, weight double"))
    assert (strict, soft) == ({"bad": 1.0}, {"meh": 0.4, "so": 0.4})
    d = spark.createDataFrame([(1, "x/BAD"), (2, "meh.so"), (3, "meh")], "page_id bigint, url string")
    assert [(r.page_id, r.rejected, r.score) for r in urls.score_urls(d, strict, soft).orderBy("page_id").collect()] == [(1, True, 1.0), (2, True, 0.8), (3, False, 0.4)]


def test_odd_rows(spark):
    rows = [(None, None, "z", 1), (1, "http://porn.x/" + "a" * 500_000, "z", 1), (1, "http://porn.x/" + "a" * 500_000, "z", 1)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, low string, score int")
    assert sorted((str(r.page_id), r.rejected) for r in urls.score_urls(d).collect()) == [("1", True), ("1", True), ("None", False)]
    assert urls.score_urls(d.limit(0)).count() == 0
    assert not urls.score_urls(d, {}, {}).where("rejected").count()
