"""URL filters by a weighted vocabulary.

One Aho-Corasick automaton holds strict and soft terms, each with its weight.  A
hit counts only between borders: the text's ends or a character other than an
ASCII letter or digit.  A URL is rejected on one strict term, or on
`soft_limit` distinct soft terms or more whose weights come to `soft_score`.

The vocabulary is a parameter; `read_terms` takes it from a table.

Defined cases: a null or empty URL has no hits and is kept; letters count in
lower case; a term counts once however often it occurs; overlapping terms all
count; every row is returned, repeated rows too; an empty table gives an empty
one; in a table of terms, rows without a term are left out, and of a repeated
term the strict row of the greatest weight counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

STRICT: dict[str, float] = dict.fromkeys(
    """porn porno pornography xxx hentai camgirl camgirls sexcam sexcams livesex escort escorts onlyfans-leak nudes-leak
    viagra cialis levitra online-pharmacy buy-xanax buy-oxycodone casino casinos online-casino slot-machine sportsbook
    warez torrent-hub serial-keys cracked-software phishing malware botnet fake-id counterfeit payday-loan payday-loans link-farm spam-farm doorway-page""".split(), 1.0
)
SOFT: dict[str, float] = dict.fromkeys("adult sex sexy nude naked erotic fetish bet bets betting poker roulette jackpot gamble gambling pills pharmacy loan loans spam crack keygen torrent dating replica".split(), 0.5) | dict.fromkeys(
    "hot bonus free win winner prize cheap cheapest deal deals discount promo coupon click download clickbait earn cash credit miracle".split(), 0.3
)
SOFT_LIMIT, SOFT_SCORE = 2, 0.8


def automaton(terms: Mapping[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in terms:
        if term:
            a.add_word(term.lower(), term)
    if len(a):
        a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, a: ahocorasick.Automaton) -> set[str]:
    """The distinct terms that stand between borders in a lower-case URL."""
    found = set()
    if len(a):
        for end, term in a.iter(url):
            start = end - len(term)
            if (start < 0 or not _word(url[start])) and (end + 1 == len(url) or not _word(url[end + 1])):
                found.add(term)
    return found


def read_terms(terms: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(strict, soft) of a table (term STRING, strict BOOLEAN, weight DOUBLE); the vocabulary is held by each worker."""
    best = terms.where("term is not null and term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max(F.struct("strict", "weight")).alias("w")).select("term", "w.*").collect()
    return {r.term: r.weight for r in best if r.strict}, {r.term: r.weight for r in best if not r.strict}


def score_urls(pages: DataFrame, strict: Mapping[str, float] = STRICT, soft: Mapping[str, float] = SOFT, soft_limit: int = SOFT_LIMIT, soft_score: float = SOFT_SCORE) -> DataFrame:
    """(page_id, url, strict_hits, soft_hits, score, rejected) for every row; hits are distinct terms, the score is the sum of their weights."""
    strict, soft = dict(strict), dict(soft)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(soft | strict)
        for batch in batches:
            rows = []
            for url in batch.column(2).to_pylist():
                found = hits(url or "", a)
                s, w = [t for t in found if t in strict], [t for t in found if t not in strict]
                weak = round(sum(soft[t] for t in w), 6)
                rows.append((len(s), len(w), round(sum(strict[t] for t in s) + weak, 6), bool(s) or (len(w) >= soft_limit and weak >= soft_score)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.bool_())))], names=["page_id", "url", "strict_hits", "soft_hits", "score", "rejected"])

    schema = "page_id bigint, url string, strict_hits int, soft_hits int, score double, rejected boolean"
    return mapped(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.lower("url").alias("low")), kernel, schema)


_VALUES = ", ".join(f"('{t}', {str(k).lower()}, {w})" for k, v in ((True, STRICT), (False, SOFT)) for t, w in v.items())
ORACLE = f"""
WITH v(term, strict, weight) AS (VALUES {_VALUES}),
u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
h AS (SELECT url, term, strict, weight FROM u JOIN v ON regexp_matches(lower(url), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')),
s AS (SELECT url, CAST(count(*) FILTER (strict) AS INTEGER) AS strict_hits, CAST(count(*) FILTER (NOT strict) AS INTEGER) AS soft_hits, round(CAST(sum(weight) AS DOUBLE), 6) AS score, round(CAST(sum(weight) FILTER (NOT strict) AS DOUBLE), 6) AS weak FROM h GROUP BY url)
SELECT page_id, url, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(score, 0.0) AS score,
       coalesce(strict_hits > 0, false) OR coalesce(soft_hits >= {SOFT_LIMIT} AND weak >= {SOFT_SCORE}, false) AS rejected
FROM pages LEFT JOIN s USING (url)
"""
