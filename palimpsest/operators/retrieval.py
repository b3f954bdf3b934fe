"""Retrieval: inverted index, vector search, and hybrid recall."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import bloom_words, fuzzy, index_terms, query_keywords
from ..functions.vectors import cosine, with_cosine
from .storage import contains_text, has_tag, search


def postings(m: DataFrame, content: str = "content") -> DataFrame:
    """(term, id), once each."""
    return m.select("id", F.explode(F.array_distinct(index_terms(F.col(content)))).alias("term"))


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The terms of a query, and how often it names each; made of a constant, so that no job runs."""
    return dict(Counter(spark.sql("VALUES (1)").select(index_terms(F.lit(query)).alias("t")).first()["t"]))


def has_term(low: Column, term: str) -> Column:
    """Whether a lower-case text holds a term between its breaks.  The term stands first in the expression, so that its breaks are looked at only where it is."""
    inside, t = r"[\p{IsAlphabetic}\p{N}_]", re.escape(term)
    return low.rlike(f"{t}(?<!{inside}{t})(?!{inside})")


def _tested(m: DataFrame, tests: Sequence[Column], *columns: str) -> tuple[DataFrame, list[Column]]:
    """`columns` of m and the tests' results as bits, each test made once a row, however often its result is asked for; and the results as Columns."""
    groups = [tests[k : k + 60] for k in range(0, len(tests), 60)]
    bits = F.array(*[reduce(lambda a, b: a + b, [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, t in enumerate(g)]) for g in groups])
    # a generated column is not evaluated again inside later expressions
    return m.select(*columns, F.explode(F.array(bits)).alias("__bits")), [F.col("__bits")[k // 60].bitwiseAND(F.lit(1 << k % 60)) != 0 for k in range(len(tests))]


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def index_hits(m: DataFrame, query: str, *columns: str) -> DataFrame:
    """(id, *columns, terms, score): distinct terms of the query that a memory holds, and their times in the query.

    Terms are tested per row, so nothing but the hits leaves the scan.
    """
    q = query_terms(m.sparkSession, query)
    if not q:
        return m.select("id", *columns, F.lit(0).alias("terms"), F.lit(0).cast("bigint").alias("score")).where("false")
    low = m.select("id", *columns, F.lower(F.coalesce("content", F.lit(""))).alias("__low"))
    found, has = _tested(low, [has_term(F.col("__low"), t) for t in q], "id", *columns)
    score = _total([F.when(h, n).otherwise(0) for h, n in zip(has, q.values())])
    return found.where(reduce(lambda a, b: a | b, has)).select("id", *columns, _total([h.cast("int") for h in has]).alias("terms"), score.cast("bigint").alias("score"))


def search_and(m: DataFrame, query: str) -> DataFrame:
    return index_hits(m, query).where(F.col("terms") == len(query_terms(m.sparkSession, query))).select("id")


def search_or(m: DataFrame, query: str) -> DataFrame:
    return index_hits(m, query).select("id")


def search_ranked(m: DataFrame, query: str, limit: int) -> DataFrame:
    return index_hits(m, query).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def remove_postings(p: DataFrame, ids: DataFrame) -> DataFrame:
    """A stored index without the postings of some memories."""
    return p.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_anti")


def update_postings(p: DataFrame, changed: DataFrame) -> DataFrame:
    """A stored index with the postings of changed memories in place of their old ones."""
    return remove_postings(p, changed.select("id")).unionByName(postings(changed).select(*p.columns))


def rebuild(m: DataFrame, limit: int | None = None) -> DataFrame:
    """One row of what a rebuilt index holds: memories of each store (the strongest `limit` of each, if given), terms, postings, and words for the Bloom filter."""
    stores = {"episodic": "Episodic", "semantic": "Semantic", "procedural": "Procedural"}
    parts = [m.where(F.col("memory_type") == t) for t in stores.values()]
    if limit is not None:
        parts = [p.orderBy(F.desc("strength"), "id").limit(limit) for p in parts]
    own = reduce(DataFrame.unionByName, [p.select("id", "content", "memory_type") for p in parts])
    n = own.agg(*[F.count_if(F.col("memory_type") == t).alias(k) for k, t in stores.items()])
    i = postings(own).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))
    w = own.select(F.explode(bloom_words(F.col("content"))).alias("w")).agg(F.count_distinct("w").alias("bloom_words"))
    return n.crossJoin(i).crossJoin(w)


def index_stats(m: DataFrame) -> DataFrame:
    p = postings(m)
    terms = p.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("n"))
    docs = m.where(F.size(index_terms(F.col("content"))) > 0).agg(F.count("*").alias("docs"))
    return terms.crossJoin(docs).select("terms", "docs", F.coalesce(F.try_divide("n", F.col("docs").cast("double")), F.lit(0.0)).alias("avg_terms"))


def keywords(m: DataFrame) -> DataFrame:
    return postings(m).select("term").distinct()


def contains_keyword(m: DataFrame, word: str) -> DataFrame:
    return m.select(F.array_contains(index_terms(F.col("content")), word.lower()).alias("has")).agg(F.coalesce(F.bool_or("has"), F.lit(False)).alias("found"))


def top_similar(m: DataFrame, query: Sequence[float], k: int, threshold: float | None = None, kind: str | None = None) -> DataFrame:
    """The k memories most like a vector; filters come before the limit, so k return if there are as many."""
    if kind is not None:
        m = m.where(F.col("memory_type") == kind)
    hit = with_cosine(m.where("embedding is not null"), query)
    if threshold is not None:
        hit = hit.where(F.col("similarity") > threshold)
    return hit.orderBy(F.desc("similarity"), "id").limit(k)


def semantic_search(m: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.05, among: int | None = None) -> DataFrame:
    """The memories most like the query above the threshold; with `among`, only the so many strongest are looked at."""
    pool = m if among is None else m.orderBy(F.desc("strength"), "id").limit(among)
    return top_similar(pool, query, limit, threshold)


def search_from(v: DataFrame, query: Sequence[float], k: int, source: str | None = None) -> DataFrame:
    """The k vectors most like the query, with a source only those whose metadata name exactly it; the filter comes before the limit."""
    return top_similar(v if source is None else v.where(F.try_element_at("metadata", F.lit("source")) == source), query, k)


def related(stores: Sequence[tuple[DataFrame, int]], query: Sequence[float], threshold: float = 0.4, limit: int = 5) -> DataFrame:
    """Over the strongest of each store, the memories most like the vector, once each."""
    pool = None
    for m, n in stores:
        part = m.select("id", "embedding", "strength").orderBy(F.desc("strength"), "id").limit(n).select("id", "embedding")
        pool = part if pool is None else pool.unionByName(part)
    hit = with_cosine(pool.where("embedding is not null"), query).where(F.col("similarity") > threshold)
    return hit.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def recall(m: DataFrame, query: str, now: Column, limit: int = 10, vector: Sequence[float] | None = None, working: DataFrame | None = None, among: int = 1000) -> DataFrame:
    """Hybrid recall: working memory, inverted index, keywords and the whole query as text; scored by strength, similarity, decay and relevance; once for each content.

    One scan marks each memory with the searches that it answers and ranks it in
    each; tasks send no more than the best of a search.  The ids that come through
    are few, and a second scan reads their rows.  `among` is the number of strongest
    semantic memories that the inverted index counts for.
    """
    cols = ["id", "content", "context", "memory_type", "strength", "access_count", "created_at", "last_accessed", "tags", *(["embedding"] if "embedding" in m.columns else [])]
    m = m.select(*cols)
    words = query_keywords(query)
    q = query_terms(m.sparkSession, query)
    semantic, episodic = F.col("memory_type") == "Semantic", F.col("memory_type") == "Episodic"
    low, about = F.col("__low"), F.col("__about")
    lowered = m.where(F.col("memory_type").isin("Semantic", "Episodic")).select("id", "memory_type", "strength", F.lower(F.coalesce("content", F.lit(""))).alias("__low"), F.lower(F.coalesce("context", F.lit(""))).alias("__about"))
    texts = [query, *words]
    tested, has = _tested(lowered, [has_term(low, t) for t in q] + [low.contains(t.lower()) | about.contains(t.lower()) for t in texts], "id", "memory_type", "strength")
    terms, holds = has[: len(q)], has[len(q) :]
    score = _total([F.when(h, n).otherwise(0) for h, n in zip(terms, q.values())])
    # (search, by what it ranks); null where a memory doesn't answer it
    mark = lambda hit, k, by: F.when(hit, F.struct(F.lit(k).alias("s"), by.cast("double").alias("by")))
    marks = [mark(semantic, 0, F.col("strength")), mark(semantic & (score > 0), 1, score), mark(semantic & holds[0], 2, F.col("strength"))]
    for k, h in enumerate(holds[1:]):
        marks += [mark(kind & h, 3 + 2 * k + j, F.col("strength")) for j, kind in enumerate((episodic, semantic))]
    marked = tested.select("id", F.explode(F.array(*marks)).alias("x")).where("x is not null").select("id", "x.s", "x.by")
    most = max(among, 2 * limit)
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("by"), "id"))
    ranked = marked.withColumn("r", rank).where(F.col("r") <= most)
    ranked = ranked.where(F.col("r") <= F.when(F.col("s") == 0, among).when(F.col("s") == 1, 2 * limit).otherwise(limit))
    found = ranked.groupBy("id").agg(F.collect_set("s").alias("s"))
    indexed = F.array_contains("s", 0) & F.array_contains("s", 1)
    found = found.select("id", indexed.alias("indexed"), F.array_contains("s", 2).alias("whole"), F.exists("s", lambda x: x > 2).alias("word"))
    have = found.agg(F.count_if("indexed").alias("n"))
    if working is not None:
        own = working.select(*cols).where(contains_text(query))
        have = have.crossJoin(own.agg(F.count("*").alias("w"))).select((F.col("n") + F.col("w")).alias("n"))
    # keywords count only where the index and working memory found too little
    ids = found.crossJoin(F.broadcast(have)).where(F.col("indexed") | F.col("whole") | (F.col("word") & (F.col("n") < limit))).select("id")
    pool = m.join(F.broadcast(ids), "id", "left_semi")  # a few ids for each search
    if working is not None:
        pool = pool.unionByName(own).dropDuplicates(["id"])
    if vector is not None and "embedding" in pool.columns:
        sim = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
        pool = pool.withColumn("strength", F.when(F.col("embedding").isNotNull(), F.col("strength") * 0.5 + sim * 0.5).otherwise(F.col("strength")))
    left = scoring.decay(F.col("strength"), F.col("access_count"), F.col("last_accessed"), F.col("created_at"), now)
    pool = pool.withColumn("strength", F.col("strength") * left)
    pool = pool.withColumn("score", scoring.relevance(F.col("strength"), F.col("last_accessed"), F.col("access_count"), now))
    rank = F.row_number().over(Window.partitionBy("content").orderBy(F.desc("score"), "id"))
    return pool.withColumn("__rank", rank).where("__rank = 1").drop("__rank").orderBy(F.desc("score"), "id").limit(limit)


def filtered(found: DataFrame, limit: int, regex: str | None = None, like: str | None = None, tag: str | None = None, kind: str | None = None, by: Sequence[Column] = ()) -> DataFrame:
    """Recalled memories by regular expression, fuzzy pattern, tag and type, then the limit.  A wrong expression is an error."""
    if regex is not None:
        found = found.where(F.col("content").rlike(regex))
    if like is not None:
        found = found.where(fuzzy(F.col("content"), like))
    if tag is not None:
        found = found.where(has_tag(tag))
    if kind is not None:
        found = found.where(F.col("memory_type") == kind)
    return found.orderBy(*(by or (F.desc("strength"), F.col("id")))).limit(limit)


def recall_reinforcing(m: DataFrame, query: Sequence[float], k: int = 5, boost: float = 0.1, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(results, touched): every memory above `least` gets stronger; the best by similarity times new strength return."""
    hit = with_cosine(m.where("embedding is not null"), query).where(F.col("similarity") > least)
    touched = hit.withColumn("strength", F.least(F.lit(1.0), F.col("strength") + boost)).withColumn("access_count", F.col("access_count") + 1)
    return touched.withColumn("score", F.col("similarity") * F.col("strength")).orderBy(F.desc("score"), "id").limit(k), touched


def list_memories(m: DataFrame, n: int, procedural: bool = True) -> DataFrame:
    """The strongest semantic memories and the newest episodic ones, and the strongest procedural ones."""
    semantic = m.where("memory_type = 'Semantic'").orderBy(F.desc("strength"), "id").limit(n)
    episodic = m.where("memory_type = 'Episodic'").orderBy(F.desc("created_at"), "id").limit(n)
    out = semantic.unionByName(episodic)
    return out.unionByName(m.where("memory_type = 'Procedural'").orderBy(F.desc("strength"), "id").limit(n)) if procedural else out


def show(m: DataFrame, links: DataFrame, prefix: str) -> DataFrame:
    """The memories with an id prefix and the contents of what they are linked to."""
    own = m.where(F.col("id").startswith(prefix)).select("id", "content")
    other = m.select(F.col("id").alias("to_id"), F.col("content").alias("linked"))
    return own.join(links.select(F.col("from_id").alias("id"), "to_id"), "id", "left").join(other, "to_id", "left").select("id", "content", "to_id", "linked")


def nearest(m: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(id, other, similarity): the n best partners of each id in symmetric pairs (a, b, similarity)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n).join(m.select("id"), "id", "left_semi")


def patterns_like(m: DataFrame, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """Procedural patterns (JSON in the content) that hold the query and have succeeded often enough."""
    kind = "trigger string, action string, success_count bigint, failure_count bigint, tags array<string>"
    top = search(m.where("memory_type = 'Procedural'"), query, limit).select("id", F.from_json("content", kind).alias("p"))
    c = scoring.confidence(F.col("p.success_count"), F.col("p.failure_count"))
    return top.where("p is not null").select("id", "p.trigger", "p.action", c.alias("confidence")).where(F.col("confidence") > least)
