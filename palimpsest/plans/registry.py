"""The registered queries, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, scoring, text, vectors
from ..operators import embedding, graph, lifecycle, mining, retrieval, sequence, storage
from ..schema import DERIVED_SQL, document_memories, event_memories, now, read, vector_memories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Registers a query; its SQL may use the derived tables m, v and e."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if raw else f"WITH {DERIVED_SQL}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
        return f

    return add


M, V, E = document_memories, vector_memories, event_memories
T = "TIMESTAMP '2024-02-01 00:00:00'"
MICROS = f"(epoch_us({T}) - epoch_us({{}}))"
HOURS = lambda c: f"({MICROS.format(c)} // 3600000000)"
DAYS = lambda c: f"({MICROS.format(c)} // 86400000000)"
LN = "greatest(ln(access_count), 1.0)"
DECAY = f"greatest(0.1, exp(-0.1 * {HOURS('last_accessed')} / 24.0 / ({LN} * strength * CASE WHEN {DAYS('created_at')} > 7 THEN 1.2 ELSE 1.0 END)))"
RELEVANCE = f"0.5 * strength + 0.3 * exp(-{HOURS('last_accessed')} / 168.0) + 0.2 * ln(access_count) / 10"


def r6(c):
    return F.round(c, 6)


# Storage


def _changes(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = m.select("id", "content", r6("strength").alias("strength"))
    return old, old.where("cast(id as int) % 10 = 3").select("id", F.concat(F.lit("new "), F.substring("content", 1, 10)).alias("content"), F.lit(0.5).alias("strength"))


@query("s01_upsert", "SELECT id, CASE WHEN CAST(id AS INT) % 10 = 3 THEN 'new ' || substr(content, 1, 10) ELSE content END AS content, CASE WHEN CAST(id AS INT) % 10 = 3 THEN 0.5 ELSE round(strength, 6) END AS strength FROM m")
def _(s, d):
    return storage.upsert(*_changes(M(s, d)))


@query("s03_delete", "SELECT id FROM m WHERE CAST(id AS INT) % 10 <> 3")
def _(s, d):
    old, new = _changes(M(s, d))
    return storage.delete(old, new.select("id")).select("id")


@query("s04_search", "SELECT id, round(strength, 6) AS strength FROM m WHERE contains(lower(content), 'license') OR contains(lower(context), 'license') ORDER BY m.strength DESC, id LIMIT 20")
def _(s, d):
    return storage.search(M(s, d), "License", 20).select("id", r6("strength").alias("strength"))


@query("s06_recent", "SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM m ORDER BY m.created_at DESC, id LIMIT 15")
def _(s, d):
    return storage.recent(M(s, d), 15).select("id", F.col("created_at").cast("string").alias("created_at"))


@query("s07_time_range", "SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM m WHERE m.created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def _(s, d):
    return storage.in_range(M(s, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("id", F.col("created_at").cast("string").alias("created_at"))


@query("s08_by_tag", "SELECT id FROM m WHERE len(list_filter(tags, lambda t: contains(lower(t), 'rc1'))) > 0")
def _(s, d):
    return storage.by_tag(M(s, d), "RC1").select("id")


@query("s09_sql", "SELECT memory_type, count(*) AS n FROM m GROUP BY memory_type")
def _(s, d):
    return storage.run_sql(M(s, d), "SELECT memory_type, count(*) AS n FROM memories GROUP BY memory_type")


def _links(d: DataFrame) -> DataFrame:
    i = F.col("id").cast("int")
    return d.select("id", F.explode(F.array((i + 1).cast("string"), (i * 2).cast("string"))).alias("to_id")).select(F.col("id").alias("from_id"), "to_id").where("from_id <> to_id")


LINKS = "l AS (SELECT id AS from_id, unnest([CAST(CAST(id AS INT) + 1 AS VARCHAR), CAST(CAST(id AS INT) * 2 AS VARCHAR)]) AS to_id FROM m), k AS (SELECT * FROM l WHERE from_id <> to_id)"


@query("s11_associated", f"{LINKS} SELECT id, memory_type FROM m WHERE id IN (SELECT to_id FROM k WHERE from_id = '7')")
def _(s, d):
    m = M(s, d)
    return storage.associated(_links(m), m, "7").select("id", "memory_type")


@query("s12_decode_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, '') AS context, CASE WHEN doc_id % 5 = 0 THEN 'Procedural' ELSE 'Semantic' END AS memory_type, CAST(make_timestamp(1700000000000000 + doc_id * 1000000) AS VARCHAR) AS created_at, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(doc_id % 4 AS INT) END AS access_count, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END AS strength, CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [] END AS tags FROM documents WHERE doc_id % 7 <> 0")
def _(s, d):
    i = F.col("doc_id")
    rows = read(s, d, "documents").select(
        F.when(i % 7 != 0, i.cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("context"),
        F.when(i % 5 == 0, "Procedural").otherwise("?").alias("memory_type"),
        F.lit("Joy").alias("emotion"),
        (F.lit(1_700_000_000_000) + i * 1000).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("last_accessed"),
        F.when(i % 4 != 0, (i % 4).cast("string")).otherwise(F.lit("none")).alias("access_count"),
        F.when(i % 2 != 0, F.lit("0.5")).alias("strength"),
        F.when(i % 2 == 0, F.to_json(F.array("lang"))).alias("tags"),
    )
    return storage.decode_rows(rows).select("id", "content", "context", "memory_type", F.col("created_at").cast("string").alias("created_at"), "access_count", "strength", "tags")


@query("s15_get_many", "SELECT * FROM (SELECT id, pos, memory_type FROM m JOIN (VALUES (0, '5'), (1, '3'), (3, '100')) w(pos, k) ON m.id = w.k)")
def _(s, d):
    return storage.get_many(M(s, d), ["5", "3", "no", "100"]).select("id", "pos", "memory_type")


@query("s18_links_of", f"{LINKS} SELECT from_id, to_id FROM k WHERE from_id = '7'")
def _(s, d):
    return storage.links_of(_links(M(s, d)), "7")


@query("s28_from_metadata", "SELECT doc_id AS vec_id, text AS content, CASE WHEN doc_id % 2 = 0 THEN 'Semantic' ELSE 'Episodic' END AS memory_type, CASE WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1.0 END AS strength, 1 AS access_count, [lang, source] AS tags FROM documents")
def _(s, d):
    i = F.col("doc_id")
    md = F.create_map(F.lit("content"), F.col("text"), F.lit("type"), F.when(i % 2 == 0, "Semantic").otherwise("Working"), F.lit("tags"), F.concat(F.lit(" "), F.col("lang"), F.lit(" ,, "), F.col("source")))
    md = F.when(i % 3 == 0, F.map_concat(md, F.create_map(F.lit("strength"), F.lit("0.25")))).otherwise(md)
    return storage.from_metadata(read(s, d, "documents").select(i.alias("vec_id"), md.alias("metadata")))


@query("s29_vector_stats", "SELECT count(*) AS vectors, CAST(max(len(embedding)) AS BIGINT) AS dim FROM v")
def _(s, d):
    return storage.stats(V(s, d))


# Scores


@query(
    "p_scores",
    f"""SELECT id, round(exp(-{HOURS('last_accessed')} / 168.0), 6) AS recency, round({RELEVANCE}, 6) AS relevance, round({DECAY}, 6) AS decay, round(strength * {DECAY}, 6) AS decayed,
    round(greatest(1.0, -{LN} * strength * ln(0.7) / 0.1 * 24), 6) AS review_hours, {DECAY} < 0.7 AND strength > 0.3 AS needs_review, emotion <> 'Neutral' OR strength >= 0.6 OR access_count >= 3 AS consolidates,
    round(CASE WHEN emotion <> 'Neutral' THEN least(1.0, strength * 1.5) ELSE strength END, 6) AS felt, round(least(1.0, strength + 0.1), 6) AS accessed, strength < 0.1 AS forgotten FROM m""",
)
def _(s, d):
    m = M(s, d)
    a = [F.col(c) for c in ("strength", "access_count", "last_accessed", "created_at")]
    return m.select(
        "id",
        r6(scoring.recency(a[2], now())).alias("recency"),
        r6(scoring.relevance(a[0], a[2], a[1], now())).alias("relevance"),
        r6(scoring.decay(*a, now())).alias("decay"),
        r6(a[0] * scoring.decay(*a, now())).alias("decayed"),
        r6(scoring.review_hours(a[0], a[1])).alias("review_hours"),
        scoring.needs_review(*a, now()).alias("needs_review"),
        scoring.consolidates(F.col("emotion"), a[0], a[1]).alias("consolidates"),
        r6(scoring.felt(a[0], F.col("emotion"))).alias("felt"),
        r6(F.least(F.lit(1.0), a[0] + 0.1)).alias("accessed"),
        (a[0] < lifecycle.FORGOTTEN).alias("forgotten"),
    )


@query("p17_classify", "SELECT id, memory_type FROM m")
def _(s, d):
    return M(s, d).select("id", "memory_type")


KEYS = ", ".join(f"'{w}'" for w in text.KEY_STOP)
TRIM = r"regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')"
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


@query("p18_key_info", f"SELECT id, list_transform(list_filter(list_transform({WORDS.format('content')}, lambda x: {TRIM}), lambda w: strlen(w) > 4 AND lower(w) NOT IN ({KEYS})), lambda w: lower(w))[1:5] AS keys FROM m")
def _(s, d):
    return M(s, d).select("id", text.key_info(F.col("content")).alias("keys"))


@query("p21_fuzzy", r"SELECT id FROM m WHERE regexp_matches(lower(content), '(?s)z.*q.*x')")
def _(s, d):
    return M(s, d).where(text.fuzzy(F.col("content"), "ZqX")).select("id")


@query("p22_filters", r"SELECT id FROM m WHERE regexp_matches(content, '[0-9]{3}') AND len(list_filter(tags, lambda t: contains(lower(t), 'en'))) > 0 AND memory_type = 'Semantic' ORDER BY strength DESC, id LIMIT 25")
def _(s, d):
    return retrieval.filtered(M(s, d), 25, regex="[0-9]{3}", tag="en", kind="Semantic").select("id")


@query(
    "p24_list",
    "SELECT * FROM (SELECT id, memory_type FROM m WHERE memory_type = 'Semantic' ORDER BY strength DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, memory_type FROM m WHERE memory_type = 'Episodic' ORDER BY created_at DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, memory_type FROM m WHERE memory_type = 'Procedural' ORDER BY strength DESC, id LIMIT 10)",
)
def _(s, d):
    return retrieval.list_memories(M(s, d), 10).select("id", "memory_type")


@query("p25_show", f"{LINKS} SELECT m.id, m.content, k.to_id, o.content AS linked FROM m LEFT JOIN k ON k.from_id = m.id LEFT JOIN m o ON o.id = k.to_id WHERE starts_with(m.id, '12')")
def _(s, d):
    m = M(s, d)
    return retrieval.show(m, _links(m), "12")


@query("p26_delete_prefix", "SELECT id FROM m WHERE NOT starts_with(id, '12')")
def _(s, d):
    return storage.delete_prefix(M(s, d), "12").select("id")


@query("p27_truncate", "SELECT id, CASE WHEN length(content) > 20 THEN substr(content, 1, 20) || '...' ELSE content END AS short FROM m")
def _(s, d):
    return M(s, d).select("id", text.truncate(F.col("content"), 20).alias("short"))


@query("p28_set_strength", "f AS (SELECT id FROM m WHERE starts_with(id, '3') ORDER BY CASE memory_type WHEN 'Episodic' THEN 0 WHEN 'Semantic' THEN 1 ELSE 2 END, id LIMIT 1) SELECT id, CASE WHEN id IN (FROM f) THEN 1.0 ELSE round(strength, 6) END AS strength FROM m")
def _(s, d):
    return storage.set_strength(M(s, d), "3", 1.7).select("id", r6("strength").alias("strength"))


@query("p31_visual_decay", "SELECT id, round(greatest(0.0, strength - 0.05 * (1 - 0.3 * abs(access_count / 5.0 - 1)) * (1 / (1 + 0.1 * access_count))), 6) AS strength FROM v")
def _(s, d):
    v = V(s, d).withColumn("valence", F.col("access_count") / 5.0 - 1).withColumn("recall_count", F.col("access_count"))
    return lifecycle.visual_forget(v, 0.05).select("id", r6("strength").alias("strength"))


@query("p34_confidence", "SELECT id, CASE WHEN a + b = 0 THEN 0.5 ELSE round(CAST(a AS DOUBLE) / (a + b), 6) END AS confidence FROM (SELECT id, CAST(id AS INT) % 4 AS a, CAST(id AS INT) % 3 AS b FROM m)")
def _(s, d):
    i = F.col("id").cast("int")
    return M(s, d).select("id", r6(scoring.confidence(i % 4, i % 3)).alias("confidence"))


# Retrieval

TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) >= 2)"
POSTINGS = f"p AS (SELECT id, unnest(list_distinct({TERMS.format('content')})) AS term FROM m)"
QUERY = "the license that the program of en"
QTERMS = f"q AS (SELECT unnest({TERMS.format(chr(39) + QUERY + chr(39))}) AS term)"


@query("r06_postings", f"{POSTINGS} SELECT term, count(*) AS df FROM p GROUP BY term")
def _(s, d):
    return retrieval.postings(M(s, d)).groupBy("term").agg(F.count("*").alias("df"))


@query("r08_search_and", f"{POSTINGS} SELECT id FROM p WHERE term IN ('the', 'of', 'in') GROUP BY id HAVING count(*) = 3")
def _(s, d):
    return retrieval.search_and(M(s, d), "the of in the")


@query("r09_search_or", f"{POSTINGS} SELECT DISTINCT id FROM p WHERE term IN ('license', 'version', 'token')")
def _(s, d):
    return retrieval.search_or(M(s, d), "license version token")


@query("r10_search_ranked", f"{POSTINGS}, {QTERMS} SELECT id, count(*) AS score FROM p JOIN q USING (term) GROUP BY id ORDER BY score DESC, id LIMIT 30")
def _(s, d):
    return retrieval.search_ranked(M(s, d), QUERY, 30)


@query("r13_index_stats", f"{POSTINGS} SELECT count(DISTINCT term) AS terms, count(DISTINCT id) AS docs, round(count(*) / CAST(count(DISTINCT id) AS DOUBLE), 6) AS avg_terms FROM p")
def _(s, d):
    return retrieval.index_stats(M(s, d)).withColumn("avg_terms", r6("avg_terms"))


@query("r14_contains_keyword", f"{POSTINGS} SELECT bool_or(term = 'license') AS found FROM p")
def _(s, d):
    return retrieval.contains_keyword(M(s, d), "License")


def _vector(s: SparkSession, d: str, i: int = 0) -> list[float]:
    return list(read(s, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"])


COS = "list_cosine_similarity({}, {})"
WITH_Q = "q AS (SELECT embedding AS x FROM v WHERE id = '0'), c AS (SELECT v.*, list_cosine_similarity(embedding, x) AS sim FROM v, q)"


@query("r03_semantic_search", f"{WITH_Q}, t AS (SELECT * FROM c ORDER BY strength DESC, id LIMIT 1000) SELECT id, round(sim, 6) AS similarity FROM t WHERE sim > 0.05 ORDER BY sim DESC, id LIMIT 10")
def semantic_search(s, d):
    return retrieval.semantic_search(V(s, d), _vector(s, d), among=1000).select("id", r6("similarity").alias("similarity"))


@query("r04_related", f"{WITH_Q}, t AS (SELECT * FROM (SELECT * FROM c WHERE CAST(id AS INT) % 2 = 0 ORDER BY strength DESC, id LIMIT 100) UNION ALL SELECT * FROM (SELECT * FROM c WHERE CAST(id AS INT) % 2 = 1 ORDER BY strength DESC, id LIMIT 50)) SELECT id, round(sim, 6) AS similarity FROM t WHERE sim > 0.1 ORDER BY sim DESC, id LIMIT 5")
def _(s, d):
    v = V(s, d)
    i = F.col("id").cast("int") % 2
    return retrieval.related([(v.where(i == 0), 100), (v.where(i == 1), 50)], _vector(s, d), 0.1).select("id", r6("similarity").alias("similarity"))


@query("r17_vector_functions", "q AS (SELECT embedding AS x FROM v WHERE id = '1') SELECT id, round(list_cosine_similarity(embedding, x), 6) AS cos, round(list_inner_product(embedding, x), 6) AS dot, round(sqrt(list_inner_product(embedding, embedding)), 6) AS norm FROM v, q")
def _(s, d):
    q = F.array(*map(F.lit, _vector(s, d, 1)))
    e = F.col("embedding")
    return V(s, d).select("id", r6(vectors.cosine(e, q)).alias("cos"), r6(vectors.dot(e, q)).alias("dot"), r6(vectors.norm(e)).alias("norm"))


@query("r20_batch_similarity", f"{WITH_Q} SELECT id, round(sim, 6) AS similarity FROM c")
def _(s, d):
    return vectors.with_cosine(V(s, d), _vector(s, d)).select("id", r6("similarity").alias("similarity"))


@query("r25_nearest_all", f"{WITH_Q} SELECT id, round(sim, 6) AS similarity FROM c ORDER BY sim DESC, id LIMIT 10")
def _(s, d):
    return retrieval.top_similar(V(s, d), _vector(s, d), 10).select("id", r6("similarity").alias("similarity"))


@query("r32_recall_reinforcing", f"{WITH_Q} SELECT id, round(least(1.0, strength + 0.1), 6) AS strength, round(sim * least(1.0, strength + 0.1), 6) AS score FROM c WHERE sim > 0.1 ORDER BY sim * least(1.0, strength + 0.1) DESC, id LIMIT 5")
def _(s, d):
    return retrieval.recall_reinforcing(V(s, d), _vector(s, d))[0].select("id", r6("strength").alias("strength"), r6("score").alias("score"))


RECALL = f"""
{POSTINGS}, q AS (SELECT unnest(['license', 'version', 'license']) AS term),
k AS (SELECT p.id FROM p JOIN q USING (term) JOIN m ON m.id = p.id AND memory_type = 'Semantic' GROUP BY p.id ORDER BY count(*) DESC, p.id LIMIT 20),
s AS (SELECT * FROM m WHERE memory_type = 'Semantic'),
a AS (SELECT * FROM s ORDER BY strength DESC, id LIMIT 1000),
f AS (SELECT * FROM s WHERE contains(lower(content), 'license version license') ORDER BY strength DESC, id LIMIT 10),
u AS (SELECT * FROM a WHERE id IN (FROM k)),
n AS (SELECT (SELECT count(*) FROM u) < 10 AS few),
w AS (SELECT * FROM (SELECT * FROM m WHERE memory_type = 'Episodic' AND contains(lower(content), 'license') ORDER BY strength DESC, id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT * FROM s WHERE contains(lower(content), 'license') ORDER BY strength DESC, id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT * FROM m WHERE memory_type = 'Episodic' AND contains(lower(content), 'version') ORDER BY strength DESC, id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT * FROM s WHERE contains(lower(content), 'version') ORDER BY strength DESC, id LIMIT 10)),
z AS (SELECT DISTINCT ON (id) * FROM (SELECT * FROM u UNION ALL SELECT * FROM f UNION ALL SELECT * FROM w WHERE (SELECT few FROM n))),
d AS (SELECT * REPLACE (strength * {DECAY} AS strength) FROM z),
o AS (SELECT *, {RELEVANCE} AS score FROM d)
SELECT id, round(strength, 6) AS strength, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY content ORDER BY score DESC, id) = 1 ORDER BY o.score DESC, id LIMIT 10
"""


@query("r02_recall", RECALL)
def _(s, d):
    return retrieval.recall(M(s, d), "license version license", now(), 10).select("id", r6("strength").alias("strength"), r6("score").alias("score"))


@query("r44_patterns", "SELECT id, 'when ' || CAST(CAST(id AS INT) % 5 AS VARCHAR) AS trigger, round(CASE WHEN a + b = 0 THEN 0.5 ELSE CAST(a AS DOUBLE) / (a + b) END, 6) AS confidence FROM (SELECT id, strength, CAST(id AS INT) % 4 AS a, CAST(id AS INT) % 7 AS b FROM v ORDER BY strength DESC, id LIMIT 40) WHERE CASE WHEN a + b = 0 THEN 0.5 ELSE CAST(a AS DOUBLE) / (a + b) END > 0.3")
def _(s, d):
    i = F.col("id").cast("int")
    p = F.to_json(F.struct(F.concat(F.lit("when "), (i % 5).cast("string")).alias("trigger"), F.lit("act").alias("action"), (i % 4).alias("success_count"), (i % 7).alias("failure_count"), F.array().cast("array<string>").alias("tags")))
    m = V(s, d).withColumn("content", p).withColumn("memory_type", F.lit("Procedural")).withColumn("context", F.lit(None).cast("string"))
    return retrieval.patterns_like(m, "trigger", 40).select("id", "trigger", r6("confidence").alias("confidence"))


# Joins on similarity

PAIRS = "x AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding, b.embedding) AS s FROM v a JOIN v b ON a.id < b.id)"


@query("j03_similar_pairs", f"{PAIRS} SELECT a, b, round(s, 6) AS similarity FROM x WHERE s > 0.3")
def _(s, d):
    return vectors.similarity_pairs(V(s, d), 0.3, strict=True).withColumn("similarity", r6("similarity"))


@query("j05_bisociations", f"{PAIRS} SELECT count(*) AS n FROM x WHERE s > 0.3 AND s < 0.7")
def _(s, d):
    return mining.bisociations(vectors.similarity_pairs(V(s, d), 0.3, strict=True))


@query("j08_auto_link", f"{PAIRS}, y AS (SELECT a AS id, b AS other, s FROM x WHERE s > 0.3 UNION ALL SELECT b, a, s FROM x WHERE s > 0.3) SELECT id, other, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS INT) AS rank FROM y QUALIFY rank <= 4")
def _(s, d):
    v = V(s, d)
    return retrieval.nearest(v, vectors.similarity_pairs(v, 0.3, strict=True), 4).select("id", "other", r6("similarity").alias("similarity"), "rank")


# Mining


@query("a01_store_stats", "SELECT memory_type, count(*) AS n, round(avg(strength), 6) AS avg_strength, CAST(min(created_at) AS VARCHAR) AS first, CAST(max(created_at) AS VARCHAR) AS last FROM m GROUP BY memory_type")
def _(s, d):
    return mining.store_stats(M(s, d)).withColumns({"avg_strength": r6("avg_strength"), "first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


TOP = "t AS (SELECT * FROM m ORDER BY strength DESC, id LIMIT 1000)"


@query("a03_hour_pattern", f"{TOP} SELECT CAST(hour(created_at) AS INT) AS value, count(*) AS n FROM t GROUP BY 1 HAVING n >= 5 ORDER BY n DESC, value LIMIT 1")
def _(s, d):
    return mining.hour_pattern(mining.pool(M(s, d), 1000))


@query("a04_weekday_pattern", f"{TOP} SELECT CAST((dayofweek(created_at) + 6) % 7 AS INT) AS value, count(*) AS n FROM t GROUP BY 1 HAVING n >= 5 ORDER BY n DESC, value LIMIT 1")
def _(s, d):
    return mining.weekday_pattern(mining.pool(M(s, d), 1000))


@query(
    "a05_tag_patterns",
    f"""{TOP}, g AS (SELECT id, content, unnest(tags) AS tag FROM t), b AS (SELECT tag, count(*) AS n FROM g GROUP BY tag HAVING count(*) >= 3 ORDER BY n DESC, tag LIMIT 3),
    f AS (SELECT tag, id, CASE WHEN length(content) > 30 THEN substr(content, 1, 30) || '...' ELSE content END AS c, row_number() OVER (PARTITION BY tag ORDER BY id) AS r FROM g WHERE tag IN (SELECT tag FROM b) QUALIFY r <= 3)
    SELECT tag, n, (SELECT list(c ORDER BY r) FROM f WHERE f.tag = b.tag) AS examples FROM b""",
)
def _(s, d):
    return mining.tag_patterns(mining.pool(M(s, d), 1000))


PSTOP = ", ".join(f"'{w}'" for w in text.PATTERN_STOP)


@query("a06_word_pattern", f"{TOP}, w AS (SELECT unnest(list_transform({WORDS.format('lower(content)')}, lambda x: {TRIM})) AS value FROM t) SELECT value, count(*) AS n FROM w WHERE strlen(value) > 2 AND value NOT IN ({PSTOP}) GROUP BY value HAVING n >= 5 ORDER BY n DESC, value LIMIT 1")
def _(s, d):
    return mining.word_pattern(mining.pool(M(s, d), 1000))


TOPIC = f"w AS (SELECT unnest({WORDS.format('lower(content)')}) AS value FROM t), c AS (SELECT value, count(*) AS n FROM w WHERE strlen(value) > 3 GROUP BY value HAVING n >= 5 ORDER BY n DESC, value LIMIT 1)"


@query("a07_topic", f"{TOP}, {TOPIC} SELECT value, n, round(least(0.7, n / (SELECT count(*) FROM t)), 6) AS confidence FROM c")
def _(s, d):
    return mining.topic(mining.pool(M(s, d), 1000)).withColumn("confidence", r6("confidence"))


@query("a08_tag_at_hour", f"{TOP}, h AS (SELECT * FROM t WHERE hour(created_at) = 14), g AS (SELECT unnest(tags) AS value FROM h) SELECT value, count(*) AS n, round(least(0.9, count(*) / (SELECT count(*) FROM h)), 6) AS confidence FROM g GROUP BY value HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 1")
def _(s, d):
    return mining.tag_at_hour(mining.pool(M(s, d), 1000), 14).withColumn("confidence", r6("confidence"))


RISK = f"least(1.0, {DAYS('last_accessed')} / 30.0 * 0.4 + (1 - strength) * 0.4 + 1 / (access_count + 1.0) * 0.2)"


@query(
    "a11_alerts",
    f"k AS (SELECT id, strength, {DAYS('last_accessed')} AS days, CAST({RISK} AS DOUBLE) AS risk FROM m), u AS (SELECT *, CASE WHEN risk > 0.7 THEN 'High' WHEN risk > 0.5 THEN 'Medium' ELSE 'Low' END AS urgency FROM k WHERE risk > 0.3) SELECT id, round(strength, 6) AS strength, days, round(risk, 6) AS risk, urgency FROM u ORDER BY CASE urgency WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, u.strength DESC, id LIMIT 40",
)
def _(s, d):
    return mining.alerts(M(s, d), now(), 40).select("id", r6("strength").alias("strength"), "days", r6("risk").alias("risk"), "urgency")


@query("a14_concept", f"e2 AS (SELECT * FROM m WHERE tags[1] = 'en'), w AS (SELECT unnest(list_distinct(list_filter({WORDS.format('lower(content)')}, lambda x: strlen(x) > 3))) AS word FROM e2), c AS (SELECT word, count(*) AS df FROM w GROUP BY word HAVING df >= greatest((SELECT count(*) // 2 FROM e2), 2) ORDER BY df DESC, word LIMIT 3) SELECT string_agg(word, '_' ORDER BY df DESC, word) AS name FROM c")
def _(s, d):
    return mining.concept(M(s, d).where("tags[0] = 'en'"))


@query("a15_jaccard", f"w AS (SELECT id, list_distinct({WORDS.format('lower(content)')}) AS w FROM m WHERE CAST(id AS INT) < 60) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE), 6) AS similarity FROM w a JOIN w b ON a.id < b.id")
def _(s, d):
    m = M(s, d).where("cast(id as int) < 60")
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), r6(text.jaccard(F.col("a.content"), F.col("b.content"))).alias("similarity"))


@query("a16_tag_rarity", "t AS (SELECT id, unnest(tags) AS tag FROM m), n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag) SELECT id, round(avg(1 - least(1.0, n / (SELECT count(*) FROM m))), 6) AS rarity FROM t JOIN n USING (tag) GROUP BY id")
def _(s, d):
    return mining.tag_rarity(M(s, d)).withColumn("rarity", r6("rarity"))


@query("a18_importance", "t AS (SELECT id, unnest(tags) AS tag FROM m), n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag), r AS (SELECT id, avg(1 - least(1.0, n / (SELECT count(*) FROM m))) AS rarity FROM t JOIN n USING (tag) GROUP BY id) SELECT id, round(least(1.0, greatest(0.3, 0.5 + 0.25 * 1.0 + 0.2 * abs(access_count / 5.0 - 1) + 0.05 * rarity)), 6) AS importance FROM m JOIN r USING (id)")
def _(s, d):
    m = M(s, d)
    return m.join(mining.tag_rarity(m), "id").select("id", r6(scoring.importance(F.lit(1.0), F.col("access_count") / 5.0 - 1, F.col("rarity"))).alias("importance"))


@query("a20_insights", f"SELECT count(*) AS memories, count(*) FILTER (access_count > 2 OR strength > 0.8) AS strengthened, count(*) FILTER (strength < 0.3 AND access_count < 2 AND created_at < {T} - INTERVAL 7 DAY) AS faded, count(*) FILTER (created_at > {T} - INTERVAL 6 HOUR) AS last_6h, (SELECT tag FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag HAVING count(*) >= 3 ORDER BY count(*) DESC, tag LIMIT 1) AS top_tag, (SELECT count(*) FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag HAVING count(*) >= 3 ORDER BY count(*) DESC, tag LIMIT 1) AS top_n FROM m")
def _(s, d):
    return mining.insights(M(s, d), now())


def _log(s: SparkSession, d: str) -> DataFrame:
    """Events as an audit log: written as lines, and read again."""
    op = F.expr("case event_type when 'view' then 'RECALL' when 'signup' then 'STORE' when 'purchase' then 'SEARCH' else 'SLEEP' end")
    lines = read(s, d, "events").select(mining.audit_line(F.col("ts").cast("timestamp"), op, F.col("props"), F.array("event_type"), F.lit("ok")).alias("value"))
    return mining.parse_audit(lines)


OPS = "o AS (SELECT date_trunc('second', CAST(ts AS TIMESTAMP)) AS t_at, CASE event_type WHEN 'view' THEN 'RECALL' WHEN 'signup' THEN 'STORE' WHEN 'purchase' THEN 'SEARCH' ELSE 'SLEEP' END AS op FROM events)"
COUNTS = ", ".join(f"count(*) FILTER (op = '{x}') AS {x.lower()}" for x in ("STORE", "RECALL", "SEARCH"))


@query("a25_daily_ops", f"{OPS} SELECT CAST(CAST(t_at AS DATE) AS VARCHAR) AS day, {COUNTS} FROM o GROUP BY 1")
def _(s, d):
    return mining.daily_ops(_log(s, d)).withColumn("day", F.col("day").cast("string"))


@query("a27_weekly_ops", f"{OPS}, y AS (SELECT CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, {COUNTS} FROM y LEFT JOIN o ON CAST(t_at AS DATE) = y.day GROUP BY y.day")
def _(s, d):
    return mining.weekly_ops(_log(s, d), "2024-02-02").withColumn("day", F.col("day").cast("string"))


@query("a29_op_shares", f"{OPS} SELECT op, count(*) AS n, CAST(count(*) * 100 // (SELECT count(*) FROM o) AS BIGINT) AS percent FROM o GROUP BY op")
def _(s, d):
    return mining.op_shares(_log(s, d))


@query("a30_timeline", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, list(substr(content, 1, 120) ORDER BY created_at, id) AS previews FROM m GROUP BY 1")
def _(s, d):
    return mining.timeline(M(s, d)).withColumn("day", F.col("day").cast("string"))


@query("a33_compression", "SELECT count(*) AS items, CAST(sum(len(embedding) * 4) AS BIGINT) AS original, CAST(sum(len(embedding) + 8) AS BIGINT) AS compressed, round(sum(len(embedding) * 4) / sum(len(embedding) + 8), 6) AS ratio, round((1 - sum(len(embedding) + 8) / sum(len(embedding) * 4)) * 100, 6) AS savings FROM v")
def _(s, d):
    o, c = codec.sizes(F.col("embedding"))
    row = V(s, d).agg(F.count("*").alias("items"), F.sum(o).alias("original"), F.sum(c).alias("compressed"))
    return row.select("*", r6(F.col("original") / F.col("compressed")).alias("ratio"), r6((1 - F.col("compressed") / F.col("original")) * 100).alias("savings"))


# Sequences

LAG = "g AS (SELECT user_id, id, created_at, tags, lag(id) OVER w AS pid, lag(created_at) OVER w AS pat, lag(tags) OVER w AS ptags FROM e WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)), h AS (SELECT *, (epoch_us(created_at) - epoch_us(pat)) // 1000000 AS gap, len(list_filter(ptags, lambda t: list_contains(tags, t))) / CAST(greatest(len(ptags), len(tags)) AS DOUBLE) AS alike FROM g WHERE pid IS NOT NULL)"


@query(
    "w01_replay",
    f"{LAG.replace('FROM e WINDOW', f'FROM (SELECT * FROM e WHERE created_at > {T} - INTERVAL 240 HOUR) WINDOW')}, r AS (SELECT *, 0.4 / (1 + abs(gap) / 3600.0) + 0.2 * alike AS s FROM h) SELECT user_id, pid AS from_id, id AS to_id, round(s, 6) AS replay_strength, round(s * 0.05, 6) AS boost, false AS new_connection FROM r WHERE s > 0.2",
)
def _(s, d):
    x = sequence.replay(E(s, d), now(), 240, ["user_id"])
    return x.withColumn("replay_strength", r6("replay_strength")).withColumn("boost", r6("boost"))


def _chain_sql(minutes: int) -> str:
    return f"{LAG} SELECT user_id, CAST(sum(CASE WHEN gap // 60 > {minutes} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id) AS BIGINT) AS chain, pid AS from_id, id AS to_id, gap AS gap_seconds, round(alike, 6) AS similarity FROM h"


@query("w02_chains_hour", _chain_sql(60))
def _(s, d):
    return sequence.chains(E(s, d), 60, ["user_id"]).withColumn("similarity", r6("similarity"))


@query("w02_chains_day", _chain_sql(1440))
def _(s, d):
    return sequence.chains(E(s, d), 1440, ["user_id"]).withColumn("similarity", r6("similarity"))


@query("w03_context", "n AS (SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS INT) AS pos FROM e), c AS (SELECT user_id, pos AS mid FROM n WHERE id = '500') SELECT n.user_id, id, pos FROM n JOIN c USING (user_id) WHERE pos BETWEEN mid - 3 AND mid + 3")
def _(s, d):
    return sequence.context(E(s, d), "500", 3, ["user_id"])


@query("w05_transitions", "g AS (SELECT tags, lead(tags) OVER (PARTITION BY user_id ORDER BY created_at, id) AS nx FROM e), x AS (SELECT unnest(tags) AS tag, nx FROM g WHERE nx IS NOT NULL), y AS (SELECT tag, unnest(nx) AS next_tag FROM x) SELECT tag, next_tag, count(*) AS n FROM y WHERE tag <> next_tag GROUP BY tag, next_tag")
def _(s, d):
    return mining.transitions(E(s, d), "user_id")


@query("w05_next_tags", "g AS (SELECT tags, lead(tags) OVER (PARTITION BY user_id ORDER BY created_at, id) AS nx FROM e), x AS (SELECT unnest(tags) AS tag, nx FROM g WHERE nx IS NOT NULL), y AS (SELECT tag, unnest(nx) AS next_tag FROM x), z AS (SELECT tag, next_tag, count(*) AS n FROM y WHERE tag <> next_tag GROUP BY tag, next_tag), l AS (SELECT DISTINCT unnest(tags) AS tag FROM (SELECT * FROM e ORDER BY created_at DESC, id DESC LIMIT 1)) SELECT tag, next_tag, n, round(least(0.8, n / 10.0), 6) AS confidence FROM z JOIN l USING (tag) WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY n DESC, next_tag) = 1")
def _(s, d):
    return mining.next_tags(E(s, d), "user_id").withColumn("confidence", r6("confidence"))


@query("w06_working", "SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS pos FROM e QUALIFY pos <= 7")
def _(s, d):
    return sequence.working(E(s, d), ["user_id"]).select("user_id", "id", "pos")


@query("w08_rehearse", "SELECT id, round(CASE WHEN contains(content, 'License') THEN least(1.0, strength + 0.1) ELSE strength END, 6) AS strength, CASE WHEN contains(content, 'License') THEN access_count + 1 ELSE access_count END AS access_count FROM m")
def _(s, d):
    return sequence.rehearse(M(s, d), "License", now()).select("id", r6("strength").alias("strength"), "access_count")


@query("w11_snapshots", "s AS (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (memory_type = 'Episodic') AS episodic, count(*) FILTER (memory_type = 'Semantic') AS semantic FROM m GROUP BY 1) SELECT day, episodic - lag(episodic, 1, 0) OVER (ORDER BY day) AS episodic, semantic - lag(semantic, 1, 0) OVER (ORDER BY day) AS semantic FROM s")
def _(s, d):
    snaps = M(s, d).groupBy(F.to_date("created_at").alias("at")).agg(F.count_if(F.col("memory_type") == "Episodic").alias("episodic"), F.count_if(F.col("memory_type") == "Semantic").alias("semantic"))
    return sequence.snapshot_changes(snaps).select(F.col("at").cast("string").alias("day"), "episodic", "semantic")


# Graphs

NODES = "t AS (SELECT *, row_number() OVER (ORDER BY strength DESC, id) AS pos FROM v QUALIFY pos <= 100), f AS (SELECT tags[1] AS tag, min(pos) AS first FROM t GROUP BY 1), g AS (SELECT tag, row_number() OVER (ORDER BY first) - 1 AS grp FROM f)"


@query("g01_nodes", f"{NODES} SELECT id, content AS label, CAST(grp AS INT) AS \"group\", round(least(20.0, strength * 10 + 5), 6) AS size FROM t JOIN g ON tags[1] = tag")
def _(s, d):
    return graph.nodes(V(s, d), 100).select("id", "label", "group", r6("size").alias("size"))


@query("g01_edges", f"{NODES} SELECT a.id AS source, b.id AS target, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS weight FROM t a JOIN t b ON a.id < b.id WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.25")
def _(s, d):
    return graph.edges(graph.nodes(V(s, d), 100), 0.25).withColumn("weight", r6("weight"))


@query("g07_constellation", f"{NODES.replace('pos <= 100', 'pos <= 500')} SELECT id, content AS label, CAST(grp AS INT) AS cluster, true AS placed FROM t JOIN g ON tags[1] = tag")
def _(s, d):
    c = graph.constellation(V(s, d), 500)
    return c.select("id", "label", "cluster", (F.abs("x") + F.abs("y") > 0).alias("placed"))


@query("g12_relations", "r AS (SELECT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey % 50 AS VARCHAR) AS target, l_discount AS strength FROM lineitem) SELECT source, target, round(least(1.0, sum(strength)), 6) AS strength FROM r GROUP BY source, target")
def _(s, d):
    r = read(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source"), (F.col("l_partkey") % 50).cast("string").alias("target"), F.col("l_discount").alias("strength"))
    return graph.add_relations(r).withColumn("strength", r6("strength"))


# Embeddings

ESTOP = ", ".join(f"'{w}'" for w in text.EMBED_STOP)
TOKENS = rf"list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}'']+'), lambda x: strlen(x) > 2 AND x NOT IN ({ESTOP}))"
DJB2 = "list_reduce([CAST(5381 AS BIGINT)] || list_transform(range(1, length(hex({0})), 2), lambda i: CAST('0x' || substr(hex({0}), i, 2) AS BIGINT)), lambda a, x: (a * 33 + x) % 4294967296)"


@query("f03_djb2", f"t AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM m) SELECT token, CAST({DJB2.format('token')} AS BIGINT) AS hash FROM t")
def _(s, d):
    t = M(s, d).select(F.explode(text.embed_tokens(F.col("content"))).alias("token")).distinct()
    return t.select("token", text.djb2(F.col("token")).alias("hash"))


HASHED = f"t AS (SELECT id, unnest({TOKENS}) AS token FROM m), w AS (SELECT token, CAST({DJB2.format('token')} AS BIGINT) AS h FROM (SELECT DISTINCT token FROM t)), c AS (SELECT id, h % 64 AS idx, sum(CASE WHEN (h >> 16) & 1 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM t JOIN w USING (token) GROUP BY id, h % 64), n AS (SELECT id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM c GROUP BY id)"


@query("f05_hash_embed", f"{HASHED}, g AS (SELECT m.id, i AS idx FROM m, range(64) r(i)) SELECT g.id, CAST(g.idx AS INT) AS idx, round(coalesce(CASE WHEN norm > 0 THEN CAST(x AS DOUBLE) / norm ELSE 0.0 END, 0.0), 6) AS x FROM g LEFT JOIN c ON c.id = g.id AND c.idx = g.idx LEFT JOIN n ON n.id = g.id")
def _(s, d):
    return embedding.hash_embed(M(s, d), 64).select("id", F.posexplode("embedding").alias("idx", "x")).withColumn("x", r6("x") + 0.0)


VOCAB = f"t AS (SELECT id, unnest({TOKENS}) AS word FROM m), o AS (SELECT word, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY word ORDER BY n DESC, word LIMIT 100), v2 AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS INT) AS idx, ln((SELECT count(*) FROM m) / CAST(df AS DOUBLE)) + 1 AS idf FROM o)"


@query("f06_vocabulary", f"{VOCAB} SELECT word, idx, round(idf, 6) AS idf FROM v2")
def _(s, d):
    return embedding.vocabulary(M(s, d), 100).withColumn("idf", r6("idf"))


@query("f08_tfidf", f"{VOCAB}, a AS (SELECT id, count(*) AS total FROM t GROUP BY id), b AS (SELECT id, word, count(*) AS n FROM t GROUP BY id, word), c AS (SELECT id, idx, n / CAST(total AS DOUBLE) * idf AS x FROM b JOIN v2 USING (word) JOIN a USING (id)), z AS (SELECT id, sqrt(sum(x * x)) AS norm FROM c GROUP BY id) SELECT id, idx, round(x / norm, 6) AS x FROM c JOIN z USING (id)")
def _(s, d):
    m = M(s, d)
    return embedding.tfidf_embed(m, embedding.vocabulary(m, 100), 100).select("id", F.posexplode("embedding").alias("idx", "x")).where("x <> 0").withColumn("x", r6("x"))


@query(
    "f25_quantise",
    "b AS (SELECT id, embedding AS x, list_min(embedding) AS lo, list_max(embedding) - list_min(embedding) AS span FROM v), q AS (SELECT id, lo, CASE WHEN span = 0 THEN 1.0 ELSE span / 255.0 END AS scale, x FROM b) SELECT id, list_transform(x, lambda y: CAST(least(127.0, greatest(-128.0, round((y - lo) / scale) - 128)) AS TINYINT)) AS data, round(scale, 9) AS scale, round(lo, 6) AS zero_point FROM q",
)
def _(s, d):
    return V(s, d).select("id", codec.quantise(F.col("embedding")).alias("q")).select("id", "q.data", F.round("q.scale", 9).alias("scale"), r6("q.zero_point").alias("zero_point"))


# Sketches


# Lifecycle

SOFT = f"strength * ({DECAY} * 0.5 + 0.5)"


@query("t01_sleep", f"a AS (SELECT id, memory_type, CASE memory_type WHEN 'Episodic' THEN strength * {DECAY} WHEN 'Semantic' THEN {SOFT} ELSE strength END AS s FROM m) SELECT id, memory_type, round(s, 6) AS strength FROM a WHERE s >= 0.1 OR memory_type = 'Procedural' UNION ALL SELECT id, memory_type, round(strength, 6) FROM m WHERE CAST(id AS INT) < 7 AND strength >= 0.7")
def _(s, d):
    m = M(s, d)
    working = m.where("cast(id as int) < 7").withColumn("memory_type", F.lit("Working"))
    return lifecycle.sleep(m, working, now()).select("id", "memory_type", r6("strength").alias("strength"))


@query("t02_forget", f"SELECT id, round(strength * {DECAY}, 6) AS strength FROM m WHERE strength * {DECAY} >= 0.1")
def _(s, d):
    return lifecycle.forget(M(s, d), now()).select("id", r6("strength").alias("strength"))


@query("t04_decay_all", "SELECT id, round(strength * 0.4, 6) AS strength FROM m WHERE strength * 0.4 >= 0.1")
def _(s, d):
    return lifecycle.decay_all(M(s, d), 0.4).select("id", r6("strength").alias("strength"))


@query("t08_reinforce", "SELECT id, round(CASE WHEN memory_type = 'Semantic' THEN least(1.0, strength + 0.1) ELSE strength END, 6) AS strength, CASE WHEN memory_type = 'Semantic' THEN access_count + 1 ELSE access_count END AS access_count FROM m")
def _(s, d):
    m = M(s, d)
    return lifecycle.reinforce(m, m.where("memory_type = 'Semantic'").select("id"), 0.1, now()).select("id", r6("strength").alias("strength"), "access_count")


@query("t09_fade", f"f AS (SELECT id, strength * exp(-({MICROS.format('last_accessed')} // 60000000) / 60.0 * 0.02) AS s FROM m) SELECT id, round(s, 6) AS strength FROM f WHERE s >= 0.01")
def _(s, d):
    return lifecycle.fade(M(s, d), now(), 0.02).select("id", r6("strength").alias("strength"))


# Deduplication


@query("u01_store_or_access", "n AS (SELECT DISTINCT content AS c FROM m WHERE CAST(id AS INT) % 100 = 1), h AS (SELECT m.id, c, m.strength FROM m JOIN n ON contains(lower(m.content), lower(c)) OR contains(lower(m.context), lower(c))), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY c ORDER BY strength DESC, id) = 1), k AS (SELECT id, count(*) AS n FROM b GROUP BY id) SELECT id, round(least(1.0, strength + 0.1 * coalesce(n, 0)), 6) AS strength, CAST(access_count + coalesce(n, 0) AS INT) AS access_count FROM m LEFT JOIN k USING (id)")
def _(s, d):
    m = M(s, d)
    new = m.where("cast(id as int) % 100 = 1").select("content")
    return graph.store_or_access(m, new, now()).select("id", r6("strength").alias("strength"), "access_count")


@query("x09_facts", "SELECT DISTINCT conv_id, trim(regexp_replace(f, '^[-*•]+\\s*', '')) AS fact FROM (SELECT conv_id, unnest(['- remember ' || conv_id || ' well', '* star ' || role, 'no list', '• ' || turn]) AS f FROM conversations) WHERE regexp_matches(f, '^[-*•]') AND strlen(trim(regexp_replace(f, '^[-*•]+\\s*', ''))) > 5")
def _(s, d):
    c = read(s, d, "conversations")
    t = F.concat(F.lit("- remember "), F.col("conv_id").cast("string"), F.lit(" well\n* star "), F.col("role"), F.lit("\nno list\n• "), F.col("turn").cast("string"))
    return c.select("conv_id", F.explode(text.bullets(t)).alias("fact")).distinct()
