import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import chat
from palimpsest.operators import embedding, graph, lifecycle, mining, retrieval, sequence, sketch, storage
from palimpsest.schema import MEMORY, new_memories, now
from palimpsest.sources import files

from .conftest import DATA


@pytest.fixture(scope="module")
def m(spark):
    rows = [
        ("a", "the fox is quick", "Semantic", 0.9, [1.0, 0.0], ["x"], "2024-01-31 10:00:00"),
        ("b", "the fox is quick too", "Semantic", 0.8, [0.99, 0.05], ["x", "y"], "2024-01-31 10:30:00"),
        ("c", "never feed the fox", "Procedural", 0.7, [0.0, 1.0], [], "2024-01-31 12:00:00"),
        ("d", "met a fox today", "Episodic", 0.6, [0.02, 0.99], ["y"], "2024-01-31 12:10:00"),
        ("e", "plain", "Episodic", 0.05, None, ["z"], "2024-01-01 00:00:00"),
    ]
    d = spark.createDataFrame(rows, "id string, content string, memory_type string, strength double, embedding array<double>, tags array<string>, created_at string")
    at = F.col("created_at").cast("timestamp")
    return d.withColumns({"created_at": at, "last_accessed": at, "access_count": F.lit(2), "context": F.lit(None).cast("string"), "emotion": F.lit("Neutral")})


def ids(d, c="id"):
    return [r[c] for r in d.collect()]


def test_new_memories(spark):
    n = new_memories(spark.createDataFrame([("hello",)], "content string"))
    assert n.schema.names == MEMORY.names
    r = n.first()
    assert (r.memory_type, r.emotion, r.access_count, r.strength) == ("Working", "Neutral", 1, 1.0)


def test_index(m):
    assert ids(retrieval.search_and(m, "fox quick")) == ["a", "b"]
    assert sorted(ids(retrieval.search_or(m, "quick today"))) == ["a", "b", "d"]
    assert [tuple(r) for r in retrieval.search_ranked(m, "fox fox quick", 2).collect()] == [("a", 3), ("b", 3)]
    assert retrieval.search_or(m, "").count() == 0 == retrieval.search_and(m, "!").count()
    assert retrieval.search_or(m.limit(0), "fox").count() == 0


def test_recall_prefers_the_best_and_dedups(m):
    twice = m.unionByName(m.where("id = 'a'").withColumn("id", F.lit("z")))
    got = retrieval.recall(twice, "quick fox", now(), 10, vector=[1.0, 0.0]).collect()
    assert [r.id for r in got][0] == "a" and len({r.content for r in got}) == len(got)
    assert retrieval.recall(m, "nothing at all", now()).count() == 0


def test_regex_errors_are_errors(m):
    with pytest.raises(Exception):
        retrieval.filtered(m, 5, regex="(").collect()


def test_vector_search_skips_other_sizes(m):
    assert ids(retrieval.top_similar(m, [1.0, 0.0], 2)) == ["a", "b"]
    assert ids(retrieval.top_similar(m, [1.0, 0.0, 0.0], 2, threshold=0.0)) == []


def greedy(x, strength, threshold, least):
    order = sorted(x, key=lambda i: (-strength[i], i))
    taken, out = set(), []
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for k, i in enumerate(order):
        if i in taken:
            continue
        own = [j for j in order[k + 1 :] if j not in taken and cos(x[i], x[j]) >= threshold]
        taken.update(own)
        if own and len(own) >= least - 1:
            taken.add(i)
            out.append({i, *own})
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_clusters_are_greedy(spark, least):
    rng = np.random.default_rng(4)
    x = {f"{i:03}": rng.normal(size=3) for i in range(60)}
    strength = {i: float(rng.random()) for i in x}
    d = spark.createDataFrame([(i, v.tolist(), strength[i], "2024-01-01 00:00:00", "c", ["t" + i]) for i, v in x.items()], "id string, embedding array<double>, strength double, created_at string, content string, tags array<string>").withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = graph.clusters(d, 0.9, least)
    got = {}
    for r in found.collect():
        got.setdefault(r.primary_id, {r.primary_id}).add(r.member_id)
    want = greedy(x, strength, 0.9, least)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    merged = graph.merge(d, found)
    assert merged.count() == 60 - sum(len(g) - 1 for g in want)
    some = max(want, key=len)
    tags = {r.id: set(r.tags) for r in merged.collect()}
    assert {"t" + i for i in some} == tags[next(i for i in some if i in tags)]
    assert graph.merge_stats(found, d).first().mergeable == sum(len(g) - 1 for g in want)


def test_projection(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * [9, 4, 1, 1, 1, 1]
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, [1.0]), (1000, None)], "id bigint, embedding array<double>")
    got = {r.id: (r.x, r.y) for r in graph.project_2d(d).collect()}
    c = x - x.mean(axis=0)
    u = np.linalg.svd(c, full_matrices=False)[2]
    for k in (0, 1):
        a, b = np.array([got[i][k] for i in range(200)]), c @ u[k]
        assert abs(np.corrcoef(a, b)[0, 1]) > 0.999
    assert got[999] == got[1000] == (0.0, 0.0)


def test_graph_texts(m):
    n = graph.nodes(m, 10)
    e = graph.edges(n, 0.9)
    assert {(r.source, r.target) for r in e.collect()} == {("a", "b"), ("c", "d")}
    dot = graph.to_dot(n, e).first().dot
    assert '"a" -- "b"' in dot and dot.startswith("graph")
    assert "N0 --- N1" in graph.to_mermaid(n, e).first().mermaid
    assert '"links"' in graph.graph_json(n, e).first().json
    assert graph.nodes_json(n).count() == 5 and graph.edges_json(e).count() == 2
    assert [r.size for r in graph.nodes(m, 1, "fox").collect()] == [pytest.approx(0.9 * 12 + 8)]


def test_associate_falls_back_to_words(m):
    bare = m.withColumn("embedding", F.when(F.col("id").isin("a", "c"), F.col("embedding")))
    got = {(r.a, r.b): r.similarity for r in graph.associate(bare, 0.3).collect()}
    assert got[("a", "b")] == pytest.approx(4 / 5) and ("b", "d") not in got


def test_chains(m):
    got = [(r.from_id, r.to_id, r.chain) for r in sequence.chains(m.drop("embedding"), 60).orderBy("chain", "to_id").collect()]
    assert got == [("e", "a", 1), ("a", "b", 1), ("b", "c", 2), ("c", "d", 2)]
    assert sequence.context(m, "zz", 2).count() == 0


def test_replay(m):
    boosts = sequence.replay(m, now(), 48)
    assert {(r.from_id, r.to_id) for r in boosts.collect()} >= {("a", "b"), ("c", "d")}
    after = {r.id: r.strength for r in sequence.replayed(m, boosts).collect()}
    assert after["a"] > 0.9 and after["e"] == 0.05


def test_working_memory(m):
    w = sequence.working(m, capacity=2)
    assert sorted(ids(w)) == ["c", "d"] and {r.memory_type for r in w.collect()} == {"Working"}


def test_storage(m, spark):
    new = spark.createDataFrame([("a", 0.1), ("n", 0.2)], "id string, strength double")
    got = {r.id: r.strength for r in storage.upsert(m.select("id", "strength"), new).collect()}
    assert got["a"] == 0.1 and got["n"] == 0.2 and len(got) == 6
    assert storage.search(m, "", 10).count() == 5 and ids(storage.search(m, "FOX", 2)) == ["a", "b"]
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "from_id string, to_id string")
    assert storage.both_ways(links).count() == 2
    assert {r.id: r.strength for r in storage.set_strength(m, "d", 3.0).collect()}["d"] == 1.0


def test_mining(m):
    assert mining.hour_pattern(m).count() == 0
    assert mining.concept(m).first().name is not None
    assert mining.concept(m.limit(0)).first().name is None
    assert mining.novelty(m, "fox").first().novelty == 0.5 and mining.novelty(m, "zebra").first().novelty == 1.0
    assert {r.id: r.rarity for r in mining.tag_rarity(m).collect()}["c"] == 0.5


def test_audit(spark):
    d = spark.range(1).select(mining.audit_line(now(), F.lit("STORE"), F.lit("x" * 60), F.array(F.lit("a"), F.lit("b")), F.lit("done")).alias("value"))
    r = mining.parse_audit(d.union(spark.createDataFrame([("junk",)], "value string"))).collect()
    assert len(r) == 1 and r[0].op == "STORE" and r[0].tags == ["a", "b"] and r[0].content == "x" * 50 + "..." and r[0].result == "done"
    week = mining.weekly_ops(mining.parse_audit(d), "2024-02-03").collect()
    assert len(week) == 7 and sum(x.store for x in week) == 1


def test_bloom(spark):
    bits, k = sketch.sizing(1000, 0.01)
    words = spark.range(1000).select(F.concat(F.lit("Word"), F.col("id").cast("string")).alias("word"))
    other = spark.range(5000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("word"))
    b = sketch.build(words, bits, k)
    assert sketch.contains(b, words.select(F.upper("word").alias("word")), bits, k).where("not maybe").count() == 0
    assert sketch.contains(b, other, bits, k).where("maybe").count() < 5000 * 0.03
    c = sketch.counting(words.union(words), bits, k)
    half = words.where("word like '%1'")
    once = sketch.counting_remove(c, half, bits, k)
    assert sketch.counting_contains(once, words, bits, k).where("not maybe").count() == 0
    gone = sketch.counting_remove(sketch.counting(words, bits, k), half, bits, k)
    assert sketch.counting_contains(gone, words.where("word not like '%1'"), bits, k).where("not maybe").count() == 0
    assert sketch.counting_contains(gone, half, bits, k).where("maybe").count() < 20
    assert sketch.merge(b, sketch.build(other, bits, k)).count() >= b.count()


def test_lifecycle(m):
    assert "e" not in ids(lifecycle.forget(m, now()))
    s = {r.id: (r.memory_type, r.strength) for r in lifecycle.sleep(m, m.where("id = 'a'").withColumn("id", F.lit("w")), now()).collect()}
    assert s["c"] == ("Procedural", 0.7) and s["w"] == ("Semantic", 0.9)
    got, links, name = lifecycle.consolidate(m, now())
    assert name.count() == 1 and links.count() >= 2 and sorted(ids(got)) == ["a", "b", "c", "d"]
    assert {r.id: r.strength for r in got.collect()}["a"] > 0.7


def test_embeddings(spark, m):
    e = {r.id: np.array(r.embedding) for r in embedding.hash_embed(m, 32).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in e.values())
    assert e["a"] @ e["b"] >= e["a"] @ e["c"]
    v = embedding.vocabulary(m, 3)
    assert v.count() == 3 and embedding.add_words(v, spark.createDataFrame([("zzz",)], "word string"), 4).count() == 4
    table = spark.createDataFrame([("fox", [1.0, 0.0]), ("quick", [0.0, 1.0])], "word string, vec array<double>")
    t = {r.id: r.embedding for r in embedding.table_embed(m.unionByName(m.where("id = 'a'").withColumns({"id": F.lit("q"), "content": F.lit("of")})), table).collect()}
    assert t["q"] == [0.5, 0.5] and abs(np.linalg.norm(t["a"]) - 1) < 1e-9
    cache = spark.createDataFrame([("plain", [9.0])], "content string, embedding array<double>")
    got, grown = embedding.cached_embed(m.select("id", "content"), cache, lambda d: embedding.hash_embed(d, 8))
    assert {r.id: r.embedding for r in got.collect()}["e"] == [9.0] and grown.count() == 5
    assert embedding.cache_stats(m, cache).first().hits == 1


def test_word_vectors(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("the 1 2\nshort 1\nFox 3 4\nbad x y\n")
    assert {r.word: r.vec for r in embedding.word_vectors(spark, str(p)).collect()} == {"the": [1.0, 2.0], "fox": [3.0, 4.0]}
    assert embedding.word_vectors(spark, str(p), 1).count() == 1


def test_import_export(spark, tmp_path, m):
    (tmp_path / "a.txt").write_text("one line\n\nab\n  second line  \n")
    (tmp_path / "a.md").write_text("# Title\ntext\n\nnext part\n\n\nab")
    (tmp_path / "a.csv").write_text('content,tags\n"quoted, text",x;y\nplain text,z\nab\n')
    (tmp_path / "a.json").write_text('[{"content": "hello", "tags": ["t"], "context": "c"}, {"content": "full", "memory_type": "Episodic", "strength": 0.5}, {"content": "x"}]')
    read = lambda x, **k: {r.content: r for r in files.read_any(spark, str(tmp_path / x), **k).collect()}
    assert set(read("a.txt", tags=["d"])) == {"one line", "second line"} and read("a.txt", tags=["d"])["one line"].tags == ["d"]
    assert set(read("a.md")) == {"# Title\ntext", "next part"}
    got = read("a.csv")
    assert got["quoted, text"].tags == ["x", "y"] and got["plain text"].tags == ["z"] and len(got) == 2
    got = read("a.json", tags=["d"])
    assert got["hello"].tags == ["t", "d"] and got["full"].memory_type == "Episodic" and got["full"].strength == 0.5 and len(got) == 2
    files.write_json(files.export(m), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    assert files.read_batch(spark, str(tmp_path / "a.txt")).count() == 3


def test_photos(spark):
    schema = "uuid string, location struct<lat: double, lon: double>, persons array<string>, keywords array<string>, albums array<string>, favorite boolean"
    old = spark.createDataFrame([("1", None, ["A"], ["k"], ["z"], False), ("2", (1.0, 2.0), [], [], ["y", "z"], True)], schema)
    new = spark.createDataFrame([("2", None, ["B", "A"], [], ["y"], True), ("3", None, None, None, None, None)], schema)
    p = files.merge_records(old, new)
    assert p.count() == 3
    r = files.photo_stats(p).first()
    assert (r.photos, r.located, r.with_people, r.favorites, r.persons, r.keywords, r.albums) == (3, 0, 2, 1, 2, 1, 2)
    assert [tuple(x) for x in files.albums(p).collect()] == [("y", 1), ("z", 1)]


def test_chat(m):
    said, memory = chat.chat(m, "quick fox", now(), lambda p: f"{p.count('- ')} memories")
    assert said.endswith("memories") and memory.first().memory_type == "Episodic"
    assert chat.summarise(m, "fox", now(), str.upper).endswith("FOX")


def test_streams(spark, tmp_path):
    from palimpsest.streaming import jobs

    src = spark.read.parquet(str(DATA / "sf0.001/events.parquet"))
    src.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for k, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):  # the stream takes files by age; rows must not come too late
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    src = spark.read.parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    stream = lambda: jobs.event_stream(spark, str(tmp_path / "in"), src.schema)
    w = run(jobs.tumbling(stream()), "tumbling", "complete")
    assert w.agg(F.sum("n")).first()[0] == src.count()
    e = run(jobs.episodes(stream(), "24 hours"), "episodes", "complete")
    assert e.agg(F.sum("n")).first()[0] == src.count()
    assert run(jobs.deduplicated(stream()), "dedup").count() == src.count()
    s = run(jobs.sliding(stream()), "sliding", "complete")
    assert s.agg(F.sum("n")).first()[0] == 4 * src.count()
    last = {}
    for r in run(jobs.working_memory(stream()), "working", "update").collect():
        last.setdefault(r.user_id, set()).add(r.event_id)
    top = {u: {r.event_id for r in src.where(F.col("user_id") == u).orderBy(F.desc("ts"), F.desc("event_id")).limit(7).collect()} for u in list(last)[:3]}
    assert all(top[u] <= last[u] for u in top)
    seen = []
    jobs.maintain(stream(), lambda df, i: seen.append(df.count()), str(tmp_path / "maintain")).awaitTermination(180)
    assert sum(seen) == src.count()
