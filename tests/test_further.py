import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import benchmarks, http, providers
from palimpsest.functions import codec
from palimpsest.library import Library
from palimpsest.operators import ann, concepts, embedding, graph, ingest, mining, notes, patterns, retrieval, sequence, storage, visual
from palimpsest.schema import MEMORY, new_memories, now
from palimpsest.service import Api, Guardian
from palimpsest.sources import files
from palimpsest.streaming import jobs

from .conftest import DATA


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# Storage


def test_the_last_of_equal_keys_wins(spark):
    old = spark.createDataFrame([("k", -1), ("other", 5)], "id string, x int")
    new = spark.createDataFrame([("k", i) for i in range(50)], "id string, x int")
    assert rows(storage.upsert(old, new), "id", "x") == [("k", 49), ("other", 5)]
    shuffled = new.repartition(7)
    assert rows(storage.upsert(old, shuffled, order=["x"]), "id", "x") == [("k", 49), ("other", 5)]
    assert rows(storage.upsert(old, new.limit(0)), "id", "x") == [("k", -1), ("other", 5)]


def test_get_many_by_a_join(spark, monkeypatch):
    m = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    want = [(str(i % 60), i) for i in range(100_001) if i % 60 < 50][:5]
    got = storage.get_many(m, [str(i % 60) for i in range(100_001)]).limit(5).collect()
    assert [(r.id, r.pos) for r in got] == want


def test_tables_of_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert not storage.healthy(spark, path)
    assert storage.ensure(spark, path, "vec_id bigint, embedding array<float>").count() == 0
    spark.createDataFrame([(1, [0.5])], "vec_id bigint, embedding array<float>").write.mode("append").parquet(path)
    assert storage.ensure(spark, path, "vec_id bigint, embedding array<float>").count() == 1 and storage.healthy(spark, path)
    with pytest.raises(ValueError):
        storage.ensure(spark, path, "vec_id string")


def test_sql_keeps_whole_values(spark):
    m = spark.createDataFrame([("x" * 500,)], "content string")
    assert len(storage.run_sql(m, "select content from memories").first()[0]) == 500
    assert len(storage.run_sql(m, "select content from memories", width=100).first()[0]) == 100


# Joins


@pytest.mark.parametrize("chars", [1_000_000, 10])
def test_holders(spark, chars):
    m = spark.createDataFrame([("a", "The quick brown fox jumps over the lazy dog", None), ("b", "nothing", "QUICK brown fox jumps over the"), ("c", None, None), ("d", "é quick é", "x")], "id string, content string, context string")
    new = spark.createDataFrame([("quick brown FOX jumps over the",), ("Quick",), ("é",), ("zebra",), ("quick",), (None,)], "content string")
    got = rows(graph.holders(m, new, chars), "id", "c")
    low = [(r.id, f"{r.content or ''}\0{r.context or ''}".lower()) for r in m.collect()]
    assert got == sorted((i, c) for i, t in low for (c,) in new.collect() if c is not None and c.lower() in t)
    assert graph.holders(m, new.limit(0), chars).count() == 0


def test_similar_words_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = {str(i): " ".join(rng.choice(list("abcdefghijkl"), rng.integers(0, 9))) for i in range(60)}
    m = spark.createDataFrame(list(texts.items()), "id string, content string").withColumn("bare", F.col("id").cast("int") % 4 == 0)
    for t in (0.2, 0.5, 1.0):
        want = {(a, b) for a in texts for b in texts if a < b and texts[a] and texts[b] and len(set(texts[a].split()) & set(texts[b].split())) / len(set(texts[a].split()) | set(texts[b].split())) >= t}
        assert {(r.a, r.b) for r in graph.similar_words(m, t).collect()} == want
        some = {(a, b) for a, b in want if int(a) % 4 == 0 or int(b) % 4 == 0}
        assert {(r.a, r.b) for r in graph.similar_words(m, t, "bare").collect()} == some
    with pytest.raises(ValueError):
        graph.similar_words(m, 0.0)


def test_clusters_against_the_order(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 4))
    m = spark.createDataFrame([(f"m{i:02}", v[i].tolist(), float(i % 7) / 7) for i in range(40)], "id string, embedding array<double>, strength double").withColumn("created_at", now())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = sorted(range(40), key=lambda i: (-(i % 7) / 7, i))
    taken, want = set(), set()
    for k, i in enumerate(order):
        if i in taken:
            continue
        own = [j for j in order[k + 1 :] if j not in taken and u[i] @ u[j] >= 0.8]
        taken |= set(own)
        if own:
            taken.add(i)
            want |= {(f"m{i:02}", f"m{j:02}") for j in own}
    assert {(r.primary_id, r.member_id) for r in graph.clusters(m, 0.8).collect()} == want
    assert graph.clusters(m.limit(0), 0.8).count() == 0


def test_one_sequence_over_stretches(spark):
    rng = np.random.default_rng(1)
    at = np.sort(rng.integers(0, 40 * 3600, 300))
    e = spark.createDataFrame([(f"{i:03}", int(s)) for i, s in enumerate(at)], "id string, s int").select("id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("created_at"), F.array("id").alias("tags"))
    got = {r.to_id: r.from_id for r in sequence.links(e).collect()}
    order = [f"{i:03}" for i in range(300)]
    assert got == dict(zip(order[1:], order[:-1]))
    chain = {r.to_id: r.chain for r in sequence.chains(e, 20).collect()}
    n = 0
    for i in range(1, 300):
        n += (at[i] - at[i - 1]) // 60 > 20
        assert chain[order[i]] == n
    assert mining.transitions(e).count() == 299
    for key, want in (("000", order[:3]), ("001", order[:4]), ("150", order[148:153]), ("299", order[297:])):
        found = sequence.context(e, key, 2).orderBy("pos").collect()
        assert [r.id for r in found] == want and found[0].pos == order.index(want[0]) + 1
    plan = sequence.chains(e, 20)._jdf.queryExecution().toString()
    assert "Window" in plan


# Index


def test_index(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(40, 16)) for c in centres])
    v = spark.createDataFrame([(f"{i}", x[i].tolist()) for i in range(len(x))], "id string, embedding array<float>")
    i = ann.build(v, lists=12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = v.limit(50).select(F.col("id").alias("query_id"), "embedding")
    found = ann.search_all(i, q, 10, probes=3)
    exact = {(str(a), str(b)) for a in range(50) for b in np.argsort(-(u[a] @ u.T))[:10]}
    assert len({(r.query_id, r.id) for r in found.collect()} & exact) >= 0.95 * len(exact)
    assert ann.stats(i).first().vectors == 480
    # ids that it has are ignored, other sizes are refused
    more = ann.add(i, spark.createDataFrame([("0", [9.0] * 16), ("new", [1.0] * 16), ("odd", [1.0])], "id string, embedding array<float>"))
    assert ann.stats(more).first().vectors == 481 and ann.search(more, x[0].tolist(), 1, 12).first().id == "0"
    assert [r.id for r in ann.rejected(i, spark.createDataFrame([("odd", [1.0]), ("none", None)], "id string, embedding array<float>")).collect()] == ["odd", "none"]
    gone = spark.createDataFrame([("0",)], "id string")
    assert ann.search(ann.remove(i, gone), x[0].tolist(), 5, 12).count() == 5
    assert ann.search(ann.remove(i, gone, at_once=False), x[0].tolist(), 5, 12, after=True).count() == 4
    assert ann.search(i, [1.0, 2.0], 5).count() == 0
    empty = ann.build(v.limit(0))
    assert empty.dim == 0 and ann.search(empty, x[0].tolist(), 3).count() == 0


# New memories


def test_process_links_what_is_alike(spark):
    none = spark.createDataFrame([], MEMORY)
    first = ingest.process(none, spark.createDataFrame([("a", "the red fox is quick"), ("b", "boats on water are slow")], "id string, content string"), dim=64)
    both = ingest.process(first, spark.createDataFrame([("c", "a red fox is very quick")], "id string, content string"), dim=64)
    got = {r.id: r for r in both.collect()}
    assert got["c"].associations == ["a"] and got["a"].associations == [] and {r.memory_type for r in got.values()} == {"Semantic"}
    assert ingest.process(both, spark.createDataFrame([], "id string, content string"), dim=64).count() == 3


def test_feedback_counts_and_accesses(spark):
    none = spark.createDataFrame([], MEMORY)
    m = patterns.learn(none, patterns.new_patterns(spark.createDataFrame([("on error", "retry"), ("on start", "log")], "trigger string, action string")))
    told = spark.createDataFrame([("on error", True), ("on error", False), ("on error", False), ("never", True)], "trigger string, success boolean")
    got = {p.trigger: (p.success_count, p.failure_count, n) for p, n in patterns.feedback(m, told, now()).select(patterns.parsed(F.col("content")).alias("p"), "access_count").collect()}
    assert got == {"on error": (2, 2, 4), "on start": (1, 0, 1)}
    assert patterns.feedback(m, told.limit(0), now()).count() == 2


def test_notes(spark):
    n = notes.preference(spark.createDataFrame([("tea over coffee",)], "content string"), "ann").unionByName(notes.conversation(spark.createDataFrame([("hello",)], "content string"), "mail"))
    m = notes.remember(spark.createDataFrame([], MEMORY), notes.with_importance(n, F.lit(9)), dim=16, prefix="bot")
    assert [r.tags for r in notes.preferences(m, "bot").collect()] == [["ann", "bot:preference", "importance:5"]]
    assert notes.lessons(m, "bot").count() == 0 and notes.by_kind(m, "conversation", "bot").first().context == "💬"
    assert notes.fast_recall(m, notes.hash_embed(spark.createDataFrame([("q", "tea")], "id string, content string"), 16).first().embedding, 1).count() == 1


def test_images(spark):
    v = spark.createDataFrame([], visual.VISUAL)
    one = lambda p: spark.createDataFrame([(f"{p}{k}", f"/{p}") for k in range(2)], "id string, image_path string")
    embed = lambda c: embedding.mock_embed(c, 32)
    v = visual.store_captioned(v, one("a"), lambda p: F.concat(F.lit("picture "), p), embed, lists=1)
    v = visual.store_images(v, one("b").withColumn("description", F.lit("x")), embed, lists=1)
    got = {r.id: r for r in v.collect()}
    assert {k: r.linked_visuals for k, r in got.items()} == {"a0": ["a1"], "a1": ["a0"], "b0": ["b1"], "b1": ["b0"]} and got["a0"].description == "picture /a"
    assert {r.id for r in visual.search_by(v, "/b", embed, 2).collect()} == {"b0", "b1"}
    again = visual.decode_rows(visual.encode_rows(v))
    assert rows(again, "id", "strength", "linked_visuals") == rows(v, "id", "strength", "linked_visuals")


def test_concepts(spark):
    c = spark.createDataFrame([], concepts.CONCEPT)
    new = lambda d: spark.createDataFrame([("fox", d, ["1"])], "name string, description string, source_memories array<string>")
    c = concepts.store_knowledge(c, new("red animal"), now("2024-01-01 00:00:00"), 16)
    c = concepts.store_knowledge(c, new("quick animal"), now("2024-01-02 00:00:00"), 16)
    assert concepts.knowledge(c, "fox").first()[0] == "quick animal" and concepts.knowledge(c, "Fox").count() == 0
    assert concepts.by_name(c).count() == 1 and concepts.names(c).count() == 2
    assert [r.score for r in concepts.search(c, 5, "red").collect()] == [0.5]
    assert concepts.search(c, 1, vector=c.first().embedding).first().score > 0.99


# Embeddings and codes


def test_cache_on_disk(spark, tmp_path):
    texts = spark.createDataFrame([("a b ccc",), ("ddd",)], "content string")
    cache = embedding.preload(spark.createDataFrame([], "content string, embedding array<double>"), texts, lambda x: embedding.hash_embed(x, 8))
    embedding.save_cache(cache, f"file://{tmp_path}/c")
    back = embedding.load_cache(spark, f"file://{tmp_path}/c")
    assert rows(back, "content", F.round(F.col("embedding")[0], 4)) == rows(cache, "content", F.round(F.col("embedding")[0].cast("float"), 4))


def test_runs(spark):
    for data in (b"", b"a", b"\xff", b"\xff\xff\xff", b"\xff" * 4, b"a" * 300, b"ab" * 5 + b"z" * 259 + b"\xff" * 258, bytes(range(256)) * 2):
        out = []
        i = 0
        while i < len(data):
            n = 1
            while n < 255 and i + n < len(data) and data[i + n] == data[i]:
                n += 1
            if n >= 4 or data[i] == 255:
                n = n if n >= 4 else 1
                out += [255, n, data[i]]
            else:
                n = 1
                out.append(data[i])
            i += n
        assert codec._encode(data) == bytes(out) and codec._decode(bytes(out)) == data


def test_page(spark):
    m = spark.createDataFrame([("1", "</script> fox", [1.0, 0.0]), ("2", "fox", [0.9, 0.1])], "id string, content string, embedding array<double>").withColumn("strength", F.lit(0.5)).withColumn("tags", F.array(F.lit("t")))
    n = graph.nodes(m, 5)
    page = graph.to_html(graph.graph_json(n, graph.edges(n, 0.5))).first().html
    assert page.count("</script>") == 1
    data = json.loads(page.split("const data = ")[1].split(", c = document")[0].replace("<\\/", "</"))
    assert len(data["nodes"]) == 2 and len(data["links"]) == 1
    assert "hsl" in graph.to_html(graph.constellation_json(graph.constellation(m, 5))).first().html


# Models, HTTP and remote stores


class Model:
    dim = 4

    def images(self, paths):
        return [[len(p), 1.0, 0.0, 0.0] for p in paths]

    def texts(self, texts):
        return [[len(t), 1.0, 0.0, 0.0] for t in texts]


def test_models(spark):
    images, texts = providers.of_images(Model())
    x = spark.createDataFrame([("abc",), (None,), ("",)], "p string").select(images(F.col("p")).alias("i"), texts(F.col("p")).alias("t"), providers.captions(lambda ps: [f"a picture of {p}" for p in ps])(F.col("p")).alias("c")).collect()
    assert x[0].i == x[0].t == pytest.approx([0.9486833, 0.3162278, 0, 0]) and x[0].c == "a picture of abc" and x[1].i is None and x[1].c is None
    assert providers.similarity(x[0].i, x[0].t) == pytest.approx(1) and providers.similarity([1.0], [1.0, 0.0]) == 0


@pytest.fixture
def served():
    """Runs a server in a thread and gives its address."""
    import threading

    running = []

    def start(s):
        threading.Thread(target=s.serve_forever, daemon=True).start()
        running.append(s)
        return f"http://127.0.0.1:{s.server_port}"

    yield start
    for s in running:
        s.shutdown()
        s.server_close()


def test_remote_vectors(spark, served):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Embedder(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["texts"]
            self.send_response(500 if "bad" in texts else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"dense": [[len(t), 0.5] for t in texts]}).encode())

    url = served(HTTPServer(("127.0.0.1", 0), Embedder))
    m = spark.createDataFrame([("1", "ab"), ("2", None), ("3", "bad")], "id string, content string").coalesce(1)
    got = {r.id: r.embedding for r in providers.remote(url, 2, rows=1)(m).collect()}
    assert got == {"1": [2.0, 0.5], "2": [0.0, 0.5], "3": [0.0, 0.0]} and providers.reachable(url)
    gone = "http://127.0.0.1:9"
    assert not providers.reachable(gone) and providers.remote(gone, 2)(m.limit(1)).first().embedding == [0.0, 0.0]


def test_http(spark, tmp_path, served):
    import urllib.error
    import urllib.parse
    import urllib.request

    lib = Library(spark, f"file://{tmp_path}/lib", dim=16)
    url = served(http.server(Api(lib)))

    def ask(method, path, body=None, form=False):
        data = None if body is None else urllib.parse.urlencode(body).encode() if form else json.dumps(body).encode()
        request = urllib.request.Request(url + path, data, {"Content-Type": "application/x-www-form-urlencoded" if form else "application/json"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert ask("GET", "/api/health") == (200, '{"status": "ok"}')
    key = json.loads(ask("POST", "/api/store", {"content": "the fox is <red>", "tags": ["animal"]})[1])["id"]
    assert ask("POST", "/store", {"content": "a boat is slow", "tags": "water"}, form=True) == (200, "stored") and ask("POST", "/store", {}, form=True)[0] == 400
    assert len(json.loads(ask("POST", "/api/batch", {"items": [{"content": "an owl is wise"}, {"x": 1}]})[1])) == 1
    assert [r["content"] for r in json.loads(ask("POST", "/api/recall", {"query": "fox"})[1])] == ["the fox is <red>"]
    assert json.loads(ask("POST", "/api/recall", {"query": "fox red", "use_index": True, "limit": 1})[1])[0]["id"] == key
    assert json.loads(ask("GET", "/api/stats")[1])["indexed"] == 3
    assert ask("DELETE", f"/api/memory/{key}")[0] == 200 and json.loads(ask("GET", "/api/stats")[1])["indexed"] == 2 and ask("DELETE", "/api/memory/")[0] == 400
    assert "&lt;red&gt;" in ask("GET", "/memories")[1] and "boat" in ask("GET", "/search?tags=WATER")[1] and "<canvas" in ask("GET", "/map")[1] and "fox" in ask("GET", "/timeline")[1]
    assert ask("POST", "/api/store", {"text": 1})[0] == 404 and ask("GET", "/x")[0] == 404
    bad = urllib.request.Request(url + "/api/store", b"[1", method="POST")
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(bad)


def test_remote_stores(spark):
    m = new_memories(spark.createDataFrame([("a", "one thing", ["x"]), ("b", "another", [])], "id string, content string, tags array<string>"))
    sent = files.push(m, spark.createDataFrame([("a",)], "id string"), lambda rows: [r["content"] == "another" for r in rows])
    assert [tuple(r) for r in sent.collect()] == [("b", True)]
    back = files.pull(spark.createDataFrame([("one thing", []), ("from afar", ["y"]), (" ", [])], "content string, tags array<string>"), m, "far")
    assert [(r.content, r.tags) for r in back.collect()] == [("from afar", ["y", "far"])]


def test_log(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", dim=16)
    assert lib.audit.count() == 0
    lib.log("STORE", "a fox", ["animal"])
    lib.log("RECALL", "x" * 80)
    got = {r.op: r for r in lib.audit.collect()}
    assert got["STORE"].tags == ["animal"] and got["RECALL"].content == "x" * 50 + "..." and mining.daily_ops(lib.audit).first().store == 1


def test_benchmarks(spark):
    calls = []
    r = benchmarks.bench("x", lambda: calls.append(1), 3, 2)
    assert len(calls) == 5 and r.runs == 3 and r.mean_s >= 0
    assert len(benchmarks.run(spark, 50, 1)) == 10


# Streams


def test_watched_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("first line\n\nsecond line\n")
    got = []
    for _ in range(2):
        jobs.watch(spark, f"file://{tmp_path}/in", lambda m: got.extend(r.content for r in m.collect()), f"file://{tmp_path}/cp", ("t",)).awaitTermination(120)
        (tmp_path / "in/b.txt").write_text("third line\n")
    assert sorted(got) == ["first line", "second line", "third line"]


def test_working_memory_of_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").orderBy("ts", "event_id")
    n = e.count()
    numbered = e.withColumn("part", F.floor((F.row_number().over(sequence.Window.orderBy("ts", "event_id")) - 1) * 3 / n))
    for k in range(3):
        numbered.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/w{k}")
    (tmp_path / "in").mkdir()
    import os
    import shutil

    for k in range(3):
        src = next(p for p in (tmp_path / f"w{k}").iterdir() if p.suffix == ".parquet")
        shutil.copy(src, tmp_path / f"in/{k}.parquet")
        os.utime(tmp_path / f"in/{k}.parquet", (1000 + k, 1000 + k))
    last: dict = {}

    def see(batch, _):
        for r in batch.collect():
            last.setdefault(r.user_id, {})
        new: dict = {}
        for r in batch.collect():
            new.setdefault(r.user_id, {})[r.pos] = r.event_id
        last.update(new)

    stream = jobs.event_stream(spark, f"file://{tmp_path}/in", e.schema)
    jobs.working_memory(stream, idle="3650 days").writeStream.outputMode("update").foreachBatch(see).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    want: dict = {}
    for r in sequence.working(e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id"), ["user_id"]).collect():
        want.setdefault(r.user_id, {})[r.pos] = r.id
    assert last == want


# The library and its service


def test_service(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", dim=32)
    api = Api(lib)
    assert api.submit("  ") == {"success": False}
    fox = api.store("the fox is red", ["animal"])["id"]
    api.submit("a boat is slow", "water, travel")
    api.build_index(1)
    third = api.store("the red fox is quick", memory_type="episodic")["id"]
    assert {r.memory_type for r in lib.memories.collect()} == {"Semantic", "Episodic"}
    assert {r.id for r in api.recall("red fox", 2, use_index=True).collect()} == {fox, third}
    assert api.delete(fox) and not api.delete("") and lib.memories.count() == 3
    s = api.stats().first()
    assert (s.semantic, s.episodic, s.indexed, s.dim) == (2, 1, 2, 32)
    assert api.memories_page().count() == 3 and api.listing(2).columns == ["memory_type", "content", "date"]
    assert [r.content for r in api.results_page("", "WATER").collect()] == ["a boat is slow"] and api.results_page("fox").count() >= 1


def test_guardian(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", dim=32)
    g = Guardian(lib)
    a = g.handle({"op": "store", "content": "the fox is red"})["stored"]
    b = g.handle({"op": "store", "content": "the red fox is quick"})["stored"]
    ops = [
        {"op": "recall", "query": "red fox", "k": 1}, {"op": "get", "id": a}, {"op": "get", "id": "none"}, {"op": "reinforce", "id": "none", "delta": 0.1}, {"op": "link", "source": a, "target": b}, {"op": "link", "source": a, "target": b},
        {"op": "recent", "limit": 1}, {"op": "tick"}, {"op": "start_dream"}, {"op": "tick"}, {"op": "learn", "name": "fox", "description": "red animal"}, {"op": "query", "name": "fox"}, {"op": "query", "name": "x"}, {"op": "stats"}, {"op": "status"},
        {"op": "working"}, {"op": "associate"}, {"op": "generalise"}, {"op": "forget", "rate": 0.0}, {"op": "what"}, {"op": "shutdown"}, {"op": "stats"},
    ]
    got = list(g.run(ops))
    assert len(got) == len(ops) - 1 and got[-1] == {"shutdown": True} and "error" in g.handle({"op": "stats"})
    by = dict(zip(range(len(got)), got))
    assert len(by[0]["recalled"]) == 1 and by[1]["found"]["content"] == "the fox is red" and by[2]["found"] is None and "error" in by[3]
    assert by[4] == {"linked": True} and "error" in by[5] and len(by[6]["memories"]) == 1 and "error" in by[7] and "concept" in by[9]
    assert by[11] == {"knowledge": "red animal"} and by[12] == {"knowledge": None} and by[13]["concepts"] == 1 and by[13]["dreaming"] and by[14]["readable"]
    assert len(by[15]["memories"]) == 2 and by[16]["links"] and "error" in by[19]


def test_library_of_patterns_notes_and_concepts(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", dim=16)
    lib.learn("on error", "retry")
    lib.feedback("on error", True)
    lib.remember(notes.lesson(spark.createDataFrame([("test first",)], "content string")))
    lib.process(spark.createDataFrame([("the fox is red",)], "content string"))
    score = lib.store_with_importance(spark.createDataFrame([("the fox is quick", ["animal"], 0.9)], "content string, tags array<string>, valence double")).first()
    assert score.novelty == 1.0 and lib.memories.where("content = 'the fox is quick'").first().strength == pytest.approx(score.importance)
    assert retrieval.search_or(lib.memories, "fox").count() == 2
    assert lib.counts().first().semantic == 3 and lib.rebuild().first().procedural == 1
    assert new_memories(spark.createDataFrame([("x",)], "content string")).count() == 1
