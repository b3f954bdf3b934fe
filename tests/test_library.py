import json

from palimpsest.__main__ import main
from palimpsest.library import Library
from palimpsest.schema import MEMORY


def test_library(spark, tmp_path, capsys):
    lib = Library(spark, f"file://{tmp_path}/lib", dim=32)
    assert lib.memories.count() == 0 and lib.links.count() == 0
    lib.store("the heron is a grey bird", ["bird"])
    lib.store("a heron is a bird by the water", ["bird", "water"])
    lib.store("the heron is a grey bird", ["bird"])
    lib.store("how to row a boat", ["boat"])
    assert lib.memories.schema.names == MEMORY.names and lib.memories.count() == 3
    assert {r.memory_type for r in lib.memories.collect()} == {"Semantic", "Procedural"}
    assert lib.recall("heron", 2).count() == 2 and lib.recall("heron", 2, regex="water").count() == 1
    assert lib.search("grey heron bird", 1).first().content == "the heron is a grey bird"
    # two versions are kept, and an unfinished one is not read
    assert len(lib._versions("memories")) == 2
    (tmp_path / "lib/memories/99").mkdir()
    assert lib.memories.count() == 3
    (tmp_path / "lib/memories/99").rmdir()
    assert lib.merge(0.3, dry_run=True).first().clusters >= 1 and lib.memories.count() == 3
    lib.dream(threshold=0.2)
    assert lib.links.count() >= 1 and lib.show("").count() >= 3
    assert lib.merge(0.3).first().mergeable == 3 - lib.memories.count()
    lib.sleep()
    assert "links" in json.loads(lib.map(10, 0.1).first().json)
    path = f"file://{tmp_path}/cli"
    for args in (["store", "a fox is red", "--tags", "animal"], ["list"], ["recall", "fox"], ["search", "fox"], ["stats"], ["patterns"], ["forget"], ["predict"], ["timeline"], ["chains"], ["constellation"], ["map", "--form", "dot"], ["merge", "--dry-run"], ["sql", "select count(*) as n from memories"], ["sleep"], ["dream"], ["show", "x"], ["delete", "zzz"], ["export", f"{tmp_path}/out"]):
        assert main([path, *args]) == 0
    out = capsys.readouterr().out
    assert "a fox is red" in out and "graph memories" in out
    assert spark.read.json(f"{tmp_path}/out").first().content == "a fox is red"
