import pytest

from loomstone.corpus import Corpus
from loomstone.personas import PersonaTable


def embedder():
    return lambda texts: [[float(t.lower().count(w)) + 0.01 for w in ("alpha", "beta", "gamma")] for t in texts]


def test_life_of_a_corpus(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "source_path string, content string")
    c = Corpus(spark, str(tmp_path / "c"), embed=embedder())
    files = rows(("raw/x/a.md", "alpha alpha\n\n5.1 净宽不应低于1.2米"), ("raw/b.md", "beta\n5.2 净宽不应低于1.5米"), ("raw/empty.md", " "))
    assert c.ingest(files) == 2 and c.ingest(files) == 0 and c.ingest(rows(("raw/b.md", "gamma beta\n净宽不应低于1.5米"))) == 1
    assert c.stats() == {"backend": "parquet", "chunks": 2, "sources": 2, "vectors": 2, "indicators": 2}
    assert [r["source_path"] for r in c.search("alpha", 1).collect()] == ["raw/x/a.md"]
    assert Corpus(spark, str(tmp_path / "c")).search("gamma").first()["source_path"] == "raw/b.md"
    assert c.recall("alpha").startswith("[知识库片段] 来源：raw/x/a.md\n") and c.recall("a") == ""
    assert [r["type"] for r in c.conflicts("raw/b.md").collect()] == ["A更严格"]
    assert c.answer("alpha").startswith("raw/x/a.md\n")
    plain = Corpus(spark, str(tmp_path / "c"))
    assert [r["source_path"] for r in c.search("净宽", 1).collect()] == [r["source_path"] for r in plain.search("净宽", 1).collect()]  # too short for trigrams
    assert c.search("zzz qqq", 1).count() == 1 and plain.search("zzz qqq").count() == 0 and plain.search(" ").count() == 0
    c.delete("raw/x")
    assert c.stats()["sources"] == 1 and c.stats()["vectors"] == 1 and c.stats()["indicators"] == 1


def test_compile(spark, tmp_path):
    files = spark.createDataFrame([("raw/a.md", "text")], "source_path string, content string")
    answer = lambda prompt, tokens: '{"operations":[{"path":"entities/a.md","content":"A"}]}'
    assert Corpus(spark, str(tmp_path)).compile(files).count() == 0
    assert [r["path"] for r in Corpus(spark, str(tmp_path), complete=answer).compile(files).collect()] == ["entities/a.md"]


def test_personas(spark, tmp_path):
    t = PersonaTable(spark, str(tmp_path / "p"))
    key = t.create(" Name ", "text")
    assert {r["name"] for r in t.active().collect()} == {"Name", "default"}
    t.assign("s1", key)
    t.update(key, "Other", "new")
    assert [(r["session_id"], r["persona_id"]) for r in t.of_sessions().collect()] == [("s1", key)]
    new = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    assert {r["session_id"]: r["persona_id"] for r in t.started(new).collect()} == {"s1": key, "s2": None}
    t.default = "house"
    assert {r["session_id"]: r["persona_id"] for r in t.started(new).collect()} == {"s1": key, "s2": "house"}
    t.delete(key)
    assert [r["persona_id"] for r in t.of_sessions().collect()] == [None] and t.active().count() == 1
    t.assign("s1", "unknown")
    assert t.of_sessions().count() == 0
    for wrong in (lambda: t.create(" ", ""), lambda: t.update("default", "x", "")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        t.delete(key)
