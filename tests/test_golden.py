"""Small inputs with known results."""

import shutil
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstone.functions import text, vectors
from loomstone.operators import chunking, extraction, jobs, pages, plans, relations, search, sessions
from loomstone.sources import readers
from loomstone.sources.snapshots import SnapshotTable
from loomstone.streaming import streams

CHUNKS = [
    ("a", "Alpha beta GAMMA alpha", "raw/one.md"),
    ("b", "beta delta aaaaa", "raw/two.md"),
    ("c", "nothing here at all in this long long document text", "raw/alpha.md"),
    ("d", "gamma rays", "raw/x.md"),
    ("e", "电子政务数据元设计方法", "raw/y.md"),
    ("f", "zeta", "q"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "uid string, content string, source_path string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def bm25(chunks, *terms):
    return [(r["uid"], round(r["score"], 6)) for r in search.bm25(chunks, list(terms), 10).collect()]


def test_bm25(chunks):
    assert bm25(chunks, "alpha") == [("a", 0.765166), ("c", 0.361643)]
    assert bm25(chunks, "beta", "gamma") == [("a", 1.086664), ("d", 0.702788), ("b", 0.601856)]
    assert bm25(chunks, "beta", "beta") == [("b", 1.203712), ("a", 1.086664)]
    assert bm25(chunks, "aaa") == [("b", 2.067041)]
    assert bm25(chunks, "be", "gamma") == [("d", 0.702788), ("a", 0.543332)]
    assert bm25(chunks, "be", "ga") == []
    assert bm25(chunks, "数据元") == [("e", 1.521594)]
    assert [u for u, _ in bm25(chunks, "raw")] == ["d", "e", "b", "a", "c"]
    assert [r["uid"] for r in search.lexical(chunks, "be", 10).collect()] == ["a", "b"]
    assert search.lexical(chunks, "  ", 10).count() == 0


def test_bm25_is_what_fts5_computes(chunks):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(content, source_path, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("INSERT INTO t VALUES (?, ?)", [c[1:] for c in CHUNKS])
    for terms in (["alpha"], ["beta", "gamma"], ["aaa"]):
        found = db.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ? ORDER BY 2 DESC", (" OR ".join(f'"{t}"' for t in terms),)).fetchall()
        assert [(CHUNKS[i - 1][0], round(s, 6)) for i, s in found] == bm25(chunks, *terms)


def test_fusion(spark, chunks):
    lex = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "uid string, score double")
    vec = spark.createDataFrame([("b", 0.1), ("c", 0.2)], "uid string, distance double")
    got = {r["uid"]: r for r in search.fuse(lex, vec).collect()}
    assert {u: round(r["score"], 6) for u, r in got.items()} == {"b": 0.032522, "a": 0.016393, "c": 0.016129}
    assert got["a"]["cosine"] is None and got["a"]["distance"] == 1


def test_vectors(spark):
    d = lambda a, b: one(spark, vectors.cosine_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert [d([1.0, 0.0], [1.0, 0.0]), d([1.0, 0.0], [0.0, 1.0]), d([1.0, 0.0], [-1.0, 0.0]), d([0.0, 0.0], [1.0, 0.0]), d([1.0, 0.0, 9.0], [1.0, 0.0])] == [0, 1, 2, 1, 0]
    s = lambda n: one(spark, vectors.sketch(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("double"))))
    assert s(64) == [float(x) for x in range(1, 65)] and s(128)[:2] == [3.0, 7.0]
    assert s(100)[50:] == [0.0] * 14 and s(100)[0] == 3.0 and s(32)[32:] == [0.0] * 32


def test_text(spark):
    lit = F.lit
    assert one(spark, text.normalize(lit("a \r\n\r\n\r\n\r\nb\u0007\t\n"))) == "a\n\nb"
    assert one(spark, text.trim_all(lit("\ufeff\u3000 a\u00a0b\u2009\n\x0b"))) == "a\u00a0b" and one(spark, text.trim_all(lit(" \t"))) == ""
    assert one(spark, text.trim_all(lit(text.SPACES))) == "" and one(spark, text.trim_all(F.regexp_replace(lit(text.SPACES), f"[{text.JS_SPACE}]", "x"))) == "x" * len(text.SPACES)
    assert one(spark, text.excerpt(lit("hello world"), 6)) == "hello…"
    assert search.query_terms('a"b') == ["a", "b"] and search.query_terms("电子政务数据元 设计方法") == ["电子政务数据元", "设计方法"]
    assert one(spark, plans.dedup_key(lit("GB_50016-2014"))) == "gb500162014"
    assert one(spark, text.title_of(lit("raw/a/GB 1_0A1B2C3D.pdf"))) == "GB 1" and one(spark, text.title_of(lit("wiki/entities/x.md"))) == ""
    for raw, page in (("raw/a/report.pdf", "sources/a/report.pdf.md"), ("raw/n.md", "sources/n.md"), ("raw/../x.txt", "sources/x.txt.md")):
        assert one(spark, text.mirror_path(lit(raw))) == page
    assert one(spark, text.safe_name(lit("a<b>.md"))) == "a_b_.md"
    page = lit('---\ntitle: "A: B"\nsource: raw/x.md\nbad\nsource: raw/y.md\n---\nbody')
    assert one(spark, text.frontmatter(page)) == {"title": "A: B", "source": "raw/y.md"} and one(spark, text.body(page)) == "body"
    assert tuple(one(spark, text.release(lit("0.1.7-rc.1")))) == (0, 1, 7) and one(spark, text.release(lit("1.2"))) is None
    assert one(spark, extraction.standard_no(lit("依据 GB/T 18883-2022 执行"))) == "GB/T18883-2022"


def test_chunks(spark):
    t = "# T\n\npara one\n\npara two"
    assert chunking.chunk_text(t, 64, 10) == ["[T]\n# T\n\npara one\n\npara two"]
    assert chunking.chunk_text(t, 20, 9) == ["[T]\n# T\n\npara one", "[T]\npara one", "[T]\npara two"]
    assert chunking.chunk_text("  ", 64, 10) == []
    with pytest.raises(ValueError):
        chunking.chunk_text(t, 10, 10)
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(20))
    assert all("| a | b |\n|---|---|" in c for c in chunking.chunk_text(table, 60, 0))
    long = chunking.chunk_text("y" * 100, 30, 5)
    assert "".join(long) == "y" * 100 and max(map(len, long)) <= 30
    rows = chunking.chunks(spark.createDataFrame([("raw/a", t, ""), ("raw/b", None, None)], "source_path string, content string, title string"), 20, 9).collect()
    assert [(r["source_path"], r["chunk_index"]) for r in rows] == [("raw/a", 0), ("raw/a", 1), ("raw/a", 2)]


@pytest.mark.parametrize("n,size,count,cut", [(1500, 2000, 1, False), (5000, 2000, 3, False), (1_000_000, 5199, 200, False), (5_000_000, 20199, 200, True)])
def test_windows(spark, n, size, count, cut):
    rows = chunking.windows(spark.createDataFrame([("x" * n,)], "content string")).select("window", "start", "size", "truncated", F.length("content").alias("n")).collect()
    assert len(rows) == count and {(r["size"], r["truncated"]) for r in rows} == {(size, cut)}
    assert max(r["start"] + r["n"] for r in rows) == min(n, 4_000_000)


def test_conflict_types(spark):
    kind = lambda da, a, db, b: one(spark, extraction.classified(F.lit(da), F.lit(db), F.lit(a), F.lit(b)))
    assert kind("upper", 0.10, "upper", 0.08) == "B更严格" and kind("lower", 30, "lower", 20) == "A更严格"
    assert kind("upper", 5, "upper", 5) == "相同" and kind("upper", 5, "lower", 5) == "方向不同"


def test_jobs(spark):
    rows = [("l", f"raw/{i}", s, i) for i, s in enumerate(("done", "done", "failed", "running"))] + [("l", "__recompile_all__", "running", 9)]
    j = spark.createDataFrame(rows, "lib string, rel string, status string, updated_at long")
    p = jobs.progress(j).first()
    assert (p["total"], p["failed"], p["settled"], p["active"], p["percent"]) == (4, 1, 3, 1, 75)
    assert jobs.recovered(j.limit(4)).where("recovered").count() == 1
    asked = spark.createDataFrame([("l", "a", 1, False), ("l", "b", 2, False), ("l", "c", 3, True), ("l", "a", 4, False)], "lib string, rel string, seq long, front boolean")
    assert [r["rel"] for r in jobs.queue_order(asked).orderBy("position").collect()] == ["c", "a", "b"]


def test_ambient(spark):
    hits = spark.createDataFrame([(u, s, "raw/a", "z" * 3000) for u, s in (("1", 3.0), ("2", 2.0), ("3", 1.0))], "uid string, score double, source_path string, content string")
    assert [len(r["block"]) for r in search.ambient(hits).orderBy("uid").collect()] == [2017, 1981]


def test_links_and_occurrences(spark, chunks):
    p = spark.createDataFrame([("entities/beta.md", "A", "[[A]] [[beta]] [[zzz]]")], "path string, title string, content string")
    assert [r["target"] for r in pages.broken_links(p).collect()] == ["zzz"]
    got = search.weighted_occurrences(spark.createDataFrame([("u", "alpha beta Alpha")], "uid string, content string"), "Alpha be", 5).first()
    assert got["score"] == 12


def test_uploads(spark):
    had = spark.createDataFrame([("raw/r.pdf", "H1")], "rel string, hash string")
    new = spark.createDataFrame([(1, "raw/n.pdf", "H9"), (2, "raw/r.pdf", "H1"), (3, "raw/r.pdf", "H2")], "seq long, rel string, hash string")
    assert [(r["status"], r["stored"]) for r in relations.upload_outcome(had, new).orderBy("seq").collect()] == [("created", "raw/n.pdf"), ("duplicate", "raw/r.pdf"), ("renamed", "raw/r (1).pdf")]


def test_sessions(spark):
    p = spark.createDataFrame([("default", "d", "", 1), ("p1", "x", "", 1), ("p2", "y", "", 0)], "id string, name string, content string, status int")
    a = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), ("s3", None)], "session_id string, persona_id string")
    assert {r["session_id"]: r["persona_id"] for r in sessions.bound(a, p).collect()} == {"s1": "p1", "s2": None, "s3": None}
    gone = spark.createDataFrame([("p1", "x", "", 0, 1), ("default", "z", "", 0, 2)], "id string, name string, content string, status int, seq long")
    assert {r["id"]: r["status"] for r in sessions.latest(p, gone).collect()} == {"default": 1, "p1": 0, "p2": 0}
    stamp = F.to_timestamp(F.lit("2026-01-02 03:04:05.678"))
    assert one(spark, sessions.trace_label(F.lit(7), stamp, F.lit(None).cast("string"))) == "007-2026-01-02T03-04-05-678Z-no-session"
    parts = [("c", 1, 1, "text-delta", "a", None), ("c", 2, 2, "reasoning-delta", None, None), ("c", 3, 3, "text-delta", "b", None), ("c", 4, 4, "finish", None, "stop")]
    fold = sessions.stream_fold(spark.createDataFrame(parts, "call_id string, seq long, t_ms long, type string, text string, finish_kind string")).first()
    assert (fold["text"], fold["types"], fold["outcome"]) == ("ab", "text-delta:2,reasoning-delta:1,finish:1", "ok")


def test_latest_prompts_stream(spark, tmp_path):
    events = spark.createDataFrame([("s1", 1, "x"), ("s1", 3, "z"), ("s2", 1, "")], "session_id string, seq long, text string")
    events.write.parquet(str(tmp_path / "events"))
    stream = streams.arriving(spark, str(tmp_path / "events"), events.schema)
    got = streams.final_state(streams.latest_prompts(stream), spark, str(tmp_path / "state"))
    assert [(r["session_id"], r["prompt"]) for r in streams.most_recent(got).collect()] == [("s1", "z")]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "source_path string, v int")
    rows = lambda *x: spark.createDataFrame(list(x), "source_path string, v int")
    assert t.read().count() == 0 and t.version() == 0
    t.replace(rows(("a", 1), ("a", 2), ("b", 1)), "source_path")
    t.replace(rows(("a", 3)), "source_path")
    assert sorted(map(tuple, t.read().collect())) == [("a", 3), ("b", 1)]
    t.delete(rows(("b", 0)), "source_path")
    assert [tuple(r) for r in t.read().collect()] == [("a", 3)] and t.version() == 3
    t.truncate()
    assert t.read().count() == 0


def test_readers(spark, tmp_path):
    assert readers.decode("é".encode()) == "é" and readers.decode(b"\xff\xfea\x00") == "a" and readers.decode(b"\xfe\xff\x00a") == "a" and readers.decode(b"caf\xe9") == "café"
    assert readers.extensions([" PDF ", ".pdf", ""])[-1] == ".pdf" and readers.vocabulary(["a\r\n", "\n", "b"]) == {"a": 0, "b": 2}
    (tmp_path / "raw/sub").mkdir(parents=True)
    (tmp_path / "raw/sub/x.txt").write_bytes(b"hi")
    (tmp_path / "raw/.hidden").write_bytes(b"no")
    files = readers.raw_files(spark, str(tmp_path / "raw")).withColumn("t", readers.decoded("content")).collect()
    assert [(r["source_path"], r["t"]) for r in files] == [("raw/sub/x.txt", "hi")]
    (tmp_path / "d.csv").write_text('a,b\n"x ""y""\nz",2\n')
    assert tuple(readers.csv(spark, str(tmp_path / "d.csv")).first()) == ('x "y"\nz', "2")
    assert readers.document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    assert readers.document(spark, str(tmp_path / "bad.json"), "a int").where("a is not null").count() == 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomstone", tmp_path / "loomstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
