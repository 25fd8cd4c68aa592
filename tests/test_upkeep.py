import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import schema
from loomstone.operators import models, upkeep


def test_schema_round_trip():
    s = schema.Schema("overwrite", False, ("entity", "x-y"), "entities/<a>.md")
    assert schema.parsed(schema.rendered(s)) == s
    prose = "# Mine\n\nwords stay\n\n## 页面类型\n- old\n\n## 命名约定\n- 实体页：b.md\n"
    out = schema.merged(prose, s)
    assert schema.parsed(out) == s and "words stay" in out and "old" not in out
    assert schema.merged("", s) == schema.rendered(s) and schema.parsed("nothing").conflict == "mark"


def test_budget_and_limits():
    assert models.budget(8192, 32768, 128_000) == models.Budget(16384, 32768, 20_200)
    assert models.budget(99_999, 1, 0).window == 500
    assert models.chunking_limits(10, 900) == (64, 63) and models.chunking_limits(None, float("nan")) == (800, 100)
    assert [models.compile_percent(*x) for x in ((0, 0), (0, 5), (1, 2), (2, 2))] == [99, 1, 50, 99]
    assert models.decoded_option(models.encoded_option("p", "m")) == ("p", "m") and models.decoded_option("x") is None
    a, b = models.halves("x" * 3000)
    assert len(a) == len(b) == 1700


def test_cache_and_catalog():
    now, made = [0.0], []
    c = models.Cache(30, 2, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert [c.get(k, make) for k in "aab"] == [1, 1, 2]
    now[0] = 31
    assert c.get("a", make) == 3 and c.get("c", make) == 4 and set(c.kept) == {"a", "c"}
    groups, failures = models.catalog([("p", ""), ("q", "Q")], lambda k: [("m", "")] if k == "p" else 1 / 0)
    assert groups == [{"id": "p", "name": "p", "models": [{"id": "m", "name": "m"}]}] and failures[0]["name"] == "Q"


def test_word_pieces():
    v = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##able", "中", "a"])}
    t = models.WordPiece(v, most=6)
    assert t.ids("Unable 中a") == [2, 4, 5, 6, 7, 3] and t.ids("unx") == [2, 1, 3] and len(t.ids("a " * 50)) == 6
    ids, mask = t.batch(["a", "Unable"])
    assert ids.tolist() == [[2, 7, 3, 0], [2, 4, 5, 3]] and mask.tolist() == [[1, 1, 1, 0], [1, 1, 1, 1]]
    out = models.pooled(np.array([[[3.0, 4.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0]]]), np.array([[1, 0], [1, 1]]))
    assert np.allclose(out, [[0.6, 0.8], [0, 0]])


def test_tables(spark, tmp_path):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    stat = upkeep.changed_by_stat(df([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size int, modified int"), df([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size int, modified int"))
    assert {r["path"]: r["state"] for r in stat.collect()} == {"a": "same", "b": "changed", "c": "new", "d": "gone"}
    p = upkeep.personas(df([("x", "X", None)], "id string, name string, content string")).collect()
    assert {r["id"]: r["status"] for r in p} == {"x": 1, "default": 1}
    lib = upkeep.libraries(df([("l", None, "/r", None, 50, 3), (None, "n", "/q", 1, 1, 1)], "id string, name string, root_dir string, chunk_size int, chunk_overlap int, top_k int"), "l").collect()
    assert [(r["name"], r["chunk_size"], r["is_active"]) for r in lib] == [("l", 800, True)]
    old = upkeep.adopted_jobs(df([("a", "running", None), ("b", "failed", "e"), ("c", "queued", None), ("k", "done", None)], "rel string, status string, error string"), df([("k",)], "rel string"))
    assert {r["rel"]: r["status"] for r in old.collect()} == {"a": "failed", "b": "failed", "c": "done"}
    pages = df([("sources/n.txt.md", "---\nsource: raw/x/n.txt\n---\nB"), ("sources/x/n.txt.md", "---\nsource: raw/x/n.txt\n---\nC")], "path string, content string")
    files = df([("raw/x/n.txt",)], "source_path string")
    assert [r["body"] for r in upkeep.mirrors(files, pages).collect()] == ["C"]
    assert [r["path"] for r in upkeep.flat_mirrors(pages, files).collect()] == ["sources/n.txt.md"]
    marks = df([("p", True, "1"), ("q", True, "1")], "page_path string, edited boolean, updated_at string")
    assert [r["page_path"] for r in upkeep.with_marks_set(marks, df([("q", False, "2")], marks.schema)).collect()] == ["p"]
    libs = upkeep.libraries_after(df([("a", "A", "/a"), ("b", "B", "/b")], "id string, name string, root_dir string"), df([(1, "rename", "a", "A2", None), (2, "remove", "b", None, None), (3, "add", "c", "C", "/a"), (4, "add", "d", "D", "/d")], "seq int, action string, id string, name string, root_dir string"))
    assert sorted((r["id"], r["name"]) for r in libs.collect()) == [("a", "A2"), ("d", "D")]
    jobs, left = upkeep.recompiled(files, df([("entities/e.md", ""), ("sources/s.md", "")], "path string, content string"))
    assert jobs.count() == 2 and [r["path"] for r in left.collect()] == ["sources/s.md"]
    rows = df([(i,) for i in range(7)], "path int")
    got = upkeep.page_of_rows(rows, 3, 1, "path").collect()
    assert [(r["path"], r["remaining"]) for r in got] == [(3, 1), (4, 1), (5, 1)]
    assert [r["dropped"] for r in upkeep.clipped(rows, 5).collect()] == [2] * 5
    assert upkeep.as_json(rows, 2, "path").first()["json"] == '[{"path":0},{"path":1}]'
    assert upkeep.conflict_report(df([], "path string, n long, blocks array<string>")).first()["report"] == "未发现冲突标记。"
    assert upkeep.conflict_report(df([("b", 1, ["x"]), ("a", 2, ["y", "z"])], "path string, n long, blocks array<string>")).first()["report"].index("### a（2 处）") > 0
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(upkeep.posix(F.lit("\\a\\b/"))) == "a/b" and one(upkeep.listed(F.lit(" a, ,b"))) == ["a", "b"]
    assert one(upkeep.pretty(F.lit('{"a":1}'), "a int")) == '{\n  "a" : 1\n}' and one(upkeep.pretty(F.lit("{no"), "a int")) == "{no"
    entry = one(upkeep.log_entry(F.to_timestamp(F.lit("2026-01-02 03:04:05")), F.lit("raw/a"), F.array(F.lit("x")), F.array().cast("array<string>"), F.lit(2)))
    assert entry == "## 2026-01-02 03:04:05\n- 来源：raw/a\n- 新建：x\n- 更新：无\n- 冲突：2\n"
    for _ in range(2):
        upkeep.appended(df([(entry,)], "block string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).where("value like '## %'").count() == 2
    upkeep.traced(df([("2026-01-02 03:04:05", "m", "s")], "time string, model string, signal string"), str(tmp_path / "trace"))
    back = spark.read.json(str(tmp_path / "trace"))
    assert "signal" not in back.columns and str(back.first()["day"]) == "2026-01-02"
    shown = {r["path"]: r["kind"] for r in upkeep.preview(df([("a.pdf", b"x"), ("b.bin", b"y")], "path string, content binary")).collect()}
    assert shown == {"a.pdf": "pdf", "b.bin": "error"}


def test_split_needs_enough_text():
    with pytest.raises(models.OutputLimit):
        raise models.OutputLimit("x")
