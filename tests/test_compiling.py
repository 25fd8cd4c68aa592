"""Compiling in rounds, against a recursion in Python; retrieval for many windows, against one search each."""

import json
import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomstone.corpus import CHUNKS, VECTORS, Corpus
from loomstone.operators import compiling, plans, postings, search
from loomstone.operators.chunking import SHARED
from loomstone.operators.models import Budget, OutputLimit
from loomstone.workspace import PAGES, Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


def embed(texts):
    return [[float(t.lower().count(w)) + 0.01 for w in ("alpha", "beta", "gamma")] for t in texts]


def test_many_searches_are_one(spark, tmp_path):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "alphabet", "甲醛浓度", "ab"]) for _ in range(n))
    c = Corpus(spark, str(tmp_path / "c"), embed=embed)
    c.ingest(spark.createDataFrame([(f"raw/{k}.md", say(r.randint(1, 40))) for k in range(15)], "source_path string, content string"))
    asked = [(f"q{k}", k, say(r.randint(1, 6))) for k in (0, 1, 3, 7, 8)] + [("none", 3, "ab"), ("blank", 4, " ")]
    queries = spark.createDataFrame(asked, "id string, window int, content string")
    got = {}
    for x in postings.search_many(c.store, queries.withColumnRenamed("content", "query"), 4).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["uid"], round(x["score"], 9)))
    for i, _, q in asked:
        one = postings.search(c.store, search.query_terms(q), 4).collect()
        assert sorted(got.get(i, [])) == [(k + 1, x["uid"], round(x["score"], 9)) for k, x in enumerate(one)]
    found = {}
    for x in compiling.related(c.store, c.read(VECTORS), queries, embed, 3).collect():
        found.setdefault(x["id"], {})[x["uid"]] = round(x["score"], 9)
    for i, w, q in asked[:5]:
        lexical = postings.search(c.store, search.query_terms(q), 10)
        if w == 0 or (w + 1) % 8 == 0:
            rows = search.fuse(lexical, search.vector_top(c.read(VECTORS), embed([q])[0], 20)).orderBy(F.desc("score"), "uid").limit(3)
        else:
            rows = lexical.limit(3)
        assert found.get(i, {}) == {x["uid"]: round(x["score"], 9) for x in rows.collect()}


def model(prompt, tokens):
    """Fails, truncates and answers by what the text is about."""
    text = prompt.rsplit("\n\n", 1)[-1]
    if "never" in text:
        raise RuntimeError("down")
    if "silent" in text:
        return None
    if len(text) > 3000 or "long" in text and tokens < 400:
        raise OutputLimit('{"operations": [{"path"')
    ops = [{"path": f"entities/{w}.md", "content": f"{w} of {len(text)}"} for w in sorted(set(text.split())) if w.startswith("w")]
    return json.dumps({"operations": [*ops, {"path": "sources/no.md", "content": "no"}, {"path": "../x.md", "content": "no"}]})


def recursion(text, limits, depth=0):
    """The operations of one window, or None."""
    tokens, limited = limits.floor, False
    splits = depth < 2 and len(text) >= 2000
    for _ in range(3):
        raw, cut = "", False
        try:
            raw = model(text, tokens) or ""
        except OutputLimit:
            cut = True
        except RuntimeError:
            pass
        if plans.parse_plan(raw) is not None:
            return [o for o in plans.parse_plan(raw) if o[1].startswith("entities/")]
        if not cut:
            continue
        limited = True
        if tokens >= limits.ceiling:
            if splits:
                break
            continue
        tokens = min(2 * tokens, limits.ceiling)
    if not (splits and limited):
        return None
    mid = len(text) // 2
    parts = [recursion(t, limits, depth + 1) for t in (text[: mid + SHARED], text[max(mid - SHARED, 0) :])]
    return None if all(p is None for p in parts) else [o for p in parts for o in p or []]


def test_rounds_equal_the_recursion(spark):
    limits, waits = Budget(100, 400, 2000), []
    texts = ["w1 w2", "never w3", "silent", "long w4", "w5 " * 1500, "long w6 " * 1200, "w7 " * 5000, "", "never " * 500]
    rows = spark.createDataFrame([(f"raw/{k % 2}", k, t) for k, t in enumerate(texts)], "source_path string, window int, content string")
    ops = compiling.proposed(rows, model, limits, lambda p: p.select("id", F.col("content").alias("prompt")), wait=waits.append)
    got = {}
    for x in sorted(ops.collect(), key=lambda x: (x["window"], x["part"], x["seq"])):
        got.setdefault(x["window"], []).append((x["kind"], x["path"], x["content"]))
    for k, t in enumerate(texts):
        assert got.get(k, []) == (recursion(t, limits) or [])
    assert set(waits) <= {1.0, 4.0} and waits
    tight = compiling.proposed(rows.where("window = 4"), model, limits, lambda p: p.select("id", F.col("content").alias("prompt")), context=2800, wait=waits.append)
    assert {x["part"] for x in tight.collect()} == {"00", "01", "10", "11"}  # split before it was asked


def test_workspace_compiles(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def ask(prompt, tokens):
        with open(seen, "a") as f:
            f.write(prompt + "\n====\n")
        return json.dumps({"operations": [{"path": "entities/alpha-one.md", "content": "---\ntitle: Alpha\n---\nnew alpha"}, {"path": "concepts/wombat.md", "content": "wombat"}]})

    w = Workspace(Corpus(spark, str(tmp_path / "w"), complete=ask))
    w.write_page("entities/alpha.md", "---\ntitle: Alpha\n---\nold alpha page")
    w.upload(spark.createDataFrame([(1, "raw/a.md", "all about alpha and more")], "seq int, rel string, content string"))
    w.ingest()
    got = {r["path"]: r["outcome"] for r in w.compile().collect()}
    assert got == {"entities/alpha.md": "updated", "concepts/wombat.md": "created"}  # a page of that title was there
    prompt = open(seen).read()
    assert "- entities/alpha.md Alpha" in prompt and "old alpha page" in prompt and prompt.count("all about alpha") >= 1
    assert [r["source_path"] for r in w.corpus.search("wombat").collect()] == ["wiki/concepts/wombat.md"]
    assert w.read_page("entities/alpha.md").endswith("new alpha") and w.read(PAGES).count() == 3
    assert Workspace(Corpus(spark, str(tmp_path / "w"))).compile().count() == 0 and w.read(CHUNKS).count() >= 3
