"""The stored index gives what a scan of all chunks gives, after any change."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators import postings, search
from loomstone.sources.store import Keyed, Store

CHUNKS = Keyed("chunks", "uid string, content string, source_path string", postings.TAG)


def rows_of(spark, sources):
    """Chunks of sources {path: [contents]}."""
    rows = [(p, i, t) for p, ts in sources.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "source_path string, i int, content string").select(text.uid(F.col("source_path"), F.col("i")).alias("uid"), "content", "source_path")


def change(spark, store, new=None, gone=()):
    c = store.change()
    dead = spark.createDataFrame([(p,) for p in gone], "p string").select(F.expr("substring(sha2(p, 256), 1, 12)").alias("k")) if gone else None
    touched = postings.indexed(c, CHUNKS, rows_of(spark, new) if new else None, dead)
    c.commit()
    return touched


def same(store, terms, top=10):
    show = lambda df: [(r["uid"], round(r["score"], 9)) for r in df.collect()]
    got = show(postings.search(store, terms, top))
    assert got == show(search.bm25(store.read(CHUNKS), terms, top))
    return got


def test_equals_a_scan_after_changes(spark, tmp_path):
    r, store = random.Random(4), Store(spark, str(tmp_path / "s"))
    words = ["alpha", "aaaa", "aaa", "ALPHAbet", "甲醛浓度", "限值甲醛", "ünï", "a😀b", "İstanbul", "beta", "alp", "ha al"]
    say = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
    assert same(store, ["alpha"]) == []
    sources = {f"raw/{k % 3}/alpha{k}.md": [say() for _ in range(r.randint(1, 4))] for k in range(12)}
    sources["raw/odd.md"] = ["", "ab", "abc"]
    change(spark, store, sources)
    queries = [["alpha"], ["aaa"], ["aaaa", "alpha", "alpha"], ["甲醛浓"], ["alphabet", "raw/1"], ["nowhere", "beta"], ["ab"], [], ["😀b "], ["a aaa"], ["md"], [".md"]]
    for q in queries:
        same(store, q)
    before = store.manifest()["tables"]
    touched = change(spark, store, {"raw/1/alpha1.md": ["alpha beta gamma"]}, ["raw/2/alpha2.md", "raw/none.md"])
    after = store.manifest()["tables"]
    for t in ("chunks", "postings"):  # the other buckets stay as they are
        assert {b for b in {*before[t], *after[t]} if before[t].get(b) != after[t].get(b)} <= set(map(str, touched))
    assert store.manifest()["facts"] == postings.facts(store.read(CHUNKS))
    for q in queries[:4]:
        same(store, q)
    assert store.read(CHUNKS).where("source_path = 'raw/2/alpha2.md'").count() == 0
    change(spark, store, gone=list(sources))
    assert store.manifest()["facts"] == {"chunks": 0, "length": 0} and same(store, ["alpha"]) == [] and store.read(postings.POSTINGS).count() == 0


def test_reads_the_parts_of_its_terms(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    change(spark, store, {f"raw/{k}.md": [f"alpha beta {k}"] for k in range(20)})
    found = postings.matches(store, ["alpha"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(gram", plan)
    assert re.search(r"PartitionFilters: \[.*split#\d+ (IN \(\d(,\d){0,2}\)|= \d)", plan)


@pytest.mark.parametrize("gram", ["abc", "甲醛浓", "a😀b"])
def test_codes_are_one_to_one(gram):
    assert postings.code(gram) < 2**63 and [postings.code(gram) >> s & (1 << 21) - 1 for s in (42, 21, 0)] == list(map(ord, gram))
