"""The pipeline's rows against stages worked out in plain Python."""

import collections
import re

import corpus_pipeline
from pyspark.sql import functions as F
from loomstone.llm import common, decontamination, mixing, quality

from test_operators import brute_components, brute_contamination, brute_pii


def test_stages_take_effect(spark, data):
    docs = common.table(spark, data, "documents")
    first = docs.columns
    judged = {r["doc_id"]: r["keep"] for r in quality.quality(docs, common.table(spark, data, "labels")).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if judged[r["doc_id"]]}
    _, find = brute_components([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if find(i) == i}
    windows = collections.defaultdict(set)
    for r in common.table(spark, data, "benchmark").collect():
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", r["text"].translate({i: i + 32 for i in range(65, 91)}))
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            windows[tuple(w[k : k + n])].add(r["item_id"])
    near = collections.defaultdict(dict)  # by their first word, as a full test is slow here
    for x, ids in windows.items():
        near[x[0]][x] = ids

    def contaminated(text):
        present = set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.translate({i: i + 32 for i in range(65, 91)})))
        return brute_contamination(text, {x: ids for w in present for x, ids in near[w].items() if set(x) <= present})[4]

    rows = {i: r for i, r in rows.items() if not contaminated(r["text"])}
    out = corpus_pipeline.run(spark, data)
    assert set(first) <= set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) <= set(rows)
    for i, r in got.items():
        assert not brute_pii(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_pii(rows[i]["text"]):
            assert r["text"] == rows[i]["text"] and r["lang"] == rows[i]["lang"]
    # the last stage takes what mix() says of the documents before it
    stored = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stored = stage(spark, stored, data)
        assert stored.columns == first
        stored = common.stored(stored)
    assert {r["doc_id"] for r in stored.collect()} == set(rows)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(stored).where("copies > 0").collect()}
    assert collections.Counter(r["doc_id"] for r in out.select("doc_id").collect()) == collections.Counter(want)
    assert decontamination.contamination(out, common.table(spark, data, "benchmark")).where("contaminated").count() == 0


def test_stages_take_odd_rows(spark, docs, labels, items, empty, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names, and no rows at all."""
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    nulls = spark.createDataFrame([tuple([None] * len(docs.columns))], docs.schema)
    rows = docs.unionByName(nulls).unionByName(nulls).drop("copies").withColumn("copy", F.lit(5))
    for table in (rows, empty.drop("copies").withColumn("copy", F.lit(5))):
        first, step = table.columns, table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = step.count()
            step = common.stored(stage(spark, step, str(tmp_path)))
            assert step.columns == first and step.count() <= before, name
            if name != "near_copies" and before:
                assert step.where("doc_id is null and text is null").count() == 2, name
        mixed = mixing.mix(step).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies")).where("copies > 0").collect()
        out = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).collect()
        assert len(out) == sum(r["copies"] for r in mixed) and all(r["copy"] == 5 and r["copy_"] >= 1 for r in out)
