"""What keeps queries from growing faster than their tables: how rows are dealt, and what is shuffled."""

import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomstone.functions import vectors
from loomstone.operators import chunking, extraction, plans, postings
from loomstone.operators.jobs import STEPS
from loomstone.plans import catalogue, search_queries
from loomstone.sources.store import Change, Store
from loomstone.streaming.stateful import Queue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_texts_are_made_without_a_shuffle_of_words(spark, data):
    for name in ("standards_in_texts", "indicators_in_texts"):
        assert "collect_list" not in plan(catalogue.QUERIES[name](spark, data))


def test_indicators_compile_no_pattern_for_each_row(spark):
    rows = [("a", "甲醛不大于1 mg\n照度最大12米米米米米米湿度最小3m，温度≥ 4.5 ℃", ""), ("b", "12.3 照度不得超过不小于5 m/s", ""), ("c", "x" * 30 + "上限7", ""), ("d", None, ""), ("e", "甲\r乙丙不大于8", "")]
    found = extraction.indicators(spark.createDataFrame(rows, "source_path string, content string, standard_no string"))
    assert "split(line" not in plan(found)  # that one compiles its pattern for each row
    got = {(r.source_path, r.ordinal, r.indicator_name, r.value, r.unit, r.direction) for r in found.collect()}
    assert got == {("a", 1, "甲醛", 1.0, "mg", "upper"), ("a", 2, "照度", 12.0, "", "upper"), ("a", 3, "照度最大12米米米米米米湿度", 3.0, "m", "lower"), ("a", 4, "温度", 4.5, "℃", "lower"), ("b", 1, "照度不得超过", 5.0, "m/s", "lower"), ("c", 1, "x" * 20, 7.0, "", "upper"), ("e", 1, "乙丙", 8.0, "", "upper")}


def test_alike_keys_are_not_compared_with_every_text(spark):
    keys, texts = [f"abcd{k}" for k in range(500)], [(w, f"xabcd{w}y" * 3) for w in range(50)]
    found = plans.contained(spark.createDataFrame(texts, "window long, hay string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert "contains(" not in plan(found).lower()  # keys with a piece in common were each looked for in the text
    assert {(r.window, r.key) for r in found.collect()} == {(w, k) for w, t in texts for k in keys if k in t}


def test_titles_behind_enough_longer_ones_are_dropped(spark):
    pages = spark.createDataFrame([(f"entities/{t}-{k}.md", t, f"{t}{k}") for t in ("aaaa", "bbb", "cc") for k in range(3)], "path string, title string, name string")
    title = spark.createDataFrame([(1, t) for t in ("aaaa", "bbb", "cc")], "window long, title string")
    best = lambda most: {r.title for r in plans._best(title, pages, most).collect()}
    assert best(3) == {"aaaa"} and best(4) == {"aaaa", "bbb"} and best(7) == {"aaaa", "bbb", "cc"}


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    written, write = [], Change._write
    monkeypatch.setattr(Change, "_write", lambda self, table, rows, *more: written.append((table.name, more)) or write(self, table, rows, *more))
    store = Store(spark, str(tmp_path / "index"))
    chunks = lambda *texts: spark.createDataFrame([(f"{k:012d}_0", t, f"raw/{k}.txt") for k, t in enumerate(texts)], "uid string, content string, source_path string")
    for state in (chunks("thatin a", "b thatin thatin", "c"), chunks("none", "thatin")):
        change = store.change()
        postings.indexed(change, search_queries._CHUNKS, state, None)
        change.commit()
    assert [more for name, more in written if name == "postings"] == [(True,), (True,)]
    assert {(r.uid, r.tf) for r in postings.matches(store, ["thatin"]).collect()} == {("000000000001_0", 1)}
    assert store.manifest()["facts"]["chunks"] == 3


def test_a_fixed_vector_is_worked_out_once(spark):
    q, rows = [0.5, -1.25, 3.0, 0.1], [([1.0, 2.0, 3.0, 4.0],), ([0.0, 0.0, 0.0, 0.0],), ([1.5, 0.25],), ([1.0, 2.0, 3.0, 4.0, 5.0],)]
    fixed = F.array(*[F.lit(x) for x in q])
    df = spark.createDataFrame(rows, "v array<double>").select(vectors.cosine_distance(F.col("v"), fixed).alias("a"), vectors.distance_to(F.col("v"), q).alias("b"), vectors.sketch(fixed, 3).alias("c"))
    assert all(r.a == r.b and r.c == vectors.sketched(q, 3) for r in df.collect())
    assert plan(catalogue.QUERIES["sketch_shortlist"](spark, "/root/testdata/sf0.001")).count("sequence(") <= 1  # it was made again for each use


def test_chunks_leave_the_worker_a_few_texts_at_a_time(spark):
    texts = [(str(k), f"a{k}. " * 400, "t") for k in range(chunking.STEP * 2 + 1)]
    got = chunking.chunks(spark.createDataFrame(texts, "source_path string, content string, title string"), 300, 50)
    assert "mapinarrow" in plan(got).lower()  # a frame of all chunks of a batch was made before
    assert sorted(map(tuple, got.collect())) == sorted((p, i, c) for p, t, n in texts for i, c in enumerate(chunking.chunk_text(t, 300, 50, n)))


def test_pairs_of_one_name_and_unit_are_made_by_several_tasks(spark):
    rows = spark.range(400).selectExpr("concat('n', id) AS standard_no", "'1' AS clause_no", "'x' AS indicator_name", "cast(id AS double) AS value", "'m' AS unit", "'lower' AS direction")
    found = extraction.numeric_conflicts(rows.where("value < 20"), rows.where("value >= 20"))
    assert found.count() == 20 * 380 and found.distinct().count() == 20 * 380
    assert found.select(F.spark_partition_id().alias("k")).distinct().count() > 1


class _Handle:
    """A state that lies in dicts and counts how often it is asked."""

    def __init__(self):
        self.asked, self.at, self.held = 0, None, {}

    def getValueState(self, name, schema):
        handle = self

        class Value:
            exists = lambda self: handle.at is not None
            get = lambda self: handle.at

            def update(self, value):
                handle.at = value

        return Value()

    def getMapState(self, name, *schemas):
        handle, held = self, self.held.setdefault(name, {})

        def asked(f):
            def call(self, *a):
                handle.asked += 1
                return f(*a)

            return call

        return type("Map", (), {"containsKey": asked(lambda k: k in held), "getValue": asked(lambda k: held[k]), "updateValue": asked(held.__setitem__), "removeKey": asked(held.__delitem__)})()

    listTimers = lambda self: []
    registerTimer = deleteTimer = lambda self, t: None


def test_a_batch_of_commands_asks_the_state_for_each_file_once():
    r = random.Random(5)
    commands = [Row(seq=k, ms=k * 10, rel=f"r{r.randrange(20)}", action=r.choice(["enqueue", "enqueue", "claim", "done", "fail", "remove", "pause", "resume", "restart"]), front=r.random() < 0.3) for k in range(3000)]

    def said(*batches):
        handle = _Handle()
        out, queue = [], Queue(300, STEPS)
        queue.init(handle)
        for rows in batches:
            r.shuffle(rows)
            out += queue.handleInputRows(("a",), iter(rows), None)
        return out, handle

    (one, first), (many, second) = said(commands[:]), said(*[commands[k : k + 7] for k in range(0, 3000, 7)])
    assert one == many and first.at == second.at
    assert {k: list(v) for k, v in first.held.items()}.keys() == second.held.keys() and all(first.held[k] == second.held[k] for k in first.held)
    assert first.asked <= 4 * 20


def test_postings_meet_many_keys_without_a_shuffle(spark, tmp_path, monkeypatch):
    """More changed sources than go to all tasks at once: some buckets at a time."""
    plans_, write = [], Change._write
    monkeypatch.setattr(postings, "FEW", 8)
    monkeypatch.setattr(Change, "_write", lambda self, table, rows, *more: plans_.append((table.name, rows._jdf.queryExecution().executedPlan().toString())) or write(self, table, rows, *more))
    store = Store(spark, str(tmp_path / "index"))
    texts = {f"raw/{k:02d}.txt": f"{k} thatin " * (k % 3 + 1) for k in range(40)}
    chunks = lambda texts: spark.createDataFrame([(f"{path[4:6]:>012}_0", t, path) for path, t in texts.items()], "uid string, content string, source_path string")
    gone = [f"raw/{k:02d}.txt" for k in range(0, 40, 4)]
    for new, dead in ((texts, []), (fresh := {p: t + "thatin" for p, t in texts.items() if p[5] in "137"}, gone)):
        change = store.change()
        postings.indexed(change, search_queries._CHUNKS, chunks(new), spark.createDataFrame([(f"{p[4:6]:>012}",) for p in dead], "k string"))
        change.commit()
    written = [p for name, p in plans_ if name == "postings"]
    assert len(written) > 4 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in written)
    want = {f"{p[4:6]:>012}_0": t.count("thatin") for p, t in {**{p: t for p, t in texts.items() if p not in gone}, **fresh}.items()}
    assert {r.uid: r.tf for r in postings.matches(store, ["thatin"]).collect()} == want
    assert store.manifest()["facts"] == postings.facts(store.read(search_queries._CHUNKS)) and store.manifest()["facts"]["chunks"] == len(want)


def test_indexed_search_keeps_one_state_on_disk(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(search_queries, "place", lambda spark, name: str(tmp_path / name))
    got = [r.uid for r in catalogue.QUERIES["indexed_search"](spark, data).collect()]
    store = Store(spark, str(tmp_path / "index"))
    assert len(got) == 10 and store.versions() == [3]
    for table, at in store.manifest()["tables"].items():
        assert {f"ver={v}" for v in at.values()} == set(store._names(table))


def test_places_are_kept_in_few_bytes(spark):
    r = random.Random(6)
    lists = [sorted({r.randrange(1 << r.choice((3, 8, 15, 22, 31))) for _ in range(r.choice((1, 2, 30)))}) for _ in range(300)] + [[0], [0, 1 << 30], [127, 254], [128, 256]]
    starts = np.cumsum([0, *map(len, lists)])
    packed = postings._packed(np.array([x for one in lists for x in one]), starts)
    assert postings._unpacked(packed).to_pylist() == lists and postings._unpacked(packed.slice(7, 90)).to_pylist() == lists[7:97] and postings._unpacked(packed.slice(3, 0)).to_pylist() == []
    assert postings._packed(np.arange(0, 100_000, 90), np.array([0, 1112])).nbytes < 1112 + 16


def test_postings_come_in_the_order_they_are_stored_in(spark):
    """Of ordinary texts, and of one whose places and characters do not fit one number."""
    wide = "".join(map(chr, range(0x4E00, 0x9000))) * 30
    for texts in (["thatin thatin 甲醛 😀b", "ab", "", None, "zz thatin"] * 20, [wide, wide[:50], "a😀b"]):
        rows = [(f"{k:012d}_0", t, f"raw/{k}.txt") for k, t in enumerate(texts)]
        made = postings.postings(spark.createDataFrame(rows, "uid string, content string, source_path string").coalesce(1))
        p = postings.POSTINGS
        got = [tuple(r) for r in postings.placed(made).select(p.bucket(F.expr(p.key)), F.expr(p.split), "gram", "uid", "at").collect()]
        assert [r[:4] for r in got] == sorted(r[:4] for r in got)
        want = {}
        for uid, t, path in rows:
            for s, start in ((t or "", 0), (path, len(t or "") + postings.GAP)):
                for k in range(len(s) - 2):
                    want.setdefault((postings.code(s[k : k + 3]), uid), []).append(start + k)
        assert {(g, uid): at for _, _, g, uid, at in got} == want
