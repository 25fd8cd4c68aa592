"""Streams with state: against folds in Python, cut into batches and killed in between."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators.jobs import STEPS
from loomstone.streaming import stateful, streams

EVENTS = "path string, ts timestamp, kind string"
COMMANDS = "lib string, seq long, ts timestamp, rel string, action string, front boolean"


def at(spark, rows, schema, folder, ms="ms"):
    """Another file of a folder that a stream reads."""
    names = [c.split()[0] for c in schema.split(", ")]
    cols = schema.replace("ts timestamp", "ts long")
    spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_millis("ts")).select(*names).coalesce(1).write.mode("append").parquet(folder)


def test_files_settle(spark, tmp_path):
    r, folder, checkpoint = random.Random(2), str(tmp_path / "in"), str(tmp_path / "c")
    rows, now = [], 1_000_000
    for _ in range(300):
        now += r.choice((50, 300, 1500, 2500, 9000))
        rows.append((f"raw/{r.randint(0, 5)}", now, r.choice(("add", "change", "change", "unlink"))))
    want, open_ = [], {}
    for path, ms, kind in rows:
        b = open_.get(path)
        if b and ms - b[1] >= 2000:
            want.append((path, *b[:3], "removed" if b[3] == "unlink" else "ready"))
            b = None
        open_[path] = (ms, ms, 1, kind) if b is None else (b[0], ms, b[2] + 1, kind)
    left = {p: b for p, b in open_.items() if b[1] + 2000 > rows[-1][1]}
    want += [(p, *b[:3], "removed" if b[3] == "unlink" else "ready") for p, b in open_.items() if p not in left]
    at(spark, [("x", 0, "add")], EVENTS, str(tmp_path / "none"))
    stream = lambda f: streams.arriving(spark, f, "path string, ts timestamp, kind string", per_batch=1)
    for k in range(0, 300, 100):  # three runs, each of one more file
        at(spark, rows[k : k + 100], EVENTS, folder)
        got = stateful.settled_files(stream(folder), checkpoint=checkpoint)
    assert sorted(map(tuple, got.collect())) == sorted(want) and left
    at(spark, [("raw/late", rows[-1][1] + 60_000, "add")], EVENTS, folder)
    got = stateful.settled_files(stream(folder), checkpoint=checkpoint)
    assert got.count() == len(want) + len(left)  # time has gone on


def fold(commands, lease, now=None):
    """(lib, rel) -> (status, progress, error) of the same commands, on plain lists."""
    libs, jobs = {}, {}
    for lib, seq, ms, rel, action, front in sorted(commands, key=lambda c: c[1]):
        q = libs.setdefault(lib, {"pending": [], "at": None, "since": 0, "paused": False})
        if q["at"] is not None and ms - q["since"] >= lease:
            jobs[lib, q["at"]] = ("failed", "interrupted")
            q["at"] = None
        if action == "enqueue":
            if rel not in q["pending"]:
                q["pending"].insert(0 if front else len(q["pending"]), rel)
            jobs[lib, rel] = ("queued", None)
        elif action == "claim" and q["at"] is None and not q["paused"] and q["pending"]:
            q["at"], q["since"] = q["pending"].pop(0), ms
            jobs[lib, q["at"]] = ("parsing", None)
        elif action in ("done", "fail", "restart") and q["at"] is not None:
            jobs[lib, q["at"]] = {"done": ("done", None), "fail": ("failed", "failed"), "restart": ("failed", "interrupted")}[action]
            q["at"] = None
        elif action == "remove":
            q["pending"] = [x for x in q["pending"] if x != rel]
            jobs.pop((lib, rel), None)
        elif action in ("pause", "resume"):
            q["paused"] = action == "pause"
    for lib, q in libs.items():
        if now is not None and q["at"] is not None and q["since"] + lease <= now:
            jobs[lib, q["at"]] = ("failed", "interrupted")
    return {k: (s, STEPS[s], e) for k, (s, e) in jobs.items()}


def test_queue(spark, tmp_path):
    r, folder, checkpoint = random.Random(6), str(tmp_path / "in"), str(tmp_path / "c")
    actions = ["enqueue"] * 6 + ["claim"] * 5 + ["done"] * 3 + ["fail", "restart", "remove", "pause", "resume", "resume"]
    commands, now = [], 5_000_000
    for seq in range(400):
        now += r.choice((10, 100, 700))
        commands.append((f"lib{r.randint(0, 2)}", seq, now, f"raw/{r.randint(0, 8)}", r.choice(actions), r.random() < 0.3))
    state = lambda df: {(x["lib"], x["rel"]): (x["status"], x["progress"], x["error"]) for x in stateful.job_table(df).collect()}
    stream = lambda: streams.arriving(spark, folder, COMMANDS, per_batch=1)
    for k in (0, 150, 300):
        part = commands[k : k + 150]
        at(spark, part, COMMANDS, folder)
        if k == 150:  # the second run dies while it writes; the next one does its batch again, once
            with pytest.raises(Exception, match="killed"), stateful.stateful(spark):
                rows = stateful.timed(stream()).select("lib", "ts", "ms", "seq", "rel", "action", "front").groupBy("lib").transformWithState(stateful.Queue(1000, STEPS), stateful.CHANGES, "append", "eventTime")

                def die(batch, number):
                    batch.count()
                    raise RuntimeError("killed")

                streams.drained(rows, die, "append", checkpoint)
        got = stateful.queue_changes(stream(), 1000, checkpoint)
        assert state(got) == fold(commands[: k + 150], 1000, commands[min(k + 149, 399)][2])
    assert got.groupBy("lib", "rel", "seq", "status").count().where("count > 1").count() == 0


def test_newest_prompts(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    schema = "session_id string, ts timestamp, place long, text string"
    stream = lambda: streams.arriving(spark, folder, schema, per_batch=1)
    at(spark, [("a", 1000, 1, "one"), ("a", 2000, 2, "two"), ("a", 3000, 3, ""), ("b", 3000, 1, None), ("c", 3000, 5, "x")], schema, folder)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(stateful.newest_prompts(stream(), 10_000, checkpoint)) == [("a", "two", 2), ("c", "x", 5)]
    at(spark, [(f"s{k}", 100_000 + k, k, f"p{k}") for k in range(50)], schema, folder)
    at(spark, [("a", 200_000, 9, "back"), ("c", 200_000, 4, "older")], schema, folder)
    seen = got(stateful.newest_prompts(stream(), 10_000, checkpoint))
    assert ("a", "back", 9) in seen and ("c", "x", 5) in seen and len(seen) == 52
    held = spark.read.format("statestore").option("stateVarName", "prompt").load(checkpoint).count()
    assert held == 2  # of 52 sessions, those that were heard of late


def test_nothing_has_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = streams.arriving(spark, str(tmp_path / "in"), COMMANDS)
    assert stateful.queue_changes(empty, checkpoint=str(tmp_path / "q")).count() == 0
    prompts = streams.arriving(spark, str(tmp_path / "in"), "session_id string, seq long, text string")
    assert streams.final_state(streams.latest_prompts(prompts), spark, str(tmp_path / "f")).count() == 0
