"""Streams with a state of their own for each key (T1-T5, L11, S18): files that settle, work queues, newest prompts.

Each is a processor for ``transformWithState``: value and map state in RocksDB, timers
in event time.  State and progress lie in the stream's checkpoint folder, and batches
are written to folders of their numbers, so a stream that is killed goes on from its
last whole batch and gives each row once.  Rows of one batch are taken in order of time
(or sequence), so results do not depend on how the input is cut into batches as long as
later batches hold later rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstone.session import findable, place
from loomstone.streaming import streams

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession):
    """The state store that processors need, while a stream is started."""
    had = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, had)


def timed(rows: DataFrame, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Rows with a watermark, and ``ms``, their time in whole milliseconds, as timers have it."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("ms", F.unix_millis(ts))


def run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a processor says of what has arrived, this run's rows and those of the runs before; a restart with the same checkpoint folder goes on where it ended."""
    spark = rows.sparkSession
    checkpoint = checkpoint or place(spark, "progress")
    findable(spark)
    with stateful(spark):
        streams.drained(rows.groupBy(key).transformWithState(processor, schema, mode, "eventTime"), streams.kept(f"{checkpoint}-rows"), mode, checkpoint)
    return streams.written(spark, f"{checkpoint}-rows", schema)


class Settling(StatefulProcessor):
    """A path's events (ms, kind) become one row when nothing has happened for ``quiet`` milliseconds: what the last one left."""

    def __init__(self, quiet: int, removal: str = "unlink"):
        self.quiet, self.removal = quiet, removal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.burst = handle, handle.getValueState("burst", "first_ms long, last_ms long, n long, kind string")

    def _row(self, path, burst) -> Row:
        return Row(path=path, first_ms=burst[0], last_ms=burst[1], n=burst[2], action="removed" if burst[3] == self.removal else "ready")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        burst = self.burst.get() if self.burst.exists() else None
        for ms, kind in sorted((r["ms"], r["kind"]) for r in rows):
            if burst and ms - burst[1] >= self.quiet:
                yield self._row(key[0], burst)
                burst = None
            burst = (ms, ms, 1, kind) if burst is None else (burst[0], max(ms, burst[1]), burst[2] + 1, kind if ms >= burst[1] else burst[3])
        self.burst.update(burst)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(burst[1] + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            yield self._row(key[0], self.burst.get())
            self.burst.clear()

    def close(self) -> None:
        pass


SETTLED = "path string, first_ms long, last_ms long, n long, action string"


def settled_files(events: DataFrame, quiet: int = 2000, late: str = "0 seconds", checkpoint: str | None = None) -> DataFrame:
    """Events (path, ts, kind) of files, one row for each burst that has been over for ``quiet`` milliseconds: ready, or removed. The last bursts stay in the state until time has gone on."""
    return run(timed(events, late=late).select("path", "ts", "ms", "kind"), "path", Settling(quiet), SETTLED, checkpoint=checkpoint)


_CHANGE = Row("lib", "rel", "status", "progress", "error", "seq")


def _in_order(rows: Iterator[Row]) -> Iterator[tuple]:
    """Commands as (seq, ms, rel, action, front), in that order; held as numbers, names once each."""
    seqs, times, codes, names = array("q"), array("q"), array("q"), {}
    for r in rows:
        seqs.append(r["seq"])
        times.append(r["ms"])
        codes.append(names.setdefault((r["rel"], r["action"], bool(r["front"])), len(names)))
    ranked = sorted(names)
    rank = np.empty(len(names), np.int64)
    rank[[names[x] for x in ranked]] = np.arange(len(names))
    seq, ms, code = np.frombuffer(seqs, np.int64), np.frombuffer(times, np.int64), rank[np.frombuffer(codes, np.int64)]
    order = np.lexsort((code, ms, seq))
    for k in range(0, len(order), 10_000):
        part = order[k : k + 10_000]
        for s, m, c in zip(seq[part].tolist(), ms[part].tolist(), code[part].tolist(), strict=True):
            yield (s, m, *ranked[c])


class Queue(StatefulProcessor):
    """One library's queue of files, as commands (seq, ms, rel, action, front) change it.

    ``enqueue`` puts a file at the end, or with ``front`` before all others; one that
    waits already keeps its place, and either way its state starts anew.  ``claim``
    takes the next file if none is at work and the queue is not paused; ``done`` and
    ``fail`` end the one at work, ``remove`` forgets a file, ``pause`` and ``resume``
    do what they say, and ``restart`` fails what was at work.  A claim is a lease: after
    ``lease`` milliseconds without an end the file has failed.  Waiting files lie in a
    map from their place to their name, places running downwards in front and upwards
    behind, so no command reads the queue.  The commands of one batch work on what they
    have seen of the state, which is asked for each file once and told what is left.
    """

    def __init__(self, lease: int, steps: dict[str, int], interrupted: str = "interrupted"):
        self.lease, self.steps, self.interrupted = lease, steps, interrupted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.control = handle.getValueState("control", "paused boolean, head long, tail long, rel string, since long, seq long")
        self.waiting = handle.getMapState("waiting", "place long", "rel string")
        self.places = handle.getMapState("places", "rel string", "place long")

    def _said(self, lib, rel, status, seq, error=None) -> Row:
        return _CHANGE(lib, rel, status, self.steps[status], error, seq)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lib, fresh = key[0], not self.control.exists()
        # places from head up to, not including, tail; ``at`` is the file at work
        paused, head, tail, at, since, last = (False, 0, 0, None, None, None) if fresh else self.control.get()
        # what these commands have seen of the state and changed in it; the state is told at the end
        had, places, waiting = {}, {}, {}

        def place_of(rel):
            if rel not in places:
                had[rel] = places[rel] = None if fresh or not self.places.containsKey((rel,)) else self.places.getValue((rel,))[0]
            return places[rel]

        def waits(place):
            if place not in waiting and not fresh and self.waiting.containsKey((place,)):
                waiting[place] = self.waiting.getValue((place,))[0]
            return waiting.get(place)

        def forget(rel):
            waiting[place_of(rel)], places[rel] = None, None

        for seq, ms, rel, action, front in _in_order(rows):
            if at is not None and ms - since >= self.lease:
                yield self._said(lib, at, "failed", last, self.interrupted)  # before this command, after the last one
                at = None
            last = seq
            if action == "enqueue":
                if place_of(rel) is None:
                    place, head, tail = (head - 1, head - 1, tail) if front else (tail, head, tail + 1)
                    waiting[place], places[rel] = rel, place
                yield self._said(lib, rel, "queued", seq)
            elif action == "claim" and at is None and not paused:
                while head < tail and waits(head) is None:
                    head += 1  # one that was removed
                if head < tail:
                    at, since = waits(head), ms
                    forget(at)
                    head += 1
                    yield self._said(lib, at, "parsing", seq)
            elif action in ("done", "fail", "restart") and at is not None:
                yield self._said(lib, at, "done" if action == "done" else "failed", seq, {"fail": "failed", "restart": self.interrupted}.get(action))
                at = None
            elif action == "remove":
                if place_of(rel) is not None:
                    forget(rel)
                yield _CHANGE(lib, rel, "removed", 0, None, seq)
            elif action in ("pause", "resume"):
                paused = action == "pause"
        for rel, place in places.items():
            if place != had[rel]:
                if had[rel] is not None:
                    self.waiting.removeKey((had[rel],))
                if place is None:
                    self.places.removeKey((rel,))
                else:
                    self.places.updateValue((rel,), (place,))
        for rel, place in places.items():  # behind the removals, as a place may have got another file
            if place is not None and place != had[rel]:
                self.waiting.updateValue((place,), (rel,))
        self.control.update((paused, head, tail, at, since, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(since + self.lease)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        paused, head, tail, at, since, last = self.control.get()
        if at is not None:
            yield self._said(key[0], at, "failed", last, self.interrupted)
            self.control.update((paused, head, tail, None, None, last))

    def close(self) -> None:
        pass


CHANGES = "lib string, rel string, status string, progress int, error string, seq long"


def queue_changes(commands: DataFrame, lease: int = 600_000, checkpoint: str | None = None) -> DataFrame:
    """Every change of state of files' jobs that commands (lib, seq, ts, rel, action, front) make, in the order of ``seq`` within a library."""
    from loomstone.operators.jobs import STEPS

    rows = timed(commands).select("lib", "ts", "ms", F.col("seq").cast("long").alias("seq"), "rel", "action", "front")
    return run(rows, "lib", Queue(lease, STEPS), CHANGES, checkpoint=checkpoint)


def job_table(changes: DataFrame) -> DataFrame:
    """The last state of each file's job; a lease that ran out after a command has that one's ``seq`` and counts. Removed files have none."""
    rank = F.when(F.col("error") == "interrupted", 1).otherwise(0)
    last = changes.groupBy("lib", "rel").agg(F.max_by(F.struct("status", "progress", "error", "seq"), F.struct("seq", rank)).alias("x"))
    return last.select("lib", "rel", "x.*").where("status <> 'removed'")


class Newest(StatefulProcessor):
    """A session's newest prompt (place, text); what has been silent for ``idle`` milliseconds leaves the state."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.prompt = handle, handle.getValueState("prompt", "place long, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.prompt.get() if self.prompt.exists() else None
        place, text, heard = None, None, had[1] if had else 0
        for r in rows:
            heard = max(heard, r["ms"])
            if place is None or (r["place"], r["text"]) > (place, text):
                place, text = r["place"], r["text"]
        if had is None or place > had[0]:
            yield Row(session_id=key[0], prompt=text, last=place)
        self.prompt.update((place if had is None else max(place, had[0]), heard))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(heard + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.prompt.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_prompts(events: DataFrame, idle: int = 3_600_000, checkpoint: str | None = None) -> DataFrame:
    """T4: (session_id, prompt, last) as prompts (session_id, ts, place, text) come, the newest one of each session that is not empty.

    The state holds the sessions of the last ``idle`` milliseconds only, whatever their
    number so far; the texts are in the rows that were written.
    """
    rows = timed(events).where(F.coalesce("text", F.lit("")) != "").select(F.col("session_id").cast("string").alias("session_id"), "ts", "ms", F.col("place").cast("long").alias("place"), "text")
    said = run(rows, "session_id", Newest(idle), "session_id string, prompt string, last long", "update", checkpoint)
    return said.groupBy("session_id").agg(F.max_by("prompt", "last").alias("prompt"), F.max("last").alias("last"))
