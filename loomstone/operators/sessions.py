"""Personas and request traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "default"


def active(personas: DataFrame) -> DataFrame:
    """The active personas, and the default one even if none is stored."""
    return personas.where("status = 1")


def bound(assignments: DataFrame, personas: DataFrame) -> DataFrame:
    """(session_id, persona_id), null where it is unknown or inactive."""
    live = active(personas).select(F.col("id").alias("persona_id"), F.lit(True).alias("live"))
    return assignments.join(live, "persona_id", "left").select("session_id", F.when(F.col("live"), F.col("persona_id")).alias("persona_id"))


def default_bindings(sessions: DataFrame, assignments: DataFrame, default_persona: str) -> DataFrame:
    """A session without a binding gets the default, unless that is the built-in one."""
    rows = sessions.join(assignments, "session_id", "left")
    return rows.withColumn("persona_id", F.coalesce("persona_id", F.lit(default_persona))) if default_persona != DEFAULT else rows


def latest(personas: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest version of each persona after changes (id, name, content, status, seq); the built-in one is not changed."""
    both = personas.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes.where(F.col("id") != DEFAULT))
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def trace_summary(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages, characters in all and of the system for each request."""
    n = F.length(F.coalesce("text", F.lit("")))
    return messages.groupBy(key).agg(F.count("*").alias("messages"), F.sum(n).alias("chars"), F.sum(F.when(F.col("role") == "system", n).otherwise(0)).alias("system_chars"), F.max_by("role", order).alias("last_role"))


def trace_label(seq: Column, stamp: Column, session: Column) -> Column:
    """the file name of a request; stamp is a timestamp in UTC."""
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    name = F.concat(F.lpad(seq.cast("string"), F.greatest(F.lit(3), F.length(seq.cast("string"))), F.lit("0")), F.lit("-"), iso, F.lit("-"), F.coalesce(session, F.lit("no-session")))
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")


def stream_fold(parts: DataFrame) -> DataFrame:
    """(call_id, text, types, outcome, first_delta_ms) of the parts of each call."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "type", "text", "finish_kind", "t_ms")))
    rows = parts.groupBy("call_id").agg(ordered.alias("p"))
    kinds = F.array_distinct(F.transform("p", lambda x: x["type"]))
    types = F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(":"), F.size(F.filter("p", lambda x: x["type"] == k)).cast("string"))), ",")
    deltas = F.filter("p", lambda x: x["type"] == "text-delta")
    last = F.try_element_at(F.filter("p", lambda x: x["type"] == "finish"), F.lit(-1))["finish_kind"]
    return rows.select("call_id", F.array_join(F.transform(deltas, lambda x: x["text"]), "").alias("text"), types.alias("types"), F.when(last == "stop", "ok").otherwise("error").alias("outcome"), F.when(F.size(deltas) > 0, F.try_element_at(deltas, F.lit(1))["t_ms"]).alias("first_delta_ms"))


def route(*pairs: tuple[Column, Column]) -> Column:
    """the first pair whose parts are both there."""
    return F.coalesce(*[F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), F.struct(a.alias("provider"), b.alias("model"))) for a, b in pairs])
