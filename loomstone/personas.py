"""A mutable table of personas and the sessions bound to them (K12, X10, J15, T11), on versioned snapshots."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import sessions, upkeep
from loomstone.sources.snapshots import SnapshotTable

PERSONAS = "id string, name string, content string, status int, create_time string, update_time string"
BOUND = "session_id string, persona_id string"


class PersonaTable:
    """The built-in persona is always there and can be neither changed nor deleted; deleting keeps the row."""

    def __init__(self, spark: SparkSession, root: str, default: str = sessions.DEFAULT):
        self.spark, self.default = spark, default
        self.rows, self.bindings = SnapshotTable(spark, f"{root}/personas", PERSONAS), SnapshotTable(spark, f"{root}/bindings", BOUND)

    def all(self) -> DataFrame:
        return upkeep.personas(self.rows.read())

    def active(self) -> DataFrame:
        return sessions.active(self.all()).select("id", "name", "content")

    def _put(self, key: str, name: str, content: str, status: int, created: str | None = None) -> None:
        if key == sessions.DEFAULT:
            raise ValueError("the built-in persona stays as it is")
        if not name.strip():
            raise ValueError("a persona needs a name")
        now = datetime.now(UTC).isoformat(timespec="milliseconds")
        self.rows.replace(self.spark.createDataFrame([(key, name.strip(), content, status, created or now, now)], PERSONAS), "id")

    def _one(self, key: str):
        row = self.all().where((F.col("id") == key) & (F.col("status") == 1)).first()
        if row is None:
            raise KeyError(key)
        return row

    def create(self, name: str, content: str) -> str:
        key = str(uuid.uuid4())
        self._put(key, name, content, 1)
        return key

    def update(self, key: str, name: str, content: str) -> None:
        self._put(key, name, content, 1, self._one(key)["create_time"])

    def delete(self, key: str) -> None:
        row = self._one(key)
        self._put(key, row["name"], row["content"], 0, row["create_time"])

    def assign(self, session: str, key: str | None) -> None:
        """Binds a session; an unknown or deleted persona, or none, clears the binding."""
        known = key is not None and self.active().where(F.col("id") == key).limit(1).count() > 0
        row = self.spark.createDataFrame([(session, key)], BOUND)
        self.bindings.replace(row, "session_id") if known else self.bindings.delete(row, "session_id")

    def started(self, new: DataFrame) -> DataFrame:
        """(session_id, persona_id) of sessions that start: their binding, else the default."""
        return sessions.default_bindings(new.select("session_id"), self.bindings.read(), self.default)

    def of_sessions(self) -> DataFrame:
        return sessions.bound(self.bindings.read(), self.all())
