"""Versioned tables on plain Parquet (K1-K3, K10): one table of a store, written whole or by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.sources.store import Keyed, Store


class SnapshotTable:
    """A small table whose readers see the last version published; of two writers that began at one version the second is refused."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.store, self.table = Store(spark, root), Keyed("rows", schema, schema.split()[0], buckets=1)

    def version(self) -> int:
        return self.store.version()

    def read(self) -> DataFrame:
        return self.store.read(self.table)

    def write(self, rows: DataFrame) -> int:
        """Publishes rows as the next version."""
        change = self.store.change()
        change.write(self.table, rows)
        return change.commit()

    def replace(self, new: DataFrame, key: str) -> int:
        """K1: rows of the keys that new has give way to new's."""
        from loomstone.operators.relations import upsert

        return self.write(upsert(self.read(), new, key))

    def delete(self, gone: DataFrame, key: str) -> int:
        from loomstone.operators.relations import without

        return self.write(without(self.read(), gone, key))

    def truncate(self) -> int:
        change = self.store.change()
        change.truncate(self.table)
        return change.commit()
