"""Keyed tables on plain Parquet, and versions of several of them published as one.

A table is dealt into buckets by a hash of its key.  A change writes the buckets that
its keys lie in, each to a new folder (copy on write), and is published by one small
manifest that names the folders of every bucket of every table.  A manifest's name is
its version, and it appears whole or not at all and never twice: of two writers that
began at one version, the second is refused.  Readers see one version of all tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import place

#: Versions that expire() keeps.
KEPT = 5


class Conflict(Exception):
    """Another writer published a version meanwhile."""


@dataclass(frozen=True)
class Keyed:
    """A table's name and columns, its key (SQL of its rows), how many buckets that is dealt into, and SQL that parts a bucket again."""

    name: str
    schema: str
    key: str
    buckets: int = 16
    split: str | None = None

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @property
    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(",")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "facts": {}}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """The manifest appears under its version's name at once, unless that name is there already."""
        path, fs = self._path(f"versions/{manifest['version']:012d}.json")
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}.json")
        fs.mkdirs(path.getParent())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.getScheme() == "file":  # a local rename would take another's place; a link doesn't
            files, name = self.spark._jvm.java.nio.file.Files, lambda p: self.spark._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0))
            try:
                files.createLink(name(path), name(draft))
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                raise Conflict(f"version {manifest['version']} is another writer's") from None
            finally:
                fs.delete(draft, False)
        elif not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is another writer's")

    def read(self, table: Keyed, version: int | None = None, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a version; only the folders of the buckets named, if any are. A table with ``split`` shows that column, for pruning."""
        manifest = manifest or self.manifest(version)
        at = manifest["tables"].get(table.name, {})
        wanted = at if buckets is None else {b: at[b] for b in map(str, buckets) if b in at}
        columns = table.columns + (["split"] if table.split else [])
        schema = table.schema + (", split int" if table.split else "")
        if not wanted:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/{table.name}"
        return self.spark.read.schema(f"{schema}, ver string, bucket int").option("basePath", folder).parquet(*(f"{folder}/ver={v}/bucket={b}" for b, v in sorted(wanted.items()))).select(*columns)

    def change(self) -> Change:
        return Change(self, self.manifest())

    def expire(self, keep: int = KEPT) -> int:
        """Old manifests go, and the folders that none of the last ``keep`` names; returns the number of folders dropped.

        Call it when no reader of older versions and no writer is at work: a folder of a
        change that is not yet published is named by no manifest.
        """
        versions = self.versions()
        live, gone = versions[-keep:], versions[:-keep]
        used = {(t, v, b) for n in live for t, at in self.manifest(n)["tables"].items() for b, v in at.items()}
        tables = {t for n in versions for t in self.manifest(n)["tables"]}
        dropped = 0
        for n in gone:
            path, fs = self._path(f"versions/{n:012d}.json")
            fs.delete(path, False)
        for t in tables:
            for ver in self._names(t):
                for b in self._names(f"{t}/{ver}"):
                    if b.startswith("bucket=") and (t, ver[4:], b[7:]) not in used:
                        path, fs = self._path(f"{t}/{ver}/{b}")
                        fs.delete(path, True)
                        dropped += 1
                if not any(x.startswith("bucket=") for x in self._names(f"{t}/{ver}")):
                    path, fs = self._path(f"{t}/{ver}")
                    fs.delete(path, True)
        return dropped


@dataclass
class Change:
    """What one writer does to the tables of a store; nothing of it is seen before commit()."""

    store: Store
    base: dict
    ver: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    steps: int = 0

    def _now(self) -> dict:
        return {**self.base, "tables": {**self.base["tables"], **self.tables}}

    def read(self, table: Keyed, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as this change leaves it."""
        return self.store.read(table, buckets=buckets, manifest=self._now())

    def _write(self, table: Keyed, rows: DataFrame, dealt: bool = False) -> dict[str, str]:
        """Rows in a new folder, by bucket; which buckets have any. ``dealt`` rows lie by buckets as they come, and are not shuffled."""
        self.steps += 1
        ver = f"{self.ver}-{self.steps}"
        by = ["bucket"] + (["split"] if table.split else [])
        out = rows.select(*table.columns, table.bucket(F.expr(table.key)).alias("bucket"), *([F.expr(table.split).cast("int").alias("split")] if table.split else []))
        out = out if dealt else out.hint("rebalance", *by)
        out.sortWithinPartitions(*by, table.columns[0]).write.partitionBy(*by).option("compression", "zstd").parquet(f"{self.store.root}/{table.name}/ver={ver}")
        return {n[7:]: ver for n in self.store._names(f"{table.name}/ver={ver}") if n.startswith("bucket=")}

    def write(self, table: Keyed, rows: DataFrame) -> None:
        """The whole table anew."""
        self.tables[table.name] = self._write(table, rows)

    def truncate(self, table: Keyed) -> None:
        self.tables[table.name] = {}

    def touched(self, table: Keyed, keys: DataFrame) -> list[int]:
        """The buckets that keys (k) lie in; as many as there are buckets at most."""
        return sorted(r[0] for r in keys.select(table.bucket(F.col("k"))).distinct().collect())

    def runs(self, table: Keyed, keys: DataFrame, few: int) -> list[tuple[list[int], DataFrame]]:
        """The buckets that keys (k) lie in, so many together that their keys can go to all tasks, with those keys; a bucket with more of its own stands alone, and its rows are shuffled to meet them."""
        b = table.bucket(F.col("k"))
        out: list[tuple[list[int], int]] = []
        for bucket, n in sorted(map(tuple, keys.groupBy(b.alias("b")).count().collect())):  # as many as there are buckets
            if out and out[-1][1] + n <= few:
                out[-1] = (out[-1][0] + [bucket], out[-1][1] + n)
            else:
                out.append(([bucket], n))
        mine = lambda buckets: keys if len(out) == 1 else keys.where(b.isin(buckets))
        return [(buckets, F.broadcast(mine(buckets)) if n <= few else mine(buckets)) for buckets, n in out]

    def replace(self, table: Keyed, new: DataFrame | None, gone: DataFrame | None = None, touched: list[int] | None = None, keys: DataFrame | None = None, dealt: bool = False) -> list[int]:
        """K1, K2: the keys of ``new`` and of ``gone`` (one column) lose their rows, then new's are added. Returns the buckets that are written again.

        ``new`` is read more than once: give stored rows.  ``touched`` are those buckets, and ``keys`` (k)
        all keys of both, where they are known; ``dealt`` says that new's rows lie by buckets as they come.
        """
        keys = [keys] if keys is not None else [x for x in (new.select(F.expr(table.key).alias("k")) if new is not None else None, gone.select(F.col(gone.columns[0]).alias("k")) if gone is not None else None) if x is not None]
        keys = keys[0].unionByName(keys[1]) if len(keys) > 1 else keys[0]
        touched = self.touched(table, keys) if touched is None else touched
        if not touched:
            return []
        kept = self.read(table, touched).select(*table.columns)
        kept = kept.withColumn("k", F.expr(table.key)).join(keys, "k", "left_anti").select(*table.columns)
        written = self._write(table, kept if new is None else kept.unionByName(new.select(*table.columns)), dealt)
        at = self._now()["tables"].get(table.name, {})
        self.tables[table.name] = {b: v for b, v in at.items() if int(b) not in touched} | written
        return touched

    def commit(self) -> int:
        """Publishes the change as the next version; raises Conflict if another writer has."""
        version = self.base["version"] + 1
        self.store._publish({"version": version, "tables": {**self.base["tables"], **self.tables}, "facts": {**self.base["facts"], **self.facts}})
        return version


def settled(rows: DataFrame) -> DataFrame:
    """Rows that several writes need, worked out once and kept in the shared checkpoint folder."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place(rows.sparkSession, "checkpoints"))
    return rows.checkpoint(eager=True)
