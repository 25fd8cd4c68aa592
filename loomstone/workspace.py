"""Files, pages, jobs and log around a corpus, and the registry of corpora.

Raw files are the source of truth; everything else is made from them or written by
hand.  What is searched is the pages: a file's text stands in its page once, and a
page written by hand is found like any other.  All tables lie in the corpus's store,
so whatever a call changes, index included, becomes one version, or none if it fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.corpus import BY_SOURCE, CHUNKS, INDICATORS, VECTORS, Corpus
from loomstone.functions import text
from loomstone.operators import jobs, pages, plans, relations, upkeep
from loomstone.operators.postings import POSTINGS
from loomstone.sources.snapshots import SnapshotTable
from loomstone.sources.store import Change, Keyed, settled

RAW = Keyed("raw", "source_path string, content string, hash string", BY_SOURCE)
#: The hash that each source had when it was last read.
SOURCES = Keyed("sources", "source_path string, hash string", BY_SOURCE)
PAGES = Keyed("pages", "path string, content string", "path")
MARKS = Keyed("marks", "page_path string, edited boolean, updated_at string", "page_path", buckets=4)
JOBS = Keyed("jobs", "rel string, status string, progress int, error string, updated_at string", "rel", buckets=4)
LIBRARIES = "id string, name string, root_dir string"
ACTIVE = "id string"
#: The actions of the log and what its notes say.
DELETED, REBUILT = "删除来源", "整库重建"
#: Fixed value: why a file without text failed.
NO_TEXT = "文件没有可索引的文本内容"
PATH, FILES, MIRRORS, CLEARED, AGAIN = "路径：", "删除文件：", "连带删除镜像页：", "清空页面：", "重新处理："


def digest(content: str):
    return F.sha2(F.col(content).cast("binary"), 256)


def _stamp():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS")


class Workspace:
    """What a user does with one corpus; search, recall, conflicts and lint are the corpus's own."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.spark, self.store = corpus, corpus.spark, corpus.store

    def read(self, table: Keyed) -> DataFrame:
        return self.corpus.read(table)

    def _safe(self, rows: DataFrame, path: str) -> None:
        wrong = rows.where(~text.safe_path(F.col(path))).select(path).first()
        if wrong:
            raise ValueError(f"not a path below raw/: {wrong[0]}")

    def _below(self, prefix: str) -> DataFrame:
        self._safe(self.spark.createDataFrame([(prefix,)], "p string"), "p")
        return relations.under(self.read(RAW), prefix)

    def _note(self, action: str, *details: str) -> None:
        stamp, lines = F.current_timestamp(), F.array(*[F.lit(x) for x in details])
        upkeep.appended(self.spark.range(1).select(upkeep.log_note(stamp, F.lit(action), lines).alias("block")), f"{self.corpus.root}/log")

    def upload(self, uploads: DataFrame) -> DataFrame:
        """K8: uploads (seq, rel, content) are stored, each under a free name, and queued; (seq, rel, status, stored). Ingest reads them later."""
        self._safe(uploads, "rel")
        hashed = uploads.withColumn("hash", digest("content"))
        outcome = settled(relations.upload_outcome(self.read(RAW).select(F.col("source_path").alias("rel"), "hash"), hashed.select("seq", "rel", "hash")))
        new = settled(hashed.drop("rel").join(outcome.where("status <> 'duplicate'").select("seq", F.col("stored").alias("source_path")), "seq"))
        change = self.store.change()
        change.replace(RAW, new)
        self._jobs(change, new, F.lit("queued"))
        change.commit()
        return outcome

    def _jobs(self, change: Change, files: DataFrame, status, error=None) -> None:
        """The jobs of files (source_path) as they stand now."""
        steps = F.create_map(*[F.lit(x) for kv in jobs.STEPS.items() for x in kv])
        change.replace(JOBS, files.select(F.col("source_path").alias("rel"), status.alias("status"), steps[status].alias("progress"), (F.lit(None).cast("string") if error is None else error).alias("error"), _stamp().alias("updated_at")))

    def list_jobs(self) -> DataFrame:
        """The files' jobs, those at work first, then the latest."""
        return self.read(JOBS).orderBy(F.when(F.col("status") == "queued", 0).otherwise(1), F.desc("updated_at"), "rel")

    def progress(self) -> DataFrame:
        """A3."""
        return jobs.progress(self.read(JOBS))

    def list_files(self, folder: str = "raw") -> DataFrame:
        """(name, is_leaf, n) of what is in a folder, folders first, with the number of files below each."""
        inside = self._below(folder).where(F.col("source_path") != folder).select("source_path")
        edges = relations.tree_edges(inside).where(F.col("parent") == folder.rstrip("/"))
        return edges.select(text.basename(F.col("child")).alias("name"), "is_leaf", "n").orderBy("is_leaf", *pages.by_name(F.col("name")))

    def read_file(self, path: str) -> str:
        row = self._below(path).where(F.col("source_path") == path).select("content").first()
        if row is None:
            raise KeyError(path)
        return row["content"]

    def _read(self, change: Change, files: DataFrame) -> int:
        """Files (source_path, content, hash) get their pages anew, without marks, their indicators and their jobs; the index follows. Returns how many have text."""
        files = settled(files.withColumn("content", text.normalize(F.col("content"))))
        fresh = files.where("content <> ''")
        head = [("title", text.title_of(F.col("source_path"))), ("type", F.lit("source")), ("source", F.col("source_path"))]
        made = settled(fresh.select(text.mirror_path(F.col("source_path")).alias("path"), text.rendered(head, F.col("content")).alias("content")))
        change.replace(PAGES, made)
        change.replace(MARKS, None, made.select("path"))
        self.corpus.extract(change, fresh)
        change.replace(SOURCES, files.select("source_path", "hash"))
        bare = F.coalesce(F.col("content"), F.lit("")) == ""
        self._jobs(change, files, F.when(bare, "failed").otherwise("done"), F.when(bare, NO_TEXT))
        self._sync(change)
        return fresh.count()

    def _sync(self, change: Change) -> dict[str, int]:
        return self.corpus.sync(change, change.read(PAGES), change.read(RAW).select("source_path"))

    def sync(self) -> dict[str, int]:
        """The index follows the pages as they are; returns how many keys were added, changed and gone."""
        change = self.store.change()
        n = self._sync(change)
        if any(n.values()):
            change.commit()
        return n

    def ingest(self) -> int:
        """Files that are new or changed get their pages and are indexed with them; returns the number of those with text. A file without text fails."""
        todo = self.read(RAW).join(self.read(SOURCES), ["source_path", "hash"], "left_anti")
        if todo.isEmpty():
            return 0
        change = self.store.change()
        n = self._read(change, todo)
        change.commit()
        return n

    def reingest(self, prefix: str) -> int:
        """The file, or every file below the folder, is read anew, changed or not."""
        files = self._below(prefix)
        if files.isEmpty():
            return 0
        change = self.store.change()
        n = self._read(change, files)
        change.commit()
        return n

    def compile(self, prefix: str = "raw", **options) -> DataFrame:
        """The completion's pages for the files below a path are written and indexed in one version; (path, outcome, marked)."""
        wiki = settled(pages.inventory(self.read(PAGES)).select("path", "title"))
        ops = settled(self.corpus.compile(self._below(prefix).select("source_path", text.normalize(F.col("content")).alias("content")), wiki=wiki, **options))
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("source_path"), F.desc("window"), F.desc("seq")))
        new = settled(ops.withColumn("k", last).where("k = 1").select("path", "kind", "content"))
        outcome = settled(plans.applied(new, wiki))
        if not new.isEmpty():
            change = self.store.change()
            change.replace(PAGES, new.select("path", "content"))
            self._sync(change)
            change.commit()
        return outcome

    def rebuild(self) -> int:
        """Index, pages, marks and jobs are made again from the raw files, all in one version; the log stays and gets a note."""
        pages_before, files = self.read(PAGES).count(), self.read(RAW).count()
        change = self.store.change()
        for table in (CHUNKS, VECTORS, POSTINGS, INDICATORS, PAGES, MARKS, SOURCES, JOBS):
            change.truncate(table)
        change.facts |= {"chunks": 0, "length": 0}
        if files:
            self._read(change, change.read(RAW))
        change.commit()
        self._note(REBUILT, f"{CLEARED}{pages_before}", f"{AGAIN}{files} 个文件")
        return files

    def delete(self, prefix: str) -> int:
        """K9: a raw file or folder goes with its chunks, vectors, postings, indicators, jobs, pages and their marks, in one version, and the log notes it; returns the number of files."""
        gone = settled(self._below(prefix).select("source_path"))
        n = gone.count()
        mirrors = settled(upkeep.sources_of(self.read(PAGES).where(F.col("path").startswith("sources/"))).join(gone.withColumnRenamed("source_path", "source"), "source", "left_semi").select("path"))
        m = mirrors.count()
        change = self.store.change()
        keys = gone.select(F.expr(BY_SOURCE).alias("k"))
        for table, of in ((RAW, keys), (SOURCES, keys), (INDICATORS, keys), (JOBS, gone), (PAGES, mirrors), (MARKS, mirrors)):
            change.replace(table, None, of)
        self._sync(change)
        change.commit()
        self._note(DELETED, f"{PATH}{prefix}", f"{FILES}{n}", f"{MIRRORS}{m}")
        return n

    def list_pages(self, needle: str = "", edited: bool | None = None) -> DataFrame:
        """The inventory with marks, by type and title."""
        found = pages.with_marks(pages.inventory(self.read(PAGES)), self.read(MARKS))
        return pages.filtered(found, needle, edited).orderBy(*pages.by_name(F.col("type")), *pages.by_name(F.col("title")), "path")

    def _healed(self, path: str) -> str | None:
        wanted = self.spark.createDataFrame([(path,)], "path string")
        return pages.healed(wanted, self.read(PAGES).select("path")).first()["found"]

    def read_page(self, path: str) -> str:
        """The page, or the only one of its name."""
        found = self._healed(path)
        if found is None:
            raise KeyError(path)
        return self.read(PAGES).where(F.col("path") == found).first()["content"]

    def write_page(self, path: str, content: str) -> str:
        """A page written by hand, marked as such and indexed; returns its path, which is that of the only page of its name if there is one."""
        row = self.spark.createDataFrame([(path,)], "p string")
        safe = text.safe_path(F.concat(F.lit("wiki/"), F.col("p")), "wiki") & ~F.col("p").rlike(r"^[A-Za-z]:|^[/\\]") & F.col("p").endswith(".md")
        if not row.select(safe).first()[0]:
            raise ValueError(f"not a page below wiki/: {path}")
        target = self._healed(path) or path
        change = self.store.change()
        change.replace(PAGES, self.spark.createDataFrame([(target, content)], PAGES.schema))
        mark = self.spark.range(1).select(F.lit(target).alias("page_path"), F.lit(True).alias("edited"), _stamp().alias("updated_at"))
        change.replace(MARKS, settled(mark))
        self._sync(change)
        change.commit()
        return target

    def log(self) -> DataFrame:
        """K6: the lines of the log; without one there are none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.corpus.root}/log")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.text(f"{self.corpus.root}/log") if there else self.spark.createDataFrame([], "value string")


class Libraries:
    """The registry of corpora; one that goes leaves its folder as it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.rows, self.chosen = SnapshotTable(spark, f"{root}/libraries", LIBRARIES), SnapshotTable(spark, f"{root}/active", ACTIVE)

    def _change(self, action: str, key: str, name: str | None = None, root_dir: str | None = None) -> None:
        change = self.spark.createDataFrame([(1, action, key, name, root_dir)], "seq int, action string, id string, name string, root_dir string")
        self.rows.write(upkeep.libraries_after(self.rows.read(), change))

    def _one(self, key: str):
        row = self.rows.read().where(F.col("id") == key).first()
        if row is None:
            raise KeyError(key)
        return row

    def active(self) -> str | None:
        row = self.chosen.read().first()
        return row["id"] if row else None

    def add(self, name: str, root_dir: str) -> str:
        """The library's id; the first one is active. Without a name it has its folder's, and a folder that is known keeps its library."""
        known = self.rows.read().where(F.col("root_dir") == root_dir).first()
        key = known["id"] if known else str(uuid.uuid4())
        if not known:
            self._change("add", key, name.strip() and name or root_dir.rstrip("/").rsplit("/", 1)[-1], root_dir)
        if self.active() is None:
            self.switch(key)
        return key

    def rename(self, key: str, name: str) -> None:
        self._one(key)
        self._change("rename", key, name)

    def switch(self, key: str) -> str:
        """Makes a library active; returns its name."""
        name = self._one(key)["name"]
        self.chosen.write(self.spark.createDataFrame([(key,)], ACTIVE))
        return name

    def remove(self, key: str) -> None:
        """An unknown one is gone already; where the active one goes, none is active."""
        self._change("remove", key)
        if self.active() == key:
            self.chosen.truncate()

    def all(self) -> DataFrame:
        defaults = [F.lit(None).cast("int").alias(c) for c in ("chunk_size", "chunk_overlap", "top_k")]
        return upkeep.libraries(self.rows.read().select("*", *defaults), self.active()).orderBy("name", "id")

    def open(self, key: str | None = None, **options) -> Workspace:
        """The library's workspace; without a key, the active one's."""
        key = key or self.active()
        if key is None:
            raise KeyError("no library is active")
        return Workspace(Corpus(self.spark, self._one(key)["root_dir"], **options))
