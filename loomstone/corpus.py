"""One object over a corpus on disk (X1-X8): ingest, search, upkeep, pages, conflicts.

Its tables lie in one store below a root folder and change together, one version at a
time: chunks, their vectors and postings, and what was read from the sources.  The
embedder and the completion are functions that may be absent: without an embedder
search is lexical, without a completion nothing is compiled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators import chunking, compiling, extraction, models, pages, postings, relations, search
from loomstone.session import findable
from loomstone.sources.store import Change, Keyed, Store, settled

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Completion = Callable[[str, int], str | None]
#: The key of a source: the first part of its chunks' uids.
BY_SOURCE = "substring(sha2(source_path, 256), 1, 12)"
CHUNKS = Keyed("chunks", "uid string, content string, source_path string, chunk_index int, file_hash string", postings.TAG)
VECTORS = Keyed("vectors", "uid string, dim int, embedding array<float>", postings.TAG)
INDICATORS = Keyed("indicators", "source_path string, standard_no string, clause_no string, indicator_name string, value double, unit string, direction string, condition string, level string, ordinal int", BY_SOURCE)
BATCH = 8


def embedded(chunks: DataFrame, embed: Embedder) -> DataFrame:
    """(uid, dim, embedding), in batches of eight texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                vectors = [list(map(float, v)) for v in embed(part["content"].tolist())]
                yield pd.DataFrame({"uid": part["uid"].to_numpy(), "dim": [len(v) for v in vectors], "embedding": vectors})

    findable(chunks.sparkSession)
    return chunks.select("uid", "content").mapInPandas(run, VECTORS.schema)


@dataclass
class Corpus:
    spark: SparkSession
    root: str
    size: int = 800
    overlap: int = 100
    embed: Embedder | None = None
    complete: Completion | None = None

    #: Whether a long table of vectors is ranked by sketches first.
    approximate: bool = True

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)

    def read(self, table: Keyed) -> DataFrame:
        return self.store.read(table).select(*table.columns)

    def index(self, change: Change, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """Sources (source_path, content, title, file_hash) give their chunks, vectors and postings for what they had; those in ``gone`` (source_path) just lose theirs."""
        cut = chunking.chunks(fresh, self.size, self.overlap).join(fresh.select("source_path", "file_hash"), "source_path")
        rows = settled(cut.select(text.uid(F.col("source_path"), F.col("chunk_index")).alias("uid"), "content", "source_path", "chunk_index", "file_hash"))
        keys = fresh.select("source_path").unionByName(gone.select("source_path")) if gone is not None else fresh.select("source_path")
        keys = settled(keys.select(F.expr(BY_SOURCE).alias("k")).distinct())
        touched = postings.indexed(change, CHUNKS, rows, keys)
        change.replace(VECTORS, settled(embedded(rows, self.embed)) if self.embed else None, keys, touched)  # dealt as the chunks are

    def ingest(self, files: DataFrame, force: bool = False) -> int:
        """Files (source_path, content); the changed ones are normalised, chunked, indexed and read for indicators. Returns their number."""
        files = files.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256)).withColumn("content", text.normalize(F.col("content"))).where("content <> ''")
        todo = relations.changed(files.select("source_path", "file_hash"), self.read(CHUNKS), force)
        fresh = settled(files.join(todo.select("source_path"), "source_path", "left_semi").withColumn("title", text.title_of(F.col("source_path"))))
        n = fresh.count()
        if n:
            change = self.store.change()
            self.index(change, fresh)
            self.extract(change, fresh)
            change.commit()
        return n

    def extract(self, change: Change, fresh: DataFrame) -> None:
        """The indicators of sources (source_path, content) give way to those of their texts."""
        found = extraction.indicators(fresh.withColumn("standard_no", extraction.standard_no(F.col("content"))))
        change.replace(INDICATORS, settled(found.select(*INDICATORS.columns)), fresh.select(F.expr(BY_SOURCE).alias("k")).distinct())

    def sync(self, change: Change, wiki: DataFrame, raw: DataFrame) -> dict[str, int]:
        """The index follows the pages (path, content): new and changed ones are indexed under their keys, others go unless a file of raw (source_path) has the key.

        A page that is a source's mirror has the source's path as its key, any other its
        own below wiki/.  Returns how many keys were added, changed and gone.
        """
        found = settled(relations.change_set(change.read(CHUNKS), pages.keyed(wiki), raw))
        n = {r["action"]: r["n"] for r in found.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if n:
            live = found.where("action <> 'gone'").join(wiki.select("path", "content"), "path")
            fresh = settled(live.select(F.col("key").alias("source_path"), text.trim_all(F.col("content")).alias("content"), text.title_of(F.col("key")).alias("title"), F.col("digest").alias("file_hash")))
            self.index(change, fresh, found.where("action = 'gone'").select(F.col("key").alias("source_path")))
        return {k: n.get(k, 0) for k in ("added", "changed", "gone")}

    def _lexical(self, query: str, top: int) -> DataFrame:
        """What the index finds; a query too short for trigrams is looked for in the chunks' texts."""
        if not query or len(query) < 3:
            return search.lexical(self.read(CHUNKS), query, top)
        return postings.search(self.store, search.query_terms(query), top)

    def search(self, query: str, top: int = 5) -> DataFrame:
        """Hybrid where the corpus has vectors and an embedder, else lexical; (uid, source_path, content, score)."""
        query = query.strip()
        lexical = self._lexical(query, max(2 * top, 10))
        if not query or self.embed is None:
            best = lexical.limit(top)
        else:
            vecs, probe, want = self.read(VECTORS), list(self.embed([query])[0]), max(4 * top, 20)
            lexical = settled(lexical)
            near = search.nearest(vecs, probe, lexical, want) if self.approximate else search.vector_top(vecs, probe, want)
            best = search.fuse(lexical, near).orderBy(F.desc("score"), "uid").limit(top).select("uid", F.round(F.coalesce("cosine", "score"), 4).alias("score"), F.col("score").alias("place"))
        hits = {r["uid"]: r for r in best.collect()}  # at most ``top``
        buckets = {r[0] for r in self.spark.createDataFrame([(u,) for u in hits], "uid string").select(CHUNKS.bucket(F.expr(CHUNKS.key))).collect()}
        texts = self.store.read(CHUNKS, buckets=buckets).where(F.col("uid").isin(list(hits))).where("coalesce(content, '') <> ''").select("uid", "source_path", "content")
        ranks = self.spark.createDataFrame([(u, float(r["score"]), float(r["place"] if "place" in r else r["score"])) for u, r in hits.items()], "uid string, score double, place double")
        return texts.join(F.broadcast(ranks), "uid").orderBy(F.desc("place"), "uid").select("uid", "source_path", "content", "score")

    def answer(self, query: str) -> str:
        """Five hits, each with its path and four hundred characters."""
        rows = self.search(query, 5).select("source_path", text.excerpt(F.col("content"), 400).alias("short")).collect()  # five rows
        return "\n\n".join(f"{r['source_path']}\n{r['short']}" for r in rows)

    def recall(self, query: str, budget: int = 4000) -> str:
        """What goes into a prompt for a query, at most ``budget`` characters; '' for fewer than two characters."""
        if len(query.strip()) < 2:
            return ""
        return "\n\n".join(r["block"] for r in search.ambient(self.search(query), budget).collect())  # at most five blocks

    def delete(self, prefix: str) -> None:
        """K9: a raw file or folder goes, with its chunks, vectors, postings and indicators."""
        change = self.store.change()
        gone = settled(relations.under(self.read(CHUNKS).select("source_path").unionByName(self.read(INDICATORS).select("source_path")).distinct(), prefix))
        self.index(change, self.spark.createDataFrame([], "source_path string, content string, title string, file_hash string"), gone)
        change.replace(INDICATORS, None, gone.select(F.expr(BY_SOURCE).alias("k")))
        change.commit()

    def stats(self) -> dict[str, int | str]:
        """A1."""
        chunks = self.read(CHUNKS)
        return {"backend": "parquet", "chunks": chunks.count(), "sources": chunks.select("source_path").distinct().count(), "vectors": self.read(VECTORS).count(), "indicators": self.read(INDICATORS).count()}

    def conflicts(self, source: str) -> DataFrame:
        """A source's indicators against those of all others."""
        rows = self.read(INDICATORS)
        return extraction.numeric_conflicts(rows.where(F.col("source_path") == source), rows.where(F.col("source_path") != source))

    def lint(self, wiki: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Broken links and conflict blocks of pages (path, title, content)."""
        return pages.broken_links(wiki), extraction.conflict_blocks(wiki)

    def compile(self, files: DataFrame, prompt: Callable[[str], str] = str, tokens: int = 16_384, most_tokens: int = 32_768, context: int = 131_072, wiki: DataFrame | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
        """(source_path, path, kind, window, seq, content) that the completion proposes for files (source_path, content), merged for each file; none without a completion.

        ``wiki`` (path, title) are the pages there are: prompts name those that matter,
        and a new page that means one of them becomes its update.
        """
        ask = self.complete
        if ask is None:
            return self.spark.createDataFrame([], "source_path string, path string, kind string, window string, seq int, content string")
        wiki = settled(wiki) if wiki is not None else self.spark.createDataFrame([], "path string, title string")
        limits = models.budget(tokens, most_tokens, context)
        chunks = self.read(CHUNKS)

        def prompt_of(pieces: DataFrame) -> DataFrame:
            pieces = settled(pieces)
            return compiling.prompts(pieces, settled(compiling.related(self.store, self.read(VECTORS), pieces, self.embed)), chunks, wiki)

        ops = compiling.proposed(chunking.windows(files, window=limits.window), lambda p, n: ask(prompt(p), n), limits, prompt_of, context, wait=wait)
        return compiling.merged(settled(ops), wiki)
