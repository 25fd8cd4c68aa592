"""Pages that a completion proposes for the windows of sources.

Windows are rows.  What each should know is found for all of them at once: related
chunks by one join with the stored index, pages by their titles in its text.  Then the
completion is asked in rounds, each a Spark job over the windows still open, whose
answers are stored: an answer with a plan closes its window, a failure is asked again
after a while, a truncated one with twice the budget, and at the ceiling the window is
split in two.  A round that is lost with its executor is asked again by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators import plans, postings, search
from loomstone.operators.chunking import SHARED
from loomstone.operators.models import ATTEMPTS, SPLIT_DEPTH, SPLIT_FROM, WAITS, Budget, OutputLimit
from loomstone.session import findable
from loomstone.sources.store import Store, settled

#: How much of a window is its query, how many hits it gets, and which windows are ranked by vectors too.
ASKED, RELATED, HYBRID_EVERY = 800, 5, 8
#: Query vectors that meet the table of vectors in one pass.
PROBES = 256
PIECES = "source_path string, window int, part string, content string, tokens int, attempt int, depth int, limited boolean"


def near_many(vecs: DataFrame, queries: DataFrame, embed: Callable, want: int) -> DataFrame:
    """(id, uid, distance) of the nearest vectors for each query (id, query); tasks keep their best, by exact cosine."""
    spark, rows = vecs.sparkSession, queries.select("id", "query").toLocalIterator()
    out, more = None, True
    while more:
        part = [r for r, _ in zip(rows, range(PROBES), strict=False)]
        more = len(part) == PROBES
        if not part:
            break
        q = np.asarray(embed([r["query"] for r in part]), float)
        ids, norms = [r["id"] for r in part], np.linalg.norm(q, axis=1)

        def run(frames: Iterator[pd.DataFrame], q=q, ids=ids, norms=norms) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                x = np.array(pdf["embedding"].tolist(), float)
                if not len(x):
                    continue
                scale = norms[:, None] * np.linalg.norm(x, axis=1)[None]
                d = np.where(scale > 0, 1 - q @ x.T / np.where(scale > 0, scale, 1), 1.0)
                uid = pdf["uid"].to_numpy()
                for k, i in enumerate(ids):
                    best = np.lexsort((uid, d[k]))[:want]
                    yield pd.DataFrame({"id": i, "uid": uid[best], "distance": d[k][best]})

        found = vecs.select("uid", "embedding").mapInPandas(run, "id string, uid string, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "id string, uid string, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "uid"))
    return out.withColumn("k", rank).where(F.col("k") <= want).drop("k")


def related(store: Store, vecs: DataFrame, pieces: DataFrame, embed: Callable | None = None, top: int = RELATED) -> DataFrame:
    """(id, uid, score) of the chunks that pieces (id, window, content) should know: by words, a file's first window and every eighth by vectors too."""
    asked = pieces.select("id", F.substring("content", 1, ASKED).alias("query"), ((F.col("window") == 0) | ((F.col("window") + 1) % HYBRID_EVERY == 0)).alias("hybrid"))
    lexical = postings.search_many(store, asked, max(2 * top, 10))
    if embed is None:
        return lexical.where(F.col("rank") <= top).select("id", "uid", "score")
    lexical, wide = settled(lexical), asked.where("hybrid")
    near = near_many(vecs, wide, embed, max(4 * top, 20))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "uid")))
    both = lexical.join(wide.select("id"), "id", "left_semi").select("id", "uid", "rank").unionByName(near.select("id", "uid", "rank"))
    fused = both.groupBy("id", "uid").agg(F.sum(1.0 / (search.RRF + F.col("rank"))).alias("score"))
    rows = fused.unionByName(lexical.join(wide.select("id"), "id", "left_anti").select("id", "uid", "score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "uid"))
    return rows.withColumn("k", rank).where(F.col("k") <= top).drop("k")


def prompts(pieces: DataFrame, hits: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, prompt) of pieces (id, content): the pages that matter, excerpts of related chunks, the text."""
    told = hits.join(chunks.select("uid", "source_path", "content"), "uid")
    excerpts = told.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "uid", F.concat_ws("\n", "source_path", text.excerpt(F.col("content"), 400)).alias("t")))), lambda x: x["t"]), "\n\n").alias("excerpts"))
    found = told.select(F.col("id").alias("window"), F.regexp_replace("source_path", "^wiki/", "").alias("path"))
    listed = plans.prompt_pages(pages.select("path", "title"), pieces.select(F.col("id").alias("window"), "content"), found).join(pages.select("path", "title"), "path")
    listed = listed.groupBy(F.col("window").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "path", F.concat(F.lit("- "), F.col("path"), F.lit(" "), F.col("title")).alias("t")))), lambda x: x["t"]), "\n").alias("listed"))
    return pieces.join(listed, "id", "left").join(excerpts, "id", "left").select("id", F.concat_ws("\n\n", F.nullif("listed", F.lit("")), F.nullif("excerpts", F.lit("")), "content").alias("prompt"))


def _split(rows: DataFrame) -> DataFrame:
    """Both halves of each piece, with the usual overlap, asked afresh."""
    n, mid = F.length("content"), F.floor(F.length("content") / 2).cast("int")
    low = F.greatest(mid - SHARED, F.lit(0))
    half = F.explode(F.array(F.struct(F.concat("part", F.lit("0")).alias("p"), F.substring("content", F.lit(1), mid + SHARED).alias("t")), F.struct(F.concat("part", F.lit("1")).alias("p"), F.substring("content", low + 1, n - low).alias("t"))))
    return rows.withColumn("h", half).select("source_path", "window", F.col("h.p").alias("part"), F.col("h.t").alias("content"), F.lit(0).alias("tokens"), F.lit(0).alias("attempt"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("limited"))


def proposed(windows: DataFrame, ask: Callable[[str, int], str | None], limits: Budget, prompt_of: Callable[[DataFrame], DataFrame], context: int | None = None, at_ceiling: bool = False, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(source_path, window, part, seq, kind, path, content) that the completion proposes for windows (source_path, window, content).

    ``prompt_of`` gives (id, prompt) of pieces (id, window, content).  A window without
    a plan after all attempts has no rows, the others do.  Prompts that do not fit
    ``context`` tokens beside the largest answer are split before they are asked.
    """
    spark = windows.sparkSession
    open_ = settled(windows.select("source_path", F.col("window").cast("int").alias("window"), F.lit("").alias("part"), "content", F.lit(limits.ceiling if at_ceiling else limits.floor).alias("tokens"), F.lit(0).alias("attempt"), F.lit(0).alias("depth"), F.lit(False).alias("limited")))
    done, texts = [], None

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raws, cuts = [], []
            for prompt, tokens in zip(pdf["prompt"], pdf["tokens"], strict=True):
                raw, cut = "", False
                try:
                    raw = ask(prompt, int(tokens)) or ""
                except OutputLimit as e:
                    raw, cut = e.partial, True
                except Exception:  # noqa: BLE001  a model may fail in any way; the next attempt follows
                    raw = ""
                raws.append(raw)
                cuts.append(cut)
            plan = [None if c else plans.parse_plan(r) for r, c in zip(raws, cuts, strict=True)]
            ops = [None if p is None else [{"seq": k, "kind": o[0], "path": o[1], "content": o[2]} for k, o in enumerate(p)] for p in plan]
            yield pdf[["id"]].assign(ops=ops, cut=[c or bool(r.strip()) and r.strip()[-1] not in "}]" for r, c in zip(raws, cuts, strict=True)])

    findable(spark)
    for turn in range(1 + ATTEMPTS * (SPLIT_DEPTH + 1) * 2):
        ident = F.concat_ws("\u0001", "source_path", F.lpad(F.col("window").cast("string"), 8, "0"), "part")
        open_ = open_.withColumn("id", ident)
        fresh = open_.where("attempt = 0")
        if not fresh.isEmpty():
            new = settled(prompt_of(fresh.select("id", "window", "content")).select("id", "prompt"))
            texts = new if texts is None else texts.unionByName(new)
        can_split = (F.col("depth") < SPLIT_DEPTH) & (F.length("content") >= SPLIT_FROM)
        told = open_.join(texts, "id")
        if context is not None:
            over = F.ceil(F.length("prompt")) + limits.ceiling > context
            told = told.withColumn("over", over & can_split & (F.col("attempt") == 0))
        else:
            told = told.withColumn("over", F.lit(False))
        told = settled(told.withColumn("tokens", F.when(F.col("tokens") == 0, F.lit(limits.floor)).otherwise(F.col("tokens"))))
        asked = told.where("not over")
        if turn and not asked.where("attempt > 0").isEmpty():
            wait(WAITS[min(asked.agg(F.max("attempt")).first()[0], len(WAITS)) - 1])
        said = settled(asked.join(asked.select("id", "prompt", "tokens").mapInPandas(answer, "id string, ops array<struct<seq int, kind string, path string, content string>>, cut boolean"), "id"))
        done.append(said.where("ops is not null").select("source_path", "window", "part", F.explode("ops").alias("o")).select("source_path", "window", "part", "o.*"))
        failed = said.where("ops is null").withColumn("limited", F.col("limited") | F.col("cut")).withColumn("attempt", F.col("attempt") + 1)
        full = F.col("cut") & (F.col("tokens") >= limits.ceiling)
        splits = can_split & (full | F.col("limited") & (F.col("attempt") >= ATTEMPTS))
        again = failed.where(~splits & (F.col("attempt") < ATTEMPTS)).withColumn("tokens", F.when(F.col("cut"), F.least(2 * F.col("tokens"), F.lit(limits.ceiling))).otherwise(F.col("tokens")))
        names = [c.split()[0] for c in PIECES.split(", ")]
        open_ = settled(again.select(*names).unionByName(_split(failed.where(splits))).unionByName(_split(told.where("over"))))
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where(plans.allowed(F.col("path")) & ~F.col("path").startswith("sources/"))


def merged(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_path, path, kind, window, seq, content): each source's operations merged by path in the order of its windows, and turned to the pages (path, title) they mean."""
    place = F.concat_ws(".", F.lpad(F.col("window").cast("string"), 8, "0"), "part")
    keyed = ops.select(F.concat_ws("\u0001", "source_path", "path").alias("path"), "kind", place.alias("window"), "seq", "content")
    one = plans.merge_ops(keyed).select(F.substring_index("path", "\u0001", 1).alias("source_path"), F.substring_index("path", "\u0001", -1).alias("path"), "kind", "window", "seq", "content")
    meant = plans.dedup_plan(one.select(F.concat_ws("\u0001", "source_path", "window").alias("window"), "seq", "kind", "path", "content"), plans.dedup_index(pages.select("path", "title")))
    return meant.select(F.substring_index("window", "\u0001", 1).alias("source_path"), "path", "kind", F.substring_index("window", "\u0001", -1).alias("window"), "seq", "content")
