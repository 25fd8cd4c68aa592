"""Lexical, vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text, vectors

K1, B, RRF = 1.2, 0.75, 60


def query_terms(query: str) -> list[str]:
    """the quoted terms of a query."""
    return re.sub(r'["*()^:{}]', " ", query).split()


def bm25(chunks: DataFrame, terms: list[str], top: int) -> DataFrame:
    """(uid, score) of the best chunks by trigram BM25 over content and source_path.

    A document is both columns; a term counts its overlapping occurrences; terms
    under three characters count nothing; repeated terms count again.
    """
    terms = [t for t in terms if len(t) >= 3]
    length = F.greatest(F.length("content") - 2, F.lit(0)) + F.greatest(F.length("source_path") - 2, F.lit(0))
    tf = chunks.select("uid", length.alias("dl"), *[(text.occurrences(F.col("content"), t) + text.occurrences(F.col("source_path"), t)).alias(f"tf{i}") for i, t in enumerate(terms)])
    if not terms:
        return tf.where("false").select("uid", F.lit(0.0).alias("score"))
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = tf.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("uid", score.alias("score")).orderBy(F.desc("score"), "uid").limit(top)


def like(chunks: DataFrame, query: str, top: int) -> DataFrame:
    """The chunks that contain a query, for queries too short for the index; by uid."""
    needle = re.sub("[%_]", " ", query).strip().lower()
    return chunks.where(F.lower("content").contains(needle)).select("uid", F.lit(1.0).alias("score")).orderBy("uid").limit(top)


def lexical(chunks: DataFrame, query: str, top: int) -> DataFrame:
    """What a query finds: by LIKE under three characters, else by BM25; blank finds nothing."""
    query = query.strip()
    if not query:
        return chunks.where("false").select("uid", F.lit(0.0).alias("score"))
    return like(chunks, query, top) if len(query) < 3 else bm25(chunks, query_terms(query), top)


def weighted_occurrences(chunks: DataFrame, query: str, top: int) -> DataFrame:
    """Length times occurrences (not overlapping) of each needle."""
    score = F.lit(0)
    for needle in query.lower().split():
        score = score + F.length(F.lower("content")) - F.length(F.replace(F.lower("content"), F.lit(needle), F.lit("")))
    return chunks.select("uid", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "uid").limit(top)


def vector_top(vecs: DataFrame, query: list[float], top: int) -> DataFrame:
    """L2: (uid, distance) of the nearest vectors."""
    vecs = vecs.select("uid", vectors.doubles(F.col("embedding")).alias("v"))
    return vecs.select("uid", vectors.distance_to(F.col("v"), query).alias("distance")).orderBy("distance", "uid").limit(top)


def shortlist(vecs: DataFrame, query: list[float], lexical_hits: DataFrame, size: int) -> DataFrame:
    """(uid, score) of the best sketches, lexical hits raised by 2."""
    # a row of its own for the sketch, which the distance takes several times, and not made again for each
    sketches = vecs.select("uid", vectors.sketch(vectors.doubles(F.col("embedding"))).alias("v"))
    s = sketches.select("uid", (1 - vectors.distance_to(F.col("v"), vectors.sketched(query))).alias("s"))
    hits = lexical_hits.select("uid", F.lit(2.0).alias("boost"))
    return s.join(hits, "uid", "left").select("uid", (F.col("s") + F.coalesce("boost", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "uid").limit(size)


#: Up to so many vectors all are compared; the shortlist's size, by the number wanted and at least.
EXACT, WIDER, LEAST = 512, 16, 320


def nearest(vecs: DataFrame, query: list[float], lexical_hits: DataFrame, want: int) -> DataFrame:
    """L2, L3: (uid, distance) of the nearest vectors; a long table is cut to its best sketches first."""
    if vecs.limit(EXACT + 1).count() > EXACT:
        vecs = vecs.join(shortlist(vecs, query, lexical_hits, max(want * WIDER, LEAST)).select("uid"), "uid", "left_semi")
    return vector_top(vecs, query, want)


def ranked(hits: DataFrame, *order) -> DataFrame:
    """Numbers hits from 1; hits are few, a limit has cut them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order, "uid")))


def fuse(lex: DataFrame, vec: DataFrame) -> DataFrame:
    """Reciprocal ranks of two rankings summed; (uid, score, lexical, distance)."""
    a = ranked(lex, F.desc("score")).select("uid", F.col("score").alias("lexical"), F.col("rank").alias("ra"))
    b = ranked(vec, "distance").select("uid", "distance", F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    return a.join(b, "uid", "full_outer").select("uid", (part("ra") + part("rb")).alias("score"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("distance", F.lit(1.0)).alias("distance"), F.when(F.col("distance").isNotNull(), 1 - F.col("distance")).alias("cosine"))


def hybrid(chunks: DataFrame, vecs: DataFrame, words: str, query: list[float], top: int = 5) -> DataFrame:
    """What the words find and the nearest vectors fused, cut to ``top``, joined with the chunks, those without content dropped afterwards."""
    fused = fuse(lexical(chunks, words, max(2 * top, 10)), vector_top(vecs, query, max(4 * top, 20)))
    best = fused.orderBy(F.desc("score"), "uid").limit(top)
    return best.join(chunks.select("uid", "content", "source_path"), "uid", "left").where("coalesce(content, '') <> ''")


def ambient(hits: DataFrame, budget: int = 4000, each: int = 2000) -> DataFrame:
    """Blocks of hits (uid, score, source_path, content) while characters remain; the last is cut.

    A block is a line that names the path, and the content's excerpt; blocks are two characters apart.
    """
    block = F.concat(F.lit("[知识库片段] 来源："), F.col("source_path"), F.lit("\n"), text.excerpt(F.col("content"), each))
    w = Window.orderBy(F.desc("score"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.where("score > 0").withColumn("block", block).withColumn("used", F.coalesce(F.sum(F.length("block") + 2).over(w), F.lit(0)))
    return rows.where(F.col("used") < budget).select("uid", F.substring(F.col("block"), F.lit(1), (budget - F.col("used")).cast("int")).alias("block"))
