"""Relational upkeep of a corpus."""

from __future__ import annotations

import re
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import findable


def upsert(old: DataFrame, new: DataFrame, key: str = "source_path") -> DataFrame:
    """K1: every row of a key that new has gives way to new's rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """K2, J14."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def under(paths: DataFrame, prefix: str, path: str = "source_path") -> DataFrame:
    """The rows at a path or below it."""
    return paths.where((F.col(path) == prefix) | F.col(path).startswith(prefix.rstrip("/") + "/"))


def delete_cascade(chunks: DataFrame, vectors: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """K9: the chunks and vectors left when a raw subtree goes."""
    gone = under(chunks, prefix)
    return without(chunks, gone, "source_path"), without(vectors, gone.select("uid"), "uid")


def stale_keys(index: DataFrame, live_pages: DataFrame, live_raw: DataFrame) -> DataFrame:
    """The keys of the index that neither a live page nor a live raw file has."""
    keys = index.select("key").distinct()
    return keys.join(live_pages.select("key"), "key", "left_anti").join(live_raw.select("key"), "key", "left_anti")


def change_set(index: DataFrame, pages: DataFrame, live_raw: DataFrame) -> DataFrame:
    """(key, action, path, digest) of what an index (source_path, file_hash) must do to follow pages (key, path, digest).

    A page without text has an empty digest and is not indexed.  A key that no page has
    goes, unless a raw file (source_path) of that name is there: it was indexed by itself.
    """
    had = index.groupBy(F.col("source_path").alias("key")).agg(F.max("file_hash").alias("had"))
    rows = had.join(pages, "key", "full_outer").join(live_raw.select(F.col("source_path").alias("key"), F.lit(True).alias("raw")).distinct(), "key", "left")
    empty = F.col("digest") == ""
    action = F.when(F.col("had").isNull() & ~empty, "added").when(F.col("digest").isNull() & F.col("raw").isNull() | F.col("had").isNotNull() & empty, "gone").when(F.col("digest") != F.col("had"), "changed")
    return rows.withColumn("action", action).where("action is not null").select("key", "action", "path", "digest")


def changed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """(source_path, state) of the files whose hash is not the manifest's."""
    known = manifest.groupBy("source_path").agg(F.max_by("file_hash", "chunk_index").alias("known"))
    rows = files.join(known, "source_path", "left").withColumn("state", F.when(F.col("known").isNull(), "new").when(F.col("known") != F.col("file_hash"), "changed").otherwise("same"))
    return (rows if force else rows.where("state <> 'same'")).select("source_path", "state")


_STEM, _EXT = r"\.[^./]*$", r"(\.[^./]*)$"
_NUMBER = r"( \(\d+\))+$"


def upload_outcome(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """K8: (seq, rel, status, stored) of uploads (seq, rel, hash), in the order of seq, onto existing files (rel, hash).

    A free name is created, and taken from then on; what is stored under it decides about
    later ones: equal content is a duplicate, other content gets the first free number.
    Names are independent of each other as long as none of a family carries a number
    itself, and windows over a name give all numbers; the other families, those with a
    name such as ``x (1).txt`` among files or uploads, are gone through one by one.
    """
    family = lambda c: F.concat(F.regexp_replace(F.regexp_replace(c, _STEM, ""), _NUMBER, ""), F.regexp_extract(c, _EXT, 1))
    # names of their own, as both may come from one table
    existing, uploads = existing.select(*[F.col(c).alias(c) for c in ("rel", "hash")]), uploads.select(*[F.col(c).alias(c) for c in ("seq", "rel", "hash")])
    both = existing.select("rel").unionByName(uploads.select("rel"))
    numbered = both.where(F.regexp_replace("rel", _STEM, "").rlike(_NUMBER)).select(family(F.col("rel")).alias("family")).distinct()
    ups, files = uploads.withColumn("family", family(F.col("rel"))), existing.groupBy("rel").agg(F.min("hash").alias("had")).withColumn("family", family(F.col("rel")))
    plain = ups.join(numbered, "family", "left_anti").join(files.drop("family"), "rel", "left")
    first = F.row_number().over(Window.partitionBy("rel").orderBy("seq")) == 1
    held = F.coalesce("had", F.first("hash").over(Window.partitionBy("rel").orderBy("seq")))
    status = F.when(F.col("had").isNull() & F.col("first"), "created").when(F.col("held") == F.col("hash"), "duplicate").otherwise("renamed")
    plain = plain.withColumns({"first": first, "held": held}).withColumn("status", status)
    n = F.row_number().over(Window.partitionBy("rel", "status").orderBy("seq"))
    named = F.concat(F.regexp_replace("rel", _STEM, ""), F.lit(" ("), n.cast("string"), F.lit(")"), F.regexp_extract("rel", _EXT, 1))
    plain = plain.withColumn("stored", F.when(F.col("status") == "renamed", named).otherwise(F.col("rel"))).select("seq", "rel", "status", "stored")

    def in_turn(had: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        at, out = dict(zip(had["rel"], had["had"], strict=True)), []
        for seq, rel, content in new.sort_values("seq")[["seq", "rel", "hash"]].itertuples(index=False):
            status, to = "duplicate" if at.get(rel) == content else "renamed" if rel in at else "created", rel
            if status == "renamed":
                ext = (re.search(_EXT, rel) or [""])[0]
                to = next(x for k in count(1) if (x := f"{rel[: len(rel) - len(ext)]} ({k}){ext}") not in at)
            if status != "duplicate":
                at[to] = content
            out.append((seq, rel, status, to))
        return pd.DataFrame(out, columns=["seq", "rel", "status", "stored"])

    findable(uploads.sparkSession)
    only = lambda df: df.join(numbered, "family", "left_semi").groupBy("family")
    kind = uploads.schema["seq"].dataType.simpleString()
    return plain.unionByName(only(files).cogroup(only(ups)).applyInPandas(in_turn, f"seq {kind}, rel string, status string, stored string"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def folder_counts(files: DataFrame, path: str = "source_path") -> DataFrame:
    """(folder, n) of the files anywhere below each folder."""
    return files.select(F.explode(ancestors(F.col(path))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def tree_edges(files: DataFrame, path: str = "source_path") -> DataFrame:
    """(parent, child, is_leaf, n) of the tree of paths."""
    whole = F.concat(ancestors(F.col(path)), F.array(F.col(path)))
    nodes = files.select(F.posexplode(whole).alias("depth", "child"), F.size(whole).alias("d")).groupBy("child").agg(F.count("*").alias("n"), F.max(F.col("depth") == F.col("d") - 1).alias("is_leaf"))
    return nodes.select(F.regexp_extract("child", "^(.*)/[^/]*$", 1).alias("parent"), "child", "is_leaf", "n")


def filtered_tree(files: DataFrame, needle: str, path: str = "source_path") -> DataFrame:
    """The matching files and every folder above one."""
    hit = files.where(F.lower(F.element_at(F.split(path, "/"), -1)).contains(needle.lower()))
    return hit.select(F.explode(F.concat(ancestors(F.col(path)), F.array(F.col(path)))).alias("node")).distinct()


def source_detail(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk of a source with the facts of its vector."""
    from loomstone.functions.vectors import doubles, magnitude

    v = vectors.select("uid", F.size("embedding").alias("dim"), magnitude(doubles(F.col("embedding"))).alias("magnitude"), F.slice(doubles(F.col("embedding")), 1, 8).alias("sample"))
    return chunks.join(v, "uid", "left").select("uid", "source_path", F.length("content").cast("long").alias("content_length"), F.substring("content", 1, 240).alias("preview"), F.col("dim").isNotNull().alias("has_vector"), "dim", "magnitude", "sample")
