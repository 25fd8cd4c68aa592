"""Page inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text


def inventory(files: DataFrame) -> DataFrame:
    """(path, title, type, updated, source, digest) of pages (path, content)."""
    skipped = text.basename(F.col("path")).isin("index.md", "log.md", "schema.md")
    front = files.where(F.col("path").endswith(".md") & ~skipped).withColumn("m", text.frontmatter(F.col("content")))
    trimmed = text.trim_all(F.col("content"))
    name = F.regexp_replace(text.basename(F.col("path")), r"\.md$", "")
    get = lambda k, default: F.coalesce(F.col("m")[k], default)
    return front.select("path", get("title", name).alias("title"), get("type", F.lit("unknown")).alias("type"), get("updated", F.lit("")).alias("updated"), get("source", F.lit("")).alias("source"), F.when(trimmed == "", "").otherwise(F.sha2(trimmed.cast("binary"), 256)).alias("digest"))


def keyed(files: DataFrame) -> DataFrame:
    """(key, path, digest) of pages (path, content) under the keys that the index has for them; of several with one key the last path's."""
    rows = inventory(files).select(text.index_key(F.col("path"), F.col("source")).alias("key"), "path", "digest")
    return rows.groupBy("key").agg(F.max_by(F.struct("path", "digest"), "path").alias("x")).select("key", "x.*")


def by_type(pages: DataFrame) -> DataFrame:
    """K5, A2: (type, n, listing) with the titles in their own order."""
    return pages.groupBy("type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("title", "path"))).alias("x")).select("type", "n", F.array_join(F.transform("x", lambda p: F.concat(F.lit("- ["), p["title"], F.lit("]("), p["path"], F.lit(")"))), "\n").alias("listing"))


def with_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Edited is true only where a mark says so."""
    return pages.join(marks.select(F.col("page_path").alias("path"), "edited"), "path", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))


def filtered(pages: DataFrame, needle: str, edited: bool | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """The needle in title, path or (translated) type; edited, unedited or all."""
    kind = F.col("type")
    if labels:
        kind = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("type")], F.col("type"))
    hit = F.lit(False)
    for c in (F.col("title"), F.col("path"), kind):
        hit = hit | F.lower(c).contains(needle.lower())
    out = pages.where(hit)
    return out if edited is None else out.where(F.col("edited") == edited)


def healed(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, found): the page itself, else the only page of its name."""
    exact = pages.select(F.col("path"), F.col("path").alias("exact"))
    only = pages.groupBy(text.basename(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("name", "only")
    rows = wanted.join(exact, "path", "left").withColumn("name", text.basename(F.col("path"))).join(only, "name", "left")
    return rows.select("path", F.coalesce("exact", "only").alias("found"))


def broken_links(pages: DataFrame, small: int = 10_000) -> DataFrame:
    """(path, target) of the [[targets]] that are no page's title and in no page's path.

    Titles are an equi-join.  Paths need containment: targets that are a piece of a
    path between its separators are found by an equi-join; the few that are left are
    compared with all paths, broadcast only up to ``small`` targets.
    """
    links = pages.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("target")).select("path", F.trim("target").alias("target"))
    open_links = links.join(pages.select(F.col("title").alias("target")).distinct(), "target", "left_anti")
    pieces = pages.select(F.explode(F.split(F.regexp_replace("path", r"\.md$", ""), "/")).alias("target")).distinct()
    rest = open_links.join(pieces, "target", "left_anti")
    targets = rest.select("target").distinct()
    paths = pages.select(F.col("path").alias("p"))
    found = paths.join(F.broadcast(targets) if targets.limit(small + 1).count() <= small else targets, F.contains(F.col("p"), F.col("target"))).select("target").distinct()
    return rest.join(found, "target", "left_anti").select("path", "target")


def by_name(name: Column, locale: str = "UNICODE") -> tuple[Column, Column]:
    """Sort keys of names in the order of a locale (the root one if none is given), equal ones by code points."""
    return F.collate(name, locale), name


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
