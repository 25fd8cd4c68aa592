"""Smaller upkeep of documents, pages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.sources import docx


def changed_by_stat(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """S3: (path, state) by size and time of modification: new, changed, same, and gone for what is no longer there."""
    m = manifest.select("path", F.col("size").alias("size_0"), F.col("modified").alias("modified_0"), F.lit(True).alias("was"))
    rows = files.select("path", "size", "modified", F.lit(True).alias("is")).join(m, "path", "full_outer")
    same = (F.col("size") == F.col("size_0")) & (F.col("modified") == F.col("modified_0"))
    return rows.select("path", F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(same, "same").otherwise("changed").alias("state"))


def personas(stored: DataFrame) -> DataFrame:
    """Rows without times or status get them; the built-in persona is there even if nothing is stored."""
    cols = {c: F.col(c) if c in stored.columns else F.lit(None).cast("string") for c in ("create_time", "update_time")}
    rows = stored.select("id", "name", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.col("status").cast("int") if "status" in stored.columns else F.lit(None).cast("int"), F.lit(1)).alias("status"), F.coalesce(cols["create_time"], F.lit("")).alias("create_time"), F.coalesce(cols["update_time"], cols["create_time"], F.lit("")).alias("update_time"))
    built_in = stored.sparkSession.createDataFrame([("default", "default", "", 1, "", "")], rows.schema)
    return rows.unionByName(built_in.join(rows.select("id"), "id", "left_anti").select(rows.columns))


def libraries(stored: DataFrame, active: str | None) -> DataFrame:
    """Rows without an id or folder are skipped, numbers get their defaults, and is_active marks at most one."""
    rows = stored.where("coalesce(id, '') <> '' and coalesce(root_dir, '') <> ''")
    return rows.select("id", F.coalesce("name", "id").alias("name"), "root_dir", *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("chunk_size", 800), ("chunk_overlap", 100), ("top_k", 5))], (F.col("id") == F.lit(active)).alias("is_active") if active else F.lit(False).alias("is_active"))


def adopted_jobs(legacy: DataFrame, known: DataFrame) -> DataFrame:
    """Old jobs of files that have none: a running one was interrupted, a failed one stays so, others are done."""
    rows = legacy.join(known.select("rel"), "rel", "left_anti")
    return rows.select("rel", F.when(F.col("status").isin("running", "failed"), "failed").otherwise("done").alias("status"), F.lit(100).alias("progress"), F.when(F.col("status") == "running", "interrupted").otherwise(F.col("error")).alias("error"))


def pretty(c: Column, schema: str) -> Column:
    """JSON with indents; what is not JSON stays as it is."""
    return F.when(F.try_parse_json(c).isNotNull(), F.to_json(F.from_json(c, schema), {"pretty": "true"})).otherwise(c)


def preview(files: DataFrame) -> DataFrame:
    """(path, kind, data): base64 of what is shown as it is, a document's HTML, an error for what can't be shown."""
    ext = text.extension(F.col("path"))
    rows = files.select("path", ext.alias("ext"), "content", docx.docx_html(F.when(ext == ".docx", F.col("content"))).alias("html"))
    kind = F.when(F.col("ext") == ".pdf", "pdf").when(F.col("ext").isin(".png", ".jpg", ".jpeg", ".gif", ".webp"), "image").when(F.col("html").isNotNull(), "html").otherwise("error")
    rows = rows.withColumn("kind", kind)
    return rows.select("path", "kind", F.when(F.col("kind") == "html", F.col("html")).when(F.col("kind") != "error", F.base64("content")).alias("data"))


def sources_of(pages: DataFrame) -> DataFrame:
    """(path, source) from each page's head; empty is null."""
    return pages.select("path", F.nullif(text.frontmatter(F.col("content"))["source"], F.lit("")).alias("source"))


def mirrors(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_path, body) of the mirror pages of sources."""
    keyed = wanted.select("source_path", text.mirror_path(F.col("source_path")).alias("path"))
    return keyed.join(pages, "path").select("source_path", text.body(F.col("content")).alias("body"))


def flat_mirrors(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The paths of old flat mirrors: pages named after a file's last segment that say they are that file's."""
    flat = files.select(F.col("source_path").alias("source"), text.mirror_path(text.basename(F.col("source_path"))).alias("path"), text.mirror_path(F.col("source_path")).alias("own")).where("path <> own")
    return sources_of(pages).join(flat, ["path", "source"]).select("path")


def log_entry(stamp: Column, source: Column, created: Column, updated: Column, conflicts: Column) -> Column:
    """K6: a block of the log for one run."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("无")
    return F.concat_ws("\n", F.concat(F.lit("## "), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("- 来源："), source), F.concat(F.lit("- 新建："), listed(created)), F.concat(F.lit("- 更新："), listed(updated)), F.concat(F.lit("- 冲突："), conflicts.cast("string")), F.lit(""))


def log_note(stamp: Column, action: Column, details: Column) -> Column:
    lines = F.transform(details, lambda x: F.concat(F.lit("- "), x))
    return F.concat_ws("\n", F.concat(F.lit("## "), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("- 操作："), action), F.array_join(lines, "\n"), F.lit(""))


def appended(entries: DataFrame, path: str) -> None:
    """K6: blocks (block) are added to a log; each write adds files, none is changed."""
    entries.select("block").write.mode("append").text(path, lineSep="\n")


def traced(requests: DataFrame, path: str) -> None:
    """K7: requests, without their signal and with the day they came on, as JSON by day."""
    requests.drop("signal").withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").json(path)


def written(pages: DataFrame, path: str) -> None:
    """K4: (path, content) as a table of pages, whole; readers take the page by its path."""
    pages.select("path", "content").write.mode("overwrite").parquet(path)


def with_marks_set(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Page marks after changes (page_path, edited, updated_at): the last one holds, false clears."""
    both = marks.unionByName(changes.select(marks.columns))
    last = F.row_number().over(Window.partitionBy("page_path").orderBy(F.desc("updated_at")))
    return both.withColumn("k", last).where("k = 1 and edited").drop("k")


def libraries_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Libraries (id, name, root_dir) after changes (seq, action, id, name, root_dir) of adding, renaming and removing; a folder is added once."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("action", "name", "root_dir"), "seq").alias("x")).select("id", "x.*")
    kept = stored.join(last.where("action = 'remove'"), "id", "left_anti")
    renamed = kept.alias("a").join(last.where("action = 'rename'").alias("b"), "id", "left").select("id", F.coalesce("b.name", "a.name").alias("name"), F.col("a.root_dir").alias("root_dir"))
    new = last.where("action = 'add'").join(kept.select("id"), "id", "left_anti").join(kept.select("root_dir"), "root_dir", "left_anti").select("id", "name", "root_dir")
    return renamed.unionByName(new)


def recompiled(mirrors_of: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, pages left) of compiling everything anew: compiled pages go, each mirror's source waits, and one job stands for the run."""
    left = pages.where(~(F.col("path").startswith("entities/") | F.col("path").startswith("concepts/")))
    queued = mirrors_of.select(F.col("source_path").alias("rel"), F.lit("queued").alias("status"))
    run = mirrors_of.sparkSession.createDataFrame([("__recompile_all__", "running")], "rel string, status string")
    return queued.unionByName(run), left


def page_of_rows(rows: DataFrame, size: int, number: int, *order: str) -> DataFrame:
    """A page of rows, from 0, and how many there are after it."""
    w = Window.orderBy(*order)
    part = rows.orderBy(*order).offset(size * number).limit(size)
    rest = rows.agg(F.greatest(F.count("*") - size * (number + 1), F.lit(0)).alias("remaining"))
    return part.withColumn("row", F.row_number().over(w)).crossJoin(F.broadcast(rest))  # one row


def clipped(nodes: DataFrame, most: int, order: str = "path") -> DataFrame:
    """The first rows, and the number of those that are not shown."""
    total = nodes.agg(F.count("*").alias("total"))
    return nodes.orderBy(order).limit(most).crossJoin(F.broadcast(total)).withColumn("dropped", F.greatest(F.col("total") - most, F.lit(0))).drop("total")  # one row


def as_json(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """One row with the first rows as a JSON array."""
    first = rows.orderBy(*order).limit(most)
    return first.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*rows.columns).alias("v")))), lambda x: x["v"])).alias("json"))


def conflict_report(found: DataFrame) -> DataFrame:
    """(report) of conflict_blocks() rows, in the order of their paths."""
    part = F.concat(F.lit("### "), "path", F.lit("（"), F.col("n").cast("string"), F.lit(" 处）\n"), F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("\n"), b)), "\n"), F.lit("\n"))
    every = found.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("path", part.alias("part")))).alias("x"))
    body = F.concat(F.lit("共发现 "), F.col("n").cast("string"), F.lit(" 个文件包含冲突标记：\n\n"), F.array_join(F.transform("x", lambda r: r["part"]), "\n"))
    return every.select(F.when(F.col("n") == 0, "未发现冲突标记。").otherwise(body).alias("report"))


def posix(c: Column) -> Column:
    """forward slashes, none at either end."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def listed(c: Column) -> Column:
    """the parts of a comma list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def status_label(c: Column) -> Column:
    """how an upload ended, in words."""
    return F.when(c == "created", "stored").when(c == "duplicate", "already there").when(c == "renamed", "stored under another name").otherwise(c)
