"""Queries over the relational upkeep, pages, jobs, sessions, extraction, plans and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import schema, text, vectors
from loomstone.operators import extraction, jobs, pages, plans, relations, sessions
from loomstone.plans.views import JOBS, SRC, VEC, src, table, vec
from loomstone.plans.views import jobs as job_view
from loomstone.session import place
from loomstone.sources import readers
from loomstone.streaming import stateful, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# pages and keys

_DIGEST = r"sha256(regexp_replace(regexp_replace(content, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', ''))"


@query(f"WITH {SRC} SELECT 'sources/' || doc_id || '.md' AS path, doc_id::VARCHAR AS title, 'unknown' AS type, '' AS source, {_DIGEST} AS digest FROM src")
def page_digest(spark: SparkSession, sf: str) -> DataFrame:
    files = src(spark, sf).select(F.concat(F.lit("sources/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "content")
    return pages.inventory(files).drop("updated")


@query(f"WITH {SRC} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source_path ELSE 'wiki/entities/' || doc_id || '.md' END AS key, doc_id::VARCHAR AS title FROM src")
def index_key(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    path = F.when(even, F.concat(F.lit("sources/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("entities/"), F.col("doc_id").cast("string"), F.lit(".md")))
    return src(spark, sf).select("doc_id", text.index_key(path, F.when(even, F.col("source_path"))).alias("key"), text.title_of(F.concat(F.lit("raw/x/"), F.col("doc_id").cast("string"), F.lit("_0A1b2C3d.pdf"))).alias("title"))


@query(f"WITH {SRC} SELECT doc_id, 'sources/' || source || '/' || lang || '/' || doc_id || '.txt.md' AS mirror FROM src")
def mirror_path(spark: SparkSession, sf: str) -> DataFrame:
    return src(spark, sf).select("doc_id", text.mirror_path(F.regexp_replace("source_path", "^raw/", "raw/./../")).alias("mirror"))


# incremental upkeep


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """An older state: a tenth of the files is not in it, another tenth had another text."""
    return src(spark, sf).where("doc_id % 10 <> 0").select("doc_id", "source_path", F.md5(F.when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("file_hash"), F.lit(0).alias("chunk_index"))


@query(f"WITH {SRC} SELECT source_path, CASE doc_id % 10 WHEN 0 THEN 'new' ELSE 'changed' END AS state FROM src WHERE doc_id % 10 IN (0, 1)")
def incremental_changed(spark: SparkSession, sf: str) -> DataFrame:
    files = src(spark, sf).select("source_path", F.md5("content").alias("file_hash"))
    return relations.changed(files, _manifest(spark, sf))


@query(f"WITH {SRC} SELECT source_path AS key FROM src WHERE doc_id % 10 > 1")
def stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = src(spark, sf).select("doc_id", F.col("source_path").alias("key"))
    return relations.stale_keys(d, d.where("doc_id % 10 = 0"), d.where("doc_id % 10 = 1"))


@query(f"WITH {SRC} SELECT source_path, count(*)::BIGINT AS n, max(v)::BIGINT AS version FROM (SELECT source_path, 1 AS v FROM src WHERE doc_id % 7 <> 3 UNION ALL SELECT source_path, 2 AS v FROM src WHERE doc_id % 7 = 3 UNION ALL SELECT source_path, 2 AS v FROM src WHERE doc_id % 7 = 3) GROUP BY source_path")
def upsert_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    old = src(spark, sf).select("source_path", F.lit(1).alias("version"))
    new = src(spark, sf).where("doc_id % 7 = 3").select("source_path", F.explode(F.array(F.lit(2), F.lit(2))).alias("version"))
    return relations.upsert(old, new).groupBy("source_path").agg(F.count("*").alias("n"), F.max("version").cast("long").alias("version"))


@query(f"WITH {SRC}, {VEC} SELECT 'chunks' AS relation, count(*)::BIGINT AS n FROM src WHERE source <> 'src1' UNION ALL SELECT 'vectors', count(*)::BIGINT FROM vec WHERE uid NOT IN (SELECT uid FROM src WHERE source = 'src1')")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    chunks, vectors_left = relations.delete_cascade(src(spark, sf), vec(spark, sf), "raw/src1")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
    return count(chunks, "chunks").unionByName(count(vectors_left, "vectors"))


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS h, 'raw/' || CASE WHEN doc_id // 6 % 2 = 0 THEN (doc_id // 6)::VARCHAR ELSE 'new/' || doc_id // 2 END || '.txt' AS rel FROM documents),
e AS (SELECT rel, min(h) AS had FROM d WHERE doc_id % 12 < 1 GROUP BY rel),
u AS (SELECT doc_id AS seq, d.rel, h, had, row_number() OVER (PARTITION BY d.rel ORDER BY doc_id) AS k, coalesce(had, first_value(h) OVER (PARTITION BY d.rel ORDER BY doc_id)) AS held FROM d LEFT JOIN e ON d.rel = e.rel),
v AS (SELECT *, CASE WHEN had IS NULL AND k = 1 THEN 'created' WHEN h = held THEN 'duplicate' ELSE 'renamed' END AS status FROM u)
SELECT seq, rel, status, CASE WHEN status = 'renamed' THEN replace(rel, '.txt', ' (' || row_number() OVER (PARTITION BY rel, status ORDER BY seq) || ').txt') ELSE rel END AS stored FROM v"""
)
def upload_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """All documents arrive: of twelve, six under one name, of which the first is stored already, and six under new names, two for each."""
    block = F.floor(F.col("doc_id") / 6)
    rel = F.concat(F.lit("raw/"), F.when(block % 2 == 0, block.cast("string")).otherwise(F.concat(F.lit("new/"), F.floor(F.col("doc_id") / 2).cast("string"))), F.lit(".txt"))
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), rel.alias("rel"))
    return relations.upload_outcome(d.where("doc_id % 12 < 1"), d.withColumnRenamed("doc_id", "seq"))


@query(f"WITH {SRC}, {VEC} SELECT src.uid, source_path, len(content)::BIGINT AS content_length, substr(content, 1, 240) AS preview, e IS NOT NULL AS has_vector, coalesce(len(e), 0)::INT AS dim, round(coalesce(sqrt(list_inner_product(e, e)), 0), 6) AS magnitude FROM src LEFT JOIN vec ON src.uid = vec.uid WHERE source = 'src2'")
def source_detail(spark: SparkSession, sf: str) -> DataFrame:
    d = relations.source_detail(relations.under(src(spark, sf), "raw/src2"), vec(spark, sf))
    return d.drop("sample").withColumns({"magnitude": F.round(F.coalesce("magnitude", F.lit(0.0)), 6), "dim": F.coalesce("dim", F.lit(0))})


# jobs


@query(f"WITH {JOBS} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, count(*) FILTER (WHERE status IN ('done', 'failed'))::BIGINT AS settled, count(*) FILTER (WHERE status IN ('queued', 'running'))::BIGINT AS active, max(updated_at)::BIGINT AS updated_at, floor(count(*) FILTER (WHERE status IN ('done', 'failed')) * 100.0 / count(*) + 0.5)::INT AS percent FROM jobs")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    synthetic = job_view(spark, sf).limit(1).withColumn("rel", F.lit("__recompile_all__"))
    return jobs.progress(job_view(spark, sf).unionByName(synthetic))


@query(f"WITH {JOBS} SELECT rel, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, status = 'running' AS recovered FROM jobs")
def recover_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.recovered(job_view(spark, sf)).select("rel", "status", "recovered")


@query(f"WITH {JOBS} SELECT count(*)::BIGINT AS others_busy FROM (SELECT lib FROM jobs WHERE lib <> 'lib1' GROUP BY lib HAVING bool_or(status IN ('queued', 'running')))")
def others_busy(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.busy_others(job_view(spark, sf), "lib1")


@query(
    """WITH q AS (SELECT 'lib' || (user_id % 5) AS lib, 'f' || user_id AS rel, event_id AS seq, event_type = 'purchase' AS front FROM events), f AS (SELECT lib, rel, min(seq) AS seq, arg_min(front, seq) AS front FROM q GROUP BY lib, rel)
SELECT lib, rel, row_number() OVER (PARTITION BY lib ORDER BY CASE WHEN front THEN 0 ELSE 1 END, CASE WHEN front THEN -seq ELSE seq END)::INT AS position FROM f"""
)
def queue_order(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("lib"), (F.col("user_id") % 5).cast("string")).alias("lib"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("rel"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("front"))
    return jobs.queue_order(e)


@query(f"WITH {JOBS}, live AS (SELECT DISTINCT 'raw/' || (user_id % 20) || '/' || user_id || '.txt' AS rel FROM events WHERE user_id % 3 <> 0) SELECT rel, 'queued' AS fate FROM live UNION ALL SELECT rel, 'dropped' FROM jobs WHERE rel NOT IN (SELECT rel FROM live)")
def rebuild_jobs(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "events").where("user_id % 3 <> 0").select(F.concat(F.lit("raw/"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("source_path")).distinct()
    return jobs.rebuilt(job_view(spark, sf), live)


@query(f"WITH {JOBS} SELECT rel AS source_path, status FROM jobs WHERE contains(lower(rel), '/1') AND status = 'failed'")
def file_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = job_view(spark, sf).select(F.col("rel").alias("source_path"))
    return jobs.file_status(files, job_view(spark, sf), "/1", "failed")


# statistics and pages


@query("SELECT 'parquet' AS backend, (SELECT count(*) FROM documents)::BIGINT AS chunks, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS sources, (SELECT count(*) FROM embeddings)::BIGINT AS vectors, (SELECT count(*) FROM labels)::BIGINT AS indicators, (SELECT count(*) FROM pages)::BIGINT AS pages")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, agg, alias: table(spark, sf, name).agg(agg.alias(alias))
    out = one("documents", F.count("*"), "chunks").crossJoin(one("documents", F.countDistinct("source"), "sources"))
    for name, alias in (("embeddings", "vectors"), ("labels", "indicators"), ("pages", "pages")):
        out = out.crossJoin(one(name, F.count("*"), alias))  # tables of one row
    return out.select(F.lit("parquet").alias("backend"), "*")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    return src(spark, sf).select(F.concat(F.lit("entities/"), "uid", F.lit(".md")).alias("path"), F.concat(F.lit("Doc "), "uid").alias("title"), F.col("lang").alias("type"), "doc_id")


_INV = "inv AS (SELECT 'entities/' || uid || '.md' AS path, 'Doc ' || uid AS title, lang AS type, doc_id FROM src)"
_MARKED = "marks AS (SELECT 'entities/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, bool_or(quality = 0) AS edited FROM labels GROUP BY 1)"


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").groupBy(F.concat(F.lit("entities/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")).alias("page_path")).agg(F.bool_or(F.col("quality") == 0).alias("edited"))


@query(f"WITH {SRC}, {_INV} SELECT type, count(*)::BIGINT AS n, md5(string_agg('- [' || title || '](' || path || ')', chr(10) ORDER BY title, path)) AS listing FROM inv GROUP BY type")
def index_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return pages.by_type(_inventory(spark, sf)).withColumn("listing", F.md5(F.col("listing").cast("binary")))


@query(f"WITH {SRC}, {_INV}, {_MARKED} SELECT inv.path, title, type, coalesce(edited, false) AS edited FROM inv LEFT JOIN marks ON inv.path = marks.path")
def pages_with_marks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.with_marks(_inventory(spark, sf).drop("doc_id"), _marks(spark, sf)).select("path", "title", "type", "edited")


@query(f"WITH {SRC}, {_INV}, {_MARKED} SELECT inv.path, edited FROM inv JOIN marks ON inv.path = marks.path WHERE edited AND (contains(lower(title), 'german') OR contains(lower(inv.path), 'german') OR type = 'de')")
def page_filter(spark: SparkSession, sf: str) -> DataFrame:
    marked = pages.with_marks(_inventory(spark, sf), _marks(spark, sf))
    return pages.filtered(marked, "German", True, {"de": "German", "fr": "French"}).select("path", "edited")


@query(f"WITH {SRC}, {_INV} SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'concepts/' || title || '.md' END AS path, CASE WHEN doc_id % 2 = 0 THEN path END AS found FROM inv UNION ALL SELECT 'lost/' || substr(path, 10), path FROM inv WHERE doc_id % 3 = 0")
def path_heal(spark: SparkSession, sf: str) -> DataFrame:
    inv = _inventory(spark, sf)
    wanted = inv.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("concepts/"), "title", F.lit(".md"))).alias("path")).unionByName(inv.where("doc_id % 3 = 0").select(F.concat(F.lit("lost/"), text.basename(F.col("path"))).alias("path")))
    return pages.healed(wanted, inv)


@query(f"WITH {SRC} SELECT folder, count(*)::BIGINT AS n FROM (SELECT unnest(['raw', 'raw/' || source, 'raw/' || source || '/' || lang]) AS folder FROM src) GROUP BY folder")
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return relations.folder_counts(src(spark, sf))


@query(f"WITH {SRC} SELECT DISTINCT unnest(['raw', 'raw/' || source, 'raw/' || source || '/' || lang, source_path]) AS node FROM src WHERE contains(lower(doc_id || '.txt'), '77')")
def tree_filter(spark: SparkSession, sf: str) -> DataFrame:
    return relations.filtered_tree(src(spark, sf), "77")


@query(f"WITH {SRC}, x AS (SELECT unnest([{{'c': 'raw', 'l': false}}, {{'c': 'raw/' || source, 'l': false}}, {{'c': 'raw/' || source || '/' || lang, 'l': false}}, {{'c': source_path, 'l': true}}]) AS v FROM src) SELECT regexp_extract(v.c, '^(.*)/[^/]*$', 1) AS parent, v.c AS child, v.l AS is_leaf, count(*)::BIGINT AS n FROM x GROUP BY v.c, v.l")
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return relations.tree_edges(src(spark, sf))


@query(
    f"WITH {SRC}, t AS (SELECT doc_id, lang, regexp_replace(substr(content, 1, 40), '\\s+', ' ', 'g') AS title FROM src) SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY title COLLATE zh, title, doc_id)::INT AS place FROM t"
)
def locale_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each document's title among those of its language, in the order of a locale."""
    titles = src(spark, sf).select("doc_id", "lang", F.regexp_replace(F.substring("content", 1, 40), r"\s+", " ").alias("title"))
    order = Window.partitionBy("lang").orderBy(*pages.by_name(F.col("title"), "zh"), "doc_id")
    return titles.select("doc_id", F.row_number().over(order).alias("place"))


_LINKS = "(VALUES ('entities/beta.md', 'B', 'see [[A]] and [[beta]] [[zzz]]'), ('entities/a.md', 'A', '[[ B ]] [[be]] [[none]] [[zzz]]'), ('concepts/c.md', 'C', 'no links')) t(path, title, content)"


@query(
    f"""WITH p AS (SELECT path, title FROM {_LINKS} UNION ALL SELECT url, regexp_extract(html, '<title>([^<]*)', 1) FROM pages),
l AS (SELECT path, trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1))) AS target FROM {_LINKS} UNION ALL SELECT url, trim(unnest(regexp_extract_all(html, 'href="([^"\\]]+)"', 1))) FROM pages),
t AS (SELECT DISTINCT target FROM l), b AS (SELECT target FROM t WHERE target NOT IN (SELECT title FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE contains(p.path, t.target)))
SELECT path, target FROM l WHERE target IN (SELECT target FROM b)"""
)
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    """The literal rows, and every web page: its url, its title and its hrefs."""
    rows = [("entities/beta.md", "B", "see [[A]] and [[beta]] [[zzz]]"), ("entities/a.md", "A", "[[ B ]] [[be]] [[none]] [[zzz]]"), ("concepts/c.md", "C", "no links")]
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(r'href="([^"\]]+)"'), F.lit(1)), lambda x: F.concat(F.lit("[["), x, F.lit("]]")))
    web = table(spark, sf, "pages").select(F.col("url").alias("path"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.array_join(hrefs, " ").alias("content"))
    return pages.broken_links(spark.createDataFrame(rows, "path string, title string, content string").unionByName(web))


# extraction and conflicts

@query(
    """SELECT 'raw/' || p_partkey || '.md' AS source_path, CASE p_partkey % 3 WHEN 0 THEN '5.' || p_partkey % 7 || '.1' WHEN 1 THEN '7' ELSE '' END AS clause_no, CASE p_partkey % 3 WHEN 0 THEN '室内甲醛浓度' WHEN 1 THEN '宜采用照度' ELSE '温度' END AS indicator_name,
p_size::DOUBLE AS value, CASE p_partkey % 3 WHEN 0 THEN 'mg/m³' WHEN 1 THEN 'lx' ELSE '℃' END AS unit, CASE p_partkey % 3 WHEN 1 THEN 'lower' ELSE 'upper' END AS direction, CASE p_partkey % 3 WHEN 1 THEN '推荐' ELSE '强制' END AS level FROM part"""
)
def extract_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """A source for each part, whose size is the bound that its text states; a second line states none."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("5."), (k % 7).cast("string"), F.lit(".1 室内甲醛浓度不大于"), size, F.lit(" mg/m³。")))
    said = said.when(k % 3 == 1, F.concat(F.lit("7 宜采用照度不低于"), size, F.lit("lx"))).otherwise(F.concat(F.lit("温度≤"), size, F.lit("℃\n6.2 疏散时间 不低于 30 min")))
    docs = table(spark, sf, "part").select(F.concat(F.lit("raw/"), k.cast("string"), F.lit(".md")).alias("source_path"), said.alias("content"), F.lit("GB1").alias("standard_no"))
    return extraction.indicators(docs).select("source_path", "clause_no", "indicator_name", "value", "unit", "direction", "level")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'GB/T' || doc_id || '-2022' WHEN 1 THEN 'JGJ' || doc_id WHEN 2 THEN 'T/CECS' || doc_id || '.1-2020' ELSE '' END AS standard FROM documents")
def standard_no(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is given a sentence that names a standard in one of three ways, or none."""
    i = F.col("doc_id").cast("string")
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("依据 GB/T "), i, F.lit("-2022 执行"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("see JGJ "), i)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("按 T/CECS "), i, F.lit(".1-2020 的规定"))).otherwise("plain text")
    return table(spark, sf, "documents").select("doc_id", extraction.standard_no(said).alias("standard"))


#: A line for each word of a text, from nothing but n, its length and its place; SQL that both engines read.
_NAMES = "CASE {} % 5 WHEN 0 THEN '室内甲醛浓度' WHEN 1 THEN '照度' WHEN 2 THEN '疏散时间' WHEN 3 THEN '的净宽' ELSE '应符合温度' END"
_SAID = f"""CASE n % 11
WHEN 0 THEN '5.' || CAST(n % 7 AS STRING) || '.1 ' || {_NAMES.format('n')} || '不大于' || CAST(n AS STRING) || ' mg/m³。'
WHEN 1 THEN '7 宜采用' || {_NAMES.format('(n + 1)')} || '不低于' || CAST(n % 40 AS STRING) || 'lx'
WHEN 2 THEN {_NAMES.format('n')} || '≤' || CAST(n AS STRING) || '.' || CAST(n % 10 AS STRING) || '℃，' || {_NAMES.format('(n + 2)')} || '≥ ' || CAST(n % 60 AS STRING) || ' min'
WHEN 3 THEN '推荐的' || {_NAMES.format('n')} || '应为至少' || CAST(n AS STRING) || '　%（' || {_NAMES.format('(n + 3)')} || '上限' || CAST(n % 90 AS STRING) || ' kPa）'
WHEN 4 THEN 'no number: ' || {_NAMES.format('n')} || '不大于 many'
WHEN 5 THEN '不大于' || CAST(n AS STRING)
WHEN 6 THEN '12.3 ' || {_NAMES.format('n')} || '不得超过不小于' || CAST(n AS STRING) || ' m/s'
WHEN 7 THEN {_NAMES.format('n')} || '最大' || CAST(n AS STRING) || 'm最小' || CAST(n % 20 AS STRING) || 'm'
WHEN 8 THEN '依据 gb/t ' || CAST(n AS STRING) || '-2022 and JGJ 5'
WHEN 9 THEN '按 T/CECS ' || CAST(n AS STRING) || '.1-2020 的规定'
ELSE 'GB of ' || CAST(n AS STRING) END"""
_LINES = f"""l AS (SELECT doc_id, i - 1 AS line_no, {_SAID} AS line FROM (SELECT doc_id, i, len(p[i]) + i - 1 AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))))"""


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, content): each text's lines are made where it lies, without a shuffle of words."""
    lengths = "transform(split(text, ' '), (s, i) -> length(s) + i)"
    return table(spark, sf, "documents").where("text is not null").selectExpr("doc_id", f"array_join(transform({lengths}, n -> {_SAID}), '\\n') AS content")


@query(
    rf"""WITH {_LINES}, b AS (SELECT doc_id, line_no, line, string_split_regex(line, '{extraction.BOUND}') AS p, regexp_extract_all(line, '{extraction.BOUND}', 0) AS m, regexp_extract_all(line, '{extraction.BOUND}', 1) AS w, regexp_extract_all(line, '{extraction.BOUND}', 2) AS v, regexp_extract_all(line, '{extraction.BOUND}', 3) AS u FROM l WHERE regexp_matches(line, '{extraction.BOUND}')),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM b),
f AS (SELECT doc_id, line_no, i, regexp_extract(line, '([0-9]+(?:\.[0-9]+)*)\s', 1) AS clause_no,
  trim(regexp_replace(regexp_extract(array_to_string(list_transform(range(1, i), lambda j: p[j] || m[j]), '') || p[i], '([^{extraction.STOP}]{{2,20}})$', 1), '^[的是应为须需符合]+', '')) AS indicator_name, v[i]::DOUBLE AS value,
  regexp_replace(u[i], '[^\w%/·℃°³²µμ]', '', 'g') AS unit, CASE WHEN w[i] IN ({', '.join(repr(x) for x in extraction.LOWER_WORDS)}) THEN 'lower' ELSE 'upper' END AS direction, CASE WHEN regexp_matches(line, '宜|推荐') THEN '推荐' ELSE '强制' END AS level FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, indicator_name, value, unit ORDER BY line_no, i) AS k FROM f WHERE indicator_name <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS ordinal FROM g WHERE k = 1)
SELECT doc_id, ordinal::INT AS ordinal, clause_no, indicator_name, value, unit, direction, level FROM o WHERE ordinal <= {extraction.PER_FILE}"""
)
def indicators_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every document is a line in one of eleven shapes; documents of some length have repeated bounds, and more than a source may have."""
    docs = _said(spark, sf).select(F.col("doc_id").alias("source_path"), "content", F.lit("").alias("standard_no"))
    return extraction.indicators(docs).select(F.col("source_path").alias("doc_id"), "ordinal", "clause_no", "indicator_name", "value", "unit", "direction", "level")


@query(rf"WITH {_LINES} SELECT doc_id, regexp_replace(regexp_extract(string_agg(line, chr(10) ORDER BY line_no), '{extraction.STANDARD}', 0), '\s+', '', 'g') AS standard FROM l GROUP BY doc_id")
def standards_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first standard that each of these texts names; rows of one doc_id are one text, by their lines' places."""
    named = _said(spark, sf).select("doc_id", "content", F.regexp_extract("content", extraction.STANDARD, 0).alias("whole"))
    before = F.substring(F.col("content"), F.lit(1), F.call_function("locate", F.col("whole"), F.col("content")))
    line = F.when(F.col("whole") != "", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    first = named.select("doc_id", extraction.standard_no(F.col("whole")).alias("standard"), line.alias("line")).groupBy("doc_id").agg(F.min_by("standard", "line").alias("standard"))
    return first.select("doc_id", F.coalesce("standard", F.lit("")).alias("standard"))


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    lower = F.col("p_partkey") % 2 == 0
    return table(spark, sf, "part").select(F.col("p_brand").alias("standard_no"), F.lit("1").alias("clause_no"), F.col("p_type").alias("indicator_name"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("string").alias("unit"), F.when(lower, "lower").otherwise("upper").alias("direction"), F.col("p_partkey").alias("k"))


@query(
    """WITH l AS (SELECT p_partkey AS k, p_brand AS no, p_type AS name, p_size AS unit, p_retailprice AS v, CASE WHEN p_partkey % 2 = 0 THEN 'lower' ELSE 'upper' END AS d FROM part)
SELECT a.name AS indicator_name, a.no AS no_a, b.no AS no_b, a.v AS value_a, b.v AS value_b, CASE WHEN a.d <> b.d THEN '方向不同' WHEN a.v = b.v THEN '相同' WHEN a.d = 'lower' THEN CASE WHEN a.v > b.v THEN 'A更严格' ELSE 'B更严格' END ELSE CASE WHEN a.v < b.v THEN 'A更严格' ELSE 'B更严格' END END AS type
FROM l a JOIN l b ON a.name = b.name AND a.unit = b.unit WHERE a.no = 'Brand#11' AND b.no <> 'Brand#11'"""
)
def numeric_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _limits(spark, sf)
    found = extraction.numeric_conflicts(rows.where("standard_no = 'Brand#11'"), rows.where("standard_no <> 'Brand#11'"))
    return found.select("indicator_name", F.col("standard_a.no").alias("no_a"), F.col("standard_b.no").alias("no_b"), F.col("standard_a.value").alias("value_a"), F.col("standard_b.value").alias("value_b"), "type")


@query("SELECT 'concepts/' || doc_id || '.md' AS path, (doc_id % 3)::BIGINT AS n, '> ⚠️ **潜在冲突** ' || doc_id || chr(10) || '> b' AS first FROM documents WHERE doc_id % 3 > 0")
def conflict_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each document, with none to two blocks."""
    i = F.col("doc_id").cast("string")
    block = F.concat(F.lit(extraction.MARKER + " "), i, F.lit("\n> b\ntext\n"))
    made = table(spark, sf, "documents").select(F.concat(F.lit("concepts/"), i, F.lit(".md")).alias("path"), F.concat(F.lit("intro\n"), F.repeat(block, (F.col("doc_id") % 3).cast("int")), F.lit("end")).alias("content"))
    return extraction.conflict_blocks(made).select("path", "n", F.element_at("blocks", 1).alias("first"))


# plans of operations

_ANSWERS = [
    (1, '```json\n{"operations":[{"kind":"create","path":"entities/x.md","content":"---\\ntitle: X\\n---\\nA\\n"},{"path":"raw/no.md","content":"n"}]}\n```'),
    (2, 'prose [{"kind":"update","path":"entities/x.md","content":"---\\ntitle: X2\\n---\\nB"},{"path":"entities/y.md"}] more'),
    (3, '{"operations":[{"path":"entities/x.md","content":"A"},{"kind":"other","path":"concepts/GB1.md","content":"---\\ntitle: none\\n---\\nC"}]}'),
    (4, "no plan here"),
]


def _ops(spark: SparkSession) -> DataFrame:
    return plans.plan_ops(spark.createDataFrame(_ANSWERS, "window int, raw string"))


_ANSWERED = """a AS (SELECT doc_id::INT AS win, doc_id % 4 AS k, 'entities/x' || doc_id || '.md' AS x, 'concepts/GB' || doc_id || '.md' AS g, doc_id FROM documents)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each document: a fenced plan with a path that is refused, a bare list with an operation without content, a plan of two, or none."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = F.when(k == 0, j('```json\n{"operations":[{"kind":"create","path":"entities/x', i, '.md","content":"A', i, '"},{"path":"raw/no.md","content":"n"}]}\n```'))
    raw = raw.when(k == 1, j('prose [{"kind":"update","path":"entities/x', i, '.md","content":"B"},{"path":"entities/y.md"}] more'))
    raw = raw.when(k == 2, j('{"operations":[{"path":"entities/x', i, '.md","content":"A"},{"kind":"other","path":"concepts/GB', i, '.md","content":"C"}]}')).otherwise("no plan here")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("int").alias("window"), raw.alias("raw"))


@query(f"WITH {_ANSWERED} SELECT win, 0 AS seq, CASE k WHEN 1 THEN 'update' ELSE 'create' END AS kind, x AS path, CASE k WHEN 0 THEN 1 + len(doc_id::VARCHAR) ELSE 1 END::INT AS n FROM a WHERE k < 3 UNION ALL SELECT win, 1, 'create', g, 1 FROM a WHERE k = 2")
def plan_ops(spark: SparkSession, sf: str) -> DataFrame:
    return plans.plan_ops(_answers(spark, sf)).select(F.col("window").alias("win"), "seq", "kind", "path", F.length("content").alias("n"))


@query(
    """WITH o AS (SELECT doc_id, 'entities/' || doc_id % 97 || '.md' AS path, CASE doc_id % 2 WHEN 0 THEN 'create' ELSE 'update' END AS kind, 'body ' || doc_id // 97 % 3 || ' end' AS body FROM documents),
b AS (SELECT path, body, min(doc_id) AS f, min_by(kind, doc_id) AS kind FROM o GROUP BY path, body)
SELECT path, min_by(kind, f) AS kind, '---' || chr(10) || 'title: T' || min(f) || chr(10) || '---' || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY f) || CASE WHEN count(*) > 1 THEN chr(10) ELSE '' END AS content FROM b GROUP BY path"""
)
def merge_ops(spark: SparkSession, sf: str) -> DataFrame:
    """An operation of each document on one of 97 pages, with one of three bodies."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id")
    content = F.concat(F.lit("---\ntitle: T"), i, F.lit("\n---\nbody "), (F.floor(k / 97) % 3).cast("string"), F.lit(" end"))
    ops = table(spark, sf, "documents").select(k.alias("window"), F.lit(0).alias("seq"), F.when(k % 2 == 0, "create").otherwise("update").alias("kind"), F.concat(F.lit("entities/"), (k % 97).cast("string"), F.lit(".md")).alias("path"), content.alias("content"))
    return plans.merge_ops(ops).select("path", "kind", "content")


_NAMED = [("entities/gb-1.md", "GB 1"), ("entities/GB标1.md", "GB1"), ("concepts/x_y.md", "x y"), ("sources/s.md", "S")]


def _named_by_texts(d: DataFrame) -> DataFrame:
    """(path, title, doc_id): a page for each document, named by its first words."""
    first, second = F.substring_index("text", " ", 1), F.split_part(F.substring_index("text", " ", 2), F.lit(" "), F.lit(2))  # not the whole text in parts
    return d.select(F.concat(F.lit("entities/"), second, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(first, F.lit(" "), second).alias("title"), "doc_id")


def _all_named(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_NAMED, "path string, title string").unionByName(_named_by_texts(table(spark, sf, "documents")).drop("doc_id"))


_DROP = r"""[\s_\-—–·.,，。:：;；!！?？()（）\[\]【】{}"''“”‘’`/\\|]+"""
_MADE = "made AS (SELECT doc_id, 'entities/' || split_part(text, ' ', 2) || '-' || doc_id || '.md' AS path, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS title FROM documents)"
_INDEX = f"""{_MADE}, p AS (SELECT path, title FROM made UNION ALL SELECT * FROM (VALUES ('entities/gb-1.md', 'GB 1'), ('entities/GB标1.md', 'GB1'), ('concepts/x_y.md', 'x y')) t(path, title)),
named AS (SELECT path, title, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '') AS name FROM p),
k AS (SELECT DISTINCT path, regexp_replace(lower(nfc_normalize(unnest([name, title]))), '{_DROP}', '', 'g') AS key, regexp_full_match(name, '[ -~]+') AS plain FROM named),
ix AS (SELECT key, CASE WHEN count(*) = 1 THEN min(path) WHEN count(*) FILTER (WHERE plain) = 1 THEN min(path) FILTER (WHERE plain) END AS path FROM k WHERE len(key) >= 2 GROUP BY key)"""


@query(f"WITH {_INDEX} SELECT key, path FROM ix WHERE path IS NOT NULL")
def dedup_index(spark: SparkSession, sf: str) -> DataFrame:
    """The literal pages and one for each document."""
    return plans.dedup_index(_all_named(spark, sf))


@query(
    f"""WITH {_INDEX}, o AS (SELECT doc_id + 100 AS win, 0 AS seq, 'create' AS kind, 'concepts/' || doc_id || '_.md' AS path, doc_id::VARCHAR AS k1, regexp_replace(lower(nfc_normalize(trim(regexp_replace(title, '\\s+', ' ', 'g')))), '{_DROP}', '', 'g') AS k2 FROM made
UNION ALL SELECT * FROM (VALUES (1, 0, 'create', 'entities/x.md', 'x', 'x'), (2, 0, 'update', 'entities/x.md', 'x', 'x2'), (3, 0, 'create', 'entities/x.md', 'x', ''), (3, 1, 'create', 'concepts/GB1.md', 'gb1', 'none')) t(win, seq, kind, path, k1, k2)),
j AS (SELECT o.*, CASE WHEN kind = 'create' THEN coalesce(a.path, b.path) END AS target FROM o LEFT JOIN (SELECT * FROM ix WHERE path IS NOT NULL) a ON k1 = a.key LEFT JOIN (SELECT * FROM ix WHERE path IS NOT NULL) b ON k2 = b.key)
SELECT win::BIGINT AS win, seq, CASE WHEN target IS NOT NULL AND target <> path THEN 'update' ELSE kind END AS kind, coalesce(target, path) AS path FROM j"""
)
def plan_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The literal operations, and one for each document that creates a page of its title."""
    made = _named_by_texts(table(spark, sf, "documents")).select((F.col("doc_id") + 100).cast("long").alias("window"), F.lit(0).alias("seq"), F.lit("create").alias("kind"), F.concat(F.lit("concepts/"), F.col("doc_id").cast("string"), F.lit("_.md")).alias("path"), F.concat(F.lit("---\ntitle: "), F.regexp_replace("title", r"\s+", " "), F.lit("\n---\nD")).alias("content"))
    ops = _ops(spark).withColumn("window", F.col("window").cast("long")).unionByName(made)
    return plans.dedup_plan(ops, plans.dedup_index(_all_named(spark, sf))).select(F.col("window").alias("win"), "seq", "kind", "path")


@query(
    f"""WITH {_MADE}, k AS (SELECT path, regexp_replace(lower(unnest([title, substr(path, 10, len(path) - 12)])), '{_DROP}', '', 'g') AS key, unnest([10, 1]) AS each FROM made),
w AS (SELECT doc_id AS win, regexp_replace(lower(text), '{_DROP}', '', 'g') AS hay FROM documents), u AS (SELECT DISTINCT key FROM k WHERE len(key) >= 2),
c AS (SELECT win, key FROM w JOIN u ON contains(hay, key)),
h AS (SELECT win, path, len(c.key) * each AS s FROM c JOIN k ON c.key = k.key UNION ALL SELECT doc_id, path, 1000 FROM made),
g AS (SELECT win, path, sum(s)::BIGINT AS score FROM h GROUP BY win, path)
SELECT win, path, score FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY score DESC, path) AS k FROM g) WHERE k <= 40"""
)
def prompt_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a page and a window."""
    d = table(spark, sf, "documents")
    inv = _named_by_texts(d)
    windows = d.select(F.col("doc_id").alias("window"), F.col("text").alias("content"))
    return plans.prompt_pages(inv, windows, inv.select(F.col("doc_id").alias("window"), "path"), ascii_only=True).select(F.col("window").alias("win"), "path", "score")


@query("SELECT 'entities/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 5 < 2 AND p_partkey % 2 = 0 THEN 'skipped' WHEN p_partkey % 5 < 2 THEN 'updated' ELSE 'created' END AS outcome, p_partkey % 3 = 0 AND NOT (p_partkey % 5 < 2 AND p_partkey % 2 = 0) AS marked FROM part")
def apply_ops(spark: SparkSession, sf: str) -> DataFrame:
    """An operation for each part, on pages of which two in five exist."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("entities/"), k.cast("string"), F.lit(".md")).alias("path")
    p = table(spark, sf, "part")
    ops = p.select(F.when(k % 2 == 0, "create").otherwise("update").alias("kind"), path, F.when(k % 3 == 0, F.concat(F.lit("a\n" + extraction.MARKER), F.lit(" b"))).otherwise("a").alias("content"))
    return plans.applied(ops, p.where(k % 5 < 2).select(path), reject_existing=True)


# sessions


def _personas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("content"), (F.col("c_acctbal") > 0).cast("int").alias("status"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_acctbal > 0")
def persona_active(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.active(_personas(spark, sf)).select("id", "name")


@query("SELECT o_orderkey::VARCHAR AS session_id, CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR END AS persona_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def session_persona(spark: SparkSession, sf: str) -> DataFrame:
    assigned = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("persona_id"))
    return sessions.bound(assigned, _personas(spark, sf))


@query(
    """WITH o AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS id, CASE WHEN s IS NULL THEN c_mktsegment ELSE s END AS content, CASE WHEN s IS NULL THEN (c_acctbal > 0)::INT WHEN s = 'F' THEN 0 ELSE 1 END AS status FROM customer LEFT JOIN o ON c_custkey = o_custkey"""
)
def persona_scd(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.lit("").alias("name"), F.col("o_orderstatus").alias("content"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("status"), F.col("o_orderkey").alias("seq"))
    return sessions.latest(_personas(spark, sf), changes).select("id", "content", "status")


@query("SELECT conv_id, count(*)::BIGINT AS messages, sum(len(text))::BIGINT AS chars, coalesce(sum(len(text)) FILTER (WHERE role = 'system'), 0)::BIGINT AS system_chars, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions.trace_summary(table(spark, sf, "conversations"))
    return s.select("conv_id", "messages", _long("chars"), _long("system_chars"), "last_role")


@query("SELECT event_id, lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') || '-' || strftime(ts, '%Y-%m-%dT%H-%M-%S-') || lpad((extract('milliseconds' FROM ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z-u' || user_id || '_x_1' AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def trace_label(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf, "events").withColumn("n", n)
    return e.select("event_id", sessions.trace_label(F.col("n"), F.col("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/x.1"))).alias("label"))


def _folded(spark: SparkSession, sf: str, said) -> DataFrame:
    kind = F.when(F.col("role") == "user", "reasoning-delta").when(F.col("role") == "assistant", "text-delta").otherwise("finish")
    parts = table(spark, sf, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), kind.alias("type"), said.alias("text"), F.when(kind == "finish", "stop").alias("finish_kind"), (F.col("turn") * 10).alias("t_ms"))
    return sessions.stream_fold(parts).withColumn("first_delta_ms", F.coalesce("first_delta_ms", F.lit(-1).cast("long")))


@query(
    """WITH p AS (SELECT conv_id AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'reasoning-delta' WHEN 'assistant' THEN 'text-delta' ELSE 'finish' END AS type, text AS x FROM conversations),
k AS (SELECT call_id, type, count(*) AS n, min(seq) AS f FROM p GROUP BY call_id, type)
SELECT p.call_id, coalesce(string_agg(x, '' ORDER BY seq) FILTER (WHERE type = 'text-delta'), '') AS text, (SELECT string_agg(type || ':' || n, ',' ORDER BY f) FROM k WHERE k.call_id = p.call_id) AS types, CASE WHEN count(*) FILTER (WHERE type = 'finish') > 0 THEN 'ok' ELSE 'error' END AS outcome, coalesce(min(seq * 10) FILTER (WHERE type = 'text-delta'), -1)::BIGINT AS first_delta_ms FROM p GROUP BY p.call_id"""
)
def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf, F.col("text"))


# streams


@query("SELECT conv_id, max_by(text, turn) AS prompt, max(turn)::BIGINT AS last FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def stream_latest_prompt(spark: SparkSession, sf: str) -> DataFrame:
    events = streams.arriving(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema).where("role = 'user'")
    return streams.final_state(streams.latest_prompts(events, "conv_id", "turn"), spark)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; one kind of them stands for a removal."""
    return streams.arriving(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


#: A file has settled after six quiet hours, as the table's users act some twice a day.
_QUIET = 6 * 3_600_000


@query(
    f"""WITH e AS (SELECT 'raw/' || user_id AS path, (epoch_us(ts) // 1000) AS ms, CASE event_type WHEN 'error' THEN 'unlink' ELSE 'change' END AS kind FROM events),
o AS (SELECT *, lag(ms) OVER (PARTITION BY path ORDER BY ms, kind) AS before FROM e),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before >= {_QUIET} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ms, kind) AS burst FROM o)
SELECT path, min(ms) AS first_ms, max(ms) AS last_ms, count(*)::BIGINT AS n, CASE WHEN max_by(kind, (ms, kind)) = 'unlink' THEN 'removed' ELSE 'ready' END AS action
FROM b GROUP BY path, burst HAVING max(ms) + {_QUIET} <= (SELECT max(ms) FROM e)"""
)
def watch_settled(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a file's events, once they are over."""
    kind = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    events = _events(spark, sf).select(F.concat(F.lit("raw/"), F.col("user_id").cast("string")).alias("path"), "ts", kind.alias("kind"))
    return stateful.settled_files(events, _QUIET)


#: A claim ends by itself after half an hour.
_LEASE = 1_800_000


@query(
    f"""WITH RECURSIVE c AS (SELECT 'lib' || (user_id % 5) AS lib, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k, event_id AS seq, (epoch_us(ts) // 1000) AS ms, 'raw/' || user_id AS rel,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'enqueue' WHEN event_type = 'view' THEN 'claim' WHEN event_type = 'click' THEN 'done' WHEN value >= 20 THEN 'fail' WHEN value >= 10 THEN 'pause' ELSE 'resume' END AS action, event_type = 'purchase' AS front FROM events),
-- one row for each command: the queue and what is at work before it is carried out, after a lease that has run out
f AS (SELECT lib, 0::BIGINT AS k, []::VARCHAR[] AS pending, NULL::VARCHAR AS work, 0::BIGINT AS since, false AS paused, NULL::VARCHAR AS rel, NULL::VARCHAR AS status, NULL::VARCHAR AS error, NULL::VARCHAR AS lost, 0::BIGINT AS seq FROM (SELECT DISTINCT lib FROM c)
  UNION ALL
  SELECT lib, k, CASE WHEN action = 'enqueue' AND NOT list_contains(pending, r) THEN CASE WHEN front THEN list_prepend(r, pending) ELSE list_append(pending, r) END WHEN claims THEN pending[2:] ELSE pending END,
    CASE WHEN claims THEN pending[1] WHEN action IN ('done', 'fail') THEN NULL ELSE w END, CASE WHEN claims THEN ms ELSE since END, CASE action WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE paused END,
    CASE WHEN action = 'enqueue' THEN r WHEN claims THEN pending[1] WHEN action IN ('done', 'fail') THEN w END,
    CASE WHEN action = 'enqueue' THEN 'queued' WHEN claims THEN 'parsing' WHEN w IS NULL THEN NULL WHEN action = 'done' THEN 'done' WHEN action = 'fail' THEN 'failed' END,
    CASE WHEN action = 'fail' AND w IS NOT NULL THEN 'failed' END, lost, s
  FROM (SELECT *, action = 'claim' AND w IS NULL AND NOT paused AND len(pending) > 0 AS claims FROM
    (SELECT f.lib, c.k, c.seq AS s, c.ms, c.rel AS r, c.action, c.front, f.pending, f.since, f.paused, CASE WHEN c.ms - f.since >= {_LEASE} THEN NULL ELSE f.work END AS w, CASE WHEN c.ms - f.since >= {_LEASE} THEN f.work END AS lost FROM f JOIN c ON c.lib = f.lib AND c.k = f.k + 1))),
said AS (SELECT lib, rel, status, error, seq, 1 AS later FROM f WHERE status IS NOT NULL UNION ALL SELECT lib, lost, 'failed', 'interrupted', seq, 0 FROM f WHERE lost IS NOT NULL
  UNION ALL SELECT lib, work, 'failed', 'interrupted', seq, 2 FROM (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY k DESC) AS back FROM f) WHERE back = 1 AND work IS NOT NULL AND since + {_LEASE} <= (SELECT max(ms) FROM c)),
last AS (SELECT lib, rel, max_by({{'s': status, 'e': error}}, (seq, later)) AS x FROM said GROUP BY lib, rel)
SELECT lib, rel, x.s AS status, CASE x.s WHEN 'queued' THEN 0 WHEN 'parsing' THEN 10 ELSE 100 END::INT AS progress, coalesce(x.e, '') AS error FROM last"""
)
def queue_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The job table of five libraries' queues after all events: some put files in, some claim them, others end, pause and resume."""
    kind, value = F.col("event_type"), F.col("value")
    action = F.when(kind.isin("signup", "purchase"), "enqueue").when(kind == "view", "claim").when(kind == "click", "done").when(value >= 20, "fail").when(value >= 10, "pause").otherwise("resume")
    rel, lib = F.concat(F.lit("raw/"), F.col("user_id").cast("string")), F.concat(F.lit("lib"), (F.col("user_id") % 5).cast("string"))
    commands = _events(spark, sf).select(lib.alias("lib"), F.col("event_id").alias("seq"), "ts", rel.alias("rel"), action.alias("action"), (kind == "purchase").alias("front"))
    table_ = stateful.job_table(stateful.queue_changes(commands, _LEASE))
    return table_.select("lib", "rel", "status", "progress", F.coalesce("error", F.lit("")).alias("error"))


@query("SELECT conv_id::VARCHAR AS conv_id, max_by(text, turn) AS prompt, max(turn)::BIGINT AS last FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def stream_newest_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The same as stream_latest_prompt, from a state that forgets sessions which have been silent; a turn takes a minute."""
    turns = streams.arriving(spark, f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema).where("role = 'user'")
    got = stateful.newest_prompts(turns.select(F.col("conv_id").alias("session_id"), F.timestamp_millis((F.col("turn") + 1) * 60_000).alias("ts"), F.col("turn").alias("place"), "text"))
    return got.select(F.col("session_id").alias("conv_id"), "prompt", "last")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '')) AS file_hash, len(text) > 0 AS ok FROM documents")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = streams.arriving(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").schema)
    out = place(spark, "ingest")
    found = rows.select("doc_id", F.sha2(text.normalize(F.col("text")).cast("binary"), 256).alias("file_hash"), (F.length("text") > 0).alias("ok"))
    streams.drained(found, streams.kept(out))
    return spark.read.parquet(out).drop("batch")


# scalars

_PATHS = ("raw/a#.md", "raw/../x#", "/etc/x#", "C:/x#", "#", "raw", "raw/b/../c#.md", "other/a#.md", "raw\\d#.md", "raw/./#", "rawer/#", "raw/..a/#")


@query(
    r"""WITH p AS (SELECT p_partkey, replace(list_extract(['raw/a#.md', 'raw/../x#', '/etc/x#', 'C:/x#', '#', 'raw', 'raw/b/../c#.md', 'other/a#.md', 'raw\d#.md', 'raw/./#', 'rawer/#', 'raw/..a/#'], (p_partkey % 12 + 1)::INT), '#', p_size::VARCHAR) AS path FROM part),
n AS (SELECT *, string_split(replace(path, '\', '/'), '/') AS parts FROM p)
SELECT p_partkey, path, parts[1] = 'raw' AND NOT list_contains(parts, '..') AS safe FROM n"""
)
def path_safety(spark: SparkSession, sf: str) -> DataFrame:
    """A path of twelve shapes for each part."""
    shape = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", F.replace(shape, F.lit("#"), F.col("p_size").cast("string")).alias("path"))
    return p.select("p_partkey", "path", text.safe_path(F.col("path")).alias("safe"))


@query("SELECT lower(regexp_extract(url, '(\\.[^./?#]*)([?#].*)?$', 1)) AS ext, count(*)::BIGINT AS n, bool_or(lower(regexp_extract(url, '(\\.[^./?#]*)([?#].*)?$', 1)) IN ('.txt', '.md', '.html', '.htm', '.json', '.csv', '.pdf')) AS known FROM pages GROUP BY 1")
def ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("url", r"(\.[^./?#]*)([?#].*)?$", 1))
    return table(spark, sf, "pages").select(ext.alias("ext"), ext.isin(*readers.extensions([" PDF ", ""])).alias("known")).groupBy("ext").agg(F.count("*").alias("n"), F.bool_or("known").alias("known"))


@query(
    """WITH v AS (SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 11 AS b, p_size % 7 AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN false ELSE (a, b, c) >= (1, 5, 3) END AS enough FROM v"""
)
def semver_cmp(spark: SparkSession, sf: str) -> DataFrame:
    """A release for each part, some before their final one and some without a third number, against 1.5.3."""
    k = F.col("p_partkey")
    host = F.concat_ws(".", (k % 3).cast("string"), (k % 11).cast("string"), F.when(k % 13 != 0, F.concat((F.col("p_size") % 7).cast("string"), F.when(k % 5 == 0, "-rc.1").otherwise(""))))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(text.release(host) >= text.release(F.lit("1.5.3")), F.lit(False)).alias("enough"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%H:%M') AS minute FROM events")
def ts_render(spark: SparkSession, sf: str) -> DataFrame:
    f = lambda p, a: F.date_format("ts", p).alias(a)
    return table(spark, sf, "events").select("event_id", f("yyyy-MM-dd", "day"), f("yyyy-MM-dd HH:mm:ss", "stamp"), f("HH:mm", "minute"))


@query(
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS lp, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS lm, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS cp FROM part),
w AS (SELECT *, CASE WHEN lp IS NOT NULL AND lm <> '' THEN 1 WHEN cp IS NOT NULL THEN 2 ELSE 3 END AS which FROM r)
SELECT p_partkey, CASE which WHEN 1 THEN lp WHEN 2 THEN cp ELSE 'e' END AS provider, CASE which WHEN 1 THEN lm WHEN 2 THEN 'd' ELSE 'f' END AS model FROM w"""
)
def route_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """For each part a route of its own, which may lack a half, one of its library, and a default."""
    k = F.col("p_partkey")
    r = sessions.route((F.when(k % 2 == 0, F.col("p_brand")), F.when(k % 3 == 0, "").otherwise(F.col("p_type"))), (F.when(k % 5 > 0, F.col("p_name")), F.lit("d")), (F.lit("e"), F.lit("f")))
    return table(spark, sf, "part").select("p_partkey", r["provider"].alias("provider"), r["model"].alias("model"))


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'mark' WHEN 1 THEN 'reject' WHEN 2 THEN 'overwrite' ELSE 'mark' END AS conflict, c_custkey % 4 > 0 AND c_custkey % 3 > 0 AS read_only,
CASE WHEN c_custkey % 4 = 0 THEN 'source,entity,concept' ELSE 'entity,t-' || c_nationkey END AS page_types, CASE WHEN c_custkey % 4 = 0 THEN 'entities/<名称>.md' ELSE 'entities/<' || c_nationkey || '>.md' END AS naming FROM customer"""
)
def schema_form(spark: SparkSession, sf: str) -> DataFrame:
    """A policy document for each customer; a quarter say nothing, so that the defaults hold."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    said = F.when(k % 4 == 1, "reject").when(k % 4 == 2, "overwrite").otherwise("other")
    whole = j("# Policy\n\n## 页面类型\n- entity\n- t-", nation, "\n\n## 冲突处理规则\n- 冲突行为：", said, "\n\n## 命名约定\n- 实体页：entities/<", nation, ">.md\n\n## 不可变性规则\n- raw/ 目录只读：", F.when(k % 3 > 0, "是").otherwise("否"), "\n")
    d = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 4 == 0, "prose only").otherwise(whole).alias("doc"))
    c = schema.columns(F.col("doc"))
    return d.select("id", *[(F.array_join(v, ",") if name == "page_types" else v).alias(name) for name, v in c.items()])


@query(f"WITH {VEC} SELECT vec_id, round(list_inner_product(e, e), 6) AS squared FROM vec")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.doubles(F.col("embedding"))
    return vec(spark, sf).select("vec_id", F.round(vectors.dot(v, v), 6).alias("squared"))
