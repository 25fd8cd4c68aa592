"""Queries over the smaller operators of upkeep, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text
from loomstone.operators import relations, upkeep
from loomstone.plans.views import JOBS, SRC, src, table
from loomstone.plans.views import jobs as job_view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(
    f"""WITH {JOBS}, known AS (SELECT DISTINCT 'raw/' || (user_id % 20) || '/' || user_id || '.txt' AS rel FROM events WHERE value > 100 AND event_type = 'signup')
SELECT rel, CASE WHEN status IN ('running', 'failed') THEN 'failed' ELSE 'done' END AS status, 100::INT AS progress, CASE WHEN status = 'running' THEN 'interrupted' WHEN status = 'failed' THEN 'was ' || updated_at ELSE '' END AS error FROM jobs WHERE rel NOT IN (SELECT rel FROM known)"""
)
def adopt_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs of an older register, of files that the new one does not know."""
    rel = F.concat(F.lit("raw/"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt"))
    known = table(spark, sf, "events").where("value > 100 AND event_type = 'signup'").select(rel.alias("rel")).distinct()
    legacy = job_view(spark, sf).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("was "), F.col("updated_at").cast("string"))).otherwise(""))
    return upkeep.adopted_jobs(legacy, known)


#: A page beside each document's file: named flat after it or not, and saying that it is that file's or another's, as the text's length says.
_FLAT = f"""{SRC}, pg AS (SELECT CASE WHEN len(content) % 2 = 0 THEN 'sources/' || doc_id || '.txt.md' ELSE 'sources/' || source || '/' || doc_id || '.md' END AS path, CASE WHEN len(content) % 3 = 0 THEN 'raw/other/' || doc_id || '.txt' ELSE source_path END AS source FROM src)"""


@query(f"WITH {_FLAT} SELECT pg.path FROM pg JOIN src ON pg.source = src.source_path AND pg.path = 'sources/' || regexp_extract(src.source_path, '([^/]*)$', 1) || '.md'")
def flat_mirrors(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of an older layout, which a file's own page replaces."""
    docs = src(spark, sf)
    n, i = F.length("content"), F.col("doc_id").cast("string")
    path = F.when(n % 2 == 0, F.concat(F.lit("sources/"), i, F.lit(".txt.md"))).otherwise(F.concat(F.lit("sources/"), "source", F.lit("/"), i, F.lit(".md")))
    of = F.when(n % 3 == 0, F.concat(F.lit("raw/other/"), i, F.lit(".txt"))).otherwise(F.col("source_path"))
    wiki = docs.select(path.alias("path"), text.rendered([("title", i), ("source", of)], F.col("content")).alias("content"))
    return upkeep.flat_mirrors(wiki, docs.select("source_path"))


@query(f"WITH {SRC} SELECT source_path, md5(content) AS digest FROM src WHERE len(content) % 2 = 0")
def mirror_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of sources as their pages have them."""
    docs = src(spark, sf)
    wiki = docs.select(text.mirror_path(F.col("source_path")).alias("path"), text.rendered([("title", F.col("uid")), ("source", F.col("source_path"))], F.col("content")).alias("content"))
    found = upkeep.mirrors(docs.where(F.length("content") % 2 == 0).select("source_path"), wiki)
    return found.select("source_path", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("SELECT doc_id, n_chars, k::INT AS row, greatest((SELECT count(*) FROM documents) - 175, 0)::BIGINT AS remaining FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 150 AS k FROM documents) WHERE k BETWEEN 1 AND 25")
def page_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The seventh page of twenty-five documents, and how many come after it."""
    return upkeep.page_of_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), 25, 6, "n_chars", "doc_id")


@query(f"WITH {SRC}, n AS (SELECT DISTINCT unnest([regexp_extract(source_path, '^([^/]*)', 1), regexp_extract(source_path, '^([^/]*/[^/]*)', 1), regexp_extract(source_path, '^(.*)/[^/]*$', 1), source_path]) AS path FROM src) SELECT path, (SELECT greatest(count(*) - 120, 0)::BIGINT FROM n) AS dropped FROM (SELECT path FROM n ORDER BY path LIMIT 120)")
def clipped_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The first nodes of the tree of files, and the number of those that are not shown."""
    nodes = relations.tree_edges(src(spark, sf)).select(F.col("child").alias("path"))
    return upkeep.clipped(nodes, 120)


@query("SELECT to_json(list(struct_pack(lang := lang, n := n, longest := longest) ORDER BY lang, n))::VARCHAR AS json FROM (SELECT lang, count(*) AS n, max(len(text)) AS longest FROM documents GROUP BY lang)")
def rows_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """A small table as one JSON array."""
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    return upkeep.as_json(rows, 100, "lang", "n")


@query(r"SELECT page_id, regexp_replace(replace(CASE WHEN len(html) % 2 = 0 THEN replace(url, '/', '\') || '\\' ELSE '//' || url || '/' END, '\', '/'), '^/+|/+$', '', 'g') AS path FROM pages")
def posix_paths(spark: SparkSession, sf: str) -> DataFrame:
    """urls as paths with either slash and slashes at their ends."""
    odd = F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("\\\\"))
    path = F.when(F.length("html") % 2 == 0, odd).otherwise(F.concat(F.lit("//"), "url", F.lit("/")))
    return table(spark, sf, "pages").select("page_id", upkeep.posix(path).alias("path"))


@query("SELECT doc_id, len(x)::INT AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda s: trim(s)), lambda s: s <> '') AS x FROM documents)")
def comma_lists(spark: SparkSession, sf: str) -> DataFrame:
    """every text read as a list with commas."""
    x = upkeep.listed(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(x).alias("n"), F.md5(F.array_join(x, "|").cast("binary")).alias("digest"))


@query(
    f"""WITH {_FLAT} SELECT source AS rel, 'queued' AS status FROM pg WHERE path LIKE 'sources/%/%' UNION ALL SELECT '__recompile_all__', 'running'
UNION ALL SELECT path, 'left' FROM (SELECT path FROM pg UNION ALL SELECT 'entities/' || doc_id || '.md' FROM src WHERE len(content) % 5 = 0) WHERE path LIKE 'sources/%'"""
)
def recompile_all(spark: SparkSession, sf: str) -> DataFrame:
    """Compiled pages go, each source waits, one job stands for the run."""
    docs = src(spark, sf)
    n, i = F.length("content"), F.col("doc_id").cast("string")
    path = F.when(n % 2 == 0, F.concat(F.lit("sources/"), i, F.lit(".txt.md"))).otherwise(F.concat(F.lit("sources/"), "source", F.lit("/"), i, F.lit(".md")))
    of = F.when(n % 3 == 0, F.concat(F.lit("raw/other/"), i, F.lit(".txt"))).otherwise(F.col("source_path"))
    mirrors = docs.select(path.alias("path"), of.alias("source_path"))
    wiki = mirrors.select("path").unionByName(docs.where(n % 5 == 0).select(F.concat(F.lit("entities/"), i, F.lit(".md")).alias("path")))
    queued, left = upkeep.recompiled(mirrors.where("path LIKE 'sources/%/%'"), wiki)
    return queued.unionByName(left.select(F.col("path").alias("rel"), F.lit("left").alias("status")))
