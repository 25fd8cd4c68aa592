"""Queries over the search operators and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text, vectors
from loomstone.operators import chunking, postings, relations, search
from loomstone.plans.views import SRC, VEC, src, table, vec
from loomstone.session import place
from loomstone.sources.store import Keyed, Store, settled

TERMS = ["thatin", "ononst"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _tf(t: str) -> str:
    count = lambda c: f"(len(lower({c})) - len(replace(lower({c}), '{t}', ''))) / {len(t)}"
    return f"(({count('content')}) + ({count('source_path')}))"


def _bm25(top: int, name: str = "lex") -> str:
    tf = ", ".join(f"{_tf(t)}::DOUBLE AS tf{i}" for i, t in enumerate(TERMS))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))
    return f"""tf AS (SELECT uid, greatest(len(content) - 2, 0) + greatest(len(source_path) - 2, 0) AS dl, {tf} FROM src),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf),
{name} AS (SELECT uid, {score} AS score FROM tf, st WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))} ORDER BY score DESC, uid LIMIT {top})"""


_DOT = "list_inner_product({0}, {1})"
_DIST = "CASE WHEN sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(q.e, q.e)) = 0 THEN 1 ELSE 1 - list_inner_product(a.e, q.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(q.e, q.e))) END"
_VTOP = f"vt AS (SELECT a.uid, {_DIST} AS distance FROM vec a, (SELECT e FROM vec WHERE vec_id = 7) q ORDER BY distance, a.uid LIMIT 20)"
_FUSE = """fused AS (SELECT coalesce(a.uid, b.uid) AS uid, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS score, coalesce(a.score, 0.0) AS lexical, coalesce(distance, 1.0) AS distance, 1 - distance AS cosine
  FROM (SELECT uid, score, row_number() OVER (ORDER BY score DESC, uid) AS ra FROM lex) a FULL OUTER JOIN (SELECT uid, distance, row_number() OVER (ORDER BY distance, uid) AS rb FROM vt) b ON a.uid = b.uid)"""
_HYBRID = f"WITH {SRC}, {VEC}, {_bm25(10)}, {_VTOP}, {_FUSE}, best AS (SELECT * FROM fused ORDER BY score DESC, uid LIMIT 5), hy AS (SELECT best.*, src.content, src.source_path FROM best JOIN src ON best.uid = src.uid WHERE coalesce(content, '') <> '')"


def _probe(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: one row, by its key."""
    return list(vec(spark, sf).where("vec_id = 7").select("embedding").first()[0])


@query(f"WITH {SRC}, {_bm25(10)} SELECT uid, round(score, 6) AS score FROM lex")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(src(spark, sf), TERMS, 10).select("uid", _r("score").alias("score"))


@query(f"WITH {SRC} SELECT uid, 1.0::DOUBLE AS score FROM src WHERE contains(lower(content), 'zu') ORDER BY uid LIMIT 20")
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.lexical(src(spark, sf), "zu", 20)


@query(f"WITH {SRC} SELECT uid, score FROM (SELECT uid, (len(content) - len(replace(lower(content), 'thatin', '')) + len(content) - len(replace(lower(content), 'the', '')))::BIGINT AS score FROM src) WHERE score > 0 ORDER BY score DESC, uid LIMIT 10")
def lexical_json(spark: SparkSession, sf: str) -> DataFrame:
    return search.weighted_occurrences(src(spark, sf), "Thatin the", 10)


@query(f"WITH {VEC}, {_VTOP} SELECT uid, round(distance, 6) AS distance FROM vt")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_top(vec(spark, sf), _probe(spark, sf), 20).select("uid", _r("distance").alias("distance"))


_SKETCH = "list_transform(range(0, 64), lambda i: w[2 * i + 1] + w[2 * i + 2])"


@query(
    f"WITH {SRC}, {VEC}, {_bm25(10)}, wide AS (SELECT uid, vec_id, list_concat(e, list_reverse(e)) AS w FROM vec), sk AS (SELECT uid, vec_id, {_SKETCH} AS e FROM wide), s AS (SELECT a.uid, 1 - ({_DIST}) AS s FROM sk a, (SELECT e FROM sk WHERE vec_id = 7) q) SELECT s.uid, round(s + CASE WHEN lex.uid IS NULL THEN 0 ELSE 2 END, 6) AS score FROM s LEFT JOIN lex ON s.uid = lex.uid ORDER BY s + CASE WHEN lex.uid IS NULL THEN 0 ELSE 2 END DESC, s.uid LIMIT 320"
)
def sketch_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    q = _probe(spark, sf)
    wide = vec(spark, sf).withColumn("embedding", F.concat("embedding", F.reverse("embedding")))
    return search.shortlist(wide, q + q[::-1], search.bm25(src(spark, sf), TERMS, 10), 320).select("uid", _r("score").alias("score"))


@query(f"WITH {SRC}, {VEC}, {_bm25(10)}, {_VTOP}, {_FUSE} SELECT uid, round(score, 6) AS score, round(cosine, 6) AS cosine FROM fused")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    fused = search.fuse(search.bm25(src(spark, sf), TERMS, 10), search.vector_top(vec(spark, sf), _probe(spark, sf), 20))
    return fused.select("uid", _r("score").alias("score"), _r("cosine").alias("cosine"))


@query(f"{_HYBRID} SELECT uid, source_path, round(score, 6) AS score, round(lexical, 6) AS lexical, round(distance, 6) AS distance FROM hy")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.hybrid(src(spark, sf), vec(spark, sf), " ".join(TERMS), _probe(spark, sf))
    return hits.select("uid", "source_path", *[_r(c).alias(c) for c in ("score", "lexical", "distance")])


_LIKE = "lex AS (SELECT uid, 1.0::DOUBLE AS score FROM src WHERE contains(lower(content), 'zu') ORDER BY uid LIMIT 10)"


@query(
    f"WITH {SRC}, {VEC}, {_LIKE}, {_VTOP}, {_FUSE}, best AS (SELECT * FROM fused ORDER BY score DESC, uid LIMIT 5) SELECT best.uid, source_path, round(score, 6) AS score, round(lexical, 6) AS lexical, round(distance, 6) AS distance FROM best JOIN src ON best.uid = src.uid WHERE coalesce(content, '') <> ''"
)
def hybrid_short(spark: SparkSession, sf: str) -> DataFrame:
    """Words too short for trigrams are looked for in the texts, in hybrid search too."""
    hits = search.hybrid(src(spark, sf), vec(spark, sf), " Zu ", _probe(spark, sf))
    return hits.select("uid", "source_path", *[_r(c).alias(c) for c in ("score", "lexical", "distance")])


#: Three states of the documents: in each some are missing, and in the second some have other texts.
_STATES = [
    "SELECT uid, source_path, content FROM src WHERE length(content) % 3 <> 0",
    "SELECT uid, source_path, CASE WHEN length(content) % 2 = 1 THEN content || ' ' || lang ELSE content END AS content FROM src WHERE length(content) % 4 <> 0",
    "SELECT uid, source_path, content FROM src WHERE length(content) % 5 <> 0",
]


def _states(spark: SparkSession, sf: str) -> list[DataFrame]:
    docs = src(spark, sf)
    return [spark.sql(q.replace("FROM src", "FROM {docs}"), docs=docs) for q in _STATES]


def _pages_of(state: DataFrame) -> DataFrame:
    return state.select(F.col("source_path").alias("key"), F.col("source_path").alias("path"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    f"""WITH {SRC}, {', '.join(f's{k} AS ({q})' for k, q in enumerate(_STATES))},
i AS (SELECT source_path AS key, md5(content) AS had FROM s1), p AS (SELECT source_path AS key, md5(content) AS digest FROM s2)
SELECT key, CASE WHEN had IS NULL THEN 'added' WHEN digest IS NULL THEN 'gone' ELSE 'changed' END AS action FROM i FULL OUTER JOIN p USING (key)
WHERE had IS DISTINCT FROM digest AND NOT (digest IS NULL AND key IN (SELECT source_path FROM s0 WHERE length(content) % 2 = 0))"""
)
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an index of the second state does to follow the third, where files of the first of even length are still there."""
    first, second, third = _states(spark, sf)
    index = second.select("source_path", F.md5(F.col("content").cast("binary")).alias("file_hash"))
    return relations.change_set(index, _pages_of(third), first.where("length(content) % 2 = 0")).select("key", "action")


_CHUNKS = Keyed("chunks", "uid string, content string, source_path string", postings.TAG)


@query(f"WITH {SRC.replace('src AS', 'every AS')}, src AS ({_STATES[2].replace('FROM src', 'FROM every')}), {_bm25(10)} SELECT uid, round(score, 6) AS score FROM lex")
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search from a stored index that was built from the first state and followed the second and the third."""
    store, had = Store(spark, place(spark, "index")), None
    for state in _states(spark, sf):
        index = spark.createDataFrame([], "source_path string, file_hash string") if had is None else had.select("source_path", F.md5(F.col("content").cast("binary")).alias("file_hash"))
        found = settled(relations.change_set(index, _pages_of(state), state.limit(0)))
        new = state.join(found.where("action <> 'gone'").select(F.col("key").alias("source_path")), "source_path")
        gone = had.join(found.select(F.col("key").alias("source_path")), "source_path").select(F.expr(postings.TAG).alias("k")) if had is not None else None
        change = store.change()
        postings.indexed(change, _CHUNKS, new, gone)
        change.commit()
        store.expire(1)  # nobody reads the state before
        had = store.read(_CHUNKS)
    return postings.search(store, TERMS, 10).select("uid", _r("score").alias("score"))


@query(f"{_HYBRID} SELECT uid, source_path, round(coalesce(cosine, score), 4) AS score FROM hy")
def search_view(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.hybrid(src(spark, sf), vec(spark, sf), " ".join(TERMS), _probe(spark, sf))
    return hits.select("uid", "source_path", _r(F.coalesce("cosine", "score"), 4).alias("score"))


@query(
    f"""WITH {SRC}, {_bm25(5)}, b AS (SELECT lex.uid, score, '[知识库片段] 来源：' || source_path || chr(10) || CASE WHEN len(content) <= 2000 THEN content ELSE regexp_replace(substr(content, 1, 1999), '[ \\t\\n\\r]+$', '') || '…' END AS block FROM lex JOIN src ON lex.uid = src.uid WHERE score > 0),
u AS (SELECT *, coalesce(sum(len(block) + 2) OVER (ORDER BY score DESC, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT uid, substr(block, 1, (4000 - used)::BIGINT) AS block FROM u WHERE used < 4000"""
)
def ambient_recall(spark: SparkSession, sf: str) -> DataFrame:
    chunks = src(spark, sf)
    return search.ambient(search.bm25(chunks, TERMS, 5).join(chunks.select("uid", "source_path", "content"), "uid"))


@query(
    r"""WITH s AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)), ' ', ' ' || chr(7)) || '  ' || chr(9) || chr(10) AS t FROM documents),
a AS (SELECT doc_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM s),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^[ \t\n\r]+', ''), '[ \t\n\r]+$', '')) AS digest FROM b"""
)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n\n\n\n")), F.lit(" "), F.lit(" \u0007")), F.lit("  \t\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(t).cast("binary")).alias("digest"))


@query("SELECT doc_id, len(text)::BIGINT AS code_points, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(r"SELECT doc_id, CASE WHEN len(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 79), '[ \t\n\r]+$', '') || '…' END AS short, substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 300) AS line FROM documents")
def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), 80).alias("short"), text.one_line(F.col("text"), 300).alias("line"))


@query(r"WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace('## ' || split_part(text, chr(10), 1), '^#+', ''), '\s+', ' ', 'g')) AS h FROM documents) SELECT doc_id, CASE WHEN len(h) > 60 THEN substr(h, 1, 59) || '…' ELSE h END AS heading FROM l")
def heading_trail(spark: SparkSession, sf: str) -> DataFrame:
    first = F.concat(F.lit("## "), F.substring_index("text", "\n", 1))
    return table(spark, sf, "documents").select("doc_id", text.heading(first).alias("heading"))


@query(
    """WITH d AS (SELECT doc_id, text, len(text) AS n FROM documents), z AS (SELECT *, CASE WHEN n <= 2000 THEN 2000 ELSE greatest(2000, least(ceil((least(n, 4000000) + 39800) / 200), 20200)) END::BIGINT AS size FROM d),
w AS (SELECT *, CASE WHEN n <= 2000 THEN 1 ELSE ceil((least(n, 4000000) - size) / (size - 200)) + 1 END::BIGINT AS k FROM z),
x AS (SELECT *, unnest(range(0, least(k, 200))) AS win FROM w)
SELECT doc_id, win::INT AS win, (win * (size - 200))::INT AS start, size::INT AS size, n > 2000 AND (k > 200 OR n > 4000000) AS truncated, md5(substr(text, win * (size - 200) + 1, least(size, least(n, 4000000) - win * (size - 200)))) AS digest FROM x"""
)
def text_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = chunking.windows(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return w.select("doc_id", F.col("window").alias("win"), "start", "size", "truncated", F.md5(F.col("content").cast("binary")).alias("digest"))


def _heading(c: str) -> str:
    """F4 in SQL."""
    flat = f"trim(regexp_replace(regexp_replace({c}, '^#+', ''), '\\s+', ' ', 'g'))"
    return f"CASE WHEN len({flat}) > 60 THEN substr({flat}, 1, 59) || '…' ELSE {flat} END"


def _crumb(clause: str, caption: str, budget: int) -> str:
    """F6 in SQL."""
    line = f"'[' || concat_ws(' · ', nullif(title, ''), nullif({clause}, ''), nullif({caption}, '')) || ']'"
    return f"CASE WHEN {line} = '[]' OR {budget} < 4 THEN '' WHEN len({line}) <= {budget} THEN {line} ELSE substr({line}, 1, {max(budget - 2, 1)}) || '…]' END"


def _chunk_sql(size: int = 800, overlap: int = 100) -> str:
    """Common tables from doc (source_path, content, title) to chunk (source_path, chunk_index, content).

    ``packed`` goes from line to line of all texts at once and says in which block a line lies (F7, F8); ``grown`` goes
    from chunk to chunk, with the blocks of a text as lists (F5, F6, F9, N7).
    """
    budget = min(chunking.CRUMB_MOST, size // 3)
    cap = max(size - budget, 1)
    table_of = "CASE WHEN starts_with(l[1], '|') AND regexp_full_match(trim(l[2]), '\\|[\\s:|-]+\\|') THEN l[1] || chr(10) || trim(l[2]) ELSE '' END"
    return f"""para AS (SELECT source_path, p, string_split(trim(part, ' ' || chr(9) || chr(10)), chr(10)) AS l FROM (SELECT source_path, unnest(z) AS part, unnest(range(len(z))) AS p FROM (SELECT source_path, string_split_regex(content, '\\n{{2,}}') AS z FROM doc)) WHERE trim(part, ' ' || chr(9) || chr(10)) <> ''),
line AS MATERIALIZED (SELECT source_path, line, i = 0 AS opens, len(line) AS n, header, row_number() OVER (PARTITION BY source_path ORDER BY p, i) AS k FROM (SELECT source_path, p, unnest(l) AS line, unnest(range(len(l))) AS i, {table_of} AS header FROM para)),
packed(source_path, k, block, held, again) AS (SELECT source_path, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM doc
  UNION ALL SELECT source_path, k, block + CASE WHEN n > {cap} THEN (n + {cap - 1}) // {cap} WHEN h > 0 AND h + 1 + n <= {cap} THEN 0 ELSE 1 END,
    CASE WHEN n > {cap} THEN 0 WHEN h = 0 THEN n WHEN h + 1 + n <= {cap} THEN h + 1 + n WHEN header <> '' AND len(header) + 1 + n <= {cap} THEN len(header) + 1 + n ELSE n END,
    n <= {cap} AND h > 0 AND h + 1 + n > {cap} AND header <> '' AND len(header) + 1 + n <= {cap}
  FROM (SELECT l.*, q.block, CASE WHEN l.opens THEN 0 ELSE q.held END AS h FROM packed q JOIN line l ON l.source_path = q.source_path AND l.k = q.k + 1)),
piece AS (SELECT source_path, k, line, n, header, block, again FROM packed JOIN line USING (source_path, k)),
block AS (SELECT source_path, block AS b, string_agg(CASE WHEN again THEN header || chr(10) || line ELSE line END, chr(10) ORDER BY k) AS x FROM piece WHERE n <= {cap} GROUP BY ALL
  UNION ALL SELECT source_path, block - c + j + 1, substr(line, (j * {cap} + 1)::BIGINT, {cap}) FROM (SELECT *, unnest(range(c)) AS j FROM (SELECT *, (n + {cap - 1}) // {cap} AS c FROM piece WHERE n > {cap}))),
mark AS (SELECT *, {_heading("line")} AS name, regexp_matches(line, '^(?i:表|图|Table|Figure)\\s*[0-9]+') AS caption FROM (SELECT source_path, b, trim(unnest(z)) AS line, unnest(range(len(z))) AS i FROM (SELECT source_path, b, string_split(x, chr(10)) AS z FROM block))),
sect AS (SELECT *, NOT caption AND len(line) <= {chunking.SECTION_MOST} AND regexp_matches(line, '^(#{{1,6}}\\s+\\S|[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{0,3}}[.、]?\\s+\\S)') AS section FROM mark),
trail AS (SELECT source_path, b, max(CASE WHEN section THEN i END) AS s, max(CASE WHEN caption THEN i END) AS c, arg_max(name, i) FILTER (section) AS clause, arg_max(name, i) FILTER (caption) AS named FROM sect GROUP BY ALL),
lists AS MATERIALIZED (SELECT source_path, list(x ORDER BY b) AS x, list(len(x) ORDER BY b) AS n, list(clause ORDER BY b) AS s, list(CASE WHEN c > coalesce(s, -1) THEN named WHEN s IS NOT NULL THEN '' END ORDER BY b) AS c FROM block JOIN trail USING (source_path, b) GROUP BY ALL),
known AS MATERIALIZED (SELECT source_path, {_heading("title")} AS title, x, s, c, len(x) AS total, list_transform(range(len(x) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT) AS upto FROM lists JOIN doc USING (source_path)),
grown(source_path, chunk_index, first, next, clause, caption, stop, label) AS (SELECT source_path, -1, 0::BIGINT, 0::BIGINT, '', '', 0::BIGINT, '' FROM known
  UNION ALL SELECT source_path, chunk_index + 1, next, CASE WHEN stop = total THEN total ELSE greatest(next + 1, list_filter(range(stop + 1), lambda j: upto[stop + 1] - upto[j + 1] <= {overlap})[1]) END,
    coalesce(list_filter(s[next + 1:stop], lambda x: x IS NOT NULL)[-1], clause), coalesce(list_filter(c[next + 1:stop], lambda x: x IS NOT NULL)[-1], caption), stop, label
  FROM (SELECT *, next + 1 + len(list_filter(range(next + 2, total + 1), lambda e: upto[e + 1] - upto[next + 1] + 2 * (e - next - 1) <= greatest({size} - len(label), 1))) AS stop
    FROM (SELECT *, {_crumb("clause", "caption", budget)} AS label FROM (SELECT g.source_path, g.chunk_index, g.next, coalesce(k.s[g.next + 1], g.clause) AS clause, coalesce(k.c[g.next + 1], g.caption) AS caption, k.title, k.s, k.c, k.total, k.upto FROM grown g JOIN known k ON k.source_path = g.source_path AND g.next < k.total)))),
chunk AS (SELECT source_path, chunk_index, CASE WHEN label = '' THEN '' ELSE label || chr(10) END || array_to_string(x[first + 1:stop], chr(10) || chr(10)) AS content FROM grown JOIN known USING (source_path) WHERE chunk_index >= 0)"""


#: A document's text by its file's name as a title, in SQL.
_DOC = f"{SRC}, doc AS (SELECT source_path, coalesce(content, '') AS content, doc_id::VARCHAR AS title FROM src)"
#: What gives a plain text structure: sentences become lines, and some lines headings, clauses, captions, tables and ends of paragraphs.
_SHAPES = [(r"\. ", ".\n"), (r"\n([A-D])", "\n\n@1"), (r"\n(E[^\n]{0,38})", "\n## @1\n"), (r"\n(S[^\n]{0,30})", "\n3.1 @1\n"), (r"\n(I[^\n]{0,30})", "\n\nTable 7 @1\n"), (r"\n([L-N][^\n,]*),([^\n]*)", "\n\n| @1 | x |\n|---|:-:|\n|@2 |")]


def _shaped_sql(c: str) -> str:
    for pattern, by in _SHAPES:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')".replace("@", "\\").replace("\n", "' || chr(10) || '")
    return c


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = src(spark, sf)
    return chunking.chunks(d.select("source_path", "content", text.title_of(F.col("source_path")).alias("title")))


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_path", "chunk_index", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


_DIGESTS = "SELECT source_path, chunk_index, len(content) AS n_chars, md5(content) AS digest FROM chunk"


@query(f"WITH RECURSIVE {_DOC}, {_chunk_sql()} {_DIGESTS}")
def chunk_structural(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(_chunks(spark, sf))


@query(f"WITH RECURSIVE {_DOC}, {_chunk_sql()} SELECT source_path, count(*) AS n, max(chunk_index) AS last FROM chunk GROUP BY ALL")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("source_path").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))


@query(f"WITH RECURSIVE {SRC}, doc AS (SELECT source_path, {_shaped_sql('coalesce(content, ' + repr('') + ')')} AS content, doc_id::VARCHAR AS title FROM src), {_chunk_sql(300, 80)} {_DIGESTS}")
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with paragraphs, headings, clauses, captions and tables put into its text, in small chunks that overlap."""
    content = F.coalesce("content", F.lit(""))
    for pattern, by in _SHAPES:
        content = F.regexp_replace(content, pattern, by.replace("@", "$"))
    return _digests(chunking.chunks(src(spark, sf).select("source_path", content.alias("content"), text.title_of(F.col("source_path")).alias("title")), 300, 80))


@query(f"WITH {SRC} SELECT doc_id, substr(sha256(source_path), 1, 12) || '_' || (doc_id % 3) AS chunk_uid FROM src")
def chunk_uid(spark: SparkSession, sf: str) -> DataFrame:
    return src(spark, sf).select("doc_id", text.uid(F.col("source_path"), F.col("doc_id") % 3).alias("chunk_uid"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    d = src(spark, sf)
    pairs = [("title", F.concat(F.lit("Doc: "), F.col("doc_id").cast("string"))), ("type", F.col("lang")), ("source", F.col("source_path"))]
    return d.select("doc_id", text.rendered(pairs, F.concat(F.lit("\n# "), F.col("uid"), F.lit("\n\n"), F.col("content"), F.lit("\n"))).alias("page"))


_PAGE = """pg AS (SELECT doc_id, '---' || chr(10) || 'title: "Doc: ' || doc_id || '"' || chr(10) || 'type: ' || lang || chr(10) || 'source: ' || source_path || chr(10) || '---' || chr(10) || chr(10) || '# ' || uid || chr(10) || chr(10) || content || chr(10) AS page FROM src)"""


@query(f"WITH {SRC}, {_PAGE} SELECT doc_id, md5(page) AS digest, len(page)::BIGINT AS n FROM pg")
def render_page(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("doc_id", F.md5(F.col("page").cast("binary")).alias("digest"), F.length("page").cast("long").alias("n"))


@query(f"WITH {SRC} SELECT doc_id, 'Doc: ' || doc_id AS title, lang AS type, source_path AS source, md5(chr(10) || '# ' || uid || chr(10) || chr(10) || content || chr(10)) AS body FROM src")
def frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    m = text.frontmatter(F.col("page"))
    return _pages(spark, sf).select("doc_id", m["title"].alias("title"), m["type"].alias("type"), m["source"].alias("source"), F.md5(text.body(F.col("page")).cast("binary")).alias("body"))


@query(r"SELECT page_id, md5(html) AS html_digest FROM pages WHERE html LIKE '%</p>%'")
def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.col("html").contains("</p>")).select("page_id", F.md5(F.col("html").cast("binary")).alias("html_digest"))


@query()
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    t = text.html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query(f"WITH {VEC} SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS magnitude, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, round(e[64] / sqrt(list_inner_product(e, e)), 6) AS last FROM vec")
def vec_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.doubles(F.col("embedding"))
    n = vectors.normalized(v)
    return vec(spark, sf).select("vec_id", _r(vectors.magnitude(v)).alias("magnitude"), _r(F.element_at(n, 1)).alias("first"), _r(F.element_at(n, 64)).alias("last"))
