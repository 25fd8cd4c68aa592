"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark are hashed into a set of bits, whose size follows their
number within bounds; it goes to every task as the value of a scalar subquery.  Every
window of every document is tested against it where the text is.  What passes, hits
and a few false ones, is joined with the windows by their words, and what each document has of the
benchmark is summed up.  The plan is the same for every size of benchmark.  DataFrame
functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common

WIDTH = 13
#: Bits of the set for each n-gram, and its least and largest size as powers of two: 128 KB and 16 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 27
#: Windows that are sent to every task to verify hits, some 32 MB; more are joined by a shuffle of what passed the set.
BROADCAST_WINDOWS = 1 << 17
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """What stands between breaks: splitting takes a tenth of the time that extracting the words does."""
    return F.array_remove(F.split(F.coalesce(folded(text), F.lit("")), BREAKS), "")


def benchmark_windows(items: DataFrame, width: int = WIDTH, key: str = "item_id", text: str = "text") -> DataFrame:
    """(h, size, window, item_id), distinct; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0").withColumn("size", F.least(F.lit(width), F.size("w")))
    return (
        w.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
        .select("item_id", "size", F.slice("w", F.col("i"), F.col("size")).alias("x"))
        .select(F.xxhash64("x").alias("h"), "size", F.array_join("x", " ").alias("window"), "item_id")
        .distinct()
    )


def _mask(h: Column) -> Column:
    """Two of 64 bits, named by the lowest bits of a hash."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int")) for x in (h, F.shiftright(h, 6))]
    return bits[0].bitwiseOR(bits[1])


def gram_set(grams: DataFrame, bits: int) -> DataFrame:
    """One row: the set as an array of longs; an n-gram has two bits of the one that the highest bits of its hash name."""
    longs = grams.select(F.shiftrightunsigned("h", 70 - bits).alias("id"), _mask(F.col("h")).alias("v")).groupBy("id").agg(F.bit_or("v").alias("v"))
    dense = grams.sparkSession.range(1 << (bits - 6)).join(longs, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("x")).select(F.transform("x", lambda x: x["v"]).alias("bits"))


def _scanned(text: Column, sizes: list[int], held: Column, bits: int) -> Column:
    """(n_words, hits) of a text: its windows that pass the set, as (start, size, window).

    The words are the one element of an array that a lambda walks over: so they are worked
    out once, and the set, named once, stays a part of the expression instead of a column
    that every row would carry.
    """

    def passes(h: Column) -> Column:
        return F.get(held, F.shiftrightunsigned(h, 70 - bits).cast("int")).bitwiseAND(_mask(h)) == _mask(h)

    def windows(w: Column, n: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)))
        passing = F.array_compact(F.transform(hashes, lambda h, i: F.when(passes(h), i + 1)))
        return F.transform(passing, lambda i: F.struct(i.alias("start"), n.alias("size"), F.array_join(F.slice(w, i, n), " ").alias("window")))

    each = F.array(*map(F.lit, sizes)).cast("array<int>")
    return F.get(F.transform(F.array(words_of(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.flatten(F.transform(each, lambda n: windows(w, n))).alias("hits"))), 0)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, one_in: int = ONE_IN, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, spans, places, t, contaminated), one row for each row of docs.

    places are the numbers of the hit words from 0, sorted, and spans their runs as
    pieces [start, end).  A null text has no words and no hits; items with a null or wordless text have no
    window, a null item_id counts as none; an empty benchmark hits nothing.  Repeated
    rows get a row each, repeated items count once by their id.  Other columns are not read.
    """
    known = common.settled(benchmark_windows(items, width).where("item_id is not null"))
    # windows of the same items are one class, so that a window of many items is not multiplied by its hits
    of = known.groupBy("h", "size", "window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    of = common.settled(of.withColumn("class", F.sha2(F.to_json("items"), 256)))
    classes = of.select("class", "items").dropDuplicates(["class"])
    sizes = sorted(r["size"] for r in of.select("size").distinct().collect())  # at most ``width`` numbers
    n = of.count()
    bits = min(most_bits, max(LEAST_BITS, (BITS_EACH * max(1, n) - 1).bit_length()))
    held = common.settled(gram_set(of, bits))
    held.createOrReplaceTempView(view := "gram_set_" + uuid.uuid4().hex)
    base = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), F.expr(f"(select bits from {view})").alias("held"))
    scanned = _scanned(F.col("text"), sizes, F.col("held"), bits).alias("x")
    seen = common.settled(base.select("doc_id", F.xxhash64("text").alias("t"), scanned).select("doc_id", "t", "x.n_words", "x.hits"))
    docs.sparkSession.catalog.dropTempView(view)
    # one row for rows that repeat id and text; all that follows stays with the document
    hits = seen.where("size(hits) > 0").groupBy("doc_id", "t").agg(F.first("hits").alias("hits")).select("doc_id", "t", F.explode("hits").alias("x")).select("doc_id", "t", "x.*")
    windows = of.select("size", "window", "class")
    windows = F.broadcast(windows) if n <= broadcast_windows else windows
    found = common.settled(hits.join(windows, ["size", "window"]).select("doc_id", "t", "start", "size", "class"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start") - 1, F.col("start") + F.col("size") - 2)))))
    where = found.groupBy("doc_id", "t").agg(covered.alias("places"))
    of_items = found.select("doc_id", "t", "class").distinct().join(classes, "class").groupBy("doc_id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_doc = where.alias("x").join(of_items.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.t = y.t")).select("x.*", "y.items")
    out = seen.alias("a").join(per_doc.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.t <=> b.t"), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("a.doc_id", "n_words", F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce("places", F.array().cast("array<int>")).alias("places"), "a.t")
    first = F.filter("places", lambda x, i: F.coalesce(F.get("places", i - 1) != x - 1, F.lit(True)))
    last = F.filter("places", lambda x, i: F.coalesce(F.get("places", i + 1) != x + 1, F.lit(True)))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    out = out.withColumns({"n_hit": F.size("places").cast("long"), "spans": spans})
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "places", "t", ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that are not contaminated.

    Rows with a null or wordless text stay, as do all rows where the benchmark is empty;
    rows that repeat an id are judged by their own texts.
    """
    bad = contamination(docs, items, **kw).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("t").alias("__t")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of docs, each text as its normalised words without those that are hit (texts without hits, null ones too, are unchanged)."""
    found = contamination(docs, items, **kw).where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("places").alias("__places")).dropDuplicates(["__d", "__t"])
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left").withColumn("__w", F.when(F.col("__places").isNotNull(), words_of(F.col("text"))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__w") - 1), "__places"), lambda i: F.get("__w", i))
    return joined.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).drop("__d", "__t", "__places", "__w")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bn AS (SELECT item_id, w, least({WIDTH}, len(w))::BIGINT AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM bi),
z AS (SELECT DISTINCT n FROM g),
di AS (SELECT r, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, z WHERE len(w) >= z.n),
dx AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM di),
h AS (SELECT dx.r, dx.i, dx.n, g.item_id FROM dx JOIN g ON dx.n = g.n AND dx.x = g.x),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""
