"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies.  The documents of a source
are put in an order; their expected copies are summed up along it, one random offset
per source is added, and a document is emitted once for each whole number that its
part of the sum crosses.  The order runs through the sizes, so that the mix takes
short and long documents alike and the words taken stay near the target.

No group is ordered by one task: documents are ranked inside cells (source, class of
size, salt), and the counts of the cells, a table of bounded length per source, are
summed up to give each cell its first rank.  Rows that agree in id, source and size are
counted first and are one row of a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import common

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
#: Cells of one source and one class of size; a class is a step of 4 * size ** 0.25.
SALTS = 128


def unit(text: Column) -> Column:
    """A number in [0, 1) from a text, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go by code point of the source, null last, and repeat.  Targets share the
    sum of all sizes by weight; those above most times their source stop there, and
    what they leave is shared again by weight.  The sources that stop are the first ones by most * size /
    weight, so running sums in that order give the level of the others at once, from
    whole numbers and one division.  A source without words has target 0.  The table
    has a row for each source, which one task sorts; documents are never sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))))
    by_ratio = Window.orderBy("k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("w_rest", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("stops", most * F.col("source_size") * F.col("w_rest") <= F.col("w") * F.col("rest"))
    )
    # the first source that does not stop sets the level of all after it
    first = F.min(F.when(~F.col("stops"), F.struct("k", "rest", "w_rest"))).over(Window.partitionBy())
    return level.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), (most * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("first.rest")).cast("double") / F.col("first.w_rest")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken), one row for each row of docs.

    A null text has size 0.  A null source is a source of its own.  Repeated rows are
    documents of their own; rows that agree in key, source and size are alike, so
    which of them gets a copy makes no difference to the result.  An empty table
    gives no rows.  Other columns are not read.
    """
    h = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    # alike rows follow each other in the order, so a key that repeats is one row until the end
    alike = docs.select(docs[key].alias("id"), docs[source].alias("source"), docs[text].alias("text")).select("id", "source", size.alias("size")).groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    sized = common.settled(alike.withColumn("class", F.floor(F.sqrt(F.sqrt("size")) * 4).cast("int")).withColumn("salt", F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(SALTS))))
    cells = sized.groupBy("source", "class", "salt").agg(F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("s"))
    share = targets(cells.groupBy("source").agg(F.sum("s").alias("source_size")), weights, most)
    first = cells.withColumn("first", F.sum("n").over(Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.alias("a").join(share.alias("b"), F.expr("a.source <=> b.source")).select(F.col("a.source").alias("source"), "class", "salt", F.coalesce("first", F.lit(0)).alias("first"), "source_size", "target")
    cell = Window.partitionBy("source", "class", "salt").orderBy("size", h, "id")
    ranked = sized.withColumn("before", F.sum("rows").over(cell.rowsBetween(Window.unboundedPreceding, -1)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.concat(F.lit(seed + ":"), F.coalesce("a.source", F.lit(""))))
    place = F.col("first") + F.coalesce("before", F.lit(0)) + F.col("row")
    copies = (F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))).cast("long")
    return (
        ranked.alias("a")
        .join(first.alias("b"), F.expr("a.source <=> b.source and a.class = b.class and a.salt = b.salt"))
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select(F.col("a.id").alias(key), F.col("a.source").alias(source), "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def emit(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as it was taken, with its number ``copy`` from 1.

    mixed has a row for each row of docs.  Rows that agree in key, source and size share
    their copies evenly, in the order of their texts.  A null key or source is a value
    like others, a null text has size 0 and is taken where its size is; an empty table
    gives no rows.  Where docs has a column ``copy`` the number's name has underscores after it.
    """
    number = "copy"
    while number in docs.columns:
        number += "_"
    text_size = F.coalesce(F.regexp_count(F.col("text"), F.lit(common.WORD)), F.lit(0)).cast("long")
    same = mixed.groupBy(key, source, "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    left, right = docs.withColumn("__size", text_size).alias("a"), same.alias("b")
    on = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")) & (F.col("a.__size") == F.col("b.size"))
    joined = left.join(right, on).select(*[F.col(f"a.`{c}`") for c in docs.columns], F.col("a.__size"), F.col("b.copies").alias("__copies"), F.col("b.rows").alias("__rows"))
    once = joined.where("__rows = 1").withColumn("__n", F.col("__copies"))
    at = F.row_number().over(Window.partitionBy(key, source, "__size").orderBy("text"))
    share = lambda n: F.floor(n * F.col("__copies") / F.col("__rows"))
    more = joined.where("__rows > 1").withColumn("__n", share(at) - share(at - 1))
    return once.unionByName(more).where("__n > 0").withColumn(number, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__size", "__copies", "__rows", "__n")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{', '.join(map(str, WEIGHTS))}], (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT)::BIGINT AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {MOST})::BIGINT AS rest,
  (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_rest FROM r),
f AS (SELECT rest, w_rest, k FROM l WHERE NOT ({MOST} * source_size * w_rest <= w * rest) ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN f.k IS NULL OR l.k < f.k THEN ({MOST} * source_size)::DOUBLE ELSE (l.w * f.rest)::DOUBLE / f.w_rest END AS target FROM l LEFT JOIN f ON true),
h AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM d),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(sqrt(size)) * 4), ('0x' || substr(h, 1, 4))::INT % {SALTS}, size, h, doc_id) AS place FROM h),
r2 AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, ('0x' || substr(md5('{SEED}:' || coalesce(p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, source, size, source_size, target, (floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT AS copies FROM r2)
SELECT *, copies * size AS taken FROM c
"""
