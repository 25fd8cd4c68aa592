"""Numeric requirements, standard numbers and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words that bound a number, longest first, and those that bound it from below.
BOUND_WORDS = (
    "不得大于", "不得高于", "不得小于", "不得低于", "不应大于", "不应低于", "应不大于", "应不小于", "不得超过",
    "大于等于", "小于等于", "不大于", "不小于", "不超过", "不低于", "不少于",
    "最高", "最大", "上限", "最低", "最小", "下限", "至少", "≤", "≥",
)
LOWER_WORDS = (
    "不得小于", "不得低于", "不应低于", "应不小于",
    "不小于", "不低于", "大于等于", "不少于", "至少", "最低", "最小", "下限", "≥",
)
STOP = r"\s　，。；、（）()：:"
BOUND = rf"({'|'.join(BOUND_WORDS)})[\s　]*([0-9]+(?:\.[0-9]+)?)[\s　]*([^{STOP}]{{0,6}})"
STANDARD = r"(?i)(GB/T|GBZ|GB|JGJ|JTG|CJJ|DL/T|SH/T|QB/T|YB/T|HG/T|T/[A-Z]{2,})[\s/]*[0-9]+(?:[.-][0-9A-Za-z]+)*"
MARKER = "> ⚠️ **潜在冲突**"
PER_FILE = 200
#: Parts that the existing rows of one name and unit are dealt into.
SLOTS = 32
#: How long a name may be, and how many texts one task takes apart.
NAME_MOST, PER_PART = 20, 1024
#: What a pattern of Java's tells fast: words by their first characters (none begins another one, so their order says nothing) and STOP in ranges.
_FIRST = {w[0]: [v[1:] for v in BOUND_WORDS if v[0] == w[0]] for w in BOUND_WORDS}
_QUICK = rf"(?:{'|'.join(f'{c}(?:{chr(124).join(rest)})' if rest != [''] else c for c, rest in _FIRST.items())})[\s　]*[0-9]+(?:\.[0-9]+)?[\s　]*[^\t\n\x0B\f\r ():　-。（-），：-；]{{0,6}}"
_STOPS = " \t\n\x0b\f\r　，。；、（）()：:"


def standard_no(text: Column) -> Column:
    """F31."""
    return F.regexp_replace(F.regexp_extract(text, STANDARD, 0), r"\s+", "")


def indicators(docs: DataFrame) -> DataFrame:
    """one row for each first (name, value, unit) of a source, in text order, at most 200 a source.

    docs has (source_path, content, standard_no).  The texts are dealt by source before
    they are taken apart, into so many parts that the rows of one are some ten megabytes
    to sort, so what is found in them is not shuffled again.
    """
    dealt = docs.select("source_path", "standard_no", "content").repartition(docs.count() // PER_PART + 1, "source_path")
    # outer, as Spark works out the array of a plain one twice, to see whether it is empty
    rows = dealt.select("source_path", "standard_no", F.posexplode_outer(F.split("content", "\n")).alias("line_no", "line"))
    met = rows.select("source_path", "standard_no", "line_no", "line", F.regexp_extract_all("line", F.lit(_QUICK), F.lit(0)).alias("whole"))
    found = met.select("source_path", "standard_no", "line_no", "line", F.posexplode_outer(F.arrays_zip("whole", _starts().alias("start"))).alias("i", "m")).where("m is not null")
    # words of bounds hold no digits and no blanks; a name abuts its bound: it ends what stands before it in the line
    word, number, raw = F.regexp_extract("m.whole", r"^[^\s　0-9]+", 0), r"[0-9]+(?:\.[0-9]+)?", "m.whole"
    before = F.substring(F.col("line"), F.greatest(F.col("m.start") - NAME_MOST, F.lit(1)), F.least(F.col("m.start") - 1, F.lit(NAME_MOST)))
    run = F.substring_index(F.translate(before, _STOPS, " " * len(_STOPS)), " ", -1)
    name = F.when(F.length(run) < 2, "").otherwise(F.trim(F.regexp_replace(run, "^[的是应为须需符合]+", "")))
    out = found.select(
        "source_path",
        "standard_no",
        "line_no",
        "i",
        F.regexp_extract("line", r"([0-9]+(?:\.[0-9]+)*)\s", 1).alias("clause_no"),
        name.alias("indicator_name"),
        F.regexp_extract(raw, number, 0).cast("double").alias("value"),
        F.regexp_replace(F.regexp_replace(raw, rf"^[^0-9]+{number}[\s　]*", ""), r"[^\w%/·℃°³²µμ]", "").alias("unit"),
        F.when(word.isin(*LOWER_WORDS), "lower").otherwise("upper").alias("direction"),
        F.substring(F.trim("line"), 1, 120).alias("condition"),
        F.when(F.contains("line", F.lit("宜")) | F.contains("line", F.lit("推荐")), "推荐").otherwise("强制").alias("level"),
    ).where("indicator_name <> ''")
    first = out.withColumn("k", F.row_number().over(Window.partitionBy("source_path", "indicator_name", "value", "unit").orderBy("line_no", "i"))).where("k = 1")
    order = F.row_number().over(Window.partitionBy("source_path").orderBy("line_no", "i"))
    return first.withColumn("ordinal", order).where(F.col("ordinal") <= PER_FILE).drop("k", "line_no", "i")


def _starts() -> Column:
    """Where in ``line`` the matches ``whole`` begin: each is the first of its text behind the one before it, or the pattern would have met that sooner."""

    def add(acc, m):
        at = F.call_function("locate", m, F.col("line"), acc["next"])
        return F.struct((at + F.length(m)).alias("next"), F.concat(acc["all"], F.array(at)).alias("all"))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("all"))
    return F.aggregate("whole", start, add)["all"]


def classified(direction_a: Column, direction_b: Column, a: Column, b: Column) -> Column:
    """F37."""
    stricter = F.when(direction_a == "lower", a > b).otherwise(a < b)
    return F.when(direction_a != direction_b, "方向不同").when(a == b, "相同").when(stricter, "A更严格").otherwise("B更严格")


def numeric_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of indicators with one name and unit; an equi-join, partitioned by both and by a slot.

    There are as many rows as pairs, which grow with the square of a name's and unit's
    rows, so their number, not the input's size, must say how the work is dealt:
    existing rows go to SLOTS parts of their group, incoming ones to each, and the
    parts to as many tasks as the session's shuffles have, which are not put together.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    by, tasks = ["indicator_name", "unit", "slot"], int(existing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows, slot: rows.where(finite("value")).withColumn("slot", slot).repartition(tasks, *by)
    a = dealt(incoming, F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).alias("a")
    b = dealt(existing, F.pmod(F.xxhash64(*existing.columns), F.lit(SLOTS)).cast("int")).alias("b")
    joined = a.join(b, (F.col("a.indicator_name") == F.col("b.indicator_name")) & (F.col("a.unit") == F.col("b.unit")) & (F.col("a.slot") == F.col("b.slot")))
    side = lambda s: F.struct(F.col(f"{s}.standard_no").alias("no"), F.col(f"{s}.clause_no").alias("clause"), F.col(f"{s}.value").alias("value"), F.col(f"{s}.unit").alias("unit"))
    return joined.select(F.col("a.indicator_name").alias("indicator_name"), side("a").alias("standard_a"), side("b").alias("standard_b"), classified(F.col("a.direction"), F.col("b.direction"), F.col("a.value"), F.col("b.value")).alias("type"))


def conflict_blocks(pages: DataFrame) -> DataFrame:
    """(path, n, blocks) of the pages that carry the conflict marker."""
    found = F.regexp_extract_all("content", F.lit(r"(> ⚠️ \*\*潜在冲突\*\*[\s\S]*?(?=\n[^>]|$))"), F.lit(1))
    return pages.where(F.col("content").contains(MARKER)).select("path", F.transform(found, lambda x: F.trim(x)).alias("blocks")).select("path", F.size("blocks").cast("long").alias("n"), "blocks")
