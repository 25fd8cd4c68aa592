"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Addresses, numbers and phones that the fixed patterns accept are seeds.  The words to
the left of a string are a lexical pattern (the last two words, or the last one if it is
a label such as ``mail:``).  Patterns and the strings that they introduce form a
bipartite graph.  In each round, patterns with enough believed strings are induced from it; a
pattern's confidence is the share of its distinct strings that are believed; a string's
belief is the chance that one of its patterns is right.  Strings that are believed in one
round induce patterns of their own in the next.  All this is Spark joins and sums; what a pattern of high
confidence introduces is personal data too.  DataFrame functions only.

Positions come from splitting a text at the matches of a pattern: the pieces between
and the matches themselves, summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions, with possessive repeats and anchored starts, which match the same in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that a context may reveal: words of six characters or more with a digit or an at sign, spelled out or not.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:[0-9@]|[\[(]at[\])]))[^\x20\x09-\x0D]{6,}"
#: Characters to the left of a match that its context is read from.
TAIL = 80
SEEDS, CONFIDENCE, ROUNDS = 3, 0.7, 3
SPACE = r"[\x20\x09-\x0D]+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1))
    return F.pmod(F.aggregate(at, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)), F.lit(10)) == 0


def _accepted(kind: Column, x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    n = F.length(digits)
    part_ok = F.forall(F.split(x, r"\."), lambda p: F.coalesce((F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255), F.lit(False)))
    return F.when(kind == "email", True).when(kind == "ip", part_ok).when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False)).when(kind == "phone", n.between(8, 15)).otherwise(False)


def _context(piece: Column) -> Column:
    """The lexical pattern at the end of what stands to the left of a match; null if there are too few words."""
    w = F.filter(F.split(F.lower(F.right(piece, F.lit(TAIL))), SPACE), lambda x: x != "")
    last = F.element_at(w, -1)
    return F.when((F.size(w) >= 1) & last.rlike(r"^[^\x20]{2,}[:=]$"), last).when(F.size(w) >= 2, F.concat_ws(" ", F.element_at(w, -2), last))


def _matches(kind: str, text: Column) -> Column:
    """All matches of a pattern, accepted or not, with the length of the piece before each and their context."""
    pattern = PATTERNS.get(kind, CANDIDATE)
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9]")}.get(kind, text.rlike(r"[0-9@]|[\[(]at[\])]"))
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
        lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("before"), m.alias("x"), _context(p).alias("ctx")),
    )
    none = F.array().cast("array<struct<kind:string,before:int,x:string,ctx:string>>")
    return F.when(may, F.filter(pairs, lambda r: r["x"].isNotNull())).otherwise(none)


def found(docs: DataFrame) -> DataFrame:
    """(r, doc_id, t, base, candidates): for each row, t being the hash of its text, the accepted spans and, apart from them, the strings that a context may reveal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", F.xxhash64("text").alias("t"), F.concat(*[_matches(k, text) for k in (*KINDS, "other")]).alias("m"))
    flat = rows.select("r", "doc_id", "t", F.posexplode_outer("m").alias("i", "m")).select("r", "doc_id", "t", "i", "m.*")
    end = F.sum(F.col("before") + F.length("x")).over(Window.partitionBy("r", "kind").orderBy("i"))
    flat = flat.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("x"))
    # a string of another kind without the punctuation around it
    lead, trail = F.length(F.regexp_extract("x", r"^[^A-Za-z0-9+(]*", 0)), F.length(F.regexp_extract("x", r"[^A-Za-z0-9]*$", 0))
    other = F.col("kind") == "other"
    flat = flat.withColumn("cut", F.when(other, F.greatest(F.length("x") - lead - trail, F.lit(0))))
    flat = flat.select("r", "doc_id", "t", "kind", (F.col("start") + F.when(other, lead).otherwise(0)).alias("start"), F.when(other, F.col("start") + lead + F.col("cut")).otherwise(F.col("end")).alias("end"), F.lower(F.when(other, F.expr("substring(x, length(regexp_extract(x, '^[^A-Za-z0-9+(]*', 0)) + 1, cut)")).otherwise(F.col("x"))).alias("x"), "ctx", _accepted(F.col("kind"), F.col("x")).alias("ok"))
    span = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("k"), "start", "end", "kind", "x", "ctx")
    per_doc = flat.groupBy("r", "doc_id", "t").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("base"), F.array_sort(F.collect_list(F.when((F.col("kind") == "other") & (F.length("x") >= 6), span))).alias("other"))
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return per_doc.select("r", "doc_id", "t", "base", free.alias("candidates"))


def _fits(kind: str, x: Column) -> Column:
    """Whether a string can be of a kind at all."""
    return x.rlike(r"@|[\[(]at[\])]") if kind == "email" else F.length(F.regexp_replace(x, "[^0-9]", "")) >= 6


def patterns(spans: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(kind, ctx): the lexical patterns of high confidence, from found().

    A pattern needs ``seeds`` distinct strings that are believed by ``confidence``; those
    of fewer strings of any kind are left out at once, as they can never have them.
    """
    known = spans.select(F.explode("base").alias("s")).select("s.kind", "s.ctx", "s.x").where("ctx is not null").distinct()
    kinds = F.filter(F.array(*[F.when(_fits(k, F.col("c.x")), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    may = spans.select(F.explode("candidates").alias("c")).where("c.ctx is not null").select(F.explode(kinds).alias("kind"), F.col("c.ctx").alias("ctx"), F.col("c.x").alias("x")).distinct()
    edges = known.withColumn("seed", F.lit(1.0)).unionByName(may.withColumn("seed", F.lit(0.0)))
    edges = edges.groupBy("kind", "ctx", "x").agg(F.max("seed").alias("seed"))
    large = edges.groupBy("kind", "ctx").agg(F.count("*").alias("n")).where(F.col("n") >= seeds).select("kind", "ctx")
    edges = common.settled(edges.join(large, ["kind", "ctx"]))
    belief = edges.groupBy("kind", "x").agg(F.max("seed").alias("s"))
    for _ in range(rounds):
        induced = F.count(F.when(F.col("s") >= confidence, 1))
        score = edges.join(belief, ["kind", "x"]).groupBy("kind", "ctx").agg((F.sum("s") / (F.count("*") + 1)).alias("p"), induced.alias("n")).where(F.col("n") >= seeds)
        score = common.settled(score.select("kind", "ctx", "p"))
        doubt = F.sum(F.log(1 - F.least(F.coalesce("p", F.lit(0.0)), F.lit(0.999))))
        belief = common.settled(edges.join(score, ["kind", "ctx"], "left").groupBy("kind", "x").agg(F.greatest(F.max("seed"), 1 - F.exp(doubt)).alias("s")))
    return score.where(F.col("p") >= confidence).select("kind", "ctx")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(r, doc_id, t, base, added), one row for each row of docs; spans are (k, start, end, kind), in code points, end exclusive.

    A null text is empty and has no spans.  Repeated rows, and rows that repeat an id,
    get a row each with their own spans; a string counts once for a pattern however
    often it is repeated.  Added spans never touch accepted ones.  r numbers the rows,
    t is the xxhash64 of the text.
    Other columns are not read.
    """
    spans = common.settled(found(docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))))
    trusted = patterns(spans)
    kinds = F.filter(F.array(*[F.when(_fits(k, F.col("c.x")), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    places = spans.select("r", F.explode("candidates").alias("c")).where("c.ctx is not null").select("r", "c.start", "c.end", F.col("c.ctx").alias("ctx"), F.explode(kinds).alias("kind"))
    added = places.join(trusted, ["kind", "ctx"]).groupBy("r", "start", "end").agg(F.min(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")).alias("k"))
    added = added.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("k")).alias("kind")))).alias("added"))
    slim = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint,kind:string>>")
    return spans.select("r", "doc_id", "t", slim.alias("base")).join(added, "r", "left").select("r", "doc_id", "t", "base", F.coalesce("added", none).alias("added"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with each span of a text replaced by its kind, as in ``[EMAIL]``.

    Of spans that overlap, the one that starts first stands, the longer one if they
    start together, and it is drawn out to the end of the others.  Columns other than text stay; ``n_chars`` follows the text.
    Null, empty and spanless texts stay as they are; rows that repeat an id keep their own texts.
    """
    found_in = personal_data(docs.select("doc_id", "text")).where("size(base) + size(added) > 0").dropDuplicates(["doc_id", "t"])
    each = found_in.select("doc_id", "t", F.explode(F.concat("base", "added")).alias("s")).select("doc_id", "t", "s.start", "s.end", "s.kind")
    # runs of spans that overlap, the first one's kind for each
    w = Window.partitionBy("doc_id", "t").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(F.col("start") >= F.coalesce(before, F.lit(0)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    runs = each.groupBy("doc_id", "t", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    spans = runs.groupBy(F.col("doc_id").alias("__d"), F.col("t").alias("__t")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left")
    # what stands before each span, and its kind; then the rest
    end_before = lambda i: F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))
    pieces = F.transform("__spans", lambda s, i: F.concat(F.substring("text", (end_before(i) + 1).cast("int"), (s["start"] - end_before(i)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    whole = F.concat(F.array_join(pieces, ""), F.expr("substring(text, cast(element_at(__spans, -1).end + 1 as int))"))
    out = rows.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(whole)).drop("__d", "__t", "__spans")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(common.table(spark, sf_dir, "documents"))
    counts = [_count(i + 1).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
