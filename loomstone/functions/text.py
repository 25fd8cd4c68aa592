"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming removes (in a pattern, and its characters), and the control characters that normalising drops.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """one kind of line end, no control characters, no blanks at line ends, at most one empty line, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, CONTROL, "")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trim_all(c)


def excerpt(c: Column, most: int) -> Column:
    """the text, or its first most - 1 characters without blanks at their end and an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, most - 1), f"[{JS_SPACE}]+$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def one_line(c: Column, most: int) -> Column:
    """white space flattened, capped."""
    return F.substring(trim_all(F.regexp_replace(c, f"[{JS_SPACE}]+", " ")), 1, most)


def heading(c: Column, most: int = 60) -> Column:
    """a heading line without its marks, capped with an ellipsis."""
    flat = trim_all(F.regexp_replace(F.regexp_replace(c, r"^#+", ""), f"[{JS_SPACE}]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


FRONT = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?"


def frontmatter(c: Column) -> Column:
    """the map of a leading block of key: value lines; the last of equal keys wins."""
    lines = F.split(F.regexp_extract(c, FRONT, 1), r"\r?\n")
    good = F.filter(lines, lambda x: F.instr(x, ":") > 1)
    pair = F.transform(good, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), _unquoted(F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).alias("value")))
    last = F.filter(pair, lambda p, i: F.size(F.filter(F.slice(pair, i + 2, F.size(pair)), lambda q: q["key"] == p["key"])) == 0)
    return F.map_from_entries(last)


def _unquoted(c: Column) -> Column:
    return F.when(c.rlike(r'^"[\s\S]*"$') & (F.length(c) >= 2), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r'\\"', '"')).otherwise(c)


def body(c: Column) -> Column:
    """the text without its leading block."""
    return F.regexp_replace(c, FRONT, "")


def quoted(c: Column) -> Column:
    return F.when(c.rlike(r"[:#\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def rendered(pairs: list[tuple[str, Column]], text: Column) -> Column:
    """ordered pairs as a leading block, then the text."""
    lines = [F.concat(F.lit(f"{k}: "), quoted(v)) for k, v in pairs]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), text)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def title_of(key: Column) -> Column:
    """'' below wiki/, else the file's name without extension and hash suffix."""
    name = F.regexp_replace(basename(key), r"\.[^.]*$", "")
    return F.when(key.startswith("wiki/"), F.lit("")).otherwise(F.regexp_replace(name, r"_[0-9A-Fa-f]{8}$", ""))


def mirror_path(c: Column) -> Column:
    """where the page of a raw file is kept."""
    parts = F.filter(F.split(F.regexp_replace(c, "^raw/", ""), "/"), lambda x: ~x.isin("", ".", ".."))
    path = F.concat(F.lit("sources/"), F.array_join(parts, "/"))
    return F.when(F.lower(path).endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))


def index_key(path: Column, source: Column) -> Column:
    """The key of a page in the index."""
    return F.when(path.startswith("sources/") & (F.coalesce(source, F.lit("")) != ""), source).otherwise(F.concat(F.lit("wiki/"), path))


def uid(key: Column, ordinal: Column) -> Column:
    """F11."""
    return F.concat(F.substring(F.sha2(key.cast("binary"), 256), 1, 12), F.lit("_"), ordinal.cast("string"))


def occurrences(c: Column, needle: str) -> Column:
    """Occurrences that may overlap, in lower case; a needle that can't overlap itself is counted by lengths."""
    low, n = F.lower(c), needle.lower()
    if any(n[i:] == n[: len(n) - i] for i in range(1, len(n))):
        import re

        return F.regexp_count(low, F.lit(f"(?={re.escape(n)})"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("int")


def safe_path(c: Column, prefix: str = "raw") -> Column:
    """Neither empty, absolute, on a drive nor out of its prefix."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(p, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, x: F.struct(
            (acc["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
    )
    inside = (p == prefix) | p.startswith(prefix + "/")
    return F.coalesce((F.trim(p) != "") & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & inside & (depth["low"] >= 0) & ~F.array_contains(F.split(p, "/"), ".."), F.lit(False))


def safe_name(c: Column) -> Column:
    """the last segment, characters that file systems refuse as underscores."""
    return F.trim(F.regexp_replace(basename(F.replace(c, F.lit("\\"), F.lit("/"))), r'[<>:"|?*\x00-\x1F]', "_"))


def release(c: Column) -> Column:
    """(major, minor, patch) without what follows a hyphen; null where there are fewer."""
    m = r"^(\d+)\.(\d+)\.(\d+)"
    return F.when(c.rlike(m), F.struct(*[F.regexp_extract(c, m, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def html_text(c: Column) -> Column:
    """The text of a page of HTML."""
    for pattern, by in ((r"(?is)<!--.*?-->", ""), (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " "), (r"(?i)<(br|/p|/div|/h[1-6]|/li|/title|/article|/footer|/nav|/ul)[^>]*>", "\n"), (r"<[^>]*>", "")):
        c = F.regexp_replace(c, pattern, by)
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(by))
    return normalize(c)
