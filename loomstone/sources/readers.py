"""Readers (S1, S5, S6, S8, S10, S15-S17, S22): files to relations."""

from __future__ import annotations

import codecs
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import text
from loomstone.sources import docx

#: What can be parsed without more parsers.
EXTENSIONS = (".txt", ".md", ".markdown", ".json", ".csv", ".xml", ".yaml", ".yml", ".html", ".htm", ".log", ".docx")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


#: Encodings older than UTF-8, and the lead bytes of each one's everyday characters; kana and hangul by their code points.
_LEGACY = (("gb18030", "gb2312", range(0xB0, 0xD8)), ("big5", "big5", range(0xA4, 0xC7)), ("shift_jis", "shift_jis", range(0x88, 0x98)), ("euc_jp", "euc_jp", range(0xB0, 0xD0)), ("euc_kr", "euc_kr", range(0, 0)))
#: The commonest characters of each, which decide between encodings that fit alike.
_COMMONEST = {"gb18030": "的一是不了在有和中大人为国", "big5": "的一是不了在有和中大人為國", "shift_jis": "のにはをがでと", "euc_jp": "のにはをがでと", "euc_kr": "이다는을에의가하고"}
SURE = 0.8


def _everyday(char: str, codec: str, leads: range) -> bool:
    if "\u3000" <= char <= "\u303f" or "\uff00" <= char <= "\uffef" or "\u2010" <= char <= "\u203f":
        return True
    if codec in ("shift_jis", "euc_jp") and "\u3040" <= char <= "\u30ff" or codec == "euc_kr" and "\uac00" <= char <= "\ud7a3":
        return True
    try:
        return char.encode(codec)[0] in leads
    except UnicodeEncodeError:
        return False


def detected(raw: bytes) -> str | None:
    """The text in the encoding that makes the largest share of its other than ASCII characters everyday ones, if that is above SURE."""
    best, out = SURE, None
    for name, codec, leads in _LEGACY:
        try:
            said = raw.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in said if c > "\x7f"]
        share = sum(_everyday(c, codec, leads) for c in odd) / max(1, len(odd))
        share += min(0.1, sum(c in _COMMONEST[name] for c in odd) / max(1, len(odd)))
        if codec in ("shift_jis", "euc_jp") and not any("\u3040" <= c <= "\u30ff" for c in odd):
            share -= 0.1  # Japanese has kana
        if share > best:
            best, out = share, said
    if out is None:
        said = raw.decode("cp1252", "replace")
        odd = [c for c in said if c > "\x7f"]
        letters = sum(c.isalpha() or c in "‘’“”–—…€°" for c in odd)
        # Western text: accents stand single between ASCII letters
        if "�" not in said and letters > SURE * len(odd) and not re.search(r"[\x80-\U0010ffff]{3}", said) and 3 * len(odd) < len(said):
            out = said
    return out


def decode(raw: bytes) -> str:
    """By its byte order mark, else strict UTF-8, else an encoding that is detected with confidence, else UTF-8 with replacements."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        said = detected(raw)
        return raw.decode("utf-8", "replace") if said is None else said


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode(bytes(b)))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, length, content, file_hash) of all files below a folder, read in parallel; names with a leading dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^.*?/raw/", "raw/")
    return files.select(rel.alias("source_path"), "length", "content", F.sha2("content", 256).alias("file_hash")).where(~text.basename(F.col("source_path")).startswith("."))


def parsed(files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(source_path, text, parser) of files (source_path, content) of known kinds, each by its extension; a file that its parser can't read has no text.

    PDF needs its text layer's layout and is not read here.
    """
    ext = text.extension(F.col("source_path"))
    parser = F.when(ext.isin(".docx", ".pdf"), F.substring(ext, 2, 4)).when(ext.isin(".html", ".htm"), "html").otherwise("text")
    rows = files.where(supported(F.col("source_path"), extra)).withColumn("parser", parser)
    # each parser gets the files of its kind and nulls for the others, in one reading of the files
    mine = lambda *kinds: F.when(F.col("parser").isin(*kinds), F.col("content"))
    rows = rows.select("source_path", "parser", docx.docx_text(mine("docx")).alias("d"), decoded(mine("html", "text")).alias("t"))
    said = F.when(F.col("parser") == "docx", F.col("d")).when(F.col("parser") == "html", text.html_text(F.col("t"))).otherwise(F.col("t"))
    return rows.select("source_path", text.normalize(said).alias("text"), "parser")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the Markdown files below a folder."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), r"^.*?/wiki/", "").alias("path"), F.col("value").alias("content"))


def extensions(extra: Sequence[str] = ()) -> list[str]:
    """The known extensions and the given ones, trimmed, in lower case, with a dot, once."""
    out = dict.fromkeys(EXTENSIONS)
    for e in (x.strip().lower() for x in extra):
        if e:
            out[e if e.startswith(".") else f".{e}"] = None
    return list(out)


def supported(name: Column, extra: Sequence[str] = ()) -> Column:
    return text.extension(name).isin(*extensions(extra))


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document; one that is missing or broken is empty, never an error."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Quotes, doubled quotes and line ends in fields; the first row names the columns."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def vocabulary(lines: Sequence[str]) -> dict[str, int]:
    """Each line's number; blank lines count but have no entry."""
    return {w: i for i, line in enumerate(lines) if (w := line.rstrip("\r\n")) != ""}
