"""Structural chunks (F5-F9, N6, N7) and overlapping windows.

A document's chunks depend on those before them, so one document is one step of a
Python worker; documents are independent and stream through ``mapInArrow``, a few of a
batch at a time, so a worker holds the chunks of STEP texts and no more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.session import findable

#: Limits of breadcrumbs and the shapes of headings.
CRUMB_MOST, PART_MOST, SECTION_MOST = 140, 60, 50
SECTION = re.compile(r"(?:#{1,6}\s+\S|[0-9]{1,3}(?:\.[0-9]{1,3}){0,3}[.、]?\s+\S)")
CAPTION = re.compile(r"(?:表|图|Table|Figure)\s*[0-9]+", re.IGNORECASE)
#: How many texts are taken apart before their chunks leave the worker.
STEP = 32
RULE = re.compile(r"\|[\s:|-]+\|")


def heading_text(line: str) -> str:
    flat = " ".join(re.sub(r"^#+\s*", "", line).split())
    return flat if len(flat) <= PART_MOST else flat[: PART_MOST - 1] + "…"


@dataclass
class Trail:
    """The section and the caption that a place in a document stands under."""

    clause: str = ""
    caption: str = ""

    def read(self, block: str) -> None:
        for line in filter(None, map(str.strip, block.split("\n"))):
            if CAPTION.match(line):
                self.caption = heading_text(line)
            elif len(line) <= SECTION_MOST and SECTION.match(line):
                self.clause, self.caption = heading_text(line), ""

    def crumb(self, title: str, budget: int) -> str:
        line = " · ".join(filter(None, (heading_text(title), self.clause, self.caption)))
        if not line or budget < 4:
            return ""
        line = f"[{line}]"
        return line if len(line) <= budget else line[: max(budget - 2, 1)] + "…]"


@dataclass
class Packer:
    """Lines packed into blocks of at most ``cap`` characters; a new block of a table repeats its header."""

    cap: int
    blocks: list[str] = field(default_factory=list)

    def paragraph(self, text: str) -> None:
        lines = text.split("\n")
        table = len(lines) > 1 and lines[0].startswith("|") and RULE.fullmatch(lines[1].strip())
        header = f"{lines[0]}\n{lines[1].strip()}" if table else ""
        held = ""
        for line in lines:
            if len(line) > self.cap:
                self.blocks += [held] if held else []
                self.blocks += [line[i : i + self.cap] for i in range(0, len(line), self.cap)]
                held = ""
            elif not held or len(held) + 1 + len(line) <= self.cap:
                held = f"{held}\n{line}" if held else line
            else:
                self.blocks.append(held)
                with_header = f"{header}\n{line}"
                held = with_header if header and len(with_header) <= self.cap else line
        self.blocks += [held] if held else []


def chunk_text(text: str, size: int, overlap: int, title: str = "") -> list[str]:
    """The chunks of a normalised text, each under a breadcrumb of its title, section and caption."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap from 0 and below size")
    budget = min(CRUMB_MOST, size // 3)
    packer = Packer(max(size - budget, 1))
    for part in re.split(r"\n{2,}", text):
        if part.strip():
            packer.paragraph(part.strip())
    blocks, trail, out, at = packer.blocks, Trail(), [], 0
    while at < len(blocks):
        trail.read(blocks[at])
        crumb = trail.crumb(title, budget)
        room, end = max(size - len(crumb), 1) - len(blocks[at]), at + 1
        while end < len(blocks) and len(blocks[end]) + 2 <= room:
            trail.read(blocks[end])
            room -= len(blocks[end]) + 2
            end += 1
        out.append("\n".join(filter(None, (crumb, "\n\n".join(blocks[at:end])))))
        if end == len(blocks):
            break
        # the next chunk opens with as many of the last blocks as the overlap holds, but not with all
        spare, back = overlap, end
        while back - 1 > at and len(blocks[back - 1]) <= spare:
            back -= 1
            spare -= len(blocks[back])
        at = back
    return out


def chunks(docs: DataFrame, size: int = 800, overlap: int = 100, title: str = "title") -> DataFrame:
    """(source_path, chunk_index, content) from (source_path, content, title); blank texts give no rows."""
    chunk_text("x", size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, STEP) for k in range(0, whole.num_rows, STEP)):
                rows = [(path, i, c) for path, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, c in enumerate(chunk_text(text or "", size, overlap, name or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["source_path", "chunk_index", "content"])

    findable(docs.sparkSession)
    return docs.select("source_path", "content", F.col(title).alias("title")).mapInArrow(run, "source_path string, chunk_index int, content string")


#: The least and largest window, what windows share, what is read at most.
WINDOW_LEAST, WINDOW_MOST, SHARED, READ_MOST = 500, 20_200, 200, 4_000_000


def window_size(n: Column, window: int, most: int, cap: int) -> Column:
    cap = max(WINDOW_LEAST, min(cap, WINDOW_MOST))
    low = min(max(int(window), WINDOW_LEAST), cap)
    need = F.ceil((F.least(n, F.lit(READ_MOST)) + (most - 1) * SHARED) / most)
    return F.when(n <= low, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(need, F.lit(cap)))).cast("int")


def windows(docs: DataFrame, window: int = 2000, most: int = 200, cap: int = WINDOW_MOST, text: str = "content") -> DataFrame:
    """docs' columns but the text, and (window, start, size, truncated, content) for each window."""
    n, most = F.length(text), max(int(most), 1)
    low = min(max(int(window), WINDOW_LEAST), max(WINDOW_LEAST, min(cap, WINDOW_MOST)))
    whole, budget, size = n <= low, F.least(n, F.lit(READ_MOST)), window_size(n, window, most, cap)
    step = size - SHARED
    wanted = F.when(whole, F.lit(1)).otherwise(F.ceil((budget - size) / step) + 1).cast("int")
    rows = docs.withColumns({"__size": size, "__n": F.least(wanted, F.lit(most)), "__cut": ~whole & ((wanted > most) | (budget < n)), "__end": F.when(whole, n).otherwise(budget)})
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    start = F.col("window") * (F.col("__size") - SHARED)
    content = F.substring(F.col(text), start + 1, F.least(F.col("__size"), F.col("__end") - start))
    rest = [c for c in docs.columns if c != text]
    return rows.select(*rest, "window", start.alias("start"), F.col("__size").alias("size"), F.col("__cut").alias("truncated"), content.alias("content"))
