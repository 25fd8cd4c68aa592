"""DOCX documents as Markdown text and as HTML (S7, S22): a zip of XML, read whole in the task that has the file.

Files come from Spark's binary file source, which reads any store that Spark can, so a
partition is some files and nothing but their texts goes on.
"""

from __future__ import annotations

import html as markup
import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The namespace of the format, and where a document keeps its parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY, STYLES, NUMBERING = "word/document.xml", "word/styles.xml", "word/numbering.xml"
#: Parts that unpack to more are refused.
MOST_BYTES = 256 << 20


@dataclass
class Block:
    """A paragraph, a heading of a level, a list's item of a level, or a table of rows of cells of blocks."""

    kind: str
    runs: list[tuple[str, bool, bool]] = field(default_factory=list)
    level: int = 0
    ordered: bool = False
    rows: list[list[tuple[int, list[Block]]]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.runs).strip()


def _part(zipped: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in zipped.namelist():
        return None
    if zipped.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is too large")
    raw = zipped.read(name)
    if b"<!DOCTYPE" in raw:  # the format has none; entities could blow up
        raise ValueError(f"{name} has a document type")
    return ElementTree.fromstring(raw)


def _value(node: ElementTree.Element | None, path: str, default: str | None = None) -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return default if found is None else found.get(f"{W}val", default)


def _on(node: ElementTree.Element | None, name: str) -> bool:
    found = node.find(W + name) if node is not None else None
    return found is not None and found.get(f"{W}val", "1") not in ("0", "false", "off", "none")


class Reader:
    def __init__(self, raw: bytes):
        with zipfile.ZipFile(io.BytesIO(raw)) as zipped:
            self.body = _part(zipped, BODY)
            styles, numbering = _part(zipped, STYLES), _part(zipped, NUMBERING)
        self.levels: dict[str, int] = {}
        self.list_styles: dict[str, tuple[str, int]] = {}
        for s in styles.iter(f"{W}style") if styles is not None else ():
            key, name = s.get(f"{W}styleId", ""), _value(s, "name", "") or ""
            outline, heading = _value(s, "pPr/outlineLvl"), re.fullmatch(r"heading (\d)", name.lower())
            if heading:
                self.levels[key] = int(heading[1])
            elif name.lower() == "title":
                self.levels[key] = 1
            elif outline and outline.isdigit() and int(outline) < 9:
                self.levels[key] = int(outline) + 1
            number = _value(s, "pPr/numPr/numId")
            if number:
                self.list_styles[key] = (number, int(_value(s, "pPr/numPr/ilvl", "0")))
        kinds: dict[tuple[str, str], str] = {}
        self.bullets: dict[tuple[str, str], bool] = {}
        if numbering is not None:
            for a in numbering.iter(f"{W}abstractNum"):
                for level in a.iter(f"{W}lvl"):
                    kinds[a.get(f"{W}abstractNumId", ""), level.get(f"{W}ilvl", "0")] = _value(level, "numFmt", "decimal")
            for n in numbering.iter(f"{W}num"):
                of = _value(n, "abstractNumId")
                self.bullets |= {(n.get(f"{W}numId", ""), lvl): kind == "bullet" for (a, lvl), kind in kinds.items() if a == of}

    def blocks(self, node: ElementTree.Element | None = None) -> list[Block]:
        if node is None:
            node = self.body.find(f"{W}body") if self.body is not None else None
        out: list[Block] = []
        for child in node if node is not None else ():
            if child.tag == f"{W}p":
                out.append(self._paragraph(child))
            elif child.tag == f"{W}tbl":
                rows = [[(int(_value(c, "tcPr/gridSpan", "1")), self.blocks(c)) for c in r.findall(f"{W}tc")] for r in child.findall(f"{W}tr")]
                out.append(Block("table", rows=rows))
            elif child.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins", f"{W}customXml"):
                out += self.blocks(child)
        return out

    def _paragraph(self, p: ElementTree.Element) -> Block:
        style = _value(p, "pPr/pStyle", "")
        runs = list(self._runs(p))
        if style in self.levels:
            return Block("heading", runs, min(self.levels[style], 6))
        number, level = _value(p, "pPr/numPr/numId"), int(_value(p, "pPr/numPr/ilvl", "0"))
        if number is None and style in self.list_styles:
            number, level = self.list_styles[style]
        if number not in (None, "0"):
            return Block("item", runs, level, not self.bullets.get((number, str(level)), False))
        return Block("paragraph", runs)

    def _runs(self, node: ElementTree.Element):
        for child in node:
            if child.tag == f"{W}r":
                style = child.find(f"{W}rPr")
                said = "".join({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}.get(x.tag, "") for x in child)
                if said:
                    yield said, _on(style, "b"), _on(style, "i")
            elif child.tag in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag", f"{W}sdt", f"{W}sdtContent", f"{W}fldSimple"):
                yield from self._runs(child)  # deleted text is left out


def _markdown(blocks: list[Block]) -> list[str]:
    out: list[str] = []
    counts: dict[int, int] = {}  # items so far of each open list, by level
    for b in blocks:
        inside, counts = bool(counts), counts if b.kind == "item" else {}
        if b.kind == "table":
            rows = [["" if not cell else " ".join(" ".join(_markdown(cell)).split()).replace("|", "\\|") for span, cell in row for cell in [cell, *[[]] * (span - 1)]] for row in b.rows]
            wide = max(map(len, rows), default=0)
            lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
            if lines:
                out.append("\n".join([lines[0], f"|{' --- |' * wide}", *lines[1:]]))
        elif not b.text:
            continue
        elif b.kind == "heading":
            out.append(f"{'#' * b.level} {' '.join(b.text.split())}")
        elif b.kind == "item":
            counts = {k: n for k, n in counts.items() if k <= b.level} | {b.level: counts.get(b.level, 0) + 1}
            line = f"{'  ' * b.level}{f'{counts[b.level]}.' if b.ordered else '-'} {b.text}"
            if inside:  # the items of a list are lines of one block
                out[-1] += f"\n{line}"
            else:
                out.append(line)
        else:
            out.append(b.text)
    return out


def _inline(b: Block) -> str:
    said = ""
    for t, bold, italic in b.runs:
        x = markup.escape(t, quote=False).replace("\n", "<br />")
        x = f"<em>{x}</em>" if italic else x
        said += f"<strong>{x}</strong>" if bold else x
    return said


def _html(blocks: list[Block]) -> str:
    out, lists = "", []  # the open lists, outermost first

    def close(to: int) -> str:
        said = ""
        while len(lists) > to:
            said += f"</li></{lists.pop()}>"
        return said

    for b in blocks:
        if b.kind != "item":
            out += close(0)
        if b.kind == "table":
            cell = lambda span, inner: f"<td{f' colspan=\"{span}\"' if span > 1 else ''}>{_html(inner)}</td>"
            out += f"<table>{''.join(f'<tr>{"".join(cell(*c) for c in row)}</tr>' for row in b.rows)}</table>"
        elif not b.text:
            continue
        elif b.kind == "item":
            tag = "ol" if b.ordered else "ul"
            out += close(b.level + 1)
            if len(lists) == b.level + 1 and lists[-1] == tag:
                out += "</li><li>"
            else:
                out += close(b.level)
                while len(lists) < b.level:
                    lists.append("ul")
                    out += "<ul><li>"
                lists.append(tag)
                out += f"<{tag}><li>"
            out += _inline(b)
        else:
            tag = f"h{b.level}" if b.kind == "heading" else "p"
            out += f"<{tag}>{_inline(b)}</{tag}>"
    return out + close(0)


def _read(raw: bytes | None, shape) -> str | None:
    """Nothing for what is no such document, so that one broken file does not end a job."""
    if raw is None:
        return None
    try:
        return shape(Reader(bytes(raw)).blocks())
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, RuntimeError, NotImplementedError):
        return None


def markdown(raw: bytes | None) -> str | None:
    return _read(raw, lambda blocks: "\n\n".join(_markdown(blocks)))


def html(raw: bytes | None) -> str | None:
    return _read(raw, _html)


@F.pandas_udf(T.StringType())
def docx_text(raw: pd.Series) -> pd.Series:
    return raw.map(markdown)


@F.pandas_udf(T.StringType())
def docx_html(raw: pd.Series) -> pd.Series:
    return raw.map(html)
