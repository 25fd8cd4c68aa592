"""The policy document of a corpus (F40, R16): read from prose, written into prose, or written anew."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a document says, and what holds where it says nothing.
PAGE_TYPES = ("source", "entity", "concept")
NAMING = "entities/<名称>.md"
CONFLICT = r"冲突行为[：:]\s*(\w+)"
READ_ONLY = r"raw/\s*目录只读[：:]\s*是"
TYPES = r"##\s*页面类型\s*\n([\s\S]*?)(?=\n##\s|\s*$)"
NAMED = r"实体页[：:]\s*(\S+)"


@dataclass(frozen=True)
class Schema:
    conflict: str = "mark"
    read_only: bool = True
    page_types: tuple[str, ...] = PAGE_TYPES
    naming: str = NAMING


def parsed(document: str) -> Schema:
    first = lambda p: (m := re.search(p, document)) and m.group(1)
    types = re.findall(r"^[-*]\s+([\w-]+)", first(TYPES) or "", re.M | re.A)
    said = first(CONFLICT)
    return Schema(said if said in ("reject", "overwrite") else "mark", re.search(READ_ONLY, document) is not None, tuple(types) or PAGE_TYPES, first(NAMED) or NAMING)


def _sections(s: Schema) -> list[tuple[str, list[str]]]:
    return [("页面类型", list(s.page_types)), ("冲突处理规则", [f"冲突行为：{s.conflict}"]), ("命名约定", [f"实体页：{s.naming}"]), ("不可变性规则", [f"raw/ 目录只读：{'是' if s.read_only else '否'}"])]


def rendered(s: Schema) -> str:
    return "# Corpus policy\n" + "".join(f"\n## {title}\n" + "".join(f"- {x}\n" for x in lines) for title, lines in _sections(s))


def merged(document: str, s: Schema) -> str:
    """The document with the policy's lines and lists in place of its own; other prose stays, missing rules are added at the end."""
    if not document:
        return rendered(s)
    out = document
    for (title, lines), line in zip(_sections(s), (None, r"(?:- )?冲突行为[：:]\s*\w+", None, r"- raw/\s*目录只读[：:]\s*\S+"), strict=True):
        body = "".join(f"- {x}\n" for x in lines)
        if line is None:
            out = re.sub(rf"##\s*{title}[\s\S]*?(?=\n##\s|\s*$)", lambda _, b=body, t=title: f"## {t}\n{b}", out, count=1)
        elif re.search(line, out):
            out = re.sub(line, lambda _, b=body: b.strip(), out, count=1)
        else:
            out = f"{out.rstrip()}\n\n## {title}\n{body}"
    return out


def columns(document: Column) -> dict[str, Column]:
    """The same reading on a column of documents."""
    said = F.regexp_extract(document, CONFLICT, 1)
    section = F.regexp_extract(document, TYPES, 1)
    types = F.regexp_extract_all(section, F.lit(r"(?m)^[-*]\s+([\w-]+)"), F.lit(1))
    naming = F.regexp_extract(document, NAMED, 1)
    return {
        "conflict": F.when(said.isin("reject", "overwrite"), said).otherwise("mark"),
        "read_only": document.rlike(READ_ONLY),
        "page_types": F.when(F.size(types) > 0, types).otherwise(F.array(*map(F.lit, PAGE_TYPES))),
        "naming": F.when(naming != "", naming).otherwise(NAMING),
    }
