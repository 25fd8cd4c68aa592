"""Alignment of two tokenizers against a walk over their tokens, and on odd texts."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from loomstone.llm import alignment

PATHS = alignment._paths(None, None)


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*PATHS)


def spell(table, k):
    return table.data[table.first[k] : table.first[k] + table.size[k]].tobytes()


def brute(both, rows):
    """Token by token over whole texts, as the libraries encode them."""
    seen, found = collections.Counter(), []
    for i, text in rows:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        x, y = [spell(both.a_table, k) for k in a], [spell(both.b_table, k) for k in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        links, groups, p, q, end_a, end_b = [(a[0], b[0])], [([a[0]], [b[0]])], 0, 0, len(x[0]), len(y[0])
        while (p, q) != (len(a) - 1, len(b) - 1) or end_a != end_b:
            one, two = end_a <= end_b, end_b <= end_a
            if one and two:
                groups.append(([], []))
            if one:
                p += 1
                groups[-1][0].append(a[p])
                end_a += len(x[p])
            if two:
                q += 1
                groups[-1][1].append(b[q])
                end_b += len(y[q])
            links.append((a[p], b[q]))
        seen.update(links)
        found.append((i, a, b, groups, links))
    top = collections.Counter()
    for (_, y), n in seen.items():
        top[y] = max(top[y], n)
    say = lambda ids: ",".join(map(str, ids))
    digest = lambda groups: hashlib.sha256(";".join(f"{say(x)}|{say(y)}" for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted(((i, len(a), len(b), len(g), len(links), sum(seen[x] == top[x[1]] for x in links), sum(seen[x] for x in links), digest(g)) for i, a, b, g, links in found), key=str)


ODD = [
    "", None, " ", "  ", "a", "a ", " a", "a  ", "  a  b ", "\n", "a\n", "a\n b", "a \n b  c\t\td \r\n e", " a   b　c", "\x1c a\x1f b", "a\x00b c", "<|endoftext|> x <s> </s> <unk> <0x41>",
    "has ▁ mark", "▁", "the ▁the the", "中文没有空格的一句话" * 40, "😀 family 👨‍👩‍👧 é é", "x" * 5000, "don't we'll I'VE 12345 3.14", "ﬁ ﬂ ½ Ⅷ", "عربي हिन्दी ไทย", "the the the the", "a. \tb", "ȀɎɏɐ Ω ϐ", "tail  ",
]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 5, 0])
def test_equals_a_walk_over_tokens(spark, docs, both, frequent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    table = docs.select("doc_id", "text", "n", "k", "source").unionByName(spark.createDataFrame([(1000 + i, t, 1, "k", "s") for i, t in enumerate(ODD)], "doc_id long, text string, n int, k string, source string"))
    got = alignment.alignment(table, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(both, rows)


def test_empty_tables(spark, empty):
    assert alignment.alignment(empty).count() == 0
    nothing = alignment.alignment(spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id long, text string")).orderBy(F.col("doc_id").asc_nulls_first())
    assert list(map(tuple, nothing.collect())) == [(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_what_is_forgotten_is_encoded_anew(both, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    texts = [f"word{k % 7} other{k}" for k in range(50)]
    for t in texts:
        turn, found = both.words([t])
        assert len(turn) == 3 and [s.a for s in found] == [len(both.a.encode(x).ids) for x in both.split(" " + t)]
    assert len(both.young) + len(both.old) <= 8
