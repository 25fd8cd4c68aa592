"""Queries over whole tables against brute force."""

import random
import re
import unicodedata

import pytest

from loomstone.operators import plans, relations
from loomstone.plans import catalogue
from loomstone.sources import readers
from loomstone.streaming import streams


@pytest.fixture(scope="module")
def documents(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def named(documents):
    """(id, path, title) of the page of each document."""
    words = [(i, (t.split(" ") + [""])[:2]) for i, t in documents]
    return [(i, f"entities/{w[1]}-{i}.md", f"{w[0]} {w[1]}") for i, w in words]


def test_prompt_pages_of_all_documents(spark, data, documents):
    key = lambda s: re.sub(f"[{plans.DROPPED}]+", "", s.lower())
    pages = [(i, path, key(title), key(path[9:-3])) for i, path, title in named(documents)]
    want = set()
    for window, text in documents:
        hay, scores = key(text), {}
        for i, path, title, name in pages:
            score = sum(len(k) * each for k, each in ((title, 10), (name, 1)) if len(k) >= 2 and k in hay) + (1000 if i == window else 0)
            if score:
                scores[path] = score
        want |= {(window, path, score) for path, score in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: plans.PROMPT_PAGES]}
    got = catalogue.QUERIES["prompt_pages"](spark, data).collect()
    assert {(r["win"], r["path"], r["score"]) for r in got} == want and len(got) == len(want)
    assert {w for w, _, _ in want} == {i for i, _ in documents}


def test_uploads_of_the_whole_table(spark, data, documents):
    got = catalogue.QUERIES["upload_outcome"](spark, data).collect()
    assert {r["seq"] for r in got} == {i for i, _ in documents}
    last = {r["status"] for r in got if r["seq"] >= len(documents) - 12}
    assert last == {"created", "duplicate", "renamed"}


def one_by_one(had, new):
    """Uploads onto a file system, as a dictionary."""
    at, out = dict(had), []
    for seq, rel, content in sorted(new):
        stem, dot, ext = rel.rpartition(".")
        to, k = rel, 0
        if at.get(rel) == content:
            out.append((seq, rel, "duplicate", rel))
            continue
        while to in at:
            k += 1
            to = f"{stem} ({k}){dot}{ext}"
        out.append((seq, rel, "renamed" if k else "created", to))
        at[to] = content
    return out


def test_uploads_equal_a_file_system(spark):
    r = random.Random(4)
    names = ["raw/a.txt", "raw/a (1).txt", "raw/a (2).txt", "raw/b.txt", "raw/c.txt", "raw/d (1).txt", "raw/d.txt"]
    had = [("raw/a (2).txt", "x"), ("raw/b.txt", "x"), ("raw/d.txt", "z")]
    new = [(i, r.choice(names), r.choice("xyz")) for i in range(60)]
    got = relations.upload_outcome(spark.createDataFrame(had, "rel string, hash string"), spark.createDataFrame(new, "seq long, rel string, hash string")).collect()
    assert sorted(tuple(x) for x in got) == one_by_one(had, new)


@pytest.mark.parametrize(
    "name,said",
    [
        ("gb18030", "室内甲醛浓度不大于0.10的标准规定，适用于民用建筑工程。"),
        ("big5", "國家標準規定適用於民用建築工程，室內空氣品質。"),
        ("shift_jis", "これは日本語のテキストです。東京は晴れです。"),
        ("euc_kr", "이것은 한국어 문장입니다. 오늘 날씨가 좋습니다."),
        ("cp1252", "Où est la bibliothèque, s’il vous plaît? Ça va très bien."),
        ("utf-8", "any 中文 é"),
    ],
)
def test_older_encodings(name, said):
    assert readers.decode(said.encode(name)) == said


def test_bytes_of_no_encoding():
    assert "\ufffd" in readers.decode(bytes(range(128, 256)))


def test_a_stream_batch_that_is_tried_again(spark, tmp_path):
    rows, each = spark.range(5), streams.kept(str(tmp_path / "rows"))
    each(rows, 0)
    each(rows, 0)
    each(rows, 1)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 10


def test_dedup_over_all_titles(spark, data, documents):
    key = lambda s: re.sub(f"[{plans.DROPPED}]+", "", unicodedata.normalize("NFKC", s).lower())
    pages = [("entities/gb-1.md", "GB 1"), ("entities/GB标1.md", "GB1"), ("concepts/x_y.md", "x y")] + [x[1:] for x in named(documents)]
    paths = {}
    for path, title in pages:
        for k in (path.split("/")[-1][:-3], title):
            paths.setdefault(key(k), set()).add(path)
    index = {}
    for k, found in paths.items():
        plain = {p for p in found if re.fullmatch(r"[\x20-\x7E]+", p.split("/")[-1])}
        if len(k) >= 2 and (len(found) == 1 or len(plain) == 1):
            index[k] = min(found if len(found) == 1 else plain)
    got = catalogue.QUERIES["dedup_index"](spark, data).collect()
    assert {r["key"]: r["path"] for r in got} == index and len(got) == len(index)
    rows = {r["win"]: (r["kind"], r["path"]) for r in catalogue.QUERIES["plan_dedup"](spark, data).collect() if r["win"] >= 100}
    assert set(rows) == {i + 100 for i, _ in documents}
    for i, _, title in named(documents):
        to = index.get(key(f"{i}_")) or index.get(key(title.strip()))
        assert rows[i + 100] == (("update", to) if to else ("create", f"concepts/{i}_.md")), title


def test_links_of_all_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    title = {re.search("<title>([^<]*)", r["html"])[1] for r in pages} | {"A", "B", "C"}
    paths = [r["url"] for r in pages] + ["entities/beta.md", "entities/a.md", "concepts/c.md"]
    want = sorted((r["url"], x) for r in pages for x in re.findall('href="([^"]+)"', r["html"]) if x not in title and not any(x in path for path in paths))
    got = sorted((r["path"], r["target"]) for r in catalogue.QUERIES["broken_links"](spark, data).collect() if "/" in r["target"])
    assert want and got == want


def test_labels_go_on_after_999(spark, tmp_path):
    spark.range(1, 1203).selectExpr("id AS event_id", "7L AS user_id", "timestamp '2024-01-02 03:04:05' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["label"].split("-")[0] for r in catalogue.QUERIES["trace_label"](spark, str(tmp_path)).collect()}
    assert got == {i: f"{i:03d}" for i in range(1, 1203)}


def test_folds_hold_the_whole_texts(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").where("role = 'assistant'").collect()
    said = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        said[r["conv_id"]] = said.get(r["conv_id"], "") + r["text"]
    got = {r["call_id"]: r["text"] for r in catalogue.QUERIES["stream_fold"](spark, data).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in said.items() if v}
