"""Main text of pages: against the article's own markup, on pages of other make, and on odd markup."""

import html
import random
import re
import time

import numpy as np

from loomstone.llm import main_text


def one(page):
    return main_text.main_texts([page])[0]


def test_tree_fits_its_table_and_splits_by_impurity():
    tree = main_text.tree()
    for page in main_text.LABELLED:
        texts, _, rows = main_text.rows_of(["".join(f"<wbr>{part.replace('word', 'yes' if keep else 'no')}" for part, keep in page)])
        assert tree.classify(rows).tolist() == ["yes" in t for t in texts[0]]
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    grown = main_text.Tree(x, y)
    assert (grown.classify(x) == y.astype(bool)).all() and grown.column[0] in (0, 2)
    best = min((((y[x[:, j] <= t].var() * (x[:, j] <= t).sum() + y[x[:, j] > t].var() * (x[:, j] > t).sum()), j) for j in range(3) for t in np.sort(x[:, j])[:-1]))
    assert grown.column[0] == best[1]


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inside = re.sub(r"<[a-z0-9]+[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside))
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"</[a-z]+>", "", inside)).split())
    got = main_text.extracted(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == pages.count()


def test_pages_of_other_make():
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    links = "".join(f"<li><a href='/{k}'>{say(2)}</a>" for k in range(6))
    for lengths in ((2, 40, 3, 25), (60, 5, 1, 90), (15, 15, 15, 15)):
        body = [say(n) for n in lengths]
        text = "".join(f"<p>{b}</p>" for b in body)
        want = " ".join(body)
        for page in (
            f"<body><div id='top-nav'><ul>{links}</ul></div><main role='main'>{text}<aside>{say(30)}</aside></main><div class='site-footer'>{say(20)}</div>",
            f"<body class='single-post has-sidebar'><header><h1>{say(3)}</h1></header><div class='post-content'>{text}<div class='adBanner'>{say(25)}</div></div><div class='sidebar widget-area'><p>{say(40)}</p></div>",
            f"<article class='no-sidebar'>{text}<section id='comments'><article><p>{say(30)}</p></article></section></article><div class='related-posts'><article><p>{say(20)}</p></article></div>",
            f"<div class='cookieNotice'>{say(30)}</div><article>{text}<form action='/x'><label>{say(4)}</label><textarea>{say(5)}</textarea></form></article><footer><p>{say(30)}</p></footer>",
            f"<article><header><p class='byline'>{say(3)}</p></header>{text}</article><div class='comment-list'><p>{say(50)}</p></div>",
            f"<table><tr><td><ul>{links}</ul><td><div role='article'>{text}</div><td class='ads'><p>{say(33)}</p></table>",
        ):
            assert one(page) == want, page
    body = [say(n) for n in (40, 12, 55, 20)]
    assert one(f"<ul>{links}</ul>{''.join(f'<p>{b}' for b in body)}<ul>{links}</ul>") == " ".join(body)


def test_odd_markup():
    assert one("<p>Hi &amp;lt; there &lt;b&gt; a<b>b</b>c<br>d &nbsp; e &#x41; &copy 3 < 4 and 5 > 2") == "Hi &lt; there <b> abc d e A © 3 < 4 and 5 > 2"
    assert one("<article><p>One<!-- <p>no</p> --> two <script>if (a<b) '</p>'</script> three<span hidden>secret</span> four</p><aside>x y z</aside><p>five</article>") == "One two three four five"
    assert one("<ARTICLE><P>unclosed <B>bold<P>next <I>one</ARTICLE><FOOTER>foot") == "unclosed bold next one"
    assert one('<article><p>a</p><div class="a>b">c</div><p title=\'x>y\'>d</p><p title="e>f</p></article>') == "a c d f"
    assert one("<article><div>a<div>b</article>c<style>p{}</style><article>d") == "a b d"
    assert one("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul></article>") == "a b c d"
    assert one("<article><![CDATA[ no ]]>a<?php no ?>b</>c</article>") == "abc"
    assert [one(x) for x in ("", "<p", "<!--", "<script>", "<article></article>", " \n ", "<article><nav>a</nav></article>")] == [""] * 7
    assert one("x") == "x" and one("</p></p></div>x") == "x" and one("<article>" + "long " * 30_000) == ("long " * 30_000).strip()


def test_time_follows_the_length():
    for piece in ("<div>", "<a <", "<", "=\"'", "</p>", "<li>", "<!--x", "<p title='", "<td><table>", "&", "<span hidden>"):
        began = time.time()
        one("<article>" + piece * 40_000 + "</b>" * 40_000)
        assert time.time() - began < 8, piece


def test_odd_rows(spark):
    schema = "text string, url string, html string, page_id long, n_chars int, u int, k int, h int"
    rows = [("t", "u1", "<article>one</article>", 1, 5, 1, 1, 1)] * 2 + [("t", None, None, None, 5, 1, 1, 1), (None, "u2", "", 1, None, 1, 1, 1)]
    got = main_text.extracted(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u1", "one", 3)] * 2 + [(None, None, "", 0), (1, "u2", "", 0)], key=str)
    assert main_text.extracted(spark.createDataFrame([], schema)).count() == 0
