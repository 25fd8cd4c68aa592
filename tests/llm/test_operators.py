"""Every operator against a brute-force version, and on odd and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomstone.llm import common, decontamination, jaccard, language_id, lm_scoring, mixing, nearest, pii, quality, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_quality_keeps_trusted_and_rejects_junk(docs, labels, empty):
    got = quality.quality(docs, labels, train_docs=30).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    ids = {t: i for i, t in rows_of(docs)}
    assert not by_id[ids["the&&& of%%% " * 30]]["keep"] and by_id[ids["two words"]]["keep"]
    assert sum(r["keep"] for r in got) > 0.9 * len(got)
    assert quality.without_rejected(docs, labels, train_docs=30).columns == docs.columns
    assert all(r["keep"] for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(empty, labels).count() == 0


def test_quality_of_a_language_with_one_trusted_document(spark):
    r = random.Random(3)
    words = [a + b for a in ("al", "be", "co", "du") for b in ("ra", "li", "mo", "nu")]

    def say(lang, share=None):
        share = r.uniform(0.1, 0.5) if share is None else share
        return " ".join(f"rare{r.random()}" if r.random() < share + 0.2 * (lang == "x") else r.choice(words) for _ in range(r.randint(60, 120)))

    odd = spark.range(2000, 2100).where("pmod(xxhash64(id), 2) = 1").first()[0]  # stays out of the sample
    rows = [(i, say("x" if i >= 1000 else "", 0.3 if i == odd else None), "xx" if i >= 1000 else "en") for i in (*range(300), *range(1000, 1060), odd)]
    good = spark.createDataFrame([(i, 1, 0) for i in (*range(300), odd)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [x for x in quality.quality(docs, good, train_docs=100).collect() if x["lang"] == "xx"]
    assert len(got) == 61 and sum(not x["keep"] for x in got) <= 2
    alone = quality.quality(docs.where("lang = 'xx'"), good, train_docs=100).collect()
    assert len(alone) == 61 and all(x["keep"] for x in alone)


def test_long_words_are_weighed_whole():
    model = lm_scoring.lattice(public_tokenizers.path(lm_scoring.PIECES))
    for word in ("internationalisation" * 9, "https://example.org/" + "aé中😀the" * 40, "x" * 65):
        chars = np.array([[0x2581, *map(ord, word)]], np.uint32)
        assert abs(model.score([word])[0] - model._forward(chars)[0]) < 1e-6
    assert np.isfinite(model.score(["the" * 50_000])[0])


class Brute:
    """Interpolated modified Kneser-Ney trigrams of words, from its definition."""

    def __init__(self, texts):
        three = collections.Counter(x for t in texts for x in self.tokens(t))
        two = collections.Counter()
        for (u, v, w), n in three.items():
            two[v, w] += n if v == "<s>" else 1
        one = collections.Counter(w for _, w in two)
        self.counts = [one, two, three]
        self.cut, self.total, self.left = [], [], []
        for order, c in enumerate(self.counts):
            n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
            d = [min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) if a else 0.5 for k, a, b in zip((1, 2, 3), n, n[1:], strict=False)]
            self.cut.append(lambda x, d=d: d[min(x, 3) - 1])
            total, left = collections.Counter(), collections.Counter()
            for g, x in c.items():
                ctx = g[:-1] if order else ()
                total[ctx] += x
                left[ctx] += self.cut[order](x)
            self.total.append(total)
            self.left.append(left)

    @staticmethod
    def tokens(text):
        w = ["<s>", "<s>", *WORD.findall(text or ""), "</s>"]
        return list(zip(w, w[1:], w[2:], strict=False))

    def p(self, u, v, w):
        one, total = self.counts[0], self.total[0][()]
        new = self.left[0][()] / total / (len(one) + 1)
        out = ((one[w] - self.cut[0](one[w])) / total if w in one else 0) + new
        for order, g in ((1, (v, w)), (2, (u, v, w))):
            ctx = g[:-1]
            if self.total[order][ctx]:
                c = self.counts[order][g]
                out = ((c - self.cut[order](c)) if c else 0) / self.total[order][ctx] + self.left[order][ctx] / self.total[order][ctx] * out
        return out

    def log10(self, text):
        return sum(np.log10(self.p(*x)) for x in self.tokens(text))


@pytest.mark.parametrize("frequent", [quality.FREQUENT, 3])
def test_quality_scores_equal_kneser_ney(spark, docs, frequent):
    train = ["a b a c a b d a b a e", "b a c", "a", "", *[t for _, t in rows_of(docs) if t][:12]]
    model = quality.train(spark.createDataFrame([(t,) for t in train], "text string"), common.Scratch(spark))
    brute = Brute(train)
    vocab = [*brute.counts[0], "never seen"]
    for u, v in (("a", "b"), ("<s>", "a"), ("d", "e"), ("q", "r")):
        assert abs(sum(brute.p(u, v, w) for w in vocab) - 1) < 1e-9
    asked = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("t")).unionByName(spark.createDataFrame([(900 + i, t, "x", i) for i, t in enumerate(train)], "doc_id long, text string, lang string, t long"))
    got = collections.Counter((r["doc_id"], r["n_tokens"], round(r["log10_prob"], 6)) for r in quality.log_probabilities(asked, model, frequent).collect())
    assert got == collections.Counter((i, len(brute.tokens(t)), round(brute.log10(t), 6)) for i, t in rows_of(asked))


def test_quality_decides_as_its_definition(spark, docs, labels):
    """Thresholds and decisions from the scores, worked out anew; percentiles of few rows are their minimum."""
    got = quality.quality(docs, labels, train_docs=20, quantile=0.0).collect()
    good = {i for i in range(55) if i % 9 != 8 and i != 2}
    ids = [(i,) for i in sorted(good)]
    h = {r["i"]: r["h"] for r in spark.createDataFrame(ids, "i long").select("i", F.xxhash64("i").alias("h")).collect()}
    texts = dict(rows_of(docs))
    fits = {i for i in sorted((i for i in good if h[i] % 2 == 0), key=lambda i: (h[i], i))[:20] if texts.get(i) is not None and len(texts[i].encode()) <= quality.TRAIN_BYTES}
    held = [r for r in got if r["doc_id"] in good - fits]
    mean = lambda rs: sum(r["log10_prob"] for r in rs) / sum(r["n_tokens"] for r in rs)
    drawn = lambda r, m: (r["log10_prob"] + quality.PRIOR * m) / (r["n_tokens"] + quality.PRIOR)
    by = collections.defaultdict(list)
    for r in held:
        by[r["lang"]].append(r)
    far = {k: min(drawn(r, mean(rs)) - mean(rs) for r in rs) for k, rs in by.items()}
    usual = -min(far.values())
    for r in got:
        rs = by[r["lang"]]
        own = (-len(rs) * far[r["lang"]] + quality.ENOUGH * usual) / (len(rs) + quality.ENOUGH)
        wide = (1 + 1 / len(rs) + quality.PRIOR / sum(x["n_tokens"] for x in rs)) ** 0.5
        limit = mean(rs) - (1 + quality.MARGIN) * wide * own
        assert abs(r["threshold"] - limit) < 1e-9 and abs(r["score"] - drawn(r, mean(rs))) < 1e-9
        assert r["keep"] == (r["score"] >= r["threshold"])


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    total, by_source = sum(r["size"] for r in got), collections.defaultdict(list)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        by_source[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by_source.items()}
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=False))
    target, left, share = dict.fromkeys(sizes, 0.0), float(total), set(sizes)
    while share:  # as the contract says it: by weight, what is above the limit is shared again
        w = sum(weight[s] for s in share)
        over = {s for s in share if left * weight[s] / w > 3 * sizes[s]}
        for s in over or share:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        share -= over
    for s, rs in by_source.items():
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= 3 * max(r["size"] for r in rs)
    emitted = mixing.emit(docs, mixing.mix(docs))
    assert emitted.columns == [*docs.columns, "copy"] or set(emitted.columns) == {*docs.columns, "copy"}
    assert emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty, mixing.mix(empty)).count() == 0


def test_emit_keeps_sizes_apart(spark):
    rows = [(1, "s", "w " * n + x, 0) for n, x in ((10, "a"), (20, "b"), (10, "c"), (20, "d"))] + [(None, None, None, 0), (None, "s", "w", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    mixed = spark.createDataFrame([(1, "s", 11, 1), (1, "s", 21, 0), (1, "s", 11, 0), (1, "s", 21, 1), (None, None, 0, 2), (None, "s", 1, 0)], "doc_id long, source string, size long, copies long")
    got = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").split()), r["copy_"]) for r in mixing.emit(docs, mixed).collect())
    assert got == {(1, "s", 11, 1): 1, (1, "s", 21, 1): 1, (None, None, 0, 1): 1, (None, None, 0, 2): 1}


def test_mixing_of_one_key_in_many_rows(spark):
    docs = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id) doc_id", "'s' source", "repeat('w ', int(id % 2) + 3) text")
    got = mixing.mix(docs).agg(F.count("*"), F.sum("copies"), F.max("target"), F.sum("taken")).first()
    assert got[0] == 30_000 and abs(got[3] - got[2]) <= 12


def brute_dedup(rows, span):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        if i is not None:
            for k in range(len(w) - span + 1):
                x = tuple(w[k : k + span])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("span,k", [(50, 24), (12, 5)])
def test_substring_dedup(docs, empty, span, k):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs, span, k).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(brute_dedup(rows_of(docs), span), key=lambda r: str(key(r)))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_when_hashes_collide(spark):
    r, words = random.Random(2), "abcdefghijklmnopqrstuvwx"
    base = [[r.choice(words) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join(base[0][:30] + base[1][20:]), " ".join(base[2][5:] + base[3]), " ".join("zz" if k == 40 else x for k, x in enumerate(base[4])), "b " * 9, "b " * 40, "a " + "b " * 20, "c d " * 6, "c d " * 30]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for bits in (1, 64):
        got = [(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(docs, 8, 3, hash_bits=bits).collect()]
        assert sorted(got) == sorted(brute_dedup(rows_of(docs), 8)) and any(x[2] for x in got)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_personal_data(spark, docs, empty):
    odd = ["a@b.c_d@e.f a@b.c%d@e.f.g x@y a@@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "é 4539 1488 0343 6467 😀 x@y.zz 4539148803436467-1", "+1 (974) 555-3436 ++12345678 +1.2.3.4.5.6.7.8.9", "1" * 5000, "a." * 3000 + "@b.c"]
    odd += [f"please write to user{i}@corp{i}.example.org today" for i in range(6)] + ["please write to alice99@internal today", "please write to bob[at]corp.org now"]
    rows = spark.createDataFrame([*enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = pii.personal_data(rows)
    want = collections.Counter((i, tuple(brute_pii(t))) for i, t in rows_of(rows))
    assert collections.Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in got.collect()) == want
    added = {odd[r["doc_id"]][s["start"] : s["end"]] for r in got.where("size(added) > 0").collect() for s in r["added"]}
    assert added == {"alice99@internal", "bob[at]corp.org"}
    hidden = {r["doc_id"]: r["text"] for r in pii.redacted(rows.where("doc_id in (2, 3, 12)").where("text not like 'co%'").limit(50)).collect()}
    assert not any("@" in (t or "") for t in hidden.values())
    assert pii.redacted(docs).columns == docs.columns and pii.personal_data(empty).count() == 0


def brute_patterns(spans):
    """From (base, candidates) of texts, each (kind, ctx, x) or (ctx, x): the graph's rounds one by one."""
    fits = lambda kind, x: bool(re.search(r"@|[\[(]at[\])]", x)) if kind == "email" else len(re.sub("[^0-9]", "", x)) >= 6
    seed = {}
    for base, candidates in spans:
        for k, ctx, x in base:
            if ctx is not None:
                seed[k, ctx, x] = 1.0
        for ctx, x in candidates:
            for k in PATTERNS:
                if ctx is not None and fits(k, x):
                    seed.setdefault((k, ctx, x), 0.0)
    strings, contexts = collections.defaultdict(set), collections.defaultdict(set)
    for k, ctx, x in seed:
        strings[k, ctx].add(x)
    for (k, ctx), xs in strings.items():
        if len(xs) >= pii.SEEDS:
            for x in xs:
                contexts[k, x].add(ctx)
    first = {(k, x): max(seed[k, c, x] for c in cs) for (k, x), cs in contexts.items()}
    belief, p = dict(first), {}
    for _ in range(pii.ROUNDS):
        p = {}
        for (k, c), xs in strings.items():
            if len(xs) >= pii.SEEDS and sum(belief[k, x] >= pii.CONFIDENCE for x in xs) >= pii.SEEDS:
                p[k, c] = sum(belief[k, x] for x in xs) / (len(xs) + 1)
        belief = {(k, x): max(first[k, x], 1 - np.prod([1 - min(p.get((k, c), 0.0), 0.999) for c in cs])) for (k, x), cs in contexts.items()}
    return {kc for kc, v in p.items() if v >= pii.CONFIDENCE}


def test_patterns_are_bootstrapped(spark, docs):
    names = [f"{a}{b}@intra{a}" for a in ("kim", "lee", "noor", "sol") for b in (17, 28, 39)]
    texts = [f"reply to user{i}@corp{i}.example.org" for i in range(40)] + [f"reply to {n}" for n in names]  # a seed pattern reveals names ...
    texts += [f"account owner {n}" for n in names] + ["account owner hidden77@deep"]  # ... which induce another one, which reveals this
    texts += [f"weather at station{i}@hill" for i in range(9)] + [f"order number 12345{i}" for i in range(9)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = pii.found(rows).collect()
    want = brute_patterns([([(s["kind"], s["ctx"], s["x"]) for s in r["base"]], [(s["ctx"], s["x"]) for s in r["candidates"]]) for r in found])
    got = {(r["kind"], r["ctx"]) for r in pii.patterns(pii.found(rows)).collect()}
    assert got == want and {("email", "reply to"), ("email", "account owner")} <= got
    added = {texts[r["doc_id"]][s["start"] : s["end"]] for r in pii.personal_data(rows).where("size(added) > 0").collect() for s in r["added"]}
    assert added == {*names, "hidden77@deep"}


def brute_contamination(text, windows):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD))
    hit, items = set(), set()
    for x, ids in windows.items():
        for k in range(len(w) - len(x) + 1):
            if tuple(w[k : k + len(x)]) == x:
                hit.update(range(k, k + len(x)))
                items |= ids
    ids = sorted(map(str, items))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most_bits", [decontamination.MOST_BITS, 7])
def test_decontamination(docs, items, empty, most_bits, monkeypatch):
    if most_bits == 7:  # nearly every window passes the set, and the words decide
        monkeypatch.setattr(decontamination, "LEAST_BITS", 7)
    windows = collections.defaultdict(set)
    for r in items.where("item_id is not null").collect():
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r["text"] or "").translate(FOLD))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(r["item_id"])
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in decontamination.contamination(docs, items, most_bits=most_bits, broadcast_windows=1 << 17 if most_bits > 7 else 0).collect())
    assert got == collections.Counter((i, *brute_contamination(t, windows)) for i, t in rows_of(docs))
    assert any(r[5] for r in got)
    kept = decontamination.without_contaminated(docs, items, most_bits=most_bits, broadcast_windows=1 << 17 if most_bits > 7 else 0)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in got.items() if not r[5])
    assert not decontamination.contamination(decontamination.without_spans(docs, items, most_bits=most_bits, broadcast_windows=1 << 17 if most_bits > 7 else 0).where("text not like '%two%'"), items.where("item_id <> 2")).where("n_hit > 0").count()
    assert decontamination.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(empty, items).count() == 0


def test_one_window_of_many_items(spark):
    text = " ".join(f"w{k}" for k in range(14))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(f"before {text} after").alias("text"))
    got = decontamination.contamination(docs, items).select("n_hit", "n_items", "contaminated").distinct().collect()
    assert [tuple(r) for r in got] == [(14, 10_000, True)]


def test_nearest_ties_and_one_id_in_many_rows(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 40L, id) vec_id", "array(double(id % 7), double(1), double(id % 5)) embedding")
    got = nearest.nearest_neighbours(rows.unionByName(rows.where("vec_id < 100")), every=5000, nearest=5).collect()
    seen = rows.unionByName(rows.where("vec_id < 100")).toPandas()
    for q in {r["query_id"] for r in got}:
        vector = min(map(tuple, seen[seen["vec_id"] == q]["embedding"]))
        others = seen[seen["vec_id"] != q]
        want = sorted((-sum(a * b for a, b in zip(v, vector, strict=True)), i) for i, v in zip(others["vec_id"], others["embedding"], strict=True))[:5]
        mine = [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == sorted(mine) and [x for x, _ in mine] == [x for x, _ in want]  # which of the tied rows are found is approximate


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = np.concatenate((r.normal(size=(800, 16)), np.repeat(r.normal(size=(1, 16)), 60, 0)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0, None] * 8, 1), (None, x[0].tolist(), 1), (840, x[840].tolist(), 1)]
    got = nearest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), nearest=10).toPandas()
    assert set(got["query_id"]) == set(range(0, 860, 20))
    ids = np.array([i for i, v, _ in rows if i is not None and i < 1000])
    m = np.array([v for i, v, _ in rows if i is not None and i < 1000])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (m * x[q]).sum(axis=1)
        s[ids == q] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and g["score"].is_monotonic_decreasing
        assert np.allclose(sorted(g["score"]), sorted((x[g["vec_id"]] * x[q]).sum(axis=1)), atol=1e-12)
        hit += len(set(g["vec_id"]) & set(ids[want]))
    assert hit >= 0.9 * 10 * got["query_id"].nunique()
    assert nearest.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    few = nearest.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0)]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    count = lambda t: len(library.encode(t or "", add_special_tokens=False))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs).collect())
    assert got == collections.Counter((i, len((t or "").encode()), count(t), count(t) > 2048) for i, t in rows_of(docs))
    odd = ["a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ.", "it's we'll 'LL x'D", "²½ ①٣", "\x1c\x85 x　y", "aaaaaaa" * 50, "é İstanbul <| x |>"]
    assert token_counts.Counter(public_tokenizers.path(token_counts.TOKENIZER), memory=3).count(odd) == [count(t) for t in odd]
    assert token_counts.token_counts(empty).count() == 0


def test_language_id(spark, data, docs, empty):
    table = common.table(spark, data, "documents")
    got = language_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held) > 0
    odd = {t: r for r, t in ((r, r["text"]) for r in language_id.language_id(docs).join(docs.select("doc_id", "text"), "doc_id").collect())}
    assert all(odd[t]["lang_pred"] == "und" and odd[t]["score"] == 0 for t in ("", None, " \t\n"))
    assert language_id.language_id(docs).count() == docs.count() and language_id.language_id(empty).count() == 0
    # lang, source and id are never inputs of a prediction
    wrong = table.where(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2)
    mixed = table.join(wrong.select("doc_id"), "doc_id", "left_anti").unionByName(wrong.withColumn("lang", F.lit("xx")))
    assert {(r["doc_id"], r["lang_pred"]) for r in language_id.language_id(mixed).collect()} == {(r["doc_id"], r["lang_pred"]) for r in got}


def test_language_scores_equal_kernel_ridge_regression(monkeypatch):
    r = random.Random(9)
    texts = [" ".join("".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 40))) for a in ("abcde", "cdefg", "éñfgh") for _ in range(12)]
    langs = [x for x in ("aa", "bb", "cc") for _ in range(12)]
    monkeypatch.setattr(language_id, "LANDMARKS", 5)
    monkeypatch.setattr(language_id, "PIECE", 16)
    asked = texts + ["zzz completely other", "a", "é" * 90]
    got = language_id.Predictor(language_id.Model(texts, langs)).scores(asked)

    def spectrum(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [spectrum(t) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [sets[12 * k + i] for k in range(3) for i in range(5)]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    white = vectors / np.sqrt(values)
    z = lambda s: np.append(np.array([kernel(s, m) for m in marks]) @ white, 1.0)
    x = np.array([z(s) for s in sets])
    y = np.array([[1.0 if a == b else -1.0 for b in ("aa", "bb", "cc")] for a in langs])
    beta = np.linalg.solve(x.T @ x + (language_id.RIDGE * len(x) / x.shape[1] + 1e-9) * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(got, [z(spectrum(t)) @ beta for t in asked], atol=1e-4)


def test_language_of_many_and_of_hot_rows(spark):
    rows = [(i, f"{chr(0x3B1 + i % 90)}{chr(0x400 + i % 90)} " * (3 + i // 90), f"l{i % 90}") for i in range(900)] + [(None, "same text again and again", "hot")] * 5000 + [(10_000 + i, f"only long ones {i} " * 2000, "long") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert {r["lang_pred"] for r in got} >= {f"l{i}" for i in range(90)} | {"long"}
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.95 * len(got)
    assert language_id.language_id(docs.where("doc_id is null")).where("lang_pred = 'hot'").count() == 5000


@pytest.mark.parametrize("frequent", [1 << 19, 7])
def test_lm_scores(docs, empty, frequent):
    rows = rows_of(docs)
    words = [[*WORD.findall((t or "").translate(FOLD)), 0] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(w for ws, x in zip(words, held, strict=True) if not x for w in ws)
    total = sum(c.values())
    model = lm_scoring.lattice(public_tokenizers.path(lm_scoring.PIECES))
    kinds = list({w for ws in words for w in ws} - {0})
    log = dict(zip(kinds, model.score(kinds) + lm_scoring.WORD_LATTICE, strict=True)) | {0: lm_scoring.END_LATTICE}
    a = len(c)  # Witten and Bell
    base = lambda ws: sum(np.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws)
    score = lambda ws: sum(np.logaddexp(np.log(c[w]) if c[w] else -np.inf, np.log(a) + log[w]) / np.log(10) - np.log10(total + a) for w in ws)
    want = sorted((str(i), x, len(ws), sum(c[w] > 0 for w in ws), total, round(base(ws), 3), round(score(ws), 3)) for (i, _), x, ws in zip(rows, held, words, strict=True))
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted((str(r["doc_id"]), *(round(r[n], 3) if isinstance(r[n], float) else r[n] for n in names)) for r in lm_scoring.lm_scores(docs, frequent=frequent).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=0.01)
    assert lm_scoring.lm_scores(empty).count() == 0


def test_lattice_sums_all_segmentations():
    model = lm_scoring.Lattice(public_tokenizers.path(lm_scoring.PIECES))

    def spell(s):
        if not s:
            return 1.0
        own = np.exp(len(s[0].encode()) * model.byte) * spell(s[1:])
        return own + sum(np.exp(model.pieces[s[:n]]) * spell(s[n:]) for n in range(1, len(s) + 1) if s[:n] in model.pieces)

    assert abs(sum(map(np.exp, model.pieces.values())) + 256 * np.exp(model.byte) - 1) < 1e-9
    for w in ("the", "thanes", "éñ中", "x"):
        assert abs(model.score([w])[0] - np.log(spell("▁" + w))) < 1e-9


def brute_components(rows, least=80):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for n, (i, s) in enumerate(flat):
        for j, z in flat[:n]:
            both = len(s & z)
            if 100 * both >= least * (len(s) + len(z) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, find


@pytest.mark.parametrize("short,block", [(64, 2048), (2, 3)])
def test_jaccard(spark, docs, empty, monkeypatch, short, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    # a chain and a star of near copies: each differs from its neighbour a little, ends from each other much
    words = [f"w{k}" for k in range(140)]
    chain = [(500 + k, " ".join(words[2 * k : 2 * k + 60])) for k in range(20)]
    star = [(600 + k, " ".join("zz" if m in (7 * k + 1, 7 * k + 3) else f"v{m}" for m in range(150))) for k in range(20)]
    both = docs.select("doc_id", "text", "h", "n").unionByName(spark.createDataFrame([(i, t, 1, 1) for i, t in chain + star], "doc_id long, text string, h long, n int"))
    rows = rows_of(both)
    sets, find = brute_components(rows)
    got = jaccard.jaccard_components(both).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"])), r
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns and one.where("doc_id is not null").count() == len({find(i) for i, _ in rows_of(docs) if i is not None})
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_stars_with_a_late_centre(spark):
    # one edit each: all link with the centre, none with each other, and some share the centre's whole prefix
    rows, r = [], random.Random(11)
    for star in range(8):
        centre = [f"s{star}w{k}" for k in range(60)]
        edited = r.sample(range(5, 55), 30)
        rows += [(1000 * star + i, " ".join([*centre[:k], f"s{star}e{k}", *centre[k + 1 :]])) for i, k in enumerate(edited)]
        rows.append((1000 * star + 999, " ".join(centre)))
    _, find = brute_components(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r for r in got if r["component_id"] != find(r["doc_id"])] == []
    assert len({r["component_id"] for r in got}) == 8


def test_hashes_equal_those_of_spark(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63), 123456789012345], np.int64)
    want = {r["id"]: r["h"] for r in spark.createDataFrame([(int(i),) for i in x], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    assert [want[i] for i in x] == common.signed(common.xxhash64(x)).tolist()


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.joined_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
