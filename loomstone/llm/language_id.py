"""Language identification with string kernels.

The kernel of two texts is the cosine of their presence vectors over all n-grams of
lengths 1 to 3 of their lower-cased bytes (a blended spectrum).  A bounded sample of
training rows gives, a few rows for each language, the landmarks.  Kernels with the
landmarks, whitened by the landmarks' own kernel (Nystroem), are the features of one
ridge regression for each language against the rest.

A kernel with a landmark is a sum over the n-grams that both have, so the landmarks,
the whitening and the regressions multiply out to one matrix, a row of weights for each
n-gram of any landmark; n-grams of no landmark count in the norm alone.  Prediction is
the product of a batch's presence rows, as lists of n-grams, with that matrix.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import common

FOLDS, HELD_OUT = 4, 2
#: Bounds of the sample: rows for each language and of all together, characters of a row that are learned from and of all together.
ROWS, ALL_ROWS, CHARS, ALL_CHARS = 300, 19_200, 20_000, 1 << 25
#: Landmarks for each language and (but one for each) of all together, ridge.
LANDMARKS, ALL_LANDMARKS, RIDGE = 24, 1536, 1e-2
#: How sharply the scores of the languages are turned into a share.
SHARP = 8.0
#: Bytes of a text that are numbered at once.
PIECE = 1 << 20
_MAYBE = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Letters are found by a pattern that also finds numbers such as fractions; those don't count."""
    return any(m.group().isalpha() for m in _MAYBE.finditer(text))


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def codes(raw: bytes) -> np.ndarray:
    """The distinct n-grams of lengths 1 to 3 as numbers: bytes below the length's own offset."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    out = [b]
    if len(b) > 1:
        out.append(256 + (b[:-1] << 8 | b[1:]))
    if len(b) > 2:
        out.append(256 + 65536 + (b[:-2] << 16 | b[1:-1] << 8 | b[2:]))
    return np.concatenate(out)


ALL = 256 + 65536 + (1 << 24)


class Grams:
    """Finds distinct n-grams with one array over all of them that is never cleared: the last place that wrote an n-gram keeps it."""

    def __init__(self):
        self.last = np.zeros(ALL, np.int32)

    def of(self, raw: bytes) -> np.ndarray:
        if len(raw) <= PIECE:
            return self._piece(raw)
        seen, out = np.zeros(ALL, bool), []
        for i in range(0, len(raw), PIECE):  # with two bytes more, so that no n-gram is lost
            x = self._piece(raw[i : i + PIECE + 2])
            out.append(x[~seen[x]])
            seen[x] = True
        return np.concatenate(out)

    def _piece(self, raw: bytes) -> np.ndarray:
        x = codes(raw)
        at = np.arange(len(x), dtype=np.int32)
        self.last[x] = at
        return x[self.last[x] == at]


class Model:
    """Everything that a prediction needs: n-grams of the landmarks, sorted, with their weights for each language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs, finder = sorted(set(langs)), Grams()
        sets = [finder.of(folded(t)) for t in texts]
        y = np.array([self.langs.index(lang) for lang in langs], np.int64)
        each = max(1, min(LANDMARKS, ALL_LANDMARKS // max(1, len(self.langs))))
        marks = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(self.langs))]) if self.langs else np.zeros(0, np.int64)
        # pairs of n-gram and landmark, by n-gram
        code = np.concatenate([sets[m] for m in marks]) if len(marks) else np.zeros(0, np.int64)
        mark = np.repeat(np.arange(len(marks)), [len(sets[m]) for m in marks])
        order = np.argsort(code, kind="stable")
        code, mark = code[order], mark[order]
        self.grams, start = np.unique(code, return_index=True)
        count = np.diff(start, append=len(code))
        size = np.sqrt(np.array([max(1, len(s)) for s in sets], float))

        def kernel(k: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(self.grams, sets[k]), max(0, len(self.grams) - 1))
            at = at[self.grams[at] == sets[k]] if len(self.grams) else at[:0]
            _, place = common.segments(count[at])
            return np.bincount(mark[np.repeat(start[at], count[at]) + place], minlength=len(marks)) / (size[k] * size[marks])

        x = np.stack([kernel(k) for k in range(len(sets))]) if sets else np.zeros((0, 0))
        value, vector = np.linalg.eigh(x[marks]) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
        keep = value > 1e-8 * max(value.max(initial=0.0), 1e-12)
        white = vector[:, keep] / np.sqrt(value[keep])
        z = np.concatenate((x @ white, np.ones((len(x), 1))), axis=1) if len(marks) else np.zeros((0, 1))
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = np.bincount(y, minlength=len(self.langs)).astype(float)
        w = (len(y) / (len(self.langs) * weight))[y] if len(y) else np.zeros(0)
        a = (z * w[:, None]).T @ z + RIDGE * len(y) * np.eye(z.shape[1]) / max(1, z.shape[1])
        beta = np.linalg.solve(a + 1e-9 * np.eye(len(a)), (z * w[:, None]).T @ target) if len(marks) else np.zeros((1, 0))
        alpha, self.bias = (white @ beta[:-1]) / size[marks][:, None], beta[-1]
        of = np.repeat(np.arange(len(self.grams)), count)
        self.weights = np.stack([np.bincount(of, alpha[mark, k], len(self.grams)) for k in range(len(self.langs))] or [np.zeros(len(self.grams))], axis=1).astype(np.float32)

    def lookup(self) -> np.ndarray:
        """The place of each n-gram; those of no landmark have the place after the last, whose weights are 0."""
        out = np.full(ALL, len(self.grams), np.int32)
        out[self.grams] = np.arange(len(self.grams))
        return out


class Predictor:
    def __init__(self, model: Model):
        self.model, self.lookup, self.finder = model, model.lookup(), Grams()
        self.weights = np.concatenate((model.weights, np.zeros((1, model.weights.shape[1]), np.float32)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of regression values for each text."""
        sets = [self.finder.of(folded(t)) for t in texts]
        sizes = np.array([len(s) for s in sets])
        rows = self.weights[self.lookup[np.concatenate(sets)]]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64) / np.sqrt(sizes)[:, None] + self.model.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = [k for k, t in enumerate(texts) if t and self.model.langs and has_letter(t)]
        label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if ok:
            f = self.scores([texts[k] for k in ok])
            p = np.exp(SHARP * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            best = f.argmax(axis=1)
            for k, b, s in zip(ok, best, p[np.arange(len(ok)), best], strict=True):
                label[k], score[k] = self.model.langs[b], s
        return label, score


_PREDICTORS: dict[int, Predictor] = {}


def fold(key):
    """crc32 of the id as text, modulo the folds; a null id is outside every fold."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(FOLDS))


def train(docs: DataFrame) -> Model:
    """From (doc_id, text, lang): a bounded sample, by the hash of the text, of the rows outside the held-out fold.

    Every value of lang is learned.  Equal texts of a language are one row; of a text
    longer than CHARS its first ones are learned from.  The driver gets at most
    ROWS rows of a language, ALL_ROWS (or one for each language) and ALL_CHARS together.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("kinds"))
    n = max(1, kinds.count())
    each = max(1, min(ROWS, ALL_ROWS // n))
    share = F.pmod("h", F.lit(1 << 30)).cast("double") * F.col("kinds") <= F.lit(2.0 * each * (1 << 30))
    few = rows.join(F.broadcast(kinds) if n <= 10_000 else kinds, "lang").where((F.col("kinds") <= 8 * each) | share)
    few = few.groupBy("lang", "h").agg(F.min(F.substring("text", 1, CHARS)).alias("text"))
    w = Window.partitionBy("lang").orderBy((F.length("text") >= CHARS), F.pmod("h", F.lit(1 << 30)), "h")
    few = few.withColumns({"k": F.row_number().over(w), "chars": F.sum(F.length("text")).over(w)})
    taken = few.where((F.col("k") <= each) & ((F.col("k") == 1) | (F.col("chars") <= ALL_CHARS // n))).orderBy("lang", "k").select("lang", "text").toArrow()
    return Model(taken["text"].to_pylist(), taken["lang"].to_pylist())


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs.

    A null text, or one without a letter, is ``und`` with score 0, as is every text
    where there is nothing to learn from.  A null id is training data.  Repeated rows
    get a row each.  A long text is read whole.  Other columns are not read.
    """
    docs = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def make(batch: pa.RecordBatch):
        m = model.value
        if id(m) not in _PREDICTORS:
            _PREDICTORS.clear()
            _PREDICTORS[id(m)] = Predictor(m)
        for at, end, _, _ in common.chunks(batch.column(1)):
            label, score = _PREDICTORS[id(m)].predict(batch.column(1)[at:end].to_pylist())
            held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in batch.column(0)[at:end].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array(held), pa.array(label), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return common.per_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.table(spark, sf_dir, "documents"))
