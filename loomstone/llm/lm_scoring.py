"""Language-model scores of whole texts: the marginal probability of a lattice of subwords.

A text is spelled by pieces of an existing vocabulary, a word's first one beginning with
its boundary mark, and by whole words of the training texts, which are arcs of the
lattice like any other.  All segmentations count: the forward recursion in log space adds, at every
character, the probabilities of all arcs that end there times those of what comes before
them.  The vocabulary's scores order its pieces by rank, and a piece of rank r weighs
1 / (r + 2.7), Mandelbrot's form of Zipf's law; a character without a piece is spelled in
its bytes.  All pieces together have the share V / (N + V) and a word's arc c / (N + V): c
its count in the training texts, N that of all tokens and V of distinct ones (Witten and
Bell's estimate of what is new).  The end of a text is a token with an arc too, beside a
share END_SHARE of the pieces'.  As a word ends where a boundary mark follows, pieces spell words
with a total probability of 1, and so all tokens together have 1.

Counts are exact and cover all training texts.  The most frequent words, a bounded
number, are looked up where the texts are; the other words of each document are
joined with the table of counts.
"""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common

PIECES = "piece_bpe_32k.model"
#: Words that are looked up without a join, at most.
FREQUENT = 1 << 19
FOLDS, HELD_OUT = 7, 2
#: Words whose spelling a worker remembers, at most; then it starts anew.
MEMORY = 1 << 20
#: Longer words are spelled one at a time, with the last few sums alone in memory.
WORD_CHARS = 64
#: The end of a text counts as a token; this is its hash.
END = np.uint64(0x5D1E0F7EA3C9B241)
END_SHARE = 1e-3
END_LATTICE, WORD_LATTICE = np.log(END_SHARE), np.log1p(-END_SHARE)
LOG10 = float(np.log(10.0))


class Lattice:
    """Unigram subword probabilities and the marginal probability of words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
        rank = {i: r for r, i in enumerate(sorted((i for i in ids if not sp.is_byte(i)), key=lambda i: -sp.get_score(i)))}
        tail = len(rank)
        weight = {i: 1.0 / (rank.get(i, tail) + 2.7) for i in ids}
        total = np.log(sum(weight.values()))
        self.pieces = {sp.id_to_piece(i): np.log(w) - total for i, w in weight.items() if not sp.is_byte(i)}
        self.byte = np.log(1.0 / (tail + 2.7)) - total
        self.longest = max(map(len, self.pieces))
        keys = np.array([_text_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self.seen, self.seen_logs = np.zeros(0, np.uint64), np.zeros(0)
        self.keys, self.logs = keys[order], np.array(list(self.pieces.values()))[order]

    def remembered(self, h: np.ndarray, spell) -> np.ndarray:
        """score() by hash: spell(places) gives the words that the bounded memory lacks. h is sorted."""
        place = np.searchsorted(self.seen, h)
        known = np.zeros(len(h), bool)
        inside = place < len(self.seen)
        known[inside] = self.seen[place[inside]] == h[inside]
        out = np.zeros(len(h))
        out[known] = self.seen_logs[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.score(spell(new))
            if len(self.seen) + len(new) > MEMORY:
                self.seen, self.seen_logs = h[new], out[new]
            else:
                self.seen, self.seen_logs = np.insert(self.seen, place[new], h[new]), np.insert(self.seen_logs, place[new], out[new])
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Natural logs of the words' probabilities, all words of one length at once."""
        out = np.zeros(len(words))
        long = [k for k, w in enumerate(words) if len(w) > WORD_CHARS]
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= WORD_CHARS:
                by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            chars = np.frombuffer("".join(words[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
            out[at] = self._forward(np.concatenate((np.full((len(at), 1), 0x2581, np.uint32), chars), axis=1))
        for k in long:
            out[k] = self._rolling("\u2581" + words[k])
        return out

    def _rolling(self, word: str) -> float:
        """_forward of one word of any length: a sum needs only the last ``longest`` ones before it."""
        alpha = collections.deque([0.0], self.longest)
        for j in range(1, len(word) + 1):
            c = ord(word[j - 1])
            logs = [alpha[-1] + (1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4) * self.byte]
            for n in range(1, len(alpha) + 1):
                log = self.pieces.get(word[j - n : j])
                if log is not None:
                    logs.append(alpha[-n] + log)
            top = max(logs)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in logs)))
        return alpha[-1]

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        rows, n = chars.shape
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        size = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        # hashes of the pieces that start at i, grown by one character at a time
        for i in range(n):
            h = np.zeros(rows, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * _STEP + chars[:, j] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                log = np.where(hit, self.logs[at], -np.inf)
                if j == i:
                    log = np.logaddexp(log, size[:, i] * self.byte)
                if hit.any() or j == i:
                    alpha[j + 1] = np.logaddexp(alpha[j + 1], alpha[i] + log)
        return alpha[n]


_STEP = np.uint64(0xC6A4A7935BD1E995)


def _text_hash(text: str) -> np.uint64:
    h = 0
    for c in text:
        h = (h * int(_STEP) + ord(c) + 1) % (1 << 64)
    return np.uint64(h)


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves the fold's remainder; a null id is training text."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    first, length, row = common.words(data, offsets)
    return common.word_hashes(data, first, length, common.LOWER), first, length, row


def training_counts(docs: DataFrame) -> DataFrame:
    """(h, c): the tokens of all training texts, ends included."""

    def make(batch: pa.RecordBatch):
        train = ~held_out(batch.column(0).to_pylist())
        for at, end, data, offsets in common.chunks(batch.column(1), 4 * common.CHUNK_BYTES):
            h, _, _, row = _tokens(data, offsets)
            h = np.concatenate((h[train[at:end][row]], np.full(int(train[at:end].sum()), END)))
            value, n = common.distinct(h)
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(value)), pa.array(n)], ["h", "c"])

    return common.per_batch(docs, make, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def lm_scores(docs: DataFrame, pieces: str | None = None, smoothing: float | None = None, frequent: int = FREQUENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Scores are log10.  A null or wordless text is its end alone.  Repeated rows get a
    row each and count as often in training.  A null id is training text.  Without
    training texts all counts are 0, the base score is 0 and the score the lattice's.  A text and each of its words
    are read whole.  Other columns are not read.
    """
    if pieces is None:
        import public_tokenizers

        pieces = public_tokenizers.path(PIECES)
    spark = docs.sparkSession
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    counts = common.settled(training_counts(docs))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    smoothing = float(max(kinds, 1)) if smoothing is None else smoothing
    ends = counts.where(F.col("h") == F.lit(int(END.astype(np.int64)))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    first = common.most_frequent(counts, frequent, "c")
    top_h, top_c = (x.astype(np.int64) for x in common.arrays(first))
    order = np.argsort(top_h.view(np.uint64))
    known = spark.sparkContext.broadcast((top_h.view(np.uint64)[order], top_c[order]))
    complete = len(top_h) == kinds  # then no word is left for the join

    def make(batch: pa.RecordBatch):
        model = lattice(pieces)
        keys, cs = known.value
        ids = batch.column(0).to_pylist()
        out = held_out(ids)
        tags = batch.column(2)
        for at, end, data, offsets in common.chunks(batch.column(1)):
            rows = end - at
            h, first, length, row = _tokens(data, offsets)
            # distinct words of the chunk, spelled once
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
            kind = np.zeros(len(h), np.int64)
            kind[order] = np.cumsum(new) - 1
            one = order[new]
            raw = common.LOWER[data].tobytes()
            log = WORD_LATTICE + model.remembered(h[one], lambda new, raw=raw, one=one, first=first, length=length: [raw[first[k] : first[k] + length[k]].decode("utf-8", "replace") for k in one[new]])
            place = np.minimum(np.searchsorted(keys, h[one]), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(one), np.int64)
            found = keys[place] == h[one] if len(keys) else np.zeros(len(one), bool)
            count = np.where(found, cs[place], 0) if len(keys) else np.zeros(len(one), np.int64)
            done = found | complete
            # each row's distinct words with their number
            pair, n = common.distinct(row.astype(np.uint64) << np.uint64(32) | kind.astype(np.uint64))
            of, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            e = ends
            base = np.full(rows, np.log10((e + 1) / (total + kinds + 1)))
            score = np.full(rows, _mix(e, END_LATTICE, total, smoothing))
            hits = np.full(rows, int(e > 0))
            local = done[word]
            o, w, k = of[local], word[local], n[local]
            np.add.at(base, o, k * np.log10((count[w] + 1) / (total + kinds + 1)))
            np.add.at(score, o, k * _mix(count[w], log[w], total, smoothing))
            np.add.at(hits, o, k * (count[w] > 0))
            tokens = np.bincount(row, minlength=rows) + 1
            far = ~local
            starts = np.searchsorted(of[far], np.arange(rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v)) for v in (common.signed(h[one][word[far]]), n[far].astype(np.int32), log[word[far]].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], tags[at:end], pa.array(out[at:end]), pa.array(tokens), pa.array(hits), pa.array(base), pa.array(score), *lists], ["doc_id", "r", "held_out", "n_tokens", "n_known", "base_score", "score", "h", "n", "log"])

    rows = common.per_batch(docs.withColumn("r", F.monotonically_increasing_id()), make, "doc_id long, r long, held_out boolean, n_tokens long, n_known long, base_score double, score double, h array<long>, n array<int>, log array<float>")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    if not complete:
        # one row for each word that is looked up by a join; the first one, or a row without a word, carries what the text has so far
        rest = counts.join(first.select("h"), "h", "left_anti")
        one = lambda x: F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(x)).alias(x)
        words = rows.select(*names, "r", F.posexplode_outer(F.arrays_zip("h", "n", "log")).alias("pos", "x"))
        words = words.select("r", *map(one, names), F.coalesce("x.h", F.xxhash64("r")).alias("h"), "x.n", F.col("x.log").cast("double").alias("log"))
        c = F.coalesce("c", F.lit(0)).cast("double")
        n = F.coalesce("n", F.lit(0))
        far = words.join(rest, "h", "left").select(
            "r",
            *names[:3],
            (F.coalesce("n_known", F.lit(0)) + n * (c > 0).cast("long")).alias("n_known"),
            (F.coalesce("base_score", F.lit(0.0)) + n * F.log10((c + 1) / F.lit(float(total + kinds + 1)))).alias("base_score"),
            (F.coalesce("score", F.lit(0.0)) + F.coalesce(n * (F.when(c > 0, F.log10(c + smoothing * F.exp("log"))).otherwise((F.col("log") + float(np.log(smoothing))) / LOG10) - float(np.log10(total + smoothing))), F.lit(0.0))).alias("score"),
        )
        rows = far.groupBy("r").agg(*(F.max(x).alias(x) for x in names[:3]), *(F.sum(x).alias(x) for x in names[3:]))
    return rows.select(*names).withColumn("train_tokens", F.lit(int(total)).cast("long"))


def _mix(c, log, total: int, smoothing: float):
    """log10 of the smoothed probability; for a word that no count knows, from logs alone."""
    c = np.asarray(c, float)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c), np.log(smoothing) + log) / LOG10 - np.log10(total + smoothing)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"))
