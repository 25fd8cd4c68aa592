"""Alignment of two tokenizers' tokens over the bytes they share.

Each byte of a text has an owner among A's tokens and one among B's: both arrays are
``np.repeat`` of token numbers by their lengths in bytes.  Where the pair of owners
changes a new overlap (a link) starts; where both change at once both tokenizers cut,
and a group of tokens ends.

Neither tokenizer joins what a space after other than white space separates: A's
pre-tokens begin there, and no piece of B has its space mark inside.  So a text is
taken as segments that begin with a space, each distinct one is encoded once for each
chunk of texts, and what a text has is the sum over its segments.  A text without
such spaces is one segment.

The texts are read once: what each one has is stored, with its distinct pairs of ids,
and links are summed for each pair over the corpus.  Then the sums are looked up,
those of the most frequent pairs in place, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import common

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that a worker remembers, twice as many at most, and the longest of them in characters.
MEMORY, LONG = 300_000, 48
#: Pairs of ids whose sums are looked up in place: 2^21 at most, two arrays of 16 MB.
FREQUENT = 1 << 21
#: A segment starts at a space that follows other than white space and does not end the text.
_START = re.compile(r"(?<=\S)(?= .)", re.S)
#: Segments that may be encoded in one call: of ASCII and Latin letters, without white space at their end.
_LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*[!-~À-ÖØ-öø-ɏ]")
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizers:
    """Both libraries, and the bytes of every entry of their vocabularies."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        shown = {token: token.encode() if token in special else bytes(byte[c] for c in token) for token in vocab}
        self.a_table = Table({vocab[token]: raw for token, raw in shown.items()})
        size = self.b.get_piece_size()
        self.b_table = Table({k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.b.id_to_piece, range(size)))})
        self.digits = Table({k: str(k).encode() + b"," for k in range(max(size, len(self.a_table.size)))})
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        first = vocab[merged[0]]
        #: The same merges by ranks, for Latin segments: much quicker, and their letters are the same in all editions of Unicode.
        self.quick = None
        if all(vocab[m] == first + k for k, m in enumerate(merged)) and all(vocab[t] < first for t in vocab if len(t) == 1):
            self.quick = tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks={raw: vocab[t] for t, raw in shown.items() if t not in special}, special_tokens={})
        #: Whether segments may be encoded apart.
        self.apart = not any("▁" in self.b.id_to_piece(k).lstrip("▁") for k in range(size))
        self.young: dict[str, Segment | None] = {}
        self.old: dict[str, Segment | None] = {}

    def _ids_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each text)."""
        easy = np.fromiter((self.quick is not None and _LATIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        n, lists = np.zeros(len(texts), np.int64), []
        if easy.any():
            # one call: a segment ends where a pre-token does, and ids go back to segments by their bytes
            raw = [texts[k].encode() for k in np.flatnonzero(easy)]
            ids = self.quick.encode_to_numpy(b"".join(raw).decode()).astype(np.int64)
            ends = np.searchsorted(np.cumsum(self.a_table.size[ids]), np.cumsum(list(map(len, raw))), "left") + 1
            n[easy] = np.diff(ends, prepend=0)
            lists.append(ids)
        if not easy.all():
            rest = [x.ids for x in self.a.encode_batch_fast([texts[k] for k in np.flatnonzero(~easy)], add_special_tokens=False)]
            n[~easy] = list(map(len, rest))
            lists.append(np.fromiter(chain.from_iterable(rest), np.int64))
        where = np.concatenate((np.flatnonzero(easy), np.flatnonzero(~easy)))
        order = np.argsort(np.repeat(where, n[where]), kind="stable")
        return np.concatenate(lists)[order], n

    def segments(self, texts: list[str]) -> dict[str, Segment | None]:
        """The texts (each begins with a space) as aligned segments; None where a tokenizer does not give the bytes back."""
        ids_a, n_a = self._ids_a(texts)
        lists = self.b.encode([t[1:] for t in texts], num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        good = size > 1
        for table, ids, n in ((self.a_table, ids_a, n_a), (self.b_table, ids_b, n_b)):
            ends = np.concatenate(([0], np.cumsum(table.size[ids])))[np.cumsum(n)]
            good &= np.diff(ends, prepend=0) == size
            same = table.joined(ids)
            if len(same) == len(data) and good.all():
                wrong = np.flatnonzero(same != data)
                good[np.searchsorted(np.cumsum(size), wrong, "right")] = False
            else:
                for k in np.flatnonzero(good):
                    good[k] = same[ends[k] - size[k] : ends[k]].tobytes() == raw[k]
        out: dict[str, Segment | None] = dict.fromkeys(texts)
        keep = np.flatnonzero(good)
        if len(keep):
            parts = self._aligned(ids_a[np.repeat(good, n_a)], n_a[good], ids_b[np.repeat(good, n_b)], n_b[good])
            out.update(zip((texts[k] for k in keep), parts, strict=True))
        return out

    def _aligned(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> list[Segment]:
        """Owner arrays of all segments at once; the ends of a segment are cuts of both."""
        owner_a = np.repeat(np.arange(len(ids_a)), self.a_table.size[ids_a])
        owner_b = np.repeat(np.arange(len(ids_b)), self.b_table.size[ids_b])
        new_a, new_b = np.diff(owner_a, prepend=-1) > 0, np.diff(owner_b, prepend=-1) > 0
        at = np.flatnonzero(new_a | new_b)
        link_a, link_b = owner_a[at], owner_b[at]
        keys = ids_a[link_a] << 20 | ids_b[link_b]
        cut = np.flatnonzero(new_a & new_b)
        first_a, first_b = np.append(owner_a[cut], len(ids_a)), np.append(owner_b[cut], len(ids_b))
        # the digest's text: a group's ids of A, then of B, each followed by a mark
        of_a, of_b = np.repeat(np.arange(len(cut)), np.diff(first_a)), np.repeat(np.arange(len(cut)), np.diff(first_b))
        place_a, place_b = np.arange(len(ids_a)) + first_b[of_a], np.arange(len(ids_b)) + first_a[of_b + 1]
        both = np.empty(len(ids_a) + len(ids_b), np.int64)
        both[place_a], both[place_b] = ids_a, ids_b
        text, ends = self.digits.joined(both), np.cumsum(self.digits.size[both])
        text[ends[place_a[first_a[1:] - 1]] - 1] = ord("|")
        text[ends[place_b[first_b[1:] - 1]] - 1] = ord(";")
        text = text.tobytes()
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        groups, links, bytes_ = (np.concatenate(([0], x)).tolist() for x in (np.searchsorted(first_a, ends_a), np.searchsorted(link_a, ends_a), ends[ends_a + ends_b - 1]))
        links, keys = [8 * x for x in links], keys.tobytes()
        return [Segment(a, b, g1 - g0, text[t0 : t1 - 1], keys[l0:l1]) for a, b, g0, g1, t0, t1, l0, l1 in zip(n_a.tolist(), n_b.tolist(), groups, groups[1:], bytes_, bytes_[1:], links, links[1:], strict=False)]

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, list[Segment | None]]:
        """(the number of the distinct segment for each one in turn, with -1 where a text ends; the distinct segments' alignments)."""
        place: dict[str, int] = {}
        turn = []
        for t in texts:
            if t:
                turn += [place.setdefault(s, len(place)) for s in self.split(" " + t)]
            turn.append(-1)
        names = list(place)
        found = list(map(self._remembered, names))
        new = [k for k, x in enumerate(found) if x is _NEW]
        if new:
            made = self.segments([names[k] for k in new])
            for k in new:
                found[k] = made[names[k]]
                if len(names[k]) <= LONG:
                    self.young[names[k]] = found[k]
            if len(self.young) > MEMORY:
                self.old, self.young = self.young, {}
        return np.asarray(turn, np.int64), found

    def _remembered(self, segment: str):
        """What is known of a segment; what was not asked for between two clearings is forgotten."""
        x = self.young.get(segment, _NEW)
        if x is _NEW and (x := self.old.get(segment, _NEW)) is not _NEW:
            self.young[segment] = x
        return x

    def split(self, text: str) -> list[str]:
        return _START.split(text) if self.apart else [text]


class Table:
    """Byte strings by number, laid end to end."""

    def __init__(self, entries: dict[int, bytes]):
        rows = [entries.get(k, b"") for k in range(max(entries) + 1)]
        self.size = np.array(list(map(len, rows)), np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        starts, within = common.segments(size)
        return self.data[np.repeat(self.first[ids], size) + within]


class Segment:
    """What one segment adds to its text: tokens of A and B, groups and their digest text, and the pair of ids of each link."""

    __slots__ = ("a", "b", "groups", "keys", "shown")

    def __init__(self, a: int, b: int, groups: int, shown: bytes, keys: bytes):
        self.a, self.b, self.groups, self.shown, self.keys = a, b, groups, shown, keys


_NEW = object()
_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _loaded(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)
    return a, b


class Sums:
    """Counts by key, folded together now and then."""

    def __init__(self, most: int = 1 << 20):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            keys, counts = self.rows()
            self.keys, self.counts, self.held = [keys], [counts], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        return keys[order][first], np.add.reduceat(counts[order], first)


def _rows(turn: np.ndarray, found: list[Segment | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the distinct segment) of each segment in turn; the row is -1 where one of its segments has no alignment."""
    inside = turn >= 0
    rows, kinds = np.cumsum(~inside)[inside], turn[inside]
    bad = np.fromiter((x is None for x in found), bool, len(found))
    if bad.any():
        rows = np.where(np.isin(rows, rows[bad[kinds]]), -1, rows)
    return rows, kinds


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _lists(offsets: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in columns]


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each row of (doc_id, text) aligned by itself: its figures, its digest, its distinct pairs of ids (key = A's id * 2^20 + B's id) with their number.

    Besides, one row for each batch has the sums of its texts' links in ``all_keys`` and
    ``all_n``, so that the corpus need not be taken apart again to be summed.
    """

    def make(batch: pa.RecordBatch):
        both, sums = _loaded(paths), Sums()
        none = np.zeros(0, np.int64)
        for at, end, _, _ in common.chunks(batch.column(1)):
            rows = end - at
            turn, found = both.words(batch.column(1)[at:end].to_pylist())
            row, kind = _rows(turn, found)
            kind, row = kind[row >= 0], row[row >= 0]
            size = np.fromiter((len(s.keys) // 8 if s else 0 for s in found), np.int64, len(found))
            flat = np.frombuffer(b"".join([s.keys for s in found if s]), np.int64)
            many = np.repeat(np.bincount(kind, minlength=len(found)), size)
            sums.add(flat[many > 0], many[many > 0])  # others are of texts without tokens
            starts = np.searchsorted(row, np.arange(rows + 1))
            adds = [*(np.fromiter((getattr(s, x) if s else 0 for s in found), np.int64, len(found)) for x in ("a", "b", "groups")), size]
            figures = [np.diff(np.concatenate(([0], np.cumsum(x[kind])))[starts]) for x in adds]
            shown, kinds, digest = [s.shown if s else b"" for s in found], kind.tolist(), []
            for i, j in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                digest.append(hashlib.sha256(b";".join([shown[k] for k in kinds[i:j]])).hexdigest() if j > i else "")
            # the distinct pairs of each row, as (row, place among the chunk's pairs) in one number
            value, code = np.unique(flat, return_inverse=True)
            _, within = common.segments(size[kind])
            own = code[np.repeat((np.cumsum(size) - size)[kind], size[kind]) + within]
            pair, n = common.distinct(np.repeat(row, size[kind]) * max(len(value), 1) + own)
            of = pair // max(len(value), 1)
            lists = _lists(np.searchsorted(of, np.arange(rows + 1)), value[pair % max(len(value), 1)], n.astype(np.int32))
            nothing = pa.nulls(rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, bool)), batch.column(0)[at:end], *map(pa.array, figures), pa.array(digest), *lists, nothing, nothing], names)
        keys, n = sums.rows()
        if len(keys):
            blank = [pa.nulls(1, t) for t in (pa.int64(), *[pa.int64()] * len(FIGURES), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([True]), *blank, *_lists(np.array([0, len(keys)]), keys, n)], names)

    names = ["sums", "doc_id", *FIGURES, "groups_sha256", "keys", "n", "all_keys", "all_n"]
    return common.per_batch(docs, make, f"sums boolean, doc_id long, {', '.join(f'{x} long' for x in FIGURES)}, groups_sha256 string, keys array<long>, n array<int>, all_keys array<long>, all_n array<long>")


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None, frequent: int = FREQUENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    A null or empty text, or one whose bytes a tokenizer does not give back (as where it
    holds U+2581), has no tokens: zeros and an empty digest.  Repeated rows get a row
    each and their links count as often; a null id is passed on.  A text is read whole,
    whatever its length, and one without spaces is one segment.  An empty table gives
    no rows.  Other columns are not read.
    """
    paths, spark = _paths(a, b), docs.sparkSession
    rows = common.stored(aligned(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), paths))
    counts = common.settled(rows.where("sums").select(F.explode(F.arrays_zip("all_keys", "all_n")).alias("x")).groupBy(F.col("x.all_keys").alias("key")).agg(F.sum("x.all_n").alias("c")))
    b_id = F.col("key").bitwiseAND((1 << 20) - 1)
    ranked = common.settled(counts.withColumn("b", b_id).join(counts.groupBy(b_id.alias("b")).agg(F.max("c").alias("most")), "b").select("key", "c", (F.col("c") == F.col("most")).alias("best")))
    first = common.most_frequent(ranked, frequent, "c")
    keys, c, is_best = common.arrays(first)
    order = np.argsort(keys.astype(np.int64))
    known = spark.sparkContext.broadcast((keys.astype(np.int64)[order], (c.astype(np.int64) << 1 | is_best.astype(np.int64))[order]))
    complete = len(keys) == ranked.count()  # then no link is left for the join

    def make(batch: pa.RecordBatch):
        keys, c = known.value
        offsets = batch.column("keys").offsets.to_numpy().astype(np.int64)
        flat, n = (batch.column(x).values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for x in ("keys", "n"))
        offsets = offsets - offsets[0]
        spot = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
        hit = keys[spot] == flat if len(keys) else np.zeros(len(flat), bool)
        value = np.where(hit, c[spot], 0) if len(keys) else np.zeros(len(flat), np.int64)
        n_best, total = (np.diff(np.concatenate(([0], np.cumsum(x * n)))[offsets]) for x in (value & 1, value >> 1))
        left = np.concatenate(([0], np.cumsum(~hit)))[offsets]
        kept = [batch.column(x) for x in ("doc_id", *FIGURES, "groups_sha256", "r")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(total), *_lists(left, flat[~hit], n[~hit].astype(np.int64))], ["doc_id", *FIGURES, "groups_sha256", "r", "n_best", "count_sum", "key", "n"])

    columns = ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"]
    rows = rows.where("not sums").select("doc_id", *FIGURES, "groups_sha256", "keys", "n", F.monotonically_increasing_id().alias("r"))
    rows = common.per_batch(rows, make, f"doc_id long, {', '.join(f'{x} long' for x in FIGURES)}, groups_sha256 string, r long, n_best long, count_sum long, key array<long>, n array<long>")
    if complete:
        return rows.select(*columns)
    # one row for each pair that is looked up by a join; the first one, or a row without any, carries what the text has so far
    rest = ranked.join(first.select("key"), "key", "left_anti")
    carried = lambda x: F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(x)).alias(x)
    links = rows.select(*columns, "r", F.posexplode_outer(F.arrays_zip("key", "n")).alias("pos", "x"))
    links = links.select("r", *map(carried, columns), F.coalesce("x.key", -1 - F.col("r")).alias("key"), F.coalesce("x.n", F.lit(0)).alias("n")).join(rest, "key", "left")
    n, zero = F.col("n"), F.lit(0)
    links = links.withColumns({"n_best": F.coalesce("n_best", zero) + n * F.coalesce(F.col("best"), F.lit(False)).cast("long"), "count_sum": F.coalesce("count_sum", zero) + n * F.coalesce("c", zero)})
    return links.groupBy("r").agg(*(F.sum(x).alias(x) if x in ("n_best", "count_sum") else F.max(x).alias(x) for x in columns)).select(*columns)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(common.table(spark, sf_dir, "documents"))
