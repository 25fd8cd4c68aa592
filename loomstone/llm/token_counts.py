"""Token counts of whole texts, by merging all pre-tokens of a chunk at once.

``merge_counts`` holds the distinct pre-tokens of a chunk as one ragged array of
symbol ids.  Each round finds every sequence's lowest-ranked adjacent pair, merges
all its occurrences (left to right, not overlapping) in all sequences together, and
drops the sequences that have no pair left.  Merging all occurrences of a pair in
one round equals merging them one by one as long as each merge makes a symbol of its
own, since a pair that holds the new symbol then ranks after the merge that made it;
``Merges`` checks this when the vocabulary is loaded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import common

TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's memory of pre-tokens; when full it starts anew.
MEMORY = 400_000
#: The pre-tokenizer's pattern as the vocabulary's file gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = r"\t-\r\x85\xa0 "
#: The same for texts of ASCII and Latin letters, where the standard library's faster module has the classes.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^{_SPACES}0-9a-zÀ-ÖØ-öø-ɏ]+")
_NOT_LATIN = re.compile(r"[^\x00-\x7fÀ-ɏ]")
_ANY = regex.compile(PATTERN)


class Merges:
    """The vocabulary as arrays: symbols of single bytes, and merges sorted by their pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a] << 20 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])], np.int64)
        if len(np.unique(pairs[:, 2])) != len(pairs):
            raise ValueError("two merges make the same symbol")
        order = np.argsort(pairs[:, 0])
        self.keys, self.ranks, self.made = pairs[order].T.copy()
        self.made_by_rank = self.made[np.argsort(self.ranks)]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


def merge_counts(merges: Merges, tokens: list[str]) -> np.ndarray:
    """The number of symbols that each pre-token (not empty) ends as."""
    raw = [t.encode() for t in tokens]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(sizes) - 1
    symbols = merges.inner[data]
    symbols[ends] = merges.last[data[ends]]
    counts = sizes.copy()
    owner = np.repeat(np.arange(len(raw)), sizes)
    none = len(merges.keys)
    rank = np.full(len(symbols), none, np.int64)

    def fresh(at: np.ndarray) -> None:
        rank[at] = none
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        rank[at] = merges.rank(symbols[at], symbols[at + 1])

    fresh(np.arange(len(symbols)))
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        low = np.minimum.reduceat(rank, first)
        seq = np.repeat(np.arange(len(first)), np.diff(first, append=len(owner)))
        alive = (low < none)[seq]
        if not alive.all():
            symbols, owner, rank, seq = symbols[alive], owner[alive], rank[alive], seq[alive]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == low[seq])
        # in a run of neighbouring hits (a a a) every other one merges, from the left
        run = np.concatenate(([True], (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])))
        start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        symbols[hit] = merges.made_by_rank[rank[hit]]
        np.subtract.at(counts, owner[hit], 1)
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        new = place[hit]
        fresh(np.unique(np.concatenate((new, new[new > 0] - 1))))
    return counts


def pre_tokens(text: str) -> list[str]:
    """The normalised words of a text without special strings."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma is lowered without its context
        text = text.lower()
        if _NOT_LATIN.search(text):
            return _ANY.findall(text)
        return _LATIN.findall(text)
    return _LATIN.findall(text.lower())


class Counter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.merges, self.memory, self.known = Merges(path), memory, {}

    def count(self, texts: list[str]) -> list[int]:
        extra, lists = [0] * len(texts), []
        for k, t in enumerate(texts):
            if "<|" in t:
                parts = self.merges.split.split(t)
                extra[k] = len(parts) - 1
                lists.append([w for p in parts for w in pre_tokens(p)])
            else:
                lists.append(pre_tokens(t))
        new = list(set(chain.from_iterable(lists)) - self.known.keys())
        if new:
            if len(self.known) + len(new) > self.memory:
                self.known.clear()
                new = list(set(chain.from_iterable(lists)))
            self.known.update(zip(new, merge_counts(self.merges, new).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, x)) + e for x, e in zip(lists, extra, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, as the library counts without added special tokens.

    A null text counts as empty (no bytes, no tokens).  Repeated rows each get their
    row; a null key is passed on; columns beside key and text are not read.  A long
    text is one document: its pre-tokens are merged as one chunk, never cut.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    kind = docs.schema[key].dataType.simpleString()

    def make(batch: pa.RecordBatch):
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = Counter(tokenizer)
        counter = _COUNTERS[tokenizer]
        sizes, counts = [], []
        for at, end, _, offsets in common.chunks(batch.column(1)):
            sizes.append(np.diff(offsets))
            counts += counter.count([t or "" for t in batch.column(1)[at:end].to_pylist()])
        n = pa.array(counts, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), n, pa.array(np.array(counts) > limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    return common.per_batch(docs.select(docs[key].alias("k"), docs[text].alias("t")), make, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
