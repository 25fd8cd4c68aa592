"""Around pluggable models."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from loomstone.operators.chunking import SHARED, WINDOW_LEAST, WINDOW_MOST

#: Output budgets, what a prompt costs besides its window, attempts and their waits, how windows are split.
OUTPUT_LEAST, OVERHEAD = 16_384, 12_000
ATTEMPTS, WAITS = 3, (1.0, 4.0)
SPLIT_FROM, SPLIT_DEPTH = 2000, 2


@dataclass(frozen=True)
class Budget:
    floor: int
    ceiling: int
    window: int


def budget(tokens: int, most_tokens: int, context: int, chars_per_token: float = 1.0) -> Budget:
    """how much an answer may take, and how large a window fits beside it."""
    ceiling = max(most_tokens, OUTPUT_LEAST)
    room = max(context - ceiling - OVERHEAD, 0) * (chars_per_token if chars_per_token > 0 else 1)
    return Budget(min(max(tokens, OUTPUT_LEAST), ceiling), ceiling, max(WINDOW_LEAST, min(WINDOW_MOST, int(room))))


def halves(text: str) -> tuple[str, str]:
    """two parts that share the usual overlap around the middle."""
    mid = len(text) // 2
    return text[: mid + SHARED], text[max(mid - SHARED, 0) :]


def chunking_limits(size: float | None, overlap: float | None) -> tuple[int, int]:
    """F57."""
    whole = lambda x, default: int(x) if isinstance(x, (int, float)) and np.isfinite(x) else default
    n = min(max(whole(size, 800), 64), 8000)
    return n, min(max(whole(overlap, 100), 0), n - 1)


def positive(value: float | None, default: int) -> int:
    return int(value) if isinstance(value, (int, float)) and np.isfinite(value) and value > 0 else default


def compile_percent(done: int, total: int) -> int:
    """the last percent is the end of the run's own."""
    return 99 if total == 0 else max(1, int(done / total * 99 + 0.5))


class OutputLimit(Exception):
    """A completion that stopped at its output budget; ``partial`` is what it had said."""

    def __init__(self, partial: str = ""):
        super().__init__("maxTokens")
        self.partial = partial


class Cache:
    """Values for a time, the most recent ones."""

    def __init__(self, seconds: float, most: int, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.kept = seconds, most, clock, OrderedDict()

    def get(self, key, make: Callable):
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < self.seconds:
            self.kept.move_to_end(key)
            return self.kept[key][1]
        self.kept[key] = (now, make())
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[key][1]


def catalog(providers: Sequence[tuple[str, str]], models: Callable[[str], Sequence[tuple[str, str]]]) -> tuple[list[dict], list[dict]]:
    """(groups, failures) of the providers in their order; one that fails leaves the others."""
    groups, failures = [], []
    for key, name in providers:
        label = {"id": key, "name": name or key}
        try:
            groups.append(label | {"models": [{"id": i, "name": n or i} for i, n in models(key)]})
        except Exception as e:  # noqa: BLE001
            failures.append(label | {"message": str(e)})
    return groups, failures


def encoded_option(provider: str, model: str) -> str:
    """F82."""
    return f"{provider}\0{model}"


def decoded_option(value: str) -> tuple[str, str] | None:
    parts = value.split("\0")
    return (parts[0], parts[1]) if len(parts) == 2 and all(parts) else None


class WordPiece:
    """greedy longest pieces of lower-cased words; ideographs are tokens of their own."""

    IDEOGRAPH = re.compile("[一-鿿㐀-䶿豈-﫿]")
    PART = re.compile("[一-鿿㐀-䶿豈-﫿]|[^\\s一-鿿㐀-䶿豈-﫿]+")

    def __init__(self, vocab: Mapping[str, int], most: int = 512, unknown: str = "[UNK]", first: str = "[CLS]", last: str = "[SEP]"):
        self.vocab, self.most, self.unknown, self.ends = vocab, most, unknown, (first, last)

    def word(self, w: str) -> list[str]:
        out, at = [], 0
        while at < len(w):
            mark = "##" if at else ""
            end = next((e for e in range(len(w), at, -1) if mark + w[at:e] in self.vocab), None)
            if end is None:
                return [w] if len(w) == 1 else [self.unknown]
            out.append(mark + w[at:end])
            at = end
        return out

    def ids(self, text: str) -> list[int]:
        tokens = [self.ends[0]]
        for p in self.PART.findall(text):
            tokens += [p] if self.IDEOGRAPH.match(p) else self.word(p.lower())
        tokens = [*tokens[: self.most - 1], self.ends[1]]
        return [self.vocab.get(t, self.vocab.get(self.unknown, 0)) for t in tokens]

    def batch(self, texts: Sequence[str], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask), as wide as the longest text."""
        rows = [self.ids(t) for t in texts]
        width = max(map(len, rows), default=0)
        return np.array([r + [pad] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width), np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each text's token states, of length 1; without any length it stays zero."""
    m = mask[..., None].astype(float)
    mean = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    n = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(n == 0, 1, n)
