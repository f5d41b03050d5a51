"""A detector in plain Python, for checks and for single texts: exact windows, spaced seeds, and their union.

It follows the definitions step by step and keeps everything in dictionaries; scans
of tables use the operators.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

from siftgram.config import FIELD_SEPARATOR, Normalization
from siftgram.operators.spaced import FAMILY, SeedFamily


def tokens_of(text: str, norm: Normalization | None = None) -> list[str]:
    norm = norm or Normalization()
    body = unicodedata.normalize("NFKC", text) if norm.nfkc else text
    found = re.findall(rf"<\|field_sep\|>|{norm.word}", body.lower())
    return [t for t in found if t not in norm.stop_words]


def exact_windows(toks: list[str], n: int, norm: Normalization | None = None) -> Iterator[tuple[int, str]]:
    """(place, window) of allowed windows of n tokens."""
    norm = norm or Normalization()
    reject = re.compile("|".join(f"(?:{p})" for p in norm.reject), re.I | re.A) if norm.reject else None
    for i in range(len(toks) - n + 1):
        window = toks[i : i + n]
        text = " ".join(window)
        if FIELD_SEPARATOR not in window and not (reject and reject.search(text)):
            yield i, text


def spaced_windows(toks: list[str], family: SeedFamily = FAMILY) -> Iterator[tuple[int, tuple]]:
    """(place, seed) of every pattern at every place that no separator interrupts."""
    for i in range(len(toks) - family.span + 1):
        if FIELD_SEPARATOR not in toks[i : i + family.span]:
            for number, offsets in enumerate(family.offsets()):
                yield i, (number, *[toks[i + o] for o in offsets])


class Detector:
    """Built from the texts of items."""

    def __init__(self, items: list[str], n: int = 13, norm: Normalization | None = None, family: SeedFamily = FAMILY):
        self.n, self.norm, self.family = n, norm, family
        self.items = [tokens_of(t, norm) for t in items]
        self.windows = {w for toks in self.items for _, w in exact_windows(toks, n, norm)}
        self.seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, toks in enumerate(self.items):
            for i, seed in spaced_windows(toks, family):
                self.seeds[seed].append((k, i))

    def exact(self, text: str, min_hits: int = 3, min_coverage: float = 0.001) -> bool:
        mine = {w for _, w in exact_windows(tokens_of(text, self.norm), self.n, self.norm)}
        hits = len(mine & self.windows)
        return hits >= min_hits and hits / len(mine) >= min_coverage

    def candidates(self, text: str, min_loci: int = 3) -> dict[tuple[int, int], list[int]]:
        """(item, diagonal) -> places in the text, where there are enough of them."""
        places = defaultdict(set)
        for i, seed in spaced_windows(tokens_of(text, self.norm), self.family):
            for k, j in self.seeds.get(seed, ()):
                places[k, i - j].add(i)
        return {k: sorted(v) for k, v in sorted(places.items()) if len(v) >= min_loci}

    def spaced(self, text: str, min_loci: int = 3, min_span: int = 17, identity: float = 0.85, verify: bool = True) -> int | None:
        """The first item that agrees; without verification the first candidate."""
        toks = tokens_of(text, self.norm)
        for (k, diagonal), at in self.candidates(text, min_loci).items():
            item = self.items[k]
            lo, hi = max(at[0], 0, diagonal), min(at[-1] + self.family.span, len(toks), len(item) + diagonal)
            if not verify:
                return k
            if hi - lo >= min_span and sum(toks[p] == item[p - diagonal] for p in range(lo, hi)) / (hi - lo) >= identity:
                return k
        return None

    def union(self, text: str, **options) -> bool:
        return self.exact(text) or self.spaced(text, **options) is not None
