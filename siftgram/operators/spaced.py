"""Spaced seeds: gap-tolerant matching, verified by token identity on one diagonal.

As with exact n-grams there are two plans with one result: a kernel over Arrow
batches with the seeds and tokens of items broadcast, and joins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgram.config import FIELD_SEPARATOR, ScanConfig
from siftgram.functions import kernels as K
from siftgram.functions.sharing import share, with_types
from siftgram.functions.text import tokens
from siftgram.operators.index import Index, item_text
from siftgram.operators.matching import Matcher, Tokens, known_of, lists, looked_at, normalized, repeated, small


def _pattern(span: int, *gaps: int) -> str:
    return "".join("0" if i in gaps else "1" for i in range(span))


#: Four seeds of weight 13, by where they don't care.
_PATTERNS = (_pattern(17, 3, 5, 9, 13), _pattern(17, 3, 6, 8, 11), _pattern(17, 2, 6, 10, 12), _pattern(17, 4, 7, 9, 12))


@dataclass(frozen=True)
class SeedFamily:
    """Patterns of one span and weight; a window of that many consecutive tokens contains no whole seed."""

    patterns: tuple[str, ...] = _PATTERNS
    window: int = 13

    def __post_init__(self) -> None:
        shapes = {(len(p), p.count("1")) for p in self.patterns}
        if len(shapes) != 1:
            raise ValueError("patterns have to share span and weight")
        for p in self.patterns:
            if not re.fullmatch("1[01]*1", p):
                raise ValueError(f"{p!r} is no seed pattern")
            if len(p) <= self.window or self.window * "1" in p:
                raise ValueError("a seed may not contain an exact window")
        if len(set(self.patterns)) < len(self.patterns):
            raise ValueError("patterns repeat")

    @property
    def span(self) -> int:
        """Tokens from a seed's first to its last."""
        return max(map(len, self.patterns))

    def offsets(self) -> list[list[int]]:
        return [[i for i, c in enumerate(p) if c == "1"] for p in self.patterns]


FAMILY = SeedFamily()


def token_class(tok: Column, kind: str = "none") -> Column:
    """Class maps for candidate seeds; verification always compares tokens."""
    if kind == "none":
        return tok
    number = F.when(tok.rlike("^[0-9]+$"), F.lit("<num>"))
    return (number.when((F.length(tok) == 1) & tok.rlike("^[a-z]$"), F.lit("<id>")) if kind == "num_id" else number).otherwise(tok)


def seeds(toks: Column, family: SeedFamily = FAMILY, kind: str = "none") -> Column:
    """array<struct<pos, seed>>: every pattern at every window that no separator interrupts."""
    span, last = family.span, F.size(toks) - family.span
    # in ANSI mode get() and the guard keep short lists from failing
    named = F.transform(toks, lambda t: token_class(t, kind)) if kind != "none" else toks
    one = lambda i, pid, offs: F.concat(F.lit(f"s{pid}|"), F.concat_ws(" ", *[F.get(named, i + o) for o in offs]))
    per = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.transform(F.array(*[one(i, p, o) for p, o in enumerate(family.offsets())]), lambda s: F.struct(i.alias("pos"), s.alias("seed"))),
    )
    clear = F.filter(F.flatten(per), lambda s: ~F.array_contains(F.slice(toks, s["pos"] + 1, span), FIELD_SEPARATOR))
    return F.when(last >= 0, clear).otherwise(F.array().cast("array<struct<pos:int,seed:string>>"))


def seed_postings(index: Index, family: SeedFamily = FAMILY) -> tuple[DataFrame, DataFrame]:
    """((seed, item_idx, item_pos), (item_idx, item_toks)) over the items' joined texts."""
    items = index.items.select("item_idx", tokens(item_text(F.col("fields")), index.normalization).alias("item_toks"))
    posts = items.select("item_idx", F.explode(seeds(F.col("item_toks"), family)).alias("s")).select(F.col("s.seed").alias("seed"), "item_idx", F.col("s.pos").alias("item_pos"))
    return posts.distinct(), items


def loci(parts: DataFrame, index: Index, cfg: ScanConfig, key: list[str], family: SeedFamily = FAMILY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, item_idx, diag, first, last, n_loci) with min_loci distinct places, the token rows, the item tokens."""
    posts, items = seed_postings(index, family)
    toks = parts.select(*key, tokens(F.col("text"), index.normalization).alias("toks"))
    each = toks.select(*key, F.explode(seeds(F.col("toks"), family)).alias("s")).select(*key, F.col("s.pos").alias("pos"), F.col("s.seed").alias("seed"))
    met = each.join(small(posts, index.sizes[0] * 4), "seed").select(*key, "item_idx", (F.col("pos") - F.col("item_pos")).alias("diag"), "pos").distinct()
    found = met.groupBy(*key, "item_idx", "diag").agg(F.count("*").alias("n_loci"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return found.where(F.col("n_loci") >= cfg.spaced_min_loci), toks, items


def verified(parts: DataFrame, index: Index, cfg: ScanConfig, key: list[str], family: SeedFamily = FAMILY) -> DataFrame:
    """(key, spaced_item, diag): the smallest (item, diagonal) whose aligned tokens agree enough."""
    found, toks, items = loci(parts, index, cfg, key, family)
    both = found.join(toks, key).join(small(items, index.sizes[1]), "item_idx")
    lo = F.greatest(F.col("first"), F.lit(0), F.col("diag"))
    hi = F.least(F.col("last") + family.span, F.size("toks"), F.size("item_toks") + F.col("diag"))
    both = both.withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi") - F.col("lo") >= cfg.spaced_ver_min_span)
    same = F.aggregate(
        F.sequence(F.col("lo"), F.greatest(F.col("hi") - 1, F.col("lo"))), F.lit(0),
        lambda a, p: a + F.when(F.get("toks", p) == F.get("item_toks", p - F.col("diag")), 1).otherwise(0),
    )
    good = both.where(same / (F.col("hi") - F.col("lo")) >= cfg.spaced_ver_identity)
    best = good.groupBy(*key).agg(F.min(F.struct("item_idx", "diag")).alias("b"))
    return best.select(*key, F.col("b.item_idx").alias("spaced_item"), F.col("b.diag").alias("diag"))


_SEPARATOR = np.uint64(0x2545F4914F6CDD1D)


class Stream:
    """The tokens of a piece with separators in their places: hash, document, first of each document."""

    def __init__(self, t: Tokens):
        self.first = np.concatenate([[0], np.cumsum(t.counts)])
        self.hash = np.full(self.first[-1], _SEPARATOR)
        self.hash[self.first[t.doc] + np.arange(len(t.doc)) - t.first[t.doc] + t.segment - t.base[t.doc]] = t.hash
        self.doc = np.repeat(np.arange(len(t.counts)), t.counts)

    def seeds(self, family: SeedFamily) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, places) hashes of the seeds, and the places where all tokens of a span are of one text and field."""
        m = len(self.hash) - family.span + 1
        if m <= 0:
            return np.zeros((len(family.patterns), 0), np.uint64), np.zeros(0, np.int64)
        breaks = np.concatenate([[0], np.cumsum(self.hash == _SEPARATOR)])
        at = np.flatnonzero((self.doc[:m] == self.doc[family.span - 1 :]) & (breaks[family.span :] == breaks[:m]))
        out = np.zeros((len(family.patterns), len(at)), np.uint64)
        whole = len(at) == m
        with np.errstate(over="ignore"):
            for i, offsets in enumerate(family.offsets()):
                h = np.full(m, np.uint64(i + 1))
                for o in offsets:
                    h *= K.MULTIPLIER
                    h += self.hash[o : o + m]
                out[i] = K.mix64(h if whole else h[at])
        return out, at


class Seeds:
    """Seeds of items, sorted, with the items' tokens; found() is the smallest verified item of each document."""

    def __init__(self, item: np.ndarray, t: Tokens, cfg: ScanConfig, family: SeedFamily):
        stream = Stream(t)
        self.family, self.cfg = family, cfg
        self.names, self.tokens, self.first = item, stream.hash, stream.first
        h, at = stream.seeds(family)
        of = stream.doc[at]
        key, row, place = h.reshape(-1), np.tile(of, len(h)), np.tile(at - stream.first[of], len(h))
        order = np.lexsort((place, row, key))
        self.keys, self.rows, self.places = key[order], row[order], place[order]
        self.sieve = np.zeros(1 << max(16, min(26, (len(self.keys) * 16).bit_length())), bool)
        self.sieve[self.keys & np.uint64(len(self.sieve) - 1)] = True

    def loci(self, stream: Stream) -> tuple[np.ndarray, ...]:
        """(doc, item row, diagonal, first, last, places) where an item has enough places on a diagonal."""
        h, at = stream.seeds(self.family)
        docs, rows, diags, places = [], [], [], []
        for one in h if len(self.keys) else []:
            maybe = np.flatnonzero(self.sieve[one & np.uint64(len(self.sieve) - 1)])
            lo, hi = np.searchsorted(self.keys, one[maybe], "left"), np.searchsorted(self.keys, one[maybe], "right")
            n = hi - lo
            where = np.repeat(at[maybe], n)
            which = np.repeat(lo, n) + repeated(n)
            d = stream.doc[where]
            docs.append(d)
            rows.append(self.rows[which])
            places.append(where - stream.first[d])
            diags.append(places[-1] - self.places[which])
        if not docs or not sum(map(len, docs)):
            return (np.zeros(0, np.int64),) * 6
        met = np.unique(np.stack([np.concatenate(x) for x in (docs, rows, diags, places)]), axis=1)
        new = np.flatnonzero(np.concatenate([[True], (met[:3, 1:] != met[:3, :-1]).any(axis=0)]))
        n = np.diff(np.append(new, met.shape[1]))
        keep = n >= self.cfg.spaced_min_loci
        new, n = new[keep], n[keep]
        return met[0, new], met[1, new], met[2, new], met[3, new], met[3, new + n - 1], n

    def verified(self, stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, item, diagonal) whose aligned tokens agree enough."""
        doc, row, diag, first, last, _ = self.loci(stream)
        lo = np.maximum(np.maximum(first, 0), diag)
        hi = np.minimum(np.minimum(last + self.family.span, np.diff(stream.first)[doc]), np.diff(self.first)[row] + diag)
        ok = hi - lo >= max(1, self.cfg.spaced_ver_min_span)
        doc, row, diag, lo, hi = (x[ok] for x in (doc, row, diag, lo, hi))
        if not len(doc):
            return doc, row, diag
        size = hi - lo
        at = np.repeat(lo, size) + repeated(size)
        same = stream.hash[np.repeat(stream.first[doc], size) + at] == self.tokens[np.repeat(self.first[row] - diag, size) + at]
        share_ = np.add.reduceat(same, np.cumsum(size) - size) / size
        good = share_ >= self.cfg.spaced_ver_identity
        return doc[good], self.names[row[good]], diag[good]

    def found(self, t: Tokens, docs: int) -> pa.Array:
        doc, item, _ = self.verified(Stream(t))
        best = np.full(docs, np.iinfo(np.int64).max)
        np.minimum.at(best, doc, item.astype(np.int64))
        none = best == np.iinfo(np.int64).max
        return pa.array(np.where(none, 0, best).astype(np.int32), mask=none)


def kernel(index: Index, cfg: ScanConfig, family: SeedFamily = FAMILY) -> Callable[[], Seeds]:
    """The broadcast seeds of an index; its size is that of the items' tokens, which fits_kernel() bounds."""
    name = ("seeds", cfg.spaced_min_loci, cfg.spaced_ver_min_span, cfg.spaced_ver_identity, family)
    if name not in index.shared:
        got = index.items.select("item_idx", item_text(F.col("fields")).alias("t")).orderBy("item_idx").toArrow()
        column = normalized(got["t"].cast(pa.large_string()).combine_chunks())
        matcher = Matcher(known_of(index)())
        t = matcher.tokens(*K.buffers(column))
        index.shared[name] = share(index.items.sparkSession, Seeds(got["item_idx"].to_numpy(), t, cfg, family))
    return index.shared[name]


def loci_kernel(parts: DataFrame, index: Index, cfg: ScanConfig, key: list[str], verify: bool, family: SeedFamily = FAMILY) -> DataFrame:
    """(key, item_idx, diag, n_loci) of loci, or (key, item_idx, diag, 0) of what verification leaves, by the kernel."""
    shared, seeds_ = known_of(index), kernel(index, cfg, family)
    rows = parts.select(F.struct(*key).alias("row"), "text")

    def scan(batches):
        matcher, own = Matcher(shared()), seeds_()
        for batch in batches:
            for i, j, data, offs in looked_at(batch.column(1)):
                stream = Stream(matcher.tokens(data, offs))
                if verify:
                    doc, item, diag = own.verified(stream)
                    n = np.zeros(len(doc), np.int64)
                else:
                    doc, row, diag, _, _, n = own.loci(stream)
                    item = own.names[row]
                order = np.argsort(doc, kind="stable")
                found = lists(doc[order], j - i, {"item_idx": pa.array(item[order].astype(np.int32)), "diag": pa.array(diag[order].astype(np.int32)), "n_loci": pa.array(n[order])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), found], names=["row", "found"])

    got = rows.mapInArrow(scan, with_types(rows, ["row"], "found array<struct<item_idx:int,diag:int,n_loci:long>>"))
    return got.select("row.*", F.explode("found").alias("f")).select(*key, "f.*")
