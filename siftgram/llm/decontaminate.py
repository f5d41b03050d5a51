"""Benchmark decontamination by winnowing (operator 2).

Training and test texts are cut into words; k-gram hashes are winnowed: of each
t-k+1 neighbouring k-grams (a window of t words) the minimum is kept, so that
every shared span of t words or more shares a kept fingerprint. Fingerprints of
documents are joined to those of items. A hit is extended over the windows of t
words around it: each that is a window of an item too is hit, and neighbouring
ones make up the shared span. A window is looked up once, however often its
words repeat in a document or an item, so that the work is linear in both.
Items of fewer than t words are one window; they are looked up as whole grams.

A benchmark of at most `broadcast_bytes` of text is broadcast (its windows take
about 8 bytes for each byte of text), and documents are read once, without a
shuffle. Beyond that the fingerprints are a table, built by executors, and joined
by a shuffle; documents are read once as well, and carry the hashes of the
windows around each fingerprint along.

Edge cases: null or empty texts have no words and are clean. An empty benchmark
leaves all clean. Items that share an id count once. A null item_id stands for
an empty string in the digest. Repeated rows are judged each by itself. Long
texts are processed whole. Own columns of any name stand in a struct and can't
clash. Windows are compared by 64-bit hashes of their words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.functions import kernels as K
from siftgram.functions.sharing import share
from siftgram.llm.shared import materialised, with_types

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 16 << 20


def item_windows(words: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length, hash) of every window of a piece's texts; short texts are one window."""
    counts = words.counts()
    g = K.grams(words.hash, window)
    at = np.flatnonzero(words.doc[: len(g)] == words.doc[window - 1 : window - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < window))
    own = np.array([K.grams(words.hash[words.first[d] : words.first[d + 1]], int(counts[d]))[0] for d in short], dtype=np.uint64)
    return np.concatenate([words.doc[at], short]), np.concatenate([np.full(len(at), window), counts[short]]), np.concatenate([g[at], own])


class Items:
    """The windows and fingerprints of a benchmark, sorted for lookup."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int, gram: int):
        self.ids, self.window, self.gram = ids, window, gram
        pows, prints, found = K.Powers(), [np.zeros(0, np.uint64)], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for i, _, data, offs in K.pieces(texts):
            words = K.Words(data, offs, pows)
            prints.append(fingerprints(words, window, gram)[1])
            text, length, h = item_windows(words, window)
            found.append((text + i, length, h))
        self.prints = np.unique(np.concatenate(prints))
        text, length, h = (np.concatenate([f[c] for f in found]) for c in range(3))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> (hashes, items), one pair once
        for n in np.unique(length).tolist():
            pair = np.unique(np.stack([h[length == n], text[length == n].astype(np.uint64)]), axis=1)
            self.windows[n] = pair[0], pair[1].astype(np.int64)


def fingerprints(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept k-grams of a piece."""
    at = winnow(words.hash, words.doc, window, gram)
    return at, K.grams(words.hash, gram)[at] if len(at) else np.zeros(0, np.uint64)


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of kept k-grams: minima of some window of `window` words of one document."""
    w = window - gram + 1
    g = K.grams(hashes, gram)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = K.sliding(g, w, np.minimum)
    least[doc[: len(least)] != doc[window - 1 : window - 1 + len(least)]] = 0  # windows across documents keep nothing
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    best = K.sliding(padded, w, np.maximum)
    return np.flatnonzero((best == g) & (best > 0))


def _lookup(hashes: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Positions of hashes that known (sorted) has; a bit table keeps most from the search."""
    maybe = np.flatnonzero(sieve[hashes & np.uint64(len(sieve) - 1)])
    got = hashes[maybe]
    at = np.minimum(np.searchsorted(known, got), len(known) - 1)
    return maybe[known[at] == got]


def _sieve(known: np.ndarray) -> np.ndarray:
    size = 1 << max(16, min(26, int(len(known) * 16).bit_length()))
    out = np.zeros(size, dtype=bool)
    out[known & np.uint64(size - 1)] = True
    return out


class Finder:
    """Finds item windows in pieces of documents; one per task."""

    def __init__(self, items: Items):
        self.items = items
        self.sieves = {0: _sieve(items.prints)} | {n: _sieve(h) for n, (h, _) in items.windows.items()}

    def windows(self, words: K.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, hashes) of the document windows that an item has."""
        w, k = self.items.window, self.items.gram
        for n, (known, _) in self.items.windows.items():
            if n == w:
                prints, values = fingerprints(words, w, k)
                at = around(prints[_lookup(values, self.items.prints, self.sieves[0])], words, w, k)
                h = gram_at(words.hash, at, w)
            else:
                h = K.grams(words.hash, n)
                at = np.flatnonzero(words.doc[: len(h)] == words.doc[n - 1 : n - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
                h = h[at]
            own = _lookup(h, known, self.sieves[n])
            yield n, at[own], h[own]

    def owners(self, n: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs of found windows; each window of a document is expanded once."""
        known, item = self.items.windows[n]
        pair = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)
        lo, hi = np.searchsorted(known, pair[1], "left"), np.searchsorted(known, pair[1], "right")
        size = hi - lo
        which = np.repeat(lo, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        out = np.unique(np.stack([np.repeat(pair[0].astype(np.int64), size), item[which]]), axis=1)
        return out[0], out[1]


def around(prints: np.ndarray, words: K.Words, window: int, gram: int) -> np.ndarray:
    """Places of the windows that contain a k-gram at one of `prints`, and lie in one document."""
    at = np.unique((prints[:, None] - np.arange(window - gram + 1)).reshape(-1))
    at = at[(at >= 0) & (at + window <= len(words.hash))]
    return at[words.doc[at] == words.doc[at + window - 1]] if len(at) else at


def gram_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """K.grams at some places only."""
    with np.errstate(over="ignore"):
        out = hashes[at].copy()
        for j in range(1, n):
            out = out * K.MULTIPLIER + hashes[at + j]
        return K.mix64(out)


def _read(benchmark: DataFrame, item: str, text: str) -> tuple[list[str], pa.Array]:
    """A benchmark of bounded size on the driver."""
    got = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toArrow()
    return got["i"].to_pylist(), got["t"].cast(pa.large_string()).combine_chunks()


def _hit_words(words: K.Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hit words per document."""
    change = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    return hit[words.first[1:]] - hit[words.first[:-1]]


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    if not 0 < gram <= window:
        raise ValueError("the gram has to fit the window")
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)) + 8)).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(narrow, benchmark, item, item_text, window, gram).withColumnRenamed("k", key)
    shared = share(docs.sparkSession, Items(*_read(benchmark, item, item_text), window, gram))
    nothing = _digest(set())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, pows = Finder(shared()), K.Powers()
        ids = finder.items.ids
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                words = K.Words(data, offs, pows)
                lo, hi, owned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
                for n, at, h in finder.windows(words):
                    lo.append(at)
                    hi.append(at + n)
                    for d, x in zip(*(a.tolist() for a in finder.owners(n, words.doc[at], h)), strict=True):
                        owned.setdefault(d, set()).add(ids[x])
                n_hit = _hit_words(words, np.concatenate(lo), np.concatenate(hi))
                sets = [owned.get(d) for d in range(words.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(words.counts()), pa.array(n_hit), pa.array([len(s) if s else 0 for s in sets], pa.int64()),
                     pa.array([_digest(s) if s else nothing for s in sets], pa.string()), pa.array(n_hit > 0)],
                    names=["k", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return narrow.mapInArrow(scan, with_types(narrow, ["k"], RESULT)).withColumnRenamed("k", key)


def _joined(narrow: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, gram: int) -> DataFrame:
    """Benchmarks of any size: windows of both sides are tables of hashes and meet by shuffles."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                words = K.Words(data, offs, pows)
                text, n, h = item_windows(words, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(text)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.zeros(len(h), np.int64))], names=["item", "n", "h", "p"])
                at, g = fingerprints(words, window, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(words.doc[at])), pa.array(np.zeros(len(at), np.int32)), pa.array(np.zeros(len(at), np.int64)), pa.array(g.view(np.int64))], names=["item", "n", "h", "p"])

    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("t"))
    tables = materialised(source.mapInArrow(of_items, "item string, n int, h long, p long").distinct(), "item-windows")
    owners, prints = tables.where("n > 0").select("item", "n", "h"), tables.where("n = 0").select("p").distinct()
    lengths = [r["n"] for r in owners.select("n").distinct().collect()]  # `window` numbers at most
    # what is found depends on the text alone: its digest names it
    rows = narrow.withColumn("d", F.md5(F.coalesce("t", F.lit(""))))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1), 1 << 19):
                words = K.Words(data, offs, pows)
                names = batch.column(0).slice(i, j - i)

                def found(doc, n, p, at, h, words=words, names=names):
                    return pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(p.view(np.int64)), pa.array(at - words.first[doc]), pa.array(h.view(np.int64))], names=["d", "n", "p", "at", "h"])

                for n in lengths:
                    if n < window:
                        h = K.grams(words.hash, n)
                        at = np.flatnonzero(words.doc[: len(h)] == words.doc[n - 1 : n - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
                        yield found(words.doc[at], n, np.zeros(len(at), np.uint64), at, h[at])
                        continue
                    prints_at, p = fingerprints(words, window, gram)
                    for o in range(window - gram + 1):
                        at = prints_at - o
                        ok = (at >= 0) & (at + window <= len(words.hash))
                        ok[ok] = words.doc[at[ok]] == words.doc[at[ok] + window - 1]
                        yield found(words.doc[at[ok]], n, p[ok], at[ok], gram_at(words.hash, at[ok], window))

    cut = rows.select("d", "t").mapInArrow(of_documents, "d string, n int, p long, at long, h long")
    long_ = cut.where(F.col("n") == window).join(prints, "p", "left_semi")
    met = cut.where(F.col("n") < window).unionByName(long_).select("d", "n", "at", "h").distinct().join(owners, ["n", "h"])
    found = materialised(met.select("d", "at", "n", "item").distinct(), "item-hits")
    items = found.groupBy("d").agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"))
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    items = items.select(F.col("d").alias("d2"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"), n_hit.alias("n_hit"))
    n_words = F.size(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    got = rows.select("k", "d", n_words.alias("n_words")).join(items, F.col("d") == F.col("d2"), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return got.select("k", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit word, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return contamination(own, benchmark, key="row", **options).where(~F.col("contaminated")).select("row.*")
