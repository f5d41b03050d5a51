"""Matching sub-documents against the index.

Two plans with one result. The kernel plan tokenises Arrow batches and looks
windows up in the broadcast hashes and postings of the index, so that a document
is read once, by one task, and its evidence per item and benchmark comes out
with it; nothing is shuffled. It needs an index within KERNEL_BYTES and the
default word pattern. The join plan is Catalyst expressions and joins on the
n-gram, for any normalization and any size of index; what is found depends on the
text alone there, so that its digest names rows, and null or repeated keys do no
harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgram.config import FIELD_SEPARATOR, REJECT_TRIGGER_PREFIX, REJECT_TRIGGERS, Normalization
from siftgram.functions import kernels as K
from siftgram.functions.sharing import share, with_types
from siftgram.functions.scratch import materialised
from siftgram.functions.text import may_reject, rejected, tokens, windows
from siftgram.operators.index import Index, hash_grams

#: Bytes of an index that the kernel plan broadcasts, at POSTING_BYTES for each posting or stop-gram.
KERNEL_BYTES = 256 << 20
POSTING_BYTES = 32
#: Bytes of text that a kernel looks at together: its arrays take about a hundred times that.
LOOK_BYTES = 256 << 10
#: Posting rows that a join may broadcast.
BROADCAST_ROWS = 2_000_000

_PART = np.zeros(256, dtype=bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = True


def _hash_words(words: list[str], pows: K.Powers) -> np.ndarray:
    a, _ = pows.upto(max((len(w) for w in words), default=0) + 1)
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            body = np.frombuffer(w.encode(), np.uint8)
            out[i] = (K.VALUE[body] * a[: len(body)]).sum(dtype=np.uint64)
        return K.mix64(out)


class Tokens:
    """Tokens of a piece, stop words out: start, end (bytes), doc, segment (a field separator begins a new one), hash, trigger."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pows: K.Powers, stop: np.ndarray, triggers: np.ndarray, prefix: np.uint64 | None):
        n = len(data)
        is_part = _PART[data]
        begin, end = is_part.copy(), is_part.copy()
        if n:
            begin[1:] &= ~is_part[:-1]
            end[:-1] &= ~is_part[1:]
            cut = offs[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            begin[cut] = is_part[cut]
            end[cut - 1] = is_part[cut - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        a, b = pows.upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(K.VALUE[data] * a[:n], out=sums[1:])
            part_hash = K.mix64((sums[e] - sums[s]) * b[s])
        first = np.searchsorted(s, offs)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        trigger = np.isin(part_hash, triggers)
        if prefix is not None:
            width = len(REJECT_TRIGGER_PREFIX)
            long_ = np.flatnonzero(e - s >= width)
            with np.errstate(over="ignore"):
                trigger[long_] |= K.mix64((sums[s[long_] + width] - sums[s[long_]]) * b[s[long_]]) == prefix
        # word'word is one token; a chain of more pairs up from its left
        link = np.zeros(len(s), bool)
        if len(s) > 1:
            link[:-1] = (s[1:] == e[:-1] + 1) & (doc[1:] == doc[:-1])
            link[:-1][link[:-1]] = data[e[:-1][link[:-1]]] == 39
        odd = np.zeros(len(s), bool)
        if link.any():
            heads = np.flatnonzero(np.concatenate([[True], ~link[:-1]]))
            place = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
            odd = place % 2 == 1
            pair = np.flatnonzero(~odd & link)
            e = e.copy()
            e[pair] = e[pair + 1]
            trigger[pair] |= trigger[pair + 1]
        with np.errstate(over="ignore"):
            h = K.mix64((sums[e] - sums[s]) * b[s])
        keep = ~odd & ~np.isin(h, stop)
        segment = np.zeros(len(s), np.int64)
        self.separators = np.zeros(len(offs) - 1, np.int64)
        marker = FIELD_SEPARATOR.encode()
        body = data.tobytes().lower() if (data == marker[0]).any() and (data == 124).any() else b""
        at = body.find(marker)
        while at >= 0:
            owner = int(np.searchsorted(offs, at, side="right")) - 1
            if at + len(marker) <= offs[owner + 1]:
                segment[np.searchsorted(s, at) :] += 1
                self.separators[owner] += 1
                keep[(s >= at) & (s < at + len(marker))] = False
            at = body.find(marker, at + 1)
        self.start, self.end, self.doc, self.segment, self.hash, self.trigger = s[keep], e[keep], doc[keep], segment[keep], h[keep], trigger[keep]
        self.first = np.searchsorted(self.start, offs)
        self.base = np.cumsum(self.separators) - self.separators  # separators before each document
        self.counts = np.diff(self.first) + self.separators


def _rows_of(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where groups of sorted keys begin, for the distinct sorted values in known, and where the last ends."""
    return np.append(np.searchsorted(keys, known), len(keys))


def repeated(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Known:
    """What kernels need of an index: sorted n-gram hashes, the items and benchmarks of each, and stop-grams."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, source: np.ndarray, fan_out: np.ndarray, stop: np.ndarray | None, n: int, norm: Normalization, boilerplate: int = 50):
        order = np.lexsort((item, gram))
        gram, item, source, fan_out = gram[order], item[order], source[order], fan_out[order]
        self.hashes, first = np.unique(gram, return_index=True)
        self.fan_out = fan_out[first].astype(np.int64)
        self.first, self.item = _rows_of(gram, self.hashes), item.astype(np.int32)
        self.item_ngrams = np.bincount(item)
        pair = np.unique(np.stack([gram, source.astype(np.uint64)]), axis=1)
        self.source_first, self.source = _rows_of(pair[0], self.hashes), pair[1].astype(np.int32)
        self.stop = None if stop is None else np.sort(stop)
        self.n, self.norm, self.boilerplate = n, norm, boilerplate

    def lookup(self, g: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, number of the n-gram) of every hash that is known."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(sieve[g & np.uint64(len(sieve) - 1)])
        at = np.minimum(np.searchsorted(self.hashes, g[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == g[maybe]
        return maybe[hit], at[hit]

    def sieve(self) -> np.ndarray:
        size = 1 << max(16, min(27, (len(self.hashes) * 16).bit_length()))
        out = np.zeros(size, bool)
        out[self.hashes & np.uint64(size - 1)] = True
        return out

    def by_source(self, doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, benchmark, distinct n-grams) over distinct (doc, gram) pairs."""
        count = self.source_first[gram + 1] - self.source_first[gram]
        d, s = np.repeat(doc, count), self.source[np.repeat(self.source_first[gram], count) + repeated(count)]
        pair, n = np.unique(np.stack([d, s.astype(np.int64)]), axis=1, return_counts=True)
        return pair[0], pair[1], n

    def by_item(self, doc: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, item, hits, unique, shared, boilerplate, longest run in tokens, n-grams of the item) of hits."""
        count = self.first[gram + 1] - self.first[gram]
        d, p, g = (np.repeat(x, count) for x in (doc, place, gram))
        item = self.item[np.repeat(self.first[gram], count) + repeated(count)].astype(np.int64)
        if not len(d):
            return (np.zeros(0, np.int64),) * 8
        by = np.lexsort((p, item, d))  # runs: one n-gram stands at a place, so that places of an item are distinct
        new = np.concatenate([[True], (d[by][1:] != d[by][:-1]) | (item[by][1:] != item[by][:-1])])
        group = np.flatnonzero(new)
        run = np.flatnonzero(new | np.concatenate([[True], p[by][1:] != p[by][:-1] + 1]))
        longest = np.maximum.reduceat(np.diff(np.append(run, len(by))), np.searchsorted(run, group)) + self.n - 1
        who, whose = d[by][group], item[by][group]
        by = np.lexsort((g, item, d))
        once = np.concatenate([[True], (d[by][1:] != d[by][:-1]) | (item[by][1:] != item[by][:-1]) | (g[by][1:] != g[by][:-1])])
        fan = self.fan_out[g[by]]
        split = [once, once & (fan <= 1), once & (fan > 1) & (fan < self.boilerplate), once & (fan > 1) & (fan >= self.boilerplate)]
        return who, whose, *[np.add.reduceat(x.astype(np.int64), group) for x in split], longest, self.item_ngrams[whose]


def normalized(column: pa.Array) -> pa.Array:
    """NFKC and lower case for the texts that are not plain ASCII."""
    data, offs = K.buffers(column)
    high = np.concatenate([[0], np.cumsum(data > 127)])
    rows = np.flatnonzero(high[offs[1:]] > high[offs[:-1]])
    if not len(rows):
        return column
    out = column.to_pylist()
    for i in rows:
        out[i] = unicodedata.normalize("NFKC", out[i]).lower()
    return pa.array(out, pa.large_string())


def looked_at(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """K.pieces() of LOOK_BYTES, normalized one at a time, so that a batch is never in Python as a whole."""
    for i, j, _, _ in K.pieces(column, LOOK_BYTES):
        data, offs = K.buffers(normalized(column.slice(i, j - i)))
        yield i, j, data, offs


class Reader:
    """Tokens of pieces, and the windows that patterns reject; one per task."""

    def __init__(self, norm: Normalization):
        self.pows = K.Powers(LOOK_BYTES)
        self.stop = np.sort(_hash_words(sorted(norm.stop_words), self.pows))
        self.triggers = np.sort(_hash_words(sorted(REJECT_TRIGGERS), self.pows))
        self.prefix = _hash_words([REJECT_TRIGGER_PREFIX], self.pows)[0]
        self.reject = re.compile("|".join(f"(?:{p})" for p in norm.reject), re.IGNORECASE | re.ASCII)

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> Tokens:
        return Tokens(data, offs, self.pows, self.stop, self.triggers, self.prefix)

    @staticmethod
    def whole(t: Tokens, n: int) -> np.ndarray:
        """Whether the n tokens from each place are of one text and field; the last n-1 places are dropped."""
        m = max(0, len(t.hash) - n + 1)
        return (t.doc[:m] == t.doc[n - 1 : n - 1 + m]) & (t.segment[:m] == t.segment[n - 1 : n - 1 + m]) if m else np.zeros(0, bool)

    def rejected(self, data: np.ndarray, t: Tokens, ok: np.ndarray, n: int) -> Iterator[tuple[int, str]]:
        """(place, text) of the windows in ok that a pattern rejects. Windows in a row are looked at together first:
        patterns that don't match their common text match none of them."""
        if not t.trigger.any():
            return
        seen = np.concatenate([[0], np.cumsum(t.trigger)])
        can = np.flatnonzero(ok & (seen[n : n + len(ok)] > seen[: len(ok)]))
        for row in np.split(can, np.flatnonzero(np.diff(can) > 1) + 1) if len(can) else []:
            a, b = t.start[row[0] : row[-1] + n].tolist(), t.end[row[0] : row[-1] + n].tolist()
            words = [K.word_bytes(data, x, y) for x, y in zip(a, b, strict=True)]
            if self.reject.search(b" ".join(words).decode()):
                for i in row.tolist():
                    text = b" ".join(words[i - row[0] : i - row[0] + n]).decode()
                    if self.reject.search(text):
                        yield i, text

    def allowed(self, data: np.ndarray, t: Tokens, n: int) -> np.ndarray:
        """Whether the window at each place counts."""
        ok = self.whole(t, n)
        for i in [i for i, _ in self.rejected(data, t, ok, n)]:
            ok[i] = False
        return ok


class Matcher(Reader):
    """Scores pieces of texts; one per task."""

    def __init__(self, known: Known):
        super().__init__(known.norm)
        self.known, self.sieve = known, known.sieve()

    def score(self, data: np.ndarray, offs: np.ndarray, t: Tokens | None = None) -> dict[str, np.ndarray]:
        n, docs = self.known.n, len(offs) - 1
        t = t or self.tokens(data, offs)
        g = K.grams(t.hash, n)
        ok = self.allowed(data, t, n)
        short = np.diff(offs) < 2 * n
        pos = np.flatnonzero(ok)
        pos = pos[~short[t.doc[pos]]]
        h, doc = g[pos], t.doc[pos]
        n_grams = self._distinct(h, doc, docs)
        n_kept = n_grams
        if self.known.stop is not None and len(self.known.stop):
            at = np.minimum(np.searchsorted(self.known.stop, h), len(self.known.stop) - 1)
            stays = self.known.stop[at] != h
            pos, h, doc = pos[stays], h[stays], doc[stays]
            n_kept = self._distinct(h, doc, docs)
        hit, gram = self.known.lookup(h, self.sieve)
        # a separator takes a place of its own in the token stream
        place = pos[hit] - t.first[doc[hit]] + t.segment[pos[hit]] - t.base[doc[hit]]
        return {"skipped": short, "n_tokens": t.counts, "n_grams": n_grams, "n_kept": n_kept, "doc": doc[hit], "pos": place, "gram": gram}

    @staticmethod
    def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if len(h) < 200 * docs:  # many short documents: one sort of all
            by = np.lexsort((h, doc))
            d, v = doc[by], h[by]
            new = np.ones(len(by), bool)
            new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
            return np.bincount(d[new], minlength=docs)
        out = np.zeros(docs, np.int64)
        first = np.searchsorted(doc, np.arange(docs + 1))
        for d in np.flatnonzero(np.diff(first)):
            s = np.sort(h[first[d] : first[d + 1]])
            out[d] = 1 + np.count_nonzero(s[1:] != s[:-1])
        return out


HITS = "array<struct<pos:int,gram_id:long>>"
SOURCES = "array<struct<source_id:int,hits:long>>"
ITEMS = "array<struct<item_idx:int,hits:long,unique_hits:long,shared_hits:long,boilerplate_hits:long,longest_run_tokens:long,item_ngrams:long>>"
RESULT = f"skipped boolean, n_tokens long, n_grams long, n_kept long, n_hits long, hits {HITS}, sources {SOURCES}, items {ITEMS}"
COLUMNS = ("skipped", "n_tokens", "n_grams", "n_kept", "n_hits", "hits", "sources", "items")
_SPLIT = ("hits", "unique_hits", "shared_hits", "boilerplate_hits", "longest_run_tokens", "item_ngrams")
SPACED, EXACT = "spaced_item int", "exact_items array<int>"


def numbered(index: Index) -> DataFrame:
    """(gram_id, gram) of the distinct n-grams of an index."""
    return index.postings.select("gram_id", "gram").distinct()


def lists(doc: np.ndarray, docs: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs per document, from columns in the order of documents."""
    first = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def fits_kernel(index: Index, stopgrams: DataFrame | None = None) -> bool:
    if not index.normalization.is_default:
        return False
    return (index.sizes[0] + (0 if stopgrams is None else stopgrams.count())) * POSTING_BYTES <= KERNEL_BYTES


def match(
    parts: DataFrame, index: Index, stopgrams: DataFrame | None = None, keep: tuple[str, ...] | None = None, plan: str = "auto",
    boilerplate: int = 50, seeds=None, questions=None, texts_from: int | None = None,
) -> DataFrame:
    """parts (with `text`) and skipped, n_tokens, n_grams (distinct allowed windows), n_kept (of them, no stop-grams),
    n_hits (of them, in the index), hits (those windows with their positions), sources and items (evidence by benchmark
    and item).

    keep: columns to carry, by default all but text. seeds, questions: kernels of the spaced and the exact channel
    (see spaced.kernel and exact.kernel), which add spaced_item and exact_items in the same pass. texts_from: adds `seen`,
    the text of rows with so many hits, or an exact one.
    """
    keep = keep if keep is not None else tuple(c for c in parts.columns if c != "text")
    if plan == "auto":
        plan = "kernel" if fits_kernel(index, stopgrams) else "join"
    if plan == "kernel":
        return _by_kernel(parts, index, stopgrams, keep, boilerplate, seeds, questions, texts_from)
    if seeds is not None or questions is not None:
        raise ValueError("the channels' kernels need the kernel plan")
    if texts_from is not None:
        got = _by_join(parts, index, stopgrams, (*keep, "text"), boilerplate)
        return got.withColumnRenamed("text", "seen")
    return _by_join(parts, index, stopgrams, keep, boilerplate)


def known_of(index: Index, stopgrams: DataFrame | None = None, boilerplate: int = 50):
    """The broadcast Known of an index, made once."""
    name = ("known", boilerplate)
    if stopgrams is None and name in index.shared:
        return index.shared[name]
    code = F.array_position(F.array(*[F.lit(b) for b in index.names]), F.col("benchmark")) - 1 if index.names else F.lit(0)
    got = index.postings.select("gram_id", "item_idx", code.cast("int").alias("source"), "fan_out").distinct().toArrow()
    column = lambda c: got[c].to_numpy()
    stop = None
    if stopgrams is not None:
        n = index.ngram
        words = stopgrams.select("gram").where(F.size(F.split("gram", " ")) == n).toArrow()["gram"].combine_chunks()
        stop = hash_grams(words, K.Powers())
    known = Known(column("gram_id").view(np.uint64), column("item_idx"), column("source"), column("fan_out"), stop, index.ngram, index.normalization, boilerplate)
    shared = share(index.postings.sparkSession, known)
    if stopgrams is None:
        index.shared[name] = shared
    return shared


def _by_kernel(parts: DataFrame, index: Index, stopgrams: DataFrame | None, keep: tuple[str, ...], boilerplate: int, seeds, questions, texts_from: int | None) -> DataFrame:
    shared = known_of(index, stopgrams, boilerplate)
    rows = parts.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    more = RESULT + (f", {SPACED}" if seeds else "") + (f", {EXACT}" if questions else "") + (", seen string" if texts_from is not None else "")
    names = [f.name for f in T.StructType.fromDDL(more)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared())
        spaced = seeds() if seeds else None
        exact = questions() if questions else None
        for batch in batches:
            for i, j, data, offs in looked_at(batch.column(1)):
                t = matcher.tokens(data, offs)
                r = matcher.score(data, offs, t)
                known, docs, doc, gram = matcher.known, j - i, r["doc"], r["gram"]
                hits = lists(doc, docs, {"pos": pa.array(r["pos"].astype(np.int32)), "gram_id": pa.array(known.hashes[gram].view(np.int64))})
                pair = np.unique(np.stack([doc, gram]), axis=1)
                d, source, n = known.by_source(*pair)
                sources = lists(d, docs, {"source_id": pa.array(source.astype(np.int32)), "hits": pa.array(n)})
                d, item, *split = known.by_item(doc, r["pos"], gram)
                items = lists(d, docs, {"item_idx": pa.array(item.astype(np.int32))} | {c: pa.array(x) for c, x in zip(_SPLIT, split, strict=True)})
                out = [pa.array(r["skipped"]), pa.array(r["n_tokens"]), pa.array(r["n_grams"]), pa.array(r["n_kept"]), pa.array(np.bincount(pair[0], minlength=docs)), hits, sources, items]
                if spaced is not None:
                    out.append(spaced.found(t, docs))
                if exact is not None:
                    out.append(exact.found(batch.column(1).slice(i, docs)))
                if texts_from is not None:
                    some = np.bincount(pair[0], minlength=docs) >= texts_from
                    if exact is not None:
                        some |= np.diff(out[-1].offsets.to_numpy()) > 0
                    own = batch.column(1).slice(i, docs)
                    out.append(pc.if_else(pa.array(some), own, pa.nulls(docs, own.type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, docs), *out], names=["row", *names])

    return rows.mapInArrow(scan, with_types(rows, ["row"], more)).select("row.*", *names)


def reject_counts(texts: DataFrame, n: int, norm: Normalization) -> DataFrame:
    """(pattern_idx, n, text): windows of texts (text) by the first pattern that rejects them, one row a pattern and task,
    by the kernel; texts with a field separator, which is a token of windows here, are handed on in text, normalized."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, patterns = Reader(norm), [re.compile(p, re.IGNORECASE | re.ASCII) for p in norm.reject]
        counts, kinds = np.zeros(len(patterns) + 1, np.int64), pa.schema([("pattern_idx", pa.int32()), ("n", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for _, _, data, offs in looked_at(batch.column(0)):
                t = own.tokens(data, offs)
                ok = own.whole(t, n)
                odd = np.flatnonzero(t.separators)
                ok &= t.separators[t.doc[: len(ok)]] == 0
                some = [next(k for k, p in enumerate(patterns) if p.search(text)) for _, text in own.rejected(data, t, ok, n)]
                counts[:-1] += np.bincount(np.array(some, np.int64), minlength=len(patterns))
                counts[-1] += np.count_nonzero(ok) - len(some)
                if len(odd):
                    handed = [data[offs[d] : offs[d + 1]].tobytes().decode() for d in odd.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(odd), pa.int32()), pa.nulls(len(odd), pa.int64()), pa.array(handed, pa.string())], schema=kinds)
        of = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32), mask=of == len(patterns)), pa.array(counts[of]), pa.nulls(len(of), pa.string())], schema=kinds)

    return texts.select("text").mapInArrow(scan, "pattern_idx int, n long, text string")


#: Bytes of text of a block of documents in which candidates for frequent n-grams are counted.
BLOCK_BYTES = 8 << 20


def frequent(docs: DataFrame, n: int, tau: float, norm: Normalization) -> DataFrame | None:
    """(gram, df): n-grams in at least max(1, ceil(tau * N)) of the N documents, by kernels; None where no bound holds.

    What is in a share tau of all documents is in that share of some block of them. Blocks name candidates by hash, which
    are broadcast and counted over all documents; n-grams are neither exploded nor shuffled.
    """
    texts = docs.select("text")

    def grams(own: Reader, batch: pa.RecordBatch):
        """(documents, bytes, tokens, places and hashes of distinct n-grams of a document) of pieces."""
        for i, j, data, offs in looked_at(batch.column(0)):
            t = own.tokens(data, offs)
            at = np.flatnonzero(own.allowed(data, t, n))
            h, doc = K.grams(t.hash, n)[at], t.doc[at]
            by = np.lexsort((h, doc))
            once = by[np.flatnonzero(np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (h[by][1:] != h[by][:-1])])[: len(by)])]
            yield j - i, data, t, at[once], h[once]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, count = Reader(norm), [], 0, 0

        def named():
            h, df = np.unique(np.concatenate(held), return_counts=True)
            h = h[df >= tau * count - 1e-6]
            ids = pa.array(np.append(h.view(np.int64), 0), mask=np.append(np.zeros(len(h), bool), True))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.append(np.zeros(len(h), np.int64), count))], names=["gram_id", "docs"])

        for batch in batches:
            for docs_, data, _, _, h in grams(own, batch):
                held.append(h)
                size, count = size + len(data), count + docs_
                if size >= BLOCK_BYTES:
                    yield named()
                    held, size, count = [], 0, 0
        if held:
            yield named()

    got = materialised(texts.mapInArrow(candidates, "gram_id long, docs long").groupBy("gram_id").agg(F.sum("docs").alias("docs")), "candidates")
    if got.count() > BROADCAST_ROWS:
        return None
    total = got.agg(F.sum("docs")).first()[0] or 0
    need = max(1, -int(-(tau * total) // 1))
    shared = share(docs.sparkSession, np.sort(got.where("gram_id IS NOT NULL").toArrow()["gram_id"].to_numpy().view(np.uint64)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Reader(norm), shared()
        df, texts_ = np.zeros(len(known), np.int64), {}
        for batch in batches:
            for _, data, t, at, h in grams(own, batch) if len(known) else ():
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[k] == h
                k, at = k[hit], at[hit]
                new, first = np.unique(k, return_index=True)
                for x, a in zip(new[df[new] == 0].tolist(), at[first[df[new] == 0]].tolist(), strict=True):
                    texts_[x] = b" ".join(K.word_bytes(data, t.start[a + y], t.end[a + y]) for y in range(n)).decode()
                df += np.bincount(k, minlength=len(known))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([texts_[x] for x in met.tolist()], pa.string()), pa.array(df[met])], names=["gram", "df"])

    return texts.mapInArrow(counted, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= need)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the number of rows is known to be small; otherwise a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _by_join(parts: DataFrame, index: Index, stopgrams: DataFrame | None, keep: tuple[str, ...], boilerplate: int) -> DataFrame:
    """Windows of distinct texts are exploded under the text's digest; results come back by it."""
    n, norm = index.ngram, index.normalization
    rows = parts.withColumn("__k", F.sha2("text", 256))
    keyed = rows.select("__k", "text").dropDuplicates(["__k"]).withColumn("skipped", F.octet_length("text") < 2 * n)
    toks = keyed.select("__k", "skipped", tokens(F.col("text"), norm).alias("toks"))
    ws = windows(F.col("toks"), n)
    ws = F.when(may_reject(F.col("toks"), norm), F.filter(ws, lambda w: ~rejected(w["gram"], norm))).otherwise(ws)
    ws = F.when(F.col("skipped"), F.array().cast("array<struct<pos:int,gram:string>>")).otherwise(ws)
    base = materialised(toks.select("__k", "skipped", F.size("toks").cast("long").alias("n_tokens"), ws.alias("ws")), "windows")
    each = base.select("__k", F.explode("ws").alias("w")).select("__k", "w.pos", "w.gram")
    if stopgrams is not None:
        each = each.join(stopgrams.select("gram").distinct(), "gram", "left_anti")
    met = materialised(each.join(small(numbered(index), index.sizes[0]), "gram").select("__k", "pos", "gram_id"), "met")
    hits = met.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("pos", "gram_id"))).alias("hits"), F.count_distinct("gram_id").alias("n_hits"))
    counted = base.select("__k", "skipped", "n_tokens", F.size(F.array_distinct(F.transform("ws", lambda w: w["gram"]))).cast("long").alias("n_grams"))
    if stopgrams is not None:
        kept = each.groupBy("__k").agg(F.count_distinct("gram").alias("n_kept"))
        counted = counted.join(kept, "__k", "left").na.fill(0, ["n_kept"])
    else:
        counted = counted.withColumn("n_kept", F.col("n_grams"))
    posts, once = index.postings, met.select("__k", "gram_id").distinct()
    code = F.array_position(F.array(*[F.lit(b) for b in index.names]), F.col("benchmark")) - 1 if index.names else F.lit(0)
    of = small(posts.select("gram_id", code.cast("int").alias("source_id")).distinct(), index.sizes[0])
    sources = once.join(of, "gram_id").groupBy("__k", "source_id").agg(F.count("*").alias("hits"))
    sources = sources.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("source_id", "hits"))).alias("sources"))
    of = small(posts.select("gram_id", "item_idx", "fan_out").distinct(), index.sizes[0])
    at = met.join(of, "gram_id")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("__k", "item_idx").orderBy("pos"))
    runs = at.select("__k", "item_idx", island.alias("island")).groupBy("__k", "item_idx", "island").agg(F.count("*").alias("n"))
    runs = runs.groupBy("__k", "item_idx").agg((F.max("n") + (n - 1)).cast("long").alias("longest_run_tokens"))
    fan = F.col("fan_out")
    split = once.join(of, "gram_id").groupBy("__k", "item_idx").agg(
        F.count("*").alias("hits"), F.count_if(fan <= 1).alias("unique_hits"), F.count_if((fan > 1) & (fan < boilerplate)).alias("shared_hits"),
        F.count_if((fan > 1) & (fan >= boilerplate)).alias("boilerplate_hits"),
    )
    sizes = index.items.select("item_idx", F.col("n_grams").alias("item_ngrams"))
    split = split.join(runs, ["__k", "item_idx"]).join(small(sizes, index.sizes[1]), "item_idx")
    items = split.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("item_idx", *_SPLIT))).alias("items"))
    found = counted.join(hits, "__k", "left").join(sources, "__k", "left").join(items, "__k", "left")
    found = materialised(found, "matched")
    none = {"hits": HITS, "sources": SOURCES, "items": ITEMS}
    # a table of distinct texts against rows: the rows' side can be split where a text is hot
    out = rows.select(*[F.col(f"`{c}`") for c in keep], "__k").join(found, "__k", "left")
    filled = [F.coalesce(c, F.array().cast(none[c])).alias(c) if c in none else F.coalesce(c, F.lit(0)).alias(c) if c == "n_hits" else F.col(c) for c in COLUMNS]
    return out.select(*[F.col(f"`{c}`") for c in keep], *filled)
