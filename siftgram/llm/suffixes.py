"""Suffix-array dedup of long repeated substrings (operator 3).

Every byte goes that lies in a string of `length` bytes that also starts earlier
(in a document with a smaller id, or earlier in the same one).

The collection is bucketed so that only suffixes that can share `length` bytes
meet. Each window of `length` bytes is anchored at the least hash among its
`gram`-byte substrings (leftmost on ties), so that equal windows have equal
anchors at equal distances. The windows of one anchor occurrence form a stretch.

1. Stretches are counted by anchor hash; what has a partner stays.
2. Equal stretches: all but the earliest go entirely (a partial aggregate).
3. Stretches that differ under one anchor: column-wise construction. Stretches are
   aligned at their anchors, and a round inserts one symbol of every stretch, from
   the last column to the first. A round's file below the shared folder holds the
   column's suffixes in order, their part of the collection's Burrows-Wheeler
   transform and their common prefixes; the next round reads it sequentially,
   sorts stably by the transform's symbols and writes its own. Suffixes that share
   `length` bytes are adjacent; all but the earliest of them are repeats.
   Stretches of many anchors go through the rounds together, as only equal anchors
   can agree.
4. An anchor of over HOT different stretches is not brought into one task: its
   windows are hashed (with the anchor, 128 bits) and their earliest occurrences
   found by partial aggregation.

Edge cases: a null text is empty; texts under `length` bytes keep everything.
Rows with one doc_id are ordered by a hash of their text; of rows that repeat as
a whole one counts as the first. A null doc_id comes last. Matches never cross
documents. An empty table gives no rows. Only key and text are read, so that other
columns can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.functions import kernels as K
from siftgram.llm.shared import materialised, released, scratch, with_types

LENGTH = 100
GRAM = 24
HOT = 500
_SPAN = 4 << 20  # bytes of a long document that are anchored at once
_RAW = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Stretches:
    """Anchors of a piece: doc, begin and end (bytes of the stretch within its document), at (anchor in it), hash, content hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pows: K.Powers, length: int, gram: int):
        n = len(data)
        w = length - gram + 1
        none = np.zeros(0, np.int64)
        self.doc = self.begin = self.end = self.at = none
        self.hash = self.content = none.astype(np.uint64)
        if n < length:
            return
        a, b = pows.upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_RAW[data] * a[:n], out=sums[1:])
            g = K.mix64((sums[gram:] - sums[:-gram]) * b[: n - gram + 1]) | np.uint64(1)
        least = K.sliding(g, w, np.minimum)  # per window start
        place = np.arange(len(g))
        # leftmost place of the minimum: of equal hashes under a window the first
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        start = np.arange(len(least))
        inside = doc[start] == doc[start + length - 1]
        # candidates: places that are a minimum of a window that begins at them or before
        padded = np.concatenate([np.zeros(w - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(w - 1, np.uint64)])
        is_min = (K.sliding(padded, w, np.maximum) == g)
        spots = place[is_min]
        if not len(spots) or not inside.any():
            return
        # for each window, the first spot from its start on with the window's minimum
        live = start[inside]
        k = np.searchsorted(spots, live)
        todo = np.flatnonzero(g[spots[k]] != least[live])
        while len(todo):
            k[todo] += 1
            todo = todo[g[spots[k[todo]]] != least[live[todo]]]
        anchor = spots[k]
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(live) != 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(live)]]) - 1
        begin, end = live[first], live[last] + length
        self.doc = doc[begin]
        base = offs[self.doc]
        self.begin, self.end, self.at = begin - base, end - base, anchor[first] - begin
        self.hash = g[anchor[first]]
        with np.errstate(over="ignore"):
            own = (sums[end] - sums[begin]) * b[begin]
            self.content = K.mix64(own + (end - begin).astype(np.uint64) * K.BASE + self.at.astype(np.uint64) * K.MULTIPLIER)


class Memory(dict):
    """Files of rounds in memory, for small inputs."""

    def write(self, name: str, data: bytes) -> None:
        self[name] = data

    def read(self, name: str) -> bytes:
        return self[name]

    def drop(self, name: str) -> None:
        del self[name]


class Folder:
    """Files of rounds below the shared folder; a task attempt has a folder of its own."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, base = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")
        self.base = f"{base}/rounds-{uuid.uuid4().hex}"
        self.store.create_dir(self.base, recursive=True)

    def write(self, name: str, data: bytes) -> None:
        with self.store.open_output_stream(f"{self.base}/{name}", compression=None) as f:
            f.write(data)

    def read(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.base}/{name}", compression=None) as f:
            return f.read()

    def drop(self, name: str) -> None:
        self.store.delete_file(f"{self.base}/{name}")

    def close(self) -> None:
        self.store.delete_dir(self.base)


def columns(data: np.ndarray, offs: np.ndarray, at: np.ndarray, order: np.ndarray, length: int, files: Memory | Folder) -> list[tuple[np.ndarray, np.ndarray]]:
    """Column-wise construction over stretches that are aligned at their anchors.

    Stretch i is data[offs[i]:offs[i + 1]], at[i] its anchor's place in it, order[i] its rank among occurrences: smaller is
    earlier. Returns (stretches, starts within them) of all windows that an earlier stretch has at the same place.

    A round's file holds, for the suffixes that begin at one column in their order: the stretch, the symbol before the
    suffix (the column's part of the collection's Burrows-Wheeler transform), and the common prefix with the suffix
    before. The next round reads it once from beginning to end. Its suffixes are those of the transform's symbols, in a
    stable sort by them, and besides the last symbols of stretches that end there; prefixes grow by one within a symbol.
    """
    size = np.diff(offs)
    left, right = int(at.max()), int((size - at).max())
    width = left + right
    shift = left - at  # the column where a stretch begins
    last = shift + size - 1
    ends = np.argsort(last, kind="stable")
    bound = np.searchsorted(last[ends], np.arange(width + 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before = lambda rows, c: np.where(shift[rows] < c, data[np.maximum(offs[rows] + c - 1 - shift[rows], 0)], 0).astype(np.uint8)
    kind = np.dtype([("stretch", "<i4"), ("bwt", "u1"), ("lcp", "<i4")])
    name = None
    for c in range(width - 1, -1, -1):
        fresh = ends[bound[c] : bound[c + 1]]  # suffixes of one symbol, which sort before longer ones
        if name is None:
            rank, symbol, lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        else:
            held = np.frombuffer(files.read(name), kind)
            files.drop(name)
            rank, symbol, lcp = held["stretch"].astype(np.int64), held["bwt"], held["lcp"].astype(np.int64)
            goes_on = shift[rank] <= c
            if not goes_on.all():  # stretches that begin to the right are done
                group = np.cumsum(goes_on) - 1
                low = np.full(int(goes_on.sum()), np.iinfo(np.int64).max)
                # the common prefix over removed suffixes is the least on the way
                step = np.where(goes_on, group, group + 1)
                inside = step < len(low)
                np.minimum.at(low, step[inside], lcp[inside])
                rank, symbol, lcp = rank[goes_on], symbol[goes_on], low
                if len(lcp):
                    lcp[0] = 0
        rank = np.concatenate([fresh, rank])
        s = np.concatenate([data[offs[fresh] + size[fresh] - 1], symbol])
        lcp = np.concatenate([np.zeros(len(fresh), np.int64), lcp])
        if len(fresh) and len(lcp) > len(fresh):
            lcp[len(fresh)] = 0
        if not len(rank):
            name = None
            continue
        by = np.argsort(s, kind="stable")
        # new common prefix: one more than the least old one between two that stand together under one symbol
        new = np.zeros(len(rank), np.int64)
        same = np.flatnonzero(s[by][1:] == s[by][:-1]) + 1
        if len(same):
            near = by[same] == by[same - 1] + 1
            new[same[near]] = lcp[by[same[near]]] + 1
            rest = same[~near]
            if len(rest):
                edges = np.empty(2 * len(rest), np.int64)
                edges[0::2], edges[1::2] = by[rest - 1] + 1, by[rest] + 1
                new[rest] = np.minimum.reduceat(np.append(lcp, 0), edges)[0::2] + 1
        rank, lcp = rank[by], np.minimum(new, length)
        if len(rank) > 1:
            full = lcp >= length
            if full.any():
                group = np.cumsum(~full)
                least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, group, order[rank])
                later = (np.bincount(group)[group] > 1) & (order[rank] > least[group])
                if later.any():
                    found.append((rank[later], c - shift[rank[later]]))
        if c:
            name = f"column-{c}"
            out = np.empty(len(rank), kind)
            out["stretch"], out["bwt"], out["lcp"] = rank, before(rank, c), lcp
            files.write(name, out.tobytes())
    return found


def _occurrences(keyed: DataFrame, length: int, gram: int, kind: str) -> DataFrame:
    names = ["hash", "content", "k", "th", "place"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(2), 1 << 20):
                # a stretch that a span's end cuts in two is two stretches under one anchor: still exact
                for base in range(0, max(1, len(data)), _SPAN) if j == i + 1 else (0,):
                    part = (data[base : base + _SPAN + length - 1], np.array([0, min(len(data) - base, _SPAN + length - 1)])) if j == i + 1 else (data, offs)
                    s = Stretches(*part, pows, length, gram)
                    if not len(s.doc):
                        continue
                    row = pa.array(s.doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.hash.view(np.int64)), pa.array(s.content.view(np.int64)), batch.column(0).slice(i, j - i).take(row), batch.column(1).slice(i, j - i).take(row),
                         pa.array(((s.begin + base) << 32) | ((s.end - s.begin) << 16) | s.at)],
                        names=names,
                    )

    return keyed.mapInArrow(scan, f"hash long, content long, k {kind}, th long, place long")


def _unpacked() -> list:
    """begin, end and at of a stretch, whose place packs begin, size and anchor in 32, 16 and 16 bits."""
    begin = F.shiftright("place", 32).cast("int")
    size = F.shiftright("place", 16).bitwiseAND(0xFFFF).cast("int")
    return [begin.alias("begin"), (begin + size).alias("end"), F.col("place").bitwiseAND(0xFFFF).cast("int").alias("at")]


def _key_order(k: str = "k", th: str = "th", begin: str = "begin"):
    """Occurrences in order: documents by id (null last), then by text hash, then by place."""
    return F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("k"), F.col(th).alias("th"), F.col(begin).alias("b"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [begin, end) bytes) for every document."""
    if not 0 < gram <= length:
        raise ValueError("the gram has to fit the length")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("th"), body.alias("t"))
    ids = keyed.select("k").groupBy("k").agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL")
    unique = ids.isEmpty()
    if unique:  # ids alone name the documents
        keyed = keyed.withColumn("th", F.lit(0).cast("long"))
    kind = keyed.schema["k"].dataType.simpleString()
    # anchors are found twice, in place of a table of them: most have no partner
    occ = _occurrences(keyed, length, gram, kind)
    shared = occ.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    shared = materialised(shared, "partners")  # a table, so that both sides of the join are exchanges that Spark can split
    near = materialised(occ.join(shared, "hash", "left_semi").select("hash", "content", "k", "th", "place"), "shared")
    released(near)
    mixed = near.groupBy("hash").agg(F.min("content").alias("c0"), F.max("content").alias("c1")).where("c0 <> c1").select("hash", F.lit(True).alias("mixed"))
    first = near.groupBy("content", "hash").agg(F.min(_key_order(begin="place")).alias("f"), F.count("*").alias("n"))
    first = materialised(first.join(mixed, "hash", "left").select("content", "hash", "f", "n", F.coalesce("mixed", F.lit(False)).alias("mixed")), "firsts")
    again = near.join(first.where("n > 1").select("content", "hash", "f"), ["content", "hash"]).where(_key_order(begin="place") != F.col("f"))
    whole = again.select("k", "th", *_unpacked()[:2])
    # rows that repeat as a whole have equal keys: they are not told apart here, see _finish
    open_ = first.where("mixed").select("hash", F.col("f.k").alias("k"), F.col("f.th").alias("th"), F.col("f.b").alias("place"))
    open_ = open_.select("hash", "k", "th", *_unpacked()).select("hash", "k", "th", "begin", (F.col("end") - F.col("begin")).alias("size"), "at")
    parts = _distinct_windows(keyed if unique else keyed.dropDuplicates(["k", "th"]), open_, kind, length)
    released(near)
    marks = whole.unionByName(parts).groupBy("k", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return _finish(keyed, marks, kind, length).withColumnRenamed("k", key)


def _distinct_windows(keyed: DataFrame, open_: DataFrame, kind: str, length: int) -> DataFrame:
    """(k, th, begin, end): windows of distinct stretches that an earlier distinct stretch of the same anchor has."""
    wanted = open_.groupBy("k", "th").agg(F.collect_list(F.struct("hash", "begin", "size", "at")).alias("spans"))
    rows = keyed.join(wanted.select(F.col("k").alias("k2"), F.col("th").alias("th2"), "spans"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")))
    rows = rows.select("k", "th", F.encode("t", "utf-8").alias("t"), F.explode("spans").alias("s"))
    cut = rows.select(F.col("s.hash").alias("hash"), "k", "th", F.col("s.begin").alias("begin"), F.col("s.at").alias("at"), F.substring(F.col("t"), F.col("s.begin") + 1, F.col("s.size")).alias("body"))
    cut = materialised(cut, "cut")
    released(cut)
    hot = materialised(cut.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash"), "hot")
    cool = cut.join(hot, "hash", "left_anti")
    out = _by_columns(cool, kind, length)
    if not hot.isEmpty():
        out = out.unionByName(_by_windows(cut.join(hot, "hash", "left_semi"), kind, length))
    return out


def _runs(row: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the bytes under windows of consecutive starts."""
    order = np.lexsort((at, row))
    r, w = row[order], at[order]
    cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(w) > 1)) + 1
    one, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(r)]]) - 1
    return r[one], w[one], w[last] + length


def _by_columns(cut: DataFrame, kind: str, length: int) -> DataFrame:
    place = scratch(cut.sparkSession, "suffix-rounds")
    lot = cut.repartition("hash").sortWithinPartitions("hash", F.col("k").isNull(), "k", "th", "begin").select("hash", "k", "th", "begin", "at", "body")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            data, offs = K.buffers(rows.column(5))
            found = columns(data, offs, rows.column(4).to_numpy().astype(np.int64), np.arange(rows.num_rows), length, files[0])
            if found:
                r, b, e = _runs(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), length)
                take, begin = pa.array(r), rows.column(3).to_numpy()[r]
                out = pa.Table.from_arrays([rows.column(1).take(take), rows.column(2).take(take), pa.array((begin + b).astype(np.int32)), pa.array((begin + e).astype(np.int32))], names=["k", "th", "begin", "end"])
                yield from out.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        files: list[Folder] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if not files:
                files.append(Folder(place))
            if size >= 60_000:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows.column(0).to_numpy()
                cut = int(np.argmax(h == h[-1]))
                if cut:
                    yield from done(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = rows.num_rows - cut
        if size:
            yield from done(pa.Table.from_batches(held).combine_chunks())
        if files:
            files[0].close()

    return lot.mapInArrow(scan, f"k {kind}, th long, begin int, end int")


def _by_windows(cut: DataFrame, kind: str, length: int) -> DataFrame:
    """Hot anchors: every window by its hash; of equal ones all but the earliest are repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(5), 1 << 19):
                a, b = pows.upto(len(data) + 1)
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(data) + 1, dtype=np.uint64)
                    np.cumsum(_RAW[data] * a[: len(data)], out=sums[1:])
                    n = np.diff(offs) - length + 1
                    row = np.repeat(np.arange(j - i), n)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    start = offs[row] + at
                    w = K.mix64((sums[start + length] - sums[start]) * b[start])
                take = pa.array(row)
                begin = batch.column(3).slice(i, j - i).to_numpy()[row] + at
                parts = [batch.column(c).slice(i, j - i).take(take) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(begin.astype(np.int32)), pa.array(w.view(np.int64))], names=["hash", "k", "th", "begin", "w"])

    every = materialised(cut.select("hash", "k", "th", "begin", "at", "body").mapInArrow(scan, f"hash long, k {kind}, th long, begin int, w long"), "windows")
    first = every.groupBy("hash", "w").agg(F.min(_key_order()).alias("f"), F.count("*").alias("n")).where("n > 1").select("hash", "w", "f")
    first = materialised(first, "windows-first")
    later = every.join(first, ["hash", "w"]).where(_key_order() != F.col("f"))
    return later.select("k", "th", "begin", (F.col("begin") + length).cast("int").alias("end"))


def _finish(keyed: DataFrame, marks: DataFrame, kind: str, length: int) -> DataFrame:
    """Applies the spans to the texts. Of rows that repeat as a whole, all but one lose every byte."""
    twice = materialised(keyed.groupBy("k", "th").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    rows = keyed.select("k", "th", "t", F.lit(1).cast("long").alias("n"))
    if not twice.isEmpty():
        # rows that repeat as a whole are one row with a count: their texts are aggregated before they move
        copies = twice.select(F.col("k").alias("k3"), F.col("th").alias("th3"))
        same = F.col("k").eqNullSafe(F.col("k3")) & (F.col("th") == F.col("th3"))
        again = keyed.join(copies, same, "left_semi").groupBy("k", "th").agg(F.first("t").alias("t"), F.count("*").alias("n"))
        rows = rows.join(copies, same, "left_anti").unionByName(again.select("k", "th", "t", "n"))
    left = rows.join(marks.select(F.col("k").alias("k2"), F.col("th").alias("th2"), "spans"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left").select("k", "t", "spans", "n")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size, removed, runs, sha, out = [], [], [], [], []
            for t, s in zip(texts, spans, strict=True):
                data = t.encode()
                marked = sorted((x["begin"], x["end"]) for x in s or ())
                merged: list[list[int]] = []
                for b, e in marked:
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([b, e])
                digest, at = hashlib.sha256(), 0
                for b, e in merged:
                    digest.update(data[at:b])
                    at = e
                digest.update(data[at:])
                size.append(len(data))
                removed.append(sum(e - b for b, e in merged))
                runs.append(len(merged))
                sha.append(digest.hexdigest())
                out.append([{"begin": b, "end": e} for b, e in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                names=["k", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    made = left.mapInArrow(scan, with_types(left, ["k", "n"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"))
    # the further rows of a group lose every byte that a window covers, which is all of them
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    made = made.select("k", copy, *[c for c in made.columns if c not in ("k", "n")])
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_bytes").cast("int").alias("end")))
    put = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": whole}
    return made.select("k", "n_bytes", *[F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in put.items()])
