"""SimHash near-duplicates through an LSH forest (operator 7).

1. Every text becomes a set of five-word shingles and a 128-bit SimHash of it.
   Texts with equal word sequences are one node (aggregated before they move).
2. The forest: each trie sorts the nodes by the bits of their SimHash in an order
   of its own. The depth at which candidates are sought, and the number of tries,
   follow from the number of nodes and the target recall at the threshold; in
   dense regions a bucket is refined to longer prefixes until it is of bounded
   size. Tries are range-partitioned, so that no prefix, however dense, has to
   fit one task. Candidates within a bucket are compared on all 128 bits; sparse
   nodes keep every candidate, dense ones at first their nearest in each trie.
3. Candidates are verified by exact Jaccard similarity of their shingle sets.
4. Buckets that were refined, that lie over the end of a range or that the first
   pass left pairs of are open: the climb goes back to the depth that reaches the
   recall, and a bucket is whole whatever its size. Every pair of theirs within
   the distance limit is verified, the nearest first, but for pairs that verified
   links already put in one class, and pairs of sets too unequal in size. Large
   ones are compared block by block; a pair is compared in the first trie where
   it meets, and sets travel to blocks, not to pairs.
5. Verified links form classes (connected components); the class id is the
   smallest doc_id.

Edge cases: a null text is a class of its own. Texts of no words are copies only
of byte-equal texts. Texts of under five words are one shingle. Repeated rows
belong to one class. Ties go to smaller node ids. An empty table gives no rows.
Nodes are named by 64 bits of a hash of their words. Only key and text are read,
and own columns of any name come back through a struct, so that none can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.functions import kernels as K
from siftgram.llm.components import components
from siftgram.llm.shared import materialised, shared_dir, with_types

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.998
BUCKET = 256  # nodes that a bucket of the shallowest depth holds, about
MOST = 1024  # larger buckets are refined
NEAREST = 4  # candidates that a dense node keeps in each trie at first
SPARSE = 16  # a node with no more candidates than this keeps all at first
BLOCK = 4096  # nodes of an open bucket that are compared at once, about
#: Open buckets that may be broadcast; above, a join takes their place.
BROADCAST_ROWS = 1_000_000
_BITS = 128
_LANES = np.uint64(0x0101010101010101)


def _distance_limit(threshold: float) -> int:
    """Bits in which SimHashes of sets at the threshold differ, plus 3.6 deviations."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return round(_BITS * p + 3.6 * math.sqrt(_BITS * p * (1 - p)))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(depth, tries) for n nodes: the depth holds buckets near BUCKET, the tries reach the recall."""
    same = 1 - math.acos(2 * threshold / (1 + threshold)) / math.pi
    depth = min(40, max(6, math.ceil(math.log2(max(2, n / BUCKET)))))
    tries = math.ceil(math.log(1 - recall) / math.log(1 - same**depth))
    return depth, max(4, tries)


def shingle_sets(words: K.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 40-bit shingle hash), sorted and distinct within each document."""
    counts = words.counts()
    g = K.grams(words.hash, k)
    inside = words.doc[: len(g)] == words.doc[k - 1 : k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    v = (words.doc[: len(g)][inside].astype(np.uint64) << np.uint64(40)) | (g[inside] >> np.uint64(24))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([K.grams(words.hash[words.first[d] : words.first[d + 1]], int(counts[d]))[0] for d in short], dtype=np.uint64)
        v = np.concatenate([v, (short.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24))])
    v.sort()
    if len(v):
        v = v[np.concatenate([[True], v[1:] != v[:-1]])]
    return (v >> np.uint64(40)).astype(np.int64), v & np.uint64((1 << 40) - 1)


def _majority(values: np.ndarray, first: np.ndarray, n_docs: int) -> np.ndarray:
    """The SimHash word of each document's values (rows first[d] to first[d+1])."""
    counts = np.diff(first)
    out = np.zeros(n_docs, dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)  # byte lanes hold sums up to 255
    at = np.repeat(first[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    begin = np.cumsum(pieces) - pieces
    for s in range(8):
        lanes = np.add.reduceat((values >> np.uint64(s)) & _LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(bits).view(np.uint64).reshape(-1) << np.uint64(s)
    return out


def _node_hash(words: K.Words, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64 bits of each word sequence; of the bytes where there is no word."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words.hash), dtype=np.uint64) - words.first[words.doc].astype(np.uint64)
        mixed = K.mix64(words.hash + place * K.MULTIPLIER)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out = K.mix64((sums[words.first[1:]] - sums[words.first[:-1]]) + words.counts().astype(np.uint64) * K.BASE)
    for d in np.flatnonzero(words.counts() == 0):
        out[d] = np.frombuffer(hashlib.blake2b(data[offs[d] : offs[d + 1]].tobytes(), digest_size=8, person=b"no words").digest(), np.uint64)[0]
    return out


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, node, s1, s2 (SimHash), n (distinct shingles) per document; node is null for a null text."""
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            column = batch.column(1)
            null = np.asarray(column.is_null())
            for i, j, data, offs in K.pieces(column):
                words = K.Words(data, offs, pows)
                doc, low = shingle_sets(words)
                first = np.searchsorted(doc, np.arange(words.n_docs + 1))
                with np.errstate(over="ignore"):
                    s1 = _majority(K.mix64(low * K.BASE), first, words.n_docs)
                    s2 = _majority(K.mix64(low * K.MULTIPLIER + np.uint64(77)), first, words.n_docs)
                node = pa.array(_node_hash(words, data, offs).view(np.int64), mask=null[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), node, pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.diff(first))], names=["k", "node", "s1", "s2", "n"])

    return narrow.mapInArrow(scan, with_types(narrow, ["k"], "node long, s1 long, s2 long, n long"))


def _orders(tries: int) -> list[np.ndarray]:
    """Each trie's own order of the bits."""
    return [np.random.Generator(np.random.PCG64(1000 + t)).permutation(_BITS) for t in range(tries)]


def _tries(nodes: DataFrame, tries: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(trie, key, rest, node) and `more` columns of long: a node's bits, in each trie's own order."""
    orders = _orders(tries)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                s = np.stack([part.column(1).to_numpy(), part.column(2).to_numpy()], axis=1).astype(">i8")
                bits = np.unpackbits(s.view(np.uint8).reshape(len(s), 16), axis=1)
                for t, order in enumerate(orders):
                    moved = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").astype(np.uint64)
                    # the sign bit is flipped so that Spark's signed order is the order of the bits
                    key = (moved[:, 0] ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), t, np.int32)), pa.array(key), pa.array(moved[:, 1].copy().view(np.int64)), part.column(0), *part.columns[3:]], names=["trie", "key", "rest", "node", *more])

    return nodes.select("node", "s1", "s2", *more).mapInArrow(spread, ", ".join(["trie int, key long, rest long, node long", *[f"{c} long" for c in more]]))


def buckets(trie: np.ndarray, key: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of buckets over rows sorted by (trie, key): prefixes of `depth` bits, refined while larger than most."""
    found, todo = [], [(0, len(key))]
    for d in range(depth, 65):
        later = []
        for lo, hi in todo:
            p = key[lo:hi] >> np.uint64(64 - d)
            cut = np.flatnonzero((p[1:] != p[:-1]) | (trie[lo + 1 : hi] != trie[lo : hi - 1])) + 1
            start = lo + np.concatenate([[0], cut])
            end = lo + np.concatenate([cut, [hi - lo]])
            big = end - start > most
            found.append((start[~big], end[~big]))
            later += list(zip(start[big].tolist(), end[big].tolist(), strict=True))
        todo = later
        if not todo:
            break
    for lo, hi in todo:  # equal keys: windows that overlap by one keep them connected
        start = np.arange(lo, hi - 1, most - 1)
        found.append((start, np.minimum(start + most, hi)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def candidates(start, end, key, rest, node, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of nodes within buckets, at most `limit` bits apart, in pieces of bounded size, and a row of each pair left out."""
    many = end - start >= 2
    start, end = start[many], end[many]
    size = end - start
    order = np.argsort(size, kind="stable")
    start, end, size = start[order], end[order], size[order]
    load = np.cumsum(size * (size - 1) // 2)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + 4_000_000, side="right")))
        rows = np.repeat(start[at:stop], size[at:stop]) + (np.arange(size[at:stop].sum()) - np.repeat(np.cumsum(size[at:stop]) - size[at:stop], size[at:stop]))
        last = np.repeat(end[at:stop], size[at:stop])
        got = []
        for o in range(1, int(size[stop - 1])):
            live = rows + o < last
            rows, last = rows[live], last[live]
            far = np.bitwise_count(key[rows] ^ key[rows + o]).astype(np.int16) + np.bitwise_count(rest[rows] ^ rest[rows + o])
            hit = np.flatnonzero(far <= limit)
            if len(hit):
                got.append((rows[hit], rows[hit] + o, far[hit]))
        at = stop
        if not got:
            continue
        a, b, far = (np.concatenate([g[i] for g in got]) for i in range(3))
        n = np.bincount(np.concatenate([a, b]), minlength=1)
        keep = (n[a] <= SPARSE) | (n[b] <= SPARSE)
        dense = np.flatnonzero(~keep)
        if len(dense):  # of dense nodes, the nearest on either side
            one, two, f = np.concatenate([a[dense], b[dense]]), np.concatenate([b[dense], a[dense]]), np.concatenate([far[dense]] * 2)
            o = np.lexsort((node[two], f, one))
            rank = np.arange(len(o)) - np.repeat(*(lambda c: (np.cumsum(c) - c, c))(np.unique(one[o], return_counts=True)[1]))
            keep[dense[o[rank < NEAREST] % len(dense)]] = True
        x, y = node[a[keep]], node[b[keep]]
        yield np.minimum(x, y), np.maximum(x, y), np.unique(a[~keep])


def _pairs(tries: DataFrame, depth: int, limit: int) -> DataFrame:
    """(a, b, open): pairs of nodes and, where open holds, (trie, prefix) of buckets that pairs may be missing of."""

    def prefixes(key):
        return (key ^ np.uint64(1 << 63)).view(np.int64) >> np.int64(64 - depth)

    def batch_of(a, b, open_):
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b), pa.array(np.full(len(a), open_))], names=["a", "b", "open"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        begun = False

        def flush(rows, all_of_them):
            nonlocal begun
            trie, key, rest, node = (np.concatenate([h[i] for h in rows]) for i in range(4))
            cut = len(key)
            if not all_of_them:  # the bucket at the end may go on
                p = key >> np.uint64(64 - depth)
                change = np.flatnonzero((p[1:] != p[:-1]) | (trie[1:] != trie[:-1]))
                cut = int(change[-1]) + 1 if len(change) else len(key)
            out = []
            if cut:
                start, end = buckets(trie[:cut], key[:cut], depth, MOST)
                left = []
                for x, y, z in candidates(start, end, key[:cut], rest[:cut], node[:cut], limit):
                    out.append(batch_of(x, y, False))
                    left.append(z)
                p = key[:cut] >> np.uint64(64 - depth)
                first = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (trie[1:cut] != trie[: cut - 1])) + 1])
                left.append(first[np.diff(np.append(first, cut)) > MOST])  # refined: pairs of shorter prefixes are missing
                # a bucket at either end of a range, or cut for its size, may go on elsewhere
                ends = [0] * (not begun) + [cut - 1] * (all_of_them or cut == len(key))
                left.append(np.array(ends, dtype=np.int64))
                begun = True
                left = np.concatenate(left)
                at = np.unique(np.stack([trie[left].astype(np.int64), prefixes(key[left])]), axis=1)
                out.append(batch_of(at[0], at[1], True))
            return out, [(trie[cut:], key[cut:], rest[cut:], node[cut:])]

        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            held.append((batch.column(0).to_numpy(), key, batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()))
            size += batch.num_rows
            if size >= 500_000:
                out, held = flush(held, False)
                size = len(held[0][0])
                yield from out
        if size:
            yield from flush(held, True)[0]

    return tries.mapInArrow(scan, "a long, b long, open boolean").distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def across(s1, s2, n, root, side, limit: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (i, j) and their distances, of all pairs of different roots within the limit, of sizes that allow the threshold; between sides, where there are two."""
    of, counts = np.unique(root, return_inverse=True, return_counts=True)[1:]
    main = of == np.argmax(counts)  # rows of the commonest root need not meet each other
    everything = np.arange(len(s1))
    if len(np.unique(side)) > 1:
        one, two = side == side.min(), side != side.min()
        jobs = [(np.flatnonzero(one & ~main), np.flatnonzero(two)), (np.flatnonzero(two & ~main), np.flatnonzero(one & main))]
    else:
        jobs = [(np.flatnonzero(~main), everything)]
    for left, right in jobs:
        step = max(1, 1_000_000 // max(1, len(right)))
        for at in range(0, len(left), step):
            i = left[at : at + step, None]
            far = np.bitwise_count(s1[i] ^ s1[right]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[right])
            x, y = np.nonzero(far <= limit)
            far, x, y = far[x, y], left[at + x], right[y]
            fits = (of[x] != of[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9)
            if fits.any():
                yield x[fits], y[fits], far[fits]


def prefixes_of(s1, s2, tries: int, depth: int) -> np.ndarray:
    """(tries, rows): the first `depth` bits of nodes in each of the first tries."""
    bits = np.unpackbits(np.stack([s1, s2], axis=1).view(np.int64).astype(">i8").view(np.uint8).reshape(len(s1), 16), axis=1)
    weights = np.int64(1) << np.arange(depth, dtype=np.int64)
    orders = _orders(tries)
    return np.stack([bits[:, o[:depth]] @ weights for o in orders]) if tries else np.zeros((0, len(s1)), np.int64)


class Cell:
    """Nodes of an open bucket, or of two of its blocks, that may be links between classes."""

    def __init__(self, trie, s1, s2, node, n, root, side, depth: int, limit: int, threshold: float):
        self.s1, self.s2, self.node, self.n, self.root, self.side = s1.view(np.uint64), s2.view(np.uint64), node, n, root, side
        self.limit, self.threshold = limit, threshold
        self.before = prefixes_of(s1, s2, int(trie), depth)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and distances of pairs that meet in this trie first: those that share a bucket of an earlier one are compared there."""
        for x, y, far in across(self.s1, self.s2, self.n, self.root, self.side, self.limit, self.threshold):
            new = ~(self.before[:, x] == self.before[:, y]).any(axis=0)
            if new.any():
                yield x[new], y[new], far[new]

    def near(self) -> np.ndarray:
        """Rows that are in some pair."""
        seen = np.zeros(len(self.node), bool)
        for x, y, _ in self.pairs():
            seen[x] = seen[y] = True
        return np.flatnonzero(seen)

    def links(self, values: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Rows of verified pairs, enough to connect all classes that some pair links. values, first: the rows' shingle sets.

        A pair of classes is one as soon as one pair of theirs is verified; the nearest are looked at first, and all
        others only of classes that stay apart.
        """
        label = np.unique(self.root, return_inverse=True)[1]
        for xs, ys, fars in self.pairs():
            for one in np.split(np.argsort(xs, kind="stable"), np.flatnonzero(np.diff(np.sort(xs))) + 1):
                x = int(xs[one[0]])
                todo = ys[one[np.argsort(fars[one], kind="stable")]]
                mine, size = values[first[x] : first[x + 1]], 8
                while len(todo := todo[label[todo] != label[x]]):
                    now, todo = todo[:size], todo[size:]
                    size *= 4
                    count = first[now + 1] - first[now]
                    at = np.repeat(first[now], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                    place = np.minimum(np.searchsorted(mine, values[at]), len(mine) - 1)
                    common = np.add.reduceat(mine[place] == values[at], np.cumsum(count) - count)
                    for y in now[common >= self.threshold * (len(mine) + count - common)].tolist():
                        if label[y] != label[x]:
                            label[label == label[y]] = label[x]
                            yield x, y


def _cells(rows: DataFrame, sizes: DataFrame, depth: int, limit: int, threshold: float, out: str, make) -> DataFrame:
    """make(cell, set column) over the cells of open buckets; rows: trie, prefix, s1, s2, node, n, root and, where they are to be verified, sh."""
    dealt = rows.join(_small(sizes), ["trie", "prefix"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["trie", "prefix", "x", "y"]
    sets = ["sh"] if "sh" in rows.columns else []
    dealt = dealt.select("trie", "prefix", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "s1", "s2", "node", "n", "root", "side", *sets)
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            c = [table.column(i).to_numpy() for i in range(10)]
            own = Cell(c[0][0], c[4], c[5], c[6], c[7], c[8], c[9], depth, limit, threshold)
            yield from make(own, c[0][0], c[1][0], table.column(10).combine_chunks() if sets else None)

        def cut(rows: list[pa.RecordBatch], all_of_them: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            keys = [table.column(i).to_numpy() for i in range(4)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            ends = [0, *change.tolist(), *([table.num_rows] if all_of_them else [])]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                yield from whole(table.slice(lo, hi - lo))
            held[:] = table.slice(ends[-1]).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from cut([*held, batch], False)
        if held:
            yield from cut(held, True)

    return dealt.mapInArrow(scan, out)


def _open_links(nodes: DataFrame, opened: DataFrame, depth: int, tries: int, limit: int, threshold: float, sets_of) -> DataFrame:
    """(a, b): links that connect whatever pairs of open buckets (trie, prefix) connect. nodes: node, s1, s2, n, root.

    Nodes with a pair to verify are found first, by their prints; sets_of(nodes) gives the shingle sets of those alone, and a
    set travels to the cells of its node, not with every pair.
    """
    rows = _tries(nodes.withColumn("b1", F.col("s1")).withColumn("b2", F.col("s2")), tries, ("n", "root", "b1", "b2")).withColumn("prefix", F.shiftright("key", 64 - depth))
    rows = rows.select("trie", "prefix", F.col("b1").alias("s1"), F.col("b2").alias("s2"), "node", "n", "root")
    mine = rows.join(_small(opened), ["trie", "prefix"], "left_semi")
    sizes = mine.groupBy("trie", "prefix").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    sizes = materialised(sizes.select("trie", "prefix", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "open-buckets")

    def near(cell: Cell, trie, prefix, _) -> Iterator[pa.RecordBatch]:
        who = cell.node[cell.near()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), trie, np.int32)), pa.array(np.full(len(who), prefix, np.int64)), pa.array(who)], names=["trie", "prefix", "node"])

    some = materialised(_cells(rows, sizes, depth, limit, threshold, "trie int, prefix long, node long", near).distinct(), "open-nodes")
    sh = sets_of(some.select("node").distinct())

    def links(cell: Cell, trie, prefix, sets) -> Iterator[pa.RecordBatch]:
        first = sets.offsets.to_numpy().astype(np.int64)
        found = list(cell.links(sets.values.to_numpy(), first))
        a, b = (cell.node[np.array([f[i] for f in found], np.int64)] for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    rest = rows.join(some, ["trie", "prefix", "node"], "left_semi").join(sh, "node").select("trie", "prefix", "s1", "s2", "node", "n", "root", "sh")
    blocks = rest.groupBy("trie", "prefix").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return _cells(rest, materialised(blocks, "open-blocks"), depth, limit, threshold, "a long, b long", links).distinct()


def _shingles(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, sh): shingle sets of the wanted nodes, each from its representative's text."""
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = narrow.join(wanted, F.col("k").eqNullSafe(F.col("rep")), "inner").select("t", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(0)):
                words = K.Words(data, offs, pows)
                # a key may stand on rows with other texts: those are not this node
                mine = _node_hash(words, data, offs).view(np.int64) == batch.column(1).slice(i, j - i).to_numpy()
                doc, low = shingle_sets(words)
                first = np.searchsorted(doc, np.arange(words.n_docs + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(low.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), lists], names=["node", "sh"]).filter(pa.array(mine))

    return rows.mapInArrow(scan, "node long, sh array<long>")


def _named(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, rep) of the nodes in pairs."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_semi").select("node", "rep")


def _verified(pairs: DataFrame, sh: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""
    left = pairs.join(sh.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a")
    both = left.join(sh.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """key, node, root, class_id, one row per document. root names the class by its smallest node, class_id by its
    smallest key; where keys repeat on different texts, classes may share a class_id but no root."""
    shared_dir(docs.sparkSession)
    every = materialised(prints(docs, key, text), "prints")
    nodes = materialised(every.where("node is not null").groupBy("node").agg(F.min("k").alias("rep"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("n").alias("n")), "nodes")
    # J >= t between different sets needs a union of at least 1 / (1 - t)
    open_ = nodes.where(F.col("n") >= math.ceil(threshold / (1 - threshold) - 1e-9))
    depth, tries = plan(open_.count(), threshold, recall)
    limit = _distance_limit(threshold)
    forest = _tries(open_, tries).repartitionByRange("trie", "key").sortWithinPartitions("trie", "key")
    found = materialised(_pairs(forest, depth, limit), "pairs")
    pairs = found.where("not open").select("a", "b")
    sh = materialised(_shingles(docs, _named(nodes, pairs), key, text).dropDuplicates(["node"]), "shingles")
    links = _verified(pairs, sh, threshold)
    opened = found.where("open").select(F.col("a").cast("int").alias("trie"), F.col("b").alias("prefix"))
    if not opened.isEmpty():
        stars = materialised(components(links, "a", "b"), "first-roots")
        known = open_.join(stars, "node", "left").select("node", "s1", "s2", "n", F.coalesce("root", "node").alias("root"))

        def sets_of(wanted: DataFrame) -> DataFrame:
            unread = materialised(wanted.join(sh, "node", "left_anti").join(nodes.select("node", "rep"), "node"), "unread")
            more = materialised(_shingles(docs, unread, key, text).dropDuplicates(["node"]), "more-shingles")
            return sh.unionByName(more)

        found = _open_links(known, opened, depth, tries, limit, threshold, sets_of)
        links = stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(materialised(found, "open-links"))
    roots = components(links, "a", "b")
    linked = nodes.join(roots, "node").select("node", "rep", "root").checkpoint()
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_linked = linked.join(least, "root").select("node", "class_id", "root")
    of_node = nodes.select("node", "rep").join(of_linked, "node", "left")
    of_node = of_node.select(F.col("node").alias("n2"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("root", "node").alias("root"))
    of_node = materialised(of_node, "node-classes")  # a table: the copies' side of the join can be split
    got = every.select("k", "node").join(of_node, F.col("node") == F.col("n2"), "left")
    return got.select(F.col("k").alias(key), "node", "root", F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest key, with its own columns."""
    found = materialised(classes(docs, key, text), "classes").withColumnRenamed(key, "_k")
    first = found.where(F.col("node").isNotNull()).groupBy(F.col("root").alias("_c")).agg(F.min_by("node", F.struct("_k", "node")).alias("_n"), F.min("_k").alias("_f"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    gone = found.where("node is not null").join(first, F.col("root") == F.col("_c")).where(~F.col("_k").eqNullSafe(F.col("_f")) | (F.col("node") != F.col("_n")))
    # rows that repeat as a whole keep one; they are few, and only they are put together
    again = found.where("node is not null").groupBy("_k", "node").agg(F.count("*").alias("c")).where("c > 1")
    kept = own
    if not gone.isEmpty():
        names = gone.select("_k", "node").distinct()
        # keys that stand on several texts need the node as well; a null text counts as one more
        crowded = found.groupBy("_k").agg(F.count_distinct(F.coalesce("node", F.lit(0))).alias("d")).where("d > 1")
        if crowded.isEmpty():
            kept = own.join(names.select("_k"), F.col("k").eqNullSafe(F.col("_k")), "left_anti")
        else:
            marked = prints(own, "row", "t").withColumnRenamed("k", "row").withColumn("k", F.col(f"row.`{key}`")).withColumn("t", F.col(f"row.`{text}`"))
            kept = marked.join(names.withColumnRenamed("node", "_n"), F.col("k").eqNullSafe(F.col("_k")) & (F.col("node") == F.col("_n")), "left_anti").select("row", "k", "t")
    if not again.isEmpty():
        twice = again.select("_k").distinct()
        single = kept.join(twice, F.col("k").eqNullSafe(F.col("_k")), "left_anti")
        rest = kept.join(twice, F.col("k").eqNullSafe(F.col("_k")), "left_semi")
        kept = single.unionByName(rest.where("t is null")).unionByName(rest.where("t is not null").dropDuplicates(["k", "t"]))
    return kept.select("row.*")
