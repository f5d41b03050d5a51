"""Line dedup through a log-template tree (operator 4).

Lines are parsed into a tree of fixed depth: by token count, then by leading
tokens (tokens with digits stand for any number). Below a leaf, a token that
recurs at its position is part of the template and any other is a variable
field, so that lines that differ only in such fields share one template.
A template that recurs across documents is dropped everywhere.

Copies and near copies of one document are no recurrence. A document's sketch is
the least of its word shingles in each of ORDERS hash orders. Of a template's
documents, those that share a sketch count once; each of the others counts
1 / f, f being how many of them have what it has in the AGREE-th commonest of
its orders: a family of near copies agrees in most orders and counts about once,
however many they are, and takes nothing from the documents beside it. A
template recurs when this count reaches `short_docs`, or `long_docs` from
`long_words` tokens on, as long lines hardly recur by chance.

All counts are partial aggregates over thin hash rows, and sketches are looked up
only for documents of templates that can recur. Distinct lines, not lines, are
parsed below the leaves: those of a leaf meet in one task, as do the documents of
a template, up to a bounded size. Larger leaves and templates are exploded to
tokens and orders and go through partial aggregates and joins, to the same result.

Edge cases: null and empty texts have no lines to drop and stay as they are.
Lines of under `min_tokens` tokens are never dropped. Repeated rows share their
sketch, so that they count once, and lose the same lines. A text whose lines all
go becomes empty. An empty table gives no rows. Own columns of any name stand in
a struct and can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgram.functions import kernels as K
from siftgram.llm.shared import materialised, with_types

SHORT_DOCS = 10
LONG_DOCS = 2
LONG_WORDS = 20
MIN_TOKENS = 3
LEADING = 3
CONSTANT_SHARE = 0.7
SHINGLE = 5
ORDERS = 16
AGREE = 9
#: Hashes that may be broadcast (8 bytes each); above, a join takes their place. For the lines to drop, 8 times as many: that join moves the texts.
BROADCAST_ROWS = 1_000_000
#: Tokens of the distinct lines of a leaf, and documents of a template, that one task takes together.
LEAF_TOKENS = 1 << 20
TEMPLATE_DOCS = 1 << 15
_NUMBER = np.uint64(0x5851F42D4C957F2D)
_TURNS = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Lines:
    """Lines of a piece that have a word: doc, start, end (bytes), first word, words, tree leaf, hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pows: K.Powers):
        words = K.Words(data, offs, pows)
        self.words = words
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offs[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.minimum(np.append(starts[1:], len(data)), len(data))
        first = np.searchsorted(words.starts, starts)
        count = np.append(first[1:], len(words.starts)) - first
        some = np.flatnonzero(count > 0)
        self.start, self.end, self.first, self.count = starts[some], ends[some], first[some], count[some]
        self.doc = words.doc[self.first] if len(some) else np.zeros(0, np.int64)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.token = np.where(digits[words.ends] > digits[words.starts], _NUMBER, words.hash)
        with np.errstate(over="ignore"):
            if len(some):
                line = np.repeat(np.arange(len(some)), self.count)
                place = (np.arange(len(line)) - np.repeat(np.cumsum(self.count) - self.count, self.count)).astype(np.uint64)
                mixed = K.mix64(self.token + place * K.MULTIPLIER)
                self.hash = K.mix64(np.add.reduceat(mixed, self.first) + self.count.astype(np.uint64) * K.BASE)
                lead = np.where(place < LEADING, mixed, np.uint64(0))
                self.leaf = K.mix64(np.add.reduceat(lead, self.first) + self.count.astype(np.uint64) * K.BASE + np.uint64(1))
            else:
                self.hash = self.leaf = np.zeros(0, np.uint64)


def sketches(words: K.Words) -> np.ndarray:
    """(documents, ORDERS): the least shingle of each document in each order; all ones without a word."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((words.n_docs, ORDERS), none)
    counts = words.counts()
    g = K.grams(words.hash, SHINGLE)
    whole = np.flatnonzero(counts >= SHINGLE)
    if len(whole):
        inside = words.doc[: len(g)] == words.doc[SHINGLE - 1 : SHINGLE - 1 + len(g)]
        with np.errstate(over="ignore"):
            for r, turn in enumerate(_TURNS):
                out[whole, r] = np.minimum.reduceat(np.where(inside, g * turn, none), words.first[whole])
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        out[d] = K.grams(words.hash[words.first[d] : words.first[d + 1]], int(counts[d]))[0]
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), _long(values))


def _thin(texts: DataFrame, min_tokens: int) -> DataFrame:
    """(leaf, line, n: lists of the lines; sketch) per document that has a line of min_tokens tokens."""
    names = ["leaf", "line", "n", "sketch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(0)):
                lines = Lines(data, offs, pows)
                use = lines.count >= min_tokens
                sizes = np.bincount(lines.doc[use], minlength=j - i)
                own = [_lists(x[use], sizes) for x in (lines.leaf, lines.hash, lines.count)]
                sketch = _lists(sketches(lines.words).reshape(-1), np.full(j - i, ORDERS))
                yield pa.RecordBatch.from_arrays([*own, sketch], names=names).filter(pa.array(sizes > 0))

    return texts.mapInArrow(scan, ", ".join(f"{n} array<long>" for n in names))


class Members:
    """A set of hashes, sent to tasks: exact up to BROADCAST_ROWS, beyond that a bitmap of 16 bits or more a hash that lets a few others in."""

    SLICE = 1 << 23
    MOST_BITS = 30

    def __init__(self, df: DataFrame):
        """df: one column of distinct long values."""
        (name,) = df.columns
        n = df.count()
        read = lambda x: x.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        if n <= BROADCAST_ROWS:
            self.bits, values = 0, np.sort(read(df))
        else:
            self.bits = min(self.MOST_BITS, max(10, (16 * n).bit_length()))
            values = np.zeros(1 << (self.bits - 3), np.uint8)
            slices = -(-n // self.SLICE)
            for i in range(slices):
                at = np.unique(read(df.where(F.pmod(F.col(name), F.lit(slices)) == i)) >> np.uint64(64 - self.bits)).astype(np.int64)
                if len(at):
                    starts = np.flatnonzero(np.diff(at >> 3, prepend=-1))
                    values[at[starts] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), starts)
        self.shared = df.sparkSession.sparkContext.broadcast(values)

    def has(self, x: np.ndarray) -> np.ndarray:
        values = self.shared.value
        if self.bits:
            at = (x >> np.uint64(64 - self.bits)).astype(np.int64)
            return (values[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        if not len(values):
            return np.zeros(len(x), bool)
        return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _tokens(texts: DataFrame, min_tokens: int, leaves: Members) -> DataFrame:
    """(leaf, line, tokens) below leaves; a line once for each piece that has it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for _, _, data, offs in K.pieces(batch.column(0)):
                lines = Lines(data, offs, pows)
                use = np.flatnonzero(lines.count >= min_tokens)
                use = use[leaves.has(lines.leaf[use])]
                _, one = np.unique(lines.hash[use], return_index=True)
                one = use[one]
                n = lines.count[one]
                take = np.repeat(lines.first[one], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                yield pa.RecordBatch.from_arrays([_long(lines.leaf[one]), _long(lines.hash[one]), _lists(lines.token[take], n)], names=["leaf", "line", "tokens"])

    return texts.mapInArrow(scan, "leaf long, line long, tokens array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in the order of their first column, cut anew so that equal values of it stand in one."""
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if left and (cut or left[-1].column(0)[-1].as_py() != key[0]):
            yield whole([*left, batch.slice(0, cut)])
            left = []
        elif cut:
            yield batch.slice(0, cut)
        left.append(batch.slice(cut))
    if left:
        yield whole(left)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of these columns differs from the row before; the first row does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _parsed(tokens: DataFrame, counts: DataFrame, short_docs: int, long_docs: int, long_words: int, min_tokens: int, constant_share: float) -> DataFrame:
    """(line, template) of tokens (leaf, line, tokens) with their counts (leaf, line, n); the lines of a leaf meet in one task."""

    def shapes(leaf: np.ndarray, line: np.ndarray, n: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
        token, size = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(token)) - first[row]
        place = (np.cumsum(np.diff(leaf, prepend=leaf[0]) != 0) * size.max())[row] + at
        order = np.lexsort((token, place))
        group = _changes(place[order], token[order])
        s = np.add.reduceat(n[row][order], group)
        fixed = np.zeros(len(token), bool)
        fixed[order] = np.repeat(s, np.diff(group, append=len(token))) >= np.where(size >= long_words, long_docs, short_docs)[row][order]
        with np.errstate(over="ignore"):
            x = np.bitwise_xor.reduceat(np.where(fixed, K.mix64(K.mix64(token) + at.astype(np.uint64) * K.MULTIPLIER), np.uint64(0)), first)
            template = K.mix64(leaf.view(np.uint64) * K.MULTIPLIER + K.mix64(x))
        ok = np.add.reduceat(fixed.astype(np.int64), first) >= np.maximum(min_tokens, np.ceil(constant_share * size))
        return pa.RecordBatch.from_arrays([pa.array(line[ok]), _long(template[ok])], names=["line", "template"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            leaf, line, n = (run.column(i).to_numpy() for i in range(3))
            same = _changes(leaf, line)
            total = np.add.reduceat(n, same)
            have = np.flatnonzero(run.column(3).is_valid().to_numpy(zero_copy_only=False))
            # a line of several pieces is taken once; one without a count came in by the bitmap
            of, one = np.unique(np.searchsorted(same, have, side="right") - 1, return_index=True)
            own, n = have[one][total[of] > 0], total[of][total[of] > 0]
            if not len(own):
                continue
            lists, starts = run.column(3).take(pa.array(own)), _changes(leaf[own])
            before = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
            cuts = [*starts[_changes(before[starts] // LEAF_TOKENS)].tolist(), len(own)]  # whole leaves, of about LEAF_TOKENS tokens
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield shapes(leaf[own[i:j]], line[own[i:j]], n[i:j], lists.slice(i, j - i))

    rows = tokens.select("leaf", "line", F.lit(0).cast("long").alias("n"), "tokens").unionAll(counts.select("leaf", "line", "n", F.lit(None).cast("array<long>").alias("tokens")))
    return rows.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(scan, "line long, template long")


def _parsed_wide(tokens: DataFrame, counts: DataFrame, need: Column, min_tokens: int, constant_share: float) -> DataFrame:
    """_parsed for leaves that are too large for one task: by token, through partial aggregates and a join."""
    distinct = tokens.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens")).join(counts.select("leaf", "line", "words", "n"), ["leaf", "line"])
    distinct = materialised(distinct, "distinct")
    each = distinct.select("leaf", "line", "n", need.alias("need"), F.posexplode("tokens").alias("at", "token"))
    constant = each.groupBy("leaf", "at", "token").agg(F.sum("n").alias("s"), F.first("need").alias("need")).where("s >= need").select("leaf", "at", "token", F.lit(1).alias("fixed"))
    parsed = each.join(constant, ["leaf", "at", "token"], "left")
    shape = parsed.groupBy("leaf", "line").agg(
        F.bit_xor(F.when(F.col("fixed") == 1, F.xxhash64("at", "token"))).alias("x"), F.count("fixed").alias("n_fixed"), F.count("*").alias("n_tokens"),
    )
    shape = shape.where(F.col("n_fixed") >= F.greatest(F.lit(min_tokens), F.ceil(constant_share * F.col("n_tokens"))))
    return shape.select("line", F.xxhash64("leaf", "x").alias("template"))


def _excess(spread: DataFrame) -> DataFrame:
    """(template, less): by how much the documents (template, d, sketch) of a template count less than one each; they meet in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            template = run.column(0).to_numpy()
            first = _changes(template)
            of = np.repeat(np.arange(len(first)), np.diff(first, append=len(template)))
            sketch = run.column(1).flatten().to_numpy().reshape(-1, ORDERS)
            f = np.zeros(sketch.shape, np.int64)
            for r in range(ORDERS):
                order = np.lexsort((sketch[:, r], of))
                group = _changes(of[order], sketch[order, r])
                sizes = np.diff(group, append=len(of))
                f[order, r] = np.repeat(sizes, sizes)
            f.sort(axis=1)
            less = np.add.reduceat(1 - 1 / f[:, ORDERS - AGREE], first)
            yield pa.RecordBatch.from_arrays([pa.array(template[first]), pa.array(less)], names=["template", "less"])

    return spread.select("template", "sketch").repartition("template").sortWithinPartitions("template").mapInArrow(scan, "template long, less double")


def _excess_wide(spread: DataFrame) -> DataFrame:
    """_excess for templates of too many documents for one task: by order, through partial aggregates and a join."""
    spread = materialised(spread.select("template", "d", F.posexplode("sketch").alias("r", "c")), "sketches")
    alike = materialised(spread.groupBy("template", "r", "c").agg(F.count("*").alias("f")).where("f > 1"), "alike")
    # what no other document has counts 1 and needs no join; a document's list has ORDERS entries at most
    shared = spread.join(alike, ["template", "r", "c"]).groupBy("template", "d").agg(F.sort_array(F.collect_list("f"), asc=False).alias("f"))
    return shared.select("template", (1 - 1 / F.coalesce(F.get("f", F.lit(AGREE - 1)), F.lit(1))).alias("less")).groupBy("template").agg(F.sum("less").alias("less"))


def templates(
    docs: DataFrame, text: str = "text", short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS, long_words: int = LONG_WORDS,
    min_tokens: int = MIN_TOKENS, constant_share: float = CONSTANT_SHARE,
) -> DataFrame:
    """(line, template, n_docs, n_contexts, recurs): line hashes below leaves that can recur, with their template."""
    texts = docs.select(F.col(text).alias("t"))
    thin = materialised(_thin(texts, min_tokens).withColumn("d", F.xxhash64("sketch")), "lines")
    each = thin.select("d", F.explode(F.arrays_zip("leaf", "line", "n")).alias("l"))
    need = F.when(F.col("words") >= long_words, long_docs).otherwise(short_docs)
    leaves = each.groupBy("l.leaf").agg(F.count("*").alias("c"), F.first("l.n").alias("words"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    # lines of one document and its copies are no recurrence, whatever else stands below their leaf
    leaves = materialised(leaves.where((F.col("c") >= need) & (F.col("lo") != F.col("hi"))).select("leaf", "words"), "leaves")
    near = each.select("d", "l.leaf", "l.line").join(_small(leaves), "leaf")
    held = materialised(near.groupBy("line", "d").agg(F.first("leaf").alias("leaf"), F.first("words").alias("words")), "held")
    counts = held.groupBy("line").agg(F.count("*").alias("n"), F.first("leaf").alias("leaf"), F.first("words").alias("words"))
    counts = materialised(counts, "counts")
    below = counts.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.first("words").alias("words"), F.first("line").alias("line"))
    below = materialised(below.where(F.col("s") >= need).select("leaf", "line", "k", (F.col("k") * F.col("words") > LEAF_TOKENS).alias("wide")), "below")
    # the only line of a leaf is its own template, all tokens constant
    shape = below.where((F.col("k") == 1) & F.lit(constant_share <= 1)).select("line", F.xxhash64("leaf", "line").alias("template"))
    several = below.where("k > 1 and not wide").select("leaf")
    shape = shape.unionAll(_parsed(_tokens(texts, min_tokens, Members(several)), counts.join(_small(several), "leaf", "left_semi"), short_docs, long_docs, long_words, min_tokens, constant_share))
    wide = below.where("k > 1 and wide").select("leaf")
    if not wide.isEmpty():
        own = _tokens(texts, min_tokens, Members(wide)).join(_small(wide), "leaf", "left_semi")
        shape = shape.unionAll(_parsed_wide(own, counts.join(_small(wide), "leaf", "left_semi"), need, min_tokens, constant_share))
    shape = materialised(shape, "shapes")
    # a document, however often it stands or repeats a line, is one row
    places = held.join(shape, "line").groupBy("template", "d").agg(F.first("words").alias("words"))
    places = materialised(places, "places")
    seen = places.groupBy("template").agg(F.count("*").alias("n_docs"), F.first(need).alias("need"))
    can = materialised(seen.where("n_docs >= need"), "can")
    able = places.select("template", "d").join(_small(can.select("template", "n_docs")), "template")
    sketches = thin.select("d", "sketch").groupBy("d").agg(F.first("sketch").alias("sketch"))
    spread = able.join(sketches, "d")
    excess = _excess(spread.where(F.col("n_docs") <= TEMPLATE_DOCS))
    if not can.where(F.col("n_docs") > TEMPLATE_DOCS).isEmpty():
        excess = excess.unionAll(_excess_wide(spread.where(F.col("n_docs") > TEMPLATE_DOCS)))
    counted = can.join(excess, "template", "left").withColumn("n_contexts", F.round(F.col("n_docs") - F.coalesce("less", F.lit(0.0)), 6))
    return shape.join(counted.select("template", "n_docs", "n_contexts", (F.col("n_contexts") >= F.col("need")).alias("recurs")), "template")


def dropped(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """row (docs' own columns), kept (the text without lines of recurring templates), n_lines (that have a word), n_dropped."""
    spark = docs.sparkSession
    gone = materialised(templates(docs, text, **options).where("recurs").select("line").distinct(), "recurring")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    few = gone.count() <= 8 * BROADCAST_ROWS
    if few:
        known = np.sort(gone.toArrow()["line"].to_numpy()).astype(np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(np.sort(known))
        rows = rows.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        shared = None
        rows = rows.withColumn("h", F.sha2(F.col("t"), 256))
        has = _lines_of(rows.select("h", "t")).distinct().join(gone, "line").groupBy("h").agg(F.collect_set("line").alias("own"))
        rows = rows.join(has, "h", "left").select("row", "t", "own")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                lines = Lines(data, offs, pows)
                if shared is not None:
                    sorted_ = shared.value
                else:
                    lists = batch.column(2).slice(i, j - i).flatten()
                    sorted_ = np.unique(lists.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                at = np.minimum(np.searchsorted(sorted_, lines.hash), max(0, len(sorted_) - 1))
                out = np.flatnonzero(sorted_[at] == lines.hash) if len(sorted_) else np.zeros(0, np.int64)
                n = np.bincount(lines.doc[out], minlength=j - i)
                kept = batch.column(1).slice(i, j - i)
                if len(out):
                    kept = pa.array(_without(kept.to_pylist(), data, offs, lines, out), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), kept, pa.array(np.bincount(lines.doc, minlength=j - i)), pa.array(n)], names=["row", "kept", "n_lines", "n_dropped"]
                )

    return rows.mapInArrow(scan, with_types(rows, ["row"], "kept string, n_lines long, n_dropped long"))


def _without(texts: list, data: np.ndarray, offs: np.ndarray, lines: Lines, out: np.ndarray) -> list:
    """The texts of a piece less the lines numbered in out."""
    cuts = np.flatnonzero(np.diff(lines.doc[out])) + 1
    for mine in np.split(out, cuts):
        d = int(lines.doc[mine[0]])
        parts, at = [], int(offs[d])
        for x in mine:
            parts.append(data[at : lines.start[x]].tobytes())
            at = int(lines.end[x])
        parts.append(data[at : offs[d + 1]].tobytes())
        body = b"".join(parts)
        # a dropped last line takes the break before it along
        if lines.end[mine[-1]] == offs[d + 1] and body.endswith(b"\n"):
            body = body[:-1]
        texts[d] = body.decode()
    return texts


def _lines_of(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                lines = Lines(data, offs, pows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(lines.doc)), _long(lines.hash)], names=["h", "line"])

    return rows.mapInArrow(scan, "h string, line long")


def cleaned(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """docs with their own columns, the text (and n_chars, if it is there) as the drops leave it."""
    got = dropped(docs, text, **options)
    put = {text: F.col("kept"), n_chars: F.length("kept").cast("long")}
    own = lambda c: F.col(f"row.`{c}`")
    return got.select(*[(F.when(F.col("n_dropped") > 0, put[c]).otherwise(own(c)) if c in put else own(c)).alias(c) for c in docs.columns])
