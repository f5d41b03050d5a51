"""Exact channel: verbatim questions of items, and evidence from texts.

Candidates are blocked on words of a question, so that no document meets every
question; containment and word boundaries are checked on the pairs that are left.
There are two plans. The kernel looks up hashes of words inside a question, which
are broadcast, in Arrow batches, and documents don't move. The join plan blocks
on the first words, an equi-join; questions without a token are few by nature and
are compared through the same join on an empty block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.config import ScanConfig
from siftgram.functions import kernels as K
from siftgram.functions.sharing import share, with_types
from siftgram.functions.text import bounded, common_substring, light, numbers
from siftgram.operators.index import Index
from siftgram.operators.matching import KERNEL_BYTES, LOOK_BYTES, small

WINDOW_CHARS = 1_000
BLOCK_WORDS = 3
TEXT = 10  # posting rows that a row with texts is taken for, where rows are counted before a broadcast
_PIECE = r"[\p{IsAlphabetic}\p{N}]+"


def questions(index: Index, cfg: ScanConfig, with_nfkc: bool = True, every: bool = False) -> DataFrame:
    """(item_idx, question, choices): the first field, and all values of the others, light-normalized; every: also of
    items that the channel doesn't look for."""
    items = index.items.select("item_idx", "n_grams", "fields")
    first = light(F.array_join(F.get("fields", F.lit(0)), " "), with_nfkc)
    items = items.withColumn("question", first)
    rest = items.select("item_idx", F.explode_outer(F.flatten(F.slice("fields", 2, F.greatest(F.size("fields") - 1, F.lit(0))))).alias("c"))
    rest = rest.select("item_idx", light(F.col("c"), with_nfkc).alias("c")).groupBy("item_idx").agg(F.filter(F.collect_list("c"), lambda x: x != "").alias("choices"))
    out = items.join(rest, "item_idx")
    if every:
        return out.select("item_idx", "question", "choices")
    out = out.where(F.length("question") >= cfg.exact_min_chars)
    if cfg.exact_channel == "short":
        out = out.where(F.col("n_grams") < cfg.min_hits)
    return out.select("item_idx", "question", "choices")


#: The characters that light normalization takes as white space.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


def lighten(t: str, with_nfkc: bool = True) -> str:
    """light() in Python."""
    return _SPACE.sub(" ", (unicodedata.normalize("NFKC", t) if with_nfkc else t).lower()).strip(" ")


def first_bounded(text: str, needle: str) -> int | None:
    """The place of the first occurrence, also one that overlaps another, that touches no letter or digit with one of its own."""
    alnum = lambda c: _ALNUM.match(c) is not None
    left, right, at = alnum(needle[0]), alnum(needle[-1]), text.find(needle)
    while at >= 0:
        end = at + len(needle)
        if not (left and at > 0 and alnum(text[at - 1])) and not (right and end < len(text) and alnum(text[end])):
            return at
        at = text.find(needle, at + 1)
    return None


class Questions:
    """Questions blocked by hashes of words inside them; found() lists the items each text holds."""

    def __init__(self, item: np.ndarray, texts: list[str], with_nfkc: bool):
        self.item, self.texts, self.with_nfkc = item, texts, with_nfkc
        column = pa.array(texts, pa.large_string())
        words = K.Words(*K.buffers(column), K.Powers())
        # the first and the last word may touch signs outside ASCII, which count as parts of words here
        inner = np.maximum(words.counts() - 2, 0)
        size = np.minimum(inner, BLOCK_WORDS)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == n)
            h = words.hash[words.first[rows] + 1].copy()
            with np.errstate(over="ignore"):
                for j in range(1, n):
                    h = h * K.MULTIPLIER + words.hash[words.first[rows] + 1 + j]
                h = K.mix64(h)
            order = np.argsort(h, kind="stable")
            self.blocks[n] = h[order], rows[order]
        self.bare = [(int(i), texts[i].encode()) for i in np.flatnonzero(size == 0)]

    def _candidates(self, data: np.ndarray, offs: np.ndarray, pows: K.Powers) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        words = K.Words(data, offs, pows)
        for n, (known, rows) in self.blocks.items():
            h = K.grams(words.hash, n)
            at = np.flatnonzero(self.sieves[n][h & np.uint64(len(self.sieves[n]) - 1)])
            lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            some = np.flatnonzero(hi > lo)
            for x in some.tolist():
                d = int(words.doc[at[x]])
                out.update((d, int(r)) for r in rows[lo[x] : hi[x]])
        body = data.tobytes() if self.bare else b""
        for row, needle in self.bare:
            at = body.find(needle)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                out.add((d, row))
                at = body.find(needle, at + 1)
        return out

    def ready(self) -> Questions:
        self.pows, self.sieves = K.Powers(LOOK_BYTES), {}
        for n, (known, _) in self.blocks.items():
            self.sieves[n] = np.zeros(1 << max(16, min(26, (len(known) * 16).bit_length())), bool)
            self.sieves[n][known & np.uint64(len(self.sieves[n]) - 1)] = True
        return self

    def found(self, column: pa.Array) -> pa.Array:
        """Items per text, from raw texts. Texts that are plain ASCII are looked at as they are; white space runs don't
        matter to words, and candidates are normalized before they are compared."""
        if not hasattr(self, "pows"):
            self.ready()
        data, offs = K.buffers(column)
        high = np.concatenate([[0], np.cumsum(data > 127)])
        odd = np.flatnonzero(high[offs[1:]] > high[offs[:-1]])
        texts: dict[int, str] = {}
        if len(odd) or self.bare:
            rows = odd.tolist() if not self.bare else range(len(column))
            values = column.to_pylist()
            texts = {i: lighten(values[i] or "", self.with_nfkc) for i in rows}
            column = pa.array([texts.get(i, v) for i, v in enumerate(values)], pa.large_string())
        items: list[list[int]] = [[] for _ in range(len(column))]
        for i, _, piece, at in K.pieces(column):
            for d, row in sorted(self._candidates(piece, at, self.pows)):
                if i + d not in texts:
                    texts[i + d] = lighten(column[i + d].as_py() or "", self.with_nfkc)
                if self.texts[row] in texts[i + d] and first_bounded(texts[i + d], self.texts[row]) is not None:
                    items[i + d].append(int(self.item[row]))
        return pa.array([sorted(x) for x in items], pa.list_(pa.int32()))


def kernel(index: Index, cfg: ScanConfig, with_nfkc: bool = True) -> Callable[[], Questions] | None:
    """The broadcast questions of an index, or None where they take more than a quarter of KERNEL_BYTES."""
    name = ("questions", cfg.exact_channel, cfg.exact_min_chars, cfg.min_hits, with_nfkc)
    if name not in index.shared:
        q = questions(index, cfg, with_nfkc).select("item_idx", "question")
        size = q.agg(F.sum(F.octet_length("question") + 64)).first()[0] or 0
        index.shared[name] = None
        if size <= KERNEL_BYTES // 4:
            got = q.orderBy("item_idx").toArrow()
            index.shared[name] = share(index.items.sparkSession, Questions(got["item_idx"].to_numpy(), got["question"].to_pylist(), with_nfkc))
    return index.shared[name]


def exact_hits(parts: DataFrame, index: Index, cfg: ScanConfig, key: list[str], with_nfkc: bool = True, plan: str = "auto") -> DataFrame:
    """(key, item_idx, question, choices, light): word-bounded verbatim questions."""
    shared = kernel(index, cfg, with_nfkc) if plan != "join" else None
    if shared is None:
        return _by_join(parts, index, cfg, key, with_nfkc)
    rows = parts.select(F.struct(*key).alias("row"), "text")

    def scan(batches):
        own = shared()
        for batch in batches:
            for i, j, _, _ in K.pieces(batch.column(1), LOOK_BYTES):
                found = own.found(batch.column(1).slice(i, j - i))
                some = pa.array(np.diff(found.offsets.to_numpy()) > 0)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, found], names=["row", "text", "found"]).filter(some)

    got = rows.mapInArrow(scan, with_types(rows, ["row", "text"], "found array<int>"))
    return with_texts(got.select("row.*", "text", F.explode("found").alias("item_idx")), index, cfg, key, with_nfkc)


def with_texts(pairs: DataFrame, index: Index, cfg: ScanConfig, key: list[str], with_nfkc: bool = True) -> DataFrame:
    """(key, item_idx, question, choices, light) of pairs (key, text, item_idx)."""
    q = questions(index, cfg, with_nfkc)
    return pairs.select(*key, "item_idx", light(F.col("text"), with_nfkc).alias("light")).join(small(q, index.sizes[1] * TEXT), "item_idx").select(*key, "item_idx", "question", "choices", "light")


def _by_join(parts: DataFrame, index: Index, cfg: ScanConfig, key: list[str], with_nfkc: bool) -> DataFrame:
    """Documents blocked on words by a shuffle.

    A bounded occurrence holds the question's words as whole words of the text, so
    that its first words, a block, are equal on both sides of the join.
    """
    q = questions(index, cfg, with_nfkc)
    words = F.regexp_extract_all(F.col("question"), F.lit(_PIECE), F.lit(0))
    q = q.withColumn("w", F.slice(words, 1, BLOCK_WORDS)).withColumn("n", F.size("w")).withColumn("block", F.array_join("w", " ")).drop("w")
    docs = parts.select(*key, light(F.col("text"), with_nfkc).alias("light"))
    docs = docs.withColumn("lw", F.regexp_extract_all(F.col("light"), F.lit(_PIECE), F.lit(0)))
    # a block is named by its number of words, and plain strings are distinct by hashing
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.size("lw") - n), lambda i: F.concat(F.lit(f"{n}|"), F.array_join(F.slice("lw", i + 1, n), " ")))
    none = F.array().cast("array<string>")
    every = F.concat(F.array(F.lit("0|")), *[F.when(F.size("lw") >= n, blocks(n)).otherwise(none) for n in range(1, BLOCK_WORDS + 1)])
    # blocks alone travel to the join; pairs come back to the text by the row's key
    seen = docs.select(*key, F.explode(F.array_distinct(every)).alias("block"))
    pairs = seen.join(small(q.select("item_idx", F.concat(F.col("n").cast("string"), F.lit("|"), "block").alias("block")), index.sizes[1]), "block").select(*key, "item_idx").distinct()
    both = pairs.join(docs.select(*key, "light"), key).join(small(q.select("item_idx", "question", "choices"), index.sizes[1] * TEXT), "item_idx")
    return both.where(bounded(F.col("light"), F.col("question")))


def choices_near(hits: DataFrame, radius: int = WINDOW_CHARS) -> DataFrame:
    """Adds choices_found and choices_total: choices within `radius` characters of the question."""
    pieces = F.split("light", F.concat(F.lit(r"\Q"), F.col("question"), F.lit(r"\E")), -1)
    ends = F.transform(pieces, lambda p, i: F.call_function("array_join", F.slice(pieces, 1, i + 1), F.col("question")))
    start = F.get(F.filter(F.transform(ends, lambda e: F.length(e)), lambda n: bounded(F.substring(F.col("light"), F.greatest(F.lit(1), n), F.length("question") + F.when(n > 0, F.lit(2)).otherwise(F.lit(1))), F.col("question"))), F.lit(0))
    out = hits.withColumn("start", F.coalesce(start, F.lit(0)))
    lo = F.greatest(F.lit(0), F.col("start") - radius)
    around = F.substring(F.col("light"), lo + 1, F.col("start") + F.length("question") + radius - lo)
    out = out.withColumn("around", around).withColumn("choices_total", F.size("choices"))
    return out.withColumn("choices_found", F.size(F.filter("choices", lambda c: bounded(F.col("around"), c)))).drop("around")


def evidence(pairs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """pairs (…, question, choices, light): adds choices_found and choices_total, null where the question has no bounded
    occurrence, and what confirm() adds, null where it is empty."""
    met = bounded(F.col("light"), F.col("question"))
    out = choices_near(pairs.withColumn("met", met))
    out = out.withColumn("choices_found", F.when(F.col("met"), F.col("choices_found"))).withColumn("choices_total", F.when(F.col("met"), F.col("choices_total"))).drop("met", "start")
    if not cfg.confirm:
        return out
    asked = F.col("question") != ""
    out = confirm(out)
    for c in ("numbers_total", "numbers_matched", "lcs_chars", "lcs_ratio"):
        out = out.withColumn(c, F.when(asked, F.col(c)))
    return out


def confirm(pairs: DataFrame) -> DataFrame:
    """pairs with `question` and `light`: adds numbers_total, numbers_matched, lcs_chars, lcs_ratio."""
    q, d = numbers(F.col("question")), numbers(F.col("light"))
    out = pairs.withColumn("numbers_total", F.size(q)).withColumn("numbers_matched", F.size(F.array_intersect(q, d)))
    out = out.withColumn("lcs_chars", common_substring(F.col("question"), F.col("light")))
    return out.withColumn("lcs_ratio", F.when(F.length("question") > 0, F.col("lcs_chars") / F.length("question")))


def template_variants(confirmed: DataFrame) -> DataFrame:
    """Copies of a template with other numbers: some number is missing and the texts differ by a tenth or more; those
    that differ most come first."""
    order = [F.asc("lcs_ratio"), *[F.asc(c) for c in ("shard", "doc_id", "item_idx") if c in confirmed.columns]]
    return confirmed.orderBy(*order).where((F.col("numbers_total") > 0) & (F.col("numbers_matched") < F.col("numbers_total")) & (F.col("lcs_ratio") < 0.9))
