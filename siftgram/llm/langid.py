"""Language identification with segmentation-marginalised unigrams (operator 8).

Each language has a unigram distribution over the pieces of a fixed public
vocabulary (a byte-level one, so that any text has a segmentation). A word's
probability is the sum over all its segmentations, by the forward algorithm; a
text's log-likelihood is the sum over its words. Piece probabilities come from
EM with the backward pass over the word counts of about ROWS_A_LANGUAGE distinct
documents of each language, chosen by a hash threshold.

The kernels run the recursion for all distinct words of one length at once. A
word of more than SPAN bytes is summed whole too: the forward recursion looks
LONGEST_PIECE bytes back, so that the bytes from one boundary to the next act on
that many forward values as a matrix; the matrices of all blocks are computed
together, and then multiplied through the word, with rescaling. In learning
alone, such words are cut at characters into parts of about SPAN bytes.

Edge cases: null texts and texts without a letter are `und`, score 0. Nulls in
lang teach nothing. Without anything learned, all texts are `und`. Repeated rows
are judged each by itself, and teach once. Ties go to the language first in
order. An empty table gives no rows. Columns but key and text are not carried,
so that none can clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.llm import folds
from siftgram.functions import kernels as K
from siftgram.functions.sharing import share
from siftgram.llm.shared import materialised, with_types

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROWS_A_LANGUAGE = 4_000
ROUNDS = 3
SMOOTHING = 0.5
SPAN = 40  # bytes that one recursion spans; more could underflow
LONGEST_PIECE = 16
FLOOR = 1e-7
_SPACE = np.uint64(0xA0761D6478BD642F)


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces that can lie in a lower-cased word, with or without a space before."""
    out = []
    try:
        lines = open(path, "rb")
    except OSError as e:
        raise FileNotFoundError(f"the vocabulary {path!r} can't be read: name a byte-level one in tiktoken's format (`vocabulary`)") from e
    with lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            body = np.frombuffer(piece.removeprefix(b" "), np.uint8)
            if len(body) <= LONGEST_PIECE and (not len(body) and piece == b" " or len(body) and (K.WORD[body] & (K.LOWER[body] == body)).all()):
                out.append(piece)
    return out


def _hash(pieces: list[bytes], pows: K.Powers) -> np.ndarray:
    a, _ = pows.upto(LONGEST_PIECE + 1)
    out = np.zeros(len(pieces), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, p in enumerate(pieces):
            body = np.frombuffer(p.removeprefix(b" "), np.uint8)
            h = K.mix64((K.VALUE[body] * a[: len(body)]).sum(dtype=np.uint64, keepdims=True))[0]
            out[i] = h ^ _SPACE if p.startswith(b" ") else h
    return out


class Table:
    """Piece hash -> number; two direct tables, the second for what collides in the first. 0 is no piece."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, np.uint64), hashes])
        numbers = np.arange(1, len(hashes) + 1, dtype=np.int32)
        self.first = np.zeros(1 << 20, np.int32)
        slot = (hashes & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.first[slot[::-1]] = numbers[::-1]
        rest = numbers[self.first[slot] != numbers]
        for shift in range(20, 46):
            self.shift = np.uint64(shift)
            slot = ((self.keys[rest] >> self.shift) & np.uint64((1 << 18) - 1)).astype(np.int64)
            if len(np.unique(slot)) == len(slot):
                break
        else:
            raise ValueError("pieces collide")
        self.second = np.zeros(1 << 18, np.int32)
        self.second[slot] = rest

    def of(self, h: np.ndarray) -> np.ndarray:
        n = self.first[h & np.uint64((1 << 20) - 1)]
        n = np.where(self.keys[n] == h, n, self.second[(h >> self.shift) & np.uint64((1 << 18) - 1)])
        return np.where(self.keys[n] == h, n, 0)


class Model:
    """Languages and the (pieces + 1, languages) matrix of probabilities; row 0 is no piece."""

    def __init__(self, languages: list[str], table: Table, p: np.ndarray, space: int):
        self.languages, self.table, self.p, self.space = languages, table, p, space

    @classmethod
    def start(cls, languages: list[str], pieces: list[bytes]) -> Model:
        p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
        p[0] = 0
        return cls(languages, Table(_hash(pieces, K.Powers())), p, pieces.index(b" ") + 1)

    def learned(self, counts: np.ndarray) -> Model:
        """counts: expected uses, (pieces + 1, languages)."""
        c = counts[1:] + SMOOTHING
        p = np.vstack([np.zeros((1, c.shape[1])), np.maximum(c / c.sum(axis=0), FLOOR)])
        return Model(self.languages, self.table, p, self.space)


def cut_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut at characters into parts of about SPAN bytes: starts, ends, and the word each part is of."""
    n = -(-(ends - starts) // SPAN)
    of = np.repeat(np.arange(len(starts)), n)
    at = starts[of] + SPAN * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    for _ in range(3):  # bytes 10xxxxxx go on with a character
        inside = (at > starts[of]) & ((data[at] & 0xC0) == 0x80)
        at = at - inside
    return at, np.where(np.append(of[1:] == of[:-1], False), np.append(at[1:], 0), ends[of]), of


class Lattice:
    """The segmentations of words of one length, m of them at `at` in the prefix sums; inner: of parts that follow no space."""

    def __init__(self, sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int, table: Table, inner: bool = False):
        self.n, self.inner = n, inner
        self.arcs: dict[tuple[int, int], np.ndarray] = {}  # (begin, end) -> piece numbers; begin -1: with the space
        with np.errstate(over="ignore"):
            for i in range(n):
                base, scale = sums[at + i], inverse[at + i]
                for e in range(i + 1, min(n, i + LONGEST_PIECE) + 1):
                    h = K.mix64((sums[at + e] - base) * scale)
                    self.arcs[i, e] = table.of(h)
                    if i == 0 and not inner:
                        self.arcs[-1, e] = table.of(h ^ _SPACE)

    def forward(self, model: Model) -> list[np.ndarray]:
        """alpha[e]: probability of all segmentations of the first e bytes, per word and language."""
        m = len(next(iter(self.arcs.values())))
        alpha = [np.ones((m, model.p.shape[1])) if self.inner else np.broadcast_to(model.p[model.space], (m, model.p.shape[1]))]
        for e in range(1, self.n + 1):
            a = model.p[self.arcs[-1, e]] if (-1, e) in self.arcs else np.zeros((m, model.p.shape[1]))
            for i in range(max(0, e - LONGEST_PIECE), e):
                a = a + alpha[i] * model.p[self.arcs[i, e]]
            alpha.append(a)
        return alpha

    def expected(self, model: Model, weights: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> None:
        """Adds expected uses of pieces for words of known language, weighted, to counts."""
        rows = np.arange(len(lang))
        p = model.p[:, :]
        alpha = [a[rows, lang] for a in self.forward(model)]
        beta = [np.ones(len(lang)) if e == self.n else np.zeros(len(lang)) for e in range(self.n + 1)]
        for i in range(self.n - 1, -1, -1):
            for e in range(i + 1, min(self.n, i + LONGEST_PIECE) + 1):
                beta[i] = beta[i] + p[self.arcs[i, e], lang] * beta[e]
        scale = weights / np.maximum(alpha[self.n], 1e-300)
        width = counts.shape[1]
        flat = counts.reshape(-1)
        for (i, e), piece in self.arcs.items():
            before = 1.0 if i < 0 else alpha[i]
            use = before * p[piece, lang] * beta[e] * scale
            flat += np.bincount(piece.astype(np.int64) * width + lang, weights=use, minlength=len(flat))
        if not self.inner:
            flat += np.bincount(np.full(len(lang), model.space, np.int64) * width + lang, weights=p[model.space, lang] * beta[0] * scale, minlength=len(flat))


def _sums(data: np.ndarray, pows: K.Powers) -> tuple[np.ndarray, np.ndarray]:
    a, b = pows.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(K.VALUE[data] * a[: len(data)], out=sums[1:])
    return sums, b


def lattices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Table, pows: K.Powers, most: int = 8192, inner: bool = False) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(indices, lattice) for words of about SPAN bytes at most, by length."""
    sums, inverse = _sums(data, pows)
    length = ends - starts
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        for at in range(0, len(group), most):
            part = group[at : at + most]
            yield part, Lattice(sums, inverse, starts[part], int(length[part[0]]), table, inner)


def transfers(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int, model: Model) -> np.ndarray:
    """(blocks, before, after, languages): what each of the LONGEST_PIECE forward values up to `at` adds to those up to at + n."""
    m, k, langs = len(at), LONGEST_PIECE, model.p.shape[1]
    # value j stands for the boundary at - k + 1 + j; unit vectors before the block
    values = [np.zeros((m, k, langs)) for _ in range(k)]
    for j in range(k):
        values[j][:, j] = 1
    for e in range(1, n + 1):
        a = np.zeros((m, k, langs))
        for back in range(1, k + 1):
            with np.errstate(over="ignore"):
                h = K.mix64((sums[at + e] - sums[at + e - back]) * inverse[at + e - back])
            a += values[-back] * model.p[model.table.of(h)][:, None, :]
        values = [*values[1:], a]
    return np.stack(values, axis=2)


def long_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, pows: K.Powers, blocks: int = 512) -> np.ndarray:
    """(words, languages): log-probabilities of words of over SPAN bytes, over all segmentations of the whole word."""
    k, out = LONGEST_PIECE, np.zeros((len(starts), len(model.languages)))
    if not len(starts):
        return out
    sums, inverse = _sums(data, pows)
    v = np.zeros((len(starts), k, out.shape[1]))
    for part, lattice in lattices(data, starts, starts + SPAN, model.table, pows, 2048):
        v[part] = np.stack(lattice.forward(model)[-k:], axis=1)
    n = -(-(ends - starts) // SPAN) - 1  # blocks after the first SPAN bytes, the last one shorter
    word = np.repeat(np.arange(len(starts)), n)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[word] + SPAN * (turn + 1)
    size = np.minimum(at + SPAN, ends[word]) - at
    order = np.lexsort((size, turn))  # all words' first blocks, then their second ones
    word, turn, at, size = word[order], turn[order], at[order], size[order]
    for lo in range(0, len(order), blocks):
        hi = min(lo + blocks, len(order))
        t = np.zeros((hi - lo, k, k, out.shape[1]))
        for s in np.unique(size[lo:hi]):
            mine = np.flatnonzero(size[lo:hi] == s)
            t[mine] = transfers(sums, inverse, at[lo:hi][mine], int(s), model)
        for same in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(turn[lo:hi])) + 1):
            top = v[word[same]].max(axis=1, keepdims=True)
            out[word[same]] += np.log(np.maximum(top[:, 0], 1e-300))
            v[word[same]] = np.einsum("wkl,wkjl->wjl", v[word[same]] / np.maximum(top, 1e-300), t[same - lo])
    return out + np.log(np.maximum(v[:, -1], 1e-300))


def log_likelihood(words: K.Words, data: np.ndarray, model: Model, pows: K.Powers) -> np.ndarray:
    """(documents, languages) of a piece."""
    _, one, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    starts, ends = words.starts[one], words.ends[one]
    value = np.zeros((len(one), len(model.languages)))
    short, long_ = np.flatnonzero(ends - starts <= SPAN), np.flatnonzero(ends - starts > SPAN)
    for part, lattice in lattices(data, starts[short], ends[short], model.table, pows):
        value[short[part]] = np.log(np.maximum(lattice.forward(model)[lattice.n], 1e-300))
    value[long_] = long_words(data, starts[long_], ends[long_], model, pows)
    out = np.zeros((words.n_docs, len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(words.doc, weights=value[inverse, k], minlength=words.n_docs)
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, rows_a_language: int = ROWS_A_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """EM over the distinct words of a bounded sample, each round one pass over them."""
    spark = docs.sparkSession
    ready = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~folds.held_out(F.col(key)))
    sizes = {r["l"]: r["n"] for r in ready.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = load_pieces(vocabulary)
    model = Model.start(languages, pieces)
    if not languages:
        return model
    # the first of each language in a hash order, by a threshold: no sort, no window over a hot language
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_a_language / sizes[k]))])
    name = F.xxhash64(F.col(key), F.col(text), F.lit("sample"))
    place = name.bitwiseAND((1 << 30) - 1) / float(1 << 30)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    sample = ready.where(place < part[F.col(lang)]).select(F.col(text).alias("t"), number[F.col(lang)].alias("l"), name.alias("name"))
    sample = sample.dropDuplicates(["name", "l"]).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = K.Powers()
        for batch in batches:
            lang_of = batch.column(1).to_numpy().astype(np.int64)
            for i, j, data, offs in K.pieces(batch.column(0)):
                words = K.Words(data, offs, pows)
                starts, ends, of = cut_long(data, words.starts, words.ends)
                spoken = lang_of[i:j][words.doc[of]]
                inner = starts > words.starts[of]
                texts = [K.word_bytes(data, s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                seen: dict[tuple[bytes, int, bool], int] = {}
                for w in zip(texts, spoken.tolist(), inner.tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + 1
                columns = list(zip(*seen, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["w", "l", "inner", "n"])

    counts = materialised(sample.mapInArrow(count, "w binary, l int, inner boolean, n long").groupBy("w", "l", "inner").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        shared = share(spark, model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pows, own = K.Powers(), shared()
            total = np.zeros(own.p.shape)
            for batch in batches:
                for i, j, data, offs in K.pieces(batch.column(0)):
                    lang_of = batch.column(1).slice(i, j - i).to_numpy().astype(np.int64)
                    part_of = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                    n = batch.column(3).slice(i, j - i).to_numpy().astype(float)
                    for inner in (False, True):
                        mine = np.flatnonzero(part_of == inner)
                        for part, lattice in lattices(data, offs[:-1][mine], offs[1:][mine], own.table, pows, inner=inner):
                            lattice.expected(own, n[mine[part]], lang_of[mine[part]], total)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], names=["piece", "l", "c"])

        # bounded by vocabulary times languages
        got = counts.mapInArrow(expect, "piece int, l int, c double").groupBy("piece", "l").agg(F.sum("c").alias("c")).toArrow()
        total = np.zeros(model.p.shape)
        total[got["piece"].to_numpy(), got["l"].to_numpy()] = got["c"].to_numpy()
        model = model.learned(total)
    return model


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upper_or_lower = (data | 32) - np.uint8(97) < 26
    sums = np.concatenate([[0], np.cumsum(upper_or_lower)])
    out = sums[offs[1:]] > sums[offs[:-1]]
    for d in np.flatnonzero(~out):
        body = data[offs[d] : offs[d + 1]]
        if (body > 127).any():
            out[d] = any(c.isalpha() for c in body.tobytes().decode())
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (posterior of lang_pred under equal priors) for every document."""
    shared = share(docs.sparkSession, model)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows, own = K.Powers(), shared()
        for batch in batches:
            for i, j, data, offs in K.pieces(batch.column(1)):
                lettered = _has_letter(data, offs)
                if own.languages:
                    ll = log_likelihood(K.Words(data, offs, pows), data, own, pows)
                    best = ll.argmax(axis=1)
                    score = 1 / np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -700)).sum(axis=1)
                    names = np.array(own.languages, dtype=object)[best]
                else:
                    lettered[:] = False
                    names, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                names[~lettered] = "und"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["k", "lang_pred", "score"])

    return narrow.mapInArrow(scan, with_types(narrow, ["k"], "lang_pred string, score double")).withColumnRenamed("k", key)
