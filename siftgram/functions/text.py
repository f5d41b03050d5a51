"""Text functions as Column builders; Arrow UDFs only for what Spark lacks."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgram.config import FIELD_SEPARATOR, REJECT, REJECT_TRIGGER_PREFIX, REJECT_TRIGGERS, Normalization


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.LongType())
def blake64(s: pd.Series) -> pd.Series:
    """BLAKE2b of 8 bytes, little-endian, as a signed long (two's complement)."""
    return s.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True))


def unsigned(h: Column) -> Column:
    """The unsigned value of a 64-bit hash, as DECIMAL(20,0)."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


@F.pandas_udf(T.StringType())
def identity128(s: pd.Series) -> pd.Series:
    """Identity of a text without id: BLAKE2b-128 hex of its first 1,024 bytes, cut at a character."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        head = t.encode()[:1024].decode("utf-8", "ignore").encode()
        return hashlib.blake2b(head, digest_size=16).hexdigest()

    return s.map(one)


@F.pandas_udf(T.IntegerType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters of the longest common substring (light-normalized on both sides)."""

    def one(x: str | None, y: str | None) -> int:
        x, y = light_text(x or ""), light_text(y or "")
        if not x or not y:
            return 0
        # suffix automaton of the shorter text: states as (length, link, moves)
        if len(x) > len(y):
            x, y = y, x
        length, link, moves, last = [0], [-1], [{}], 0
        for ch in x:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and ch not in moves[p]:
                moves[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = moves[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(ch) == q:
                        moves[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        state = run = best = 0
        for ch in y:
            while state and ch not in moves[state]:
                state = link[state]
                run = length[state]
            if ch in moves[state]:
                state, run = moves[state][ch], run + 1
                best = max(best, run)
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Plain ASCII, which it never changes, does not travel to Python."""
    return F.coalesce(_nfkc(F.when(~ascii_only(text), text)), text)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column, norm: Normalization | None = None) -> Column:
    """NFKC, lower case, words, stop words out; the field separator stays as a token of its own."""
    norm = norm or Normalization()
    body = nfkc(text) if norm.nfkc else text
    found = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(rf"<\|field_sep\|>|{norm.word}"), F.lit(0))
    if not norm.stop_words:
        return found
    # one array_except would drop repeats; the filter keeps them
    return F.filter(found, lambda x: ~x.isin(*sorted(norm.stop_words)))


def light_text(t: str) -> str:
    """Light normalization in Python: NFKC, lower case by character, white space runs to one space."""
    return " ".join("".join(c.lower() for c in unicodedata.normalize("NFKC", t)).split())


def light(text: Column, with_nfkc: bool = True) -> Column:
    """Light normalization: NFKC, lower case, white space runs to one space, trimmed."""
    body = nfkc(text) if with_nfkc else text
    return F.btrim(F.regexp_replace(F.lower(body), r"(?U)\s+", " "), F.lit(" "))


def rejected(gram: Column, norm: Normalization | None = None) -> Column:
    """Whether a window is blank, spans fields or is answer-sheet phrasing."""
    norm = norm or Normalization()
    out = (F.btrim(gram) == "") | gram.contains(FIELD_SEPARATOR)
    if norm.reject:
        out = out | gram.rlike("(?i)" + "|".join(f"(?:{p})" for p in norm.reject))
    return out


def may_reject(toks: Column, norm: Normalization) -> Column:
    """Whether any window of these tokens can be rejected: a look at tokens is cheaper than one at windows."""
    if norm.reject != REJECT:
        return F.lit(True)
    words = "|".join([*sorted(REJECT_TRIGGERS), REJECT_TRIGGER_PREFIX])
    return F.exists(toks, lambda t: t.rlike(rf"\b(?:{words})|<"))


def reject_pattern(gram: Column, norm: Normalization | None = None) -> Column:
    """Number of the first pattern that rejects a window; null if none does."""
    norm = norm or Normalization()
    return F.coalesce(*[F.when(gram.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(norm.reject)], F.lit(None).cast("int"))


def windows(toks: Column, n: int) -> Column:
    """array<struct<pos, gram>> of all windows of n tokens that no field separator interrupts."""
    last = F.size(toks) - n
    every = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(toks, i + 1, n), " ").alias("gram")),
    )
    # sequence(0, -1) counts down: the guard stands inside the generator's input
    return F.when(last >= 0, every).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def numbers(light_col: Column) -> Column:
    """Distinct number tokens of a light-normalized text."""
    digits = "[0-9]+"
    return F.array_distinct(F.regexp_extract_all(light_col, F.lit(rf"{digits}(?:\.{digits})?"), F.lit(0)))


_ALNUM = r"[\p{IsAlphabetic}\p{N}]"


def bounded(text: Column, needle: Column) -> Column:
    """Whether needle occurs in text with no letter or digit of it touching one outside.

    The text is split at the needle; occurrence i lies between pieces i and i+1, and
    an empty piece means that the neighbouring occurrence is what touches.
    """
    pieces = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    alnum = lambda c: F.coalesce(c, F.lit("")).rlike(f"^{_ALNUM}$")
    first, last = F.substring(needle, 1, 1), F.right(needle, F.lit(1))

    def ok(p: Column, i: Column) -> Column:
        after = F.get(pieces, i + 1)
        before_char = F.when((F.length(p) == 0) & (i > 0), last).otherwise(F.right(p, F.lit(1)))
        after_char = F.when((F.length(after) == 0) & (i + 2 < F.size(pieces)), first).otherwise(F.substring(after, 1, 1))
        return after.isNotNull() & ~(alnum(before_char) & alnum(first)) & ~(alnum(last) & alnum(after_char))

    return F.when((needle != "") & text.contains(needle), F.exists(F.transform(pieces, lambda p, i: ok(p, i)), lambda x: x)).otherwise(F.lit(False))


def missing_label(label: Column) -> Column:
    """None, blank, "-1" or -1."""
    return F.coalesce(F.btrim(label.cast("string")).isin("", "-1"), F.lit(True))
