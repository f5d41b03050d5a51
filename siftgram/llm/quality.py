"""Quality rules as a bitmask ledger (operator 9), in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long, `fail_bits`, with bit i set where rule i fails. Policies are
masks over those bits, so that a new policy version, or an ablation of one,
reads the ledger and never the texts again.

Edge cases: a null or empty text has no words, all counts are 0, it fails the
`few_words` rule. Rows that repeat are judged each by itself. Very long texts
(over 2**20 words) use a sort of (window, position) structs in place of packed
longs; the result is the same. An empty table gives no rows. Own columns of any
name stand in a struct, and the ledger reads key and text alone: none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
_POSITION_BITS = 20


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the ledger's measurements


#: Bits are never reused: a rule that is dropped keeps its bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > 4 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
)
_BIT = {r.name: r.bit for r in RULES}


def mask(*names: str) -> int:
    return sum(1 << _BIT[n] for n in names)


#: version -> mask of the rules that reject.
POLICIES = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": mask(*_BIT),
}


def _covered(positions: Column) -> Column:
    """Words under three-word windows that start at the given ascending positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum"), p.alias("last")),
        lambda a: a["sum"],
    )


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words within three-word windows that occur twice or more, first one included.

    Windows are sorted as longs: a hash above, the position below; neighbours of
    one hash are compared word by word.
    """
    n = F.size(words)
    at = lambda i: F.get(words, i)
    low = (1 << _POSITION_BITS) - 1
    starts = F.when(n >= 3, F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    same = lambda i, j: (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
    h = lambda i: F.get(hashes, i)
    packed = F.sort_array(
        F.transform(starts, lambda i: F.shiftleft(F.xxhash64(h(i), h(i + 1), h(i + 2)), _POSITION_BITS).bitwiseOR(i.cast("long")))
    )

    def repeats(keys: Column) -> Column:
        def hit(x: Column, j: Column) -> Column:
            before, after = F.get(keys, j - 1), F.get(keys, j + 1)
            i = x.bitwiseAND(low).cast("int")
            near = lambda y: F.coalesce(
                (y.bitwiseXOR(x) <= low) & (y.bitwiseXOR(x) >= 0) & same(i, y.bitwiseAND(low).cast("int")), F.lit(False)
            )
            return near(before) | near(after)

        return F.sort_array(F.transform(F.filter(keys, hit), lambda x: x.bitwiseAND(low)))

    by_struct = F.sort_array(
        F.transform(starts, lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.cast("long").alias("i")))
    )

    def struct_repeats(keys: Column) -> Column:
        eq = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return F.sort_array(
            F.transform(F.filter(keys, lambda x, j: eq(x, F.get(keys, j - 1)) | eq(x, F.get(keys, j + 1))), lambda x: x["i"])
        )

    # transform over a one-element array binds the sorted keys once; a plain reference would sort again for every element
    bound = lambda keys, f: F.get(F.transform(F.array(keys), f), F.lit(0))
    return F.when(n <= low, _covered(bound(packed, repeats))).otherwise(_covered(bound(by_struct, struct_repeats)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct `_m` of the measurements; no shuffle, no Python."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return docs.withColumn(
        "_m",
        F.get(
            F.transform(
                F.transform(
                    F.array(F.struct(words.alias("w"), lines(body).alias("l"))),
                    lambda s: F.struct(s["w"].alias("w"), s["l"].alias("l"), F.transform(s["w"], lambda x: F.xxhash64(x)).alias("h")),
                ),
                lambda s: F.struct(
                    F.size(s["w"]).cast("long").alias("n_words"),
                    F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
                    (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                    F.size(s["l"]).cast("long").alias("n_lines"),
                    _repeat_words(s["w"], s["h"]).cast("long").alias("n_repeat_words"),
                ),
            ),
            F.lit(0),
        ),
    )


def fail_bits() -> Column:
    """The failure bits of all rules over columns that hold the measurements."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measurements, fail_bits."""
    m = measure(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    return m.select(F.col("_key").alias(key), *[F.col(f"_m.{c}").alias(c) for c in MEASURES]).withColumn("fail_bits", fail_bits())


def passes(policy: str | int = "v1", bits: str = "fail_bits") -> Column:
    """Whether a ledger row is kept under a policy (a version or a mask)."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy] if isinstance(policy, str) else policy)) == 0


def apply_policy(docs: DataFrame, policy: str | int = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns; one narrow pass."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    m = measure(inner, "_text").select("_row", "_m.*").withColumn("fail_bits", fail_bits())
    return m.where(passes(policy)).select("_row.*")


def ablations(rows: DataFrame, policy: str | int = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, documents that it alone rejects.

    Bits are counted over the distinct failure patterns, at most 2**rules of them.
    """
    m = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if m >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules]))
    return (
        patterns.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.b")) != 0, F.col("n")).otherwise(0)).alias("n_fails"),
            F.sum(F.when(F.col("bits") == F.col("r.b"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.b"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
