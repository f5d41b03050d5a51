import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftgram.config import FIELD_SEPARATOR, Normalization
from siftgram.functions import text as X
from siftgram.operators.spaced import SeedFamily, seeds, token_class


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first()["x"]


def test_hash_of_a_gram(spark):
    got = spark.createDataFrame([("hello world",)], "g string").select(X.unsigned(X.blake64("g")).alias("h"), X.identity128("g").alias("i")).first()
    assert int(got["h"]) == 5814608031911216775
    assert got["i"] == hashlib.blake2b(b"hello world", digest_size=16).hexdigest()


@pytest.mark.parametrize(
    "given,want",
    [("The ＣＡＴ and DOG!", ["cat", "dog"]), ("Don't stop believing", ["don't", "stop", "believing"]), ("Chapter 3.1 of THE book", ["chapter", "3", "1", "book"]), ("", []), ("  \n", []), ("the and a", []),
     (f"alpha {FIELD_SEPARATOR} beta", ["alpha", FIELD_SEPARATOR, "beta"]), ("a'b'c'd", ["a'b", "c'd"])],
)
def test_tokens(spark, given, want):
    assert one(spark, X.tokens(F.col("c0")), given) == want


def test_windows_stop_at_the_field_separator(spark):
    toks = X.tokens(F.col("c0"), Normalization(nfkc=False))
    got = one(spark, F.filter(X.windows(toks, 2), lambda w: ~X.rejected(w["gram"])), f"alpha {FIELD_SEPARATOR} beta gamma")
    assert [w["gram"] for w in got] == ["beta gamma"]
    assert one(spark, X.windows(toks, 5), "too short") == []


@pytest.mark.parametrize("gram,want", [("option a", True), ("Which of the following", True), ("", True), ("  ", True), ("plain words here", False), ("none of above", True), ("true false true", True)])
def test_rejected(spark, gram, want):
    assert one(spark, X.rejected(F.col("c0")), gram) is want
    assert (one(spark, X.reject_pattern(F.col("c0")), gram) is not None) == (want and gram.strip() != "")


@pytest.mark.parametrize("given,want", [("  What   IS\t2+3?\n", "what is 2+3?"), ("ＡＢＣ　ｘ²", "abc x2"), ("", "")])
def test_light(spark, given, want):
    assert one(spark, X.light(F.col("c0")), given) == want == X.light_text(given)


@pytest.mark.parametrize("a,b,want", [("abcdef", "zzcdezz", 3), ("abc", "xyz", 0), ("Same Text", "same   text", 9), ("", "abc", 0)])
def test_common_substring(spark, a, b, want):
    assert one(spark, X.common_substring(F.col("c0"), F.col("c1")), a, b) == want


def test_common_substring_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(0, 20))), "".join(rng.choices("abc", k=rng.randrange(0, 20)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select(X.common_substring("a", "b").alias("x"), "a", "b").collect()
    for r in got:
        assert r["x"] == max((j - i for i in range(len(r["a"])) for j in range(i + 1, len(r["a"]) + 1) if r["a"][i:j] in r["b"]), default=0)


@pytest.mark.parametrize("text,needle,want", [("buy 23 apples", "3 apples", False), ("buy 3 apples", "3 apples", True), ("quiz:what is it?yes", "what is it?", True), ("somewhat is it?", "what is it?", False), ("x", "", False), ("3 apples3 apples", "3 apples", False)])
def test_bounded(spark, text, needle, want):
    assert one(spark, X.bounded(F.col("c0"), F.col("c1")), text, needle) is want


def test_numbers_and_missing_labels(spark):
    assert one(spark, X.numbers(F.col("c0")), "2 and 3.5, again 2 and 7.") == ["2", "3.5", "7"]
    rows = spark.createDataFrame([(None,), ("",), (" -1 ",), ("0",), ("A",)], "l string").select(X.missing_label(F.col("l")).alias("m")).collect()
    assert [r["m"] for r in rows] == [True, True, True, False, False]


def test_custom_normalization(spark):
    norm = Normalization(stop_words=frozenset(), word=r"\w+", reject=())
    assert one(spark, X.tokens(F.col("c0"), norm), "The x_y") == ["the", "x_y"]
    assert not norm.is_default and norm.fingerprint() != Normalization().fingerprint()


def test_seeds(spark):
    toks = " ".join(f"t{i}" for i in range(18))
    got = one(spark, seeds(F.split("c0", " ")), toks)
    assert len(got) == 8 and got[0]["seed"] == "s0|" + " ".join(f"t{i}" for i, c in enumerate("11101011101110111") if c == "1")
    assert one(spark, seeds(F.split("c0", " ")), f"a b {FIELD_SEPARATOR} " + toks.rsplit(" ", 2)[0]) == []
    assert one(spark, seeds(F.split("c0", " ")), "short") == []
    assert one(spark, token_class(F.col("c0"), "num_id"), "42") == "<num>" and one(spark, token_class(F.col("c0"), "num_id"), "x") == "<id>"
    for bad in (("1101", "111"), ("0111",), ("1" * 17,), ("11101011101110111", "11101011101110111")):
        with pytest.raises(ValueError):
            SeedFamily(bad)


def test_nfkc_leaves_ascii_to_the_jvm(spark):
    text = "ﬁne ² Ｘ"
    assert one(spark, X.nfkc(F.col("c0")), text) == unicodedata.normalize("NFKC", text)
    assert one(spark, X.nfkc(F.col("c0")), "plain") == "plain"
