"""Every operator and pipeline stage over nulls, repeats, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftgram.llm import decontaminate, entry, langid, lines, mixing, quality, simhash, suffixes, toxicity, urls, warc

NAMES = ["row", "k", "t", "node", "h", "own", "size", "size_", "target", "epoch", "take_words", "at", "th", "spans", "_key", "_text", "_m", "_row", "bin", "host", "hits", "part", "tie", "class_id", "line", "my col", "a-b", "a.b", "_kept", "_n_dropped", "kept", "n_dropped", "d", "w", "n", "source_size", "_e", "epoch_"]


def docs(spark):
    rng = random.Random(20)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    long_ = prose(60_000) + "\n" + "x" * 30_000
    one = prose(120)
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (None, one, "en", None, 1), (3, one, None, "a", 1), (3, one, None, "a", 1), (3, prose(90), "fr", "b", 2), (4, long_, "en", "b", 3), (5, "\n\n", "en", "", 2), (6, "é" * 200, "en", "a", 200), (7, one + " tail", "en", "a", 9)]
    rows += [(10 + i, prose(70), "en" if i % 2 else "fr", "a", 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df


def crowded(df):
    """df with extra columns that share their names with what operators use inside."""
    return df.select("*", *[F.lit(f"extra{i}").alias(n) for i, n in enumerate(NAMES)])


@pytest.fixture(scope="module")
def table(spark):
    return crowded(docs(spark)).cache()


@pytest.fixture(scope="module")
def sf(spark, table, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    table.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def benchmark(spark):
    return spark.createDataFrame([(1, "w1 w2 w3"), (1, "w1 w2 w3"), (None, None), (2, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")


OPERATORS = {
    "decontamination": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "suffixes": lambda s, d: suffixes.repeats(d),
    "lines": lambda s, d: lines.dropped(d, short_docs=2),
    "mixing": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "simhash": lambda s, d: simhash.classes(d),
    "language": lambda s, d: langid.identify(d, langid.train(d)),
    "quality": lambda s, d: quality.ledger(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_returns_every_row(spark, table, name):
    assert OPERATORS[name](spark, table).count() == table.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, table, name):
    rows = lambda df: sorted(map(str, df.drop("row").collect()))
    assert rows(OPERATORS[name](spark, table)) == rows(OPERATORS[name](spark, docs(spark)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_carry_extra_columns(spark, table, sf, name, stage):
    got = stage(spark, table, sf).select(*[F.col(f"`{c}`") for c in table.columns])
    for row in got.collect():
        assert row[5:] == tuple(f"extra{i}" for i in range(len(NAMES)))
    plain = stage(spark, docs(spark), sf)
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(spark, table, name):
    assert OPERATORS[name](spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, table, sf, name, stage):
    got = stage(spark, table, sf)
    assert set(table.columns) <= {*got.columns}
    assert got.count() <= 3 * table.count()
    assert stage(spark, table.limit(0), sf).count() == 0


def test_pipeline_runs_through(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_repeats_lose_all_but_one(spark):
    rows = [(1, "a b c d e f " * 20), (1, "a b c d e f " * 20), (2, "a b c d e f " * 20)]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.n_removed == r.n_bytes for r in got.collect()) == [False, True, True]
    assert simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()[0].doc_id == 1
    assert simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def test_dedup_with_ids_that_repeat(spark):
    a, b, c = ("".join(f"{x}{i} " for i in "abcdefghijkl") for x in "xyz")
    rows = [(None, None), (None, None), (None, a), (1, a), (1, a), (1, b), (2, b), (3, None), (3, None), (3, c), (3, c)]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None), (None, None), (1, a), (1, b), (3, None), (3, None), (3, c)], key=str)


def test_pages(spark, tmp_path):
    rows = [(1, None, None), (None, "", ""), (1, None, None), (2, "http://a/\u00e9", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("k", F.lit(2)).withColumn("r", F.lit(3))
    assert urls.verdicts(pages).count() == 4 and urls.verdicts(pages.limit(0)).count() == 0
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a")
    assert warc.read_archives(spark, f"file://{tmp_path}/a", manifest).count() == 4
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b", empty).count() == 0


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in entry.QUERIES} == {f"op{i}" for i in range(1, 11)}
