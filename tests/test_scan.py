import random
import warnings

import pytest
from pyspark.sql import functions as F

from siftgram.config import DOC_SEPARATOR, DOC_SEPARATOR_TYPO, FIELD_SEPARATOR, ItemStopGrams, Normalization, ScanConfig
from siftgram.functions import text as X
from siftgram.operators import exact, index, matching, segments, spaced, stopgrams
from siftgram.operators.detector import Detector
from siftgram.plans import filtering, report, scan, selftest


def bench(spark, items, name="b"):
    return spark.createDataFrame([(name, i, [[f] if isinstance(f, str) else f for f in fields]) for i, fields in enumerate(items)], "benchmark string, ord long, fields array<array<string>>")


def corpus(spark, texts):
    return spark.createDataFrame([(f"d{i}", t, "s", i) for i, t in enumerate(texts)], "id string, text string, shard string, row long")


def run(spark, texts, ix, **cfg):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return scan.scan(corpus(spark, texts), ix, ScanConfig(ngram=ix.ngram, **cfg), "shard", "row")


def flagged(result):
    return sorted(r.row_index for r in result.flagged.collect())


def test_subtraction_is_per_benchmark(spark):
    two = bench(spark, [["a1 b1 c1"]], "x").union(bench(spark, [["b1 c1"]], "y"))
    gone = spark.createDataFrame([("x", "b1 c1 d1")], "benchmark string, text string")
    ix = index.build_index(two, 2, subtract=gone)
    assert sorted((r.benchmark, r.gram) for r in ix.postings.collect()) == [("x", "a1 b1"), ("y", "b1 c1")]
    assert {r.benchmark: (r.n_items, r.n_ngrams, r.n_empty) for r in index.stats(ix).collect()} == {"x": (1, 1, 0), "y": (1, 1, 0)}


def test_empty_benchmarks(spark):
    with pytest.raises(index.EmptyBenchmarkError):
        index.check_not_empty(index.build_index(bench(spark, [["one"]]), 5))
    assert index.check_not_empty(index.build_index(bench(spark, [["one"]]), 5), allow=True) == ["b"]


def test_item_gate_against_union(spark):
    ix = index.build_index(bench(spark, [["alpha beta gamma"], ["delta epsilon zeta"]]), 2)
    texts = ["alpha beta gamma", "alpha beta frog delta epsilon", "nothing to see here"]
    low = {"min_coverage": 0.0, "min_hits": 2}
    item = low | {"gate_mode": "item"}
    assert flagged(run(spark, texts, ix, **low)) == [0, 1]
    assert flagged(run(spark, texts, ix, **item)) == [0]
    assert flagged(run(spark, texts, ix, min_longest_run=3, **item)) == [0]
    assert flagged(run(spark, texts, ix, min_longest_run=4, **item)) == []


def test_fan_out_split(spark):
    items = [["table chair couch shelf"], ["table chair couch lamp"], ["table chair desk"], ["bench stool"]]
    ix = index.build_index(bench(spark, items), 2)
    r = run(spark, ["table chair couch shelf"], ix, boilerplate_threshold=3, gate_mode="item", min_hits=1, min_coverage=0.0)
    got = {x.item_idx: (x.hits, x.unique_hits, x.shared_hits, x.boilerplate_hits) for x in r.verdicts.collect()}
    assert got == {0: (3, 1, 1, 1), 1: (2, 0, 1, 1), 2: (1, 0, 0, 1)}


def test_item_coverage_path(spark):
    rng = random.Random(1)
    filler = " ".join(f"f{rng.randrange(10**6)}" for _ in range(800))
    ix = index.build_index(bench(spark, [["i0 i1 i2 i3 i4 i5"]]), 3)
    texts = [f"{filler} i0 i1 i2 i3 i4 i5"]
    assert flagged(run(spark, texts, ix, min_coverage=0.01)) == []
    hit = run(spark, texts, ix, min_coverage=0.01, min_item_coverage=0.5)
    assert flagged(hit) == [0] and scan.records(hit).first().item_hits[0].item_coverage == 1.0
    assert flagged(run(spark, texts, ix, min_coverage=0.01, min_item_coverage=0.5, min_hits=5)) == []


def test_stop_grams_and_counts(spark):
    ix = index.build_index(bench(spark, [["alpha beta gamma delta"]]), 2)
    stop = spark.createDataFrame([("alpha beta",), ("beta gamma",), ("gamma delta",)], "gram string")
    r = scan.scan(corpus(spark, ["alpha beta gamma delta", "alpha beta gamma delta omega", "x"]), ix, ScanConfig(ngram=2, min_hits=1), "shard", "row", stopgrams=stop)
    s = scan.shard_summary(r).first()
    assert (s.scanned, s.contaminated, s.empty_after_filter) == (2, 0, 1)
    assert {x.row_index: (x.n_grams, x.n_kept) for x in r.decided.collect()} == {0: (3, 0), 1: (4, 1), 2: (0, 0)}
    docs = spark.createDataFrame([("alpha beta",), ("alpha alpha beta",), ("beta alpha",), ("gamma",)], "text string")
    assert {x.gram: x.df for x in stopgrams.background_stopgrams(docs, 1, 0.75).collect()} == {"alpha": 3, "beta": 3}


def test_frequent_grams_by_blocks(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gámma", "delta's", "<|FIELD_SEP|>", "option b", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts if t], "text string").repartition(3)
    monkeypatch.setattr(matching, "BLOCK_BYTES", 2000)
    for tau in (0.05, 0.2, 0.003):
        got = stopgrams.background_stopgrams(docs, 2, tau)
        assert "hashpartitioning(gram_id" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan and "MapInArrow" in plan
        monkeypatch.setattr(matching, "BROADCAST_ROWS", -1)  # no candidates: the plan that explodes n-grams
        want = stopgrams.background_stopgrams(docs, 2, tau)
        assert "Generate" in want._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        monkeypatch.setattr(matching, "BROADCAST_ROWS", 2_000_000)
    assert stopgrams.background_stopgrams(docs.limit(0), 2, 0.05).count() == 0


def test_kernels_look_at_small_pieces(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(matching, "normalized", lambda c: seen.append(len(c)) or c)
    column = matching.pa.array(["x" * 100_000] * 20)
    at = [(i, j) for i, j, _, _ in matching.looked_at(column)]
    assert max(seen) * 100_000 <= matching.LOOK_BYTES and at[0][0] == 0 and at[-1][1] == 20 and all(a[1] == b[0] for a, b in zip(at, at[1:], strict=False))


def test_item_stop_grams(spark):
    items = [[f"read passage below carefully word{i} thing{i} other{i}"] for i in range(10)]
    drop = ItemStopGrams(0.5, 5)
    ix = index.build_index(bench(spark, items), 3, item_stopgrams=drop)
    whole = index.build_index(bench(spark, items), 3)
    gone = {r.gram for r in whole.postings.collect()} - {r.gram for r in ix.postings.collect()}
    assert gone == {"read passage below", "passage below carefully"}
    assert index.build_index(bench(spark, items), 3, item_stopgrams=ItemStopGrams(0.5, 11)).postings.count() == whole.postings.count()
    assert index.build_index(bench(spark, items), 3, item_stopgrams=ItemStopGrams(1.0, 5)).postings.count() == whole.postings.count()


def test_segments_ids_and_parts(spark):
    text = f"one{DOC_SEPARATOR}{DOC_SEPARATOR_TYPO}three"
    df = spark.createDataFrame([("a", text, None, 0), ("", "two", "x", 1), (None, None, "", 2)], "id string, prompt string, chosen string, row long").withColumn("shard", F.lit("s"))
    cfg = ScanConfig(text_keys=("prompt", "chosen"))
    got = sorted(r.doc_id for r in segments.sub_documents(segments.segments(df, cfg, "shard", "row"), cfg).collect())
    assert [x for x in got if x.startswith("a/")] == ["a/prompt-part-0", "a/prompt-part-2"] and len(got) == 4
    chat = spark.createDataFrame([("c", [("user", "hi"), None, ("assistant", None), (None, "there")])], "id string, messages array<struct<role:string,content:string>>").withColumn("shard", F.lit("s")).withColumn("row", F.lit(0))
    cfg = ScanConfig(messages_key="messages")
    got = sorted((r.doc_id, r.role, r.turn) for r in segments.sub_documents(segments.segments(chat, cfg, "shard", "row"), cfg).collect())
    assert got == [("c/messages/0-part-0", "user", 0), ("c/messages/3-part-0", None, 3)]
    with pytest.raises(TypeError, match="expected a string column"):
        segments.check_columns(spark.createDataFrame([(1,)], "text long"), ScanConfig())
    with pytest.raises(ValueError):
        segments.check_columns(spark.createDataFrame([(1,)], "other long"), ScanConfig())
    with pytest.warns(UserWarning):
        segments.check_columns(spark.createDataFrame([("a", "b")], "text string, other string"), ScanConfig())


def test_kernel_and_join_plans_agree(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "don't", "o'o'o", "option", "a", "the", "true", "false", "ＣＡＴ", "é", "K", "only", "ii", FIELD_SEPARATOR, "select", "answer", "x9", ".", "and'i"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(150)] + ["", None, "x", "x'y'z'w", FIELD_SEPARATOR * 3, "optiona b"]
    items = [[" ".join(rng.choices(words, k=8))] for _ in range(30)]
    stop = spark.createDataFrame([("alpha beta",), ("true false",), ("cat",)], "gram string")
    for n in (1, 2, 4):
        ix = index.cached(index.build_index(bench(spark, items), n))
        cfg = ScanConfig(ngram=n)
        p = segments.sub_documents(segments.segments(corpus(spark, texts), cfg, "shard", "row"), cfg)
        for s in (None, stop):
            got = [
                {r.row_index: (r.skipped, r.n_tokens, r.n_grams, r.n_kept, r.n_hits, sorted((h.pos, h.gram_id) for h in r.hits), r.sources, r.items) for r in matching.match(p, ix, s, ("row_index",), plan).collect()}
                for plan in ("kernel", "join")
            ]
            assert got[0] == got[1]


def test_exact_channel(spark):
    ix = index.build_index(bench(spark, [["What is 2+3 apples in total?", ["four", "five"]], ["Is it red?", ["yes"]]]), 13)
    texts = ["quiz time. What is 2+3 apples in total? answer below: Four or five", "somewhat is 2+3 apples in total?", "quiz:WHAT IS\n2+3 apples in total?yes", "What is 2-3 apples in total?", "Is it red? yes"]
    assert flagged(run(spark, texts, ix)) == []
    hit = run(spark, texts, ix, exact_channel="short", confirm=True)
    assert flagged(hit) == [0, 2] and flagged(run(spark, texts, ix, exact_channel="all", exact_min_chars=5)) == [0, 2, 4]
    got = {r.row_index: r.exact_hits[0] for r in scan.records(hit).collect()}
    assert (got[0].choices_found, got[0].choices_total, got[0].numbers_matched, got[0].lcs_ratio) == (2, 2, 2, 1.0)
    far = "What is 2+3 apples in total?" + " pad" * 400 + " five"
    r = run(spark, [far], ix, exact_channel="all")
    assert exact.choices_near(r.exact).first().choices_found == 0


def test_spaced_channel(spark):
    item = [f"w{i}x" for i in range(30)]
    ix = index.build_index(bench(spark, [[" ".join(item)]]), 13)
    edited = [f"e{i}y" if i in (6, 18) else t for i, t in enumerate(item[:24])]
    assert flagged(run(spark, [" ".join(edited)], ix)) == []
    hit = run(spark, [" ".join(edited), " ".join(f"c{i}z" for i in range(30)), " ".join(item)], ix, spaced=True)
    assert {r.row_index: r.channels for r in hit.flagged.collect()} == {0: ["spaced"], 2: ["ngram"]}
    assert spaced.FAMILY.span == 17


def test_filters(spark):
    ix = index.build_index(bench(spark, [["alpha beta gamma delta epsilon"]]), 2)
    bad = "alpha beta gamma delta epsilon"
    texts = ["clean words stay here", bad, f"keep me{DOC_SEPARATOR}{bad}{DOC_SEPARATOR}and me", f"{bad}{DOC_SEPARATOR_TYPO}", "last one"]
    r = run(spark, texts, ix, max_return_records=0)
    assert [x.id for x in filtering.filter_records(corpus(spark, texts), r, "shard", "row").orderBy("row").collect()] == ["d0", "d4"]
    cut = filtering.filter_parts(corpus(spark, texts), r, "shard", "row").orderBy("row").collect()
    assert [(x.id, x.text) for x in cut] == [("d0", texts[0]), ("d2", f"keep me{DOC_SEPARATOR}and me"), ("d4", "last one")]
    assert {x.benchmark: x.rows for x in filtering.removals(r, ix).collect()} == {"b": 3, None: 3}
    assert "| b | 3 |" in filtering.dataset_card(filtering.removals(r, ix))
    with pytest.raises(ValueError):
        filtering.check_consistent(run(spark, texts, ix))


def test_chat_filter_removes_turns(spark):
    ix = index.build_index(bench(spark, [["alpha beta gamma delta epsilon"]]), 2)
    bad = "alpha beta gamma delta epsilon"
    df = spark.createDataFrame([("c", [("u", "hello"), ("a", bad), ("u", "bye")], 0), ("e", [("u", bad)], 1)], "id string, messages array<struct<role:string,content:string>>, row long").withColumn("shard", F.lit("s"))
    r = scan.scan(df, ix, ScanConfig(ngram=2, messages_key="messages", max_return_records=0), "shard", "row")
    got = filtering.filter_parts(df, r, "shard", "row").collect()
    assert [(x.id, [m.content for m in x.messages]) for x in got] == [("c", ["hello", "bye"])]


def test_report_and_self_test(spark):
    items = [[" ".join(f"q{i}w{j}" for j in range(20))] for i in range(3)]
    ix = index.cached(index.build_index(bench(spark, items), 13))
    r = run(spark, [items[0][0], "nothing"], ix)
    top = report.leak_by_benchmark(scan.hits(r), ix).first()
    assert (top.leaked, top.total) == (8, 24) and top.fraction == 8 / 24
    best = report.leak_by_item(scan.hits(r), ix, best=scan.item_best(r)).first()
    assert (best.item_id, best.leaked, best.best_doc) == ("b#0", 8, "d0-part-0")
    by_shard = report.leak_by_shard(scan.hits(r), ix, scan.shard_summary(r))
    assert "| b | 8 | 24 | 0.3333 |" in report.markdown(report.leak_by_benchmark(scan.hits(r), ix), by_shard)
    got = {x.variant: (x.planted, x.matchable, x.found) for x in selftest.recall(ix).collect()}
    assert got == {v: (3, 3, 3) for v in selftest.VARIANTS} | {"control": (3, 3, 0)}


def test_index_round_trip(spark, tmp_path):
    ix = index.build_index(bench(spark, [["alpha beta gamma"]]), 2)
    ix.save(str(tmp_path))
    again = index.Index.load(spark, str(tmp_path), 2)
    assert again.postings.count() == ix.postings.count()
    with pytest.raises(ValueError):
        index.Index.load(spark, str(tmp_path), 3)
    with pytest.raises(ValueError):
        index.Index.load(spark, str(tmp_path), 2, Normalization(stop_words=frozenset()))


def test_config_checks():
    assert ScanConfig(gate_mode="auto").gate_mode == "union"
    for bad in ({"ngram": 0}, {"min_coverage": 2.0}, {"gate_mode": "x"}, {"boilerplate_threshold": 1}, {"exact_channel": "some"}, {"spaced_ver_identity": 0.0}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)
    assert ScanConfig(min_hits=4).fingerprint() != ScanConfig().fingerprint()


def test_detector_and_scan_agree(spark):
    rng = random.Random(6)
    words = [f"w{i}x" for i in range(60)] + ["the", "select", "answer", FIELD_SEPARATOR]
    items = [" ".join(rng.choices(words, k=40)) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = rng.choice(items).split(" ")
        a = rng.randrange(0, 20)
        t = t[a : a + rng.randrange(5, 40)]
        for _ in range(rng.choice([0, 1, 2, 5])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(99)}y"
        texts.append(" ".join(rng.choices(words, k=5) + t))
    ix = index.cached(index.build_index(bench(spark, [[t] for t in items]), 13))
    mine = Detector(items)
    r = run(spark, texts, ix, spaced=True)
    got = {x.row_index: x for x in r.decided.select("row_index", "ngram_flag", "spaced_item", "skipped", "n_kept").collect()}
    for i, t in enumerate(texts):
        want = mine.exact(t)
        assert got[i].ngram_flag == want
        if not want and not got[i].skipped and got[i].n_kept:
            assert got[i].spaced_item == mine.spaced(t), i
    assert {x.ngram_flag for x in got.values()} == {True, False} and any(x.spaced_item is not None for x in got.values())
    assert mine.spaced(texts[0], verify=False) is None or mine.candidates(texts[0])
    cfg, key = ScanConfig(), ["row_index"]
    parts = corpus(spark, texts).select(F.col("row").alias("row_index"), "text")
    found, _, _ = spaced.loci(parts, ix, cfg, key)
    by_kernel = spaced.loci_kernel(parts, ix, cfg, key, verify=False)
    rows = lambda df: sorted((x.row_index, x.item_idx, x.diag, x.n_loci) for x in df.collect())
    assert rows(found) == rows(by_kernel) != []
    best = {x.row_index: x.spaced_item for x in spaced.verified(parts, ix, cfg, key).collect()}
    kernel = {}
    for x in spaced.loci_kernel(parts, ix, cfg, key, verify=True).collect():
        kernel[x.row_index] = min(x.item_idx, kernel.get(x.row_index, 99))
    assert best == kernel


def test_plans_agree_with_null_and_repeated_keys(spark):
    item = " ".join(f"q{i}z" for i in range(30))
    edited = " ".join("oops" if i in (8, 20) else f"q{i}z" for i in range(24))
    ask = "What is 2+3 apples in total?"
    ix = index.cached(index.build_index(bench(spark, [[item], [ask, "five"]]), 13))
    rows = [("a", item, None, None), ("b", item, None, None), ("c", edited, "s", None), ("d", ask, None, 3), ("e", "clean words", None, None), ("f", item, "s", 1), ("f", item, "s", 1)]
    df = spark.createDataFrame(rows, "id string, text string, shard string, row long")
    for more in ({}, {"gate_mode": "item"}, {"min_item_coverage": 0.5}):
        cfg = ScanConfig(spaced=True, exact_channel="all", confirm=True, max_return_records=0, **more)
        got = [scan.scan(df, ix, cfg, "shard", "row", plan=p) for p in ("kernel", "join")]
        marks = [sorted(map(str, r.flagged.select("id", "channels", "spaced_item", "match_count").collect())) for r in got]
        assert marks[0] == marks[1] and len(marks[0]) == 6
        told = [sorted(map(str, scan.records(r).collect())) for r in got]
        assert told[0] == told[1] and len(told[0]) == 6
        assert {x.benchmark: x.rows for x in filtering.removals(got[0]).collect()} == {"b": 4, None: 4}
        assert sorted(x.id for x in filtering.filter_records(df, got[0], "shard", "row").collect()) == []
    by = {x.channel: x.parts for x in filtering.removals_by(got[0], "channel").collect()}
    assert by == {"ngram": 4, "spaced": 1, "exact": 5}
    two = {x.doc_id: x for x in scan.records(got[0]).collect()}
    assert two["d-part-0"].exact_hits[0].numbers_matched == 2 and two["a-part-0"].item_hits[0].text.lcs_ratio == 1.0


def test_template_variants_and_text_evidence(spark):
    ask = " ".join(f"word{i}q" for i in range(16)) + " costs 40 dollars and 7 cents altogether now"
    ix = index.cached(index.build_index(bench(spark, [[ask, ["blue whale"]]]), 13))
    texts = [ask.replace("40", "41") + " blue whale", ask + " blue whale"]
    r = run(spark, texts, ix, confirm=True, exact_channel="all")
    got = {x.doc_id: x.item_hits[0].text for x in scan.records(r).collect()}
    assert got["d1-part-0"].choices_found == 1 and got["d0-part-0"].choices_found is None
    assert (got["d0-part-0"].numbers_matched, got["d0-part-0"].numbers_total) == (1 + got["d1-part-0"].numbers_total - 2, got["d1-part-0"].numbers_total)
    assert exact.first_bounded("xab ab", "ab") == 4 and exact.first_bounded("xab", "ab") is None
    assert [x.bit_ids for x in spark.sql("SELECT 5L AS m").select(index.source_ids(F.col("m")).alias("bit_ids")).collect()] == [[0, 2]]


def test_self_test_in_real_hosts(spark, tmp_path):
    items = [[" ".join(f"q{i}w{j}" for j in range(20))] for i in range(3)]
    ix = index.cached(index.build_index(bench(spark, items), 13))
    hosts = corpus(spark, ["first paragraph\n\nsecond one\n\nthird", "only one", "", None, "only one"])
    truth = selftest.planted_in(ix, hosts)
    selftest.save_planted(truth, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "planted"))
    assert back.count() == 15 == spark.read.parquet(str(tmp_path / "truth")).count()
    cells = {(r.variant, r.channel): r for r in selftest.cells(ix, truth).collect()}
    assert all(cells[v, "any"].recall == cells[v, "ngram"].recall == 1.0 for v in selftest.VARIANTS)
    assert cells["control", "any"].found == 0 and cells["control", "any"].recall == 0.0 and cells["verbatim", "spaced"].found == 0
    one = back.where("text like 'first%q0%'").first().text
    assert one.split("\n\n")[:2] == ["first paragraph", "second one"] and one.endswith("third")


def test_upper_variant_keeps_words(spark):
    item = " ".join(f"gruß{i} dieenerßß ǆ ﬁx İx w{i}x" for i in range(6))
    ix = index.cached(index.build_index(bench(spark, [[item + " 😀."]]), 13))
    plant = selftest.planted(ix).where("variant = 'upper'").first().text
    assert "GRUß0 DIEENERßß Ǆ ﬁX İX W0X" in plant and plant.count("😀.\n\n") == 1
    assert {r.variant: r.found for r in selftest.recall(ix).collect()} == dict.fromkeys(selftest.VARIANTS, 1) | {"control": 0}


def test_reject_statistics(spark):
    items = bench(spark, [["select one best answer please now"], ["true false true false here"], ["plain words only stay"]]).select("benchmark", "fields")
    got = {r.pattern_idx: r.n for r in index.reject_stats(items, 3).collect()}
    assert sum(got.values()) == 4 + 3 + 2 and got[None] >= 1
    odd = bench(spark, [["true <|field_sep|> x option a ＜|FIELD_SEP|＞ which statement true " + "true false true " * 40, "İx find value x"], ["", "short"]]).select("benchmark", "fields")
    both = items.unionByName(odd)
    plain = Normalization()
    want = index._field_grams(both, 3, plain).groupBy(X.reject_pattern(F.col("gram"), plain).alias("p")).count()
    assert {r.pattern_idx: r.n for r in index.reject_stats(both, 3).collect()} == {r.p: r["count"] for r in want.collect()}
    assert "MapInArrow" in index.reject_stats(both, 3)._jdf.queryExecution().executedPlan().toString()
    top = index.top_rejected(items, 3).collect()
    assert [r.n for r in top] == sorted((n for p, n in got.items() if p is not None), reverse=True)
