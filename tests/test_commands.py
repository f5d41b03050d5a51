import json

import pytest

import siftgram
from siftgram.__main__ import main
from siftgram.config import BenchmarkSpec, ScanConfig
from siftgram.operators import index
from siftgram.plans import run
from siftgram.sources import registry, settings

BAD = " ".join(f"alpha{i} beta{i}" for i in range(10))
WORSE = " ".join(f"gamma{i} delta{i}" for i in range(10))


@pytest.fixture
def place(spark, tmp_path):
    spark.createDataFrame([(BAD, ["x", "y"]), (WORSE, [])], "question string, choices array<string>").coalesce(1).write.parquet(str(tmp_path / "bench"))
    body = {
        "benchmarks": [{"name": "b", "path": str(tmp_path / "bench"), "fields": ["question", "choices"]}], "index": {"ngram": 13}, "scan": {"min_hits": 2},
        "stopgrams": {"inputs": [str(tmp_path / "corpus")], "tau": 0.9},
    }
    (tmp_path / "c.json").write_text(json.dumps(body))
    (tmp_path / "corpus").mkdir()
    rows = [{"id": "a", "text": "clean words only"}, {"id": "b", "text": f"see {BAD} there"}]
    (tmp_path / "corpus" / "one.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\r\n")
    spark.createDataFrame([("c", f"{WORSE} end"), ("d", "other words")], "id string, text string").coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("part-*")).rename(tmp_path / "corpus" / "two.parquet")
    return tmp_path


def test_commands_end_to_end(spark, place, capsys):
    at = lambda *p: str(place.joinpath(*p))
    config, ix, out = ["--config", at("c.json")], at("ix"), at("out")
    assert main(["validate-config", at("c.json")]) == 0
    assert main(["build-index", *config, "--out", ix]) == 0 and main(["inspect-index", "--index", ix]) == 0
    assert main(["selftest", "--index", ix]) == 0
    scan = ["scan", *config, "--index", ix, "--inputs", at("corpus"), "--out", out]
    assert main([*scan, "--dry-run"]) == 0 and "2 to scan" in capsys.readouterr().out and not place.joinpath("out").exists()
    assert main(scan) == 0
    about = json.loads(place.joinpath("out", "manifest.json").read_text())
    assert (about["summary"]["contaminated"], about["summary"]["shards"]) == (2, 2)
    assert main([*scan, "--dry-run"]) == 0 and "0 to scan" in capsys.readouterr().out
    assert main(scan) == 0 and json.loads(place.joinpath("out", "manifest.json").read_text())["summary"] == about["summary"]
    assert main(["inspect-run", "--run", out]) == 0
    got = {r.doc_id: r for r in run.read_records(spark, out).collect()}
    assert set(got) == {"b-part-0", "c-part-0"} and got["b-part-0"].item_hits[0].fields_matched == ["question"] and got["b-part-0"].row_index == 1
    assert main(["report", "--run", out, "--index", ix, "--out", at("report")]) == 0
    body = json.loads(place.joinpath("report", "report.json").read_text())
    assert body["benchmarks"][0]["leaked"] == body["benchmarks"][0]["total"] and body["examples"]["found"] == 2 and body["field_matches"] == {"single_field": 2}
    assert "| b |" in place.joinpath("report", "report.md").read_text() and list(place.joinpath("report", "leak_by_item").glob("*.csv"))
    assert main(["reproduce", "--manifest", at("out", "manifest.json"), "--index", ix, "--out", at("again")]) == 0
    place.joinpath("corpus", "one.jsonl").write_text("changed\n")
    assert main(["reproduce", "--manifest", at("out", "manifest.json"), "--index", ix, "--out", at("more")]) == 1


def test_a_run_that_is_continued_and_broken_shards(spark, place):
    at = lambda *p: str(place.joinpath(*p))
    args = ["run", "--config", at("c.json"), "--inputs", at("corpus"), "--out", at("out")]
    place.joinpath("corpus", "bad.parquet").write_bytes(b"no parquet")
    assert main(args) == 1
    total = json.loads(place.joinpath("out", "summary.json").read_text())
    assert (total["shards"], total["failed_shards"], total["contaminated"]) == (2, 1, 2)
    place.joinpath("corpus", "bad.parquet").unlink()
    place.joinpath("corpus", "three.jsonl").write_text(json.dumps({"id": "e", "text": BAD}) + "\n")
    before = {p: p.stat().st_mtime_ns for p in place.joinpath("out", "summaries", "shard=two").iterdir()}
    assert main(args) == 0
    total = json.loads(place.joinpath("out", "summary.json").read_text())
    assert (total["shards"], total["failed_shards"], total["contaminated"]) == (3, 1, 3)
    assert before == {p: p.stat().st_mtime_ns for p in place.joinpath("out", "summaries", "shard=two").iterdir()}
    assert run.inspected(spark, at("out"))["records"] == 3
    # other settings: everything again, and nothing is left of the run before
    assert main([*args, "--set", "min_hits=9"]) == 0
    assert run.inspected(spark, at("out"))["records"] == 0


def test_filter_command(spark, place):
    at = lambda *p: str(place.joinpath(*p))
    assert main(["build-index", "--config", at("c.json"), "--out", at("ix")]) == 0
    args = ["filter", "--config", at("c.json"), "--index", at("ix"), "--inputs", at("corpus"), "--out", at("clean")]
    raw = place.joinpath("corpus", "one.jsonl").read_bytes()
    assert main(args) == 0
    line = next(x for x in raw.split(b"\n") if b'"b"' in x)
    assert place.joinpath("clean", "one.jsonl").read_bytes() == raw.replace(line + b"\n", b"")
    kept = spark.read.parquet(at("clean", "two.parquet"))
    assert [r.id for r in kept.collect()] == ["d"] and kept.columns == ["id", "text"]
    about = json.loads(place.joinpath("clean", "filter_manifest.json").read_text())
    assert about["removals"] == {"benchmark": {"all": 2, "b": 2}, "channel": {"ngram": 2}, "shard": {"one": 1, "two": 1}} and about["rows_before"] == 4
    gone = [json.loads(x) for f in place.joinpath("clean", "removed_ids").glob("part-*") for x in f.read_text().splitlines()]
    assert [(g["shard"], g["row_index"], g["id"], g["benchmarks"]) for g in sorted(gone, key=lambda g: g["id"])] == [("one", 1, "b", ["b"]), ("two", 0, "c", ["b"])]
    assert "| b | 2 |" in place.joinpath("clean", "card.md").read_text()
    with pytest.raises(ValueError, match="not empty"):
        main(args)
    assert main([*args, "--overwrite", "--granularity", "subdoc"]) == 0
    for bad in (at("corpus", "in"), at()):
        with pytest.raises(ValueError, match="lies inside|not empty|inside"):
            main([*args[:-1], bad])
    place.joinpath("clean", "mine.txt").write_text("x")
    with pytest.raises(ValueError, match="no filter wrote"):
        main([*args, "--overwrite"])


def test_stopgrams_seeds_and_splits(spark, place):
    at = lambda *p: str(place.joinpath(*p))
    config = ["--config", at("c.json")]
    assert main(["build-index", *config, "--out", at("ix")]) == 0
    assert main(["build-stopgrams", *config, "--tau", "0.2", "--out", at("stop")]) == 0
    assert main(["scan", *config, "--index", at("ix"), "--stopgrams", at("stop"), "--inputs", at("corpus"), "--out", at("s")]) == 0
    assert json.loads(place.joinpath("s", "summary.json").read_text())["empty_after_filter"] == 2
    assert main(["build-spaced-index", *config, "--index", at("ix"), "--out", at("seeds")]) == 0
    from siftgram.sources import artifacts

    ix = index.Index.load(spark, at("ix"), 13)
    assert artifacts.check_spaced(spark, at("seeds"), ix, ScanConfig()).span == 17
    assert artifacts.load_spaced(spark, at("seeds"))[0].count() == artifacts.spaced.seed_postings(ix)[0].count()
    with pytest.raises(ValueError, match="min_loci"):
        artifacts.check_spaced(spark, at("seeds"), ix, ScanConfig(spaced_min_loci=4))
    with pytest.raises(ValueError, match="n = 13"):
        artifacts.load_stopgrams(spark, at("stop"), 5)
    pairs = artifacts.export_masks(ix, at("masks.bin"))
    assert [m for _, m in artifacts.import_masks(at("masks.bin"))] == [1] * pairs and pairs == ix.grams.count()
    place.joinpath("cut.bin").write_bytes(place.joinpath("masks.bin").read_bytes()[:-3])
    with pytest.raises(ValueError, match="cut short"):
        list(artifacts.import_masks(at("cut.bin")))
    spark.createDataFrame([(str(i), BAD if i == 3 else "fine words") for i in range(10)], "id string, text string").coalesce(1).write.parquet(at("source"))
    assert main(["run-split", *config, "--source", at("source"), "--max-rows", "4", "--out", at("r")]) == 0
    assert [p.name for p in sorted(place.joinpath("r", "shards").glob("*.parquet"))] == [f"train-{i:05d}-of-00003.parquet" for i in range(3)]
    assert json.loads(place.joinpath("r", "summary.json").read_text())["contaminated"] == 1


def test_settings_and_registry(spark, place, capsys):
    assert main(["list-benchmarks"]) == 0 and "| gsm8k |" in capsys.readouterr().out
    assert main(["describe-benchmark", "piqa"]) == 0 and "68 %" in capsys.readouterr().out
    out = str(place / "new.yaml")
    assert main(["init-config", "--benchmarks", "gsm8k", "arc", "--out", out]) == 0
    with pytest.raises(FileExistsError):
        main(["init-config", "--benchmarks", "gsm8k", "--out", out])
    got = settings.load(spark, out)
    assert [b.dataset for b in got.benchmarks] == ["openai/gsm8k", "allenai/ai2_arc"] and got.scan.min_hits == 3
    assert main(["validate-config", out]) == 1  # nothing lies at those paths
    assert main(["export-registry", "--out", str(place / "reg")]) == 0 and spark.read.parquet(str(place / "reg" / "registry")).count() == 25
    for text, what in (("scan: {min_hit: 3}", "unknown min_hit"), ("scans: {}", "unknown scans"), ("benchmarks: [{name: x}]", "needs name"), ("benchmarks: [nothing]", "no benchmark")):
        with pytest.raises((ValueError, KeyError), match=what):
            settings.parse(text)
    arc = lambda *c: BenchmarkSpec("x", "p", ("q",), dataset="ALLENAI/ai2_arc", configs=c)
    assert registry.entry_for(arc("ARC-Easy")).key == "arc_easy" and registry.entry_for(arc("ARC-Easy", "ARC-Challenge")).key == "arc" and registry.entry_for(arc()) is None
    assert registry.entry_for(BenchmarkSpec("x", "p", ("q",), dataset="baber/piqa")).key == "piqa"
    assert registry.split_warnings(BenchmarkSpec("x", "p", ("q",), dataset="baber/piqa", splits=("test",)))
    with pytest.raises(ValueError, match="no revision"):
        index.check_revisions([BenchmarkSpec("x", "p", ("q",), dataset="d")])
    assert siftgram.ScanConfig is ScanConfig and callable(siftgram.scan)


def test_old_records_parse():
    old = run.parse_record(json.dumps({"doc_id": "a", "src_hits": [[0, 3]], "item_hits": [[7, 3, 15], [8, 2]]}))
    assert old["src_hits"] == [{"source_id": 0, "hits": 3}]
    assert [(i["item_id"], i["longest_run_tokens"], i["unique_hits"]) for i in old["item_hits"]] == [(7, 15, 0), (8, 0, 0)]
    new = {"doc_id": "a", "src_hits": [{"source_id": 1, "hits": 2}], "item_hits": [{"item_id": 1, "hits": 2, "longest_run_tokens": 3, "unique_hits": 1, "shared_hits": 1, "boilerplate_hits": 0}]}
    assert run.parse_record(json.dumps(new))["item_hits"] == new["item_hits"]
