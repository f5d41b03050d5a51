"""Commands over corpora and benchmarks: build an index, scan, filter, report, check."""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from dataclasses import asdict, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftgram.config import ScanConfig
from siftgram.operators import index as indexes
from siftgram.operators import stopgrams as frequent
from siftgram.plans import filtering, report, run, selftest
from siftgram.sources import artifacts, registry, settings, shards
from siftgram.sources import files as small

SCANS = ("scan", "run", "run-split", "filter", "selftest")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftgram", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, what: sub.add_parser(name, help=what, description=what)
    built = add("build-index", "Index the benchmarks of a configuration.")
    scan = add("scan", "Scan shards against an index.")
    whole = add("run", "Build the index, unless it stands, and scan.")
    split = add("run-split", "Write a data set's split as shards, then run.")
    cut = add("filter", "Scan, and write cleaned shards.")
    test = add("selftest", "Plant items in documents and measure recall.")
    told = add("report", "Report leaks of a finished run.")
    stats = add("inspect-index", "Statistics of an index.")
    look = add("inspect-run", "Check a run folder.")
    again = add("reproduce", "Run a manifest again and compare.")
    stop = add("build-stopgrams", "Collect frequent n-grams of a background corpus.")
    seeds = add("build-spaced-index", "Write an index's spaced seeds.")
    check = add("validate-config", "Look for problems in a configuration.")
    first = add("init-config", "Write a configuration to start from.")
    add("list-benchmarks", "Benchmarks that the registry knows.")
    about = add("describe-benchmark", "One of them.")
    show = add("export-registry", "The registry as a table and a card.")
    for q in (built, scan, whole, split, cut, test, stop, seeds):
        q.add_argument("--config", help="YAML or JSON file of settings")
    for q in (scan, whole, split, cut, test, again):
        q.add_argument("--stopgrams", help="folder of build-stopgrams")
        q.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a scan setting, above the file's")
    for q in (scan, cut, test, told, stats, again, seeds):
        q.add_argument("--index", required=True)
    for q in (scan, whole, cut):
        q.add_argument("--inputs", nargs="+", required=True)
    for q in (built, scan, whole, split, cut, told, again, stop, seeds, first, show):
        q.add_argument("--out", required=True)
    for q in (built, scan, whole):
        q.add_argument("--dry-run", action="store_true")
    for q in (built, whole, split, check):
        q.add_argument("--allow-unpinned", action="store_true")
    for q in (built, whole, split):
        q.add_argument("--allow-empty", action="store_true")
    for q in (scan, whole, split):
        q.add_argument("--no-resume", action="store_true")
    split.add_argument("--source", required=True)
    split.add_argument("--format", default="parquet")
    split.add_argument("--split", default="train")
    split.add_argument("--max-rows", type=int, default=1_000_000)
    cut.add_argument("--granularity", choices=["record", "subdoc"], default="record")
    for q in (cut, first):
        q.add_argument("--overwrite", action="store_true")
    test.add_argument("--inputs", nargs="+", help="shards whose texts are hosts")
    test.add_argument("--out")
    test.add_argument("--min-recall", type=float, default=1.0)
    told.add_argument("--run", required=True)
    told.add_argument("--top", type=int, default=50)
    told.add_argument("--top-per-benchmark", type=int, default=20)
    stats.add_argument("--min-hits", type=int, default=3)
    look.add_argument("--run", required=True)
    look.add_argument("--shallow", action="store_true")
    again.add_argument("--manifest", required=True)
    stop.add_argument("--inputs", nargs="+")
    stop.add_argument("--tau", type=float)
    check.add_argument("file")
    first.add_argument("--benchmarks", nargs="+", required=True)
    about.add_argument("key")
    return p


def _settings(spark: SparkSession, a: argparse.Namespace) -> settings.Settings:
    got = settings.load(spark, a.config) if getattr(a, "config", None) else settings.Settings()
    given = {}
    for one in getattr(a, "set", []):
        key, _, value = one.partition("=")
        try:
            given[key] = json.loads(value)
        except json.JSONDecodeError:
            given[key] = value
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    odd = sorted(set(given) - set(asdict(got.scan)))
    if odd:
        raise ValueError(f"no setting {', '.join(odd)}")
    return replace(got, scan=replace(got.scan, **given)) if given else got


def built(spark: SparkSession, got: settings.Settings, allow_unpinned: bool = False, allow_empty: bool = False) -> tuple[indexes.Index, list]:
    """(index, status of every split) of a configuration."""
    if not got.benchmarks:
        raise ValueError("the configuration names no benchmark")
    indexes.check_revisions(list(got.benchmarks), allow_unpinned)
    items = gone = None
    status: list = []
    for s in got.benchmarks:
        for w in registry.split_warnings(s):
            warnings.warn(w, stacklevel=2)
        one = indexes.load_benchmark(spark, s, status=status)
        items = one if items is None else items.unionByName(one)
        for path in s.subtract:
            text = indexes.load_benchmark(spark, s, path).select("benchmark", indexes.item_text(F.col("fields")).alias("text"))
            gone = text if gone is None else gone.unionByName(text)
    made = indexes.build_index(items, got.scan.ngram, got.scan.normalization, gone, got.item_stopgrams, [s.name for s in got.benchmarks])
    ix = indexes.cached(made)
    indexes.check_not_empty(ix, allow_empty)
    return ix, status


def _index_at(spark: SparkSession, got: settings.Settings, path: str, a: argparse.Namespace) -> indexes.Index:
    """The index at path, if these settings made it; otherwise it is built there."""
    if shards.exists(spark, f"{path}/meta") and indexes.read_meta(spark, f"{path}/meta").get("settings") == got.index_key():
        return indexes.Index.load(spark, path, got.scan.ngram, got.scan.normalization)
    ix, status = built(spark, got, a.allow_unpinned, a.allow_empty)
    ix.save(path, {"settings": got.index_key(), "splits": [asdict(s) for s in status]})
    return ix


def _stop(spark: SparkSession, a: argparse.Namespace, cfg: ScanConfig):
    return artifacts.load_stopgrams(spark, a.stopgrams, cfg.ngram, cfg.normalization) if getattr(a, "stopgrams", None) else None


def _scan(spark: SparkSession, a: argparse.Namespace, inputs: list[str], ix: indexes.Index | None, got: settings.Settings) -> int:
    cfg = got.scan
    plan, total = run.execute(spark, inputs, a.out, ix, cfg, _stop(spark, a, cfg), not a.no_resume, getattr(a, "dry_run", False))
    print(plan if total is None else json.dumps(total, sort_keys=True))
    return int(bool(plan.failed))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "list-benchmarks":
        print(registry.card())
        return 0
    if a.command == "describe-benchmark":
        print(registry.describe(a.key))
        return 0
    spark = SparkSession.builder.appName(f"siftgram {a.command}").getOrCreate()
    if a.command == "export-registry":
        registry.export(spark, a.out)
        return 0
    if a.command == "init-config":
        if shards.exists(spark, a.out) and not a.overwrite:
            raise FileExistsError(f"{a.out} is there; --overwrite replaces it")
        small.put(spark, a.out, settings.initial(a.benchmarks))
        return 0
    if a.command == "validate-config":
        found = settings.problems(spark, a.file, a.allow_unpinned)
        print("\n".join(found) or "no problems")
        return int(any(not f.startswith("warning:") for f in found))
    if a.command == "inspect-run":
        got = run.inspected(spark, a.run, not a.shallow)
        print(json.dumps(got, indent=1, sort_keys=True))
        return int(bool(got["wrong"]))
    got = _settings(spark, a)
    if a.command == "build-index":
        if a.dry_run:
            print("\n".join(f"{s.name}: {p}" for s in got.benchmarks for _, _, p in indexes.split_paths(spark, s)))
            return 0
        ix, status = built(spark, got, a.allow_unpinned, a.allow_empty)
        ix.save(a.out, {"settings": got.index_key(), "splits": [asdict(s) for s in status]})
        indexes.stats(ix, got.scan.min_hits).show(truncate=False)
        indexes.top_rejected(ix.items.select("item_idx", "fields"), ix.ngram, ix.normalization).show(truncate=False)
        for s in status:
            if s.error:
                print(f"{s.benchmark} {s.config or ''} {s.split}: {s.error}")
        return int(any(s.error for s in status))
    if a.command == "build-stopgrams":
        about = got.stopgrams or settings.StopGrams()
        inputs, tau = list(a.inputs or about.inputs), a.tau if a.tau is not None else about.tau
        rows = frequent.background_documents(shards.read_shards(spark, inputs), list(about.fields), got.scan.packed_doc_sep, got.scan.packed_doc_sep_typo)
        artifacts.save_stopgrams(frequent.background_stopgrams(rows, got.scan.ngram, tau, got.scan.normalization), a.out, got.scan.ngram, got.scan.normalization, tau=tau, inputs=inputs)
        return 0
    if a.command == "run-split":
        spark.read.format(a.format).load(a.source).transform(lambda df: shards.to_parquet_shards(df, f"{a.out}/shards", a.max_rows, a.split) and df)
        return _scan(spark, a, [f"{a.out}/shards"], _index_at(spark, got, f"{a.out}/index", a), got)
    if a.command == "run":
        if a.dry_run and not shards.exists(spark, f"{a.out}/index/meta"):
            print(f"the index is to be built; {len(shards.collect_files(a.inputs, spark))} shards to scan")
            return 0
        return _scan(spark, a, a.inputs, _index_at(spark, got, f"{a.out}/index", a), got)
    meta = indexes.read_meta(spark, f"{a.index}/meta")
    if getattr(a, "config", None) is None and not any(s.startswith("ngram=") for s in getattr(a, "set", [])):
        got = replace(got, scan=replace(got.scan, ngram=meta["ngram"]))
    ix = indexes.Index.load(spark, a.index, got.scan.ngram, got.scan.normalization)
    if a.command == "scan":
        return _scan(spark, a, a.inputs, ix, got)
    if a.command == "filter":
        done = filtering.write_filtered(spark, a.inputs, a.out, ix, got.scan, a.granularity, _stop(spark, a, got.scan), a.overwrite)
        print(json.dumps({k: done[k] for k in ("rows_before", "rows_contaminated", "parts_flagged", "removals")}, sort_keys=True))
        return 0
    if a.command == "report":
        report.write_report(spark, a.run, ix, a.out, a.top, a.top_per_benchmark)
        print(small.get(spark, f"{a.out}/report.md"))
        return 0
    if a.command == "inspect-index":
        indexes.stats(ix, a.min_hits).show(truncate=False)
        return 0
    if a.command == "reproduce":
        wrong = run.reproduce(spark, a.manifest, ix, a.out, _stop(spark, a, got.scan))
        print("\n".join(wrong) or "reproduced")
        return int(bool(wrong))
    if a.command == "build-spaced-index":
        artifacts.save_spaced(ix, a.out, got.scan)
        return 0
    cfg = replace(got.scan, text_keys=("text",), messages_key=None, id_key=None, packed_doc_sep=None)
    hosts = shards.read_shards(spark, a.inputs).select(F.col(got.scan.text_keys[0]).alias("text")) if a.inputs else None
    truth = selftest.planted(ix) if hosts is None else selftest.planted_in(ix, hosts)
    if a.out:
        selftest.save_planted(truth, a.out)
    rows = selftest.cells(ix, truth, cfg).where("channel = 'any'").collect()
    ok = True
    for r in sorted(rows, key=lambda r: r.variant):
        print(r.variant, f"{r.found} of {r.planted}", f"({r.found_matchable} of {r.matchable} with enough n-grams)")
        ok &= r.found == 0 or bool(a.inputs) if r.variant == "control" else r.found_matchable >= a.min_recall * r.matchable
    return int(not ok)


if __name__ == "__main__":
    sys.exit(main())
