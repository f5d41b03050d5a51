"""Configuration files: YAML or JSON with `benchmarks`, `index`, `scan` and `stopgrams`.

An entry of `benchmarks` is a spec, or `ref: <registry key>` with a path and whatever
it replaces. Unknown keys are errors, as a misspelt setting would change results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from siftgram.config import BenchmarkSpec, ItemStopGrams, Normalization, ScanConfig
from siftgram.operators import index as indexes
from siftgram.sources import files as small
from siftgram.sources import registry, shards

SECTIONS = ("benchmarks", "index", "scan", "stopgrams", "normalization")


@dataclass(frozen=True)
class StopGrams:
    inputs: tuple[str, ...] = ()
    fields: tuple[str, ...] = ("text",)
    tau: float = 0.05

    def __post_init__(self) -> None:
        if not 0 < self.tau <= 1:
            raise ValueError("tau lies above 0, at most 1")


@dataclass(frozen=True)
class Settings:
    benchmarks: tuple[BenchmarkSpec, ...] = ()
    scan: ScanConfig = field(default_factory=ScanConfig)
    item_stopgrams: ItemStopGrams | None = None
    stopgrams: StopGrams | None = None

    def index_key(self) -> str:
        """What an index built from these settings depends on, as text."""
        return json.dumps([[str(b) for b in self.benchmarks], self.scan.ngram, self.scan.normalization.fingerprint(), str(self.item_stopgrams)])


def _made(kind, given: dict, what: str):
    names = {f.name for f in fields(kind)}
    odd = sorted(set(given) - names)
    if odd:
        raise ValueError(f"{what}: unknown {', '.join(odd)}; there are {', '.join(sorted(names))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def spec_of(given: dict | str) -> BenchmarkSpec:
    if isinstance(given, str):
        return registry.entry(given).spec()
    given = dict(given)
    if "ref" in given:
        return registry.with_overrides(given.pop("ref"), **given)
    if "fields" not in given or "name" not in given or "path" not in given:
        raise ValueError(f"a benchmark needs name, path and fields: {given}")
    return _made(BenchmarkSpec, given, str(given["name"]))


def parse(text: str, name: str = "settings") -> Settings:
    if name.endswith(".json"):
        body = json.loads(text)
    else:
        import yaml

        body = yaml.safe_load(text)
    body = body or {}
    if not isinstance(body, dict):
        raise ValueError(f"{name} has to be a mapping")
    odd = sorted(set(body) - set(SECTIONS))
    if odd:
        raise ValueError(f"{name}: unknown {', '.join(odd)}; there are {', '.join(SECTIONS)}")
    about = dict(body.get("index") or {})
    stop = about.pop("item_stopgrams", None)
    scan = dict(body.get("scan") or {})
    if "ngram" in about:
        if scan.get("ngram", about["ngram"]) != about["ngram"]:
            raise ValueError("index and scan have different n")
        scan["ngram"] = about.pop("ngram")
    if about:
        raise ValueError(f"index: unknown {', '.join(sorted(about))}")
    norm = body.get("normalization")
    if norm:
        scan["normalization"] = Normalization(**{k: frozenset(v) if k == "stop_words" else tuple(v) if isinstance(v, list) else v for k, v in norm.items()})
    return Settings(
        tuple(spec_of(b) for b in body.get("benchmarks") or ()), _made(ScanConfig, scan, "scan"),
        _made(ItemStopGrams, stop, "item_stopgrams") if stop else None, _made(StopGrams, body["stopgrams"], "stopgrams") if body.get("stopgrams") else None,
    )


def load(spark: SparkSession, path: str) -> Settings:
    return parse(small.get(spark, path), path)


def problems(spark: SparkSession, path: str, allow_unpinned: bool = False) -> list[str]:
    """What is wrong with a configuration, or worth a look (`warning:`), as far as it can be told on the spot."""
    try:
        got = load(spark, path)
    except Exception as e:
        return [f"{type(e).__name__}: {e}"]
    out = []
    try:
        indexes.check_revisions(list(got.benchmarks), allow_unpinned)
    except ValueError as e:
        out.append(str(e))
    for b in got.benchmarks:
        out += [f"warning: {w}" for w in registry.split_warnings(b)]
        for _, _, place in indexes.split_paths(spark, b):
            try:
                indexes.load_benchmark(spark, b, place)
            except Exception as e:
                out.append(f"{b.name}: {place}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    if got.stopgrams:
        try:
            shards.collect_files(got.stopgrams.inputs, spark)
        except FileNotFoundError as e:
            out.append(f"stopgrams: {e}")
    return out


def initial(keys: list[str]) -> str:
    """A configuration to start from, with registry benchmarks whose paths are to be filled in."""
    lines = ["benchmarks:"]
    for k in keys:
        e = registry.entry(k)
        share = "" if e.short_item_share is None else f"; {100 * e.short_item_share:.0f} % of its items are short"
        lines += [f"  # {e.dataset}, {e.scored_split} is scored{'; gated' if e.gated else ''}{share}", f"  - ref: {k}", f"    path: data/{shards.slug(e.dataset)}"]
    return "\n".join([*lines, "scan:", "  text_keys: [text]", "  ngram: 13", "  min_hits: 3", ""])
