"""Public benchmarks as data: where they are published, which fields are protected, how many items are short.

Nothing is downloaded; an entry becomes a BenchmarkSpec once it is given a local path.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftgram.config import BenchmarkSpec


@dataclass(frozen=True)
class Entry:
    key: str
    name: str
    dataset: str
    configs: tuple[str, ...]
    data_files: tuple[str, ...]
    splits: tuple[str, ...]
    fields: tuple[str, ...]
    label_field: str
    revision: str
    scored_split: str
    item_count: int | None
    short_items: int | None
    gated: bool

    @property
    def short_item_share(self) -> float | None:
        """Items with fewer than 3 windows of 13 words, as a share; None where it was not measured."""
        return self.short_items / self.item_count if self.item_count and self.short_items is not None else None

    def spec(self, path: str = "", format: str = "parquet") -> BenchmarkSpec:
        return BenchmarkSpec(
            self.name, path or self.dataset, self.fields, format=format, splits=self.splits, revision=self.revision or None,
            label_field=self.label_field or None, dataset=self.dataset, configs=self.configs, data_files=self.data_files,
        )


def _list(x: str) -> tuple[str, ...]:
    return tuple(p for p in x.split("+") if p)


def _entry(row: dict[str, str]) -> Entry:
    number = lambda x: int(x) if x else None
    many = {k: _list(row[k]) for k in ("configs", "data_files", "splits", "fields")}
    rest = {k: row[k] for k in ("key", "name", "dataset", "label_field", "revision", "scored_split")}
    return Entry(**rest, **many, item_count=number(row["item_count"]), short_items=number(row["short_items"]), gated=row["gated"] == "gated")


def entries(path: str | None = None) -> dict[str, Entry]:
    with open(path or Path(__file__).with_name("benchmarks.csv"), newline="", encoding="utf-8") as f:
        return {r["key"]: _entry(r) for r in csv.DictReader(f, delimiter=";")}


def entry(key: str) -> Entry:
    known = entries()
    if key not in known:
        raise KeyError(f"no benchmark {key!r}; there are {', '.join(sorted(known))}")
    return known[key]


def entry_for(spec: BenchmarkSpec, known: dict[str, Entry] | None = None) -> Entry | None:
    """The entry of a spec's dataset: with equal configs, else with some in common, else the only one there is."""
    same = [e for e in (known or entries()).values() if spec.dataset and e.dataset.lower() == spec.dataset.strip().lower()]
    mine = set(spec.configs)
    exact = [e for e in same if set(e.configs) == mine]
    some = [e for e in same if mine & set(e.configs)]
    for found in (exact, some):
        if found:
            return found[0]
    return same[0] if len(same) == 1 else None


def with_overrides(key: str, **given) -> BenchmarkSpec:
    """A registry entry's spec with some settings replaced."""
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    path, form = given.pop("path", ""), given.pop("format", "parquet")
    return replace(entry(key).spec(path, form), **given)


def split_warnings(spec: BenchmarkSpec) -> list[str]:
    """What the registry knows against a spec's choice of splits."""
    e = entry_for(spec)
    if e is None:
        return []
    out = []
    if e.scored_split and e.scored_split not in spec.splits:
        out.append(f"{spec.name}: {e.scored_split} is what is scored, not {', '.join(spec.splits)}")
    if e.gated:
        out.append(f"{spec.name}: {e.dataset} is gated")
    return out


def rows(spark: SparkSession) -> DataFrame:
    """One row per entry."""
    kind = (
        "key string, name string, dataset string, configs array<string>, data_files array<string>, splits array<string>, fields array<string>, "
        "label_field string, revision string, scored_split string, item_count int, short_items int, short_item_share double, gated boolean"
    )
    names = [c.split(" ")[0] for c in kind.split(", ")]
    value = lambda e, n: list(v) if isinstance(v := getattr(e, n), tuple) else v
    return spark.createDataFrame([tuple(value(e, n) for n in names) for e in entries().values()], kind)


def card() -> str:
    head = "| key | dataset | configs | splits | fields | short items |\n|:-|:-|:-|:-|:-|-:|\n"
    share = lambda e: "" if e.short_item_share is None else f"{100 * e.short_item_share:.0f} %"
    return head + "".join(f"| {e.key} | {e.dataset} | {', '.join(e.configs)} | {', '.join(e.splits)} | {', '.join(e.fields)} | {share(e)} |\n" for e in entries().values())


def export(spark: SparkSession, out: str) -> None:
    """The registry as a Parquet table and a card, as for publication."""
    rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{out}/registry")
    spark.createDataFrame([(card(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/card")


def describe(key: str) -> str:
    e = entry(key)
    lines = [f"{e.name} ({e.key})", f"dataset: {e.dataset}", f"revision: {e.revision}", f"configs: {', '.join(e.configs) or '-'}", f"splits: {', '.join(e.splits)} (scored: {e.scored_split})", f"fields: {', '.join(e.fields)}"]
    if e.short_item_share is not None:
        lines.append(f"items: {e.item_count}, of which {e.short_items} ({100 * e.short_item_share:.0f} %) are too short for the n-gram rule")
    return "\n".join(lines + (["gated"] if e.gated else []))
