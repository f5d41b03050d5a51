import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftgram.config import BenchmarkSpec, ScanConfig
from siftgram.operators import index
from siftgram.sources import shards
from siftgram.streaming import scan as streaming


def test_collect_files(tmp_path):
    for n in ("b.jsonl", "a.parquet", "sub/c.jsonl.gz", "skip.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"")
    got = [p.rsplit("/", 1)[1] for p in shards.collect_files([str(tmp_path), str(tmp_path / "*.jsonl")])]
    assert got == ["a.parquet", "b.jsonl", "c.jsonl.gz"]
    with pytest.raises(FileNotFoundError):
        shards.collect_files([str(tmp_path / "none*")])
    assert shards.stem("/x/y.jsonl.gz") == "y"


def test_json_lines_row_numbers_and_byte_identity(spark, tmp_path):
    body = b'{"id": "a", "text": "one"}\r\n\n{"id": "b",  "text": "two"}\n  \n{"id": "c", "text": "three"}\n'
    for name, data in (("x.jsonl", body), ("y.jsonl.gz", gzip.compress(body))):
        (tmp_path / name).write_bytes(data)
        rows = shards.read_jsonl(spark, [str(tmp_path / name)]).orderBy("row_index").collect()
        assert [(r.id, r.row_index) for r in rows] == [("a", 0), ("b", 1), ("c", 2)]
    gone = spark.createDataFrame([(1,)], "row_index long")
    shards.filter_lines(spark, str(tmp_path / "x.jsonl"), gone, str(tmp_path / "out"))
    [part] = list((tmp_path / "out" / "shard=x").glob("part-*"))
    assert part.read_bytes() == body.replace(b'{"id": "b",  "text": "two"}\n', b"")


def test_zstandard_and_many_splits_in_one_plan(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    bodies = {}
    for name in ("a", "b", "c d"):
        lines = [json.dumps({"id": f"{name}{i}", "text": "x" * (i % 90)}) if i % 7 else "" for i in range(3000)]
        bodies[name] = [x for x in lines if x]
        raw = ("\n".join(lines) + "\n").encode()
        (tmp_path / f"{name}.jsonl{'.zst' if name == 'b' else ''}").write_bytes(zstandard.compress(raw) if name == "b" else raw)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits a file
    try:
        rows = shards.read_jsonl(spark, shards.collect_files([str(tmp_path)], spark)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    got = {}
    for r in rows:
        got.setdefault(r.shard, {})[r.row_index] = r.id
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: [json.loads(x)["id"] for x in v] for k, v in bodies.items()}


def test_files_through_the_session(spark, tmp_path):
    for n in ("b.jsonl", "a.parquet", "sub/c.jsonl.gz", "skip.txt", "_hidden.parquet"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * 7)
    got = shards.collect_files([str(tmp_path), str(tmp_path / "*.jsonl")], spark)
    assert got == shards.collect_files([str(tmp_path / n) for n in ("a.parquet", "b.jsonl", "sub")]) and len(got) == 3
    with pytest.raises(FileNotFoundError):
        shards.collect_files([str(tmp_path / "none*")], spark)
    about = {a["path"].rsplit("/", 1)[1]: a for a in shards.survey(spark, got)}
    assert about["a.parquet"]["error"] and about["b.jsonl"]["error"] is None and about["b.jsonl"]["bytes"] == 7
    assert about["b.jsonl"]["sha256"] == hashlib.sha256(b"x" * 7).hexdigest()
    with pytest.raises(ValueError, match="share a name"):
        shards.check_stems(["/x/a.jsonl", "/y/a.parquet"])
    assert shards.slug(" org/a name ") == "org__a-name"


def test_benchmark_splits_and_formats(spark, tmp_path):
    for config, split, rows in (("one", "test", [{"q": "b2", "l": "-1"}, {"q": "a1", "l": "-1"}]), ("two", "test", [{"q": "c3", "l": "x"}]), ("all", "test", [{"q": "zz", "l": "x"}])):
        (tmp_path / "j" / config).mkdir(parents=True, exist_ok=True)
        (tmp_path / "j" / config / f"{split}.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    spec = BenchmarkSpec("j", str(tmp_path / "j"), ("q",), format="jsonl", splits=("test", "dev"), configs=("*",), label_field="l")
    status = []
    with pytest.warns(UserWarning, match="labels"):
        got = index.load_benchmark(spark, spec, status=status)
    assert [(r.ord, r.fields, r.field_names) for r in got.orderBy("ord").collect()] == [(0, [["b2"]], ["q"]), (1, [["a1"]], ["q"]), (2, [["c3"]], ["q"])]
    assert [(s.config, s.split, s.rows, s.error is None) for s in status] == [("one", "test", 2, True), ("one", "dev", None, False), ("two", "test", 1, True), ("two", "dev", None, False)]
    (tmp_path / "t.csv").write_text('q,n\n"line one\nline two",1\nplain,2\n')
    got = index.load_benchmark(spark, BenchmarkSpec("c", str(tmp_path / "t.csv"), ("q", "n"), format="csv")).orderBy("ord").collect()
    assert [r.fields for r in got] == [[["line one\nline two"], ["1"]], [["plain"], ["2"]]]
    with pytest.raises(ValueError, match="no field"):
        index.load_benchmark(spark, BenchmarkSpec("c", str(tmp_path / "t.csv"), ("x",), format="csv"))
    with pytest.raises(ValueError, match="no split"):
        index.load_benchmark(spark, BenchmarkSpec("c", str(tmp_path / "none.csv"), ("x",), format="csv"), status=[])


def test_parquet_rows_and_records(spark, tmp_path):
    spark.range(2500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text")).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = shards.read_parquet(spark, [str(tmp_path / "p")])
    assert rows.where("row_index in (3, 2049)").selectExpr("id = cast(row_index as string) ok").distinct().first().ok
    shards.write_records(rows.limit(2), str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").rglob("part-*.txt") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and "text" in lines[0]
    done = spark.createDataFrame([("s1", "f", None), ("s2", "g", None), ("s3", "f", "broken")], "shard string, fingerprint string, error string")
    assert shards.finished(done, ["s1", "s2", "s3", "s4"], "f") == ["s2", "s3", "s4"]


def test_streaming_scan(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon", "clean text of other words here", "x alpha beta gamma delta epsilon"]
    df = spark.createDataFrame([(f"d{i}", t, "s", i) for i, t in enumerate(texts)], "id string, text string, shard string, row long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    ix = index.build_index(spark.createDataFrame([("b", 0, [["alpha beta gamma delta epsilon"]])], "benchmark string, ord long, fields array<array<string>>"), 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.run(stream, ix, ScanConfig(ngram=2), "shard", "row", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert tuple(streaming.totals(spark, str(tmp_path / "out")).first()) == ("s", 3, 2)
