"""The registered queries over the driver's tables, and the same in SQL.

documents are the corpus (`source` is the shard, `doc_id` the row), benchmark is
split into two pseudo-benchmarks by the parity of item_id; where a query needs
fields, the first line of an item is its question and the rest its choices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgram.config import DOC_SEPARATOR, DOC_SEPARATOR_TYPO, REJECT, STOP_WORDS, WORD, ItemStopGrams, ScanConfig
from siftgram.functions import text as X
from siftgram.operators import exact, gates, index, segments, spaced, stopgrams
from siftgram.operators.matching import match
from siftgram.plans import filtering, report, selftest
from siftgram.plans import scan as scans

QUERIES: dict = {}
ORACLES: dict = {}
N = 13


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# inputs


def spread(df: DataFrame) -> DataFrame:
    """Few input splits are dealt out to all cores; inputs with enough of them stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))


def items(spark: SparkSession, sf: str, two_fields: bool = False) -> DataFrame:
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    name = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    whole = F.array(F.array("text"))
    lines = F.split("text", "\n")
    split = F.array(F.array(F.get(lines, F.lit(0))), F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != ""))
    return b.select(name.alias("benchmark"), F.col("item_id").alias("ord"), (split if two_fields else whole).alias("fields"))


_BUILT: dict = {}


def indexed(spark: SparkSession, sf: str, n: int = N, two_fields: bool = False) -> index.Index:
    """The index over a folder's benchmark, built and written once in a session, as scans read one that stands."""
    name = (spark.sparkContext.applicationId, sf, n, two_fields)
    if name not in _BUILT:
        _BUILT[name] = index.cached(index.build_index(items(spark, sf, two_fields), n))
    return _BUILT[name]


def config(n: int = N, **more) -> ScanConfig:
    return ScanConfig(id_key="doc_id", ngram=n, **more)


def parts(spark: SparkSession, sf: str, cfg: ScanConfig) -> DataFrame:
    return segments.sub_documents(segments.segments(documents(spark, sf), cfg, "source", "doc_id"), cfg)


CARRY = ("shard", "row_index")
KEY = ["shard", "row_index"]


def matched(spark: SparkSession, sf: str, ix: index.Index, n: int = N, stop: DataFrame | None = None, boilerplate: int = 50) -> DataFrame:
    """Documents hold no packed separator: rows are sub-documents."""
    return match(parts(spark, sf, config(n)), ix, stop, CARRY, boilerplate=boilerplate)


def scanned(spark: SparkSession, sf: str, cfg: ScanConfig | None = None, two_fields: bool = False) -> scans.ScanResult:
    cfg = cfg or config()
    return scans.scan(documents(spark, sf), indexed(spark, sf, cfg.ngram, two_fields), cfg, "source", "doc_id")


# SQL

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_WORD = WORD.replace("'", "''")
_REJECT = "(?i)" + "|".join(f"(?:{p})" for p in REJECT)


def toks(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '{_WORD}'), lambda x: NOT list_contains([{_STOP}], x))"


def wins(name: str, source: str, n: int, cols: str, guard: str = "TRUE") -> str:
    """CTE: cols, pos, gram of the windows of a token CTE."""
    return (
        f"{name} AS (SELECT * FROM (SELECT {cols}, i - 1 AS pos, array_to_string(t[i:i + {n} - 1], ' ') AS gram FROM "
        f"(SELECT *, unnest(range(1, len(t) - {n} + 2)) AS i FROM {source} WHERE len(t) >= {n} AND {guard})) WHERE NOT regexp_matches(gram, '{_REJECT}'))"
    )


def base(n: int = N, two_fields: bool = False, docs: str | None = None, where: str = "TRUE") -> str:
    """WITH …: dt (tokens), dw (windows), g (distinct windows), it (items), iw (postings), fan, h (distinct hits), c (counts)."""
    docs = docs or "SELECT doc_id, source, text FROM documents"
    first = "string_split(text, chr(10))[1]"
    rest = "array_to_string(list_filter(string_split(text, chr(10))[2:], lambda x: x <> ''), ' ')"
    fields = f"SELECT item_idx, benchmark, 0 AS field_idx, {toks(first)} AS t FROM it UNION ALL SELECT item_idx, benchmark, 1, {toks(rest)} FROM it" if two_fields else f"SELECT item_idx, benchmark, 0 AS field_idx, {toks('text')} AS t FROM it"
    return f"""WITH d0 AS ({docs}),
dt AS (SELECT doc_id, source, octet_length(encode(text)) AS n_bytes, {toks("text")} AS t FROM d0),
{wins("dw", "dt", n, "doc_id, source", f"n_bytes >= {2 * n}")},
g AS (SELECT DISTINCT doc_id, source, gram FROM dw),
it AS (SELECT CAST(row_number() OVER (ORDER BY benchmark, item_id) - 1 AS INT) AS item_idx, benchmark, benchmark || '#' || item_id AS item_id, text, item_id AS ord
       FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS benchmark, item_id, text FROM benchmark)),
ft AS ({fields}),
{wins("fw", "ft", n, "item_idx, benchmark, field_idx")},
iw AS (SELECT DISTINCT gram, item_idx, benchmark, field_idx FROM fw WHERE {where}),
fan AS (SELECT gram, count(DISTINCT item_idx) AS fan_out FROM iw GROUP BY gram),
sz AS (SELECT it.item_idx, it.benchmark, it.item_id, count(DISTINCT gram) AS n_grams FROM it LEFT JOIN iw ON it.item_idx = iw.item_idx GROUP BY ALL),
h AS (SELECT g.* FROM g JOIN fan ON g.gram = fan.gram),
c AS (SELECT x.*, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_grams > 0 THEN CAST(coalesce(n_hits, 0) AS DOUBLE) / n_grams ELSE 0 END AS coverage
      FROM (SELECT doc_id, source, count(*) AS n_grams FROM g GROUP BY ALL) x LEFT JOIN (SELECT doc_id, count(*) AS n_hits FROM h GROUP BY doc_id) y ON x.doc_id = y.doc_id),
fl AS (SELECT * FROM c WHERE n_hits >= 3 AND coverage >= 0.001),
ih AS (SELECT doc_id, source, p.item_idx, count(*) AS hits, count(*) FILTER (fan_out <= 1) AS unique_hits, count(*) FILTER (fan_out > 1 AND fan_out < 3) AS shared_hits,
              count(*) FILTER (fan_out >= 3) AS boilerplate_hits
       FROM h JOIN (SELECT DISTINCT gram, item_idx FROM iw) p ON h.gram = p.gram JOIN fan ON h.gram = fan.gram GROUP BY ALL),
iv AS (SELECT ih.*, sz.n_grams AS item_ngrams, CAST(hits AS DOUBLE) / sz.n_grams AS item_coverage, CAST(hits AS DOUBLE) / c.n_grams AS doc_coverage
       FROM ih JOIN sz ON ih.item_idx = sz.item_idx JOIN c ON ih.doc_id = c.doc_id),
rn AS (SELECT doc_id, item_idx, max(n) + {n - 1} AS longest_run_tokens FROM (
         SELECT doc_id, item_idx, pos - rk AS isl, count(*) AS n FROM (
           SELECT dw.doc_id, p.item_idx, pos, row_number() OVER (PARTITION BY dw.doc_id, p.item_idx ORDER BY pos) AS rk
           FROM dw JOIN (SELECT DISTINCT gram, item_idx FROM iw) p ON dw.gram = p.gram) GROUP BY ALL) GROUP BY ALL),
sh AS (SELECT DISTINCT source AS shard, gram FROM h),
bg AS (SELECT DISTINCT gram, benchmark FROM iw)
"""


# gates


@query(base() + "SELECT doc_id, n_grams, n_hits, coverage FROM fl")
def union_gate(spark: SparkSession, sf: str) -> DataFrame:
    got = gates.union_gate(matched(spark, sf, indexed(spark, sf)), config())
    return got.where("union_flag").select(F.col("row_index").alias("doc_id"), "n_grams", "n_hits", "coverage")


@query(f"SELECT doc_id, CAST(len({toks('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf, indexed(spark, sf)).select(F.col("row_index").alias("doc_id"), "n_tokens")


@query(base() + "SELECT d0.doc_id, CAST(coalesce(c.n_grams, 0) AS BIGINT) AS n_grams FROM d0 LEFT JOIN c ON d0.doc_id = c.doc_id")
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf, indexed(spark, sf)).select(F.col("row_index").alias("doc_id"), "n_grams")


_EVERY_WINDOW = f"""SELECT array_to_string(t[i:i + 2], ' ') AS gram FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT {toks("text")} AS t FROM documents UNION ALL SELECT {toks("text")} FROM benchmark) WHERE len(t) >= 3)"""


@query(
    f"SELECT pattern_idx, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN regexp_matches(gram, '(?i){p}') THEN {i}" for i, p in enumerate(REJECT))} END AS pattern_idx FROM ({_EVERY_WINDOW})) GROUP BY pattern_idx"
)
def reject_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three tokens of all documents and items, by the pattern that rejects them."""
    texts = documents(spark, sf).select("text").unionByName(spark.read.parquet(f"{sf}/benchmark.parquet").select("text"))
    return index.reject_stats(texts.select(F.array(F.array("text")).alias("fields")), 3)


@query(base() + "SELECT h.doc_id, benchmark, count(*) AS hits FROM h JOIN bg ON h.gram = bg.gram GROUP BY ALL")
def src_hits(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    return gates.benchmark_hits(matched(spark, sf, ix), ix, KEY).select(F.col("row_index").alias("doc_id"), "benchmark", "hits")


@query(base(2) + "SELECT doc_id, item_idx, hits, unique_hits, shared_hits, boilerplate_hits FROM ih")
def item_hits_split(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf, 2)
    got = gates.item_hits(matched(spark, sf, ix, 2, boilerplate=3), KEY)
    return got.select(F.col("row_index").alias("doc_id"), "item_idx", "hits", "unique_hits", "shared_hits", "boilerplate_hits")


@query(base() + "SELECT doc_id, item_idx, hits, item_ngrams, item_coverage FROM iv WHERE hits >= 3 AND doc_coverage >= 0.001")
def item_gate(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    got = gates.item_verdicts(matched(spark, sf, ix), config(gate_mode="item"), KEY).where("item_gate")
    return got.select(F.col("row_index").alias("doc_id"), "item_idx", "hits", "item_ngrams", "item_coverage")


@query(base() + "SELECT doc_id, item_idx, hits, item_coverage FROM iv WHERE hits >= 3 AND item_coverage >= 0.5")
def item_coverage_path(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    got = gates.item_verdicts(matched(spark, sf, ix), config(min_item_coverage=0.5), KEY).where("coverage_path")
    return got.select(F.col("row_index").alias("doc_id"), "item_idx", "hits", "item_coverage")


@query(base() + "SELECT rn.doc_id, rn.item_idx, rn.longest_run_tokens FROM rn")
def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    return gates.longest_runs(matched(spark, sf, ix), KEY).select(F.col("row_index").alias("doc_id"), "item_idx", "longest_run_tokens")


@query(base() + "SELECT rn.doc_id, rn.item_idx FROM rn JOIN iv ON rn.doc_id = iv.doc_id AND rn.item_idx = iv.item_idx WHERE hits >= 3 AND doc_coverage >= 0.001 AND longest_run_tokens >= 20")
def longest_run_gate(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    got = gates.item_verdicts(matched(spark, sf, ix), config(gate_mode="item", min_longest_run=20), KEY).where("item_gate")
    return got.select(F.col("row_index").alias("doc_id"), "item_idx")


_FIELDS = base(3, True)


@query(_FIELDS + "SELECT h.doc_id, iw.item_idx, CAST(iw.field_idx AS INT) AS field_idx, count(*) AS hits FROM h JOIN iw ON h.gram = iw.gram GROUP BY ALL")
def field_hits(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf, 3, True)
    return gates.field_hits(matched(spark, sf, ix, 3), ix, KEY).select(F.col("row_index").alias("doc_id"), "item_idx", "field_idx", "hits")


@query(
    _FIELDS
    + """, fh AS (SELECT h.doc_id, iw.item_idx, list_sort(list(DISTINCT iw.field_idx)) AS f FROM h JOIN iw ON h.gram = iw.gram GROUP BY ALL),
af AS (SELECT item_idx, list_sort(list(DISTINCT field_idx)) AS a FROM iw GROUP BY ALL)
SELECT CASE WHEN len(a) = 1 THEN 'single_field' WHEN a = f THEN 'full' WHEN f = [0] THEN 'question_only' ELSE 'partial' END AS kind, count(*) AS n
FROM fh JOIN af ON fh.item_idx = af.item_idx GROUP BY ALL"""
)
def field_match_summary(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf, 3, True)
    return report.field_matches(gates.field_hits(matched(spark, sf, ix, 3), ix, KEY), ix)


@query(
    base()
    + """SELECT source AS shard, item_idx, hits, item_ngrams, item_coverage, doc_id FROM iv
QUALIFY row_number() OVER (PARTITION BY source, item_idx ORDER BY hits DESC, doc_id) = 1"""
)
def item_best(spark: SparkSession, sf: str) -> DataFrame:
    ix = indexed(spark, sf)
    got = gates.item_best(matched(spark, sf, ix).withColumn("doc_id", F.col("row_index")), KEY)
    return got.select("shard", "item_idx", "hits", "item_ngrams", "item_coverage", "doc_id")


# index


@query(
    base()
    + """SELECT sz.benchmark, count(*) AS n_items, count(*) FILTER (n_grams = 0) AS n_empty, count(*) FILTER (n_grams < 3) AS n_short,
CAST(any_value(b.n) AS BIGINT) AS n_ngrams FROM sz JOIN (SELECT benchmark, count(*) AS n FROM bg GROUP BY ALL) b ON sz.benchmark = b.benchmark GROUP BY sz.benchmark"""
)
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.stats(indexed(spark, sf))


_GONE = (
    "gram NOT IN (SELECT gram FROM fw f2 WHERE f2.benchmark = fw.benchmark AND f2.item_idx IN (SELECT item_idx FROM it WHERE ord % 5 = 0))"
)


@query(base(3, where=_GONE) + "SELECT benchmark, count(*) AS n_ngrams FROM bg GROUP BY ALL")
def subtraction_index(spark: SparkSession, sf: str) -> DataFrame:
    every = items(spark, sf)
    gone = every.where("ord % 5 = 0").select("benchmark", F.array_join(F.flatten("fields"), " ").alias("text"))
    ix = index.build_index(every, 3, subtract=gone)
    return ix.postings.groupBy("benchmark").agg(F.count_distinct("gram").alias("n_ngrams"))


@query(base(2) + "SELECT gram, fan_out AS n_items FROM fan WHERE fan_out > 0.02 * (SELECT count(*) FROM it) AND fan_out >= 2")
def item_stopgrams(spark: SparkSession, sf: str) -> DataFrame:
    return stopgrams.item_stopgrams(indexed(spark, sf, 2), 0.02, 2)


@query(
    base(2, where="gram NOT IN (SELECT gram FROM fw GROUP BY gram HAVING count(DISTINCT item_idx) > 0.02 * (SELECT count(*) FROM it) AND count(DISTINCT item_idx) >= 2)")
    + "SELECT item_idx, n_grams FROM sz"
)
def item_stopgrams_index(spark: SparkSession, sf: str) -> DataFrame:
    ix = index.build_index(items(spark, sf), 2, item_stopgrams=ItemStopGrams(0.02, 2))
    return ix.items.select("item_idx", "n_grams")


@query(base() + "SELECT CAST(m AS BIGINT) AS mask, count(*) AS n FROM (SELECT gram, bit_or(CASE WHEN benchmark = 'even' THEN 1 ELSE 2 END) AS m FROM bg GROUP BY gram) GROUP BY ALL")
def benchmark_masks(spark: SparkSession, sf: str) -> DataFrame:
    return index.masks(indexed(spark, sf)).groupBy("mask").agg(F.count("*").alias("n"))


_BACKGROUND = f"""bg0 AS (SELECT doc_id, {toks("text")} AS t FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
{wins("bw", "bg0", 2, "doc_id")},
st AS (SELECT gram, count(DISTINCT doc_id) AS df FROM bw GROUP BY gram HAVING count(DISTINCT doc_id) >= greatest(1, ceil(0.05 * (SELECT count(*) FROM bg0))))"""


@query(f"WITH {_BACKGROUND} SELECT gram, df FROM st")
def background_stopgrams(spark: SparkSession, sf: str) -> DataFrame:
    return stopgrams.background_stopgrams(_background(spark, sf), 2, 0.05)


def _background(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    return stopgrams.background_documents(rows, ["text"])


@query(
    base(2).rstrip()
    + f""", {_BACKGROUND},
k AS (SELECT doc_id, count(*) AS n_kept FROM g WHERE gram NOT IN (SELECT gram FROM st) GROUP BY ALL),
kh AS (SELECT doc_id, count(*) AS n_hits FROM h WHERE gram NOT IN (SELECT gram FROM st) GROUP BY ALL)
SELECT d0.doc_id, CAST(coalesce(c.n_grams, 0) AS BIGINT) AS n_grams, CAST(coalesce(k.n_kept, 0) AS BIGINT) AS n_kept, CAST(coalesce(kh.n_hits, 0) AS BIGINT) AS n_hits
FROM d0 LEFT JOIN c ON d0.doc_id = c.doc_id LEFT JOIN k ON d0.doc_id = k.doc_id LEFT JOIN kh ON d0.doc_id = kh.doc_id"""
)
def scan_with_stopgrams(spark: SparkSession, sf: str) -> DataFrame:
    stop = stopgrams.background_stopgrams(_background(spark, sf), 2, 0.05).cache()
    got = gates.union_gate(matched(spark, sf, indexed(spark, sf, 2), 2, stop), config(2))
    return got.select(F.col("row_index").alias("doc_id"), "n_grams", "n_kept", "n_hits")


# segments


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    """Each document packed with its first half and an empty part, one separator misspelt."""
    d = documents(spark, sf)
    half = F.substring(F.col("text"), F.lit(1), (F.length("text") / 2).cast("int"))
    return d.withColumn("text", F.concat("text", F.lit(DOC_SEPARATOR), F.lit(DOC_SEPARATOR_TYPO), half))


_PACKED_SQL = f"SELECT doc_id, source, text || '{DOC_SEPARATOR}' || '{DOC_SEPARATOR_TYPO}' || left(text, CAST(floor(length(text) / 2) AS INT)) AS text FROM documents"
_SPLIT_SQL = f"SELECT doc_id, source, unnest(string_split(replace(text, '{DOC_SEPARATOR_TYPO}', '{DOC_SEPARATOR}'), '{DOC_SEPARATOR}')) AS text, generate_subscripts(string_split(replace(text, '{DOC_SEPARATOR_TYPO}', '{DOC_SEPARATOR}'), '{DOC_SEPARATOR}'), 1) - 1 AS part FROM ({_PACKED_SQL})"


@query(f"SELECT doc_id || '-part-' || part AS doc_id, CAST(len({toks('text')}) AS BIGINT) AS n_tokens FROM ({_SPLIT_SQL}) WHERE text <> ''")
def packed_split(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config()
    p = segments.sub_documents(segments.segments(_packed(spark, sf), cfg, "source", "doc_id"), cfg)
    return match(p, indexed(spark, sf), keep=("doc_id",)).select("doc_id", "n_tokens")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len({toks('text')}) AS BIGINT) AS n_tokens FROM ({_PACKED_SQL})")
def no_split(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(packed_doc_sep=None)
    p = segments.sub_documents(segments.segments(_packed(spark, sf), cfg, "source", "doc_id"), cfg)
    return match(p, indexed(spark, sf), keep=("doc_id",)).select("doc_id", "n_tokens")


@query(
    f"SELECT page_id || '/' || field || '-part-0' AS doc_id, field, CAST(len({toks('x')}) AS BIGINT) AS n_tokens FROM "
    "(SELECT page_id, 'url' AS field, url AS x FROM pages UNION ALL SELECT page_id, 'html', html FROM pages) WHERE x <> ''"
)
def multi_field(spark: SparkSession, sf: str) -> DataFrame:
    cfg = ScanConfig(text_keys=("url", "html"), id_key="page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("s", F.lit("pages"))
    p = segments.sub_documents(segments.segments(spread(pages), cfg, "s", "page_id"), cfg)
    return match(p, indexed(spark, sf), keep=("doc_id", "field")).select("doc_id", "field", "n_tokens")


_TURNS = "SELECT conv_id AS doc_id, role || '|' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source, text FROM conversations"
_CHAT = base(2, docs="SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, conv_id || '/messages/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '-part-0' AS source, text FROM conversations WHERE text IS NOT NULL")


@query(_CHAT + "SELECT source AS doc_id, n_grams, CAST(n_hits AS BIGINT) AS n_hits FROM c WHERE n_hits > 0")
def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    cfg = ScanConfig(messages_key="messages", id_key="id", ngram=2)
    chats = segments.chats(spark.read.parquet(f"{sf}/conversations.parquet")).withColumn("s", F.lit("chats")).withColumn("r", F.col("id"))
    p = segments.sub_documents(segments.segments(spread(chats), cfg, "s", "r"), cfg)
    got = gates.union_gate(match(p, indexed(spark, sf, 2), keep=("doc_id",)), cfg)
    return got.where("n_hits > 0").select("doc_id", "n_grams", "n_hits")


# reports


@query(base() + "SELECT shard, benchmark, count(*) AS n FROM sh JOIN bg ON sh.gram = bg.gram GROUP BY ALL")
def hits_by_shard(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.hits_by_shard(scans.hits(r), r.index)


@query(
    base()
    + """SELECT benchmark, count(*) FILTER (gram IN (SELECT gram FROM sh)) AS leaked, count(*) AS total,
CAST(count(*) FILTER (gram IN (SELECT gram FROM sh)) AS DOUBLE) / count(*) AS fraction FROM bg GROUP BY ALL"""
)
def leak_by_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.leak_by_benchmark(scans.hits(r), r.index)


@query(
    base()
    + """SELECT l.item_idx, sz.benchmark, sz.item_id, leaked, unique_leaked, shared_leaked, boilerplate_leaked, n_grams AS total, CAST(leaked AS DOUBLE) / n_grams AS fraction
FROM (SELECT p.item_idx, count(*) AS leaked, count(*) FILTER (fan_out <= 1) AS unique_leaked, count(*) FILTER (fan_out > 1 AND fan_out < 50) AS shared_leaked, count(*) FILTER (fan_out >= 50) AS boilerplate_leaked
      FROM (SELECT DISTINCT gram FROM sh) s JOIN (SELECT DISTINCT gram, item_idx FROM iw) p ON s.gram = p.gram JOIN fan ON s.gram = fan.gram GROUP BY ALL) l JOIN sz ON l.item_idx = sz.item_idx"""
)
def leak_by_item(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.leak_by_item(scans.hits(r), r.index)


_BY_SHARD = """SELECT s.shard, unique_grams, scanned, CAST(unique_grams AS DOUBLE) / scanned * 1000 AS per_1k_docs
FROM (SELECT shard, count(*) AS unique_grams FROM sh GROUP BY ALL) s JOIN (SELECT source AS shard, count(*) FILTER (n_bytes >= 26) AS scanned FROM dt GROUP BY ALL) n ON s.shard = n.shard"""


@query(base() + _BY_SHARD)
def leak_by_shard(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.leak_by_shard(scans.hits(r), r.index, scans.shard_summary(r))


@query(base() + _BY_SHARD + " ORDER BY unique_grams DESC, per_1k_docs DESC, s.shard LIMIT 5")
def worst_shards_topk(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.worst_shards(report.leak_by_shard(scans.hits(r), r.index, scans.shard_summary(r)), 5)


@query(
    base()
    + """SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY n DESC, shard) AS rank FROM (SELECT shard, benchmark, count(*) AS n FROM sh JOIN bg ON sh.gram = bg.gram GROUP BY ALL)
QUALIFY rank <= 3"""
)
def worst_shards_per_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.worst_shards_per_benchmark(report.hits_by_shard(scans.hits(r), r.index), 3)


@query(
    base()
    + """SELECT shard, string_agg(benchmark || ':' || n, ';' ORDER BY n DESC, benchmark) AS benchmarks FROM (SELECT shard, benchmark, count(*) AS n FROM sh JOIN bg ON sh.gram = bg.gram GROUP BY ALL) GROUP BY shard"""
)
def shard_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf)
    return report.shard_benchmarks(report.hits_by_shard(scans.hits(r), r.index))


_SUMMARY = """SELECT dt.source AS shard, count(*) FILTER (n_bytes >= 26) AS scanned, count(fl.doc_id) AS contaminated, CAST(0 AS BIGINT) AS empty_after_filter,
count(fl.doc_id) AS by_ngram, CAST(0 AS BIGINT) AS by_spaced, CAST(0 AS BIGINT) AS by_exact, CAST(count(fl.doc_id) AS DOUBLE) / count(*) FILTER (n_bytes >= 26) AS contam_rate
FROM dt LEFT JOIN fl ON dt.doc_id = fl.doc_id GROUP BY dt.source"""


@query(base() + _SUMMARY)
def shard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scans.shard_summary(scanned(spark, sf))


@query(
    base()
    + f"""SELECT count(*) AS shards, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(contaminated) AS BIGINT) AS contaminated, CAST(0 AS BIGINT) AS empty_after_filter,
CAST(sum(by_ngram) AS BIGINT) AS by_ngram, CAST(0 AS BIGINT) AS by_spaced, CAST(0 AS BIGINT) AS by_exact, CAST(sum(contaminated) AS DOUBLE) / sum(scanned) AS contam_rate FROM ({_SUMMARY})"""
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scans.run_summary(scanned(spark, sf))


@query(base() + "SELECT source AS shard, doc_id || '-part-0' AS doc_id FROM fl QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 1")
def record_cap(spark: SparkSession, sf: str) -> DataFrame:
    return scans.records(scanned(spark, sf, config(max_return_records=1))).select("shard", "doc_id")


@query(
    base()
    + """SELECT fl.doc_id AS row_index, fl.n_hits AS match_count, count(iv.item_idx) AS n_items FROM fl LEFT JOIN iv ON fl.doc_id = iv.doc_id AND iv.hits >= 3 AND iv.doc_coverage >= 0.001 GROUP BY ALL"""
)
def flagged_records(spark: SparkSession, sf: str) -> DataFrame:
    got = scans.records(scanned(spark, sf))
    return got.select("row_index", "match_count", F.coalesce(F.size("item_hits"), F.lit(0)).cast("long").alias("n_items"))


# filter


@query(base() + "SELECT doc_id FROM d0 WHERE doc_id NOT IN (SELECT doc_id FROM fl)")
def filter_record(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf, config(max_return_records=0))
    return filtering.filter_records(documents(spark, sf), r, "source", "doc_id").select("doc_id")


_PARTS = base(docs=f"SELECT doc_id * 3 + part AS doc_id, source, text FROM ({_SPLIT_SQL}) WHERE text <> ''")


@query(
    _PARTS.rstrip()
    + f""", pk AS (SELECT doc_id, count(*) FILTER (bad) AS n_bad, string_agg(text, '{DOC_SEPARATOR}' ORDER BY part) FILTER (NOT bad) AS kept
 FROM (SELECT doc_id, part, text, (doc_id * 3 + part) IN (SELECT doc_id FROM fl) AS bad FROM ({_SPLIT_SQL})) GROUP BY doc_id)
SELECT pk.doc_id, CAST(length(CASE WHEN n_bad > 0 THEN coalesce(kept, '') ELSE p.text END) AS BIGINT) AS n_chars FROM pk JOIN ({_PACKED_SQL}) p ON pk.doc_id = p.doc_id
WHERE n_bad = 0 OR trim(coalesce(kept, ''), ' ' || chr(10)) <> ''"""
)
def filter_subdoc(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(max_return_records=0)
    r = scans.scan(_packed(spark, sf), indexed(spark, sf), cfg, "source", "doc_id")
    return filtering.filter_parts(_packed(spark, sf), r, "source", "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(
    base()
    + """SELECT benchmark, count(DISTINCT fl.doc_id) AS rows FROM fl JOIN h ON fl.doc_id = h.doc_id JOIN bg ON h.gram = bg.gram GROUP BY benchmark
UNION ALL SELECT NULL, count(*) FROM fl"""
)
def filter_removals(spark: SparkSession, sf: str) -> DataFrame:
    r = scanned(spark, sf, config(max_return_records=0))
    return filtering.removals(r, r.index)


# exact and spaced channels


def _places(text: str, needle: str) -> str:
    """SQL: numbers of the pieces of text that a word-bounded occurrence of needle follows."""
    pieces = f"string_split({text}, {needle})"
    before = f"CASE WHEN {pieces}[i] = '' AND i > 1 THEN {needle} ELSE {pieces}[i] END"
    after = f"CASE WHEN {pieces}[i + 1] = '' AND i + 1 < len({pieces}) THEN {needle} ELSE {pieces}[i + 1] END"
    touch = lambda x, y: f"(regexp_matches(right({x}, 1), '^{_A}$') AND regexp_matches(left({y}, 1), '^{_A}$'))"
    return f"list_filter(range(1, len({pieces})), lambda i: NOT {touch(before, needle)} AND NOT {touch(needle, after)})"


def _light(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g'))"


_A = r"[\p{L}\p{N}]"
_EXACT = f"""SELECT d.doc_id, q.item_idx FROM (SELECT doc_id, {_light("text")} AS l FROM d0) d
JOIN (SELECT it.item_idx, {_light("text")} AS q, n_grams FROM it JOIN sz ON it.item_idx = sz.item_idx) q ON length(q.q) >= 12 AND contains(d.l, q.q)
WHERE len({_places("d.l", "q.q")}) > 0"""


@query(
    base()
    + f"""SELECT benchmark, count(DISTINCT doc_id) AS rows FROM (
  SELECT fl.doc_id, bg.benchmark FROM fl JOIN h ON fl.doc_id = h.doc_id JOIN bg ON h.gram = bg.gram
  UNION ALL SELECT e.doc_id, it.benchmark FROM ({_EXACT}) e JOIN it ON e.item_idx = it.item_idx) GROUP BY benchmark
UNION ALL SELECT NULL, count(*) FROM (SELECT doc_id FROM fl UNION SELECT doc_id FROM ({_EXACT}))"""
)
def filter_removals_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Removals by benchmark where the exact channel flags rows that n-grams don't."""
    return filtering.removals(scanned(spark, sf, config(13, max_return_records=0, exact_channel="all")))


@query(
    base()
    + """, ok AS (SELECT DISTINCT doc_id FROM iv WHERE hits >= 3 AND doc_coverage >= 0.001)
SELECT shard, count(*) FILTER (n_bytes >= 26) AS scanned, count(ok.doc_id) AS contaminated FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN source END AS shard FROM dt) t
LEFT JOIN ok ON t.doc_id = ok.doc_id GROUP BY shard"""
)
def null_shard_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The item gate over rows of which half have no shard and two thirds no row number."""
    cfg = config(gate_mode="item")
    rows = documents(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("shard"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("row"))
    return scans.shard_summary(scans.scan(rows, indexed(spark, sf), cfg, "shard", "row")).select("shard", "scanned", "contaminated")


@query(base() + _EXACT)
def exact_all(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(exact_channel="all")
    return exact.exact_hits(parts(spark, sf, cfg).select(*KEY, "text"), indexed(spark, sf), cfg, KEY).select(F.col("row_index").alias("doc_id"), "item_idx")


@query(base() + _EXACT + " AND q.n_grams < 3")
def exact_short(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(exact_channel="short")
    return exact.exact_hits(parts(spark, sf, cfg).select(*KEY, "text"), indexed(spark, sf), cfg, KEY).select(F.col("row_index").alias("doc_id"), "item_idx")


_NEAR = f"""WITH q AS (SELECT CAST(row_number() OVER (ORDER BY benchmark, item_id) - 1 AS INT) AS item_idx, {_light("string_split(text, chr(10))[1]")} AS q,
  list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: {_light("x")}), lambda x: x <> '') AS cs
  FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS benchmark, item_id, text FROM benchmark)),
p AS (SELECT d.doc_id, q.*, d.l, {_places("d.l", "q.q")} AS pl FROM (SELECT doc_id, {_light("text")} AS l FROM documents) d JOIN q ON length(q.q) >= 12 AND contains(d.l, q.q)),
s AS (SELECT *, CAST(list_sum(list_transform(string_split(l, q)[1:pl[1]], lambda x: length(x))) + (pl[1] - 1) * length(q) AS BIGINT) AS b FROM p WHERE len(pl) > 0),
w AS (SELECT *, substring(l, greatest(0, b - 1000) + 1, b + length(q) + 1000 - greatest(0, b - 1000)) AS near FROM s),
c AS (SELECT doc_id, item_idx, unnest(CASE WHEN len(cs) = 0 THEN [NULL] ELSE cs END) AS c, len(cs) AS n, near FROM w)
SELECT doc_id, item_idx, CAST(count(*) FILTER (c IS NOT NULL AND contains(near, c) AND len({_places("near", "c")}) > 0) AS INT) AS choices_found, CAST(any_value(n) AS INT) AS choices_total
FROM c GROUP BY doc_id, item_idx"""


@query(_NEAR)
def choices_near(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(exact_channel="all")
    got = exact.exact_hits(parts(spark, sf, cfg).select(*KEY, "text"), indexed(spark, sf, N, True), cfg, KEY)
    return exact.choices_near(got).select(F.col("row_index").alias("doc_id"), "item_idx", "choices_found", "choices_total")


@query()
def lcs_confirm(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config(exact_channel="all")
    got = exact.confirm(exact.exact_hits(parts(spark, sf, cfg).select(*KEY, "text"), indexed(spark, sf), cfg, KEY))
    return got.select(F.col("row_index").alias("doc_id"), "item_idx", "numbers_total", "numbers_matched", "lcs_chars", "lcs_ratio")


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(lower(html), '[0-9]+(?:\\.[0-9]+)?'))) AS BIGINT) AS n_numbers FROM pages")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.size(X.numbers(X.light(F.col("html")))).cast("long").alias("n_numbers"))


@query(f"SELECT doc_id, md5({_light('text')}) AS light_md5 FROM documents")
def light_text(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.md5(X.light(F.col("text"))).alias("light_md5"))


def _seed_sql(name: str, source: str, cols: str) -> str:
    per = " UNION ALL ".join(
        f"SELECT {cols}, i - 1 AS pos, 's{p}|' || concat_ws(' ', " + ", ".join(f"t[i + {o}]" for o in offs) + f") AS seed FROM (SELECT *, unnest(range(1, len(t) - 15)) AS i FROM {source} WHERE len(t) >= 17)"
        for p, offs in enumerate(spaced.FAMILY.offsets())
    )
    return f"{name} AS ({per})"


_LOCI = f""", ds AS (SELECT doc_id, t FROM dt), ists AS (SELECT item_idx, t FROM ft),
{_seed_sql("dsd", "ds", "doc_id")}, {_seed_sql("isd", "ists", "item_idx")},
lo AS (SELECT doc_id, item_idx, dsd.pos - isd.pos AS diag, count(DISTINCT dsd.pos) AS n_loci, min(dsd.pos) AS first_, max(dsd.pos) AS last_
       FROM dsd JOIN isd ON dsd.seed = isd.seed GROUP BY ALL HAVING count(DISTINCT dsd.pos) >= 3)
"""


@query(base().rstrip() + _LOCI + "SELECT doc_id, item_idx, CAST(diag AS INT) AS diag, n_loci FROM lo")
def spaced_loci(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config()
    found = spaced.loci_kernel(parts(spark, sf, cfg).select(*KEY, "text"), indexed(spark, sf), cfg, KEY, verify=False)
    return found.select(F.col("row_index").alias("doc_id"), "item_idx", "diag", "n_loci")


@query(
    base().rstrip()
    + _LOCI.rstrip()
    + """, al AS (SELECT lo.*, dt.t AS a, ft.t AS b, greatest(first_, 0, diag) AS x, least(last_ + 17, len(dt.t), len(ft.t) + diag) AS y FROM lo JOIN dt ON lo.doc_id = dt.doc_id JOIN ft ON lo.item_idx = ft.item_idx),
ok AS (SELECT * FROM al WHERE y - x >= 17 AND CAST(len(list_filter(range(x, y), lambda p: a[p + 1] = b[p - diag + 1])) AS DOUBLE) / (y - x) >= 0.85)
SELECT doc_id, CAST(min(item_idx) AS INT) AS spaced_item FROM ok GROUP BY doc_id"""
)
def spaced_verified(spark: SparkSession, sf: str) -> DataFrame:
    cfg = config()
    ix = indexed(spark, sf)
    got = match(parts(spark, sf, cfg), ix, keep=CARRY, seeds=spaced.kernel(ix, cfg)).where("spaced_item IS NOT NULL")
    return got.select(F.col("row_index").alias("doc_id"), "spaced_item")


@query(
    base().rstrip()
    + f""", ex AS (SELECT DISTINCT doc_id FROM ({_EXACT}))
SELECT count(*) FILTER (fl.doc_id IS NOT NULL) AS by_ngram, count(*) FILTER (ex.doc_id IS NOT NULL) AS by_exact, count(*) FILTER (fl.doc_id IS NOT NULL OR ex.doc_id IS NOT NULL) AS contaminated
FROM d0 LEFT JOIN fl ON d0.doc_id = fl.doc_id LEFT JOIN ex ON d0.doc_id = ex.doc_id"""
)
def channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.run_summary(scanned(spark, sf, config(exact_channel="all", spaced=True))).select("by_ngram", "by_exact", F.col("contaminated"))


# self-test and checks


@query(
    base()
    + """SELECT v AS variant, count(*) FILTER (n_grams > 0) AS planted, count(*) FILTER (n_grams >= 3) AS matchable, CASE WHEN v = 'control' THEN 0 ELSE count(*) FILTER (n_grams >= 3) END AS found
FROM sz, (SELECT unnest(['verbatim', 'upper', 'whitespace', 'wrapper', 'control']) AS v) GROUP BY v"""
)
def selftest_recall(spark: SparkSession, sf: str) -> DataFrame:
    return selftest.recall(indexed(spark, sf))


@query("SELECT quality, bool_and(toxic IS NULL OR trim(CAST(toxic AS VARCHAR)) IN ('', '-1')) AS hidden FROM labels GROUP BY quality")
def hidden_labels(spark: SparkSession, sf: str) -> DataFrame:
    return index.hidden_labels(spark.read.parquet(f"{sf}/labels.parquet"), ["quality"], "toxic")
