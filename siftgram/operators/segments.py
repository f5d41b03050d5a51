"""Rows to sub-documents: fields, chat turns and packed parts, each scored by itself."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgram.config import ScanConfig
from siftgram.functions.text import identity128

#: Columns that name a sub-document.
KEY = ("shard", "row_index", "field_ord", "turn", "part")


def check_columns(df: DataFrame, cfg: ScanConfig) -> None:
    """Missing columns and wrong types are errors; string-like columns left out are a warning."""
    fields = {f.name: f.dataType for f in df.schema}
    for name in cfg.text_keys:
        if name not in fields:
            raise ValueError(f"text column {name!r} is missing; there are {sorted(fields)}")
        if not isinstance(fields[name], (T.StringType, T.NullType)):
            raise TypeError(f"{name!r} is {fields[name].simpleString()}: expected a string column")
    key = cfg.messages_key
    if key is not None:
        if key not in fields:
            raise ValueError(f"messages column {key!r} is missing; there are {sorted(fields)}")
        kind = fields[key]
        if not _is_chat(kind):
            raise TypeError(f"{key!r} has to be a list of structs with content")
    if cfg.id_key is not None and cfg.id_key not in fields:
        warnings.warn(f"no id column {cfg.id_key!r}: ids are hashes of texts", stacklevel=3)
    used = {*cfg.text_keys, key, cfg.id_key}
    over = [n for n, k in fields.items() if n not in used and (isinstance(k, T.StringType) or _is_chat(k))]
    if over:
        warnings.warn(f"columns that are not scanned: {', '.join(sorted(over))}", stacklevel=3)


def _is_chat(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "content" in kind.elementType.names


def with_rows(df: DataFrame, shard: str | None = None, row_index: str | None = None) -> DataFrame:
    """Adds shard and row_index, from columns or from what the Parquet reader knows of its files."""
    s = F.col(shard) if shard else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    i = F.col(row_index) if row_index else F.col("_metadata.row_index")
    return df.select("*", s.alias("__shard"), i.cast("long").alias("__row"))


def segments(df: DataFrame, cfg: ScanConfig, shard: str | None = None, row_index: str | None = None) -> DataFrame:
    """One row per non-empty text field or chat turn: shard, row_index, id, field, field_ord, role, turn, text."""
    rows = with_rows(df, shard, row_index)
    none = F.lit(None)
    parts = [
        F.array(F.struct(F.lit(k).alias("field"), F.lit(i).alias("field_ord"), none.cast("string").alias("role"), F.lit(-1).alias("turn"), F.col(f"`{k}`").cast("string").alias("text")))
        for i, k in enumerate(cfg.text_keys)
    ]
    if cfg.messages_key:
        at = len(cfg.text_keys)
        kind = df.schema[cfg.messages_key].dataType.elementType
        role = (lambda m: m["role"].cast("string")) if "role" in kind.names else (lambda m: none.cast("string"))
        parts.append(
            F.transform(
                F.coalesce(F.col(f"`{cfg.messages_key}`"), F.array().cast(df.schema[cfg.messages_key].dataType)),
                lambda m, i: F.struct(F.lit(cfg.messages_key).alias("field"), F.lit(at).alias("field_ord"), role(m).alias("role"), i.alias("turn"), m["content"].cast("string").alias("text")),
            )
        )
    own = F.nullif(F.col(f"`{cfg.id_key}`").cast("string"), F.lit("")) if cfg.id_key in df.columns else none.cast("string")
    each = rows.select(F.col("__shard").alias("shard"), F.col("__row").alias("row_index"), own.alias("id"), F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("s"))
    return each.select("shard", "row_index", "id", "s.*").where(F.col("text") != "")


def _name(cfg: ScanConfig, split: bool) -> Column:
    """`id[/field[/turn]][-part-k]`; without an id the hash of the part's own text stands in."""
    several = len(cfg.text_keys) + bool(cfg.messages_key) > 1 or bool(cfg.messages_key)
    own = F.coalesce(F.col("id"), identity128(F.when(F.col("id").isNull(), F.col("text"))))
    out = [own]
    if several:
        out += [F.lit("/"), F.col("field"), F.when(F.col("turn") >= 0, F.concat(F.lit("/"), F.col("turn").cast("string"))).otherwise("")]
    if split:
        out += [F.lit("-part-"), F.col("part").cast("string")]
    return F.concat(*out)


def sub_documents(segs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Splits packed texts; part counts all parts, also empty ones. Adds part (null without splitting) and doc_id."""
    if cfg.packed_doc_sep is None:
        return segs.withColumn("part", F.lit(None).cast("int")).withColumn("doc_id", _name(cfg, False))
    body = F.col("text")
    if cfg.packed_doc_sep_typo:
        body = F.replace(body, F.lit(cfg.packed_doc_sep_typo), F.lit(cfg.packed_doc_sep))
    quoted = "\\Q" + cfg.packed_doc_sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    keep = [c for c in segs.columns if c != "text"]
    out = segs.select(*keep, F.posexplode(F.split(body, quoted, -1)).alias("part", "text"))
    return out.where(F.col("text") != "").withColumn("doc_id", _name(cfg, True))


def chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn rows to one row per conversation with messages, in turn order."""
    item = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))
    listed = F.sort_array(F.collect_list(item))
    return turns.groupBy(F.col(conv).alias("id")).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
