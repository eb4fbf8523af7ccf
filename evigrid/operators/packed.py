"""Several values packed in one field: one row per value with its position (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evigrid.functions import packed
from evigrid.session import Scratch, is_small

_SEP = "\u0001"
_RULE = "skeleton string, prose boolean, rule array<struct<a:int,b:int>>"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(packed.TOKEN), F.lit(0))


def skeleton(parts: Column) -> Column:
    """The JVM form of functions.packed.skeleton."""
    lower = lambda i: F.lower(F.get(parts, i))

    def mask(x: Column, i: Column) -> Column:
        stepped = (lower(i - 1) == "step") | (F.get(parts, i - 1).rlike(r"^[ \t ​﻿]+$") & (lower(i - 2) == "step"))
        closed = F.get(parts, i + 1).isin(".", ")", ":", "]")
        stepped, closed = F.coalesce(stepped, F.lit(False)), F.coalesce(closed, F.lit(False))
        first = (i == 0) | F.coalesce(F.get(parts, i - 1).isin("\n", "\r\n", "\r"), F.lit(False))
        number = F.when((stepped | closed) & (F.length(x) <= F.when(first | stepped, 6).otherwise(2)), x).otherwise("#")
        return (
            F.when(x.rlike(r"^\r\n?$"), "\n")
            .when(x.rlike("^[0-9]+$"), number)
            .when(x.rlike("^[0-9]"), "#")
            .when(x.rlike(r"^[\p{L}\p{N}_]"), F.when(F.lower(x).isin(*packed.KEPT_WORDS), F.lower(x)).otherwise("w"))
            .when(x.rlike(r"^[ \t ​﻿]+$"), F.when(x.contains("\t"), "\t").otherwise(" "))
            .when(x.isin("=>", "→"), "->")
            .otherwise(x)
        )

    return F.array_join(F.transform(parts, mask), _SEP)


def resolve_rules(skeletons: DataFrame) -> DataFrame:
    """(skeleton, prose) -> its rule; one pass of Python over distinct skeletons only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            rules = [[{"a": a, "b": b} for a, b in packed.resolve(s.split(_SEP), p)] for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rules, kind)], names=["skeleton", "prose", "rule"])

    return skeletons.select("skeleton", "prose").distinct().mapInArrow(run, _RULE)


def split_packed(fields: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """fields (record_id, field, text, prose) -> (record_id, field, pos, value), positions from 1.

    Texts are cut into tokens, their skeletons resolved once per distinct skeleton, and the rules
    joined back: broadcast if the written rules are below broadcast_bytes, else hashed on the skeleton,
    where adaptive skew joins split a hot one. Nulls, blanks and words for none give no row; a lone
    value that says none gives none; equal rows count once; a text of any length is split whole.
    """
    scratch = Scratch(fields.sparkSession)
    cut = fields.where("text IS NOT NULL").select("record_id", "field", "text", "prose").distinct().withColumn("parts", tokens(F.col("text")))
    cut = scratch.cut(cut.select("record_id", "field", "prose", "parts", skeleton(F.col("parts")).alias("skeleton")).where("size(parts) > 0"))
    rules = scratch.cut(resolve_rules(cut))
    rules = F.broadcast(rules) if is_small(rules, broadcast_bytes) else rules
    whole = F.transform("rule", lambda r: F.array_join(F.slice("parts", r["a"] + 1, r["b"] - r["a"]), ""))
    unquoted = lambda v: F.regexp_replace(F.trim(v), r"""(?s)^(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|“([^”]*)”)$""", "$1$2$3")
    plain = lambda v: F.regexp_replace(F.regexp_replace(unquoted(v), r"\\u[0-9a-fA-F]{4}|\\[ntr]", " "), r"\\(.)", "$1")
    bare = F.transform(whole, lambda v: F.trim(plain(v)))
    none = (F.size("vals") == 1) & F.regexp_replace(F.lower(F.get("vals", F.lit(0))), "[^a-z]", "").isin(*packed.NONE_WORDS)
    return (
        cut.join(rules, ["skeleton", "prose"])
        .select("record_id", "field", bare.alias("vals"))
        .where(~none)
        .select("record_id", "field", F.posexplode("vals").alias("i", "value"))
        .select("record_id", "field", (F.col("i") + 1).alias("pos"), "value")
    )


def item_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
