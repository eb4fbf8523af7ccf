"""Duplicates hidden by formatting differences (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.canonical import LABELS, canonical
from evigrid.session import Scratch


def raw_groups(rows: DataFrame, record_id: str, text: str) -> DataFrame:
    """Byte-identical texts collapsed: (text, n_ids, first_id). Repeats of (id, text) count once.

    Both aggregations combine on the map side, so a text that holds a third of all rows reaches its
    reducer as one row per map task.
    """
    pairs = rows.select(F.col(record_id).alias("record_id"), F.col(text).alias("text")).where("record_id IS NOT NULL AND text IS NOT NULL").distinct()
    return pairs.groupBy("text").agg(F.count("*").alias("n_ids"), F.min("record_id").alias("first_id"))


def with_content(texts: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Adds content and fields (see canonical) to distinct texts; whole texts, one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [canonical(t, labels) for t in batch.column("text").to_pylist()]
            cols = [*batch.columns, pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "content", "fields"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, shape + ", content string, fields string")


def classes(rows: DataFrame, record_id: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Every distinct raw text with its class: (text, n_ids, first_id, class_key, class_first_id, class_ids).

    Raw texts are collapsed first, only distinct survivors are made canonical, and these are grouped
    on their full content. A content is then replaced by its labelled fields in canonical order, if
    one of its texts shows them, so that reordered fields meet. Texts without letters or digits have
    no content and stand alone. class_first_id is the smallest id, class_ids sums the counts of the
    raw groups (an id with two texts of one class counts for each).
    """
    own = Scratch(rows.sparkSession).cut(with_content(raw_groups(rows, record_id, text), labels).where("content IS NOT NULL"))
    by_content = own.groupBy("content").agg(F.max("fields").alias("f"), F.sum("n_ids").alias("n"), F.min("first_id").alias("first"))
    keyed = by_content.select("content", "n", "first", F.coalesce(F.concat(F.lit("f:"), "f"), F.concat(F.lit("t:"), "content")).alias("class_key"))
    by_class = keyed.groupBy("class_key").agg(F.sum("n").alias("class_ids"), F.min("first").alias("class_first_id"))
    of_content = keyed.select("content", "class_key").join(by_class, "class_key")
    return own.select("text", "n_ids", "first_id", "content").join(of_content, "content").drop("content")


def collapsed(rows: DataFrame, record_id: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Each distinct content once: (first_id, question, n_ids, n_raw); question is the raw text of the smallest id."""
    return (
        classes(rows, record_id, text, labels)
        .groupBy("class_key", "class_first_id", "class_ids")
        .agg(F.min_by("text", F.struct("first_id", "text")).alias("question"), F.count("*").alias("n_raw"))
        .select(F.col("class_first_id").alias("first_id"), "question", F.col("class_ids").alias("n_ids"), "n_raw")
    )


def copies(rows: DataFrame, record_id: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(first_id, copy_id): one row per id of a class other than its smallest.

    Membership comes back by a join of the rows with distinct texts of classes of two or more; the
    texts are unique there, and adaptive skew joins split a hot one.
    """
    many = classes(rows, record_id, text, labels).where("class_ids > 1").select("text", "class_first_id")
    ids = rows.select(F.col(record_id).alias("copy_id"), F.col(text).alias("text")).where("copy_id IS NOT NULL AND text IS NOT NULL")
    return ids.join(many, "text").where("copy_id <> class_first_id").select(F.col("class_first_id").alias("first_id"), "copy_id").distinct()
