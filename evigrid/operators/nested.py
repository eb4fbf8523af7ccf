"""Deeply nested semi-structured records as related flat tables (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.functions import nested
from evigrid.session import Scratch

OCCURRENCES = (
    "record_id {kind}, node string, step_path string, item_pos int, ordinal int, parent_path string, "
    "node_hash string, parent_hash string, body string"
)


def occurrences(lines: DataFrame, record_id: str, raw: str) -> DataFrame:
    """One row per occurrence of a trace, step, evidence or reasoning object in each readable line.

    Lines that are null or, apart from blanks or a byte-order mark, no JSON object give no row. Null or
    blank values and null steps give none but keep their position. A line of any length is parsed
    whole, in one task; batches hold whole lines. Rows of the same id and text count once.
    """
    kind = lines.schema[record_id].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (record := nested.record_of(text)) is None:
                    continue
                for row in nested.walk(record):
                    cols[0].append(key)
                    for c, v in zip(cols[1:], row):
                        c.append(v)
            types = [key_type, pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["record_id", "node", "step_path", "item_pos", "ordinal", "parent_path", "node_hash", "parent_hash", "body"],
            )

    pairs = lines.select(F.col(record_id).alias("record_id"), F.col(raw).alias("raw")).where("raw IS NOT NULL").distinct()
    return pairs.mapInArrow(run, OCCURRENCES.format(kind=kind))


def objects(found: DataFrame) -> DataFrame:
    """Every distinct object once: (node_hash, node, body, copies). Partial aggregation meets hot objects."""
    return found.groupBy("node_hash").agg(F.first("node").alias("node"), F.first("body").alias("body"), F.count("*").alias("copies"))


def bridge(found: DataFrame) -> DataFrame:
    """Every occurrence, without its body: the link from parent to child with place and ordinal."""
    return found.drop("body")


def flat_tables(lines: DataFrame, record_id: str, raw: str) -> dict[str, DataFrame]:
    """objects, bridge, traces, steps and items; the flat tables keep their parents' keys.

    The parsed occurrences are written once and read by all five.
    """
    found = Scratch(lines.sparkSession).cut(occurrences(lines, record_id, raw))
    links, bodies = bridge(found), found.select("record_id", "node", "step_path", "item_pos", "parent_path", "node_hash", "parent_hash", "body")
    field = lambda name: F.get_json_object("body", f"$.fields.{name}").alias(name)
    return {
        "objects": objects(found),
        "bridge": links,
        "traces": bodies.where("node = 'trace'").select("record_id", "node_hash", *map(field, ["task_id", "question", "goal", "model", "answer", "level"])),
        "steps": bodies.where("node = 'step'").select("record_id", "step_path", "parent_path", "node_hash", "parent_hash", *map(field, ["kind", "tool", "summary", "intention"])),
        "items": bodies.where("node IN ('evidence', 'reasoning')").select(
            "record_id", "step_path", "node", "item_pos", "node_hash", "parent_hash", F.coalesce(F.get_json_object("body", "$.value.text"), F.get_json_object("body", "$.value")).alias("value")
        ),
    }


def native_items(traces: DataFrame) -> DataFrame:
    """Evidence values of already typed traces: (trace_id, step_pos, item_pos, tool, value), blanks left out.

    Null step lists, steps, evidence lists and values keep their positions and give no row.
    """
    steps = traces.select("trace_id", F.posexplode("trace.steps").alias("s", "step"))
    return (
        steps.select("trace_id", (F.col("s") + 1).alias("step_pos"), F.col("step.tool").alias("tool"), F.posexplode("step.evidence").alias("i", "value"))
        .where("trim(value) <> ''")
        .select("trace_id", "step_pos", (F.col("i") + 1).alias("item_pos"), "tool", "value")
    )
