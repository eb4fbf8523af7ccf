"""Writers: JSON lines, resumed appends, numbered blocks, text and markdown reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evigrid.session import Scratch


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_report(df: DataFrame, path: str) -> None:
    """One pretty JSON document of a report of one row, as one text file; more rows are an error."""
    row = df.limit(2).toJSON().collect()
    if len(row) != 1:
        raise ValueError(f"a report of {len(row)} rows")
    text = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the target lacks, and returns how many; a missing target is an empty one. Repeated keys count once."""
    spark = df.sparkSession
    rows = df.dropDuplicates([key])
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    new = Scratch(spark).cut(rows)
    new.write.mode("append").parquet(path)
    return new.count()


def append_unique(df: DataFrame, path: str, key: str) -> None:
    """Appends all rows, or none: a key that the target has, or that repeats among the rows, is an error that names it."""
    spark = df.sparkSession
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if _exists(spark, path):
        twice = twice.unionByName(df.select(key).join(spark.read.parquet(path).select(key).distinct(), key, "left_semi"))
    if (row := twice.head()) is not None:
        raise ValueError(f"{key} {row[0]!r} is there already")
    df.write.mode("append").parquet(path)


#: Roles of a judge, and what an absent field of a run becomes.
ROLES = ("critic", "synthesizer", "generator")
DEFAULTS = {"domain": "general", "material_count": 0, "notable_count": 0, "minor_count": 0}
NEEDED = ("block_id", "model", "role", "score_given", "verdict", "recorded_at")


def with_run_defaults(runs: DataFrame) -> DataFrame:
    """Judge runs as they are stored: absent fields get their defaults; a run without a needed field, or of an unknown role, is an error at run time."""
    for name, value in DEFAULTS.items():
        runs = runs.withColumn(name, F.coalesce(name, F.lit(value)))
    for name in NEEDED:
        runs = runs.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a run has no {name}"))).otherwise(F.col(name)))
    return runs.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("unknown role "), "role"))))


def with_block_ids(df: DataFrame, last: int, width: int = 3, order: str = "question") -> DataFrame:
    """Adds ids PoT-<number> that follow ``last``, by rank in a range-partitioned order.

    Numbers come from per-partition counts and their running sum, not from one global window: rows are
    sorted by range, written, counted per partition, and numbered within it.
    """
    scratch = Scratch(df.sparkSession)
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    # written once: ids must come from the partitions that were counted
    placed = scratch.cut(ranged.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_start")
    number = F.col("_start") + F.col("_i") + 1 + last
    text = number.cast("string")
    numbered = placed.join(F.broadcast(before), "_p")  # one row per written partition
    return numbered.withColumn("id", F.concat(F.lit("PoT-"), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))).drop("_at", "_p", "_i", "_start")


def key_value_report(df: DataFrame) -> Column:
    """One text line per column, for one-row summaries."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A markdown table of a report of at most ``limit`` rows; more rows are an error, as a report is no export."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])
