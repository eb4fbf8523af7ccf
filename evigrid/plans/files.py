"""Queries that write the test tables in the formats of the readers and read them again, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.operators import records as R, scan
from evigrid.plans.reference_sql import TRACES
from evigrid.session import shared_dir, table
from evigrid.sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    """A new place in the shared folder; it goes with the driver."""
    path = f"{shared_dir(spark)}/evigrid-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_traces(table(spark, d, "gaia_traces"))


def read_jsonl(spark, d):
    """Traces as JSON lines, with blank lines between some."""
    path = f"{_folder(spark)}/t"
    rows = _traces(spark, d).select(F.to_json(F.struct("task_id", "level", "question", "model", "answer", "ground_truth", "final_correct", "trace")).alias("value"))
    rows.unionByName(spark.range(3).select(F.lit("").alias("value"))).write.text(path)
    return readers.jsonl(spark, path, readers.TRACE).select("task_id", "level", "model", "answer", F.coalesce(F.size("trace.steps"), F.lit(-1)).alias("n_steps"), F.get("trace.steps", F.lit(0))["summary"].alias("first"))


def read_json_documents(spark, d):
    """Samples as one array in one document."""
    path = f"{_folder(spark)}/d"
    rows = table(spark, d, "gaia_samples").select("task_id", "level", "final_answer").distinct()
    rows.agg(F.to_json(F.collect_list(F.struct("task_id", "level", "final_answer"))).alias("value")).write.text(path)
    return readers.json_documents(spark, path, "task_id STRING, level STRING, final_answer STRING")


def read_samples(spark, d):
    """Samples under the aliases of their keys."""
    path = f"{_folder(spark)}/s"
    odd = F.pmod(F.length("question"), F.lit(2)) == 1
    rows = table(spark, d, "gaia_samples").groupBy("task_id").agg(F.max(F.struct("question", "level", "final_answer", "file_path")).alias("r")).select("task_id", "r.*")
    objects = rows.select(F.when(odd, F.to_json(F.struct("task_id", F.col("question").alias("Question"), F.col("level").alias("Level"), F.col("final_answer").alias("Final answer"), "file_path"))).otherwise(F.to_json(F.struct("task_id", "question", "level", F.col("final_answer").alias("ground_truth")))).alias("j"))
    objects.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(path)
    return readers.samples(spark, path).select("task_id", "question", "level", "final_answer", "file_path")


def read_gold_map(spark, d):
    """Truths keyed by task, in both spellings."""
    path = f"{_folder(spark)}/g"
    gold = table(spark, d, "gaia_traces").where("ground_truth IS NOT NULL").groupBy("task_id").agg(F.min("ground_truth").alias("t"))
    entry = F.when(F.pmod(F.length("t"), F.lit(2)) == 1, F.to_json(F.struct(F.col("t").alias("true_answer"), F.array("t", F.lit("x")).alias("accepted_answers")))).otherwise(F.to_json(F.struct(F.col("t").alias("ground_truth"))))
    pairs = gold.select(F.concat(F.lit('"'), "task_id", F.lit('":'), entry).alias("p"))
    pairs.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("p"), ","), F.lit("}")).alias("value")).write.text(path)
    return readers.gold_map(spark, path).select("task_id", "true_answer", F.array_join("accepted", ",").alias("accepted"))


def read_source_claims(spark, d):
    """Source claims keyed by trace; every third entry lacks its confidence."""
    path = f"{_folder(spark)}/c"
    rows = _traces(spark, d).select("trace_id", F.pmod(F.length("question"), F.lit(3)).alias("k"))
    entry = F.to_json(F.struct(F.lit("exact").alias("support"), F.when(F.col("k") > 0, "high").alias("confidence"), F.when(F.col("k") == 1, F.lit(True)).alias("exactStringQuestion")))
    rows.select(F.concat(F.lit('"'), "trace_id", F.lit('":'), entry).alias("p")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list("p"), ","), F.lit("}")).alias("value")).write.text(path)
    return readers.source_claims(spark, path).select("trace_id", "support", "confidence", "exact_question")


def line_range(spark, d):
    """Lines two to four of every document."""
    return scan.line_range(scan.lines_of(table(spark, d, "documents"), "doc_id", "text"), 2, 4)


def append_resumed(spark, d):
    """Traces appended twice, first in part: each is there once."""
    path = f"{_folder(spark)}/a"
    t = _traces(spark, d).select("trace_id", "task_id", "answer")
    sinks.append_new(t.where(F.pmod(F.crc32("trace_id"), F.lit(2)) == 1), path, "trace_id")
    sinks.append_new(t, path, "trace_id")
    return spark.read.parquet(path)


def numbered_blocks(spark, d):
    """Blocks numbered on from the 998th in the order of their ids."""
    return sinks.with_block_ids(table(spark, d, "blocks").select(F.col("id").alias("old_id")).distinct(), 998, order="old_id")


def stored_runs(spark, d):
    """Judge runs as they are stored, those without a score left out."""
    runs = table(spark, d, "judge_runs").where("score_given IS NOT NULL AND verdict IS NOT NULL").distinct().withColumn("domain", F.nullif("domain", F.lit("code")))
    return sinks.with_run_defaults(runs).groupBy("role", "domain").agg(F.count("*").alias("n"), F.sum("material_count").alias("material"))


QUERIES = {f.__name__: f for f in (read_jsonl, read_json_documents, read_samples, read_gold_map, read_source_claims, line_range, append_resumed, numbered_blocks, stored_runs)}

ORACLE = {
    "read_jsonl": "WITH " + TRACES + " SELECT task_id, level, model, answer, CAST(coalesce(len(trace.steps), -1) AS INT) AS n_steps, trace.steps[1].summary AS first FROM lt",
    "read_json_documents": "SELECT DISTINCT task_id, level, final_answer FROM gaia_samples",
    "read_samples": """SELECT task_id, r.q AS question, r.l AS level, r.f AS final_answer, CASE WHEN length(r.q) % 2 = 1 THEN r.p END AS file_path FROM (SELECT task_id,
  max({'q': question, 'l': level, 'f': final_answer, 'p': file_path}) AS r FROM gaia_samples GROUP BY 1)""",
    "read_gold_map": "SELECT task_id, t AS true_answer, CASE WHEN length(t) % 2 = 1 THEN t || ',x' END AS accepted FROM (SELECT task_id, min(ground_truth) AS t FROM gaia_traces WHERE ground_truth IS NOT NULL GROUP BY 1)",
    "read_source_claims": "WITH " + TRACES + " SELECT trace_id, 'exact' AS support, 'high' AS confidence, length(question) % 3 = 1 AS exact_question FROM lt WHERE length(question) % 3 > 0",
    "line_range": "SELECT doc_id AS file, CAST(i AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(2, least(len(l), 4) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "append_resumed": "WITH " + TRACES + " SELECT trace_id, task_id, answer FROM lt",
    "numbered_blocks": "SELECT id AS old_id, 'PoT-' || lpad((998 + n)::VARCHAR, greatest(3, length((998 + n)::VARCHAR))::INT, '0') AS id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM blocks WHERE id IS NOT NULL))",
    "stored_runs": "SELECT role, CASE WHEN domain = 'code' THEN 'general' ELSE domain END AS domain, count(*) AS n, sum(coalesce(material_count, 0))::BIGINT AS material FROM (SELECT DISTINCT * FROM judge_runs WHERE score_given IS NOT NULL AND verdict IS NOT NULL) GROUP BY 1, 2",
}
