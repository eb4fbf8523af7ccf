"""Readers of the record shapes that the operators take; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRACE = (
    "task_id STRING, level STRING, question STRING, model STRING, answer STRING, ground_truth STRING, final_correct BOOLEAN, attachments ARRAY<STRUCT<path: STRING, kind: STRING>>, "
    "annotator_metadata MAP<STRING, STRING>, trace STRUCT<steps: ARRAY<STRUCT<index: INT, kind: STRING, tool: STRING, summary: STRING, evidence: ARRAY<STRING>>>, notes: STRING>"
)
GOLD = "MAP<STRING, STRUCT<trace_id: STRING, ground_truth: STRING, true_answer: STRING, annotator_steps: ARRAY<STRING>, annotator_tools: ARRAY<STRING>, accepted_answers: ARRAY<STRING>>>"
CLAIMS = "MAP<STRING, STRUCT<support: STRING, confidence: STRING, exactStringQuestion: BOOLEAN, explanation: STRING, matchedSpan: STRING>>"
BUNDLE = (
    "id STRING, title STRING, sourceType STRING, candidateObjectType STRING, candidateObjectRef STRING, expectedVerdict STRING, referenceSteps ARRAY<STRING>, criticalSteps ARRAY<STRING>, sourceArtifacts STRING"
)


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record per line, blank lines skipped; strict: a bad line is an error, else it is dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_map(spark: SparkSession, path: str, value_map: str, key: str) -> DataFrame:
    """An object keyed by id as rows: (key, the value's fields)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", value_map)).alias(key, "v")).select(key, "v.*")


def gold_map(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, true_answer, accepted, annotator_steps): both spellings of the answer; entries with neither are an error."""
    rows = keyed_map(spark, path, GOLD, "task_id")
    answer = F.coalesce("true_answer", "ground_truth")
    return rows.select("task_id", F.when(answer.isNull(), F.raise_error(F.concat(F.lit("no answer for "), F.col("task_id")))).otherwise(answer).alias("true_answer"), F.col("accepted_answers").alias("accepted"), "annotator_steps", "annotator_tools")


def source_claims(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, support, confidence, exact_question, explanation); entries without support or confidence are left out."""
    rows = keyed_map(spark, path, CLAIMS, "trace_id").where("support IS NOT NULL AND confidence IS NOT NULL")
    return rows.select("trace_id", "support", "confidence", F.coalesce("exactStringQuestion", F.lit(False)).alias("exact_question"), "explanation", "matchedSpan")


def blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Block files (PoT-*.json) of a folder with their file names, unreadable ones dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "PoT-*.json").json(path, mode="DROPMALFORMED").withColumn("file_name", F.col("_metadata.file_name"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Task samples with aliased keys as (task_id, question, level, final_answer, file_path, annotator_metadata).

    Keys differ by case, so objects are read as maps. A sample without id or question is an error.
    """
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "ARRAY<MAP<STRING, STRING>>")).alias("m"))
    first = lambda *keys: F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in keys])
    needed = lambda c, what: F.when(c.isNull(), F.raise_error(F.lit(f"a sample has no {what}"))).otherwise(c)
    return objects.select(
        needed(first("task_id"), "task_id").alias("task_id"), needed(first("question", "Question"), "question").alias("question"), first("level", "Level").alias("level"),
        first("Final answer", "Final_answer", "final_answer", "ground_truth").alias("final_answer"), first("file_path").alias("file_path"),
        F.from_json(first("Annotator Metadata", "Annotator_Metadata", "annotator_metadata"), "MAP<STRING, STRING>").alias("annotator_metadata"),
    )


def source_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("py", "ts", "js"), max_bytes: int = 1 << 20, ignored: tuple[str, ...] = ("node_modules", ".git", "dist", "build")) -> DataFrame:
    """Text files below a folder: (file, text); size, extension and folder filters reach the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = F.col("path").rlike(rf"\.({'|'.join(extensions)})$") & ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")/")
    return files.where(keep & (F.col("length") <= max_bytes)).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def sniff(spark: SparkSession, path: str) -> str:
    """``jsonl``, ``traces`` or ``records``, from a file's name and its first record; an error for anything else."""
    if path.endswith(".jsonl"):
        return "jsonl"
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 65536).alias("v")).head()
    first = (head[0] if head else "").lstrip()
    if first.replace(" ", "").replace("\n", "") in ("[]",):
        return "records"
    if first.startswith("[") and '"trace"' in first:
        return "traces"
    if first.startswith("[") and '"traceId"' in first:
        return "records"
    raise ValueError(f"unknown record shape in {path}")
