"""Pattern scans over lines of text, with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Severities from high to low.
SEVERITIES = ("critical", "high", "medium", "low")
#: Calls that run what they are given, as (pattern, label, severity, language, weakness).
DANGERS = (
    (r"\bexec\s*\(", "exec", "critical", "python", "CWE-94"), (r"\beval\s*\(", "eval", "critical", "python", "CWE-94"),
    (r"subprocess\.(Popen|run|call|check_output)\s*\(", "subprocess", "critical", "python", "CWE-78"), (r"os\.(system|popen|exec[lv]?p?e?)\s*\(", "os.system", "critical", "python", "CWE-78"),
    (r"importlib\.(import_module|util\.module_from_spec)", "importlib", "high", "python", "CWE-829"), (r"exec_module\s*\(", "exec_module", "high", "python", "CWE-829"),
    (r"pickle\.loads?\s*\(", "pickle", "critical", "python", "CWE-502"), (r"yaml\.load\s*\((?!.*Loader)", "yaml.load", "high", "python", "CWE-502"),
    (r"child_process\.(exec|spawn|execFile|fork)\s*\(", "child_process", "critical", "javascript", "CWE-78"), (r"new Function\s*\(", "new Function", "critical", "javascript", "CWE-94"),
    (r"vm\.runIn(New|This)Context\s*\(", "vm.runInContext", "high", "javascript", "CWE-94"),
)
#: Marks of a bypass, of a sandbox and of a guard.
BYPASS = r"(?i)BYPASS|NON_INTERACTIVE|DISABLE_SAFETY|SKIP_CONFIRM|AUTO_APPROVE|TRUST_REMOTE|UNSAFE"
SANDBOX = r"(?i)\bsandbox\b|\bcontainer\b|\bjail\b|\bseccomp\b|\bchroot\b|\bAppArmor\b|\bSELinux\b|\bWASM\b|\bQuickJS\b|\bisolated_process\b|\bsecure_sandbox\b|\bsandboxed\b|\bvm\.runIn\b"
GUARD = r"\binput\s*\(|\bconfirm\s*\(|\bprompt\s*\(|\bapprove\s*\(|\bgetpass\s*\(|(?i:\bconsent\b|\bask_user\b|\bconfirmation\b)"
#: Lines around a finding in which guards and sandboxes count, and scores by status.
REACH = 20
SCORES = {"sandbox": 3.0, "unguarded": 9.1, "guarded-but-bypassable": 8.4, "guarded": 5.5}


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of each file, both counted."""
    return lines.where(F.col("line_no").between(first, last))


def findings(lines: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """(file, line_no, label, severity, line) for every pattern (regex, label, severity) that a line holds.

    The patterns are a stated list, so each line is tested in one pass in its own row; no join is needed.
    """
    tests = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(label).alias("label"), F.lit(sev).alias("severity"))) for p, label, sev in patterns]))
    return lines.select("file", "line_no", "line", F.explode(tests).alias("f")).select("file", "line_no", "f.label", "f.severity", "line")


def guard_context(lines: DataFrame, flag: str, reach: int = 20) -> DataFrame:
    """Per line, whether a line within ``reach`` of it in its file holds the guard pattern, and the file's first such line."""
    near = Window.partitionBy("file").orderBy("line_no").rowsBetween(-reach, reach)
    hit = F.col("line").rlike(flag)
    first = lines.where(hit).groupBy("file").agg(F.min("line_no").alias("first_guard"))
    return lines.withColumn("guarded", F.max(hit.cast("int")).over(near) == 1).join(first, "file", "left").select("file", "line_no", "guarded", "first_guard")


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def attest(found: DataFrame, subject: str, parts: list[str]) -> DataFrame:
    """(subject, digest, short_id): sha-256 over a subject's findings in order; findings of a subject are few by nature of a scan report."""
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *parts))), "\n")
    return found.groupBy(subject).agg(F.sha2(F.concat_ws("\n", F.first(F.col(subject).cast("string")), body), 256).alias("digest")).withColumn("short_id", F.left("digest", F.lit(16)))


def language_of(file: Column) -> Column:
    """python or javascript, by the file's extension; null for other files."""
    low = F.lower(file)
    return F.when(low.endswith(".py"), "python").when(low.rlike(r"\.(ts|js)$"), "javascript")


def audit(lines: DataFrame, file_language: Column, dangers: tuple = DANGERS, reach: int = REACH) -> DataFrame:
    """(file, line_no, label, severity, weakness, guard_status, bypass_line, has_sandbox, score) for every dangerous call.

    lines: file, line_no, line. Patterns of the file's language are tried per line, within its row.
    Guards and sandboxes count within ``reach`` lines, a bypass anywhere in the file: its first line
    is named. Context is joined only for files with findings, through the few lines that hold a mark:
    a finding meets the marks of its neighbourhood by stretches of 2 * reach + 1 lines, so no file is
    sorted in one task.
    """
    wide = 2 * reach + 1
    tests = F.array_compact(F.array(*[
        F.when((file_language == lang) & F.col("line").rlike(p), F.struct(F.lit(label).alias("label"), F.lit(sev).alias("severity"), F.lit(cwe).alias("weakness"))) for p, label, sev, lang, cwe in dangers
    ]))
    found = lines.select("file", "line_no", F.explode(tests).alias("f")).select("file", "line_no", "f.*")
    marks = lines.select("file", "line_no", F.col("line").rlike(BYPASS).alias("bypass"), F.col("line").rlike(SANDBOX).alias("sandbox"), F.col("line").rlike(GUARD).alias("guard")).where("bypass OR sandbox OR guard")
    first = marks.where("bypass").groupBy("file").agg(F.min("line_no").alias("bypass_line"))
    stretch = F.floor(F.col("line_no") / wide)
    around = found.select("file", "line_no", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("s")).distinct()
    near = around.join(marks.where("sandbox OR guard").select("file", F.col("line_no").alias("at"), "sandbox", "guard", F.floor(F.col("line_no") / wide).alias("s")), ["file", "s"]).where(F.abs(F.col("at") - F.col("line_no")) <= reach)
    context = near.groupBy("file", "line_no").agg(F.bool_or("sandbox").alias("has_sandbox"), F.bool_or("guard").alias("has_guard"))
    out = found.join(context, ["file", "line_no"], "left").join(first, "file", "left").fillna(False, ["has_sandbox", "has_guard"])
    status = F.when(F.col("bypass_line").isNotNull(), "guarded-but-bypassable").when(F.col("has_guard"), "guarded").otherwise("unguarded")
    score = F.when(F.col("has_sandbox"), SCORES["sandbox"])
    for name in ("unguarded", "guarded-but-bypassable", "guarded"):
        score = score.when(F.col("guard_status") == name, SCORES[name])
    return out.withColumn("guard_status", status).withColumn("score", score).select("file", "line_no", "label", "severity", "weakness", "guard_status", "bypass_line", "has_sandbox", "score")


def severity_rank(severity: Column) -> Column:
    """0 for the highest severity; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) - 1, F.lit(len(SEVERITIES))).cast("int")


def ranked_findings(found: DataFrame) -> DataFrame:
    """Findings in report order: by severity, file and line."""
    return found.orderBy(severity_rank(F.col("severity")), "file", "line_no", "label")


def highest_severity(found: DataFrame, by: str) -> DataFrame:
    """(by, severity): the highest severity among each subject's findings."""
    return found.groupBy(by).agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"))
