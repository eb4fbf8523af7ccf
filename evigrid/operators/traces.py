"""Traces as rows: flattening, sequences, enrichment, validation, resumed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evigrid.functions import text as T
from evigrid.session import Scratch


def ranked(steps: DataFrame, group: list[str], idx: str, step: str, width: int = 1000) -> DataFrame:
    """Adds pos, the rank of each step in its group by (idx, step), and size, the group's number of steps.

    A group of any size is cut into stretches of ``width`` index values: stretch counts are added up,
    and only the steps of one stretch are sorted together. Null indexes come first.
    """
    cut = steps.withColumn("_b", F.floor(F.coalesce(F.col(idx), F.lit(-1)) / width))
    counts = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    offsets = counts.select(*group, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("size"))
    within = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(idx, step))
    return cut.withColumn("_i", within).join(offsets, [*group, "_b"]).withColumn("pos", (F.col("_before") + F.col("_i")).cast("int")).drop("_b", "_i", "_before")


def sequence_edges(steps: DataFrame, group: list[str], idx: str, step: str) -> DataFrame:
    """Each step with its follower in its group: (group, src, dst), by a join of ranks."""
    r = ranked(steps.select(*group, idx, step), group, idx, step)
    return r.select(*group, "pos", F.col(step).alias("src")).join(r.select(*group, (F.col("pos") - 1).alias("pos"), F.col(step).alias("dst")), [*group, "pos"]).select(*group, "src", "dst")


def flow_ends(steps: DataFrame, group: list[str], order: str, step: str) -> DataFrame:
    """First and last step of each group, by two aggregates; ties by step."""
    key = F.struct(order, step)
    return steps.groupBy(*group).agg(F.min(key)[step].alias("first_step"), F.max(key)[step].alias("last_step"), F.count("*").alias("n_steps"))


def flatten_spans(spans: DataFrame) -> DataFrame:
    """Depth and pre-order path of each span of a parent-pointer tree: (trace_id, span_id, depth, path).

    Every span first points to its parent; each round replaces its pointer by that of the span it
    points to and joins the paths, so a tree of depth n takes log n rounds over all traces at once.
    Spans whose parent is unknown are roots of their trace; spans in a cycle, or below one, reach no
    root and do not appear. Siblings keep their pos, in nine digits; a larger or negative pos is an
    error, as its path would sort wrongly.
    """
    scratch = Scratch(spans.sparkSession)
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    known = spans.join(parents.withColumn("has_parent", F.lit(True)), ["trace_id", "parent_span_id"], "left")
    digits = F.when(F.col("pos").between(0, 999_999_999), F.lpad(F.col("pos").cast("string"), 9, "0")).when(F.col("pos").isNotNull(), F.raise_error(F.concat(F.lit("position out of range: "), F.col("pos").cast("string"))))
    base = scratch.cut(known.select("trace_id", "span_id", F.when(F.col("has_parent"), F.col("parent_span_id")).alias("up"), F.coalesce("has_parent", F.lit(False)).cast("int").alias("depth"), digits.alias("path")))
    done, open_ = base.where("up IS NULL"), base.where("up IS NOT NULL")
    finished = done
    while True:
        # those that a round's spans may point to: all that were open at its start, and all that were done
        targets = done.unionByName(open_).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"))
        step = open_.join(targets, ["trace_id", "up"]).select("trace_id", "span_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "before", "path").alias("path"))
        moved = scratch.cut(step)
        found = moved.where("up IS NULL")
        if found.isEmpty():  # what is still open hangs on a cycle
            return finished.select("trace_id", "span_id", "depth", "path")
        finished = finished.unionByName(found)
        done, open_ = finished, moved.where("up IS NOT NULL")


def enrich_gold(traces: DataFrame, gold: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Traces with their gold answer and whether theirs equals it or an accepted one, trimmed and without case.

    strict: a trace without gold is an error at run time; else its columns are null. Repeated gold
    keys count once (the smallest answer).
    """
    norm = lambda c: F.lower(F.trim(c))
    one = gold.select(key, "true_answer", F.explode_outer("accepted").alias("a")).groupBy(key).agg(F.min("true_answer").alias("true_answer"), F.collect_set("a").alias("accepted"))
    joined = traces.join(one, key, "left")
    if strict:
        joined = joined.withColumn("true_answer", F.when(F.col("true_answer").isNull(), F.raise_error(F.concat(F.lit("no gold for "), F.col(key)))).otherwise(F.col("true_answer")))
    same = (norm(F.col("answer")) == norm(F.col("true_answer"))) | F.exists("accepted", lambda a: norm(a) == norm(F.col("answer")))
    return joined.withColumn("answer_correct", F.coalesce(same, F.lit(False)))


def enrich_pages(traces: DataFrame, pages: DataFrame) -> DataFrame:
    """traces (trace_id, source_url, step_pos, kind, evidence) with title and heading of the page added to the first browse step's evidence, once each."""
    page = pages.groupBy("url").agg(F.min("html").alias("html")).select(F.col("url").alias("source_url"), F.array_compact(F.array(T.element(F.col("html"), "title"), T.element(F.col("html"), "h1"))).alias("extra"))
    first = traces.where("kind = 'browse'").groupBy("trace_id").agg(F.min("step_pos").alias("browse_pos"))
    out = traces.join(first, "trace_id", "left").join(page, "source_url", "left")
    hit = (F.col("step_pos") == F.col("browse_pos")) & F.col("extra").isNotNull()
    return out.withColumn("evidence", F.when(hit, F.array_union(F.coalesce("evidence", F.array().cast("array<string>")), "extra")).otherwise(F.col("evidence"))).drop("browse_pos", "extra")


#: Origins of a provenance, and groups of steps.
ORIGINS, GROUPS = ("explicit", "inferred", "annotator"), ("annotator", "agent:plan", "agent:exec")


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _provenance_rules(p: str) -> list[tuple[str, str, Column]]:
    p = F.col(p)
    return [
        ("error", "no_provenance", p.isNull()), ("error", "unknown_origin", p.isNotNull() & ~F.coalesce(p["origin"].isin(*ORIGINS), F.lit(False))),
        ("error", "no_source_evidence", p.isNotNull() & _empty(p["sourceEvidence"])), ("error", "confidence_out_of_range", p.isNotNull() & ~F.coalesce(p["confidence"].between(0, 1), F.lit(False))),
    ]


def _broken(rules: list[tuple[str, str, Column]]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules])))


def validate_steps(steps: DataFrame) -> DataFrame:
    """(trace_id, step_id, severity, rule) for each broken rule of a step table; distinct."""
    rules = [
        ("error", "empty_step_id", _empty(F.col("step_id"))), ("error", "empty_description", _empty(F.col("description"))), ("error", "unknown_group", ~F.coalesce(F.col("grp").isin(*GROUPS),
        F.lit(False))),
        ("error", "index_below_one", F.coalesce(F.col("idx") < 1, F.lit(True))), ("error", "confidence_out_of_range", F.coalesce(~F.col("provenance.confidence").between(0, 1), F.lit(False))),
        ("warning", "no_span", F.col("span_id").isNull()),
    ]
    return steps.select("trace_id", "step_id", _broken(rules).alias("b")).select("trace_id", "step_id", "b.severity", "b.rule").distinct()


def validate_records(steps: DataFrame, edges: DataFrame, goals: DataFrame | None = None, flows: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """(trace_id, part, ref_id, severity, rule) for each broken rule of plan records, over all traces at once; distinct.

    steps: trace_id, step_id, grp, idx, description, tools, provenance; edges: trace_id, id, src, dst,
    provenance. Step ids must be unique within a trace, and edges end at steps of their trace (or at
    goal and final_answer). goals (trace_id, id, description, task_id, provenance, verified,
    duration, answer): one row per record, whose traces without steps get a warning. flows (trace_id,
    id, src, dst, description, provenance) and flags (trace_id, id, step_id, description,
    provenance) are checked alike where given. Referential rules are hash joins on (trace, step).
    """

    def tell(rows: DataFrame, part: str, ref: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
        return rows.select("trace_id", F.lit(part).alias("part"), ref.alias("ref_id"), _broken(rules).alias("b")).select("trace_id", "part", "ref_id", "b.severity", "b.rule")

    step_rules = [
        ("error", "no_id", F.col("step_id").isNull()), ("error", "unknown_group", ~F.coalesce(F.col("grp").isin(*GROUPS), F.lit(False))), ("error", "index_below_one", F.coalesce(F.col("idx") < 1,
        F.lit(True))),
        ("error", "empty_description", _empty(F.col("description"))), ("error", "no_tools", F.col("tools").isNull()), *_provenance_rules("provenance"),
    ]
    out = tell(steps, "step", F.col("step_id"), step_rules)
    twice = steps.where("step_id IS NOT NULL").groupBy("trace_id", "step_id").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(twice.select("trace_id", F.lit("step").alias("part"), F.col("step_id").alias("ref_id"), F.lit("error").alias("severity"), F.lit("duplicate_id").alias("rule")))
    known = steps.where("step_id IS NOT NULL").select("trace_id", "step_id").distinct()

    def refer(rows: DataFrame, part: str, column: str, rule: str, outer: str | None) -> DataFrame:
        ends = rows.select("trace_id", F.col("id").alias("ref_id"), F.col(column).alias("step_id"))
        ends = ends.where(F.coalesce(F.col("step_id") != outer, F.lit(True))) if outer else ends.where("step_id IS NOT NULL")
        return ends.join(known, ["trace_id", "step_id"], "left_anti").select("trace_id", F.lit(part).alias("part"), "ref_id", F.lit("error").alias("severity"), F.lit(rule).alias("rule"))

    out = out.unionByName(tell(edges, "edge", F.col("id"), _provenance_rules("provenance"))).unionByName(refer(edges, "edge", "src", "unknown_from", "goal")).unionByName(refer(edges, "edge", "dst", "unknown_to", "final_answer"))
    if flows is not None:
        rules = [("error", "empty_description", _empty(F.col("description"))), *_provenance_rules("provenance")]
        out = out.unionByName(tell(flows, "flow", F.col("id"), rules)).unionByName(refer(flows, "flow", "src", "unknown_from", "goal")).unionByName(refer(flows, "flow", "dst", "unknown_to", "final_answer"))
    if flags is not None:
        rules = [("error", "empty_description", _empty(F.col("description"))), *_provenance_rules("provenance")]
        out = out.unionByName(tell(flags, "flag", F.col("id"), rules)).unionByName(refer(flags, "flag", "step_id", "unknown_step", None))
    if goals is not None:
        rules = [
            ("error", "empty_id", _empty(F.col("id"))), ("error", "empty_description", _empty(F.col("description"))), ("error", "empty_task", _empty(F.col("task_id"))),
            *_provenance_rules("provenance"),
            ("error", "verified_unknown", F.col("verified").isNull()), ("error", "no_duration", F.col("duration").isNull()), ("warning", "duration_zero", F.coalesce(F.col("duration") == 0,
            F.lit(False))), ("error", "no_answer", F.col("answer").isNull()),
        ]
        bare = goals.join(steps.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit("record").alias("part"), F.col("id").alias("ref_id"), F.lit("warning").alias("severity"), F.lit("no_steps").alias("rule"))
        out = out.unionByName(tell(goals, "goal", F.col("id"), rules)).unionByName(bare)
    return out.distinct()


def only_new(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks: what a resumed append writes. Null keys are always new."""
    return rows.join(written.select(key).distinct(), key, "left_anti")
