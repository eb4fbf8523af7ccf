"""Queries of the general training-data problems (2, 3, 4) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.operators import nested, orphans, packed
from evigrid.plans import nested_sql
from evigrid.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.plan_orphans(table(spark, d, "plan_steps"), table(spark, d, "plan_edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    direct = _orphans(spark, d).where("kind = 'direct'")
    return direct.select(F.col("group_id").alias("trace_id"), F.col("record_id").alias("edge_id"), "side", "reason").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d), "plan_edges")


def p2_direct_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's direct part alone, which SQL can state."""
    return p2_report(spark, d).where("kind = 'direct'")


def p2_report_dangling(spark: SparkSession, d: str) -> DataFrame:
    """References of the other tables: their foreign keys, counted per table, reason and month."""
    keys = {
        "proposals": ("block_id", "blocks", "id", "loaded_at", "loaded_at"),
        "judge_runs": ("block_id", "blocks", "id", "ingested_at", "loaded_at"),
        "quote_reports": ("trace_id", "gaia_traces", "trace_id", "reported_at", "loaded_at"),
    }
    out = None
    for child, (ref, parent, key, at, loaded) in keys.items():
        states = orphans.key_states(table(spark, d, parent), [key], loaded).select(F.lit("").alias("group_id"), F.col(key).alias("key"), "first_seen", "is_deleted")
        rows = table(spark, d, child).distinct().select(F.lit("").alias("group_id"), F.lit("").alias("record_id"), F.lit(ref).alias("side"), F.col(ref).alias("key"), F.col(at).alias("loaded_at"))
        bad = orphans.direct_orphans(rows.where("key IS NOT NULL"), states)
        part = bad.groupBy(F.lit(child).alias("tab"), "reason", F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("refs"))
        out = part if out is None else out.unionByName(part)
    return out


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of blocks, proposals, judge runs, quote reports and plan edges, through all of them."""
    step = lambda c: F.concat("trace_id", F.lit("/"), c)
    read = lambda t, key, at, *refs: table(spark, d, t).select(key.alias("key"), F.col(at).alias("loaded_at"), *refs)
    tables = {
        "blocks": read("blocks", F.col("id"), "loaded_at", "context_refs"),
        "proposals": read("proposals", F.concat_ws("/", "block_id", "pos", "model"), "loaded_at", "block_id"),
        "judge_runs": read("judge_runs", F.col("id"), "ingested_at", "block_id"),
        "gaia_traces": read("gaia_traces", F.col("trace_id"), "loaded_at"),
        "quote_reports": read("quote_reports", F.col("report_id"), "reported_at", "trace_id"),
        "plan_steps": read("plan_steps", step("step_id"), "loaded_at", F.col("deleted").alias("is_deleted")),
        "plan_edges": read("plan_edges", step("id"), "loaded_at", step("src").alias("src"), step("dst").alias("dst")),
    }
    references = [("plan_edges", "src", "plan_steps"), ("plan_edges", "dst", "plan_steps"), ("blocks", "context_refs", "blocks"), ("proposals", "block_id", "blocks"), ("judge_runs", "block_id", "blocks"), ("quote_reports", "trace_id", "gaia_traces")]
    return orphans.graph_orphans(tables, references)


def p2_graph_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, reference, reason and month."""
    found = _graph(spark, d).select("tab", "record_id", "side", "key", "kind", "reason", F.date_format("loaded_at", "yyyy-MM").alias("month")).distinct()
    return found.groupBy("tab", "side", "kind", "reason", "month").agg(F.count("*").alias("refs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = nested.bridge(nested.occurrences(table(spark, d, "trace_lines"), "line_id", "raw"))
    return links.where("node <> 'trace'").select(F.col("record_id").alias("line_id"), "node", "step_path", "item_pos").distinct()


def _flat(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_tables(table(spark, d, "trace_lines"), "line_id", "raw")[name]

    return query


def p3_native_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.native_items(table(spark, d, "gaia_traces")).select("trace_id", "step_pos", "item_pos", "value").distinct()


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and reasoning of the lines that are texts, with their place."""
    items = nested.flat_tables(table(spark, d, "trace_lines"), "line_id", "raw")["items"]
    return items.select(F.col("record_id").alias("line_id"), "node", "step_path", "item_pos", "value").distinct()


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the lines with its parent; top steps have the empty path for one."""
    steps = nested.flat_tables(table(spark, d, "trace_lines"), "line_id", "raw")["steps"]
    return steps.select(F.col("record_id").alias("line_id"), "step_path", "parent_path", "tool", "kind").distinct()


def _native(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The typed traces through the same operator as the lines."""
    rows = table(spark, d, "gaia_traces").select("trace_id", F.to_json(F.struct("task_id", "question", "model", "answer", "level", "trace")).alias("raw"))
    return nested.flat_tables(rows, "trace_id", "raw")[name].withColumnRenamed("record_id", "trace_id")


def p3_native_traces(spark: SparkSession, d: str) -> DataFrame:
    return _native(spark, d, "traces").select("trace_id", "task_id", "question", "model", "answer", "level").distinct()


def p3_native_steps(spark: SparkSession, d: str) -> DataFrame:
    return _native(spark, d, "steps").select("trace_id", "step_path", "kind", "tool", "summary").distinct()


def p3_native_objects(spark: SparkSession, d: str) -> DataFrame:
    """Identical objects of the typed traces, stored once, with their number of occurrences."""
    return _native(spark, d, "objects").select("node_hash", "node", "copies")


def p3_native_copies(spark: SparkSession, d: str) -> DataFrame:
    """How many evidence objects occur how often: each is stored once, whatever its occurrences."""
    return _native(spark, d, "objects").where("node = 'evidence'").groupBy("copies").agg(F.count("*").alias("objects"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gaia_samples").select("task_id", "annotator_metadata")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("annotator_metadata")[f].alias("text"), F.lit(p).alias("prose")) for f, p in (("Steps", True), ("Tools", False))])
    return rows.select(F.col("task_id").alias("record_id"), F.explode(pairs).alias("e")).select("record_id", "e.*")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(_fields(spark, d)).withColumnRenamed("record_id", "task_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_values(spark, d).select("task_id", "field", "pos", packed.item_key(F.col("value")).alias("item_key"))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_direct_report": p2_direct_report,
    "p2_report_dangling": p2_report_dangling,
    "p2_graph_report": p2_graph_report,
    "p3_found": p3_found,
    "p3_traces": _flat("traces"),
    "p3_steps": _flat("steps"),
    "p3_items": _flat("items"),
    "p3_objects": _flat("objects"),
    "p3_values": p3_values,
    "p3_links": p3_links,
    "p3_native_items": p3_native_items,
    "p3_native_traces": p3_native_traces,
    "p3_native_steps": p3_native_steps,
    "p3_native_objects": p3_native_objects,
    "p3_native_copies": p3_native_copies,
    "p4_found": p4_found,
    "p4_values": p4_values,
}

_P2 = """
WITH s AS (SELECT trace_id, step_id, min(loaded_at) AS first_seen, arg_max(deleted, loaded_at) AS gone FROM plan_steps GROUP BY ALL),
e AS (SELECT DISTINCT trace_id, id, src, dst, loaded_at FROM plan_edges),
ends AS (SELECT trace_id, id, 'src' AS side, src AS k, loaded_at FROM e WHERE src IS NOT NULL
  UNION ALL SELECT trace_id, id, 'dst', dst, loaded_at FROM e WHERE dst IS NOT NULL),
f AS (SELECT ends.*, CASE WHEN s.step_id IS NULL THEN 'missing' WHEN s.gone THEN 'deleted' WHEN s.first_seen > ends.loaded_at THEN 'late' END AS reason
  FROM ends LEFT JOIN s ON s.trace_id = ends.trace_id AND s.step_id = ends.k)
"""


_GRAPH = """WITH RECURSIVE nodes AS (SELECT 'blocks:' || id AS k, min(loaded_at) AS t FROM blocks WHERE id IS NOT NULL GROUP BY 1 UNION ALL SELECT 'gaia_traces:' || trace_id, min(loaded_at)
  FROM gaia_traces WHERE trace_id IS NOT NULL GROUP BY 1
UNION ALL SELECT 'plan_steps:' || trace_id || '/' || step_id, min(loaded_at) FROM plan_steps WHERE trace_id || step_id IS NOT NULL GROUP BY 1),
gone AS (SELECT 'plan_steps:' || trace_id || '/' || step_id AS k FROM plan_steps GROUP BY 1 HAVING arg_max(deleted, loaded_at)),
refs AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'blocks' AS tab, 'blocks:' || id AS rec, 'blocks.context_refs' AS side, 'blocks:' || unnest(context_refs) AS ref, loaded_at AS seen FROM blocks
  UNION ALL SELECT 'proposals', 'proposals:' || concat_ws('/', block_id, pos, model), 'proposals.block_id', 'blocks:' || block_id, loaded_at FROM proposals
UNION ALL SELECT 'judge_runs', 'judge_runs:' || id, 'judge_runs.block_id', 'blocks:' || block_id, ingested_at FROM judge_runs UNION ALL SELECT 'plan_edges', 'plan_edges:' || trace_id || '/' || id,
  'plan_edges.src', 'plan_steps:' || trace_id || '/' || src, loaded_at FROM plan_edges UNION ALL SELECT 'plan_edges', 'plan_edges:' || trace_id || '/' || id, 'plan_edges.dst',
  'plan_steps:' || trace_id || '/' || dst, loaded_at FROM plan_edges
UNION ALL SELECT 'quote_reports', 'quote_reports:' || report_id, 'quote_reports.trace_id', 'gaia_traces:' || trace_id, reported_at FROM quote_reports) WHERE ref IS NOT NULL),
dir AS MATERIALIZED (SELECT * FROM (SELECT r.*, CASE WHEN n.k IS NULL THEN 'missing' WHEN g.k IS NOT NULL THEN 'deleted' WHEN n.t > r.seen THEN 'late' END AS reason FROM refs r LEFT
  JOIN nodes n ON n.k = r.ref LEFT JOIN gone g ON g.k = r.ref) WHERE reason IS NOT NULL),
reach AS (SELECT DISTINCT rec FROM dir UNION SELECT r.rec FROM refs r JOIN reach ON r.ref = reach.rec),
every AS (SELECT tab, rec, side, ref, 'direct' AS kind, reason, strftime(seen, '%Y-%m') AS month FROM dir UNION SELECT r.tab, r.rec, r.side, r.ref, 'inherited', 'inherited', strftime(r.seen, '%Y-%m')
  FROM refs r WHERE r.ref IN (SELECT rec FROM reach) AND r.rec NOT IN (SELECT rec FROM dir))
SELECT tab, side, kind, reason, month, count(*) AS refs FROM every GROUP BY ALL"""


def _dangling_sql(child: str, ref: str, parent: str, key: str, at: str) -> str:
    return f"""SELECT '{child}' AS tab, reason, month, count(*) AS refs FROM (
  SELECT strftime(c.{at}, '%Y-%m') AS month, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.t > c.{at} THEN 'late' END AS reason
  FROM (SELECT DISTINCT * FROM {child}) c LEFT JOIN (SELECT {key} AS k, min(loaded_at) AS t FROM {parent} GROUP BY 1) p ON p.k = c.{ref} WHERE c.{ref} IS NOT NULL)
WHERE reason IS NOT NULL GROUP BY ALL"""


ORACLE = {
    "p3_found": nested_sql.FOUND,
    "p3_values": nested_sql.WALK + " SELECT DISTINCT line_id, node, path AS step_path, CAST(i AS INT) AS item_pos, w ->> '$' AS value FROM good",
    "p3_links": nested_sql.WALK
    + " SELECT DISTINCT line_id, path AS step_path, CASE WHEN contains(path, '.') THEN regexp_replace(path, '[.][0-9]+$', '') ELSE '' END AS parent_path, step ->> '$.tool' AS tool, step ->> '$.kind' AS kind FROM walk",
    "p2_found": _P2 + "SELECT DISTINCT trace_id, id AS edge_id, side, reason FROM f WHERE reason IS NOT NULL",
    "p2_direct_report": _P2
    + """SELECT 'plan_edges' AS tab, 'direct' AS kind, reason, month, count(*) AS ends
FROM (SELECT DISTINCT trace_id, id, side, k, reason, strftime(loaded_at, '%Y-%m') AS month FROM f WHERE reason IS NOT NULL) GROUP BY ALL""",
    "p2_graph_report": _GRAPH,
    "p2_report": _P2.replace("WITH s AS", "WITH RECURSIVE s AS") + """, bad AS MATERIALIZED (SELECT DISTINCT trace_id, id FROM f WHERE reason IS NOT NULL),
reach AS (SELECT DISTINCT e.trace_id, e.dst FROM e JOIN bad USING (trace_id, id) WHERE e.dst IS NOT NULL UNION SELECT e.trace_id, e.dst FROM e JOIN reach r ON r.trace_id = e.trace_id
  AND r.dst = e.src WHERE e.dst IS NOT NULL)
SELECT 'plan_edges' AS tab, kind, reason, month, count(*) AS ends FROM (SELECT DISTINCT trace_id, id, side, k, 'direct' AS kind, reason, strftime(loaded_at, '%Y-%m') AS month FROM f
  WHERE reason IS NOT NULL
  UNION SELECT DISTINCT e.trace_id, e.id, 'src', e.src, 'inherited', 'inherited', strftime(e.loaded_at, '%Y-%m') FROM e JOIN (SELECT DISTINCT * FROM reach) r ON r.trace_id = e.trace_id
  AND r.dst = e.src LEFT JOIN bad b ON b.trace_id = e.trace_id AND b.id = e.id WHERE b.id IS NULL) GROUP BY ALL""",
    "p2_report_dangling": " UNION ALL ".join(
        _dangling_sql(*x)
        for x in (
            ("proposals", "block_id", "blocks", "id", "loaded_at"),
            ("judge_runs", "block_id", "blocks", "id", "ingested_at"),
            ("quote_reports", "trace_id", "gaia_traces", "trace_id", "reported_at"),
        )
    ),
    "p3_native_copies": """SELECT copies, count(*) AS objects FROM (SELECT v, count(*) AS copies FROM (
  SELECT trace_id, s, i, trace.steps[s].evidence[i] AS v FROM (SELECT trace_id, k, trace, s, unnest(range(1, len(trace.steps[s].evidence) + 1)) AS i FROM (SELECT trace_id, k, trace, unnest(range(1,
  len(trace.steps) + 1)) AS s
    FROM (SELECT DISTINCT trace_id, {'a': task_id, 'b': question, 'c': model, 'd': answer, 'e': level} AS k, trace FROM gaia_traces)))) WHERE trim(v) <> '' GROUP BY v) GROUP BY 1""",
    "p3_native_traces": "SELECT DISTINCT trace_id, task_id, question, model, answer, level FROM gaia_traces",
    "p3_native_steps": """SELECT DISTINCT trace_id, s::VARCHAR AS step_path, trace.steps[s].kind AS kind, trace.steps[s].tool AS tool, trace.steps[s].summary AS summary
FROM (SELECT trace_id, trace, unnest(range(1, len(trace.steps) + 1)) AS s FROM gaia_traces) WHERE trace.steps[s] IS NOT NULL""",
    "p3_native_items": """SELECT DISTINCT trace_id, CAST(s AS INT) AS step_pos, CAST(i AS INT) AS item_pos, trace.steps[s].evidence[i] AS value
FROM (SELECT trace_id, trace, s, unnest(range(1, len(trace.steps[s].evidence) + 1)) AS i
  FROM (SELECT trace_id, trace, unnest(range(1, len(trace.steps) + 1)) AS s FROM gaia_traces))
WHERE trim(trace.steps[s].evidence[i]) <> ''""",
}
