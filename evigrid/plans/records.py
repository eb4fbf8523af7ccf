"""Queries of plan records, generated plans, provenance, discussion and scans over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.functions import text as T
from evigrid.operators import align, entail, evalstats as E, grading as G, provenance as P, records as R, scan, traces as TR
from evigrid.plans import reference
from evigrid.plans.alignment_sql import RAW_PAIRS, SOFT
from evigrid.plans.reference_sql import GOLD, STEPS, TRACES
from evigrid.session import table


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_traces(table(spark, d, "gaia_traces"))


def record_steps(spark, d):
    return R.plan_steps(_traces(spark, d)).select("trace_id", "step_id", "grp", "idx", "description", F.array_join("tools", ",").alias("tools"), F.col("provenance.sourceEvidence").alias("evidence"))


def record_edges(spark, d):
    return R.plan_edges(R.plan_steps(_traces(spark, d)))


def record_flows(spark, d):
    t = _traces(spark, d)
    return R.information_flows(t, R.plan_steps(t))


def record_summary(spark, d):
    t = _traces(spark, d)
    return R.record_summary(t, R.plan_steps(t))


def record_validate(spark, d):
    """The rules of plan records over the history of steps, the edges, and goals made of the traces."""
    steps = table(spark, d, "plan_steps").select("trace_id", "step_id", "grp", "idx", "description", "tools", "provenance")
    edges = table(spark, d, "plan_edges").select("trace_id", "id", "src", "dst", "provenance").distinct()
    goals = _traces(spark, d).select(
        "trace_id", F.concat(F.lit("goal:"), "task_id").alias("id"), F.col("question").alias("description"), "task_id", F.struct(F.lit("explicit").alias("origin"),
        F.lit("trace").alias("sourceEvidence"), F.lit(1.0).alias("confidence")).alias("provenance"),
        F.col("final_correct").alias("verified"), F.lit(0.0).alias("duration"), "answer",
    )
    return TR.validate_records(steps, edges, goals).groupBy("part", "severity", "rule").agg(F.count("*").alias("n"))


def step_tool_names(spark, d):
    """Tools named in descriptions, with names of the forms that a description may hold put in by the step's number."""
    forms = F.array(*map(F.lit, ("web browser", "search_agent", "PageReaderTool", "inspect_file_as_text", "CSVTool and a_b_2")))
    said = table(spark, d, "plan_steps").where("description IS NOT NULL").select(F.concat("description", F.lit(" with "), F.element_at(forms, (F.pmod(F.coalesce("idx", F.lit(0)), F.lit(5)) + 1).cast("int"))).alias("d")).distinct()
    return said.select(F.explode(R.tool_names(F.col("d"))).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


def resolved_answers(spark, d):
    """Answers, every other one wrapped as arguments, taken out again."""
    t = _traces(spark, d).where("answer IS NOT NULL").select("trace_id", "answer")
    wrapped = F.when(F.pmod(F.length("answer"), F.lit(2)) == 0, F.to_json(F.struct(F.array("answer").alias("args")))).otherwise(F.col("answer"))
    return t.select("trace_id", R.resolved_answer(wrapped).alias("resolved"), F.length(wrapped).cast("long").alias("n_raw"))


def question_domains(spark, d):
    return table(spark, d, "blocks").select("id", R.domain_of(F.concat("question", F.lit(" "), F.coalesce("domain", F.lit("")), F.lit(" audit "), F.coalesce("domain", F.lit("")))).alias("domain")).distinct().groupBy("domain").agg(F.count("*").alias("n"))


def truncated_context(spark, d):
    return table(spark, d, "blocks").select("id", R.truncated_words(F.col("question"), 8).alias("context")).distinct()


def plain_plan_steps(spark, d):
    return align.latest_steps(table(spark, d, "plan_steps")).where(R.is_plan_step(F.col("grp"), F.col("step_id"))).groupBy("trace_id").agg(F.count("*").alias("n"))


def _rated(spark, d, grp):
    """Steps of a group with a criticality by their tools."""
    steps = align.latest_steps(table(spark, d, "plan_steps")).where(F.col("grp") == grp)
    rate = F.when(F.size(F.coalesce("tools", F.array().cast("array<string>"))) > 0, "critical").when(F.length("description") % 7 == 0, "optional").otherwise("supporting")
    return steps.select("trace_id", "step_id", "idx", "description", rate.alias("criticality"))


def plan_comparison(spark, d):
    return R.compare_plans(_rated(spark, d, "agent:plan"), _rated(spark, d, "annotator"), "trace_id")


def generated_check(spark, d):
    return R.check_generated(_rated(spark, d, "agent:plan"), "trace_id")


def _entries(spark, d):
    """Calibration replies: the annotator's rating of the same numbers; a reason where the description is long enough."""
    return _rated(spark, d, "annotator").select("trace_id", "idx", "criticality", F.when(F.length("description") > 20, F.col("description")).alias("reason"))


def calibration_check(spark, d):
    plans = _rated(spark, d, "agent:plan").groupBy("trace_id").agg(F.count("*").alias("n_steps"))
    return R.check_calibration(_entries(spark, d), plans, "trace_id")


def calibration_changes(spark, d):
    return R.calibration_stats(R.rewrite_criticality(_rated(spark, d, "agent:plan"), _entries(spark, d).where("criticality <> 'optional'"), "trace_id"), "trace_id")


def generation_stats(spark, d):
    plans = _rated(spark, d, "agent:plan").groupBy("trace_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("criticality") == "critical").alias("n_critical"), F.sum(F.length("description")).cast("double").alias("ms"), F.max("criticality").alias("domain"))
    return R.generation_stats(plans).select("plans", "domains", *[F.round(c, 9).alias(c) for c in ("avg_n_steps", "avg_n_critical", "avg_ms")])


#: Patterns that the test documents hold, in the shape of scan.DANGERS: the calls of the real list do not stand in prose.
_DANGERS = ((r"flood of [0-9]+", "flood", "critical", "python", "W-1"), (r"[0-9]+ percent", "percent", "low", "python", "W-2"), (r"missing", "missing", "high", "javascript", "W-3"), (r"step [0-9]+", "step", "medium", "javascript", "W-4"))


def _audited(spark, d):
    lines = scan.lines_of(table(spark, d, "documents").withColumn("name", F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".ts").otherwise(".md"))), "name", "text")
    # the marks of guards, sandboxes and bypasses stand in few documents: words that do take their place in the line
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "(?i)auction", "sandbox"), "(?i)index card", "confirm("), "(?i)seed trays", "AUTO_APPROVE")
    return scan.audit(lines.withColumn("line", marked), scan.language_of(F.col("file")), _DANGERS, 2)


def scan_audit(spark, d):
    return _audited(spark, d).select("file", "line_no", "label", "severity", "guard_status", F.col("bypass_line").cast("int").alias("bypass_line"), "has_sandbox", "score")


def scan_highest_severity(spark, d):
    return scan.highest_severity(_audited(spark, d), "file")


def scan_ranked(spark, d):
    """The first findings in report order."""
    return scan.ranked_findings(_audited(spark, d)).select("file", "line_no", "label", "severity").limit(50)


def scan_dangers(spark, d):
    """Calls of the fixed list, put into the lines of documents by their numbers."""
    calls = F.array(*map(F.lit, ("exec (x)", "eval(x)", "subprocess.run (x)", "os.popen(x)", "importlib.import_module", "spec.exec_module(m)", "pickle.loads(b)", "yaml.load(f)", "yaml.load(f, Loader=S)", "child_process.spawn(x)", "new Function (x)", "vm.runInNewContext(x)", "retrieval(x)")))
    lines = table(spark, d, "documents").select(
        F.concat("doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".js")).alias("file"), (F.col("doc_id") % 5 + 1).cast("int").alias("line_no"), F.element_at(calls, (F.col("doc_id") % 13 + 1).cast("int")).alias("line")
    ).distinct()
    return scan.audit(lines, scan.language_of(F.col("file"))).groupBy("label", "severity", "weakness", "guard_status", "score").agg(F.count("*").alias("n"))


def graded_floors(spark, d):
    """Scores under all floors: reasons and excerpts dealt to line items, in both modes."""
    said = F.array(*map(F.lit, ("wrong source", "used blog rather than the source, blog instead", "cross-step evidence", "plain", "spans two trace steps", "not the official page")))
    shown = F.array(*map(F.lit, ("[search] x", "[search] x [observe] y", "tool call made", "plain text", "[TOOL] run [EXTRACTED] z")))
    g = reference.graded(spark, d).withColumn("reason", F.element_at(said, (F.col("step_no") % 6 + 1).cast("int"))).withColumn("shown", F.element_at(shown, (F.col("item_id") % 5 + 1).cast("int")))
    s, f = (G.floored(F.col("raw_score"), F.col("quote"), F.col("reason"), F.col("shown"), m) for m in ("support", "faithfulness"))
    g = g.withColumn("s", s).withColumn("f", f)
    return g.groupBy(G.predicate(F.col("s"), F.col("quote")).alias("support"), G.predicate(F.col("f"), F.col("quote"), "faithfulness").alias("faithfulness")).agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("s"), F.round(F.sum("f"), 4).alias("f"))


def enrich_pages(spark, d):
    """Titles and headings of pages added to the evidence of each trace's first browse step."""
    steps = _traces(spark, d).select("trace_id", F.col("annotator_metadata")["source_url"].alias("source_url"), F.posexplode("trace.steps").alias("i", "s"))
    rows = steps.where("s IS NOT NULL").select("trace_id", "source_url", (F.col("i") + 1).alias("step_pos"), F.when(F.col("s.tool") == "web_browser", "browse").otherwise(F.col("s.kind")).alias("kind"), F.col("s.evidence").alias("evidence"))
    urls = rows.where("source_url IS NOT NULL").select(F.col("source_url").alias("url")).distinct()
    pages = urls.select("url", F.concat(F.lit("<html><title> Page of&nbsp;"), "url", F.lit("</title><body><h1>Head &amp; <b>"), F.length("url").cast("string"), F.lit("</b></h1></body></html>")).alias("html"))
    out = TR.enrich_pages(rows, pages).where("kind = 'browse'")
    return out.select("trace_id", "step_pos", F.array_join(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: e.contains("Page of") | e.contains("Head &")), "|").alias("added"))


def signal_phrases(spark, d):
    return table(spark, d, "blocks").select("id", T.signal_count(F.col("question"), ["how many", "which", "claim", "prove", "source"]).alias("n_signals")).distinct()


def numbered_lists(spark, d):
    t = table(spark, d, "gaia_samples").select("task_id", F.col("annotator_metadata")["Steps"].alias("steps")).where("steps IS NOT NULL").distinct()
    return t.select("task_id", F.posexplode(T.numbered_items(F.col("steps"))).alias("i", "item")).distinct()


def highest_scores(spark, d):
    """The best of three classes by score, ties in their order."""
    a, b, c = F.col("l_discount"), F.col("l_tax"), F.round(F.col("l_quantity") / 500, 2)
    top = F.greatest(a, b, c)
    return table(spark, d, "lineitem").select(F.when(a == top, "discount").when(b == top, "tax").otherwise("quantity").alias("best")).groupBy("best").agg(F.count("*").alias("n"))


def accuracy_mismatch_families(spark, d):
    """Mismatches per family of case ids."""
    m = E.mismatches(reference._labelled(spark, d), "item_id")
    starts = F.array(*[F.lit(x) for x in ("V0-", "V1-", "B-", "GAIA-", "X-")])
    name = F.concat(F.element_at(starts, (F.col("item_id") % 5 + 1).cast("int")), F.col("item_id").cast("string"))
    return m.groupBy(E.id_family(name).alias("family"), "gold", "verdict").agg(F.count("*").alias("n"))


def segment_diagnostics(spark, d):
    out = align.segment_diagnostics(*reference._sides(spark, d, True))
    return out.select("trace_id", "agent_id", F.col("start_pos").cast("int").alias("start_pos"), F.col("len").cast("int").alias("len"), *[F.round(c, 9).alias(c) for c in ("score", "single_score", "improvement")])


def near_miss_answers(spark, d):
    """Whether answers, some of them made of the truth, come near it: the truth with words around it, cut, negated, or with other numbers."""
    t = _traces(spark, d).where("ground_truth IS NOT NULL").select("trace_id", "ground_truth", "question", F.pmod(F.length("question"), F.lit(5)).alias("k"))
    g = F.concat("question", F.lit(" "), "ground_truth")
    made = F.when(F.col("k") == 0, F.concat(g, F.lit(" as the page says"))).when(F.col("k") == 1, F.substring_index(g, " ", 8)).when(F.col("k") == 2, F.concat(F.lit("not "), g)).when(F.col("k") == 3, F.regexp_replace(g, "[0-9]", "7")).otherwise(F.concat(F.lit("A B. C. "), F.substring_index(g, " ", -6)))
    return t.select("trace_id", entail.near_miss(made, g).alias("near"), entail.negation_differs(made, g).alias("negated"), entail.names_differ(made, g).alias("other_names"))


def line_break_quotes(spark, d):
    """Signals of cuts across lines in probes made of each trace's evidence."""
    return _evidence(spark, d).select("trace_id", F.array_join(P.line_break_signals(P.cross_line_quote(F.col("source")), F.col("source")), ",").alias("signals"), F.array_join(P.line_break_signals(P.bridge_quote(F.col("source")), F.col("source")), ",").alias("bridge_signals"))


def line_break_sweep(spark, d):
    return P.line_break_sweep(_evidence(spark, d))


def _evidence(spark, d):
    e = F.filter(F.flatten(F.transform("trace.steps", lambda s: F.coalesce(s["evidence"], F.array().cast("array<string>")))), lambda x: x.isNotNull())
    return _traces(spark, d).select("trace_id", F.coalesce(F.array_join(e, "\n"), F.lit("")).alias("source"))


def coerced_traces(spark, d):
    steps, answer = R.coerced_trace(F.col("trace.steps"), F.col("answer"))
    t = _traces(spark, d).select("trace_id", F.posexplode(steps).alias("i", "s"), answer.alias("answer"))
    return t.select("trace_id", F.col("s.index").alias("index"), "s.kind", "s.tool", "s.summary", F.coalesce(F.size("s.evidence"), F.lit(-1)).alias("n_evidence"), "answer")


def evidence_sources(spark, d):
    return reference.graded(spark, d).groupBy(R.evidence_source(F.col("step_type")).alias("source")).agg(F.count("*").alias("n"))


def plan_span_selection(spark, d):
    """Steps as model calls: a prompt that asks for a plan is one whose description compares."""
    steps = align.latest_steps(table(spark, d, "plan_steps")).where("grp = 'agent:exec'")
    return R.plan_spans(steps.select("trace_id", F.col("step_id").alias("span_id"), F.col("idx").alias("pos"), F.col("description").alias("prompt")), "Compare")


def text_attributes(spark, d):
    """A text and a number of each part as attributes of a span; the number is no text."""
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("llm.name"), F.col("p_size").alias("llm.size"))).alias("attributes"))
    return p.select("p_partkey", R.text_attribute(F.col("attributes"), "llm.name").alias("name"), R.text_attribute(F.col("attributes"), "llm.size").alias("size"))


def evaluator_pairs(spark, d):
    """All families of the dealt model names against those of the next two."""
    names = F.array(*map(F.lit, reference.MODEL_NAMES))
    at = lambda k: G.family(F.element_at(names, ((F.col("p_partkey") * k + k) % len(reference.MODEL_NAMES) + 1).cast("int")))
    return table(spark, d, "part").groupBy(R.pair_problem(at(1), at(3), at(5)).alias("problem")).agg(F.count("*").alias("n"))


def artifact_paths(spark, d):
    forms = F.array(*map(F.lit, ("a/traces.jsonl", "b/traces-x-2026-01-02.jsonl", "gold.json", "c/gold-2026-01-02.json", "source-claim.json", "readme.md", "traces.json")))
    at = lambda k: F.element_at(forms, ((F.col("p_partkey") * k) % 7 + 1).cast("int"))
    paths = F.array(at(1), at(2), at(3))
    return table(spark, d, "part").groupBy(*[R.artifact(paths, k).alias(k) for k in R.ARTIFACTS]).agg(F.count("*").alias("n"))


#: Rules over the test documents, in the shape of records.boundary_breaks.
_RULES = [("^1", ["(?i)ledger"], [], "ledger in ones"), ("[05]$", ["(?i)flood", "(?i)museum"], ["(?i)missing"], "flood and museum, nothing missing"), (".", ["(?i)wool bales"], ["(?i)the"], "bales without an article")]


def boundary_breaks(spark, d):
    return R.boundary_breaks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"), _RULES)


def acronyms(spark, d):
    """Questions for names of parts, and pages that spell them out."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("AB"), F.pmod("p_partkey", F.lit(7)).cast("string")).alias("a"), F.lower("p_brand").alias("brand"))
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("What does "), F.lower("a"), F.lit(" stand for?"))).otherwise(F.concat(F.lit("what does  "), "a", F.lit(" stand for")))
    page = F.concat(F.lit("Here is The Alpha Brand-"), F.regexp_extract("brand", "([0-9]+)", 1), F.lit(" (AB"), F.pmod("p_partkey", F.lit(5)).cast("string"), F.lit(") and Other Words (ZZ)."))
    return p.select("p_partkey", R.acronym_asked(q).alias("asked"), R.acronym_expansion(page, R.acronym_asked(q)).alias("meaning"))


def document_digest(spark, d):
    return R.document_digest(table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), "text"), 10, 300, 2_000)


def calibration_scan(spark, d):
    """Calibration of the judges of one role, scanned by equality."""
    runs = R.where_equal(table(spark, d, "judge_runs"), role="critic", domain=None, model="orla-2").distinct()
    return runs.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("score_given"), 8).alias("avg_score"))


QUERIES = {f.__name__: f for f in (
    record_steps, record_edges, record_flows, record_summary, record_validate, step_tool_names, resolved_answers, question_domains, truncated_context, plain_plan_steps, plan_comparison, generated_check,
    calibration_check, calibration_changes, generation_stats, scan_audit, scan_highest_severity, scan_ranked, scan_dangers, graded_floors, enrich_pages, signal_phrases, numbered_lists, highest_scores, accuracy_mismatch_families,
    segment_diagnostics, near_miss_answers, line_break_quotes, line_break_sweep, coerced_traces, evidence_sources, plan_span_selection, text_attributes, evaluator_pairs, artifact_paths, boundary_breaks, acronyms, document_digest, calibration_scan,
)}

_LINES = "list_filter(list_transform(list_filter(list_transform(string_split_regex(coalesce(annotator_metadata['Steps'], ''), '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '(?i)^step\\s*\\d+\\s*:\\s*', ''), '^\\d+\\.\\s*', '')), lambda x: x <> '')"
_RECORDS = "WITH " + TRACES + f""", real AS (SELECT *, list_filter(coalesce(trace.steps, []), lambda s: s IS NOT NULL) AS st, {_LINES} AS said FROM lt),
plan AS (SELECT *, list_filter(st, lambda s: coalesce(s.kind <> 'answer', true)) AS pl FROM real),
rs AS MATERIALIZED (SELECT trace_id, 'annotator:step:' || i AS step_id, 'annotator' AS grp, i AS idx, said[i] AS description, '' AS tools, 'annotator_metadata.Steps line ' || i AS evidence
  FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM plan)
UNION ALL SELECT trace_id, 'agent:plan:step:' || i, 'agent:plan', i, pl[i].summary, CASE WHEN coalesce(pl[i].tool, '') IN ('', 'internal') THEN '' ELSE pl[i].tool END,
  'trace.steps[' || (i - 1) || '] projected into inferred plan' FROM (SELECT *, unnest(range(1, len(pl) + 1)) AS i FROM plan)
UNION ALL SELECT trace_id, 'agent:exec:step:' || i, 'agent:exec', i, st[i].summary, CASE WHEN coalesce(st[i].tool, '') IN ('', 'internal') THEN '' ELSE st[i].tool END,
  'trace.steps[' || (i - 1) || ']' FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM plan))"""
_RATED = "WITH " + STEPS + """, rated AS MATERIALIZED (SELECT trace_id, step_id, grp, idx, description, CASE WHEN len(coalesce(tools, [])) > 0 THEN 'critical'
  WHEN length(description) % 7 = 0 THEN 'optional' ELSE 'supporting' END AS criticality FROM steps),
auto AS (SELECT * FROM rated WHERE grp = 'agent:plan'), gold AS (SELECT * FROM rated WHERE grp = 'annotator')"""
_AUDIT = """WITH l AS (SELECT doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.md' END AS file, doc_id, i AS line_no,
  regexp_replace(regexp_replace(regexp_replace(x[i], '(?i)auction', 'sandbox', 'g'), '(?i)index card', 'confirm(', 'g'), '(?i)seed trays', 'AUTO_APPROVE', 'g') AS line FROM (SELECT doc_id, x,
  unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
w AS (SELECT *, bool_or(regexp_matches(line, '(?i)\\b(sandbox|container|jail|seccomp|chroot|AppArmor|SELinux|WASM|QuickJS|isolated_process|secure_sandbox|sandboxed)\\b|\\bvm\\.runIn\\b')) OVER n AS has_sandbox,
  bool_or(regexp_matches(line, '\\b(input|confirm|prompt|approve|getpass)\\s*\\(|(?i:\\b(consent|ask_user|confirmation)\\b)')) OVER n AS guard,
  min(CASE WHEN regexp_matches(line, '(?i)BYPASS|NON_INTERACTIVE|DISABLE_SAFETY|SKIP_CONFIRM|AUTO_APPROVE|TRUST_REMOTE|UNSAFE') THEN line_no END) OVER (PARTITION BY file) AS bypass_line
  FROM l WINDOW n AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (SELECT file, line_no, label, severity, CASE WHEN bypass_line IS NOT NULL THEN 'guarded-but-bypassable' WHEN guard THEN 'guarded' ELSE 'unguarded' END AS guard_status, bypass_line, has_sandbox,
  list_position(['critical', 'high', 'medium', 'low'], severity) AS r
  FROM w JOIN (VALUES ('flood of [0-9]+', 'flood', 'critical', 0), ('[0-9]+ percent', 'percent', 'low', 0), ('missing', 'missing', 'high', 1), ('step [0-9]+', 'step', 'medium', 1)) p(re, label,
  severity, m) ON doc_id % 3 = m AND regexp_matches(line, re))"""
_SCORE = "CASE WHEN has_sandbox THEN 3.0 WHEN guard_status = 'unguarded' THEN 9.1 WHEN guard_status = 'guarded' THEN 5.5 ELSE 8.4 END"
_SNAKE = "list_transform(regexp_extract_all(d, '(?i)\\b[a-z]+(?:_[a-z0-9]+)+\\b'), lambda t: lower(t))"
_CAMEL = "list_transform(regexp_extract_all(d, '\\b[A-Z][A-Za-z0-9]+Tool\\b'), lambda t: lower(regexp_replace(regexp_replace(t, 'Tool$', ''), '([a-z])([A-Z])', '\\1_\\2', 'g')))"

_EXCERPT_BARE = "regexp_matches(shown, '(?i)tool.?call|web_search|web_fetch|\\[search\\]|\\[TOOL') AND NOT regexp_matches(shown, '(?i)tool.?result|\\[observe\\]|\\[EXTRACTED')"

_TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TAIL = "regexp_matches({q}, '\\n') AND regexp_matches(" + _TRIMMED.format("string_split({q}, chr(10))[-1]") + ", '^[A-Za-z\\[(]') AND length(" + _TRIMMED.format("string_split({q}, chr(10))[-1]") + ") <= 16 AND contains(source, chr(10) || " + _TRIMMED.format("string_split({q}, chr(10))[-1]") + ")"
_HALF = "length(string_split({q}, chr(10))[1]) >= 8 AND length(string_split({q}, chr(10))[2]) >= 4 AND contains(source, string_split({q}, chr(10))[1]) AND contains(source, " + _TRIMMED.format("string_split({q}, chr(10))[2]") + ") AND NOT contains(source, string_split({q}, chr(10))[1] || chr(10) || " + _TRIMMED.format("string_split({q}, chr(10))[2]") + ")"
_PROBES = "WITH " + TRACES + f""", ev AS (SELECT trace_id, coalesce(array_to_string(list_filter(flatten(list_transform(trace.steps, lambda s: coalesce(s.evidence, []))), lambda e: e IS NOT NULL),
  chr(10)), '') AS source FROM lt),
ln AS (SELECT *, list_transform(string_split(source, chr(10)), lambda x: {_TRIMMED.format('x')}) AS l FROM ev),
pb AS (SELECT trace_id, source, list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN length(l[i]) >= 20 AND length(l[i + 1]) >= 12 AND regexp_matches(left(l[i + 1], 10),
  '[A-Za-z\\[(]$') THEN l[i] || chr(10) || left(l[i + 1], 10) END), lambda x: x IS NOT NULL)[1] AS q,
  list_filter(list_transform(range(3, len(l) + 1), lambda i: CASE WHEN length(l[1]) >= 10 AND length(l[i]) >= 8 AND regexp_matches(left(l[i], 12), '[A-Za-z\\[(]$') THEN l[1] || chr(10) || left(l[i],
  12) END), lambda x: x IS NOT NULL)[1] AS b FROM ln),
sig AS MATERIALIZED (SELECT *, coalesce({_TAIL.format(q='q')}, false) AS qa, coalesce({_HALF.format(q='q')}, false) AS qc, coalesce({_TAIL.format(q='b')}, false) AS ba,
  coalesce({_HALF.format(q='b')}, false) AS bc FROM pb)"""

ORACLE = {
    "record_steps": _RECORDS + " SELECT trace_id, step_id, grp, CAST(idx AS INT) AS idx, description, tools, evidence FROM rs",
    "record_edges": _RECORDS + " SELECT a.trace_id, a.grp || ':edge:' || a.idx AS id, a.step_id AS src, b.step_id AS dst, 'sequential' AS type FROM rs a JOIN rs b ON a.trace_id = b.trace_id AND a.grp = b.grp AND b.idx = a.idx + 1",
    "record_flows": _RECORDS + """ SELECT trace_id, 'flow:goal_to_plan' AS id, 'goal' AS src, 'agent:plan:step:1' AS dst, question AS value FROM plan WHERE len(pl) > 0 UNION ALL SELECT trace_id,
  'flow:goal_to_exec', 'goal', 'agent:exec:step:1', question FROM plan WHERE len(st) > 0
UNION ALL SELECT trace_id, 'flow:exec_to_final_answer', 'agent:exec:step:' || len(st), 'final_answer', answer FROM plan WHERE len(st) > 0""",
    "record_summary": _RECORDS + """, v AS (SELECT *, lower(regexp_replace(coalesce(ground_truth, ''), '^\\s+|\\s+$', '', 'g')) AS g, lower(regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '',
  'g')) AS a FROM plan),
u AS (SELECT *, CASE WHEN g <> '' THEN coalesce(final_correct, true) AND a = g ELSE coalesce(final_correct, false) END AS verified FROM v)
SELECT trace_id, len(said)::BIGINT AS n_annotator, len(pl)::BIGINT AS n_plan, len(st)::BIGINT AS n_exec, len(list_filter(string_split_regex(coalesce(annotator_metadata['Tools'], ''), '\\r?\\n'),
  lambda x: trim(x) <> ''))::INT AS n_annotator_tools, verified, g <> '' AND NOT verified AS wrong_answer FROM u""",
    "record_validate": "WITH " + TRACES + """, e AS (SELECT DISTINCT trace_id, id, src, dst, provenance AS p FROM plan_edges), ids AS (SELECT DISTINCT trace_id, step_id FROM plan_steps
  WHERE step_id IS NOT NULL),
pr AS (SELECT trace_id, 'step' AS part, step_id AS ref, provenance AS p FROM plan_steps UNION ALL SELECT trace_id, 'edge', id, p FROM e),
b AS (SELECT trace_id, part, ref, 'error' AS severity, 'no_provenance' AS rule, p IS NULL AS bad FROM pr UNION ALL SELECT trace_id, part, ref, 'error', 'unknown_origin', p IS NOT NULL
  AND NOT coalesce(p.origin IN ('explicit', 'inferred', 'annotator'), false) FROM pr
UNION ALL SELECT trace_id, part, ref, 'error', 'no_source_evidence', p IS NOT NULL AND coalesce(trim(p.sourceEvidence), '') = '' FROM pr UNION ALL SELECT trace_id, part, ref, 'error',
  'confidence_out_of_range', p IS NOT NULL AND NOT coalesce(p.confidence BETWEEN 0 AND 1, false) FROM pr
UNION ALL SELECT trace_id, 'step', step_id, 'error', 'unknown_group', NOT coalesce(grp IN ('annotator', 'agent:plan', 'agent:exec'), false) FROM plan_steps UNION ALL SELECT trace_id, 'step', step_id,
  'error', 'index_below_one', coalesce(idx < 1, true) FROM plan_steps
UNION ALL SELECT trace_id, 'step', step_id, 'error', 'empty_description', coalesce(trim(description), '') = '' FROM plan_steps UNION ALL SELECT trace_id, 'step', step_id, 'error', 'no_tools',
  tools IS NULL FROM plan_steps UNION ALL SELECT trace_id, 'step', step_id, 'error', 'no_id', step_id IS NULL FROM plan_steps
UNION ALL SELECT trace_id, 'step', step_id, 'error', 'duplicate_id', count(*) > 1 FROM plan_steps WHERE step_id IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT e.trace_id, 'edge', id, 'error', 'unknown_from', i.step_id IS NULL AND coalesce(src <> 'goal', true) FROM e LEFT JOIN ids i ON i.trace_id = e.trace_id AND i.step_id = e.src UNION ALL
  SELECT e.trace_id, 'edge', id, 'error', 'unknown_to', i.step_id IS NULL AND coalesce(dst <> 'final_answer', true) FROM e LEFT JOIN ids i ON i.trace_id = e.trace_id AND i.step_id = e.dst
UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'error', 'empty_id', coalesce(trim('goal:' || task_id), '') = '' FROM lt UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'error',
  'empty_description', coalesce(trim(question), '') = '' FROM lt UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'error', 'empty_task', coalesce(trim(task_id), '') = '' FROM lt
UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'error', 'verified_unknown', final_correct IS NULL FROM lt UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'warning', 'duration_zero',
  true FROM lt UNION ALL SELECT trace_id, 'goal', 'goal:' || task_id, 'error', 'no_answer', answer IS NULL FROM lt
UNION ALL SELECT trace_id, 'record', 'goal:' || task_id, 'warning', 'no_steps', trace_id NOT IN (SELECT trace_id FROM plan_steps WHERE trace_id IS NOT NULL) FROM lt)
SELECT part, severity, rule, count(*) AS n FROM (SELECT DISTINCT trace_id, part, ref, severity, rule FROM b WHERE bad) GROUP BY ALL""",
    "step_tool_names": f"""WITH s AS (SELECT DISTINCT description || ' with ' || ['web browser', 'search_agent', 'PageReaderTool', 'inspect_file_as_text', 'CSVTool and a_b_2'][((coalesce(idx,
  0) % 5) + 5) % 5 + 1] AS d FROM plan_steps WHERE description IS NOT NULL),
k AS (SELECT list_distinct(list_concat(list_filter(['search engine', 'web browser', 'python_interpreter', 'final_answer', 'visualizer', 'inspect_file_as_text', 'search_agent'],
  lambda t: contains(lower(d), t)), {_SNAKE}, {_CAMEL})) AS ts FROM s)
SELECT tool, count(*) AS n FROM (SELECT unnest(ts) AS tool FROM k) GROUP BY 1""",
    "resolved_answers": "WITH " + TRACES + " SELECT trace_id, answer AS resolved, CASE WHEN length(answer) % 2 = 0 THEN length('{\"args\":[' || to_json(answer)::VARCHAR || ']}') ELSE length(answer) END AS n_raw FROM lt WHERE answer IS NOT NULL",
    "truncated_context": "SELECT DISTINCT id, CASE WHEN len(string_split_regex(trim(question, ' '), '\\s+')) <= 8 THEN question ELSE array_to_string(string_split_regex(trim(question, ' '), '\\s+')[1:8], ' ') || '...' END AS context FROM blocks",
    "plain_plan_steps": "WITH " + STEPS + " SELECT trace_id, count(*) AS n FROM steps WHERE grp = 'agent:plan' AND step_id NOT LIKE 'agent:plan:facts:%' GROUP BY 1",
    "plan_comparison": _RATED + """, s AS (SELECT a.trace_id, an, gn, ac, gc, asu, gsu FROM (SELECT trace_id, count(*) AS an, count(*) FILTER (criticality = 'critical') AS ac,
  count(*) FILTER (criticality = 'supporting') AS asu FROM auto GROUP BY 1) a
  JOIN (SELECT trace_id, count(*) AS gn, count(*) FILTER (criticality = 'critical') AS gc, count(*) FILTER (criticality = 'supporting') AS gsu FROM gold GROUP BY 1) g USING (trace_id))
SELECT trace_id, an AS auto_steps, gn AS gold_steps, ac AS auto_critical, gc AS gold_critical, an = gn AS step_count_match, ac = gc AND asu = gsu AS criticality_structure_match,
  ac = gc AS verdict_structure_match FROM s""",
    "generated_check": _RATED + """, l AS (SELECT trace_id, count(*) AS n_steps, list_sort(list(idx)) AS ix, bool_or(length(coalesce(description, '')) < 10) AS short,
  bool_or(criticality NOT IN ('critical', 'supporting')) AS odd, bool_or(criticality = 'critical') AS crit FROM auto GROUP BY 1)
SELECT trace_id, n_steps, CASE WHEN n_steps < 3 OR n_steps > 6 THEN 'step_count' WHEN ix <> list_transform(range(1, n_steps + 1), lambda x: x::INT) THEN 'index' WHEN short THEN 'description'
  WHEN odd THEN 'criticality' WHEN NOT crit THEN 'no_critical' END AS problem FROM l""",
    "calibration_check": _RATED + """, c AS (SELECT trace_id, count(*) AS n, bool_or(idx IS NULL) AS bare, bool_or(criticality NOT IN ('critical', 'supporting')) AS odd,
  bool_or(NOT coalesce(length(description) > 20, false)) AS mute, bool_or(criticality = 'critical') AS crit FROM gold GROUP BY 1)
SELECT trace_id, CASE WHEN coalesce(n, 0) <> k THEN 'length' WHEN bare THEN 'index' WHEN odd THEN 'criticality' WHEN mute THEN 'reason' WHEN NOT crit THEN 'no_critical' END AS problem
  FROM (SELECT trace_id, count(*) AS k FROM auto GROUP BY 1) LEFT JOIN c USING (trace_id)""",
    "calibration_changes": _RATED + """, j AS (SELECT a.trace_id, a.criticality AS o, coalesce(g.c, a.criticality) AS w FROM auto a LEFT JOIN (SELECT trace_id, idx, max(criticality) AS c FROM gold
  WHERE criticality <> 'optional' GROUP BY ALL) g ON g.trace_id = a.trace_id AND g.idx = a.idx)
SELECT count(*) AS items, count(*) FILTER (n > 0) AS items_changed, sum(d)::BIGINT AS demoted, sum(p)::BIGINT AS promoted FROM (SELECT trace_id, count(*) FILTER (o <> w) AS n, count(*) FILTER (o <> w
  AND w = 'supporting') AS d, count(*) FILTER (o <> w AND w <> 'supporting') AS p FROM j GROUP BY 1)""",
    "generation_stats": _RATED + """, p AS (SELECT trace_id, count(*) AS n, count(*) FILTER (criticality = 'critical') AS c, sum(length(description)) AS ms, max(criticality) AS dom FROM auto
  GROUP BY 1)
SELECT count(*) AS plans, count(DISTINCT dom) AS domains, round(avg(n), 9) AS avg_n_steps, round(avg(c), 9) AS avg_n_critical, round(avg(ms), 9) AS avg_ms FROM p""",
    "scan_audit": _AUDIT + f" SELECT file, CAST(line_no AS INT) AS line_no, label, severity, guard_status, CAST(bypass_line AS INT) AS bypass_line, has_sandbox, {_SCORE}::DOUBLE AS score FROM f",
    "scan_highest_severity": _AUDIT + " SELECT file, arg_min(severity, r) AS severity FROM f GROUP BY 1",
    "scan_ranked": _AUDIT + " SELECT file, CAST(line_no AS INT) AS line_no, label, severity FROM f ORDER BY r, file, line_no, label LIMIT 50",
    "scan_dangers": """WITH d AS (SELECT DISTINCT doc_id % 2 = 0 AS py, doc_id, doc_id % 13 AS k FROM documents),
p(k, py, label, severity, weakness) AS (VALUES (0, true, 'exec', 'critical', 'CWE-94'), (1, true, 'eval', 'critical', 'CWE-94'), (2, true, 'subprocess', 'critical', 'CWE-78'), (3, true, 'os.system',
  'critical', 'CWE-78'), (4, true, 'importlib', 'high', 'CWE-829'), (5, true, 'exec_module', 'high', 'CWE-829'),
  (6, true, 'pickle', 'critical', 'CWE-502'), (7, true, 'yaml.load', 'high', 'CWE-502'), (9, false, 'child_process', 'critical', 'CWE-78'), (10, false, 'new Function', 'critical', 'CWE-94'), (11,
  false, 'vm.runInContext', 'high', 'CWE-94'))
SELECT label, severity, weakness, 'unguarded' AS guard_status, 9.1::DOUBLE AS score, count(*) AS n FROM d JOIN p USING (k, py) GROUP BY ALL""",
    "graded_floors": f"""WITH g AS (SELECT round(l_discount * 10, 2) AS r, CASE WHEN l_tax < 0.005 THEN NULL WHEN l_tax < 0.015 THEN 'short' ELSE 'a quote that is long enough' END AS q,
  ['wrong source', 'used blog rather than the source, blog instead', 'cross-step evidence', 'plain', 'spans two trace steps', 'not the official page'][l_linenumber % 6 + 1] AS reason, ['[search] x',
  '[search] x [observe] y', 'tool call made', 'plain text', '[TOOL] run [EXTRACTED] z'][l_orderkey % 5 + 1] AS shown FROM lineitem),
x AS (SELECT *, CASE WHEN {_EXCERPT_BARE} THEN least(r, 0.25) ELSE r END AS a FROM g), y AS (SELECT *, CASE WHEN a > 0 AND a <= 0.5 AND reason IN ('wrong source',
  'used blog rather than the source, blog instead', 'not the official page') THEN 0 ELSE a END AS b0 FROM x),
z AS (SELECT *, CASE WHEN reason IN ('cross-step evidence', 'spans two trace steps') THEN least(b0, 0.4) ELSE b0 END AS b FROM y),
e AS (SELECT *, CASE WHEN b >= 0.5625 AND q IS NULL THEN 0.25 WHEN length(q) < 10 THEN least(b, 0.4) ELSE b END AS s, CASE WHEN a >= 0.5625 AND q IS NULL THEN 0.25 WHEN length(q) < 10 THEN least(a,
  0.4) ELSE a END AS f FROM z)
SELECT CASE WHEN s = 0 THEN 'skipped' WHEN s >= 0.5625 AND q IS NOT NULL THEN 'supported' WHEN s >= 0.25 THEN 'partial' ELSE 'unsupported' END AS support,
  CASE WHEN f >= 0.75 AND q IS NOT NULL THEN 'faithful' WHEN f >= 0.5625 THEN 'partially_faithful' WHEN f >= 0.25 THEN 'weakly_faithful' ELSE 'unfaithful' END AS faithfulness, count(*) AS n,
  round(sum(s), 4) AS s, round(sum(f), 4) AS f FROM e GROUP BY ALL""",
    "enrich_pages": "WITH " + TRACES + """, st AS (SELECT trace_id, annotator_metadata['source_url'] AS url, i, trace.steps[i] AS s FROM (SELECT *, unnest(range(1, len(trace.steps) + 1)) AS i
  FROM lt)),
k AS (SELECT trace_id, url, i, CASE WHEN s.tool = 'web_browser' THEN 'browse' ELSE s.kind END AS kind FROM st WHERE s IS NOT NULL), b AS (SELECT *, min(i) OVER (PARTITION BY trace_id) AS first FROM k
  WHERE kind = 'browse')
SELECT trace_id, CAST(i AS INT) AS step_pos, CASE WHEN i = first AND url IS NOT NULL THEN 'Page of ' || url || '|Head & ' || length(url) ELSE '' END AS added FROM b""",
    "signal_phrases": "SELECT DISTINCT id, CAST(len(list_filter(['how many', 'which', 'claim', 'prove', 'source'], lambda s: contains(lower(question), s))) AS INT) AS n_signals FROM blocks",
    "numbered_lists": """WITH t AS (SELECT DISTINCT task_id, list_filter(list_transform(string_split_regex(annotator_metadata['Steps'], '\\r?\\n'), lambda x: trim(regexp_replace(x,
  '^\\s*(?:\\d+[.)]|[-*•])\\s*', ''), ' ')), lambda x: x <> '') AS l FROM gaia_samples WHERE annotator_metadata['Steps'] IS NOT NULL)
SELECT DISTINCT task_id, CAST(i - 1 AS INT) AS i, l[i] AS item FROM (SELECT task_id, l, unnest(range(1, len(l) + 1)) AS i FROM t)""",
    "highest_scores": "SELECT best, count(*) AS n FROM (SELECT CASE greatest(l_discount, l_tax, round(l_quantity / 500, 2)) WHEN l_discount THEN 'discount' WHEN l_tax THEN 'tax' ELSE 'quantity' END AS best FROM lineitem) GROUP BY 1",
    "accuracy_mismatch_families": GOLD + """ SELECT CASE item_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'H' WHEN 2 THEN 'B' WHEN 3 THEN 'G' ELSE '?' END AS family, gold, verdict, count(*) AS n FROM lab
  WHERE gold <> verdict GROUP BY ALL""",
    "segment_diagnostics": RAW_PAIRS + f""", sp AS MATERIALIZED (SELECT a.trace_id, a.pos AS start_pos, l AS len, a.size, list_distinct(flatten(list(b.tokens))) AS tokens,
  list_distinct(flatten(list(b.tools))) AS tools, flatten(list(b.meanings ORDER BY b.pos)) AS fm
  FROM prof a, range(2, 5) r(l), prof b WHERE a.grp = 'annotator' AND b.grp = 'annotator' AND a.trace_id = b.trace_id AND b.pos BETWEEN a.pos AND a.pos + l - 1 AND a.pos + l - 1 <= a.size
  GROUP BY ALL),
sm AS (SELECT *, list_filter(fm, lambda t, i: list_position(fm, t) = i) AS meanings FROM sp),
sq AS MATERIALIZED (SELECT g.trace_id, g.step_id AS agent_id, start_pos, len, CASE WHEN len(g.meanings) <= len(s.meanings) THEN g.meanings ELSE s.meanings END AS small, CASE
  WHEN len(g.meanings) <= len(s.meanings) THEN s.meanings ELSE g.meanings END AS big,
  CASE WHEN len(g.tokens) = 0 OR len(s.tokens) = 0 THEN 0.0 ELSE len(list_intersect(g.tokens, s.tokens)) / (len(g.tokens) + len(s.tokens) - len(list_intersect(g.tokens,
  s.tokens)))::DOUBLE END AS lexical, CASE WHEN len(g.tools) = 0 OR len(s.tools) = 0 THEN 0.0 ELSE len(list_intersect(g.tools, s.tools)) / (len(g.tools) + len(s.tools) - len(list_intersect(g.tools,
  s.tools)))::DOUBLE END AS tool,
  1 - abs(CASE WHEN g.size = 1 THEN 0.5 ELSE (g.pos - 1) / (g.size - 1)::DOUBLE END - (start_pos + (len - 1) / 2 - 1) / (s.size - 1)::DOUBLE) AS position FROM prof g
  JOIN sm s ON g.trace_id = s.trace_id AND g.grp = 'agent:plan'),
sr AS (SELECT *, CASE WHEN len(small) = 0 THEN 0.0 ELSE {SOFT} END AS common FROM sq), su AS (SELECT *, CASE WHEN len(small) = 0 THEN 0.0
  ELSE common / (len(small) + len(big) - common) END AS semantic FROM sr),
sv AS (SELECT *, greatest(0.35 * lexical + 0.25 * semantic + 0.25 * position + 0.15 * tool, 0.5 * lexical + 0.3 * position + 0.2 * tool) AS sc FROM su),
sw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, agent_id ORDER BY round(sc, 12) DESC, start_pos, len) AS rn FROM sv) WHERE rn = 1)
SELECT trace_id, agent_id, CAST(start_pos AS INT) AS start_pos, CAST(len AS INT) AS len, round(sc, 9) AS score, round(top, 9) AS single_score, round(sc - top, 9) AS improvement FROM sw
  JOIN (SELECT trace_id, agent_id, max(score) AS top FROM scored GROUP BY ALL) USING (trace_id, agent_id)""",
    "line_break_quotes": _PROBES + """ SELECT trace_id, CASE WHEN q IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN qa THEN 'cross_line_fragment_tail' END, CASE
  WHEN qc THEN 'bridge_span_concat' END, CASE WHEN (qa OR qc) AND regexp_matches(q, '[A-Za-z\\[(]\\s*$') THEN 'mid_word_termination' END], lambda x: x IS NOT NULL), ',') END AS signals,
  CASE WHEN b IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN ba THEN 'cross_line_fragment_tail' END, CASE WHEN bc THEN 'bridge_span_concat' END, CASE WHEN (ba OR bc)
  AND regexp_matches(b, '[A-Za-z\\[(]\\s*$') THEN 'mid_word_termination' END], lambda x: x IS NOT NULL), ',') END AS bridge_signals FROM sig""",
    "line_break_sweep": _PROBES + """ SELECT count(*) AS sources, count(q) AS made, count(*) FILTER (qa OR qc) AS triggered, count(*) FILTER (qa) AS cross_line, count(*) FILTER ((qa OR qc)
  AND regexp_matches(q, '[A-Za-z\\[(]\\s*$')) AS mid_word, count(*) FILTER (qc) AS bridge,
  count(*) FILTER (qa::INT + qc::INT + ((qa OR qc) AND regexp_matches(q, '[A-Za-z\\[(]\\s*$'))::INT >= 2) AS several, count(b) AS bridges_made, count(*) FILTER (bc) AS bridges_found FROM sig""",
    "coerced_traces": "WITH " + TRACES + """, s AS (SELECT trace_id, i, st[i] AS s, answer FROM (SELECT trace_id, answer, list_filter(coalesce(trace.steps, []), lambda s: s IS NOT NULL
  AND coalesce(regexp_replace(s.summary, '^\\s+|\\s+$', '', 'g'), '') <> '') AS st, unnest(range(1, len(st) + 1)) AS i FROM lt)),
k AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(s."index", i), i) AS n, CASE WHEN lower(trim(s.kind)) IN ('observe', 'search', 'browse', 'read', 'reason',
  'calculate', 'answer') THEN lower(trim(s.kind)) ELSE 'reason' END AS kind, nullif(trim(s.tool), '') AS tool,
  regexp_replace(s.summary, '^\\s+|\\s+$', '', 'g') AS summary, coalesce(len(list_filter(s.evidence, lambda e: regexp_replace(e, '^\\s+|\\s+$', '', 'g') <> '')), -1) AS ne FROM s),
z AS (SELECT lt.trace_id, coalesce(nullif(regexp_replace(lt.answer, '^\\s+|\\s+$', '', 'g'), ''), 'Unable to determine a final answer.') AS answer, coalesce(m, 0) AS m, k.kind AS last FROM lt LEFT
  JOIN (SELECT trace_id, max(n) AS m FROM k GROUP BY 1) x USING (trace_id) LEFT JOIN k ON k.trace_id = lt.trace_id AND k.n = m)
SELECT trace_id, CAST(n AS INT) AS "index", kind, tool, summary, CAST(ne AS INT) AS n_evidence, answer FROM k JOIN z USING (trace_id) UNION ALL SELECT trace_id, CAST(m + 1 AS INT), 'answer', NULL,
  'Submitted the final answer: ' || answer, -1, answer FROM z WHERE coalesce(last, '') <> 'answer'""",
    "evidence_sources": "SELECT CASE WHEN l_linestatus = 'O' THEN 'answer' ELSE 'trace' END AS source, count(*) AS n FROM lineitem GROUP BY 1",
    "plan_span_selection": "WITH " + STEPS + """, c AS (SELECT * FROM steps WHERE grp = 'agent:exec') SELECT trace_id, coalesce(arg_min(step_id,
  {'p': idx, 's': step_id}) FILTER (contains(description, 'Compare')), arg_max(step_id, {'p': idx, 's': step_id})) AS span_id,
  CASE WHEN bool_or(coalesce(contains(description, 'Compare'), false)) THEN 'prompt_match' ELSE 'last_llm_call' END AS selection FROM c GROUP BY 1""",
    "text_attributes": "SELECT p_partkey, p_brand AS name, NULL::VARCHAR AS size FROM part",
    "evaluator_pairs": """WITH f AS (SELECT ['anthropic', 'openai', 'openai', 'openai', 'unknown', 'xai', 'moonshot', 'moonshot', 'deepseek', 'google', 'unknown', 'anthropic', 'unknown'] AS l),
  p AS (SELECT l[(p_partkey + 1) % 13 + 1] AS a, l[(p_partkey * 3 + 3) % 13 + 1] AS b, l[(p_partkey * 5 + 5) % 13 + 1] AS g FROM part, f)
SELECT CASE WHEN a = b THEN 'judges_share_family' WHEN a = g AND b = g THEN 'both_share_generator' WHEN a = g THEN 'primary_shares_generator'
  WHEN b = g THEN 'secondary_shares_generator' END AS problem, count(*) AS n FROM p GROUP BY 1""",
    "artifact_paths": """WITH f AS (SELECT ['a/traces.jsonl', 'b/traces-x-2026-01-02.jsonl', 'gold.json', 'c/gold-2026-01-02.json', 'source-claim.json', 'readme.md', 'traces.json'] AS l),
  p AS (SELECT [l[p_partkey % 7 + 1], l[p_partkey * 2 % 7 + 1], l[p_partkey * 3 % 7 + 1]] AS ps FROM part, f)
SELECT list_filter(ps, lambda x: x IN ('a/traces.jsonl', 'b/traces-x-2026-01-02.jsonl'))[1] AS trace, list_filter(ps, lambda x: x LIKE '%gold%')[1] AS gold, list_filter(ps,
  lambda x: x = 'source-claim.json')[1] AS source_claim, count(*) AS n FROM p GROUP BY ALL""",
    "boundary_breaks": """WITH f AS (SELECT doc_id::VARCHAR AS file, lower(text) AS t FROM documents) SELECT file, 'ledger in ones' AS message FROM f WHERE file LIKE '1%' AND contains(t, 'ledger')
  UNION ALL SELECT file, 'flood and museum, nothing missing' FROM f WHERE right(file, 1) IN ('0', '5') AND contains(t, 'flood') AND contains(t, 'museum') AND NOT contains(t, 'missing')
UNION ALL SELECT file, 'bales without an article' FROM f WHERE contains(t, 'wool bales') AND NOT contains(t, 'the')""",
    "acronyms": """SELECT p_partkey, 'AB' || p_partkey % 7 AS asked, CASE WHEN p_partkey % 7 = p_partkey % 5 THEN 'Alpha Brand-' || regexp_extract(lower(p_brand), '([0-9]+)',
  1) || ' (AB' || p_partkey % 5 || ')' END AS meaning FROM part""",
    "document_digest": """WITH f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS file, text FROM documents ORDER BY 1 LIMIT 10) SELECT left(string_agg('### ' || file || chr(10) || left(text, 300),
  chr(10) || chr(10) ORDER BY file), 2000) AS digest, count(*) AS n_files FROM f""",
    "calibration_scan": "SELECT domain, count(*) AS n, round(avg(score_given), 8) AS avg_score FROM (SELECT DISTINCT * FROM judge_runs WHERE role = 'critic' AND model = 'orla-2') GROUP BY 1",
    "question_domains": f"""WITH q AS (SELECT DISTINCT id, question || ' ' || coalesce(domain, '') || ' audit ' || coalesce(domain, '') AS q FROM blocks), c AS (SELECT id,
  {', '.join(f"len(regexp_extract_all(q, '{p}')) AS {n}" for n, p in R.DOMAINS.items())} FROM q)
SELECT CASE WHEN greatest(medical, legal, financial, technical) = 0 THEN 'general' WHEN medical = greatest(medical, legal, financial, technical) THEN 'medical' WHEN legal = greatest(legal, financial,
  technical) THEN 'legal' WHEN financial >= technical THEN 'financial' ELSE 'technical' END AS domain, count(*) AS n FROM c GROUP BY 1""",
    "near_miss_answers": "WITH " + TRACES + """, g AS (SELECT trace_id, question || ' ' || ground_truth AS t, length(question) % 5 AS k FROM lt WHERE ground_truth IS NOT NULL),
m AS (SELECT trace_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t, regexp_replace(CASE k WHEN 0 THEN t || ' as the page says' WHEN 1 THEN array_to_string(string_split(t, ' ')[1:8], ' ')
  WHEN 2 THEN 'not ' || t WHEN 3 THEN regexp_replace(t, '[0-9]', '7', 'g') ELSE 'A B. C. ' || array_to_string(string_split(t, ' ')[-6:], ' ') END, '^\\s+|\\s+$', '', 'g') AS a FROM g),
w AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(a), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS wa, list_filter(string_split_regex(regexp_replace(lower(t),
  '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS wt,
  list_distinct(list_filter(regexp_extract_all(a, NAMES), lambda x: x NOT IN ('The', 'A', 'An', 'By', 'In', 'On', 'At', 'For', 'Of'))) AS ea, list_distinct(list_filter(regexp_extract_all(t, NAMES),
  lambda x: x NOT IN ('The', 'A', 'An', 'By', 'In', 'On', 'At', 'For', 'Of'))) AS et FROM m),
c AS (SELECT *, list_filter(wa, lambda x: x NOT IN PLAIN) AS ca, list_filter(wt, lambda x: x NOT IN PLAIN) AS ct,
  list_filter(ea, lambda x: NOT list_contains(et, x)) AS lo, list_filter(et, lambda x: NOT list_contains(ea, x)) AS ro, len(list_intersect(ea, et)) AS es, list_filter(wa, lambda x: regexp_matches(x,
  '[0-9]')) AS na, list_filter(wt, lambda x: regexp_matches(x, '[0-9]')) AS nt FROM w),
f AS (SELECT *, (len(list_filter(ca, lambda x: x IN NEGATING)) > 0) <> (len(list_filter(ct, lambda x: x IN NEGATING)) > 0) AS negated,
  len(ea) > 0 AND len(et) > 0 AND (es >= 2 AND len(lo) > 0 AND len(ro) > 0 OR es >= 1 AND (len(lo) > 0) <> (len(ro) > 0) AND len(list_filter(list_concat(lo, ro), lambda x: length(replace(x, '.',
  '')) > 2)) = 0) AS other_names, len(list_intersect(list_distinct(ca), list_distinct(ct))) AS sh FROM c)
SELECT trace_id, CASE WHEN a = '' OR t = '' OR negated OR other_names OR (len(na) > 0 AND len(nt) > 0 AND len(list_intersect(na, nt)) = 0) THEN false WHEN contains(lower(a),
  lower(t)) THEN len(ca) <= len(ct) + 8 ELSE sh >= 3 AND sh / (len(list_distinct(ca)) + len(list_distinct(ct)) - sh) >= 0.25 END AS near, negated, other_names FROM f"""
    .replace("NAMES", "'(?:\\b[A-Z]{2,}\\b|\\b[A-Z][a-z]+\\b|\\b[A-Z]\\.)'").replace("PLAIN", "('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'was', 'were', 'with')")
    .replace("NEGATING", "('no', 'not', 'never', 'none', 'without', 'cannot', 'cant', 'doesnt', 'dont', 'isnt', 'arent', 'wasnt', 'werent', 'wont', 'didnt')"),
}
