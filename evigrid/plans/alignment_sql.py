"""SQL for DuckDB that states the alignment queries by comparing all steps of a trace, and by the sequential choice."""

from evigrid.functions.text import ALIASES
from evigrid.plans.reference_sql import CANDS, STEPS, tokens

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ALIASES.items()) + "}"
_ALIAS = "coalesce({m}[{t}], {t})"
_STEM = """CASE WHEN length({t}) <= 3 OR {t} = 'species' THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN {t}[:-4]
  WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN {t}[:-3] WHEN {t} LIKE '%es' AND length({t}) > 4 THEN {t}[:-3] WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND length({t}) > 4 THEN {t}[:-2] ELSE {t} END"""


def _semantic(column: str) -> str:
    """Aliased stems, distinct in order of first occurrence."""
    raw = f"list_filter({tokens(column, keep=False)}, lambda t: t <> '')"
    one = f"list_transform({raw}, lambda t: {_ALIAS.format(m=_MAP, t='t')})"
    two = f"list_transform({one}, lambda t: {_STEM.format(t='t')})"
    three = f"list_transform({two}, lambda t: {_ALIAS.format(m=_MAP, t='t')})"
    stop = "'the','a','an','to','for','of','and','or','in','on','with','by','from','into','via','step','search','find','use','using','then'"
    kept = f"list_filter({three}, lambda t: (length(t) > 2 OR t IN ('ai','api','cli','sql','db','ui','ux','qa','id')) AND t NOT IN ({stop}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


SIM = "(CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) >= 5 AND length({b}) >= 5 AND (starts_with({a}, {b}) OR starts_with({b}, {a})) THEN 0.92 WHEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) >= 0.82 THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) ELSE 0.0 END)"
_SIMS = f"list_transform(big, lambda x, i: CASE WHEN list_contains(acc.used, i) THEN 0.0 ELSE {SIM.format(a='e.t', b='x')} END)"
SOFT = f"""list_reduce(list_transform(small, lambda t: {{'t': t, 's': 0.0::DOUBLE, 'used': []::BIGINT[]}}),
  lambda acc, e: {{'t': '', 's': acc.s + list_max({_SIMS}), 'used': CASE WHEN list_max({_SIMS}) > 0 THEN list_append(acc.used, list_position({_SIMS}, list_max({_SIMS}))::BIGINT) ELSE acc.used END}},
  {{'t': '', 's': 0.0::DOUBLE, 'used': []::BIGINT[]}}).s"""
_PLACE = "1 - abs(CASE WHEN a.size = 1 THEN 0.5 ELSE (a.pos - 1) / (a.size - 1)::DOUBLE END - CASE WHEN b.size = 1 THEN 0.5 ELSE (b.pos - 1) / (b.size - 1)::DOUBLE END)"
_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"

_PROF = STEPS + f""", prof AS MATERIALIZED (SELECT trace_id, step_id, grp, row_number() OVER (PARTITION BY trace_id, grp ORDER BY idx, step_id) AS pos, count(*) OVER (PARTITION BY trace_id,
  grp) AS size,
  {tokens("coalesce(description, '')")} AS tokens, {_semantic("coalesce(description, '')")} AS meanings, list_distinct(coalesce(tools, [])) AS tools FROM steps)"""
RAW_PAIRS = "WITH RECURSIVE " + _PROF + f""", pairs AS MATERIALIZED (SELECT a.trace_id, a.step_id AS agent_id, b.step_id AS annotator_id, a.pos AS apos, b.pos AS bpos, {_PLACE} AS position,
  {_JAC.format(a='a.tokens', b='b.tokens')} AS lexical, {_JAC.format(a='a.tools', b='b.tools')} AS tool,
  CASE WHEN len(a.meanings) <= len(b.meanings) THEN a.meanings ELSE b.meanings END AS small, CASE WHEN len(a.meanings) <= len(b.meanings) THEN b.meanings ELSE a.meanings END AS big
  FROM prof a JOIN prof b ON a.trace_id = b.trace_id AND a.grp = 'agent:plan' AND b.grp = 'annotator'),
soft AS MATERIALIZED (SELECT *, CASE WHEN len(small) = 0 THEN 0.0 ELSE {SOFT} END AS common FROM pairs),
raw AS MATERIALIZED (SELECT *, CASE WHEN len(small) = 0 THEN 0.0 ELSE common / (len(small) + len(big) - common) END AS semantic FROM soft),
scored AS MATERIALIZED (SELECT trace_id, agent_id, annotator_id, apos, bpos, position, lexical, semantic, tool, lexical + semantic + tool > 0 AS has_content,
  greatest(0.35 * lexical + 0.25 * semantic + 0.25 * position + 0.15 * tool, 0.5 * lexical + 0.3 * position + 0.2 * tool) AS score FROM raw),
ok AS MATERIALIZED (SELECT * FROM scored WHERE has_content AND score + 1e-9 >= 0.25),
best AS (SELECT trace_id, annotator_id, agent_id, score, has_content FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, annotator_id ORDER BY round(score, 12) DESC, apos) AS rn FROM scored)
  WHERE rn = 1)"""


def _greedy(third: str) -> str:
    """The sequential choice: annotator steps in order each take the best agent step that is still free."""
    return f""", ord AS MATERIALIZED (SELECT trace_id, annotator_id, row_number() OVER (PARTITION BY trace_id ORDER BY n, top DESC, bpos, annotator_id) AS k, wants FROM (
  SELECT trace_id, annotator_id, min(bpos) AS bpos, count(*) AS n, max(round(score, 12)) AS top,
    list(agent_id ORDER BY round(score, 12) DESC, round(position, 12) DESC, {third}lexical DESC, apos, agent_id DESC) AS wants FROM ok GROUP BY ALL)),
g AS (SELECT trace_id, 0::BIGINT AS k, NULL::VARCHAR AS annotator_id, NULL::VARCHAR AS agent_id, []::VARCHAR[] AS used FROM (SELECT DISTINCT trace_id FROM ord)
  UNION ALL SELECT o.trace_id, o.k, o.annotator_id, list_filter(o.wants, lambda w: NOT list_contains(g.used, w))[1], list_append(g.used, list_filter(o.wants, lambda w: NOT list_contains(g.used,
  w))[1])
  FROM g JOIN ord o ON o.trace_id = g.trace_id AND o.k = g.k + 1),
done AS MATERIALIZED (SELECT g.trace_id, g.annotator_id, g.agent_id, ok.score FROM g JOIN ok USING (trace_id, annotator_id, agent_id))"""


LEX = CANDS.replace("WITH ", "WITH RECURSIVE ", 1).replace("a.pos AS apos,", f"a.pos AS apos, b.pos AS bpos, {_PLACE} AS position, cw / greatest(len(a.tokens) + len(b.tokens) - cw, 1) AS lexical,") + _greedy("")
SEM = RAW_PAIRS + _greedy("round(semantic, 12) DESC, ")
_ANN = "ann AS (SELECT trace_id, step_id AS annotator_id FROM prof WHERE grp = 'annotator')"
_FREE = f", {_ANN}, free AS (SELECT trace_id, annotator_id FROM ann ANTI JOIN done USING (trace_id, annotator_id))"

ORACLE = {
    "align_greedy": LEX + " SELECT trace_id, annotator_id, agent_id, round(score, 9) AS score FROM done",
    "align_coverage": LEX + f", {_ANN} SELECT trace_id, count(*) AS n_steps, count(score) AS n_covered, round(count(score) / count(*), 9) AS coverage FROM ann LEFT JOIN done USING (trace_id, annotator_id) GROUP BY 1",
    "align_gaps": LEX + _FREE + """ SELECT trace_id, annotator_id, round(coalesce(top, 0), 9) AS best_score, top IS NOT NULL AS conflict FROM free LEFT JOIN (SELECT trace_id, annotator_id,
  max(score) AS top FROM ok GROUP BY ALL) USING (trace_id, annotator_id)""",
    "align_semantic_candidates": RAW_PAIRS + " SELECT trace_id, agent_id, annotator_id, round(semantic, 9) AS semantic, round(score, 9) AS score FROM ok",
    "align_semantic_greedy": SEM + " SELECT trace_id, annotator_id, agent_id, round(score, 9) AS score FROM done",
    "align_gap_descriptions": SEM + _FREE + """ SELECT trace_id, annotator_id, agent_id AS best_agent_id, round(coalesce(score, 0), 9) AS best_score,
  coalesce('best candidate: ' || agent_id || ' scored ' || format('{:.2f}', floor(round(score, 9) * 100 + 0.5) / 100) || ' (threshold 0.25)', 'no agent plan steps to compare') AS reason FROM free
  LEFT JOIN best USING (trace_id, annotator_id)""",
    "align_conflicts": SEM + _FREE + " SELECT ok.trace_id, ok.annotator_id, ok.agent_id, round(ok.score, 9) AS score, done.annotator_id AS held_by FROM ok JOIN free USING (trace_id, annotator_id) LEFT JOIN done ON done.trace_id = ok.trace_id AND done.agent_id = ok.agent_id",
    "align_content_gate": RAW_PAIRS + f", {_ANN} SELECT b.trace_id, b.annotator_id, b.agent_id, round(b.score, 9) AS score FROM (SELECT trace_id, annotator_id FROM ann ANTI JOIN ok USING (trace_id, annotator_id)) JOIN best b USING (trace_id, annotator_id) WHERE b.score + 1e-9 >= 0.25",
    "align_risk_flags": SEM + _FREE + """ SELECT trace_id, annotator_id AS step_id, 'missing_step' AS flag, CASE WHEN coalesce(score, 0) >= 0.1875 THEN 'medium' ELSE 'high' END AS severity FROM free
  LEFT JOIN best USING (trace_id, annotator_id)
UNION ALL SELECT p.trace_id, p.step_id, 'gap', 'medium' FROM prof p LEFT JOIN done d ON d.trace_id = p.trace_id AND d.agent_id = p.step_id WHERE p.grp = 'agent:plan' AND d.agent_id IS NULL""",
    "align_near_misses": SEM + _FREE + " SELECT trace_id, annotator_id, agent_id, round(score, 9) AS score FROM free JOIN best USING (trace_id, annotator_id) WHERE score >= 0.25 - 0.1 AND score < 0.25",
    "semantic_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_semantic('description')}) AS token FROM (SELECT DISTINCT description FROM plan_steps WHERE description IS NOT NULL)) GROUP BY 1",
}

#: Lexical tokens of COL, distinct in order; and the greedy overlap of the lists small and big.
_KEPT = tokens("COL").replace("list_distinct(", "(", 1)
PROF_COLUMNS = (f"list_filter({_KEPT}, lambda t, i: list_position({_KEPT}, t) = i)", SOFT)
