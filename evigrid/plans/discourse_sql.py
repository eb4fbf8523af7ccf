"""SQL for DuckDB that states the queries of discussion, entailment, provenance and stability independently of the operators."""

from evigrid.plans.alignment_sql import LEX, PROF_COLUMNS, SEM
from evigrid.plans.reference_sql import AB, GOLD, QUOTE, TRACES

_SYN = """syn AS (SELECT block_id, max(pos) AS last, arg_max(coalesce(content, ''), {'p': pos, 'c': coalesce(content, '')}) AS synthesis FROM proposals GROUP BY 1),
mem AS (SELECT p.block_id, p.pos, p.content, p.pos || ':' || p.model AS member FROM (SELECT block_id, pos, max(content) AS content, max(model) AS model FROM proposals GROUP BY ALL) p
  JOIN syn USING (block_id) WHERE p.pos < last)"""
_KW = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-zäöüß0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 4)"
_COV = "WITH " + _SYN + f""", kw AS (SELECT m.block_id, member, {_KW.format("coalesce(content, '')")} AS k, {_KW.format('synthesis')} AS held FROM mem m JOIN syn USING (block_id)),
cov AS (SELECT block_id, member, CASE WHEN len(k) = 0 THEN 0 ELSE len(list_filter(k, lambda w: list_contains(held, w))) / len(k)::DOUBLE END AS coverage FROM kw),
sh AS (SELECT *, sum(coverage) OVER w AS total, count(*) OVER w AS n, CASE WHEN sum(coverage) OVER w > 0 THEN coverage / sum(coverage) OVER w ELSE 1 / count(*) OVER w END AS share
  FROM cov WINDOW w AS (PARTITION BY block_id)),
bal AS (SELECT block_id, max(n) AS n_members, round(greatest(0, 1 - avg(abs(share - 1 / n) * n)), 4) AS score, max(CASE WHEN share > 0.6 THEN member END) AS dominated_by, max(CASE
  WHEN share > 0.6 THEN share END) AS top FROM sh GROUP BY 1),
bal2 AS (SELECT *, coalesce(CASE WHEN n_members > 1 THEN (1 - top) / (n_members - 1) END < 0.15, false) AS justified FROM bal)"""
_MARKS = "'however','incorrect','wrong','unverified','fails','hallucination','no evidence','questionable','not supported','inaccurate','misleading','contradicts','unsupported','no proof','unfounded','disputed','lacks evidence','cannot be verified','not accurate'"
_COMMON = "'would','could','should','their','there','about','other','these','those','which','where','while','though','between','because','after','before','under','since','every','being','using','through','within','during','against','without','always','often','model','models','agent','agents','output','claim','claims','point','points','argument','arguments'"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SEGS = f"""list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(critique, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '^[-*•]\\s+|^\\d+\\.\\s+') THEN [regexp_replace(x, '^[-*•\\d.]\\s+', '')] ELSE string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'),
  chr(1)) END)), lambda x: {_TRIM.format('x')}), lambda x: length(x) > 10)"""
_TERMS = f"list_filter(string_split_regex(regexp_replace(lower(x), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 4 AND w NOT IN ({_COMMON}))[1:6]"
_DPR = _COV + f""", crit AS (SELECT block_id, critique_id, replace(replace(replace(critique, 'disputes', 'disputed'), 'although', 'however'), 'missing', 'unverified') AS critique FROM (
  SELECT DISTINCT block_id, 'run:' || id AS critique_id, overall_assessment AS critique FROM judge_runs WHERE overall_assessment IS NOT NULL UNION ALL SELECT block_id, 'pos:' || pos, content FROM mem
  WHERE content IS NOT NULL)),
seg AS (SELECT c.block_id, critique_id, lower(coalesce(synthesis, '')) AS s, coalesce(NOT justified AND dominated_by IS NOT NULL, false) AS warned,
  list_filter({_SEGS}, lambda x: len(list_filter([{_MARKS}], lambda m: contains(lower(x), m))) > 0) AS segs FROM crit c LEFT JOIN syn USING (block_id) LEFT JOIN bal2 USING (block_id)),
ter AS (SELECT *, list_transform(segs, lambda x: {_TERMS}) AS ts FROM seg),
kep AS (SELECT *, len(ts) AS objections, len(list_filter(ts, lambda t: len(list_filter(t, lambda w: contains(s, w))) >= CASE WHEN len(t) >= 6 THEN 2 ELSE greatest(1,
  ceil(len(t) * 0.25)) END)) AS preserved FROM ter),
sco AS (SELECT *, CASE WHEN objections = 0 THEN 1 ELSE round(preserved / objections, 4) END AS score FROM kep)"""

_N = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'), ' ')"
_NEG = "regexp_matches(s, '(?:^|\\b)(?:not|no|never|without)(?:\\W+\\w+){0,3}\\W+' || array_to_string(list_transform(string_split({a}, ' '), lambda t: regexp_escape(t)), '\\W+') || '(?:\\b|$)')"
_USABLE = "contains(l, p) AND (len(list_filter(ss, lambda s: contains(s, p))) = 0 OR len(list_filter(list_filter(ss, lambda s: contains(s, p)), lambda s: NOT " + _NEG.replace("{a}", "p") + ")) > 0)"
_WS = "list_distinct(list_filter(string_split_regex({}, '\\W+'), lambda t: t <> ''))"


def _entail(rows: str) -> str:
    """rows: key, question, answer, source."""
    return f"""n AS (SELECT k, question, {_TRIM.format('answer')} AS span, {_N.format('answer')} AS a, {_N.format('source')} AS l,
  list_transform(list_filter(list_transform(string_split_regex(source, '[.!?\\n]+'), lambda s: {_TRIM.format('s')}), lambda s: length(s) > 2), lambda s: {_N.format('s')}) AS ss FROM ({rows})),
h AS (SELECT *, list_filter(ss, lambda s: contains(s, a)) AS hold, list_filter(list_transform(CASE WHEN regexp_matches(a, '[;,]') THEN string_split_regex(a, '[;,]') ELSE [] END, lambda p: trim(p,
  ' ')), lambda p: p <> '') AS parts, {_WS.format('a')} AS aw,
  len(list_filter(['exactly as it appears','exactly as they appear','word for word','verbatim','exact wording','exact phrase','exact name','exact title','exact text','quote the exact','exact sentence','exact one-line','one-line description'], lambda e: contains(lower(question), e))) > 0 OR regexp_matches(question, '(?i)as given in the .* lede') AS exact FROM n),
j AS (SELECT *, coalesce(list_max(list_transform(ss, lambda s: CASE WHEN len(aw) + len({_WS.format('s')}) = 0 THEN 1.0 ELSE len(list_intersect(aw,
  {_WS.format('s')})) / (len(aw) + len({_WS.format('s')}) - len(list_intersect(aw, {_WS.format('s')})))::DOUBLE END)), 0) AS best FROM h),
r AS (SELECT *, a <> '' AND contains(l, a) AS found, len(hold) > 0 AND len(list_filter(hold, lambda s: NOT {_NEG.replace('{a}', 'a')})) = 0 AS negated, len(parts) >= 2 AND len(list_filter(parts,
  lambda p: NOT ({_USABLE}))) = 0 AS composed FROM j),
e AS (SELECT *, CASE WHEN found AND negated THEN 'unsupported' WHEN found THEN 'exact' WHEN composed OR (a <> '' AND best >= 0.5) THEN 'paraphrase' ELSE 'unsupported' END AS support,
  CASE WHEN found THEN 'high' WHEN composed THEN 'medium' WHEN a <> '' AND best >= 0.7 THEN 'high' WHEN a <> '' AND best >= 0.5 THEN 'medium' WHEN exact THEN 'high' ELSE 'medium' END AS confidence
  FROM r)"""


_EVID = "array_to_string(list_filter(flatten(list_transform(trace.steps, lambda s: coalesce(s.evidence, []))), lambda e: e IS NOT NULL), chr(10))"
_EVID2 = "array_to_string(list_filter(flatten(list_transform(list_filter(coalesce(trace.steps, []), lambda s: s IS NOT NULL), lambda s: coalesce(s.evidence, []))), lambda e: e <> ''), chr(10))"

_CLEAN = "trim(regexp_replace(regexp_replace({}, '\\.{{2,}}\\s*$', ''), '…\\s*$', ''), ' ')"
_FRAG = "list_filter(list_transform(string_split_regex({}, '\\.{{2,}}|…'), lambda f: trim(regexp_replace(f, '\\s+', ' ', 'g'), ' ')), lambda f: length(f) >= 8)"
_LEFT = "regexp_replace({}, '(?m)^[ \\t]+', '', 'g')"
_DIAG = QUOTE + f""", c AS (SELECT *, {_CLEAN.format('quote')} AS cl, coalesce(source, '') AS so FROM q),
fr AS (SELECT *, {_FRAG.format('cl')} AS fs, regexp_replace(regexp_replace(so, '(?m)^\\s+', '', 'g'), '\\s+', ' ', 'g') AS flat FROM c),
fo AS (SELECT *, len(fs) > 0 AND list_reduce(list_transform(fs, lambda f: {{'f': f, 'at': 1::BIGINT}}), lambda acc,
  x: {{'f': x.f, 'at': CASE WHEN acc.at > 0 AND strpos(flat[acc.at:], x.f) > 0 THEN acc.at + strpos(flat[acc.at:], x.f) - 1 + length(x.f) ELSE 0 END}}, {{'f': '', 'at': 1::BIGINT}}).at > 0 AS inorder
  FROM fr),
pa AS (SELECT *, CASE WHEN contains(so, cl) OR contains(so, quote) THEN 'exact' WHEN contains({_LEFT.format('so')}, {_LEFT.format('cl')}) THEN 'whitespace-normalized'
  WHEN inorder THEN 'fuzzy-truncated' ELSE 'no-match' END AS match_path FROM fo),
pr AS (SELECT *, CAST(coalesce(list_max(list_filter(range(8, length(cl) + 1), lambda n: contains(so, left(cl, n)))), 0) AS INT) AS prefix FROM pa),
po AS (SELECT *, CASE WHEN prefix > 0 THEN CAST(strpos(so, left(cl, prefix)) - 1 AS INT) ELSE -1 END AS position FROM pr),
sg AS (SELECT *, CASE WHEN position >= 0 THEN so[greatest(position - 4, 1):greatest(position - 4, 1) + length(cl) + 4 + least(position, 5)] ELSE '' END AS win FROM po),
si AS (SELECT *, list_filter([CASE WHEN SIGQ <> '' THEN 'quote:' || SIGQ END, CASE WHEN SIGW <> '' THEN 'trace:' || SIGW END, CASE WHEN len(regexp_extract_all(left(cl, 80),
  '["''‘’“”]')) >= 3 THEN 'structural_meta_quote' END], lambda x: x IS NOT NULL) AS sig FROM sg),
di AS (SELECT *, CASE WHEN match_path <> 'no-match' THEN 'matched' WHEN len(list_filter(sig, lambda x: regexp_matches(x, '^(quote|trace):'))) > 0 THEN 'mode_1_tokenization' WHEN list_contains(sig,
  'structural_meta_quote') THEN 'mode_3_structural'
  WHEN prefix >= 8 AND prefix < 0.6 * length(cl) THEN 'mode_2_paraphrase' ELSE 'inconclusive' END AS mode FROM si)"""
_SIGS = "array_to_string(list_filter([CASE WHEN regexp_matches({x}, '[‘’]') THEN 'smart_apostrophe' END, CASE WHEN regexp_matches({x}, '[“”]') THEN 'smart_quote' END, CASE WHEN regexp_matches({x}, '\\x{{00A0}}') THEN 'nbsp' END, CASE WHEN regexp_matches({x}, '[–—]') THEN 'en_or_em_dash' END, CASE WHEN regexp_matches({x}, '…') THEN 'ellipsis_char' END, CASE WHEN regexp_matches({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]') THEN 'zero_width_space' END, CASE WHEN regexp_matches({x}, '\\r') THEN 'crlf_newline' END], lambda s: s IS NOT NULL), ',')"
_DIAG = _DIAG.replace("SIGQ", _SIGS.format(x="cl")).replace("SIGW", _SIGS.format(x="win"))

_CASES = AB + """, flips AS (SELECT CASE WHEN a = b THEN NULL WHEN a = 'BLOCK' AND b LIKE '%ALLOW' THEN 'safety' WHEN a LIKE '%ALLOW' AND b = 'BLOCK' THEN 'cross' ELSE 'adjacent' END AS kind FROM two)"""
_DELTA = ", dl AS (SELECT item_id, step_no, x, y, abs(x - y) AS delta FROM (SELECT item_id, step_no, max({'t': shipped, 's': ra}).s AS x, max({'t': shipped, 's': rb}).s AS y FROM raw GROUP BY 1, 2))"
_LOO = GOLD + ", t AS (SELECT count(*) AS n, count(*) FILTER (gold = verdict) AS c FROM lab), loo AS (SELECT item_id, CAST(gold = verdict AS INT) AS hit, (c - CAST(gold = verdict AS INT)) / (n - 1)::DOUBLE AS w, c / n::DOUBLE AS acc FROM lab, t)"

# spans of one to four annotator steps against all agent steps of their trace
_SPANS = LEX + f""", sp AS MATERIALIZED (SELECT a.trace_id, a.pos AS start_pos, l AS len, a.size, list(b.step_id ORDER BY b.pos) AS ids, list_distinct(flatten(list(b.tokens))) AS tokens,
  list_distinct(flatten(list(b.tools))) AS tools
  FROM prof a, range(1, 5) r(l), prof b WHERE a.grp = 'annotator' AND b.grp = 'annotator' AND a.trace_id = b.trace_id AND b.pos BETWEEN a.pos AND a.pos + l - 1 AND a.pos + l - 1 <= a.size
  GROUP BY ALL),
ss AS (SELECT g.trace_id, g.step_id AS agent_id, start_pos, len, ids, len(list_intersect(g.tokens, s.tokens)) AS cw, len(list_intersect(g.tools, s.tools)) AS ct,
  0.5 * len(list_intersect(g.tokens, s.tokens)) / greatest(len(g.tokens) + len(s.tokens) - len(list_intersect(g.tokens, s.tokens)), 1) + 0.3 * (1 - abs(CASE WHEN g.size = 1 THEN 0.5
  ELSE (g.pos - 1) / (g.size - 1)::DOUBLE END - CASE WHEN s.size = 1 THEN 0.5 ELSE (start_pos + (len - 1) / 2 - 1) / (s.size - 1)::DOUBLE END))
  + 0.2 * len(list_intersect(g.tools, s.tools)) / greatest(len(g.tools) + len(s.tools) - len(list_intersect(g.tools, s.tools)), 1) AS score FROM prof g JOIN sp s ON g.trace_id = s.trace_id
  AND g.grp = 'agent:plan'),
sb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, agent_id ORDER BY round(score, 12) DESC, start_pos, len) AS rn FROM ss WHERE cw + ct > 0
  AND score + 1e-9 >= 0.25) WHERE rn = 1)"""


# match paths of any pair of columns; of the compatibility forms only those that the tables hold (no-break space, ellipsis)
_NF = "replace(replace({}, chr(160), ' '), '…', '...')"
_FOLD = "replace(translate({}, '‘’‚‛“”„‟–—​‌‍﻿', '" + "''" * 4 + '"' * 4 + "--'), '…', '...')"
_ORDERED = (
    "(len({f}) > 0 AND list_reduce(list_transform({f}, lambda f: {{'f': f, 'at': 1::BIGINT}}), lambda acc, x: {{'f': x.f, 'at': CASE WHEN acc.at > 0 AND strpos(({fl})[acc.at:], x.f) > 0 "
    "THEN acc.at + strpos(({fl})[acc.at:], x.f) - 1 + length(x.f) ELSE 0 END}}, {{'f': '', 'at': 1::BIGINT}}).at > 0)"
)
_QUOTES = "('\"', '''', '‘', '’', '“', '”')"
_UNWRAP = "CASE WHEN length(trim({x}, ' ')) >= 2 AND left(trim({x}, ' '), 1) IN " + _QUOTES + " AND right(trim({x}, ' '), 1) IN " + _QUOTES + " THEN substr(trim({x}, ' '), 2, length(trim({x}, ' ')) - 2) ELSE {x} END"


def _plain_path(q: str, s: str) -> str:
    c, flat = _CLEAN.format(q), f"regexp_replace(regexp_replace({s}, '(?m)^\\s+', '', 'g'), '\\s+', ' ', 'g')"
    ordered = _ORDERED.format(f=_FRAG.format(c), fl=flat)
    return f"CASE WHEN contains({s}, {c}) OR contains({s}, {q}) THEN 'exact' WHEN contains({_LEFT.format(s)}, {_LEFT.format(c)}) THEN 'whitespace-normalized' WHEN {ordered} THEN 'fuzzy-truncated' ELSE 'no-match' END"


def _full_path(rows: str) -> str:
    """rows: any columns with q and s; adds before (plain paths) and path (all of them)."""
    c = _CLEAN.format("nq")
    bare = _UNWRAP.format(x=c)
    return f"""nf AS (SELECT *, {_NF.format('q')} AS nq, {_NF.format('s')} AS ns FROM ({rows})), p1 AS (SELECT *, CASE WHEN q IS NOT NULL AND s IS NOT NULL THEN {_plain_path('q', 's')} END AS before,
  {_plain_path('nq', 'ns')} AS again FROM nf),
p2 AS (SELECT *, CASE WHEN before <> 'no-match' OR before IS NULL THEN before WHEN again <> 'no-match' THEN 'unicode-normalized' WHEN contains({_FOLD.format('ns')},
  {_FOLD.format(c)}) THEN 'unicode-normalized'
  WHEN {bare} <> {c} AND contains({_FOLD.format('ns')}, {_FOLD.format(bare)}) THEN 'structural-unwrapped' ELSE 'no-match' END AS path FROM p1)"""


_PARTS = "string_split(quote, ' ')"
_MID = f"len({_PARTS}) // 2"
_VARIANTS = (
    "[{'k': 'plain', 't': quote}, {'k': 'smart', 't': translate(quote, '''\"', '’”')}, {'k': 'dash', 't': translate(quote, '-', '—')}, {'k': 'ellipsis', 't': quote || '...'}, {'k': 'wrapped', 't': '\"' || quote || '\"'}, "
    f"{{'k': 'swapped', 't': CASE WHEN len({_PARTS}) >= 4 THEN array_to_string(list_concat(list_concat({_PARTS}[1:{_MID} - 1], [{_PARTS}[{_MID} + 1], {_PARTS}[{_MID}]]), {_PARTS}[{_MID} + 2:]), ' ') ELSE quote END}}]"
)


_NESTED = lambda name, sql: f"{name} AS MATERIALIZED ({sql}), "
_MERGED = _SPANS.replace("WITH RECURSIVE ", "WITH RECURSIVE " + _NESTED("ex", LEX.replace("agent:plan", "agent:exec") + " SELECT trace_id, annotator_id FROM done"), 1) + """, ann AS (SELECT trace_id, step_id AS annotator_id FROM prof WHERE grp = 'annotator'),
runs AS (SELECT DISTINCT trace_id, unnest(ids) AS annotator_id FROM sb),
mg AS (SELECT a.trace_id, a.annotator_id, d.agent_id IS NOT NULL AS p, x.annotator_id IS NOT NULL AS e, r.annotator_id IS NOT NULL AS s FROM ann a LEFT JOIN done d USING (trace_id, annotator_id) LEFT
  JOIN ex x ON x.trace_id = a.trace_id AND x.annotator_id = a.annotator_id LEFT JOIN runs r ON r.trace_id = a.trace_id AND r.annotator_id = a.annotator_id),
m2 AS (SELECT trace_id, annotator_id, CASE WHEN (p OR s) AND e THEN 'both' WHEN p OR s THEN 'plan' WHEN e THEN 'execution' ELSE 'none' END AS source, CASE WHEN p AND s THEN 'single_step_and_segment'
  WHEN p THEN 'single_step' WHEN s THEN 'segment_only' ELSE 'none' END AS kind FROM mg)"""
_BENCH = SEM.replace("WITH RECURSIVE ", "WITH RECURSIVE " + _NESTED("lexs", LEX + " SELECT trace_id, count(*) AS k FROM done GROUP BY 1"), 1) + """, base AS (SELECT trace_id, count(*) AS n_steps FROM prof WHERE grp = 'annotator' GROUP BY 1),
m AS (SELECT b.trace_id, n_steps, coalesce(l.k, 0) AS lc, coalesce(s.k, 0) AS sc FROM base b LEFT JOIN lexs l USING (trace_id) LEFT JOIN (SELECT trace_id, count(*) AS k FROM done
  GROUP BY 1) s USING (trace_id))"""

ORACLE = {
    "merged_support": _MERGED + " SELECT * FROM m2",
    "support_flags": _MERGED + " SELECT trace_id, annotator_id, CASE source WHEN 'none' THEN 'truly_missing_step' ELSE 'plan_gap' END AS flag, CASE source WHEN 'none' THEN 'high' ELSE 'medium' END AS severity FROM m2 WHERE source IN ('none', 'execution')",
    "align_mode_summary": _BENCH + """ SELECT mode, count(*) AS traces, round(avg(c), 9) AS mean_coverage, round(min(c), 9) AS min_coverage, round(max(c), 9) AS max_coverage,
  sum(k)::BIGINT AS covered, sum(n_steps - k)::BIGINT AS uncovered
FROM (SELECT 'lexical' AS mode, lc / n_steps AS c, lc AS k, n_steps FROM m UNION ALL SELECT 'semantic', sc / n_steps, sc, n_steps FROM m) GROUP BY 1""",
    "synthesis_coverage": _COV + " SELECT block_id, member, round(coverage, 9) AS coverage, round(share, 9) AS share FROM sh",
    "synthesis_balance": _COV + " SELECT block_id, n_members, score, dominated_by, justified AS dominance_justified, dominated_by IS NOT NULL AND NOT justified AS warning FROM bal2",
    "objection_preservation": _DPR + " SELECT block_id, critique_id, CAST(objections AS INT) AS objections, CAST(preserved AS INT) AS preserved, score, score < 0.4 AND warned AND objections >= 2 AS false_consensus, array_to_string(list_filter(flatten(ts), lambda w, i: list_position(flatten(ts), w) = i)[1:20], ' ') AS keywords FROM sco",
    "claim_support": "WITH " + TRACES + ", " + _entail(f"SELECT trace_id AS k, question, answer, coalesce({_EVID}, '') AS source FROM lt WHERE answer IS NOT NULL") + " SELECT k AS trace_id, support, confidence, exact AS exact_question, CASE WHEN support = 'exact' THEN span END AS matched_span FROM e",
    "source_claim_join": "WITH " + TRACES + ", known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at DESC) AS rk FROM (SELECT DISTINCT * FROM gaia_traces) WHERE trim(ground_truth) <> '' AND trace_id IS NOT NULL) WHERE rk = 1), "
    + _entail(f"SELECT trace_id AS k, question, ground_truth AS answer, coalesce({_EVID2}, '') AS source FROM known")
    + " SELECT lt.trace_id, lt.task_id, support, confidence, CASE WHEN support = 'exact' THEN span END AS matched_span FROM lt LEFT JOIN e ON e.k = lt.trace_id",
    "quote_diagnosis": _DIAG + """ SELECT report_id, match_path, CASE WHEN match_path = 'no-match' THEN prefix END AS prefix, CASE WHEN match_path = 'no-match' THEN position END AS position,
  CASE WHEN match_path = 'no-match' THEN trim(regexp_replace(lower(left(hex(encode(cl)), 120)), '(..)', '\\1 ', 'g'), ' ') END AS quote_hex, CASE
  WHEN match_path = 'no-match' THEN array_to_string(sig, ' ') ELSE '' END AS signals, mode FROM di""",
    "quote_path_distribution": _DIAG + " SELECT match_path, count(*) AS n FROM di GROUP BY 1",
    "quote_match_paths": QUOTE + ", " + _full_path("SELECT report_id, model, quote AS q, source AS s FROM q") + f""" SELECT report_id, model, path AS match_path,
  array_to_string(list_filter([CASE WHEN path = 'no-match' THEN 'PROV_FAIL_02' WHEN path IS NOT NULL AND path <> 'exact' THEN 'PROV_INFO_07' END, CASE
  WHEN length({_CLEAN.format('q')}) < 10 THEN 'PROV_WARN_06' END], lambda x: x IS NOT NULL), ',') AS codes FROM p2""",
    "quote_variants": QUOTE + ", va AS (SELECT source AS s, unnest(" + _VARIANTS + ") AS v FROM q), " + _full_path("SELECT v.k AS kind, v.t AS q, s FROM va") + " SELECT kind, path AS match_path, count(*) AS n FROM p2 GROUP BY ALL",
    "quote_probe_sweep": QUOTE + ", va AS (SELECT source AS s, unnest(" + _VARIANTS + ") AS v FROM q WHERE source IS NOT NULL), " + _full_path("SELECT v.k AS kind, v.t AS q, s FROM va")
    + " SELECT kind, count(*) AS probes, count(*) FILTER (before <> 'no-match') AS before, count(*) FILTER (path <> 'no-match') AS after, count(*) FILTER (path <> 'no-match') - count(*) FILTER (before <> 'no-match') AS gained FROM p2 GROUP BY 1",
    "loocv_summary": _LOO + """, s AS (SELECT count(*) AS n, sum(hit) AS correct, avg(w) AS mean, stddev_samp(w) AS deviation, min(w) AS least, max(w) AS greatest, sum(hit) / count(*) AS p FROM loo)
SELECT n, correct::BIGINT AS correct, round(mean, 9) AS mean, round(deviation, 12) AS deviation, round(least, 9) AS least, round(greatest, 9) AS greatest, round(p, 9) AS accuracy,
  round((p + 1.9208 / n - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 9) AS low,
  round((p + 1.9208 / n + 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 9) AS high, p >= 0.3 AS passes FROM s""",
    "loocv_influential": _LOO + " SELECT item_id, round(w - acc, 12) AS impact, CASE WHEN w > acc THEN 'removal improves' ELSE 'removal hurts' END AS direction FROM loo WHERE abs(w - acc) > 1e-6",
    "verdict_mismatches": GOLD + " SELECT item_id, gold, verdict FROM lab WHERE gold <> verdict",
    "case_families": "SELECT ['D', 'H', 'C', 'B', 'G', 'B', 'C', 'D', 'H', '?', '?'][o_orderkey % 11 + 1] AS family, count(*) AS n FROM orders GROUP BY 1",
    "verdict_flips": _CASES + " SELECT kind, count(*) AS n FROM flips WHERE kind IS NOT NULL GROUP BY 1",
    "drift_acceptance": _CASES + _DELTA + """, v AS (SELECT count(*) FILTER (delta > 0.02) / count(*) AS o, max(delta) AS m, count(*) FILTER (delta >= 0.5 AND (x < 0.25) <> (y < 0.25))::DOUBLE AS d
  FROM dl), f AS (SELECT count(kind)::DOUBLE AS f, count(*) FILTER (kind = 'safety')::DOUBLE AS b FROM flips)
SELECT 'oscillator' AS criterion, round(o, 9) AS value, 0.15::DOUBLE AS target, o <= 0.15 AS passes FROM v UNION ALL SELECT 'max_drift', round(m, 9), 0.1, m < 0.1 FROM v UNION ALL
  SELECT 'verdict_flips', f, 0, f = 0 FROM f UNION ALL SELECT 'collapsed', d, 0, d = 0 FROM v UNION ALL SELECT 'block_to_allow', b, 0, b = 0 FROM f""",
    "segment_support": _SPANS + " SELECT trace_id, agent_id, CAST(start_pos AS INT) AS start_pos, CAST(len AS INT) AS len, round(score, 9) AS score FROM sb",
    "align_mode_benchmark": _BENCH + """ SELECT trace_id, n_steps, lc AS lexical_covered, sc AS semantic_covered, round(lc / n_steps, 9) AS lexical_coverage, round(sc / n_steps,
  9) AS semantic_coverage, round(sc / n_steps - lc / n_steps, 9) AS coverage_delta FROM m""",
    "soft_similarity": f"""WITH t AS (SELECT DISTINCT trace_id, question, trace.steps[1].summary AS summary FROM gaia_traces WHERE trace.steps[1].summary IS NOT NULL),
o AS (SELECT trace_id, {PROF_COLUMNS[0].replace('COL', 'question')} AS q, {PROF_COLUMNS[0].replace('COL', 'summary')} AS s FROM t),
p AS (SELECT trace_id, CASE WHEN len(q) <= len(s) THEN q ELSE s END AS small, CASE WHEN len(q) <= len(s) THEN s ELSE q END AS big FROM o),
c AS (SELECT *, CASE WHEN len(small) = 0 THEN 0.0 ELSE {PROF_COLUMNS[1]} END AS common FROM p)
SELECT DISTINCT trace_id, round(CASE WHEN len(small) = 0 THEN 0 ELSE common / (len(small) + len(big) - common) END, 9) AS soft FROM c""",
    "synthesis_similarity": """WITH l AS (SELECT block_id, max(pos) AS last FROM (SELECT DISTINCT block_id, pos, content FROM proposals) GROUP BY 1),
w AS (SELECT DISTINCT p.block_id, pos = last AS fin, unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9äöüß]+'), lambda t: length(t) > 4)) AS w FROM proposals p JOIN l USING (block_id)),
k AS (SELECT block_id, w, bool_or(fin) AS a, bool_or(NOT fin) AS b FROM w GROUP BY ALL) SELECT block_id, round(count(*) FILTER (a AND b) / count(*), 9) AS similarity, count(*) FILTER (a
  AND b) / count(*) >= 0.35 AS verified FROM k GROUP BY 1""",
}
