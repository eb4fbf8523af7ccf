"""SQL for DuckDB that walks the steps of JSON lines with its own JSON functions."""

_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || '​‍⁠﻿')"


def _opened(v: str) -> str:
    """A JSON value, or the object or array that a string holds."""
    inner = _STRIP.format(f"({v} ->> '$')")
    return f"(CASE WHEN json_type({v}) = 'VARCHAR' AND left({inner}, 1) IN ('{{', '[') AND json_valid({inner}) THEN {inner}::JSON ELSE {v} END)"


def _as_list(v: str) -> str:
    """Elements of an array, or the values of an object by its numeric keys; null for anything else. v is opened."""
    keys = f"json_keys({v})"
    numeric = f"len({keys}) > 0 AND len(list_filter({keys}, lambda k: NOT regexp_matches(k, '^\\s*[+-]*\\d+\\s*$'))) = 0"
    by_number = f"list_transform(list_sort(list_transform({keys}, lambda k: {{'n': trim(k)::BIGINT, 'k': k}})), lambda e: json_extract({v}, '$.\"' || e.k || '\"'))"
    return f"(CASE json_type({v}) WHEN 'ARRAY' THEN from_json({v}, '[\"JSON\"]') WHEN 'OBJECT' THEN CASE WHEN {numeric} THEN {by_number} END END)"


_KIDS = ("steps", "children", "substeps", "sub_steps", "subSteps", "child_steps")
_CHILDREN = " UNION ALL ".join(f"SELECT line_id, path, {_opened(f'json_extract(step, $$$.{k}$$)')} AS v FROM walk WHERE json_exists(step, '$.{k}')" for k in _KIDS)

WALK = f"""WITH RECURSIVE lines AS MATERIALIZED (SELECT DISTINCT line_id, {_STRIP.format('raw')} AS t FROM trace_lines WHERE raw IS NOT NULL), objs AS MATERIALIZED (SELECT line_id, t::JSON AS o
  FROM lines WHERE json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t::JSON END) = 'OBJECT'),
one AS MATERIALIZED (SELECT line_id, o, CASE WHEN len(json_keys(o)) = 1 AND json_keys(o)[1] NOT IN ('trace', 'steps',
  'task_id') THEN {_opened("json_extract(o, '$.\"' || json_keys(o)[1] || '\"')")} END AS inner_ FROM objs),
rec AS MATERIALIZED (SELECT line_id, CASE WHEN json_type(inner_) = 'OBJECT' THEN inner_ ELSE o END AS r FROM one), tr AS MATERIALIZED (SELECT line_id, r, {_opened("json_extract(r, '$.trace')")} AS tr
  FROM rec),
top AS MATERIALIZED (SELECT line_id, {_opened("CASE WHEN json_type(tr) = 'OBJECT' AND json_exists(tr, '$.steps') THEN json_extract(tr, '$.steps') ELSE json_extract(r, '$.steps') END")} AS v FROM tr),
first AS MATERIALIZED (SELECT line_id, i, l[i] AS e FROM (SELECT line_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT line_id, {_as_list('v')} AS l FROM top))),
walk AS (SELECT line_id, i::VARCHAR AS path, {_opened('e')} AS step FROM first WHERE json_type({_opened('e')}) = 'OBJECT'
  UNION ALL SELECT line_id, path || '.' || i, {_opened('e')} FROM (SELECT line_id, path, i, l[i] AS e FROM (SELECT line_id, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT line_id, path,
  {_as_list('v')} AS l FROM ({_CHILDREN})))) WHERE json_type({_opened('e')}) = 'OBJECT'),
fields AS MATERIALIZED (SELECT line_id, path, 'evidence' AS node, {_opened("json_extract(step, '$.evidence')")} AS v FROM walk WHERE json_exists(step, '$.evidence') UNION ALL SELECT line_id, path,
  'reasoning', {_opened("json_extract(step, '$.reasoning')")} FROM walk WHERE json_exists(step, '$.reasoning')),
vals AS (SELECT line_id, path, node, coalesce({_as_list('v')}, [v]) AS l FROM fields), vs AS (SELECT line_id, path, node, i, l[i] AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM vals)),
  items AS MATERIALIZED (SELECT line_id, path, node, i, {_opened('e')} AS v FROM vs),
full_items AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.text') THEN json_extract(v, '$.text') ELSE v END AS w FROM items),
good AS (SELECT * FROM full_items WHERE w IS NOT NULL AND json_type(w) <> 'NULL' AND NOT (json_type(w) = 'VARCHAR' AND {_STRIP.format("(w ->> '$')")} = '') AND NOT (json_type(w) = 'OBJECT'
  AND len(json_keys(w)) = 0) AND NOT (json_type(w) = 'ARRAY' AND json_array_length(w) = 0))"""

FOUND = WALK + " SELECT DISTINCT line_id, 'step' AS node, path AS step_path, 0 AS item_pos FROM walk UNION SELECT DISTINCT line_id, node, path, CAST(i AS INT) FROM good"
