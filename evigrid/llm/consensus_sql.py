"""SQL for DuckDB that states the spectral consensus with the agreement matrix written down and multiplied as lists."""

VOTES = """SELECT block_id, model, verdict FROM (
  SELECT block_id, model, upper(regexp_replace(verdict, '^\\s+|\\s+$', '', 'g')) AS verdict,
    row_number() OVER (PARTITION BY block_id, model ORDER BY recorded_at DESC, id DESC) AS n FROM judge_runs)
WHERE n = 1 AND verdict IN ('ALLOW', 'HOLD', 'BLOCK')"""

_BASE = f"""WITH RECURSIVE votes AS MATERIALIZED ({VOTES}), b AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY block_id) AS m FROM votes) WHERE m > 1),
who AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY model) AS i FROM (SELECT model, count(*) AS n, sum(m - 1)::DOUBLE AS o, avg((verdict = 'ALLOW')::INT) AS p0,
  avg((verdict = 'HOLD')::INT) AS p1, avg((verdict = 'BLOCK')::INT) AS p2 FROM b GROUP BY 1)),
two AS MATERIALIZED (SELECT u.i, v.i AS j, count(*) AS c, count(*) FILTER (x.verdict = y.verdict) AS same, any_value(u.p0 * v.p0 + u.p1 * v.p1 + u.p2 * v.p2) AS e FROM b x
  JOIN b y ON x.block_id = y.block_id AND x.model <> y.model JOIN who u ON u.model = x.model JOIN who v ON v.model = y.model GROUP BY ALL),
mat AS MATERIALIZED (SELECT list(line ORDER BY i) AS a, max(n) AS n FROM (SELECT u.i, count(*) AS n, list(coalesce((t.same - t.c * t.e) / sqrt(u.o * v.o), 0) ORDER BY v.i) AS line FROM who u CROSS
  JOIN who v LEFT JOIN two t ON t.i = u.i AND t.j = v.i GROUP BY 1)),
it AS (SELECT 0 AS k, list_transform(range(n), lambda z: 1.0::DOUBLE) AS x FROM mat UNION ALL SELECT k + 1, list_transform(y, lambda v: v / sqrt(list_sum(list_transform(y, lambda w: w * w))))
  FROM (SELECT k, list_transform(a, lambda line: list_dot_product(line, x)) AS y FROM it, mat WHERE k < 150)),
vec AS MATERIALIZED (SELECT i, model, n, o, p0, p1, p2, (SELECT CASE WHEN list_sum(x) < 0 THEN -1 ELSE 1 END * x[who.i] FROM it WHERE k = 150) / sqrt(o) AS r0 FROM who),
fac AS (SELECT sqrt(greatest(0, sum(t.same) - sum(t.c * t.e)) / (2 / 3 * sum(t.c * u.r0 * v.r0))) AS f FROM two t JOIN vec u ON u.i = t.i JOIN vec v ON v.i = t.j),
rel AS MATERIALIZED (SELECT vec.*, least(greatest(f * r0, 0), 0.97) AS r FROM vec, fac)"""
_VOTE = _BASE + """, pri AS (SELECT sum(n * r * r / (1 - r) * p0) / sum(n * r * r / (1 - r)) AS q0, sum(n * r * r / (1 - r) * p1) / sum(n * r * r / (1 - r)) AS q1,
  sum(n * r * r / (1 - r) * p2) / sum(n * r * r / (1 - r)) AS q2 FROM rel),
gue AS (SELECT model, r, q0, q1, q2, greatest((p0 - r * q0) / (1 - r), 0.01) AS g0, greatest((p1 - r * q1) / (1 - r), 0.01) AS g1, greatest((p2 - r * q2) / (1 - r), 0.01) AS g2 FROM rel, pri),
lik AS (SELECT v.block_id, v.verdict, ln(greatest(q0, 0.01)) AS l0, ln(greatest(q1, 0.01)) AS l1, ln(greatest(q2, 0.01)) AS l2, r, (1 - r) * CASE v.verdict WHEN 'ALLOW' THEN g0 WHEN 'HOLD' THEN g1
  ELSE g2 END / (g0 + g1 + g2) AS g FROM votes v LEFT JOIN gue ON gue.model = v.model),
sm AS (SELECT block_id, count(*) AS n, sum(coalesce(ln(r * (verdict = 'ALLOW')::INT + g), 0) + 1e-6 * (verdict = 'ALLOW')::INT) + coalesce(max(l0), 0) AS t0,
  sum(coalesce(ln(r * (verdict = 'HOLD')::INT + g), 0) + 1e-6 * (verdict = 'HOLD')::INT) + coalesce(max(l1), 0) AS t1,
  sum(coalesce(ln(r * (verdict = 'BLOCK')::INT + g), 0) + 1e-6 * (verdict = 'BLOCK')::INT) + coalesce(max(l2), 0) AS t2, count(*) FILTER (verdict = 'ALLOW') AS c0,
  count(*) FILTER (verdict = 'HOLD') AS c1, count(*) FILTER (verdict = 'BLOCK') AS c2 FROM lik GROUP BY 1),
con AS (SELECT *, CASE WHEN t2 >= t1 AND t2 >= t0 THEN 'BLOCK' WHEN t1 >= t0 THEN 'HOLD' ELSE 'ALLOW' END AS v, greatest(t0, t1, t2) AS top FROM sm WHERE n >= 3)"""

RELIABILITY = _BASE + " SELECT model, n AS n_votes, o::BIGINT AS overlap, round((2 * r + 1) / 3, 6) AS reliability, round(r, 6) AS r FROM rel"
AGREEMENT = _VOTE + " SELECT block_id, v AS verdict, n AS n_votes, round(CASE v WHEN 'ALLOW' THEN c0 WHEN 'HOLD' THEN c1 ELSE c2 END / n, 6) AS agreement, round(1 / (exp(t0 - top) + exp(t1 - top) + exp(t2 - top)), 5) AS confidence FROM con"
FOUND = _VOTE + " SELECT block_id, v AS verdict FROM con"
