"""Problems 2, 3, 4: brute force, round trips, and the cases every operator must bear."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from evigrid.functions import nested as N, packed as P
from evigrid.operators import nested, orphans, packed
from evigrid.plans import training
from evigrid.session import table

T0 = datetime(2025, 1, 1)
STEPS = "trace_id string, step_id string, deleted boolean, loaded_at timestamp, side string"
EDGES = "trace_id string, id string, src string, dst string, loaded_at timestamp, reason string"


def at(h):
    return T0 + timedelta(hours=h)


def test_orphans_reasons_and_cascade(spark):
    steps = [("t", "a", False, at(1), "x"), ("t", "a", False, at(1), "x"), ("t", "b", False, at(1), "x"), ("t", "b", True, at(3), "x"), ("t", "c", None, at(9), "x"),
             ("t", "d", False, at(1), None), ("t", "e", False, at(1), None), ("t", None, False, at(1), None), ("u", "z", False, at(1), None), ("t", "f", True, at(2), ""), ("t", "f", False, at(2), "")]
    edges = [("t", "1", "a", "b", at(5), "r"), ("t", "1", "a", "b", at(5), "r"), ("t", "2", "b", "d", at(5), None), ("t", "3", "d", "e", at(5), None), ("t", "4", "e", "d", at(5), None),
             ("t", "5", "c", None, at(5), None), ("t", "6", "z", "a", at(5), None), ("t", "7", "f", "a", None, None), (None, "8", "a", None, at(5), None)]
    out = orphans.plan_orphans(spark.createDataFrame(steps, STEPS), spark.createDataFrame(edges, EDGES)).collect()
    direct = {(r.group_id, r.record_id, r.side, r.reason) for r in out if r.kind == "direct"}
    assert direct == {("t", "1", "dst", "deleted"), ("t", "2", "src", "deleted"), ("t", "5", "src", "late"), ("t", "6", "src", "missing"), (None, "8", "src", "missing")}
    # 2 -> d, so 3 (d -> e) at depth 1 and 4 (e -> d) at depth 2; 6 -> a, but 1 is itself orphaned
    assert {(r.record_id, r.depth) for r in out if r.kind == "inherited"} == {("3", 1), ("4", 2)}


def test_orphans_empty(spark):
    out = orphans.plan_orphans(spark.createDataFrame([], STEPS), spark.createDataFrame([], EDGES))
    assert out.count() == 0
    assert orphans.orphan_report(out, "x").count() == 0


def test_orphans_cascade_against_brute_force(spark, sf):
    steps, edges = table(spark, sf, "plan_steps"), table(spark, sf, "plan_edges")
    out = orphans.plan_orphans(steps, edges).collect()
    bad = {(r.group_id, r.record_id) for r in out if r.kind == "direct"}
    rows = {(r.trace_id, r.id, r.src, r.dst) for r in edges.collect()}
    todo, reached = [(t, d) for t, i, s, d in rows if (t, i) in bad and d], set()
    while todo:
        k = todo.pop()
        if k not in reached:
            reached.add(k)
            todo += [(t, d) for t, i, s, d in rows if (t, s) == k and d]
    assert {(r.group_id, r.record_id) for r in out if r.kind == "inherited"} == {(t, i) for t, i, s, d in rows if s and (t, s) in reached} - bad


@pytest.mark.parametrize("growth", [0.0, 1.0, 100.0])
def test_cascade_depths(spark, growth):
    import random

    rng = random.Random(3)
    rows = [("g", f"r{i}", str(i), str(i + 1), T0) for i in range(37)] + [("g", f"x{i}", str(rng.randrange(60)), str(rng.randrange(60)), T0) for i in range(40)]
    edges = spark.createDataFrame(rows, "group_id string, record_id string, src string, dst string, loaded_at timestamp")
    direct = spark.createDataFrame([("g", "r0", "src", "0", T0, "missing")], "group_id string, record_id string, side string, key string, loaded_at timestamp, reason string")
    got = {r.record_id: r.depth for r in orphans.cascade_orphans(edges, direct, growth).collect() if r.kind == "inherited"}
    dist, todo = {"1": 1}, ["1"]
    while todo:
        k = todo.pop(0)
        for _, _, s, d, _ in rows:
            if s == k and d not in dist:
                dist[d] = dist[k] + 1
                todo.append(d)
    assert got == {r: dist[s] for _, r, s, _, _ in rows if s in dist and r != "r0"}


def test_nested_shapes():
    raw = '﻿ {"data": {"task_id": "x", "trace": "{\\"steps\\": {\\"10\\": {\\"evidence\\": \\"e\\"}, \\"2\\": {\\"evidence\\": [null, \\"x\\", {\\"text\\": \\" \\"}], \\"children\\": [{\\"reasoning\\": \\"[\\\\\\"y\\\\\\"]\\"}, null, {}]}}}"}} \n'
    got = {(r[0], r[1], r[2]) for r in N.walk(N.record_of(raw))}
    assert got == {("trace", "", 0), ("step", "1", 0), ("step", "2", 0), ("step", "1.1", 0), ("step", "1.3", 0), ("evidence", "1", 2), ("evidence", "2", 1), ("reasoning", "1.1", 1)}


@pytest.mark.parametrize("raw", [None, "", "[]", "nul", '{"a": NaN}', '{"a": 1', "5", '"{}"'])
def test_nested_unreadable(raw):
    assert N.record_of(raw) is None


def test_nested_deep_and_merkle():
    step = {"summary": "s"}
    for _ in range(300):
        step = {"summary": "s", "children": [step]}
    rows = N.walk({"task_id": "t", "steps": [step]})
    assert len(rows) == 302
    twin = {"summary": "s", "evidence": ["e"]}
    rows = N.walk({"task_id": "t", "steps": [twin, {"evidence": ["e"], "summary": "s"}, {"summary": "s", "evidence": ["f"]}]})
    hashes = [r[5] for r in rows if r[0] == "step"]
    assert len(set(hashes)) == 2


def test_nested_tables_link_up(spark, sf):
    t = nested.flat_tables(table(spark, sf, "trace_lines"), "line_id", "raw")
    links = t["bridge"]
    assert links.where("node <> 'trace' AND parent_hash IS NULL").count() == 0
    parents = links.selectExpr("record_id", "step_path AS parent_path", "node_hash AS parent_hash").where("node IN ('trace', 'step')")
    assert links.where("node <> 'trace'").join(parents, ["record_id", "parent_path", "parent_hash"], "left_anti").count() == 0
    assert t["objects"].agg({"copies": "sum"}).head()[0] == links.count()
    assert links.join(t["objects"], "node_hash", "left_anti").count() == 0


def test_nested_occurrences_edge_cases(spark):
    long = json.dumps({"task_id": "x", "steps": [{"reasoning": "word " * 200_000}]})
    rows = [(1, None, "n"), (2, "", None), (3, long, None), (3, long, None), (4, "{}", None), (None, '{"steps": [{}]}', None)]
    out = nested.occurrences(spark.createDataFrame(rows, "line_id long, raw string, node string"), "line_id", "raw").collect()
    assert sorted((r.record_id or 0, r.node) for r in out) == [(0, "step"), (0, "trace"), (3, "reasoning"), (3, "step"), (3, "trace"), (4, "trace")]
    assert nested.occurrences(spark.createDataFrame([], "line_id long, raw string"), "line_id", "raw").count() == 0


SPLITS = [
    ("Steps:\r\n1. Opened x, then.\r\n \r\n2. Multiplied 55.4 by 2.\r\nwhich gave 3 lamps", True, ["Opened x, then.", "Multiplied 55.4 by 2.\r\nwhich gave 3 lamps"]),
    ('1. Counted on page 2. 2. Clicked the "x" 3. Noted', True, ["Counted on page 2.", 'Clicked the "x"', "Noted"]),
    ("(1) a b\n(2) c", True, ["a b", "c"]),
    ("STEP 1 - a\nSTEP 2 - b on page 3", True, ["a", "b on page 3"]),
    ("a one -> b two", True, ["a one", "b two"]),
    ("a;b, c", True, ["a", "b, c"]),
    ("x and y, then z", True, ["x and y, then z"]),
    ("pdf viewer; color picker | code editor, image recognition", False, ["pdf viewer", "color picker", "code editor", "image recognition"]),
    ("browser (any, headless)", False, ["browser (any, headless)"]),
    ("text/speech converter", False, ["text/speech converter"]),
    ("a / a / c", False, ["a", "a", "c"]),
    ("Tools used:\r\n1. word processor.\r\n2. x y.", False, ["word processor.", "x y."]),
    ("N/A", False, []),
    ("-", False, []),
    (" ", True, []),
    (None, True, []),
]


@pytest.mark.parametrize(("text", "prose", "want"), SPLITS)
def test_packed_rules(text, prose, want):
    assert P.split(text, prose) == want


def test_packed_spark_equals_python(spark):
    texts = [(str(i), "f", t, p, "k") for i, (t, p, _) in enumerate(SPLITS)] + [("j", "f", '["a \\"b\\" c", "d, e"]', True, "k"), ("q", "f", "\"a, b\";'c'", False, "k"), ("l", "f", "\n".join(f"{i}. v {i}" for i in range(1, 3000)), True, "k")]
    df = spark.createDataFrame(texts + texts[:3], "record_id string, field string, text string, prose boolean, pos string").drop("pos")
    for limit in (64 << 20, -1):
        got = {}
        for r in packed.split_packed(df, broadcast_bytes=limit).collect():
            got.setdefault(r.record_id, {})[r.pos] = r.value
        for i, (t, p, want) in enumerate(SPLITS):
            assert [v for _, v in sorted(got.get(str(i), {}).items())] == want
        assert got["j"] == {1: 'a "b" c', 2: "d, e"}
        assert got["q"] == {1: "a, b", 2: "c"}
        assert len(got["l"]) == 2999
    assert packed.split_packed(df.limit(0)).count() == 0
    run = spark.createDataFrame([("r", "f", "word " * 200_000, False), ("s", "f", "x" * 1_000_000, False), ("t", "f", "1.2" * 100_000, True)], "record_id string, field string, text string, prose boolean")
    assert packed.split_packed(run).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.from_regex(r"[a-z]{1,8}( [a-z]{1,8}){0,2}", fullmatch=True).filter(lambda v: not P.says_none(v) and not set(v.split()) & set(P.KEPT_WORDS)), min_size=1, max_size=8), st.sampled_from(["1. ", "- ", "step "]), st.sampled_from(["\n", "\r\n"]))
def test_packed_round_trip(values, style, newline):
    mark = {"1. ": lambda i: f"{i}. ", "- ": lambda i: "- ", "step ": lambda i: f"Step {i}: "}[style]
    text = newline.join(mark(i) + v for i, v in enumerate(values, 1))
    assert P.split(text, True) == values
    assert P.split("; ".join(f'"{v}"' for v in values), False) == [f'"{v}"' for v in values]


def test_queries_run(spark, sf):
    for name, query in training.QUERIES.items():
        assert query(spark, sf).count() > 0, name


def test_orphans_through_tables(spark):
    """Blocks refer to blocks, proposals to blocks, votes to proposals: what hangs below an orphan is inherited, through tables and cycles."""
    t = lambda rows, extra: spark.createDataFrame(rows, f"key string, loaded_at timestamp, {extra}")
    tables = {
        "blocks": t([("a", at(1), ["gone"]), ("b", at(1), ["a", None]), ("c", at(2), ["c"]), ("d", at(9), None), ("d", at(9), None), (None, at(1), ["b"])], "refs array<string>"),
        "proposals": t([("p", at(2), "b"), ("q", at(2), "c"), ("r", at(3), "d"), ("s", at(3), None)], "block string"),
        "votes": t([("1", at(4), "p"), ("2", at(4), "q"), ("3", at(4), "nowhere"), ("4", at(4), "r")], "proposal string"),
    }
    tables = {k: v.withColumn("side", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("depth", F.lit(1)) for k, v in tables.items()}  # clashing names
    got = orphans.graph_orphans(tables, [("blocks", "refs", "blocks"), ("proposals", "block", "blocks"), ("votes", "proposal", "proposals")]).collect()
    assert {(r.tab, r.record_id, r.side, r.key, r.reason, r.depth) for r in got} == {
        ("blocks", "a", "blocks.refs", "gone", "missing", 0), ("blocks", "b", "blocks.refs", "a", "inherited", 1), ("blocks", "", "blocks.refs", "b", "inherited", 2), ("proposals", "p",
        "proposals.block", "b", "inherited", 2),
        ("proposals", "r", "proposals.block", "d", "late", 0), ("votes", "1", "votes.proposal", "p", "inherited", 3), ("votes", "3", "votes.proposal", "nowhere", "missing", 0), ("votes", "4",
        "votes.proposal", "r", "inherited", 1),
    }
    none = {k: v.limit(0) for k, v in tables.items()}
    assert orphans.graph_orphans(none, [("blocks", "refs", "blocks"), ("proposals", "block", "blocks")]).count() == 0


def test_json_of_any_depth(spark):
    deep = '{"task_id": "t", "steps": [{"summary": ' + "[" * 10_000 + "]" * 10_000 + ', "evidence": ["e"]}]}'
    inner = '[{"evidence": ["e"], "steps": ' + json.dumps(json.dumps([{"evidence": "f"}])) + "}]"  # lists in strings in strings
    wrapped = json.dumps({"outer": json.dumps({"task_id": "w", "steps": inner})})
    chain = '{"summary": "s"}'
    for _ in range(1_500):
        chain = '{"steps": [' + chain + "]}"
    df = spark.createDataFrame([(1, deep), (2, wrapped), (3, '{"task_id": "c", ' + chain[1:])], "line_id long, raw string")
    found = nested.occurrences(df, "line_id", "raw").groupBy("record_id", "node").count().collect()
    assert {(r.record_id, r.node, r["count"]) for r in found} == {(1, "trace", 1), (1, "step", 1), (1, "evidence", 1), (2, "trace", 1), (2, "step", 2), (2, "evidence", 2), (3, "trace", 1), (3, "step", 1_500)}
