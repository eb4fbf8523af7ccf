"""The reference's own operators: locks on constants, exhaustive small domains, brute force, hand-made cases."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evigrid.functions import similarity as S, text as T
from evigrid.operators import align, discourse, entail, evalstats as E, grading as G, provenance as P, records, scan, traces as TR
from evigrid.plans import reference
from evigrid.sources import readers, sinks
from evigrid.streaming import traces as streaming

LONG, SHORT = "a quote that is long enough", "short"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).head()[0]


@pytest.mark.parametrize(
    ("score", "quote", "reasoning", "want"),
    [
        (0.0, LONG, "", (0.0, "skipped")), (0.2499, LONG, "", (0.2499, "unsupported")), (0.25, LONG, "", (0.25, "partial")), (0.5624, LONG, "", (0.5624, "partial")), (0.5625, LONG, "", (0.5625,
        "supported")),
        (0.5625, None, "", (0.25, "partial")), (0.9, SHORT, "", (0.4, "partial")), (0.3, SHORT, "", (0.3, "partial")), (0.9, "", "", (0.4, "partial")), (0.5, LONG,
        "used blog rather than the source, wrong source", (0.0, "skipped")),
        (0.75, LONG, "wrong source", (0.75, "supported")), (0.9, LONG, "cross-step evidence", (0.4, "partial")), (0.4, LONG, "aliasing", (0.4, "partial")),
    ],
)
def test_floors_and_bands(spark, score, quote, reasoning, want):
    df = spark.createDataFrame([(score, quote, reasoning)], "s double, q string, r string")
    df = df.withColumn("f", G.floored(df.s, df.q, df.r))
    row = df.select("f", G.predicate(F.col("f"), df.q).alias("p")).head()
    assert (row.f, row.p) == want


def test_fetch_without_extraction(spark):
    df = spark.createDataFrame([("[search] x", 0.9), ("[search] x [observe] y", 0.9), ("[search] " + "y" * 600, 0.9)], "t string, s double")
    assert [r[0] for r in df.select(G.floored(df.s, F.lit(LONG), None, df.t)).collect()] == [0.25, 0.9, 0.9]


def fold(steps):
    """Plain form of the fold."""
    te = sum({"unsupported": 1, "skipped": 1, "partial": 0.5}.get(p, 0) for c, t, s, p in steps if c == "critical" and t == "te")
    ac = sum({"unsupported": 0.5, "skipped": 0.5, "partial": 0.25}.get(p, 0) for c, t, s, p in steps if c == "critical" and t == "ac")
    held = ac > 0 and not any(p in ("unsupported", "skipped") for c, t, s, p in steps if c == "critical" and t == "te")
    if te + ac >= 2 and not held:
        return "BLOCK"
    if te + ac >= 1 or held:
        return "HOLD"
    if te + ac >= 0.5 or any(0 < s < 0.5625 for c, t, s, p in steps if c != "critical"):
        return "CONDITIONAL_ALLOW"
    return "ALLOW"


def test_fold_exhaustive(spark):
    kinds = [(c, t, s, p) for c in ("critical", "optional") for t in ("te", "ac") for s, p in ((0.0, "skipped"), (0.1, "unsupported"), (0.4, "partial"), (0.9, "supported"))]
    cases = {i: steps for i, steps in enumerate(itertools.combinations_with_replacement(kinds, 3))}
    rows = [(i, c, {"te": None, "ac": "answer_consistency"}[t], s, p) for i, steps in cases.items() for c, t, s, p in steps]
    df = spark.createDataFrame(rows, "item_id long, criticality string, step_type string, score double, predicate string")
    got = {r.item_id: r.verdict for r in G.fold_verdicts(df).collect()}
    assert got == {i: fold(s) for i, s in cases.items()}
    assert G.fold_verdicts(df.limit(0)).count() == 0


def test_merge_is_commutative_and_strict(spark):
    df = spark.createDataFrame(list(itertools.product(G.LATTICE, G.LATTICE)), "a string, b string")
    for r in df.select("a", "b", G.stricter(df.a, df.b).alias("ab"), G.stricter(df.b, df.a).alias("ba")).collect():
        assert r.ab == r.ba == G.LATTICE[min(G.LATTICE.index(r.a), G.LATTICE.index(r.b))]


def test_cascade_never_softens_a_block(spark):
    judges = [*G.LATTICE, None]
    df = spark.createDataFrame(list(itertools.product(judges, judges, [True, False], [True, False])), "p string, s string, c boolean, e boolean")
    rows = df.withColumn("o", G.cascade(df.p, df.s, df.c, df.e)).collect()
    for r in rows:
        if r.p is None and r.s is None:
            assert r.o is None
        elif r.p == "BLOCK":
            assert r.o.verdict in ("BLOCK", "HOLD") and (r.o.verdict == "BLOCK" or r.c)
        elif r.p == "HOLD":
            assert r.o.verdict == ("BLOCK" if r.s == "BLOCK" else "HOLD")
        elif r.p and r.s in ("BLOCK", "HOLD"):
            assert r.o.verdict == "HOLD"


def test_family(spark):
    for m, f in [("claude-x", "anthropic"), ("o3-mini", "openai"), ("foo3", "unknown"), ("x-o1", "openai"), ("kimi-k", "moonshot"), ("deepseek-r", "deepseek"), ("Gemini", "google"), ("grok", "xai")]:
        assert one(spark, G.family(F.lit(m))) == f


@pytest.mark.parametrize(("w", "s"), [("species", "species"), ("berries", "berry"), ("ties", "ties"), ("running", "runn"), ("ring", "ring"), ("used", "used"), ("noted", "not"), ("boxes", "box"), ("glass", "glass"), ("steps", "step"), ("bus", "bus")])
def test_stem(spark, w, s):
    assert one(spark, T.stem(F.lit(w))) == s


def test_text_functions(spark):
    assert one(spark, T.lexical_tokens(F.lit("Use the web-browser, then find zip codes by AI!"))) == ["browser", "zipcode", "ai"]
    assert one(spark, T.iso_duration_seconds(F.lit("PT1M48.5S"))) == 108.5 and one(spark, T.iso_duration_seconds(F.lit("P1DT30M"))) == 88200 and one(spark, T.iso_duration_seconds(F.lit("P1D"))) is None
    assert one(spark, T.confidence_of(F.lit("Confidence: 85%"))) == 0.85 and one(spark, T.confidence_of(F.lit("x"))) == 0.5
    assert one(spark, T.element(F.lit("<html><TITLE a=1> A &amp; B\n</TITLE>"), "title")) == "A & B" and one(spark, T.element(F.lit("<p>"), "h1")) is None
    assert one(spark, T.unwrapped(F.lit("“x y”"))) == "x y" and one(spark, T.unwrapped(F.lit("x"))) == "x"
    assert one(spark, T.numbered_items(F.lit("1. a\n2) b\n\n- c"))) == ["a", "b", "c"]
    assert one(spark, T.collapsed(F.lit(" A  B\n"))) == "a b"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def sim(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 5 and (a.startswith(b) or b.startswith(a)):
        return 0.92
    near = 1 - lev(a, b) / max(len(a), len(b))
    return near if near >= 0.82 else 0.0


def test_soft_jaccard_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["survey", "surveys", "ledger", "ledgers", "harbor", "harbour", "canal", "canals", "guild", "map"]
    rows = [(rng.sample(vocab, rng.randrange(0, 6)), rng.sample(vocab, rng.randrange(0, 6))) for _ in range(120)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for (a, b), r in zip(rows, df.select(S.soft_jaccard(df.a, df.b).alias("x")).collect()):
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        used, total = set(), 0.0
        for t in small:
            best = max(((sim(t, u), -i) for i, u in enumerate(large) if i not in used), default=(0, 0))
            if best[0] > 0:
                total += best[0]
                used.add(-best[1])
        assert r.x == pytest.approx(total / (len(a) + len(b) - total) if a and b else 0.0)


def test_assignment_against_greedy(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for t in range(25):
        cands = {(a, b): (round(rng.choice([0.3, 0.5, 0.7]), 2), round(rng.random(), 3)) for a in range(rng.randrange(1, 9)) for b in range(rng.randrange(1, 9)) if rng.random() < 0.6}
        rows += [(f"t{t}", f"a{a}", f"b{b}", a, b, s, p, 0.1, s) for (a, b), (s, p) in cands.items()]
        by = {}
        for (a, b), (s, p) in cands.items():
            by.setdefault(b, []).append((s, p, -a))
        taken = set()
        for b in sorted(by, key=lambda b: (len(by[b]), -max(x[0] for x in by[b]), b)):
            free = [x for x in by[b] if -x[2] not in taken]
            if free:
                best = max(free, key=lambda x: (x[0], x[1], x[2]))
                taken.add(-best[2])
                want.add((f"t{t}", f"b{b}", f"a{-best[2]}"))
    df = spark.createDataFrame(rows, "trace_id string, agent_id string, annotator_id string, agent_pos int, annotator_pos int, lexical double, position double, tool double, score double").withColumn("lexical", F.col("score"))
    assert {(r.trace_id, r.annotator_id, r.agent_id) for r in align.assign(df).collect()} == want
    assert align.assign(df.limit(0)).count() == 0


def steps_df(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, step_id string, grp string, idx int, description string, tools array<string>, deleted boolean, loaded_at int")


def test_alignment_cases(spark):
    rows = [("t", "an1", "annotator", 1, "open harbor ledger", ["python"], False, 1), ("t", "an2", "annotator", 2, "count copper kettles", None, False, 1), ("t", "an3", "annotator", 3, "report final tonnage", [], False, 1),
            ("t", "pl1", "agent:plan", 1, "open harbor ledger count copper kettles", ["python"], False, 1), ("t", "pl2", "agent:plan", 2, None, None, False, 1), ("t", "ex1", "agent:exec", 1,
            "report final tonnage", [], False, 1),
            ("t", "old", "agent:exec", 2, "count copper kettles", [], False, 1), ("t", "old", "agent:exec", 2, "count copper kettles", [], True, 2), ("u", "an1", "annotator", 1, "", [], False, 1),
            (None, "x", "annotator", 1, "", [], False, 1)]
    steps = align.latest_steps(steps_df(spark, rows))
    side = {g: align.profiles(steps, g) for g in ("annotator", "agent:plan", "agent:exec")}
    plan = align.assign(align.candidates(side["agent:plan"], side["annotator"]))
    done = align.assign(align.candidates(side["agent:exec"], side["annotator"]))
    runs = align.segment_support(side["agent:plan"], side["annotator"])
    got = {(r.trace_id, r.annotator_id): (r.source, r.kind) for r in align.merged_support(side["annotator"], plan, done, runs).collect()}
    assert got == {("t", "an1"): ("plan", "single_step_and_segment"), ("t", "an2"): ("plan", "segment_only"), ("t", "an3"): ("execution", "none"), ("u", "an1"): ("none", "none")}
    flags = {(r.trace_id, r.annotator_id, r.flag) for r in align.support_flags(align.merged_support(side["annotator"], plan, done, runs)).collect()}
    assert flags == {("t", "an3", "plan_gap"), ("u", "an1", "truly_missing_step")}


PATHS = [
    ("the ledger was read", "so the ledger was read twice", "exact"), ("the ledger was read...", "the ledger was read twice", "exact"), ("the ledger\n  was read", "the ledger\nwas read",
    "whitespace-normalized"),
    ("the first part of it ... the second part of it", "the first part of it and then the second part of it", "fuzzy-truncated"), ("it’s the “ledger”", "it's the \"ledger\"", "unicode-normalized"),
    ("ﬁnal ledger", "the final ledger", "unicode-normalized"),
    ('"the ledger was read"', "so the ledger was read twice", "structural-unwrapped"), ("something else", "the ledger", "no-match"), (None, "x", None),
    ("the second part of it ... the first part of it", "the first part of it and the second part of it", "no-match"),
]


def test_match_paths(spark):
    df = spark.createDataFrame([(i, q, s) for i, (q, s, _) in enumerate(PATHS)], "i int, quote string, source string")
    got = {r.i: r.match_path for r in P.with_match_path(df, "quote", "source").collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(PATHS)}
    assert one(spark, P.longest_prefix(F.lit("abcdefghijXYZ"), F.lit("--abcdefghij--"))) == 10 and one(spark, P.longest_prefix(F.lit("abcX"), F.lit("abc"))) == 0


def test_entailment(spark):
    rows = [("1", "Paris", "The capital is Paris."), ("2", "Paris", "The capital is not Paris."), ("3", "Rome; Oslo", "Oslo came first. Rome came later."), ("4", "the old harbor ledger", "They found the old harbor ledger book"), ("5", "", "x"), ("6", "Lima", None), ("7", "a red fox jumps high", "a red fox jumps. Nothing else")]
    df = spark.createDataFrame([(k, "q", a, s) for k, a, s in rows], "k string, q string, a string, s string")
    got = {r.k: r.support for r in entail.span_entailment(df, "k", "q", "a", "s").collect()}
    assert got == {"1": "exact", "2": "unsupported", "3": "paraphrase", "4": "exact", "5": "unsupported", "6": "unsupported", "7": "paraphrase"}


def test_statistics(spark):
    low, high = E.wilson(F.lit(40.0), F.lit(40.0))
    assert one(spark, low) == pytest.approx(0.9124, abs=1e-3) and one(spark, high) == pytest.approx(1.0)
    assert one(spark, E.wilson(F.lit(0), F.lit(0))[1]) == 1.0
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "Y!"), ("b", "y"), ("b", "z"), ("c", None)], "g string, t string")
    got = {r.g: (r.answer, r.votes, r.tie) for r in E.majority(df, "g", "t").collect()}
    assert got == {"a": ("x", 2, False), "b": ("y", 2, False)}
    d = {r.g: r.diversity for r in E.diversity(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g string, k string"), "g", "k").collect()}
    assert d == {"a": 0.5, "b": 0.0}
    empty = spark.createDataFrame([], "g string, m int, t string")
    assert discourse.dissent(empty, "g", "m", "t").count() == 0
    k = E.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").head()
    assert k.kappa is None
    loo = E.leave_one_out(spark.createDataFrame([("1", "A", "A"), ("2", "A", "B")], "i string, gold string, verdict string"), "i").collect()
    assert {(r["item"], r.accuracy_without) for r in loo} == {("1", 0.0), ("2", 1.0)}


def test_span_tree_and_sequences(spark):
    rows = [("t", "a", None, 1), ("t", "b", "a", 2), ("t", "c", "a", 1), ("t", "d", "b", 1), ("t", "x", "y", 1), ("t", "y", "x", 1), ("u", "r", "gone", 1)]
    out = TR.flatten_spans(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, pos int")).orderBy("trace_id", "path").collect()
    assert [(r.span_id, r.depth) for r in out] == [("a", 0), ("c", 1), ("b", 1), ("d", 2), ("r", 0)]
    st = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a"), ("u", 1, "z")], "g string, i int, s string")
    assert [tuple(r) for r in TR.sequence_edges(st, ["g"], "i", "s").collect()] == [("t", "a", "b")]
    many = spark.createDataFrame([("t", i * 37 % 5000, f"s{i}") for i in range(5000)] + [("t", None, "n")], "g string, i int, s string")
    got = {r.s: r.pos for r in TR.ranked(many, ["g"], "i", "s", 100).collect()}
    assert got["n"] == 1 and all(got[f"s{i}"] == i * 37 % 5000 + 2 for i in range(5000))
    assert one(spark, S.position_score(F.lit(1), F.lit(1), F.lit(1), F.lit(3))) == 0.5 and one(spark, S.position_score(F.lit(1), F.lit(1), F.lit(2), F.lit(3))) == 1.0


def test_enrichment_and_scan(spark):
    t = spark.createDataFrame([("1", " Paris "), ("2", "x"), ("3", None)], "task_id string, answer string")
    g = spark.createDataFrame([("1", "paris", None), ("2", "y", ["X"]), ("2", "y", ["X"])], "task_id string, true_answer string, accepted array<string>")
    assert {r.task_id: r.answer_correct for r in TR.enrich_gold(t, g, "task_id").collect()} == {"1": True, "2": True, "3": False}
    with pytest.raises(Exception, match="no gold"):
        TR.enrich_gold(t, g, "task_id", strict=True).collect()
    tr = spark.createDataFrame([("t", "u", 1, "search", ["e"]), ("t", "u", 2, "browse", ["A"]), ("t", "u", 3, "browse", None)], "trace_id string, source_url string, step_pos int, kind string, evidence array<string>")
    pages = spark.createDataFrame([("u", "<title>A</title><h1>B</h1>"), ("u", "<title>A</title><h1>B</h1>")], "url string, html string")
    assert {r.step_pos: r.evidence for r in TR.enrich_pages(tr, pages).collect()} == {1: ["e"], 2: ["A", "B"], 3: None}
    lines = scan.lines_of(spark.createDataFrame([("f", "eval(x)\n# safe\nexec(y)\neval(z)")], "f string, t string"), "f", "t")
    found = scan.findings(lines, [(r"\beval\(", "eval", "high"), (r"\bexec\(", "exec", "critical")])
    assert {(r.label, r.line_no) for r in found.collect()} == {("eval", 1), ("exec", 3), ("eval", 4)}
    assert {r.line_no: r.guarded for r in scan.guard_context(lines, "safe", 1).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert scan.attest(found, "file", ["label", "line_no"]).head().short_id == scan.attest(found.orderBy(F.desc("line_no")), "file", ["label", "line_no"]).head().short_id


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"1": {"true_answer": "a", "accepted_answers": ["b"]}, "2": {"ground_truth": "c"}}))
    assert {r.task_id: r.true_answer for r in readers.gold_map(spark, str(tmp_path / "gold.json")).collect()} == {"1": "a", "2": "c"}
    (tmp_path / "claims.json").write_text(json.dumps({"1": {"support": "exact", "confidence": "high"}, "2": {"support": "exact"}}))
    assert [(r.trace_id, r.exact_question) for r in readers.source_claims(spark, str(tmp_path / "claims.json")).collect()] == [("1", False)]
    (tmp_path / "s.json").write_text(json.dumps([{"task_id": "1", "Question": "q", "Final answer": "f", "Level": 2}, {"task_id": "2", "question": "r", "ground_truth": "g"}]))
    assert {(r.task_id, r.question, r.final_answer) for r in readers.samples(spark, str(tmp_path / "s.json")).collect()} == {("1", "q", "f"), ("2", "r", "g")}
    (tmp_path / "t.jsonl").write_text('{"task_id": "1", "level": 2}\n\n{"task_id": "2", "trace": {"steps": [{"summary": "s"}]}}\r\n')
    assert readers.jsonl(spark, str(tmp_path / "t.jsonl"), readers.TRACE).count() == 2
    assert readers.sniff(spark, str(tmp_path / "t.jsonl")) == "jsonl"
    with pytest.raises(ValueError, match="unknown"):
        readers.sniff(spark, str(tmp_path / "s.json"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "src/b.txt").write_text("x")
    assert readers.source_tree(spark, str(tmp_path / "src")).count() == 1
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.append_new(rows, str(tmp_path / "out"), "k") == 2 and sinks.append_new(rows, str(tmp_path / "out"), "k") == 0
    ids = {r.question: r.id for r in sinks.with_block_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "question string"), 998).collect()}
    assert ids == {"a": "PoT-999", "b": "PoT-1000", "c": "PoT-1001"}
    assert sinks.markdown_table(rows.limit(1)).splitlines()[2] == "| 1 | a |"


def test_streaming(spark, tmp_path, sf):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": "1", "at": "2025-01-01T00:00:00"}\n{"k": "1", "at": "2025-01-01T00:10:00"}\n{"k": "2", "at": "2025-01-01T00:00:00"}\n')
    stream = streaming.once(streaming.trace_stream(spark, str(src), "k STRING, at TIMESTAMP"), "k", "at")
    q = streaming.each_batch(stream, lambda b: b.withColumn("n", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    batch = spark.read.parquet(f"{sf}/judge_runs.parquet")
    assert streaming.judge_windows(batch, "ingested_at").agg(F.sum("n")).head()[0] == batch.count()


def test_queries_run(spark, sf):
    for name in ("graded_verdict", "cascade_stats", "semantic_tokens", "align_gaps", "support_flags", "quote_variants", "claim_support", "objection_preservation", "synthesis_similarity", "soft_similarity"):
        assert reference.QUERIES[name](spark, sf).count() > 0, name


# --- what the second round added ------------------------------------------------------------------------


def test_span_tree_of_any_depth(spark):
    """A chain of 1500 spans, a cycle with a tail, two roots, and positions out of range."""
    rows = [("t", f"s{i}", f"s{i - 1}" if i else None, i % 3) for i in range(1_500)] + [("t", "x", "y", 0), ("t", "y", "x", 0), ("t", "z", "x", 1), ("u", "r", "nowhere", 5)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, pos int")
    got = {r.span_id: (r.depth, r.path) for r in TR.flatten_spans(df).collect()}
    assert len(got) == 1_501 and got["s1499"][0] == 1_499 and got["s2"][1] == "000000000/000000001/000000002" and got["r"] == (0, "000000005")
    assert got["s1499"][1] == "/".join(f"{i % 3:09d}" for i in range(1_500))
    with pytest.raises(Exception, match="out of range"):
        TR.flatten_spans(spark.createDataFrame([("t", "a", None, 1_000_000_000)], df.schema)).collect()
    assert TR.flatten_spans(df.limit(0)).count() == 0


def test_assignment_with_long_chains(spark):
    """Displacement that runs through all steps of a trace: every annotator step wants the same agent steps in the same order."""
    n = 60
    rows = [("t", f"a{a}", f"b{b}", a, b, 0.9 - a / 1000, 0.5, 0.5) for b in range(n) for a in range(b + 1)]
    df = spark.createDataFrame(rows, "trace_id string, agent_id string, annotator_id string, agent_pos int, annotator_pos int, score double, position double, lexical double")
    got = {r.annotator_id: r.agent_id for r in align.assign(df).collect()}
    assert got == {f"b{i}": f"a{i}" for i in range(n)}


def test_similar_tokens_against_all_pairs(spark):
    rng = random.Random(6)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 8))) for _ in range(150)}
    for w in list(words)[:40]:
        long = w * 3
        at = rng.randrange(len(long))
        words |= {long, long[:at] + "x" + long[at + 1 :], long[:at] + long[at + 1 :], long + "abc", long[:at] + "yz" + long[at:]}
    words.discard("")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (last := row) else row
            for j, y in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
        return row[-1]

    def near(a, b):
        return a == b or min(len(a), len(b)) >= 5 and (a.startswith(b) or b.startswith(a)) or 1 - distance(a, b) / max(len(a), len(b)) >= 0.82

    got = {(r.a, r.b) for r in align.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_a_long_trace_is_split(spark):
    """One trace of 20 000 steps whose steps share a token: the pairs that match are found, in stretches of the agent's positions."""
    shape = "trace_id string, step_id string, pos int, size int, tokens array<string>, meanings array<string>, tools array<string>"
    agent = spark.createDataFrame([("t", f"a{i}", i, 10_000, ["common" if i % 400 == 0 else f"w{i}"], [], []) for i in range(1, 10_001)], shape)
    annotator = spark.createDataFrame([("t", f"b{i}", i, 10_000, ["common" if i % 400 == 0 else f"w{i}"], [], []) for i in range(1, 10_001)], shape)
    got = align.candidates(agent, annotator, 0.79)
    assert got.count() == 9_975 + sum(1 for i in range(25) for j in range(25) if 0.5 + 0.3 * (1 - abs(i - j) * 400 / 9_999) >= 0.79)
    assert got.where("agent_pos <> annotator_pos").count() == sum(1 for i in range(25) for j in range(25) if i != j and 0.5 + 0.3 * (1 - abs(i - j) * 400 / 9_999) >= 0.79)


def test_dissent_of_a_hot_group(spark):
    rows = [("g", i, f"common word{i % 7:02d} other") for i in range(600)] + [("h", 1, "alone here")]
    got = {r.g: r.dissent for r in discourse.dissent(spark.createDataFrame(rows, "g string, m int, t string"), "g", "m", "t").collect()}
    sets = [{"common", f"word{i % 7:02d}", "other"} for i in range(600)]
    want = sum(1 - len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)) / (600 * 599 / 2)
    assert got["g"] == pytest.approx(want) and got["h"] == 0


@pytest.mark.parametrize(
    ("critique", "synthesis", "want"),
    [
        ("However, the ledger totals are wrong for harbor barges.", "The ledger totals of the harbor were checked.", (1, 1, 1.0, False)),
        ("But this is fine and good, is it not.", "x", (0, 0, 1.0, False)),
        ("- incorrect: ledger totals\n2. Unsupported claim about barges\nFine.", "ledger", (2, 1, 0.5, False)),
        ("The totals are wrong here today. The barges are disputed by many.", "nothing", (2, 0, 0.0, True)),
        (None, None, (0, 0, 1.0, False)), ("wrong", "wrong", (0, 0, 1.0, False)),
    ],
)
def test_objections(spark, critique, synthesis, want):
    df = spark.createDataFrame([(critique, synthesis, True, 1)], "critique string, synthesis string, warned boolean, score_given int")
    r = discourse.preservation(df).head()
    assert (r.objections, r.preserved, r.score, r.false_consensus) == want


def test_balance(spark):
    rows = spark.createDataFrame([("g", "a", "alpha bravo charlie"), ("g", "b", "delta hotel"), ("h", "a", None), ("h", "b", ""), ("i", "a", "alpha")], "g string, m string, t string")
    synth = spark.createDataFrame([("g", "alpha bravo charlie"), ("h", None), ("i", "alpha")], "g string, synthesis string")
    cov = discourse.member_coverage(rows, "g", "m", "t", synth)
    got = {r.g: (r.n_members, r.score, r.dominated_by, r.dominance_justified, r.warning) for r in discourse.synthesis_balance(cov, "g", "m").collect()}
    assert got == {"g": (2, 0.0, "a", True, False), "h": (2, 1.0, None, False, False), "i": (1, 1.0, "a", False, True)}


@pytest.mark.parametrize(
    ("question", "answer", "source", "want"),
    [
        ("q", "Paris", "It was PARIS  in spring.", ("exact", "high")), ("q", "Paris", "It was not Paris. It is never in paris", ("unsupported", "high")), ("q", "Paris",
        "It was not Paris. But Paris it is.", ("exact", "high")),
        ("q", "red; blue", "The red one. A blue one.", ("paraphrase", "medium")), ("q", "red; blue", "The red one. Not blue.", ("unsupported", "medium")),
        ("What is the translation of the source title?", "the century of the world", "el siglo del mundo", ("paraphrase", "medium")), ("q", "the old gate was open", "the old gate was not open then",
        ("paraphrase", "high")),
        ("Give it verbatim", "zebra", "nothing here", ("unsupported", "high")), ("q", "zebra", None, ("unsupported", "medium")), ("q", None, "x y z", ("unsupported", "medium")), ("q", r"a\Eb",
        r"so a\Eb it is", ("exact", "high")), ("q", "3.5%", "never 3.5% but", ("exact", "high")), ("q", "35 percent", "never 35 percent but", ("unsupported", "high")),
    ],
)
def test_entailment_branches(spark, question, answer, source, want):
    df = spark.createDataFrame([(1, question, answer, source)], "k int, q string, a string, s string")
    r = entail.span_entailment(df, "k", "q", "a", "s").head()
    assert (r.support, r.confidence) == want


def test_near_misses(spark):
    cases = [("Peter Capaldi as said", "Peter Capaldi", True), ("not the river bank", "the river bank", False), ("John Smith Jr.", "John Smith", False), ("John Smith Junior", "John Smith", True), ("Anna Maria Berg in Rome", "Anna Maria Tal in Rome", False), ("rose by 12", "rose by 13", False), ("old stone gate of town", "stone gate of old city", True), (None, "x", False), ("", "", False)]
    df = spark.createDataFrame(cases, "a string, t string, want boolean")
    assert [r.got == r.want for r in df.withColumn("got", entail.near_miss(df.a, df.t)).collect()] == [True] * len(cases)


def test_diagnosis(spark):
    rows = [(1, None, "s"), (2, "a plain quote", "so a plain quote here"), (3, "a plain quote that goes on elsewhere for long", "a plain quote, and then something"), (4, "it’s a smart quote", "it's a smart quote"), (5, "'a' \"b\" ‘c’ nested", "x"), (6, "short", "nothing"), (7, "no source", None)]
    df = spark.createDataFrame(rows, "k int, quote string, source string")
    got = {r.k: (r.match_path, r["mode"]) for r in P.diagnose(df).collect()}
    assert got == {1: ("no-match", "no_quote"), 2: ("exact", "matched"), 3: ("no-match", "mode_2_paraphrase"), 4: ("no-match", "mode_1_tokenization"), 5: ("no-match", "mode_1_tokenization"), 6: ("no-match", "inconclusive"), 7: ("no-match", "inconclusive")}
    r = P.diagnose(df.where("k = 3")).head()
    assert (r.prefix, r.position, r.first_difference) == (13, 0, 13) and r.quote_hex.startswith("61 20 70") and r.source_hex.startswith("61 20 70")
    assert P.diagnose(df.limit(0)).count() == 0


def test_line_break_probes(spark):
    source = "The first line of the page is long enough.\nStep 4 [search] for the other thing\nA third line that follows it"
    cases = {"page is long enough.\nStep 4 [se": ["cross_line_fragment_tail", "mid_word_termination"], "The first line\nA third line": ["cross_line_fragment_tail", "bridge_span_concat", "mid_word_termination"], "one line only": [], "The first line of the page is long enough.\nStep 4 [search] for the other thing": []}
    for quote, want in cases.items():
        assert one(spark, P.line_break_signals(F.lit(quote), F.lit(source))) == want
    df = spark.createDataFrame([(source,), (None,), ("",)], "source string")
    r = P.line_break_sweep(df).head()
    assert (r.sources, r.made, r.cross_line, r.bridges_made, r.bridges_found) == (3, 1, 1, 1, 1)


def test_audit_of_code(spark):
    code = "import os\nos.system('x')\n" + "pass\n" * 30 + "exec(y)\nconfirm('sure')\n"
    files = [("a.py", code), ("b.js", "child_process.exec(x)\n// sandbox\n"), ("c.py", "BYPASS = 1\n" + "x\n" * 50 + "eval (z)"), ("d.py", "yaml.load(f, Loader=S)\nretrieval(x)"), ("e.txt", "eval(x)"), ("f.ts", None)]
    lines = scan.lines_of(spark.createDataFrame(files, "f string, t string"), "f", "t")
    out = scan.audit(lines, scan.language_of(F.col("file")))
    got = {(r.file, r.line_no, r.label): (r.guard_status, r.bypass_line, r.has_sandbox, r.score) for r in out.collect()}
    assert got == {("a.py", 2, "os.system"): ("unguarded", None, False, 9.1), ("a.py", 33, "exec"): ("guarded", None, False, 5.5), ("b.js", 1, "child_process"): ("unguarded", None, True, 3.0), ("c.py", 52, "eval"): ("guarded-but-bypassable", 1, False, 8.4)}
    assert {r.file: r.severity for r in scan.highest_severity(out, "file").collect()} == {"a.py": "critical", "b.js": "critical", "c.py": "critical"}
    assert [r.file for r in scan.ranked_findings(out).collect()] == ["a.py", "a.py", "b.js", "c.py"]


def test_record_rules(spark):
    prov = "struct<origin:string,sourceEvidence:string,confidence:double>"
    ok = ("explicit", "e", 0.5)
    steps = spark.createDataFrame([("t", "a", "annotator", 1, "d", ["x"], ok), ("t", "a", "annotator", 1, "d", [], ok), ("t", "b", "odd", 0, " ", None, ("x", "", 2.0)), ("t", None, "annotator", 1, "d", [], None)], f"trace_id string, step_id string, grp string, idx int, description string, tools array<string>, provenance {prov}")
    edges = spark.createDataFrame([("t", "1", "a", "b", ok), ("t", "2", "goal", "final_answer", ok), ("t", "3", "zz", None, ok)], f"trace_id string, id string, src string, dst string, provenance {prov}")
    goals = spark.createDataFrame([("t", "g", "d", "k", ok, True, 1.0, "a"), ("u", "h", "", None, ok, None, 0.0, None)], f"trace_id string, id string, description string, task_id string, provenance {prov}, verified boolean, duration double, answer string")
    flags = spark.createDataFrame([("t", "f", "nowhere", "d", ok), ("t", "f2", None, "d", ok)], f"trace_id string, id string, step_id string, description string, provenance {prov}")
    got = {(r.part, r.ref_id, r.rule) for r in TR.validate_records(steps, edges, goals, flags=flags).collect()}
    assert got == {
        ("step", "a", "duplicate_id"), ("step", "b", "unknown_group"), ("step", "b", "index_below_one"), ("step", "b", "empty_description"), ("step", "b", "no_tools"), ("step", "b",
        "unknown_origin"), ("step", "b", "no_source_evidence"), ("step", "b", "confidence_out_of_range"),
        ("step", None, "no_id"), ("step", None, "no_provenance"), ("edge", "3", "unknown_from"), ("edge", "3", "unknown_to"), ("goal", "h", "empty_description"), ("goal", "h", "empty_task"), ("goal",
        "h", "verified_unknown"), ("goal", "h", "duration_zero"), ("goal", "h", "no_answer"), ("record", "h", "no_steps"), ("flag", "f", "unknown_step"),
    }


def test_statistics_of_reruns(spark):
    shape = "item string, step int, at int, score double, predicate string"
    a = spark.createDataFrame([("i", 1, 1, 0.9, "supported"), ("i", 1, 2, 0.1, "unsupported"), ("j", 1, 1, 0.5, "partial"), ("k", 1, 1, None, None)], shape)
    b = spark.createDataFrame([("i", 1, 1, 0.9, "supported"), ("j", 1, 1, 0.5, "partial"), ("k", 1, 1, 0.01, "unsupported")], shape)
    d = E.drift(a, b, ["item", "step"])
    assert {r["item"]: (round(r.delta, 3), r.drifted, bool(r.collapsed)) for r in d.collect()} == {"i": (0.8, True, True), "j": (0.0, False, False), "k": (0.01, False, False)}
    v = spark.createDataFrame([("BLOCK", "ALLOW"), ("ALLOW", "BLOCK"), ("HOLD", "ALLOW"), ("HOLD", "HOLD")], "verdict_a string, verdict_b string")
    got = {r.criterion: (r.value, r.passes) for r in E.drift_acceptance(d, v).collect()}
    assert got["verdict_flips"] == (3, False) and got["block_to_allow"] == (1, False) and got["collapsed"] == (1, False) and got["max_drift"][1] is False
    assert all(r.passes for r in E.drift_acceptance(d.limit(0), v.limit(0)).collect())
    lab = spark.createDataFrame([(str(i), "A", "A" if i < 7 else "B") for i in range(10)], "id string, gold string, verdict string")
    s = E.leave_one_out_summary(E.leave_one_out(lab, "id")).head()
    folds = [(7 - (i < 7)) / 9 for i in range(10)]
    mean = sum(folds) / 10
    assert s.mean == pytest.approx(mean) and s.deviation == pytest.approx((sum((f - mean) ** 2 for f in folds) / 9) ** 0.5) and s.passes is False
    assert E.influential(E.leave_one_out(lab, "id")).where("direction = 'removal improves'").count() == 3


def test_generated_plans(spark):
    steps = spark.createDataFrame([("ok", i, "a long description", "critical" if i == 1 else "supporting") for i in (1, 2, 3)] + [("few", 1, "a long description", "critical")] + [("gap", i, "a long description", "critical") for i in (1, 2, 4)] + [("short", i, "tiny", "critical") for i in (1, 2, 3)] + [("odd", i, "a long description", "x") for i in (1, 2, 3)] + [("none", i, "a long description", "supporting") for i in (1, 2, 3)], "k string, idx int, description string, criticality string")
    assert {r.k: r.problem for r in records.check_generated(steps, "k").collect()} == {"ok": None, "few": "step_count", "gap": "index", "short": "description", "odd": "criticality", "none": "no_critical"}
    entries = spark.createDataFrame([("ok", 1, "supporting", "r"), ("ok", 2, "critical", "r"), ("ok", 3, "supporting", "r")], "k string, idx int, criticality string, reason string")
    new = records.rewrite_criticality(steps.where("k = 'ok'"), entries, "k")
    assert {r.idx: (r.criticality, r.change) for r in new.collect()} == {1: ("supporting", "demoted"), 2: ("critical", "promoted"), 3: ("supporting", None)}
    assert tuple(records.calibration_stats(new, "k").head()) == (1, 1, 1, 1)
    plans = spark.createDataFrame([("ok", 3), ("less", 2)], "k string, n_steps int")
    assert {r.k: r.problem for r in records.check_calibration(entries, plans, "k").collect()} == {"ok": None, "less": "length"}
    assert one(spark, records.domain_of(F.lit("Which tax does the IRS ask, by law?"))) == "financial" and one(spark, records.domain_of(F.lit(None).cast("string"))) == "general"
    assert one(spark, records.resolved_answer(F.lit('{"args": ["x"]}'))) == "x" and one(spark, records.resolved_answer(F.lit("plain"))) == "plain"
    assert one(spark, records.repository_of(F.lit("https://github.com/a/b.git"))) == "a/b" and one(spark, records.base_url(F.lit(" http://x// "))) == "http://x"


def test_sinks_that_refuse(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_unique(rows, str(tmp_path / "u"), "k")
    for again in (rows.limit(1), spark.createDataFrame([(9, "x"), (9, "y")], rows.schema)):
        with pytest.raises(ValueError, match="already"):
            sinks.append_unique(again, str(tmp_path / "u"), "k")
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
    sinks.write_report(rows.limit(1), str(tmp_path / "r"))
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())) == {"k": 1, "v": "a"}
    shape = "block_id string, model string, role string, domain string, score_given double, verdict string, material_count int, notable_count int, minor_count int, recorded_at long"
    run = ("b", "m", "critic", None, 0.5, "ALLOW", None, 2, None, 1)
    r = sinks.with_run_defaults(spark.createDataFrame([run], shape)).head()
    assert (r.domain, r.material_count, r.notable_count, r.minor_count) == ("general", 0, 2, 0)
    for bad, what in (((*run[:4], None, *run[5:]), "no score_given"), ((*run[:2], "x", *run[3:]), "unknown role")):
        with pytest.raises(Exception, match=what):
            sinks.with_run_defaults(spark.createDataFrame([bad], shape)).collect()
