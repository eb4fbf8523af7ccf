"""Queries of the reference's own operators, bound to the test tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.functions import similarity as S, text as T
from evigrid.operators import align, discourse, entail, evalstats as E, grading as G, provenance as P, records, scan, traces as TR
from evigrid.plans import alignment_sql, discourse_sql, reference_sql
from evigrid.session import Scratch, table

FAMILIES = "o_orderpriority"


# --- graded steps: a line item is a graded step of its order --------------------------------------


def graded(spark: SparkSession, d: str, judge: str = "a") -> DataFrame:
    """Line items as graded steps; judge a scores by discount, judge b by tax."""
    li = table(spark, d, "lineitem")
    score = F.round(F.col("l_discount") * 10, 2) if judge == "a" else F.round(F.col("l_tax") * 12.5, 4)
    raw = li.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("step_no"), score.alias("raw_score"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "supporting").otherwise("optional").alias("criticality"),
        F.when(F.col("l_linestatus") == "O", "answer_consistency").otherwise("trace_evidence").alias("step_type"),
        F.when(F.col("l_tax") < 0.005, F.lit(None)).when(F.col("l_tax") < 0.015, "short").otherwise("a quote that is long enough").alias("quote"), F.col("l_shipdate").alias("at"),
    )
    return raw.withColumn("score", G.floored(F.col("raw_score"), F.col("quote"))).withColumn("predicate", G.predicate(F.col("score"), F.col("quote")))


def verdicts(spark: SparkSession, d: str, judge: str = "a") -> DataFrame:
    return G.fold_verdicts(graded(spark, d, judge))


def graded_verdict(spark, d):
    v = verdicts(spark, d)
    return v.select("item_id", "verdict", "fail_score", "low_confidence", "n_steps", F.round("mean_score", 9).alias("mean_score"))


def graded_verdict_counts(spark, d):
    return verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


def step_predicates(spark, d):
    return graded(spark, d).groupBy("criticality", "step_type", "predicate").agg(F.count("*").alias("n"))


def public_verdict(spark, d):
    return verdicts(spark, d).groupBy(G.public_verdict(F.col("verdict")).alias("public")).agg(F.count("*").alias("n"))


def _two(spark, d):
    a = verdicts(spark, d).select("item_id", F.col("verdict").alias("a"))
    return a.join(verdicts(spark, d, "b").select("item_id", F.col("verdict").alias("b")), "item_id")


def conservative_merge(spark, d):
    return _two(spark, d).select("item_id", "a", "b", G.stricter(F.col("a"), F.col("b")).alias("merged"))


def _cascaded(spark, d):
    two = _two(spark, d)
    failed = F.when(F.col("item_id") % 17 == 0, F.lit(None)).otherwise(F.col("a")), F.when(F.col("item_id") % 13 == 0, F.lit(None)).otherwise(F.col("b"))
    out = two.withColumn("c", G.cascade(failed[0], failed[1], F.col("item_id") % 2 == 0, F.col("item_id") % 3 == 0))
    return out.where("c IS NOT NULL").select("item_id", "c.*")


def cascade_decision(spark, d):
    return _cascaded(spark, d)


def cascade_stats(spark, d):
    timed = _cascaded(spark, d).withColumn("primary_ms", (F.col("item_id") % 1000).cast("double")).withColumn("secondary_ms", F.when(F.col("invoked"), (F.col("item_id") % 700).cast("double")))
    s = G.cascade_stats(timed)
    return s.select("total", "agreements", "disagreements", "fallbacks", *[F.round(c, 9).alias(c) for c in ("mean_primary_ms", "mean_secondary_ms", "early_exit_rate")])


def tier1_routing(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select((F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_returnflag") == "R", "critical").otherwise("optional").alias("criticality"), F.when(F.col("l_linestatus") == "O", "answer_consistency").alias("step_type"))
    return g.groupBy(G.route(F.col("confidence"), F.col("criticality"), F.col("step_type")).alias("route")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


def tier_merge(spark, d):
    g = graded(spark, d).select("item_id", "step_no", "score", "criticality")
    out = G.merge_tiers(g, g.where("criticality = 'critical'"), g.where("criticality = 'supporting'"), ["item_id", "step_no"])
    return out.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


#: Model names of every family and of none, dealt to the parts by their numbers.
MODEL_NAMES = ("claude-3", "GPT-4o", "o3-mini", "my-o1", "solo1", "grok-2", "kimi-k2", "moonshot-v1", "deepseek-r1", "Gemini-2", "llama-3", "opus", "bo4t")


def model_family(spark, d):
    names = F.concat(F.element_at(F.array(*map(F.lit, MODEL_NAMES)), (F.col("p_partkey") % len(MODEL_NAMES) + 1).cast("int")), F.lit("/"), F.lower(F.substring("p_brand", 7, 2)))
    return table(spark, d, "part").groupBy(names.alias("model"), G.family(names).alias("family")).agg(F.count("*").alias("n"))


# --- statistics --------------------------------------------------------------------------------


def _labelled(spark, d):
    gold = table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("item_id")).agg(F.min("o_orderstatus").alias("s"), F.min(FAMILIES).alias("family"))
    gold = gold.withColumn("gold", F.when(F.col("s") == "F", "ALLOW").when(F.col("s") == "P", "HOLD").otherwise("BLOCK"))
    return verdicts(spark, d).join(gold, "item_id").select("item_id", "family", "gold", "verdict")


def confusion(spark, d):
    return E.confusion(_labelled(spark, d))


def accuracy_by_family(spark, d):
    a = E.accuracy(_labelled(spark, d), "family")
    return a.select("family", "n", "correct", F.round("accuracy", 9).alias("accuracy"))


def wilson_ci(spark, d):
    a = E.accuracy(_labelled(spark, d), "family")
    low, high = E.wilson(F.col("correct"), F.col("n"))
    return a.select("family", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def loocv(spark, d):
    return E.leave_one_out(_labelled(spark, d), "item_id").groupBy("hit").agg(F.count("*").alias("n"), F.round(F.avg("accuracy_without"), 9).alias("mean_without"), F.round(F.max("influence"), 9).alias("max_influence"))


def loocv_summary(spark, d):
    s = E.leave_one_out_summary(E.leave_one_out(_labelled(spark, d), "item_id"), 0.3)
    return s.select("n", "correct", *[F.round(c, 9).alias(c) for c in ("mean", "least", "greatest", "accuracy", "low", "high")], F.round("deviation", 12).alias("deviation"), "passes")


def loocv_influential(spark, d):
    return E.influential(E.leave_one_out(_labelled(spark, d), "item_id"), over=1e-6).select(F.col("item").alias("item_id"), F.round("impact", 12).alias("impact"), "direction")


def verdict_mismatches(spark, d):
    return E.mismatches(_labelled(spark, d), "item_id")


def case_families(spark, d):
    """Cases named after line items, in both namings and in none."""
    starts = F.array(*[F.lit(x) for x in ("V0-", "V1-", "V2-", "V3-", "GAIA-", "B-", "C-", "D-", "H-", "X-", "VV0-")])
    ids = table(spark, d, "orders").select(F.concat(F.element_at(starts, (F.col("o_orderkey") % 11 + 1).cast("int")), F.col("o_orderkey").cast("string")).alias("case_id"))
    return ids.groupBy(E.id_family(F.col("case_id")).alias("family")).agg(F.count("*").alias("n"))


def drift_acceptance(spark, d):
    v = _two(spark, d).select(F.col("a").alias("verdict_a"), F.col("b").alias("verdict_b"))
    return E.drift_acceptance(_drift(spark, d), v).select("criterion", F.round("value", 9).alias("value"), "target", "passes")


def verdict_flips(spark, d):
    return _two(spark, d).groupBy(E.flip_kind(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n")).where("kind IS NOT NULL")


def benchmark_status(spark, d):
    return _labelled(spark, d).groupBy(E.benchmark_status(F.col("gold"), F.col("verdict")).alias("status")).agg(F.count("*").alias("n"))


def recall_by_class(spark, d):
    return E.recall(_labelled(spark, d)).select("gold", "n", F.round("recall", 9).alias("recall"))


def verdict_kappa(spark, d):
    return E.kappa(_two(spark, d), "a", "b").select("total", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def _drift(spark, d):
    cut = lambda j: graded(spark, d, j).select("item_id", "step_no", "at", F.col("raw_score").alias("score"), F.when(F.col("raw_score") < 0.25, "unsupported").otherwise("partial").alias("predicate"))
    return E.drift(cut("a"), cut("b"), ["item_id", "step_no"])


def score_drift(spark, d):
    s = E.drift_summary(_drift(spark, d))
    return s.select("compared", "drifted", "collapsed", *[F.round(c, 9).alias(c) for c in ("max_delta", "mean_delta", "oscillator_rate")])


def drift_top10(spark, d):
    return _drift(spark, d).select("item_id", "step_no", F.round("delta", 6).alias("delta")).orderBy(F.desc("delta"), "item_id", "step_no").limit(10)


def verdict_transitions(spark, d):
    return E.transitions(_two(spark, d), "a", "b")


def stability_3run(spark, d):
    two = _two(spark, d)
    runs = two.withColumn("c", G.stricter(F.col("a"), F.col("b")))
    return E.stability(runs, "item_id", ["a", "b", "c"]).select("cases", F.round("any_rate", 9).alias("any_rate"), F.round("pair_flip_rate", 9).alias("pair_flip_rate"))


def model_correlation(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_discount", "l_tax"), 8).alias("r_ab"), F.round(F.corr("l_discount", "l_quantity"), 8).alias("r_ac"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r_cd"))


def threshold_sweep(spark, d):
    scores = graded(spark, d).withColumn("ok", F.col("criticality") != "critical")
    return E.threshold_sweep(scores, "raw_score", F.col("ok"), [0.5, 0.5625, 0.625, 0.75]).select("threshold", "correct", "n", F.round("accuracy", 9).alias("accuracy"))


def predicate_shift(spark, d):
    old = F.when(F.col("raw_score") >= 0.75, "supported").when(F.col("raw_score") >= 0.5, "partial").otherwise("unsupported")
    return graded(spark, d).groupBy(old.alias("old"), F.col("predicate").alias("new")).agg(F.count("*").alias("n"))


def judge_calibration(spark, d):
    runs = table(spark, d, "judge_runs").distinct().select("model", "role", "domain", F.upper(F.trim(F.regexp_replace("verdict", r"\s", ""))).alias("verdict"), F.col("score_given").alias("score"), F.col("material_count").alias("material"))
    c = E.judge_calibration(runs)
    return c.select("model", "role", "domain", "n_runs", F.round("avg_score", 8).alias("avg_score"), F.round("avg_score_first_verdict", 8).alias("avg_score_first_verdict"), F.round("avg_material", 8).alias("avg_material"), "n_allow", "n_hold", "n_block", "bias")


def model_diversity(spark, d):
    rows = table(spark, d, "proposals").select("block_id", "pos", "model").distinct()
    return E.diversity(rows, "block_id", "model").select("block_id", "n", F.round("diversity", 9).alias("diversity"))


def majority_vote(spark, d):
    return E.majority(table(spark, d, "gaia_traces").select("trace_id", "task_id", "answer").distinct(), "task_id", "answer")


def batch_summary(spark, d):
    v = verdicts(spark, d)
    return v.agg(F.count("*").alias("items"), F.round(F.avg("mean_score"), 9).alias("mean"), F.round(F.min("mean_score"), 9).alias("low"), F.round(F.max("mean_score"), 9).alias("high"), F.count_if(F.col("mean_score") < 0.5).alias("below_half"), F.sum("n_steps").alias("steps"))


def top_missed(spark, d):
    bad = graded(spark, d).where("predicate IN ('skipped', 'unsupported')")
    return E.top_missed(bad, "step_no", "item_id")


# --- text ---------------------------------------------------------------------------------------


def lex_tokens(spark, d):
    steps = table(spark, d, "plan_steps").select("description").where("description IS NOT NULL").distinct()
    return steps.select(F.explode(T.lexical_tokens(F.col("description"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def semantic_tokens(spark, d):
    steps = table(spark, d, "plan_steps").select("description").where("description IS NOT NULL").distinct()
    return steps.select(F.explode(T.semantic_tokens(F.col("description"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def stem_tokens(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^a-z0-9]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return words.select("w", T.stem(F.col("w")).alias("stem"), "n")


def question_answer_jaccard(spark, d):
    t = table(spark, d, "gaia_traces").select("trace_id", "question", "answer").distinct().where("answer IS NOT NULL")
    return t.select("trace_id", F.round(S.jaccard(T.word_set(F.col("question")), T.word_set(F.col("answer")), 1.0), 9).alias("similarity")).distinct()


def token_levenshtein(spark, d):
    p = table(spark, d, "part").select(F.lower("p_brand").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(S.token_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def soft_similarity(spark, d):
    t = table(spark, d, "gaia_traces").select("trace_id", "question", F.get("trace.steps", F.lit(0))["summary"].alias("summary")).distinct().where("summary IS NOT NULL")
    return t.select("trace_id", F.round(S.soft_jaccard(T.lexical_tokens(F.col("question")), T.lexical_tokens(F.col("summary"))), 9).alias("soft")).distinct()


def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"), F.size(T.word_set(F.col("text"))).alias("n_words"))


def dissent_score(spark, d):
    rows = table(spark, d, "proposals").where("content IS NOT NULL").select("block_id", "pos", "content").distinct()
    return discourse.dissent(rows, "block_id", "pos", "content").select("block_id", "n", F.round("dissent", 9).alias("dissent"))


def synthesis_similarity(spark, d):
    return discourse.synthesis_similarity(table(spark, d, "proposals").select("block_id", "pos", "content").distinct(), "block_id", "pos", "content")


def _synthesis(spark, d):
    """The last proposal of each block as its synthesis."""
    return table(spark, d, "proposals").groupBy("block_id").agg(F.max_by(F.coalesce("content", F.lit("")), F.struct("pos", F.coalesce("content", F.lit("")))).alias("synthesis"), F.max("pos").alias("last"))


def _balance(spark, d):
    synth = _synthesis(spark, d)
    rows = table(spark, d, "proposals").groupBy("block_id", "pos").agg(F.max("content").alias("content"), F.max("model").alias("model")).join(synth.select("block_id", "last"), "block_id").where("pos < last")
    return discourse.member_coverage(rows.withColumn("member", F.concat_ws(":", "pos", "model")), "block_id", "member", "content", synth)


def synthesis_coverage(spark, d):
    return _balance(spark, d).select("block_id", "member", F.round("coverage", 9).alias("coverage"), F.round("share", 9).alias("share"))


def synthesis_balance(spark, d):
    return discourse.synthesis_balance(_balance(spark, d), "block_id", "member")


def objection_preservation(spark, d):
    """Each judge's assessment and the block's proposals but the last as critiques of the synthesis; words of the objections' list take the place of near ones."""
    said = table(spark, d, "judge_runs").where("overall_assessment IS NOT NULL").select("block_id", F.concat(F.lit("run:"), "id").alias("critique_id"), F.col("overall_assessment").alias("critique")).distinct()
    synth = _synthesis(spark, d)
    held = table(spark, d, "proposals").where("content IS NOT NULL").select("block_id", "pos", "content").distinct().join(synth.select("block_id", "last"), "block_id").where("pos < last")
    both = said.unionByName(held.groupBy("block_id", "pos").agg(F.max("content").alias("critique")).select("block_id", F.concat(F.lit("pos:"), "pos").alias("critique_id"), "critique"))
    warned = discourse.synthesis_balance(_balance(spark, d), "block_id", "member").select("block_id", F.col("warning").alias("warned"))
    both = both.withColumn("critique", F.regexp_replace(F.regexp_replace(F.regexp_replace("critique", "disputes", "disputed"), "although", "however"), "missing", "unverified"))
    rows = both.join(synth.select("block_id", "synthesis"), "block_id", "left").join(warned, "block_id", "left")
    out = discourse.preservation(rows)
    return out.select("block_id", "critique_id", "objections", "preserved", "score", "false_consensus", F.array_join("keywords", " ").alias("keywords"))


# --- alignment ----------------------------------------------------------------------------------


def _groups(spark, d, *names, semantic=False):
    """Profiles of several groups, written once together."""
    steps = align.latest_steps(table(spark, d, "plan_steps")).where(F.col("grp").isin(*names))
    every = Scratch(spark).cut(align.group_profiles(steps, semantic))
    return [every.where(F.col("grp") == n).drop("grp") for n in names]


def _sides(spark, d, semantic=False):
    return _groups(spark, d, "agent:plan", "annotator", semantic=semantic)


def align_candidates(spark, d):
    return align.candidates(*_sides(spark, d)).select("trace_id", "agent_id", "annotator_id", F.round("score", 9).alias("score"))


def align_best_per_annotator(spark, d):
    return align.best_per_annotator(align.candidates(*_sides(spark, d))).select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"), "n_candidates")


def align_greedy(spark, d):
    return align.assign(align.candidates(*_sides(spark, d))).select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"))


def align_coverage(spark, d):
    agent, annotator = _sides(spark, d)
    return align.coverage(annotator, align.assign(align.candidates(agent, annotator))).select("trace_id", "n_steps", "n_covered", F.round("coverage", 9).alias("coverage"))


def align_gaps(spark, d):
    agent, annotator = _sides(spark, d)
    cands = Scratch(spark).cut(align.candidates(agent, annotator))
    return align.gaps(annotator, align.assign(cands), align.best_per_annotator(cands)).select("trace_id", "annotator_id", F.round("best_score", 9).alias("best_score"), "conflict")


def _semantic(spark, d):
    """Both sides, all pairs with content in semantic mode, those that match, and the assignment."""
    agent, annotator = _sides(spark, d, True)
    scratch = Scratch(spark)
    content = scratch.cut(align.semantic_candidates(agent, annotator, None))
    passing = content.where(F.col("score") + align.EPSILON >= align.MINIMUM)
    return agent, annotator, content, passing, scratch.cut(align.assign(passing))


def align_semantic_candidates(spark, d):
    agent, annotator = _sides(spark, d, True)
    return align.semantic_candidates(agent, annotator).select("trace_id", "agent_id", "annotator_id", F.round("semantic", 9).alias("semantic"), F.round("score", 9).alias("score"))


def align_semantic_greedy(spark, d):
    *_, done = _semantic(spark, d)
    return done.select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"))


def align_gap_descriptions(spark, d):
    agent, annotator, content, _, done = _semantic(spark, d)
    return align.gap_descriptions(annotator, done, align.best_raw(agent, annotator, content)).select("trace_id", "annotator_id", "best_agent_id", F.round("best_score", 9).alias("best_score"), "reason")


def align_conflicts(spark, d):
    _, annotator, _, passing, done = _semantic(spark, d)
    return align.conflicts(annotator, passing, done).select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"), "held_by")


def align_content_gate(spark, d):
    agent, annotator, content, passing, _ = _semantic(spark, d)
    return align.content_gate_blocks(annotator, passing, align.best_raw(agent, annotator, content)).select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"))


def align_risk_flags(spark, d):
    agent, annotator, content, _, done = _semantic(spark, d)
    return align.risk_flags(agent, done, align.gap_descriptions(annotator, done, align.best_raw(agent, annotator, content)))


def align_near_misses(spark, d):
    agent, annotator, content, _, done = _semantic(spark, d)
    return align.near_misses(annotator, done, align.best_raw(agent, annotator, content), width=0.1).select("trace_id", "annotator_id", "agent_id", F.round("score", 9).alias("score"))


def _modes(spark, d):
    agent, annotator, _, _, done = _semantic(spark, d)
    return align.mode_benchmark(annotator, align.assign(align.candidates(agent, annotator)), done)


def align_mode_benchmark(spark, d):
    return _modes(spark, d).select("trace_id", "n_steps", "lexical_covered", "semantic_covered", *[F.round(c, 9).alias(c) for c in ("lexical_coverage", "semantic_coverage", "coverage_delta")])


def align_mode_summary(spark, d):
    return align.mode_summary(_modes(spark, d)).select("mode", "traces", *[F.round(c, 9).alias(c) for c in ("mean_coverage", "min_coverage", "max_coverage")], "covered", "uncovered")


def segment_support(spark, d):
    return align.segment_support(*_sides(spark, d)).select("trace_id", "agent_id", "start_pos", "len", F.round("score", 9).alias("score"))


def merged_support(spark, d):
    plan, done, annotator = _groups(spark, d, "agent:plan", "agent:exec", "annotator")
    return align.merged_support(annotator, align.assign(align.candidates(plan, annotator)), align.assign(align.candidates(done, annotator)), align.segment_support(plan, annotator)).select("trace_id", "annotator_id", "source", "kind")


def support_flags(spark, d):
    return align.support_flags(merged_support(spark, d))


# --- provenance -----------------------------------------------------------------------------------


def _quotes(spark, d):
    """All quotes with the evidence of the step they point to, in the latest row of its trace, as one text; null where there is no such step."""
    steps = records.latest_traces(table(spark, d, "gaia_traces")).select("trace_id", F.posexplode("trace.steps").alias("i", "step")).select(
        "trace_id", F.concat(F.lit("step_"), F.col("i") + 1).alias("step_id"), F.array_join(F.filter("step.evidence", lambda e: e.isNotNull()), "\n").alias("source")
    )
    return table(spark, d, "quote_reports").distinct().join(steps, ["trace_id", "step_id"], "left").where("quote IS NOT NULL")


def quote_exact(spark, d):
    q = _quotes(spark, d)
    return q.select("report_id", F.col("source").isNotNull().alias("has_source"), (F.col("source").contains(P.clean_quote(F.col("quote"))) | F.col("source").contains(F.col("quote"))).alias("exact"))


def quote_match_paths(spark, d):
    return P.with_match_path(_quotes(spark, d), "quote", "source").select("report_id", "model", "match_path", F.array_join(P.codes(F.lit(1.0), F.col("quote"), F.col("match_path")), ",").alias("codes"))


def quote_longest_prefix(spark, d):
    return _quotes(spark, d).select("report_id", P.longest_prefix(F.col("quote"), F.col("source")).alias("prefix"))


def quote_variants(spark, d):
    q = _quotes(spark, d).select("report_id", "source", F.explode(P.variants(F.col("quote"))).alias("v")).select("report_id", "source", "v.*")
    return P.with_match_path(q, "text", "source").groupBy("kind", "match_path").agg(F.count("*").alias("n"))


def quote_diagnosis(spark, d):
    found = P.diagnose(_quotes(spark, d))
    return found.select("report_id", "match_path", "prefix", "position", "quote_hex", F.array_join("signals", " ").alias("signals"), "mode")


def quote_path_distribution(spark, d):
    return P.path_distribution(P.diagnose(_quotes(spark, d)))


def quote_probe_sweep(spark, d):
    """Per kind of variant, matches without and with the unicode and unwrapping paths."""
    q = _quotes(spark, d).where("source IS NOT NULL").select("source", F.explode(P.variants(F.col("quote"))).alias("v")).select("source", "v.*")
    return P.probe_sweep(q)


def claim_support(spark, d):
    t = records.latest_traces(table(spark, d, "gaia_traces")).where("answer IS NOT NULL")
    evidence = F.filter(F.flatten(F.transform("trace.steps", lambda s: F.coalesce(s["evidence"], F.array().cast("array<string>")))), lambda e: e.isNotNull())
    return entail.span_entailment(t.select("trace_id", "question", "answer", F.array_join(evidence, "\n").alias("source")), "trace_id", "question", "answer", "source")


def source_claim_join(spark, d):
    """Traces with the source claim of their ground truth."""
    traces = table(spark, d, "gaia_traces")
    return entail.with_claims(records.latest_traces(traces).select("trace_id", "task_id"), entail.source_claims(traces)).select("trace_id", "task_id", "support", "confidence", "matched_span")


# --- scans, sequences, integrity -------------------------------------------------------------------

_PATTERNS = [("(?i)flood of [0-9]+", "flood", "high"), ("https?://", "link", "medium"), ("[0-9]+ percent", "percent", "low"), ("(?i)missing", "missing", "critical")]


def _found(spark, d):
    return scan.findings(scan.lines_of(table(spark, d, "documents"), "doc_id", "text"), _PATTERNS)


def pattern_scan(spark, d):
    return _found(spark, d).groupBy("label", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def scan_first(spark, d):
    return scan.first_per(_found(spark, d), ["file", "label"], ["line_no"]).select("file", "label", "line_no")


def scan_context(spark, d):
    ctx = scan.guard_context(scan.lines_of(table(spark, d, "documents"), "doc_id", "text"), "missing", 2)
    return ctx.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if("guarded").alias("n_guarded"), F.min("first_guard").alias("first_guard"))


def scan_attest(spark, d):
    return scan.attest(_found(spark, d), "file", ["label", "line_no"]).select("file", "short_id")


def seq_edges(spark, d):
    return TR.sequence_edges(align.latest_steps(table(spark, d, "plan_steps")), ["trace_id", "grp"], "idx", "step_id")


def flow_endpoints(spark, d):
    return TR.flow_ends(align.latest_steps(table(spark, d, "plan_steps")), ["trace_id", "grp"], "idx", "step_id")


def span_tree(spark, d):
    r = table(spark, d, "region").select(F.lit("t").alias("trace_id"), F.concat(F.lit("r"), "r_regionkey").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("r_regionkey").alias("pos"))
    n = table(spark, d, "nation").select(F.lit("t"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey"))
    s = table(spark, d, "supplier").select(F.lit("t"), F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_suppkey").cast("int"))
    return TR.flatten_spans(r.union(n).union(s)).select("span_id", "depth", "path")


def enrich_gold(spark, d):
    t = table(spark, d, "gaia_traces").select("trace_id", "task_id", "answer").distinct()
    gold = table(spark, d, "gaia_traces").where("ground_truth IS NOT NULL").select("task_id", F.col("ground_truth").alias("true_answer"), F.lit(None).cast("array<string>").alias("accepted"))
    return TR.enrich_gold(t, gold, "task_id").select("trace_id", "true_answer", "answer_correct")


def plan_validate(spark, d):
    return TR.validate_steps(table(spark, d, "plan_steps"))


def resume_anti(spark, d):
    t = table(spark, d, "gaia_traces").select("trace_id", "task_id").distinct()
    return TR.only_new(t, table(spark, d, "quote_reports").select("trace_id"), "trace_id")


def slice_scan(spark, d):
    return table(spark, d, "judge_runs").select("id").distinct().orderBy("id").offset(100).limit(50)


def block_lookup(spark, d):
    return table(spark, d, "blocks").where(F.col("id").rlike("^PoT-[0-9]{3,12}$") & (F.regexp_extract("id", "([0-9]+)$", 1).cast("long").isin(1, 5, 17, 40))).select("id", "question", "domain").distinct()


def next_block_ids(spark, d):
    """Ids that a sequence-numbered sink gives to the ten items that follow."""
    top = table(spark, d, "blocks").agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")).alias("top"))
    return top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + 10)).alias("n")).select("n", F.concat(F.lit("PoT-"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("id"))


_NAMES = """graded_verdict graded_verdict_counts step_predicates public_verdict conservative_merge cascade_decision cascade_stats tier1_routing tier_merge model_family
confusion accuracy_by_family wilson_ci loocv benchmark_status recall_by_class verdict_kappa loocv_summary loocv_influential verdict_mismatches case_families drift_acceptance verdict_flips score_drift drift_top10 verdict_transitions stability_3run model_correlation
threshold_sweep predicate_shift judge_calibration model_diversity majority_vote batch_summary top_missed lex_tokens semantic_tokens stem_tokens question_answer_jaccard
token_levenshtein soft_similarity sentence_counts dissent_score synthesis_similarity objection_preservation synthesis_coverage synthesis_balance align_semantic_candidates align_semantic_greedy align_gap_descriptions align_conflicts align_content_gate align_risk_flags
align_near_misses align_mode_benchmark align_mode_summary align_candidates align_best_per_annotator align_greedy align_coverage
align_gaps segment_support merged_support support_flags quote_exact quote_match_paths quote_longest_prefix quote_variants quote_diagnosis quote_path_distribution quote_probe_sweep claim_support source_claim_join pattern_scan scan_first scan_context scan_attest
seq_edges flow_endpoints span_tree enrich_gold plan_validate resume_anti slice_scan block_lookup next_block_ids""".split()
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLE = reference_sql.ORACLE | alignment_sql.ORACLE | discourse_sql.ORACLE
