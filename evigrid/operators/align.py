"""Alignment of agent steps with annotator steps: candidates, one-to-one assignment, spans, support."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evigrid.functions import similarity as S, text as T
from evigrid.operators.traces import ranked
from evigrid.session import Scratch

#: Lowest composite score of a match, and slack of the comparison.
MINIMUM, EPSILON = 0.25, S.EPSILON


def latest_steps(history: DataFrame) -> DataFrame:
    """The latest live row of each step: (trace_id, step_id, grp, idx, description, tools)."""
    last = history.where("trace_id IS NOT NULL AND step_id IS NOT NULL").groupBy("trace_id", "step_id").agg(
        F.max(F.struct("loaded_at", (~F.coalesce("deleted", F.lit(False))).alias("live"), "description", "grp", "idx", "tools")).alias("r")
    )
    return last.where("r.live").select("trace_id", "step_id", "r.grp", "r.idx", "r.description", "r.tools")


def group_profiles(steps: DataFrame, semantic: bool = False) -> DataFrame:
    """Steps with their token and tool sets, their rank in their group of their trace, and the group's size, for all groups at once; meanings only for the semantic mode."""
    said = F.coalesce("description", F.lit(""))
    meanings = T.semantic_tokens(said) if semantic else F.array().cast("array<string>")
    return ranked(steps, ["trace_id", "grp"], "idx", "step_id").select(
        "trace_id", "step_id", "grp", "pos", "size", T.lexical_tokens(said).alias("tokens"), meanings.alias("meanings"), F.array_distinct(F.coalesce("tools", F.array().cast("array<string>"))).alias("tools")
    )


def profiles(steps: DataFrame, grp: str, semantic: bool = False) -> DataFrame:
    """The profiles of one group."""
    return group_profiles(steps.where(F.col("grp") == grp), semantic).drop("grp")


#: Steps of a trace that stand under one key before the key is split by their positions.
STRETCH = 256


def _shared(agent: DataFrame, annotator: DataFrame) -> DataFrame:
    """(trace_id, agent_id, annotator_id, key) wherever both steps hold a key. Both sides: trace_id, step_id, pos, size, key.

    A key that many steps of a long trace hold is split by stretches of the agent's positions, and
    the annotator's rows are repeated once for each stretch that the trace has, so that no task
    holds more than STRETCH agent steps of a key, whatever the trace.
    """
    stretches = agent.groupBy("trace_id").agg((F.floor((F.max("pos") - 1) / STRETCH) + 1).alias("n_stretches"))
    left = agent.select("trace_id", F.col("step_id").alias("agent_id"), "key", F.floor((F.col("pos") - 1) / STRETCH).alias("stretch"))
    right = annotator.join(stretches, "trace_id").select("trace_id", F.col("step_id").alias("annotator_id"), "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_stretches") - 1)).alias("stretch"))
    return left.join(right, ["trace_id", "key", "stretch"]).select("trace_id", "agent_id", "annotator_id", "key")


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (token), distinct -> (a, b) for all pairs whose token similarity is not 0, both ways round and each with itself.

    Pairs are found by keys that any two such tokens share: one of at least five letters that begins
    the other shares its first five; two within k = floor(.18 * longer length) edits share, by the
    pigeonhole, one of the k + 1 pieces into which either is cut, at most k places apart. So a
    vocabulary is never crossed with itself. Keys come from one Arrow pass over distinct tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, ks = [], []
            for t in batch.column(0).to_pylist():
                keys = _near_keys(t)
                ts += [t] * len(keys)
                ks += keys
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array(ks, pa.string())], names=["token", "key"])

    keyed = tokens.select("token").distinct().mapInArrow(run, "token string, key string")
    pairs = keyed.select(F.col("token").alias("a"), "key").join(keyed.select(F.col("token").alias("b"), "key"), "key").where("a <> b").select("a", "b").distinct()
    same = tokens.select(F.col("token").alias("a"), F.col("token").alias("b")).distinct()
    return pairs.where(S.token_similarity(F.col("a"), F.col("b")) > 0).unionByName(same)


def _near_keys(t: str) -> list[str]:
    """Keys that t shares with every similar token: its beginning, and for each longer length n >= len(t) of a pair its pieces and places."""
    keys = {f"p{t[:5]}"} if len(t) >= 5 else set()
    # as the one that is cut (length n), and as a partner of a token of length m that is cut; the cut one is the longer, or as long
    n = len(t)
    k = int(0.18 * n + 1e-9)
    for i, (a, b) in enumerate(_pieces(n, k)):
        keys.add(f"{n}:{i}:{t[a:b]}")
    for m in range(n, n + 1 + int(0.18 * n / 0.82 + 2)):
        k = int(0.18 * m + 1e-9)
        if m - n > k:
            continue
        for i, (a, b) in enumerate(_pieces(m, k)):
            for shift in range(-k, k + 1):
                if 0 <= a + shift and b + shift <= n:
                    keys.add(f"{m}:{i}:{t[a + shift:b + shift]}")
    return sorted(keys)


def _pieces(n: int, k: int) -> list[tuple[int, int]]:
    ends = [round(n * (i + 1) / (k + 1)) for i in range(k + 1)]
    return list(zip([0, *ends[:-1]], ends))


def candidates(agent: DataFrame, annotator: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Pairs that reach the minimum and share content: (trace_id, agent_id, annotator_id, score, lexical, position, ...).

    A pair without a shared token or tool never matches, so pairs are found by a join on
    (trace, token or tool), which spreads a long trace over its words and, within a word that many
    of its steps hold, over their positions; no trace's steps are crossed.
    """
    return _scored(agent, annotator, False).where(F.col("score") + EPSILON >= minimum).drop("semantic")


def semantic_candidates(agent: DataFrame, annotator: DataFrame, minimum: float | None = MINIMUM) -> DataFrame:
    """The same in semantic mode: soft overlap of aliased stems counts too, and is content by itself.

    The composite is never below the lexical one. ``minimum=None`` keeps all pairs with content.
    """
    scored = _scored(agent, annotator, True)
    return scored if minimum is None else scored.where(F.col("score") + EPSILON >= minimum)


def _scored(agent: DataFrame, annotator: DataFrame, semantic: bool) -> DataFrame:
    tagged = lambda tag, c: F.transform(c, lambda t: F.concat(F.lit(tag), t))
    keyed = lambda df: df.select("trace_id", "step_id", "pos", "size", F.explode(F.concat(tagged("w:", "tokens"), tagged("t:", "tools"))).alias("key"))
    found = _shared(keyed(agent), keyed(annotator))
    if semantic:
        meant = lambda df: df.select("trace_id", "step_id", "pos", "size", F.explode("meanings").alias("token"))
        words = meant(agent).select("token").unionByName(meant(annotator).select("token")).distinct()
        near = similar_tokens(words)
        reach = meant(agent).join(near.select(F.col("a").alias("token"), F.col("b").alias("other")), "token").select("trace_id", "step_id", "pos", "size", F.concat(F.lit("m:"), "other").alias("key"))
        own = meant(annotator).select("trace_id", "step_id", "pos", "size", F.concat(F.lit("m:"), "token").alias("key"))
        found = found.unionByName(_shared(reach, own))
    shared = found.groupBy("trace_id", "agent_id", "annotator_id").agg(
        F.count_if(F.col("key").startswith("w:")).alias("common_tokens"), F.count_if(F.col("key").startswith("t:")).alias("common_tools")
    )
    extra = ["meanings"] if semantic else []
    side = lambda df, p: df.select(
        "trace_id", F.col("step_id").alias(f"{p}_id"), F.col("pos").alias(f"{p}_pos"), F.col("size").alias(f"{p}_size"),
        F.size("tokens").alias(f"{p}_tokens"), F.size("tools").alias(f"{p}_tools"), *[F.col(c).alias(f"{p}_{c}") for c in extra],
    )
    both = shared.join(side(agent, "agent"), ["trace_id", "agent_id"]).join(side(annotator, "annotator"), ["trace_id", "annotator_id"])
    union = lambda k: F.coalesce(F.try_divide(F.col(f"common_{k}"), F.col(f"agent_{k}") + F.col(f"annotator_{k}") - F.col(f"common_{k}")), F.lit(0.0))
    place = S.position_score(F.col("agent_pos"), F.col("agent_size"), F.col("annotator_pos"), F.col("annotator_size"))
    soft = S.soft_jaccard(F.col("agent_meanings"), F.col("annotator_meanings")) if semantic else F.lit(0.0)
    scored = both.withColumn("lexical", union("tokens")).withColumn("tool", union("tools")).withColumn("position", place).withColumn("semantic", soft)
    scored = scored.withColumn("score", S.composite(F.col("lexical"), F.col("position"), F.col("tool"), F.col("semantic") if semantic else None))
    return scored.select("trace_id", "agent_id", "annotator_id", "agent_pos", "annotator_pos", "lexical", "semantic", "position", "tool", "score")


def nearest(agent: DataFrame, annotator: DataFrame) -> DataFrame:
    """For each annotator step the agent steps that stand nearest in relative position, as pairs without content, in the shape of semantic_candidates.

    Position is the whole score of such a pair, so the nearest are the best of them: at most two rows a step.
    """
    n = agent.groupBy("trace_id").agg(F.max("size").alias("n"))
    at = F.when(F.col("size") <= 1, 0.5).otherwise((F.col("pos") - 1) / F.nullif(F.col("size") - 1, F.lit(0)))
    x = 1 + at * (F.col("n") - 1)
    places = annotator.join(n, "trace_id").select("trace_id", F.col("step_id").alias("annotator_id"), F.col("pos").alias("annotator_pos"), F.col("size").alias("m"), "n", F.explode(F.array_distinct(F.array(F.floor(x), F.ceil(x)))).alias("agent_pos"))
    pairs = places.withColumn("agent_pos", F.col("agent_pos").cast("int")).join(agent.select("trace_id", F.col("pos").alias("agent_pos"), F.col("step_id").alias("agent_id")), ["trace_id", "agent_pos"])
    place = S.position_score(F.col("agent_pos"), F.col("n"), F.col("annotator_pos"), F.col("m"))
    zero = F.lit(0.0)
    return pairs.select("trace_id", "agent_id", "annotator_id", "agent_pos", "annotator_pos", zero.alias("lexical"), zero.alias("semantic"), place.alias("position"), zero.alias("tool"), S.composite(zero, place, zero, zero).alias("score"))


def best_raw(agent: DataFrame, annotator: DataFrame, content: DataFrame) -> DataFrame:
    """The best pair of each annotator step whether or not it matches; the earliest agent step wins ties. content: all pairs with content."""
    every = content.unionByName(nearest(agent, annotator).join(content.select("trace_id", "agent_id", "annotator_id"), ["trace_id", "agent_id", "annotator_id"], "left_anti"))
    best = every.groupBy("trace_id", "annotator_id").agg(F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("agent_pos")).alias("p"), "agent_id", "score", "lexical", "semantic", "tool")).alias("b"))
    return best.select("trace_id", "annotator_id", "b.agent_id", "b.score", ((F.col("b.lexical") + F.col("b.semantic") + F.col("b.tool")) > 0).alias("has_content"))


def best_per_annotator(cands: DataFrame) -> DataFrame:
    """The best candidate of each annotator step; the earliest agent step wins ties."""
    best = cands.groupBy("trace_id", "annotator_id").agg(
        F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("agent_pos")).alias("p"), "agent_id", "score")).alias("b"), F.count("*").alias("n_candidates")
    )
    return best.select("trace_id", "annotator_id", F.col("b.agent_id").alias("agent_id"), F.col("b.score").alias("score"), "n_candidates")


def assign(cands: DataFrame) -> DataFrame:
    """One-to-one assignment: annotator steps in the order (fewest candidates, best score, position) each take their best free agent step.

    The same pairs come out of deferred acceptance, as all agent steps rank annotator steps by that
    one order: every annotator step holds its best remaining candidate, and an agent step that is
    held strikes out all candidates of later annotator steps for it. Rounds repeat until none is
    struck out, which ends, as each strikes out at least one. A round is two aggregates over all
    traces at once; a trace of any size is spread over its steps, and nothing is sorted within a
    task. A step of a long trace is settled once its holder has no earlier rival: settled pairs and
    their rivals leave the rounds, so that long chains of displacement shrink what later rounds read.
    """
    scratch = Scratch(cands.sparkSession)
    order = cands.groupBy("trace_id", "annotator_id").agg(F.count("*").alias("n"), F.max(F.round("score", 12)).alias("top"))
    third = [F.round("semantic", 12).alias("m")] if "semantic" in cands.columns else []
    preference = F.struct(F.round("score", 12).alias("s"), F.round("position", 12).alias("q"), *third, "lexical", (-F.col("agent_pos")).alias("a"), "agent_id")
    priority = F.struct("n", (-F.col("top")).alias("t"), "annotator_pos", "annotator_id")
    alive = scratch.cut(cands.join(order, ["trace_id", "annotator_id"]).select("trace_id", "agent_id", "annotator_id", "score", "lexical", preference.alias("pref"), priority.alias("prio")), "alive")
    done, parts = None, 0
    while not alive.isEmpty():
        wish = alive.groupBy("trace_id", "annotator_id").agg(F.max("pref").alias("p"), F.min("prio").alias("prio"))
        # of all that wish for an agent step the first in order holds it
        held = wish.groupBy("trace_id", F.col("p.agent_id").alias("agent_id")).agg(F.min("prio").alias("holder"))
        # the holder keeps it for good if nobody still alive who may want it comes earlier
        rival = alive.groupBy("trace_id", "agent_id").agg(F.min("prio").alias("first"))
        marks = scratch.cut(held.join(rival, ["trace_id", "agent_id"]).select("trace_id", "agent_id", "holder", (F.col("first") == F.col("holder")).alias("settled")), "marks")
        joined = alive.join(marks, ["trace_id", "agent_id"], "left")
        final = joined.where("settled AND prio = holder").select("trace_id", "annotator_id", "agent_id", "score", "lexical")
        final, parts = scratch.cut(final), parts + 1
        done = final if done is None else done.unionByName(final)
        if parts % 16 == 0:  # one table again, so that its plan stays short
            done = scratch.cut(done, "done")
        left = joined.where("holder IS NULL OR (NOT settled AND prio <= holder)").drop("holder", "settled")
        alive = scratch.cut(left.join(final.select("trace_id", "annotator_id"), ["trace_id", "annotator_id"], "left_anti"), "alive")
    return alive.select("trace_id", "annotator_id", "agent_id", "score", "lexical") if done is None else done


def coverage(annotator: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per trace: annotator steps, covered ones, and their share. Traces without annotator steps do not appear."""
    done = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(assigned.select("trace_id", "annotator_id", "score"), ["trace_id", "annotator_id"], "left")
    return done.groupBy("trace_id").agg(F.count("*").alias("n_steps"), F.count("score").alias("n_covered"), F.avg(F.col("score").isNotNull().cast("double")).alias("coverage"))


def gaps(annotator: DataFrame, assigned: DataFrame, best: DataFrame) -> DataFrame:
    """Annotator steps without a partner, with their best raw candidate and whether it was lost to another step."""
    free = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(assigned, ["trace_id", "annotator_id"], "left_anti")
    return free.join(best, ["trace_id", "annotator_id"], "left").select("trace_id", "annotator_id", F.coalesce("score", F.lit(0.0)).alias("best_score"), F.col("score").isNotNull().alias("conflict"))


def gap_descriptions(annotator: DataFrame, assigned: DataFrame, raw: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """(trace_id, annotator_id, best_agent_id, best_score, reason) of annotator steps without a partner. raw: as from best_raw."""
    free = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(assigned.select("trace_id", "annotator_id"), ["trace_id", "annotator_id"], "left_anti")
    best = raw.select("trace_id", "annotator_id", F.col("agent_id").alias("best_agent_id"), F.col("score").alias("best_score"))
    said = F.concat(F.lit("best candidate: "), "best_agent_id", F.lit(" scored "), F.format_string("%.2f", F.floor(F.round("best_score", 9) * 100 + 0.5) / 100), F.lit(f" (threshold {minimum:g})"))
    return free.join(best, ["trace_id", "annotator_id"], "left").select(
        "trace_id", "annotator_id", "best_agent_id", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.coalesce(said, F.lit("no agent plan steps to compare")).alias("reason")
    )


def conflicts(annotator: DataFrame, cands: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every passing candidate of the annotator steps that got no partner, and which annotator step holds that agent step."""
    free = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(assigned.select("trace_id", "annotator_id"), ["trace_id", "annotator_id"], "left_anti")
    holder = assigned.select("trace_id", "agent_id", F.col("annotator_id").alias("held_by"))
    return cands.join(free, ["trace_id", "annotator_id"]).join(holder, ["trace_id", "agent_id"], "left").select("trace_id", "annotator_id", "agent_id", "score", "held_by")


def content_gate_blocks(annotator: DataFrame, cands: DataFrame, raw: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Annotator steps without any passing candidate whose best raw score reaches the minimum: position alone would have matched them."""
    none = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(cands.select("trace_id", "annotator_id"), ["trace_id", "annotator_id"], "left_anti")
    return none.join(raw.where(F.col("score") + EPSILON >= minimum), ["trace_id", "annotator_id"]).select("trace_id", "annotator_id", "agent_id", "score")


def risk_flags(agent: DataFrame, assigned: DataFrame, described: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """(trace_id, step_id, flag, severity): missing_step for each gap (medium if its best candidate came within three quarters), gap for each unmatched agent step."""
    missing = described.select("trace_id", F.col("annotator_id").alias("step_id"), F.lit("missing_step").alias("flag"), F.when(F.col("best_score") >= minimum * 0.75, "medium").otherwise("high").alias("severity"))
    unmatched = agent.select("trace_id", "step_id").join(assigned.select("trace_id", F.col("agent_id").alias("step_id")), ["trace_id", "step_id"], "left_anti")
    return missing.unionByName(unmatched.select("trace_id", "step_id", F.lit("gap").alias("flag"), F.lit("medium").alias("severity")))


def near_misses(annotator: DataFrame, assigned: DataFrame, raw: DataFrame, minimum: float = MINIMUM, width: float = 0.02) -> DataFrame:
    """Annotator steps without a partner whose best raw score lies within ``width`` below the minimum."""
    free = annotator.select("trace_id", F.col("step_id").alias("annotator_id")).join(assigned.select("trace_id", "annotator_id"), ["trace_id", "annotator_id"], "left_anti")
    return free.join(raw, ["trace_id", "annotator_id"]).where((F.col("score") >= minimum - width) & (F.col("score") < minimum)).select("trace_id", "annotator_id", "agent_id", "score")


def mode_benchmark(annotator: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Per trace: steps, covered steps and coverage of two assignments, and what the second gains."""
    per = lambda a, p: a.groupBy("trace_id").agg(F.count("*").alias(f"{p}_covered"), F.avg("score").alias(f"{p}_mean_score"))
    base = annotator.groupBy("trace_id").agg(F.count("*").alias("n_steps"))
    out = base.join(per(lexical, "lexical"), "trace_id", "left").join(per(semantic, "semantic"), "trace_id", "left").fillna(0, ["lexical_covered", "semantic_covered"])
    share = lambda p: F.col(f"{p}_covered") / F.col("n_steps")
    return out.select("*", share("lexical").alias("lexical_coverage"), share("semantic").alias("semantic_coverage"), (share("semantic") - share("lexical")).alias("coverage_delta"))


def mode_summary(benchmark: DataFrame) -> DataFrame:
    """One row per mode: traces, mean, least and greatest coverage, covered and uncovered steps in all."""
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_coverage").alias("c"), F.col(f"{m}_covered").alias("k")) for m in ("lexical", "semantic")])
    rows = benchmark.select("n_steps", F.explode(modes).alias("m"))
    return rows.groupBy("m.mode").agg(
        F.count("*").alias("traces"), F.avg("m.c").alias("mean_coverage"), F.min("m.c").alias("min_coverage"), F.max("m.c").alias("max_coverage"),
        F.sum("m.k").alias("covered"), F.sum(F.col("n_steps") - F.col("m.k")).alias("uncovered"),
    )


def spans(steps: DataFrame, longest: int = 4) -> DataFrame:
    """Runs of 1 to ``longest`` following steps: (trace_id, start_pos, len, ids, tokens, tools, size).

    An equi-join on position + offset for each length, not a range join: every step has ``longest`` runs at most.
    """
    part = steps.select("trace_id", "pos", "size", "step_id", "tokens", "tools", "meanings")
    offsets = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("k"))
    offsets = offsets.select("trace_id", (F.col("pos") - F.col("k")).alias("start_pos"), "k", "size", "step_id", "tokens", "tools", "meanings").where("start_pos >= 1")
    gathered = offsets.groupBy("trace_id", "start_pos").agg(F.array_sort(F.collect_list(F.struct("k", "step_id", "tokens", "tools", "meanings"))).alias("run"), F.max("size").alias("size"))
    cut = gathered.select("trace_id", "start_pos", "size", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("len")).withColumn("run", F.slice("run", F.lit(1), F.col("len")))
    merged = lambda c: F.array_distinct(F.flatten(F.transform("run", lambda r: r[c]))).alias(c)
    return cut.select("trace_id", "start_pos", "len", "size", F.transform("run", lambda r: r["step_id"]).alias("ids"), merged("tokens"), merged("tools"), merged("meanings"))


def segment_support(agent: DataFrame, annotator: DataFrame, minimum: float = MINIMUM, longest: int = 4, semantic: bool = False) -> DataFrame:
    """Best passing run of annotator steps per agent step; of equal scores the earlier, then the shorter run."""
    runs = spans(annotator, longest).withColumn("run_id", F.concat_ws(":", "start_pos", "len"))
    as_steps = runs.select("trace_id", F.col("run_id").alias("step_id"), (F.col("start_pos") + (F.col("len") - 1) / 2).alias("pos"), "size", "tokens", "tools", "meanings")
    found = (semantic_candidates if semantic else candidates)(agent, as_steps, minimum).join(runs.select("trace_id", F.col("run_id").alias("annotator_id"), "start_pos", "len", "ids"), ["trace_id", "annotator_id"])
    best = found.groupBy("trace_id", "agent_id").agg(F.max(F.struct(F.round("score", 12).alias("r"), (-F.col("start_pos")).alias("s"), (-F.col("len")).alias("l"), "ids", "score")).alias("b"))
    return best.select("trace_id", "agent_id", (-F.col("b.s")).alias("start_pos"), (-F.col("b.l")).alias("len"), F.col("b.ids").alias("ids"), F.col("b.score").alias("score"))


def segment_diagnostics(agent: DataFrame, annotator: DataFrame, longest: int = 4) -> DataFrame:
    """(trace_id, agent_id, start_pos, len, score, single_score, improvement): the best run of two to ``longest`` annotator steps of each agent step, whatever it scores, against the best single one.

    Semantic mode. Of runs without content the nearest in position is the best, so beside pairs with
    content at most two runs of each length are looked at. Of equal scores the earlier, then the
    shorter run. Traces with fewer than two annotator steps give none.
    """
    runs = spans(annotator, longest).where("len >= 2").withColumn("run_id", F.concat_ws(":", "start_pos", "len"))
    as_steps = runs.select("trace_id", F.col("run_id").alias("step_id"), (F.col("start_pos") + (F.col("len") - 1) / 2).alias("pos"), "size", "tokens", "tools", "meanings")
    shape = ["trace_id", "agent_id", "start_pos", "len", "score"]
    content = semantic_candidates(agent, as_steps, None).join(runs.select("trace_id", F.col("run_id").alias("annotator_id"), "start_pos", "len"), ["trace_id", "annotator_id"]).select(*shape)
    m = annotator.groupBy("trace_id").agg(F.max("size").alias("m"))
    at = F.when(F.col("size") <= 1, 0.5).otherwise((F.col("pos") - 1) / F.nullif(F.col("size") - 1, F.lit(0)))
    near = agent.join(m, "trace_id").where("m >= 2").select("trace_id", F.col("step_id").alias("agent_id"), "pos", "size", "m", at.alias("at"), F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.col("m")))).alias("len"))
    x = 1 + F.col("at") * (F.col("m") - 1) - (F.col("len") - 1) / 2
    inside = lambda c: F.greatest(F.lit(1), F.least(F.col("m") - F.col("len") + 1, c)).cast("int")
    near = near.select("*", F.explode(F.array_distinct(F.array(inside(F.floor(x)), inside(F.ceil(x))))).alias("start_pos"))
    place = S.position_score(F.col("pos"), F.col("size"), F.col("start_pos") + (F.col("len") - 1) / 2, F.col("m"))
    zero = F.lit(0.0)
    bare = near.withColumn("score", S.composite(zero, place, zero, zero)).select(*shape)
    # a nearest run that has content scores at least as much with it, so it needs no telling apart
    best = content.unionByName(bare).groupBy("trace_id", "agent_id").agg(F.max(F.struct(F.round("score", 12).alias("r"), (-F.col("start_pos")).alias("s"), (-F.col("len")).alias("l"))).alias("b"))
    swapped = nearest(annotator, agent).groupBy("trace_id", F.col("annotator_id").alias("agent_id")).agg(F.max("score").alias("n"))
    single = semantic_candidates(agent, annotator, None).groupBy("trace_id", "agent_id").agg(F.max("score").alias("c"))
    out = best.join(swapped, ["trace_id", "agent_id"], "left").join(single, ["trace_id", "agent_id"], "left")
    one = F.greatest(F.coalesce("n", zero), F.coalesce("c", zero))
    return out.select("trace_id", "agent_id", (-F.col("b.s")).alias("start_pos"), (-F.col("b.l")).alias("len"), F.col("b.r").alias("score"), one.alias("single_score"), (F.col("b.r") - one).alias("improvement"))


def merged_support(annotator: DataFrame, plan: DataFrame, execution: DataFrame, segments: DataFrame) -> DataFrame:
    """Per annotator step: supported by plan, execution, both or none; by a single step, a run, or both kinds."""
    key = ["trace_id", "annotator_id"]
    base = annotator.select("trace_id", F.col("step_id").alias("annotator_id"))
    in_runs = segments.select("trace_id", F.explode("ids").alias("annotator_id"), "score").groupBy(*key).agg(F.max("score").alias("segment_score"))
    out = base.join(plan.select(*key, F.col("score").alias("plan_score")), key, "left").join(execution.select(*key, F.col("score").alias("exec_score")), key, "left").join(in_runs, key, "left")
    p, e, s = F.col("plan_score").isNotNull(), F.col("exec_score").isNotNull(), F.col("segment_score").isNotNull()
    return out.select(
        *key, F.when((p | s) & e, "both").when(p | s, "plan").when(e, "execution").otherwise("none").alias("source"),
        F.when(p & s, "single_step_and_segment").when(p, "single_step").when(s, "segment_only").otherwise("none").alias("kind"), "plan_score", "exec_score", "segment_score",
    )


def support_flags(merged: DataFrame) -> DataFrame:
    flag: Column = F.when(F.col("source") == "none", "truly_missing_step").when(F.col("source") == "execution", "plan_gap")
    return merged.select("trace_id", "annotator_id", flag.alias("flag"), F.when(F.col("source") == "none", "high").otherwise("medium").alias("severity")).where("flag IS NOT NULL")
