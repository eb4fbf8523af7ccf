"""Graded step scores: floors, bands, fold to verdicts, merges and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bands, floors and weights of the grading scale.
SUPPORTED, PARTIAL, FAITHFUL = 0.5625, 0.25, 0.75
NO_QUOTE_FLOOR, CROSS_STEP_FLOOR, SHORT_QUOTE_FLOOR, FETCH_ONLY_FLOOR = 0.25, 0.40, 0.40, 0.25
SHORT_QUOTE, MARGIN = 10, 0.05
#: Wording in a judge's reasoning, and in an excerpt, that floors react to.
WRONG_SOURCE = r"(?i)wrong source|different source|blog.*(instead|rather than)|secondary.*(instead|rather than)|not the (official|primary|required|actual)|fetched.*blog|used.*blog.*instead"
CROSS_STEP = r"(?i)cross[- ]step|plan[- ]then[- ]execute|R7|spans (multiple|two) (trace )?steps|planning step .* (execution|fetch|search) step|aliasing"
TOOL_CALL = r"(?i)tool.?call|web_search|web_fetch|\[search\]|\[TOOL"
TOOL_RESULT = r"(?i)tool.?result|\[observe\]|\[EXTRACTED"
#: Internal verdicts from strict to lenient.
LATTICE = ("BLOCK", "HOLD", "CONDITIONAL_ALLOW", "ALLOW")


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LATTICE)), verdict).cast("int") - 1


def verdict_of(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LATTICE)), number)


def floored(score: Column, quote: Column, reasoning: Column | None = None, excerpt: Column | None = None, mode: str = "support") -> Column:
    """The score after its caps, in their fixed order; a cap only ever lowers it.

    Fetch without extraction, wrong source and cross-step evidence (support mode), a supported score
    without a quote (an empty quote is one), a quote shorter than ten characters.
    """
    s = score
    if excerpt is not None:
        bare = excerpt.rlike(TOOL_CALL) & ~(excerpt.rlike(TOOL_RESULT) | (F.length(excerpt) > 500))
        s = F.when(bare, F.least(s, F.lit(FETCH_ONLY_FLOOR))).otherwise(s)
    if mode == "support" and reasoning is not None:
        said = F.coalesce(reasoning, F.lit(""))
        s = F.when((s > 0) & (s <= 0.5) & said.rlike(WRONG_SOURCE), 0.0).otherwise(s)
        s = F.when(said.rlike(CROSS_STEP), F.least(s, F.lit(CROSS_STEP_FLOOR))).otherwise(s)
    s = F.when((s >= SUPPORTED) & quote.isNull(), NO_QUOTE_FLOOR).otherwise(s)
    short = quote.isNotNull() & (F.length(F.trim(quote)) < SHORT_QUOTE)
    return F.when(short, F.least(s, F.lit(SHORT_QUOTE_FLOOR))).otherwise(s)


def predicate(score: Column, quote: Column, mode: str = "support") -> Column:
    """Band of a floored score; the top band needs a quote that is not empty."""
    quoted = F.coalesce(quote, F.lit("")) != ""
    if mode == "faithfulness":
        return F.when((score >= FAITHFUL) & quoted, "faithful").when(score >= SUPPORTED, "partially_faithful").when(score >= PARTIAL, "weakly_faithful").otherwise("unfaithful")
    return F.when(score == 0, "skipped").when((score >= SUPPORTED) & quoted, "supported").when(score >= PARTIAL, "partial").otherwise("unsupported")


def in_margin(score: Column, band: Column) -> Column:
    return band.isin("supported", "faithful") & (F.abs(score - SUPPORTED) < MARGIN)


def fold_verdicts(steps: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, verdict, fail_score, low_confidence, n_steps, mean_score) from graded steps.

    steps: item, criticality, step_type, score, predicate. One aggregation; whatever the number of
    steps of an item, map-side partial sums of seven counters travel. Answer-consistency fails weigh
    half, and as long as no trace step failed outright they hold an item at most. Items of steps
    without criticality fall to ALLOW as nothing critical failed.
    """
    critical = F.col("criticality") == "critical"
    answer = F.coalesce(F.col("step_type") == "answer_consistency", F.lit(False))
    failed = F.col("predicate").isin("unsupported", "skipped", "unfaithful")
    half = F.col("predicate").isin("partial", "weakly_faithful", "partially_faithful")
    weak = ~F.coalesce(critical, F.lit(False)) & (F.col("score") > 0) & (F.col("score") < SUPPORTED)
    counted = steps.groupBy(item).agg(
        F.count_if(critical & failed & ~answer).alias("te_fail"), F.count_if(critical & half & ~answer).alias("te_half"),
        F.count_if(critical & failed & answer).alias("ac_fail"), F.count_if(critical & half & answer).alias("ac_half"),
        F.count_if(weak).alias("weaknesses"), F.count_if(in_margin(F.col("score"), F.col("predicate"))).alias("margin"),
        F.count("*").alias("n_steps"), F.avg("score").alias("mean_score"),
    )
    fail = F.col("te_fail") + 0.5 * F.col("te_half") + 0.5 * F.col("ac_fail") + 0.25 * F.col("ac_half")
    held = (F.col("ac_fail") + F.col("ac_half") > 0) & (F.col("te_fail") == 0)
    verdict = (
        F.when((fail >= 2) & ~held, "BLOCK").when((fail >= 1) | held, "HOLD").when((fail >= 0.5) | (F.col("weaknesses") > 0), "CONDITIONAL_ALLOW").otherwise("ALLOW")
    )
    low = (F.col("margin") > 0) | verdict.isin("CONDITIONAL_ALLOW") & (fail >= 0.5)
    return counted.select(item, verdict.alias("verdict"), fail.alias("fail_score"), low.alias("low_confidence"), "n_steps", "mean_score")


def public_verdict(verdict: Column) -> Column:
    """Internal verdicts as ALLOW, BLOCK or UNCERTAIN; null for anything else."""
    return F.when(verdict.isin("ALLOW", "CONDITIONAL_ALLOW"), "ALLOW").when(verdict == "BLOCK", "BLOCK").when(verdict.isin("HOLD", "DISSENT"), "UNCERTAIN")


def stricter(a: Column, b: Column) -> Column:
    """Conservative merge of two verdicts."""
    return verdict_of(F.least(rank(a), rank(b)))


def cascade(primary: Column, secondary: Column, confirm_blocks: Column, allow_on_error: Column) -> Column:
    """STRUCT<verdict, reason, invoked, degraded> of a two-judge cascade; a null verdict is a failed judge.

    A primary BLOCK stands unless blocks are to be confirmed; a primary HOLD is heard against the
    second judge, which can only make it BLOCK; an ALLOW needs the second judge's agreement.
    """
    passing = ("ALLOW", "CONDITIONAL_ALLOW")

    def out(verdict: Column | str, reason: str | Column, invoked: bool | Column, degraded: bool) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(verdict).alias("verdict"), lit(reason).alias("reason"), lit(invoked).alias("invoked"), lit(degraded).alias("degraded"))

    any_conditional = (primary == "CONDITIONAL_ALLOW") | (secondary == "CONDITIONAL_ALLOW")
    return (
        F.when(primary.isNull() & secondary.isNull(), F.lit(None))
        .when(primary.isNull(), out(secondary, "primary_error_fallback", True, True))
        .when((primary == "BLOCK") & ~confirm_blocks, out("BLOCK", "primary_block", False, False))
        .when((primary == "BLOCK") & secondary.isNull(), out("BLOCK", "secondary_error_fallback", True, True))
        .when((primary == "BLOCK") & secondary.isin("BLOCK", "HOLD"), out("BLOCK", "confirmed_block", True, False))
        .when(primary == "BLOCK", out("HOLD", "primary_block_rejected", True, False))
        .when((primary == "HOLD") & (secondary == "BLOCK"), out("BLOCK", "disagreement_hold", True, False))
        .when(primary == "HOLD", out("HOLD", "primary_hold", secondary.isNotNull(), False))
        .when(~primary.isin(*passing), out("HOLD", "primary_hold", False, True))
        .when(secondary.isNull(), out(F.when(allow_on_error, primary).otherwise("HOLD"), "secondary_error_fallback", True, True))
        .when(secondary.isin(*passing) & any_conditional, out("CONDITIONAL_ALLOW", "agreement_conditional_allow", True, False))
        .when(secondary.isin(*passing), out("ALLOW", "agreement_allow", True, False))
        .otherwise(out("HOLD", F.when(primary == "CONDITIONAL_ALLOW", "disagreement_conditional_hold").otherwise("disagreement_hold"), True, False))
    )


def cascade_stats(results: DataFrame) -> DataFrame:
    """One row of batch statistics; results: verdict, reason, invoked, primary_ms, secondary_ms (null: not run)."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason").isin("agreement_allow", "agreement_conditional_allow", "confirmed_block")).alias("agreements"),
        F.count_if(F.col("reason").startswith("disagreement") | (F.col("reason") == "primary_block_rejected")).alias("disagreements"),
        F.count_if(F.col("reason").endswith("error_fallback")).alias("fallbacks"),
        F.coalesce(F.avg("primary_ms"), F.lit(0.0)).alias("mean_primary_ms"),
        F.coalesce(F.avg("secondary_ms"), F.lit(0.0)).alias("mean_secondary_ms"),
        F.coalesce(F.try_divide(F.count_if(~F.col("invoked")), F.count("*")), F.lit(0.0)).alias("early_exit_rate"),
    )


def family(model: Column) -> Column:
    """Provider family of a model name by known substrings."""
    m = F.lower(model)
    has = lambda *xs: m.rlike("|".join(xs))
    return (
        F.when(has("claude", "opus", "sonnet", "haiku"), "anthropic").when(m.contains("gpt") | m.rlike(r"(^|[^a-z0-9])o[134](?![a-z0-9])"), "openai").when(m.contains("grok"), "xai")
        .when(has("kimi", "moonshot"), "moonshot").when(m.contains("deepseek"), "deepseek").when(m.contains("gemini"), "google").otherwise("unknown")
    )


def route(confidence: Column, criticality: Column, step_type: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """Where a cheap first scorer sends a step: settled as supported or unsupported, or on to the judge."""
    settled = F.when(confidence >= high, "supported").when(confidence <= low, "unsupported")
    skip = (criticality == "critical") | F.coalesce(step_type == "answer_consistency", F.lit(False)) | confidence.isNull()
    return F.when(skip, "tier2").otherwise(F.coalesce(settled, F.lit("tier2")))


def merge_tiers(expected: DataFrame, judged: DataFrame, screened: DataFrame, keys: list[str]) -> DataFrame:
    """One row per expected step: the judge's score, else the screen's, else 0. First rows win on repeated keys."""
    first = lambda df, c: df.groupBy(*keys).agg(F.min("score").alias(c))
    return (
        expected.select(*keys).distinct().join(first(judged, "judged"), keys, "left").join(first(screened, "screened"), keys, "left")
        .select(*keys, F.coalesce("judged", "screened", F.lit(0.0)).alias("score"), F.when(F.col("judged").isNotNull(), "tier2").when(F.col("screened").isNotNull(), "tier1").otherwise("default").alias("tier"))
    )
