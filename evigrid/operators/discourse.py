"""Measures of agreement and preservation between the texts of one discussion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.functions import similarity as S, text as T

#: Phrases by which an objection is known.
OBJECTIONS = (
    "however", "incorrect", "wrong", "unverified", "fails", "hallucination", "no evidence", "questionable", "not supported", "inaccurate", "misleading", "contradicts",
    "unsupported", "no proof", "unfounded", "disputed", "lacks evidence", "cannot be verified", "not accurate",
)
#: Words that are no key terms of an objection.
COMMON = (
    "would", "could", "should", "their", "there", "about", "other", "these", "those", "which", "where", "while", "though", "between", "because", "after", "before", "under", "since", "every", "being",
    "using", "through", "within", "during", "against", "without", "always", "often", "model", "models", "agent", "agents", "output", "claim", "claims", "point", "points", "argument", "arguments",
)
#: Share of kept objections below which, with a warning and at least so many objections, a consensus is false.
FALSE_CONSENSUS, LEAST_OBJECTIONS = 0.4, 2
#: Share of one member above which it dominates, and mean coverage of the others below which that is justified.
DOMINANT, WEAK_OTHERS = 0.6, 0.15


def dissent(rows: DataFrame, group: str, member: str, text: str) -> DataFrame:
    """(group, n, dissent): mean Jaccard distance of the words over three letters, over all pairs of members.

    Only pairs that share a word are joined, on (group, word); the others are at distance 1 and are
    counted from the number of members. Groups of one have no dissent (0). A null text takes no
    part; pairs of two wordless texts are at distance 1.
    """
    own = rows.where(F.col(text).isNotNull()).groupBy(group, member).agg(F.max(text).alias("t")).select(group, F.col(member).alias("m"), T.long_words(F.col("t"), 3).alias("w"))
    size = own.groupBy(group).agg(F.count("*").alias("n"))
    # a word that many members of one group hold is split by a salt of the group's size, so that no task pairs more than 256 rows of one side
    salts = size.select(group, (F.floor((F.col("n") - 1) / 256) + 1).alias("k"))
    word = own.select(group, "m", F.size("w").alias("size"), F.explode("w").alias("word")).join(salts, group)
    left = word.select(group, F.col("m").alias("m1"), F.col("size").alias("n1"), "word", F.pmod(F.xxhash64("m"), F.col("k")).alias("salt"))
    right = word.select(group, F.col("m").alias("m2"), F.col("size").alias("n2"), "word", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("salt"))
    shared = left.join(right, [group, "word", "salt"]).where("m1 < m2").groupBy(group, "m1", "m2", "n1", "n2").agg(F.count("*").alias("c"))
    near = shared.groupBy(group).agg(F.sum(F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("near"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return size.join(near, group, "left").select(group, "n", F.when(F.col("n") < 2, 0.0).otherwise((pairs - F.coalesce("near", F.lit(0.0))) / pairs).alias("dissent"))


def synthesis_similarity(rows: DataFrame, group: str, member: str, text: str, least: float = 0.35) -> DataFrame:
    """(group, similarity, verified): words over four letters of the last text against those of all before it."""
    last = rows.groupBy(group).agg(F.max(member).alias("last"))
    words = rows.join(last, group).select(group, (F.col(member) == F.col("last")).alias("final"), F.explode(T.long_words(F.col(text), 4)).alias("w")).distinct()
    per_word = words.groupBy(group, "w").agg(F.bool_or("final").alias("a"), F.bool_or(~F.col("final")).alias("b"))
    sums = per_word.groupBy(group).agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count("*").alias("all"))
    value = F.round(F.col("both") / F.col("all"), 9)
    return sums.select(group, value.alias("similarity"), (F.col("both") / F.col("all") >= least).alias("verified"))


def objection_segments(critique: Column) -> Column:
    """Sentences and list items of a critique that hold an objection phrase: bulleted and numbered lines stay whole, others are split after closing marks."""
    lines = F.filter(F.transform(F.split(critique, "\n"), _trim), lambda x: x != "")
    listed = lambda x: x.rlike(r"^[-*•]\s+|^\d+\.\s+")
    parts = F.flatten(F.transform(lines, lambda x: F.when(listed(x), F.array(F.regexp_replace(x, r"^[-*•\d.]\s+", ""))).otherwise(F.split(x, r"(?<=[.!?])\s+"))))
    long = F.filter(F.transform(parts, _trim), lambda x: F.length(x) > 10)
    return F.filter(long, lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(m) for m in OBJECTIONS]))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def key_terms(sentence: Column, most: int = 6) -> Column:
    """The first words of more than four letters that are not common ones, repeats included."""
    words = F.split(F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(*COMMON)), 1, most)


def preservation(rows: DataFrame, critique: str = "critique", synthesis: str = "synthesis", warned: str = "warned") -> DataFrame:
    """rows with objections, preserved, score, false_consensus and the objections' first 20 key terms; all within a row.

    An objection is kept if enough of its key terms stand in the synthesis: two of six, else a
    quarter and at least one. Without objections the score is 1. A null critique has none, in a
    null synthesis nothing stands.
    """
    text, said = F.coalesce(F.col(critique), F.lit("")), F.lower(F.coalesce(F.col(synthesis), F.lit("")))
    terms = F.transform(objection_segments(text), lambda x: key_terms(x))  # noqa: PLW0108 - a second parameter would be the index
    out = rows.withColumn("_t", terms)
    need = lambda t: F.when(F.size(t) >= 6, F.lit(2)).otherwise(F.greatest(F.lit(1), F.ceil(F.size(t) * 0.25)))
    kept = F.filter("_t", lambda t: F.size(F.filter(t, lambda w: said.contains(w))) >= need(t))
    out = out.withColumn("objections", F.size("_t")).withColumn("preserved", F.size(kept))
    out = out.withColumn("score", F.coalesce(F.round(F.try_divide("preserved", "objections"), 4), F.lit(1.0)))
    false = (F.col("score") < FALSE_CONSENSUS) & F.coalesce(F.col(warned), F.lit(False)) & (F.col("objections") >= LEAST_OBJECTIONS)
    return out.withColumn("false_consensus", false).withColumn("keywords", F.slice(F.array_distinct(F.flatten("_t")), 1, 20)).drop("_t")


def keywords(text: Column) -> Column:
    """Words of more than four letters in order, repeats included; marks vanish without parting words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-zäöüß0-9\s]", ""), r"\s+"), lambda w: F.length(w) > 4)


def member_coverage(rows: DataFrame, group: str, member: str, text: str, synthesis: DataFrame) -> DataFrame:
    """(group, member, coverage, share): of each member's keywords, repeats included, how many the synthesis holds, and its part of the group's coverage.

    Coverage is measured within a row; shares come from one aggregate per group. Without any
    coverage in the group all members share alike. A null text covers nothing.
    """
    held = F.array_distinct(keywords(F.coalesce(F.col("synthesis"), F.lit(""))))
    words = keywords(F.coalesce(F.col(text), F.lit("")))
    joined = rows.join(synthesis.select(group, held.alias("_held")), group)
    per = joined.select(group, member, words.alias("_w"), "_held").select(group, member, F.coalesce(F.try_divide(F.size(F.filter("_w", lambda w: F.array_contains("_held", w))), F.size("_w")), F.lit(0.0)).alias("coverage"))
    total = per.groupBy(group).agg(F.sum("coverage").alias("_sum"), F.count("*").alias("_n"))
    share = F.when(F.col("_sum") > 0, F.col("coverage") / F.col("_sum")).otherwise(1 / F.col("_n"))
    return per.join(total, group).select(group, member, "coverage", share.alias("share"), F.col("_n").alias("n_members"), F.col("_sum").alias("all_coverage"))


def synthesis_balance(covered: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_members, score, dominated_by, dominance_justified, warning) from member_coverage.

    score is 1 less the mean distance of the shares from an even one, relative to it. At most one
    member can hold a share above DOMINANT; its dominance is justified if the others cover little.
    """
    even = 1 / F.col("n_members")
    found = covered.groupBy(group).agg(
        F.max("n_members").alias("n_members"), F.avg(F.abs(F.col("share") - even) / even).alias("mad"),
        F.max(F.when(F.col("share") > DOMINANT, F.struct(member, "share"))).alias("top"),
    )
    others = (1 - F.col("top.share")) / F.nullif(F.col("n_members") - 1, F.lit(0))
    justified = F.coalesce(others < WEAK_OTHERS, F.lit(False))
    return found.select(
        group, "n_members", F.round(F.greatest(1 - F.col("mad"), F.lit(0.0)), 4).alias("score"), F.col(f"top.{member}").alias("dominated_by"), justified.alias("dominance_justified"),
        (F.col("top").isNotNull() & ~justified).alias("warning"),
    )


def similarity_of(a, b):
    return S.jaccard(T.word_set(a), T.word_set(b), 1.0)
