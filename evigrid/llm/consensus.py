"""Consensus from several annotators' labels by spectral reliability (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import Scratch

#: The labels of the test data's judgements.
VERDICTS = ("ALLOW", "HOLD", "BLOCK")


def last_votes(runs: DataFrame, item: str, annotator: str, label: str, at: str, labels: tuple[str, ...] = VERDICTS, tie: str = "id") -> DataFrame:
    """(item, annotator, label): the last run of each annotator on each item, if its label is valid.

    Labels are compared without case and surrounding white space. A last run that abstains, or says
    anything else, is no vote, and earlier runs do not step in. Of runs at the same time the largest
    tie column counts; runs without a time are the oldest; null items and annotators are left out.
    """
    last = (
        runs.where(F.col(item).isNotNull() & F.col(annotator).isNotNull())
        .groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator"))
        .agg(F.max(F.struct(F.col(at).alias("t"), F.col(tie).alias("tie"), F.upper(F.regexp_replace(F.col(label), r"^\s+|\s+$", "")).alias("label")))["label"].alias("label"))
    )
    return last.where(F.col("label").isin(*labels))


def _sum_over(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


#: Rounds after which the power step is taken on the matrix plus one, which has no negative eigenvalue and so always settles.
UNSHIFTED = 20


def reliabilities(votes: DataFrame, labels: tuple[str, ...] = VERDICTS, close: float = 1e-4, scratch: Scratch | None = None) -> DataFrame:
    """(annotator, n_votes, overlap, reliability, r, p0, p1, ...): leading eigenvector of the chance-centred agreement.

    The matrix A has, for two annotators, the number of items on which they agree less the number
    expected from their label shares p, over the square root of the product of their overlap counts;
    its diagonal is left out, and no eigenvalue exceeds 1. It is never written down: a power step
    multiplies by it through sums per item and label, so an item with m votes costs m, not m * m,
    and a hot item is combined on the map side. Each step is two sparse joins with a vector of one
    row per annotator, and a written table that replaces the last; steps end when the vector moves
    by less than ``close``. It starts positive and keeps that sign, as most annotators are better
    than chance. r is the share of votes an annotator knows rather than guesses (see _scaled),
    reliability its share of true labels if guesses were even, r + (1 - r) / k. Annotators whose
    items nobody else judged, and groups that share no item with the largest one, have r = 0.
    """
    scratch, k = scratch or Scratch(votes.sparkSession), len(labels)
    hot = [F.avg((F.col("label") == v).cast("double")).alias(f"p{i}") for i, v in enumerate(labels)]
    per_item = votes.groupBy("item").agg(F.count("*").alias("m")).where("m > 1")
    # overlap: how many other votes stand beside an annotator's, over all items
    rows = scratch.cut(votes.join(per_item, "item").select("item", "annotator", "label", "m"))
    who = scratch.cut(rows.groupBy("annotator").agg(F.count("*").alias("n"), F.sum(F.col("m") - 1).cast("double").alias("overlap"), *hot))
    vector, turn = who.select("*", F.lit(1.0).alias("x")), 0
    while True:
        # u: entry scaled by overlap; sums per item of u by label, and of u times the label shares
        u = vector.select("annotator", (F.col("x") / F.sqrt("overlap")).alias("u"), *[f"p{i}" for i in range(k)])
        mine = rows.select("item", "annotator", "label").join(u, "annotator")
        sums = mine.groupBy("item").agg(
            *[F.sum(F.when(F.col("label") == v, F.col("u")).otherwise(0.0)).alias(f"s{i}") for i, v in enumerate(labels)],
            *[F.sum(F.col("u") * F.col(f"p{i}")).alias(f"c{i}") for i in range(k)],
        )
        agree = _sum_over([F.when(F.col("label") == v, F.col(f"s{i}")).otherwise(0.0) for i, v in enumerate(labels)]) - F.col("u")
        chance = _sum_over([F.col(f"p{i}") * (F.col(f"c{i}") - F.col("u") * F.col(f"p{i}")) for i in range(k)])
        y = mine.join(sums, "item").groupBy("annotator").agg(F.sum(agree - chance).alias("y"))
        shift = 0.0 if turn < UNSHIFTED else 1.0
        step = vector.join(y, "annotator", "left").withColumn("y", F.coalesce("y", F.lit(0.0)) / F.sqrt("overlap") + shift * F.col("x"))
        done = scratch.cut(step, "vector")
        norm, total, size, dot = done.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))), F.sum("y"), F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sum(F.col("x") * F.col("y"))).head()
        if not norm:
            vector = done.select(*who.columns, F.lit(0.0).alias("x"))
            break
        sign = -1.0 if total < 0 else 1.0
        vector, turn = done.select(*who.columns, (F.col("y") * sign / norm).alias("x")), turn + 1
        # distance of the two unit vectors
        if 2 - 2 * sign * dot / (norm * size) < close * close:
            break
    return _scaled(rows.drop("m"), vector, k).select(
        "annotator", F.col("n").alias("n_votes"), F.col("overlap").cast("long").alias("overlap"), ((F.col("r") * (k - 1) + 1) / k).alias("reliability"), "r", *[f"p{i}" for i in range(k)]
    )


def _scaled(rows: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Entries as shares of votes that an annotator knows rather than guesses.

    If annotator i knows the label of an item in r_i of all cases and else guesses, chance-centred
    agreement of i and j on an item is about r_i r_j times a constant. The entry over the square
    root of the overlap is r up to one factor; that factor makes the mean pairwise agreement that
    the r predict equal to the one observed.
    """
    r = vector.select("*", (F.col("x") / F.sqrt("overlap")).alias("r0"))
    pairs = rows.join(r.select("annotator", "r0", *[c for c in r.columns if c[:1] == "p"]), "annotator")
    shares = [c for c in r.columns if c[:1] == "p" and c[1:].isdigit()]
    by_item = pairs.groupBy("item").agg(F.sum("r0").alias("sr"), F.sum(F.col("r0") * F.col("r0")).alias("srr"), F.count("*").alias("m"), *[F.sum(c).alias(f"s_{c}") for c in shares], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in shares])
    seen = rows.groupBy("item", "label").agg(F.count("*").alias("c")).groupBy("item").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("agreeing"))
    total = (
        by_item.join(seen, "item")
        .agg(
            F.sum(F.col("sr") * F.col("sr") - F.col("srr")).alias("predicted"),
            F.sum("agreeing").alias("agreeing"),
            F.sum(_sum_over([F.col(f"s_{c}") * F.col(f"s_{c}") - F.col(f"q_{c}") for c in shares])).alias("chance"),
        )
        .head()
    )
    # expected agreement beyond chance of two perfect annotators is 1 - 1/k
    surplus = max(0.0, float((total.agreeing or 0) - (total.chance or 0.0)))
    factor = (surplus / ((1 - 1 / k) * total.predicted)) ** 0.5 if total.predicted and total.predicted > 0 else 0.0
    return r.withColumn("r", F.least(F.greatest(F.lit(factor) * F.col("r0"), F.lit(0.0)), F.lit(SURE)))


#: An annotator knows at most this share of labels, and guesses each label at least so often.
SURE, LEAST_GUESS = 0.97, 0.01


def consensus(votes: DataFrame, weights: DataFrame, labels: tuple[str, ...] = VERDICTS, minimum: int = 1) -> DataFrame:
    """(item, verdict, n_votes, agreement, confidence) for items with at least minimum votes.

    weights: as from reliabilities. Votes are weighed by the spectral r alone: an annotator who knows
    the label in r of all cases and else guesses gives label l with probability r [l is true] +
    (1 - r) g(l). The guesses g are what its label shares p, by which agreement was centred, leave
    when the share that r explains is taken off; so a vote for a label that an annotator favours
    anyway counts less. Log-likelihoods add up per item, with the shares of labels that the weights
    give as prior. agreement is the share of votes for the verdict, confidence its posterior. Ties
    go to the label named first in reverse order of labels (the stricter). Annotators without a
    weight count with r = 0 unless nobody on the item has one, when the vote is plain.
    """
    k = len(labels)
    # label shares are r parts truth and 1 - r parts guess: the surer an annotator, the nearer its shares to those of the truth
    n = F.col("n_votes") * F.col("r") * F.col("r") / (1 - F.col("r"))
    prior = weights.agg(F.struct(*[F.coalesce(F.try_divide(F.sum(n * F.col(f"p{i}")), F.sum(n)), F.lit(1 / k)).alias(f"q{i}") for i in range(k)])).scalar()
    known = weights.select("annotator", "r", *[f"p{i}" for i in range(k)]).withColumn("q", prior)
    share = lambda i: F.greatest(F.col(f"q.q{i}"), F.lit(LEAST_GUESS))
    guess = [F.greatest((F.col(f"p{i}") - F.col("r") * F.col(f"q.q{i}")) / (1 - F.col("r")), F.lit(LEAST_GUESS)) for i in range(k)]
    known = known.select("annotator", "r", *[share(i).alias(f"q{i}") for i in range(k)], *[(g / _sum_over(guess)).alias(f"g{i}") for i, g in enumerate(guess)])
    logs = [F.log(F.col("r") * float(a == b) + (1 - F.col("r")) * F.col(f"g{b}")).alias(f"l_{a}_{b}") for a in range(k) for b in range(k)]
    known = known.select("annotator", *[F.log(f"q{i}").alias(f"q{i}") for i in range(k)], *logs)
    said = lambda a: reduce(lambda acc, b: acc.when(F.col("label") == labels[b], F.col(f"l_{a}_{b}")), range(1, k), F.when(F.col("label") == labels[0], F.col(f"l_{a}_0")))
    # a vote without a weight adds as little as decides between otherwise equal labels
    plain = lambda a: F.when(F.col("label") == labels[a], 1e-6).otherwise(0.0)
    summed = votes.join(known, "annotator", "left").groupBy("item").agg(
        F.count("*").alias("n_votes"),
        *[(F.sum(F.coalesce(said(a).otherwise(0.0), F.lit(0.0)) + plain(a)) + F.coalesce(F.max(f"q{a}"), F.lit(0.0))).alias(f"t{a}") for a in range(k)],
        *[F.sum((F.col("label") == v).cast("int")).alias(f"c{i}") for i, v in enumerate(labels)],
    )
    order = list(reversed(list(enumerate(labels))))
    top = F.greatest(*[F.col(f"t{i}") for i in range(k)])
    best = F.coalesce(*[F.when(F.col(f"t{i}") == top, F.lit(v)) for i, v in order])
    votes_for = reduce(lambda acc, x: acc.when(best == x[1], F.col(f"c{x[0]}")), list(enumerate(labels))[1:], F.when(best == labels[0], F.col("c0")))
    return summed.where(F.col("n_votes") >= minimum).select(
        "item", best.alias("verdict"), "n_votes", (votes_for / F.col("n_votes")).alias("agreement"), (1 / _sum_over([F.exp(F.col(f"t{i}") - top) for i in range(k)])).alias("confidence")
    )
