"""Text cut off by field limits (problem 5)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import Scratch

#: Common function words of English, German, French and Spanish, by which a sentence is known from a label.
FUNCTION_WORDS = (
    "the a an of to in on at by for from with without and or but if as that this these those it its is are was were be been has have had not no nor neither both each every "
    "only most some all other another which who what where when while because although so than then there their his her our your they we you he she i nobody two several "
    "der die das den dem des ein eine einen einem einer und oder aber wenn dass nicht kein keine mit von zu im am auf für aus bei nach über ist sind war waren wird wurde werden hat haben "
    "sich auch nur wie als wer was wo jeder jede niemand zwei "
    "le la les un une des du de et ou mais si que qui ne pas aucun aucune avec sans dans sur pour par au aux est sont était a ont ce cette ces il elle ils elles son sa ses selon deux "
    "el los las una unos unas del y o pero no ningún ninguna con sin en por para al es son fue está han este esta estos que quien su sus según dos"
).split()

_CLOSERS = "\"'”’»)\\]*_"
_MARKER = (
    r"(?is)(?:\.{2,}|…|�|\[\s*(?:\.{2,}|…|truncated|cut|cut off|continued|cont\.?|snip(?:ped)?|more|abridged|gekürzt|tronqué|cortado)\s*\]"
    r"|\(\s*(?:\.{2,}|…|truncated|cut|cut off|continued|cont\.?|more|fortsetzung(?: folgt)?|suite)\s*\)|<\s*/?\s*(?:truncated|cut|snip|more|continued)\s*/?\s*>)"
    rf"[\s{_CLOSERS}]*$"
)
#: Kinds of ending, and prior counts of each among cut and among whole values; a source's fit adds its own values to them.
KINDS = ("marked", "open", "finished", "label")
CUT_PRIOR, WHOLE_PRIOR = (6.0, 14.0, 0.0, 0.1), (0.0, 0.0, 14.0, 6.0)
#: Shares that no fit may move, as they state what a cut is: a whole value does not stop within a sentence or carry a mark, and a
#: cut that falls on the end of a sentence leaves the value whole. What they leave are endings misread.
MARKED_WHOLE, OPEN_WHOLE, FINISHED_CUT = 1e-6, 1e-3, 2e-4
#: The same for a reported length that exceeds the value's, or does not.
LONGER_CUT, LONGER_WHOLE = (8.0, 12.0), (1.0, 19.0)
#: Chance below which open values at one length are more than chance puts there: a candidate limit.
RARE = 1e-3


def ending(text: Column) -> Column:
    """marked, open, finished or label: what the end of a text says, whatever its length.

    A note in brackets after a finished sentence, and quotes or brackets that close it, do not open
    it again. ``0.`` at the end is a number that lost its decimals.
    """
    t = F.regexp_replace(text, r"\s+$", "")
    bare = F.regexp_replace(t, rf"[\s{_CLOSERS}]+$", "")
    noted = F.regexp_replace(t, r"\s*[(\[][^()\[\]]{0,80}[)\]]$", "")
    stop = lambda x: x.rlike(rf"[.!?。！？][{_CLOSERS}]*$") & ~x.rlike(rf"(?:^|\s)0\.[{_CLOSERS}]*$")
    words = F.regexp_extract_all(t, F.lit(r"[\p{L}][\p{L}'’-]*"), F.lit(0))
    grammar = F.exists(words, lambda w: F.lower(w).isin(*FUNCTION_WORDS))
    content = F.exists(words, lambda w: w.rlike(r"^\p{Ll}{3,}") & ~w.isin(*FUNCTION_WORDS))
    label = ~(grammar & content) | t.rlike(r"(?i)^[a-z]+://\S*$|^www\.\S*$") | t.rlike(r"(?i)^[^.!?]{1,40}:\s*\S+$") & (F.size(words) <= 4)
    return F.when(t.rlike(_MARKER), "marked").when(stop(bare) | stop(t) | stop(noted), "finished").when(label, "label").otherwise("open")


def _length_step(x: np.ndarray, whole: np.ndarray, cut: np.ndarray, mu: float, sd: float) -> tuple[float, float]:
    """One step of expectation-maximisation of a normal of log lengths, the cut ones right-censored at theirs."""
    z = (x - mu) / sd
    tail = np.maximum(0.5 * np.vectorize(math.erfc)(z / math.sqrt(2)), 1e-12)
    mills = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
    total = whole.sum() + cut.sum()
    m1 = ((x * whole).sum() + ((mu + sd * mills) * cut).sum()) / total
    m2 = ((x * x * whole).sum() + ((mu * mu + sd * sd + sd * (x + mu) * mills) * cut).sum()) / total
    return m1, max(0.05, math.sqrt(max(m2 - m1 * m1, 1e-6)))


def fit_lengths(length: np.ndarray, whole: np.ndarray, cut: np.ndarray, close: float = 1e-6) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood; a censored value counts with the moments of the normal above its length."""
    x = np.log(length)
    weight = whole + cut
    mu = (x * weight).sum() / weight.sum()
    sd = max(0.05, math.sqrt((((x - mu) ** 2) * weight).sum() / weight.sum()))
    if whole.sum() < 5:  # nothing to fit a tail on
        return mu, sd
    while True:
        m, s = _length_step(x, whole, cut, mu, sd)
        if abs(m - mu) + abs(s - sd) < close:
            return m, s
        mu, sd = m, s


def candidate_limits(length: np.ndarray, opened: np.ndarray, rare: float = RARE) -> set[int]:
    """Lengths at which more values stand open than a Poisson count around them explains."""
    n_at = dict(zip(length.tolist(), opened.tolist()))
    out = set()
    for at, n in n_at.items():
        around = 0.5 + sum(n_at.get(at + d, 0.0) for d in (-6, -5, -4, -3, 3, 4, 5, 6)) / 8
        below, term = 0.0, math.exp(-around)
        for i in range(int(n)):
            below += term
            term *= around / (i + 1)
        if 1 - below < rare:
            out.add(int(at))
    return out


_LEARNT_CUT, _FIXED_CUT = np.array([1, 1, 0, 1]), np.array([0, 0, FINISHED_CUT, 0])
_LEARNT_WHOLE, _FIXED_WHOLE = np.array([0, 0, 1, 1]), np.array([MARKED_WHOLE, OPEN_WHOLE, 0, 0])


def fit_source(hist: pd.DataFrame, use_lengths: bool = True, close: float = 1e-4) -> pd.DataFrame:
    """hist (length, ending, longer, n) of one source -> the same rows with p_limit, at_limit and p_cut.

    A mixture of cut and whole values, fitted by expectation-maximisation until no posterior moves
    by more than ``close``. Whole values have log-normal lengths, cut ones are right-censored at
    theirs. At a candidate limit the prior of being cut is the excess of values over those whose
    whole length falls there; elsewhere it is the share of cut values off the limits. The ending
    (given, for whole values, the length's octave: a label of three hundred letters is rare) and a
    reported length beyond the value's (longer: 1, 0, or -1 if unknown) weigh in with their
    likelihoods, estimated together with the rest. ``use_lengths=False`` leaves the limits out.
    """
    hist = hist.groupby(["length", "ending", "longer"], as_index=False)["n"].sum()
    length, n = hist["length"].to_numpy(float), hist["n"].to_numpy(float)
    kind = hist["ending"].map(KINDS.index).to_numpy()
    longer = hist["longer"].to_numpy()
    x, prose = np.log(length), kind != KINDS.index("label")
    octaves, octave = np.unique(np.floor(np.log2(length)), return_inverse=True)
    at_length, slot = np.unique(length, return_inverse=True)
    prose_at, open_at = np.bincount(slot, n * prose), np.bincount(slot, n * (kind < 2))
    limits = candidate_limits(at_length, open_at) if use_lengths else set()
    at_limit = np.isin(length, list(limits))
    r = np.choose(kind, (0.99, 0.9, 0.01, 0.01))
    mu = sd = None
    while True:
        whole, cut = n * (1 - r) * prose, n * r * prose
        if limits and mu is None:
            mu, sd = fit_lengths(length, whole, cut, 1e-3)
        elif limits:
            mu, sd = _length_step(x, whole, cut, mu, sd)
        off = ~at_limit
        prior = np.full(len(n), np.clip((n * r)[off].sum() / max(n[off].sum(), 1.0), 0.002, 0.5))
        if limits:
            z = (x - mu) / sd
            expected = prose_at.sum() * np.exp(-0.5 * z * z) / (sd * length * math.sqrt(2 * math.pi))
            excess = 1 - expected / np.maximum(prose_at[slot], 1.0)
            prior = np.where(at_limit, np.clip(excess, 0.001, 0.999), prior)
        of_cut = (np.bincount(kind, n * r, 4) + CUT_PRIOR) * _LEARNT_CUT
        of_cut = of_cut / of_cut.sum() * (1 - FINISHED_CUT) + _FIXED_CUT
        of_whole = (np.bincount(kind, n * (1 - r), 4) + WHOLE_PRIOR) * _LEARNT_WHOLE
        of_whole = of_whole / of_whole.sum()
        near = np.bincount(octave * 4 + kind, n * (1 - r), 4 * len(octaves)).reshape(-1, 4) * _LEARNT_WHOLE + 20 * of_whole
        near = near / near.sum(axis=1, keepdims=True) * (1 - MARKED_WHOLE - OPEN_WHOLE) + _FIXED_WHOLE
        odds = np.log(prior / (1 - prior)) + np.log(of_cut[kind] / near[octave, kind])
        told = longer >= 0
        if told.any():
            said = (longer == 1).astype(float)
            pc = ((n * r * said)[told].sum() + LONGER_CUT[0]) / ((n * r)[told].sum() + sum(LONGER_CUT))
            pw = ((n * (1 - r) * said)[told].sum() + LONGER_WHOLE[0]) / ((n * (1 - r))[told].sum() + sum(LONGER_WHOLE))
            odds = odds + np.where(told, np.where(longer == 1, math.log(pc / pw), math.log((1 - pc) / (1 - pw))), 0.0)
        new = 1 / (1 + np.exp(-odds))
        moved, r = np.abs(new - r).max(), new
        if moved < close:
            return hist.assign(p_limit=prior, at_limit=at_limit, p_cut=r)


def length_posteriors(graded: DataFrame, use_lengths: bool = True) -> DataFrame:
    """(tab, source, length, ending, longer, n, p_limit, at_limit, p_cut) from (tab, source, length, ending, longer).

    Values are counted per source, length, ending and report first; one task then sees one source's
    distinct combinations, whose number the longest text bounds, not its rows.
    """
    hist = graded.where("length > 0").groupBy("tab", "source", "length", "ending", "longer").agg(F.count("*").alias("n"))
    columns = ["tab", "source", "length", "ending", "longer", "n", "p_limit", "at_limit", "p_cut"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_source(pdf, use_lengths).assign(tab=key[0], source=key[1])[columns]

    return hist.groupBy("tab", "source").applyInPandas(run, "tab string, source string, length int, ending string, longer int, n bigint, p_limit double, at_limit boolean, p_cut double")


def with_endings(values: DataFrame) -> DataFrame:
    """values (tab, record_id, step_pos, item_pos, source, text[, reported]) -> keys with length, ending and longer; nulls and blanks left out."""
    reported = F.col("reported").cast("int") if "reported" in values.columns else F.lit(None).cast("int")
    rows = values.where("trim(text) <> ''").withColumn("source", F.coalesce("source", F.lit(""))).distinct()
    longer = F.coalesce((reported > F.length("text")).cast("int"), F.lit(-1))
    return rows.select("tab", "record_id", "step_pos", "item_pos", "source", F.length("text").alias("length"), ending(F.col("text")).alias("ending"), longer.alias("longer"))


def grade(values: DataFrame, use_lengths: bool = True) -> DataFrame:
    """values (tab, record_id, step_pos, item_pos, source, text[, reported]) -> the same keys with ending, p_cut and is_cut.

    p_cut is the posterior of the source's mixture (see fit_source) at the value's length, ending
    and reported length. Null and blank texts are left out; a null source is a source of its own
    (''); equal rows count once; whole texts are read.
    """
    graded = Scratch(values.sparkSession).cut(with_endings(values))
    known = length_posteriors(graded, use_lengths).select("tab", "source", "length", "ending", "longer", "p_limit", "at_limit", "p_cut")
    return graded.join(known, ["tab", "source", "length", "ending", "longer"]).select(
        "tab", "record_id", "step_pos", "item_pos", "source", "length", "ending", "at_limit", "p_limit", "p_cut", (F.col("p_cut") > 0.5).alias("is_cut")
    )


def cut_rates(graded: DataFrame) -> DataFrame:
    """Per tab and source: values, sentences, cut values, those at a limit, and the rate of cut values."""
    return graded.groupBy("tab", "source").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("ending") != "label").alias("n_sentences"),
        F.count_if("is_cut").alias("n_cut"),
        F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_at_limit"),
        F.avg(F.col("is_cut").cast("double")).alias("cut_rate"),
    )
