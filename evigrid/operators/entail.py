"""Whether a source text supports an answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.functions import similarity as S, text as T

#: Overlap from which a sentence paraphrases an answer, and from which it does so surely.
PARAPHRASE, SURE = 0.5, 0.7
#: Phrases of questions that ask for exact wording, and for a translated title.
EXACT_PHRASES = (
    "exactly as it appears", "exactly as they appear", "word for word", "verbatim", "exact wording", "exact phrase", "exact name", "exact title", "exact text", "quote the exact", "exact sentence",
    "exact one-line", "one-line description",
)
EXACT_PATTERNS = (r"(?i)quote the exact\s+(sentence|line|one-line description)", r"(?i)as given in the .* lede")
TITLE_PHRASES = ("google translation", "translation of the source title", "translated title", "what is the translation")
#: The lexical bridge of titles, longer phrases first.
TITLE_PHRASE_WORDS = (("siglo veintiuno", "twenty first century"),)
TITLE_WORDS = {"el": "the", "la": "the", "los": "the", "las": "the", "del": "of the", "de": "of", "mundo": "world", "siglo": "century", "veintiuno": "twenty first"}
#: What negates an answer that follows within three words.
NEGATIONS = "not|no|never|without"


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in phrases])


def asks_exact(question: Column) -> Column:
    return F.coalesce(_any(question, EXACT_PHRASES) | reduce(lambda a, b: a | b, [question.rlike(p) for p in EXACT_PATTERNS]), F.lit(False))


def asks_title(question: Column) -> Column:
    return F.coalesce(_any(question, TITLE_PHRASES), F.lit(False))


def _quoted(word: Column) -> Column:
    """A word as a literal part of a pattern; the closing quote within a word is taken out of the quoting."""
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def negates(sentence: Column, answer: Column) -> Column:
    """Whether a normal sentence negates a normal answer within three words before it."""
    words = F.array_join(F.transform(F.split(answer, " "), _quoted), r"\W+")
    return F.regexp_count(sentence, F.concat(F.lit(rf"(?<![A-Za-z0-9_])(?:{NEGATIONS})(?:\W+\w+){{0,3}}\W+"), words, F.lit(r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|$)"))) > 0


def usable(answer: Column, source: Column, sentences: Column) -> Column:
    """Whether a normal answer stands in a normal source outside of negation; sentences: the source's, in normal form."""
    holding = F.filter(sentences, lambda s: s.contains(answer))
    return (answer != "") & source.contains(answer) & ((F.size(holding) == 0) | F.exists(holding, lambda s: ~negates(s, answer)))


def translated(sentence: Column) -> Column:
    """A sentence with title words of the bridge in English, in normal form."""
    out = reduce(lambda s, p: F.regexp_replace(s, f"(?i){p[0]}", p[1]), TITLE_PHRASE_WORDS, sentence)
    known = F.create_map(*[F.lit(x) for pair in TITLE_WORDS.items() for x in pair])
    words = F.transform(F.split(out, r"\s+"), lambda t: F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")), t))
    return T.collapsed(F.array_join(words, " "))


def span_entailment(rows: DataFrame, key: str, question: str, answer: str, source: str) -> DataFrame:
    """(key, support, confidence, exact_question, matched_span) from the sentences of the source.

    An answer that stands in the source word for word is exact (high), unless every sentence with it
    negates it: unsupported (high). Else an answer of several parts of which each stands there
    outside of negation is a paraphrase (medium), and so is one that stands in a translated title, if
    the question asks for that. Else the sentence with the largest word overlap decides between
    paraphrase (high or medium) and unsupported, which is sure (high) only where the question asks
    for exact wording. Nulls count as empty texts; blank answers are unsupported. All within a row,
    without a shuffle.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parted = F.filter(F.transform(F.split(text(source), r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 2)
    d = rows.select(
        key, T.collapsed(text(answer)).alias("_a"), F.regexp_replace(text(answer), r"^\s+|\s+$", "").alias("_span"), T.collapsed(text(source)).alias("_l"), parted.alias("_p"),
        F.transform(parted, T.collapsed).alias("_s"), asks_exact(text(question)).alias("_exact"), asks_title(text(question)).alias("_title"),
    )
    a, low = F.col("_a"), F.col("_l")
    holding = F.filter("_s", lambda s: s.contains(a))
    negated = (F.size(holding) > 0) & F.forall(holding, lambda s: negates(s, a))
    parts = F.when(a.rlike("[;,]"), F.filter(F.transform(F.split(a, "[;,]"), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    composed = (F.size(parts) >= 2) & F.forall(parts, lambda p: usable(p, low, F.col("_s")))
    bridged = F.col("_title") & F.exists("_p", lambda s: translated(s).contains(a))
    best = F.coalesce(F.array_max(F.transform("_s", lambda s: S.jaccard(T.word_set(a), T.word_set(s), 1.0))), F.lit(0.0))
    say = lambda s, c: F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"))
    found = (a != "") & low.contains(a)
    d = d.withColumn("_best", best)
    told = (
        F.when(found & negated, say("unsupported", "high")).when(found, say("exact", "high"))
        .when(composed, say("paraphrase", "medium")).when((a != "") & bridged, say("paraphrase", "medium"))
        .when((a != "") & (F.col("_best") >= SURE), say("paraphrase", "high")).when((a != "") & (F.col("_best") >= PARAPHRASE), say("paraphrase", "medium"))
        .when(F.col("_exact"), say("unsupported", "high")).otherwise(say("unsupported", "medium"))
    )
    d = d.withColumn("_o", told)
    return d.select(key, F.col("_o.s").alias("support"), F.col("_o.c").alias("confidence"), F.col("_exact").alias("exact_question"), F.when(F.col("_o.s") == "exact", F.col("_span")).alias("matched_span"))


def source_claims(traces: DataFrame, key: str = "trace_id") -> DataFrame:
    """The source-claim map of typed traces: (key, support, confidence, exact_question, matched_span) of the ground truth against all evidence.

    Traces without a ground truth have no entry; of rows that repeat a key the latest counts.
    """
    evidence = F.filter(F.flatten(F.transform(F.filter("trace.steps", lambda s: s.isNotNull()), lambda s: F.coalesce(s["evidence"], F.array().cast("array<string>")))), lambda e: e != "")
    known = traces.where(f"trim(ground_truth) <> '' AND `{key}` IS NOT NULL").select(key, "question", "ground_truth", F.array_join(evidence, "\n").alias("source"), "loaded_at")
    last = known.groupBy(key).agg(F.max(F.struct("loaded_at", "question", "ground_truth", "source")).alias("r")).select(key, "r.*")
    return span_entailment(last, key, "question", "ground_truth", "source")


def with_claims(traces: DataFrame, claims: DataFrame, key: str = "trace_id") -> DataFrame:
    """Traces with their source claim; those without one keep nulls. The join is on the key; the planner broadcasts claims it knows to be small."""
    return traces.join(claims, key, "left")


#: Words without content, words that negate, and capitalised words that are no names.
PLAIN_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "with")
NEGATING = ("no", "not", "never", "none", "without", "cannot", "cant", "doesnt", "dont", "isnt", "arent", "wasnt", "werent", "wont", "didnt")
NO_NAMES = ("The", "A", "An", "By", "In", "On", "At", "For", "Of")
#: Words by which an answer may be longer than the truth it holds; shared words and overlap of a near miss.
LONGER, LEAST_SHARED, LEAST_OVERLAP = 8, 3, 0.25


def content_words(text: Column) -> Column:
    """Words in lower case without marks and plain words, repeats included."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: (t != "") & ~t.isin(*PLAIN_WORDS))


def numeric_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t.rlike(r"\d"))


def names(text: Column) -> Column:
    """Distinct words that look like names: capitals, capitalised words, initials."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(?:[A-Z]{2,}(?![A-Za-z0-9_])|[A-Z][a-z]+(?![A-Za-z0-9_])|[A-Z]\.)"), F.lit(0)), lambda t: ~t.isin(*NO_NAMES)))


def negation_differs(a: Column, b: Column) -> Column:
    says = lambda x: F.exists(content_words(x), lambda t: t.isin(*NEGATING))
    return says(a) != says(b)


def names_differ(a: Column, b: Column) -> Column:
    """Whether names were exchanged (two shared, both sides have others) or short ones left out (one side has others, all of at most two letters)."""
    x, y = names(a), names(b)
    shared, left, right = F.size(F.array_intersect(x, y)), F.array_except(x, y), F.array_except(y, x)
    exchanged = (shared >= 2) & (F.size(left) > 0) & (F.size(right) > 0)
    omitted = F.when((F.size(left) > 0) & (F.size(right) == 0), left).when((F.size(right) > 0) & (F.size(left) == 0), right)
    short = F.coalesce(F.forall(omitted, lambda t: F.length(F.regexp_replace(t, r"\.", "")) <= 2), F.lit(False))
    return (F.size(x) > 0) & (F.size(y) > 0) & (exchanged | ((shared >= 1) & short))


def near_miss(answer: Column, truth: Column) -> Column:
    """Whether a wrong answer looks like the right one in other words: it holds the truth and little more, or shares enough content.

    Answers that negate the truth, name others, or give no number of the truth's are no near misses.
    """
    a, t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""), F.regexp_replace(F.coalesce(truth, F.lit("")), r"^\s+|\s+$", "")
    na, nt = numeric_words(a), numeric_words(t)
    numbers = (F.size(na) > 0) & (F.size(nt) > 0) & ~F.arrays_overlap(na, nt)
    ca, ct = F.array_distinct(content_words(a)), F.array_distinct(content_words(t))
    shared = F.size(F.array_intersect(ca, ct))
    close = (shared >= LEAST_SHARED) & (S.jaccard(ca, ct) >= LEAST_OVERLAP)
    holds = F.lower(a).contains(F.lower(t))
    return F.when((a == "") | (t == "") | negation_differs(a, t) | names_differ(a, t) | numbers, False).when(holds, F.size(content_words(a)) <= F.size(content_words(t)) + LONGER).otherwise(close)
