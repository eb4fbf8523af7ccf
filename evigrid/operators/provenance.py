"""Whether a quote stands in its source, and how it had to be read for that."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from evigrid.functions import text as T

#: Match paths in the order in which they are tried.
PATHS = ("exact", "whitespace-normalized", "fuzzy-truncated", "unicode-normalized", "structural-unwrapped", "no-match")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """Smart quotes, dashes, ellipses and invisible characters as plain ones; the rest is left (see nfkc)."""
    t = F.translate(text, "‘’‚‛“”„‟–—​‌‍﻿", "''''\"\"\"\"--")
    return F.regexp_replace(t, "…", "...")


def clean_quote(quote: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(quote, r"\.{2,}\s*$", ""), r"…\s*$", ""))


def fragments_in_order(quote: Column, source: Column, least: int = 8) -> Column:
    """Whether the parts between ellipses, of eight characters or more, stand in the source, each after the last, white space aside."""
    flat = F.regexp_replace(F.regexp_replace(source, r"(?m)^\s+", ""), r"\s+", " ")
    parts = F.filter(F.transform(F.split(quote, r"\.{2,}|…"), lambda f: F.trim(F.regexp_replace(f, r"\s+", " "))), lambda f: F.length(f) >= least)
    last = F.aggregate(parts, F.lit(1), lambda pos, f: F.when(pos <= 0, pos).otherwise(_after(flat, f, pos)))
    return (F.size(parts) > 0) & (last > 0)


def _after(text: Column, part: Column, pos: Column) -> Column:
    at = F.call_function("locate", part, text, pos)
    return F.when(at > 0, at + F.length(part)).otherwise(F.lit(0))


def match_path(quote: Column, source: Column, unicode_paths: bool = True) -> Column:
    """The first path on which the quote is found; null for a null quote or source.

    Texts are expected in NFKC form where they are not ASCII (see with_match_path).
    """
    clean = clean_quote(quote)
    lines = lambda t: F.regexp_replace(t, r"(?m)^[ \t]+", "")
    bare = T.unwrapped(clean)
    out = F.when(quote.isNull() | source.isNull(), F.lit(None)).when(source.contains(clean) | source.contains(quote), PATHS[0])
    out = out.when(lines(source).contains(lines(clean)), PATHS[1]).when(fragments_in_order(clean, source), PATHS[2])
    if unicode_paths:
        out = out.when(folded(source).contains(folded(clean)), PATHS[3]).when((bare != clean) & folded(source).contains(folded(bare)), PATHS[4])
    return out.otherwise(PATHS[5])


def with_match_path(rows: DataFrame, quote: str, source: str, unicode_paths: bool = True) -> DataFrame:
    """Adds match_path. Exact matches and ASCII rows never enter Python: rows that need NFKC are split off by a filter."""
    plain = match_path(F.col(quote), F.col(source), unicode_paths)
    odd = F.coalesce(F.concat(F.col(quote), F.col(source)).rlike(r"[^\x00-\x7F]") & ~F.col(source).contains(clean_quote(F.col(quote))), F.lit(False))
    ascii_rows = rows.where(~odd).withColumn("match_path", plain)
    if not unicode_paths:
        return rows.withColumn("match_path", plain)
    again = rows.where(odd).withColumn("_q", nfkc(F.col(quote))).withColumn("_s", nfkc(F.col(source)))
    first = match_path(F.col(quote), F.col(source), False)
    second = match_path(F.col("_q"), F.col("_s"), True)
    redone = F.when(first != PATHS[5], first).when(second.isin(PATHS[0], PATHS[1], PATHS[2]), PATHS[3]).otherwise(second)
    return ascii_rows.unionByName(again.withColumn("match_path", redone).drop("_q", "_s"))


def codes(score: Column, quote: Column, path: Column) -> Column:
    """Provenance codes of a graded step."""
    return F.array_compact(F.array(
        F.when((score >= 0.75) & quote.isNull(), "PROV_FAIL_01"),
        F.when(path == PATHS[5], "PROV_FAIL_02").when(path.isNotNull() & (path != PATHS[0]), "PROV_INFO_07"),
        F.when(F.length(clean_quote(quote)) < 10, "PROV_WARN_06"),
    ))


def longest_prefix(quote: Column, source: Column, least: int = 8) -> Column:
    """Length of the longest beginning of the quote, of at least eight characters, that the source holds; 0 if none.

    Containment of a prefix falls once with its length, so the length is bisected: thirty steps do for any text.
    """
    zero = F.struct(F.lit(0).alias("lo"), F.length(quote).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        hit = source.contains(F.left(quote, mid))
        return F.struct(F.when(hit, mid).otherwise(acc["lo"]).alias("lo"), F.when(hit, acc["hi"]).otherwise(F.greatest(mid - 1, acc["lo"])).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(30)), zero, halve)["lo"]
    return F.when(found >= least, found).otherwise(0)


def variants(quote: Column) -> Column:
    """ARRAY<STRUCT<kind, text>>: ways in which a model may reproduce a quote."""
    words = F.split(quote, " ")
    n = F.size(words)
    mid = (n / 2).cast("int")
    swapped = F.when(n >= 4, F.array_join(F.concat(F.slice(words, F.lit(1), mid - 1), F.array(F.get(words, mid)), F.array(F.get(words, mid - 1)), F.slice(words, mid + 2, n)), " ")).otherwise(quote)
    made = [("plain", quote), ("smart", F.translate(quote, "'\"", "’”")), ("dash", F.translate(quote, "-", "—")), ("ellipsis", F.concat(quote, F.lit("..."))), ("wrapped", F.concat(F.lit('"'), quote, F.lit('"'))), ("swapped", swapped)]
    return F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in made])


#: Characters by which a text's tokenisation is suspected, with the names of the signals.
SIGNALS = (
    ("smart_apostrophe", "[\u2018\u2019]"), ("smart_quote", "[\u201c\u201d]"), ("nbsp", "\u00a0"), ("en_or_em_dash", "[\u2013\u2014]"), ("ellipsis_char", "\u2026"),
    ("zero_width_space", "[\u200b-\u200d\ufeff]"), ("crlf_newline", r"\r\n|\r"),
)
#: Wording of a judge that hints at a wrong source.
WRONG_SOURCE_HINT = r"(?i)wikipedia|blog|secondary|different source|wrong source"


def signals(text: Column) -> Column:
    """Names of the tokenisation signals in a text, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SIGNALS]))


def is_structural(quote: Column) -> Column:
    """Three quotation marks or more within the first 80 characters: a quote of a quote."""
    return F.regexp_count(F.left(quote, F.lit(80)), F.lit("[\"'\u2018\u2019\u201c\u201d]")) >= 3


def hex_dump(text: Column, most: int = 60) -> Column:
    """The first bytes of a text's UTF-8 form, two digits each."""
    return F.trim(F.regexp_replace(F.lower(F.hex(F.substring(F.encode(text, "UTF-8"), 1, most))), "(..)", "$1 "))


def diagnose(rows: DataFrame, quote: str = "quote", source: str = "source", reasoning: str | None = None) -> DataFrame:
    """rows with match_path and why a quote is not found: prefix, position, first_difference, quote_hex, source_hex, signals, mode.

    Only the exact, whitespace and truncated paths count as found here. mode is no_quote, matched,
    or for the others what their texts suggest, in this order: tokenisation, a quote of a quote, a
    wrong source (by the judge's reasoning), a paraphrase (a beginning of eight characters or more,
    but of less than six tenths), else inconclusive. A null source holds nothing. All within a row.
    """
    text, clean = F.coalesce(F.col(source), F.lit("")), clean_quote(F.col(quote))
    d = rows.withColumn("_path", match_path(F.col(quote), text, False)).withColumn("_prefix", longest_prefix(clean, text))
    d = d.withColumn("_at", F.when(F.col("_prefix") > 0, F.call_function("instr", text, F.left(clean, F.col("_prefix"))) - 1).otherwise(-1))
    held = F.col("_at") >= 0
    window = F.when(held, F.substr(text, F.greatest(F.col("_at") - 4, F.lit(1)), F.length(clean) + 5 + F.least(F.col("_at"), F.lit(5)))).otherwise("")
    of_quote, of_source = signals(clean), signals(window)
    told = F.array_compact(F.array(
        F.when(F.size(of_quote) > 0, F.concat(F.lit("quote:"), F.array_join(of_quote, ","))), F.when(F.size(of_source) > 0, F.concat(F.lit("trace:"), F.array_join(of_source, ","))),
        F.when(is_structural(clean), F.lit("structural_meta_quote")), F.when(F.col(reasoning).rlike(WRONG_SOURCE_HINT), F.lit("reasoning_hints_wrong_source")) if reasoning else F.lit(None).cast("string"),
    ))
    failed = F.col("_path") == PATHS[5]
    d = d.withColumn("_told", F.when(failed, told).otherwise(F.array().cast("array<string>")))
    mode = (
        F.when(F.col(quote).isNull(), "no_quote").when(~failed, "matched")
        .when(F.exists("_told", lambda s: s.rlike("^(quote|trace):")), "mode_1_tokenization").when(F.array_contains("_told", "structural_meta_quote"), "mode_3_structural")
        .when(F.array_contains("_told", "reasoning_hints_wrong_source"), "mode_4_wrong_source")
        .when((F.col("_prefix") >= 8) & (F.col("_prefix") < 0.6 * F.length(clean)), "mode_2_paraphrase").otherwise("inconclusive")
    )
    only = lambda c: F.when(failed, c)
    return d.select(
        *rows.columns, F.coalesce("_path", F.lit(PATHS[5])).alias("match_path"), only(F.col("_prefix")).alias("prefix"), only(F.col("_at")).alias("position"),
        only(F.when(held, F.col("_prefix")).otherwise(0)).alias("first_difference"), only(hex_dump(clean)).alias("quote_hex"),
        only(F.when(held, hex_dump(F.substr(text, F.col("_at") + 1, F.length(clean) + 4))).otherwise("")).alias("source_hex"), F.col("_told").alias("signals"), mode.alias("mode"),
    )


def path_distribution(matched: DataFrame) -> DataFrame:
    """(match_path, n): most frequent first."""
    return matched.groupBy("match_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match_path")


def probe_sweep(probes: DataFrame, source: str = "source") -> DataFrame:
    """(kind, probes, before, after, gained): per kind of variant how many match without and with the unicode and unwrapping paths. probes: kind, text, source."""
    plain = match_path(F.col("text"), F.col(source), False)
    both = with_match_path(probes.withColumn("_before", plain), "text", source)
    hit = lambda c: F.coalesce(F.col(c) != PATHS[5], F.lit(False))
    out = both.groupBy("kind").agg(F.count("*").alias("probes"), F.count_if(hit("_before")).alias("before"), F.count_if(hit("match_path")).alias("after"))
    return out.withColumn("gained", F.col("after") - F.col("before"))


# --- quotes that run over the end of a line -----------------------------------------------------------


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def line_tail(quote: Column) -> Column:
    """What follows the last line break of a quote; null without one."""
    return F.when(quote.contains("\n"), _strip(F.substring_index(quote, "\n", -1)))


def crosses_lines(quote: Column, source: Column) -> Column:
    """Whether a quote ends on a fragment of up to 16 characters that begins another line of the source."""
    tail = line_tail(quote)
    return F.coalesce(tail.rlike(r"^[A-Za-z\[(]") & (F.length(tail) <= 16) & source.contains(F.concat(F.lit("\n"), tail)), F.lit(False))


def ends_within_word(quote: Column) -> Column:
    return F.coalesce(quote.rlike(r"[A-Za-z\[(]\s*$"), F.lit(False))


def bridges(quote: Column, source: Column) -> Column:
    """Whether the two sides of a quote's first line break stand in the source, but not one after the other."""
    left, right = _strip(F.substring_index(quote, "\n", 1)), _strip(F.substr(quote, F.call_function("instr", quote, F.lit("\n")) + 1))
    long = quote.contains("\n") & (F.length(left) >= 8) & (F.length(right) >= 4)
    return F.coalesce(long & source.contains(left) & source.contains(right) & ~source.contains(F.concat(left, F.lit("\n"), right)), F.lit(False))


def line_break_signals(quote: Column, source: Column) -> Column:
    """Signals that a quote was cut across lines; an end within a word only confirms one of the other two."""
    a, c = crosses_lines(quote, source), bridges(quote, source)
    return F.array_compact(F.array(F.when(a, F.lit("cross_line_fragment_tail")), F.when(c, F.lit("bridge_span_concat")), F.when((a | c) & ends_within_word(quote), F.lit("mid_word_termination"))))


def cross_line_quote(source: Column) -> Column:
    """A probe made of a source: its first line of 20 characters or more whose follower has twelve, and the follower's first ten; null if none ends within a word."""
    lines = F.transform(F.split(source, "\n"), _strip)
    made = F.transform(lines, lambda x, i: F.when((F.length(x) >= 20) & (F.length(F.get(lines, i + 1)) >= 12) & F.left(F.get(lines, i + 1), F.lit(10)).rlike(r"[A-Za-z\[(]$"), F.concat(x, F.lit("\n"), F.left(F.get(lines, i + 1), F.lit(10)))))
    return F.get(F.array_compact(made), F.lit(0))


def bridge_quote(source: Column) -> Column:
    """A probe of a source's first line and the first twelve characters of a line that does not follow it."""
    lines = F.transform(F.split(source, "\n"), _strip)
    first = F.get(lines, F.lit(0))
    made = F.transform(lines, lambda x, i: F.when((i >= 2) & (F.length(first) >= 10) & (F.length(x) >= 8) & F.left(x, F.lit(12)).rlike(r"[A-Za-z\[(]$"), F.concat(first, F.lit("\n"), F.left(x, F.lit(12)))))
    return F.get(F.array_compact(made), F.lit(0))


def line_break_sweep(sources: DataFrame, source: str = "source") -> DataFrame:
    """One row: sources, those that probes can be made of, and how many probes each signal finds."""
    text = F.coalesce(F.col(source), F.lit(""))
    d = sources.select(text.alias("_s"), cross_line_quote(text).alias("_q"), bridge_quote(text).alias("_b"))
    d = d.withColumn("_x", F.when(F.col("_q").isNotNull(), line_break_signals(F.col("_q"), F.col("_s")))).withColumn("_y", F.when(F.col("_b").isNotNull(), line_break_signals(F.col("_b"), F.col("_s"))))
    has = lambda c, n: F.count_if(F.coalesce(F.array_contains(c, n), F.lit(False)))
    return d.agg(
        F.count("*").alias("sources"), F.count("_q").alias("made"), F.count_if(F.size("_x") > 0).alias("triggered"), has("_x", "cross_line_fragment_tail").alias("cross_line"), has("_x", "mid_word_termination").alias("mid_word"),
        has("_x", "bridge_span_concat").alias("bridge"), F.count_if(F.size("_x") >= 2).alias("several"), F.count("_b").alias("bridges_made"), has("_y", "bridge_span_concat").alias("bridges_found"),
    )
