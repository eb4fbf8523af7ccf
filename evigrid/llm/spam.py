"""Keyword-stuffed and link-list pages (problem 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import Scratch, is_small

#: Words of a phrase shingle; shorter phrases are one shingle.
SHINGLE = 5
#: Items of more words are entries, not keywords; runs of so many words without a sentence are looked at by repetition.
MAX_ITEM_WORDS, LONG_RUN = 4, 25
#: A longer phrase is stitched in if shingles on at least so many hosts, and on no fewer than this part of the hosts of
#: its most frequent one, cover its words: an entry made from a template holds words that stand nowhere else.
LONG_HOSTS, EVENNESS = 4, 1 / 20
#: Words of a window of sentences in which repetition is measured; phrases, and their mean words, that make a line with a closing mark a list.
WINDOW, LIST_PHRASES, LIST_WORDS = 30, 5, 10

#: An anchor without its end is a tag and its address; the text of an anchor holds no other anchor, so unclosed ones cost no search.
_LINK = r"(?i)<a\s[^>]*+>(?:[^<]++|<(?!/?a[\s>]))*+</a>|\[[^\]\n]*+\]\(\s*[^)\s]+\s*\)|(?:https?://|www\.)[^\s<>\"')\]]++"
_TAG = r"(?<![\p{L}\p{N}_&/])#[\p{L}_][\p{L}\p{N}_-]*"
#: A sentence or a labelled sentence: words up to a closing mark, at least four blanks within.
_LINE = r"\n+|\s++(?=[\p{Lu}\p{N}\"“‘'(\[])(?<=[.!?…][\"”’')\]]{0,2}\s{1,64})"
_SENTENCE = r"(?s)^\s*+(?:\S++\s++){3}.*[.!?…:][\"”’')\]*_]*\s*$"
#: A row of a table or a log: cells with figures, or a date in front.
_ENTRY = r"\t\s*[-+]?\d|^\s*\[?\d{4}-\d\d-\d\d|^\s*\[?\d\d:\d\d"
_DELIMITER = r"\s*[,;|·•*>\t/]+\s*|\s+[-–—:]\s+|\n+|^\s*[-*•]\s+|\.\s+"
_LISTED = r"[,;|·•]"
_WORD = r"[\p{L}\p{N}]+"


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0))


def _is_stuffed(w: Column) -> Column:
    return (F.size(w) >= LONG_RUN) & (F.size(F.array_distinct(w)) <= 0.5 * F.size(w))


def _list_dense(x: Column) -> Column:
    n = F.size(F.split(x, _LISTED))
    return (n >= LIST_PHRASES) & (F.size(F.split(F.trim(x), r"\s+")) <= LIST_WORDS * n)


def repeated_chars(sentences: Column) -> Column:
    """Characters in windows of WINDOW words of which at most half are distinct; a sentence said again, be it with other figures, counts once."""
    text = F.regexp_replace(F.lower(F.array_join(sentences, "\n")), r"\p{N}+", "0")
    starts = lambda ws: F.when(F.size(ws) >= LONG_RUN, F.sequence(F.lit(1), F.size(ws), F.lit(WINDOW))).otherwise(F.array())

    def stuffed(t: Column) -> Column:
        # one element, so that the words are taken once and not once a window
        windows = F.flatten(F.transform(F.array(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))), lambda ws: F.transform(starts(ws), lambda i: F.slice(ws, i, WINDOW))))
        return F.filter(windows, lambda w: F.size(F.array_distinct(w)) <= 0.5 * F.size(w))

    # sentences are only compared where a window of the whole text repeats itself
    counted = F.transform(F.array(text), lambda t: F.when(F.size(stuffed(t)) > 0, F.aggregate(stuffed(F.array_join(F.array_distinct(F.split(t, r"[.!?…]+\s+|\n")), "\n")), F.lit(0), lambda a, w: a + F.length(F.array_join(w, "")))).otherwise(0))
    return F.element_at(counted, 1)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and per document: chars of links, tags, sentences, entries; its list phrases.

    A line that is a sentence, or a tabular or dated entry, is set aside, sentences with the characters
    of their repetitive windows; what is left, and a line of many short phrases whatever mark ends it, is
    cut at list delimiters into phrases. A phrase of up to MAX_ITEM_WORDS words is a list item.
    """
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    none = F.array().cast("array<string>")
    low = F.lower("text")
    linked = low.contains("://") | low.contains("](") | low.contains("<a") | low.contains("www.")  # most texts have no link, most have no tag
    base = docs.select("doc_id", "host", "text", linked.alias("linked"))
    base = base.withColumn("links", F.when(F.col("linked"), F.regexp_extract_all("text", F.lit(_LINK), F.lit(0))).otherwise(none))
    base = base.withColumn("rest", F.when(F.col("linked"), F.regexp_replace("text", _LINK, "\n")).otherwise(F.col("text")))
    tagged = F.col("rest").contains("#")
    base = base.withColumn("tags", F.when(tagged, F.regexp_extract_all("rest", F.lit(_TAG), F.lit(0))).otherwise(none))
    base = base.withColumn("rest", F.when(tagged, F.regexp_replace("rest", _TAG, "\n")).otherwise(F.col("rest")))
    kind = lambda x: F.when(x.rlike(_ENTRY), "entry").when(x.rlike(_SENTENCE) & ~_list_dense(x), "sentence").otherwise("loose")
    base = base.withColumn("kinds", F.transform(F.split("rest", _LINE), lambda x: F.struct(kind(x).alias("kind"), x.alias("x"))))
    of_kind = lambda k: F.transform(F.filter("kinds", lambda s: s["kind"] == k), lambda s: s["x"])
    base = base.withColumn("loose", of_kind("loose"))
    phrases = F.filter(F.flatten(F.transform("loose", lambda x: F.split(x, _DELIMITER))), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    base = base.withColumn("phrases", F.transform(phrases, lambda x: _words(x)))
    return base.select(
        "doc_id",
        "host",
        F.length(F.regexp_replace("text", r"\s+", "")).alias("n_solid"),
        size("links").alias("link_chars"),
        size("tags").alias("tag_chars"),
        repeated_chars(of_kind("sentence")).alias("repeated_chars"),
        F.size("links").alias("n_links"),
        F.size("tags").alias("n_tags"),
        F.filter("phrases", lambda w: F.size(w) > 0).alias("phrases"),
    )


def phrase_shingles(measured: DataFrame) -> DataFrame:
    """(doc_id, host, phrase, n_words, stuffed, chars, times, at, shingle): shingles of SHINGLE words of every list phrase; shorter phrases whole.

    One row per distinct phrase of a document and shingle of it; chars are those of all its occurrences.
    """
    w = F.col("w")
    phrases = (
        measured.select("doc_id", "host", F.explode("phrases").alias("w"))
        .groupBy("doc_id", "host", "w").agg(F.count("*").alias("times"))
        .select("doc_id", "host", F.xxhash64(F.array_join(w, " ")).alias("phrase"), F.size(w).alias("n_words"), _is_stuffed(w).alias("stuffed"), (F.length(F.array_join(w, "")) * F.col("times")).alias("chars"), "times", "w")
    )
    spans = F.when(F.size(w) > SHINGLE, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))).otherwise(F.array(F.lit(1)))
    shingled = F.transform(spans, lambda i: F.struct(i.alias("at"), F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")).alias("shingle")))
    return phrases.select("doc_id", "host", "phrase", "n_words", "stuffed", "chars", "times", F.explode(shingled).alias("s")).select("doc_id", "host", "phrase", "n_words", "stuffed", "chars", "times", "s.*")


def phrase_spread(shingles: DataFrame, spread: DataFrame) -> DataFrame:
    """(doc_id, phrase, n_words, chars, times, is_spread): the phrases of each document, and whether they stand on other hosts too.

    A phrase of up to MAX_ITEM_WORDS words is spread if two hosts have it. A longer one is if its
    words, one in LONG_RUN excepted, lie in shingles on LONG_HOSTS hosts and on hosts nearly as many
    as those of its most frequent shingle. Stuffed runs are counted as such.
    """
    rows = shingles.join(spread, "shingle", "left").groupBy("doc_id", "host", "phrase", "n_words", "stuffed").agg(
        F.max("chars").alias("chars"), F.max("times").alias("times"), F.max("hosts").alias("most"), F.collect_list(F.struct("at", F.coalesce("hosts", F.lit(1)).alias("hosts"))).alias("at")
    )
    held = F.filter("at", lambda s: (s["hosts"] >= LONG_HOSTS) & (s["hosts"] >= EVENNESS * F.col("most")))
    covered = F.size(F.array_distinct(F.flatten(F.transform(held, lambda s: F.sequence(s["at"], s["at"] + (SHINGLE - 1))))))
    long = ~F.col("stuffed") & (F.col("n_words") - covered <= F.floor(F.col("n_words") / LONG_RUN))
    return rows.select("doc_id", "phrase", "n_words", "chars", "times", F.when(F.col("n_words") <= MAX_ITEM_WORDS, F.col("most").isNotNull()).otherwise(long).alias("is_spread"))


def hosts_per_shingle(shingles: DataFrame, least: int = 2) -> DataFrame:
    """Shingles found on at least so many distinct hosts, counted over all documents.

    Distinct (shingle, host) pairs are combined on the map side first, so a phrase that stands in a
    third of all pages costs one row per host and task.
    """
    return shingles.select("shingle", "host").distinct().groupBy("shingle").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= least)


def page_evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "site", url: str = "url", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id with the shares of its solid characters that are links, tags, stuffed, list items, replicated list items and longer replicated phrases.

    The host is the site, else the url's, else the document itself. Texts are read whole; null and
    blank texts have shares of 0; of repeated rows of a document the longest text counts.
    """
    scratch = Scratch(docs.sparkSession)
    host = F.coalesce(F.lower(site), F.expr(f"nullif(lower(regexp_extract(`{url}`, '^[a-z]+://([^/:]+)', 1)), '')"), F.concat(F.lit("\u0001"), F.col(doc_id).cast("string")))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), host.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    measured = measures(rows)
    kept = scratch.cut(measured)
    shingles = scratch.cut(phrase_shingles(kept))
    spread = scratch.cut(hosts_per_shingle(shingles))
    spread = F.broadcast(spread) if is_small(spread, broadcast_bytes) else spread
    item = F.col("n_words") <= MAX_ITEM_WORDS
    per_doc = (
        phrase_spread(shingles, spread)
        .groupBy("doc_id")
        .agg(
            F.sum(F.when(item, F.col("chars")).otherwise(0)).alias("item_chars"),
            F.sum(F.when(item & F.col("is_spread"), F.col("chars")).otherwise(0)).alias("spread_item_chars"),
            F.sum(F.when(~item & F.col("is_spread"), F.col("chars")).otherwise(0)).alias("spread_long_chars"),
            F.sum(F.when(item, F.col("times")).otherwise(0)).alias("n_items"),
        )
    )
    words = F.flatten("phrases")
    variety = F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(1.0))
    stuffed = F.aggregate(F.filter("phrases", _is_stuffed), F.col("repeated_chars"), lambda a, w: a + F.length(F.array_join(w, "")))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_solid")), F.lit(0.0))
    doc = kept.select("doc_id", "n_solid", "link_chars", "tag_chars", "n_links", "n_tags", stuffed.alias("stuffed_chars"), variety.alias("variety"))
    doc = doc.groupBy("doc_id").agg(F.max(F.struct("n_solid", *[c for c in doc.columns if c not in ("doc_id", "n_solid")])).alias("m")).select("doc_id", "m.*")
    joined = doc.join(per_doc, "doc_id", "left").fillna(0)
    return joined.select(
        "doc_id", "n_solid", "n_links", "n_tags", "n_items", "variety",
        share("link_chars").alias("link_share"), share("tag_chars").alias("tag_share"), share("stuffed_chars").alias("stuffed_share"),
        share("item_chars").alias("item_share"), share("spread_item_chars").alias("spread_share"),
        share("spread_long_chars").alias("spread_long_share"),
    )


def spam_pages(evidence: DataFrame, most: float = 0.5, least_spread: float = 0.05, stuffed_variety: float = 0.5) -> DataFrame:
    """The evidence of pages whose text is for the most part links, tags, keyword items, replicated phrases or stuffed runs.

    List items count where the page is stitched from phrases that stand on other hosts too, or where it
    says the same few words again and again (variety: distinct words of its phrases over all of
    them). A list whose items are neither is a list of entries.
    """
    stitched = (F.col("spread_share") >= least_spread) | (F.col("variety") <= stuffed_variety)
    whole = F.col("link_share") + F.col("tag_share") + F.col("stuffed_share") + F.col("spread_long_share") + F.when(stitched, F.col("item_share")).otherwise(0.0)
    return evidence.withColumn("spam_share", whole).where(F.col("spam_share") > most)
