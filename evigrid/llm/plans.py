"""Queries of the llm problems over their whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.llm import consensus, consensus_sql, duplicates, duplicates_sql, leaks, mixture, pairs, spam, truncation
from evigrid.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(table(spark, d, "blocks"), "id", "question")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.collapsed(table(spark, d, "blocks"), "id", "question")


def p1_raw_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.raw_groups(table(spark, d, "blocks"), "id", "question")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of traces and quotes of reports: (tab, record_id, step_pos, item_pos, source, text, reported length)."""
    steps = table(spark, d, "gaia_traces").select(F.lit("gaia_traces").alias("tab"), F.col("trace_id").alias("record_id"), F.posexplode("trace.steps").alias("s", "step"))
    evidence = steps.select("tab", "record_id", (F.col("s") + 1).alias("step_pos"), F.col("step.tool").alias("source"), F.posexplode("step.evidence").alias("i", "text"))
    quotes = table(spark, d, "quote_reports").select(
        F.lit("quote_reports").alias("tab"), F.col("report_id").cast("string").alias("record_id"), F.lit(0).alias("step_pos"), F.lit(0).alias("item_pos"), F.col("model").alias("source"), F.col("quote").alias("text"),
        F.col("quote_length").alias("reported"),
    )
    columns = ["tab", "record_id", "step_pos", "item_pos", "source", "text", "reported"]
    return evidence.withColumn("item_pos", F.col("i") + 1).withColumn("reported", F.lit(None).cast("int")).select(*columns).unionByName(quotes.select(*columns)).where("trim(text) <> ''").distinct()


def p5_graded(spark: SparkSession, d: str) -> DataFrame:
    return truncation.grade(p5_values(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_graded(spark, d).where("is_cut").select("tab", "record_id", "step_pos", "item_pos").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(p5_graded(spark, d))


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limits found per source: values there, those that are cut, and the prior of a cut."""
    found = truncation.length_posteriors(truncation.with_endings(p5_values(spark, d))).where("at_limit")
    return found.groupBy("tab", "source", "length").agg(F.sum("n").alias("n_values"), F.sum(F.col("n") * F.col("p_cut")).alias("n_cut"), F.max("p_limit").alias("p_limit"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of blocks and proposals (those without a block keep a null question), and of traces."""
    questions = table(spark, d, "blocks").groupBy(F.col("id").alias("block_id")).agg(F.max_by("question", F.struct("loaded_at", "question")).alias("question"))
    proposals = table(spark, d, "proposals").select("block_id", "pos", F.col("content").alias("answer")).distinct().join(questions, "block_id", "left")
    traces = table(spark, d, "gaia_traces").select(F.lit("gaia_traces").alias("tab"), F.col("trace_id").alias("record_id"), F.lit(0).alias("pos"), "question", "answer").distinct()
    return proposals.select(F.lit("proposals").alias("tab"), F.col("block_id").alias("record_id"), "pos", "question", "answer").unionByName(traces)


def p6_defects(spark: SparkSession, d: str) -> DataFrame:
    rows = Scratch(spark).cut(p6_pairs(spark, d))
    return pairs.classify(rows, pairs.train(pairs.training_sample(rows)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_defects(spark, d).where("defect IS NOT NULL").select("tab", "record_id", "pos", "defect").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per table and defect; a pair with several counts for each."""
    return p6_defects(spark, d).distinct().select("tab", F.explode("defects").alias("defect")).groupBy("tab", "defect").agg(F.count("*").alias("n_pairs"))


def _votes(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    return scratch.cut(consensus.last_votes(table(spark, d, "judge_runs"), "block_id", "model", "verdict", "recorded_at"))


def _consensus(spark: SparkSession, d: str, close: float = 1e-4) -> DataFrame:
    scratch = Scratch(spark)
    votes = _votes(spark, d, scratch)
    return consensus.consensus(votes, consensus.reliabilities(votes, close=close, scratch=scratch), minimum=3)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).select(F.col("item").alias("block_id"), "verdict")


#: How near the vector must settle where numbers are reported and not only verdicts.
_CLOSE = 1e-9


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = _consensus(spark, d, _CLOSE)
    return found.select(F.col("item").alias("block_id"), "verdict", "n_votes", F.round("agreement", 6).alias("agreement"), F.round("confidence", 5).alias("confidence"))


def p7_reliability(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    found = consensus.reliabilities(_votes(spark, d, scratch), close=_CLOSE, scratch=scratch)
    return found.select(F.col("annotator").alias("model"), "n_votes", "overlap", F.round("reliability", 6).alias("reliability"), F.round("r", 6).alias("r"))


def p7_votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.last_votes(table(spark, d, "judge_runs"), "block_id", "model", "verdict", "recorded_at").select(
        F.col("item").alias("block_id"), F.col("annotator").alias("model"), F.col("label").alias("verdict")
    )


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_spans(spark, d))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    spans = Scratch(spark).cut(_spans(spark, d))
    return leaks.without_leaks(table(spark, d, "documents"), spans).select("doc_id", F.length("text").alias("n_chars"), "removed_chars", "dropped")


#: The tree above the sources: shortages of a source go to its language within its domain first, then to other languages of the domain, then to other domains.
DOMAINS = {
    "run_reports": "records", "audit_notes": "records", "changelogs": "records", "web_pages": "public", "forum_threads": "public", "annotator_guides": "guidance", "policy_memos": "guidance", "paper_abstracts": "guidance",
}


def _mix(spark: SparkSession, d: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    docs = Scratch(spark).cut(mixture.with_tokens(table(spark, d, "documents").select("doc_id", "source", "lang", "text")))
    if total is not None:
        total *= docs.agg(F.sum("n_tokens")).head()[0] or 0
    return mixture.mix(docs, table(spark, d, "source_targets"), total, domains=DOMAINS)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix that meets every target."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_whole_corpus_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as the corpus: scarce sources are repeated up to their caps and fall short, others of their domain fill up."""
    return _mix(spark, d, 1.0)[0]


def p9_whole_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, 1.0)[1]


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_evidence(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(p10_evidence(spark, d)).select("doc_id")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_collapsed, p1_raw_groups, p5_found, p5_values, p5_rates, p5_limits, p5_graded, p6_found, p6_pairs, p6_defects, p6_report, p7_found, p7_agreement, p7_reliability, p7_votes,
    p8_found, p8_spans, p8_clean, p9_mix, p9_shares, p9_whole_corpus_mix, p9_whole_corpus_shares, p10_found, p10_evidence,
)}

ORACLE = {
    "p1_found": duplicates_sql.FOUND,
    "p1_collapsed": duplicates_sql.COLLAPSED,
    "p1_raw_groups": "SELECT question AS text, count(DISTINCT id) AS n_ids, min(id) AS first_id FROM blocks WHERE question IS NOT NULL GROUP BY 1",
    "p5_values": """SELECT DISTINCT 'gaia_traces' AS tab, trace_id AS record_id, CAST(s AS INT) AS step_pos, CAST(i AS INT) AS item_pos, trace.steps[s].tool AS source, trace.steps[s].evidence[i] AS text, NULL::INT AS reported
FROM (SELECT trace_id, trace, s, unnest(range(1, len(trace.steps[s].evidence) + 1)) AS i FROM (SELECT trace_id, trace, unnest(range(1, len(trace.steps) + 1)) AS s FROM gaia_traces))
WHERE trim(trace.steps[s].evidence[i], ' ') <> ''
UNION SELECT 'quote_reports', CAST(report_id AS VARCHAR), 0, 0, model, quote, quote_length FROM quote_reports WHERE trim(quote, ' ') <> ''""",
    "p6_pairs": """SELECT DISTINCT 'proposals' AS tab, p.block_id AS record_id, p.pos, b.question, p.content AS answer FROM proposals p LEFT JOIN (SELECT DISTINCT id, question FROM blocks) b ON b.id = p.block_id
UNION SELECT 'gaia_traces', trace_id, 0, question, answer FROM gaia_traces""",
    "p7_votes": consensus_sql.VOTES,
    "p7_reliability": consensus_sql.RELIABILITY,
    "p7_agreement": consensus_sql.AGREEMENT,
    "p7_found": consensus_sql.FOUND,
}
