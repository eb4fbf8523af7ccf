"""Traces as plan records, and the comparison, validation and calibration of generated plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Tools known by name in a description.
KNOWN_TOOLS = ("search engine", "web browser", "python_interpreter", "final_answer", "visualizer", "inspect_file_as_text", "search_agent")
#: Least and most steps of a generated plan, and the shortest description.
PLAN_STEPS, SHORTEST = (3, 6), 10
#: Words by which the domain of a question is known.
DOMAINS = {
    "medical": r"(?i)\b(drug|medication|dose|dosage|mg|mcg|contraindication|eGFR|CKD|diabetes|cancer|hypertension|FDA|label|vaccine|symptom|diagnosis|treatment|prescription|ibuprofen|metformin|warfarin|statin|antibiotic|clinical|renal|hepatic|cardiac|stage|opioid|taper|patient|KDIGO|CDC|guideline|therapy|potassium iodide|allergy|interaction|side.?effect|pharma)",
    "legal": r"(?i)\b(law|statute|regulation|court|jurisdiction|contract|liability|tort|enforceable|legal|illegal|sue|lawsuit|damages|GDPR|HIPAA|ADA|§|U\.S\.C\.|CFR|attorney|compliance|estoppel|cause of action|Article \d|directive|regulation \(EU\)|legitimate interest)",
    "financial": r"(?i)\b(tax|IRS|401k|IRA|Roth|capital gain|dividend|SEC|FINRA|deductible|bond|stock|ETF|depreciation|FICA|W-2|1099|AGI|MAGI|contribution limit|GAAP|IFRS|materiality|audit|disclosure)",
    "technical": r"(?i)\b(TLS|SSL|RFC \d+|NIST|ISO \d+|API|HTTP|OAuth|JWT|CVE|OWASP|encryption|protocol|PCI.?DSS|SOC|vulnerability|patch|firmware|deprecated|standard|status code|specification)",
}


def latest_traces(traces: DataFrame) -> DataFrame:
    """The latest row of each trace; rows without a trace id are left out."""
    cols = [c for c in traces.columns if c not in ("trace_id", "loaded_at", "annotator_metadata")]
    meta = F.col("annotator_metadata")
    keyed = traces.where("trace_id IS NOT NULL").select("trace_id", F.struct("loaded_at", *cols, F.array_sort(F.map_entries(meta)).alias("_meta")).alias("r"))
    last = keyed.groupBy("trace_id").agg(F.max("r").alias("r"))
    return last.select("trace_id", *[F.col(f"r.{c}").alias(c) for c in cols], F.map_from_entries("r._meta").alias("annotator_metadata"), F.col("r.loaded_at").alias("loaded_at"))


def annotator_lines(text: Column) -> Column:
    """Lines of an annotator's list without step names and numbers, blank ones left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^step\s*\d+\s*:\s*", ""), r"^\d+\.\s*", ""))
    return F.filter(bare, lambda x: x != "")


def plan_steps(traces: DataFrame) -> DataFrame:
    """(trace_id, step_id, grp, idx, description, tools, provenance) of typed traces: annotator lines, all steps as executed, and those that are no answer as the plan.

    Null steps are left out before they are numbered. A tool that is absent or internal is none. All
    three groups of a trace come out of its one row, without a shuffle.
    """
    said = F.transform(annotator_lines(F.col("annotator_metadata")["Steps"]), lambda d, i: _step("annotator", "annotator:step:", i, d, F.array().cast("array<string>"), "annotator", 1.0, F.concat(F.lit("annotator_metadata.Steps line "), i + 1)))
    real = F.filter(F.coalesce("trace.steps", F.array()), lambda s: s.isNotNull())
    tools = lambda s: F.when(s["tool"].isNull() | s["tool"].isin("", "internal"), F.array().cast("array<string>")).otherwise(F.array(s["tool"]))
    done = F.transform(real, lambda s, i: _step("agent:exec", "agent:exec:step:", i, s["summary"], tools(s), "explicit", 1.0, F.concat(F.lit("trace.steps["), i, F.lit("]"))))
    meant = F.filter(real, lambda s: F.coalesce(s["kind"] != "answer", F.lit(True)))
    plan = F.transform(meant, lambda s, i: _step("agent:plan", "agent:plan:step:", i, s["summary"], tools(s), "inferred", 0.8, F.concat(F.lit("trace.steps["), i, F.lit("] projected into inferred plan"))))
    return traces.select("trace_id", F.explode(F.concat(said, plan, done)).alias("s")).select("trace_id", "s.*")


def _step(grp: str, prefix: str, i: Column, description: Column, tools: Column, origin: str, confidence: float, evidence: Column) -> Column:
    provenance = F.struct(F.lit(origin).alias("origin"), evidence.alias("sourceEvidence"), F.lit(confidence).alias("confidence"))
    return F.struct(F.concat(F.lit(prefix), i + 1).alias("step_id"), F.lit(grp).alias("grp"), (i + 1).alias("idx"), description.alias("description"), tools.alias("tools"), provenance.alias("provenance"))


def plan_edges(steps: DataFrame) -> DataFrame:
    """(trace_id, id, src, dst, type): sequential edges within each group of plan_steps; numbers follow each other, so an edge needs no partner row."""
    last = steps.groupBy("trace_id", "grp").agg(F.max("idx").alias("n")).where("n > 1")
    i = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i")
    prefix = F.concat("grp", F.lit(":step:"))
    return last.select("trace_id", "grp", i).select(
        "trace_id", F.concat("grp", F.lit(":edge:"), "i").alias("id"), F.concat(prefix, F.col("i")).alias("src"), F.concat(prefix, F.col("i") + 1).alias("dst"), F.lit("sequential").alias("type")
    )


def information_flows(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """(trace_id, id, src, dst, value): the question into the first plan and executed step, the answer out of the last executed one."""
    sizes = steps.groupBy("trace_id").agg(F.count_if(F.col("grp") == "agent:plan").alias("n_plan"), F.count_if(F.col("grp") == "agent:exec").alias("n_exec"))
    flow = lambda ok, i, a, b, v: F.when(ok, F.struct(F.lit(i).alias("id"), a.alias("src"), b.alias("dst"), v.alias("value")))
    one, p, e = F.lit, F.col("n_plan") > 0, F.col("n_exec") > 0
    flows = F.array_compact(F.array(
        flow(p, "flow:goal_to_plan", one("goal"), one("agent:plan:step:1"), F.col("question")), flow(e, "flow:goal_to_exec", one("goal"), one("agent:exec:step:1"), F.col("question")),
        flow(e, "flow:exec_to_final_answer", F.concat(one("agent:exec:step:"), "n_exec"), one("final_answer"), F.col("answer")),
    ))
    return traces.select("trace_id", "question", "answer").join(sizes, "trace_id").select("trace_id", F.explode(flows).alias("f")).select("trace_id", "f.*")


def is_verified(answer: Column, truth: Column, final_correct: Column) -> Column:
    """Whether an answer is right: not if it was marked wrong; else by the truth, trimmed and without case, where there is one, else by the mark."""
    norm = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(norm(truth) != "", F.coalesce(final_correct, F.lit(True)) & (norm(answer) == norm(truth))).otherwise(F.coalesce(final_correct, F.lit(False)))


def record_summary(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """(trace_id, n_annotator, n_plan, n_exec, n_annotator_tools, verified, wrong_answer) of each plan record."""
    count = lambda g: F.count_if(F.col("grp") == g)
    sizes = steps.groupBy("trace_id").agg(count("annotator").alias("n_annotator"), count("agent:plan").alias("n_plan"), count("agent:exec").alias("n_exec"))
    tools = F.size(F.filter(F.transform(F.split(F.coalesce(F.col("annotator_metadata")["Tools"], F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
    verified = is_verified(F.col("answer"), F.col("ground_truth"), F.col("final_correct"))
    own = traces.select("trace_id", tools.alias("n_annotator_tools"), verified.alias("verified"), (F.trim(F.coalesce("ground_truth", F.lit(""))) != "").alias("_has"))
    out = own.join(sizes, "trace_id", "left").fillna(0, ["n_annotator", "n_plan", "n_exec"])
    return out.select("trace_id", "n_annotator", "n_plan", "n_exec", "n_annotator_tools", "verified", (F.col("_has") & ~F.col("verified")).alias("wrong_answer"))


def is_plan_step(grp: Column, step_id: Column) -> Column:
    """Steps of the plan proper: of the agent's plan, and no survey of facts before it."""
    return (grp == "agent:plan") & ~step_id.startswith("agent:plan:facts:")


def tool_names(description: Column) -> Column:
    """Tools that a description names: known ones, words with underscores, and names that end in Tool, in that order."""
    known = F.array_compact(F.array(*[F.when(F.lower(description).contains(t), F.lit(t)) for t in KNOWN_TOOLS]))
    snake = F.transform(F.regexp_extract_all(description, F.lit(r"(?i)(?<![a-z0-9_])[a-z]+(?:_[a-z0-9]+)+(?![a-z0-9_])"), F.lit(0)), F.lower)
    camel = F.transform(F.regexp_extract_all(description, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+Tool(?![A-Za-z0-9_])"), F.lit(0)), lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, "Tool$", ""), "([a-z])([A-Z])", "$1_$2")))
    return F.array_distinct(F.concat(known, snake, camel))


def resolved_answer(raw: Column) -> Column:
    """The first argument of an answer given as {"args": [...]}; any other text as it stands."""
    first = F.get_json_object(raw, "$.args[0]")
    return F.coalesce(F.when(raw.rlike(r"^\s*\{"), first), raw)


def truncated_words(text: Column, most: int) -> Column:
    """The first words of a text, and a mark where some were left out."""
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) <= most, text).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("...")))


def domain_of(question: Column) -> Column:
    """The domain whose words occur most often, the first named on ties; general without any."""
    counts = {d: F.regexp_count(F.coalesce(question, F.lit("")), F.lit(p)) for d, p in DOMAINS.items()}
    top = F.greatest(*counts.values())
    return F.coalesce(*[F.when((c == top) & (c > 0), d) for d, c in counts.items()], F.lit("general"))


def compare_plans(auto: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Generated against gold plans by item: steps and critical steps of both, and whether counts and structure agree. Both: key, criticality."""
    side = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}_steps"), F.count_if(F.col("criticality") == "critical").alias(f"{p}_critical"), F.count_if(F.col("criticality") == "supporting").alias(f"{p}_supporting"))
    both = side(auto, "auto").join(side(gold, "gold"), key)
    same = lambda c: F.col(f"auto_{c}") == F.col(f"gold_{c}")
    return both.select(
        key, "auto_steps", "gold_steps", "auto_critical", "gold_critical", same("steps").alias("step_count_match"), (same("critical") & same("supporting")).alias("criticality_structure_match"), same("critical").alias("verdict_structure_match")
    )


def check_generated(steps: DataFrame, key: str) -> DataFrame:
    """(key, n_steps, problem): the first rule that a generated plan breaks, null if none. steps: key, idx, description, criticality.

    In order: number of steps, consecutive numbers from 1, length of descriptions, known criticality,
    at least one critical step. Counters of one aggregate decide, so no plan is gathered in a task.
    """
    idx = F.col("idx")
    c = steps.groupBy(key).agg(
        F.count("*").alias("n"), F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.countDistinct(idx).alias("d"), F.count_if(F.length(F.coalesce("description", F.lit(""))) < SHORTEST).alias("short"),
        F.count_if(~F.coalesce(F.col("criticality").isin("critical", "supporting"), F.lit(False))).alias("odd"), F.count_if(F.col("criticality") == "critical").alias("critical"),
    )
    problem = (
        F.when(~F.col("n").between(*PLAN_STEPS), "step_count").when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")) | F.col("lo").isNull(), "index")
        .when(F.col("short") > 0, "description").when(F.col("odd") > 0, "criticality").when(F.col("critical") == 0, "no_critical")
    )
    return c.select(key, F.col("n").alias("n_steps"), problem.alias("problem"))


def check_calibration(entries: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """(key, problem): the first rule that a calibration reply breaks, null if none. entries: key, idx, criticality, reason; plans: key, n_steps."""
    c = entries.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("idx").isNull()).alias("bare"), F.count_if(~F.coalesce(F.col("criticality").isin("critical", "supporting"), F.lit(False))).alias("odd"),
        F.count_if(F.coalesce("reason", F.lit("")) == "").alias("mute"), F.count_if(F.col("criticality") == "critical").alias("critical"),
    )
    n = F.coalesce("n", F.lit(0))
    problem = F.when(n != F.col("n_steps"), "length").when(F.col("bare") > 0, "index").when(F.col("odd") > 0, "criticality").when(F.col("mute") > 0, "reason").when(F.col("critical") == 0, "no_critical")
    return plans.join(c, key, "left").select(key, problem.alias("problem"))


def rewrite_criticality(steps: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """steps with the criticality of their entry by (key, idx), and whether it changed: demoted, promoted or null. Steps without an entry stay."""
    new = entries.groupBy(key, "idx").agg(F.max("criticality").alias("_new"))
    joined = steps.join(new, [key, "idx"], "left").withColumn("_new", F.coalesce("_new", "criticality"))
    change = F.when(F.col("criticality") == F.col("_new"), F.lit(None)).when(F.col("_new") == "supporting", "demoted").otherwise("promoted")
    return joined.withColumn("change", change).withColumn("criticality", F.col("_new")).drop("_new")


def calibration_stats(rewritten: DataFrame, key: str) -> DataFrame:
    """One row: items, items changed, steps demoted and promoted."""
    per = rewritten.groupBy(key).agg(F.count("change").alias("n"), F.count_if(F.col("change") == "demoted").alias("d"), F.count_if(F.col("change") == "promoted").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("n") > 0).alias("items_changed"), zero(F.sum("d")).alias("demoted"), zero(F.sum("p")).alias("promoted"))


def generation_stats(plans: DataFrame) -> DataFrame:
    """One row over generated plans (n_steps, n_critical, ms, domain): means of all, and the number of domains."""
    return plans.agg(F.count("*").alias("plans"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("n_steps", "n_critical", "ms")], F.countDistinct("domain").alias("domains"))


def repository_of(url: Column) -> Column:
    """owner/name of a hosted repository's address; null for anything else."""
    return F.nullif(F.regexp_extract(url, r"github\.com[/:]([^/\s]+/[^/\s#?]+?)(?:\.git)?(?:[/#?].*)?$", 1), F.lit(""))


def base_url(url: Column) -> Column:
    """An address without blanks around it and slashes at its end."""
    return F.regexp_replace(F.trim(url), "/+$", "")


#: Kinds of steps; any other is a reason. The answer of a trace that gives none.
KINDS, NO_ANSWER = ("observe", "search", "browse", "read", "reason", "calculate", "answer"), "Unable to determine a final answer."


def coerced_trace(steps: Column, answer: Column) -> tuple[Column, Column]:
    """(steps, answer) of a generated trace in good order; steps: index, kind, tool, summary, evidence.

    Steps without a summary go; kinds are known ones, tools not blank, evidence without blanks. Steps
    are sorted by their index (else their place), those of equal index by place, and numbered anew; a
    step that gives the answer is added where the last is none.
    """
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    real = F.filter(F.coalesce(steps, F.array()), lambda s: s.isNotNull() & F.coalesce(trim(s["summary"]) != "", F.lit(False)))
    kind = lambda s: F.coalesce(F.when(F.lower(trim(s["kind"])).isin(*KINDS), F.lower(trim(s["kind"]))), F.lit("reason"))
    placed = F.transform(real, lambda s, i: F.struct(
        F.coalesce(s["index"], i + 1).alias("at"), i.alias("place"), kind(s).alias("kind"), F.nullif(trim(s["tool"]), F.lit("")).alias("tool"), trim(s["summary"]).alias("summary"), F.filter(s["evidence"], lambda e: trim(e) != "").alias("evidence"),
    ))
    row = lambda i, k, t, s, e: F.struct(i.cast("int").alias("index"), k.alias("kind"), t.alias("tool"), s.alias("summary"), e.alias("evidence"))
    ordered = F.transform(F.array_sort(placed), lambda s, i: row(i + 1, s["kind"], s["tool"], s["summary"], s["evidence"]))
    final = F.coalesce(F.nullif(trim(answer), F.lit("")), F.lit(NO_ANSWER))
    closing = row(F.size(ordered) + 1, F.lit("answer"), F.lit(None).cast("string"), F.concat(F.lit("Submitted the final answer: "), final), F.lit(None).cast("array<string>"))
    done = F.coalesce(F.try_element_at(ordered, F.lit(-1))["kind"] == "answer", F.lit(False))
    return F.when(done, ordered).otherwise(F.concat(ordered, F.array(closing))), final


def evidence_source(step_type: Column) -> Column:
    """Where a step's evidence is looked for: in the answer for those that compare with it, else in the trace."""
    return F.when(F.coalesce(step_type == "answer_consistency", F.lit(False)), "answer").otherwise("trace")


#: How a prompt that asks for a plan is known.
PLAN_PROMPT = "step-by-step high-level plan"


def text_attribute(attributes: Column, key: str) -> Column:
    """A text attribute of a span given as JSON; null if it is absent or no text."""
    value = F.get_json_object(attributes, f"$['{key}']")
    return F.when(F.regexp_count(attributes, F.lit(r'"' + key.replace(".", r"\.") + r'"\s*:\s*"')) > 0, value)


def plan_spans(calls: DataFrame, marker: str = PLAN_PROMPT) -> DataFrame:
    """(trace_id, span_id, selection) of the model call that made each trace's plan. calls: trace_id, span_id, pos, prompt.

    The first call whose prompt holds the marker, else the last call. One aggregate.
    """
    asked = F.coalesce(F.col("prompt").contains(marker), F.lit(False))
    picked = calls.groupBy("trace_id").agg(F.min(F.when(asked, F.struct("pos", "span_id"))).alias("a"), F.max(F.struct("pos", "span_id")).alias("z"))
    return picked.select("trace_id", F.coalesce("a.span_id", "z.span_id").alias("span_id"), F.when(F.col("a").isNotNull(), "prompt_match").otherwise("last_llm_call").alias("selection"))


def pair_problem(primary: Column, secondary: Column, generator: Column) -> Column:
    """Why two judges may not work together on a generator's output: families of models given as columns; null if they may. A null generator is unknown."""
    return F.when(primary == secondary, "judges_share_family").when((primary == generator) & (secondary == generator), "both_share_generator").when(primary == generator, "primary_shares_generator").when(secondary == generator, "secondary_shares_generator")


#: Names of artifact files by kind, plain or dated.
ARTIFACTS = {
    "trace": r"traces\.jsonl$|traces(?:-[A-Za-z0-9._]+)?-\d{4}-\d{2}-\d{2}\.jsonl$",
    "gold": r"gold\.json$|gold(?:-[A-Za-z0-9._]+)?-\d{4}-\d{2}-\d{2}\.json$",
    "source_claim": r"source-claim\.json$|source-claim(?:-[A-Za-z0-9._]+)?-\d{4}-\d{2}-\d{2}\.json$",
}


def artifact(paths: Column, kind: str) -> Column:
    """The first path of a list that names an artifact of a kind; null if none does."""
    return F.get(F.filter(paths, lambda p: p.rlike(ARTIFACTS[kind])), F.lit(0))


def boundary_breaks(files: DataFrame, rules: list[tuple[str, list[str], list[str], str]]) -> DataFrame:
    """(file, message) for each rule that a file breaks. rules: (pattern of the path, patterns that its text holds, patterns that it lacks, message).

    The rules are a stated list; each file is tried in its own row.
    """
    def broken(path: str, held: list[str], lacked: list[str]) -> Column:
        ok = F.col("file").rlike(path)
        for p in held:
            ok = ok & F.col("text").rlike(p)
        for p in lacked:
            ok = ok & ~F.col("text").rlike(p)
        return ok

    return files.select("file", F.explode(F.array_compact(F.array(*[F.when(broken(p, h, k), F.lit(m)) for p, h, k, m in rules]))).alias("message"))


def acronym_asked(question: Column) -> Column:
    """The acronym that a question asks the meaning of; null if it asks for none."""
    return F.upper(F.nullif(F.regexp_extract(question, r"(?i)what does\s+([A-Z][A-Z0-9-]{1,15})\s+stand for", 1), F.lit("")))


def acronym_expansion(text: Column, acronym: Column) -> Column:
    """The words in front of an acronym in brackets, with it; null if the text has none. Acronyms hold letters, digits and hyphens only, so that they are patterns of themselves."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9-]+(?: [A-Z][A-Za-z0-9-]+){1,8}) \(([A-Za-z0-9-]+)\)"), F.lit(0))
    first = F.get(F.filter(found, lambda x: x.endswith(F.concat(F.lit("("), acronym, F.lit(")")))), F.lit(0))
    words = F.left(first, F.length(first) - F.length(acronym) - 3)
    bare = F.trim(F.regexp_replace(F.when(F.lower(words).startswith(F.concat(F.lower(acronym), F.lit(" "))), F.substr(words, F.length(acronym) + 2)).otherwise(words), r"(?i)^(?:Official|The)\s+", ""))
    return F.when(bare != "", F.concat(bare, F.lit(" ("), acronym, F.lit(")")))


def document_digest(files: DataFrame, most: int = 10, chars: int = 3_000, total: int = 8_000) -> DataFrame:
    """One row: the first files of a folder by name, each cut, under headers, the whole cut again: a bounded context, by design."""
    first = files.orderBy("file").limit(most).select("file", F.concat(F.lit("### "), "file", F.lit("\n"), F.left("text", F.lit(chars))).alias("part"))
    return first.agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "part"))), lambda x: x["part"]), "\n\n"), F.lit(total)).alias("digest"), F.count("*").alias("n_files"))


def where_equal(rows: DataFrame, **values: object) -> DataFrame:
    """Rows that equal the given values; a value of None asks for nothing. The filters reach the scan."""
    for name, value in values.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows
