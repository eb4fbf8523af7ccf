"""Problems 1, 5, 6, 7, 8, 9, 10: brute force, held-out accuracy and the cases every operator must bear."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("evigrid.llm")

from evigrid.llm import canonical as C, consensus, duplicates, leaks, mixture, pairs, plans, spam, truncation  # noqa: E402
from evigrid.llm.automaton import Automaton, words, words_at  # noqa: E402
from evigrid.session import table  # noqa: E402

# --- 1: formatting ---------------------------------------------------------------------------------

SAME = [
    ("Is it 2,754 or\n 18.4?", "is it 2754 OR 18.4"), ("Can the “X” prove it?", "**can the x prove it**"), ("Ｃｌａｉm a​b", "claim ab"), ("year‐end", "Year-end"), ("Straße", "STRASSE"),
    ("Claim: a b; Unit: c; Period: 19", "PERIOD=19 | CLAIM=A B | UNIT=c"), ("Claim: a b; Asked by: q; Period: 19", "\nClaim: \n a \n b Asked by: q Period: 19"),
]
OTHER = [("was 18.4", "was 184"), ("was -8 now", "was 8 now"), ("Claim: a; Period: 19", "Claim: 19; Period: a"), ("in 1956", "in 1966"), (".5 of x", "5 of x")]


def key(text):
    content, fields = C.canonical(text)
    return fields or content


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_content(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_content(a, b):
    assert key(a) != key(b)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_canonical_is_stable(text):
    content, _ = C.canonical(text)
    if content:
        assert C.canonical(content.upper() if content.upper().casefold() == content else content)[0] is not None
    assert C.canonical("  " + text + " ​")[0] == content


def test_copies_and_counts(spark):
    rows = [("b2", "Claim: a; Unit: c", "x"), ("b1", "UNIT=C | CLAIM=A", "x"), ("b1", "UNIT=C | CLAIM=A", "x"), ("b3", "claim: a; unit: c!", None), ("b4", "other", ""), ("b5", "??", ""), ("b6", "!!", ""), ("b7", None, ""), (None, "other", ""), ("b8", "x" * 200_000, ""), ("b9", "X" * 200_000, "")]
    df = spark.createDataFrame(rows, "id string, question string, text string")
    assert {tuple(r) for r in duplicates.copies(df, "id", "question").collect()} == {("b1", "b2"), ("b1", "b3"), ("b8", "b9")}
    counts = {r.first_id: r.n_ids for r in duplicates.collapsed(df, "id", "question").collect()}
    assert counts == {"b1": 3, "b4": 1, "b8": 2}
    assert duplicates.copies(df.limit(0), "id", "question").count() == 0


# --- 5: truncation ------------------------------------------------------------------------------------

ENDS = {
    "The quote is exact except for a missing comma.": "finished", "The reviewer wants to see the row of the cata": "open", "He said it was done (see catalogue)": "open",
    "It was done in the end. (see catalogue)": "finished",
    '"On page ten the archive was sold."': "finished", "Most of the boxes were mo...": "marked", "The plan names steps. [truncated]": "marked", "Status: ok": "label",
    "248 wool bales (1910)": "label", "https://a.example/b/c": "label",
    "Ledger, table 10": "label", "65.1": "label", "The score is weak and it is 0.": "open", "Before [...] the audit was done.": "finished", "the idle t�": "marked",
}


def test_endings(spark):
    df = spark.createDataFrame([(k,) for k in ENDS], "t string")
    got = {r.t: r.e for r in df.select("t", truncation.ending(df.t).alias("e")).collect()}
    assert got == ENDS


def test_limits_are_found_and_lengths_fitted():
    import pandas as pd

    rng = np.random.default_rng(1)
    lengths = np.exp(rng.normal(5, 0.6, 5000)).astype(int) + 1
    cut = lengths > 200
    done = collections.Counter(lengths[~cut].tolist())
    mu, sd = truncation.fit_lengths(np.array([*done, 200.0]), np.array([*done.values(), 0.0]), np.array([0.0] * len(done) + [float(cut.sum())]))
    assert abs(mu - 5) < 0.05 and abs(sd - 0.6) < 0.05
    hist = pd.DataFrame([(n, "finished", -1, c) for n, c in done.items()] + [(200, "open", -1, int(cut.sum()))], columns=["length", "ending", "longer", "n"])
    found = truncation.fit_source(hist)
    assert set(found[found.at_limit].length) == {200} and found[found.at_limit].p_limit.iloc[0] > 0.95
    assert (found[found.ending == "open"].p_cut > 0.99).all() and (found[found.ending == "finished"].p_cut < 0.1).all()


def test_lengths_decide_where_endings_do_not(spark):
    """Values without grammar at the limit of their source are cut, elsewhere they are labels; without the length model none is."""
    rng = random.Random(3)
    whole = [("The gate was opened in the " + "very " * rng.randrange(1, 30) + "cold morning.") for _ in range(400)]
    opened = [("The gate was opened in the " + "very " * 40)[:119] + "v" for _ in range(60)]
    bare = [("Ledger Tilo Rosa Vene " * 9)[:120] for _ in range(3)]
    labels = [f"Ledger {i}" for i in range(40)] + ["Ledger Tilo Rosa Vene " * 3 + "Moor"]
    rows = [("t", str(i), 1, 1, "s", x, None) for i, x in enumerate([*whole, *opened, *bare, *labels])]
    df = spark.createDataFrame(rows, "tab string, record_id string, step_pos int, item_pos int, source string, text string, reported int")
    cut = lambda **k: {int(r.record_id) for r in truncation.grade(df, **k).where("is_cut").collect()}
    assert cut() == set(range(400, 463))
    assert cut(use_lengths=False) == set(range(400, 460))


def test_grade_edge_cases(spark):
    shape = "tab string, record_id string, step_pos int, item_pos int, source string, text string"
    rows = [("t", "1", 1, 1, None, "The box was moved to the"), ("t", "1", 1, 1, None, "The box was moved to the"), ("t", "2", 1, 1, "s", None), ("t", "3", 1, 1, "s", "  "), ("t", "4", 1, 1, "s", "The long text was here. " * 20_000), ("t", "5", 1, 1, "s", "Result: 4")]
    got = {r.record_id: r.is_cut for r in truncation.grade(spark.createDataFrame(rows, shape)).collect()}
    assert got == {"1": True, "4": False, "5": False}
    assert truncation.grade(spark.createDataFrame([], shape)).count() == 0


# --- 6: pairs -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    rows = plans.p6_pairs(spark, "/root/testdata/sf0.01")
    return pairs.train(pairs.training_sample(rows, 900))


def test_held_out_defects(spark, model):
    """Defects made from pairs that the fit has not seen."""
    rows = [(r.question, r.answer) for r in plans.p6_pairs(spark, "/root/testdata/sf0.001").collect() if r.question and r.answer and pairs.defect_of(model, r.question, r.answer)[0] is None]
    made = pairs.make_defects(rows, np.random.default_rng(99))
    hits = collections.defaultdict(list)
    for q, a, d in made:
        found = set(pairs.defects_of(model, [q], [a])[0][0])
        for k in d or [None]:
            if k != "swapped":
                hits[k].append(k in found if k else not found & set(pairs.FORM))
    for d, oks in hits.items():
        assert np.mean(oks) > 0.9, (d, np.mean(oks))
    both = [set(pairs.defects_of(model, [q], [a])[0][0]) >= d for q, a, d in made if len(d) == 2]
    assert np.mean(both) > 0.8


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("How many boxes were in the hall?", None, "empty"), ("How many boxes were in the hall?", "[no content]", "empty"), (None, "", "empty"),
        ("How many boxes were in the hall?", "You asked: HOW MANY boxes were in the hall", "copy"), ("How many boxes were in the hall?", "31 boxes", None), ("How many boxes were in the hall?", "0",
        None),
        ("How many boxes were in the hall of the museum?", "I'm sorry, but I can't help with that request.", "refusal"),
        ("How many boxes were in the hall of the museum?", "I'm sorry for the earlier confusion, here is the corrected reading. The hall of the museum held 31 boxes in the spring of 1920.", None),
        ("How many boxes were in the hall of the museum?", "Die Kisten in der Halle wurden nur einmal im Jahr gezählt. Niemand konnte sagen, wer den Bericht unterschrieben hat.", "language"),
        ("How many boxes were in the hall of the museum?", "The hall of the museum held 31 boxes in the spring of 1920, and the keeper counted them before the audi", "truncated"),
    ],
)
def test_single_pairs(model, question, answer, defect):
    assert pairs.defect_of(model, question, answer)[0] == defect


def test_classify_edge_cases(spark, model):
    shape = "tab string, record_id string, pos int, question string, answer string, defect string"
    rows = [("t", "1", 0, None, None, "x"), ("t", "1", 0, None, None, "x"), ("t", "2", 0, "q?", "The sound of it is fine. " * 20_000, None), (None, None, None, "q", "", None)]
    got = {tuple(r[:4]) for r in pairs.classify(spark.createDataFrame(rows, shape), model).collect() if r.defect}
    assert got == {(None, None, None, "empty"), ("t", "1", 0, "empty")}
    assert pairs.classify(spark.createDataFrame([], shape), model).count() == 0
    assert pairs.defect_of(pairs.train([]), "q", "a")[0] is None


def test_late_refusals_and_calibration(spark, model):
    """A refusal behind a long preamble is one, and probabilities are near the shares they state."""
    late = pairs.PREAMBLES[0].format(q="How many boxes were in the hall?") + "I must decline to answer."
    assert pairs.defect_of(model, "How many boxes were in the hall?", late)[0] == "refusal"
    rows = [(r.question, r.answer) for r in plans.p6_pairs(spark, "/root/testdata/sf0.001").collect() if r.question and r.answer]
    made = pairs.make_defects(rows, np.random.default_rng(5))
    p = model.probabilities(pairs.features([q for q, _, _ in made], [a for _, a, _ in made]))
    for j, d in enumerate(pairs.FORM):
        y = np.array([d in x for _, _, x in made])
        assert abs(p[:, j].mean() - y.mean()) < 0.05


@pytest.mark.parametrize(("gap", "hits", "rest"), [(6, 40, 1000), (8, 200, 1000), (8, 200, 3000), (10, 400, 1000), (10, 400, 3000)])
def test_calibration_of_scores_that_part_well(gap, hits, rest):
    """Whole Newton steps overshoot on these scores: the defect then went to no pair, to few or to every one."""
    score = np.concatenate([np.linspace(-gap - 8, -gap + 2, rest), np.linspace(gap - 2, gap + 6, hits)])
    y = np.repeat([0.0, 1.0], [rest, hits])
    a, b = pairs._calibrate(score, y)
    assert ((a * score + b >= 0) == (y > 0)).all()


@pytest.mark.parametrize(("refusal", "copies"), [("Als Sprachmodell darf ich dazu keine Auskunft geben.", 8), ("Zu diesem Thema sage ich grundsätzlich nichts.", 6)])
def test_refusals_in_the_sample_are_not_learned_as_sound(spark, refusal, copies):
    sample = pairs.training_sample(plans.p6_pairs(spark, "/root/testdata/sf0.01"), 900)
    fitted = pairs.train([*((q, refusal) for q, _ in sample[:copies]), *sample])
    assert pairs.defect_of(fitted, "How many boxes were in the hall?", refusal)[0] == "refusal"


# --- 7: consensus --------------------------------------------------------------------------------------


def test_consensus_recovers_truth(spark):
    rng = random.Random(5)
    share = {f"m{i}": q for i, q in enumerate([0.9, 0.85, 0.8, 0.6, 0.5, 0.35])}
    truth = {f"b{i}": rng.choice(consensus.VERDICTS) for i in range(600)}
    rows = []
    for b, t in truth.items():
        for m, q in share.items():
            if rng.random() < 0.7:
                v = t if rng.random() < q else ("ALLOW" if m == "m4" else rng.choice(consensus.VERDICTS))
                rows.append((b, m, v))
    votes = spark.createDataFrame(rows, "item string, annotator string, label string")
    rel = {r.annotator: r.reliability for r in consensus.reliabilities(votes).collect()}
    for m in share:
        own = np.mean([v == truth[b] for b, a, v in rows if a == m])
        assert abs(rel[m] - own) < 0.08, (m, own, rel[m])
    got = consensus.consensus(votes, consensus.reliabilities(votes), minimum=3).collect()
    by_vote = collections.defaultdict(collections.Counter)
    for b, _, v in rows:
        by_vote[b][v] += 1
    right, plain = np.mean([r.verdict == truth[r["item"]] for r in got]), np.mean([by_vote[r["item"]].most_common(1)[0][0] == truth[r["item"]] for r in got])
    assert right > 0.9 and right >= plain


def test_last_votes_and_empty(spark):
    shape = "id long, block_id string, model string, verdict string, recorded_at long, item string"
    rows = [(1, "b", "m", "ALLOW", 5, ""), (2, "b", "m", " hold\n", 9, ""), (2, "b", "m", " hold\n", 9, ""), (3, "b", "n", "ALLOW", 1, ""), (4, "b", "n", "n/a", 2, ""), (5, None, "m", "ALLOW", 1, ""), (6, "b", None, "ALLOW", 1, ""), (7, "c", "m", None, 1, ""), (8, "c", "n", "Block ", None, "")]
    df = spark.createDataFrame(rows, shape)
    votes = consensus.last_votes(df, "block_id", "model", "verdict", "recorded_at")
    assert {tuple(r) for r in votes.collect()} == {("b", "m", "HOLD"), ("c", "n", "BLOCK")}
    out = consensus.consensus(votes, consensus.reliabilities(votes))
    assert {(r["item"], r.verdict) for r in out.collect()} == {("b", "HOLD"), ("c", "BLOCK")}
    none = votes.limit(0)
    assert consensus.consensus(none, consensus.reliabilities(none)).count() == 0


# --- 8: leaks --------------------------------------------------------------------------------------------


def test_automaton_against_brute_force():
    rng = random.Random(2)
    lists = [(i, [rng.choice("abc") for _ in range(12)]) for i in range(6)]
    auto = Automaton(lists, 3)
    stream = [rng.choice("abcd") for _ in range(400)]
    subs = {tuple(ws[i:j]) for _, ws in lists for i in range(12) for j in range(i + 1, 13)}
    got = {end: n for end, n, _ in auto.matches(stream)}
    longest = []
    for end in range(len(stream)):
        n = 0
        while n <= end and tuple(stream[end - n : end + 1]) in subs:
            n += 1
        longest.append(n)
    assert got == {e: n for e, n in enumerate(longest) if n >= 3}
    for end, n, top in auto.matches(stream):
        lo, hi = auto.bounds[top]
        places = [(k, at) for k, ws in lists for at in range(2, 12) if ws[at - 2 : at + 1] == stream[end - 2 : end + 1]]
        assert sorted(zip(auto.keys[lo:hi].tolist(), auto.ats[lo:hi].tolist())) == places


def test_many_items_that_share_stock_phrases():
    """20 000 items that all open and close alike, in bounded time; the one that leaks is found, with errors in it."""
    import time

    rng = random.Random(9)
    name = lambda: "".join(rng.choices("bdfgklmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdfgklmnprst", k=2) + rng.choices("aeiou", k=2))
    items = [(i, ["consider", "the", "following", "case", "with", "care", *[name() for _ in range(16)], "answer", "with", "a", "single", "number", "and", "nothing", "else"]) for i in range(20_000)]
    leaked = items[777][1]
    text = " ".join(["consider the following case with care it says and we did", *leaked[2:12], "new", *leaked[13:24], "else it ends . answer with a single number and nothing else"])
    blocks = [leaks.Block(items[at : at + 5_000], 15, 7) for at in range(0, len(items), 5_000)]
    began = time.time()
    assert {s[0] for b in blocks for s in b.spans(text)} == {777}
    assert time.time() - began < 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=15, max_size=24), st.data())
def test_filter_before_the_alignment_loses_nothing(target, data):
    """Against the alignment of the item with the whole text, for texts made by random edits."""
    ws = list(target)
    for _ in range(data.draw(st.integers(0, 5))):
        at = data.draw(st.integers(0, len(ws) - 1))
        ws[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.sampled_from("abxyz"), max_size=1))
        if not ws:
            break
    text = ["q"] * data.draw(st.integers(0, 3)) + ws + ["z"] * data.draw(st.integers(0, 3))
    whole = bool(leaks.passages(target, text, 15, 7))
    assert bool(leaks.Block([(1, target)], 15, 7).spans(" ".join(text))) == whole


QUESTION = "Suppose 185 seed trays reach Sisoleda together with 163 stamp albums, and after Tuesday nobody except Gogumopi may touch the 3 spare barges, though a wager costs Hojapaju another 14 seed trays."


@pytest.mark.parametrize(
    ("text", "leaks_"),
    [
        (QUESTION, True), (QUESTION.upper().replace(",", ""), True),
        ("He wrote: suppose 185 **seed** trays reach <b>Siso-\nleda</b> together with\n> 163 stamp albums, and after Tuesday nobody except", True),
        ("Suppose 185 seed trays reach Sisoleda together also with 163 stamp and after Tuesday nobody except anyone may touch the 3 spare", True),
        ("and after Tuesday nobody except Gogumopi may touch the 3 spare barges. That is all.", False), ("", False), ("word " * 50_000, False),
    ],
)
def test_leaks(spark, text, leaks_):
    docs = spark.createDataFrame([(1, text, "q"), (1, text, "q"), (2, None, "q")], "doc_id long, text string, question string")
    items = spark.createDataFrame([(7, QUESTION), (8, None), (9, "too short")], "id int, question string")
    got = {tuple(r) for r in leaks.leaks(leaks.leak_spans(docs, items)).collect()}
    assert got == ({(1, 7)} if leaks_ else set())
    assert words(text) == [w for w, _, _ in words_at(text)]


def test_leak_within_a_worse_alignment_and_among_repeats(spark):
    item = [f"w{i}" for i in range(47)]
    run_on = item[:15] + [x for k in range(15, 47, 4) for x in ["new", *item[k : k + 4]]]
    stuffed = [x for k in range(300) for x in [*item[20:24], "x", "y"]]
    three = item[:3] + ["a"] + item[4:7] + ["b"] + item[8:11] + ["c"] + item[12:15]
    rows = [(1, " ".join(run_on)), (2, " ".join([*stuffed[:1200], *item[5:25], *stuffed[:600]])), (3, " ".join(stuffed)), (4, " ".join(three)), (5, " ".join(item[:14]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "id int, question string")
    assert {r.doc_id for r in leaks.leaks(leaks.leak_spans(docs, items)).collect()} == {1, 2, 4}


def test_leak_behind_many_entities_and_inline_tags(spark):
    text = "&quot;so&nbsp;it&#39;s foo<b>bar</b>&quot; " * 60 + QUESTION
    assert words(text) == [w for w, _, _ in words_at(text)]
    assert all(text[a:b] for _, a, b in words_at(text)) and [text[a:b] for w, a, b in words_at(text) if w == "sisoleda"] == ["Sisoleda"]
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, QUESTION)], "id int, question string")
    (got,) = leaks.leak_spans(docs, items).collect()
    assert text[got.start : got.end] == QUESTION.rstrip(".")


def test_leak_blocks_and_cleaning(spark):
    docs = spark.createDataFrame([(1, "Before it. " + QUESTION + " After it all went on as before, and so on, and so on. " * 9), (2, QUESTION), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, QUESTION), (8, QUESTION)], "id int, question string")
    one, many = leaks.leak_spans(docs, items), leaks.leak_spans(docs, items, block_words=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 4
    cleaned = {r.doc_id: r for r in leaks.without_leaks(docs, one).collect()}
    assert "Sisoleda" not in cleaned[1].text and cleaned[1].text.startswith("Before it. ") and "After it" in cleaned[1].text
    assert cleaned[2].dropped and cleaned[2].text is None and cleaned[3].text == "clean"
    assert leaks.leak_spans(docs, items.limit(0)).count() == 0 and leaks.leak_spans(docs.limit(0), items).count() == 0


# --- 9: mixtures ------------------------------------------------------------------------------------------


def test_allot_gives_shortages_to_siblings_first():
    sizes = [(("d", "en", "a"), 10, 0.25, 1), (("d", "en", "b"), 1000, 0.25, 1), (("d", "de", "c"), 1000, 0.5, 1)]
    got = mixture.budgets(sizes, 200)
    assert got == {("d", "en", "a"): 10, ("d", "en", "b"): 90, ("d", "de", "c"): 100}
    sizes[1] = (("d", "en", "b"), 20, 0.25, 1)
    got = mixture.budgets(sizes, 200)
    assert got == {("d", "en", "a"): 10, ("d", "en", "b"): 20, ("d", "de", "c"): 170}
    assert sum(mixture.budgets(sizes, 1e9).values()) == 1030
    assert sum(mixture.budgets(sizes).values()) == pytest.approx(40)


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, s, rng.choice(["en", "EN", "de", None]), rng.randrange(20, 200), "x") for i, s in enumerate(["a"] * 3000 + ["b"] * 600 + ["c"] * 60 + ["z"] * 5)] + [(1, "a", "en", 50, "x"), (None, "a", "en", 5, "x"), (9999, "b", "en", 0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_tokens long, target_share string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    for total in (None, 100_000, 10_000_000):
        uses, shares = mixture.mix(df, targets, total)
        u, s = uses.collect(), {r.source: r for r in shares.collect()}
        assert all(r.uses <= {"a": 1, "b": 3, "c": 4}[r.source] for r in u) and len({(r.source, r.doc_id) for r in u}) == len(u)
        assert sum(r.n_tokens * r.uses for r in u if r.source == "b") == s["b"].tokens
        if total is None:
            assert all(abs(s[x].actual_share - t) < 0.02 for x, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
        if total == 100_000:
            assert abs(sum(x.tokens for x in s.values()) - total) < 1500
    again = {tuple(r) for r in mixture.mix(df.orderBy("n_tokens"), targets, 100_000)[0].collect()}
    assert again == {tuple(r) for r in mixture.mix(df, targets, 100_000)[0].collect()}
    uses, shares = mixture.mix(df.limit(0), targets)
    assert uses.count() == 0 and {r.actual_share for r in shares.collect()} == {0.0}


@pytest.mark.parametrize("query", ["p9_shares", "p9_whole_corpus_shares"])
def test_share_errors(spark, query):
    """Over the corpus itself: targets are met to a document, or fall short only where a source's repeats are used up, and its domain fills up."""
    rows = plans.QUERIES[query](spark, "/root/testdata/sf0.1").collect()
    assert abs(sum(r.actual_share for r in rows) - 1) < 1e-9 and all(r.most_uses <= r.max_repeats for r in rows)
    if query == "p9_shares":
        assert all(abs(r.share_error) < 0.005 for r in rows), [(r.source, r.share_error) for r in rows]
        return
    short = {r.source for r in rows if r.share_error < -0.005}
    assert short and all(r.tokens == r.available_tokens * r.max_repeats for r in rows if r.source in short)
    # the records domain has room: its own sources make up for what it lacks
    by = {}
    for r in rows:
        by.setdefault(plans.DOMAINS[r.source], []).append(r)
    room = {k: any(r.tokens < r.available_tokens * r.max_repeats * 0.999 for r in rs) for k, rs in by.items()}
    for k, rs in by.items():
        if room[k]:
            assert sum(r.share_error for r in rs) > -0.005


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The quick brown fox.", 3), (2, None, 3), (3, "", 3), (4, "<|endoftext|>", 3)], "doc_id int, text string, n int")
    got = {r.doc_id: r.n_tokens for r in mixture.with_tokens(df).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] > 1


# --- 10: spam ----------------------------------------------------------------------------------------------

PAGES = {
    1: "best evidence vault, top judge panel, deal judge panel, near answer verifier, best evidence vault, judge panel, top judge panel",
    2: "\n".join(f"* https://site{i}.example/path{i}" for i in range(12)),
    3: "#quote_finder #claimscanner #verdict_tool #quotefinder #judgepanel #proofbadge",
    4: "model tester cheap source ranker source ranker step tracker deal source ranker model tester source ranker step tracker free model tester step tracker source ranker deal model tester step tracker source ranker",
    5: "The map sheets were counted once a year. Nobody could say who signed the final list of them.\n\nSources:\n- https://a.example/x",
    6: "1.0.2\n- add: quarterly logbook handling in step 9 for the idle time\n- fix: early ledger handling in step 4 for the repair cost\n- drop: final index card handling in step 2 for the peak flow",
    7: "storage volume\t612\t0.99\ncrew size\t817\t0.06\nstorage volume\t455\t0.23\nharvest weight\t224\t0.14",
    8: "Judge panel: a group of models that look at an answer.\nProof badge: a mark that stands beside an answer that was checked.",
    9: "", 10: None,
}


def test_spam_pages(spark):
    rows = [(k, t, f"h{k}.example", None, 0) for k, t in PAGES.items()] + [(11, PAGES[1], None, "https://other.example/x", 0), (1, PAGES[1], "h1.example", None, 0), (12, "word and so on. " * 30_000, None, None, 0), (None, PAGES[1], None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, site string, url string, host int")
    for limit in (64 << 20, -1):
        assert {r.doc_id for r in spam.spam_pages(spam.page_evidence(df, broadcast_bytes=limit)).collect()} == {1, 2, 3, 4, 11}
    assert spam.page_evidence(df.limit(0)).count() == 0


def test_spam_of_long_phrases_and_marked_lists(spark):
    """Pages stitched from phrases of five words and more, and lists and stuffed runs that end in marks, against template entries."""
    rng = random.Random(4)
    long = ["buy the best answer verifier for your quick audit", "cheap evidence vault with free trial for small judges", "top rated quote finder download for all model testers", "order the official proof badge online before next week", "fast claim scanner and bias meter deals near your town"]
    rows = [(i, ", ".join(rng.sample(long, 4)), f"h{i}.example", None) for i in range(8)]
    rows += [(20 + i, ", ".join(rng.sample(long, 5)) + ".", f"k{i}.example", None) for i in range(2)]
    names = ["ka", "lo", "mi", "ru", "te", "vo"]
    entry = lambda: f"- fix: final index card handling in step {rng.randrange(1, 4)} for {''.join(rng.choices(names, k=4))} crew size"
    rows += [(40 + i, "\n".join(entry() for _ in range(6)), f"e{i}.example", None) for i in range(8)]
    rows.append((60, "Get fast proof badge and plan audit proof badge today. proof badge plan audit, top plan audit proof badge, near proof badge! The best proof badge is the near proof badge of proof badge. Get near proof badge and plan audit proof badge free.", "x.example", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, site string, url string")
    assert {r.doc_id for r in spam.spam_pages(spam.page_evidence(df)).collect()} == {*range(8), 20, 21, 60}


def test_queries_run(spark, sf):
    for name in ("p1_found", "p5_found", "p5_rates", "p6_report", "p7_found", "p8_found", "p9_mix", "p9_shares", "p10_found"):
        assert plans.QUERIES[name](spark, sf).count() > 0, name
    assert plans.p5_limits(spark, "/root/testdata/sf0.01").count() > 0
    assert table(spark, sf, "documents").count() == plans.p8_clean(spark, sf).count()
