"""Broken prompt and response pairs: a multi-label linear classifier trained on made defects (problem 6)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.canonical import flat, plain

#: Labels of the classifier, in the order in which they are preferred at equal probability; a pair may have several.
DEFECTS = ("empty", "copy", "refusal", "language", "truncated", "swapped")
#: Those that concern the answer by itself or its form; swapped, an answer to another question, is reported beside them.
FORM = DEFECTS[:5]
#: Hashed n-gram dimensions, and the most pairs that the classifier is fitted on (a stated bound).
DIMENSIONS, SAMPLE = 1 << 12, 1_200

#: What stands for an answer that is not there (compared in plain form without marks).
PLACEHOLDERS = frozenset(
    ("", "na", "none", "null", "nil", "nan", "empty", "nocontent", "noanswer", "noresponse", "missing", "tbd", "todo", "placeholder", "undefined", "blank", "notavailable", "keineantwort", "leer",
    "keininhalt")
)
#: Frequent function words by language; a text's language is read from their shares.
LANGUAGES = {
    "en": "the of and to in is was were that for with which not by from has have does did how many who what why where when this these its it as at be on or an if but could would should there their than",
    "de": "der die das und zu den dem des ist war nicht mit für wie viele wer was wo wann dass von im ein eine einen einer einem auf aus nach sich wird wurde wurden sind hat haben bei über keine kein niemand nur als zum zur ob",
    "fr": "le la les des du et est que qui dans pour une un par sur avec pas ne ce cette sont été aux au selon sans plus ou mais comme il elle ses son sa leur même après où",
    "es": "el los las del y es que en para una un por con no se su sus al lo más pero como según sin entre fue han está esta este desde ya o si cuando donde muy ni",
    "it": "il lo gli della delle dei del e che di è per una un con non si sono nel nella dal dalla come più ma anche se suo sua questo questa secondo",
    "pt": "o os as dos das do da e que em para uma um por com não se seu sua ao mais mas como foi são está este esta segundo sem pelo pela",
    "nl": "de het een en van in is dat op te met voor niet aan zijn er maar om ook als bij door over uit naar dan wordt werd deze geen",
}
_LANG: dict[str, list[str]] = {}
for _name, _list in LANGUAGES.items():
    for _w in _list.split():
        _LANG.setdefault(_w, []).append(_name)

#: Usual ways to decline, from which refusals are made for training; openers and closers vary them.
REFUSALS = (
    "I'm sorry, but I can't help with that request.", "I'm sorry, but I cannot assist with that.", "I cannot comply with this request.", "I am unable to provide an answer to this question.",
    "Unfortunately I'm not able to assist with this topic.", "As a language model I do not have access to such records, so I must decline.", "As an AI model, I can't answer this.",
    "I would rather not speculate about this, and I won't give an answer.",
    "Sorry, no. I have to pass on this one.", "I must decline to answer.", "I don't feel comfortable answering that.", "I can't provide that information.",
    "It is not possible for me to answer this question.", "I refuse to answer that question.",
    "Es tut mir leid, aber dabei kann ich nicht helfen.", "Diese Frage kann ich leider nicht beantworten.", "Leider darf ich dazu keine Auskunft geben.",
    "Ich bin nicht in der Lage, diese Frage zu beantworten.", "Dazu möchte ich mich nicht äußern.", "Als Sprachmodell habe ich darauf keinen Zugriff.",
    "My guidelines do not allow me to discuss this.", "My guidelines prevent me from talking about this subject.", "This is not something that I can answer.", "Please consult a qualified expert.",
    "That is outside of what I can talk about.",
    "Je suis désolé, mais je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de vous aider.", "Lo siento, pero no puedo ayudar con esa solicitud.",
    "No puedo responder a esta pregunta.",
)
REFUSAL_FRAMES = (
    ("", ""), ("Thank you for the question. ", ""), ("", " I hope you understand."), ("", " If you have another question, feel free to ask."), ("Thanks for asking. ",
    " Maybe someone else can help you further."), ("", " Please contact the responsible office."),
    ("Danke für die Frage. ", ""), ("", " Ich bitte um Verständnis."), ("", " Bitte wende dich an die zuständige Stelle."),
)
#: Parts from which further refusals are put together, so that the classifier learns how one declines and not a list of sentences.
REFUSAL_PARTS = (
    (
        ("", "", "Sorry, ", "I'm sorry, but ", "I am sorry, but ", "Unfortunately ", "I apologize, but ", "I'm afraid "),
        ("I cannot", "I can't", "I am not able to", "I'm not able to", "I am unable to", "I'm unable to", "I won't", "I will not", "I must decline to", "I have to decline to", "I would rather not",
        "I am not allowed to", "I don't want to", "my guidelines do not allow me to", "my rules forbid me to", "my policies keep me from wanting to"),
        (" help with", " assist with", " answer", " discuss", " comment on", " respond to", " talk about", " speculate about", " take a position on", " provide information on"),
        (" this", " that", " such a", " your"),
        (" request.", " question.", " topic.", " subject.", " matter.", " claim.", " inquiry."),
        ("", "", " Perhaps someone else can help you further.", " Perhaps the responsible office can assist you further.", " Maybe a librarian can assist you with it.",
        " Please ask a qualified expert.", " Please contact the office in charge.", " Let me know if there is anything else I can do.", " I hope you understand."),
    ),
    (
        ("", "", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, aber "), ("kann ich", "darf ich", "möchte ich", "werde ich"), (" diese Frage", " dieses Anliegen", " diese Bitte",
        " dieses Thema", " diese Behauptung"), (" nicht", " leider nicht", " so nicht"),
        (" beantworten.", " kommentieren.", " bearbeiten.", " besprechen.", " beurteilen."), ("", "", " Vielleicht kann jemand anderes weiterhelfen.", " Bitte wenden Sie sich an eine Fachstelle.",
        " Vielleicht hilft das zuständige Amt weiter.", " Ich bitte um Verständnis."),
    ),
)
#: How an answer may repeat its question, in sound pairs and in mere copies.
COPY_FRAMES = ("", "", "Question: ", "You asked: ", "Q: ", "Frage: ", "The question was: ", "Du fragst: ", "Die Frage lautete: ")
#: Openings of sound answers that resemble refusals or copies.
SOUND_FRAMES = ("I'm sorry for the earlier confusion, here is the corrected reading. ", "As a language model would, the agent first guessed, then checked the page. ", "Sorry for the delay. ", "Unfortunately the first page was wrong. ", "Entschuldigung für den Fehler, hier ist die Antwort. ")

#: How refusals that come late begin.
PREAMBLES = (
    "Let me first repeat what you would like to know, so that we talk about the same thing: {q} That is a good question, and I have thought about it for quite a while before writing this. ",
    "Thank you for the detailed request and for all the context that came with it. I have read every line of it twice, and I see why it matters to you and your team. ",
    "Zuerst möchte ich die Frage wiederholen, damit wir vom Gleichen reden: {q} Das ist eine gute Frage, und ich habe eine Weile darüber nachgedacht. ",
)

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: A finished ending; an ellipsis is none.
_STOP = re.compile(r"(?:(?<!\.)\.|[!?。！？])[\"'”’»)\]*_\s]*$")
_META = re.compile(r"(?:^|[\s(\[])[^\W\d_][\w ]{1,20}:\s*(?:\S{1,80}|[\w ]{1,20})\s*$")
_CLOSED = re.compile(r"(?:```|\||https?://\S+|(?<![\w-])[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}(?:/\S{0,300})?|^\s*[-*•]\s[^.!?\n]{1,60})\s*$", re.M)
DENSE = (
    "bias", "empty", "same", "covered", "prefixed", "rest", "foreign", "foreign_head", "native", "far", "open", "open_long", "elided", "meta", "short", "log_words", "one_line", "shared",
    "shared_none", "numbers",
)
_FIRST = re.compile(r"(?<=[.!?])\s")
#: What an answer shares with its question tells swapped answers only: made foreign answers never share its figures, true ones may.
_SHARING = ("shared", "shared_none", "numbers")
_NAMES = tuple(LANGUAGES)
_ROWS = {w: np.array([(n in langs) / len(langs) for n in _NAMES]) for w, langs in _LANG.items()}
_HEAD, _ODD = 12, np.uint64(0x9E3779B97F4A7C15)


def language_shares(ws: list[str]) -> dict[str, float]:
    counts: dict[str, float] = {}
    for w in ws:
        for name in (langs := _LANG.get(w, ())):
            counts[name] = counts.get(name, 0.0) + 1 / len(langs)
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()} if total else {}


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h * np.uint64(salt) * _ODD) >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def _shares(rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Language shares per document, and whether it has any function word."""
    counts = np.stack([np.bincount(doc, rows[:, j], n) for j in range(len(_NAMES))], axis=1)
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.maximum(total, 1e-9), total[:, 0] > 0


@dataclass
class Features:
    """Pairs made ready, all of a batch at once: hashed n-grams of whole answers (document, bucket), and dense pair features."""

    doc: np.ndarray
    bucket: np.ndarray
    dense: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """Per n-gram, one over the root of how many its document has."""
        return 1 / np.sqrt(np.bincount(self.doc, minlength=len(self.dense)))[self.doc]

    def matrix(self) -> np.ndarray:
        """Documents x (DIMENSIONS + dense), for the fit on its bounded sample."""
        grams = np.zeros((len(self.dense), DIMENSIONS), np.float32)
        grams[self.doc, self.bucket] = self.scale
        return np.hstack([grams, self.dense.astype(np.float32)])


def features(questions: list[str | None], answers: list[str | None]) -> Features:
    """Nulls count as empty texts; answers are read whole.

    N-grams: words, pairs and triples of the whole answer, its first words and its last four by
    place. Dense: how much of the answer is the question again, whether it is blank, in which
    languages both are written, how it ends, and what of the question's words and figures it holds.
    """
    n = len(answers)
    asked: dict[str, tuple[str, list[str], frozenset[str], frozenset[str]]] = {}
    q_words, a_words, dense = [], [], np.zeros((n, len(DENSE)))
    for i, (question, answer) in enumerate(zip(questions, answers)):
        question, answer = question or "", answer or ""
        if question not in asked:
            q = plain(question)
            qw = _WORD.findall(q)
            asked[question] = flat(q), qw, frozenset(w for w in qw if len(w) > 3 and w not in _LANG), frozenset(w for w in qw if w.isdigit() and len(w) > 1)
        fq, qw, content, figures = asked[question]
        a = plain(answer)
        aw = _WORD.findall(a)
        held = set(aw)
        q_words.append(qw)
        a_words.append(aw)
        # the question can stand in an answer only with most of its words, and a blank answer has hardly any
        fa = flat(a) if len(aw) < 4 or not content or 2 * len(content & held) >= len(content) else None
        blank = fa is not None and (fa in PLACEHOLDERS or fa.replace("-", "").replace(".", "") == "")
        at = fa.find(fq) if fq and fa else -1
        rest = len(fa.replace(fq, "")) if at >= 0 else len(a)  # what is left when the question is taken out, however often it stands there
        same = bool(fq) and at >= 0 and rest <= max(18, 0.15 * len(fq)) and fa.endswith(fq)
        raw = answer.rstrip()
        unfinished = len(aw) >= 4 and not _STOP.search(raw)
        meta = bool(unfinished and ((m := _META.search(raw)) and _STOP.search(raw[: m.start()].rstrip()) or _CLOSED.search(raw)))
        is_open = unfinished and not meta and any(w in _LANG for w in aw)
        shared = len(content & held) / len(content) if content and len(aw) >= 8 else 0.5
        dense[i] = (
            1.0, blank, same, (len(fa) - rest) / len(fa) if at >= 0 and fa else 0.0, at == 0 and rest > 16, min(max(rest, 0), 400) / 400 if at >= 0 else 1.0, 0.0, 0.0, 0.0, 0.0,
            is_open, is_open and len(aw) >= 8, is_open and raw.endswith(("...", "…")), meta, len(aw) < 4, min(np.log1p(len(aw)), 8.0) / 4, "\n" not in raw, shared, shared == 0.0, bool(figures & held),
        )
    sizes, q_sizes = np.array([len(w) for w in a_words], np.int64), np.array([len(w) for w in q_words], np.int64)
    doc, q_doc = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), q_sizes)
    code, seen = pd.factorize(np.array([w for ws in (*a_words, *q_words) for w in ws], object))
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in seen), np.uint64, len(seen))
    none = np.zeros(len(_NAMES))
    rows = np.array([_ROWS.get(w, none) for w in seen]).reshape(-1, len(_NAMES))
    mine, theirs = code[: len(doc)], code[len(doc) :]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    (ls, any_a), (lq, any_q) = _shares(rows[mine], doc, n), _shares(rows[theirs], q_doc, n)
    early = place < _HEAD
    lh, any_h = _shares(rows[mine[early]], doc[early], n)
    own, at = lq.argmax(axis=1), np.arange(n)
    column = lambda name: DENSE.index(name)
    # how much more of the function words is of other languages than of the question's: kin languages share words, so theirs are taken together
    for name, shares, known in (("foreign", ls, any_a), ("foreign_head", lh, any_h)):
        dense[:, column(name)] = np.where(any_q & known & (sizes >= 4), 1.0 - 2.0 * shares[at, own], 0.0)
    native = ls[at, own]
    dense[:, column("native")] = np.where(any_q, native, 0.5)
    dense[:, column("far")] = any_q & any_a & (sizes >= 6) & (native <= 0.2)
    h = hashes[mine] if len(hashes) else np.zeros(0, np.uint64)
    parts = [(doc, _buckets(h, 3)), (doc[early], _buckets(h[early], 13))]
    if len(h) > 1:
        two, ok2 = (h[:-1] * _ODD) ^ h[1:], doc[:-1] == doc[1:]
        parts.append((doc[:-1][ok2], _buckets(two[ok2], 5)))
        three, ok3 = (two[:-1] * _ODD) ^ h[2:], doc[:-2] == doc[2:]
        parts.append((doc[:-2][ok3], _buckets(three[ok3], 11)))
    back = np.repeat(sizes, sizes) - place
    last = back <= 4
    parts.append((doc[last], _buckets((h[last] * _ODD) ^ back[last].astype(np.uint64), 7)))
    # each n-gram once, so that an answer that repeats itself weighs no more than one that does not
    cells = np.concatenate([d * DIMENSIONS + b for d, b in parts])
    cells = np.sort(cells.astype(np.int32) if n * DIMENSIONS < 1 << 31 else cells)
    cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
    return Features(cells // DIMENSIONS, cells % DIMENSIONS, dense)


@dataclass
class Model:
    """Weights per defect over hashed n-grams and dense features, and the calibration (slope, offset) of its scores."""

    weights: np.ndarray  # defects x (DIMENSIONS + dense)
    calibration: np.ndarray  # defects x 2

    def scores(self, f: Features) -> np.ndarray:
        """Documents x defects, uncalibrated."""
        scale = f.scale
        grams = np.stack([np.bincount(f.doc, w[f.bucket] * scale, len(f.dense)) for w in self.weights], axis=1)
        return grams + f.dense @ self.weights[:, DIMENSIONS:].T

    def probabilities(self, f: Features) -> np.ndarray:
        return _sigmoid(self.scores(f) * self.calibration[:, 0] + self.calibration[:, 1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def make_defects(pairs: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str, str, frozenset[str]]]:
    """(question, answer, defects): sound pairs, and defects made from them: truncated, copied, swapped, refused, emptied, and some at once."""
    out: list[tuple[str, str, frozenset[str]]] = []
    put = lambda q, a, *defects: out.append((q, a, frozenset(defects)))
    long = [(q, a) for q, a in pairs if len(_WORD.findall(a)) >= 12]
    speech = lambda text: max(x, key=x.get) if (x := language_shares(_WORD.findall(plain(text)))) else None
    by_lang: dict[str | None, list[tuple[str, str]]] = {}
    for q, a in long:
        by_lang.setdefault(speech(a), []).append((q, a))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def cut(text: str) -> str | None:
        short = text[: int(len(text) * rng.uniform(0.05, 0.97))].rstrip()
        return short + pick(("", "", "", "", "...", "…")) if not _STOP.search(short) and len(_WORD.findall(short)) >= 4 else None

    for i, (q, a) in enumerate(pairs):
        put(q, a)
        if i % 6 == 0:
            put(q, pick(("", " ", "-", "N/A", "null", "<empty>", "[no content]", "...", "none", '""', "​")), "empty")
        else:
            put(q, pick(("42", "Yes", "No.", "1873", "12.5", "Canal Trust", "31 barges")))
        opener, closer = pick(REFUSAL_FRAMES)
        if i % 2 == 0:
            composed = "".join(pick(part) for part in pick(REFUSAL_PARTS))
            put(q, (pick(PREAMBLES).format(q=q) if i % 10 == 0 else opener) + pick(REFUSALS) + closer, "refusal")
            put(q, composed[0].upper() + composed[1:], "refusal")
        if i % 3 == 0:
            shape = pick((str, str.lower, str.upper, str.title, lambda s: s.rstrip("?") + ".", lambda s: s.rstrip("?.") + "...", lambda s: f"“{s}”", lambda s: "  ".join(s.split())))
            put(q, pick(COPY_FRAMES) + pick((" ", "\n")).join([shape(q)] * (1 + (i % 9 == 0))), "copy")
    for i, (q, a) in enumerate(long):
        if short := cut(a):
            put(q, short, "truncated")
        if i % 3 == 0:
            put(q, pick(SOUND_FRAMES) + a)
            put(q, f"{pick(COPY_FRAMES[2:])}{q} {a}")
            put(q, a + pick((" Verdict: ALLOW", " Confidence: 0.8", " Source: vene.example/tolo", "\nSource: https://vene.example/tolo")))
        own = speech(q)
        same, other = by_lang.get(own, []), [x for k, xs in by_lang.items() if own and k not in (own, None) for x in xs]
        if i % 3 == 1 and len(same) > 1 and (swap := pick(same))[0] != q:
            put(q, swap[1], "swapped")
        if own and i % 2:  # languages that the sample lacks: their function words between made-up words
            known = LANGUAGES[pick([k for k in LANGUAGES if k != own])].split()
            made = [pick(known) if rng.random() < 0.5 else "".join(pick("bdfglmnprstvaeiou") for _ in range(int(rng.integers(4, 9)))) for _ in range(int(rng.integers(10, 40)))]
            put(q, " ".join(made).capitalize() + ".", "language")
        if other:
            foreign = pick(other)[1]
            put(q, foreign, "language")
            if i % 4 == 0 and (short := cut(foreign)):
                put(q, short, "language", "truncated")
            put(q, f"{a} {pick(('The note reads', 'The other page says', 'Das Blatt lautet'))}: {_FIRST.split(foreign)[0]}")
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, l2: float = 2e-4) -> np.ndarray:
    """Logistic regressions of all defects by full-batch Adam, both sides of each weighing alike."""
    n, k = y.shape
    weight = np.where(y > 0, 0.5 / np.maximum(1, y.sum(axis=0)), 0.5 / np.maximum(1, n - y.sum(axis=0))).astype(np.float32)
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    free = np.ones_like(w)
    free[np.ix_([DIMENSIONS + DENSE.index(c) for c in _SHARING], [j for j, d in enumerate(DEFECTS) if d != "swapped"])] = 0
    for t in range(1, rounds + 1):
        grad = x.T @ (weight * (_sigmoid(x @ w) - y)) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= free * 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.T.astype(float)


def _calibrate(score: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a sigmoid from held-out scores to probabilities, by Newton's method on smoothed targets.

    A step is halved until it lowers the loss: where the scores part well the curve is nearly flat,
    and whole steps fling the offset so far that a defect is given to no pair or to every one.
    """
    hits = y.sum()
    target = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))

    def loss(at: np.ndarray) -> float:
        z = at[0] * score + at[1]
        return float((np.logaddexp(0.0, z) - target * z).sum() + 5e-4 * (at[0] - 1) ** 2)

    at = np.array([1.0, 0.0])
    now = loss(at)
    for _ in range(rounds):
        p = _sigmoid(at[0] * score + at[1])
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * score).sum() + 1e-3 * (at[0] - 1), d.sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        while (lower := loss(at - step)) >= now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if lower >= now:
            break
        at, now = at - step, lower
    a, b = float(at[0]), float(at[1])
    return (a, b) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def train(pairs: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fits on made defects; the sound side is real pairs, so those the first fit does not clear are dropped before the second.

    Scores are calibrated on a held-out fifth, so that a defect is proposed from a probability of one half.
    """
    rng = np.random.default_rng(seed)
    pairs = [(q, a) for q, a in pairs if q and a and a.strip()]
    model = Model(np.zeros((len(DEFECTS), DIMENSIONS + len(DENSE))), np.tile([1.0, -1.0], (len(DEFECTS), 1)))
    for last in (False, True):
        made = make_defects(pairs, rng)
        if len(made) < 20:
            return model
        made = [made[i] for i in rng.permutation(len(made))]
        held, fold = made[: len(made) // 5], made[len(made) // 5 :]
        ready = lambda rows: (features([q for q, _, _ in rows], [a for _, a, _ in rows]), np.array([[float(k in d) for k in DEFECTS] for _, _, d in rows], np.float32))
        f, y = ready(fold)
        model = Model(_fit(f.matrix(), y), model.calibration)
        f, y = ready(held)
        score = model.scores(f)
        model.calibration = np.array([_calibrate(score[:, j], y[:, j]) for j in range(len(DEFECTS))])
        if not last:
            risk = model.probabilities(features([q for q, _ in pairs], [a for _, a in pairs]))[:, : len(FORM)].max(axis=1)
            # defective pairs that the first fit, with them as sound ones, leaves below one half would hide their like; a small sample is not told apart so finely
            clear = risk < 0.1
            pairs = [p for p, keep in zip(pairs, clear if clear.sum() >= max(50, len(pairs) / 2) else risk < 0.5) if keep]
    return model


def defects_of(model: Model, questions: list[str | None], answers: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
    """All defects of each pair with a probability of one half or more, and the probabilities (pairs x DEFECTS)."""
    if not answers:
        return [], np.zeros((0, len(DEFECTS)))
    p = model.probabilities(features(questions, answers))
    return [[DEFECTS[j] for j in np.nonzero(row >= 0.5)[0]] for row in p], p


def defect_of(model: Model, question: str | None, answer: str | None) -> tuple[str | None, float]:
    """The most probable defect of form, if it has one half or more, and its probability."""
    _, p = defects_of(model, [question], [answer])
    best = int(p[0, : len(FORM)].argmax())
    return (FORM[best] if p[0, best] >= 0.5 else None), float(p[0, best])


def training_sample(pairs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``size`` pairs, those with the smallest hash of their texts; the only rows that reach the driver."""
    rows = pairs.where("trim(question) <> '' AND trim(answer) <> ''").select("question", "answer", F.xxhash64("question", "answer").alias("h")).distinct()
    rows = rows.orderBy("h", "question", "answer").limit(size)
    return [(r[0], r[1]) for r in rows.collect()]


def classify(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs (tab, record_id, pos, question, answer) -> the defective ones: (tab, record_id, pos, defect, probability, defects).

    defects holds every label of probability one half or more, defect the most probable of form (null
    if the pair is only swapped), probability its own or swapped's. A null question leaves copy,
    language and swapped undecidable; a null answer is empty. Of differing answers under one key
    each is looked at; rows that repeat give repeated results.
    """
    shape = "tab string, record_id string, pos int, defect string, probability double, defects array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, p = defects_of(model, batch.column("question").to_pylist(), batch.column("answer").to_pylist())
            if not found:
                continue
            form = p[:, : len(FORM)]
            best, top = form.argmax(axis=1), form.max(axis=1)
            keep = np.nonzero([bool(d) for d in found])[0]
            defect = pa.array([FORM[best[i]] if top[i] >= 0.5 else None for i in keep], pa.string())
            chance = pa.array([float(top[i] if top[i] >= 0.5 else p[i].max()) for i in keep], pa.float64())
            rows = batch.select(["tab", "record_id", "pos"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, defect, chance, pa.array([found[i] for i in keep], pa.list_(pa.string()))], names=["tab", "record_id", "pos", "defect", "probability", "defects"])

    return pairs.select("tab", "record_id", F.col("pos").cast("int").alias("pos"), "question", "answer").mapInArrow(run, shape)
