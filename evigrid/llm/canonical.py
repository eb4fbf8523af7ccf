"""Canonical content of short texts: what is left when formatting is taken away."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Labels of the fields that questions of the corpus may be written in.
LABELS = ("claim", "unit", "source", "period", "asked by")

_DASHES = "‐‑‒–—―−﹣－-"
_MINUS, _POINT = "\ue000", "\ue001"  # stand for a sign and a decimal point until the rest is gone
# each begins with what it looks for and looks back from there, so that a search can skip ahead
_SIGN = re.compile(rf"[{_DASHES}](?<![\w.,].)(?=\.?\d)")
_THOUSANDS = re.compile(r"\d(?<![\d.,]\d)\d{0,2}(?:[,'’]\d{3})+(?!\d)")
_DECIMAL = re.compile(rf"[.,](?<=\d.)(?=\d)|\.(?<![^\s{_MINUS}].)(?=\d)")
_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_REST = {i: None for i in range(128) if chr(i) not in _KEPT}
_REST_ALL = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{M}}{_MINUS}{_POINT}]+")
_LINE_ENDS = regex.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\p{Zl}\p{Zp}]")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Co}\u034f\ufe00-\ufe0f]|[^\P{Cc}\n]")
_PART = re.compile(r"^\W*+([^\W\d_][\w ]*?)\s*[:=](.+)$", re.S)


def plain(text: str) -> str:
    """Compatibility form, folded case, without invisible characters."""
    if text.isascii():
        return re.sub(r"[\x00-\x08\x0e-\x1f\x7f]", "", text).casefold()
    text = unicodedata.normalize("NFKC", text)
    text = _UNSEEN.sub("", _LINE_ENDS.sub(" ", text))
    return unicodedata.normalize("NFKC", text.casefold())


def flat(text: str) -> str:
    """Letters and digits in order, with decimal points and signs, of a plain text."""
    text = _SIGN.sub(_MINUS, text)
    text = _THOUSANDS.sub(lambda m: re.sub(r"\D", "", m[0]), text)
    text = _DECIMAL.sub(_POINT, text)
    # the marks put in are no ASCII: what is left of an ASCII text is found by the first form
    text = text.translate(_REST) if all(ord(c) < 128 or c in (_MINUS, _POINT) for c in set(text)) else _REST_ALL.sub("", text)
    return text.replace(_MINUS, "-").replace(_POINT, ".")


def _label_pattern(labels: tuple[str, ...]) -> re.Pattern:
    names = "|".join(r"\s+".join(map(re.escape, x.split())) for x in sorted(labels, key=len, reverse=True))
    return re.compile(rf"(?<!\w)({names})\s*[:=]")


def fields(text: str, labels: re.Pattern) -> str | None:
    """The labelled fields of a plain text in canonical order; None if it has fewer than two.

    Known labels are found wherever they stand; others where every part between semicolons, bars,
    line breaks or commas has one.
    """
    found = list(labels.finditer(text))
    pairs: list[tuple[str, str]] = []
    if len(found) >= 2:
        ends = [m.start() for m in found[1:]] + [len(text)]
        pairs = [(flat(m[1]), flat(text[m.end() : e])) for m, e in zip(found, ends)]
        if before := flat(text[: found[0].start()]):
            pairs.append(("", before))
    else:
        for sep in (";", "|", "\n", ","):
            parts = [p for p in text.split(sep) if p.strip()]
            if len(parts) >= 2 and all(ms := [_PART.match(p) for p in parts]):
                pairs = [(flat(m[1]), flat(m[2])) for m in ms]
                break
    return "\x1f".join(f"{k}\x1e{v}" for k, v in sorted(pairs)) if len(pairs) >= 2 else None


def canonical(text: str | None, labels: tuple[str, ...] = LABELS) -> tuple[str | None, str | None]:
    """(content, fields): both None for a text without letters and digits, fields None where there are none."""
    if text is None:
        return None, None
    base = plain(text)
    return (flat(base) or None), fields(base, _pattern(labels))


_PATTERNS: dict[tuple[str, ...], re.Pattern] = {}


def _pattern(labels: tuple[str, ...]) -> re.Pattern:
    if labels not in _PATTERNS:
        _PATTERNS[labels] = _label_pattern(labels)
    return _PATTERNS[labels]
