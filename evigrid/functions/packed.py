"""Splitting rules for fields that hold several values, resolved on delimiter skeletons (problem 4).

A text is cut into tokens: runs of ordinary characters and single delimiters. In its skeleton every
run of ordinary characters is masked, so texts that differ only in their words share a skeleton and
thereby a splitting rule: for each value, the range of tokens it covers.
"""

from __future__ import annotations

import re

#: How a field says that it holds nothing (compared without case, marks and blanks).
NONE_WORDS = ("none", "na", "nil", "null", "no", "nothing", "notools", "nosteps", "nonerequired", "noneneeded", "notapplicable", "notoolsrequired", "notoolsneeded", "notoolsused", "nonenecessary")
#: Words that the mask keeps, as enumerations and headings are read from them.
KEPT_WORDS = ("step", "steps", "tool", "tools", "used", "required", "needed")
_WORD = r"(?!(?i:" + "|".join(KEPT_WORDS) + r")(?![\p{L}\p{N}_]))[\p{L}_][\p{L}\p{N}_]*"
#: A token: a line break, blanks, a long number, a run of ordinary words, a kept word or digits, an arrow, an escape, or one delimiter.
TOKEN = (
    r"\r\n|\r|\n"
    r"|[ \t\u00a0\u200b\ufeff]+"
    r"|[0-9]+(?:[.,][0-9]+)++"
    rf"|{_WORD}(?: {_WORD})*+"
    r"|[\p{L}\p{N}_]+"
    r"|->|=>|\u2192"
    r"|\\."
    r"|[^\p{L}\p{N}_]"
)
_KEPT = frozenset(KEPT_WORDS)
_SEPARATORS = ("\n", ";", "|", "\t", "->", ",", "/")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "‘": "’"}, set(")]}”»’")
_BULLETS = {"-", "*", "•", "–", "—", "·", "‣", "◦", "▪", "+"}


def mask(parts: list[str], i: int) -> str:
    """Skeleton form of a token: ``w`` for ordinary text, ``#`` for numbers that can be no enumeration."""
    token = parts[i]
    if token in ("\r\n", "\r"):
        return "\n"
    if token[:1].isalnum() or token[:1] == "_":
        if token.isascii() and token.isdigit():
            stepped = i > 0 and parts[i - 1].lower() == "step" or i > 1 and parts[i - 1].strip() == "" and parts[i - 2].lower() == "step"
            closed = i + 1 < len(parts) and parts[i + 1] in (".", ")", ":", "]")
            first = i == 0 or parts[i - 1] in ("\n", "\r\n", "\r")
            return token if (stepped or closed) and len(token) <= (6 if first or stepped else 2) else "#"
        if token[0].isascii() and token[0].isdigit():
            return "#"
        return low if (low := token.lower()) in _KEPT else "w"
    if token.strip(" \t\u00a0\u200b\ufeff") == "":
        return "\t" if "\t" in token else " "
    return "->" if token in ("=>", "\u2192") else token


def skeleton(parts: list[str]) -> list[str]:
    return [mask(parts, i) for i in range(len(parts))]


class _Reader:
    """Resolves one skeleton, given as a list of masks."""

    def __init__(self, shape: list[str]):
        self.t, self.n = shape, len(shape)
        self.deep = self._covered()

    def _covered(self) -> list[bool]:
        """For each token, whether it stands inside quotes or brackets (marks included)."""
        deep, stack = [False] * self.n, []
        for i, c in enumerate(self.t):
            before = self.t[i - 1] if i else " "
            after = self.t[i + 1] if i + 1 < self.n else " "
            if stack and c == stack[-1][0] and not (c == "'" and self._word(after)):
                at = stack.pop()[1]
                for k in range(at, i + 1):
                    deep[k] = True
            elif c in ('"', "'") and not self._word(before):
                if not any(s[0] == c for s in stack):
                    stack.append((c, i))
            elif c in _OPEN and not (stack and stack[-1][0] in "\"'"):
                stack.append((_OPEN[c], i))
        return deep

    @staticmethod
    def _word(c: str) -> bool:
        return c == "w" or c == "#" or c[:1].isalnum()

    def blank(self, i: int) -> bool:
        return i >= self.n or self.t[i] in (" ", "\t", "\n")

    def mark(self, i: int) -> tuple[int, int | None] | None:
        """An enumeration mark at i: the token after it and its number, None for a bullet."""
        t, n = self.t, self.n
        j, worded = i, False
        if j < n and t[j] in ("step", "tool"):
            j, worded = j + 1, True
            while j < n and t[j] == " ":
                j += 1
        wrapped = j < n and t[j] in ("(", "[")
        j += wrapped
        if j < n and t[j].isdigit():
            number, j = int(t[j]), j + 1
            if wrapped:
                if j < n and t[j] in (")", "]"):
                    return self._after(j + 1), number
                return None
            k = j
            while worded and k < n and t[k] == " ":
                k += 1
            if k < n and t[k] in (".", ")", ":") or worded and k < n and t[k] in _BULLETS:
                at_start = i == 0 or t[i - 1] == "\n"
                if k + 1 < n and (t[k + 1] in (" ", "\t") or worded or at_start or t[k] == ")"):
                    return self._after(k + 1), number
            elif worded:
                return self._after(k), number
            return None
        if not worded and not wrapped and i < n and t[i] in _BULLETS and i + 1 < n and t[i + 1] in (" ", "\t"):
            return self._after(i + 1), None
        return None

    def _after(self, j: int) -> int:
        while j < self.n and self.t[j] in (" ", "\t"):
            j += 1
        return j

    def lines(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for i in range(self.n + 1):
            if i == self.n or self.t[i] == "\n":
                out.append((at, i))
                at = i + 1
        return out

    def trim(self, a: int, b: int) -> tuple[int, int]:
        while a < b and self.t[a] in (" ", "\t", "\n"):
            a += 1
        while b > a and self.t[b - 1] in (" ", "\t", "\n"):
            b -= 1
        return a, b

    def heading(self, a: int, b: int) -> bool:
        """A line such as ``Tools used:`` that names the list."""
        words = [c for c in self.t[a:b] if c not in (" ", "\t")]
        return bool(words) and words[-1] == ":" and all(c in _KEPT for c in words[:-1]) and len(words) > 1

    def inline_marks(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places (start, end of mark) of a numbered enumeration that runs on within a line: 1, 2, 3 ..."""
        found, want = [], None
        i = a
        while i < b:
            if not self.deep[i] or self.t[i] in ("(", "["):
                before = self.t[i - 1] if i > a else " "
                m = self.mark(i) if before in (" ", "\t", "\n", ";", ",", "|") or i == a else None
                again = self.mark(m[0]) if m and m[0] < b else None
                if m and m[1] is not None and m[0] < b and m[1] == (m[1] if want is None else want) and not (again and again[1] == m[1]):
                    found.append((i, m[0]))
                    want, i = m[1] + 1, m[0]
                    continue
            i += 1
        return found

    def outer(self, a: int, b: int, sep: str) -> list[tuple[int, int]]:
        """Parts of a range at its separators that are not covered; a slash counts only between blanks."""
        out, at = [], a
        for i in range(a, b):
            if self.t[i] != sep or self.deep[i]:
                continue
            if sep == "/" and not (i > a and self.t[i - 1] == " " and self.blank(i + 1)):
                continue
            out.append((at, i))
            at = i + 1
        return [*out, (at, b)]

    def split_by(self, ranges: list[tuple[int, int]], seps: tuple[str, ...]) -> list[tuple[int, int]]:
        for sep in seps:
            ranges = [part for a, b in ranges for part in self.outer(a, b, sep)]
        return ranges

    def array(self, a: int, b: int) -> tuple[int, int] | None:
        """The inside of a JSON-like array that is the whole range."""
        if b - a >= 2 and self.t[a] == "[" and self.t[b - 1] == "]":
            return a + 1, b - 1
        return None


def resolve(shape: list[str], prose: bool) -> list[tuple[int, int]]:
    """The rule of a skeleton: token ranges of its values in order, marks and headings left out.

    prose: values are sentences, in which commas do not split (steps); else they are names (tools).
    """
    r = _Reader(shape)
    a, b = r.trim(0, r.n)
    if a == b:
        return []
    if inside := r.array(a, b):
        inner = _Reader(shape[inside[0] : inside[1]])
        parts = inner.split_by([(0, inner.n)], (",", ";"))
        return _clean(r, [(x + inside[0], y + inside[0]) for x, y in parts])
    lines = [r.trim(x, y) for x, y in r.lines()]
    lines = [(x, y) for x, y in lines if x < y]
    while lines and r.heading(*lines[0]):
        lines = lines[1:]
    if not lines:
        return []
    if (headed := _inline_heading(r, *lines[0])) is not None:
        lines[0] = r.trim(headed, lines[0][1])
    marked = [r.mark(x) for x, _ in lines]
    if len(lines) > 1 and not marked[0] and marked[1] and r.t[lines[0][1] - 1] == ":":
        lines, marked = lines[1:], marked[1:]
    start, end = lines[0][0], lines[-1][1]
    if marked[0]:
        bullets = marked[0][1] is None
        starts = [(x, m[0]) for (x, _), m in zip(lines, marked) if m and (m[1] is None) == bullets]
        if not bullets and len(starts) == 1:
            starts = r.inline_marks(start, end) or starts
        ends = [s for s, _ in starts[1:]] + [end]
        return _clean(r, [_without_tail(r, *r.trim(m, e)) for (_, m), e in zip(starts, ends)])
    if len(lines) > 1:
        values = lines
    else:
        values = [(start, end)]
    if prose:
        if len(lines) == 1:
            for sep in ("|", ";", "\t", "->"):
                if len(parts := r.split_by(values, (sep,))) > len(values):
                    return _clean(r, parts)
        return _clean(r, [_without_tail(r, x, y) for x, y in values])
    if len(lines) > 1:
        return _clean(r, values)
    return _clean(r, r.split_by(values, (";", "|", "\t", "->", ",", "/")))


def _inline_heading(r: _Reader, a: int, b: int) -> int | None:
    """The token after a heading that shares its line with the first value: ``Tools used: x, y``."""
    for i in range(a, b):
        if r.t[i] == ":":
            return i + 1 if i > a and r.heading(a, i + 1) else None
        if r.t[i] not in (" ", "\t") and r.t[i] not in _KEPT:
            return None
    return None


def _without_tail(r: _Reader, a: int, b: int) -> tuple[int, int]:
    while b > a and r.t[b - 1] in (";", "|", ",", " ", "\t", "\n", "->"):
        b -= 1
    return a, b


def _clean(r: _Reader, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Blank ranges and pure punctuation go; ranges keep their order."""
    out = []
    for a, b in ranges:
        a, b = r.trim(a, b)
        if a < b and any(r._word(c) for c in r.t[a:b]):
            out.append((a, b))
    return out


_TOKEN = None


def tokens(text: str) -> list[str]:
    global _TOKEN
    if _TOKEN is None:
        import regex

        _TOKEN = regex.compile(TOKEN, regex.S)
    return _TOKEN.findall(text)


def split(text: str | None, prose: bool) -> list[str]:
    """Plain form of the whole operator for one text, for tests."""
    parts = tokens(text or "")
    found = ["".join(parts[a:b]) for a, b in resolve(skeleton(parts), prose)]
    return [v for v in found if not says_none(v)] if len(found) == 1 else found


def says_none(value: str) -> bool:
    return re.sub(r"[^a-z]", "", value.lower()) in NONE_WORDS


def item_key(value: str) -> str:
    return re.sub(r"[^a-z0-9]", "", value.lower())
