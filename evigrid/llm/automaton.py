"""A generalised suffix automaton over word sequences, and the longest matches of a stream in it."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import numpy as np

_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_BROKEN = re.compile(r"(?<=\w)[-‐]\s*\n[\s>*|#]*(?=[^\W_])")
_WORD = re.compile(r"<[^<>\n]*+>|[^\W_]+(?:['’][^\W_]+)?")
#: What html.unescape looks for, a base character with its combining marks and joining jamo, and a word.
_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_COMPOSED = re.compile(r"[^\S\x00-\x20]|(?:[\x21-\x7f](?=[^\x00-\x7f])|[^\x00-\x7f])(?:(?![’\s])[^\x00-\x7f])*")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def words_at(text: str) -> list[tuple[str, int, int]]:
    """The words of ``words`` with their places in the text: every step of it keeps, for each character, where it came from."""
    chars, at = list(text), list(range(len(text)))
    ends = [i + 1 for i in at]

    def put(new: list[tuple[str, int, int]]) -> None:
        nonlocal chars, at, ends
        chars, at, ends = [c for x, _, _ in new for c in x], [a for x, a, _ in new for _ in x], [b for x, _, b in new for _ in x]

    def sub(pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        new, last, now = [], 0, "".join(chars)
        for m in pattern.finditer(now):
            new += zip(chars[last : m.start()], at[last : m.start()], ends[last : m.start()])
            new.append((by(m), at[m.start()], ends[m.end() - 1]))
            last = m.end()
        put([*new, *zip(chars[last:], at[last:], ends[last:])])

    if not text.isascii():
        sub(_INVISIBLE, lambda m: "")
        # a composition may take in the characters that follow: a base goes with its marks and joining letters
        sub(_COMPOSED, lambda m: unicodedata.normalize("NFKC", m[0]).replace("’", "'"))
    now = "".join(chars)
    if _may_break(now):
        sub(_BROKEN, lambda m: "")
    if "<" in now:
        sub(_WORD, _without_tag)
    if "&" in now:
        sub(_ENTITY, lambda m: html.unescape(m[0]))
    put([(c.casefold(), a, b) for c, a, b in zip(chars, at, ends)])
    return [(m[0], at[m.start()], ends[m.end() - 1]) for m in _TOKEN.finditer("".join(chars))]


def _may_break(text: str) -> bool:
    return "-\n" in text or "- \n" in text or "-\r" in text or "‐" in text


def _without_tag(m: re.Match) -> str:
    return m[0] if m[0][0] != "<" else " " if m[0][1:2].lower() in ("p", "d", "l") or m[0][1:3].lower() in ("br", "/p", "/d", "/l", "tr", "td") else ""


def words(text: str) -> list[str]:
    """The words of words_at without their places, faster."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).replace("’", "'")
    if _may_break(text):
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _WORD.sub(_without_tag, text)
    if "&" in text:
        text = html.unescape(text)
    return _TOKEN.findall(text.casefold())


class Automaton:
    """All word sequences that occur in the given lists, as a suffix automaton over flat tables, with end positions.

    A state's transitions lie in one table under state * vocabulary + word, so that the whole is a
    few flat objects that travel as one broadcast. End positions (list, index of the last word) are
    kept for the states that hold the sequences of exactly ``seed`` words: whatever matches longer
    passes one of them at every word.
    """

    def __init__(self, lists: list[tuple[int, list[str]]], seed: int):
        self.seed = seed
        self.vocab: dict[str, int] = {}
        for _, ws in lists:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab))
        self.follow: dict[int, int] = {}
        self._words: list[list[int]] = [[]]  # the words that lead on from a state, while it is built
        self.link, self.length = [-1], [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for key, ws in lists:
            last = 0
            for at, w in enumerate(ws):
                last = self._extend(last, self.vocab[w])
                own.setdefault(last, []).append((key, at))
        del self._words
        self.top = self._seed_states()
        places: dict[int, list[tuple[int, int]]] = {}
        for s, found in own.items():
            if self.top[s] >= 0:
                places.setdefault(self.top[s], []).extend(found)
        # a list's place belongs to one state of its full prefix, and that to one seed state
        self.bounds: dict[int, tuple[int, int]] = {}
        keys, ats = [], []
        for s, found in places.items():
            self.bounds[s] = (len(keys), len(keys) + len(found))
            keys += [k for k, _ in found]
            ats += [a for _, a in found]
        self.keys, self.ats = np.array(keys, np.int64), np.array(ats, np.int64)

    def _seed_states(self) -> list[int]:
        """For each state of seed words or more, the suffix state that holds its last seed words; -1 for the others."""
        top = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= self.seed:
                top[s] = s if self.length[self.link[s]] < self.seed else top[self.link[s]]
        return top

    def _extend(self, last: int, c: int) -> int:
        n = len(self.vocab)
        if (q := self.follow.get(last * n + c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, [])
        p = last
        while p >= 0 and p * n + c not in self.follow:
            self.follow[p * n + c] = cur
            self._words[p].append(c)
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.follow[p * n + c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, leads: list[int]) -> int:
        self._words.append(leads)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        n = len(self.vocab)
        copy = self._state(self.length[p] + 1, list(self._words[q]))
        for w in self._words[q]:
            self.follow[copy * n + w] = self.follow[q * n + w]
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.follow.get(p * n + c) == q:
            self.follow[p * n + c] = copy
            p = self.link[p]
        return copy

    def matches(self, stream: list[str]) -> list[tuple[int, int, int]]:
        """(index of a word, length of the longest match that ends there, its seed state) wherever it has seed words or more."""
        out, state, length = [], 0, 0
        vocab, follow, link, lengths, seed, top, n = self.vocab.get, self.follow.get, self.link, self.length, self.seed, self.top, len(self.vocab)
        for i, w in enumerate(stream):
            c = vocab(w)
            if c is None:
                state = length = 0
                continue
            to = follow(state * n + c)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = follow(state * n + c)
            if to is not None:
                state, length = to, length + 1
                if length >= seed:
                    out.append((i, length, top[state]))
        return out
