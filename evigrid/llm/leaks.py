"""Evaluation texts leaking into training text (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrid.llm.automaton import Automaton, words, words_at

#: Words of a passage that count as a leak, and words per tolerated error.
MIN_WORDS, WORDS_PER_ERROR = 15, 7
#: A passage of MIN_WORDS with its errors leaves an exact run of at least this many words.
SEED = 3


class Block:
    """Items of one block with their automaton: what a task needs, as one broadcast."""

    def __init__(self, items: list[tuple[object, list[str]]], min_words: int, words_per_error: int, seed: int = SEED):
        self.ids = [k for k, _ in items]
        self.targets = [ws for _, ws in items]
        self.min_words, self.words_per_error = min_words, words_per_error
        self.auto = Automaton(list(enumerate(self.targets)), seed)
        self.sizes = np.array([len(ws) for ws in self.targets], np.int64)
        # n words with e errors hold at least n - seed + 1 - seed * e matches of seed words
        longest = int(self.sizes.max(initial=min_words))
        self.least_hits = max(1, min(n - seed + 1 - seed * -(-n // words_per_error) for n in range(min_words, max(longest, min_words) + 1)))
        self.base = (self.auto.keys << 32) - self.auto.ats + _FAR

    def clusters(self, stream: list[str]) -> list[tuple[int, int, int]]:
        """(item, first, last place in the text at which the item would begin), where enough matches lie close together.

        Matches of one item within a passage differ in that place by its errors at most, so of all
        places only those with least_hits matches that near each other are looked at.
        """
        if not (found := self.auto.matches(stream)):
            return []
        bounds = self.auto.bounds
        hits = np.concatenate([self.base[slice(*bounds[top])] + i for i, _, top in found])
        if len(hits) < self.least_hits:
            return []
        hits.sort()
        item, reach = hits >> 32, self.least_hits - 1
        errors = -(-self.sizes[item] // self.words_per_error)
        near = np.ones(len(hits), bool) if not reach else (hits[reach:] - hits[:-reach] <= errors[:-reach])
        if not near.any():
            return []
        # a run of least_hits matches from each start: keep every match that lies in one
        steps = np.zeros(len(hits) + 1, np.int64)
        at = np.nonzero(near)[0]
        np.add.at(steps, at, 1)
        np.add.at(steps, np.minimum(at + reach + 1, len(hits)), -1)
        hits = hits[np.cumsum(steps[:-1]) > 0]
        item, shift = hits >> 32, (hits & 0xFFFFFFFF) - _FAR
        out, begun = [], 0
        sizes = self.sizes[item]
        gaps = (np.diff(item) != 0) | (np.diff(shift) > -(-sizes[1:] // self.words_per_error))
        for end in [*(np.nonzero(gaps)[0] + 1).tolist(), len(hits)]:
            k, first, last = int(item[begun]), int(shift[begun]), int(shift[end - 1])
            width = 4 * int(self.sizes[k])  # wide groups are looked at in parts, each reaching into the next
            while last - first > width:
                out.append((k, first, first + width))
                first += width
            out.append((k, first, last))
            begun = end
        return out

    def spans(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item, first character, end, words of the item, errors) of each leaking passage of a text."""
        stream = words(text)
        placed, out, done = None, [], {}
        for k, first, last in self.clusters(stream):
            target = self.targets[k]
            slack = -(-len(target) // self.words_per_error) + 1
            lo, hi = max(done.get(k, 0), first - slack), min(len(stream), last + len(target) + slack)
            window = stream[lo:hi]
            if not _possible(target, window, first - lo, last - lo, slack, self.min_words, self.words_per_error):
                continue
            for n, errors, a, b in passages(target, window, self.min_words, self.words_per_error):
                placed = placed or words_at(text)
                out.append((self.ids[k], placed[lo + a][1], placed[lo + b - 1][2], n, errors))
                done[k] = max(done.get(k, 0), lo + b)
        return out


#: Added to places in a text, so that those before its beginning are no negative numbers.
_FAR = 1 << 30


def _possible(target: list[str], window: list[str], first: int, last: int, slack: int, min_words: int, words_per_error: int) -> bool:
    """Whether some stretch of the item has enough words in place near the places at which it would begin."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(window):
        where.setdefault(w, []).append(j)
    held = [0]
    for i, w in enumerate(target):
        held.append(held[-1] + any(first - slack <= j - i <= last + slack for j in where.get(w, ())))
    if held[-1] < min_words - -(-min_words // words_per_error):
        return False
    # words in place less those a stretch of n needs: n - ceil(n / words_per_error)
    cum = np.array(held)
    starts, n = np.arange(len(target))[:, None], np.arange(min_words, len(target) + 1)[None, :]
    ends = starts + n
    inside = ends <= len(target)
    return bool((inside & (cum[np.minimum(ends, len(target))] - cum[starts] >= n - -(-n // words_per_error))).any())


def passages(target: list[str], window: list[str], min_words: int, words_per_error: int) -> list[tuple[int, int, int, int]]:
    """(words of the item, errors, window start, end) of the leaking passages of a window, the longest first found and the rest around it.

    Every stretch of the item is tried against every place: at step n, cell (i, j) holds the fewest
    changed, dropped or added words between the item's n words from i and words of the window up to
    j, and the latest start with so many. A passage begins and ends with words in place.
    """
    size, width, inside = len(target), len(window), set(window)
    # a passage has at least so many words in place, whatever its length
    if sum(x in inside for x in target) < min_words - -(-min_words // words_per_error):
        return []
    code: dict[str, int] = {}
    t, w = (np.array([code.setdefault(x, len(code)) for x in ws]) for ws in (target, window))
    same = t[:, None] == w[None, :]
    unit = width + 2  # a key is errors * unit - start
    ramp, never = np.arange(width + 1) * unit, unit * (size + width + 2)
    keys = np.full((size, width + 1), never)
    keys[:, 1:] = np.where(same, -np.arange(width), never)
    best = None
    for n in range(1, size + 1):
        if n > 1:
            old, hit = keys[: size - n + 1], same[n - 1 :]
            keys = old + unit
            keys[:, 1:] = np.minimum(keys[:, 1:], old[:, :-1] + np.where(hit, 0, unit))
            if n >= min_words:
                ended = np.where(hit, old[:, :-1], never)
                at = int(ended.argmin())
                key = int(ended.flat[at])
                errors = -(-key // unit)
                if errors <= -(-n // words_per_error):
                    best = (n, errors, errors * unit - key, at % width + 1)
        keys = np.minimum.accumulate(keys - ramp, axis=1) + ramp
    if best is None:
        return []
    n, errors, a, b = best
    left, right = (passages(target, part, min_words, words_per_error) for part in (window[:a], window[b:]))
    return [best, *left, *[(m, e, b + c, b + d) for m, e, c, d in right]]


def leak_spans(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "id", question: str = "question",
    min_words: int = MIN_WORDS, words_per_error: int = WORDS_PER_ERROR, block_words: int = 250_000,
) -> DataFrame:
    """(doc_id, item_id, start, end, n_words, errors): every leaking passage of every document.

    The items are a stated query set. They pass the driver once, in blocks of ``block_words`` words: an
    automaton is built per block (at most twice as many states as words), broadcast (its size is
    thereby bounded), and read once per worker process. Every document streams past each block,
    whole, without a shuffle. Null texts and items, and items shorter than min_words, match nothing;
    equal items each match.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out, block, size = None, [], 0

    def flush() -> None:
        nonlocal out, block, size
        part = _one_block(docs, Block(block, min_words, words_per_error), doc_id, text, *kinds)
        out, block, size = part if out is None else out.unionByName(part), [], 0

    for key, asked in items.select(item_id, question).where(f"`{item_id}` IS NOT NULL AND `{question}` IS NOT NULL").distinct().toLocalIterator():
        if len(ws := words(asked)) >= min_words:
            if block and size + len(ws) > block_words:
                flush()
            block.append((key, ws))
            size += len(ws)
    if block or out is None:
        flush()
    return out


def _one_block(docs: DataFrame, block: Block, doc_id: str, text: str, doc_kind: str, item_kind: str) -> DataFrame:
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            rows = [(d, *span) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for span in here.spans(t)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [arrow[doc_kind], arrow[item_kind], *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "start", "end", "n_words", "errors"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(
        run, f"doc_id {doc_kind}, item_id {item_kind}, start int, end int, n_words int, errors int"
    )


def leaks(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, spans: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed_chars, dropped): documents with their leaking spans cut out.

    Overlapping spans are cut once. A document of which spans cover drop_share or more is dropped
    (dropped = true, text null) instead. Documents without spans pass unchanged.
    """
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    cuts = spans.groupBy("doc_id").agg(merged.alias("cuts"))
    removed = F.aggregate("cuts", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda s: s["end"]))
    ends = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substr("text", s["a"] + 1, s["b"] - s["a"])), "")
    joined = docs.select("doc_id", "text").join(cuts, "doc_id", "left").withColumn("removed_chars", F.coalesce(removed, F.lit(0)))
    gone = F.col("removed_chars") > 0
    dropped = gone & (F.col("removed_chars") >= drop_share * F.length("text"))
    return joined.select("doc_id", F.when(dropped, F.lit(None)).when(gone, kept).otherwise(F.col("text")).alias("text"), "removed_chars", dropped.alias("dropped"))
