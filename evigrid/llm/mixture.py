"""Mixing sources to target weights, measured in tokens (problem 9)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evigrid.session import Scratch

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-pair files split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def with_tokens(docs: DataFrame, text: str = "text", tokenizer_dir: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """All columns but the text, and n_tokens of the whole text; a null text has none. The vocabulary file is read by the driver and shipped to the executors."""
    docs.sparkSession.sparkContext.addFile(os.path.join(tokenizer_dir, name))
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], counts], names=[*keep, "n_tokens"])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{shape}{', ' if keep else ''}n_tokens bigint")


@dataclass
class Node:
    """A node of the budget tree. capacity: tokens its leaves may give in all their epochs."""

    name: tuple[str, ...]
    weight: float
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0


def allot(node: Node, budget: float) -> float:
    """Spreads a budget over a tree by weights; returns what could not be placed below the node.

    What a child cannot take goes to its siblings in proportion to their weights, until none of them
    has room; only what is then left is returned to the parent, which offers it to its own siblings.
    """
    node.budget = min(budget, node.capacity)
    if node.children:
        open_, left, taken = [c for c in node.children if c.weight > 0], node.budget, {id(c): 0.0 for c in node.children}
        while left > 1e-9 and open_:
            total = sum(c.weight for c in open_)
            full = [c for c in open_ if c.capacity - taken[id(c)] <= left * c.weight / total]
            for c in full or open_:
                taken[id(c)] = c.capacity if full else taken[id(c)] + left * c.weight / total
            left = node.budget - sum(taken.values())
            open_ = [c for c in open_ if c not in full] if full else []
            if full:  # those still open start again from their weights
                for c in open_:
                    taken[id(c)] = 0.0
                left = node.budget - sum(taken.values())
        for c in node.children:
            allot(c, taken[id(c)])
    return budget - node.budget


def _tree(leaves: list[tuple[tuple[str, ...], float, float]]) -> Node:
    """leaves: (path from the root's child to the leaf, weight of the leaf within all, capacity)."""
    root = Node((), 1.0)
    for path, weight, capacity in leaves:
        node = root
        node.capacity += capacity
        for depth in range(1, len(path) + 1):
            child = next((c for c in node.children if c.name == path[:depth]), None)
            if child is None:
                child = Node(path[:depth], 0.0)
                node.children.append(child)
            child.weight += weight
            child.capacity += capacity
            node = child
    return root


def _leaves(node: Node) -> Iterator[Node]:
    if not node.children:
        yield node
    for c in node.children:
        yield from _leaves(c)


def budgets(sizes: list[tuple[tuple[str, ...], int, float, int]], total: float | None = None) -> dict[tuple[str, ...], float]:
    """Tokens per leaf. sizes: (path, tokens, target weight, most uses of a document), one per leaf.

    Without a total, the mix is made as large as the targets can be met exactly: the scarcest leaf
    bounds it. With one, shortages are redistributed among siblings before ancestors.
    """
    norm = sum(w for _, _, w, _ in sizes if w > 0) or 1.0
    if total is None:
        total = min((tokens * reps * norm / w for _, tokens, w, reps in sizes if w > 0), default=0.0)
    root = _tree([(path, max(w, 0.0), float(tokens * reps)) for path, tokens, w, reps in sizes])
    allot(root, total)
    return {leaf.name: leaf.budget for leaf in _leaves(root)}


def mix(
    docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, buckets: int = 4096,
    doc_id: str = "doc_id", domains: dict[str, str] | None = None, language: str | None = "lang",
) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): uses (source, doc_id, n_tokens, uses), shares one row per target source.

    docs: doc_id, source, n_tokens and the language column; targets: source, target_share,
    max_repeats (one row per source; the first of repeated ones by share counts). The tree is domain
    (of ``domains``, else one) - language - source: a source's target is spread over its languages by
    their tokens, so language shares follow the data unless a shortage moves them. Language codes
    are compared by their first two letters, unknown ones are ``und``.

    A leaf gives whole epochs of its documents and then the prefix of a seeded order that fits its
    budget best (the document at the edge is taken if half of it fits). The prefix is found without
    sorting a leaf in one task: documents fall into ``buckets`` by a seeded hash, bucket totals are
    added up, and only the bucket at the edge is ordered within itself. Documents of no target
    source, without an id or without tokens are not used; repeated ids of a source count once
    (the largest). Actual shares and their distance from the targets are reported, also for targets
    without a document (available_tokens 0), which then bound no default size; all are 0 if nothing
    can be used.
    """
    scratch = Scratch(docs.sparkSession)
    lang = F.lower(F.substring(F.col(language), 1, 2)) if language else F.lit("")
    lang = F.when(lang.rlike("^[a-z]{2}$") & (lang != "un"), lang).otherwise("und")
    goal = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").where("source IS NOT NULL")
    rows = scratch.cut(
        docs.where(F.col(doc_id).isNotNull() & F.col("source").isNotNull() & (F.col("n_tokens") > 0))
        .groupBy("source", F.col(doc_id).alias("doc_id"))
        .agg(F.max("n_tokens").alias("n_tokens"), F.min(lang).alias("lang"))
        .join(F.broadcast(goal), "source")  # one row per target source, a stated configuration
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)).cast("int"))
        .select("source", "lang", "doc_id", "n_tokens", "bucket")
    )
    wanted = {r["source"]: r for r in goal.collect()}
    # at most sources x languages x buckets rows; per leaf only its total comes to the driver
    filled = scratch.cut(rows.groupBy("source", "lang", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    totals = {(r["source"], r["lang"]): r["tokens"] for r in filled.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()}
    of_source: dict[str, int] = {}
    for (s, _), n in totals.items():
        of_source[s] = of_source.get(s, 0) + n
    sizes = []
    for s, g in sorted(wanted.items()):
        reps, share = int(g["max_repeats"] or 0), float(g["target_share"] or 0.0)
        if s not in of_source:
            sizes.append(((_domain(domains, s), "und", s), 0, share, reps))
        for (t, lg), n in sorted(totals.items()):
            if t == s:
                sizes.append(((_domain(domains, s), lg, s), n, share * n / of_source[s], reps))
    if total is None:
        plan = budgets([x for x in sizes if x[1] and x[2] > 0 and x[3] > 0], None)
    else:
        plan = budgets(sizes, total)
    leaf_rows = []
    for path, n, _, reps in sizes:
        budget = plan.get(path, 0.0)
        epochs = min(reps, int(budget // n)) if n else 0
        leaf_rows.append((path[2], path[1], epochs, float(budget - epochs * n) if epochs < reps else 0.0))
    leaf = docs.sparkSession.createDataFrame(leaf_rows, "source string, lang string, epochs int, rest double")
    below = F.sum("tokens").over(Window.partitionBy("source", "lang").orderBy("bucket")) - F.col("tokens")
    edges = scratch.cut(filled.withColumn("below", below).join(F.broadcast(leaf), ["source", "lang"]).select("source", "lang", "bucket", "tokens", "below", "epochs", "rest"))
    placed = rows.join(edges, ["source", "lang", "bucket"])
    whole, edge = F.col("below") + F.col("tokens") <= F.col("rest"), F.col("below") < F.col("rest")
    inner = Window.partitionBy("source", "lang", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id")
    at_edge = placed.where(~whole & edge).withColumn("before", F.col("below") + F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    extra = at_edge.withColumn("extra", (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    rest = placed.where(whole | ~edge).withColumn("extra", whole.cast("int"))
    cols = ["source", "doc_id", "n_tokens", (F.col("epochs") + F.col("extra")).alias("uses")]
    uses = scratch.cut(extra.select(*cols).unionByName(rest.select(*cols)).where("uses > 0"))
    got = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    have = docs.sparkSession.createDataFrame([(s, of_source.get(s, 0)) for s in wanted], "source string, available_tokens bigint")
    shares = (
        goal.join(have, "source").join(got, "source", "left").fillna(0, ["tokens", "n_docs", "most_uses"])
        .withColumn("all_tokens", got.agg(F.sum("tokens")).scalar())
        .select("source", "target_share", "max_repeats", "available_tokens", "tokens", "n_docs", "most_uses", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"))
        .withColumn("share_error", F.col("actual_share") - F.col("target_share"))
    )
    return uses, shares


def _domain(domains: dict[str, str] | None, source: str) -> str:
    return (domains or {}).get(source, "all")
