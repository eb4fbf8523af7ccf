"""References to records that do not exist (problem 2).

A reference end is orphaned when no row of its key was ever received (``missing``), when the latest
row of its key is a tombstone (``deleted``), or when its first row came after the referring record
(``late``). Orphans are inherited: whatever hangs below an orphaned record is indirectly orphaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evigrid.session import Scratch


def key_states(rows: DataFrame, keys: list[str], loaded: str, deleted: str | None = None) -> DataFrame:
    """One row per key: when it was first received, and whether its latest row is a tombstone.

    Of several rows with the same latest time a live one wins; a row without a time counts as the
    oldest; a null flag counts as live. Rows with a null key are no keys. Partial aggregation keeps
    a hot key to one row per map task.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    latest = F.max(F.struct(F.col(loaded).alias("t"), (~gone).alias("live")))
    return (
        rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        .groupBy(*keys)
        .agg(F.min(loaded).alias("first_seen"), (~latest["live"]).alias("is_deleted"))
    )


def orphan_reason(known: Column, is_deleted: Column, first_seen: Column, referred_at: Column) -> Column:
    return F.when(known.isNull(), "missing").when(is_deleted, "deleted").when(first_seen > referred_at, "late")


def edge_ends(edges: DataFrame, group: str, record: str, sides: dict[str, str], loaded: str) -> DataFrame:
    """One row per non-null end: (group_id, record_id, side, key, loaded_at). sides: name -> column."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("string").alias("key")) for s, c in sides.items()])
    return (
        edges.select(F.col(group).alias("group_id"), F.col(record).alias("record_id"), F.col(loaded).alias("loaded_at"), F.explode(ends).alias("e"))
        .select("group_id", "record_id", "loaded_at", "e.side", "e.key")
        .where("key IS NOT NULL")
    )


def direct_orphans(ends: DataFrame, states: DataFrame) -> DataFrame:
    """Ends with their reason; ends that resolve are left out. states: (group_id, key, first_seen, is_deleted).

    Both sides are hashed on (group_id, key), so one hot group is spread over its keys; adaptive
    skew joins split a single hot key. An end in a null group resolves to nothing: ``missing``.
    """
    states = states.select("group_id", "key", "first_seen", "is_deleted", F.lit(True).alias("known"))
    joined = ends.join(states, ["group_id", "key"], "left")
    return joined.withColumn("reason", orphan_reason(F.col("known"), F.col("is_deleted"), F.col("first_seen"), F.col("loaded_at"))).where(
        "reason IS NOT NULL"
    ).select("group_id", "record_id", "side", "key", "loaded_at", "reason")


def _apply(keys: DataFrame, links: DataFrame, power: int) -> DataFrame:
    """Where links lead from keys (group_id, key, depth), ``power`` deeper; the smallest depth of each."""
    from_key = keys.select("group_id", F.col("key").alias("src"), "depth")
    return links.join(from_key, ["group_id", "src"]).groupBy("group_id", F.col("dst").alias("key")).agg((F.min("depth") + power).alias("depth"))


def _doubled_size(links: DataFrame) -> int:
    """How many pairs links of links are at most, from degrees, before any is made."""
    out = links.groupBy("group_id", F.col("src").alias("k")).agg(F.count("*").alias("o"))
    into = links.groupBy("group_id", F.col("dst").alias("k")).agg(F.count("*").alias("i"))
    return out.join(into, ["group_id", "k"]).agg(F.sum(F.col("o") * F.col("i"))).head()[0] or 0


def cascade_orphans(edges: DataFrame, direct: DataFrame, growth: float = 3.0) -> DataFrame:
    """All orphaned ends, direct (depth 0) and inherited (depth of the shortest way from a direct one).

    edges: (group_id, record_id, src, dst, loaded_at); direct: as above. A record with a direct
    orphan passes its state to the key it points to (dst) and thereby to every record that starts
    there, until nothing new is reached; cycles end, as a key counts once. Chains may be long, so
    links are squared after each round, which halves the rounds that are left, as long as the square
    (measured beforehand by degrees) has at most ``growth`` times as many pairs as the links;
    beyond that, rounds go on from the frontier with the last power. Every round is a written table.

    Result: (group_id, record_id, side, key, loaded_at, reason, kind, depth); reason of inherited
    rows is ``inherited``, side is ``src``.
    """
    scratch = Scratch(edges.sparkSession)
    records = scratch.cut(edges.where("src IS NOT NULL AND group_id IS NOT NULL").select("group_id", "record_id", "src", "dst", "loaded_at").distinct())
    bad = direct.select("group_id", "record_id").distinct()
    seeds = edges.join(bad, ["group_id", "record_id"], "left_semi").where("dst IS NOT NULL AND group_id IS NOT NULL").select("group_id", F.col("dst").alias("key")).distinct()
    links = scratch.cut(records.where("dst IS NOT NULL").select("group_id", "src", "dst").distinct(), "links")
    reached = scratch.cut(seeds.withColumn("depth", F.lit(1)), "reached")
    power, known, allowed = 1, reached.count(), growth * links.count()
    doubling, frontier, parts = True, reached, 0
    while known:
        found = _apply(frontier, links, power)
        if doubling:
            reached = scratch.cut(reached.unionByName(found).groupBy("group_id", "key").agg(F.min("depth").alias("depth")), "reached")
            now = reached.count()
            if now == known:
                break
            known = now
            if doubling := _doubled_size(links) <= allowed:
                ahead = links.select("group_id", F.col("src").alias("dst"), F.col("dst").alias("end"))
                links = scratch.cut(links.join(ahead, ["group_id", "dst"]).select("group_id", "src", F.col("end").alias("dst")).distinct(), "links")
                power *= 2
            frontier = reached
        else:
            frontier = scratch.cut(found.join(reached.select("group_id", "key"), ["group_id", "key"], "left_anti"))
            if frontier.isEmpty():
                break
            reached, parts = reached.unionByName(frontier), parts + 1
            if parts % 16 == 0:  # one table again, so that a long way down reads few
                reached = scratch.cut(reached, "reached")
    inherited = (
        records.join(reached.withColumnRenamed("key", "src"), ["group_id", "src"])
        .join(bad, ["group_id", "record_id"], "left_anti")
        .select("group_id", "record_id", F.lit("src").alias("side"), F.col("src").alias("key"), "loaded_at", F.lit("inherited").alias("reason"), F.lit("inherited").alias("kind"), "depth")
    )
    own = direct.select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    return own.unionByName(inherited)


def graph_orphans(tables: dict[str, DataFrame], references: list[tuple[str, str, str]], growth: float = 3.0) -> DataFrame:
    """Orphans down a graph of tables: (tab, record_id, side, key, loaded_at, reason, kind, depth).

    tables: name -> (key, loaded_at[, is_deleted], and the referring columns), any column of which may
    be null; a column that holds an array refers with each of its values. references: (table, column,
    table referred to). Direct orphans are found per reference against the key states of the table
    referred to; then every record that refers to an orphaned one is orphaned too, through all
    tables to a fixpoint, also where a table refers to itself. Nodes of all tables share one
    cascade, so a round is one join whatever the number of tables. Keys are compared as text; a
    record without a key can be orphaned, but hands nothing on. Equal rows count once.
    """
    node = lambda t, c: F.concat(F.lit(f"{t}:"), c.cast("string"))
    parents = {p for _, _, p in references}
    states, edges = None, None
    for name in sorted(parents):
        rows = tables[name]
        gone = "is_deleted" if "is_deleted" in rows.columns else None
        one = key_states(rows, ["key"], "loaded_at", gone).select(F.lit("").alias("group_id"), node(name, F.col("key")).alias("key"), "first_seen", "is_deleted")
        states = one if states is None else states.unionByName(one)
    for name, column, parent in references:
        rows = tables[name]
        many = rows.schema[column].dataType.typeName() == "array"
        rows = rows.withColumn("_ref", F.explode(column) if many else F.col(column)).where("_ref IS NOT NULL")
        one = rows.select(
            F.lit("").alias("group_id"), F.coalesce(node(name, F.col("key")), F.lit(f"{name}:")).alias("record_id"), F.lit(f"{name}.{column}").alias("side"), node(parent, F.col("_ref")).alias("src"), node(name, F.col("key")).alias("dst"), "loaded_at"
        )
        edges = one if edges is None else edges.unionByName(one)
    scratch = Scratch(edges.sparkSession)
    edges = scratch.cut(edges.distinct())
    direct = scratch.cut(direct_orphans(edges.withColumnRenamed("src", "key").drop("dst"), states))
    # the side of an inherited orphan is the reference by which it inherits
    found = cascade_orphans(edges.drop("side"), direct, growth)
    sides = edges.select("record_id", F.col("src").alias("key"), F.col("side").alias("_side")).distinct()
    inherited = found.where("kind = 'inherited'").join(sides, ["record_id", "key"]).withColumn("side", F.col("_side")).drop("_side")
    both = found.where("kind = 'direct'").unionByName(inherited)
    bare = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    return both.select(F.regexp_extract("record_id", "^([^:]*):", 1).alias("tab"), bare("record_id").alias("record_id"), "side", bare("key").alias("key"), "loaded_at", "reason", "kind", "depth")


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Counts per table, kind, reason and month of the referring record."""
    return (
        orphans.select("group_id", "record_id", "side", "key", "kind", "reason", F.date_format("loaded_at", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy(F.lit(table).alias("tab"), "kind", "reason", "month")
        .agg(F.count("*").alias("ends"))
    )


def plan_orphans(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphaned ends of plan edges against the history of plan steps, direct and inherited."""
    scratch = Scratch(steps.sparkSession)
    states = key_states(steps, ["trace_id", "step_id"], "loaded_at", "deleted").select(
        F.col("trace_id").alias("group_id"), F.col("step_id").alias("key"), "first_seen", "is_deleted"
    )
    flat = edges.select(F.col("trace_id").alias("group_id"), F.col("id").alias("record_id"), "src", "dst", "loaded_at").distinct()
    ends = edge_ends(flat, "group_id", "record_id", {"src": "src", "dst": "dst"}, "loaded_at")
    direct = scratch.cut(direct_orphans(ends, states))
    return cascade_orphans(flat, direct)
