"""Walks over the symbol graph.

What a walk under a budget admits is bounded by the budget, so its order is kept on the driver; each step asks the stored edges, which lie sorted by
src, for the neighbours of the nodes at hand. Paths have no such bound, so their frontiers become tables once they are large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.operators.graph import KINDS
from symloom.operators.ids import dense_ids
from symloom.shared import stored

NODE_COST = 80
_SEQ = ["kind_rank", "row_id", "top_id"]
#: Nodes that a path search may keep on the driver.
ON_DRIVER = 20_000
#: Nodes up to which a frontier goes into the scan's filter.
IN_LIST = 1000
#: Nodes up to which a frontier goes to every task rather than the edges to it.
BROADCAST = 500_000


@dataclass
class Walk:
    """nodes: ids in order of admission, seeds first; edges: (a, b, kind) with a < b."""

    nodes: list[int]
    seeds: int
    edges: DataFrame
    used: int


def _from(edges: DataFrame, frontier: list[int]) -> DataFrame:
    """Edges that leave the frontier with the place (pos) of their src in it."""
    spark = edges.sparkSession
    table = spark.createDataFrame(list(enumerate(frontier)), "pos bigint, src bigint")
    near = edges.where(F.col("src").isin(frontier)) if len(frontier) <= IN_LIST else edges
    return near.join(F.broadcast(table), "src")  # as many rows as the budget admits at most


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind")


def _new(out: DataFrame, visited: list[int], most: int) -> list:
    """The first so many unvisited neighbours by where they first occur."""
    seen = out.sparkSession.createDataFrame([(v,) for v in visited], "dst bigint")
    fresh = out.join(F.broadcast(seen), "dst", "left_anti")
    return fresh.groupBy("dst").agg(F.min(F.struct("pos", *_SEQ)).alias("at")).orderBy("at", "dst").limit(most).collect()


def _upto(out: DataFrame, at) -> DataFrame:
    return out.where(F.struct("pos", *_SEQ) <= F.struct(*[F.lit(at[c]).cast(t) for c, t in zip(["pos", *_SEQ], ["bigint", "int", "bigint", "bigint"])]))


def breadth_first(edges: DataFrame, seeds: list[int], budget: int) -> Walk:
    """Level by level; seeds are always in, others as long as each costs NODE_COST within the budget. Edges count as met until the budget ends the walk,
    the edge to the node that didn't fit included."""
    seeds = list(dict.fromkeys(seeds))
    nodes, frontier, met = list(seeds), list(seeds), []
    while frontier:
        room = budget // NODE_COST - len(nodes)
        if room < 1:
            break
        out = _from(edges, frontier)
        new = _new(out, nodes, room + 1)
        if len(new) < room:
            met.append(_undirected(out))
        else:
            last = new[room - 1].at
            ends = out.where(F.col("pos") <= last.pos)
            met.append(_undirected(_upto(ends, new[room].at) if len(new) > room and new[room].at.pos == last.pos else ends))
            new = new[:room]
        frontier = [r.dst for r in new]
        nodes += frontier
    return Walk(nodes, len(seeds), _union(edges, met), NODE_COST * len(nodes))


def depth_first(edges: DataFrame, seeds: list[int], budget: int) -> Walk:
    """The last found node first; nodes are marked when they are found. One lookup for each node that is taken up, as many as the budget admits."""
    seeds = list(dict.fromkeys(seeds))
    nodes, stack, met = list(seeds), list(seeds), []
    while stack and budget // NODE_COST - len(nodes) >= 1:
        room = budget // NODE_COST - len(nodes)
        out = _from(edges, [stack.pop()])
        new = _new(out, nodes, room + 1)
        met.append(_undirected(_upto(out, new[room].at) if len(new) > room else out))
        nodes += [r.dst for r in new[:room]]
        stack += [r.dst for r in new[:room]]
    return Walk(nodes, len(seeds), _union(edges, met), NODE_COST * len(nodes))


def _union(edges: DataFrame, met: list[DataFrame]) -> DataFrame:
    out = _undirected(edges.limit(0))
    for x in met:
        out = out.unionAll(x)
    return out.dropDuplicates()


def shortest_path(edges: DataFrame, symbols: DataFrame, start: int, goal: int, most_hops: int | None = None, on_driver: int = ON_DRIVER) -> list[tuple[int, str | None]] | None:
    """[(node, kind of the edge that leads to it)], None if either is unknown or no path leads there. Of shortest paths, the one that a breadth-first walk finds first.

    As long as the nodes met are few, their order is kept on the driver and a level is one job. Beyond on_driver nodes the search goes over tables in the shared
    folder, whatever their size, from both ends.
    """
    known = {r.id for r in symbols.where(F.col("id").isin([start, goal])).select("id").distinct().collect()}
    if {start, goal} - known:
        return None
    if start == goal:
        return [(start, None)]
    before: dict[int, tuple[int, str] | None] = {start: None}
    frontier, hops = [start], 0
    while frontier and (most_hops is None or hops < most_hops):
        hops += 1
        new = _new(_from(edges, frontier), list(before), on_driver + 1)
        if len(before) + len(new) > on_driver:
            return _path_over_tables(edges, start, goal, most_hops)
        for r in new:
            before[r.dst] = (frontier[r.at.pos], KINDS[r.at.kind_rank])
        if goal in before:
            trail, node = [], goal
            while before[node]:
                trail.append((node, before[node][1]))
                node = before[node][0]
            return [(start, None), *reversed(trail)]
        frontier = [r.dst for r in new]
    return None


def _path_over_tables(edges: DataFrame, start: int, goal: int, most_hops: int | None) -> list[tuple[int, str | None]] | None:
    """From both ends, always on from that with the smaller last level, so that a goal that little leads to costs little. What lies on some shortest path is
    then put in order from the start: what leads to a node of these is one of them, so ties fall as they would among all nodes."""
    spark = edges.sparkSession
    one = lambda i: spark.createDataFrame([(i,)], "node bigint")
    ahead, behind = [(one(start), 1)], [(one(goal), 1)]
    while True:
        if most_hops is not None and len(ahead) + len(behind) - 2 >= most_hops:
            return None
        side, other = (ahead, behind) if (ahead[-1][1], len(ahead)) <= (behind[-1][1], len(behind)) else (behind, ahead)
        new = _neighbours(edges, *side[-1])
        for level, _ in side[-2:]:  # edges go both ways, so neighbours lie no further back
            new = new.join(level, "node", "left_anti")
        new = stored(new, "level")
        if not (n := new.count()):
            return None
        side.append((new, n))
        met = stored(new.join(other[-1][0], "node", "left_semi"), "met")
        if n := met.count():
            break
    on, at = {len(ahead) - 1: (met, n)}, len(ahead) - 1
    hops = at + len(behind) - 1
    for i, of in [*((i, at) for i in range(at - 1, 0, -1)), *((i, at) for i in range(at + 1, hops))]:
        level = ahead[i][0] if i < at else behind[hops - i][0]
        beside = stored(level.join(_neighbours(edges, *on[i + 1 if i < at else i - 1]), "node", "left_semi"), "on")
        on[i] = (beside, beside.count())
    on[0], on[hops] = ahead[0], behind[0]
    frontier, n, levels = on[0][0].withColumn("pos", F.lit(0).cast("bigint")), 1, []
    for i in range(1, hops + 1):
        out = _leaving(edges, frontier.withColumnRenamed("node", "src"), n)
        fresh = out.join(_small(on[i][0].withColumnRenamed("node", "dst"), on[i][1]), "dst", "left_semi")
        first = fresh.groupBy("dst").agg(F.min(F.struct("pos", *_SEQ, F.col("src").alias("prev"), "kind")).alias("at"))
        ranked = first.select(F.col("dst").alias("node"), F.col("at.prev").alias("prev"), F.col("at.kind").alias("kind"), F.col("at.pos").alias("p"), *[F.col(f"at.{c}").alias(c) for c in _SEQ])
        level = stored(dense_ids(ranked, ["p", *_SEQ, "node"], "pos", 0).select("node", "pos", "prev", "kind"), "level")
        levels.append(level)
        frontier, n = level.select("node", "pos"), on[i][1]
    trail, node = [], goal
    for level in reversed(levels):
        r = level.where(F.col("node") == node).first()
        trail.append((node, r.kind))
        node = r.prev
    return [(node, None), *reversed(trail)]


def _small(table: DataFrame, n: int) -> DataFrame:
    """A table of n rows of a few numbers, sent to every task where it is small."""
    return F.broadcast(table) if n <= BROADCAST else table


def _leaving(edges: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    """Edges from the n nodes of a frontier (src, ...)."""
    near = edges
    if n <= IN_LIST:
        near = edges.where(F.col("src").isin([r.src for r in frontier.select("src").collect()]))
    return near.join(_small(frontier, n), "src")


def _neighbours(edges: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    return _leaving(edges.select("src", "dst"), frontier.withColumnRenamed("node", "src"), n).select(F.col("dst").alias("node")).distinct()


def distances(edges: DataFrame, start: int, most_hops: int) -> DataFrame:
    """Rows (node, distance) of all nodes within so many hops; each level is a table in the shared folder."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start,)], "node bigint")
    out = frontier.withColumn("distance", F.lit(0))
    n = 1
    for hop in range(1, most_hops + 1):
        frontier = stored(_neighbours(edges, frontier, n).join(out.select("node"), "node", "left_anti"), "hop")
        n = frontier.count()
        out = out.unionAll(frontier.withColumn("distance", F.lit(hop)))
    return out
