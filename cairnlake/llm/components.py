"""Consolidating pairwise matches into groups: peel the giant component, then minimum propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges with whether their ends, ia and ib, are in the frontier."""
    on = lambda end: frontier.select(F.col("v").alias(end), F.lit(True).alias(f"i{end}"))
    return edges.join(on("a"), "a", "left").join(on("b"), "b", "left").select("a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib"))


def peel(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, str | None]:
    """Take the component of the highest-degree vertex out by breadth-first frontier joins.

    Returns the vertices reached, the edges left, and the least vertex reached. The hub's own edges, which may be a third
    of all, are met by filters and never shuffled by the hub. Every round splits the edges that are left into those that
    touch the frontier, whose other ends are the next one, and the rest, which is all the next round reads: an edge is
    done with as soon as it is touched, so what is left has no end among the vertices reached and the anti-join comes
    with the split. If the frontier isn't exhausted after ``rounds`` joins (a long chain hangs on the component), the
    reached part is contracted to its least vertex in the edges that cross its border, so the propagation that follows
    stays exact.
    """
    spark = edges.sparkSession
    top = _both_ways(edges).groupBy("a").count().agg(F.max(F.struct("count", "a")).alias("t")).first()["t"]
    if top is None:
        return spark.createDataFrame([], "v string"), edges, None
    hub = top["a"]
    rest = edges.where((F.col("a") != hub) & (F.col("b") != hub))
    frontier = cut(edges.where((F.col("a") == hub) | (F.col("b") == hub)).select(F.when(F.col("a") == hub, F.col("b")).otherwise(F.col("a")).alias("v")))
    reached = frontier.union(spark.createDataFrame([(hub,)], "v string"))
    for _ in range(rounds):
        split = cut(_touching(rest, frontier))
        rest = split.where(~F.col("ia") & ~F.col("ib")).select("a", "b")
        frontier = cut(split.where(F.col("ia") != F.col("ib")).select(F.when(F.col("ia"), F.col("b")).otherwise(F.col("a")).alias("v")).distinct())
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    reached = cut(reached)
    least = reached.agg(F.min("v")).first()[0]
    if frontier.isEmpty():
        return reached, rest, least
    border = _touching(rest, frontier).where(~(F.col("ia") & F.col("ib")))
    ends = [F.when(F.col(f"i{c}"), F.lit(least)).otherwise(F.col(c)) for c in "ab"]
    return reached, border.select(*_ordered(*ends)).distinct(), least


def _to_roots(point: DataFrame) -> DataFrame:
    """Follow pointers (v, root) to their ends by doubling: as many joins as the logarithm of the longest path, and one."""
    point = cut(point)
    while True:
        on = point.select(F.col("v").alias("root"), F.col("root").alias("_next"))
        point = cut(point.select("v", "root").join(on, "root").select("v", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        if point.where("moved").isEmpty():
            return point.select("v", "root")


def propagate(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges, root the least vertex of its component.

    Each round points every vertex to the least of itself and its neighbours, follows the pointers to their ends,
    replaces the ends of all edges by what they point to and drops loops and repeats. Only local minima survive, at
    most half of the vertices, so rounds and joins grow with the logarithm of the longest chain, in whatever order its
    keys stand. Aggregates are combined on the map side; each step is cut by a table in the shared folder.
    """
    steps: list[DataFrame] = []
    edges = cut(edges)
    while not edges.isEmpty():
        point = _to_roots(_both_ways(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")))
        steps.append(point)
        ends = edges.join(point.select(F.col("v").alias("a"), F.col("root").alias("_ra")), "a").join(point.select(F.col("v").alias("b"), F.col("root").alias("_rb")), "b")
        edges = cut(ends.where("_ra <> _rb").select(*_ordered(F.col("_ra"), F.col("_rb"))).distinct())
    if not steps:
        return edges.sparkSession.createDataFrame([], "v string, root string")
    out = steps[0]
    for later in steps[1:]:
        out = out.join(later.select(F.col("v").alias("root"), F.col("root").alias("_next")), "root", "left").select("v", F.coalesce("_next", "root").alias("root"))
    return out


def linked_groups(pairs: DataFrame, a: str, b: str, rounds: int = 8) -> DataFrame:
    """(v, root): one row per vertex with at least one link to another vertex, root the least vertex linked directly or indirectly.

    Pairs may be repeated, in either order, or join a vertex to itself (no link); a pair with a null end is dropped;
    an empty table gives no rows. Vertices are strings.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    edges = cut(pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(*_ordered(x, y)).distinct())
    reached, left, least = peel(edges, rounds)
    small = propagate(left)
    if least is None:
        return small
    root = small.where(F.col("v") == least).select("root").first()  # the contracted part may belong to a lesser vertex
    top = F.lit(root[0] if root else least)
    return reached.select("v", top.alias("root")).unionByName(small.join(reached, "v", "left_anti"))
