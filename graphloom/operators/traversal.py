"""Trails, neighbourhoods and shortest paths. A trail takes no edge twice; nodes may come again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .graph import MIN_VIEW, all_edges, seen_name, undirected


def _numbered(edges: DataFrame) -> DataFrame:
    """edges with an id by content: equal edges are one."""
    return edges.dropDuplicates(["src", "rel_type", "dst"]).withColumn("edge", F.xxhash64("src", "rel_type", "dst"))


def neighbours(entities: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(name, type, distance) of the entities at the end of directed trails; one may be at several distances.

    Trails over the same edges to the same node are one, and the last step needs no trail."""
    steps = _numbered(edges).select("src", "dst", "edge")
    at = steps.where(F.col("src") == name).select(F.col("dst").alias("node"), F.array("edge").alias("trail"))
    found = at.select("node", F.lit(1).alias("distance"))
    for d in range(2, depth + 1):
        at = at.join(steps.withColumnRenamed("src", "node"), "node").where(~F.array_contains("trail", F.col("edge"))).select(F.col("dst").alias("node"), F.array_sort(F.concat("trail", F.array("edge"))).alias("trail"))
        at = at.distinct() if d < depth else at.select("node").distinct()
        found = found.unionByName(at.select("node", F.lit(d).alias("distance")))
    kinds = entities.select(F.col("name").alias("node"), "type")
    return found.distinct().join(kinds, "node").select(F.col("node").alias("name"), "type", "distance").orderBy("distance", "name")


def neighbourhood(entities: DataFrame, edges: DataFrame, name: str, depth: int = 1, limit: int = 100, min_confidence: float = MIN_VIEW, mentions: DataFrame | None = None) -> DataFrame:
    """The edges of the first `limit` undirected trails to entities that views show; both ends of an edge must be certain.

    With mentions, trails also lead over documents that two entities share; documents have no confidence and aren't shown."""
    if not 1 <= depth <= 3:
        raise ValueError("a neighbourhood has a depth from 1 to 3")
    ids = _numbered(edges if mentions is None else all_edges(edges, mentions))
    both = undirected(ids.select("src", "dst", "edge")).select("a", "b", "edge")
    certain = entities.where(F.col("confidence") >= min_confidence)
    ends = certain.where(seen_name(F.col("name"))).select(F.col("name").alias("node"))
    at = both.where(F.col("a") == name).select(F.col("b").alias("node"), F.array("edge").alias("trail"))
    found = at
    for _ in range(1, depth):
        # shorter trails come first: where they are enough, longer ones aren't looked for
        if found.join(ends, "node", "left_semi").limit(limit).count() >= limit:
            break
        at = at.join(both.withColumnRenamed("a", "node"), "node").where(~F.array_contains("trail", F.col("edge"))).select(F.col("b").alias("node"), F.concat("trail", F.array("edge")).alias("trail"))
        found = found.unionByName(at)
    # of trails with the same end, in the order of their edges
    trails = found.join(ends, "node", "left_semi").orderBy(F.size("trail"), "node", "trail").limit(limit)
    used = trails.select(F.explode("trail").alias("edge")).distinct()
    known = certain.select(F.col("name").alias("n"))
    out = ids.join(used, "edge", "left_semi")
    for end in ("src", "dst"):
        out = out.join(known.withColumnRenamed("n", end), end, "left_semi")
    return out.select("src", "rel_type", "dst", "confidence")


def _steps(edges: DataFrame) -> DataFrame:
    """(a, rel_type, b): each edge from both ends, as a written table."""
    return written(undirected(edges.select("src", "rel_type", "dst")).select("a", "rel_type", "b"), "steps")


def _fronts(both: DataFrame, start: str, max_depth: int, goal: str | None) -> list[DataFrame]:
    """The nodes met at each distance from the start, as far as max_depth or until the goal is met: (node, parent, rel_type),
    of several ways back the least. A front is a written table; only its size and whether it holds the goal reach the driver."""
    spark = both.sparkSession
    none = F.lit(None).cast("string")
    fronts = [spark.range(1).select(F.lit(start).alias("node"), none.alias("parent"), none.alias("rel_type"))]
    for _ in range(max_depth):
        back = fronts[-1].select(F.col("node").alias("b"))
        new = both.join(back, "b").groupBy("a").agg(F.min(F.struct("b", "rel_type")).alias("way"))
        for seen in fronts[-2:]:  # a neighbour of this front lies in the one before, this one, or the next
            new = new.join(seen.select(F.col("node").alias("a")), "a", "left_anti")
        fronts.append(written(new.select(F.col("a").alias("node"), F.col("way.b").alias("parent"), F.col("way.rel_type").alias("rel_type")), "front"))
        met = fronts[-1].agg(F.count("*").alias("n"), F.max(F.col("node") == F.lit(goal)).alias("goal")).first()
        if not met["n"] or met["goal"]:
            break
    return fronts


def reached(edges: DataFrame, start: str, max_depth: int, goal: str | None = None) -> DataFrame:
    """(node, distance) over undirected edges, breadth first, as far as max_depth or until the goal is met."""
    out = None
    for d, front in enumerate(_fronts(_steps(edges), start, max_depth, goal)):
        rows = front.select("node", F.lit(d).alias("distance"))
        out = rows if out is None else out.unionByName(rows)
    return out


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 5, mentions: DataFrame | None = None) -> DataFrame:
    """(hop, source, rel_type, target) of one shortest undirected path, the least by names and types; none: no rows.

    Breadth first from the goal until the start is met; each node knows its least way back, so the path is read off front by
    front, in one join of single rows. With mentions, a path may lead over documents."""
    if not 1 <= max_depth <= 10:
        raise ValueError("a path has from 1 to 10 hops")
    both = _steps(edges if mentions is None else all_edges(edges, mentions))
    fronts = _fronts(both, goal, max_depth if start != goal else 0, start)
    at = fronts[-1].where(F.col("node") == start).select(F.lit(1).alias("hop"), F.col("node").alias("source"), "rel_type", F.col("parent").alias("target"))
    path = at
    for hop, front in enumerate(reversed(fronts[1:-1]), 2):
        at = front.join(F.broadcast(at.select(F.col("target").alias("node"))), "node").select(F.lit(hop).alias("hop"), F.col("node").alias("source"), "rel_type", F.col("parent").alias("target"))
        path = path.unionByName(at)
    return path.where(F.lit(start != goal))
