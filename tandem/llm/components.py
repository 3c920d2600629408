"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a ``min`` per vertex (combined before the shuffle) and a join, so
a vertex with very many neighbours is never gathered in one task; each round is
landed. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tandem.llm.tables import land


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: link each vertex's larger (or smaller) neighbours to its least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        pairs = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pairs = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b); the component is its least vertex.

    Self-loops, repeated and reversed edges and nulls are allowed (the latter
    link nothing); no edges give no rows. A round is one job: both steps, the
    landing, and the count and checksum that tell whether anything changed.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        seen = Observation()
        e = land(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "cc_edges")
        now = seen.get["n"], seen.get["h"]
        if now == before or not now[0]:
            break
        before = now
        e = _star(_star(e, large=True), large=False)
    stars = e.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())


def component_of(component: DataFrame, df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the component of the vertex in ``col``; a vertex without edges is its own."""
    named = component.select(F.col("vertex").alias(col), F.col("component").alias(out))
    return df.join(named, col, "left").withColumn(out, F.coalesce(out, col))


def merge_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after further edges (a, b): only the edges between components are worked on."""
    between = component_of(component, component_of(component, edges, "a", "ca"), "b", "cb")
    moved = land(connected_components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "cc_moved")
    old = component.join(moved.select(F.col("vertex").alias("component"), F.col("component").alias("to")), "component", "left")
    old = old.select("vertex", F.coalesce("to", "component").alias("component"))
    return land(old.unionByName(moved.join(component, "vertex", "left_anti").select("vertex", "component")), "cc_merged")
