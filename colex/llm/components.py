"""Connected components over an edge table, by alternating large-star and small-star steps.

Both steps are a group minimum and a join, so a node with very many edges is a partial
aggregate and a skewed join, never a list in one task.  Of large tables the minima are written
before the join, so that Spark may split the join's side of such a node.  Each round is written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

MOST_ROUNDS = 60
#: Edges from which on minima are written; below, a node's edges are few enough for one task.
MANY = 1_000_000


def connect(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): component is the least node it reaches.

    Large-star hangs a node's larger neighbours on its least neighbour, small-star does so
    with the smaller ones; the edges converge to stars around the least nodes.  Nulls and
    loops are no edges; an empty table has no nodes.
    """
    a, b = edges.columns[:2]
    # from here on each edge is (u, v) with u > v
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    before = None
    large_table = now.count() > MANY
    least_of = (lambda df: materialise(df, "components-least")) if large_table else (lambda df: df)
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        low = least_of(low)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        least = least_of(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(least, "u")
        stars = small.select("u", F.col("low").alias("v")).union(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
        last, now = now, materialise(stars.distinct(), "components")
        discard(last, *([low, least] if large_table else []))
        # stars iff no centre has an edge to something smaller; sums tell when nothing moves
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
