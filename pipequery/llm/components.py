"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its smallest node.

    Each round moves every node's links to the smallest of its neighbours and is written to the
    shared folder, so no lineage grows. Nodes without an edge aren't in the result; an empty edge
    table gives an empty one. Self-links and nulls are left out.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = materialize(now, "cc")
    for _ in range(max_rounds):
        if _is_forest_of_stars(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        now = materialize(small, "cc")
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each node hangs from one smaller node that hangs from none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return held.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0
