"""Connected components of a graph given by its edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) of every node that an edge names; component is the least node of its component.

    Each round links every node to the least neighbour of its group (large star), then every group to
    its least member (small star), so that the edge set becomes a forest of stars after about log n
    rounds. The edges of a round are written to the shared folder, which cuts the lineage. Null
    ends are ignored, a node alone with itself is its own component, no edges give no rows.
    """
    kept = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    current = written(kept.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        both = current.where("u <> v").select("u", "v").unionByName(current.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("w")).where("u <> w").select("u", F.col("w").alias("v"))
        stars = low.select(F.col("m").alias("u"), "v")
        loops = current.where("u = v")
        following = written(stars.unionByName(small).unionByName(loops).distinct())
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        current = following
        if tuple(now) == sign:
            break
        sign = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    tails = current.where("u <> v").groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    heads = current.join(tails, current.u == tails.node, "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return tails.unionByName(heads)
