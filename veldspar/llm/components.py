"""Connected components of an edge table, by alternating star contractions.

Every round is two joins of the edges with each node's least neighbour.  The rounds
are written to the shared folder, so that a lost executor costs one round, and the
number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adaptive, forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them: those above it, or those below."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u")
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    edges: pairs of comparable non-null values in columns a and b; order, repeats and
    loops don't matter.  No edge gives no row.
    """
    spark = edges.sparkSession
    adaptive(spark)  # a component's root has as many edges as the component nodes
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, path = stored(now, "edges")
    mark = None
    while True:
        after, new_path = stored(_star(_star(now, True), False), "edges")
        forget(spark, path)
        now, path = after, new_path
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(said) == mark:
            break
        mark = tuple(said)
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
