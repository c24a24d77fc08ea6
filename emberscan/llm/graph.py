"""Connected components by contraction, with every step a join of two written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.store import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow parents to their roots, doubling the distance each time."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        further = written(parents.join(up, "p", "left").select(
            "v", F.coalesce("pp", "p").alias("p"), F.coalesce(F.col("pp") < F.col("p"), F.lit(False)).alias("moved")), "parents")
        moved = not further.where("moved").isEmpty()
        parents = further.select("v", "p")
        if not moved:
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`v, component` for every vertex on an edge; the component is its least vertex.

    Each round every vertex takes its least neighbour as parent (combined before the shuffle), parents are followed to
    their roots, and edges are renamed and made distinct, until none is left. A vertex with a third of the edges is met
    only in joins of two written tables, which adaptive execution splits. NULL ends and loops are no edges; without
    edges the result is empty.
    """
    x, y = F.col(a), F.col(b)
    rest = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    labels: DataFrame | None = None
    while not rest.isEmpty():
        # The larger end of an edge has a smaller neighbour; parents therefore only go down, and there are no cycles.
        parents = _jumped(written(rest.groupBy("u").agg(F.min("v").alias("p")).withColumnRenamed("u", "v"), "parents"))
        up = parents.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        half = rest.join(up, "u", "left").select(F.coalesce("pu", "u").alias("u"), "v")
        side = parents.select("v", F.col("p").alias("pv"))
        both = half.join(side, "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        rest = written(both.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if labels is None:
            labels = parents
        else:
            # Vertices that were roots so far may have parents now.
            step = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
            old = labels.join(step, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
            new = parents.join(labels.select("v"), "v", "left_anti")
            labels = written(old.unionByName(new), "labels")
    if labels is None:
        return rest.select("v", F.col("v").alias("component"))
    roots = labels.select(F.col("p").alias("v")).distinct().withColumn("component", F.col("v"))
    return labels.select("v", F.col("p").alias("component")).unionByName(roots)
