"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscan.session import cut_lineage, ship_package

# A vertex with more than this share of the edges is a hub. There can be no
# more hubs than twice the inverse of the share, which bounds what is broadcast.
HUB_SHARE = 1e-4
# Fewer rows than this meet in one task without harm.
HUB_ROWS = 10_000
# Edges a task contracts at a time, and the links it keeps before it hands them on.
FOREST_EDGES, FOREST_LINKS = 1 << 20, 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(vertex, least)` for every vertex that is not itself the least one it is connected to by these edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    least = np.arange(len(ids))
    while True:
        a, b = least[a], least[b]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := least[least], least):
            least = jumped
    linked = np.flatnonzero(least != np.arange(len(ids)))
    return ids[linked], ids[least[linked]]


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what the given ones do, at most one per vertex for as long as the links fit."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    links = waiting = 0
    batch_of = lambda pair: pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])
    for batch in batches:
        kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        waiting += batch.num_rows
        if waiting < FOREST_EDGES:
            continue
        found = _forest(*(np.concatenate(side) for side in zip(*kept)))
        kept, links, waiting = [found], len(found[0]), 0
        if links >= FOREST_LINKS:
            yield batch_of(found)
            kept = []
    if kept:
        yield batch_of(_forest(*(np.concatenate(side) for side in zip(*kept))))


def spanning_edges(edges: DataFrame) -> DataFrame:
    """`edges (u, v)` without those that close a circle inside their task: the same components from far fewer rows.

    Pairs of close rows number their count times their density, but a task needs no more of them than it has vertices.
    Nothing is shuffled for this, and a task holds a bounded number of links. Only whole-number vertices are contracted.
    """
    if any(not isinstance(edges.schema[c].dataType, T.LongType) for c in ("u", "v")):
        return edges
    ship_package(edges.sparkSession)
    return edges.mapInArrow(_spanned, "u long, v long")


def _minimum_of_neighbours(edges: DataFrame, total: int) -> DataFrame:
    """`edges (u, v)` with `m`, the least vertex among `u` and its neighbours.

    The minimum is combined before the shuffle. Handing it back is a join on
    `u`; a hub's rows would all meet in one task there, so hubs -- a bounded
    number of them -- get theirs by broadcast and stay where they are.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
    if total <= HUB_ROWS:
        return edges.join(least.select("u", "m"), on="u")
    hubs = F.broadcast(least.where(F.col("deg") > max(total * HUB_SHARE, HUB_ROWS)).select("u", F.col("m").alias("_hub_m")))
    marked = edges.join(hubs, on="u", how="left")
    plain = marked.where(F.col("_hub_m").isNull()).drop("_hub_m").join(least.select("u", "m"), on="u")
    hub = marked.where(F.col("_hub_m").isNotNull()).select("u", "v", F.col("_hub_m").alias("m"))
    return plain.select("u", "v", "m").unionByName(hub)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def component_labels(edges: DataFrame, source: str = "src", target: str = "dst",
                     output: str = "component") -> DataFrame:
    """`(vertex, component)` for every vertex on an edge; the label is the least vertex.

    Alternates the two star operations of Kiveris et al. (2014): first every
    vertex hands its larger neighbours the least of its neighbourhood, then
    every vertex does so with its smaller ones, until only stars remain. The
    number of rounds grows with the logarithm of the vertices. Each round is
    written to the checkpoint folder, so a lost executor costs one round. Every
    task first drops the edges that its others make needless.
    """
    a, b = F.col(source), F.col(target)
    plain = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    stars = cut_lineage(spanning_edges(plain).distinct())
    state = _signature(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _minimum_of_neighbours(both, 2 * state[0])
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = cut_lineage(large)
        down = _minimum_of_neighbours(large, state[0])
        small = (
            down.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        stars = cut_lineage(small)
        after = _signature(stars)
        if after == state:
            break
        state = after
    roots = stars.select(F.col("v").alias("vertex")).distinct().withColumn(output, F.col("vertex"))
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias(output)).unionByName(roots)


def label_rows(rows: DataFrame, edges: DataFrame, row_id: str, source: str = "src", target: str = "dst",
               output: str = "component") -> DataFrame:
    """`rows` with their component; a row on no edge is its own."""
    labels = component_labels(edges, source, target, output).withColumnRenamed("vertex", row_id)
    return rows.join(labels, on=row_id, how="left").withColumn(output, F.coalesce(F.col(output), F.col(row_id)))
