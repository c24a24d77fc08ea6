"""Ordered scans that no single key can serialise.

`Window.partitionBy(ifo).orderBy(gps)` sends one detector to one task. Here the
rows are range-partitioned on `(keys, order)` instead, so a hot key is spread
over as many slabs as its size asks for, each slab is scanned on its own, and
what one slab hands to the next travels in a table with at most one row per
slab boundary -- small whatever the data, and therefore safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberscan.session import cut_lineage, shuffle_partitions

SLAB = "_slab"
# Rows a slab is sorted with, where the rows were counted: more of them make more slabs, and a task's memory stays.
SLAB_ROWS = 1 << 19


def slabs_for(spark: SparkSession, rows: int) -> int:
    """How many slabs so many rows ask for; never fewer than there are shuffle partitions."""
    return max(shuffle_partitions(spark), -(-rows // SLAB_ROWS))


def range_slabs(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                slabs: int | None = None) -> DataFrame:
    """`df` with a `_slab` number that grows with `(keys, order)`.

    The slabs come from Spark's own sampled range partitioner, which may split
    differently if the plan runs twice. The result is therefore written once and
    read from there.
    """
    count = slabs or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(count, *keys, *order)
    return cut_lineage(ranged.withColumn(SLAB, F.spark_partition_id()))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    running_max: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    slabs: int | None = None,
) -> DataFrame:
    """Running aggregates over each key in `order`, which must be a total order.

    :param sums: `{output: input}`, sum over the rows up to and including this one.
    :param running_max: `{output: input}`, maximum over the rows *before* this one.
    :param previous: `{output: input}`, last non-null at or before this row.
    :param following: `{output: input}`, first non-null at or after this row.
    """
    base = range_slabs(df, keys, order, slabs)
    return scan_slabs(base, keys, order, sums, running_max, previous, following, slabs).drop(SLAB)


def scan_slabs(
    base: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    running_max: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    slabs: int | None = None,
) -> DataFrame:
    """`prefix_scan` over rows that already carry their slab, which is kept.

    :param slabs: how many slabs there are, if they are more than the shuffle partitions.
    """
    sums, running_max = dict(sums or {}), dict(running_max or {})
    previous, following = dict(previous or {}), dict(following or {})
    keys, order = list(keys), list(order)

    inside = Window.partitionBy(SLAB, *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # A frame that ends at the partition's end is recomputed for every row, so
    # looking ahead is looking back over the reversed order.
    ahead = Window.partitionBy(SLAB, *keys).orderBy(*[F.desc(c) for c in order])
    after = ahead.rowsBetween(Window.unboundedPreceding, 0)

    local: dict[str, Column] = {}
    for out, col in sums.items():
        local[out] = F.sum(col).over(upto)
    for out, col in running_max.items():
        local[out] = F.max(col).over(before)
    for out, col in previous.items():
        local[out] = F.last(col, ignorenulls=True).over(upto)
    for out, col in following.items():
        local[out] = F.last(col, ignorenulls=True).over(after)
    # The default number of partitions would put several slabs into one sort.
    spread = base.repartition(slabs, SLAB, *keys) if slabs and slabs > shuffle_partitions(base.sparkSession) else base
    scanned = spread.select("*", *[expr.alias(f"_in_{out}") for out, expr in local.items()])

    place = F.struct(*order)
    totals = []
    for out, col in sums.items():
        totals.append(F.sum(col).alias(out))
    for out, col in running_max.items():
        totals.append(F.max(col).alias(out))
    for out, col in previous.items():
        totals.append(F.max(F.when(F.col(col).isNotNull(), F.struct(place.alias("at"), F.col(col).alias("is")))).alias(out))
    for out, col in following.items():
        totals.append(F.min(F.when(F.col(col).isNotNull(), F.struct(place.alias("at"), F.col(col).alias("is")))).alias(out))
    per_slab = base.groupBy(SLAB, *keys).agg(*totals)

    across = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = across.orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    later = across.orderBy(F.desc(SLAB)).rowsBetween(Window.unboundedPreceding, -1)
    carried: dict[str, Column] = {}
    for out in sums:
        carried[out] = F.sum(out).over(earlier)
    for out in running_max:
        carried[out] = F.max(out).over(earlier)
    for out in previous:
        carried[out] = F.last(out, ignorenulls=True).over(earlier).getField("is")
    for out in following:
        carried[out] = F.last(out, ignorenulls=True).over(later).getField("is")
    carry = per_slab.select(
        F.col(SLAB), *keys, *[expr.alias(f"_from_{out}") for out, expr in carried.items()]
    )
    # Only a key cut by a slab boundary has anything to carry, and a boundary
    # cuts one key: fewer rows than twice the slabs.
    any_carry = F.lit(False)
    for out in carried:
        any_carry = any_carry | F.col(f"_from_{out}").isNotNull()
    carry = carry.where(any_carry)

    joined = scanned.join(F.broadcast(carry), on=[SLAB, *keys], how="left")
    outputs = []
    for out in sums:
        outputs.append((F.col(f"_in_{out}") + F.coalesce(F.col(f"_from_{out}"), F.lit(0))).alias(out))
    for out in running_max:
        outputs.append(F.greatest(f"_in_{out}", f"_from_{out}").alias(out))
    for out in [*previous, *following]:
        outputs.append(F.coalesce(f"_in_{out}", f"_from_{out}").alias(out))
    return joined.select(*[F.col(c) for c in base.columns], *outputs)


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str,
            gap: Column | float = 0.0, label: str = "island") -> DataFrame:
    """Label chains of intervals no further apart than `gap`.

    A row opens an island when it starts more than `gap` after everything before
    it has ended. The label counts those openings within the key, from zero.
    """
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    order = [start, row_id]
    seen = scan_slabs(range_slabs(df, keys, order), keys, order, running_max={"_reach": end})
    opened = seen.withColumn(
        "_opens", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), 1).otherwise(0)
    )
    labelled = scan_slabs(opened, keys, order, sums={"_nth": "_opens"})
    return labelled.withColumn(label, (F.col("_nth") - 1).cast("long")).drop(SLAB, "_reach", "_opens", "_nth")


def ranked_positions(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None,
                     descending: bool = False) -> DataFrame:
    """Distinct values per key with how many rows carry them and how many rank up to them.

    Ties are collapsed before anything is shuffled for the order, so a value
    held by a third of the rows is one row here.
    """
    counted = df.groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n")
    )
    side = -F.col(value) if descending else F.col(value)
    ranked = prefix_scan(counted.withColumn("_rank_by", side), keys, ["_rank_by"], sums={"n_upto": "n"})
    return ranked.drop("_rank_by")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float],
                    output: str = "quantile_value") -> DataFrame:
    """Linearly interpolated quantiles per key, one row per key and quantile.

    Exact, and without one task holding a group: the order statistics are read
    off the ranked distinct values.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = ranked_positions(clean, keys, value)
    totals = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in quantiles])
    placed = lookup_join(ranked, totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    hits = (
        placed.select("*", F.explode(wanted).alias("_w"))
        .withColumn("q", F.col("_w.q"))
        .withColumn("_pos", F.col("q") * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_pos") + 1)
        .withColumn("_hi", F.least(F.floor("_pos") + 2, F.col("_total")))
        .withColumn("_first", F.col("n_upto") - F.col("n") + 1)
    )
    holds = lambda at: (F.col("_first") <= F.col(at)) & (F.col(at) <= F.col("n_upto"))
    picked = hits.where(holds("_lo") | holds("_hi")).groupBy(*keys, "q", "_pos").agg(
        F.max(F.when(holds("_lo"), F.col(value))).alias("_a"),
        F.max(F.when(holds("_hi"), F.col(value))).alias("_b"),
    )
    share = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias(output))


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join rows to a per-key table without letting a hot key land in one task.

    A table that was just aggregated by the key is already partitioned by it,
    and Spark then joins without shuffling it, which leaves adaptive execution
    nothing to split. Hiding the partitioning behind an expression makes both
    sides plain shuffles, so a skewed key is split when the sizes are known.
    """
    on = [on] if isinstance(on, str) else list(on)
    hidden = small.select(*[
        F.element_at(F.array(F.col(c)), 1).alias(c) if c in on else F.col(c) for c in small.columns
    ])
    return big.join(hidden, on=on, how=how)


def attach(big: DataFrame, small: DataFrame, on: Sequence[str] | str, max_rows: int, how: str = "inner") -> DataFrame:
    """Join a table that is expected to be small, by broadcast only once it has been seen to be.

    `small` is counted, at most one row past `max_rows`, so pass it written out.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on=on, how=how)
    return lookup_join(big, small, on, how)
