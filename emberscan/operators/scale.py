"""The cross-scale statistic: every tile judged at every window length that reaches its band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.operators.rangejoin import as_of


def scale_maximum(tiles: DataFrame, tile_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """`s_max, scale_best, n_scales, s_ratio` per tile, from its own `significance` and that of the others.

    At each window length the tile that covers this one's centre in the same
    band is the last one to start before it, found on a shared time axis
    instead of by pairing. Window lengths are a handful, so a tile asks few times.
    """
    keys = list(keys)
    lengths = tiles.agg(F.array_sort(F.collect_set("scale")).alias("_lengths"))
    ask = tiles.select(*keys, tile_id, F.col("f_lo"), (0.5 * (F.col("t_lo") + F.col("t_hi"))).alias("_mid")).crossJoin(
        F.broadcast(lengths)).withColumn("scale", F.explode("_lengths")).drop("_lengths")
    cover = F.struct(F.col("t_lo").alias("lo"), F.col("t_hi").alias("hi"), F.coalesce(F.nanvl("significance", F.lit(0.0)), F.lit(0.0)).alias("s"))
    table = tiles.groupBy(*keys, "scale", "f_lo", "t_lo").agg(F.max_by(cover, F.col(tile_id)).alias("_tile"))
    seen = as_of(ask, table, "_mid", "t_lo", "_tile", tile_id, [*keys, "scale", "f_lo"])
    hit = seen.where(F.col("before").isNotNull() & (F.col("_mid") < F.col("before.hi")))
    got = hit.groupBy(tile_id).agg(
        F.max("before.s").alias("s_max"), F.min("before.s").alias("_low"), F.count(F.lit(1)).alias("n_scales"),
        F.max(F.struct(F.col("before.s").alias("s"), (-F.col("scale")).alias("neg"))).alias("_b"))
    return got.select(tile_id, "s_max", (-F.col("_b.neg")).alias("scale_best"), "n_scales",
                      F.when(F.col("s_max") > 0, F.col("_low") / F.col("s_max")).otherwise(F.lit(0.0)).alias("s_ratio"))
