"""Sky positions consistent with measured arrival times."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscan.functions.geometry import SITES, SPEED_OF_LIGHT, sidereal_angle, sites_table
from emberscan.session import cut_lineage, shuffle_partitions

# Cells of the sky a task holds.
SKY_ROWS = 1 << 21


def with_grid(rows: DataFrame, n_ra: int, n_dec: int) -> DataFrame:
    """Each row once per sky cell, with `cell, ra, dec` and the cell's direction `ux, uy, uz`.

    Even in right ascension and in the sine of declination. Only numbers are
    unrolled; the geometry is plain arithmetic on them, which is compiled.
    """
    cell = F.col("cell")
    sine = F.least(F.lit(1.0), F.lit(-1.0) + F.floor(cell / n_ra) * F.lit(2.0 / (n_dec - 1)))
    out = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_ra * n_dec - 1))))
    out = out.withColumn("ra", (cell % n_ra) * F.lit(2.0 * pi / n_ra)).withColumn("dec", F.asin(sine))
    # The direction before the Earth's rotation is taken off.
    return out.withColumn("ux", F.cos("dec") * F.cos("ra")).withColumn("uy", F.cos("dec") * F.sin("ra")).withColumn("uz", F.sin("dec"))


def localise(arrivals: DataFrame, n_ra: int = 360, n_dec: int = 180, key: str = "candidate_id") -> DataFrame:
    """Weight of every grid cell for every candidate: `(key, cell, ra, dec, weight)`, summing to one.

    `arrivals` has one row per candidate and detector: `key, ifo, gps, spread`.
    The earliest detector is the reference. The arrivals are spread by candidate
    once; the cells a candidate is unrolled into and their sum stay where it is,
    so the sky -- a fixed number of rows per candidate -- is never shuffled.
    Refused are detectors without a site, candidates of one detector, and
    arrivals without a time or a positive spread: their sky would be made up.
    """
    sites = sites_table(arrivals.sparkSession)
    # Few and small rows that become many: their size would not tell adaptive
    # execution to keep them apart, so the number of partitions is given.
    # It follows from the cells, which a task sorts by candidate; the few arrivals are written to be counted.
    arrivals = cut_lineage(arrivals)
    tasks = max(shuffle_partitions(arrivals.sparkSession), -(-arrivals.count() * n_ra * n_dec // (2 * SKY_ROWS)))
    spread = arrivals.repartition(tasks, key)
    a = spread.withColumn("ifo", F.upper("ifo")).join(F.broadcast(sites), on="ifo", how="left")
    known = F.assert_true(F.col("x").isNotNull(), "an arrival is at a detector whose site is not known")
    timed = F.assert_true(F.coalesce((F.col("spread") > 0) & ~F.isnan("gps"), F.lit(False)), "an arrival has no time or no positive spread")
    a = a.withColumn("_ok", F.coalesce(known, timed)).where(F.col("_ok").isNull()).drop("_ok")
    hit = F.struct(F.col("gps").alias("gps"), F.col("ifo").alias("ifo"), F.col("spread").alias("s"), "x", "y", "z")
    # As many entries as there are detectors on Earth.
    per = a.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("_h"))
    paired = F.assert_true(F.size("_h") >= 2, "a candidate has arrivals at one detector only")
    per = per.withColumn("_ok", paired).where(F.col("_ok").isNull()).drop("_ok")
    per = per.withColumn("_ref", F.col("_h")[0]).withColumn("_angle", sidereal_angle(F.col("_h")[0]["gps"]))
    turn_c, turn_s = F.cos("_angle"), F.sin("_angle")
    ref = F.col("_ref")

    def baseline(h: Column) -> Column:
        dx, dy, dz = (ref[c] - h[c] for c in "xyz")
        return F.struct(
            ((turn_c * dx - turn_s * dy) / SPEED_OF_LIGHT).alias("x"), ((turn_s * dx + turn_c * dy) / SPEED_OF_LIGHT).alias("y"),
            (dz / SPEED_OF_LIGHT).alias("z"), (h["gps"] - ref["gps"]).alias("measured"),
            (h["s"] * h["s"] + ref["s"] * ref["s"]).alias("var"))

    per = per.select(key, F.transform(F.slice("_h", 2, F.size("_h") - 1), baseline).alias("_b"))
    for i in range(len(SITES) - 1):
        per = per.withColumn(f"_b{i}", F.get("_b", F.lit(i)))
    cells = with_grid(per.drop("_b"), n_ra, n_dec)

    def misfit(i: int) -> Column:
        b = F.col(f"_b{i}")
        off = F.col("ux") * b["x"] + F.col("uy") * b["y"] + F.col("uz") * b["z"] - b["measured"]
        return F.coalesce(off * off / b["var"], F.lit(0.0))

    chi2 = sum((misfit(i) for i in range(1, len(SITES) - 1)), misfit(0))
    sky = cells.select(key, "cell", "ra", "dec", F.exp(-0.5 * chi2).alias("_w"))
    total = sky.groupBy(key).agg(F.sum("_w").alias("_t"))
    return sky.join(total, on=key).select(
        key, "cell", "ra", "dec", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(F.col("_w")).alias("weight"))


def _ranked(sky: DataFrame, key: str) -> DataFrame:
    # A candidate has as many rows as the grid has cells, so each is ranked where `localise` left it, without a shuffle.
    down = Window.partitionBy(key).orderBy(-F.col("weight"), "cell").rowsBetween(Window.unboundedPreceding, 0)
    return sky.withColumn("_upto", F.sum("weight").over(down))


def credible_area(sky: DataFrame, level: float = 0.9, key: str = "candidate_id") -> DataFrame:
    """Square degrees of the fewest cells that hold `level` of the weight."""
    ranked = _ranked(sky, key)
    need = F.sum(F.when(F.col("_upto") < level, 1).otherwise(0)) + 1
    cell = F.lit(4.0 * pi * (180.0 / pi) ** 2) / F.count(F.lit(1))
    return ranked.groupBy(key).agg(need.alias("n_cells"), (need * cell).alias("area_deg2"))


def contains(sky: DataFrame, truth: DataFrame, level: float = 0.9, key: str = "candidate_id") -> DataFrame:
    """Whether each candidate's true position (`ra_true, dec_true`) is inside its region."""
    ranked = _ranked(sky, key).join(truth, on=[key])
    d = F.pow(F.col("ra") - F.col("ra_true"), 2) + F.pow(F.col("dec") - F.col("dec_true"), 2)
    # The cut is the weight of the first cell that brings the sum to the level.
    got = ranked.groupBy(key).agg(
        F.min(F.struct(d.alias("d"), "cell", "weight")).alias("_n"),
        F.max(F.when(F.col("_upto") >= level, F.col("weight"))).alias("_cut"), F.min("weight").alias("_least"))
    return got.select(key, (F.col("_n.weight") >= F.coalesce("_cut", "_least")).alias("inside"))
