"""Detector positions, light travel times and sky directions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Speed of light in m/s, site vertices in the Earth-fixed frame in
# metres, sidereal angle at the GPS epoch in radians, sidereal days per day.
SPEED_OF_LIGHT = 299792458.0
SITES = {
    "H1": (-2161414.93, -3834695.36, 4600350.22),
    "L1": (-74276.05, -5496283.72, 3224257.02),
    "V1": (4546374.10, 842989.70, 4378576.96),
    "K1": (-3777336.02, 3484898.41, 3765313.68),
    "G1": (3856309.94, 666598.96, 5019641.42),
}
GMST_AT_GPS_EPOCH = 1.8272328613543891
SIDEREAL_DAYS_PER_DAY = 1.0027379093508615

SIDEREAL_RATE = 2.0 * pi * SIDEREAL_DAYS_PER_DAY / 86400.0


def site(name: str) -> tuple[float, float, float]:
    try:
        return SITES[str(name).upper()]
    except KeyError:
        raise KeyError(f"no position is known for detector {name!r}") from None


def light_travel_time(a: str, b: str) -> float:
    return sqrt(sum((x - y) ** 2 for x, y in zip(site(a), site(b)))) / SPEED_OF_LIGHT


def network_light_travel_time(names) -> float:
    """The longest baseline among the known detectors, zero for fewer than two."""
    known = sorted({str(n).upper() for n in names} & set(SITES))
    return max((light_travel_time(a, b) for a in known for b in known if a < b), default=0.0)


def sites_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SITES.items()], "ifo string, x double, y double, z double")


def travel_times(spark: SparkSession) -> DataFrame:
    """One row per ordered pair of sites; the table is as long as the list of sites squared."""
    a = sites_table(spark).select(*[F.col(c).alias(c + "_a") for c in ("ifo", "x", "y", "z")])
    b = sites_table(spark).select(*[F.col(c).alias(c + "_b") for c in ("ifo", "x", "y", "z")])
    squares = [(F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz"]
    return (
        a.join(F.broadcast(b), F.col("ifo_a") < F.col("ifo_b"))
        .select("ifo_a", "ifo_b", (F.sqrt(squares[0] + squares[1] + squares[2]) / SPEED_OF_LIGHT).alias("travel_s"))
    )


def sidereal_angle(gps: Column) -> Column:
    turn = F.lit(2.0 * pi)
    angle = F.lit(GMST_AT_GPS_EPOCH) + F.lit(SIDEREAL_RATE) * gps
    return angle - turn * F.floor(angle / turn)


def direction(ra: Column, dec: Column, gps: Column) -> tuple[Column, Column, Column]:
    hour = ra - sidereal_angle(gps)
    return F.cos(dec) * F.cos(hour), F.cos(dec) * F.sin(hour), F.sin(dec)


def arrival_delay(ra: Column, dec: Column, gps: Column, from_a: tuple, from_b: tuple) -> Column:
    """`t_a - t_b` for a source at `(ra, dec)`; the sites are triples of columns."""
    ux, uy, uz = direction(ra, dec, gps)
    dx, dy, dz = (b - a for a, b in zip(from_a, from_b))
    return (ux * dx + uy * dy + uz * dz) / SPEED_OF_LIGHT
