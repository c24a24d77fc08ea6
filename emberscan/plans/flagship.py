"""Triggers of two detectors to ranked candidates with a false-alarm probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscan.operators.coincidence import nearest_coincidence
from emberscan.operators.rank import rank_by_probability
from emberscan.operators.slides import SLIDE, replicate, slide_events
from emberscan.plans.views import SPAN_S, triggers
from emberscan.session import cut_lineage

LEFT, RIGHT, FLOOR = "click", "view", 1.0
SHIFTS = [3600.0 * k + 17.0 for k in range(1, 21)]


def coincidences_with_slides(events: DataFrame, left: str, right: str, window_s: float,
                             shifts: Sequence[float], start: float, span: float) -> DataFrame:
    """Zero lag (slide 0) and every slide of the nearest coincidence, in one job."""
    a = replicate(events.where(F.col("ifo") == left), len(shifts) + 1)
    b = slide_events(events.where(F.col("ifo") == right), [0.0, *shifts], start, span, "gpsPeak", ["gpsPeak"])
    return nearest_coincidence(a, b.drop("slide_shift_s"), window_s, keys=[SLIDE])


def ranked_candidates(spark: SparkSession, folder: str, window_s: float = 60.0, top: int | None = 50) -> DataFrame:
    events = triggers(spark, folder).where(F.col("EnWDF") >= FLOOR)
    # Read three times below -- zero lag, background, its size -- and far smaller than what it came from.
    found = cut_lineage(coincidences_with_slides(events, LEFT, RIGHT, window_s, SHIFTS, 0.0, SPAN_S))
    zero = found.where(F.col(SLIDE) == 0).drop(SLIDE)
    background = found.where(F.col(SLIDE) > 0)
    ranked = rank_by_probability(zero, background, "network_enwdf", "id_a", SPAN_S)
    out = ranked.select(
        "id_a", "id_b", F.round("gps_candidate", 6).alias("gps_candidate"), F.round("dt_s", 6).alias("dt_s"),
        F.round("network_enwdf", 6).alias("network_enwdf"), "n_candidate_matches", "n_background_ge", "n_background",
        F.round("fap", 9).alias("fap"), F.round("far_per_day", 9).alias("far_per_day"))
    if top is None:
        return out
    return out.orderBy("fap", F.desc("network_enwdf"), "id_a").limit(top)
