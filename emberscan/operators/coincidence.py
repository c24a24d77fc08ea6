"""Cross-detector coincidence: nearest match, interval candidates, 1:1 pairs, networks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.functions.geometry import light_travel_time, network_light_travel_time
from emberscan.functions.intervals import TINY, clipped_overlap, intervals_touch, overlap_fraction
from emberscan.operators.assignment import assign_one_to_one
from emberscan.operators.components import component_labels
from emberscan.operators.rangejoin import nearest_within, overlap_join
from emberscan.operators.scan import prefix_scan
from emberscan.operators.slides import SLIDE, Replicated
from emberscan.session import shuffle_partitions


def quadrature(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


NETWORK_STATISTICS = {
    "quadrature_sum": lambda s: F.sqrt(F.sum(s * s)),
    "min": F.min,
    "mean": F.avg,
}


def nearest_coincidence(left: DataFrame, right: DataFrame, window_s: float, keys: Sequence[str] = ()) -> DataFrame:
    """Each left event with the nearest right event within the window.

    A right event may serve several left ones; `n_candidate_matches` says how
    many were in reach.
    """
    cols = [*keys, "id", "gpsPeak", "EnWDF", "freqMean"]
    matched = nearest_within(left.select(*cols), right.select(*cols), "gpsPeak", "gpsPeak", window_s, "id", "id", keys)
    l, r = F.col("l"), F.col("r")
    weighted = (l["gpsPeak"] * l["EnWDF"] + r["gpsPeak"] * r["EnWDF"]) / (l["EnWDF"] + r["EnWDF"])
    return matched.select(
        *keys, l["id"].alias("id_a"), r["id"].alias("id_b"), weighted.alias("gps_candidate"),
        (l["gpsPeak"] - r["gpsPeak"]).alias("dt_s"), l["EnWDF"].alias("enwdf_a"), r["EnWDF"].alias("enwdf_b"),
        l["freqMean"].alias("freq_a"), r["freqMean"].alias("freq_b"),
        quadrature(l["EnWDF"], r["EnWDF"]).alias("network_enwdf"),
        F.lit(2).alias("n_ifos"), F.col("n_matches").alias("n_candidate_matches"))


@dataclass(frozen=True)
class CoincidenceConfig:
    """How close two events must be. A travel time of None is read off the detectors."""

    light_travel_time_s: float | None = None
    timing_jitter_s: float = 0.0035
    timing_sigma: float = 3.0
    minimum_frequency_overlap: float = 0.0
    minimum_time_overlap: float = 0.0
    maximum_tolerance_travel_times: float = 2.5
    maximum_tolerance_s: float | None = None
    time_weight: float = 1.0
    frequency_weight: float = 1.0
    morphology_weight: float = 0.0

    def between(self, ifos: Sequence[str] = ()) -> "Tolerances":
        """What these settings come to for a group of detectors."""
        travel = network_light_travel_time(ifos) if self.light_travel_time_s is None else float(self.light_travel_time_s)
        return Tolerances(
            travel_s=travel, jitter_s=self.timing_jitter_s, sigmas=self.timing_sigma,
            cap_s=float(self.maximum_tolerance_s if self.maximum_tolerance_s is not None else travel * self.maximum_tolerance_travel_times))


@dataclass(frozen=True)
class Tolerances:
    """How far apart in time the events of two detectors may be, in seconds."""

    travel_s: float
    jitter_s: float
    sigmas: float
    cap_s: float

    def of_pair(self, one_spread: Column, other_spread: Column) -> Column:
        """A pair's own: light travel and the two spreads, none below the jitter or unknown, and never more than the cap."""
        spread = [F.greatest(F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0)), F.lit(self.jitter_s)) for s in (one_spread, other_spread)]
        return F.least(F.lit(self.travel_s) + F.lit(self.sigmas) * quadrature(*spread), F.lit(self.cap_s))


def legacy_window(ifo_a: str, ifo_b: str, timing_jitter_s: float = 0.01) -> float:
    """The fixed window of the older finder: the pair's light travel time and both sides' jitter."""
    return light_travel_time(ifo_a, ifo_b) + 2.0 * timing_jitter_s


def coincidence_reach(left: DataFrame, right: DataFrame, config: CoincidenceConfig, ifos: Sequence[str] = ()) -> DataFrame:
    """One row, `reach_s`: how far apart any two of these events could sit and still meet."""
    both = left.select("duration", "tSpread", F.lit("l").alias("side")).unionByName(
        right.select("duration", "tSpread", F.lit("r").alias("side")))
    longest = lambda side: F.coalesce(F.max(F.when((F.col("side") == side) & ~F.isnan("duration"), F.col("duration"))), F.lit(0.0))
    widest = F.coalesce(F.max(F.when(~F.isnan("tSpread"), F.col("tSpread"))), F.lit(0.0))
    allowed = config.between(ifos)
    facts = both.agg((F.lit(allowed.travel_s) + longest("l") + longest("r")).alias("_far"), widest.alias("_wide"))
    return facts.select(F.greatest("_far", allowed.of_pair(F.col("_wide"), F.col("_wide"))).alias("reach_s"))


EVENT_COLUMNS = ("id", "gpsPeak", "gpsStart", "duration", "tSpread", "freqMin", "freqMean", "freqMax", "EnWDF")


def candidate_edges(left: DataFrame | Replicated, right: DataFrame, config: CoincidenceConfig,
                    ifos: Sequence[str] = (), keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Every pair of events one signal could have produced, with the cost of pairing them.

    Admission is on the extents, not on an instant. The left extent is dilated
    by the largest tolerance any pair may claim to find what can meet, then
    each pair is held to its own tolerance.

    Left events that are the same in every slide may come as one copy (`replicate(..., written=False)`), which the right
    events of all slides meet. `carry` names further columns of both sides that the pairs keep, with `_l` and `_r`.
    """
    keys, cols, of_right = list(keys), [*EVENT_COLUMNS, *carry], []
    if isinstance(left, Replicated):
        right = right.where(F.col(SLIDE).between(0, left.n_slides - 1))
        left, keys, of_right = left.events, [k for k in keys if k != SLIDE], [SLIDE]
    cap = config.between(ifos).cap_s
    dilated = (lambda c: c("gpsStart") - cap, lambda c: c("gpsStart") + c("duration") + cap)
    extent = ("gpsStart", lambda c: c("gpsStart") + c("duration"))
    pairs = overlap_join(left.select(*keys, *cols), right.select(*keys, *of_right, *cols), dilated, extent, keys)
    return admitted(pairs.withColumnsRenamed({f"{c}_r": c for c in of_right}), config, ifos)


def admitted(pairs: DataFrame, config: CoincidenceConfig, ifos: Sequence[str] = ()) -> DataFrame:
    """Those pairs of events (columns with `_l` and `_r`) that may be one signal, with the cost of pairing them."""
    L, R = (lambda c: F.col(c + "_l")), (lambda c: F.col(c + "_r"))
    a0, a1 = L("gpsStart"), L("gpsStart") + L("duration")
    b0, b1 = R("gpsStart"), R("gpsStart") + R("duration")
    allowed = config.between(ifos)
    tol = allowed.of_pair(L("tSpread"), R("tSpread"))
    low = lambda s: F.least(s("freqMin"), s("freqMax"))
    high = lambda s: F.greatest(s("freqMin"), s("freqMax"))
    scored = (
        pairs.withColumn("tolerance_s", tol)
        .withColumn("dt_s", L("gpsPeak") - R("gpsPeak"))
        .withColumn("frequency_overlap", overlap_fraction(low(L), high(L), low(R), high(R)))
        .withColumn("time_overlap", clipped_overlap(a0, a1, b0, b1, F.lit(allowed.travel_s)))
        .where(intervals_touch(a0, a1, b0, b1, F.col("tolerance_s")))
    )
    # An overlap is never null or below zero. A test that holds for every pair would be worked out in the join all the same,
    # whose code would then be too long for the JVM to compile, and its columns would be shuffled though nobody reads them.
    for share, least in (("frequency_overlap", config.minimum_frequency_overlap), ("time_overlap", config.minimum_time_overlap)):
        if not least <= 0:
            scored = scored.where(F.col(share) >= least)
    scale = F.greatest(high(L) - low(L), high(R) - low(R), F.lit(1.0))
    cost = (F.lit(config.time_weight) * F.abs("dt_s") / F.greatest(F.col("tolerance_s"), F.lit(TINY))
            + F.lit(config.frequency_weight) * F.abs(L("freqMean") - R("freqMean")) / scale)
    if config.morphology_weight:
        le, re = (F.greatest(s("EnWDF") * s("EnWDF"), F.lit(TINY)) for s in (L, R))
        cost = cost + F.lit(config.morphology_weight) * F.abs(F.log(le / re))
    return scored.withColumn("cost", cost)


def one_to_one_candidates(left: DataFrame | Replicated, right: DataFrame, config: CoincidenceConfig,
                          ifos: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Candidates in which no event is used twice: most pairs first, then least total cost."""
    return chosen_candidates(candidate_edges(left, right, config, ifos, keys), keys)


def chosen_candidates(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The one-to-one choice among admitted pairs, as candidates."""
    keys = list(keys)
    used = [c + side for c in ("id", "gpsPeak", "EnWDF") for side in ("_l", "_r")]
    edges = edges.select(*keys, *used, "dt_s", "frequency_overlap", "time_overlap", "cost")
    chosen = assign_one_to_one(edges, keys, "id_l", "id_r", "cost", places=("gpsPeak_l", "gpsPeak_r"))
    sa, sb = F.col("EnWDF_l"), F.col("EnWDF_r")
    return chosen.select(
        *keys, F.col("id_l").alias("id_a"), F.col("id_r").alias("id_b"), sa.alias("enwdf_a"), sb.alias("enwdf_b"),
        (0.5 * (F.col("gpsPeak_l") + F.col("gpsPeak_r"))).alias("gps_candidate"), "dt_s",
        "frequency_overlap", "time_overlap", F.col("cost").alias("coincidence_cost"),
        quadrature(sa, sb).alias("network_enwdf"), F.least(sa, sb).alias("network_min_enwdf"),
        F.sqrt(F.greatest(sa * sb, F.lit(0.0))).alias("network_geometric_enwdf"), F.lit(2).alias("n_ifos"))


def by_detector_pair(events: DataFrame, ifos: Sequence[str], name: str = "pair") -> tuple[DataFrame, DataFrame]:
    """The left and right events of every detector pair, with the pair as a column to join within.

    A detector is in as many pairs as there are other detectors, which bounds the copies of an event. They are dealt over the
    tasks first: a file of a few megabytes is one task, and all that its events become would be made there.
    """
    events = events.repartition(shuffle_partitions(events.sparkSession))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(ifos, 2)])
    rows = events.withColumn("_p", F.explode(pairs))
    side = lambda c: rows.where(F.col("ifo") == F.col(f"_p.{c}")).withColumn(name, F.concat_ws(",", "_p.a", "_p.b")).drop("_p")
    return side("a"), side("b")


def pairwise_network(events: DataFrame, ifos: Sequence[str], config: CoincidenceConfig) -> DataFrame:
    """`one_to_one_candidates` of every detector pair, tagged with the pair.

    With a stated travel time all pairs are one job, the pair being a key; otherwise each pair has a tolerance of its own.
    """
    if config.light_travel_time_s is not None:
        left, right = by_detector_pair(events, ifos, "ifos_involved")
        found = one_to_one_candidates(left, right, config, (), ["ifos_involved"])
        return found.select(*[c for c in found.columns if c != "ifos_involved"], "ifos_involved")
    found = None
    for a, b in combinations(ifos, 2):
        rows = one_to_one_candidates(events.where(F.col("ifo") == a), events.where(F.col("ifo") == b), config, (a, b))
        rows = rows.withColumn("ifos_involved", F.lit(f"{a},{b}"))
        found = rows if found is None else found.unionByName(rows)
    return found


def network_edges(events: DataFrame, windows: dict[tuple[str, str], float]) -> DataFrame:
    """Edges joining events of different detectors within their pair's window -- a spanning subset.

    Two events of a pair that are within the window are connected through the
    events between them, all of which are within the window too, so linking each
    event to the nearest one of the other detector on either side gives the same
    components with at most two edges per event and pair. No pairs are formed.
    An edge may come twice, from either end. Rows are dealt by time over all
    pairs, so that a task can contract what is connected there to one link an event.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w"))
                      for (a, b), w in sorted(windows.items())])
    rows = events.select("id", "ifo", "gpsPeak", F.explode(pairs).alias("_p")).where(
        (F.col("ifo") == F.col("_p.a")) | (F.col("ifo") == F.col("_p.b")))
    here = F.struct(F.col("gpsPeak").alias("t"), F.col("id").alias("id"))
    is_a = F.col("ifo") == F.col("_p.a")
    rows = rows.select(
        F.concat_ws(",", "_p.a", "_p.b").alias("pair"), F.col("_p.w").alias("w"), "id", "gpsPeak", is_a.alias("is_a"),
        F.when(is_a, here).alias("at_a"), F.when(~is_a, here).alias("at_b"))
    seen = prefix_scan(rows, ["pair"], ["gpsPeak", "id"],
                       previous={"prev_a": "at_a", "prev_b": "at_b"}, following={"next_a": "at_a", "next_b": "at_b"})
    other = F.explode(F.array(F.when(F.col("is_a"), F.col("prev_b")).otherwise(F.col("prev_a")),
                              F.when(F.col("is_a"), F.col("next_b")).otherwise(F.col("next_a"))))
    return (
        seen.select("id", "gpsPeak", "w", other.alias("o"))
        .where(F.col("o").isNotNull() & (F.abs(F.col("o.t") - F.col("gpsPeak")) <= F.col("w")))
        .repartitionByRange(shuffle_partitions(events.sparkSession), "gpsPeak", "id")
        .select(F.least("id", "o.id").alias("src"), F.greatest("id", "o.id").alias("dst"))
    )


def network_candidates(events: DataFrame, ifos: Sequence[str], windows: dict[tuple[str, str], float],
                       min_ifos: int = 2, network_stat: str = "quadrature_sum") -> DataFrame:
    """One candidate per connected group of events that spans enough detectors.

    Each detector contributes its loudest member as `enwdf_<ifo>` / `id_<ifo>`.
    """
    labels = component_labels(network_edges(events, windows))
    members = events.join(labels, events["id"] == labels["vertex"]).drop("vertex")
    stat = NETWORK_STATISTICS[network_stat](F.col("EnWDF"))
    per_ifo = []
    for ifo in ifos:
        loudest = F.max(F.when(F.col("ifo") == ifo, F.struct(F.col("EnWDF").alias("e"), (-F.col("id")).alias("neg"))))
        per_ifo += [loudest["e"].alias(f"enwdf_{ifo}"), (-loudest["neg"]).alias(f"id_{ifo}")]
    involved = F.array_join(F.filter(F.array(*[
        F.max(F.when(F.col("ifo") == i, F.lit(i))) for i in sorted(ifos)]), lambda x: x.isNotNull()), ",")
    n_ifos = sum((F.max(F.when(F.col("ifo") == i, 1).otherwise(0)) for i in ifos), F.lit(0))
    return members.groupBy("component").agg(
        (F.sum(F.col("gpsPeak") * F.col("EnWDF")) / F.sum("EnWDF")).alias("gps_candidate"),
        involved.alias("ifos_involved"), stat.alias("network_enwdf"), n_ifos.alias("n_ifos"),
        F.count(F.lit(1)).alias("n_triggers_in_candidate"), *per_ifo).where(F.col("n_ifos") >= min_ifos)
