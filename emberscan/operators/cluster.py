"""Grouping triggers and tiles: percolation, window chains, graphs, DBSCAN, greedy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.functions.arrays import dot, unit_norm
from emberscan.functions.intervals import TINY, clipped_overlap, finite, gap_between, overlap_fraction
from emberscan.operators.components import component_labels, label_rows
from emberscan.operators.rangejoin import neighbour_pairs, overlap_join
from emberscan.operators.scan import islands, lookup_join
from emberscan.operators.tiles import bands_touch
from emberscan.session import cut_lineage, ship_package

# --- percolation over tiles ---------------------------------------------------


def percolate(tiles: DataFrame, time_tol_s: float, row_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tiles with `cluster_id`: joined when close in time and touching in band.

    No tile is paired with another. Take two bands that touch: among their tiles
    the relation is one-dimensional, so its groups are the islands of their
    merged time axis. Each pair of touching bands is scanned for islands, and
    the islands a tile belongs to are linked through it. The links number the
    tiles times the bands each touches -- a handful on a dyadic ladder -- even
    where every tile meets every other. A cluster is named by its least row id.
    """
    keys = list(keys)
    # The bands of a dyadic ladder: one per octave, a few dozen over all lengths.
    bands = cut_lineage(tiles.select("f_lo", "f_hi").distinct().coalesce(1))
    lower = bands.select(F.col("f_lo").alias("a_lo"), F.col("f_hi").alias("a_hi"))
    upper = bands.select(F.col("f_lo").alias("b_lo"), F.col("f_hi").alias("b_hi"))
    touch = lower.join(F.broadcast(upper), (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
                       & (F.struct("a_lo", "a_hi") <= F.struct("b_lo", "b_hi")))
    # A band on its own is covered by any pair it is in, and scanned alone only without one.
    own = (F.col("a_lo") == F.col("b_lo")) & (F.col("a_hi") == F.col("b_hi"))
    met = touch.where(~own)
    paired = met.select("a_lo", "a_hi").union(met.select("b_lo", "b_hi")).distinct()
    touch = cut_lineage(met.unionByName(touch.where(own).join(F.broadcast(paired), on=["a_lo", "a_hi"], how="left_anti")).coalesce(1))
    pair = F.xxhash64("a_lo", "a_hi", "b_lo", "b_hi").alias("_pair")
    sides = touch.select(pair, F.explode(F.array_distinct(F.array(
        F.struct(F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")),
        F.struct(F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))))).alias("_b"))
    narrow = tiles.select(*keys, row_id, "t_lo", "t_hi", "f_lo", "f_hi")
    entered = narrow.join(
        F.broadcast(sides), (F.col("f_lo") == F.col("_b.lo")) & (F.col("f_hi") == F.col("_b.hi"))).drop("_b", "f_lo", "f_hi")
    chained = cut_lineage(islands(entered, [*keys, "_pair"], "t_lo", "t_hi", row_id, gap=time_tol_s, label="_isle"))
    # Each island is named by its least tile; an edge from every tile to that name.
    names = chained.groupBy(*keys, "_pair", "_isle").agg(F.min(row_id).alias("_head"))
    links = lookup_join(chained, names, [*keys, "_pair", "_isle"]).select(
        F.col(row_id).alias("src"), F.col("_head").alias("dst"))
    return label_rows(tiles, links, row_id, output="cluster_id")


def trigger_labels(tiles: DataFrame, trigger: str = "trigger_id", label: str = "cluster_id") -> DataFrame:
    """Each trigger's cluster: the one receiving most of its energy, the lower label on a tie."""
    shares = tiles.groupBy(trigger, label).agg(F.sum("energy").alias("e"))
    best = F.max(F.struct("e", (-F.col(label)).alias("neg")))
    return shares.groupBy(trigger).agg(best.alias("_b")).select(trigger, (-F.col("_b.neg")).alias(label))


# --- one detector's triggers --------------------------------------------------


@dataclass(frozen=True)
class ChainConfig:
    max_missing_windows: int = 1
    minimum_frequency_overlap: float = 0.0
    maximum_log_energy_jump: float = 3.0


def window_chain_edges(triggers: DataFrame, stride_s: float, config: ChainConfig = ChainConfig(),
                       row_id: str = "id", time: str = "gps", energy_column: str = "energy",
                       keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Edges between windows a few strides apart that share band and energy.

    Windows of one length start on a grid, so a window has only a few neighbours
    within reach: the pairs are linear in the triggers.
    """
    reach = stride_s * (1.5 + config.max_missing_windows)
    cols = [row_id, *keys, time, "freqMin", "freqMax", energy_column]
    pairs = neighbour_pairs(triggers.select(*dict.fromkeys(cols)), time, row_id, reach, keys)
    log_energy = lambda side: F.log(F.greatest(F.col(energy_column + side), F.lit(TINY)))
    low = lambda s: F.least(F.col("freqMin" + s), F.col("freqMax" + s))
    high = lambda s: F.greatest(F.col("freqMin" + s), F.col("freqMax" + s))
    shared = overlap_fraction(low("_l"), high("_l"), low("_r"), high("_r"))
    return pairs.where(
        (shared >= config.minimum_frequency_overlap)
        & (F.abs(log_energy("_l") - log_energy("_r")) <= config.maximum_log_energy_jump)
    ).select(F.col(row_id + "_l").alias("src"), F.col(row_id + "_r").alias("dst"))


def window_chains(triggers: DataFrame, stride_s: float, config: ChainConfig = ChainConfig(), row_id: str = "id",
                  **where) -> DataFrame:
    edges = window_chain_edges(triggers, stride_s, config, row_id, **where)
    return label_rows(triggers, edges, row_id, output="cluster_id")


@dataclass(frozen=True)
class DetectorGraphConfig:
    time_tolerance: float = 1.0
    minimum_frequency_overlap: float = 0.0
    band_adjacency: int = 1
    maximum_log_energy_jump: float = 3.0
    minimum_significance: float = 0.0
    same_basis: bool = False


def detector_edges(nodes: DataFrame, config: DetectorGraphConfig = DetectorGraphConfig(),
                   keys: Sequence[str] = ("ifo",), row_id: str = "trigger_id", finest: int = -12) -> DataFrame:
    """One detector's trigger graph over all its window lengths, with its edge features.

    `nodes` carries `gps, n_coeff, fs, gpsStart, duration, freqMin, freqMax,
    EnWDF, significance, band_mask` and optionally `grid` and `wave`. The extent
    of each trigger's energy is dilated by half its own allowance and the pairs
    are those that then overlap: a long window reaches further than a short one,
    and nobody else's reach grows with it.
    """
    n = nodes.where(F.col("significance") >= config.minimum_significance)
    span = F.col("n_coeff") / F.greatest(F.col("fs"), F.lit(TINY))
    n = n.withColumn("_span", span)
    n = n.withColumn("_on", F.when(finite(F.col("gpsStart")), F.col("gpsStart")).otherwise(F.col("gps")))
    n = n.withColumn("_ext", F.when(finite(F.col("duration")), F.col("duration")).otherwise(F.col("_span")))
    n = n.withColumn("_off", F.col("_on") + F.col("_ext"))
    n = n.withColumn("_e", F.greatest(F.col("EnWDF") * F.col("EnWDF"), F.lit(TINY)))
    # Allowed gap is tolerance * mean span, that is half of it from either side.
    # A hair is added so that rounding drops no pair the exact test admits.
    pad = F.lit(config.time_tolerance * 0.5) * F.col("_span") + F.lit(1e-6)
    n = n.withColumn("_lo", F.col("_on") - pad).withColumn("_hi", F.col("_off") + pad)
    if "grid" in n.columns:
        n = n.withColumn("_shape", unit_norm(F.col("grid"))).drop("grid")
    keep = [c for c in n.columns if c.startswith("_")] + [
        row_id, "gps", "n_coeff", "freqMin", "freqMax", "band_mask", "significance", *(["wave"] if config.same_basis else [])]
    n = n.select(*keys, *keep)
    pairs = overlap_join(n, n, ("_lo", "_hi"), ("_lo", "_hi"), keys, finest)
    l, r = (lambda c: F.col(c + "_l")), (lambda c: F.col(c + "_r"))
    # The reference order of a pair: earlier window first, then lower id.
    pairs = pairs.where((l("gps") < r("gps")) | ((l("gps") == r("gps")) & (l(row_id) < r(row_id))))
    gap = gap_between(l("_on"), l("_off"), r("_on"), r("_off"))
    allowed = F.lit(config.time_tolerance * 0.5) * (l("_span") + r("_span"))
    shared = clipped_overlap(l("freqMin"), l("freqMax"), r("freqMin"), r("freqMax"))
    jump = F.log(l("_e")) - F.log(r("_e"))
    join = ((gap <= allowed) & (shared >= config.minimum_frequency_overlap)
            & bands_touch(l("band_mask"), r("band_mask"), config.band_adjacency)
            & (F.abs(jump) <= config.maximum_log_energy_jump))
    if config.same_basis:
        join = join & (l("wave") == r("wave"))
    covered = F.least(l("_off"), r("_off")) - F.greatest(l("_on"), r("_on"))
    fraction = covered / F.greatest(F.least(l("_ext"), r("_ext")), F.lit(TINY))
    features = {
        "onset_gap": l("_on") - r("_on"),
        "time_overlap": F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)),
        "frequency_overlap": shared,
        "log_scale_ratio": F.log(l("n_coeff") / r("n_coeff")),
        "log_energy_ratio": F.log(l("_e") / r("_e")),
        "significance_min": F.least(l("significance"), r("significance")),
        "significance_max": F.greatest(l("significance"), r("significance")),
        "cross_scale": (l("n_coeff") != r("n_coeff")).cast("double"),
    }
    if "_shape_l" in pairs.columns:
        features["wavegram_similarity"] = dot(F.col("_shape_l"), F.col("_shape_r"))
    return pairs.where(join).select(*keys, l(row_id).alias("src"), r(row_id).alias("dst"),
                                    *[e.alias(name) for name, e in features.items()])


def tile_edges(tiles: DataFrame, time_tolerance: float = 1.0, minimum_significance: float = 0.0,
               keys: Sequence[str] = ("ifo",), row_id: str = "tile_id", finest: int = -12) -> DataFrame:
    """The tile graph over all window lengths: close in units of their widths, touching in band."""
    n = tiles.where(F.coalesce(F.col("significance"), F.lit(0.0)) >= minimum_significance)
    width = F.col("t_hi") - F.col("t_lo")
    pad = F.lit(0.5 * time_tolerance) * width + F.lit(1e-9)
    n = n.select(*keys, row_id, "t_lo", "t_hi", "f_lo", "f_hi", "scale", "significance",
                 (F.col("t_lo") - pad).alias("_lo"), (F.col("t_hi") + pad).alias("_hi"))
    pairs = overlap_join(n, n, ("_lo", "_hi"), ("_lo", "_hi"), keys, finest)
    l, r = (lambda c: F.col(c + "_l")), (lambda c: F.col(c + "_r"))
    pairs = pairs.where((l("t_lo") < r("t_lo")) | ((l("t_lo") == r("t_lo")) & (l(row_id) < r(row_id))))
    gap = gap_between(l("t_lo"), l("t_hi"), r("t_lo"), r("t_hi"))
    allowed = F.lit(0.5 * time_tolerance) * ((l("t_hi") - l("t_lo")) + (r("t_hi") - r("t_lo")))
    band = (l("f_lo") <= r("f_hi")) & (r("f_lo") <= l("f_hi"))
    return pairs.where((gap <= allowed) & band).select(
        *keys, l(row_id).alias("src"), r(row_id).alias("dst"), gap.alias("time_gap"),
        clipped_overlap(l("f_lo"), l("f_hi"), r("f_lo"), r("f_hi")).alias("frequency_overlap"),
        F.log(l("scale") / r("scale")).alias("log_scale_ratio"),
        F.least(l("significance"), r("significance")).alias("significance_min"),
        F.greatest(l("significance"), r("significance")).alias("significance_max"),
        (l("scale") != r("scale")).cast("double").alias("cross_scale"))


# --- density clustering -------------------------------------------------------

# Sub-cells along each axis of a cell, by which two cells of cores are compared.
FINE = 8


def _cell_width(axes: int) -> float:
    """The width at which a cell's diagonal is one, so that its points are all neighbours."""
    return 1.0 / sqrt(axes)


def _offsets(axes: int) -> list[tuple[int, ...]]:
    """Cell steps within which a point at distance one can lie.

    Cells are half-open, so two that are `k` steps apart on an axis are more
    than `k - 1` widths apart on it.
    """
    gap = lambda step: max(abs(step) - 1, 0) ** 2
    return [o for o in product(range(-2, 3), repeat=axes) if sum(map(gap, o)) < axes]


def dbscan(points: DataFrame, axes: Sequence[Column], row_id: str, min_samples: int = 2,
           keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Density clusters at distance one in the scaled axes, two or three of them; `cluster_id` is -1 for noise.

    The space is cut into cells whose points are all neighbours of each other. A
    cell with `min_samples` points makes them all core without a comparison, so
    only points of sparse cells look around, and each cell is looked at by a
    bounded number of them. Core cells are then linked to one another: from the
    boxes of their sub-cells where those settle it, from points only between
    the groups of cells that this leaves. A border point takes the lowest-numbered cluster it touches; a
    cluster is named by its least core id.
    """
    keys, d = list(keys), len(axes)
    width, dims = _cell_width(d), range(d)
    at = lambda prefix, suffix="": [f"{prefix}{i}{suffix}" for i in dims]
    ahead = [o for o in _offsets(d) if o > (0,) * d]

    def looking_from(df: DataFrame, offsets: Sequence[tuple[int, ...]] = tuple(_offsets(d))) -> DataFrame:
        """Rows entered in every cell that may hold a neighbour, as `n0, n1, ...`."""
        out = df.withColumn("_s", F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])))
        return out.withColumns({f"n{i}": F.col(f"c{i}") + F.col("_s")[i] for i in dims}).drop("_s")

    def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
        return df.select(*keys, *[F.col(a).alias(b) for a, b in names.items()])

    def close(a: str, b: str) -> Column:
        return sum((F.pow(F.col(x) - F.col(y), 2) for x, y in zip(at("x", a), at("x", b))), F.lit(0.0)) <= 1.0

    p = points.select(*keys, row_id, *[x.alias(f"x{i}") for i, x in enumerate(axes)])
    p = p.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / width) for i in dims})
    cell, near = [*keys, *at("c")], [*keys, *at("n")]
    sizes = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_cell"))
    p = cut_lineage(lookup_join(p, sizes, cell))
    there = rename(p, {**dict(zip(at("c"), at("n"))), row_id: "id_b", **dict(zip(at("x"), at("x", "_b")))})
    sparse = p.where(F.col("n_cell") < min_samples)
    as_a = {**dict(zip(at("c"), at("c"))), row_id: "id_a", **dict(zip(at("x"), at("x", "_a")))}
    counts = looking_from(rename(sparse, as_a)).join(there, on=near).where(close("_a", "_b")).groupBy("id_a").agg(
        F.count(F.lit(1)).alias("n"))
    sparse_core = counts.where(F.col("n") >= min_samples).select(F.col("id_a").alias(row_id))
    core = cut_lineage(p.where(F.col("n_cell") >= min_samples).unionByName(sparse.join(sparse_core, on=row_id).select(*p.columns)))

    # Cores of one cell are one cluster, named by the least of them.
    heads = core.groupBy(*cell).agg(F.min(row_id).alias("head"))
    sub = core.withColumns({f"s{i}": F.floor(F.col(f"x{i}") / (width / FINE)) for i in dims})
    boxes = sub.groupBy(*cell, *at("s")).agg(
        *[F.min(f"x{i}").alias(f"lo{i}") for i in dims], *[F.max(f"x{i}").alias(f"hi{i}") for i in dims])
    boxes = cut_lineage(lookup_join(boxes, heads, cell))
    span = lambda i: F.greatest(F.col(f"hi{i}_b") - F.col(f"lo{i}_a"), F.col(f"hi{i}_a") - F.col(f"lo{i}_b"))
    apart = lambda i: F.greatest(F.col(f"lo{i}_b") - F.col(f"hi{i}_a"), F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.lit(0.0))
    square = lambda f: sum((f(i) * f(i) for i in dims), F.lit(0.0))

    def meeting(boxes: DataFrame, named: str) -> DataFrame:
        """Pairs of boxes of two cells that may hold neighbours. They are far more than the points, so they are never written."""
        box = [*at("s"), *at("lo"), *at("hi"), named]
        # Each pair of cells once, the one that sorts first on the left.
        a = rename(looking_from(boxes, ahead), {**{c: c for c in at("n")}, **dict(zip(at("c"), at("c", "_a"))), **{c: c + "_a" for c in box}})
        b = rename(boxes, {**dict(zip(at("c"), at("n"))), **{c: c + "_b" for c in box}})
        return a.join(b, on=near).where(square(apart) <= 1.0)

    sure = meeting(boxes, "head").where(square(span) <= 1.0).select(F.col("head_a").alias("src"), F.col("head_b").alias("dst")).distinct()
    within = lookup_join(core, heads, cell).select(F.col(row_id).alias("src"), F.col("head").alias("dst"))
    grouped = cut_lineage(label_rows(core, within.unionByName(sure), row_id, output="group"))
    # Points are compared only between cells that boxes alone have not joined yet, directly or through others.
    of_cell = grouped.groupBy(*cell).agg(F.min("group").alias("group"))
    open_ = meeting(lookup_join(boxes, of_cell, cell), "group").where((square(span) > 1.0) & (F.col("group_a") != F.col("group_b")))
    side = lambda s, cells: rename(sub, {**dict(zip(at("c"), cells)), **{c: c + s for c in [*at("s"), *at("x")]}})
    tested = (
        open_.select(*keys, *at("c", "_a"), *at("n"), *at("s", "_a"), *at("s", "_b"), "group_a", "group_b")
        .join(side("_a", at("c", "_a")), on=[*keys, *at("c", "_a"), *at("s", "_a")])
        .join(side("_b", at("n")), on=[*keys, *at("n"), *at("s", "_b")])
        .where(close("_a", "_b")).select(F.col("group_a").alias("src"), F.col("group_b").alias("dst")).distinct())
    joined = component_labels(tested, output="cluster_id").withColumnRenamed("vertex", "group")
    labelled = cut_lineage(lookup_join(grouped, joined, ["group"], how="left").withColumn("cluster_id", F.coalesce("cluster_id", "group")))

    rest = sparse.join(sparse_core, on=row_id, how="left_anti")
    near_core = rename(labelled, {**dict(zip(at("c"), at("n"))), "cluster_id": "c_b", **dict(zip(at("x"), at("x", "_b")))})
    border = looking_from(rename(rest, as_a)).join(near_core, on=near).where(close("_a", "_b")).groupBy(
        F.col("id_a").alias(row_id)).agg(F.min("c_b").alias("cluster_id"))
    ids = labelled.select(row_id, "cluster_id", F.lit(True).alias("is_core")).unionByName(
        border.select(row_id, "cluster_id", F.lit(False).alias("is_core")))
    return points.join(ids, on=row_id, how="left").withColumn(
        "cluster_id", F.coalesce("cluster_id", F.lit(-1))).withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def cluster_triggers(triggers: DataFrame, method: str = "dbscan", time_eps_s: float = 0.5, freq_eps_hz: float = 50.0,
                     min_samples: int = 2, stat_weight: float = 0.0, time: str = "gpsPeak", frequency: str = "freqMean",
                     statistic: str = "EnWDF", row_id: str = "id", keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Triggers with `cluster_id`, by density or by greedy merging, every detector on its own."""
    if method == "greedy":
        return greedy(triggers, time, frequency, row_id, time_eps_s, freq_eps_hz, min_samples, keys)
    if method != "dbscan":
        raise ValueError(f"unknown clustering method {method!r}")
    axes = [F.col(time) / time_eps_s, F.col(frequency) / freq_eps_hz]
    if stat_weight > 0:
        axes.append(F.lit(stat_weight) * F.log10(F.greatest(F.col(statistic), F.lit(TINY))))
    return dbscan(triggers, axes, row_id, min_samples, keys)


def greedy(triggers: DataFrame, time: str, frequency: str, row_id: str, time_eps: float, freq_eps: float,
           min_samples: int = 2, keys: Sequence[str] = ("ifo",)) -> DataFrame:
    """Time-ordered merging into the first open group whose last member is close enough.

    A group is named by its first member; those below `min_samples` are noise, -1.

    The rule depends on everything before it, but a silence longer than
    `time_eps` closes every group, so the stretches between silences are
    independent and are spread over the cluster. Within one, rows stream past in
    order and only the groups still open are remembered.
    """
    keys = list(keys)
    # The chain of instants, not of extents: a silence is a gap between rows.
    marked = islands(triggers.select(*keys, row_id, time, frequency), keys, time, time, row_id, gap=time_eps, label="_run")
    order = [*keys, "_run"]
    streamed = marked.repartition(*order).sortWithinPartitions(*order, time, row_id)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, open_groups = None, []
        for batch in batches:
            labels = []
            for row in zip(*[batch[c] for c in order], batch[row_id], batch[time], batch[frequency]):
                here, (rid, t, f) = row[:len(order)], row[len(order):]
                if here != run:
                    run, open_groups = here, []
                open_groups = [g for g in open_groups if t - g[1] <= time_eps]
                for g in open_groups:
                    if abs(f - g[2]) <= freq_eps:
                        g[1], g[2] = t, f
                        labels.append(g[0])
                        break
                else:
                    open_groups.append([rid, t, f])
                    labels.append(rid)
            yield pd.DataFrame({row_id: batch[row_id], "cluster_id": labels})

    ship_package(triggers.sparkSession)
    kind = triggers.schema[row_id].dataType.simpleString()
    labels = cut_lineage(streamed.mapInPandas(merge, f"{row_id} {kind}, cluster_id {kind}"))
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = lookup_join(labels, sizes, ["cluster_id"]).withColumn(
        "cluster_id", F.when(F.col("_n") >= min_samples, F.col("cluster_id")).otherwise(F.lit(-1))).drop("_n")
    return triggers.join(kept, on=row_id)
