"""Joins on time: bands, intervals, nearest neighbours and coverage.

None of these plans as a Cartesian product. Pair-producing joins shuffle on a
time cell and are split by adaptive execution when a cell is hot; the ones that
only need a neighbour or a count never form pairs at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.operators.scan import prefix_scan, slabs_for
from emberscan.session import shuffle_partitions


def _renamed(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
              below: float, above: float, keys: Sequence[str] = (),
              suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs with `left - below <= right <= left + above`, within equal `keys`.

    The cell is as wide as the band, so a left row needs two cells at most and a
    right row exactly one; every pair meets in the right row's cell, once.
    """
    width = max(float(below) + float(above), 1e-9)
    a, b = _renamed(left, suffixes[0], keys), _renamed(right, suffixes[1], keys)
    lt, rt = F.col(left_time + suffixes[0]), F.col(right_time + suffixes[1])
    cells = F.sequence(F.floor((lt - below) / width), F.floor((lt + above) / width))
    a = a.withColumn("_cell", F.explode(cells))
    b = b.withColumn("_cell", F.floor(rt / width))
    return (
        a.join(b, on=["_cell", *keys])
        .where((rt >= lt - F.lit(float(below))) & (rt <= lt + F.lit(float(above))))
        .drop("_cell")
    )


def neighbour_pairs(df: DataFrame, time: str, row_id: str, eps: float,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Every unordered pair of rows at most `eps` apart, the earlier one on the left."""
    pairs = band_join(df, df, time, time, 0.0, eps, keys)
    earlier = (F.col(time + "_l") < F.col(time + "_r")) | (
        (F.col(time + "_l") == F.col(time + "_r")) & (F.col(row_id + "_l") < F.col(row_id + "_r"))
    )
    return pairs.where(earlier)


def cross_pairs(left: DataFrame, right: DataFrame, left_time: str, right_time: str, eps: float,
                keys: Sequence[str] = ()) -> DataFrame:
    """Every pair across two tables at most `eps` apart."""
    return band_join(left, right, left_time, right_time, eps, eps, keys)


# Cell widths are every third power of two, so that an interval's own length picks them. Each level in use is one more
# entry of every shorter interval; a cell that is up to eight times as wide costs comparisons only, and no shuffle.
_FINEST, _COARSEST, _STEP = -30, 40, 3


def _level(low: Column, high: Column, finest: int) -> Column:
    length = F.greatest(high - low, F.lit(2.0 ** finest))
    steps = F.ceil((F.ceil(F.log2(length)) - F.lit(finest)) / F.lit(_STEP)).cast("int")
    return F.least(F.greatest(F.lit(finest) + F.lit(_STEP) * steps, F.lit(finest)), F.lit(_COARSEST))


def _cells(low: Column, high: Column, level: Column) -> Column:
    size = F.pow(F.lit(2.0), level.cast("double"))
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


# One end of an interval: the name of a column, or what is made of columns, given how their names read there. What is made
# is made again behind the shuffle and does not travel.
End = str | Callable[[Callable[[str], Column]], Column]


def _ends(span: tuple[End, End], suffix: str = "") -> list[Column]:
    at = lambda name: F.col(name + suffix)
    return [at(end) if isinstance(end, str) else end(at) for end in span]


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[End, End],
                 right_span: tuple[End, End], keys: Sequence[str] = (), finest: int = -4,
                 suffixes: tuple[str, str] = ("_l", "_r"), right_like: DataFrame | None = None) -> DataFrame:
    """Pairs of closed intervals that share an instant, within equal `keys`.

    An interval lives in cells about as wide as itself, so it covers two of them
    however long it is, and one long interval widens nobody else's search. A
    short interval is also entered in the coarser cells that the other side is
    at home in, where it meets the long ones only: two intervals meet at the
    level of the longer.

    :param finest: log2 of the narrowest cell, in the unit of the intervals.
    :param right_like: a cheaper table whose intervals are as long as the right ones but for rounding; their widths are read there.
    """
    finest = max(finest, _FINEST)
    a, b = _renamed(left, suffixes[0], keys), _renamed(right, suffixes[1], keys)
    a_lo, a_hi = _ends(left_span, suffixes[0])
    b_lo, b_hi = _ends(right_span, suffixes[1])
    a, b = a.where(a_lo <= a_hi), b.where(b_lo <= b_hi)
    a, b = a.withColumn("_al", _level(a_lo, a_hi, finest)), b.withColumn("_bl", _level(b_lo, b_hi, finest))
    # At most one value per width of cells, a dozen or two for each side.
    levels = lambda df, own, name: df.agg(F.array_sort(F.collect_set(own)).alias(name))
    a_levels, b_levels = levels(a, "_al", "_used"), levels(b, "_bl", "_used")
    if right_like is not None:
        low, high = _ends(right_span)
        # A level that no interval has costs entries only, so both sides of a power of two are named where rounding could decide.
        near = F.explode(F.array(*[_level(low, high + by, finest) for by in (-1e-6, 0.0, 1e-6)]))
        b_levels = levels(right_like.where(low <= high).select(near.alias("_bl")), "_bl", "_used")
    a = a.crossJoin(F.broadcast(b_levels))
    b = b.crossJoin(F.broadcast(a_levels))

    def enter(df: DataFrame, own: str, low: Column, high: Column, at_home: Column, guest: Column) -> DataFrame:
        """At home once for each role, and as a guest wherever the other side is at home in wider cells."""
        home = F.transform(at_home, lambda r: F.struct(F.col(own).alias("lv"), r.alias("role")))
        wider = F.transform(F.filter("_used", lambda lv: lv > F.col(own)), lambda lv: F.struct(lv.alias("lv"), guest.alias("role")))
        out = df.withColumn("_e", F.explode(F.concat(home, wider))).drop("_used", own)
        out = out.withColumn("_lv", F.col("_e.lv")).withColumn("_role", F.col("_e.role")).drop("_e")
        out = out.select("*", F.posexplode(_cells(low, high, F.col("_lv"))).alias("_nth", "_cell"))
        return out.withColumn(f"_first{own}", F.col("_nth") == 0).drop("_nth")

    # Roles tell whether the right interval is at home (1) or a guest (2). A left one at home meets both, a guest only the first.
    to_home, to_guest = F.lit(1), F.lit(2)
    hosts = F.exists("_used", lambda lv: lv < F.col("_al"))
    a = enter(a, "_al", a_lo, a_hi, F.when(hosts, F.array(to_home, to_guest)).otherwise(F.array(to_home)), to_home)
    b = enter(b, "_bl", b_lo, b_hi, F.array(to_home), to_guest)
    # A pair sharing several cells is kept in the first one both cover, where one of them begins.
    return (
        a.join(b, on=["_cell", "_lv", "_role", *keys])
        .where((F.col("_first_al") | F.col("_first_bl")) & (a_lo <= b_hi) & (b_lo <= a_hi))
        .drop("_lv", "_role", "_cell", "_first_al", "_first_bl")
    )


def interval_pairs(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_anchor: str,
                   reach: float = 0.0, keys: Sequence[str] = (), finest: int = -4) -> DataFrame:
    """Pairs whose right anchor falls in `[left_lo - reach, left_hi]`."""
    lo, hi = left_span
    widened = left.withColumn("_lo", F.col(lo) - F.lit(float(reach)))
    points = right.withColumn("_at", F.col(right_anchor))
    return overlap_join(widened, points, ("_lo", hi), ("_at", "_at"), keys, finest).drop("_lo_l", "_at_r")


def nearest_within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, reach: float,
                   left_id: str, right_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """For each left row the nearest right row within `reach`, and how many there are.

    Both tables are laid on one time axis and scanned once: a left row reads the
    last right instant before it and the first after it, and two markers at the
    edges of its window read the running count. No pairs are formed, so the work
    stays linear however dense the window is.

    Output: `keys`, `l` and `r` (the two rows as structs), `n_matches`. A tie in
    distance goes to the earlier right row, then to the lower id.
    """
    keys = list(keys)
    reach_c = F.lit(float(reach))
    l_row = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    r_row = F.struct(F.col(right_id).alias("_first_by"),
                     *[F.col(c) for c in right.columns if c not in keys])
    # Right rows at one instant are one row with a count: a burst of them at the
    # same time cannot pile up.
    instants = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.min(r_row).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    none_l = F.lit(None).cast(left.select(l_row.alias("x")).schema["x"].dataType)
    none_r = F.lit(None).cast(instants.schema["_r"].dataType)
    no_id = F.lit(None).cast(left.schema[left_id].dataType)
    data = instants.select(*keys, "_t", F.lit(1).alias("_tag"), no_id.alias("_lid"),
                           none_l.alias("_l"), "_r", F.col("_n"))

    def marker(shift: Column, tag: int, payload: Column) -> DataFrame:
        return left.select(*keys, (F.col(left_time) + shift).alias("_t"), F.lit(tag).alias("_tag"),
                           F.col(left_id).alias("_lid"), payload.alias("_l"), none_r.alias("_r"),
                           F.lit(0).cast("long").alias("_n"))

    axis = data.unionByName(marker(-reach_c, 0, none_l)).unionByName(
        marker(F.lit(0.0), 2, l_row)).unionByName(marker(reach_c, 3, none_l))
    # Only counted, which reads no column that is not filtered on.
    slabs = slabs_for(left.sparkSession, 3 * left.count() + right.count())
    scanned = prefix_scan(axis, keys, ["_t", "_tag", "_lid"], sums={"_cum": "_n"},
                          previous={"_prev": "_r"}, following={"_next": "_r"}, slabs=slabs)
    at = lambda tag, col: F.max(F.when(F.col("_tag") == tag, F.col(col)))
    own = [F.when(F.col("_tag") == 2, F.col(c)).alias(c) for c in ("_l", "_prev", "_next")]
    marks = scanned.where(F.col("_tag") != 1).select(*keys, "_lid", "_tag", "_cum", *own)
    if slabs > shuffle_partitions(left.sparkSession):
        marks = marks.repartition(slabs, *keys, "_lid")
    per_left = marks.groupBy(*keys, "_lid").agg(
        (at(3, "_cum") - at(0, "_cum")).alias("n_matches"),
        at(2, "_l").alias("l"), at(2, "_prev").alias("_prev"), at(2, "_next").alias("_next"),
    )
    back = F.col(f"l.{left_time}") - F.col(f"_prev.{right_time}")
    ahead = F.col(f"_next.{right_time}") - F.col(f"l.{left_time}")
    nearest = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    return (
        per_left.where(F.col("n_matches") > 0)
        .withColumn("_best", F.coalesce(nearest, F.col("_next")))
        .select(*keys, "l", F.struct(*[F.col("_best").getField(c).alias(c)
                                       for c in right.columns if c not in keys]).alias("r"), "n_matches")
    )


def count_inside(spans: DataFrame, points: DataFrame, span: tuple[str, str], point_time: str,
                 span_id: str, keys: Sequence[str] = (), output: str = "n_inside") -> DataFrame:
    """How many points each closed span contains, by one scan and no pairs."""
    keys = list(keys)
    lo, hi = span
    data = points.groupBy(*keys, F.col(point_time).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    no_id = F.lit(None).cast(spans.schema[span_id].dataType)
    data = data.select(*keys, "_t", F.lit(1).alias("_tag"), no_id.alias("_sid"), "_n")
    mark = lambda col, tag: spans.select(*keys, F.col(col).alias("_t"), F.lit(tag).alias("_tag"),
                                         F.col(span_id).alias("_sid"), F.lit(0).cast("long").alias("_n"))
    scanned = prefix_scan(data.unionByName(mark(lo, 0)).unionByName(mark(hi, 2)), keys,
                          ["_t", "_tag", "_sid"], sums={"_cum": "_n"})
    at = lambda tag: F.max(F.when(F.col("_tag") == tag, F.col("_cum")))
    return scanned.where(F.col("_tag") != 1).groupBy(*keys, F.col("_sid").alias(span_id)).agg(
        (at(2) - at(0)).alias(output)
    )


def sums_within(df: DataFrame, time: str, row_id: str, reach: float, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`row_id` and, for each of `values`, its sum over the rows that `neighbour_pairs` pairs a row with, by one scan and no pairs.

    A row stands on the axis at its time and `reach` later. What has begun by the end of its own reach, less what has ended
    its reach before the row, is what lies near. The values are whole numbers, so that long sums lose nothing; ids are unique.
    """
    keys = list(keys)
    zero = F.lit(0)
    at = lambda shift, tag, own: df.select(
        *keys, (F.col(time) + shift).alias("_t"), F.lit(tag).alias("_tag"), F.col(row_id).alias("_id"),
        *[(F.col(v) if own else zero.cast(df.schema[v].dataType)).alias(f"_begun_{v}") for v in values],
        *[(zero.cast(df.schema[v].dataType) if own else F.col(v)).alias(f"_ended_{v}") for v in values])
    axis = at(F.lit(0.0), 0, True).unionByName(at(F.lit(float(reach)), 1, False))
    slabs = slabs_for(df.sparkSession, 2 * df.count())
    scanned = prefix_scan(axis, keys, ["_t", "_tag", "_id"], slabs=slabs, sums={
        f"_{c}{v}": f"_{c}_{v}" for v in values for c in ("begun", "ended")})
    pick = lambda tag, c: F.max(F.when(F.col("_tag") == tag, F.col(c)))
    return scanned.groupBy(F.col("_id").alias(row_id)).agg(*[
        (pick(1, f"_begun{v}") - pick(0, f"_ended{v}") - pick(0, f"_begun_{v}")).alias(v) for v in values])


def as_of(points: DataFrame, table: DataFrame, point_time: str, table_time: str, table_row: str,
          point_id: str, keys: Sequence[str] = ()) -> DataFrame:
    """`points` with `before` and `after`: the table rows just at-or-before and just after.

    `table` must hold one row per key and instant; `table_row` names the column
    handed over.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in points.columns if c not in keys])
    none_p = F.lit(None).cast(points.select(payload.alias("x")).schema["x"].dataType)
    none_t = F.lit(None).cast(table.schema[table_row].dataType)
    no_id = F.lit(None).cast(points.schema[point_id].dataType)
    axis = table.select(*keys, F.col(table_time).alias("_t"), F.lit(0).alias("_tag"), no_id.alias("_pid"),
                        none_p.alias("_p"), F.col(table_row).alias("_v")).unionByName(
        points.select(*keys, F.col(point_time).alias("_t"), F.lit(1).alias("_tag"),
                      F.col(point_id).alias("_pid"), payload.alias("_p"), none_t.alias("_v")))
    scanned = prefix_scan(axis, keys, ["_t", "_tag", "_pid"], previous={"before": "_v"},
                          following={"after": "_v"})
    return scanned.where(F.col("_tag") == 1).select(
        *keys, *[F.col("_p").getField(c).alias(c) for c in points.columns if c not in keys], "before", "after")
