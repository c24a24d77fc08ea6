"""Near-duplicate vectors by product quantisation: inverted lists, table look-ups, exact rerank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.graph import components
from emberscan.llm.store import prepare, written

THRESHOLD = 0.93
#: Vectors the centroids and codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a label per coarse list aimed at, and bounds on the number of lists.
PER_LIST = 800
MAX_LISTS = 1024
SUBSPACES = 8
CODES = 64
#: Indexed vectors, and queries, that meet in one task.
BLOCK = 1024


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


class Quantiser:
    """Coarse centroids, and codebooks of what is left of a vector, for unit vectors of one length."""

    def __init__(self, size: int, sample: np.ndarray, lists: int):
        self.size = size
        if len(sample):
            self.centres = _kmeans(sample, lists, 11)
            left = sample - self.centres[self.nearest(sample)[0]]
        else:
            # Nothing of this length was in the sample: one list, and no codes worth the name.
            self.centres, left = np.zeros((1, size)), np.zeros((1, size))
        self.cuts = np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int)
        self.books = [_kmeans(left[:, a:b], CODES, 100 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares = (self.centres ** 2).sum(1) - 2 * x @ self.centres.T
        return np.argmin(squares, axis=1), squares

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each vector, and which lists a vector within `reach` of it may be in."""
        own, squares = self.nearest(x)
        apart = np.linalg.norm(self.centres[own][:, None] - self.centres[None], axis=2)
        beyond = (squares - squares[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart, 1e-12)
        # All of a list lies on its side of the border, so nothing nearer than the border can be there.
        return own, beyond <= reach + 1e-9

    def encode(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far the decoded residual is off."""
        codes, error = np.empty((len(left), len(self.books)), np.uint8), np.zeros(len(left))
        for s, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            squares = (book ** 2).sum(1) - 2 * left[:, a:b] @ book.T
            codes[:, s] = np.argmin(squares, axis=1)
            error += ((left[:, a:b] - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def distances(self, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances from residuals of queries to coded residuals, summed from tables of each query."""
        total = np.zeros((len(left), len(codes)))
        for s, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            table = ((left[:, None, a:b] - book[None]) ** 2).sum(2)
            total += table[:, codes[:, s]]
        return np.sqrt(total)


def _units(vectors: list) -> tuple[list[bytes | None], list[bytes | None]]:
    """Unit vector and digest of each usable vector."""
    units, digests = [], []
    for v in vectors:
        x = np.array([np.nan if y is None else y for y in v], float) if v is not None else np.empty(0)
        scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
        if not scale:
            units.append(None)
            digests.append(None)
            continue
        unit = x / scale
        unit /= np.sqrt((unit * unit).sum())
        units.append(unit.tobytes())
        digests.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
    return units, digests


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units, digests = _units(batch.column("embedding").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary()), pa.array(digests, pa.binary())],
            ["vec_id", "label", "unit", "digest"])


def _least_in_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position each of `n` places is connected with."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, least):
            return least
        least = new


def _linked(models: dict[int, Quantiser], threshold: float):
    def compare(table):
        """Links between the queries and the indexed vectors of one block of one list."""
        query = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        copies, spot = table.column("copies").to_numpy(), int(table.column("list")[0].as_py())
        units = [np.frombuffer(v, float) for v in table.column("unit").to_pylist()]
        model = models.get(len(units[0])) or Quantiser(len(units[0]), np.empty((0, len(units[0]))), 1)
        x = np.stack(units)
        ask, have = np.flatnonzero(query), np.flatnonzero(~query)
        out: dict[str, np.ndarray] = {"rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "other": np.empty(0, np.int64)}
        if len(ask) and len(have):
            left = x - model.centres[spot]
            codes, error = model.encode(left[have])
            reach = np.sqrt(2 - 2 * threshold)
            near = model.distances(left[ask], codes) <= (reach + error)[None] + 1e-9
            # Within its own list a vector asks the ones behind it only.
            near &= (own[ask] != spot)[:, None] | (rep[ask][:, None] < rep[have][None])
            i, j = np.nonzero(near)
            i, j = ask[i], have[j]
            keep = np.zeros(len(i), bool)
            for lo in range(0, len(i), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                keep[some] = (x[i[some]] * x[j[some]]).sum(1) >= threshold
            i, j = i[keep], j[keep]
            if len(i):
                links = (np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))).astype(np.int64)
                some = np.flatnonzero(links)
                least = _least_in_component(len(x), i, j)
                out = {"rep": rep[some], "links": links[some], "other": rep[least[some]]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`vec_id, n_links, component_id, kept`: vectors of one label linked by cosine.

    1. Equal vectors of a label are one class; only classes are compared, links count copies.
    2. Coarse centroids and residual codebooks are fitted on a sample of at most `SAMPLE` classes. Every class is indexed
       in its nearest list, and asks its own and each later list that a linked vector may be in (`Quantiser.probes`: the
       border is no further than a linked vector, so no link is lost).
    3. A list, however long, meets its queries in blocks. In a block, distances to the codes are looked up in tables of
       each query; the error of a code is added to the reach, so the look-up loses nothing. What passes is reranked by
       the exact cosine in double precision.
    4. Blocks send link counts and one edge per vector to the least vector it is connected with there.

    Defined results: a vector that is NULL, zero, or has NULL or non-finite components, and one with a NULL label, is
    linked with nothing, as are vectors of different lengths; rows that repeat a `vec_id` count as vectors of their own;
    a NULL `vec_id` is linked with nothing (component NULL, not kept); an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = written(rows.mapInArrow(_prepared, "vec_id long, label string, unit binary, digest binary"), "units")
    usable = rows.where("unit is not null and label is not null and vec_id is not null")
    classes = written(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "classes")
    # Lists are kept by label, so the largest label says how many there should be.
    count = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    lists = int(min(MAX_LISTS, max(4, count // PER_LIST)))
    # A bounded sample comes to the driver; its order is that of a hash, so it does not depend on the layout.
    sample = classes.select("unit").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for row in sample:
        by_size.setdefault(len(row["unit"]) // 8, []).append(np.frombuffer(bytes(row["unit"]), float))
    models = {size: Quantiser(size, np.stack(found), lists) for size, found in by_size.items()}
    reach = float(np.sqrt(2 - 2 * threshold))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(v, float) for v in batch.column("unit").to_pylist()]
            sizes = np.array([len(u) for u in units])
            own, probes = np.zeros(len(units), np.int64), [[0]] * len(units)
            for size in set(sizes.tolist()) & set(models):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), 2048):
                    some = at[lo:lo + 2048]
                    mine, found = models[size].probes(np.stack([units[i] for i in some]), reach)
                    own[some] = mine
                    for i, m, f in zip(some.tolist(), mine.tolist(), found, strict=True):
                        probes[i] = [m, *(c for c in np.flatnonzero(f).tolist() if c > m)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "rep", "copies", "unit")), pa.array(sizes, pa.int64()), pa.array(own), pa.array(probes, pa.list_(pa.int64()))],
                ["label", "rep", "copies", "unit", "size", "own", "probes"])

    index = written(classes.select("label", "rep", "copies", "unit").mapInArrow(
        placed, "label string, rep long, copies long, unit binary, size long, own long, probes array<long>"), "index")
    place = ["label", "size", "list"]
    asked = index.select("label", "size", F.explode("probes").alias("list"), "rep", "own")
    held = index.select("label", "size", F.col("own").alias("list"))
    blocks = held.withColumn("asks", F.lit(0)).unionByName(asked.select(*place).withColumn("asks", F.lit(1))).groupBy(*place).agg(
        F.ceil(F.sum(1 - F.col("asks")) / BLOCK).cast("int").alias("stocks"), F.ceil(F.sum("asks") / BLOCK).cast("int").alias("turns"))
    blocks = written(blocks.where("stocks > 0"), "blocks")
    shared = ["label", "size", "list", "rep", "own", "copies", "unit", "asks", "stock", "turn"]
    probed = index.withColumn("list", F.explode("probes")).join(blocks, place).withColumn("asks", F.lit(True))
    probed = probed.withColumn("turn", F.pmod(F.xxhash64("rep"), F.col("turns")).cast("int")).withColumn("stock", F.explode(F.sequence(F.lit(0), F.col("stocks") - 1)))
    stocked = index.withColumn("list", F.col("own")).join(blocks, place).withColumn("asks", F.lit(False))
    stocked = stocked.withColumn("stock", F.pmod(F.xxhash64("rep"), F.col("stocks")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    met = probed.select(*shared).unionByName(stocked.select(*shared))
    found = written(met.groupBy(*place, "stock", "turn").applyInArrow(_linked(models, threshold), "rep long, links long, other long"), "links")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("v", "rep")
    judged = classes.select("label", "digest", "rep", "copies").join(counts, "rep", "left").join(labels, "rep", "left")
    judged = written(judged.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                   F.coalesce("component", "rep").alias("component")), "judged")
    out = rows.drop("unit").join(judged, ["label", "digest"], "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
