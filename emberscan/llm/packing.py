"""Token pieces packed into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.batches import chunks, mix
from emberscan.llm.store import prepare, written
from emberscan.llm.tokens import TEXT_CHUNK, encoder

CAPACITY = 1024
END_ID = 2
#: Pieces an island is dealt, on average.
ISLAND = 1500
POPULATION = 6
GENERATIONS = 14
#: Rounds of islands; in between, the best groups leave and the rest is dealt anew.
EPOCHS = 3
#: A group with at most so much room left is elite.
ELITE_ROOM = 2

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
_PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, island long, bin long, offset long, room long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: ids, then the end id, cut only beyond `capacity` (the first piece takes the remainder).

    `deal` is a random number for dealing pieces to islands; repeated rows get different ones.
    """
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = 0
        for batch in batches:
            for part, texts in chunks(batch, "text", TEXT_CHUNK):
                coder = encoder(tokenizer)
                counts, slot = coder.encode(texts)
                ids = coder.flat_ids(slot).astype("<u4")
                stops = np.cumsum(counts)
                docs_, piece, start, length, crc = [], [], [], [], []
                tail = np.array([end_id], "<u4")
                for row, (doc, stop, count) in enumerate(zip(part.column("doc_id").to_pylist(), stops.tolist(), counts.tolist(), strict=True)):
                    all_ids = np.concatenate((ids[stop - count:stop], tail))
                    first = len(all_ids) % capacity or min(capacity, len(all_ids))
                    begins = [0, *range(first, len(all_ids), capacity)]
                    for k, begin in enumerate(begins):
                        end = begin + (capacity if k else first)
                        docs_.append(doc)
                        piece.append(k)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(crc32(all_ids[begin:end].tobytes()))
                size = len(docs_)
                deal = mix(np.arange(tally, tally + size, dtype=np.uint64) ^ mix(np.array([x or 0 for x in docs_], np.int64).view(np.uint64)))
                tally += size
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs_, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array((deal >> np.uint64(1)).astype(np.int64))], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES_DDL)


class Grouping:
    """One way to group items: each item's group, and each group's load."""

    def __init__(self, sizes: np.ndarray, groups: np.ndarray, loads: list[int]):
        self.sizes, self.groups, self.loads = sizes, groups, loads

    def fitness(self, capacity: int) -> float:
        """Falkenauer's measure: mean squared fill. Fewer and fuller groups score higher."""
        loads = np.array(self.loads, float)
        return float(np.mean((loads[loads > 0] / capacity) ** 2))

    def place(self, items: np.ndarray, capacity: int) -> None:
        """Best fit, largest first: each item goes where the least room is left over."""
        room = sorted((capacity - load, g) for g, load in enumerate(self.loads) if 0 < load < capacity)
        free = [g for g, load in enumerate(self.loads) if load == 0]
        for item in items[np.argsort(-self.sizes[items], kind="stable")].tolist():
            size = int(self.sizes[item])
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, g = room.pop(at)
            elif free:
                left, g = capacity, free.pop()
            else:
                left, g = capacity, len(self.loads)
                self.loads.append(0)
            self.groups[item] = g
            self.loads[g] += size
            if left > size:
                insort(room, (left - size, g))


def crossover(one: Grouping, other: Grouping, capacity: int, rng: np.random.Generator) -> Grouping:
    """`one` with some well-filled groups of `other`; groups that held their items go, and displaced items are best-fitted."""
    loads = np.array(other.loads)
    filled = np.flatnonzero(loads > 0)
    filled = filled[np.argsort(-(loads[filled] + rng.random(len(filled)) * 0.01 * capacity), kind="stable")]
    chosen = np.zeros(len(loads), bool)
    best = filled[:max(1, len(filled) // 2)]
    chosen[best[rng.random(len(best)) < 0.6]] = True
    injected = chosen[other.groups]
    broken = np.zeros(len(one.loads), bool)
    broken[one.groups[injected]] = True
    displaced = np.flatnonzero(broken[one.groups] & ~injected)
    groups = np.full(len(one.groups), -1, np.int64)
    kept = ~broken[one.groups] & ~injected
    rename = np.cumsum(~broken) - 1
    groups[kept] = rename[one.groups[kept]]
    offset = int((~broken).sum())
    rename = np.cumsum(chosen) - 1 + offset
    groups[injected] = rename[other.groups[injected]]
    child = Grouping(one.sizes, groups, [*np.array(one.loads)[~broken].tolist(), *loads[chosen].tolist()])
    # A few badly filled groups are broken up as well, so that there is something to regroup.
    loads = np.array(child.loads)
    poor = np.flatnonzero((loads > 0) & (loads < capacity - ELITE_ROOM) & (rng.random(len(loads)) < 0.15))
    loose = np.isin(child.groups, poor)
    for g in poor.tolist():
        child.loads[g] = 0
    child.place(np.concatenate((displaced, np.flatnonzero(loose))), capacity)
    return child


def evolve(sizes: np.ndarray, capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The group of each item in the best grouping found."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)

    def started(first: bool) -> Grouping:
        new = Grouping(sizes, np.full(len(sizes), -1, np.int64), [])
        if first:
            new.place(np.arange(len(sizes)), capacity)
        else:
            # A random share is placed first, so that the groupings differ.
            early = rng.random(len(sizes)) < 0.5
            new.place(np.flatnonzero(early), capacity)
            new.place(np.flatnonzero(~early), capacity)
        return new

    pool = sorted((started(k == 0) for k in range(population)), key=lambda x: -x.fitness(capacity))
    for _ in range(generations):
        if sum(load > 0 for load in pool[0].loads) <= bound:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[min(a, b)], pool[max(a, b)], capacity, rng)
        if child.fitness(capacity) > pool[-1].fitness(capacity):
            pool[-1] = child
            pool.sort(key=lambda x: -x.fitness(capacity))
    return pool[0].groups


def pack_island(table: pa.Table, capacity: int) -> pa.Table:
    """Group the pieces of one island and lay each group out."""
    length = table.column("length").to_numpy()
    groups = np.empty(len(length), np.int64)
    partial = np.flatnonzero(length < capacity)
    whole = np.flatnonzero(length >= capacity)
    # A fixed order first: what comes out then depends on the pieces, not on how they arrived.
    deal = table.column("deal").to_numpy()
    partial = partial[np.argsort(deal[partial], kind="stable")]
    if len(partial):
        groups[partial] = evolve(length[partial], capacity, int(deal[partial[0]]) & 0x7FFFFFFF)
    used = int(groups[partial].max()) + 1 if len(partial) else 0
    groups[whole] = used + np.arange(len(whole))
    order = np.lexsort((deal, groups))
    g, size = groups[order], length[order]
    total = np.cumsum(size) - size
    first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.empty(0, bool)
    offset = total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(g))))
    load = np.bincount(g, weights=size).astype(np.int64) if len(g) else np.empty(0, np.int64)
    return table.take(pa.array(order)).append_column("bin", pa.array(g)).append_column(
        "offset", pa.array(offset)).append_column("room", pa.array(capacity - load[g]))


def pack(rows: DataFrame, capacity: int = CAPACITY, epochs: int = EPOCHS) -> DataFrame:
    """Pack pieces into sequences: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    Pieces are dealt at random to islands of a bounded size, however many there are. Every island evolves its own
    groupings. Then elite groups, which have no room worth filling, migrate into the result, and the pieces of all
    other groups are dealt to new islands; what the last round makes stands. Each round is written, so a lost executor
    costs one island.

    Defined results: an empty text is one piece with the end id only; a NULL `doc_id` is kept; repeated rows are packed
    as often as they occur; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    prepare(spark)
    left = written(rows, "pieces")
    done: DataFrame | None = None
    for epoch in range(epochs):
        count = left.count()
        islands = max(1, -(-count // ISLAND))
        dealt = left.withColumn("island", F.pmod(F.xxhash64("deal", F.lit(epoch)), F.lit(islands)).cast("long"))
        packed = written(dealt.groupBy("island").applyInArrow(lambda t: pack_island(t, capacity), _PACKED_DDL), "islands")
        last = epoch == epochs - 1 or islands == 1
        elite = packed if last else packed.where(F.col("room") <= ELITE_ROOM)
        elite = elite.withColumn("epoch", F.lit(epoch))
        done = elite if done is None else done.unionByName(elite)
        if last:
            break
        left = packed.where(F.col("room") > ELITE_ROOM).select(*rows.columns)
    number = F.col("epoch").cast("long") * F.lit(1 << 60) + F.col("island") * F.lit(1 << 24) + F.col("bin")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
