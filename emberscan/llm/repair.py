"""Repair of conversation structure by iterative-deepening A*.

A conversation is right when the initials of its roles read `(s?(ua)+)?`. The cheapest edits that make it so are searched
depth first, in ASCII order of the edits' initials, under a cost bound that grows by one: the first path that is accepted is
the cheapest, and the least of the cheapest ones. A table remembers for each place and state the largest budget that failed
there; it holds for every bound and every way to get there, so no state is opened twice for one budget.

A conversation may have any length. It is cut into blocks of `BLOCK` rows, each block is searched on its own for every state
it may begin and end with, and the blocks of a conversation are then chained. Equally cheap edits of the same rows never
begin one with the other, so the least of a chain is the chain of the least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.llm.store import prepare, written
from emberscan.operators.scan import lookup_join
from emberscan.session import shuffle_partitions

#: Rows that are searched together.
BLOCK = 64
BLOCK_BITS = BLOCK.bit_length() - 1

#: What may be done, its price, and the price of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn that is made up or given a role becomes in each state.
TURN_TO = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Which initials may be kept in each state, and the state after.
KEEP_TO = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LEGAL = {"su", "ua", "au"}

#: Faults of a row; the first that applies.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)

_KEY = [("conv", pa.int64()), ("no_conv", pa.bool_())]
_KEY_DDL = "conv long, no_conv boolean"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCKS = pa.schema([
    *_KEY, ("block", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string())), *((c, pa.int64()) for c in _COUNTS), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())])
_BLOCKS_DDL = (f"{_KEY_DDL}, block long, begins array<int>, ends array<int>, costs array<long>, audits array<string>, "
               + ", ".join(f"{c} long" for c in _COUNTS) + ", first_initial string, last_initial string, first_turn long, last_turn long, turns long")
_VERDICT = pa.schema([*_KEY, ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())])
_VERDICT_DDL = f"{_KEY_DDL}, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"
_TURNS = pa.schema([*_KEY, ("seat", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURNS_DDL = f"{_KEY_DDL}, seat long, edit string, role string, text string"
_HASHES = pa.schema([*_KEY, ("repaired_sha256", pa.string())])
_HASHES_DDL = f"{_KEY_DDL}, repaired_sha256 string"


class Search:
    """The cheapest edits of some rows, given as (initial of the role, fault)."""

    def __init__(self, rows: list[tuple[str, int]], goal: frozenset[int], final: bool):
        self.rows, self.goal, self.final = rows, goal, final
        # No row is settled for less than this, whatever the state: the estimate never exceeds what is left to pay.
        self.left = [0] * (len(rows) + 1)
        for k in range(len(rows) - 1, -1, -1):
            initial, fault = rows[k]
            self.left[k] = self.left[k + 1] + (DELETE if fault else 0 if initial in ("s", "u", "a") else REROLE)
        self.failed: dict[int, int] = {}

    def cheapest(self, state: int) -> tuple[int, str] | None:
        """Cost and edits from `state` to the goal; None if the goal can't be reached."""
        if state == START and self.goal == {SYSTEM} and not any(i == "s" and f not in (BLANK, DUPLICATE) for i, f in self.rows):
            return None
        for bound in range(self.left[0], DELETE * len(self.rows) + 4 * INSERT + 1):
            found = self._within(0, state, bound)
            if found is not None:
                return bound, found
        return None

    def _within(self, k: int, state: int, budget: int) -> str | None:
        if budget < self.left[k]:
            return None
        at_end = k == len(self.rows)
        if at_end and state in self.goal:
            return ""
        place = k * 4 + state
        if self.failed.get(place, -1) >= budget:
            return None
        for edit, cost, to, step in self._edits(k, state, at_end):
            rest = self._within(k + step, to, budget - cost)
            if rest is not None:
                return edit + rest
        self.failed[place] = budget
        return None

    def _edits(self, k: int, state: int, at_end: bool) -> Iterator[tuple[str, int, int, int]]:
        if not at_end:
            yield "D", DELETE, state, 1
        if not at_end or self.final:
            yield "I", INSERT, TURN_TO[state], 0
        if not at_end:
            initial, fault = self.rows[k]
            if fault not in (BLANK, DUPLICATE):
                price = TRUNCATED if fault == CUT_OFF else 0
                if initial in KEEP_TO[state]:
                    yield "K", price, KEEP_TO[state][initial], 1
                yield "R", REROLE + price, TURN_TO[state], 1


def search_block(rows: list[tuple[str, int]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """`(begin, end, cost, edits)` for every state a block may begin and end with.

    The first block begins at the start; the last one ends in an accepted state, named `START` there.
    """
    begins = (START,) if first else (START, SYSTEM, USER, ASSISTANT)
    goals = {START: frozenset((START, ASSISTANT))} if last else {s: frozenset((s,)) for s in (START, SYSTEM, USER, ASSISTANT)}
    out = []
    for end, goal in goals.items():
        search = Search(rows, goal, last)
        for begin in begins:
            if not last and end < begin and end in (START, SYSTEM):
                continue  # nothing leads back there
            found = search.cheapest(begin)
            if found is not None:
                out.append((begin, end, *found))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns, across batches. For groups of bounded size only."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _sorted_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def _visible_end(text: Column) -> Column:
    """The last character that is no ASCII white space; empty if there is none."""
    # SQL's TRIM takes the characters to remove as a set.
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, each with its place `pos`, written out.

    The order is total and no key can fill a partition: equal rows are told apart by where they were read.
    """
    given = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"),
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    ending = _visible_end(F.col("text"))
    marked = given.select(
        "*", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(ending == "", BLANK).when(ending.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF).alias("fault"),
        F.substring("role", 1, 32).alias("_role"), F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_read"))
    order = ["no_conv", "conv", "turn", "_role", "_text"]
    ranged = marked.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, "_read").sortWithinPartitions(*order, "role", "digest", "_read")
    return written(ranged.select("conv", "no_conv", "turn", "role", "text", "digest", "fault", F.monotonically_increasing_id().alias("pos")), "ordered")


def _search_blocks(ordered: DataFrame) -> DataFrame:
    """One row a block: its cheapest edits from any state to any, and what it adds to the counts."""
    key = ["conv", "no_conv"]
    narrow = ordered.select(*key, "turn", "role", "digest", "fault", "pos")
    copies = narrow.groupBy(*key, "role", "digest").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = lookup_join(narrow, copies, [*key, "role", "digest"], "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("pos") > F.col("first_pos"), DUPLICATE).otherwise(F.col("fault"))
    block = F.shiftright("pos", BLOCK_BITS)
    spans = narrow.groupBy(*key).agg(F.min(block).alias("first_block"), F.max(block).alias("last_block"))
    rows = lookup_join(known.withColumn("fault", fault).withColumn("block", block), spans, key).select(
        *key, "block", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault",
        (F.col("block") == F.col("first_block")).alias("first"), (F.col("block") == F.col("last_block")).alias("last"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, no_conv, number), group in _groups(batches, 3):
            _, turns, initials, faults, first, last = zip(*group, strict=True)
            found = search_block(list(zip(initials, faults, strict=True)), first[0], last[0])
            begins, ends, costs, audits = zip(*found, strict=True)
            some = [t for t in turns if t is not None]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))
            out.append(dict(zip(_BLOCKS.names, (
                conv, no_conv, number, begins, ends, costs, audits, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), illegal,
                initials[0], initials[-1], some[0] if some else None, some[-1] if some else None, len(set(some))), strict=True)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)

    return _sorted_by(rows, [*key, "block"], "pos").mapInArrow(searched, _BLOCKS_DDL)


class Chain:
    """The blocks of one conversation put together, one after the other.

    For each state: cost, rank of its edits among the states' (no two are equal or begin one with the other), and the edits
    as a list that shares its beginning.
    """

    def __init__(self):
        self.best: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        self.counts = [0] * len(_COUNTS)
        self.initial: str | None = None
        self.turn: int | None = None
        self.lowest: int | None = None
        self.turns = 0

    def add(self, row: dict) -> None:
        reached: dict[int, tuple[int, int, str, tuple | None]] = {}
        for begin, end, cost, audit in zip(row["begins"], row["ends"], row["costs"], row["audits"], strict=True):
            if begin in self.best:
                so_far, rank, edits = self.best[begin]
                way = (so_far + cost, rank, audit, edits)
                if end not in reached or way[:3] < reached[end][:3]:
                    reached[end] = way
        ranks = {end: k for k, end in enumerate(sorted(reached, key=lambda e: reached[e][1:3]))}
        self.best = {end: (cost, ranks[end], (edits, audit)) for end, (cost, _, audit, edits) in reached.items()}
        for k, name in enumerate(_COUNTS):
            self.counts[k] += row[name]
        if self.initial is not None and self.initial + row["first_initial"] not in LEGAL:
            self.counts[_COUNTS.index("illegal")] += 1
        self.initial = row["last_initial"]
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (self.turn == row["first_turn"])
            self.turn = row["last_turn"]
            self.lowest = row["first_turn"] if self.lowest is None else self.lowest

    def verdict(self, key: tuple) -> dict:
        cost, _, edits = self.best[START]
        pieces = []
        while edits is not None:
            edits, piece = edits
            pieces.append(piece)
        gaps = 0 if self.turn is None else min(self.turn - self.lowest + 1 - self.turns, 2**63 - 1)
        return dict(zip(_VERDICT.names, (*key, gaps, *self.counts, cost, "".join(reversed(pieces))), strict=True))


def _chain(blocks: DataFrame) -> DataFrame:
    """One row a conversation. A conversation's blocks stream by one at a time."""
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, Chain()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["conv"], row["no_conv"]) != key:
                    if key is not None:
                        out.append(chain.verdict(key))
                    key, chain = (row["conv"], row["no_conv"]), Chain()
                chain.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_VERDICT)
        if key is not None:
            yield pa.RecordBatch.from_pylist([chain.verdict(key)], schema=_VERDICT)

    return _sorted_by(blocks, ["conv", "no_conv"], "block").mapInArrow(chained, _VERDICT_DDL)


@dataclass(frozen=True)
class Repaired:
    """`verdicts`: counts, cost and edits of each conversation. `turns`: the repaired conversations, turn by turn, each
    conversation whole and in order within its partition."""

    verdicts: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repaired:
    """Cheapest edits that give every conversation its form, and the repaired turns.

    Rows are taken by `turn` (NULLs first), equal turns by role, then by text in an order of its own, so that equal rows are
    neighbours. A row's fault is the first that applies: blank (no visible character), duplicate (role and text stood earlier
    in the conversation), truncated (the last visible character is none of `.!?`). Keeping a row costs nothing, giving it the
    role the form wants 1, deleting it 2 (blank and duplicate rows must go), an empty turn made up anywhere 5, and a
    truncated row that stays 5 more.

    Defined results: NULL role or text is one space (a role that can't be kept, a blank text); NULL `conv_id` is a conversation
    of its own; repeated rows are duplicates; a table without rows gives none; other columns are ignored. Gaps beyond 64 bits
    are given as the largest number. Working tables stay in the checkpoint folder as the two results read them.
    """
    spark = rows.sparkSession
    prepare(spark)
    ordered = _ordered(rows)
    blocks = written(_search_blocks(ordered), "blocks")
    verdicts = written(_chain(blocks), "verdicts")

    # The edits of a conversation come before its rows; both stream by.
    edits = verdicts.select("conv", "no_conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = _sorted_by(edits.unionByName(ordered.select("conv", "no_conv", "pos", "role", "text")), ["conv", "no_conv"], "pos")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, seat = "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, no_conv, pos, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if pos < 0:
                    audit, at, state, seat = text, 0, START, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = KEEP_TO[state][role[:1]]
                    elif edit == "R":
                        state = TURN_TO[state]
                        role = ROLES[state]
                    if edit != "D":
                        out.append((conv, no_conv, seat, edit, role, text))
                        seat += 1
                # Turns made up stand before the next row, or at the end.
                while at < len(audit) and audit[at] == "I":
                    at, state = at + 1, TURN_TO[state]
                    out.append((conv, no_conv, seat, "I", ROLES[state], ""))
                    seat += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TURNS.types, strict=True)], schema=_TURNS)

    turns = stream.mapInArrow(applied, _TURNS_DDL)
    return Repaired(verdicts, turns)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 over `role:text` of each conversation's turns, joined by newlines. Text streams by, no conversation is held."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for conv, no_conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (conv, no_conv) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (conv, no_conv), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _HASHES.types, strict=True)], schema=_HASHES)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], schema=_HASHES)

    return turns.select("conv", "no_conv", "role", "text").mapInArrow(hashed, _HASHES_DDL)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of `conv_id:turn`, NULLs being one space.

    Of twenty values 0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats the row, 4 makes it the user's.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))
    return rows.where("what != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def repair_report(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """`conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256` for every id of `conv_ids`.

    Ids without rows have zeros, no edits and the hash of the empty text.
    """
    done = repair(rows)
    key = ["conv", "no_conv"]
    every = conv_ids.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv")).distinct()
    joined = every.join(done.verdicts, key, "left").join(digests(done.turns), key, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    empty = hashlib.sha256().hexdigest()
    return joined.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
