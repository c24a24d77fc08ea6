"""Roles of transcript turns by a hidden Markov model, and their canonical rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.store import prepare, written
from emberscan.operators import scan

#: Turns that one task decodes together; longer conversations are decoded in blocks, and blocks of blocks.
BLOCK = 64

# Names that transcripts give their speakers, by what they usually stand for.
MARKERS = {
    "user": ("user", "human", "customer", "question", "q", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt"),
    "system": ("system", "instruction", "instructions", "context"),
}
_NAMES = "|".join(sorted((m for names in MARKERS.values() for m in names), key=len, reverse=True))
_SPEAKER = rf"(?:\*\*|\[|<\|?|#+\s*)?({_NAMES})(?:(?:\*\*)?\s*:|\|?>|\]\s*:?)"
_MARKER = re.compile(rf"^\s*{_SPEAKER}\s*(?:\*\*)?\s*", re.IGNORECASE)
_KIND = {name: 1 + k for k, names in enumerate(MARKERS.values()) for name in names}

#: Values of each feature: marker, length, lines, question mark.
FEATURES = (1 + len(MARKERS), 8, 4, 2)


def observe(text: str | None) -> tuple[int, ...]:
    """The features of one turn."""
    text = text or ""
    found = _MARKER.match(text)
    lines = sum(1 for line in text.split("\n") if line.strip())
    return (_KIND[found[1].lower()] if found else 0, min(7, len(text).bit_length() // 2), min(3, lines), int("?" in text or "¿" in text))


def render(role: str, text: str | None) -> str:
    """The canonical form of a turn: its role's marker line, the text without the marker it came with, an end line."""
    body = (text or "").strip()
    found = _MARKER.match(body)
    return f"<|{role}|>\n{body[found.end():].strip() if found else body}\n<|end|>"


@dataclass
class Hmm:
    """Log probabilities. Row `len(roles)` of `moves` is the start of a conversation."""

    roles: list[str]
    moves: np.ndarray
    emissions: list[np.ndarray]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Log probability of each turn's features under each role."""
        return sum((table[:, seen[:, k]].T for k, table in enumerate(self.emissions)), np.zeros((len(seen), len(self.roles))))

    def steps(self, texts: list[str | None], first: bool) -> np.ndarray:
        """One matrix per turn: from the role before (or the start) to the turn's role."""
        own = self.scores(np.array([observe(t) for t in texts], int).reshape(-1, len(FEATURES)))
        s = len(self.roles)
        out = np.broadcast_to(self.moves, (len(texts), s + 1, s)) + own[:, None, :]
        return out


def chained(steps: np.ndarray) -> np.ndarray:
    """Best log score from each entry to each exit over several steps."""
    total = steps[0]
    s = total.shape[1]
    for step in steps[1:]:
        total = (total[:, :, None] + step[None, :s, :]).max(axis=1)
    return total


def best_path(steps: np.ndarray, enter: int, leave: int) -> list[int]:
    """The best exit of each step on the way from `enter` to `leave`; ties go to the role that sorts first."""
    s = steps.shape[2]
    score, back = steps[0][enter], []
    for step in steps[1:]:
        options = score[:, None] + step[:s]
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    path = [leave]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def _blocked(turns: DataFrame) -> DataFrame:
    """Each distinct turn once, with the conversation it is decoded in, its rank there from 1, and its block of ranks.

    A turn without a conversation or a place in one stands alone: its key is made of itself.
    """
    rows = turns.groupBy("conv_id", "turn", "text").agg(F.count("*").alias("n_rows"), *([F.min("role").alias("role")] if "role" in turns.columns else []))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    key = F.when(alone, F.concat(F.lit("-"), F.sha2(F.concat_ws("\x01", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)))
    rows = rows.withColumn("alone", alone).withColumn("chain", F.coalesce(key, F.col("conv_id").cast("string")))
    ranked = scan.prefix_scan(rows.withColumn("_one", F.lit(1)), ["chain"], ["turn", "text"], sums={"nth": "_one"})
    return ranked.drop("_one").withColumn("block", F.floor((F.col("nth") - 1) / BLOCK).cast("long"))


def split_transcripts(raw: DataFrame) -> DataFrame:
    """`conv_id, turn, text` from one text per conversation, cut before marked lines and at empty ones."""
    parts = F.split("text", rf"\n(?i)(?=\s*{_SPEAKER})|\n\s*\n")
    return raw.select("conv_id", F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("turn", "text"))


def fit(turns: DataFrame) -> Hmm:
    """Count a model from turns with known roles; what reaches the driver is counts by role and feature value."""
    prepare(turns.sparkSession)
    rows = _blocked(turns.select("conv_id", F.col("turn").cast("long"), F.col("text").cast("string"), F.col("role").cast("string")))
    # The last turn of a block is also what comes before the next one.
    last = rows.where(F.col("nth") % BLOCK == 0).withColumn("block", F.col("block") + 1)
    rows = written(rows.withColumn("counts", F.lit(True)).unionByName(last.withColumn("counts", F.lit(False)).withColumn("text", F.lit(None).cast("string"))), "turns")

    def counted(table):
        table = table.sort_by("nth")
        out: dict[tuple[str, str, int], int] = {}
        before = None
        columns = (table.column(c).to_pylist() for c in ("turn", "text", "role", "nth", "alone", "counts"))
        for turn, text, role, nth, alone, counts in zip(*columns, strict=True):
            if role is None or not counts:
                before = role
                continue
            # A turn without a conversation is the start of one only if its number says so.
            if before is not None or (turn == 0 if alone else nth == 1):
                key = ("move", before or "", 0, role)
                out[key] = out.get(key, 0) + 1
            before = role
            for k, value in enumerate(observe(text)):
                key = (f"seen{k}", "", value, role)
                out[key] = out.get(key, 0) + 1
        names = [list(x) for x in zip(*out, strict=True)] or [[], [], [], []]
        return pa.table({"kind": pa.array(names[0], pa.string()), "before": pa.array(names[1], pa.string()), "value": pa.array(names[2], pa.int64()),
                         "role": pa.array(names[3], pa.string()), "n": pa.array(list(out.values()), pa.int64())})

    found = (rows.groupBy("chain", "block").applyInArrow(counted, "kind string, before string, value long, role string, n long")
             .groupBy("kind", "before", "value", "role").agg(F.sum("n").alias("n")).collect())
    roles = sorted({r["role"] for r in found}) or ["user"]
    place = {r: i for i, r in enumerate(roles)}
    moves = np.full((len(roles) + 1, len(roles)), 0.5)
    emissions = [np.full((len(roles), size), 0.5) for size in FEATURES]
    for r in found:
        if r["kind"] == "move":
            moves[place.get(r["before"], len(roles)), place[r["role"]]] += r["n"]
        else:
            emissions[int(r["kind"][4:])][place[r["role"]], r["value"]] += r["n"]
    log = lambda m: np.log(m / m.sum(axis=1, keepdims=True))
    return Hmm(roles, log(moves), [log(m) for m in emissions])


def decode(turns: DataFrame, model: Hmm) -> DataFrame:
    """`conv_id, turn, text, n_rows, role_pred, rendered`: the best roles of each conversation, and its turns in canonical form.

    Viterbi's recursion is a product of matrices under (max, +), so a block of turns is one small matrix, a block of
    blocks another one, until a conversation is one. Then the best way is handed down level by level: each block gets the
    roles it is entered and left with. No task sees more than `BLOCK` steps of a conversation, however long it is.

    Defined results: rows that repeat conversation, turn and text are one turn, counted in `n_rows`; different texts at
    one place follow each other in the order of their texts; a turn without conversation or place is decoded alone; NULL
    text is empty; an empty table gives an empty result; other columns are ignored.
    """
    prepare(turns.sparkSession)
    s = len(model.roles)
    slim = turns.select("conv_id", F.col("turn").cast("long"), F.col("text").cast("string"))
    rows = written(_blocked(slim), "turns")

    def summed(table):
        table = table.sort_by("nth")
        matrix = chained(model.steps(table.column("text").to_pylist(), False))
        return pa.table({"chain": table.column("chain")[:1], "place": table.column("block")[:1], "matrix": pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))})

    def climbed(table):
        table = table.sort_by("place")
        steps = np.array(table.column("matrix").to_pylist()).reshape(-1, s + 1, s)
        return pa.table({"chain": table.column("chain")[:1], "place": table.column("up")[:1], "matrix": pa.array([chained(steps).ravel().tolist()], pa.list_(pa.float64()))})

    def handed(table):
        table = table.sort_by("place")
        steps = np.array(table.column("matrix").to_pylist()).reshape(-1, s + 1, s)
        enter, leave = table.column("enter")[0].as_py(), table.column("leave")[0].as_py()
        path = best_path(steps, enter, leave)
        return pa.table({"chain": table.column("chain"), "place": table.column("place"), "enter": pa.array([enter, *path[:-1]], pa.int32()), "leave": pa.array(path, pa.int32())})

    shape = "chain string, place long, matrix array<double>"
    levels = [written(rows.groupBy("chain", "block").applyInArrow(summed, shape), "level")]
    while not levels[-1].groupBy("chain").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        up = levels[-1].withColumn("up", F.floor(F.col("place") / BLOCK).cast("long"))
        levels.append(written(up.groupBy("chain", "up").applyInArrow(climbed, shape), "level"))
    # From the start of the conversation to the role with the best score.
    ends = F.slice("matrix", s * s + 1, s)
    ways = levels[-1].select("chain", "place", F.lit(s).alias("enter"), (F.array_position(ends, F.array_max(ends)) - 1).cast("int").alias("leave"))
    for level in reversed(levels[:-1]):
        known = written(ways, "ways").withColumnRenamed("place", "up")
        below = level.withColumn("up", F.floor(F.col("place") / BLOCK).cast("long")).join(known, ["chain", "up"])
        ways = below.groupBy("chain", "up").applyInArrow(handed, "chain string, place long, enter int, leave int")

    kind = turns.schema["conv_id"].dataType
    out_schema = rows.select("conv_id", "turn", "text", "n_rows").schema.add("role_pred", "string").add("rendered", "string")

    def decided(table):
        table = table.sort_by("nth")
        texts = table.column("text").to_pylist()
        path = best_path(model.steps(texts, False), table.column("enter")[0].as_py(), table.column("leave")[0].as_py())
        roles = [model.roles[k] for k in path]
        return table.select(["conv_id", "turn", "text", "n_rows"]).append_column("role_pred", pa.array(roles, pa.string())).append_column(
            "rendered", pa.array([render(r, t) for r, t in zip(roles, texts, strict=True)], pa.string()))

    met = rows.join(written(ways, "ways").withColumnRenamed("place", "block"), ["chain", "block"])
    return met.groupBy("chain", "block").applyInArrow(decided, out_schema)


def is_held_out() -> F.Column:
    """Every third conversation by checksum is kept from learning."""
    return F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))


def format_chats(turns: DataFrame) -> DataFrame:
    """Learn from the conversations that are not held out, decode all."""
    return decode(turns, fit(turns.where(~is_held_out()))).withColumn("held_out", is_held_out())
