"""Structured Streaming: conditioning, the search, online coincidence and the trigger sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberscan.functions import dsp
from emberscan.operators.signal import search
from emberscan.session import ship_package


def online_coincidence(left: DataFrame, right: DataFrame, window_s: float, late: str = "10 minutes") -> DataFrame:
    """Pairs of two trigger streams (`ts, id, EnWDF`) within `window_s`.

    Both sides carry a watermark and the range condition bounds how long either
    is remembered. The time cell is an equality, so the state is spread over
    cells and not over the two detectors.
    """
    width = max(2.0 * window_s, 1.0)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    a = left.withWatermark("ts", late).select(*[F.col(c).alias(c + "_l") for c in left.columns])
    b = right.withWatermark("ts", late).select(*[F.col(c).alias(c + "_r") for c in right.columns])
    cells = F.sequence(F.floor((seconds("ts_l") - window_s) / width), F.floor((seconds("ts_l") + window_s) / width))
    a = a.withColumn("cell", F.explode(cells))
    b = b.withColumn("cell", F.floor(seconds("ts_r") / width))
    reach = F.expr(f"ts_r BETWEEN ts_l - INTERVAL {window_s} SECONDS AND ts_l + INTERVAL {window_s} SECONDS")
    return a.join(b, on="cell").where(reach).drop("cell")


def online_rate(triggers: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Triggers per second and detector in tumbling windows, emitted once the watermark has passed them."""
    w = F.window("ts", f"{seconds} seconds")
    return triggers.withWatermark("ts", late).groupBy(w, "ifo").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("started"), "ifo", "n", (F.col("n") / F.lit(float(seconds))).alias("rate_hz"))


STATE = ("pos bigint, turn bigint, held array<double>, waiting array<struct<chunk:bigint,samples:array<double>>>, "
         "out_pos bigint, out array<double>")


class _Front:
    """What one detector's stream remembers: samples the filter still needs, chunks that came early,
    and filtered samples no complete window has used up."""

    def __init__(self, taps: np.ndarray, ahead: int, factor: int, saved: tuple | None):
        self.taps, self.back, self.ahead, self.factor = taps, taps.size - 1 - ahead, ahead, factor
        pos, turn, held, waiting, out_pos, out = saved or (0, -1, [], [], -1, [])
        self.pos, self.turn, self.out_pos = pos, turn, out_pos
        self.held, self.out = np.asarray(held, dtype=float), np.asarray(out, dtype=float)
        self.waiting = {c: list(s) for c, s in (tuple(w) for w in waiting)}

    def saved(self) -> tuple:
        return (int(self.pos), int(self.turn), self.held.tolist(), sorted(self.waiting.items()), int(self.out_pos), self.out.tolist())

    def read(self, batch: pd.DataFrame) -> None:
        self.waiting.update({int(c): np.asarray(s, dtype=float).tolist() for c, s in zip(batch["chunk"], batch["samples"])})

    def filter(self) -> None:
        """Filter everything whose future has arrived onto the end of `out`."""
        if self.turn < 0 and self.waiting:
            self.turn = min(self.waiting)
            self.held, self.pos = np.zeros(self.back), self.turn * len(self.waiting[self.turn])
        while self.turn in self.waiting:
            self.held = np.concatenate([self.held, self.waiting.pop(self.turn)])
            self.turn += 1
        ready = self.held.size - self.back - self.ahead
        if ready <= 0:
            return
        y = dsp.convolve_valid(self.held, self.taps)[:ready]
        skip = -self.pos % self.factor
        if self.out_pos < 0:
            self.out_pos = (self.pos + skip) // self.factor
        self.out = np.concatenate([self.out, y[skip::self.factor]])
        self.held, self.pos = self.held[ready:], self.pos + ready

    def take_all(self) -> list[tuple[int, list]]:
        got = [(self.out_pos, self.out.tolist())] if self.out.size else []
        self.out_pos, self.out = self.out_pos + self.out.size, self.out[:0]
        return got

    def take_windows(self, window: int, step: int) -> list[tuple[int, list]]:
        """Every complete window on the grid; samples no later window needs are let go."""
        if self.out_pos < 0:
            return []
        start, got = -(-self.out_pos // step) * step, []
        while start + window <= self.out_pos + self.out.size:
            at = start - self.out_pos
            got.append((start, self.out[at:at + window].tolist()))
            start += step
        drop = min(start - self.out_pos, self.out.size)
        self.out_pos, self.out = self.out_pos + drop, self.out[drop:]
        return got


def _online(chunks: DataFrame, kernel: Sequence[float], ahead: int, factor: int, take, column: str) -> DataFrame:
    taps = np.asarray(kernel, dtype=float)
    ship_package(chunks.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        front = _Front(taps, ahead, factor, state.get if state.exists else None)
        for batch in batches:
            front.read(batch)
        front.filter()
        got = take(front)
        state.update(front.saved())
        if got:
            yield pd.DataFrame({"ifo": [key[0]] * len(got), "first_sample": [g[0] for g in got], column: [g[1] for g in got]})

    return chunks.groupBy("ifo").applyInPandasWithState(
        step, f"ifo string, first_sample bigint, {column} array<double>", STATE, "append", GroupStateTimeout.NoTimeout)


def online_filter(chunks: DataFrame, kernel: Sequence[float], ahead: int, factor: int = 1) -> DataFrame:
    """A chunk stream `(ifo, chunk, samples)` through one finite filter, block by block.

    A block comes out once `ahead` samples after it have arrived, under the
    position of the block and not of the last read. Concatenated, the output is
    what filtering the whole series gives. Chunks may arrive out of order.
    """
    return _online(chunks, kernel, ahead, factor, _Front.take_all, "samples")


def online_windows(chunks: DataFrame, kernel: Sequence[float], ahead: int, window: int, overlap: int, factor: int = 1) -> DataFrame:
    """The same conditioning, cut into the search's windows, including those that span two blocks."""
    return _online(chunks, kernel, ahead, factor, lambda f: f.take_windows(window, window - overlap), "window")


def online_search(windows: DataFrame, fs: float, threshold: float) -> DataFrame:
    """The search itself holds no state: the same plan serves a table and a stream."""
    return search(windows, fs, threshold)


def write_triggers(triggers: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ("ifo", "n_coeff")):
    """Append triggers as Parquet, exactly once per checkpoint; stops when what is there has been read."""
    return (triggers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .option("compression", "zstd").partitionBy(*partition_by).outputMode("append").trigger(availableNow=True).start())
