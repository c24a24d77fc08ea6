"""Quality rules judged per document and per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.batches import IS_SPACE, Joined, chunks, shingles
from emberscan.llm.store import prepare, written

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host falls when its shrunken failure rate is above this.
HOST_LIMIT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
_DDL = "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is it found twice or more in its document, and is it a later finding."""
    if not len(keys):
        return np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(keys ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    joined = Joined(texts)
    n = joined.count
    starts, ends, owner = joined.words()
    space = IS_SPACE[joined.bytes]
    # Words covered by a window that the text has twice or more.
    windows, at = shingles(joined.fingerprints(starts, ends), owner, WINDOW)
    twice, _ = _repeated(windows, owner[at])
    covered = np.bincount(at[twice], minlength=len(starts) + 1) - np.bincount(at[twice] + WINDOW, minlength=len(starts) + 1)
    # Lines: the newline behind each text ends its last line.
    line_ends = np.flatnonzero(joined.bytes == 0x0A)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    letters = np.concatenate(([0], np.cumsum(~space)))
    worded = letters[line_ends] > letters[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = joined.owner(line_starts)
    _, later = _repeated(joined.fingerprints(line_starts, line_ends), line_owner)
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": joined.per_document(~space & ((joined.bytes & 0xC0) != 0x80)),
        "n_symbols": joined.per_document(_SYMBOL[joined.bytes]),
        "n_dup_lines": np.bincount(line_owner[later], minlength=n),
        "n_repeat_words": np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host").cast(pa.string()), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)],
                schema=_SCHEMA)


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: its host, the five counts and `base_failed`."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    return rows.mapInArrow(_counted, _DDL).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moments of the host rates as a beta prior: variance beyond the binomial share is what hosts truly differ by.

    One row comes to the driver. Without hosts the prior is even (1, 1); hosts that do not differ get a strength of
    one host's mean size, so that a single small host never stands on its own.
    """
    row = hosts.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.avg(F.col("failed") / F.col("n")).alias("mean"),
        F.var_pop(F.col("failed") / F.col("n")).alias("var"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not row or not row["k"]:
        return 1.0, 1.0
    mean = min(max(row["mean"], 1e-6), 1 - 1e-6)
    between = row["var"] - mean * (1 - mean) * row["inverse"]
    strength = mean * (1 - mean) / between - 1 if between > 0 else 0.0
    if strength <= 0:
        strength = row["n"] / row["k"]
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Judge documents by their own rules and by their host's record.

    Failures are summed per host (combined before the shuffle, so a hot host is no hot task), rates are shrunk with an
    empirical beta prior, and verdicts are joined back. The host table is read from storage, so that the join is
    either broadcast by its real size or split where a host is hot.

    Defined results: a NULL text has no words and fails the base rules; a NULL host is a host of its own; repeated
    rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
    """
    rows = written(rule_counts(docs, host), "rule-counts")
    totals = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(totals)
    verdicts = totals.select(
        F.col("host").alias("_host"), ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("host_kept", F.col("host_rate") <= limit).withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
