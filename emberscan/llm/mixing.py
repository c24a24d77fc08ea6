"""Document rates that bring soft domains to target weights."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscan.llm.batches import IS_SPACE, Joined, chunks
from emberscan.llm.batches import mix as spread
from emberscan.llm.store import prepare, written
from emberscan.llm.tokens import encoder

#: Labelled documents the classifier is fitted on, at most.
SAMPLE = 6000
#: Buckets that words are hashed to; behind them come the shape features.
BUCKETS = 1 << 16
SHAPES, LEVELS = 4, 8
EPOCHS = 40
#: The relative miss of the totals at which the fit ends; a fit that has not got there after so many steps is an error.
TOLERANCE = 1e-6
STEPS = 200
#: Directions of the domains' moments below this share of the largest are those that no rates can change.
SINGULAR = 1e-10
#: The tokenizer that documents are weighed by.
TOKENIZER = "byte_bpe_50k.json"

#: Target share of tokens for each domain of the labels table.
WEIGHTS = {"clean": 0.88, "low": 0.07, "toxic": 0.05}


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document; NULL where a label is missing."""
    return F.when(toxic == 1, "toxic").when((quality == 0) & (toxic == 0), "low").when((quality == 1) & (toxic == 0), "clean")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and feature of every feature a text has, and how many words it has.

    Features are the hashed lower-cased words, each once, and levels of four shares: words equal to the one before,
    capitals, symbols, and words met before.
    """
    joined, folded = Joined(texts), Joined(texts, lower=True)
    starts, ends, owner = joined.words()
    n = len(texts)
    words = folded.fingerprints(starts, ends)
    counts = np.bincount(owner, minlength=n)
    keys = np.unique(owner * np.int64(BUCKETS) + (words % np.uint64(BUCKETS)).astype(np.int64))
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(words) else np.zeros(n)
    data = joined.bytes
    visible = np.maximum(joined.per_document(~IS_SPACE[data]), 1)
    capitals = joined.per_document((data >= 0x41) & (data <= 0x5A))
    letters = ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    symbols = joined.per_document(~letters & ~IS_SPACE[data])
    distinct = np.bincount(keys // BUCKETS, minlength=n)
    shares = np.stack([again / np.maximum(counts, 1), capitals / visible, symbols / visible, 1 - distinct / np.maximum(counts, 1)], axis=1)
    level = np.clip((shares * 2 * LEVELS).astype(np.int64), 0, LEVELS - 1)
    shape = BUCKETS + np.arange(SHAPES) * LEVELS + level
    return (np.concatenate((keys // BUCKETS, np.repeat(np.arange(n), SHAPES))), np.concatenate((keys % BUCKETS, shape.ravel())), counts)


class Classifier:
    """Softmax regression on sparse yes-or-no features, fitted by full-batch adaptive steps."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((len(domains), BUCKETS + SHAPES * LEVELS))
        self.bias = np.zeros(len(domains))

    def _scores(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        # Scaled by the root of a text's feature count, so that long texts are not judged more surely for their length.
        scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        z = np.stack([np.bincount(rows, weights=w[columns], minlength=n) for w in self.weights], axis=1) * scale[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, rows: np.ndarray, columns: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        wanted = np.eye(len(self.domains))[target]
        self.bias = np.log(np.maximum(wanted.mean(axis=0), 1e-6))
        scale = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1)))[rows]
        squares = np.full_like(self.weights, 1e-8)
        for _ in range(EPOCHS):
            miss = self._scores(rows, columns, n) - wanted
            slope = np.stack([np.bincount(columns, weights=miss[rows, k] * scale, minlength=self.weights.shape[1]) for k in range(len(self.domains))]) / n
            slope += 1e-6 * self.weights
            squares += slope ** 2
            self.weights -= 0.5 * slope / np.sqrt(squares)

    def posteriors(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return self._scores(rows, columns, n)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str]) -> Classifier:
    """A classifier from at most `SAMPLE` labelled documents, the first by a hash of their id.

    The sample's ids, bounded, are broadcast; only these texts are turned into features for the driver. A label and an id
    count once, with the least text, however many rows have them. Without labelled documents all domains are equally likely.
    """
    prepare(docs.sparkSession)
    out = Classifier(domains)
    known = labels.select(F.col("doc_id").cast("long"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where(
        F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(SAMPLE)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                rows, columns, _ = features(texts)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(len(texts) + 1))
                found = [columns[order][a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.array(found, pa.binary())], ["doc_id", "domain", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    got = rows.select("doc_id", "domain", "text").mapInArrow(described, "doc_id long, domain string, found binary").collect()
    got = sorted((r["doc_id"], r["domain"], bytes(r["found"])) for r in got)
    if not got:
        return out
    found = [np.frombuffer(x[2], np.int32) for x in got]
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    out.fit(owner, np.concatenate(found).astype(np.int64), np.array([domains.index(x[1]) for x in got]))
    return out


def classified(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER) -> DataFrame:
    """`keep` columns, `n_tokens`, `posterior`, an array in the order of the classifier's domains, and `coin`, a number in
    [0, 1) from the text and the row's place in its task."""
    prepare(docs.sparkSession)
    weights, bias, domains = classifier.weights.astype(np.float32), classifier.bias, classifier.domains
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType())).add("coin", "double")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(domains)
        model.weights, model.bias = weights, bias
        tally = 0
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                owner, columns, _ = features(texts)
                found = model.posteriors(owner, columns, len(texts))
                counts, _ = encoder(tokenizer).encode(texts)
                joined = Joined(texts)
                places = np.arange(tally, tally + len(texts), dtype=np.uint64)
                tally += len(texts)
                coins = (spread(joined.fingerprints(joined.starts, joined.ends) ^ spread(places)) >> np.uint64(11)) / float(1 << 53)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(part.num_columns - 1)), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(domains)), pa.array(found.ravel())), pa.array(coins)],
                    names=[*part.schema.names[:-1], "n_tokens", "posterior", "coin"])

    return rows.mapInArrow(judged, schema)


def multipliers(rows: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """One number a domain, such that rates of `max(0, 1 + posterior * numbers)` bring the totals to the targets; and the
    relative misses that are left because no rates can mend them.

    Least squares over all rates by projected gradient, from rates of one. A gradient step moves every rate by its
    posteriors times the misses, so what has been moved in all is the posteriors times a few sums, and the projection makes
    what fell below zero zero. Steps are taken in the metric of the rows whose rates are not zero: their moments, like the
    totals, are a few numbers, and one aggregation of the table brings both to the driver. A step that does not lower the
    miss is halved.
    """
    k = len(targets)
    target = np.array(targets)
    unit = max(float(np.abs(target).max()), 1e-9)
    p = [F.col("posterior")[i] for i in range(k)]

    def state(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = F.lit(1.0) + sum((p[i] * float(numbers[i]) for i in range(k)), F.lit(0.0))
        held = F.when(raw > 0, F.col("n_tokens")).otherwise(0)
        found = rows.agg(*(F.coalesce(F.sum(held * raw * p[i]), F.lit(0.0)).alias(f"t{i}") for i in range(k)),
                         *(F.coalesce(F.sum(held * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
        totals = np.array([found[f"t{i}"] for i in range(k)])
        return (totals - target) / unit, np.array([[found[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / unit

    numbers = np.zeros(k)
    miss, moments = state(numbers)
    for _ in range(steps):
        values, vectors = np.linalg.eigh(moments)
        able = values > SINGULAR * max(float(values.max()), 1e-300)
        along = vectors[:, able].T @ miss
        if not able.any() or np.abs(vectors[:, able] @ along).max() < TOLERANCE:
            return numbers, miss
        move = vectors[:, able] @ (along / values[able])
        length = 1.0
        while True:
            tried = numbers - length * move
            next_miss, next_moments = state(tried)
            if next_miss @ next_miss < miss @ miss or length < 1e-6:
                break
            length /= 2
        if length < 1e-6:
            return numbers, miss
        numbers, miss, moments = tried, next_miss, next_moments
    raise RuntimeError(f"the rates have not met their totals after {steps} steps; relative misses {miss.tolist()}")


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """`rows` (with `n_tokens`, `posterior`) and `rate`: nonnegative, with expected token totals at the targets, or as near
    as rates can bring them (`multipliers`)."""
    numbers, _ = multipliers(rows, targets, steps)
    raw = F.lit(1.0) + sum((F.col("posterior")[i] * float(x) for i, x in enumerate(numbers)), F.lit(0.0))
    return rows.withColumn("rate", F.greatest(F.lit(0.0), raw))


def copies(rate: Column, coin: Column) -> Column:
    """Whole copies for a rate: the whole part, and one more if the row's coin, even in [0, 1), is below the rest."""
    return (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = WEIGHTS, keep: tuple[str, ...] = ("doc_id",),
        tokenizer: str = TOKENIZER) -> DataFrame:
    """`keep` columns (with `doc_id`), `n_tokens, posterior, rate, copies` of every document.

    The targets are the weights' shares of all tokens (the tokenizer's), so the corpus keeps its size in expectation. Every
    row tosses its own coin, rows without an id and repeated ones too, and the coins are written with the posteriors.

    Defined results: an empty or NULL text has no tokens and gets the rate of its posteriors; without labels all domains
    are equally likely everywhere, and all rates are equal; repeated rows are rated alike; a NULL `doc_id` is kept; an
    empty table gives an empty result; other columns are ignored. Domains without a weight are given none.
    """
    domains = sorted(weights)
    rows = written(classified(docs, fit_classifier(docs, labels, domains), keep, tokenizer), "posteriors")
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    share = sum(weights.values()) or 1.0
    rated = fit_rates(rows, [total * weights[d] / share for d in domains])
    return rated.withColumn("copies", copies(F.col("rate"), F.col("coin"))).drop("coin")
