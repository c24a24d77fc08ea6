"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs. A trigram is bound from its letters' vectors, rotated by their place; a text is
the bundle (sum) of its trigrams, a language the bundle of its texts' unit vectors. A text has the language whose
prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.batches import chunks
from emberscan.llm.store import prepare

DIMENSIONS = 1024
GRAM = 3
UNDETERMINED = "und"
#: Unit vectors are summed as integers of this scale, so that sums do not depend on their order.
SCALE = 1 << 24

_BREAK = 0x20
_letters: dict[int, np.ndarray] = {}
_fold: np.ndarray | None = None


def folding() -> np.ndarray:
    """Code point to lower-case letter, or to a space where it is no letter."""
    global _fold
    if _fold is None:
        fold = np.full(0x110000, _BREAK, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                fold[cp] = ord(c.lower()[0])
        _fold = fold
    return _fold


def letter_vector(letter: int) -> np.ndarray:
    if letter not in _letters:
        if len(_letters) > 50_000:
            _letters.clear()
        _letters[letter] = np.random.default_rng((7919, letter)).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
    return _letters[letter]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams given as rows of code points."""
    distinct, place = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(x)) for x in distinct])
    place = place.reshape(grams.shape)
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for k in range(GRAM):
        out *= np.roll(table, GRAM - 1 - k, axis=1)[place[:, k]]
    return out


def bundles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Unit bundle of each text (zero if it has no letters) and whether it has letters."""
    n = len(texts)
    out, lettered = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, bool)
    points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, points), np.int64, n) + 1
    # Each text ends in a space; runs of spaces become one, and the first letter has one before it.
    flat = np.full(int(sizes.sum()) + 1, _BREAK, np.int32)
    owner = np.concatenate(([0], np.repeat(np.arange(n), sizes)))
    solid = np.ones(len(flat), bool)
    solid[0] = False
    solid[np.cumsum(sizes)] = False
    flat[solid] = folding()[np.concatenate(points)] if n else flat[solid]
    keep = np.concatenate(([True], (flat[1:] != _BREAK) | (flat[:-1] != _BREAK)))
    flat, owner = flat[keep], owner[keep]
    lettered[owner[flat != _BREAK]] = True
    symbols, codes = np.unique(flat, return_inverse=True)
    if len(flat) < GRAM:
        return out, lettered
    # A trigram may begin or end with a space, but not span one. A leading space belongs to the text before.
    middle = flat[1:-1] != _BREAK
    a, b, c = codes[:-2][middle], codes[1:-1][middle], codes[2:][middle]
    whose = owner[1:-1][middle]
    if not len(whose):
        return out, lettered
    width = len(symbols)
    keys = (a.astype(np.int64) * width + b) * width + c
    if width ** 3 <= 1 << 23:
        rank = np.zeros(width ** 3, np.int32)
        rank[keys] = 1
        distinct = np.flatnonzero(rank)
        rank[distinct] = np.arange(len(distinct))
        inverse = rank[keys]
    else:
        distinct, inverse = np.unique(keys, return_inverse=True)
    grams = np.stack([symbols[distinct // width ** 2], symbols[distinct // width % width], symbols[distinct % width]], axis=1)
    # Bounded slices of distinct trigrams keep the tables small whatever alphabet the texts use.
    step = 4096
    for lo in range(0, len(distinct), step):
        vectors = gram_vectors(grams[lo:lo + step]).astype(np.float32)
        m = len(vectors)
        some = slice(None) if len(distinct) <= step else np.flatnonzero((inverse >= lo) & (inverse < lo + m))
        counts = np.bincount(whose[some] * m + (inverse[some] - lo), minlength=n * m).reshape(n, m)
        out += counts.astype(np.float32) @ vectors
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    np.divide(out, norms, out=out, where=norms > 0)
    return out, lettered


def prototypes(examples: DataFrame) -> dict[str, np.ndarray]:
    """Language prototypes from `text, lang`; rows whose language is NULL teach nothing.

    One integer vector per batch and language is shuffled; what reaches the driver is one vector per language.
    """
    prepare(examples.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in chunks(batch):
                langs = np.array(part.column("lang").to_pylist(), object)
                units, _ = bundles(texts)
                whole = np.rint(units.astype(np.float64) * SCALE).astype(np.int64)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + whole[langs == lang].sum(axis=0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "total"])

    rows = examples.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    sums = (rows.mapInArrow(summed, "lang string, total array<long>").select("lang", F.posexplode("total").alias("at", "value"))
            .groupBy("lang", "at").agg(F.sum("value").alias("value"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("cells")).collect())
    out = {}
    for row in sums:
        vector = np.array([cell["value"] for cell in row["cells"]], np.float64)
        if np.linalg.norm(vector) > 0:
            out[row["lang"]] = vector / np.linalg.norm(vector)
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `lang_pred` and `score` for every row.

    Defined results: a text that is NULL or has no letters, or any text where nothing was learned, is `und` with score
    0; equal cosines go to the language that sorts first; a negative cosine scores 0. Repeated rows are judged alike.
    """
    prepare(docs.sparkSession)
    names = sorted(learned)
    matrix = np.stack([learned[x] for x in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "_text"):
                units, lettered = bundles(texts)
                labels, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if names:
                    cosines = units @ matrix.T
                    best = np.argmax(cosines, axis=1)
                    labels[lettered] = np.array(names, object)[best][lettered]
                    scores[lettered] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[lettered]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(part.num_columns - 1)), pa.array(labels, pa.string()), pa.array(scores)],
                    names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(judged, schema)


def is_held_out() -> F.Column:
    """Every third document by checksum is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score`, learned from the documents that are not held out."""
    learned = prototypes(docs.where(~is_held_out()))
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return predict(rows, learned, ("doc_id", "held_out"))
