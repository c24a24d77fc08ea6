"""Collocations by SON partitioning: shards are mined on their own, and what any of them finds is counted everywhere.

A shard is a run of whole pieces of text that fits in a task. A phrase with support s in the corpus has at least
s * (words of the shard) / (words of the corpus) in one shard at least, so mining every shard completely at that lowered
support (per language, rounded up) misses none. The union of what the shards find is then counted exactly.

Three things keep what the shards find small without losing a phrase. The words of the corpus are counted before, and a
shard extends frequent words only. Shards are mined for pairs first and for longer phrases then, and extend only pairs that
may be frequent in the corpus. And a shard tells the counts of what it found, so a phrase goes on only if those, together
with the most that the silent shards may hide, can reach the support.

What is known about frequent phrases travels to the shards as a bit table of fixed size: a bit that is set by chance lets a
phrase through to the exact count, which drops it; so do equal hashes of two phrases that shards found. Inside a shard
phrases are told apart by exact numbers of words and phrases, between shards by their texts; nothing is decided by hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscan.llm.batches import CHUNK, Joined, chunks, mix
from emberscan.llm.store import discard, prepare, workspace, written
from emberscan.operators.scan import attach
from emberscan.session import shuffle_partitions

#: Bits of the table of frequent phrases that each shard gets: 8 MiB whatever the corpus.
BITS = 1 << 26
#: Text of a shard: what is aimed at, and where a shard ends in any case.
SHARD_BYTES = 32 << 20
SHARD_LIMIT = 34 << 20
#: A small corpus is mined in so many shards at least, if it has as many input splits.
LEAST_SHARDS = 26
#: Bytes of text whose words are found together.
TEXT_CHUNK = 2 << 20
#: Words of the corpus for each bucket that phrases of all shards are put together in.
BUCKET_WORDS = 2_000_000
#: The same for the words themselves, by the bytes of the input, and how many there are at most.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 14
#: Parts of a shard's phrases, each some of the buckets, that are sorted and handed on one after the other.
SLICES = 16
#: Words of a shard that are looked at together, and phrases that leave a task together (or those of one bucket).
BLOCK = 1 << 18
BATCH_PHRASES = 1 << 15

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True

_WORDED_DDL = "lang string, bucket long, phrases string, hashes binary, counts binary"
_WORDED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("phrases", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])
_FOUND_DDL = "lang string, bucket long, hidden long, hashes binary, excess binary"
_FOUND = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("hidden", pa.int64()), ("hashes", pa.binary()), ("excess", pa.binary())])
_COUNTED_DDL = "lang string, bucket long, phrases string, counts binary"
_COUNTED = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("phrases", pa.string()), ("counts", pa.binary())])


@dataclass(frozen=True)
class PhraseConfig:
    """What counts as a collocation; see `collocations`."""

    support: int = 30
    longest: int = 4
    covered_percent: int = 80
    top: int = 2000
    undetermined: str = "und"


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text in stretches of some megabytes; no word is cut."""
    start = 0
    while len(text) - start > TEXT_CHUNK:
        stop = start + TEXT_CHUNK
        while stop < len(text):
            ends = np.flatnonzero(_ENDS_WORD[np.frombuffer(text[stop:stop + TEXT_CHUNK], np.uint8)])
            if len(ends):
                stop += int(ends[0])
                break
            stop += TEXT_CHUNK
        yield text[start:stop]
        start = stop
    yield text[start:]


class Shard:
    """Words of many pieces, each word as a number that is the same for equal words of one language."""

    def __init__(self):
        self.size = 0
        #: Whether the last piece is over.
        self.ended = True
        self._coded: list[pa.DictionaryArray] = []
        self._breaks: list[np.ndarray] = []
        self.totals: dict[str, int] = {}

    def add(self, langs: list[str], texts: list[bytes], totals: list[int], continues: bool = False) -> None:
        """Texts, their languages, and how many words the corpus has in each of those.

        With `continues`, the one text goes on where the last one stopped.
        """
        self.size += sum(map(len, texts))
        self.totals |= dict(zip(langs, totals, strict=True))
        joined = Joined(texts, lower=True)
        inside = ~_ENDS_WORD[joined.bytes]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
        # The newline that ends every text ends a piece, but for the last one, which may go on.
        piece_ends = np.flatnonzero(_ENDS_PIECE[joined.bytes[:-1]])
        before_first = starts[0] if len(starts) else len(joined.bytes)
        self.ended = not continues or self.ended or bool(len(piece_ends) and piece_ends[0] < before_first)
        if not len(starts):
            return
        if not self.ended:
            self._breaks[-1][-1] = False
        self.ended = bool(len(piece_ends) and piece_ends[-1] >= ends[-1])
        # A word is cut off from the next one if a piece ends between them.
        after = np.searchsorted(piece_ends, ends[:-1])
        self._breaks.append(np.append(after != np.searchsorted(piece_ends, starts[1:]), True))

        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = joined.bytes[inside]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        named = pa.array([x.encode() for x in langs], pa.large_binary()).dictionary_encode()
        spelled = words.dictionary
        pairs = named.indices.to_numpy()[joined.owner(starts)].astype(np.int64) * len(spelled) + words.indices.to_numpy()
        distinct, numbers = np.unique(pairs, return_inverse=True)
        # No word holds a newline, so it marks where the language begins.
        both = pc.binary_join_element_wise(spelled.take(pa.array(distinct % len(spelled))), named.dictionary.take(pa.array(distinct // len(spelled))), pa.scalar(b"\n", pa.large_binary()))
        self._coded.append(pa.DictionaryArray.from_arrays(pa.array(numbers.astype(np.int32)), both))

    def close(self) -> bool:
        """Number the words of all that was added. False if there are none."""
        if not self._coded:
            return False
        unified = pa.chunked_array(self._coded).unify_dictionaries()
        self._coded = []
        both = unified.chunk(0).dictionary
        self.words = np.concatenate([c.indices.to_numpy() for c in unified.chunks]).astype(np.int32, copy=False)
        del unified
        self.breaks = np.concatenate(self._breaks)
        self._breaks = []
        self.counts = np.zeros(len(both), np.int64)
        for start in range(0, len(self.words), BLOCK):
            self.counts += np.bincount(self.words[start:start + BLOCK], minlength=len(both))
        split = pc.split_pattern(both.cast(pa.large_string()), "\n", max_splits=1)
        self.texts = pc.list_element(split, 0)
        named = pc.list_element(split, 1).dictionary_encode()
        self.names, self.lang = named.dictionary.to_pylist(), named.indices.to_numpy().astype(np.int32)
        edges = np.frombuffer(both.buffers()[1], np.int64)[both.offset:both.offset + len(both) + 1]
        letters = both.buffers()[2]
        self.hashes = np.empty(len(both), np.uint64)
        start = 0
        while start < len(both):
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + CHUNK, "right")) - 1)
            held = Joined([letters.slice(edges[start], edges[stop] - edges[start]).to_pybytes()])
            self.hashes[start:stop] = held.fingerprints(edges[start:stop] - edges[start], edges[start + 1:stop + 1] - edges[start])
            start = stop
        del both, split, edges, letters, held
        give_back()
        return True

    def language_words(self) -> np.ndarray:
        return np.bincount(self.lang, weights=self.counts, minlength=len(self.names)).astype(np.int64)

    def language_totals(self) -> np.ndarray:
        return np.array([self.totals[x] for x in self.names], np.int64)


@dataclass
class Level:
    """Distinct phrases of one length: where one of each starts, its hash, and how often it occurs."""

    example: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def levels(shard: Shard, keep_word: np.ndarray, keep: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], longest: int,
           buckets: int) -> Iterator[tuple[int, Level]]:
    """Apriori inside a shard: phrases of kept words, each extended only if both phrases inside it were kept.

    `keep(size, first_words, hashes, counts)` says which distinct phrases stay. Phrases are numbered exactly: a longer one is the
    number of the shorter one it begins with and its last word. They are told apart in `SLICES` parts, each with buckets of
    its own, so that no more than a part is sorted at a time and a part can be handed on before the next one is sorted.
    """
    # The number of the phrase that starts at each word, -1 if it was not kept. Of the words, only this is held a second time.
    spot = np.where(keep_word, np.arange(len(keep_word), dtype=np.int32), np.int32(-1))[shard.words]
    hashes = shard.hashes
    slices = min(SLICES, buckets)
    part = np.empty(len(shard.words), np.uint8)
    for size in range(2, longest + 1):
        reach = len(shard.words) - size + 1
        if reach <= 0:
            return
        longer = lambda first, last: mix(hashes[first] * _STEP + shard.hashes[last] + _U(size))
        part.fill(slices)
        for start in range(0, reach, BLOCK):
            stop = min(start + BLOCK, reach)
            # The phrase one word on must be alive too, and no piece may end inside.
            at = start + np.flatnonzero((spot[start:stop] >= 0) & (spot[start + 1:stop + 1] >= 0) & ~shard.breaks[start + size - 2:stop + size - 2])
            part[at] = _bucket(longer(spot[at], shard.words[at + (size - 1)]), buckets) * slices // buckets
        kept: list[np.ndarray] = []
        known = 0
        for number in range(slices):
            here = np.flatnonzero(part == number).astype(np.int32)
            if not len(here):
                continue
            distinct, first, inverse, counts = np.unique(
                spot[here].astype(np.int64) << np.int64(32) | shard.words[here + (size - 1)], return_index=True, return_inverse=True, return_counts=True)
            example = here[first]
            own = longer(distinct >> np.int64(32), distinct & np.int64(0xFFFFFFFF))
            stays = keep(size, shard.words[example], own, counts)
            # A word is in one slice only, and nothing but its own number is read there.
            spot[here] = np.where(stays, np.cumsum(stays) - 1 + known, -1).astype(np.int32)[inverse]
            level = Level(example[stays], own[stays], counts[stays])
            del here, distinct, first, inverse, counts, example, own
            known += len(level.hashes)
            if size < longest:
                kept.append(level.hashes)
            yield size, level
        if not known or size == longest:
            return
        spot[part == slices] = -1
        hashes = np.concatenate(kept)


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for later stages, and what it held would be missing there."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def _released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, giving memory back when it is through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()
    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for part, texts in chunks(batch, "text", TEXT_CHUNK):
            langs = part.column("lang").to_pylist()
            totals = part.column("n").to_pylist() if "n" in part.schema.names else [0] * len(langs)
            if len(texts) == 1:
                for k, stretch in enumerate(_stretches(texts[0])):
                    shard.add(langs, [stretch], totals, continues=k > 0)
                    # A piece stays in one shard.
                    if shard.size >= SHARD_LIMIT and shard.ended:
                        yield shard
                        shard = Shard()
                        give_back()
            else:
                shard.add(langs, texts, totals)
            if shard.size >= SHARD_LIMIT:
                yield shard
                shard = Shard()
                give_back()
    yield shard


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & _U(BITS - 1)
    return (bits[spot >> _U(3)] >> (spot & _U(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table with the bits of a `hash` column set: `BITS` bits, merged in the executors, one block of 4096 bytes a row."""
    # Spark counts bits from 1.
    spot = F.col("hash").bitwiseAND(BITS - 1) + 1
    blocks = hashes.select(F.bitmap_bucket_number(spot).alias("block"), F.bitmap_bit_position(spot).alias("bit")) \
        .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in blocks.collect():
        out[(row["block"] - 1) * 4096:row["block"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def count_words(texts: DataFrame, buckets: int, support: int) -> DataFrame:
    """`lang, phrase, hash, f` of every word that occurs `support` times in its language; rows without a `phrase` hold what
    all words of one bucket come to, in `f`, and their bytes in `hash`.

    What is shuffled are buckets of packed words, one row a shard, language and bucket.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if shard.close():
                order, edges, of_lang, bucket = _dealt(shard.lang, shard.hashes, buckets)
                names = pa.array(shard.names, pa.string())
                for runs, lot, ends in _lots(order, edges):
                    spelled = shard.texts.take(pa.array(lot)).cast(pa.string())
                    packed = [_packed(x, ends) for x in (shard.hashes[lot], shard.counts[lot].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_lang[runs])), pa.array(bucket[runs]), _lines(spelled, ends), *packed], schema=_WORDED)

    def summed(key: tuple, batch: pa.Table) -> pa.Table:
        words, f, first = _added(batch)
        hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)[first]
        give_back()
        some = np.flatnonzero(f >= support)
        n_bytes = int((f * (pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)).sum())
        return pa.table({
            "lang": pa.array([key[0].as_py()] * (len(some) + 1), pa.string()), "phrase": pa.concat_arrays([pa.nulls(1, pa.string()), words.take(pa.array(some)).cast(pa.string())]),
            "hash": pa.array(np.append(n_bytes, hashes[some])), "f": pa.array(np.append(f.sum(), f[some]))})

    return texts.mapInArrow(_released(counted), _WORDED_DDL).groupBy("lang", "bucket").applyInArrow(summed, "lang string, phrase string, hash long, f long")


def _added(batch: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lines of all rows of a bucket, the sum of their counts, and where each first stands."""
    lines = pc.list_flatten(pc.split_pattern(batch.column("phrases").cast(pa.large_string()), "\n")).combine_chunks()
    coded = lines.dictionary_encode()
    at = coded.indices.to_numpy()
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32)
    # Sums of counts below 2**31 are exact as floating point numbers up to 2**53.
    f = np.bincount(at, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
    first = np.empty(len(f), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return coded.dictionary, f, first


def local_support(support: int, here: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The least count in a shard with `here` of `total` words that a phrase of that support must reach in some shard."""
    return np.maximum(1, -(-(support * here) // np.maximum(total, 1)))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of a hash: shards tell phrases of one bucket apart by the lower half."""
    return ((hashes >> _U(32)) % _U(buckets)).astype(np.int64)


def _dealt(lang: np.ndarray, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of phrases by language and bucket; where each such run begins (and the last ends), its language and bucket."""
    bucket = _bucket(hashes, buckets)
    place = lang.astype(np.int64) * buckets + bucket
    order = np.argsort(place, kind="stable")
    place = place[order]
    begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
    return order, np.append(begins, len(place)), place[begins] // buckets, place[begins] % buckets


def _lots(order: np.ndarray, edges: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """What `_dealt` gives in lots of at most `BATCH_PHRASES` (or one run): the runs, their phrases, and where each run ends there.

    A task hands on a lot at a time, since a batch is held whole on both sides of the pipe.
    """
    start = 0
    while start < len(edges) - 1:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + BATCH_PHRASES, "right")) - 1)
        yield slice(start, stop), order[edges[start]:edges[stop]], edges[start:stop + 1] - edges[start]
        start = stop


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The numbers of each run as bytes."""
    return pa.array([values[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)], pa.binary())


def _lines(phrases: pa.Array, edges: np.ndarray) -> pa.Array:
    """The phrases of each run, one a line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), phrases), "\n")


def _excess_type(config: PhraseConfig) -> np.dtype:
    """What is above the support counts as the support, so that this type holds it."""
    return np.min_scalar_type(config.support)


def mine_shards(texts: DataFrame, frequent_words: np.ndarray, buckets: int, config: PhraseConfig, pairs: np.ndarray | None = None) -> DataFrame:
    """`lang, bucket, hashes, excess`: what the shards found, and by how much it is above what a shard may hide.

    Without `pairs` shards look for pairs of words, else for all longer phrases of pairs whose bit is set there. A row holds
    what a shard found of one length in one bucket of one language, as packed numbers: the lower half of each hash, and at
    most the support. Rows of bucket -1 hold, in `hidden`, how often a shard may hide any phrase of the language.
    """
    context = texts.sparkSession.sparkContext
    shared, known = context.broadcast(frequent_words), None if pairs is None else context.broadcast(pairs)
    longest = 2 if pairs is None else config.longest

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if not shard.close():
                continue
            least = local_support(config.support, shard.language_words(), shard.language_totals())
            names = pa.array(shard.names, pa.string())
            none = pa.nulls(len(names), pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), -1)), pa.array(least - 1), none, none], schema=_FOUND)
            keep_word = (shard.counts >= least[shard.lang]) & _has(shared.value, shard.hashes)

            def keep(size: int, first: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
                often = counts >= least[shard.lang[first]]  # noqa: B023
                return often & _has(known.value, hashes) if known is not None and size == 2 else often

            for size, level in levels(shard, keep_word, keep, longest, buckets):
                if known is not None and size == 2:
                    continue
                lang = shard.lang[shard.words[level.example]]
                excess = np.minimum(level.counts - (least[lang] - 1), config.support).astype(_excess_type(config))
                lower = (level.hashes & _U(0xFFFFFFFF)).astype(np.uint32)
                order, edges, of_lang, bucket = _dealt(lang, level.hashes, buckets)
                for runs, lot, ends in _lots(order, edges):
                    packed = [_packed(x[lot], ends) for x in (lower, excess)]
                    none_hidden = pa.array(np.zeros(len(ends) - 1, np.int64))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_lang[runs])), pa.array(bucket[runs]), none_hidden, *packed], schema=_FOUND)

    return texts.mapInArrow(_released(mined), _FOUND_DDL)


def promising(found: DataFrame, config: PhraseConfig) -> DataFrame:
    """The lower half of the `hash` of every phrase that may have the support: what the shards found and what they may hide reach it."""
    hidden = written(found.where("bucket < 0").groupBy("lang").agg(F.sum("hidden").alias("most")), "hidden")
    packed = attach(found.where("bucket >= 0").select("lang", "bucket", "hashes", "excess"), hidden, "lang", max_rows=10_000)

    def merged(batch: pa.Table) -> pa.Table:
        hashes, excess = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("hashes", np.uint32), ("excess", _excess_type(config))))
        distinct, numbers = np.unique(hashes, return_inverse=True)
        reach = np.bincount(numbers, weights=excess) + batch.column("most")[0].as_py()
        give_back()
        return pa.table({"hash": pa.array(distinct[reach >= config.support].astype(np.int64))})

    return packed.groupBy("lang", "bucket").applyInArrow(merged, "hash long")


def count_candidates(texts: DataFrame, frequent_words: np.ndarray, candidates: np.ndarray, buckets: int, config: PhraseConfig) -> DataFrame:
    """`lang, phrase, f` of every phrase with the support, counted over the whole corpus among those whose bit is set.

    A row that is shuffled holds what a shard has of one bucket of one language: phrases, one a line, and packed counts.
    A bucket tells its phrases apart by their letters.
    """
    spark = texts.sparkSession
    words, phrases = spark.sparkContext.broadcast(frequent_words), spark.sparkContext.broadcast(candidates)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if not shard.close():
                continue
            keep_word = _has(words.value, shard.hashes)
            names = pa.array(shard.names, pa.string())
            for size, level in levels(shard, keep_word, lambda _, __, hashes, ___: _has(phrases.value, hashes), config.longest, buckets):
                order, edges, of_lang, bucket = _dealt(shard.lang[shard.words[level.example]], level.hashes, buckets)
                for runs, lot, ends in _lots(order, edges):
                    at = level.example[lot]
                    phrase = pc.binary_join_element_wise(*[shard.texts.take(pa.array(shard.words[at + k])).cast(pa.string()) for k in range(size)], " ")
                    packed = _packed(level.counts[lot].astype(np.int32), ends)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_lang[runs])), pa.array(bucket[runs]), _lines(phrase, ends), packed], schema=_COUNTED)

    def summed(key: tuple, batch: pa.Table) -> pa.Table:
        found, f, _ = _added(batch)
        some = np.flatnonzero(f >= config.support)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(some), pa.string()), "phrase": found.take(pa.array(some)).cast(pa.string()), "f": pa.array(f[some])})

    return texts.mapInArrow(_released(counted), _COUNTED_DDL).groupBy("lang", "bucket").applyInArrow(summed, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> tuple[DataFrame, DataFrame]:
    """`lang, phrase, f` of all phrases of 1 to `longest` words with the support, and `lang, n`: the words of each language."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(config.undetermined)).alias("lang"), F.col("text").cast("string").alias("text")) \
        .where("text is not null")
    # Before anything is counted only the plan tells how much there may be; a bucket too many or too few costs little.
    guess = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    words = written(count_words(texts, max(shuffle_partitions(spark), min(guess // BUCKET_BYTES, MOST_BUCKETS)), config.support), "words")
    totals = written(words.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"), F.sum("hash").alias("bytes")), "totals")
    frequent = words.where("phrase is not null")
    bits = bit_table(frequent)

    size = totals.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    totals = totals.select("lang", "n")
    wanted = max(LEAST_SHARDS, -(-int(size["bytes"] or 0) // SHARD_BYTES))
    buckets = max(shuffle_partitions(spark), int(size["n"] or 0) // BUCKET_WORDS)
    sized = attach(texts, totals, "lang", max_rows=10_000).coalesce(wanted)
    candidates = None
    for _ in ("pairs", "longer phrases") if config.longest > 2 else ("pairs",):
        found = written(mine_shards(sized, bits, buckets, config, candidates), "found")
        hashes = written(promising(found, config), "promising")
        discard(found)
        candidates = bit_table(hashes) if candidates is None else candidates | bit_table(hashes)
    counts = count_candidates(sized, bits, candidates, buckets, config)
    phrases = written(frequent.select("lang", "phrase", "f").unionByName(counts), "phrases")
    return phrases, totals


def _inner(words: str, least: int, most: str) -> str:
    """SQL for all runs of `least` to `most` words of an array, joined by spaces."""
    return (f"flatten(transform(sequence({least}, {most}), s -> transform(sequence(1, size({words}) - s + 1), "
            f"i -> array_join(slice({words}, i, s), ' '))))")


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score` of the best `top` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at `[.,;:!?]` and line ends, pieces into words at blanks and tabs; a
    phrase is 2 to `longest` words of one piece, and `a` how often it occurs, overlaps included. Cut after k words its first
    part occurs `l` times and the rest `r` times; the cut with the least floor(2000000 a / (l + r)), the first of equal
    ones, gives the score. A phrase goes if a longer one holds it and has `covered_percent` of its occurrences.

    Defined results: NULL text has no words; NULL `lang` is `und`; repeated rows all count; equal scores and counts are in
    byte order of the phrase; an empty table, or one without a phrase of that support, gives no rows; other columns are
    ignored. Texts of any length are taken whole, a long one in stretches that end with a piece.
    """
    spark = docs.sparkSession
    with workspace(spark) as keep:
        phrases, totals = frequent_phrases(docs, config)
        split = phrases.withColumn("words", F.split("phrase", " "))
        candidates = split.where("size(words) > 1").withColumnRenamed("f", "a")

        cuts = candidates.select("lang", "phrase", "a", "words", F.expr("explode(sequence(1, size(words) - 1))").alias("cut")).select(
            "lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("left"),
            F.expr("array_join(slice(words, cut + 1, size(words) - cut), ' ')").alias("right"))
        part = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn(
            "score", F.expr("(cast(2000000 as decimal(8, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
        best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

        longer = split.where("size(words) > 2").select("lang", "f", F.expr(f"explode({_inner('words', 2, 'size(words) - 1')})").alias("phrase"))
        covers = longer.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
        covered = F.coalesce(F.expr(
            f"cast(cover as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(config.covered_percent)}"), F.lit(False))
        left = best.join(covers, ["lang", "phrase"], "left").where(~covered)

        order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
        ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top)
        out = attach(ranked, totals, "lang", max_rows=10_000).select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
            F.col("best.score").cast("long").alias("score"))
        return keep(out)
