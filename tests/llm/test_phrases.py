"""Collocations against plain counting, and the query against its SQL."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import oracle
from emberscan.llm import phrases, queries
from emberscan.llm.phrases import PhraseConfig

DOCS = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    *(T.StructField(c, T.StringType()) for c in ("n", "phrase", "hash", "f", "size", "excess", "hidden", "words", "rank"))])


def table(spark, rows, partitions=5):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS).repartition(partitions)


def plain(rows, support=30, longest=4, percent=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k:k + size])] += 1
    out = []
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    covered = set()
    for (lang, words), b in candidates.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                if 100 * b >= percent * f[lang, words[k:k + size]]:
                    covered.add((lang, words[k:k + size]))
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            score, _, left, right = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                                        for k in range(1, len(words)))
            out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out.sort()
    rank, rows = Counter(), set()
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def corpus(rng):
    words = [f"w{k}" for k in range(40)] + ["É", "ÀB", "日本", "a-b", "The", "THE"]
    rows = []
    for k in range(300):
        some = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 60))
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ;"]) for w in some), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [("New York City is big", "en")] * 45 + [("New York", "en")] * 10 + [("x x x x x x", "de")] * 20
    return rows + [(None, "en"), ("", None), (" \t.,", "fr"), ("only once", "fr")]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_equals_plain_counting(spark, partitions):
    rows = corpus(random.Random(3))
    want = plain(rows, support=10)
    assert len(want) > 30 and len({r[0] for r in want}) > 1
    assert got(phrases.collocations(table(spark, rows, partitions), PhraseConfig(support=10))) == want


def test_top_and_ties(spark):
    rows = [(f"{a} {b}", "en") for a, b in ("ab", "cd", "éf", "zy", "xw")] * 30
    want = plain(rows, top=3)
    assert [r[2] for r in sorted(want, key=lambda r: r[1])] == ["a b", "c d", "x w"]
    assert got(phrases.collocations(table(spark, rows), PhraseConfig(top=3))) == want


def test_long_texts_are_counted_whole(spark):
    rng = random.Random(4)
    # Above 32 MiB with and without an end of a piece, and one word of some megabytes.
    unbroken = " ".join(rng.choices(["lorem" * 8, "ipsum" * 7, "dolor" * 9, "sit" * 10], k=950_000))
    broken = " ".join(rng.choices(["uno", "dos", "tres.", "cuatro"], k=200_000))
    rows = [(unbroken, "la"), (broken, "es"), ("z" * 5_000_000 + " tail end", "en"), *[("tail end", "en")] * 40]
    assert len(unbroken) > 32 << 20
    assert got(phrases.collocations(table(spark, rows, 2))) == plain(rows)


def test_empty_tables(spark):
    assert got(phrases.collocations(table(spark, []))) == set()
    assert got(phrases.collocations(table(spark, [(None, None), ("  ", "en")]))) == set()
    assert got(phrases.collocations(table(spark, [("a b", "en")]))) == set()


def test_shards_miss_no_frequent_phrase():
    rng = random.Random(8)
    for _ in range(200):
        sizes = np.array([rng.randrange(1, 1000) for _ in range(rng.randrange(1, 60))])
        least = phrases.local_support(30, sizes, np.full(len(sizes), sizes.sum()))
        # What every shard may hide stays below the support.
        assert (least - 1).sum() < 30


class Handed:
    """Takes the place of a DataFrame: keeps the function that tasks would run."""

    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, work, _):  # noqa: N802
        self.work = work
        return self


def test_a_shard_is_handed_on_in_small_batches():
    rng = random.Random(5)
    words = rng.choices([f"word{k}" for k in range(20_000)], k=300_000)
    pieces = [words[k:k + 1000] for k in range(0, len(words), 1000)]
    texts = pa.RecordBatch.from_pydict({"lang": ["en"] * len(pieces), "text": [" ".join(p) for p in pieces], "n": pa.array([10**9] * len(pieces), pa.int64())})
    task = Handed()
    # As in a large corpus: every phrase of the shard has to be told.
    every = np.full(phrases.BITS // 8, 255, np.uint8)
    phrases.mine_shards(task, every, 30, PhraseConfig(), every)
    f = Counter(" ".join(p[k:k + size]) for p in pieces for size in (3, 4) for k in range(len(p) - size + 1))
    told, sizes = Counter(), []
    tracemalloc.start()
    for batch in task.work(iter([texts])):
        sizes.append(batch.nbytes)
        told.update(x for packed in batch.column("excess").drop_null().to_pylist() for x in np.frombuffer(packed, np.uint8).tolist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == Counter(min(x, 30) for x in f.values())
    assert max(sizes) < 1 << 20
    # Bytes for each word of the shard, above those for the chunk of text at hand.
    assert peak < 60 * len(words) + 16 * phrases.TEXT_CHUNK


def test_a_words_hash_is_the_same_in_every_shard():
    texts = [" ".join(f"{'x' * 40}{k}" for k in range(60_000)), "y" * (2 << 20) + " middle z", "one two"]
    hashes = []
    for order in (texts, texts[::-1], texts[1:]):
        shard = phrases.Shard()
        for text in order:
            shard.add(["en"], [text.encode()], [9])
        assert shard.close()
        hashes.append(dict(zip(shard.texts.to_pylist(), shard.hashes.tolist(), strict=True)))
    assert hashes[0] == hashes[1] and len(hashes[0]) == 60_005 and len(set(hashes[0].values())) == 60_005
    assert hashes[2].items() <= hashes[0].items() and len(hashes[2]) == 5


def test_bits_are_found_again(spark):
    hashes = [0, 1, 7, 8, 32767, 32768, phrases.BITS - 1, -1, -(1 << 63), 123456789123456789]
    bits = phrases.bit_table(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    assert phrases._has(bits, np.array(hashes, np.int64).view(np.uint64)).all()
    assert np.unpackbits(bits).sum() == len({h & (phrases.BITS - 1) for h in hashes})


def test_query_equals_its_sql(spark, folder):
    assert oracle.compare(queries.QUERIES["op11_phrases"](spark, folder), oracle.connect(folder), queries.ORACLES["op11_phrases"]) == []
