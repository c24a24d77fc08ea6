"""Near-duplicate documents by an inverted join over MinHash coordinates, confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.batches import Joined, chunks, mix, shingles
from emberscan.llm.graph import components
from emberscan.llm.store import prepare, workspace, written
from emberscan.session import shuffle_partitions

#: Rows of one list that are compared in one task; longer lists are compared block by block.
BLOCK = 1024


@dataclass(frozen=True)
class MinHashConfig:
    """`percent` is the least similarity. A pair at exactly 80 % agrees in at least 36 of 64 coordinates but for a chance
    of 4 in a million, so `matches` costs no links that matter, and pairs below 30 % hardly ever reach it."""

    words: int = 5
    percent: int = 80
    coordinates: int = 64
    matches: int = 36


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one after the other, and how many each text has."""
    joined = Joined(texts, lower=True)
    starts, ends, owner = joined.words()
    words = joined.fingerprints(starts, ends)
    prints, at = shingles(words, owner, size)
    whose = owner[at]
    # A text of fewer words has one shingle: all of them.
    per_text = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        first = np.searchsorted(owner, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            have = per_text[short] > k
            whole[have] = mix(whole[have] * np.uint64(0xD6E8FEB86659FD93) + words[first[have] + k])
        prints = np.concatenate((prints, mix(whole + per_text[short].astype(np.uint64))))
        whose = np.concatenate((whose, short))
        order = np.argsort(whose, kind="stable")
        prints, whose = prints[order], whose[order]
    bounds = np.searchsorted(whose, np.arange(len(texts) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        prints[lo:hi].sort()
    distinct = np.ones(len(prints), bool)
    distinct[1:] = (prints[1:] != prints[:-1]) | (whose[1:] != whose[:-1])
    return prints[distinct], np.bincount(whose[distinct], minlength=len(texts))


def _signatures(sets: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One 64-bit token per coordinate and text: the coordinate's least value, marked with the coordinate."""
    rng = np.random.default_rng(104729)
    xors, factors = rng.integers(0, 2**63, (2, coordinates), dtype=np.uint64)
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), np.uint64)
    for k in range(coordinates):
        out[:, k] = mix(np.minimum.reduceat((sets ^ xors[k]) * (factors[k] * np.uint64(2) + np.uint64(1)), begins) + np.uint64(k))
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """Ids and texts, and a hash that tells apart the texts of one id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def described(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """`doc_id, text_hash, n_shingles, d1, d2, tokens`: size and digest of each text's set, and its signature (NULL for an empty set)."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                sets, sizes = shingle_sets(texts, config.words)
                some = np.flatnonzero(sizes)
                begins = (np.cumsum(sizes) - sizes)[some]
                digests = np.zeros((2, len(texts)), np.uint64)
                tokens = np.empty((0, config.coordinates), np.uint64)
                if len(some):
                    digests[0, some] = np.add.reduceat(mix(sets), begins)
                    digests[1, some] = np.add.reduceat(mix(sets ^ np.uint64(0x27D4EB2F165667C5)), begins)
                    tokens = _signatures(sets, sizes[some], config.coordinates)
                offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, config.coordinates, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array(sizes.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digests), lists], schema=schema)

    return _hashed(docs).mapInArrow(
        describe, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, tokens array<long>")


def _posted(reps: DataFrame, config: MinHashConfig) -> DataFrame:
    """`token, rep, n`: each document under the coordinate-value pairs of its prefix.

    Pairs are ordered by how many documents have them. Two documents that agree in `matches` of their pairs share one of
    the first `coordinates - matches + 1`; pairs that only one document has come first and need no posting. A document
    whose frequent passage it shares with many others is therefore posted under what is rarer about it, or not at all.
    """
    tokens = reps.select("rep", "n", F.explode("tokens").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "coordinates")
    mine = tokens.join(shared, "token").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    spare = F.size("found") - (config.matches - 1)
    prefix = mine.where(spare > 0).select("rep", "n", F.explode(F.slice("found", 1, spare)).alias("found"))
    return prefix.select(F.col("found.token").alias("token"), "rep", "n")


def _shingled(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """`rep, shingles`: the full sets of the classes in `needed`, recomputed from the text that `doc_id, text_hash` names."""
    # Most texts go by their ids alone, so few are dealt by what tells apart the texts of one id.
    ids = written(needed.select("doc_id").distinct(), "ids")
    some = _hashed(docs).join(ids, "doc_id", "left_semi")
    rows = some.join(needed, ["doc_id", "text_hash"]).select("rep", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                sets, sizes = shingle_sets(texts, words)
                offsets = np.concatenate(([0], np.cumsum(sizes * 8))).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(sets.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("rep"), blobs], ["rep", "shingles"])

    return rows.mapInArrow(build, "rep long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a, b` whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                both = int((two[at] == one).sum())
                keep[i] = 100 * both >= percent * (len(one) + len(two) - both)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long")


def _alike_in_size(n: str, m: str, percent: int) -> F.Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _compare_blocks(config: MinHashConfig):
    def compare(key, table):
        """Links between two blocks of one list that join components, as a forest: one row for each two that meet.

        A pair is looked at in the first of the lists it shares, if its components differ, its sizes allow the similarity
        and its signatures agree in enough coordinates; then its full sets are compared.
        """
        spot, one, two = (k.as_py() for k in key)
        table = table.combine_chunks()
        block, rep, n = (table.column(c).to_numpy() for c in ("block", "rep", "n"))
        comp = table.column("comp").to_numpy().copy()
        tokens = np.stack(table.column("tokens").to_numpy(zero_copy_only=False)).astype(np.uint32)
        lists = [np.array(x) for x in table.column("lists").to_pylist()]
        # The lists below this one that a member is in, as a padded table.
        lists = [np.sort(x[x < spot]) for x in lists]
        width = max(1, *map(len, lists))
        before = np.stack([np.concatenate((x, np.full(width - len(x), np.iinfo(np.int64).max))) for x in lists])
        blobs = table.column("shingles").to_pylist()
        sizes = np.array([len(x) // 8 for x in blobs])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        a, b = [], []
        for i in left.tolist():
            others = right[rep[right] > rep[i]] if one == two else right
            others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= config.percent * np.maximum(n[others], n[i]))]
            others = others[(tokens[others] == tokens[i]).sum(axis=1) >= config.matches]
            if len(lists[i]) and len(others):
                others = others[~np.isin(before[others], lists[i]).any(axis=1)]
            if not len(others):
                continue
            own = np.frombuffer(blobs[i], np.uint64)
            for lo in range(0, len(others), 128):
                some = others[lo:lo + 128]
                # Links found meanwhile may have joined some of them.
                some = some[comp[some] != comp[i]]
                if not len(some):
                    continue
                flat = np.frombuffer(b"".join([blobs[j] for j in some.tolist()]), np.uint64)
                met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                for j in some[100 * both >= config.percent * (sizes[i] + sizes[some] - both)].tolist():
                    if comp[j] != comp[i]:
                        a.append(rep[i])
                        b.append(rep[j])
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return compare


def _with_components(rows: DataFrame, labels: DataFrame, column: str, output: str) -> DataFrame:
    named = labels.select(F.col("v").alias(column), F.col("component").alias(output))
    return rows.join(named, column, "left").withColumn(output, F.coalesce(output, column))


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`: groups of documents linked by set similarity.

    1. Texts with equal sets are one class; only classes are joined. The classes of one id's texts are linked.
    2. Classes are posted under the prefix of their signature (`_posted`).
    3. In every list each member is compared with the list's first one, the best such pair of a class first; pairs
       whose ends are linked already are skipped. A group of n near copies so costs about n comparisons, not n squared.
    4. Lists that still hold more than one component are compared whole, in blocks, across components only, each pair in
       the first list it shares; pairs that agree in `matches` coordinates are retained, and a block sends on a forest.
    Every link, of step 3 or 4, is confirmed on the two full sets.

    Defined results: a text without words, or NULL, has an empty set and is linked with nothing; a text of fewer words
    than a shingle is one shingle; rows that repeat a `doc_id` are one document, which has the links of all its texts; a NULL
    `doc_id` is linked with nothing (component NULL, not kept); an empty table gives an empty result; other columns are
    ignored. `kept` marks the least document of each component.
    """
    with workspace(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, config))


def _near_duplicates(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    prepare(docs.sparkSession)
    rows = written(described(docs, config), "signatures")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    # Classes are numbered in the order of their least documents, so the least number of a component has its least document.
    least = usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least")).select("d1", "d2", "least.*")
    order = ["doc_id", "d1", "d2"]
    classes = written(least.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
                      .withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = written(usable.withColumnRenamed("n_shingles", "n").join(classes, ["doc_id", "text_hash", "d1", "d2"])
                   .dropDuplicates(["doc_id", "text_hash", "d1", "d2"]).select("rep", "n", "tokens"), "classes")
    posted = written(_posted(reps, config), "postings")
    lists = written(posted.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("first")).where("members > 1")
                    .select("token", "members", F.col("first.rep").alias("pivot"), F.col("first.n").alias("m")), "lists")
    pairs = written(posted.join(lists, "token").where((F.col("rep") != F.col("pivot")) & _alike_in_size("n", "m", config.percent))
                    .groupBy(F.col("rep").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("hits")), "pairs")
    needed = posted.join(lists.select("token"), "token").select("rep").distinct().join(classes.select("rep", "doc_id", "text_hash"), "rep")
    sets = written(_shingled(docs, written(needed, "needed"), config.words).dropDuplicates(["rep"]), "sets")

    best = pairs.groupBy("a").agg(F.max(F.struct("hits", (-F.col("b")).alias("nb"))).alias("x")).select("a", (-F.col("x.nb")).alias("b"))
    # Different texts of one id are one document.
    varied = usable.groupBy("doc_id").agg(F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2")) \
        .where("a1 != b1 or a2 != b2").select("doc_id")
    texts = usable.select("doc_id", "d1", "d2").join(varied, "doc_id").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").distinct()
    texts = written(texts, "texts")
    same = texts.join(texts.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep != b").select(F.col("rep").alias("a"), "b")

    links = written(confirmed(best, sets, config.percent).unionByName(same), "links")
    labels = written(components(links), "labels")

    open_pairs = _with_components(_with_components(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca != cb")
    more = written(confirmed(open_pairs, sets, config.percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = written(components(links), "labels")

    members = written(_with_components(posted.join(lists.select("token"), "token"), labels, "rep", "comp"), "members")
    open_lists = members.groupBy("token").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("digest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_lists = written(open_lists.where("lo != hi").drop("lo", "hi"), "open")
    if not open_lists.isEmpty():
        # Many coordinates of one group give the same list; it is compared under the least of its tokens.
        one_of = open_lists.groupBy("size", "digest").agg(F.min("token").alias("spot"))
        spots = written(open_lists.join(one_of, ["size", "digest"]).select("token", "spot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "spots")
        placed = members.join(spots, "token").groupBy("rep", "n", "comp").agg(F.collect_set(F.struct("spot", "blocks")).alias("spots"))
        whole = placed.join(reps.select("rep", "tokens"), "rep").join(sets, "rep").withColumn("lists", F.col("spots.spot"))
        dealt = (whole.withColumn("at", F.explode("spots")).withColumn("spot", F.col("at.spot")).withColumn("blocks", F.col("at.blocks")).drop("at", "spots")
                 .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                 .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with")))
        rest = written(dealt.groupBy("spot", "one", "two").applyInArrow(_compare_blocks(config), "a long, b long"), "links")
        if not rest.isEmpty():
            labels = written(components(links.unionByName(rest)), "labels")

    named = _with_components(classes, labels, "rep", "comp").select("d1", "d2", "comp")
    named = written(named.join(classes.select(F.col("rep").alias("comp"), F.col("doc_id").alias("component_id")), "comp").drop("comp"), "named")
    out = rows.drop("tokens", "text_hash").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
