"""Removal of byte strings that an earlier document has already, by sorted suffixes.

A suffix is looked at only at anchors. The anchor of a window of `length` bytes is the position in it of the least of its
24-byte prints, so equal windows have equal anchors, and each window belongs to exactly one. Neighbouring windows with one
anchor are a run. First the anchors that two different texts have are found, then the runs at these are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscan.llm.batches import Joined, chunks, mix
from emberscan.llm.store import discard, prepare, workspace, written

LENGTH = 50
GRAM = 24
#: Longer texts are worked on in pieces of this size that overlap by a window less one byte.
SEGMENT = 4 << 20
#: Anchors, and bytes of runs, that a task holds before it sends them on.
HELD_ANCHORS = 1 << 19
HELD_BYTES = 1 << 23
#: Bytes of text for each bucket of sorted suffixes, up to so many buckets.
BUCKET_BYTES = 4 << 20
MAX_BUCKETS = 1 << 16
#: Texts of the sample that the splitters are drawn from, and a text with more copies than one in so many rows is known everywhere.
SAMPLE = 4000
COMMON = 100_000

_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers or bytes as one compressed string; like bytes of the numbers lie together."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        raw = a.tobytes() if a.dtype.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()
        parts += [bytes([a.dtype.itemsize]), len(a).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        width, n = raw[at], int.from_bytes(raw[at + 1:at + 9], "little")
        at += 9
        a = np.frombuffer(raw, np.uint8, n * width, at)
        out.append(a if width == 1 else np.ascontiguousarray(a.reshape(8, n).T).view(np.int64).ravel())
        at += n * width
    return out


def _places(texts: list[bytes], length: int) -> Iterator[tuple[int, int]]:
    """Row and offset of each piece."""
    for row, text in enumerate(texts):
        for base in range(0, max(1, len(text) - length + 1), SEGMENT):
            yield row, base


class Segments(Joined):
    """Texts, long ones in overlapping pieces, with the row and the offset that each piece comes from."""

    def __init__(self, texts: list[bytes], length: int, places: list[tuple[int, int]] | None = None):
        places = list(_places(texts, length)) if places is None else places
        super().__init__([texts[row][base:base + SEGMENT + length - 1] for row, base in places])
        self.rows, self.bases = (np.array([x[k] for x in places], np.int64) for k in (0, 1))

    @classmethod
    def of(cls, texts: list[bytes], length: int) -> Iterator[Segments]:
        """The pieces of all texts, about `SEGMENT` bytes at a time, so that no array grows with the length of a text."""
        held, size = [], 0
        for row, base in _places(texts, length):
            held.append((row, base))
            size += min(SEGMENT, len(texts[row]) - base)
            if size >= SEGMENT:
                yield cls(texts, length, held)
                held, size = [], 0
        if held:
            yield cls(texts, length, held)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first window, number of windows, and print of the anchor's 24 bytes, for each run."""
        size = len(self.bytes)
        none = np.empty(0, np.int64)
        if size < length:
            return none, none, none, np.empty(0, np.uint64)
        if size > int(_LOW):
            raise ValueError("positions have 24 bits: take long texts by Segments.of")
        at = np.arange(size - GRAM + 1)
        prints = self.fingerprints(at, at + GRAM)
        # The print's upper bits order, the position's 24 bits break ties to the left: equal windows agree on both.
        least = (prints & ~_LOW) | at.astype(np.uint64)
        width, reach = length - GRAM + 1, 1
        whole = least
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        n = len(whole) - width + 1
        least = np.minimum(least[:n], least[width - reach:width - reach + n])
        inside = np.zeros(size + 1, np.int64)
        long_enough = self.ends - self.starts >= length
        inside[self.starts[long_enough]] = 1
        inside[self.ends[long_enough] - length + 1] = -1
        windows = np.flatnonzero(np.cumsum(inside)[:n] > 0)
        if not len(windows):
            return none, none, none, np.empty(0, np.uint64)
        least = least[windows]
        begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        anchors = (least[begins] & _LOW).astype(np.int64)
        return anchors, windows[begins], np.diff(np.append(begins, len(least))), prints[anchors]

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The first eight bytes of each suffix as a number that sorts as they do."""
        eight = np.stack([self.bytes[at + k] for k in range(8)], axis=1) if len(at) else np.empty((0, 8), np.uint8)
        return np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)


class Splitters:
    """Bounds between buckets of suffixes, ordered by leading bytes and then by print. Equal suffixes share a bucket, so
    nothing has to be compared across a bound, and a leading string that very many suffixes share is split by print."""

    def __init__(self, sample: list[tuple[int, int]], buckets: int):
        ordered = sorted((lead & (2**64 - 1), mark & (2**64 - 1)) for lead, mark in sample)
        cut = sorted({ordered[k * len(ordered) // buckets] for k in range(1, buckets)}) if ordered else []
        self.leads = np.array([x[0] for x in cut], np.uint64)
        self.prints = np.array([x[1] for x in cut], np.uint64)
        self.count = len(cut) + 1

    def bucket(self, leads: np.ndarray, prints: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.leads, leads, "left")
        high = np.searchsorted(self.leads, leads, "right")
        for i in np.unique(low[high > low]).tolist():
            tied = np.flatnonzero((low == i) & (high > low))
            low[tied] = i + np.searchsorted(self.prints[i:high[tied[0]]], prints[tied], "right")
        return low


def _by_multikey(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, then each group of equals by the next one."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        tied = np.ones(len(order), bool)
        for k in keys[:depth]:
            tied[1:] &= k[order[1:]] == k[order[:-1]]
        if len(order):
            tied[0] = False
        group = np.cumsum(~tied)
        sizes = np.bincount(group)
        loose = np.flatnonzero(sizes[group] > 1)
        order[loose] = order[loose][np.lexsort((keys[depth][order[loose]], group[loose]))]
    return order


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def _by_key(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    begins = _groups(keys[order])
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
        yield int(keys[order[lo]]), [v[order[lo:hi]] for v in values]


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


_ANCHOR_DDL, _ANCHOR = "bucket int, text_id long, payload binary", (["bucket", "text_id", "payload"], [pa.int32(), pa.int64(), pa.binary()])
_RUN_DDL = "bucket int, sub int, text_id long, weight long, payload binary"
_RUN = (["bucket", "sub", "text_id", "weight", "payload"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])
_COVER_DDL, _COVER = "text_id long, payload binary", (["text_id", "payload"], [pa.int64(), pa.binary()])


def _anchored(splitters: Splitters, length: int):
    """Each anchor print once per task part, and which prints a text shares with another text of this part."""
    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        prints, leads, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = _by_multikey([prints])
        p, t = prints[order], ids[order]
        begins = _groups(p)
        least, most = np.minimum.reduceat(t, begins), np.maximum.reduceat(t, begins)
        several = least != most
        out = []
        # One entry per print asks the other tasks.
        firsts = order[begins]
        where = splitters.bucket(leads[firsts], prints[firsts])
        for bucket, (e, s, i) in _by_key(where, p[begins].view(np.int64), several.astype(np.int64), least):
            out.append((bucket, None, _packed(e, s, i)))
        # What is known to be shared here needs no answer.
        sizes = np.diff(np.append(begins, len(p)))
        shared = np.repeat(several, sizes)
        for text, (e,) in _by_key(t[shared], p[shared]):
            out.append((text % splitters.count, text, np.unique(e).tobytes()))
        return _rows(out, *_ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for part, texts in chunks(batch):
                ids = part.column("text_id").to_numpy()
                for segments in Segments.of(texts, length):
                    anchors, first, _, prints = segments.runs(length)
                    held.append((prints, segments.leads(anchors), ids[segments.rows[segments.owner(first)]]))
                    count += len(prints)
                    if count >= HELD_ANCHORS:
                        yield settle(held)
                        held, count = [], 0
        if count:
            yield settle(held)
    return run


def _shared_anchors(table):
    """The prints of one bucket that several texts have, for each text that asked."""
    ids, payloads = table.column("text_id").to_pylist(), table.column("payload").to_pylist()
    out = [(i, p) for i, p in zip(ids, payloads, strict=True) if i is not None]
    asked = [_unpacked(p) for i, p in zip(ids, payloads, strict=True) if i is None]
    if asked:
        prints, several, text = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(prints, kind="stable")
        p, s, t = prints[order], several[order] > 0, text[order]
        begins = _groups(p)
        found = (np.minimum.reduceat(t, begins) != np.maximum.reduceat(t, begins)) | np.logical_or.reduceat(s, begins)
        answer = np.repeat(found, np.diff(np.append(begins, len(p)))) & ~s
        out += [(i, e.tobytes()) for i, (e,) in _by_key(t[answer], p[answer])]
    return pa.table(_rows(out, *_COVER).to_pydict(), schema=pa.schema(list(zip(*_COVER, strict=True))))


def _later(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Entries whose key a smaller document has, too."""
    order = np.argsort(keys, kind="stable")
    begins = _groups(keys[order])
    if not len(begins):
        return np.zeros(len(keys), bool)
    least = np.minimum.reduceat(docs[order], begins)
    out = np.empty(len(keys), bool)
    out[order] = docs[order] > np.repeat(least, np.diff(np.append(begins, len(order))))
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.empty(0, bool)
    last = np.concatenate((new[1:], [True])) if len(starts) else new
    return starts[new], ends[last]


def _covers(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for text, (s, e) in _by_key(texts, starts, ends):
        yield text, _packed(*_merged(s, e))


def _compared_runs(splitters: Splitters, length: int):
    """Runs at shared anchors: those an earlier document of this part has are settled, the others are sent on."""
    def settle(held: list[tuple[np.ndarray, ...]], chars: list[np.ndarray]) -> pa.RecordBatch:
        marks, leads, prints, ids, docs, starts, counts, offsets = (np.concatenate(x) for x in zip(*held, strict=True))
        data = np.concatenate(chars)
        later = _later(marks, docs)
        out = [(text % splitters.count, 0, text, 0, blob) for text, blob in _covers(ids[later], starts[later], starts[later] + counts[later] + length - 1)]
        rest = np.flatnonzero(~later)
        where = splitters.bucket(leads[rest], prints[rest])
        for bucket, (at,) in _by_key(where, rest):
            sizes = counts[at] + length - 1
            ends = np.cumsum(sizes)
            places = np.repeat(offsets[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            out.append((bucket, 0, None, int(counts[at].sum()), _packed(ids[at], docs[at], starts[at], counts[at], data[places])))
        return _rows(out, *_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, size = [], [], 0
        for batch in batches:
            for part, texts in chunks(batch):
                shared = [np.frombuffer(b"".join(x), np.uint64) for x in part.column("anchors").to_pylist()]
                salt = mix(np.arange(len(texts), dtype=np.uint64) + _U(1))
                mine = np.sort(np.concatenate([s ^ salt[k] for k, s in enumerate(shared)])) if shared else np.empty(0, np.uint64)
                ids, docs = part.column("text_id").to_numpy(), part.column("rep").to_numpy()
                for segments in Segments.of(texts, length):
                    anchors, first, counts, prints = segments.runs(length)
                    owner = segments.owner(first)
                    rows = segments.rows[owner]
                    asked = prints ^ salt[rows]
                    keep = np.zeros(len(asked), bool)
                    if len(mine):
                        keep = mine[np.minimum(np.searchsorted(mine, asked), len(mine) - 1)] == asked
                    anchors, first, counts, prints, owner, rows = (x[keep] for x in (anchors, first, counts, prints, owner, rows))
                    sizes = counts + length - 1
                    ends = np.cumsum(sizes)
                    total = int(ends[-1]) if len(ends) else 0
                    places = np.repeat(first - (ends - sizes), sizes) + np.arange(total)
                    starts = first - segments.starts[owner] + segments.bases[owner]
                    marks = segments.fingerprints(first, first + sizes) ^ mix(counts.astype(np.uint64))
                    held.append((marks, segments.leads(anchors), prints, ids[rows], docs[rows], starts, counts, size + ends - sizes))
                    chars.append(segments.bytes[places])
                    size += total
                    if size >= HELD_BYTES:
                        yield settle(held, chars)
                        held, chars, size = [], [], 0
        if held:
            yield settle(held, chars)
    return run


def _windows(blob: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Print, text, document and start of every window of the runs in a payload."""
    arrays = _unpacked(blob)
    if len(arrays) == 4:
        return arrays[0].view(np.uint64), arrays[1], arrays[2], arrays[3]
    ids, docs, starts, counts, data = arrays
    text = Joined([data.tobytes()])
    sizes = counts + length - 1
    begins = np.cumsum(sizes) - sizes
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(begins, counts) + step
    return text.fingerprints(at, at + length), np.repeat(ids, counts), np.repeat(docs, counts), np.repeat(starts, counts) + step


def _split_windows(parts: dict[int, int], length: int):
    """Runs of a bucket that is too large, taken apart into windows and dealt to sub-buckets by the windows' prints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, text, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "text_id", "payload")), strict=True):
                if text is not None or bucket not in parts:
                    out.append((bucket, 0, text, 0, payload))
                    continue
                prints, ids, docs, starts = _windows(payload, length)
                later = _later(prints, docs)
                out += [(t % len(parts), 0, t, 0, blob) for t, blob in _covers(ids[later], starts[later], starts[later] + length)]
                rest = ~later
                for sub, (p, i, d, s) in _by_key((prints[rest] % _U(parts[bucket])).astype(np.int64), prints[rest].view(np.int64), ids[rest], docs[rest], starts[rest]):
                    out.append((bucket, sub, None, len(p), _packed(p, i, d, s)))
            yield _rows(out, *_RUN)
    return run


def _judge_bucket(length: int):
    def judge(table):
        """Sort one bucket's windows; those that a smaller document has are covered."""
        ids, payloads = table.column("text_id").to_pylist(), table.column("payload").to_pylist()
        out = [(i, p) for i, p in zip(ids, payloads, strict=True) if i is not None]
        found = [_windows(p, length) for i, p in zip(ids, payloads, strict=True) if i is None]
        if found:
            prints, texts, docs, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            later = _later(prints, docs)
            out += list(_covers(texts[later], starts[later], starts[later] + length))
        return pa.table(_rows(out, *_COVER).to_pydict(), schema=pa.schema(list(zip(*_COVER, strict=True))))
    return judge


def _removed(with_text: bool):
    """What is left of each text once its covered bytes are gone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                removed, spans, digests, kept = [], [], [], []
                for text, blobs in zip(texts, part.column("covers").to_pylist(), strict=True):
                    pairs = [_unpacked(b) for b in blobs]
                    starts, ends = _merged(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
                    left, at = [], 0
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                        left.append(text[at:a])
                        at = b
                    rest = b"".join([*left, text[at:]])
                    removed.append(len(text) - len(rest))
                    spans.append(len(starts))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    if with_text:
                        # A cut may fall inside a character; what is left of it goes.
                        kept.append(rest.decode("utf-8", "ignore"))
                columns = [part.column("text_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                names = ["text_id", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` (and `kept_text`) of every document.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Copies of one
    text are settled by its digest; of each text its least document is compared.

    1. Anchors are posted to buckets between sampled splitters of the suffixes' leading bytes, each print once per part
       of a task, however often it occurs there; buckets sort and answer which prints several texts have.
    2. Texts with such anchors send the runs there to the same buckets, again each distinct run once per part. A bucket
       sorts all windows of its runs. A bucket that got too much, because one anchor has very many contexts, is first
       taken apart into windows, which are dealt by their prints.
    3. Covered intervals go back to their text, which is cut once.

    Defined results: NULL text is empty; texts shorter than `length` lose nothing; a document with a NULL id neither
    loses nor takes anything; rows that repeat an id and text are judged alike; an empty table gives an empty result;
    other columns are ignored.
    """
    with workspace(docs.sparkSession) as keep:
        return keep(_repeated_bytes(docs, length, with_text))


def _repeated_bytes(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))
    digests = written(base.select(
        "doc_id", "text_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "digests")
    usable = digests.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("text_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    total = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    # At most COMMON texts can have more than one in COMMON of all rows.
    common = classes.where(F.col("copies") > max(1, total["n"] // COMMON)).select("text_id", "rep")
    rows = (base.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).join(F.broadcast(common), "text_id", "left")
            .where(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))).drop("rep"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch):
                for segments in Segments.of(texts, length):
                    anchors, _, _, prints = segments.runs(length)
                    some = prints % _U(64) == 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (segments.leads(anchors[some]), prints[some])], ["lead", "print"])

    share = min(1.0, SAMPLE / max(1, total["n"]))
    sample = rows.select("text").sample(share, seed=17).mapInArrow(sampled, "lead long, print long").collect()
    splitters = Splitters([(r["lead"], r["print"]) for r in sample], int(min(MAX_BUCKETS, max(1, total["bytes"] // BUCKET_BYTES))))

    answers = (rows.select("text_id", "text").mapInArrow(_anchored(splitters, length), _ANCHOR_DDL)
               .groupBy("bucket").applyInArrow(_shared_anchors, _COVER_DDL))
    found = written(answers.groupBy("text_id").agg(F.collect_list("payload").alias("anchors")), "anchors")
    wanted = found.join(classes.select("text_id", "rep"), "text_id").select(F.col("rep").alias("doc_id"), "text_id", "rep", "anchors")
    runs = written(rows.join(wanted, ["doc_id", "text_id"]).select("text_id", "rep", "text", "anchors")
                   .mapInArrow(_compared_runs(splitters, length), _RUN_DDL), "runs")
    discard(found)
    # One row per bucket comes to the driver, MAX_BUCKETS at most.
    weights = {r["bucket"]: r["weight"] for r in runs.where("text_id is null").groupBy("bucket").agg(F.sum("weight").alias("weight")).collect()}
    usual = max(1, sum(weights.values()) // max(1, len(weights)))
    large = {b: -(-w // usual) for b, w in weights.items() if w > 2 * usual}
    judged = runs if not large else runs.mapInArrow(_split_windows(large, length), _RUN_DDL)
    covers = judged.groupBy("bucket", "sub").applyInArrow(_judge_bucket(length), _COVER_DDL)
    covers = written(covers.groupBy("text_id").agg(F.collect_list("payload").alias("covers")), "covers")
    discard(runs)
    named = covers.join(classes.select("text_id", "rep"), "text_id").select(F.col("rep").alias("doc_id"), "text_id", "covers")
    schema = "text_id long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    cut = written(rows.join(named, ["doc_id", "text_id"]).select("text_id", "text", "covers")
                  .mapInArrow(_removed(with_text), schema).dropDuplicates(["text_id"]), "cut")

    out = digests.join(classes.select("text_id", "rep"), "text_id", "left")
    out = written(out.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))), "judged")
    own = cut.withColumnRenamed("text_id", "cut_id")
    # Only the least document of a text is looked up, so no text is looked up by very many rows.
    key = F.when(F.col("doc_id") == F.col("rep"), F.col("text_id"))
    out = out.withColumn("cut_id", key).join(own, "cut_id", "left")
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy")
    out = out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *(["text_id", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
    return out
