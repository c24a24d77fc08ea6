"""Token ids of a corpus as flat binary files with 64-bit document offsets.

A folder holds, for every part `p` of the corpus in ascending `doc_id` order:

* `p.ids`: the ids of all its documents one after the other, unsigned little-endian integers, two bytes each where the
  vocabulary allows it and four otherwise;
* `p.offsets`: unsigned 64-bit, one more than it has documents; document k has ids `offsets[k]` to `offsets[k + 1]` of the part;
* `p.docs`: signed 64-bit `doc_id`s; the first `n_null` of them stand for NULL;

and `parts`, a Parquet table with one row a part: `part, file, width, n_docs, n_null, n_ids, first_doc, first_id`. The last
two are prefix sums over the parts, so a document's place in the whole corpus is `first_id + offsets[k]`.

File names carry a fresh number for each attempt of a task, and only the attempts that Spark accepts are in `parts`: a lost
executor or a speculative copy leaves files that nothing names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberscan.llm.batches import chunks
from emberscan.llm.store import prepare
from emberscan.llm.tokens import TEXT_CHUNK, encoder
from emberscan.session import shuffle_partitions

END_ID = 2
#: Bytes of text that a part is meant to hold; a part has at least one document.
PART_BYTES = 256 << 20
#: Ids that are read from a part at a time; a longer document is read in several steps.
READ_IDS = 1 << 20

_PART = pa.schema([("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())])
_PART_DDL = "part int, file string, width int, n_docs long, n_null long, n_ids long"
_PARTS_DDL = f"{_PART_DDL}, first_doc long, first_id long"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path there. `file:/x`, `file:///x` and `/x` are the same folder."""
    local = re.fullmatch("(?:file:(?://)?)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


class PartWriter:
    """Writes one part, document by document, holding no more than what it is handed."""

    def __init__(self, folder: str, part: int, width: int):
        self.system, path = place(folder)
        self.system.create_dir(path, recursive=True)
        self.part, self.width, self.name = part, width, f"{part:07d}-{uuid4().hex}"
        self.files = {kind: self.system.open_output_stream(f"{path}/{self.name}.{kind}") for kind in ("ids", "offsets", "docs")}
        self.files["offsets"].write(np.zeros(1, "<u8").tobytes())
        self.n_docs = self.n_null = self.n_ids = 0

    def append(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with `counts` ids each, after those that are there."""
        self.files["ids"].write(ids.astype(f"<u{self.width}").tobytes())
        self.files["offsets"].write((self.n_ids + np.cumsum(counts)).astype("<u8").tobytes())
        self.files["docs"].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.n_docs += len(counts)
        self.n_null += docs.null_count
        self.n_ids += len(ids)

    def close(self) -> pa.RecordBatch:
        for file in self.files.values():
            file.close()
        row = {"part": self.part, "file": self.name, "width": self.width, "n_docs": self.n_docs, "n_null": self.n_null, "n_ids": self.n_ids}
        return pa.RecordBatch.from_pylist([row], schema=_PART)


class Part:
    """A part opened for reading: memory-mapped where the folder is a mounted one, read by position otherwise."""

    def __init__(self, folder: str, file: str, width: int, n_docs: int, n_null: int, n_ids: int):
        self.system, path = place(folder)
        self.n_docs, self.n_null, self.n_ids, self.width = n_docs, n_null, n_ids, width
        self._ids = self._open(f"{path}/{file}.ids", f"<u{width}", n_ids)
        self.offsets = self._open(f"{path}/{file}.offsets", "<u8", n_docs + 1)
        self._docs = self._open(f"{path}/{file}.docs", "<i8", n_docs)

    def _open(self, path: str, dtype: str, n: int):
        if not n:
            return np.empty(0, dtype)
        if isinstance(self.system, fs.LocalFileSystem):
            return np.memmap(path, dtype, "r", shape=(n,))
        file = self.system.open_input_file(path)
        size = np.dtype(dtype).itemsize

        class Remote:
            def __getitem__(self, at: slice) -> np.ndarray:
                return np.frombuffer(file.read_at((at.stop - at.start) * size, at.start * size), dtype)
        return Remote()

    def span(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """`doc_id`s and offsets of documents `start` to `stop`; there is one offset more."""
        return self._docs[start:stop], self.offsets[start:stop + 1].astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return self._ids[start:stop]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode every whole text, end it with `end_id`, and write the files of this module to `folder`; returns `parts`.

    Documents are range-partitioned by `doc_id` (then by content and input position, so that neither one id nor one text
    can fill a part), sorted inside their part and encoded as they stream by. What each part counts is summed over the
    parts before it, in a table with one row a part.

    Defined results: NULL text is empty and has the end id alone; NULL `doc_id`s come first; rows of one id are in order
    of their texts' digests, equal rows all count; an empty table gives an empty `parts`; other columns are ignored.
    A folder must be new.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(shuffle_partitions(spark), -(-n_bytes // part_bytes))
    order = ["doc_id", "digest", "row"]
    ranged = rows.select("*", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row")) \
        .repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        width = 2 if max(len(coder.widths) - 1, end_id) < 1 << 16 else 4
        writer = None
        for batch in batches:
            for part, texts in chunks(batch, "text", TEXT_CHUNK):
                writer = writer or PartWriter(folder, TaskContext.get().partitionId(), width)
                counts, slot = coder.encode(texts)
                ends = np.cumsum(counts)
                writer.append(part.column("doc_id").cast(pa.int64()), np.insert(coder.flat_ids(slot), ends, end_id), counts + 1)
        if writer:
            yield writer.close()

    # Writing the rows that name the files is what commits them.
    ranged.select("doc_id", "text").mapInArrow(encoded, _PART_DDL).write.parquet(f"{folder}/written")
    written = spark.read.schema(_PART_DDL).parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = {name: F.coalesce(F.sum(col).over(before), F.lit(0)) for name, col in (("first_doc", "n_docs"), ("first_id", "n_ids"))}
    written.select("*", *[value.alias(name) for name, value in bases.items()]).write.parquet(f"{folder}/parts")
    return read_parts(spark, folder)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_PARTS_DDL).parquet(f"{folder}/parts")


def _spans(parts: DataFrame, per_span: int = 4096) -> DataFrame:
    """Runs of documents of one part, so that a large part is read by many tasks."""
    runs = F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(per_span)))
    spans = parts.where("n_docs > 0").select("*", runs.alias("from")).withColumn("to", F.least(F.col("from") + per_span, "n_docs"))
    return spans.repartition(shuffle_partitions(parts.sparkSession), "part", "from")


def _opened(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[dict, Part]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, Part(folder, row["file"], row["width"], row["n_docs"], row["n_null"], row["n_ids"])


def _doc_ids(row: dict, docs: np.ndarray) -> pa.Array:
    return pa.array(docs.astype(np.int64), pa.int64(), mask=np.arange(row["from"], row["to"]) < row["n_null"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, from the files alone.

    The checksum is over the ids as little-endian unsigned 32-bit integers, taken in steps of `READ_IDS`.
    """
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part in _opened(batches, folder):
            docs, offsets = part.span(row["from"], row["to"])
            sums = np.zeros(len(docs), np.int64)
            k = 0
            while k < len(docs):
                # As many whole documents as fit, or a stretch of one that does not.
                stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + READ_IDS, "right")) - 1)
                if offsets[stop] - offsets[k] <= READ_IDS:
                    ids = part.ids(int(offsets[k]), int(offsets[stop])).astype("<u4").tobytes()
                    cuts = ((offsets[k:stop + 1] - offsets[k]) * 4).tolist()
                    view = memoryview(ids)
                    sums[k:stop] = [crc32(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                else:
                    total = 0
                    for at in range(int(offsets[k]), int(offsets[stop]), READ_IDS):
                        total = crc32(part.ids(at, min(at + READ_IDS, int(offsets[stop]))).astype("<u4").tobytes(), total)
                    sums[k] = total
                k = stop
            yield pa.RecordBatch.from_arrays([
                _doc_ids(row, docs), pa.array(row["first_id"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums)], schema=_DIGEST)

    return _spans(read_parts(spark, folder)).mapInArrow(digested, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id, start, ids` of every document. A document's ids are one value here; `Part` reads any stretch of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, part in _opened(batches, folder):
            docs, offsets = part.span(row["from"], row["to"])
            k = 0
            while k < len(docs):
                stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + READ_IDS, "right")) - 1)
                ids = pa.array(part.ids(int(offsets[k]), int(offsets[stop])).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array((offsets[k:stop + 1] - offsets[k]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([
                    _doc_ids(row, docs).slice(k, stop - k), pa.array(row["first_id"] + offsets[k:stop]), lists], schema=schema)
                k = stop

    return _spans(read_parts(spark, folder)).mapInArrow(listed, "doc_id long, start long, ids array<long>")


def open_document(spark: SparkSession, folder: str, number: int) -> np.ndarray:
    """The ids of document `number` of the corpus (from 0), by its part's offsets, without reading anything else."""
    held = read_parts(spark, folder).where((F.col("first_doc") <= number) & (F.col("first_doc") + F.col("n_docs") > number)).collect()
    if not held:
        raise IndexError(f"the corpus has no document {number}")
    row = held[0]
    part = Part(folder, row["file"], row["width"], row["n_docs"], row["n_null"], row["n_ids"])
    at = number - row["first_doc"]
    _, offsets = part.span(at, at + 1)
    return np.array(part.ids(int(offsets[0]), int(offsets[1])), np.int64)
