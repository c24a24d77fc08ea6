"""Token files against the library itself, read back whole and by place."""

import random
import sys
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberscan.llm import queries, token_files  # noqa: E402
from emberscan.llm.store import new_path  # noqa: E402
from support import awkward, documents  # noqa: E402

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_digests_equal_the_library(spark, library):
    texts = awkward(random.Random(1)) + [(1000, "say <|endoftext|> twice <|endoftext|>"), (1001, "word " * 3000), (None, "no id")]
    folder = new_path(spark, "files")
    parts = token_files.write_tokens(documents(spark, texts).repartition(5), folder, NAME)
    rows = token_files.read_digests(spark, folder).orderBy("start").collect()
    # Without an id first, then by id; what is left open is the order of different texts of one id.
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, crc32(np.array(ids_of(library, t), "<u4").tobytes()), len(ids_of(library, t))) for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    # The bases are prefix sums over the parts.
    parts = parts.orderBy("part").collect()
    assert len(parts) > 1 and {p.width for p in parts} == {2}
    for a, b in zip(parts, parts[1:]):
        assert (b.first_doc, b.first_id) == (a.first_doc + a.n_docs, a.first_id + a.n_ids)
    read = {r.start: r.ids for r in token_files.read_tokens(spark, folder).collect()}
    assert all(crc32(np.array(read[r.start], "<u4").tobytes()) == r.ids_crc32 for r in rows)
    for number in (0, 3, len(rows) - 1):
        assert token_files.open_document(spark, folder, number).tolist() == read[rows[number].start]
    with pytest.raises(IndexError):
        token_files.open_document(spark, folder, len(rows))


def test_file_format(spark, library):
    folder = new_path(spark, "files")
    parts = token_files.write_tokens(documents(spark, [(5, "one two"), (2, "three"), (None, None)]), folder, NAME).orderBy("part").collect()
    system, path = token_files.place(folder)
    seen = []
    for part in parts:
        flat = np.memmap(f"{path}/{part.file}.ids", "<u2", "r")
        offsets = np.memmap(f"{path}/{part.file}.offsets", "<u8", "r")
        docs = np.memmap(f"{path}/{part.file}.docs", "<i8", "r")
        assert (len(flat), len(offsets), len(docs)) == (part.n_ids, part.n_docs + 1, part.n_docs)
        seen += [(None if k < part.n_null else d, flat[a:b].tolist()) for k, (d, a, b) in enumerate(zip(docs.tolist(), offsets[:-1], offsets[1:]))]
    assert seen == [(None, [2]), (2, ids_of(library, "three")), (5, ids_of(library, "one two"))]


def test_wide_ids(spark, library):
    folder = new_path(spark, "files")
    token_files.write_tokens(documents(spark, [(5, "one two"), (2, "three")]), folder, NAME, end_id=1 << 20)
    assert [r.ids for r in token_files.read_tokens(spark, folder).orderBy("start").collect()] == [
        [*ids_of(library, t)[:-1], 1 << 20] for t in ("three", "one two")]


def test_very_long_text_and_hot_id(spark, library):
    long = "abc defg\n" * 4_000_000
    texts = [(1, long)] + [(7, f"copy {k % 3}") for k in range(500)]
    folder = new_path(spark, "files")
    token_files.write_tokens(documents(spark, texts), folder, NAME)
    rows = token_files.read_digests(spark, folder).orderBy("start").collect()
    assert len(long) > 32 << 20 and len(rows) == len(texts)
    unit = ids_of(library, "abc defg\n" * 50)[:-1]
    assert rows[0].ids_crc32 == crc32(np.array([*unit * 80_000, 2], "<u4").tobytes())
    assert {r.n_tokens for r in rows[1:]} == {len(ids_of(library, "copy 1"))}


def test_empty_table(spark):
    folder = new_path(spark, "files")
    assert token_files.write_tokens(documents(spark, []), folder, NAME).count() == 0
    assert token_files.read_digests(spark, folder).count() == 0 and token_files.read_tokens(spark, folder).count() == 0


def test_query_over_the_shared_table(spark, folder, library):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in rows:
        ids = ids_of(library, r.text)
        want.append((r.doc_id, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.QUERIES["op13_token_files"](spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want
