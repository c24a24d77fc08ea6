"""Document operators against plain re-statements, on odd rows and on the smallest shared table."""

import random
import sys
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
import support  # noqa: E402
from emberscan.llm import langid, minhash, mixing, packing, queries, rules, suffixes, token_cache, tokens  # noqa: E402
from emberscan.llm.store import new_path  # noqa: E402


@pytest.fixture(scope="module")
def texts():
    return support.awkward(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return support.documents(spark, texts).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return support.documents(spark, [])


@pytest.fixture(scope="module")
def table(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def check_links(rows, texts, size):
    sets = {}
    for i, t in texts:
        if i is not None:
            sets[i] = support.shingles(t, size)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = support.components(ids, links)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]), r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_links(docs, texts, size):
    rows = minhash.near_duplicates(docs, minhash.MinHashConfig(words=size)).collect()
    assert len(rows) == len(texts)
    check_links(rows, texts, size)


def test_minhash_compares_lists_that_the_first_member_does_not_join(spark, monkeypatch):
    # A chain: neighbours are similar, the ends are not, so lists hold members their first one is not linked with.
    rng = random.Random(8)
    words = support.prose(rng, 400).split(" ")
    texts = [(1000 - k, " ".join(words[14 * k:14 * k + 200])) for k in range(14)]
    texts += [(k, " ".join(words[100:240] + support.prose(rng, 60).split(" "))) for k in range(30)]
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = minhash.near_duplicates(support.documents(spark, texts), minhash.MinHashConfig(words=4)).collect()
    check_links(rows, texts, 4)


def test_minhash_texts_of_one_id_are_one_document(spark):
    rng = random.Random(3)
    one, two = support.prose(rng, 80), support.prose(rng, 80)
    texts = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail"), (4, support.prose(rng, 80))]
    for order in (texts, texts[::-1]):
        rows = minhash.near_duplicates(support.documents(spark, order).coalesce(1)).collect()
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_minhash_on_the_shared_table(spark, folder, table):
    check_links(queries.QUERIES["op3_minhash"](spark, folder).collect(), [(i, r["text"]) for i, r in table.items()], 4)


def repeated(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


@pytest.mark.parametrize("bucket", [4 << 20, 300])
def test_repeated_bytes(docs, texts, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    want = support.repeated_bytes(texts, 50)
    got = repeated(suffixes.repeated_bytes(docs).collect())
    assert got == sorted((i is None, i or 0, *want[i, t]) for i, t in texts)


def test_long_texts_are_cut_with_an_overlap(monkeypatch):
    text = support.prose(random.Random(1), 900).encode()
    whole = suffixes.Segments([text], 50)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    parts = suffixes.Segments([text], 50)

    def windows(s):
        _, first, counts, _ = s.runs(50)
        owner = s.owner(first)
        begin = first - s.starts[owner] + s.bases[owner]
        return sorted(x for b, c in zip(begin.tolist(), counts.tolist(), strict=True) for x in range(b, b + c))

    assert windows(parts) == windows(whole) == list(range(len(text) - 49))


def test_passages_behind_16_mib_of_a_text_are_found(spark):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    long = letters[rng.integers(0, 27, 17 << 20)].tobytes().decode()
    early, late = long[1000:1400], long[-5000:-4600]
    docs = spark.createDataFrame([(1, f"{early} {late}"), (2, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.repeated_bytes(docs, with_text=True).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] in range(800, 804) and got[2]["n_spans"] == 2
    assert early not in got[2]["kept_text"] and late not in got[2]["kept_text"]


def test_splitters_keep_equal_keys_together():
    rng = np.random.default_rng(2)
    leads, prints = rng.integers(0, 4, 5000).astype(np.uint64), rng.integers(0, 50, 5000).astype(np.uint64)
    split = suffixes.Splitters(list(zip(leads[:500].tolist(), prints[:500].tolist(), strict=True)), 16)
    where = split.bucket(leads, prints)
    keys = list(zip(leads.tolist(), prints.tolist(), strict=True))
    order = sorted(range(5000), key=keys.__getitem__)
    assert (np.diff(where[order]) >= 0).all() and len(set(where.tolist())) > 8
    assert all(where[a] == where[b] for a, b in zip(order, order[1:], strict=False) if keys[a] == keys[b])


def test_repeated_bytes_on_the_shared_table(spark, folder, table):
    texts = [(i, r["text"]) for i, r in sorted(table.items())]
    want = support.repeated_bytes(texts, 50)
    assert repeated(queries.QUERIES["op8_suffixes"](spark, folder).collect()) == sorted((False, i, *want[i, t]) for i, t in texts)


ODD = ["", " ", "  ", "a ", " a", "a  b", "a\n\nb ", "it's they're", "x<|endoftext|>y", " é é\xa0b　c ▁ ▁d", "１２ 3a!? ...", "\x00\x1f", "a" * 500, "日本語 text"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_unit_wise_ids_are_the_librarys(name, table):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab  \n\t.,'sé\xa0　▁ß") for _ in range(rng.randrange(40))) for _ in range(500)]
    whole = [*ODD, *made, *(r["text"] or "" for r in table.values())]
    coder = tokens.Encoder(name)
    counts, slot = coder.encode([t.encode() for t in whole])
    want = [coder.model.encode(t, add_special_tokens=False).ids if name.endswith("json") else coder.model.encode(t) for t in whole]
    assert counts.tolist() == [len(x) for x in want]
    assert coder.flat_ids(slot).tolist() == [i for x in want for i in x]


def test_token_cache_encodes_only_misses(spark, docs, texts):
    cache, name = new_path(spark, "cache"), "piece_bpe_32k.model"
    coder = tokens.Encoder(name)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(coder.model.encode(t or ""))) for i, t in texts)
    some = docs.where("doc_id < 200")
    token_cache.count_tokens(some, cache, name).collect()
    before = spark.read.parquet(cache).count()
    for _ in range(2):
        got = token_cache.count_tokens(docs, cache, name).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
        stored = spark.read.parquet(cache)
        assert before < stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in texts})


def test_token_counts_of_another_tokenizer_are_kept_apart(spark, docs):
    cache = new_path(spark, "cache")
    one = token_cache.count_tokens(docs, cache, "piece_bpe_32k.model").agg({"n_tokens": "sum"}).first()[0]
    two = token_cache.count_tokens(docs, cache, "byte_bpe_50k.json").agg({"n_tokens": "sum"}).first()[0]
    assert one != two and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def check_packing(rows, texts, capacity=1024):
    coder = tokens.Encoder("byte_bpe_50k.json")
    want = []
    for i, t in texts:
        ids = [*coder.model.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        for k, at in enumerate([0, *range(first, len(ids), capacity)]):
            piece = ids[at:first] if k == 0 else ids[at:at + capacity]
            want.append((i is None, i or 0, k, at, len(piece), crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 12)
    check_packing(packing.pack_documents(docs, "byte_bpe_50k.json").collect(), texts)


def test_packing_on_the_shared_table_is_tight(spark, folder, table):
    used, bound = check_packing(queries.QUERIES["op5_genetic_packing"](spark, folder).collect(), [(i, r["text"]) for i, r in table.items()])
    assert used <= bound * 1.01 + 1


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 900, 300)
    one, two = (packing.Grouping(sizes, np.full(300, -1, np.int64), []) for _ in range(2))
    one.place(np.arange(300), 1024)
    two.place(rng.permutation(300)[:150], 1024)
    two.place(np.flatnonzero(two.groups < 0), 1024)
    child = packing.crossover(one, two, 1024, rng)
    assert (child.groups >= 0).all()
    loads = np.bincount(child.groups, weights=sizes, minlength=len(child.loads))
    assert loads.tolist() == child.loads and loads.max() <= 1024


def test_rule_counts(docs, texts):
    got = sorted(([r["doc_id"] or 0, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))] for r in rules.rule_counts(docs).collect()))
    assert got == sorted([i or 0, *support.rule_counts(t)] for i, t in texts)


def test_rule_counts_of_the_shared_table(spark, folder, table):
    for r in queries.QUERIES["op10_host_rules"](spark, folder).collect():
        want = support.rule_counts(table[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= rules.HOST_LIMIT)


def test_host_verdicts_are_shrunk(spark):
    good, bad = support.prose(random.Random(1), 40), "short"
    rows = [(k, good, "good") for k in range(40)] + [(100 + k, bad if k % 10 else good, "bad") for k in range(40)] + [(200, bad, "tiny"), (201, good, None), (202, good, "mixed"), (203, good, "mixed")]
    got = {r["doc_id"]: r for r in rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and not got[100]["kept"] and not got[100]["base_failed"]
    assert got[201]["kept"] and got[0]["host_rate"] < got[202]["host_rate"] < got[200]["host_rate"] < 1


def test_languages_by_held_out_accuracy(spark, folder, table):
    rows = queries.QUERIES["op2_language_id"](spark, folder).collect()
    assert len(rows) == len(table)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    right = [r["lang_pred"] == table[r["doc_id"]]["lang"] for r in held if table[r["doc_id"]]["lang"] is not None]
    assert len(held) > 40 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_equal_the_definition():
    texts = ["The river", "", "123 ?!", "éa B", "日本 go"]
    units, lettered = langid.bundles([t.encode() for t in texts])
    assert lettered.tolist() == [True, False, False, True, True]
    fold = langid.folding()
    for text, unit in zip(texts, units, strict=True):
        letters = [" ", *(chr(fold[ord(c)]) for c in text), " "]
        line = [ord(c) for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " "]
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            if b != 32:
                total += np.roll(langid.letter_vector(a), 2).astype(int) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
        if np.linalg.norm(total):
            total /= np.linalg.norm(total)
        assert np.allclose(unit, total, atol=1e-5)


def test_languages_of_odd_rows(spark, docs, nothing, texts):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(texts)
    none = langid.predict(docs, {}).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (300, 301, 302))
    assert langid.prototypes(nothing) == {}


def test_mixing_meets_its_targets(spark, folder, table):
    rows = queries.QUERIES["op7_soft_mixing"](spark, folder).collect()
    assert len(rows) == len(table)
    tokens_ = np.array([r["n_tokens"] for r in rows], float)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens_.tolist() == [len(library.encode(table[r["doc_id"]]["text"] or "", add_special_tokens=False).ids) for r in rows]
    p, rate = np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    target = tokens_.sum() * np.array([mixing.WEIGHTS[d] for d in sorted(mixing.WEIGHTS)])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert (np.abs((rate * tokens_) @ p - target) < 1e-5 * target.max()).all()
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)


def test_rates_equal_least_squares_without_a_bound(spark):
    rng = np.random.default_rng(6)
    tokens_, p = rng.integers(1, 50, 200), rng.dirichlet([1, 1, 1], 200)
    rows = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens_, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    total = tokens_.sum()
    target = [0.38 * total, 0.33 * total, 0.29 * total]
    got = np.array([r["rate"] for r in mixing.fit_rates(rows, target).orderBy("doc_id").collect()])
    a = (p * tokens_[:, None]).T
    # The nearest rates to one, in the documents' tokens, that meet the targets.
    best = 1 + p @ np.linalg.solve(a @ p, np.array(target) - a.sum(axis=1))
    assert (best > 0).all() and np.abs(got - best).max() < 0.02


def test_rates_stay_nonnegative_where_a_domain_must_go(spark):
    rows = spark.createDataFrame([(k, 10, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(40)], "doc_id long, n_tokens long, posterior array<double>")
    got = mixing.fit_rates(rows, [400.0, 0.0]).collect()
    assert all(abs(r["rate"] - (2.0 if r["doc_id"] % 2 else 0.0)) < 0.01 for r in got)


def test_rates_meet_their_targets_where_posteriors_hardly_differ(spark):
    p = [[0.36, 0.32, 0.32], [0.32, 0.32, 0.36]]
    rows = spark.createDataFrame([(k, 100, p[k % 2]) for k in range(400)], "doc_id long, n_tokens long, posterior array<double>")
    got = mixing.fit_rates(rows, [13_520.0, 12_800.0, 13_680.0]).collect()
    totals = np.sum([np.array(r["posterior"]) * r["rate"] * r["n_tokens"] for r in got], axis=0)
    assert np.abs(totals - [13_520, 12_800, 13_680]).max() < 0.1


def test_rates_equal_least_squares_with_many_at_zero(spark):
    rng = np.random.default_rng(9)
    tokens_, p = rng.integers(1, 50, 300), rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(k, int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens_, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    target = np.array([0.9, 0.07, 0.03]) * tokens_.sum()
    rate = np.array([r["rate"] for r in mixing.fit_rates(rows, target.tolist()).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (rate == 0).sum() > 30
    assert np.abs((rate * tokens_) @ p - target).max() < 1e-4 * target.max()
    # Rates above zero are one plus a combination of the posteriors: no other rates with these totals are nearer to one.
    numbers, *_ = np.linalg.lstsq(p[rate > 0], rate[rate > 0] - 1, rcond=None)
    assert np.abs(np.maximum(0, 1 + p @ numbers) - rate).max() < 1e-6


def test_rates_that_cannot_meet_their_targets_come_as_near_as_they_can(spark):
    rows = spark.createDataFrame([(k, 10, [0.5, 0.5, 0.0]) for k in range(20)], "doc_id long, n_tokens long, posterior array<double>")
    numbers, miss = mixing.multipliers(rows, [150.0, 50.0, 30.0])
    assert np.allclose(miss * 150, [-50, 50, -30])


def test_rows_without_id_and_repeated_rows_toss_their_own_coins(spark):
    rows = [(None, "river garden window " * 5)] * 300 + [(7, "paper silver candle " * 5)] * 300
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    docs = support.documents(spark, rows + [(8, "seven yellow morning " * 5)] * 300)
    got = mixing.mix(docs, labels, {"clean": 0.7, "toxic": 0.3}).collect()
    for key in (None, 7, 8):
        some = [r for r in got if r["doc_id"] == key]
        assert len(some) == 300 and abs(sum(r["copies"] for r in some) - sum(r["rate"] for r in some)) < 60


def test_mixing_odd_rows(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(7, 1, 0), (100, 0, 0), (200, 1, 1), (None, 1, 0), (201, None, 1), (202, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).count() == len(texts)
    equal = mixing.mix(docs, labels.limit(0)).collect()
    assert len({round(r["rate"], 9) for r in equal}) == 1
    assert mixing.mix(nothing, labels).count() == 0


@pytest.mark.parametrize("name", ["op3_minhash", "op10_host_rules"])
def test_queries_equal_their_sql(spark, folder, name):
    assert oracle.compare(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) == []


@pytest.mark.parametrize("run", [
    lambda d: minhash.near_duplicates(d), lambda d: suffixes.repeated_bytes(d), lambda d: rules.host_rules(d), lambda d: langid.identify(d),
    lambda d: packing.pack_documents(d, "byte_bpe_50k.json"), lambda d: token_cache.count_tokens(d, new_path(d.sparkSession, "cache"), "piece_bpe_32k.model")])
def test_empty_tables_give_empty_results(nothing, run):
    assert run(nothing).count() == 0
