"""Chat roles, vectors, pages and the pipeline."""

import random
import sys
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import support  # noqa: E402
from emberscan.llm import chat, graph, links, packing, quantised, queries, store  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, chain string, block string, n_rows long"


def conversation(conv, n, rng):
    rows = []
    for k in range(n):
        role = "user" if k % 2 == 0 else "assistant"
        text = ("User: " if role == "user" and k % 6 == 0 else "") + support.prose(rng, 8 if role == "user" else 60)
        rows.append((conv, k, role, text, "x", "x", 1))
    return rows


def plain_viterbi(model, texts):
    steps = model.steps(texts, True)
    s = len(model.roles)
    score, back = steps[0][s], []
    for step in steps[1:]:
        options = score[:, None] + step[:s]
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    path = [int(score.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return [model.roles[k] for k in path[::-1]]


def test_blocks_of_blocks_decode_like_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    rows = conversation(1, 700, rng) + conversation(2, 3, rng) + conversation(3, 65, rng)
    turns = spark.createDataFrame(rows, TURNS)
    model = chat.fit(turns)
    assert model.roles == ["assistant", "user"]
    monkeypatch.setattr(chat, "BLOCK", 4)
    got = {(r["conv_id"], r["turn"]): r for r in chat.decode(turns, model).collect()}
    assert len(got) == len(rows)
    for conv in (1, 2, 3):
        own = [r for r in rows if r[0] == conv]
        want = plain_viterbi(model, [r[3] for r in own])
        assert [got[conv, r[1]]["role_pred"] for r in own] == want
        assert sum(a == r[2] for a, r in zip(want, own, strict=True)) > 0.9 * len(own)
    assert got[1, 0]["rendered"].startswith("<|user|>\n") and "User:" not in got[1, 0]["rendered"]


def test_markers_of_raw_transcripts():
    for text, kind in (("Human: hi", 1), ("**Assistant:** yes", 2), ("### System:\nbe kind", 3), ("<|user|> x", 1), ("[bot]: y", 2), ("no marker: here", 0), (None, 0)):
        assert chat.observe(text)[0] == kind, text
    assert chat.render("user", " Human:  hi there ") == "<|user|>\nhi there\n<|end|>"
    assert chat.render("user", None) == "<|user|>\n\n<|end|>"


def test_raw_transcripts_are_split_and_decoded(spark):
    raw = spark.createDataFrame([(1, "Human: what is it?\nAssistant: it is this\nand that\nHuman: thanks"), (2, None), (3, "")], "conv_id long, text string")
    turns = chat.split_transcripts(raw)
    assert [(r["turn"], r["text"]) for r in turns.orderBy("conv_id", "turn").collect() if r["conv_id"] == 1] == [
        (0, "Human: what is it?"), (1, "Assistant: it is this\nand that"), (2, "Human: thanks")]
    rng = random.Random(4)
    model = chat.fit(spark.createDataFrame([r for c in range(30) for r in conversation(c, 6, rng)], TURNS))
    assert [r["role_pred"] for r in chat.decode(turns, model).orderBy("turn").collect()] == ["user", "assistant", "user"]


def test_chats_of_odd_rows(spark):
    rows = [(1, 0, "user", "a", "", "", 0)] * 3 + [(1, 0, "user", "b", "", "", 0), (1, None, "user", "c", "", "", 0), (None, 5, None, None, "", "", 0), (None, None, None, "d", "", "", 0),
                                                    (1, -70, "user", None, "", "", 0), (2, 10**12, "assistant", "x" * 10000, "", "", 0)]
    turns = spark.createDataFrame(rows, TURNS)
    got = chat.format_chats(turns).collect()
    assert len(got) == 7 and sum(r["n_rows"] for r in got) == len(rows)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_roles_are_learned_from_whole_texts_and_sparse_turns(spark):
    assert chat.observe("what? " + "x" * 500)[3] == chat.observe("x" * 500 + "¿")[3] == 1
    rows = [(c, 7 + 100 * k, ("user", "assistant")[k % 2], f"turn {k}", "", "", 1) for c in range(20) for k in range(70)]
    model = chat.fit(spark.createDataFrame(rows, TURNS))
    # From assistant, from user, and the start: 34 and 35 moves in each of 20 conversations.
    counts = np.array([[0, 34 * 20], [35 * 20, 0], [0, 20]]) + 0.5
    assert np.allclose(model.moves, np.log(counts / counts.sum(axis=1, keepdims=True)))


def test_chat_roles_by_held_out_accuracy(spark, folder):
    got = queries.QUERIES["op1_chat_roles"](spark, folder)
    truth = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "text", "role").distinct()
    rows = got.where("held_out").join(truth, ["conv_id", "turn", "text"]).select(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).first()
    assert rows[0] > 0.9
    assert got.agg(F.sum("n_rows")).first()[0] == spark.read.parquet(f"{folder}/conversations.parquet").count()


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    for k in range(150):
        rows.append((1000 + k, (base[0] + rng.normal(size=16) * 0.12 * (1 + k % 3)).tolist(), 0))
    for k in range(60):
        rows.append((2000 + k, (base[k] * 3 + rng.normal(size=16) * 0.3).tolist(), k % 3))
    rows += [(3000, base[5].tolist(), 2), (3001, base[5].tolist(), 2), (3001, base[5].tolist(), 2), (3002, base[5].tolist(), None), (3003, None, 1), (3004, [0.0] * 16, 1),
             (3005, [float("nan")] * 16, 1), (3006, [float("inf")] + [0.0] * 15, 1), (3007, [None] * 16, 1), (3008, [1e300] * 16, 1), (3009, [1e-300] * 16, 1), (3010, [1.0, 2.0], 1), (3011, [2.0, 4.0], 1),
             (3012, [], 1), (None, base[5].tolist(), 2)]
    return rows


def exact_links(rows):
    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        x = np.array(v, float)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v) if i is not None and lab is not None else None for i, v, lab in rows]
    n, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93:
                n[a] += 1
                n[b] += 1
                pairs.append((rows[a][0], rows[b][0]))
    return n, support.components({r[0] for r in rows if r[0] is not None}, pairs)


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(quantised, "BLOCK", block)
    monkeypatch.setattr(quantised, "PER_LIST", 40)
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, rep string, unit string")
    got = quantised.near_duplicates(frame).collect()
    n, comps = exact_links(rows)
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in got) == sorted((r[0] or -1 if r[0] is not None else -1, k) for r, k in zip(rows, n, strict=True))
    assert all(r["component_id"] == comps.get(r["vec_id"]) and r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert quantised.near_duplicates(frame.limit(0)).count() == 0


def test_recall_of_borderline_pairs():
    """Pairs at a cosine of just 0.93, the hardest there are, at the shared tables' width."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * side
    model = quantised.Quantiser(64, x[:5000], 64)
    reach = np.sqrt(2 - 2 * 0.93)
    own_x, probe_x = model.probes(x, reach)
    own_y, probe_y = model.probes(y, reach)
    k = np.arange(len(x))
    found = np.where(own_x <= own_y, probe_x[k, own_y] | (own_x == own_y), probe_y[k, own_x])
    assert found.mean() > 0.99
    left = x - model.centres[own_y]
    codes, error = model.encode(y - model.centres[own_y])
    near = np.array([model.distances(left[i:i + 1], codes[i:i + 1])[0, 0] for i in range(500)])
    assert (near <= reach + error[:500] + 1e-9).all()


@pytest.mark.parametrize(("size", "rank"), [(64, 4), (256, 8), (768, 20)])
def test_no_pair_is_lost_where_vectors_have_few_dimensions(size, rank):
    rng = np.random.default_rng(12)
    basis = np.linalg.qr(rng.normal(size=(size, rank)))[0]
    x = rng.normal(size=(3000, rank))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301 ** 2) * side
    x, y = x @ basis.T, y @ basis.T
    model = quantised.Quantiser(size, x, 64)
    reach = np.sqrt(2 - 2 * 0.93)
    own_x, probe_x = model.probes(x, reach)
    own_y, probe_y = model.probes(y, reach)
    k = np.arange(len(x))
    assert np.where(own_x <= own_y, probe_x[k, own_y], probe_y[k, own_x]).all()


def test_vectors_of_the_shared_table(spark, folder):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    n, comps = exact_links(rows)
    got = {r["vec_id"]: r for r in queries.QUERIES["op4_product_quantisation"](spark, folder).collect()}
    assert all((got[r[0]]["n_links"], got[r[0]]["component_id"]) == (k, comps[r[0]]) for r, k in zip(rows, n, strict=True))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (900, 901)]
    pairs += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    got = {r["v"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == support.components({x for p in real for x in p}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = "page_id long, url string, html string, host string, rule string, trust string"
URLS = {
    "http://www.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "https://a.example.com/de": ("a.example.com", "/de", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://x.net/fr/1#a": ("x.net", "/fr/1", "net/fr/", "block"),
    "http://x.net/frx": ("x.net", "/frx", None, None),
    "http://com": ("com", "", None, None),
    "http://x.com?p=/en/": ("x.com", "", None, None),
    "HTTP://É.NET/es/": ("É.net", "/es/", "net/es/", "block"),
    "nothing": ("", "", None, None),
    "://": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_addresses_and_rules(spark):
    rows = [(k, u, None, "x", "y", "z") for k, u in enumerate(URLS)] * 2
    got = links.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    assert links.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    def page(k, host, *to):
        return (k, f"http://{host}/p", "".join(f'<a HREF = "https://u@{t.upper()}:80/z">' for t in to) + '<a href="/own">', "", "", "")

    rows = [page(1, "good.com", "friend.org"), page(2, "friend.org", "second.org"), page(3, "second.org"), (4, "http://bad.net/fr/", None, "", "", ""),
            page(5, "fan.org", "bad.net"), page(6, "fanfan.org", "fan.org"), page(7, "alone.org")]
    frame = spark.createDataFrame(rows, PAGES)
    got = {r["page_id"]: r for r in links.judge(frame).collect()}
    assert [got[k]["verdict"] for k in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    assert got[2]["trust"] > got[3]["trust"] > 0 == got[7]["trust"] and got[5]["distrust"] > got[6]["distrust"] > 0

    # The same walk with a matrix.
    edges = {(r["src"], r["dst"]): r["weight"] for r in links.host_edges(frame.withColumn("host", links.host_and_path(F.col("url"))[0])).collect()}
    names = sorted({h for e in edges for h in e} | {"good.com", "bad.net", "alone.org"})
    m = np.zeros((len(names), len(names)))
    for (a, b), w in edges.items():
        m[names.index(a), names.index(b)] = w
    start = np.array([float(x == "good.com") for x in names])
    score, step = start, m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    for _ in range(300):
        score = 0.15 * start + 0.85 * score @ step
    for r in got.values():
        if r["host"] in names:
            assert abs(r["trust"] - score[names.index(r["host"])]) < 1e-9


@pytest.mark.parametrize("ring", [False, True])
def test_scores_of_long_chains_equal_a_dense_solve(spark, ring):
    n = 40
    edges = [(f"h{k:02d}", f"h{k + 1:02d}", 1) for k in range(n - 1)] + ([(f"h{n - 1}", "h00", 3), (f"h{n - 1}", "h07", 1)] if ring else [])
    seeds = spark.createDataFrame([("h00", 1.0, 0.0), (f"h{n - 1}", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in links.propagate(spark.createDataFrame(edges, "src string, dst string, weight long"), seeds).collect()}
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[int(a[1:]), int(b[1:])] = w
    for name, walk, seed in (("trust", m, 0), ("distrust", m.T, n - 1)):
        step = walk / np.maximum(walk.sum(axis=1, keepdims=True), 1)
        want = 0.15 * np.linalg.solve(np.eye(n) - 0.85 * step.T, np.eye(n)[seed])
        assert max(abs(got[f"h{k:02d}"][name] - want[k]) for k in range(n)) < 1e-9


def test_operators_in_two_threads_keep_their_own_tables(spark):
    ready, done, seen = threading.Event(), threading.Event(), []

    def slow():
        with store.workspace(spark) as keep:
            mine = store.written(spark.range(5), "mine")
            ready.set()
            done.wait(60)
            seen.append(keep(mine).count())

    other = threading.Thread(target=slow)
    other.start()
    ready.wait(60)
    with store.workspace(spark):
        gone = store.written(spark.range(3), "gone")
    done.set()
    other.join()
    assert seen == [5]
    with pytest.raises(Exception):
        gone.count()
    with pytest.raises(KeyError):
        with store.workspace(spark) as keep:
            lost = keep(spark.range(3))
            raise KeyError
    with pytest.raises(Exception):
        lost.count()


def test_pages_run_without_python(spark, folder):
    plan = queries.QUERIES["op6_link_graph"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, folder):
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        kept.append(out.count())
        if name != "sequences":
            assert out.columns == before.columns and out.count() > 0.5 * docs.count()
        docs = out
    assert kept[0] <= before.count() and kept[1] < kept[0]
    loads = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert loads[0] <= packing.CAPACITY and loads[1] <= 1.02 * loads[2] / packing.CAPACITY + 2


def test_pipeline_stages_on_odd_rows(spark, folder):
    texts = support.awkward(random.Random(5))
    docs = support.documents(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        if name != "sequences":
            assert out.columns == docs.columns
    one = stages["near_duplicates"](spark, docs, folder)
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    # A NULL id is no reason to go: the empty text without an id stays, the copy of a text that has one goes.
    assert len(ids) == len(set(ids)) and 7 in ids and 40 not in ids and None in ids
    assert [r["text"] for r in one.collect() if r["doc_id"] is None] == [None]
    for name in ("language", "near_duplicates", "repeated_passages", "target_weights"):
        again = stages[name](spark, docs, folder).select("_key", "_kept", "_copies", "_copy", "left", "number").distinct().collect()
        assert [tuple(r) for r in again] == [("x",) * 6]
    cut = {r["doc_id"]: r for r in stages["repeated_passages"](spark, docs, folder).collect()}
    assert 40 not in cut and cut[7]["text"] == dict(texts)[7] and cut[201]["n_chars"] == len(cut[201]["text"])


def test_different_texts_of_one_id_are_different_documents(spark, folder):
    rng = random.Random(11)
    one, two, three = (support.prose(rng, 60) for _ in range(3))
    texts = [(1, one), (5, one), (5, two), (5, two), (6, two), (-9, three), (8, three + " end")]
    docs = support.documents(spark, texts)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, one), (5, two), (-9, three)])
