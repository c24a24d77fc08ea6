"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import types as T

from emberscan.llm import queries, repair

ROWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("pos", "conv", "fault", "edit", "what"))])

VISIBLE = re.compile(r"[^ \t-\r]")


def cheapest(rows):
    """Least (cost, edits) over all ways, by states of the form, from the last row to the first."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    keep = {"": "su", "s": "u", "u": "a", "a": "u"}
    n = len(rows)
    best = {(n, ""): (0, ""), (n, "a"): (0, ""), (n, "u"): (5, "I"), (n, "s"): (10, "II")}
    for k in range(n - 1, -1, -1):
        initial, fault = rows[k]
        plain = {}
        for state in ("", "s", "u", "a"):
            options = [(2 + best[k + 1, state][0], "D" + best[k + 1, state][1])]
            if fault not in (1, 2):
                price = 5 if fault == 3 else 0
                if initial and initial in keep[state]:
                    cost, rest = best[k + 1, initial]
                    options.append((price + cost, "K" + rest))
                cost, rest = best[k + 1, turn[state]]
                options.append((price + 1 + cost, "R" + rest))
            plain[state] = min(options)
        for state in plain:
            # Made-up turns before the row: no more than three can ever pay.
            options, at = [], state
            for n_made in range(4):
                options.append((5 * n_made + plain[at][0], "I" * n_made + plain[at][1]))
                at = turn[at]
            best[k, state] = min(options)
    return best[0, ""]


def plain_report(rows, ids, damaged=False):
    """What the query has to return, from rows (conv_id, turn, role, text)."""
    by_conv = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        if damaged:
            what = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if what == 0:
                continue
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            role = "user" if what == 4 else role
            by_conv[conv] += [(turn, role, text)] * (2 if what == 3 else 1)
        else:
            by_conv[conv].append((turn, role, text))
    out = {}
    for conv, some in by_conv.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in some:
            last = VISIBLE.findall(text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in some if t is not None]
        initials = [r[:1] for _, r, _ in some]
        cost, audit = cheapest(list(zip(initials, faults)))
        kept, state, at = [], "", 0
        for edit in audit:
            if edit == "I":
                state = "a" if state == "u" else "u"
                kept.append(("assistant" if state == "a" else "user", ""))
                continue
            _, role, text = some[at]
            at += 1
            if edit == "R":
                state = "a" if state == "u" else "u"
                kept.append(("assistant" if state == "a" else "user", text))
            elif edit == "K":
                state = role[:1]
                kept.append((role, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], ROWS)


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def made_up(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "", " \t", None, "cut off", "Why? ", "a long one" * 3 + ".", "ünd. "]
    weights = [8, 8, 1, 1, 1, 1]
    return [(conv, rng.choice([None, k, k, k, k, k + 3]), rng.choices(roles, weights)[0], f"{rng.choice(texts) or ''}" if rng.random() < 0.5 else f"text {k}.")
            for k in range(n)]


def test_search_equals_the_dynamic_programme():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 12))]
        [(_, _, cost, audit)] = repair.search_block(rows, True, True)
        assert (cost, audit) == cheapest(rows), rows


def test_chained_blocks_equal_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(2, 24))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(3))})
        chain = repair.Chain()
        for a, b in zip(cuts, cuts[1:]):
            begins, ends, costs, audits = zip(*repair.search_block(rows[a:b], a == 0, b == len(rows)))
            chain.add({"begins": begins, "ends": ends, "costs": costs, "audits": audits, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0),
                       "first_initial": "u", "last_initial": "a", "first_turn": None, "last_turn": None, "turns": 0})
        got = chain.verdict((0, False))
        assert (got["cost"], got["audit"]) == cheapest(rows), rows


@pytest.mark.parametrize("damaged", [False, True])
def test_report_equals_the_plain_one(spark, damaged):
    rng = random.Random(11)
    rows = [r for conv in range(120) for r in made_up(rng, conv, rng.randrange(1, 9))]
    # One conversation holds a third of all rows and spans many blocks; others have no id, no turns, one row.
    rows += made_up(rng, 500, 300) + made_up(rng, None, 7) + [(600, None, "user", "Hi."), (600, None, "assistant", "Yes.")] + [(601, 5, None, None)]
    rows += [(700, 1, "user", "Same."), (700, 1, "user", "Same."), (701, -5, "user", "x" * 3_000_000 + "."), (701, 9, "assistant", "y.")]
    # Equal turns with equal roles have no stated order of texts, so none of those differ here; damage may make roles equal.
    seen, kept = {}, []
    for conv, turn, role, text in rows:
        if seen.setdefault((conv, turn, None if damaged else role or " "), (role, text)) == (role, text):
            kept.append((conv, turn, role, text))
    rng.shuffle(kept)
    df = table(spark, kept)
    source = repair.damage(df) if damaged else df
    got = report(repair.repair_report(source, df))
    want = plain_report(kept, {r[0] for r in kept}, damaged)
    assert got == want


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", " "), (1, 3, "assistant", "Bye"), (2, 0, "user", "Well?")]
    done = repair.repair(table(spark, rows))
    turns = [(r.conv, r.seat, r.edit, r.role, r.text) for r in done.turns.orderBy("conv", "seat").collect()]
    audits = {r.conv: r.audit for r in done.verdicts.collect()}
    assert audits[1] == cheapest([("a", 0), ("u", 0), ("u", 1), ("a", 3)])[1]
    assert audits[2] == "D" and not [t for t in turns if t[0] == 2]
    assert [t[1] for t in turns if t[0] == 1] == list(range(len([t for t in turns if t[0] == 1])))


def test_empty_table(spark):
    assert report(repair.repair_report(table(spark, []), table(spark, []))) == {}
    only_ids = table(spark, [(3, 0, "user", "Hi.")])
    assert report(repair.repair_report(table(spark, []), only_ids)) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query_over_the_shared_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(queries.QUERIES["op12_repair"](spark, folder)) == plain_report(rows, {r[0] for r in rows}, damaged=True)
