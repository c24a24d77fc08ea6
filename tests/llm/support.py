"""Fixtures and plain re-statements of what the operators must return."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import types as T

WORDS = "the of and reading table river garden window yellow seven mountain paper silver candle morning question answer".split()
WORD = re.compile(r"[^ \t-\r]+")

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *(T.StructField(c, T.StringType()) for c in ("rep", "host", "token", "kept", "rate", "row", "score", "text_id", "_text", "deal", "_key", "_kept", "_copies", "_copy", "coin", "number", "copies", "left"))])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, and every odd case."""
    base, passage = prose(rng, 90), prose(rng, 30)
    texts: list[tuple[int | None, str | None]] = [(k, base) for k in (40, 7, 900)]
    for k in range(12):
        words = base.split(" ")
        for at in rng.sample(range(len(words)), 1 + k // 4):
            words[at] = f"changed{k}"
        texts.append((100 + k, " ".join(words)))
    texts += [(200 + k, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for k in range(10)]
    texts += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "One"), (305, "one two three"), (306, "ONE  two\nthree"), (None, base), (None, None)]
    texts += [(400, "é" * 80), (401, "ß日" + "é" * 80), (402, "a" * 300), (403, "a" * 120 + "b"), (7, base), (404, "line\nline\nline\n" + prose(rng, 12))]
    texts.append((500, prose(rng, 9000)))
    return texts


def documents(spark, texts):
    rows = [(i, t, random.Random(k).choice(["en", "de", None]), random.Random(k).choice(["a", "b", None]), None, *["x"] * 18) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def components(ids, links) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def repeated_bytes(texts, length: int) -> dict:
    """`(doc_id, text)` to removed bytes, spans and digest of the rest."""
    raw = [(i, (t or "").encode()) for i, t in texts]
    first: dict[bytes, int] = {}
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p:p + length]
                first[w] = min(i, first.get(w, i))
    out = {}
    for (i, b), (_, t) in zip(raw, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p:p + length]] < i:
                gone[p:p + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def rule_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
