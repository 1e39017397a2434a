"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pathmine.llm import periodic as P


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:len(w) - q])


def runs_by_definition(w):
    """Every maximal stretch of every distance, kept if that distance is its smallest period."""
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(12, 2 * q) and smallest_period(w[i:e + q]) == q:
                out.add((i, e + q - i, q))
            i = e
    return sorted(out)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for b, w, rows in ((1, 4, 3), (2, 7, 5), (8, 23, 4), (64, 191, 2)):
        x, y = rng.integers(0, P.PRIME, (rows, b)).astype(np.uint64), rng.integers(0, P.PRIME, (rows, w)).astype(np.uint64)
        got = P.squared_differences(x, y)
        for r in range(rows):
            want = [sum((int(p) - int(q)) ** 2 for p, q in zip(x[r], y[r, d:d + b], strict=True)) % P.PRIME for d in range(w - b + 1)]
            assert got[r].tolist() == want
    z = rng.integers(0, P.PRIME, (3, 256)).astype(np.uint64)
    assert np.array_equal(P.intt(P.ntt(z)), z)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


CASES = [[], [1] * 11, [1] * 12, [1] * 300, [1, 2] * 6, [1, 2, 3, 4, 5, 6, 7] * 2, fibonacci(400), [0, 1, 1, 0] * 40 + [2] + [0, 1, 1, 0] * 40,
         list(range(100)) * 3, list(range(60)) * 5 + list(range(31)) * 7, ([1] * 20 + [2]) * 9, [1] * 50 + [2] + [1] * 50 + [2] + [1] * 50]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_runs(case):
    assert P.find_runs(np.array(CASES[case], np.int64)) == runs_by_definition(CASES[case])


def test_random_sequences():
    rnd = random.Random(8)
    for trial in range(150):
        w = []
        while len(w) < rnd.randrange(5, 260):
            piece = [rnd.randrange(rnd.choice((2, 3, 30))) for _ in range(rnd.randrange(1, 40))]
            w += (piece * rnd.randrange(1, 6))[:rnd.randrange(1, 150)]
        assert P.find_runs(np.array(w, np.int64), places=rnd.choice((1, 500, 1 << 20))) == runs_by_definition(w), trial


def digest(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_documents(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(f"w{rnd.randrange(60)}" for _ in range(n))
    texts = [None, "", " \n\t", "a " * 40, say(3), "é ü " * 20, "x y " * 13, (say(17) + "\n") * 6, say(900), " ".join(["tick tock"] * 30) + " " + say(9)]
    rows = [(i, texts[i % len(texts)] if i % 3 else say(rnd.randrange(250)), "s", 3) for i in range(160)] + [(None, "b " * 20, "s", 1), (7, "c d " * 20, "s", 1)]
    docs = spark.createDataFrame(rows + rows[-2:], "doc_id long, text string, start string, length int").repartition(3)
    got = P.periodic_runs(docs, plant=True, details=True).collect()
    want = [digest(r["doc_id"], r["text"]) for r in docs.collect()]
    key = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[k] for k in key)) for r in got)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(160))
    for r in got:
        assert len(r["runs"]) == r["n_runs"] and hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    rnd = random.Random(3)
    part = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(part * 2 + part[:500])), (2, "z " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.periodic_runs(docs).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"]) == (0, 120_500, 60_000)
    assert (got[2]["n_runs"], got[2]["length"], got[2]["period"]) == (1, 200_000, 1)
