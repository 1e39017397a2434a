"""Merkle fingerprints against a plain walk over the sorted rows, and their tree against the texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathmine.llm import merkle

random.seed(3)
say = lambda n: " ".join(f"w{random.randrange(400)}" for _ in range(n))


def test_equal_roots_are_equal_texts():
    texts = ["", " ", "a", "a ", "a\n", "\na", "a b", "b a", "a\nb", "b\na", "a\n\nb", say(300), say(300) + " ", "x" * 5000, "é　ü " * 40]
    prints = [merkle.fingerprint(t) for t in texts]
    assert len(set(prints)) == len(texts)
    assert merkle.fingerprint(None) == merkle.fingerprint("")


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n#", max_size=120), st.text("ab \n#", max_size=120))
def test_tree_covers_the_text(a, b):
    root, sections = merkle.tree(a)
    data = a.encode()
    leaves = [leaf for _, ps in sections for _, ls in ps for leaf in ls]
    assert b"".join(data[s:e] for _, s, e in leaves) == data
    same = merkle.parsed(merkle.fingerprint(a))
    assert same[0] == root.hex() and sum(len(ls) for _, ps in same[1] for _, ls in ps) == len(leaves)
    x, y = merkle.parsed(merkle.fingerprint(a)), merkle.parsed(merkle.fingerprint(b))
    assert (merkle.likeness(x, y) == 1.0) == (a == b)
    assert 0 <= merkle.likeness(x, y) <= 1 and merkle.likeness(x, y) == merkle.likeness(y, x)
    (removed, inserted), z = merkle.changed(a, b), b.encode()
    for s, e in removed[:1] or [(0, 0)]:
        for s2, e2 in inserted[:1] or [(0, 0)]:
            if removed and inserted:  # what is left of both sides is the same
                assert data[:s] + data[e:] == z[:s2] + z[e2:]


def test_an_edit_is_located():
    lines = [say(30) for _ in range(40)]
    before = "\n".join(lines)
    lines[17] = lines[17].replace(" ", " extra ", 1)
    after = "\n".join(lines)
    (removed,), (inserted,) = merkle.changed(before, after)
    assert after.encode()[slice(*inserted)].find(b"extra") >= 0
    assert inserted[1] - inserted[0] < 250 and removed[1] - removed[0] < 250
    assert merkle.likeness(*(merkle.parsed(merkle.fingerprint(t)) for t in (before, after))) > 0.95


@pytest.mark.parametrize("n", [0, 1, 60])
def test_against_a_plain_walk(spark, n):
    long = say(20_000)
    texts = [None, "", "x", "Hello world", say(3), say(200), long, "é" * 99, say(50) + "\n\n# head\n" + say(50)]
    rows = [(i * 3, texts[i % len(texts)], f"s{i}", 0.5) for i in range(n)]
    rows += [(None, "no id", "s", 0.1), (9, say(40), "s", 0.1), (9, say(40), "s", 0.1)] if n > 1 else []
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, fingerprint string, near_next double").repartition(7)
    got = [r.asDict() for r in merkle.edited_fingerprints(docs).collect()]
    assert len(got) == docs.count()
    from pyspark.sql import functions as F

    order = [(r["doc_id"], r["text"] or "") for r in docs.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()]
    want = []
    for i, (doc, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        after = text[:len(text) - half] + other[:half]
        f = [merkle.parsed(merkle.fingerprint(t)) for t in (text, after, other)]
        want.append((doc, len(text), hashlib.sha256(after.encode()).hexdigest(), merkle.fingerprint(text), merkle.fingerprint(after),
                     merkle.likeness(f[0], f[1]), merkle.likeness(f[0], f[2])))
    key = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[k] for k in key)) for r in got)
    for r in got:
        assert (r["edit_start"] is None) == (r["fingerprint"] == r["edited_fingerprint"])
    prints = merkle.fingerprint_documents(docs).collect()
    assert sorted(str(r["fingerprint"]) for r in prints) == sorted(r["fingerprint"] for r in got)


def test_locate_edits_as_rows(spark):
    rows = merkle.locate_edits(spark.createDataFrame([("a b c", "a b c", 1), ("one two", "one three", 2), (None, "new", 3)], "before string, after string, k int")).orderBy("k").collect()
    assert [len(r["_removed"]) for r in rows] == [0, 1, 0] and [len(r["_inserted"]) for r in rows] == [0, 1, 1]
