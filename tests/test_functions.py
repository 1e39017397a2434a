import random

import pytest
from pyspark.sql import functions as F

from pathmine.functions import nodes as FN
from pathmine.functions import text as FT
from tests.brute import norm_token

SAMPLES = ["getHTTPResponse2_foo bar", "ABCd", "aBcD", "42", "  x  ", "", "a😀b", "it's,\"q\"", "<=", "Customer#000000001", "İstanbul"]


#: Splits written down by hand, and 32-bit string hashes as java.lang.String gives them.
SPLITS = {"getHTTPResponse2_foo bar": ["get", "http", "response", "foo", "bar"], "ABCd": ["ab", "cd"], "aBcD": ["a", "bc", "d"], "42": [], "  x  ": ["x"],
          "": [], "it's,\"q\"": ["itsq"], "<=": ["<="], "Customer#000000001": ["customer"]}
HASHES = {"": 0, "a": 97, "hello": 99162322, "Hello World": -862545276, "polygenelubricants": -2147483648}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(s,) for s in SAMPLES], "s string")


def test_normalize_token(samples):
    got = {r.s: r.t for r in samples.select("s", FT.normalize_token("s").alias("t")).collect()}
    assert got == {s: norm_token(s) for s in SAMPLES}


def test_subtokens_and_label(spark):
    rows = spark.createDataFrame([(k,) for k in SPLITS], "s string").select(
        "s", F.array_join(FT.split_subtokens("s"), " ").alias("st"), FT.make_label("s").alias("lab")).collect()
    for r in rows:
        assert (r.st, r.lab) == (" ".join(SPLITS[r.s]), "|".join(SPLITS[r.s]))


def test_java_hash(spark):
    got = {r.s: r.h for r in spark.createDataFrame([(k,) for k in HASHES], "s string").select("s", FT.java_hash("s").alias("h")).collect()}
    assert got == HASHES


def test_slots_roundtrip(spark):
    df = spark.createDataFrame([("a", "P^Q", "b")], "s string, p string, e string")
    enc = df.select(FT.encode_context("s", FT.java_hash("p"), "e").alias("slot"))
    d = enc.select(FT.decode_context("slot").alias("d")).collect()[0].d
    assert (d.arity, d.start_token, d.path, d.end_token) == (3, "a", "79875", "b")
    padded = enc.select(FT.pad_slots(F.array("slot"), 3).alias("a")).collect()[0].a
    assert padded == ["a,79875,b", "", ""]
    assert enc.select(FT.pad_slots(F.array("slot"), 0).alias("a")).collect()[0].a == []


def test_file_index(spark):
    df = spark.createDataFrame([("file:12.c",), ("file:x.c",)], "l string")
    assert [r.i for r in df.select(FT.file_index("l").alias("i")).collect()] == [12, None]


def test_node_label_and_normalize(spark):
    df = spark.createDataFrame(
        [('"(METHOD,fooBar,int)"', "fooBar"), ('"(fooBar,fooBar)"', "fooBar"), ('"(LITERAL)"', "f"), ('"((X), A b1 )"', "f")],
        "raw string, name string",
    )
    p = df.select("name", FN.parse_node_label("raw").alias("f"))
    p = p.select("name", F.get("f", 0).alias("type"), F.get("f", 1).alias("token"))
    t, k = FN.normalize_node("type", "token", "name")
    got = [(r.t, r.k) for r in p.select(t.alias("t"), k.alias("k")).collect()]
    assert got == [("(METHOD)", "self"), ("(<SELF>)", "self"), ("LITERAL", None), ("(X)", "ab")]


def test_java_hash_of_a_batch(spark):
    """Characters of one to four bytes, empty and null values and long texts side by side, hashed without a lambda."""
    rng = random.Random(8)
    texts = [None, "", "\0", "é", "a😀b", "(A)^(B)_(C)" * 300] + ["".join(rng.choice("aZ0^_|é€😀") for _ in range(rng.randint(0, 40))) for _ in range(200)]

    def want(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) % 2**32
        return h - 2**32 if h >= 2**31 else h

    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1).select("i", FT.java_hash("s").alias("h"))
    assert df.schema["h"].dataType.simpleString() == "bigint"
    assert {r.i: r.h for r in df.collect()} == {i: None if s is None else want(s) for i, s in enumerate(texts)}
    assert "aggregate(" not in df._jdf.queryExecution().executedPlan().toString()
