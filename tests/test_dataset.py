from pyspark.sql import functions as F

from pathmine.operators import dataset as D
from pathmine.operators import split as SP
from pathmine.operators.numbering import global_position, number_within


def _ctx(spark, n_graphs=6, per=7):
    rows = []
    for g in range(n_graphs):
        for k in ("ast", "cfg"):
            for s in range(per if k == "ast" else 2):
                rows.append((str(g), f"lab{g % 3}", k, s, f"t{s}", f"P{s}^Q", f"u{s}"))
    return spark.createDataFrame(rows, "graph_id string, label string, kind string, seq long, start_token string, path string, end_token string")


def test_sample_is_subset_of_size_min_n_k(spark):
    ctx = _ctx(spark)
    s = D.sample_per_kind(ctx, 3, "9")
    counts = {(r.graph_id, r.kind): r.c for r in s.groupBy("graph_id", "kind").agg(F.count("*").alias("c")).collect()}
    assert all(v == (3 if k[1] == "ast" else 2) for k, v in counts.items())
    assert s.join(ctx, list(ctx.columns), "left_anti").count() == 0


def test_global_position_and_number_within(spark):
    df = spark.range(0, 500).withColumn("g", (F.col("id") % 7).cast("string"))
    pos = global_position(df, ["id"], "pos")
    assert [r.pos for r in pos.orderBy("id").collect()] == list(range(500))
    a = number_within(df, ["g"], ["id"], "seq", bounded=True)
    b = number_within(df, ["g"], ["id"], "seq", bounded=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_split_is_exact_and_disjoint(spark):
    rows = spark.range(0, 200).select(F.col("id").cast("string").alias("graph_id"))
    sp = SP.split_dataset(SP.shuffle_rows(rows, "1"))
    c = {r.split: r.n for r in sp.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert c == {"train": 178, "val": 7, "test": 15}
    assert sp.select("graph_id").distinct().count() == 200


def test_render_parse_roundtrip(spark, tmp_path):
    ctx = _ctx(spark, 3, 4)
    numbering = global_position(ctx.select("graph_id").distinct(), ["graph_id"], "rec")
    recs = D.render_records(ctx, numbering)
    from pathmine.sources.records import read_records, write_records

    out = str(tmp_path / "recs")
    write_records(recs, out)
    back = D.repair_contexts(D.parse_records(read_records(spark, out)))
    got = sorted((r.file, r.kind, r.start_token, r.path, r.end_token) for r in back.collect())
    want = sorted((f"{r.graph_id}.c", r.kind, r.start_token, r.path, r.end_token) for r in ctx.collect())
    assert got == want


def test_select_kinds_rejects_empty_first_slot(spark):
    rows = spark.createDataFrame(
        [("1", "a", ["x,1,y"], [""], [], ["p,2,q"]), ("2", "b", ["x,1,y"], ["c,3,d"], [], ["p,2,q"])],
        "graph_id string, label string, ast array<string>, cfg array<string>, cdg array<string>, ddg array<string>",
    )
    kept = D.select_kinds(rows, ("ast", "cfg", "ddg")).collect()
    assert [(r.graph_id, r.line) for r in kept] == [("2", "b x,1,y c,3,d p,2,q")]


def test_records_of_two_datasets_do_not_mix(spark):
    one = "#0\nlabel:a\nfile:1.c\npath: ast\nx\tp^q\ty\nhead\tp^\n\\nq\ttail\npath: cfg\nm\tn\to\n"
    two = "#0\r\nlabel:b\r\nfile:2.c\r\npath: ddg\r\nu\tv\tw\r\nlone\tr^\r\n"
    recs = spark.createDataFrame([(one,), (two,)], "record string")
    got = {(r.label, r.file, r.kind, r.start_token, r.path, r.end_token) for r in D.repair_contexts(D.parse_records(recs)).collect()}
    assert {g for g in got if g[0] == "a"} == {
        ("a", "1.c", "ast", "x", "p^q", "y"), ("a", "1.c", "ast", "head", "p^q", "tail"), ("a", "1.c", "cfg", "m", "n", "o")}
    assert {g[:4] for g in got if g[0] == "b"} == {("b", "2.c", "ddg", "u"), ("b", "2.c", "ddg", "lone")}
    assert not any(g[5] for g in got if g[3] == "lone")  # no partner in its own record
    plan = D.repair_contexts(D.parse_records(recs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_crlf_records_are_separate(spark, tmp_path):
    from pathmine.sources.records import read_records

    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        text = "".join(end.join([f"#{i}", f"label:l{i}", f"file:{i}.c", "path: ast", "a\tb\tc", "", ""]) for i in range(2))
        (tmp_path / name).write_bytes(text.encode())
        back = D.parse_records(read_records(spark, str(tmp_path / name))).collect()
        assert sorted((r.rec_id, r.label, r.line) for r in back) == [(0, "l0", "a\tb\tc"), (1, "l1", "a\tb\tc")], name


def test_cumulative_vocab_spreads_without_a_product(spark):
    from pathmine.operators.vocab import cumulative_vocab

    v = spark.createDataFrame([("a", "token", "x", 2), ("c", "token", "x", 3), ("b", "token", "y", 1), ("d", "path", "z", 4)],
                              "dataset string, kind string, term string, freq long").withColumn("dataset_ord", F.col("dataset"))
    got = cumulative_vocab(v)
    assert {(r.dataset, r.term): r.freq for r in got.collect()} == {
        ("a", "x"): 2, ("b", "x"): 2, ("c", "x"): 5, ("d", "x"): 5, ("b", "y"): 1, ("c", "y"): 1, ("d", "y"): 1, ("d", "z"): 4}
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_shuffle_sorts_places_not_rows(spark):
    """The range sort sees the row numbers alone; rows with the same key keep one place each."""
    rows = spark.createDataFrame([(str(i % 7), "x" * 50, i) for i in range(20)], "graph_id string, body string, i long")
    out = SP.shuffle_rows(rows)
    assert sorted(r.pos for r in out.collect()) == list(range(20)) and sorted(r.i for r in out.collect()) == list(range(20))
    assert out.columns == ["graph_id", "body", "i", "pos"]
    plan = out._jdf.queryExecution().analyzed().toString()
    # two written tables: the rows, and their places without the body
    scans = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert len(scans) >= 2 and sum("body" in line for line in scans) == 1
    both = SP.split_by_dataset(rows.withColumn("dataset", F.col("graph_id")), "dataset")
    assert set(both.columns) == {"graph_id", "body", "i", "dataset", "pos", "split"} and both.count() == 20


def test_shuffle_writes_keys_not_rows(spark):
    """The rows are not written; rows of one key, and rows without any, keep one place each in the order of their keys."""
    import hashlib

    keys = [None if i % 6 == 5 else str(i % 7) for i in range(40)]
    rows = spark.createDataFrame([(k, "x" * 50, i) for i, k in enumerate(keys)], "graph_id string, body string, i long")
    out = SP.shuffle_rows(rows, "3")
    got = out.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(40)) and sorted(r.i for r in got) == list(range(40))
    assert all(r.graph_id == keys[r.i] for r in got)
    h = [hashlib.md5("|".join(["3"] + [r.graph_id] * (r.graph_id is not None)).encode()).hexdigest() for r in got]
    assert h == sorted(h)
    source = rows._jdf.queryExecution().analyzed().toString().strip().splitlines()[-1].strip()
    scans = [line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "body" in line and "LogicalRDD" in line]
    assert len(scans) == 1 and source in scans[0]


def test_slots_may_be_made_before_the_rows(spark):
    ctx = _ctx(spark, 3, 4)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(D.model_rows(D.encode_slots(ctx), None)) == key(D.model_rows(ctx, None))
    assert D.encode_slots(D.encode_slots(ctx)).columns == ["graph_id", "label", "kind", "seq", "slot"]
