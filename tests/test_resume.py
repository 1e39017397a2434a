"""Resumed and observed pipelines, name lists, deep graphs."""

import pytest
from pyspark.sql import functions as F

from pathmine.operators import cpg as K
from pathmine.operators import traverse as T
from pathmine.operators import vocab as VC
from pathmine.options import ExtractOptions, FormatOptions
from pathmine.plans import pipelines as P
from pathmine.sources import outputs as OUT
from tests.test_pathcount import tables


def test_killed_run_is_resumed(spark, tmp_path, monkeypatch):
    graphs = {f"g{i}": (["0", "1", "2", "3"][: 3 + i % 2], [("0", "1"), ("0", "2"), ("0", "3")][: 2 + i % 2]) for i in range(12)}
    g, n, e = tables(spark, graphs)
    n = n.withColumn("token", F.concat(F.lit("t"), "node_id"))
    out, opts, real = str(tmp_path / "l2"), ExtractOptions(entry_id=None), P.build_path_dataset
    runs = []

    def breaks(*a):
        runs.append(1)
        if len(runs) == 2:
            spark.createDataFrame([("half",)], "graph_id string").write.parquet(f"{out}/dataset/part=1")
            raise RuntimeError("killed")
        return real(*a)

    monkeypatch.setattr(P, "build_path_dataset", breaks)
    args = ((g, n, e), (g, n, e), None, None, out, opts, 3)
    with pytest.raises(RuntimeError):
        P.build_resumable(*args)
    got = sorted(map(tuple, P.build_resumable(*args).collect()))
    assert len(runs) == 4  # part 0 was not built again
    assert got and got == sorted(map(tuple, real((g, n, e), (g, n, e), None, None, opts).collect()))
    assert sorted(map(tuple, P.build_resumable(*args).collect())) == got and len(runs) == 4


def test_format_text_counts(spark, tmp_path):
    def record(i, label, ast, cfg):
        return f"#{i}\nlabel:{label}\nfile:{i}.c\npath: ast\n{ast}path: cfg\n{cfg}path: cdg\npath: ddg\n"

    one, two = "a\t(X)^(Y)\tb\n", "c\t(Z)\td\n"
    for name, label in (("first", "get|a"), ("second", "put|b")):
        rows = [record(i, label if i else "", one * (i % 3), two * (i % 2)) for i in range(30)]
        spark.createDataFrame([(r,) for r in rows], "record string").coalesce(1).write.text(str(tmp_path / name))
    out = str(tmp_path / "out")
    counts = P.format_text(spark, {k: str(tmp_path / k) for k in ("first", "second")}, out, FormatOptions(include=("ast", "cfg")))
    assert counts["examples"] == 60 and counts["bad_label_examples"] == 2
    assert counts["train_rows"] == 52 and counts["val_rows"] == 2 and counts["test_rows"] == 4 and counts["unsplit_rows"] == 0
    assert counts["ast_contexts"] == 60 and counts["cfg_contexts"] == 30 and counts["cdg_contexts"] == 0 and counts["rows_without_a_chosen_kind"] == 2 * 19
    lines = spark.read.text(f"{out}/splits").collect()
    assert len(lines) == 20 and all(r.value.split(" ")[0] in ("get|a", "put|b") for r in lines)
    vocab, meta = OUT.read_vocab(spark, f"{out}/vocab")
    told = {(r.dataset, r.name): r.value for r in meta.collect()}
    assert told["first", "num_training_examples"] == 26 and told["first", "train_rows_kept"] <= 10
    labels = {(r.dataset, r.term): r.freq for r in vocab.where("kind = 'target'").collect()}
    assert labels["first", "get|a"] == labels["second", "get|a"] == told["first", "train_rows_kept"] and ("first", "put|b") not in labels


def test_vocab_intervals(spark):
    rows = [("d1", 1, "token", "a", 2), ("d2", 2, "token", "b", 5), ("d3", 3, "token", "a", 1), ("d4", 4, "path", "p", 1)]
    runs, numbers = VC.cumulative_intervals(spark.createDataFrame(rows, "dataset string, dataset_ord long, kind string, term string, freq long"))
    assert sorted((r.kind, r.term, r["first"], r["last"], r.freq) for r in runs.collect()) == [
        ("path", "p", 3, 3, 1), ("token", "a", 0, 1, 2), ("token", "a", 2, 3, 3), ("token", "b", 1, 3, 5)]
    assert sorted((r.term, r.freq) for r in VC.vocab_at(runs, numbers, "d3").collect()) == [("a", 3), ("b", 5)]
    assert VC.vocab_at(runs, numbers, "d9").count() == 0


def test_reach_along_long_chains(spark, monkeypatch):
    n = 700
    edges = [("g", f"{i}", f"{i + 1}") for i in range(n)] + [("g", "300", "x"), ("g", "x", "310"), ("c", "0", "1"), ("c", "1", "2"), ("c", "2", "0"), ("g", "up", "0")]
    e = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    seeds = spark.createDataFrame([("g", "5"), ("c", "1")], "graph_id string, node_id string")
    rounds = []
    real = T.keep_round
    monkeypatch.setattr(T, "keep_round", lambda df, r, every=1: rounds.append(r) or real(df, r, every))
    got = {(r.graph_id, r.node_id) for r in T.reach_from(e, seeds, plain_rounds=2).collect()}
    assert got == {("g", f"{i}") for i in range(6, n + 1)} | {("g", "x"), ("c", "0"), ("c", "1"), ("c", "2")}
    assert len(rounds) < 12
    back = {(r.graph_id, r.node_id) for r in T.reach_from(e, spark.createDataFrame([("g", "301")], "graph_id string, node_id string"), "backward", plain_rounds=2).collect()}
    assert back == {("g", f"{i}") for i in range(301)} | {("g", "up")}


def test_pointer_flags(spark):
    nodes = [("g", "a", "CALL", "f", None), ("g", "b", "CALL", K.INDIRECT_FIELD, None), ("g", "p", "IDENTIFIER", "p", "char*"), ("g", "i", "IDENTIFIER", "i", "int"),
             ("g", "c", "CALL", K.INDIRECT_FIELD, None), ("g", "q", "CALL", K.ADDRESS_OF, None), ("g", "m", "METHOD", "m", None), ("g", "u", "IDENTIFIER", "u", None)]
    edges = [("g", "m", "a", "AST", 1), ("g", "a", "b", "AST", 1), ("g", "a", "c", "AST", 2), ("g", "b", "p", "AST", 1), ("g", "b", "i", "AST", 2),
             ("g", "c", "u", "AST", 1), ("g", "c", "q", "AST", 2)]
    flags = K.pointer_flags(spark.createDataFrame(nodes, "graph_id string, node_id string, label string, name string, type_full_name string"),
                            spark.createDataFrame(edges, "graph_id string, src string, dst string, kind string, ord long"))
    assert {r.node_id for r in flags.where("flag").collect()} == {"p", "q", "c", "a"} and flags.count() == len(nodes)


def test_syscall_names_from_headers(spark):
    text = "#define __NR_read 0\r\n  # define SYS_openat 257\n#define OTHER 3\n# table\n0 common restart_syscall sys_restart_syscall\n12\t64\tbrk\tsys_brk\n"
    got = sorted(r.name for r in K.syscall_names(spark.createDataFrame([(text,), (None,)], "content string")).collect())
    assert got == ["brk", "openat", "read", "restart_syscall"]


def test_path_dataset_walks_the_trees_once(spark, monkeypatch):
    """The sample of the AST contexts is written as a part of the result and read for the functions; nothing computes it again."""
    g = spark.createDataFrame([("g0", "getName"), ("g1", "123"), ("g2", "x")], "graph_id string, name string")
    n = spark.createDataFrame([(f"g{i}", k, "T", f"t{k}") for i in range(3) for k in ("0", "1", "2")][:-1], "graph_id string, node_id string, type string, token string")
    e = spark.createDataFrame([(f"g{i}", "0", k, int(k), None) for i in range(3) for k in ("1", "2")], "graph_id string, src string, dst string, ord long, label string")
    opts, told = ExtractOptions(entry_id=None), {}

    def keep(name, build):
        told[name] = build()._jdf.queryExecution().optimizedPlan().toString()
        build().write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    import tempfile

    base = tempfile.mkdtemp()
    got = P.build_path_dataset((g, n, e), (g, n, e), None, None, opts, keep)
    # g1 has no label, g2 no context: the other kind leaves them out too
    assert {(r.graph_id, r.label, r.kind) for r in got.collect()} == {("g0", "get|name", "ast"), ("g0", "get|name", "cfg")}
    assert list(told) == ["ast", "functions", "cfg"] and "ArrowEvalPython" in told["ast"]
    assert not any("ArrowEvalPython" in told[k] for k in ("functions", "cfg"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.build_path_dataset((g, n, e), (g, n, e), None, None, opts).collect()))


def test_small_graphs_are_reached_in_rows(spark, monkeypatch):
    """Reachability of small graphs takes no rounds, however deep they are, and finds what the rounds of large ones find."""
    import random

    rng = random.Random(6)
    rows = [("deep", f"{i:03d}", f"{i + 1:03d}") for i in range(12)] + [("deep", f"{i:03d}", f"leaf{i}") for i in range(12)]
    rows += [("web", rng.choice("abcdefgh"), rng.choice("abcdefghz")) for _ in range(14)] + [("web", "a", None), ("web", None, "a"), (None, "a", "b")]
    e = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    s = spark.createDataFrame([("deep", "003"), ("web", "a"), ("web", None), (None, "a"), ("none", "a")], "graph_id string, node_id string")
    rounds, keep = [], T.keep_round
    monkeypatch.setattr(T, "keep_round", lambda *a: rounds.append(1) or keep(*a))
    for way in ("forward", "backward"):
        got = sorted((r.graph_id, r.node_id or "") for r in T.reach_from(e, s, way).collect())
        assert not rounds and len(got) == len(set(got))
        apart = T.reach_from(e, s, way, plain_rounds=3, row_edges=20)  # the web in a row, the deep graph in rounds
        assert sorted((r.graph_id, r.node_id or "") for r in apart.collect()) == got and rounds
        rounds.clear()
    deep = T.reach_from(e, s).where("graph_id = 'deep'").count()
    assert deep == 9 + 9
