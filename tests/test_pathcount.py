"""Sampling by path counts against enumeration, and on graphs that cannot be enumerated."""

import random

from pyspark.sql import functions as F

from pathmine.operators import pathcount as PC
from pathmine.operators import traverse as T

EDGE = "graph_id string, src string, dst string, ord long, label string"


def tables(spark, graphs):
    g = spark.createDataFrame([(i, f"m{i}") for i in graphs], "graph_id string, name string")
    n = spark.createDataFrame([(i, v, f"T{v}", f"tok{v}") for i, (nodes, _) in graphs.items() for v in nodes],
                              "graph_id string, node_id string, type string, token string")
    e = spark.createDataFrame([(i, a, b, k, None) for i, (_, es) in graphs.items() for k, (a, b) in enumerate(es)], EDGE)
    return g, n, e


def layers(depth, width):
    """A lattice: every node leads to all of the next layer."""
    name = lambda d, w: f"{d:02d}{w}"
    nodes = [name(0, 0)] + [name(d, w) for d in range(1, depth + 1) for w in range(width)]
    edges = [(name(0, 0), name(1, w)) for w in range(width)]
    edges += [(name(d, a), name(d + 1, b)) for d in range(1, depth) for a in range(width) for b in range(width)]
    return nodes, edges


def test_same_contexts_as_enumeration(spark):
    rnd = random.Random(6)
    graphs = {"loop": (["0", "1", "2"], [("0", "1"), ("1", "0"), ("1", "2")]), "one": (["0"], []), "gone": (["0"], [("0", "9")]),
              "half": (["0", "1"], [("0", "9"), ("0", "1")]), "lattice": layers(4, 3)}
    for i in range(3):
        v = [f"{j}" for j in range(7)]
        graphs[f"r{i}"] = (v, [(a, b) for a in v for b in v if a < b and rnd.random() < 0.5] + [("1", "2")])
    g, n, e = tables(spark, graphs)
    for kind in ("cfg", "cdg"):
        want = sorted((r.graph_id, r.seq, r.start_token, r.path, r.end_token) for r in T.flow_paths(g, n, e, kind).collect())
        out, report = PC.sample_flow_paths(g, n, e, kind, 1000)
        assert sorted((r.graph_id, int(r.seq), r.start_token, r.path, r.end_token) for r in out.collect()) == want
        told = {r.graph_id: (int(r.n_contexts), r.enumerated) for r in report.collect()}
        assert told["loop"][1] and told["lattice"] == (81, False)
        if kind == "cdg":
            continue
        few, _ = PC.sample_flow_paths(g, n, e, kind, 4)
        few = [(r.graph_id, int(r.seq), r.start_token, r.path, r.end_token) for r in few.collect()]
        assert set(few) <= set(want) and len(few) == len(set(few))
        assert all(sum(x[0] == i for x in few) == min(4, sum(x[0] == i for x in want)) for i in graphs)


def test_billions_of_paths(spark):
    g, n, e = tables(spark, {"big": layers(20, 3), "wide": layers(30, 20)})
    out, report = PC.sample_flow_paths(g, n, e, "cfg", 200)
    rows = out.collect()
    assert {r.graph_id: (int(r.n_contexts), r.enumerated) for r in report.where("graph_id = 'big'").collect()} == {"big": (3**20, False)}
    big = [r for r in rows if r.graph_id == "big"]
    assert len(big) == 200 and len({r.path for r in big}) == 200 and all(r.path.count("_") == 20 for r in big)
    first = [sum(r.path.startswith(f"(T000)_(T01{w})") for r in big) for w in range(3)]
    assert min(first) > 40 and sum(first) == 200
    # 20^30 paths pass 10^38: reported without a count
    assert len(rows) == 200
    assert [(r.n_contexts, r.enumerated) for r in report.where("graph_id = 'wide'").collect()] == [(None, False)]


def test_draws_are_uniform(spark):
    n, k = F.lit(7).cast(PC.WIDE), 3
    draws = spark.range(4000).select(PC.drawn_ranks(n, k, F.col("id").cast("string")).alias("d")).collect()
    assert all(len(set(r.d)) == 3 and 0 <= min(r.d) and max(r.d) < 7 for r in draws)
    share = [sum(x in r.d for r in draws) / len(draws) for x in range(7)]
    assert max(share) - min(share) < 0.06
