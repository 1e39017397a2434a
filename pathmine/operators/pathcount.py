"""F1 over C3 without enumeration: count the paths of every node, draw ranks, walk only the drawn paths.

Counts go backwards from the nodes without out-edges: a node is counted in the round after its last successor, so rounds
are the longest path and a round touches the predecessors of newly counted nodes only. A graph whose entry is never
counted can reach a cycle; its contexts are enumerated and the report says so. Counts are exact below 10^38; a graph with
more paths is reported without a count and not sampled. Ranks are places in the order in which the walk would number the
contexts (``seq``), so both ways draw the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmine.operators import traverse as T
from pathmine.options import ExtractOptions
from pathmine.session import cut_lineage, keep_short

WIDE = "decimal(38,0)"
_HALF = 1 << 60


def drawn_ranks(n: Column, k: int, *key: Column) -> Column:
    """Array of min(n, k) distinct places below ``n`` (decimal), uniform without replacement and fixed by ``key``: step i
    draws below n - k + i + 1 and takes n - k + i itself where the draw is already taken."""
    def draw(i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", *key, i.cast("string")))
        part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast(WIDE)
        return (part(1) * F.lit(_HALF).cast("decimal(19,0)")).cast(WIDE) + part(16)

    def step(taken: Column, i: Column) -> Column:
        top = (n - F.lit(k) + i).cast(WIDE)
        at = (draw(i).cast(WIDE) % (top + 1).cast(WIDE)).cast(WIDE)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, at), top).otherwise(at)))

    some = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast(f"array<{WIDE}>"), step)
    every = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(k)).cast("int") - 1), lambda i: i.cast(WIDE))
    return F.when(n <= 0, F.array().cast(f"array<{WIDE}>")).when(n <= k, every).otherwise(some)


def path_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, node_id, n): paths from each node to nodes without out-edges, for the nodes that can reach no cycle; null
    where they pass 10^38. A node whose every edge leads to no known node has none. ``links``: (graph_id, src, dst, known)."""
    pair = ["graph_id", "node_id"]
    known = links.where("known").select("graph_id", F.col("dst").alias("node_id"), "src")
    degree = links.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count_if("known").alias("degree"))
    first = nodes.select(*pair).join(degree, pair, "left").where(F.coalesce("degree", F.lit(0)) == 0)
    new = cut_lineage(first.select(*pair, F.when(F.col("degree").isNull(), 1).otherwise(0).cast(WIDE).alias("n")))
    arrows = keep_short(known.join(degree.select("graph_id", F.col("node_id").alias("src"), "degree"), ["graph_id", "src"]).repartition(*pair))
    counted, pending = new, None
    while not new.isEmpty():
        told = arrows.join(new, pair).groupBy("graph_id", F.col("src").alias("node_id")).agg(
            F.max("degree").alias("degree"), F.count(F.lit(1)).alias("got"), F.try_sum("n").cast(WIDE).alias("n"), F.max(F.col("n").isNull()).alias("wide"))
        if pending is not None:
            told = told.unionByName(pending).groupBy(*pair).agg(
                F.max("degree").alias("degree"), F.sum("got").alias("got"), F.try_sum("n").cast(WIDE).alias("n"), F.max(F.col("wide") | F.col("n").isNull()).alias("wide"))
        told = cut_lineage(told.withColumn("n", F.when(~F.col("wide"), F.col("n"))))
        new = told.where("got = degree").select(*pair, "n")
        pending = told.where("got < degree")
        counted = counted.unionByName(new)
    return counted


def sample_flow_paths(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, k: int | None = None,
                      opts: ExtractOptions = ExtractOptions()) -> tuple[DataFrame, DataFrame]:
    """At most ``k`` (default the options' limit) contexts per graph, uniform without replacement: (contexts as
    ``flow_paths`` gives them, seq as decimal; report(graph_id, n_contexts, enumerated)).

    cfg and cdg graphs without a cycle below their entry are counted and only the drawn paths walked. Cyclic graphs, and
    all of kind ddg (whose equal contexts count once, which counts of paths cannot know), are enumerated."""
    k = opts.max_path_contexts if k is None else k
    report_cols = ["graph_id", "n_contexts", "enumerated"]
    if kind == "ddg":
        return _enumerated(graphs, nodes, edges, kind, k, opts)
    if kind == "cdg":
        with_edges = edges.select("graph_id").distinct()
        graphs, nodes = graphs.join(with_edges, "graph_id", "left_semi"), nodes.join(with_edges, "graph_id", "left_semi")
    single = edges.groupBy("graph_id", "src", "dst").agg(F.min("ord").alias("ord"))
    nn = keep_short(T.normalize_nodes(graphs, nodes, opts))
    roots = T.entry_nodes(nn, None if kind == "cdg" else opts.entry_id)
    links = T._links(nn, single)
    counts = path_counts(nn, links)
    totals = cut_lineage(roots.join(counts.withColumnRenamed("node_id", "root"), ["graph_id", "root"]).select("graph_id", "root", "n"))
    drawn = totals.where("n is not null").select("graph_id", "root", F.explode(drawn_ranks(F.col("n"), k, F.lit(opts.seed), F.col("graph_id"), F.lit(kind))).alias("rank"))
    children = links.where("known").join(counts.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).where("n > 0")
    upto = F.try_sum("n").over(Window.partitionBy("graph_id", "src").orderBy("ord", "dst").rowsBetween(Window.unboundedPreceding, 0)).cast(WIDE)
    steps = keep_short(children.withColumn("hi", upto).withColumn("lo", (F.col("hi") - F.col("n")).cast(WIDE)).select(
        "graph_id", F.col("src").alias("node"), "dst", "dst_type", "dst_token", "lo", "hi"))
    frontier = drawn.join(nn.withColumnRenamed("node_id", "root"), ["graph_id", "root"]).select(
        "graph_id", "rank", F.col("rank").alias("rest"), F.col("root").alias("node"), F.array("ntype").alias("types"),
        F.col("ntoken").alias("start_token"), F.col("ntoken").alias("token"))
    ended = []
    while True:
        f, s = frontier.alias("f"), steps.alias("s")
        on = (F.col("f.graph_id") == F.col("s.graph_id")) & (F.col("f.node") == F.col("s.node")) & (F.col("f.rest") >= F.col("s.lo")) & (F.col("f.rest") < F.col("s.hi"))
        step = cut_lineage(f.join(s, on, "left").select("f.*", "s.dst", "s.dst_type", "s.dst_token", "s.lo"))
        ended.append(step.where("dst is null").select(
            "graph_id", F.lit(kind).alias("kind"), F.col("rank").cast(WIDE).alias("seq"), "start_token",
            F.array_join("types", opts.down_symbol).alias("path"), F.col("token").alias("end_token")))
        frontier = step.where("dst is not null").select(
            "graph_id", "rank", (F.col("rest") - F.col("lo")).cast(WIDE).alias("rest"), F.col("dst").alias("node"),
            F.concat("types", F.array("dst_type")).alias("types"), "start_token", F.col("dst_token").alias("token"))
        if frontier.isEmpty():
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    report = totals.select("graph_id", F.col("n").alias("n_contexts"), F.lit(False).alias("enumerated"))
    left = cut_lineage(graphs.select("graph_id").join(totals, "graph_id", "left_anti"))
    rest, rest_report = _enumerated(*(t.join(left, "graph_id", "left_semi") for t in (graphs, nodes, edges)), kind, k, opts)
    return out.unionByName(rest), report.unionByName(rest_report).select(*report_cols)


def _enumerated(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, k: int, opts: ExtractOptions) -> tuple[DataFrame, DataFrame]:
    every = cut_lineage(T.flow_paths(graphs, nodes, edges, kind, opts))
    totals = every.groupBy("graph_id").agg(F.count(F.lit(1)).cast(WIDE).alias("n"))
    drawn = totals.select("graph_id", F.explode(drawn_ranks(F.col("n"), k, F.lit(opts.seed), F.col("graph_id"), F.lit(kind))).alias("seq"))
    out = every.withColumn("seq", F.col("seq").cast(WIDE)).join(drawn, ["graph_id", "seq"], "left_semi").select(*T.PATH_COLS)
    return out, totals.select("graph_id", F.col("n").alias("n_contexts"), F.lit(True).alias("enumerated"))
