"""Graph views built from the driver tables (V1-V8 in FIXTURES.md).

Each builder returns ``(graphs, nodes, edges)`` in the library's input model; ids are strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathmine.operators.numbering import global_position
from pathmine.options import DEFAULT_ENTRY_ID
from pathmine.plans.stages import stage

LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _v1_tables(spark: SparkSession, sf_dir: str):
    """(graphs, orders, lines) of V1; orders and lines are stages with node_id, ord, type and token."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    graphs = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("graph_id"),
        F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("n_name")).alias("name"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    o = orders.join(graphs, F.col("o_custkey").cast("string") == graphs.graph_id).withColumn(
        "ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("o_orderdate", "o_orderkey"))
    )
    o = stage(spark, "v1_orders", sf_dir, inputs=sf_dir, build=lambda: o.select(
        "graph_id",
        "o_orderkey",
        "ord",
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"),
        F.when(F.col("o_orderstatus") == "P", F.col("name"))
        .otherwise(F.concat(F.lit("ORDER_"), F.col("o_orderstatus")))
        .alias("type"),
        F.col("o_orderpriority").alias("token"),
    ))  # feeds both nodes and edges: written once per session
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_COLS)
    # the parts first: the join with the orders and the window then share one shuffle by order
    lines = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(o.select("graph_id", "o_orderkey", F.col("node_id").alias("parent")), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *LINEITEM_COLS)))
    )
    lines = stage(spark, "v1_lines", sf_dir, inputs=sf_dir, build=lambda: lines.select(
        "graph_id",
        "parent",
        "ord",
        F.concat(F.col("parent"), F.lit("_"), F.col("ord").cast("string")).alias("node_id"),
        F.concat(F.lit("LINE_"), F.col("l_returnflag"), F.col("l_linestatus")).alias("type"),
        F.col("p_name").alias("token"),
    ))
    return graphs, o, lines


def v1_trees(spark: SparkSession, sf_dir: str):
    """V1 ordered trees: customer -> orders -> lineitems."""
    graphs, o, lines = _v1_tables(spark, sf_dir)
    root = graphs.select("graph_id", F.lit(DEFAULT_ENTRY_ID).alias("node_id"), F.lit("METHOD").alias("type"), F.col("name").alias("token"))
    nodes = root.unionByName(o.select("graph_id", "node_id", "type", "token")).unionByName(
        lines.select("graph_id", "node_id", "type", "token")
    )
    edges = o.select(
        "graph_id", F.lit(DEFAULT_ENTRY_ID).alias("src"), F.col("node_id").alias("dst"), "ord", F.lit(None).cast("string").alias("label")
    ).unionByName(
        lines.select("graph_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"), "ord", F.lit(None).cast("string").alias("label"))
    )
    return graphs, nodes, edges


def _event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events per user as (user_id, pos, type, next_type, k) without a per-user
    window: a global position (range sort, hot users spread) joined to position + 1."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    pos = stage(spark, "event_positions", sf_dir, inputs=sf_dir,
                build=lambda: global_position(ev, ["user_id", "ts", "event_id"], "pos"))
    a = pos.select("user_id", "pos", F.col("event_type").alias("src"), "k")
    b = pos.select(F.col("user_id").alias("u2"), (F.col("pos") - 1).alias("pos"), F.col("event_type").alias("dst"))
    return a.join(b, "pos").where(F.col("user_id") == F.col("u2")).drop("u2"), pos


def v2_flows(spark: SparkSession, sf_dir: str):
    """V2 flow graphs: per user, event types as nodes, distinct transitions as edges."""
    steps, pos = _event_steps(spark, sf_dir)
    graphs = pos.select(F.col("user_id").cast("string").alias("graph_id")).distinct().withColumn(
        "name", F.concat(F.lit("user_"), F.col("graph_id"))
    )
    nodes = pos.select(
        F.col("user_id").cast("string").alias("graph_id"), F.col("event_type").alias("node_id")
    ).distinct().select("graph_id", "node_id", F.upper("node_id").alias("type"), F.col("node_id").alias("token"))
    edges = steps.groupBy("user_id", "src", "dst").agg(F.min("pos").alias("ord")).select(
        F.col("user_id").cast("string").alias("graph_id"), "src", "dst", "ord", F.lit(None).cast("string").alias("label")
    )
    return graphs, nodes, edges


def ddg_label(k, containment: bool = True):
    if containment:
        r = F.pmod(k, F.lit(3))
        return F.when(r == 0, F.lit("v")).when(r == 1, F.lit("v1")).otherwise(F.lit("v12"))
    return F.concat(F.lit("v"), F.pmod(k, F.lit(3)).cast("string"))


def v3_dependence(spark: SparkSession, sf_dir: str, containment: bool = False):
    """V3 labelled multigraphs: V2 with the earlier event's variable on each edge."""
    steps, pos = _event_steps(spark, sf_dir)
    graphs, nodes, _ = v2_flows(spark, sf_dir)
    edges = (
        steps.withColumn("label", ddg_label(F.col("k"), containment))
        .groupBy("user_id", "src", "dst", "label")
        .agg(F.min("pos").alias("ord"))
        .select(F.col("user_id").cast("string").alias("graph_id"), "src", "dst", "ord", "label")
    )
    return graphs, nodes, edges


def v4_control(spark: SparkSession, sf_dir: str):
    """V4 dependence trees: region -> nation -> customer, plus one graph without edges."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    gid = F.col("r_regionkey").cast("string")
    solo = region.agg(F.min("r_regionkey").alias("r_regionkey")).join(region, "r_regionkey")
    graphs = region.select(gid.alias("graph_id"), F.col("r_name").alias("name")).unionByName(
        solo.select(F.lit("solo").alias("graph_id"), F.col("r_name").alias("name"))
    )
    rn = region.select(gid.alias("graph_id"), F.lit("0").alias("node_id"), F.lit("REGION").alias("type"), F.col("r_name").alias("token"))
    nn = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        gid.alias("graph_id"),
        F.concat(F.lit("1_"), F.col("n_nationkey").cast("string")).alias("node_id"),
        F.lit("NATION").alias("type"),
        F.col("n_name").alias("token"),
        F.col("n_nationkey"),
    )
    cn = cust.join(nn, cust.c_nationkey == nn.n_nationkey).select(
        "graph_id",
        F.concat(F.lit("2_"), F.col("c_custkey").cast("string")).alias("node_id"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_name").alias("token"),
        F.col("node_id").alias("parent"),
        F.col("c_custkey"),
    )
    solo_node = solo.select(F.lit("solo").alias("graph_id"), F.lit("0").alias("node_id"), F.lit("REGION").alias("type"), F.col("r_name").alias("token"))
    nodes = (
        rn.unionByName(nn.drop("n_nationkey"))
        .unionByName(cn.select("graph_id", "node_id", "type", "token"))
        .unionByName(solo_node)
    )
    edges = nn.select("graph_id", F.lit("0").alias("src"), F.col("node_id").alias("dst"), F.col("n_nationkey").cast("long").alias("ord")).unionByName(
        cn.select("graph_id", F.col("parent").alias("src"), F.col("node_id").alias("dst"), F.col("c_custkey").cast("long").alias("ord"))
    ).withColumn("label", F.lit(None).cast("string"))
    return graphs, nodes, edges


def v8_repos(spark: SparkSession, sf_dir: str):
    """V8 repositories from parts: (repos, stars_list, forks_list, method_counts).
    The two source lists are the top 60 % of parts by stars and by forks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    per = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("stars"), F.count_distinct("l_suppkey").alias("forks"), F.sum("l_quantity").alias("qty")
    )
    j = part.join(per, part.p_partkey == per.l_partkey, "left")
    repos = j.select(
        F.concat(F.col("p_name"), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("link"),
        F.coalesce(F.col("stars"), F.lit(0)).cast("long").alias("stars"),
        F.coalesce(F.col("forks"), F.lit(0)).cast("long").alias("forks"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_partkey"),
        F.col("qty"),
    )
    n = repos.agg(F.count(F.lit(1)).alias("_n"))
    lists = []
    for key in ("stars", "forks"):
        ranked = global_position(repos, [F.col(key).desc(), F.col("p_partkey")], "list_pos")
        lists.append(
            ranked.crossJoin(F.broadcast(n)).where(F.col("list_pos") < F.col("_n") * 0.6).drop("_n", "qty")
        )
    counts = repos.where(F.col("qty").isNotNull()).select("name", F.col("qty").cast("long").alias("method_count"))
    return repos.drop("qty"), lists[0], lists[1], counts


# Fixed mapping for the V9 code-property-graph view (our own fixture, not from the original tool).
CPG_CALL_BY_PRIORITY = {
    "1-URGENT": "malloc",
    "2-HIGH": "<operator>.subtraction",
    "3-MEDIUM": "<operator>.addition",
    "4-NOT SPECIFIED": "<operator>.indirectFieldAccess",
    "5-LOW": "free",
}
CPG_ASSIGNMENT_BY_STATUS = {"F": "<operator>.assignmentMinus", "O": "<operator>.assignment", "P": "<operators>.assignmentOr"}
CPG_TARGET_TYPE_BY_STATUS = {"F": "int", "O": "char*", "P": "char[8]"}


def _mapped(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def v9_cpg(spark: SparkSession, sf_dir: str):
    """V9 code property graph per customer: METHOD -> one assignment per order
    (target identifier, source call named by priority) -> the order's lines as call arguments.
    Returns (nodes, edges): nodes(graph_id, node_id, label, name, code, type_full_name),
    edges(graph_id, src, dst, kind in AST/REACHING_DEF, ord)."""
    graphs, v1_orders, v1_lines = _v1_tables(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("graph_id"), "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("onode"), "o_orderstatus", "o_orderpriority"
    )
    # order nodes of V1 carry the child position under the method
    o = v1_orders.select("graph_id", F.col("node_id").alias("onode"), F.col("ord").alias("k"))
    o = o.join(orders, "onode")
    lines = v1_lines.select(
        "graph_id", F.col("parent").alias("onode"), F.col("node_id").alias("lnode"), F.col("ord").alias("arg"),
        F.col("type").alias("ltype"), F.col("token").alias("ltoken")
    )
    flag = F.substring("ltype", 6, 1)
    status = F.substring("ltype", 7, 1)
    line_label = F.when(flag == "N", "IDENTIFIER").when(flag == "A", "LITERAL").otherwise("CALL")
    line_name = F.when(flag == "R", F.when(status == "O", "<operator>.addressOf").otherwise("<operator>.multiplication")).otherwise(F.col("ltoken"))
    line_type = F.when(flag == "N", F.when(status == "O", "int").otherwise("char*")).otherwise(F.lit("ANY"))
    method = graphs.select("graph_id", F.lit(DEFAULT_ENTRY_ID).alias("node_id"), F.lit("METHOD").alias("label"), "name",
                           F.col("name").alias("code"), F.lit("ANY").alias("type_full_name"))
    param = cust.select("graph_id", F.lit("p").alias("node_id"), F.lit("PARAMETER").alias("label"), F.lit("arg").alias("name"),
                        F.lit("arg").alias("code"),
                        F.when(F.col("c_acctbal") > 5000, "const char*").otherwise("char*").alias("type_full_name"))
    call_name = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("k") % 3 == 0), "copy_from_user").when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("k") % 5 == 0), "__get_user").otherwise(
        _mapped(F.col("o_orderpriority"), CPG_CALL_BY_PRIORITY, "unknown"))
    assign = o.select("graph_id", F.concat(F.lit("a"), "onode").alias("node_id"), F.lit("CALL").alias("label"),
                      _mapped(F.col("o_orderstatus"), CPG_ASSIGNMENT_BY_STATUS, "<operator>.assignment").alias("name"), F.concat(F.lit("v"), F.col("k").cast("string"), F.lit(" = ...")).alias("code"),
                      F.lit("ANY").alias("type_full_name"))
    target = o.select("graph_id", F.concat(F.lit("t"), "onode").alias("node_id"), F.lit("IDENTIFIER").alias("label"),
                      F.concat(F.lit("v"), F.col("k").cast("string")).alias("name"), F.concat(F.lit("v"), F.col("k").cast("string")).alias("code"),
                      _mapped(F.col("o_orderstatus"), CPG_TARGET_TYPE_BY_STATUS, "ANY").alias("type_full_name"))
    source = o.select("graph_id", F.concat(F.lit("c"), "onode").alias("node_id"), F.lit("CALL").alias("label"), call_name.alias("name"),
                      F.concat(call_name, F.lit("#"), F.col("k").cast("string")).alias("code"), F.lit("ANY").alias("type_full_name"))
    argn = lines.select("graph_id", "lnode", line_label.alias("label"), line_name.alias("name"), F.col("ltoken").alias("code"),
                        line_type.alias("type_full_name")).withColumnRenamed("lnode", "node_id")
    nodes = method.unionByName(param).unionByName(assign).unionByName(target).unionByName(source).unionByName(argn)
    ast = (
        o.select("graph_id", F.lit(DEFAULT_ENTRY_ID).alias("src"), F.concat(F.lit("a"), "onode").alias("dst"), F.col("k").alias("ord"))
        .unionByName(o.select("graph_id", F.concat(F.lit("a"), "onode").alias("src"), F.concat(F.lit("t"), "onode").alias("dst"), F.lit(1).cast("long").alias("ord")))
        .unionByName(o.select("graph_id", F.concat(F.lit("a"), "onode").alias("src"), F.concat(F.lit("c"), "onode").alias("dst"), F.lit(2).cast("long").alias("ord")))
        .unionByName(lines.select("graph_id", F.concat(F.lit("c"), "onode").alias("src"), F.col("lnode").alias("dst"), F.col("arg").cast("long").alias("ord")))
        .withColumn("kind", F.lit("AST"))
    )
    nxt = o.select("graph_id", F.col("onode").alias("prev"), (F.col("k") + 1).alias("k"))
    o2 = o.select("graph_id", "onode", "k")
    chain = nxt.join(o2, ["graph_id", "k"])
    ddg = (
        o.select("graph_id", F.concat(F.lit("c"), "onode").alias("src"), F.concat(F.lit("t"), "onode").alias("dst"))
        .unionByName(chain.select("graph_id", F.concat(F.lit("t"), "prev").alias("src"), F.concat(F.lit("c"), "onode").alias("dst")))
        .unionByName(chain.join(lines.select("graph_id", "onode", "lnode"), ["graph_id", "onode"]).select(
            "graph_id", F.concat(F.lit("t"), "prev").alias("src"), F.col("lnode").alias("dst")))
        .unionByName(o.where(F.col("k") == 1).select("graph_id", F.lit("p").alias("src"), F.concat(F.lit("c"), "onode").alias("dst")))
        .withColumn("ord", F.lit(0).cast("long")).withColumn("kind", F.lit("REACHING_DEF"))
    )
    return nodes, ast.unionByName(ddg)
