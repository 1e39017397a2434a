"""End-to-end pipelines: L2 (graphs -> sampled path dataset) and L3 (dataset -> model rows,
shuffle, split, kind selection, vocabularies)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pathmine.operators import dataset as D
from pathmine.operators import split as SP
from pathmine.operators import traverse as T
from pathmine.operators import vocab as VC
from pathmine.functions.text import pad_slots
from pathmine.options import KINDS, SPLIT_FRACTIONS, ExtractOptions, FormatOptions
from pathmine.plans import views as V
from pathmine.session import cut_lineage, ensure_checkpoint_dir
from pathmine.sources import outputs as OUT
from pathmine.sources import records as R


def _kept_apart(spark: SparkSession) -> Callable:
    """Tables written once as Parquet below the checkpoint folder: name, build -> the written table."""
    base = f"{ensure_checkpoint_dir(spark)}/path-dataset-{uuid.uuid4().hex}"

    def keep(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        build().write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    return keep


def build_path_dataset(ast_graph, cfg_graph, cdg_graph, ddg_graph, opts: ExtractOptions = ExtractOptions(), keep: Callable | None = None) -> DataFrame:
    """L2: AST first (B6, I2), keep functions with an AST path and a label (B7), restrict the other
    kinds to those functions before walking them, sample each kind (F1). The AST contexts are computed once: their sample
    is written as the first part of the result (``keep``: name, build -> written table), which also tells the functions."""
    graphs, (spark, sep) = ast_graph[0], (ast_graph[0].sparkSession, opts.separator)
    keep = _kept_apart(spark) if keep is None else keep

    def ast() -> DataFrame:
        sample = D.sample_per_kind(T.ast_paths(*ast_graph, opts, by_graph=True), opts.max_path_contexts, opts.seed)
        return D.labelled(sample, D.labels(graphs, sep)).select(*D.CTX_COLS)

    parts = [keep("ast", ast)]
    funcs = keep("functions", lambda: D.require_ast(parts[0], D.labels(graphs, sep)))
    for kind, triple in (("cfg", cfg_graph), ("cdg", cdg_graph), ("ddg", ddg_graph)):
        if triple is None:
            continue

        def flow(kind=kind, triple=triple) -> DataFrame:
            ctx = T.flow_paths(*D.restrict(*triple, funcs), kind, opts)
            return D.sample_per_kind(ctx, opts.max_path_contexts, opts.seed).join(funcs, "graph_id").select(*D.CTX_COLS)

        parts.append(keep(kind, flow))
    return reduce(DataFrame.unionByName, parts)


def flagship(spark, sf_dir: str, opts: ExtractOptions = ExtractOptions(), keep: Callable | None = None) -> DataFrame:
    return build_path_dataset(
        V.v1_trees(spark, sf_dir),
        V.v2_flows(spark, sf_dir),
        V.v4_control(spark, sf_dir),
        V.v3_dependence(spark, sf_dir),
        opts,
        keep,
    )


def to_model_rows(ctx: DataFrame, fopts: FormatOptions = FormatOptions(), materialize: bool = True) -> DataFrame:
    """B8 -> B9 -> E3 -> H10/H11 -> H13. Examples keep a row even with no valid context.
    The dataset is read twice (examples and contexts), so it is written once first: the
    L2/L3 stage boundary, like the dataset file between the original tool's stages."""
    lf = D.label_filter(cut_lineage(ctx) if materialize else ctx, fopts.not_include_methods)
    examples = lf.select("graph_id", "label").distinct()
    # one shuffle by graph serves the window by kind, the slots and the join; it carries slots, not paths
    capped = D.head_per_kind(D.encode_slots(D.valid_contexts(lf)).repartition("graph_id"), fopts.max_paths)
    slots = D.model_rows(capped, None).drop("label")
    j = examples.join(slots, "graph_id", "left")
    empty = F.array().cast("array<string>")
    return j.select(
        "graph_id", "label", *[pad_slots(F.coalesce(F.col(k), empty), int(fopts.max_paths.get(k, 0))).alias(k) for k in KINDS]
    )


def format_dataset(ctx: DataFrame, fopts: FormatOptions = FormatOptions(), materialize: bool = True):
    """L3: returns (split rows with ``line`` after kind selection, all split rows).
    ``materialize=False`` when ``ctx`` is already a written table."""
    split = SP.split_dataset(SP.shuffle_rows(to_model_rows(ctx, fopts, materialize), fopts.seed))
    kept = D.select_kinds(split.where(F.col("split").isNotNull()), fopts.include)
    return kept, split


def train_vocab(kept: DataFrame, fopts: FormatOptions = FormatOptions()) -> DataFrame:
    return VC.vocab(kept.where(F.col("split") == "train"), fopts.include)


def format_text(spark: SparkSession, paths: dict[str, str], out_dir: str, fopts: FormatOptions = FormatOptions()) -> dict[str, int]:
    """L3 from dataset text (name -> path, in order) to files: ``out_dir/splits`` (A7: the lines of each split and dataset),
    ``out_dir/vocab`` (A8: for each dataset the dictionaries summed up to it, G4, and its counts). Each dataset is shuffled
    and split by itself.

    Returns what the run saw, measured on the rows as they were written, without a job of its own: examples,
    bad_label_examples (B8), contexts of each kind (D4), rows of each split, unsplit rows (F6) and rows without a chosen
    kind (B11)."""
    records = R.read_datasets(spark, paths)
    key = F.concat_ws("|", "dataset", F.col("rec_id").cast("string")).alias("graph_id")
    heads = D.record_heads(records, ("dataset",)).select(key, "dataset", "label")
    seen, sizes = Observation("examples"), Observation("splits")
    bad = F.col("label").isNull() | (F.trim("label") == "") | F.col("label").isin([e for e in fopts.not_include_methods if e])
    heads = heads.observe(seen, F.count(F.lit(1)).alias("examples"), F.count_if(bad).alias("bad_label_examples"))
    ctx = D.valid_contexts(D.repair_contexts(D.parse_records(records, ("dataset",)))).withColumn("graph_id", key).withColumnRenamed("pos", "seq")
    capped = D.head_per_kind(D.label_filter(ctx, fopts.not_include_methods), fopts.max_paths)
    slots = D.model_rows(capped, None).drop("label")
    empty = F.array().cast("array<string>")
    rows = D.label_filter(heads, fopts.not_include_methods).join(slots, "graph_id", "left").select(
        "graph_id", "dataset", "label", *[F.coalesce(F.col(k), empty).alias(k) for k in KINDS])
    split = SP.split_by_dataset(rows, "dataset", fopts.seed)
    inc = [k for k in KINDS if k in fopts.include]
    has_all = reduce(lambda a, b: a & b, [F.size(k) > 0 for k in inc], F.lit(True))
    split = split.observe(
        sizes, *[F.count_if(F.col("split") == name).alias(f"{name}_rows") for name, _ in SPLIT_FRACTIONS], F.count_if(F.col("split").isNull()).alias("unsplit_rows"),
        F.count_if(~has_all).alias("rows_without_a_chosen_kind"), *[F.coalesce(F.sum(F.size(k)), F.lit(0)).alias(f"{k}_contexts") for k in KINDS])
    split = cut_lineage(split)
    padded = split.where("split is not null").select(
        "graph_id", "dataset", "label", "split", *[pad_slots(F.col(k), int(fopts.max_paths.get(k, 0))).alias(k) for k in KINDS])
    kept = D.select_kinds(padded, fopts.include)
    kept.select("dataset", "split", "line").write.partitionBy("dataset", "split").text(f"{out_dir}/splits")
    train = split.where("split = 'train'").where(has_all)
    sc = VC.slot_contexts(train, fopts.include, ("dataset",))
    per = (train.select("dataset", F.lit("target").alias("kind"), F.col("label").alias("term"))
           .unionByName(sc.select("dataset", F.lit("path").alias("kind"), F.col("path_hash").alias("term")))
           .unionByName(sc.select("dataset", F.lit("token").alias("kind"), F.explode(F.array("start_token", "end_token")).alias("term"))))
    per = per.groupBy("dataset", "kind", "term").agg(F.count(F.lit(1)).alias("freq"))
    order = spark.createDataFrame(list(enumerate(paths)), "dataset_ord long, dataset string")  # the caller's datasets
    counted = split.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("split") == "train") & has_all).alias("train_rows_kept"))
    meta = counted.select("dataset", F.explode(F.create_map(
        F.lit("num_training_examples"), F.bround(F.col("n").cast("double") * F.lit(SPLIT_FRACTIONS[0][1])).cast("long"),
        F.lit("train_rows_kept"), F.col("train_rows_kept"))).alias("name", "value"))
    OUT.write_vocab(VC.cumulative_vocab(per.join(F.broadcast(order), "dataset")), meta, f"{out_dir}/vocab")
    return {**seen.get, **sizes.get}


def build_resumable(ast_graph, cfg_graph, cdg_graph, ddg_graph, out_dir: str, opts: ExtractOptions = ExtractOptions(), parts: int = 16) -> DataFrame:
    """L2 in ``parts`` by hash of the function id, each written under ``out_dir/dataset/part=n`` and then named in the
    manifest ``out_dir/finished`` (one small commit per part). A run that starts again leaves the parts in the manifest
    alone (C4) and overwrites what an interrupted one left of the others, so functions come neither twice nor not at all.
    Returns the whole dataset."""
    spark = ast_graph[0].sparkSession
    try:
        finished = {r["part"] for r in spark.read.schema("part int, n long").parquet(f"{out_dir}/finished").collect()}  # at most ``parts`` rows
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        finished = set()
    for part in sorted(set(range(parts)) - finished):
        mine = F.pmod(F.xxhash64("graph_id"), F.lit(parts)) == part
        graphs = [None if g is None else tuple(t.where(mine) for t in g) for g in (ast_graph, cfg_graph, cdg_graph, ddg_graph)]
        here = f"{out_dir}/dataset/part={part}"
        build_path_dataset(*graphs, opts).write.mode("overwrite").parquet(here)
        spark.read.parquet(here).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{out_dir}/finished")
    return spark.read.parquet(f"{out_dir}/dataset").select(*D.CTX_COLS)
