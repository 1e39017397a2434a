"""Shared helpers of the training-data operators: table access, batch sizes, shared folder, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmine.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: whole texts can be long, a batch must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded_batches(spark: SparkSession, rows: int = 2048, bytes_: str = "8m") -> None:
    """Arrow batches bounded by bytes as well as rows: one very long text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` hash partitions a number that ``repartition(parts, column)`` deals to it (some other
    partition's number where none of the tried ones falls there)."""
    tried = spark.range(24 * parts + 64).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in tried.collect()}
    return [found.get(p, p) for p in range(parts)]


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own (other columns may clash)."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back (lineage ends there)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep the connectivity of links a-b: one (node, smallest node of its local component) each."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long links -> (node, component = smallest node reachable) for the nodes that occur.

    Alternating large-star / small-star rounds as joins and partial aggregations: a hub's neighbours
    are never gathered into one row. Each round is checkpointed; rounds grow with log of the diameter.
    Self links and repeated links are harmless; an empty input gives an empty table.
    """
    def norm(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def stamp(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = norm(edges).checkpoint(eager=True)
    seen = stamp(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        e2 = norm(large)
        low2 = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low2, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = norm(small).checkpoint(eager=True)
        now = stamp(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
