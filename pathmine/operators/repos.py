"""Repository list operations (ranking, union, difference, slicing, method counts).

Repository lists are small next to the code they describe, but nothing here runs on one
task: rankings and running totals use the range-sorted global position (numbering.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmine.operators.numbering import global_position
from pathmine.session import cut_lineage

REPO_COLS = ["name", "link", "stars", "forks", "size"]


def read_repos(spark, path: str, one_list: bool = False) -> DataFrame:
    """A10: JSON lines of repository objects -> projected columns. ``one_list``: each file is one JSON list."""
    df = spark.read.option("multiLine", one_list).json(path)
    return df.select(
        F.col("name").cast("string"),
        F.col("link").cast("string"),
        F.col("stars").cast("long"),
        F.col("forks").cast("long"),
        F.col("size").cast("long"),
    )


def top_repos(repos: DataFrame, k: int) -> DataFrame:
    """top ``k`` by stars (a top-k report; plans as TakeOrdered)."""
    return repos.orderBy(F.col("stars").desc(), F.col("name")).limit(k)


def union_repos(first: DataFrame, second: DataFrame, pos_col: str | None = None) -> DataFrame:
    """One row per link: the first list's, and within a list the one with the smaller ``pos_col`` (a row's place in
    its list), then the smaller row; without ``pos_col`` the smaller row. One aggregate, the same whatever the partitions."""
    rest = [c for c in first.columns if c not in ("link", pos_col)]
    u = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    place = [F.col(pos_col)] if pos_col else []
    best = u.groupBy("link").agg(F.min_by(F.struct(*rest, "_src"), F.struct("_src", *place, *rest)).alias("_r"))
    return best.select("link", *(F.col(f"_r.{c}").alias(c) for c in rest), F.col("_r._src").alias("source"))


def repo_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names in one list and not in the other, both ways: (name, side)."""
    a = first.select("name").distinct()
    b = second.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("side", F.lit("first_only")).unionByName(
        b.join(a, "name", "left_anti").withColumn("side", F.lit("second_only"))
    )


def zscores(repos: DataFrame) -> DataFrame:
    """z(stars) + z(forks) with population standard deviation (one-row aggregate, broadcast). Null where a column
    does not vary."""
    stats = repos.agg(
        F.avg("stars").alias("_ms"), F.stddev_pop("stars").alias("_ss"),
        F.avg("forks").alias("_mf"), F.stddev_pop("forks").alias("_sf"),
    )
    z = F.try_divide(F.col("stars") - F.col("_ms"), F.col("_ss")) + F.try_divide(F.col("forks") - F.col("_mf"), F.col("_sf"))
    return repos.crossJoin(F.broadcast(stats)).withColumn("zscore", z).drop("_ms", "_ss", "_mf", "_sf")


def rank_by(repos: DataFrame, order_cols: list, out: str = "rank") -> DataFrame:
    """0-based rank under a total order, without a one-task window."""
    return global_position(repos, order_cols, out)


def attach_method_counts(repos: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join with per-repository method counts; missing -> -1."""
    return repos.join(counts.select("name", "method_count"), "name", "left").withColumn(
        "method_count", F.coalesce(F.col("method_count"), F.lit(-1).cast("long"))
    )


def method_total(repos: DataFrame, threshold: int) -> DataFrame:
    """Sum and count of method counts above a threshold."""
    big = repos.where(F.col("method_count") > threshold)
    return big.agg(F.sum("method_count").alias("total_methods"), F.count(F.lit(1)).alias("n_repos"))


def running_total(ranked: DataFrame, pos_col: str, value_col: str, out: str = "running_total") -> DataFrame:
    """Running sum in ``pos_col`` order. Rows are range partitioned by position; each range
    is summed on its own task and earlier ranges' totals are added from a table whose size is
    the partition count."""
    n_parts = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parted = cut_lineage(ranked.repartitionByRange(n_parts, pos_col).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    local = parted.withColumn("_local", F.sum(value_col).over(w))
    totals = parted.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    offs = totals.select(
        "_pid",
        F.coalesce(F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    return local.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_local") + F.col("_off")).drop("_pid", "_local", "_off")


def total_of_large(ranked: DataFrame, pos_col: str, value_col: str, threshold: int, limit: int | None = None) -> DataFrame:
    """Running total of the values over ``threshold`` (a missing count, -1, and small ones add nothing). With
    ``limit`` the list ends with the row whose total first passes it."""
    out = running_total(ranked.withColumn("_large", F.when(F.col(value_col) > threshold, F.col(value_col)).otherwise(0)), pos_col, "_large")
    if limit is not None:
        out = out.where(F.col("running_total") - F.col("_large") <= limit)
    return out.drop("_large")


def rank_repositories(first: DataFrame, second: DataFrame, counts: DataFrame, threshold: int = 1000, limit: int | None = None,
                      existing: DataFrame | None = None, pos_col: str | None = None) -> DataFrame:
    """L4: union of two lists (G2), without ``existing`` ones (C5), z-scores (D8), rank (F3), method counts (C6) and the
    running total of large counts (E6), cut after ``limit``: REPO_COLS, zscore, rank, method_count, running_total."""
    kept = REPO_COLS + ([pos_col] if pos_col else [])
    repos = union_repos(first.select(*kept), second.select(*kept), pos_col)
    repos = repos if existing is None else skip_existing(repos, existing)
    ranked = attach_method_counts(rank_by(zscores(repos), [F.col("zscore").desc(), F.col("name")], "rank"), counts)
    out = total_of_large(ranked, "rank", "method_count", threshold, limit)
    return out.select(*REPO_COLS, "zscore", "rank", "method_count", F.col("running_total").cast("long"))


def repo_slice(ranked: DataFrame, pos_col: str, start: int, end: int) -> DataFrame:
    """Inclusive positional slice [start, end]."""
    return ranked.where((F.col(pos_col) >= start) & (F.col(pos_col) <= end))


def skip_existing(repos: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop repositories already present."""
    return repos.join(existing.select("name").distinct(), "name", "left_anti")
