"""Dense numbering without a one-partition window (E2, E5, seq columns).

``global_position`` sorts with a range partitioner (a hot group spans many partitions),
tags rows with ``monotonically_increasing_id`` (partition id in the high bits, row index in
the low 33 bits), writes a reliable checkpoint so every later pass sees the same partitions,
and adds per-partition offsets from a table whose size is the partition count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmine.session import cut_lineage, keep_short

_LOW33 = (1 << 33) - 1
WINDOW_ROWS = 200_000  # rows of a group that one window may number


def global_position(df: DataFrame, order_cols: list, out: str = "pos") -> DataFrame:
    """0-based position of each row under a total order ``order_cols`` (ties must not exist)."""
    tagged = cut_lineage(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy(F.shiftright("_mid", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to order on one task and broadcast
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    return (
        tagged.join(F.broadcast(offsets), F.shiftright(tagged["_mid"], 33) == offsets["_pid"])
        .withColumn(out, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)))
        .drop("_mid", "_pid", "_off")
    )


def number_within(df: DataFrame, group_cols: list, order_cols: list, out: str = "seq", bounded: bool = True, window_rows: int = WINDOW_ROWS,
                  at_most: DataFrame | None = None) -> DataFrame:
    """0-based row number inside each group.

    ``bounded=True``: groups have a proven size bound (e.g. after the tree-size filter), so a
    window partitioned by the group is fine. ``bounded=False``: groups are counted first; only
    those of at most ``window_rows`` rows go through a window, larger ones are numbered globally
    and their first position is taken off (the group-start table is joined back; AQE splits a
    skewed side). ``df`` is computed twice; with ``at_most``, which holds ``_n`` for every group, at least its number of rows,
    it is computed once, and kept where a group may be larger.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    windowed = (F.row_number().over(w) - 1).cast("long")
    if bounded:
        return df.withColumn(out, windowed)
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")) if at_most is None else at_most.select(*group_cols, "_n")
    large = cut_lineage(counts.where(F.col("_n") > window_rows).drop("_n"))
    if large.isEmpty():
        return df.withColumn(out, windowed).select(*df.columns, out)
    if at_most is not None:
        df = keep_short(df)
    same = lambda x, y: reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[c]) for c in group_cols])
    small = df.join(large, same(df, large), "left_anti").withColumn(out, windowed)
    keys = [F.col(c) for c in group_cols]
    positioned = global_position(df.join(large, same(df, large), "left_semi"), keys + list(order_cols), "_gpos")
    starts = positioned.groupBy(*group_cols).agg(F.min("_gpos").alias("_gstart"))
    numbered = positioned.join(starts.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_gstart"),
                               reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]))
    numbered = numbered.withColumn(out, F.col("_gpos") - F.col("_gstart"))
    return small.select(*df.columns, out).unionByName(numbered.select(*df.columns, out))
