"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

Records hash into ``n_slots`` virtual slots (id and text checksum, so a repeated or null id does not fill one slot).
Bytes are aggregated per slot. Version 0 of the map deals slots round robin; every run reads the newest version under its
path and edits that: slots leave overloaded shards, no larger than what is too much, and go to the lightest ones until
byte loads are near equal. Slots that need not move stay where they are, and an edit that changes something is stored as
the next version. The map has ``n_slots`` rows whatever the data, which bounds all that the driver and the broadcast hold.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmine.llm import common as C
from pathmine.operators.numbering import number_within

N_SLOTS = 4096


def record_columns(docs: DataFrame, id_col: str, text_col: str, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) per row; a null text has no bytes (size 1, checksum 0)."""
    d = C.id_text(docs, id_col, text_col)
    return d.select(
        F.col("_id").alias("doc_id"),
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("_text"), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): one partial aggregate."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(shard_of: list[int], load: list[int], n_shards: int) -> list[int]:
    """Edited map: slots leave shards above the mean, largest first, and go to the lightest shard; then single moves
    and swaps between the heaviest and the lightest shard as long as they narrow the gap."""
    out, total = list(shard_of), [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for s, b in enumerate(load):
        total[out[s]] += b
        held[out[s]].append(s)
    mean, pool = sum(load) / n_shards, []
    for k in range(n_shards):
        held[k].sort(key=lambda s: (load[s], s))
        for s in reversed(list(held[k])):
            if 0 < load[s] <= total[k] - mean:
                held[k].remove(s)
                total[k] -= load[s]
                pool.append(s)
    heap = [(total[k], k) for k in range(n_shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-load[s], s)):
        t, k = heapq.heappop(heap)
        out[s] = k
        held[k].append(s)
        total[k] = t + load[s]
        heapq.heappush(heap, (total[k], k))
    for _ in range(len(load)):
        hi, lo = max(range(n_shards), key=total.__getitem__), min(range(n_shards), key=total.__getitem__)
        gap = total[hi] - total[lo]
        mine, theirs = sorted((load[s], s) for s in held[hi]), [(0, -1), *sorted((load[s], s) for s in held[lo])]
        best, j = (gap, -1, -1), len(theirs) - 1
        for b, s in reversed(mine):  # moving a net of gap / 2 would even the two shards
            while j > 0 and b - theirs[j][0] < gap / 2:
                j -= 1
            for c, o in theirs[j:j + 2]:
                best = min(best, (abs(gap - 2 * (b - c)), s, o))
        if best[0] >= gap:
            break
        _, s, o = best
        for x, here, there in ((s, hi, lo), (o, lo, hi)):
            if x >= 0:
                held[here].remove(x)
                held[there].append(x)
                total[here] -= load[x]
                total[there] += load[x]
                out[x] = there
    return out


def grow(shard_of: list[int], load: list[int], n_shards: int) -> list[int]:
    """Edited map for one more shard: slots only move into the new shard, taken from the heaviest shards."""
    out, total = list(shard_of), [0] * (n_shards + 1)
    held: dict[int, list[int]] = {k: [] for k in range(n_shards)}
    for s, b in enumerate(load):
        total[out[s]] += b
        held[out[s]].append(s)
    for k in held:
        held[k].sort(key=lambda s: (load[s], s))
    mean = sum(load) / (n_shards + 1)
    while total[n_shards] < mean:
        k = max(held, key=total.__getitem__)
        fit = [s for s in held[k] if total[n_shards] + load[s] <= mean and load[s]]
        if not fit:
            break
        s = fit[-1]
        held[k].remove(s)
        out[s] = n_shards
        total[k] -= load[s]
        total[n_shards] += load[s]
    return out


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int], load: list[int]) -> None:
    """A new version; fails if another run has stored it meanwhile."""
    rows = [(s, k, load[s]) for s, k in enumerate(shard_of)]
    spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, bytes long").parquet(f"{path}/version={version}")


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """(version, shard of each slot) of the newest version under ``path``, None if there is none."""
    try:
        stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = stored.agg(F.max("version")).first()[0]
    return None if version is None else (version, [r["shard"] for r in read_map(spark, path, version).orderBy("vslot").collect()])


def edited_map(spark: SparkSession, path: str, load: list[int], n_shards: int) -> tuple[int, list[int]]:
    """(version, shard of each slot) after the newest map has been edited for these loads and stored if that changed it.
    More shards than it had are added one by one, each taking slots only into itself."""
    found = newest_map(spark, path)
    if found is None:
        found = (0, [s % n_shards for s in range(len(load))])
        write_map(spark, path, 0, found[1], load)
    version, shard_of = found
    if len(shard_of) != len(load) or max(shard_of) >= n_shards:
        raise ValueError(f"the map under {path} has {len(shard_of)} slots and {max(shard_of) + 1} shards")
    edited = list(shard_of)
    for k in range(max(shard_of) + 1, n_shards):
        edited = grow(edited, load, k)
    edited = rebalance(edited, load, n_shards)
    if edited != shard_of:
        version += 1
        write_map(spark, path, version, edited, load)
    return version, edited


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law 'bytes', shard, slot (place in its shard, gapless from 0),
    grown_shard (null under this law), vslot, map_version.

    ``map_path`` keeps the versions of the map from run to run (default: a new one). Equal rows share a virtual slot and
    get a place each. Null ids and texts are ordinary values, a text of any length is one row of its bytes, and other
    columns are not read. An empty table gives an empty result and leaves the map as it is (round robin if new).
    """
    spark = docs.sparkSession
    records = C.written(record_columns(docs, id_col, text_col, n_slots), "shard-records")
    stats = {r["vslot"]: (r["bytes"], r["rows"]) for r in slot_stats(records).collect()}  # at most n_slots rows
    load = [stats.get(s, (0, 0))[0] for s in range(n_slots)]
    version, edited = edited_map(spark, map_path or C.shared_path(spark, "slot-map"), load, n_shards)
    start, at = [], [0] * n_shards
    for s, k in enumerate(edited):  # where each virtual slot's rows begin in their shard
        start.append((s, k, at[k]))
        at[k] += stats.get(s, (0, 0))[1]
    place = spark.createDataFrame(start, "vslot int, shard int, _start long")
    # equal rows are told apart by their place in the written table; a slot of very many rows is numbered by a range sort
    rows = records.withColumn("_at", F.monotonically_increasing_id())
    numbered = number_within(rows, ["vslot"], [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "_at"], "_nth", bounded=False)
    return (
        numbered.join(F.broadcast(place), "vslot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("_start") + F.col("_nth")).cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))
    )
