"""SimHash near-duplicates through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits), each read as a 23-bit word of the perfect
binary Golay code. Every word has one codeword within distance 3 and, if that distance is 3, five more at distance 4.
Two words at distance 0 or 1 therefore satisfy: the codeword of one is among the (at most six) codewords within
distance 4 of the other. Three differing bits over three segments always leave two segments with at most one error
each, so for every linked pair some pair of segments matches on both codeword indices. Index rows carry a
fingerprint's own codewords (3 keys), probe rows all nearby ones (up to 108), and every hit is verified by bit count.

Only distinct fingerprints take part; equal texts share one. A hit is not emitted as a pair: each task reduces its
verified links to spanning edges, and a key with many index rows is split over probe shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

#: Generator polynomial of the binary Golay code [23,12,7] and its word length.
GOLAY_GENERATOR = 0xAE3
GOLAY_BITS = 23


# ------------------------------------------------------------------ fingerprints
def fingerprint(text: str | None, shingle: int = 3, block: int = 1 << 16) -> int:
    """Unsigned 64-bit majority of XXH64 (seed 42) over word shingles; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    n = len(words)
    if n == 0:
        return 0
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, total = xxhash.xxh64_intdigest, n - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, block):
        part = words[at:min(at + block, total) + shingle - 1]
        h = [digest(s, 42) for s in map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint_column(text: str, shingle: int = 3):
    """Signed long column with the fingerprint of a text column."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return run(F.col(f"`{text}`").cast("string"))


# ------------------------------------------------------------------ Golay tables
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits, coset leaders (weight 0 to 3) and the weight-4 words of each weight-3 coset."""
    low = GOLAY_BITS - 12
    power = []
    for j in range(GOLAY_BITS):
        r = 1 << j
        for k in range(GOLAY_BITS - 1, low - 1, -1):
            if r >> k & 1:
                r ^= GOLAY_GENERATOR << (k - low)
        power.append(r)
    high = np.zeros(1 << 12, np.int64)
    for j in range(12):
        high ^= np.where(np.arange(1 << 12) >> j & 1, power[low + j], 0)
    leader = np.zeros(1 << low, np.int64)
    near: list[list[int]] = [[] for _ in range(1 << low)]

    def words(start: int, left: int, word: int, syn: int) -> None:
        if left == 0:
            if word.bit_count() == 4:
                near[syn].append(word)
            else:
                leader[syn] = word
            return
        for j in range(start, GOLAY_BITS):
            words(j + 1, left - 1, word | 1 << j, syn ^ power[j])

    for weight in range(5):
        words(0, weight, 0, 0)
    five = np.zeros((1 << low, 5), np.int64)
    for s, found in enumerate(near):
        if int(leader[s]).bit_count() == 3:
            five[s, : len(found)] = found
    return high, leader, five


def segment_codewords(seg: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word's codeword, and up to six indices of the codewords within distance 4 (-1: none)."""
    high, leader, five = tables
    syn = high[seg >> 11] ^ (seg & 0x7FF)
    own = (seg ^ leader[syn]) >> 11
    more = np.where(five[syn] > 0, (seg[:, None] ^ five[syn]) >> 11, -1)
    return own, np.concatenate([own[:, None], more], axis=1)


def fuzzy_keys(fps: np.ndarray, tables, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of signed fingerprints: key = segment pair, index, index."""
    u = fps.astype(np.uint64)
    segs = [(u & np.uint64(0x1FFFFF)), (u >> np.uint64(21)) & np.uint64(0x1FFFFF), u >> np.uint64(42)]
    own, near = zip(*(segment_codewords(s.astype(np.int64), tables) for s in segs), strict=True)
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        if not probe:
            rows.append(np.arange(len(u)))
            keys.append(p << 24 | own[i] << 12 | own[j])
            continue
        pair = np.where((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0),
                        p << 24 | near[i][:, :, None] << 12 | near[j][:, None, :], -1).reshape(len(u), -1)
        r, c = np.nonzero(pair >= 0)
        rows.append(r)
        keys.append(pair[r, c])
    return np.concatenate(rows), np.concatenate(keys)


# ------------------------------------------------------------------ links
def _key_rows(fps: DataFrame, probe: bool) -> DataFrame:
    tables = golay_tables()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, rep = b["fp"].to_numpy(), b["rep"].to_numpy()
            r, k = fuzzy_keys(fp, tables, probe)
            yield pd.DataFrame({"key": k, "probe": int(probe), "fp": fp[r], "rep": rep[r]})

    return fps.mapInPandas(run, "key long, probe int, fp long, rep long")


def _links_of_sorted(max_bits: int, pairs_at_once: int = 1 << 21):
    """mapInPandas function over rows sorted by (key, shard, probe): joins index and probe rows of each key."""
    def links(key, probe, fp, rep):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        n_index = np.add.reduceat((probe == 0).astype(np.int64), start)
        rows = np.flatnonzero((probe == 1) & (n_index[group] > 0))  # index rows come first in their group
        reach = np.cumsum(n_index[group[rows]])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + pairs_at_once)))
            r = rows[at:end]
            n = n_index[group[r]]
            left = np.repeat(r, n)
            right = np.repeat(start[group[r]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            hit = (fp[left] > fp[right]) & (np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= max_bits)
            if hit.any():
                yield C.spanning_edges(rep[left[hit]], rep[right[hit]])
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] | None = None
        for b in batches:
            now = [b[c].to_numpy() for c in ("k", "probe", "fp", "rep")]
            cols = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            last = [c[cut:] for c in cols]
            if cut:
                for a, z in links(*(c[:cut] for c in cols)):
                    yield pd.DataFrame({"a": a, "b": z})
            if len(last[0]) > 1 << 16:  # a long group: join its probe rows now, keep its index rows
                for a, z in links(*last):
                    yield pd.DataFrame({"a": a, "b": z})
                last = [c[last[1] == 0] for c in last]
            kept = last
        if kept is not None and len(kept[0]):
            for a, z in links(*kept):
                yield pd.DataFrame({"a": a, "b": z})

    return run


def link_edges(fps: DataFrame, max_bits: int = 3, shard_rows: int = 4096) -> DataFrame:
    """Spanning edges (a, b) of the links between distinct fingerprints (fp, rep); ``max_bits`` up to 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the Golay keys find pairs up to 3 differing bits")
    index, probe = _key_rows(fps, False), _key_rows(fps, True)
    heavy = index.groupBy("key").count().where(F.col("count") > shard_rows).select(
        "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("n"))
    shards = F.coalesce(F.col("n"), F.lit(1))
    rows = (
        index.join(heavy, "key", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
        .unionByName(probe.join(heavy, "key", "left").withColumn("shard", F.pmod(F.xxhash64("fp"), shards).cast("int")))
        .select((F.col("key") * (1 << 32) + F.col("shard")).alias("k"), "probe", "fp", "rep")
    )
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "k").sortWithinPartitions("k", "probe").mapInPandas(
        _links_of_sorted(max_bits), "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(id, digest of the text, fp, root, component) per input row; ``root`` names the group even if all ids are null."""
    spark = docs.sparkSession
    C.small_batches(spark)
    prints = C.written(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _digest(text_col).alias("digest"),
                                   fingerprint_column(text_col, shingle).alias("fp")), "simhash")
    # distinct fingerprints: numbered by their smallest id; one that only null ids hold gets an id of its own kind
    fps = C.written(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-fps")
    C.small_batches(spark, 8192)
    # nodes are fingerprints, so that null or repeated ids cannot join different ones
    edges = link_edges(fps.select("fp", F.col("fp").alias("rep")), max_bits)
    comp = C.connected_components(edges)
    named = fps.join(comp, fps.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    of = named.join(lows, "root").select(F.col("fp").alias("_fp"), "root", "component")
    return prints.join(of, prints.fp == of["_fp"]).select("id", "digest", "fp", "root", "component")


def _digest(text_col: str):
    """Null and empty texts differ here, so that a row is told from its twin of the same id."""
    return F.xxhash64(F.col(f"`{text_col}`").cast("string").isNull(), F.col(f"`{text_col}`").cast("string"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """One row (id, fingerprint long, component long) per input row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with equal ids stay separate rows; a null
    id never names a component (its row takes the smallest id it reaches, or null). Empty table: empty result.
    """
    return _grouped(docs, id_col, text_col, shingle, max_bits).select("id", F.col("fp").alias("fingerprint"), "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` per group: that of the smallest id. Rows without an id come last, rows of one id are told
    apart by their texts, and of rows equal in both any one stays. Columns unchanged; empty table: empty result.
    """
    rows = _grouped(docs, id_col, text_col, shingle, max_bits).groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("f"))
    keep = C.written(first.select(F.col("f.id").alias("__id"), F.col("f.digest").alias("__digest"), F.col("f.n").alias("__n")), "simhash-kept")
    mine = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{id_col}`").cast("long").alias("__doc_id"),
                       _digest(text_col).alias("__doc_digest"))

    def rows_of(part: DataFrame) -> DataFrame:
        same = F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__doc_digest") == F.col("__digest"))
        return mine.join(part, same, "left_semi")

    out = rows_of(keep.where("__n = 1"))
    twins = keep.where("__n > 1")
    if not twins.isEmpty():  # only rows that occur again whole pass through a second shuffle
        out = out.unionByName(rows_of(twins).dropDuplicates(["__doc_id", "__doc_digest"]))
    return out.drop("__doc_id", "__doc_digest")
