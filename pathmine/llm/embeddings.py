"""Near-duplicate vectors by iterative quantisation.

Rotations learned on a bounded sample turn unit vectors into balanced binary codes (one rotation per as many bits as the
vectors have entries). A code is cut into substrings, each the key of one Hamming table (multi-index hashing). How many
tables of how many bits are needed is measured, not assumed: pairs at exactly the asked cosine are made from the sample,
with differences like those between vectors and with random ones, and the widest substrings are taken with which few enough
tables hold nearly all of them. So data with a common direction, whose pairs differ more after centring, gets shorter
substrings; with none at all the single table holds every pair.

The tables hold codes, not vectors: a row is a key, a vector's number and its code. Blocks of a bucket are compared by the
Hamming distance of the codes, and only the vectors that have a partner within the distance of the asked cosine go on, in
the first table in which the two meet. These are joined with their vectors and reranked by exact cosine, block against
block, so a large bucket is split and no pair is emitted: a task returns link counts and spanning edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, n_bits: int, seed: int = 7, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x n_bits projection): principal directions turned by rotations that alternate between the codes'
    signs and the orthogonal fit to them, each started from another random rotation."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    _, _, vt = np.linalg.svd(centred, full_matrices=False) if len(sample) else (0, 0, np.eye(dim))
    basis = np.eye(dim) if len(vt) < dim else vt.T
    rng, parts = np.random.default_rng(seed), []
    for at in range(0, n_bits, dim):
        rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        v = centred @ basis
        for _ in range(rounds if len(sample) else 0):
            signs = np.sign(v @ rotation)
            a, _, b = np.linalg.svd(signs.T @ v)
            rotation = (a @ b).T
        parts.append((basis @ rotation)[:, : n_bits - at])
    return mean, np.concatenate(parts, axis=1)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, bits) of 0 and 1."""
    return ((x - mean) @ projection > 0).astype(np.uint8)


def table_keys(bits: np.ndarray, n_tables: int) -> np.ndarray:
    """(rows, tables) integer keys: the substrings of the codes."""
    width = bits.shape[1] // n_tables
    return bits[:, : n_tables * width].reshape(len(bits), n_tables, width).astype(np.int64) @ (1 << np.arange(width))


@dataclass
class Tables:
    """Codes of the vectors of one length: mean, projection, number of tables, and the Hamming distance of pairs at the
    asked cosine over the first ``sketch`` bits."""

    mean: np.ndarray
    projection: np.ndarray
    n_tables: int
    sketch: int
    distance: int


def made_pairs(sample: np.ndarray, least: float, seed: int = 3, most: int = 3000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors with partners at exactly the cosine ``least``, off towards other vectors, along differences of vectors
    and at random; and the sample's own pairs just above ``least``, if it has some."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:most]]
    other = sample[rng.integers(0, len(sample), len(x))]
    cosine = np.triu(x @ x.T, 1)
    i, j = np.nonzero((cosine >= least) & (cosine < least + 0.02))
    some = rng.permutation(len(i))[:most]
    out = [(x[i[some]], x[j[some]])] if len(some) >= 20 else []
    for away in (other, other - sample[rng.integers(0, len(sample), len(x))], rng.standard_normal(x.shape)):
        side = away - (away * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(side, axis=1)
        good = size > 1e-9
        out.append((x[good], least * x[good] + np.sqrt(1 - least * least) * side[good] / size[good, None]))
    return [p for p in out if len(p[0])]


def fit_tables(sample: np.ndarray, n: int, least: float, recall: float = 0.985, most_tables: int = 40, most_bits: int = 16) -> Tables:
    """The widest substrings (by the number ``n`` of vectors at most so wide that a bucket holds some 16) with which at most
    ``most_tables`` tables hold the ``recall`` part of the made pairs of either kind. With no bits one table holds all."""
    widest = int(np.clip(np.log2(max(n, 1)) - 4, 0, most_bits))
    if not len(sample) or not widest:
        return Tables(np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 0)), 1, 0, 0)
    mean, projection = learn_rotations(sample, widest * most_tables)
    pairs = [(codes_of(x, mean, projection), codes_of(y, mean, projection)) for x, y in made_pairs(sample, least)]
    for width in range(widest, 0, -1):
        needed = 1
        for a, b in pairs:
            met = (table_keys(a[:, : width * most_tables], most_tables) == table_keys(b[:, : width * most_tables], most_tables))
            share = np.logical_or.accumulate(met, axis=1).mean(axis=0)
            needed = max(needed, int(np.argmax(share >= recall)) + 1 if share[-1] >= recall else most_tables + 1)
        if needed <= most_tables:
            bits = width * needed
            sketch = min(bits, 512)
            far = max((np.quantile((a[:, :sketch] != b[:, :sketch]).sum(axis=1), 0.999) for a, b in pairs), default=sketch)
            return Tables(mean, projection[:, :bits], needed, sketch, int(far) + 1)
    return Tables(mean, projection[:, :0], 1, 0, 0)


def block_links(table: int, xa, ka, na, ia, xb, kb, nb, ib, same: bool, least: float):
    """Links between two blocks of a bucket: per row the vectors it links with, and spanning edges. Pairs that met in
    an earlier table are left to that one."""
    cos = xa @ xb.T
    i, j = np.nonzero(cos >= least)
    keep = (i < j) if same else np.ones(len(i), bool)
    if table:
        keep &= ~(ka[i, :table] == kb[j, :table]).any(axis=1)
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    ids = np.concatenate([ia[i], ib[j]])
    n = np.concatenate([nb[j], na[i]])
    nodes, inv = np.unique(ids, return_inverse=True)
    return nodes, np.bincount(inv, weights=n).astype(np.int64), *C.spanning_edges(ia[i], ib[j])


def partners(keys: np.ndarray, sketch: np.ndarray, table: int, distance: int, block: int = 1024) -> np.ndarray:
    """Which of two or more rows of one bucket have a partner in it: codes within ``distance`` that share no earlier key."""
    words, n = sketch.view(np.uint64), len(keys)
    out = np.zeros(n, bool)
    for a in range(0, n, block):
        for b in range(a, n, block):
            x, y = slice(a, min(a + block, n)), slice(b, min(b + block, n))
            off = np.zeros((x.stop - a, y.stop - b), np.uint16)
            for w in range(words.shape[1]):
                off += np.bitwise_count(words[x, None, w] ^ words[None, y, w])
            i, j = np.nonzero(off <= distance)
            keep = i + a < j + b
            i, j = i[keep] + a, j[keep] + b
            if table and len(i):
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            out[i] = out[j] = True
    return out


def _buckets(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``by`` in frames of whole groups, with the places where groups begin."""
    rest = None
    def starts(b):
        mark = np.zeros(len(b), bool)
        for c in by:
            v = b[c].to_numpy()
            mark[1:] |= v[1:] != v[:-1]
        mark[:1] = True
        return np.flatnonzero(mark)

    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        at = starts(b)
        if len(at) > 1:
            yield b.iloc[: at[-1]], at[:-1]
        rest = b.iloc[at[-1]:].reset_index(drop=True) if len(at) else None
    if rest is not None and len(rest):
        yield rest, np.array([0])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                    sample_rows: int = 20_000, block: int = 2048) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link with each other. Equal vectors are one class; their links among each other are counted, not
    enumerated. The codes of each length come from at most ``sample_rows`` classes (smallest hashes); every class is
    indexed. Null ids name no component. Other columns are not read. Empty table: empty result.
    """
    spark = vectors.sparkSession
    C.bounded_batches(spark)
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("_v")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))
    classes = C.written(rows.where("ok").groupBy("_v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
                        .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # the lengths of a table are few
    tables = {}
    for d, n in sizes.items():
        some = classes.where(F.size("_v") == d).orderBy(F.xxhash64("_v")).limit(sample_rows).select("_v").collect()
        tables[d] = fit_tables(unit(np.array([r["_v"] for r in some], float)), n, least)
    number = {d: i for i, d in enumerate(sorted(tables))}

    def by_length(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lengths = b["_v"].str.len().to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            yield int(d), at, unit(np.stack(b["_v"].iloc[at].to_numpy()).astype(float))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, at, x in by_length(b):
                t = tables[d]
                bits = codes_of(x, t.mean, t.projection)
                keys = table_keys(bits, t.n_tables)
                packed = np.packbits(np.pad(bits[:, : t.sketch], ((0, 0), (0, -t.sketch % 64))), axis=1)
                # a code is its sketch; where that is the whole code the keys are read off it again
                code, node = [r.tobytes() for r in packed], b["node"].to_numpy()[at]
                for k in range(t.n_tables):
                    yield pd.DataFrame({"key": (number[d] << 48) + (k << 32) + keys[:, k], "node": node, "code": code})

    def first_keys(t: Tables, code: np.ndarray) -> np.ndarray:
        """Keys of the tables that lie inside the sketch."""
        width = t.projection.shape[1] // t.n_tables
        inside = t.sketch // width if width else 0
        bits = np.unpackbits(code, axis=1)[:, : inside * width]
        return table_keys(bits, inside) if inside else np.zeros((len(code), 0), np.int64)

    length_of = sorted(tables)

    def meeting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in _buckets(batches, ["key"]):
            key, out = b["key"].to_numpy(), []
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                if e - s < 2:
                    continue
                t, k = tables[length_of[int(key[s] >> 48)]], int(key[s] >> 32) & 0xFFFF
                if not t.sketch:
                    out.append(b.iloc[s:e][["key", "node"]])
                    continue
                code = np.frombuffer(b"".join(b["code"].iloc[s:e]), np.uint8).reshape(e - s, -1)
                hit = partners(first_keys(t, code)[:, :k], code, k, t.distance)
                out.append(b.iloc[s:e][["key", "node"]][hit])
            if out:
                yield pd.concat(out)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = classes.select("_v", "node").mapInPandas(indexed, "key long, node long, code binary")
    met = C.written(_halved(index, parts, meeting), "vector-partners")
    counted = met.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = met.join(counted, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(classes.select("node", "n", "_v"), "node")
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "key", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "node", "n", "_v")

    def linked_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in _buckets(batches, ["key", "b1", "b2"]):
            key, own, b1, b2, n, ids = (b[c].to_numpy() for c in ("key", "b", "b1", "b2", "n", "node"))
            out = []
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                t, k = tables[length_of[int(key[s] >> 48)]], int(key[s] >> 32) & 0xFFFF
                x = unit(np.stack(b["_v"].iloc[s:e].to_numpy()).astype(float))
                keys = table_keys(codes_of(x, t.mean, t.projection), t.n_tables)
                first = own[s:e] == b1[s] if b1[s] != b2[s] else np.ones(e - s, bool)
                i, j = (np.flatnonzero(first), np.flatnonzero(~first)) if b1[s] != b2[s] else (np.arange(e - s),) * 2
                got = block_links(k, x[i], keys[i], n[s:e][i], ids[s:e][i], x[j], keys[j], n[s:e][j], ids[s:e][j], b1[s] == b2[s], least)
                if got:
                    nodes, links, a, z = got
                    out.append(pd.DataFrame({"a": np.r_[nodes, a], "b": np.r_[nodes, z], "links": np.r_[links, np.zeros(len(a), np.int64)]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = C.written(pairs.repartition(parts, "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
                      .mapInPandas(linked_rows, "a long, b long, links long"), "vector-links")
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    comp = C.connected_components(found.where("links = 0").select("a", "b"))
    named = classes.join(comp, classes.node == comp.node, "left").select(classes.node, "_v", "low", "n", F.coalesce("component", classes.node).alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    full = named.join(lows, "root").join(counts, named.node == counts.a, "left").select(
        F.col("_v").alias("_w"), "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.where("ok").join(full, F.col("_v") == F.col("_w")).select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), F.col("n_links").cast("long"), F.col("component").alias("component_id"),
                                            F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _halved(index: DataFrame, parts: int, meeting, bucket: int = 4096) -> DataFrame:
    """Partners of every bucket. A bucket of more than ``bucket`` rows is dealt in pieces, every pair of pieces together
    in one task, so that a key with very many vectors is spread over tasks; a row may come more than once."""
    sizes = index.groupBy("key").count().where(F.col("count") > bucket).select(F.col("key").alias("_key"), F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("_n"))
    large = C.written(sizes, "large-buckets")
    if large.isEmpty():
        return index.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(meeting, "key long, node long")
    small = index.join(large, index["key"] == large["_key"], "left_anti").repartition(parts, "key").sortWithinPartitions("key").mapInPandas(meeting, "key long, node long")
    pieces = index.join(large, index["key"] == large["_key"]).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    pairs = pieces.select("key", "node", "code", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")).select(
        "key", F.least("_b", "_o").alias("_b1"), F.greatest("_b", "_o").alias("_b2"), "node", "code")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in _buckets(batches, ["key", "_b1", "_b2"]):
            for s, e in zip(starts, [*starts[1:], len(b)], strict=True):
                yield from meeting(iter([b.iloc[s:e].reset_index(drop=True)]))

    spread = pairs.repartition(parts, "key", "_b1", "_b2").sortWithinPartitions("key", "_b1", "_b2").mapInPandas(run, "key long, node long")
    return small.unionByName(spread.distinct())
