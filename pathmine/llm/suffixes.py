"""Removal of repeated 50-byte strings with a difference-cover suffix sort.

Equal 50-byte strings must be sorted in one place. An anchor is a 20-byte string whose hash is the smallest in some
50-byte window; equal windows hold equal anchors at equal places, so the anchor's hash says where both windows go.

1. The texts are written once, in blocks of some 2 MB hash-bucketed by block number. Everything later is joined to them
   by block, so no exchange ever carries a text.
2. Whole texts are collapsed first: of equal texts only those of the smallest id go on, the others are wholly repeated.
3. Every block gives its distinct anchor hashes, packed by hash range (as many ranges as the bytes ask for, so that a
   range's hashes fit a task at any size). A task per range answers each block with a bit per hash: does it stand in two
   documents, and in how many places. The bits are exact up to equal hashes, which only cost work.
4. A block cuts the context of each shared anchor (all windows that hold it), once for equal contexts, and deals contexts
   by anchor. A task keeps the smallest document of equal contexts and sorts the rest by the difference cover modulo 3:
   sort the triples at positions 1 and 2 modulo 3, name them, recurse on the names until they cover a window, sort the
   remaining suffixes by (symbol, rank of the next) and merge. Adjacent suffixes are compared over 50 bytes; a run of equal
   ones marks all but those of its smallest document.
5. An anchor with more than ``hot`` places is dealt over tasks by longer strings: contexts are collapsed with
   pre-aggregation, their windows split into classes by place of the anchor (16, 8, 4, 2, 1 places), each class keyed by
   the 35 to 50 bytes that its windows share, and classes of at most 12,000 contexts sorted in the same way; only larger
   ones are split on. A class of one place is one window, so the splitting ends.
6. Marks come back per block and are cut out of its texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

WINDOW, GRAM = 50, 20
SPARE = WINDOW - GRAM
BLOCK_BYTES = 2 << 20
LOW_BITS = 24
#: Contexts that are sorted together: some million symbols.
AT_ONCE = 12_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ anchors
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash (63 bits) of each GRAM-byte string, joined from powers of two."""
    def joined(left, right):
        return left * _MIX + (right ^ (right >> np.uint64(29)))

    h = data.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(0xCBF29CE484222325)
    width, of = 1, {1: h}
    while width * 2 <= GRAM:
        h = joined(h[:-width], h[width:])
        width *= 2
        of[width] = h
    n, at, out = len(data) - GRAM + 1, 0, np.zeros(len(data) - GRAM + 1, np.uint64)
    for width in sorted(of, reverse=True):
        while GRAM - at >= width:
            out = joined(out, of[width][at:at + n])
            at += width
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out ^ (out >> np.uint64(29))) >> np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    n, now, out = len(x) - width + 1, 1, x
    while now * 2 <= width:
        out = pick(out[:-now], out[now:])
        now *= 2
    return pick(out[:n], out[width - now:width - now + n])


def anchors(data: np.ndarray, ends: np.ndarray, step: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are smallest in some window of one of the joined texts; ties all count.
    ``ends``: where each text ends in ``data``; windows never cross an end. Done ``step`` windows at a time."""
    w, found, hashes = SPARE + 1, [], []
    crossing = np.zeros(len(data) + 1, np.int32)  # places of windows that would cross an end
    inner = ends[ends < len(data)]
    np.add.at(crossing, np.maximum(inner - WINDOW + 1, 0), 1)
    np.subtract.at(crossing, inner, 1)
    crossing = np.cumsum(crossing)
    for a in range(0, max(0, len(data) - WINDOW + 1), step):
        h = gram_hashes(data[a:a + step + WINDOW - 1])
        low = _sliding(h, w, np.minimum)
        low[crossing[a:a + len(low)] > 0] = 0
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero((_sliding(np.concatenate([edge, low, edge]), w, np.maximum) == h) & (h > 0))
        found.append(at + a)
        hashes.append(h[at].astype(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


# ------------------------------------------------------------------ difference cover
def _packed(*keys: np.ndarray) -> np.ndarray:
    """One number per row that sorts as the rows' keys do, the left key first. Leading keys become dense names where the
    bits of all would not fit, so symbols and ranks of any size keep their order."""
    out = keys[0]
    for key in keys[1:]:
        bits = int(key.max(initial=0)).bit_length()
        if int(out.max(initial=0)).bit_length() + bits > 62:
            out = np.unique(out, return_inverse=True)[1].reshape(-1)
            if int(out.max(initial=0)).bit_length() + bits > 62:
                raise OverflowError("suffix keys do not fit 62 bits")
        out = out << bits | key
    return out


def _smaller(n: int, *keys: np.ndarray) -> np.ndarray:
    """How many of the first ``n`` rows sort before each later row. Both are packed together: dense names are only
    comparable within one call."""
    packed = _packed(*keys)
    return np.searchsorted(np.sort(packed[:n]), packed[n:])


def suffix_ranks(s: np.ndarray, covered: int = 1, need: int = WINDOW) -> np.ndarray:
    """Ranks (from 1) of the suffixes of s (symbols from 0, each standing for ``covered`` bytes), in an order that is right
    over their first ``need`` bytes."""
    n = len(s)
    p = np.concatenate([s, np.zeros(3, np.int64)])
    i0, i1, i2 = (np.arange(k, n, 3) for k in range(3))
    sample = np.concatenate([i1, i2])
    key = _packed(p[sample], p[sample + 1], p[sample + 2])
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 3, np.int64)
    if covered * 3 < need and not new.all():
        names = np.empty(len(order), np.int64)
        names[order] = np.cumsum(new)
        del key, order, new  # long strings: hold little while the names are sorted
        r = suffix_ranks(np.concatenate([names[:len(i1)], [0], names[len(i1):]]), covered * 3, need)
        rank[sample] = np.delete(r, len(i1)) - 1  # the separator is the smallest symbol: its own rank is 1
    else:
        rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = i0[np.argsort(_packed(p[i0], rank[i0 + 1]))]
    before = _smaller(len(i1), *(np.concatenate([x[i1 + k], x[rest + k]]) for k, x in enumerate((p, rank))))
    before = before + _smaller(len(i2), *(np.concatenate([x[i2 + k], x[rest + k]]) for k, x in enumerate((p, p, rank))))
    before = np.maximum.accumulate(before) if len(before) else before
    out = np.zeros(n, np.int64)
    out[sample] = rank[sample] + np.searchsorted(before, rank[sample] - 1, side="right")
    out[rest] = before + np.arange(1, len(rest) + 1)
    return out


def repeated_starts(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each window whose bytes also occur in a context of a smaller document."""
    size = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    of = np.repeat(np.arange(len(contexts)), size + 1)
    offset = np.arange(len(data)) - begin[of]
    valid = np.flatnonzero(offset + WINDOW <= size[of])
    if not len(valid):
        return valid, valid
    ranks = suffix_ranks(data.astype(np.int64) + 1)
    order = valid[np.argsort(ranks[valid])]
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    new = np.ones(len(order), bool)
    step = 1 << 17
    for a in range(1, len(order), step):
        z = min(a + step, len(order))
        new[a:z] = (windows[order[a:z]] != windows[order[a - 1:z - 1]]).any(axis=1)
    doc = docs[of[order]]
    first = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.sort(order[doc > first])
    return of[hit], offset[hit]


# ------------------------------------------------------------------ marks of one task's contexts
_MARKS = "block long, marks binary"
_REFS = "block long, leads binary, later binary"


def _marks(parts: list[tuple]) -> pd.DataFrame:
    """A row per block: its marks (text in block, start, end) as int32 triples. Each part is (blocks, references, first,
    end): references are byte strings of int32 pairs (text in block, start of context) and first and end places in it."""
    blocks, marks = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int32)]
    for block, refs, first, end in parts:
        n = np.array([len(r) >> 3 for r in refs], np.int64)
        at = np.frombuffer(b"".join(refs), np.int32).reshape(-1, 2)
        blocks.append(np.repeat(np.asarray(block, np.int64), n))
        marks.append(np.stack([at[:, 0], at[:, 1] + np.repeat(first, n), at[:, 1] + np.repeat(end, n)], axis=1).astype(np.int32))
    block, mark = np.concatenate(blocks), np.concatenate(marks)
    order = np.argsort(block, kind="stable")
    kinds, start = np.unique(block[order], return_index=True)
    data, cut = mark[order].tobytes(), [*(12 * start).tolist(), 12 * len(order)]
    return pd.DataFrame({"block": kinds, "marks": [data[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]})


def _whole(rows: pd.DataFrame) -> tuple:
    """Places of equal contexts in other than the smallest document (column ``low``): repeated from end to end."""
    first = (rows["doc"] == rows["low"]).to_numpy()
    refs = [later if f else leads + later for f, leads, later in zip(first, rows["leads"], rows["later"], strict=True)]
    return rows["block"].to_numpy(), refs, np.zeros(len(rows), np.int64), rows["ctx"].str.len().to_numpy(np.int64)


def _runs(which: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, end) of neighbouring repeated windows."""
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(which) else np.zeros(0, np.int64)
    return which[new], offset[new], offset[np.r_[new[1:] - 1, len(which) - 1]] + WINDOW if len(which) else offset


def marks_of(rows: pd.DataFrame, at_once: int = AT_ONCE) -> pd.DataFrame:
    """Marks of context rows (h, ctx, anchor, doc, block, leads, later) that hold whole anchor groups. Groups are sorted
    together up to ``at_once`` contexts; a single larger group is split by longer anchors first (``_classes``)."""
    code = pd.factorize(rows["ctx"])[0]
    rows = rows.assign(code=code, low=rows.groupby(code)["doc"].transform("min"))
    parts = [_whole(rows)]
    kinds = rows.drop_duplicates(["h", "code", "anchor"])
    kinds = kinds[kinds.groupby("h")["code"].transform("size") > 1]
    starts = np.flatnonzero((kinds["h"] != kinds["h"].shift()).to_numpy())
    cut = [0]
    for a, z in zip(starts, [*starts[1:], len(kinds)] if len(starts) else [], strict=True):
        if z - cut[-1] > at_once and a > cut[-1]:
            cut.append(int(a))
    found = []
    for a, z in zip(cut, [*cut[1:], len(kinds)], strict=True):
        part = kinds.iloc[a:z]
        if len(part) > at_once and part["h"].iloc[0] == part["h"].iloc[-1]:
            found += _large_group(part, at_once)
            continue
        part = part.drop_duplicates("code")
        if len(part):
            which, first, end = _runs(*repeated_starts(part["ctx"].tolist(), part["low"].to_numpy()))
            found.append(pd.DataFrame({"code": part["code"].to_numpy()[which], "first": first, "end": end}))
    if found:
        hit = rows.loc[rows["doc"] == rows["low"], ["code", "block", "leads"]].merge(pd.concat(found), on="code")
        parts.append((hit["block"].to_numpy(), hit["leads"].tolist(), hit["first"].to_numpy(np.int64), hit["end"].to_numpy(np.int64)))
    return _marks(parts)


def _class(ctx: bytes, anchor: int, low: int, step: int) -> tuple[int, int, bytes] | None:
    """The windows of a context whose anchor begins ``low`` to ``low + step - 1`` bytes after their start: (from, to, the
    51 - step bytes that they share), None if the context holds none."""
    a, z = max(0, anchor - low - step + 1), min(len(ctx), anchor + WINDOW - low)
    shared = anchor + GRAM + max(0, SPARE + 1 - low - step)
    return (a, z, ctx[anchor - low:shared]) if low <= min(SPARE, anchor) and z - a >= WINDOW and z >= shared else None


def _large_group(kinds: pd.DataFrame, at_once: int) -> list[pd.DataFrame]:
    """Runs (code, first, end) of one anchor's contexts, split into classes of windows until a class has at most
    ``at_once`` contexts or one window."""
    out = []
    todo = [(16, low, list(zip(kinds["ctx"], kinds["anchor"], kinds["low"], kinds["code"], [0] * len(kinds), strict=True))) for low in (0, 16)]
    while todo:
        step, low, members = todo.pop()
        classes: dict[bytes, list] = {}
        for ctx, anchor, doc, code, o in members:
            found = _class(ctx, anchor, low, step)
            if found:
                a, z, shared = found
                classes.setdefault(shared, []).append((ctx[a:z], anchor - a, doc, code, o + a))
        for group in classes.values():
            if len(group) > at_once and step > 1:
                todo += [(step // 2, half, group) for half in (low, low + step // 2)]
            elif len(group) > 1:
                which, first, end = _runs(*repeated_starts([g[0] for g in group], np.array([g[2] for g in group])))
                code, o = np.array([g[3] for g in group])[which], np.array([g[4] for g in group])[which]
                out.append(pd.DataFrame({"code": code, "first": first + o, "end": end + o}))
    return out


def _whole_groups(batches: Iterator[pd.DataFrame], key: str, rows_at_once: int = 60_000) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key``, gathered to frames that end between two keys."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) > rows_at_once:
            rows = pd.concat(held, ignore_index=True)
            cut = int(rows[key].searchsorted(rows[key].iloc[-1]))
            if cut:
                yield rows.iloc[:cut]
            held = [rows.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _sorted_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _whole_groups(batches, "h"):
        yield marks_of(rows)


# ------------------------------------------------------------------ blocks of texts
def written_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, ids, texts) of the rows (_id, _text), written once in the shared folder, bucketed by block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, size, ids, texts = TaskContext.get().partitionId() << 33, 0, 0, [], []
        for b in batches:
            for i, t in zip(b["_id"].astype("Int64"), b["_text"], strict=True):
                ids.append(None if i is pd.NA else int(i))
                texts.append(t)
                size += len(t or "")
                if size >= block_bytes or len(ids) >= 1 << 16:
                    yield pd.DataFrame({"block": [part + n], "size": [size], "ids": [ids], "texts": [texts]})
                    n, size, ids, texts = n + 1, 0, [], []
        if ids:
            yield pd.DataFrame({"block": [part + n], "size": [size], "ids": [ids], "texts": [texts]})

    name, path = f"blocks_{uuid.uuid4().hex}", C.shared_path(spark, "blocks")
    rows = docs.mapInPandas(run, "block long, size long, ids array<long>, texts array<string>")
    rows.write.format("parquet").bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay in the shared folder, the frame holds their places
    return blocks


def joined(blocks: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with the columns of ``other`` (one row per block): only ``other`` is exchanged."""
    return blocks.join(other.hint("shuffle_hash"), "block", how)


class _Block:
    """The texts of one block joined, those that take part: with an id, not a copy of a smaller document's."""

    def __init__(self, ids, texts, copies):
        skip = set(() if copies is None else copies)
        self.place = [i for i, doc in enumerate(ids) if doc is not None and doc == doc and i not in skip]
        parts = [(texts[i] or "").encode("utf-8", "replace") for i in self.place]
        self.bytes, self.doc = b"".join(parts), np.array([int(ids[i]) for i in self.place], np.int64)
        self.ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        self.at, self.h = anchors(np.frombuffer(self.bytes, np.uint8), self.ends)
        self.of = np.searchsorted(self.ends, self.at, side="right")

    def distinct(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct leading bits of the hashes, the anchors sorted by them then by place, where each begins there)."""
        lead, place = self.h >> (63 - bits), max(1, len(self.h)).bit_length()
        if bits + place <= 63:  # sorting numbers is faster than sorting places by numbers
            both = np.sort(lead << place | np.arange(len(lead)))
            order, lead = both & ((1 << place) - 1), both >> place
        else:
            order = np.argsort(lead, kind="stable")
            lead = lead[order]
        start = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) if len(lead) else np.zeros(0, np.int64)
        return lead[start], order, start


def _hash_rows(bits: int):
    """A row per block and hash range: the distinct hashes' low bits, places, and whether two texts hold them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, ids, texts, copies in zip(b["block"], b["ids"], b["texts"], b["copies"], strict=True):
                x = _Block(ids, texts, copies)
                if not len(x.at):
                    continue
                found, order, start = x.distinct(bits)
                places = np.minimum(np.diff(np.r_[start, len(order)]), 65535).astype(np.uint16)
                several = x.of[order[start]] != x.of[order[np.r_[start[1:], len(order)] - 1]]
                low = (found & ((1 << LOW_BITS) - 1)).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]
                ranges, first = np.unique(found >> LOW_BITS, return_index=True)
                cut = list(zip(first, [*first[1:], len(found)], strict=True))
                yield pd.DataFrame({"g": ranges, "block": block, "low": [low[a:z].tobytes() for a, z in cut],
                                    "places": [places[a:z].tobytes() for a, z in cut], "several": [np.packbits(several[a:z]).tobytes() for a, z in cut]})

    return run


def _answers(hot: int):
    """For each row of one hash range: which of its hashes stand in two documents, and which in over ``hot`` places."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, "g", 2_000):
            for _, r in rows.groupby("g"):
                places = [np.frombuffer(p, np.uint16) for p in r["places"]]
                low = np.frombuffer(b"".join(r["low"]), np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
                several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)) for s, p in zip(r["several"], places, strict=True)])
                _, of = np.unique(low, return_inverse=True)
                shared = np.bincount(of, weights=1 + several)[of] > 1
                many = shared & (np.bincount(of, weights=np.concatenate(places))[of] > hot)
                ends = np.cumsum([len(p) for p in places])
                yield pd.DataFrame({"block": r["block"].to_numpy(), "g": r["g"].to_numpy(), "n_hot": [int(m.sum()) for m in np.split(many, ends[:-1])],
                                    "shared": [np.packbits(x).tobytes() for x in np.split(shared & ~many, ends[:-1])],
                                    "hot": [np.packbits(x).tobytes() for x in np.split(many, ends[:-1])]})

    return run


def _context_rows(bits: int, which: str):
    """Contexts of the anchors that the answer ``which`` names: (h, ctx, anchor, doc, block, leads, later), equal ones of a
    block once. ``leads`` are places in texts of the smallest document, ``later`` the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, ids, texts, copies, answers in zip(b["block"], b["ids"], b["texts"], b["copies"], b["answers"], strict=True):
                x = _Block(ids, texts, copies)
                found, order, start = x.distinct(bits)
                _, sizes = np.unique(found >> LOW_BITS, return_counts=True)
                said = np.concatenate([np.unpackbits(np.frombuffer(a[which], np.uint8), count=n) for a, n in zip(answers, sizes, strict=True)])
                keep = np.sort(order[np.repeat(said, np.diff(np.r_[start, len(order)])) > 0])
                begin = np.r_[0, x.ends[:-1]][x.of[keep]]
                left, right = np.maximum(x.at[keep] - SPARE, begin), np.minimum(x.at[keep] + WINDOW, x.ends[x.of[keep]])
                kind: dict[tuple[int, bytes, int], int] = {}
                code = np.array([kind.setdefault((h, x.bytes[a:z], at - a), len(kind)) for h, a, z, at in zip(
                    x.h[keep].tolist(), left.tolist(), right.tolist(), x.at[keep].tolist(), strict=True)], np.int64)
                if not len(code):
                    continue
                doc, low = x.doc[x.of[keep]], np.full(len(kind), np.iinfo(np.int64).max)
                np.minimum.at(low, code, doc)
                lead = doc == low[code]
                order = np.lexsort((~lead, code))
                refs = np.stack([np.array(x.place)[x.of[keep]], left - begin], axis=1).astype(np.int32)[order].tobytes()
                n, n_lead = np.bincount(code, minlength=len(kind)), np.bincount(code, weights=lead, minlength=len(kind)).astype(np.int64)
                end = 8 * np.cumsum(n)
                start = end - 8 * n
                cut = start + 8 * n_lead
                h, ctx, anchor = zip(*kind, strict=True)
                yield pd.DataFrame({"h": h, "ctx": ctx, "anchor": anchor, "doc": low, "block": block,
                                    "leads": [refs[a:z] for a, z in zip(start.tolist(), cut.tolist(), strict=True)],
                                    "later": [refs[a:z] for a, z in zip(cut.tolist(), end.tolist(), strict=True)]})

    return run


_CONTEXT = f"h long, ctx binary, anchor int, doc long, {_REFS}"


# ------------------------------------------------------------------ anchors with very many places
_DEALT = f"key long, ctx binary, anchor int, least int, o int, doc long, {_REFS}"


def _split(step: int):
    """Rows of the windows whose anchor begins ``least`` to ``least + 2 step - 1`` bytes after their start -> two halves,
    keyed by the bytes that all windows of a half share (51 - step of them)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, ctx, anchor, least, o, doc, block, leads, later in b[[c.split()[0] for c in _DEALT.split(", ")]].itertuples(index=False):
                for low in (least, least + step):
                    found = _class(ctx, anchor, low, step)
                    if found:
                        a, z, shared = found
                        name = hashlib.blake2b(b"%d,%d," % (key, low) + shared, digest_size=8).digest()
                        out.append((int.from_bytes(name, "little", signed=True), ctx[a:z], anchor - a, low, o + a, doc, block, leads, later))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEALT.split(", ")])

    return run


def _kind_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct contexts sorted by key -> the same with the runs of starts that smaller documents hold."""
    for rows in _whole_groups(batches, "key", 20_000):
        rows = rows.reset_index(drop=True)
        found: list[list] = [[] for _ in range(len(rows))]
        several = rows[rows.groupby("key")["ctx"].transform("size") > 1]
        for _, g in several.groupby("key"):
            at = g.index.to_numpy()
            for i, first, end in zip(*_runs(*repeated_starts(g["ctx"].tolist(), g["low"].to_numpy())), strict=True):
                found[at[i]].append([first, end])
        yield rows.assign(runs=[np.array(f, np.int32).tobytes() for f in found])


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dealt rows with their context's smallest document and runs -> marks."""
    for b in batches:
        block, refs, first, end = _whole(b)
        o = b["o"].to_numpy(np.int64)
        runs = [np.frombuffer(r, np.int32).reshape(-1, 2) if d == low else np.zeros((0, 2), np.int32) for r, d, low in zip(b["runs"], b["doc"], b["low"], strict=True)]
        of, run_ = np.repeat(np.arange(len(b)), [len(r) for r in runs]), np.concatenate([np.zeros((0, 2), np.int32), *runs])
        yield _marks([(block, refs, first + o, end + o),
                      (block[of], b["leads"].iloc[of].tolist(), run_[:, 0] + o[of], run_[:, 1] + o[of])])


def hot_marks(rows: DataFrame, hot: int) -> list[DataFrame]:
    """Marks of context rows whose anchors have too many places for one task."""
    parts, out = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), []
    todo = rows.select(F.col("h").alias("key"), "ctx", "anchor", F.lit(0).alias("least"), F.lit(0).alias("o"), "doc", "block", "leads", "later")
    for step in (16, 8, 4, 2, 1):
        todo = C.written(todo.mapInPandas(_split(step), _DEALT), "dealt")
        kinds = todo.groupBy("key", "ctx").agg(F.min("doc").alias("low"))
        sizes = C.written(kinds.groupBy("key").count().where(F.col("count") > min(hot, AT_ONCE)).select("key"), "large-classes")
        last = step == 1 or sizes.isEmpty()
        small = kinds if last else kinds.join(sizes, "key", "left_anti")
        runs = small.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_kind_runs, "key long, ctx binary, low long, runs binary")
        here = todo if last else todo.join(sizes, "key", "left_anti")
        out.append(here.join(runs, ["key", "ctx"]).mapInPandas(_told, _MARKS))
        if last:
            break
        todo = todo.join(sizes, "key", "left_semi")
    return out


# ------------------------------------------------------------------ the operator
def copies_of(blocks: DataFrame) -> DataFrame:
    """(block, copies): the texts in each block (by place) that a smaller document also holds whole."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "texts")).alias("i", "d")).where("d.ids is not null").select(
        "block", "i", F.col("d.ids").alias("doc"), F.sha2(F.coalesce("d.texts", F.lit("")), 256).alias("text"))
    # equal texts of one block come as one row, so a text that a third of all rows hold is no more rows than blocks
    per = each.groupBy("text", "block").agg(F.min("doc").alias("low"), F.collect_list(F.struct("doc", "i")).alias("held"))
    lows = per.groupBy("text").agg(F.min("low").alias("least"), F.sum(F.size("held")).alias("n")).where("n > 1").drop("n")
    later = per.join(lows, "text").select("block", F.filter("held", lambda x: x["doc"] > F.col("least")).alias("held")).where(F.size("held") > 0)
    return later.groupBy("block").agg(F.flatten(F.collect_list(F.transform("held", lambda x: x["i"]))).alias("copies"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for ids, texts, copies, found in zip(b["ids"], b["texts"], b["copies"], b["marks"], strict=True):
            copies = set(() if copies is None else copies)
            marks = np.frombuffer(b"".join(() if found is None else found), np.int32).reshape(-1, 3)
            marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
            first, last, out = np.searchsorted(marks[:, 0], np.arange(len(ids))), np.searchsorted(marks[:, 0], np.arange(len(ids)), side="right"), []
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                data = (text or "").encode("utf-8", "replace")
                united: list[list[int]] = [[0, len(data)]] if i in copies and len(data) >= WINDOW else []
                for start, end in marks[first[i]:last[i], 1:].tolist() if not united else ():
                    if united and start <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], end)
                    else:
                        united.append([start, end])
                ends = [0, *(e for _, e in united)]
                kept = b"".join(data[a:z] for a, z in zip(ends, [*(s for s, _ in united), len(data)], strict=True))
                out.append((None if doc is None or doc != doc else int(doc), len(data), len(data) - len(kept), len(united), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 250_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A null text is empty. Rows with a null id are kept whole and are no source. Rows with the same id are one document to
    the others (no smaller id); equal rows give equal results. A long text is a block of its own, hashed piece by piece.
    Other columns are not read. Empty table: empty result. ``hot`` bounds the contexts of one anchor that go to one
    task; it sorts at most 12,000 of them together.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    blocks = written_blocks(C.id_text(docs, id_col, text_col), block_bytes)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(4, (size // 8).bit_length() - 18) + LOW_BITS  # ranges of at most some 2^18 hashes
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = C.written(copies_of(blocks), "copies")
    blocks = joined(blocks, copies, "left")
    hashes = blocks.mapInPandas(_hash_rows(bits), "g long, block long, low binary, places binary, several binary")
    answers = C.written(hashes.repartition(parts, "g").sortWithinPartitions("g").mapInPandas(
        _answers(hot), "block long, g long, n_hot int, shared binary, hot binary"), "answers")
    per_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("g", "shared", "hot"))).alias("answers"))
    asked = joined(blocks, per_block)
    rows = asked.mapInPandas(_context_rows(bits, "shared"), _CONTEXT)
    marks = [rows.repartition(parts, "h").sortWithinPartitions("h").mapInPandas(_sorted_marks, _MARKS)]
    if not answers.where("n_hot > 0").isEmpty():
        marks += hot_marks(asked.mapInPandas(_context_rows(bits, "hot"), _CONTEXT), hot)
    spans = C.written(reduce(DataFrame.unionByName, marks).groupBy("block").agg(F.collect_list("marks").alias("marks")), "marks")
    return joined(blocks, spans, "left").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
