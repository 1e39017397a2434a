"""Document fingerprints: Merkle trees over sections, paragraphs and pieces.

A text is cut into pieces of some eight words, pieces form paragraphs (lines), paragraphs form sections, sections the
document. All cuts are made by content, not by position: a piece ends after a word whose last bytes hash to 0 modulo 8
(every word of a short paragraph is a piece of its own), a section ends before a heading or blank line and after a
paragraph whose digest is 0 modulo 8. An edit therefore changes only the branches that hold it. A piece's digest covers
all its bytes, an inner node's digest those of its children in order, so equal roots mean equal texts, and where roots
differ the differing branches lead to the edited pieces.

The printed fingerprint is the tree itself: ``root;section[paragraph{piece piece ...}...]...`` with 128 bits for the root
and 32 for every other node. ``likeness`` and ``changed`` read nothing else.

Following documents: a sort of the ids alone (ties by text hash, repeated rows by their place in the input, so no id or
text holds up one task) gives the first key of every range. The rows are dealt by range once, a copy of the first row of
the next range closes each range, and tasks walk their rows in order.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

PIECE_EVERY, SECTION_EVERY, SHORT_WORDS = 8, 8, 12
_NODE = re.compile(r"[0-9a-f]+|[\[\]{}]")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cuts(data: bytes) -> tuple[list[int], list[int]]:
    """(ends of paragraphs, ends of pieces) as byte offsets; every paragraph end is a piece end."""
    x = np.frombuffer(data, np.uint8)
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 if len(x) > 1 else np.zeros(0, np.int64)
    lines = np.flatnonzero(x == 10) + 1
    if not len(lines) or lines[-1] != len(x):
        lines = np.append(lines, len(x))
    line_of = np.searchsorted(lines, ends, side="left")
    short = np.bincount(line_of, minlength=len(lines))[line_of] <= SHORT_WORDS
    y = np.concatenate([np.zeros(3, np.uint8), x]).astype(np.uint32)
    mixed = (y[ends + 2] * np.uint32(0x9E3779B1) ^ y[ends + 1] * np.uint32(0x85EBCA6B) ^ y[ends] * np.uint32(0xC2B2AE35)) >> np.uint32(13)
    pieces = np.union1d(ends[short | (mixed % PIECE_EVERY == 0)], lines)
    return lines.tolist(), pieces.tolist()


def tree(text: str | None) -> tuple[bytes, list]:
    """(root digest, sections); a section is (digest, paragraphs), a paragraph (digest, pieces), a piece (digest, start,
    end) in bytes. A null text is the empty text, whose tree has no section."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return _digest(b""), []
    sections, paragraphs, at, piece = [], [], 0, 0
    lines, pieces = _cuts(data)

    def close():
        if paragraphs:
            sections.append((_digest(b"S" + b"".join(p[0] for p in paragraphs)), list(paragraphs)))
            paragraphs.clear()

    for end in lines:
        leaves = []
        while piece < len(pieces) and pieces[piece] <= end:
            leaves.append((_digest(b"L" + data[at:pieces[piece]]), at, pieces[piece]))
            at = pieces[piece]
            piece += 1
        line = data[leaves[0][1]:end]
        if line[:1] == b"#" or not line.strip():
            close()
        digest = _digest(b"P" + b"".join(d for d, _, _ in leaves))
        paragraphs.append((digest, leaves))
        if digest[0] % SECTION_EVERY == 0:
            close()
    close()
    return _digest(b"D" + b"".join(s[0] for s in sections)), sections


def printed(root: bytes, sections: list) -> str:
    short = lambda d: d[:4].hex()
    return root.hex() + ";" + "".join(
        f"{short(s)}[" + "".join(f"{short(p)}{{{' '.join(short(leaf[0]) for leaf in leaves)}}}" for p, leaves in ps) + "]" for s, ps in sections)


def fingerprint(text: str | None) -> str:
    return printed(*tree(text))


def parsed(print_: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """A printed fingerprint as (root, [(section, [(paragraph, [piece, ...]), ...]), ...])."""
    root, _, body = print_.partition(";")
    sections: list = []
    level, last = 0, ""
    for token in _NODE.findall(body):
        if token == "[":
            sections.append((last, []))
            level = 1
        elif token == "{":
            sections[-1][1].append((last, []))
            level = 2
        elif token in "]}":
            level -= 1
        elif level == 2:
            sections[-1][1][-1][1].append(token)
        else:
            last = token
    return root, sections


def likeness(a: tuple, b: tuple) -> float:
    """Shared pieces of two parsed fingerprints: twice their number over the number of both. Equal sections, then equal
    paragraphs, are matched whole, and only what differs is opened. 1 for equal roots and nothing else."""
    if a[0] == b[0]:
        return 1.0
    def matched(left: list, right: list):
        there, rest, same = Counter(k for k, _ in right), [], 0
        for key, children in left:
            if there[key] > 0:
                there[key] -= 1
                same += sum(len(c[1]) for c in children) if children and isinstance(children[0], tuple) else len(children)
            else:
                rest.extend(children)
        other, unused = [], there
        for key, children in right:
            if unused[key] > 0:
                unused[key] -= 1
                other.extend(children)
        return same, rest, other

    sections, p, q = matched(a[1], b[1])
    paragraphs, p, q = matched(p, q)
    shared = sections + paragraphs + sum((Counter(p) & Counter(q)).values())
    total = sum(len(leaves) for x in (a, b) for _, ps in x[1] for _, leaves in ps)
    return min(2 * shared / total, total / (total + 1)) if total else 0.0


def changed(before: str | None, after: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans that an edit took out of ``before`` and put into ``after``, found by opening only branches that differ.

    Children common to the front and to the back of both sides are passed over at every level; pieces between are the edit.
    Equal texts give two empty lists."""
    (ra, a), (rb, b) = tree(before), tree(after)
    if ra == rb:
        return [], []

    def between(x: list, y: list) -> tuple[list, list]:
        i = 0
        while i < min(len(x), len(y)) and x[i][0] == y[i][0]:
            i += 1
        k = 0
        while k < min(len(x), len(y)) - i and x[len(x) - 1 - k][0] == y[len(y) - 1 - k][0]:
            k += 1
        return x[i:len(x) - k], y[i:len(y) - k]

    x, y = between(a, b)
    x, y = between([p for s in x for p in s[1]], [p for s in y for p in s[1]])
    x, y = between([leaf for p in x for leaf in p[1]], [leaf for p in y for leaf in p[1]])
    return ([(x[0][1], x[-1][2])] if x else []), ([(y[0][1], y[-1][2])] if y else [])


def edit(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# ------------------------------------------------------------------ Spark
def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) per row, no shuffle. A null text is empty; null and repeated ids are kept as they
    are; long texts cost time in proportion; an empty table gives an empty result. Other columns are not read."""
    C.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["_id"].astype("Int64"), "n_chars": [len(t or "") for t in b["_text"]],
                                "fingerprint": [fingerprint(t) for t in b["_text"]]})

    return C.id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def locate_edits(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """The rows of ``pairs`` with ``_removed`` and ``_inserted``: arrays of (start, end) byte spans (see ``changed``)."""
    spans = F.udf(lambda x, y: changed(x, y), "removed array<struct<start:long,end:long>>, inserted array<struct<start:long,end:long>>")
    return pairs.withColumn("_e", spans(F.col(f"`{before}`"), F.col(f"`{after}`"))).select(
        *(F.col(f"`{c}`") for c in pairs.columns), F.col("_e.removed").alias("_removed"), F.col("_e.inserted").alias("_inserted"))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long"


def _compared(doc, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
    """One result row; ``mine`` and ``theirs`` are (printed, parsed) fingerprints of the text and of its follower."""
    after = edit(text, following)
    print_ = mine[0] if after == text else fingerprint(after)
    now = mine[1] if after == text else parsed(print_)
    spans = changed(text, after)
    start = next((s for side in spans for s, _ in side), None)
    return (doc, len(text), hashlib.sha256(after.encode("utf-8", "replace")).hexdigest(), mine[0], print_,
            likeness(mine[1], now), likeness(mine[1], theirs[1]), start)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range, each range closed by a copy of the first row of the next: every row but those copies is
    compared with the row after it."""
    held = None
    for b in batches:
        out = []
        for doc, text, copy in zip(b["_id"].astype("Int64"), b["_text"], b["_copy"], strict=True):
            print_ = fingerprint(text or "")
            now = (None if doc is pd.NA else int(doc), text or "", (print_, parsed(print_)))
            if held:
                out.append(_compared(*held, now[1], now[2]))
            held = None if copy else now
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64", "edit_start": "Int64"})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    edit_start (first byte of the text's differing branches; of the edited text's where nothing was taken out; null if
    the edit changed nothing).

    The next document is the one after in (id, text hash, input place) order, null ids first, the first after the last; a
    single document follows itself. Null text: empty. Repeated rows each get a row. Empty table: empty result. The input
    is read three times and must give the same rows in the same places (files do; write anything else first).
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["_id", "_h", "_at"]
    rows = C.id_text(docs, id_col, text_col).withColumns({"_h": F.xxhash64("_text"), "_at": F.monotonically_increasing_id()})
    # the first key of every range, from a sort of the keys alone: as many rows as there are partitions
    firsts = [tuple(r["k"]) for r in rows.select(*keys).repartitionByRange(parts, *keys).groupBy(F.spark_partition_id()).agg(
        F.min(F.struct(*keys)).alias("k")).select("k").collect()]
    order = lambda k: (k[0] is not None, k[0] or 0, *k[1:])
    firsts.sort(key=order)
    bounds, places = [order(k) for k in firsts], C.partition_keys(spark, parts)

    def ranged(i: pd.Series, h: pd.Series, at: pd.Series) -> pd.Series:
        found = [bisect.bisect_right(bounds, order((None if k is pd.NA else int(k), x, y))) - 1 for k, x, y in zip(i.astype("Int64"), h, at, strict=True)]
        return pd.Series(found, dtype="int64")

    spread = spark.createDataFrame([(p, places[p % parts]) for p in range(len(firsts))], "_range long, _place long")
    copied = spark.createDataFrame([(*k, (p - 1) % len(firsts)) for p, k in enumerate(firsts)], "id long, h long, at long, _range long")
    closing = rows.join(F.broadcast(copied), rows["_id"].eqNullSafe(copied["id"]) & (rows["_h"] == copied["h"]) & (rows["_at"] == copied["at"])).select(
        *keys, "_text", "_range", F.lit(True).alias("_copy"))
    dealt = rows.withColumn("_range", F.pandas_udf(ranged, "long")(*keys)).select(*keys, "_text", "_range", F.lit(False).alias("_copy")).unionByName(closing)
    placed = dealt.join(F.broadcast(spread), "_range").repartition(parts, "_place")
    return placed.sortWithinPartitions("_range", "_copy", *keys).select("_id", "_text", "_copy").mapInPandas(_walk, _OUT)
