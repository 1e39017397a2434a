"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs between ``\\w`` words become one blank). An item of m
characters may differ by ``k = floor(rate * m)`` edits. It is split into k + 1 pieces; k edits leave one piece
untouched, so exact piece hits (one Aho-Corasick pass over a document for all items) find every candidate place,
and Myers' bit-parallel distance verifies the place. Items come in blocks of bounded size; each block scans all rows.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

GAP = re.compile(r"(?: (?=\W|\Z)|[^\w ])\W*")  # all between two words, but for a single blank
HITS = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def normalise(text: str | None) -> str:
    """Blank-joined lower-case words, one blank at either end ('' without words)."""
    words = GAP.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The k + 1 (offset, piece) parts of an item, of near-equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a substring of the text, end of the first such substring)."""
    m = len(pattern)
    full, top, masks = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of one block: [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        texts: dict[str, list[int]] = {}
        for item_id, text in items:
            if n := normalise(text):
                texts.setdefault(n, []).append(item_id)
        self.items = [(n, sorted(ids), int(rate * len(n))) for n, ids in texts.items()]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.items):
            for at, piece in pieces(n, k):
                found.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each matching item, in the normalised text."""
        norm = normalise(text)
        if not norm or not self.items:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, where) in self.auto.iter(norm):
            for i, at in where:
                places.setdefault(i, set()).add(end + 1 - size - at)
        out = []
        for i, starts in places.items():
            item, ids, k = self.items[i]
            best = None
            for low, high in self._runs(sorted(starts), k):
                a, b = max(0, low - k), high + len(item) + k
                if a in starts and norm.startswith(item, a):  # an exact copy needs no table
                    d, e = 0, a + len(item)
                else:
                    d, e = myers(item, norm[a:b])
                    e += a
                if d <= k and (best is None or d < best[0]):
                    best = (d, max(0, e - len(item)), e)
            if best:
                out += [(item_id, *best) for item_id in ids]
        return sorted(out)

    @staticmethod
    def _runs(starts: list[int], k: int):
        """Candidate starts whose windows touch, as (first, last)."""
        low = high = starts[0]
        for s in starts[1:]:
            if s - high > 2 * k + 1:
                yield low, high
                low = s
            high = s
        yield low, high


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_chars: int = 1 << 20) -> list[list[tuple[int, str]]]:
    """The stated query set in blocks of at most ``block_chars`` characters (one item may be longer)."""
    blocks, size = [[]], 0
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        if size and size + len(r["t"]) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"], r["t"]))
        size += len(r["t"])
    return blocks


def hits_column(items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                rate: float = 0.08) -> Column:
    """Array column of the matching items of a text column."""
    def one(block: list[tuple[int, str]]) -> Column:
        held: list[Matcher] = []

        @F.pandas_udf(HITS)
        def run(texts: pd.Series) -> pd.Series:
            if not held:
                held.append(Matcher(block, rate))
            return pd.Series([[dict(zip(("item_id", "distance", "start", "end"), h, strict=True)) for h in held[0].hits(t)]
                              for t in texts], dtype=object)

        return run(F.col(f"`{text_col}`").cast("string"))

    columns = [one(b) for b in item_blocks(items, item_id, item_text)]
    return reduce(lambda a, b: F.concat(a, b), columns)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, distance, start, end): one row per row of ``docs`` and item found in it, at its best place
    in the normalised text (start is the end less the item's length).

    Null and empty texts or items match nothing; repeated rows each report; equal items each report their id.
    """
    C.small_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), hits_column(items, text_col, **options).alias("_h"))
    return found.select("doc_id", F.explode("_h").alias("_m")).select("doc_id", "_m.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found; no shuffle."""
    C.small_batches(docs.sparkSession)
    return docs.where(F.size(hits_column(items, text_col, **options)) == 0)
