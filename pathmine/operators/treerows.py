"""Walks of small graphs, one graph a row, in Arrow batches: contexts of plain trees (C1, C2) and reachability.

A Python worker walks a tree once, from the leaves up, and gives every piece's texts once and the pairs of pieces as
numbers; the contexts themselves, by far the most rows, are put together in Spark's generated code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "struct<heads:array<string>,tails:array<string>,tokens:array<string>,pairs:array<bigint>>"
ROWS_OUT = 256  # trees whose pieces are handed back together


def _joined(left: str | None, right: str | None, sep: str) -> str | None:
    """The texts of types joined as ``array_join`` does: null types are left out; null if all were."""
    return right if left is None else left if right is None else f"{left}{sep}{right}"


def _children(srcs: list, ords: list, dsts: list) -> dict:
    """src -> [dst] in order of ``ord``, then ``dst``, nulls first."""
    kids: dict = {}
    for s, o, d in zip(srcs, ords, dsts):
        if s is not None:
            kids.setdefault(s, []).append((o, d))
    for mine in kids.values():
        if len(mine) > 1:
            mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    return {s: [d for _, d in mine] for s, mine in kids.items()}


def pieces_of_tree(nodes: dict, kids: dict, root: str | None, max_length: int | None, max_width: int | None, up: str, down: str) -> tuple[list, list, list, list]:
    """C1 and C2 of one plain tree, nodes id -> (type, token): (heads, tails, tokens, pairs). A pair is left piece << 32 |
    right piece, in the order of ``seq``: post-order of the top, left child, right child, the two leaves depth first."""
    heads, tails, tokens, pairs = [], [], [], []
    most = None if max_length is None else max_length - 2
    if root not in nodes or root is None or (most is not None and most < 1):
        return heads, tails, tokens, pairs
    order, stack = [], [root]
    while stack:
        v = stack.pop()
        order.append(v)
        # a node has one edge to it, so only the root can come again
        stack.extend(d for d in kids.get(v, ()) if d in nodes and d != root)
    below: dict = {}
    for v in reversed(order):  # post-order, children from left to right
        kind, token = nodes[v]
        if v not in kids:
            if token:
                below[v] = [(1, kind, kind, token)]
            continue
        groups = [(o, below.pop(d)) for o, d in enumerate(kids[v]) if d in below]
        if len(groups) > 1:
            at = []
            for _, mine in groups:
                first = len(tokens)
                for _, climbed, fallen, tok in mine:
                    heads.append(None if kind is None else f"{climbed or ''}{up}{kind}")
                    tails.append(f"{down}{fallen or ''}")
                    tokens.append(tok)
                at.append([(first + i, p[0]) for i, p in enumerate(mine)])
            for i, (o, _) in enumerate(groups):
                near = i + 1
                while near < len(groups) and (max_width is None or groups[near][0] - o <= max_width):
                    for a, len_a in at[i]:
                        a <<= 32
                        if max_length is None:
                            pairs.extend([a | b for b, _ in at[near]])
                        else:
                            left = max_length - 1 - len_a
                            pairs.extend([a | b for b, len_b in at[near] if len_b <= left])
                    near += 1
        grown = [(n + 1, _joined(climbed, kind, up), _joined(kind, fallen, down), tok)
                 for _, mine in groups for n, climbed, fallen, tok in mine if most is None or n < most]
        if grown and v != root:
            below[v] = grown
    return heads, tails, tokens, pairs


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends, n = [0], 0
    for v in values:
        n += len(v)
        ends.append(n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for v in values for x in v], kind))


def _columns(lists: pa.ListArray) -> tuple[list[int], list[list]]:
    """(offsets, Python lists of the fields) of an array of lists of structs."""
    offsets = lists.offsets.to_numpy().tolist()
    first, last = offsets[0], offsets[-1]
    return [o - first for o in offsets], [_plain(c) for c in lists.values.slice(first, last - first).flatten()]


def _plain(values: pa.Array) -> list:
    """``to_pylist``, without a scalar object for each value where that can be had."""
    if values.null_count and not pa.types.is_string(values.type):
        return values.to_pylist()
    return values.to_numpy(zero_copy_only=False).tolist()


def tree_pieces(nodes, edges, root, max_length: int | None, max_width: int | None, up: str, down: str) -> Column:
    """``PIECES`` of each row of ``graph_rows``."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some_nodes, some_edges, roots in batches:
            for start in range(0, len(roots), ROWS_OUT):
                n_at, (ids, kinds, tokens) = _columns(some_nodes.slice(start, ROWS_OUT))
                e_at, (srcs, ords, dsts) = _columns(some_edges.slice(start, ROWS_OUT))
                found = []
                for i, top in enumerate(roots.slice(start, ROWS_OUT).to_pylist()):
                    n, m = slice(n_at[i], n_at[i + 1]), slice(e_at[i], e_at[i + 1])
                    mine = dict(zip(ids[n], zip(kinds[n], tokens[n])))
                    mine.pop(None, None)
                    found.append(pieces_of_tree(mine, _children(srcs[m], ords[m], dsts[m]), top, max_length, max_width, up, down))
                texts = [_lists([f[k] for f in found], pa.string()) for k in range(3)]
                yield pa.StructArray.from_arrays([*texts, _lists([f[3] for f in found], pa.int64())], ["heads", "tails", "tokens", "pairs"])

    return F.arrow_udf(run, PIECES)(nodes, edges, root)


def reached(ways: dict, starts: list) -> list:
    """Nodes at the end of a path of one or more edges from any of ``starts``; ``ways``: node -> [next]."""
    found, todo = set(), list(starts)
    while todo:
        for v in ways.get(todo.pop(), ()):
            if v not in found:
                found.add(v)
                if v is not None:
                    todo.append(v)
    return list(found)


def reached_nodes(ways, starts) -> Column:
    """``reached`` of each row: edges array<struct<node_id, nxt>>, starts array<string>."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some_ways, some_starts in batches:
            for start in range(0, len(some_ways), ROWS_OUT):
                at, (froms, tos) = _columns(some_ways.slice(start, ROWS_OUT))
                seeds = some_starts.slice(start, ROWS_OUT)
                s_at, first = seeds.offsets.to_numpy().tolist(), seeds.offsets[0].as_py()
                nodes = _plain(seeds.values.slice(first, s_at[-1] - first))
                found = []
                for i in range(len(at) - 1):
                    mine: dict = {}
                    for k in range(at[i], at[i + 1]):
                        mine.setdefault(froms[k], []).append(tos[k])
                    found.append(reached(mine, nodes[s_at[i] - first:s_at[i + 1] - first]))
                yield _lists(found, pa.string())

    return F.arrow_udf(run, "array<string>")(ways, starts)
