"""Secret scan with one combined deterministic automaton.

The rule regexes are parsed into one nondeterministic automaton, made deterministic by subset construction (an
unanchored search for all rules at once), minimised, and stored as transition arrays over byte classes. A text's
bytes pass through it once. Where a rule's accepting run ends, the rule's reversed automaton walks back to the
leftmost start that an earlier match has not consumed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

#: Kinds of the base in their order, then the added ones; regex, letters in either case, and the test
#: that a match must pass (least length of the whole match, or of the value after the key).
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?<[A-Za-z0-9+/_.=-]+>""", "value", 12),
    ("access", r"AKIA[A-Z0-9]+", "whole", 18),
    ("hex", r"[0-9a-f]+", "whole", 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "whole", 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", "whole", 24),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", "whole", 15),
]
BASE = ("assign", "access", "hex")
ASSIGN_HEAD = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")


# ------------------------------------------------------------------ regex -> tree
def parse(regex: str, fold: bool) -> tuple:
    """Tree of a byte regex: ('set', bytes) ('cat', ...) ('alt', ...) ('rep', tree, least, endless). ``<x>`` marks a
    part that stays case sensitive."""
    at, folding = 0, fold

    def peek() -> str:
        return regex[at] if at < len(regex) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return regex[at - 1]

    def char() -> int:
        c = take()
        if c != "\\":
            return ord(c)
        if peek() == "x":
            take()
            return int(take() + take(), 16)
        return ord(take())

    def letter_set(codes: set[int]) -> tuple:
        if folding:
            codes |= {ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()}
        return ("set", frozenset(codes))

    def atom() -> tuple:
        nonlocal folding
        c = peek()
        if c == "(":
            take()
            tree = alternatives()
            take()
            return tree
        if c == "<":
            take()
            before, folding = folding, False
            tree = alternatives()
            folding = before
            take()
            return tree
        if c == "[":
            take()
            codes: set[int] = set()
            while peek() != "]":
                low = char()
                if peek() == "-" and regex[at + 1] != "]":
                    take()
                    codes |= set(range(low, char() + 1))
                else:
                    codes.add(low)
            take()
            return letter_set(codes)
        return letter_set({char()})

    def sequence() -> tuple:
        parts = []
        while peek() not in ("", "|", ")", ">"):
            tree = atom()
            if peek() and peek() in "?*+":
                sign = take()
                tree = ("rep", tree, int(sign == "+"), sign != "?")
            parts.append(tree)
        return ("cat", *parts)

    def alternatives() -> tuple:
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    return alternatives()


def at_least(tree: tuple, n: int) -> tuple:
    """A rule that ends in ``set+`` with that run at least n long: shorter ones can't pass the rule's test anyway."""
    *head, (_, last, _, _) = tree[1:]
    return ("cat", *head, *[last] * (n - 1), ("rep", last, 1, True))


def mirror(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", mirror(tree[1]), *tree[2:])
    parts = [mirror(x) for x in tree[1:]]
    return (tree[0], *(reversed(parts) if tree[0] == "cat" else parts))


# ------------------------------------------------------------------ tree -> deterministic automaton
class Automaton:
    """Deterministic automaton over byte classes: ``rows[state][class]``, states >= ``first`` accept ``rules[state]``."""

    def __init__(self, trees: list[tuple], search: bool) -> None:
        empty: list[list[int]] = []
        step: list[list[tuple[frozenset, int]]] = []
        ends: dict[int, int] = {}

        def new() -> int:
            empty.append([])
            step.append([])
            return len(empty) - 1

        def build(tree: tuple, a: int) -> int:
            if tree[0] == "set":
                z = new()
                step[a].append((tree[1], z))
                return z
            if tree[0] == "cat":
                for part in tree[1:]:
                    a = build(part, a)
                return a
            z = new()
            if tree[0] == "alt":
                for part in tree[1:]:
                    empty[build(part, a)].append(z)
                return z
            loop = new()
            empty[a].append(loop)
            end = build(tree[1], loop)
            if tree[3]:
                empty[end].append(loop)
            empty[end].append(z)
            if not tree[2]:
                empty[a].append(z)
            return z

        roots = []
        for r, tree in enumerate(trees):
            roots.append(new())
            ends[build(tree, roots[-1])] = r
        sets = {s for edges in step for s, _ in edges}
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        sample = [self.classes.index(k) for k in range(len(kinds))]

        def closure(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(x for x in seen if step[x] or x in ends)

        start = closure(roots)
        index, todo, table = {start: 0}, [start], []
        while todo:
            row = []
            now = todo.pop(0)
            for b in sample:
                to = closure([z for x in now for s, z in step[x] if b in s] + (roots if search else []))
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            table.append(row)
        accepts = [tuple(sorted({ends[x] for x in s if x in ends})) for s in index]
        self._minimise(np.array(table), accepts, None if search else index.get(frozenset()))

    def _minimise(self, table: np.ndarray, accepts: list[tuple], dead: int | None) -> None:
        """Moore's refinement; accepting states get the highest numbers."""
        kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}  # () sorts first
        block = np.array([kinds[a] for a in accepts])
        while True:
            _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            new = new.reshape(-1)
            done = new.max() == block.max()
            block = new
            if done:
                break
        rep = {b: s for s, b in reversed(list(enumerate(block.tolist())))}
        order = sorted(rep, key=lambda b: (bool(accepts[rep[b]]), b != block[0], b))
        name = {b: i for i, b in enumerate(order)}
        self.rows = [tuple(name[x] for x in block[table[rep[b]]].tolist()) for b in order]
        self.rules = [accepts[rep[b]] for b in order]
        self.first = sum(not r for r in self.rules)
        self.start = name[int(block[0])]
        self.dead = name[int(block[dead])] if dead is not None else -1


class Scanner:
    def __init__(self) -> None:
        trees = [parse(regex, kind == "assign") for kind, regex, _, _ in RULES]
        backs = [Automaton([mirror(t)], False) for t in trees]
        # words hold short hex runs everywhere: count them in the automaton; the other rules start with rare prefixes
        self.find = Automaton([at_least(t, least) if k == "hex" else t for t, (k, _, _, least) in zip(trees, RULES, strict=True)], True)
        self.back = backs

    def ends(self, data: bytes) -> list[list[int]]:
        """Per rule, where its accepting runs end: one pass over the bytes."""
        rows, first, rules, s = self.find.rows, self.find.first, self.find.rules, self.find.start
        out: list[list[int]] = [[] for _ in RULES]
        for i, c in enumerate(data.translate(self.find.classes)):
            s = rows[s][c]
            if s >= first:
                for r in rules[s]:
                    if out[r] and out[r][-1] == i:
                        out[r][-1] = i + 1
                    else:
                        out[r].append(i + 1)
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of the matches that pass their rule's test, leftmost, non-overlapping per rule."""
        found = []
        for r, ends in enumerate(self.ends(data)):
            back, used = self.back[r], 0
            for end in ends:
                s, start, i = back.start, -1, end
                while i > used:
                    i -= 1
                    s = back.rows[s][back.classes[data[i]]]
                    if s == back.dead:
                        break
                    if s >= back.first:
                        start = i
                if start < 0:
                    continue
                used = end
                _, _, test, least = RULES[r]
                size = end - start - (ASSIGN_HEAD.match(data, start, end).end() - start if test == "value" else 0)
                if size >= least:
                    found.append((start, r, end))
        return sorted(found)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets -> code points, end exclusive."""
    at = {b: 0 for s in spans for b in (s[0], s[2])}
    before = total = 0
    for b in sorted(at):
        total += len(data[before:b].decode("utf-8", "replace"))
        before, at[b] = b, total
    return [(at[a], r, at[z]) for a, r, z in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    ``spans`` lists kind:start:end in code points by start, then kind, comma-joined. A null text is empty: no spans and
    the checksum of the empty string. Nothing is shuffled.
    """
    C.small_batches(docs.sparkSession)
    scanner = Scanner()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["_id"], b["_text"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                spans = code_points(data, scanner.spans(data))
                said = [f"{RULES[r][0]}:{a}:{z}" for a, r, z in spans]
                base = [x for x, (_, r, _) in zip(said, spans, strict=True) if RULES[r][0] in BASE]
                n = [sum(r == k for _, r, _ in spans) for k in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said), len(said) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]).astype(
                {"doc_id": "Int64"})

    return C.id_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
