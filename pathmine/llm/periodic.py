"""Periodic runs of words by block convolution.

A run with period q of at least max(12, 2 q) words matches itself at distance q over a stretch of at least max(12 - q, q)
words. At scale b (2, 4, 8, ...) the sequence is cut into blocks of b words; any stretch of 2 b - 1 words holds a whole
block, so every period from 2 b - 1 to 4 b - 2 (from 1 at the first scale) shows as an occurrence of some block at that
distance. Per block the sum of squared differences to each place of the following window is a convolution, computed for
all blocks at once by a number-theoretic transform modulo a prime: integers, no rounding. Places where it is zero are
seeds; a seed is compared word by word (zero modulo the prime is necessary, equality decides) and extended both ways as far
as words q apart agree.

What is not convolved cannot match, or adds nothing: a block one of whose words does not come again within the largest
distance of the scale, and a block whose whole window lies inside a run already found with a period of at most half a
block (there only multiples of that period match, and they extend to the same run).

Several documents are joined to one sequence with a separator each that equals nothing, so short texts share the array
work; a long one is a sequence of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pathmine.llm import common as C

MIN_WORDS = 12
#: 15 * 2^27 + 1, primitive root 31: transforms of up to 2^27 places, products below 2^62.
PRIME, ROOT = 2013265921, 31
_P = np.uint64(PRIME)
_ROOTS: dict[tuple[int, bool], list[np.ndarray]] = {}


# ------------------------------------------------------------------ number-theoretic transform
def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """Per stage (half = size / 2, size / 4, ..., 1) the powers of its root."""
    if (size, inverse) not in _ROOTS:
        out, width = [], size
        while width > 1:
            w = pow(ROOT, (PRIME - 1) // width, PRIME)
            if inverse:
                w = pow(w, PRIME - 2, PRIME)
            powers = np.ones(1, np.uint64)
            while len(powers) < width // 2:
                powers = np.concatenate([powers, powers * np.uint64(pow(w, len(powers), PRIME)) % _P])
            out.append(powers)
            width //= 2
        _ROOTS[size, inverse] = out
    return _ROOTS[size, inverse]


def ntt(x: np.ndarray) -> np.ndarray:
    """Forward transform of each row (length a power of two), places in bit-reversed order."""
    rows, size = x.shape
    for powers in _twiddles(size, False):
        half = len(powers)
        x = x.reshape(-1, 2, half)
        a, b = x[:, 0], x[:, 1]
        x = np.stack([(a + b) % _P, (a + (_P - b)) % _P * powers % _P], axis=1)
    return x.reshape(rows, size)


def intt(x: np.ndarray) -> np.ndarray:
    """Inverse of ``ntt`` (takes bit-reversed order)."""
    rows, size = x.shape
    for powers in reversed(_twiddles(size, True)):
        half = len(powers)
        x = x.reshape(-1, 2, half)
        a, b = x[:, 0], x[:, 1] * powers % _P
        x = np.stack([(a + b) % _P, (a + (_P - b)) % _P], axis=1)
    return x.reshape(rows, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row, sum over i of (block[i] - window[d + i])^2 modulo the prime, for every d at which the block fits."""
    rows, b = blocks.shape
    w = windows.shape[1]
    size = 1 << (w - 1).bit_length()
    x, y = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
    x[:, :b], y[:, :w] = blocks[:, ::-1], windows
    cross = intt(ntt(x) * ntt(y) % _P)[:, b - 1:w]  # places the block overhangs wrap round and are cut off
    squares = np.cumsum(np.concatenate([np.zeros((rows, 1), np.uint64), y[:, :w] * y[:, :w] % _P], axis=1), axis=1)
    own = (blocks * blocks % _P).sum(axis=1, keepdims=True)
    return (own + squares[:, b:] - squares[:, :-b] + (_P - cross) * np.uint64(2)) % _P


# ------------------------------------------------------------------ runs
def _reach(t: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Largest [s, e) around i with t[k] == t[k + q] for all k in it (i itself agrees)."""
    e, step = i + 1, 64
    while True:
        stop = min(e + step, len(t) - q)
        bad = np.flatnonzero(t[e:stop] != t[e + q:stop + q])
        if len(bad):
            e += int(bad[0])
            break
        e = stop
        if e >= len(t) - q:
            break
        step *= 2
    s, step = i, 64
    while s > 0:
        start = max(0, s - step)
        bad = np.flatnonzero(t[start:s] != t[start + q:s + q])
        if len(bad):
            s = start + int(bad[-1]) + 1
            break
        s, step = start, step * 2
    return s, e


def find_runs(t: np.ndarray, longest: int | None = None, places: int = 1 << 20) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of integers, sorted by start, then period.

    ``longest``: length of the longest part that can hold a run (default all); ``places``: transform places at a time."""
    n = len(t)
    longest = n if longest is None else longest
    found: dict[tuple[int, int], int] = {}
    if longest < MIN_WORDS:
        return []
    order = np.argsort(t, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the word's next place
    same = t[order[1:]] == t[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    b = 2
    while b == 2 or 2 * (2 * b - 1) <= longest:
        least, most = (1 if b == 2 else 2 * b - 1), 4 * b - 2
        count = n // b
        gate = again[:count * b].reshape(count, b).max(axis=1) <= most
        held = np.full(count, -1, np.int64)  # the run of period <= b / 2 that holds the block
        known = [(s, e, q) for (s, e), q in found.items() if 2 * q <= b]
        for k, (s, e, _) in enumerate(known):
            held[-(-s // b):max(-(-s // b), e // b)] = k
        blocks = np.flatnonzero(gate)
        if known and len(blocks):
            of = held[blocks]
            end = np.array([e for _, e, _ in known])[of]
            blocks = blocks[~((of >= 0) & (blocks * b + most + b <= end))]
        if len(blocks):
            _scale(t, b, least, most, blocks, held, known, found, places)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _scale(t, b: int, least: int, most: int, blocks, held, known, found: dict, places: int) -> None:
    """Seeds of one scale, block by block in order, extended into ``found``: (start, end) -> smallest period."""
    n, reach = len(t), most - least + b
    values = np.concatenate([t.astype(np.uint64), np.arange(len(t), len(t) + most + b, dtype=np.uint64) + np.uint64(1 << 30)]) % _P
    at_once = max(1, places // (2 * reach))
    done: dict[int, int] = {}  # distance -> end of the last stretch compared
    for a in range(0, len(blocks), at_once):
        start = blocks[a:a + at_once] * b
        zero = squared_differences(values[start[:, None] + np.arange(b)], values[start[:, None] + least + np.arange(reach)]) == 0
        row, d = np.nonzero(zero)
        pos, q = start[row], d + least
        fits = pos + q + b <= n
        run = held[pos // b]
        if known:
            ends, periods = np.array([e for _, e, _ in known]), np.array([p for _, _, p in known])
            fits &= ~((run >= 0) & (q % periods[run] == 0) & (pos + q + b <= ends[run]))
        for i, k in zip(pos[fits].tolist(), q[fits].tolist(), strict=True):
            if i < done.get(k, 0) or not np.array_equal(t[i:i + b], t[i + k:i + k + b]):
                continue
            s, e = _reach(t, i, k)
            done[k] = e
            if e + k - s >= max(MIN_WORDS, 2 * k):
                found[s, e + k] = min(k, found.get((s, e + k), k))


def repeated_tail(words: list, doc_id: int | None) -> list:
    """The contract's planted repetition: where crc32(decimal id) is divisible by 10, the words from some place on repeat
    a first stretch of theirs. A null id plants nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def runs_of_texts(texts: list[list[bytes]], together: int = 1 << 18) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each list of words; lists are joined up to ``together`` words at a time."""
    group: list[list[bytes]] = []
    size = 0
    for words in [*texts, None]:
        if group and (words is None or size + len(words) > together):
            code = pd.factorize(np.array([w for g in group for w in g], object))[0] if size else np.zeros(0, np.int64)
            sizes = np.array([len(g) for g in group])
            begin = np.cumsum(sizes + 1) - sizes - 1
            t = np.full(int((sizes + 1).sum()), -1, np.int64)
            t[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(size)] = code
            t[begin + sizes] = size + np.arange(len(group))  # separators: numbers no word has
            out: list[list] = [[] for _ in group]
            for s, length, q in find_runs(t, int(sizes.max())):
                g = int(np.searchsorted(begin, s, side="right")) - 1
                out[g].append((s - int(begin[g]), length, q))
            yield from out
            group, size = [], 0
        if words is not None:
            group.append(words)
            size += len(words)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


# ------------------------------------------------------------------ Spark
_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, details: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; null without a run), runs_sha256, collapsed_sha256; with ``details`` also runs (an array of start,
    length, period) and collapsed (the text without repetitions). ``plant`` first applies ``repeated_tail``.

    Words are separated by ASCII blanks. A null text has no words. Null ids, repeated ids and rows are kept as they are.
    No shuffle; a long text is one sequence (up to 2^28 words, the transform's limit). Empty table: empty result. Other columns are not read.
    """
    C.bounded_batches(docs.sparkSession)
    schema = _OUT + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if details else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [None if i is pd.NA else int(i) for i in b["_id"].astype("Int64")]
            texts = [(t or "").encode("utf-8", "replace").split() for t in b["_text"]]
            if plant:
                texts = [repeated_tail(w, i) for w, i in zip(texts, ids, strict=True)]
            out = []
            for i, words, runs in zip(ids, texts, runs_of_texts(texts), strict=True):
                top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                kept = b" ".join(collapsed(words, runs))
                row = (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                       hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                out.append(row + (([{"start": s, "length": k, "period": q} for s, k, q in runs], kept.decode("utf-8", "replace")) if details else ()))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")] + (["runs", "collapsed"] if details else []))
            yield frame.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})

    return C.id_text(docs, id_col, text_col).mapInPandas(run, schema)
