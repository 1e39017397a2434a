"""String / hash / slot functions, built from ``pyspark.sql.functions``; the string hash alone runs on Arrow batches.

Every function takes and returns ``Column`` objects so Catalyst can fold them into
whole-stage code next to the surrounding projection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns that must match the original tool's token rules.
# Subtoken boundaries: lower->Upper, '_', each digit, acronym end (Upper->Upper lower), whitespace runs.
SUBTOKEN_SPLIT = r"(?U)(?<=[a-z])(?=[A-Z])|_|[0-9]|(?<=[A-Z])(?=[A-Z][a-z])|\s+"
WHITESPACE = r"(?U)\s+"
QUOTES_COMMAS = "[\"',]"
NOT_ASCII_LETTER = "[^A-Za-z]"
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), EDGE_WHITESPACE, "")


def normalize_token(c, default: str = "") -> Column:
    """H1: lower, drop whitespace, quotes and commas; keep ASCII letters if any, else the cleaned text."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), WHITESPACE, ""), QUOTES_COMMAS, "")
    letters = F.regexp_replace(cleaned, NOT_ASCII_LETTER, "")
    return (
        F.when(letters != "", letters)
        .when(cleaned != "", cleaned)
        .otherwise(F.lit(default))
    )


def split_subtokens(c) -> Column:
    """H2: camelCase / snake / digit / acronym split, each piece normalised, empties dropped."""
    parts = F.split(strip_ws(c), SUBTOKEN_SPLIT)
    normed = F.transform(parts, lambda x: normalize_token(x))
    return F.filter(normed, lambda x: x != "")


def make_label(c, separator: str = "|") -> Column:
    """H3: subtokens joined by the separator (the method-name label)."""
    return F.array_join(split_subtokens(c), separator)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points of UTF-8 bytes, number of characters that begin before each byte and at the end; None if all are ASCII)."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), None
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b0, (b1, b2, b3) = padded[at], (padded[at + k] & 0x3F for k in (1, 2, 3))
    points = np.select(
        [b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
        [b0, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2], (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3)
    return points.astype(np.uint32), np.concatenate([[0], np.cumsum(begins)])


_POWERS: list = [np.ones(1, np.uint32), np.ones(1, np.uint32)]


def _powers(n: int) -> list:
    """The first ``n`` powers of 31 and of its inverse, modulo 2**32."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((31, pow(31, -1, 1 << 32))):
            factors = np.full(2 * n, base, np.uint32)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors, dtype=np.uint32)
    return _POWERS


def _hashes(texts: pa.Array) -> pa.Array:
    """``java_hash`` of a column of strings: one running sum over all characters of the batch, modulo 2**32."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points, chars = _code_points(data)
    at = offsets - offsets[0] if chars is None else chars[offsets - offsets[0]]
    up, down = (p[:len(points) + 1] for p in _powers(len(points) + 1))
    # sum of c[i] * 31**(end - 1 - i) = 31**(end - 1) * (sum of c[i] * 31**-i)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(points * down[:-1], dtype=np.uint32)])
    h = (sums[at[1:]] - sums[at[:-1]]) * up[np.maximum(at[1:] - 1, 0)]
    return pa.array(h.view(np.int32).astype(np.int64), mask=np.asarray(texts.is_null()) if texts.null_count else None)


def java_hash(c) -> Column:
    """32-bit signed polynomial string hash (base 31) over code points, as bigint. A loop over the characters in a
    lambda costs some 20 microseconds a path; a whole batch is summed at once."""
    return F.arrow_udf(_hashes, "bigint")(_col(c))


def encode_context(start, path_hash, end) -> Column:
    """``start,hash,end``."""
    return F.concat_ws(",", _col(start), _col(path_hash).cast("string"), _col(end))


def decode_context(c) -> Column:
    """struct(arity, start, path, end) of a ``start,path,end`` slot; null-safe ``get``."""
    parts = F.split(_col(c), ",")
    return F.struct(
        F.size(parts).alias("arity"),
        F.get(parts, 0).alias("start_token"),
        F.get(parts, 1).alias("path"),
        F.get(parts, 2).alias("end_token"),
    )


def pad_slots(arr, n: int) -> Column:
    """Extend an array of slots to exactly ``n`` entries with empty strings."""
    a = _col(arr)
    if n <= 0:
        return F.array().cast("array<string>")
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def slice_slots(arr, start: int, length: int) -> Column:
    """``length`` slots starting at 0-based ``start``."""
    if length <= 0:
        return F.array().cast("array<string>")
    return F.slice(_col(arr), start + 1, length)


def file_index(c) -> Column:
    """Numeric id out of a ``file:<n>.c`` line."""
    return F.regexp_extract(_col(c), r"file:\s*(\d+)\.c", 1).try_cast("long")
