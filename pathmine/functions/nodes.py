"""Node-label functions H4-H7 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathmine.functions.text import make_label, normalize_token, strip_ws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_node_label(c) -> Column:
    """H4: drop two characters at each end (quote + parenthesis), split on commas, strip each field."""
    s = _col(c)
    inner = F.substring(s, 3, F.greatest(F.length(s) - 4, F.lit(0)))
    return F.transform(F.split(inner, ","), lambda x: strip_ws(x))


def parenthesize(type_col, use_parentheses: bool = True) -> Column:
    """H6: wrap a type in parentheses once."""
    t = _col(type_col)
    if not use_parentheses:
        return t
    return F.when(t.startswith("(") & t.endswith(")") & (F.length(t) >= 1), t).otherwise(F.concat(F.lit("("), t, F.lit(")")))


def mask_self(type_col, token_col, name_col, placeholder: str = "<SELF>") -> tuple[Column, Column]:
    """H5: the method node named like the function gets a placeholder token; a node whose type is
    the function name (recursive call) gets the placeholder as type and token."""
    t, k, n = _col(type_col), _col(token_col), _col(name_col)
    is_method = (t == "METHOD") & (k == n)
    is_recursive = ~is_method & (t == n)
    new_t = F.when(is_recursive, F.lit(placeholder)).otherwise(t)
    new_k = F.when(is_method | is_recursive, F.lit(placeholder)).otherwise(k)
    return new_t, new_k


def normalize_node(
    type_col,
    token_col,
    name_col,
    *,
    split_token: bool = False,
    separator: str = "|",
    placeholder: str = "<SELF>",
    use_parentheses: bool = True,
) -> tuple[Column, Column]:
    """H7: mask -> parenthesize -> token normalisation. A node without a token field (null token)
    keeps its raw type and a null token."""
    t, k = _col(type_col), _col(token_col)
    mt, mk = mask_self(t, k, name_col, placeholder)
    nt = parenthesize(mt, use_parentheses)
    nk = make_label(mk, separator) if split_token else normalize_token(mk)
    has_token = k.isNotNull()
    return F.when(has_token, nt).otherwise(t), F.when(has_token, nk)
