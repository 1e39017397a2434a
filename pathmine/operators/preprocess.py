"""Source preprocessing (B2, B3, B4, B12, I1, E1, E2; pipeline L1).

Only function extraction (I1) runs Python: ``mapInPandas`` over Arrow batches of files,
one regex scan plus a brace matcher per file. Everything else is Column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.operators.numbering import global_position, number_within

# Fixed values that must equal the original tool's for the same functions to be found.
# Header: optional static/const, one-word return type with optional pointer/reference,
# optional Class:: prefix, name, argument list, optional trailing const, then '{'.
FUNCTION_HEADER = (
    r"((static|const)?\s+(\w+(?:\s*[*&]?\s+|\s+[*&]?\s*))(?:\w+::)?(\w+)\s*\(([\w\s,<>\[\].=&':/*]*?)\)\s*(const)?\s*(?={))"
)
# Control words that look like function headers.
CONTROL_WORDS = ["if", "while", "do", "for", "switch", "else", "case", "IF", "WHILE", "DO", "FOR", "SWITCH", "ELSE", "CASE"]
INCLUDE_LINE = r"^[ \t]*#[ \t]*include"
DIRECTIVE_LINE = r"^[ \t]*#"
# C comments, keeping string and character literals intact (group 1 is put back).
# Possessive, so that a literal of any length needs no stack.
C_COMMENT = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|//[^\n]*+|/\*(?s:.*?)\*/"""
HTML_COMMENT = r"(?s)<!--.*?-->"
DEFAULT_SIZE_OVERHEAD = 49

_HEADER_RE = re.compile(FUNCTION_HEADER, re.DOTALL)
_CONTROL = set(CONTROL_WORDS)
_TOKEN_RE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[{}]""", re.DOTALL)


def split_directives(content, include_pattern: str = INCLUDE_LINE, drop_pattern: str = DIRECTIVE_LINE):
    """B2: lines matching ``include_pattern`` first (in order), then the other lines that do not
    match ``drop_pattern``."""
    text = content if not isinstance(content, str) else F.col(content)
    if drop_pattern == DIRECTIVE_LINE:  # a directive goes on after a backslash at the line's end
        text = F.regexp_replace(text, r"\\\r?\n", " ")
    lines = F.split(text, "\n")
    inc = F.filter(lines, lambda x: x.rlike(include_pattern))
    rest = F.filter(lines, lambda x: ~x.rlike(include_pattern) & ~x.rlike(drop_pattern))
    return F.array_join(F.concat(inc, rest), "\n")


def strip_comments(content, flavour: str = "c"):
    """Comment removal; the C flavour keeps string/char literals."""
    c = content if not isinstance(content, str) else F.col(content)
    if flavour == "html":
        return F.regexp_replace(c, HTML_COMMENT, "")
    # a comment becomes one blank: mark what was matched, take the marks after literals off again
    marked = F.regexp_replace(F.regexp_replace(c, C_COMMENT, "$1\u0001"), "([\"'])\u0001", "$1")
    return F.translate(marked, "\u0001", " ")


def size_ok(code_col, max_size: int, overhead: int = DEFAULT_SIZE_OVERHEAD):
    """B4 (Q19): byte length plus a fixed header overhead against the limit."""
    c = code_col if not isinstance(code_col, str) else F.col(code_col)
    return F.octet_length(c) + F.lit(overhead) <= F.lit(max_size)


def _brace_pairs(code: str) -> dict[int, int]:
    """Position of each opening brace -> position of its closing brace; braces in literals and comments don't count."""
    pairs, opened = {}, []
    for token in _TOKEN_RE.finditer(code):
        if token.group() == "{":
            opened.append(token.start())
        elif token.group() == "}" and opened:
            pairs[opened.pop()] = token.start()
    return pairs


def find_functions(code: str) -> list[tuple[str, str]]:
    """I1 for one text: (name, function text) in order: every header whose body closes, from the opening brace to its
    partner. The header is rebuilt without the class prefix; control words are no functions."""
    if not code:
        return []
    pairs, found = _brace_pairs(code), []
    for head in _HEADER_RE.finditer(code):
        close = pairs.get(head.end())
        if close is None or head[4] in _CONTROL:
            continue
        words = [head[2], head[3], head[4], f"({head[5].strip()})", head[6]]
        said = "".join(w.strip() + " " for w in words if w is not None)
        found.append((head[4], f"{said}\n{code[head.end():close + 1]}"))
    return found


FUNCTION_SCHEMA = "project string, path string, pos int, name string, code string"


def extract_functions(files: DataFrame) -> DataFrame:
    """I1 as a Spark job: files(project, path, content) -> (project, path, pos, name, code).
    Files are independent, so Spark spreads them over tasks; each Arrow batch is scanned in a
    Python worker."""

    def run(batches):
        for pdf in batches:
            rows = []
            for project, path, content in zip(pdf["project"], pdf["path"], pdf["content"]):
                for pos, (name, code) in enumerate(find_functions(content or "")):
                    rows.append((project, path, pos, name, code))
            yield pd.DataFrame(rows, columns=["project", "path", "pos", "name", "code"]).astype({"pos": "int32"})

    return files.select("project", "path", "content").mapInPandas(run, FUNCTION_SCHEMA)


def number_per_project(fns: DataFrame, at_most: DataFrame | None = None) -> DataFrame:
    """Dense id from 0 inside each project in (path, pos) order; a huge project is numbered
    through the global range-sorted position, not one window task. ``at_most(project, _n)``: see ``number_within``."""
    return number_within(fns, ["project"], ["path", "pos"], out="fn_id", bounded=False, at_most=at_most)


def number_global(fns: DataFrame) -> DataFrame:
    """Dense id over all projects in (project, path, pos) order."""
    return global_position(fns, ["project", "path", "pos"], "fn_id")


def preprocess(files: DataFrame, max_size: int, mode: str = "multiple", overhead: int = DEFAULT_SIZE_OVERHEAD) -> DataFrame:
    """L1: B1 (caller's scan) -> B2 -> B3 -> I1 (+B12) -> B4 -> E1/E2 -> functions(project, fn_id, code)."""
    from pathmine.sources.files import is_source_file

    src = files.where(is_source_file("path"))
    cleaned = src.select("project", "path", strip_comments(split_directives("content")).alias("content"))
    fns = extract_functions(cleaned).where(size_ok("code", max_size, overhead))
    if mode != "multiple":
        return number_global(fns).select("project", "fn_id", "code")
    # every function has an opening brace of its own, and cleaning adds none: sizes known without a scan in Python
    braces = F.length("content") - F.length(F.replace(F.col("content"), F.lit("{"), F.lit("")))
    at_most = src.groupBy("project").agg(F.coalesce(F.sum(braces), F.lit(0)).alias("_n"))
    return number_per_project(fns, at_most).select("project", "fn_id", "code")
