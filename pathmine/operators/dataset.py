"""Dataset layer: labels, the AST-first rule, sampling, record text, model rows.

Long form used throughout: contexts(graph_id, label, kind, seq, start_token, path, end_token).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathmine.functions.text import encode_context, java_hash, make_label, pad_slots
from pathmine.options import KINDS, ExtractOptions, FormatOptions

CTX_COLS = ["graph_id", "label", "kind", "seq", "start_token", "path", "end_token"]


def labels(graphs: DataFrame, separator: str = "|") -> DataFrame:
    """H3 on the graph name: (graph_id, label)."""
    return graphs.select("graph_id", make_label("name", separator).alias("label"))


def labelled(ctx: DataFrame, graph_labels: DataFrame) -> DataFrame:
    """Contexts with the label of their function; functions without one are left out."""
    return ctx.join(graph_labels.where(F.col("label") != ""), "graph_id")


def require_ast(ast_ctx: DataFrame, graph_labels: DataFrame) -> DataFrame:
    """Functions with at least one AST context and a non-empty label: (graph_id, label)."""
    with_paths = ast_ctx.select("graph_id").distinct()
    return graph_labels.where(F.col("label") != "").join(with_paths, "graph_id", "left_semi")


def restrict(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, keep: DataFrame):
    """Semi-join a graph triple with the kept function ids before traversal (skip work early)."""
    k = keep.select("graph_id")
    return (
        graphs.join(k, "graph_id", "left_semi"),
        nodes.join(k, "graph_id", "left_semi"),
        edges.join(k, "graph_id", "left_semi"),
    )


def sample_per_kind(ctx: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """at most ``k`` contexts per (graph, kind), uniform without replacement; deterministic
    through ``md5(seed|graph|kind|seq)``. row_number <= k plans as a group limit (partial top-k
    before the shuffle), so a hot graph is cut map-side."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("graph_id"), F.col("kind"), F.col("seq").cast("string")))
    w = Window.partitionBy("graph_id", "kind").orderBy(key, F.col("seq"))
    return ctx.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def path_dataset(function_labels: DataFrame, contexts: list[DataFrame], opts: ExtractOptions = ExtractOptions()) -> DataFrame:
    """L2 tail: attach labels, sample, long form ``CTX_COLS``."""
    allc = contexts[0]
    for c in contexts[1:]:
        allc = allc.unionByName(c)
    allc = allc.join(function_labels, "graph_id")
    return sample_per_kind(allc, opts.max_path_contexts, opts.seed).select(*CTX_COLS)


# ------------------------------------------------------------------ record text (A5 / A4)
def render_records(ctx: DataFrame, numbering: DataFrame) -> DataFrame:
    """A5: one text value per function: ``#i``, ``label:``, ``file:<id>.c``, four ``path:`` sections
    of TAB-separated triples, blank line. ``numbering(graph_id, rec)`` gives ``#i``.
    The per-function context list is bounded by the sampling cap."""
    triples = ctx.select(
        "graph_id",
        "kind",
        "seq",
        F.concat_ws("\t", F.coalesce("start_token", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("end_token", F.lit(""))).alias("t"),
    )
    per_kind = triples.groupBy("graph_id", "kind").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "\n").alias("body")
    )
    wide = per_kind.groupBy("graph_id").pivot("kind", list(KINDS)).agg(F.first("body"))
    heads = numbering.join(ctx.select("graph_id", "label").distinct(), "graph_id")
    j = heads.join(wide, "graph_id", "left")
    parts = [F.concat(F.lit("#"), F.col("rec").cast("string")), F.concat(F.lit("label:"), F.col("label")),
             F.concat(F.lit("file:"), F.col("graph_id"), F.lit(".c"))]
    for k in KINDS:
        parts.append(F.lit(f"path: {k}"))
        parts.append(F.col(k))
    return j.select("graph_id", "rec", F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("record"))


# Fixed value: the section headers of the record format.
SECTION = "path: (ast|cfg|cdg|ddg)[ \\t]*"


def parse_records(records: DataFrame, keep: tuple = ()) -> DataFrame:
    """A4: record text -> long contexts with a raw line and its position.

    Output: (columns ``keep`` of the records, rec_id, label, file, kind, pos, line, pair_no, next_line). Header lines are recognised only at the
    record's head positions (Q25); section lines switch the kind. ``pair_no`` numbers the two-field lines of a record
    from 1, ``next_line`` is the two-field line after them (B10). Each record is cut inside its own row, so that
    records of several datasets with the same number never mix; no shuffle."""
    text = F.regexp_replace("record", "\r", "")
    sections = F.split(text, rf"\n(?={SECTION}(?:\n|$))")

    def lines_of(section, k):
        kind = F.when(k > 0, F.regexp_extract(section, f"^{SECTION}", 1))
        return F.transform(F.split(section, "\n"), lambda x, i: F.struct(kind.alias("kind"), x.alias("line"), (i == 0).alias("head")))

    lines = F.transform(F.flatten(F.transform(sections, lines_of)), lambda x, i: F.struct(
        x["kind"].alias("kind"), i.alias("pos"), x["line"].alias("line"), x["head"].alias("head"),
        (F.size(F.split(x["line"], "\t")) == 2).alias("two")))
    body = F.filter(lines, lambda x: (x["pos"] >= 3) & x["kind"].isNotNull() & ~x["head"] & (x["line"] != ""))
    r = records.select(
        *keep,
        F.regexp_extract("record", r"^#(\d+)", 1).try_cast("long").alias("rec_id"),
        F.regexp_extract(text, r"(?m)^label:(.*)$", 1).alias("label"),
        F.regexp_extract(text, r"(?m)^file:(.*)$", 1).alias("file"),
        body.alias("_body"),
    )
    twos = F.filter("_body", lambda x: x["two"])
    after = F.slice(twos, F.lit(2), F.size(twos))
    paired = F.transform(F.zip_with(twos, after, lambda x, y: F.struct(x.alias("x"), y["line"].alias("next"))), lambda p, i: F.struct(
        p["x"]["kind"].alias("kind"), p["x"]["pos"].alias("pos"), p["x"]["line"].alias("line"), (i + 1).alias("pair_no"), p["next"].alias("next_line")))
    others = F.transform(F.filter("_body", lambda x: ~x["two"]), lambda x: F.struct(
        x["kind"].alias("kind"), x["pos"].alias("pos"), x["line"].alias("line"), F.lit(None).cast("int").alias("pair_no"),
        F.lit(None).cast("string").alias("next_line")))
    return r.select(*keep, "rec_id", "label", "file", F.inline(F.concat(others, paired)))


def record_heads(records: DataFrame, keep: tuple = ()) -> DataFrame:
    """(kept columns, rec_id, label) of every record, with or without contexts."""
    return records.select(*keep, F.regexp_extract("record", r"^#(\d+)", 1).try_cast("long").alias("rec_id"),
                          F.regexp_extract("record", r"(?m)^label:([^\r\n]*)", 1).alias("label"))


def repair_contexts(parsed: DataFrame) -> DataFrame:
    """B10 + B9 input: split lines on TAB; two-field lines pair up in order inside one record
    (first gives start + path head, second gives path tail + end; a literal ``\\n`` is removed
    from the tail). Output: (kept columns, rec_id, label, file, kind, pos, start_token, path, end_token)."""
    f = parsed.withColumn("_f", F.split("line", "\t")).withColumn("_nxt", F.split("next_line", "\t"))
    odd = F.col("pair_no") % 2 == 1
    tail = F.trim(F.regexp_replace(F.get("_nxt", 0), r"\\n", ""))
    keep = [c for c in parsed.columns if c not in ("line", "pair_no", "next_line")]
    return f.where((F.size("_f") == 3) | odd).select(
        *keep,
        F.trim(F.get("_f", 0)).alias("start_token"),
        F.when(odd, F.concat(F.trim(F.get("_f", 1)), tail)).otherwise(F.trim(F.get("_f", 1))).alias("path"),
        F.trim(F.when(odd, F.get("_nxt", 1)).otherwise(F.get("_f", 2))).alias("end_token"),
    )


def valid_contexts(ctx: DataFrame) -> DataFrame:
    """Three non-empty fields."""
    ok = F.lit(True)
    for c in ("start_token", "path", "end_token"):
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    return ctx.where(ok)


def label_filter(ctx: DataFrame, exclude: tuple = ()) -> DataFrame:
    """Drop examples whose label is empty or excluded."""
    cond = F.col("label").isNotNull() & (F.trim("label") != "")
    ex = [e for e in exclude if e]
    if ex:
        cond = cond & ~F.col("label").isin(ex)
    return ctx.where(cond)


def head_per_kind(ctx: DataFrame, max_paths: dict, order_col: str = "seq") -> DataFrame:
    """First ``max_paths[kind]`` contexts per (example, kind) in stored order."""
    limit = F.lit(0)
    for k in KINDS:
        limit = F.when(F.col("kind") == k, F.lit(int(max_paths.get(k, 0)))).otherwise(limit)
    w = Window.partitionBy("graph_id", "kind").orderBy(order_col)
    return ctx.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= limit).drop("_rk")


def encode_slots(ctx: DataFrame) -> DataFrame:
    """(graph_id, label, kind, seq, slot); contexts that have their slot already stay as they are."""
    if "slot" in ctx.columns:
        return ctx.select("graph_id", "label", "kind", "seq", "slot")
    return ctx.select("graph_id", "label", "kind", "seq", encode_context("start_token", java_hash("path"), "end_token").alias("slot"))


def model_rows(ctx: DataFrame, max_paths: dict | None) -> DataFrame:
    """(graph_id, label, ast, cfg, cdg, ddg) slot arrays padded to the per-kind
    maximum; slot = ``start,hash,end``. Inputs must be valid, capped contexts (B9, E3), so each
    collected list is bounded by ``max_paths``. Contexts may come as ``encode_slots`` leaves them."""
    per = encode_slots(ctx).groupBy("graph_id", "label").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("seq", "slot")))), lambda x: x["slot"]
            ).alias(k)
            for k in KINDS
        ]
    )
    if max_paths is None:
        return per
    return per.select("graph_id", "label", *[pad_slots(k, int(max_paths.get(k, 0))).alias(k) for k in KINDS])


def render_row(rows: DataFrame, kinds: tuple = KINDS):
    return F.concat_ws(" ", F.col("label"), F.array_join(F.concat(*[F.col(k) for k in kinds]), " "))


def select_kinds(rows: DataFrame, include: tuple) -> DataFrame:
    """Keep the chosen kinds in ast, cfg, cdg, ddg order; drop an example whose first slot
    of any included kind is empty."""
    inc = [k for k in KINDS if k in include]
    ok = F.lit(True)
    for k in inc:
        ok = ok & (F.size(k) > 0) & (F.get(F.col(k), 0) != "")
    return rows.where(ok).withColumn("line", render_row(rows, tuple(inc)))


def skip_processed(functions: DataFrame, done: DataFrame) -> DataFrame:
    """C4: drop functions already present in the dataset (resume)."""
    return functions.join(done.select("graph_id").distinct(), "graph_id", "left_anti")
