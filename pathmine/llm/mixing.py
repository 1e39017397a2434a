"""Mixing to target weights by soft domain membership, in DataFrame functions only.

A naive-Bayes classifier is learned from labelled rows (a bounded sample): for each domain the words that mark it, and
how often each domain's texts hold each domain's marker words. Every document then gets its word count and a posterior
over domains. Projected-gradient least squares fits a nonnegative rate per document so that the expected word total
of each domain (rate x words x posterior) meets its target: an iteration is one aggregate over the written feature
table, and a document's rate is an expression of its posterior and the few residual vectors so far. A rate over 1
repeats a document. Every domain of the labelled rows counts: past ``max_domains`` the rarest are one domain ``other``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

BLANKS = r"\s+"
#: The name of the domain that joins the rarest ones.
OTHER = "other"


def _among(words: list[str]):
    return lambda w: w.isin(words or [""])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, max_rows: int = 20_000,
          words_per_domain: int = 100, max_domains: int = 64, sharpness: float = 20.0) -> dict:
    """Classifier from labelled rows: at most ``max_rows`` of them (smallest hashes of their ids), ``words_per_domain``
    marker words for each domain (by how much more frequent than elsewhere). Domains after the ``max_domains`` most
    frequent are learned as one, ``OTHER``."""
    ids = labels.select(F.col(id_col).cast("long").alias("_lid")).where("_lid is not null").distinct().orderBy(
        F.xxhash64("_lid"), "_lid").limit(max_rows)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                    F.col(f"`{domain_col}`").cast("string").alias("_domain")).where("_domain is not null")
    rows = C.written(d.join(F.broadcast(ids), d["_id"] == ids["_lid"]).select("_text", "_domain"), "mixing-training")
    found = [(r["_domain"], r["n"]) for r in rows.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_domain").collect()]  # at most max_rows
    if not found:
        return {"names": [], "markers": [], "prior": [], "theta": [], "sharpness": sharpness}
    own = found if len(found) <= max_domains else [d for d in found[:max_domains] if d[0] != OTHER]
    rest_n = sum(n for d, n in found if d not in dict(own))
    domains = own + ([(OTHER, rest_n)] if rest_n else [])
    names, n_of = [n for n, _ in domains], dict(domains)
    if rest_n:
        rows = rows.withColumn("_domain", F.when(F.col("_domain").isin([d for d, _ in own]), F.col("_domain")).otherwise(OTHER))
    # one row per word of the bounded sample
    counts = C.written(rows.select("_domain", F.explode(F.array_distinct(_words(F.col("_text")))).alias("w")).groupBy(
        "w").pivot("_domain", names).agg(F.count(F.lit(1))).toDF("w", *(f"n{i}" for i in range(len(names)))), "mixing-words")
    share = {d: F.coalesce(F.col(f"n{i}"), F.lit(0)) / n_of[d] for i, d in enumerate(names)}
    markers = []
    for d in names:
        rest = reduce(lambda a, b: a + b, [share[x] for x in names if x != d], F.lit(0.0))
        top = counts.select("w", (share[d] * F.log((share[d] + 0.01) / (rest + 0.01))).alias("gain")).where("gain > 0").orderBy(
            F.desc("gain"), "w").limit(words_per_domain)
        markers.append([r["w"] for r in top.collect()])
    held = rows.select("_domain", *_evidence(markers, F.col("_text")))
    sums = {r["_domain"]: [r[f"_c{e}"] for e in range(len(names))] for r in held.groupBy("_domain").agg(
        *(F.sum(f"_c{e}").alias(f"_c{e}") for e in range(len(names)))).collect()}
    theta = []
    for d in names:
        c = [x + 1.0 for x in sums[d]]
        theta.append([math.log(x / sum(c)) for x in c])
    total = sum(n for _, n in domains)
    return {"names": names, "markers": markers, "prior": [math.log(n / total) for _, n in domains], "theta": theta, "sharpness": sharpness}


def _evidence(markers: list[list[str]], text: Column) -> list[Column]:
    words = _words(text)
    return [F.size(F.filter(words, _among(m))).alias(f"_c{e}") for e, m in enumerate(markers)]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it and the optimizer copies it."""
    return F.get(F.transform(F.array(value), body), 0)


def _posterior(model: dict, words: Column) -> Column:
    """array<double>: softmax of the log prior and the evidence. The evidence of long texts counts as ``sharpness``
    words, so that a text in two languages keeps a soft membership. Texts without words have the prior."""
    def logits(c: Column) -> Column:
        n = [F.get(c, e) for e in range(len(model["markers"]))]
        scale = F.least(F.lit(1.0), F.lit(model["sharpness"]) / F.greatest(reduce(lambda a, b: a + b, n), F.lit(1.0)))
        return _let(scale, lambda s: F.array(*(model["prior"][i] + s * reduce(lambda a, b: a + b, [x * t for x, t in zip(n, row, strict=True)])
                                               for i, row in enumerate(model["theta"]))))

    def softmax(x: Column) -> Column:
        return _let(F.array_max(x), lambda top: _let(F.transform(x, lambda v: F.exp(v - top)), lambda e: _let(
            F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total))))

    known = [w for m in model["markers"] for w in m]
    counts = _let(F.filter(words, _among(known)), lambda w: F.array(*(F.size(F.filter(w, _among(m))).cast("double") for m in model["markers"])))
    return _let(_let(counts, logits), softmax)


def rate_of(steps: list[list[float]], p: list[Column], least: float = 0.0) -> Column:
    """Rate after the given steps: each is a step from the one before, from 1, projected on ``least`` or more."""
    rate = F.lit(1.0)
    for z in steps:
        rate = F.greatest(F.lit(float(least)), rate - reduce(lambda a, b: a + b, [x * v for x, v in zip(p, z, strict=True)], F.lit(0.0)))
    return rate


def rate_column(steps: list[list[float]], n_domains: int, least: float = 0.0) -> Column:
    return rate_of(steps, [F.col(f"_p{i}") for i in range(n_domains)], least)


def fit_rates(table: DataFrame, n_domains: int, target: list[float] | None, temper: float = 0.7, tolerance: float = 1e-6,
              size: float | None = 1.0, max_steps: int = 40, least: float = 0.0) -> tuple[list[list[float]], dict]:
    """Projected-gradient steps on 1/2 sum_d (expected share_d - target_d)^2, each domain's gradient scaled by its own
    natural share: (steps, totals). ``target``: weights per domain (default: natural shares to the power ``temper``).
    The mix has ``size`` times the words of the corpus; None: as many as leave no domain less than it has, so that scarce
    domains are repeated and none is thinned. ``least``: rates are that or more (1: no document is left out). Raises if
    a weighted domain has no words, or if the totals do not come within ``tolerance`` of a given target (documents of mixed
    domains can make it unreachable); with the default weights the nearest totals found are taken, as the result says."""
    k = range(n_domains)

    def totals(steps: list[list[float]]) -> list[float]:
        r = rate_column(steps, n_domains, least)
        row = table.agg(F.sum("_tokens").alias("n"), *(F.sum(r * F.col("_tokens") * F.col(f"_p{i}")).alias(f"a{i}") for i in k)).first()
        n = row["n"] or 0.0
        return [(row[f"a{i}"] or 0.0) / n if n else 0.0 for i in k]

    natural = totals([])
    if not sum(natural):
        return [], {"natural": natural, "target": natural, "reached": natural}
    weight = [float(w) for w in target] if target else [x ** temper if x > 0 else 0.0 for x in natural]
    if min(weight) < 0 or not sum(weight) or any(w > 0 and x <= 0 for w, x in zip(weight, natural, strict=True)):
        raise ValueError(f"weights {weight} cannot be met by domains with the shares {natural}")
    weight = [w / sum(weight) for w in weight]
    whole = max(x / w for x, w in zip(natural, weight, strict=True) if w > 0) if size is None else size
    goal, steps, now, missed = [whole * w for w in weight], [], natural, []
    while True:
        off = [a - g for a, g in zip(now, goal, strict=True)]
        missed.append(max(map(abs, off)))
        if missed[-1] < tolerance:
            return steps, {"natural": natural, "target": goal, "reached": now}
        if len(steps) == max_steps or len(missed) > 6 and missed[-1] > 0.9 * missed[-6]:
            if not target:
                return steps, {"natural": natural, "target": goal, "reached": now}
            raise ArithmeticError(f"target {goal} not reached, only {now}")
        steps.append([o / x if x > 0 else 0.0 for o, x in zip(off, natural, strict=True)])
        now = totals(steps)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, target: dict[str, float] | None = None,
        size: float | None = 1.0, least: float = 0.0, **learning) -> tuple:
    """(classifier, steps, totals, written feature table (doc_id, _u, _tokens, _p...)) over all rows. Raises on a target
    for a domain that the labelled rows do not have."""
    model = learn(docs, labels, id_col, text_col, domain_col, **learning)
    trained = bool(model["names"])
    unknown = sorted(set(target or ()) - set(model["names"]))
    if unknown and trained:
        raise ValueError(f"no labelled rows of {unknown}; known are {model['names']}")
    if not trained:
        model |= {"names": ["all"], "markers": [[]], "prior": [0.0], "theta": [[0.0]]}
    d = C.id_text(docs, id_col, text_col)
    found = F.transform(F.array(_words(F.col("_text"))), lambda w: F.struct(F.size(w).cast("double").alias("_tokens"), _posterior(model, w).alias("_p")))
    table = C.written(d.select(F.col("_id").alias("doc_id"), _draw("_id", "_text").alias("_u"), F.inline(found)).select(
        "doc_id", "_u", "_tokens", *(F.get("_p", i).alias(f"_p{i}") for i in range(len(model["names"])))), "mixing-features")
    goal = [float(target.get(n, 0.0)) for n in model["names"]] if target else None
    steps, totals = fit_rates(table, len(model["names"]), goal, size=size, least=least) if trained else ([], {})
    return model, steps, totals, table


def _draw_of(row_id: Column, text: Column) -> Column:
    """Uniform number in [0, 1) that the row's id and text decide."""
    return F.pmod(F.xxhash64(row_id, F.crc32(text)), F.lit(1 << 30)) / float(1 << 30)


def _draw(id_col: str, text_col: str) -> Column:
    return _draw_of(F.col(id_col), F.col(text_col))


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
              target: dict[str, float] | None = None, size: float | None = 1.0, **learning) -> DataFrame:
    """One row per input row: doc_id, n_tokens, domain (likeliest; the first named on ties), p_domain, rate, copies.

    ``copies`` rounds the rate by a draw from the row's hash, the same for repeated rows. Null and empty texts have no
    words and the prior as their posterior; a text of any length is one row of features. Rows with a null or rare domain
    are classified like any other. Without labelled rows there is one domain 'all' and every rate is 1. Empty table: empty
    result. ``learning`` goes to ``learn``.
    """
    model, steps, _, table = fit(docs, labels, id_col, text_col, domain_col, target, size, **learning)
    best = F.greatest(*(F.col(f"_p{i}") for i in range(len(model["names"])))) if len(model["names"]) > 1 else F.col("_p0")
    domain = F.coalesce(*(F.when(F.col(f"_p{i}") == F.col("_best"), F.lit(n)) for i, n in enumerate(model["names"])))
    return table.withColumn("_best", best).withColumn("_rate", rate_column(steps, len(model["names"]))).select(
        "doc_id", F.col("_tokens").cast("long").alias("n_tokens"), domain.alias("domain"), F.col("_best").alias("p_domain"),
        F.col("_rate").alias("rate"), _copies(F.col("_rate"), F.col("_u")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
        target: dict[str, float] | None = None, size: float | None = 1.0, least: float = 0.0, **learning) -> DataFrame:
    """``docs`` mixed to ``size`` times their words (see ``fit_rates``): each row as often as its copies say; columns
    unchanged."""
    model, steps, _, _ = fit(docs, labels, id_col, text_col, domain_col, target, size, least, **learning)
    text, k = F.col(f"`{text_col}`").cast("string"), range(len(model["names"]))
    rate = _let(_posterior(model, _words(text)), lambda p: rate_of(steps, [F.get(p, i) for i in k], least))
    draw = _draw_of(F.col(f"`{id_col}`").cast("long"), text)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.array_repeat(
        F.lit(0), _let(rate, lambda r: _copies(r, draw)).cast("int")).alias("_n"))
    return named.select("_row", F.explode("_n").alias("_k")).select("_row.*")
