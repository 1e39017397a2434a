"""Toxicity by a weighted finite-state pattern grammar.

A clause's words are tagged as insult, threat, target, negation, reported speech or other. Three letter-to-letter
transducers rewrite the tags: one marks insults near a target and threats followed by a target, one marks what stands
in a negation's scope, one what is reported. Their composition is one machine; each clause is run through it and
matched clauses are scored by what they became, not by isolated words: a clause counts with the weight that the machine's
arcs add up to along it, a text with the sum over its clauses, further clauses of one kind counting less and less
(log2(1 + n) of them). The arcs' weights are log-odds: priors, refitted on held-in labelled rows; insult words that
labelled rows show are learned from them too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

#: Seed words of each tag.
INSULT = """idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum trash clown pathetic worthless
disgusting imbecile jerk filth filthy vermin coward fool bastard bitch asshole retard retarded
dummkopf abschaum arschloch idioten widerlich wertlos connard crétin imbécile ordure minable idiota imbécil estúpido estúpida
basura escoria asqueroso""".split()
THREAT = """kill murder hurt destroy burn shoot stab hang strangle beat die töten umbringen tuer tuerai matar mataré""".split()
TARGET = """you your yours yourself u ur he she him her they them their these those people dich dir euch sie toi vous ti te ustedes""".split()
NEGATION = """not no never isn't aren't wasn't don't doesn't cannot can't without nicht kein keine nie pas jamais nunca sin""".split()
REPORTED = """said says say wrote writes called calls quoted claims claimed according sagte schrieb dit écrit dijo escribió""".split()
OTHER, I, H, T, N, R = "oihtnr"
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
REACH = 4


# ------------------------------------------------------------------ transducers
@dataclass
class Transducer:
    """Deterministic letter-to-letter transducer: arcs[(state, symbol)] = (output, weight, next state); a symbol
    without an arc is copied in place."""

    start: tuple
    arcs: dict[tuple, tuple[str, float, tuple]] = field(default_factory=dict)

    def step(self, state: tuple, symbol: str) -> tuple[str, float, tuple]:
        return self.arcs.get((state, symbol), (symbol, 0.0, state))

    def compose(self, then: Transducer, symbols: list[str]) -> Transducer:
        """One machine that does what ``self`` followed by ``then`` does, over its reachable states."""
        out = Transducer((self.start, then.start))
        todo, seen = [out.start], {out.start}
        while todo:
            a, b = state = todo.pop()
            for s in symbols:
                mid, w, a2 = self.step(a, s)
                last, v, b2 = then.step(b, mid)
                out.arcs[state, s] = (last, w + v, (a2, b2))
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


#: Weights of the arcs, as prior log-odds: an insult, a threat, a target near an insult, a negation, reported speech.
PARTS = ("insult", "threat", "target", "negation", "reported")
PRIOR = {"insult": 5.0, "threat": 5.5, "target": 0.8, "negation": -1.5, "reported": -1.0}


def target_transducer(weights: dict[str, float] = PRIOR) -> Transducer:
    """i -> i+ within REACH words after a target; a target within REACH words after a threat -> h+ (a lone h is dropped)."""
    t = Transducer((0, 0))
    for near, pending in product(range(REACH + 1), repeat=2):
        fade = (max(near - 1, 0), max(pending - 1, 0))
        t.arcs[(near, pending), OTHER] = (OTHER, 0.0, fade)
        t.arcs[(near, pending), N] = (N, 0.0, fade)
        t.arcs[(near, pending), R] = (R, 0.0, fade)
        t.arcs[(near, pending), I] = ("i+", weights["insult"] + weights["target"], fade) if near else ("i", weights["insult"], fade)
        t.arcs[(near, pending), H] = (OTHER, 0.0, (near, REACH))
        t.arcs[(near, pending), T] = ("h+", weights["threat"], (REACH, 0)) if pending else (T, 0.0, (REACH, 0))
    return t


def negation_transducer(weights: dict[str, float] = PRIOR) -> Transducer:
    """Marks matches within REACH words after a negation with '-'."""
    t = Transducer((0,))
    for k in range(REACH + 1):
        for s in (OTHER, R, T):
            t.arcs[(k,), s] = (s, 0.0, (max(k - 1, 0),))
        t.arcs[(k,), N] = (N, 0.0, (REACH,))
        for s in ("i", "i+", "h+"):
            t.arcs[(k,), s] = (s + "-", weights["negation"], (max(k - 1, 0),)) if k else (s, 0.0, (0,))
    return t


def reported_transducer(weights: dict[str, float] = PRIOR) -> Transducer:
    """Marks matches after a verb of speech, to the end of the clause, with '\"'."""
    t = Transducer(("own",))
    t.arcs[("own",), R] = (R, 0.0, ("told",))
    for s, m in product(("i", "i+", "h+"), ("", "-")):
        t.arcs[("told",), s + m] = (f'{s}{m}"', weights["reported"], ("told",))
    return t


#: What a clause's word can have become.
MATCHES = [f"{s}{m}{q}" for s, m, q in product(("i", "i+", "h+"), ("", "-"), ("", '"'))]


def parts_of(kind: str) -> list[int]:
    """Which of PARTS a match of this kind has gone through."""
    return [int(kind[0] == I), int(kind[0] == H), int(kind.startswith("i+")), int("-" in kind), int('"' in kind)]


def grammar(weights: dict[str, float] = PRIOR) -> Transducer:
    symbols = [OTHER, I, H, T, N, R]
    return target_transducer(weights).compose(negation_transducer(weights), symbols).compose(reported_transducer(weights), symbols)


@dataclass
class Model:
    """Words with their tags, weights of the machine's arcs, and the log-odds of a text without matches."""

    tags: dict[str, str]
    weights: dict[str, float]
    bias: float = -4.0

    def __post_init__(self) -> None:
        self.machine = grammar(self.weights)
        self.hits = {w for w, t in self.tags.items() if t in (I, H)}

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """(kind, weight) of the heaviest match of each clause that has one, as the machine emits it."""
        low, found = (text or "").lower(), []
        if self.hits.isdisjoint(WORD.findall(low)):
            return found
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            if self.hits.isdisjoint(words):
                continue
            state, best = self.machine.start, None
            for w in words:
                tag, weight, state = self.machine.step(state, self.tags.get(w, OTHER))
                if tag in KINDS and (best is None or weight > best[1]):
                    best = (tag, weight)
            if best:
                found.append(best)
        return found

    def matches(self, text: str | None) -> dict[str, int]:
        """Match kind -> number of clauses."""
        return dict(Counter(kind for kind, _ in self.clauses(text)))

    def score(self, text: str | None) -> float:
        found = self.clauses(text)
        n, weight = Counter(kind for kind, _ in found), dict(found)
        z = self.bias + sum(weight[k] * math.log2(1 + n[k]) for k in n)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


KINDS = frozenset(MATCHES)


def seed_model() -> Model:
    tags = {}
    for words, tag in ((TARGET, T), (REPORTED, R), (NEGATION, N), (THREAT, H), (INSULT, I)):
        tags |= dict.fromkeys(words, tag)
    return Model(tags, dict(PRIOR))


# ------------------------------------------------------------------ learning
def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(_text, toxic) of held-in labelled rows: at most ``max_rows`` ids, those with the smallest hash. Labels that
    contradict each other count as toxic."""
    ids = (
        labels.select(F.col(id_col).cast("long").alias("_lid"), F.col("toxic").cast("int").alias("toxic"))
        .where("_lid is not null and toxic in (0, 1)").where(F.crc32(F.col("_lid").cast("string")) % 5 != 0)
        .groupBy("_lid").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows)
    )
    d = C.id_text(docs, id_col, text_col)
    return d.join(F.broadcast(ids), d["_id"] == ids["_lid"]).select("_text", "toxic")  # max_rows bounds the broadcast


def learn_words(rows: DataFrame, known: set[str], most: int = 500) -> list[str]:
    """Words that mark toxic texts: in at least 8 of them, in at least four times as many toxic as clean ones, and after at
    least 8 different words (so that the words of one copied text don't count)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, toxic in zip(b["_text"], b["toxic"], strict=True):
                words = WORD.findall((text or "").lower())
                seen = dict(zip(words, ["", *words[:-1]], strict=True))
                out.append(pd.DataFrame({"word": list(seen), "before": list(seen.values()), "toxic": int(toxic)}))
            yield pd.concat(out)

    pairs = rows.mapInPandas(run, "word string, before string, toxic int").groupBy("word", "before").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    stats = pairs.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                                      F.count(F.when(F.col("bad") > 0, 1)).alias("contexts"))
    found = stats.where("bad >= 8 and contexts >= 8 and bad >= 4 * good").orderBy(F.desc("bad"), "word").limit(most)
    return [r["word"] for r in found.collect() if r["word"] not in known]


def fit_weights(model: Model, rows: DataFrame, strength: float = 2.0) -> Model:
    """Logistic regression of the label on how often each arc was gone through (as ``score`` counts it), drawn to the prior
    weights. The rows are the bounded sample, reduced to counts per set of matches before they reach the driver."""
    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([",".join(f"{MATCHES.index(k)}:{n}" for k, n in sorted(model.matches(t).items())) for t in texts], dtype="object")

    sets = rows.select(told("_text").alias("told"), "toxic").groupBy("told").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()

    def passes(said: str) -> list[float]:
        out = np.zeros(len(PARTS))
        for k, n in (x.split(":") for x in said.split(",") if x):
            out += np.array(parts_of(MATCHES[int(k)])) * math.log2(1 + int(n))
        return [1.0, *out]

    x = np.array([passes(r["told"]) for r in sets]).reshape(-1, 1 + len(PARTS))
    n, bad = np.array([r["n"] for r in sets], float), np.array([r["bad"] for r in sets], float)
    prior = np.array([model.bias, *(PRIOR[p] for p in PARTS)])
    w = prior.copy()
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / strength,
                               x.T @ (bad - n * p) - (w - prior) / strength)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.tags, dict(zip(PARTS, w[1:].tolist(), strict=True)), float(w[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> Model:
    """Model from held-in labelled rows; without any it is the seed model."""
    C.small_batches(docs.sparkSession)
    model = seed_model()
    rows = C.written(training_rows(docs, labels, id_col, text_col, max_rows), "toxicity-training")
    model = Model(model.tags | dict.fromkeys(learn_words(rows, set(model.tags)), I), model.weights, model.bias)
    return fit_weights(model, rows)


def score_column(model: Model, text_col: str = "text") -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return run(F.col(f"`{text_col}`").cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Only the text decides the score, so repeated texts have
    equal ones; null and empty texts get the score of a text without matches; a text of any length is read whole; a null
    id is not held out. Empty table: empty result."""
    model = train(docs, labels, id_col, text_col, **options)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score_column(model, text_col).alias("score"))
    return d.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                    "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` scored under 0.5; no shuffle."""
    model = train(docs, labels, id_col, text_col, **options)
    return docs.where(score_column(model, text_col) < 0.5)
