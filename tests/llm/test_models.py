"""Learned operators, vectors, WARC records and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathmine.llm import embeddings, mixing, toxicity, warc
from pathmine.llm.common import connected_components, table, written

SMOKE, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_components(spark):
    random.seed(4)
    pairs = [(random.randint(0, 120), random.randint(0, 120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    low = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_grammar_marks():
    m = toxicity.seed_model()
    assert set(m.matches("you are an idiot")) == {"i+"}
    assert set(m.matches("That is not stupid. He said that a fool came")) <= {"i-", 'i"', 'i+"', "i+-"}
    assert set(m.matches("we kill you")) == {"h+"} and m.matches("we kill time") == {}
    assert set(m.matches("a moron came")) == {"i"} and m.matches(None) == {} == m.matches("")
    assert m.score("you are an idiot") > 0.5 > m.score("a fine day")
    # the arcs' weights are the score's: heavier arcs, more clauses and a target raise it, negation and report lower it
    z = lambda model, t: float(np.log(model.score(t) / (1 - model.score(t))))
    mild = toxicity.Model(m.tags, {"insult": 1.0, "threat": 2.0, "target": 0.5, "negation": -0.7, "reported": -0.3}, -6.0)
    assert z(mild, "a moron came") == pytest.approx(-5) and z(mild, "you moron") == pytest.approx(-4.5)
    assert z(mild, "not a moron") == pytest.approx(-5.7) and z(mild, "he said a moron came") > z(mild, "she said not a moron came")
    assert z(mild, "you moron. " * 50) == pytest.approx(-6 + 1.5 * np.log2(51)) and z(mild, "we kill you") == pytest.approx(-4)
    assert m.score("") == m.score(None) == m.score("word " * 200_000)


def test_composition_is_sequence():
    random.seed(1)
    parts = [toxicity.target_transducer(), toxicity.negation_transducer(), toxicity.reported_transducer()]
    whole = toxicity.grammar()
    for _ in range(200):
        tags, states, state = [random.choice("oihtnr") for _ in range(15)], [p.start for p in parts], whole.start
        for t in tags:
            got, weight, state = whole.step(state, t)
            total = 0.0
            for k, p in enumerate(parts):
                t, w, states[k] = p.step(states[k], t)
                total += w
            assert (got, weight) == (t, pytest.approx(total))


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    s = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    n, right = s.count(), s.where("predicted = toxic").count()
    assert right / n > 0.9
    odd = spark.createDataFrame([(1, None, 1.0), (None, "", 1.0), (1, "you idiot", 1.0)], "doc_id long, text string, score double")
    empty = toxicity.score_documents(odd, labels.limit(0)).orderBy("score").collect()
    assert [r["predicted"] for r in empty] == [0, 0, 1] and toxicity.remove_toxic(odd, labels.limit(0)).columns == odd.columns


def test_mixing_meets_targets(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model, steps, totals, features = mixing.fit(docs, labels, "doc_id", "text", "lang")
    assert max(abs(a - b) for a, b in zip(totals["reached"], totals["target"], strict=True)) < 1e-5
    k = len(model["names"])
    x = np.array([[r["_tokens"], *(r[f"_p{i}"] for i in range(k))] for r in features.collect()])
    rate = np.ones(len(x))  # the same descent in numpy
    t = x[:, :1] * x[:, 1:] / x[:, 0].sum()
    for z in steps:
        rate = np.maximum(0, rate - x[:, 1:] @ np.array(z))
    assert np.allclose(rate @ t, totals["reached"]) and np.allclose(x[:, 1:].sum(axis=1), 1)
    got = mixing.mix_rates(docs, labels)
    assert got.count() == docs.count() and got.where("rate < 0").count() == 0
    right = got.join(docs, "doc_id").where("domain = lang").count() / docs.count()
    assert right > 0.9


def features_of(spark, natural):
    rows = [(100.0, *(float(i == k) for k in range(len(natural)))) for i, x in enumerate(natural) for _ in range(round(1000 * x))]
    return spark.createDataFrame(rows, "_tokens double, " + ", ".join(f"_p{k} double" for k in range(len(natural))))


def test_targets_are_met_or_refused(spark):
    table_ = features_of(spark, [0.73, 0.27])
    _, totals = mixing.fit_rates(table_, 2, [0.5, 0.5])
    assert totals["reached"] == pytest.approx([0.5, 0.5], abs=1e-6)  # the scarce domain is repeated
    _, totals = mixing.fit_rates(features_of(spark, [0.6, 0.399, 0.001]), 3, None, size=None)
    ratio = [a / b for a, b in zip(totals["reached"], [0.6, 0.399, 0.001], strict=True)]
    assert min(ratio) == pytest.approx(1, abs=1e-4) and ratio[2] > 2  # no domain is thinned
    assert totals["target"][0] / totals["target"][1] == pytest.approx((0.6 / 0.399) ** 0.7)
    with pytest.raises(ValueError):
        mixing.fit_rates(features_of(spark, [1.0, 0.0]), 2, [0.5, 0.5])
    both = spark.createDataFrame([(10.0, 0.5, 0.5), (10.0, 0.6, 0.4)], "_tokens double, _p0 double, _p1 double")
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(both, 2, [0.05, 0.95])


def test_twenty_domains(spark):
    """Every domain is told apart and weighed, the scarcest too; merged ones are one domain of their own."""
    rnd, rows = random.Random(3), []
    for k in range(20):
        for _ in range(4 if k == 19 else 30):
            rows.append((len(rows), " ".join(f"d{k}w{rnd.randrange(40)}" for _ in range(30)), f"lang{k:02d}"))
    docs = spark.createDataFrame([*rows, (None, None, None), (3, rows[3][1], "lang00"), (9000, "d5w1 " * 20_000, None)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id")
    got = {(r["doc_id"], r["n_tokens"]): r for r in mixing.mix_rates(docs, labels).collect()}
    assert all(got[i, 30]["domain"] == lang for i, _, lang in rows) and got[9000, 20_000]["domain"] == "lang05"
    target = {"lang19": 0.5, "lang00": 0.5}
    model, _, totals, _ = mixing.fit(docs.where("doc_id < 9000"), labels, "doc_id", "text", "lang", target)
    reached = dict(zip(model["names"], totals["reached"], strict=True))
    assert reached["lang19"] == pytest.approx(0.5, abs=1e-5) and reached["lang00"] == pytest.approx(0.5, abs=1e-5)
    assert sum(reached.values()) == pytest.approx(1, abs=1e-4)
    with pytest.raises(ValueError):
        mixing.mix_rates(docs, labels, target={"lang19": 1.0, "klingon": 1.0})
    few = mixing.learn(docs, labels, "doc_id", "text", "lang", max_domains=3)
    assert few["names"] == ["lang00", "lang01", "lang02", mixing.OTHER]


def test_mixing_edges(spark):
    odd = spark.createDataFrame([(1, None, None, 3.0), (None, "", "en", 3.0), (2, "a b", "en", 3.0)], "doc_id long, text string, lang string, rate double")
    labels = spark.createDataFrame([(2,)], "doc_id long")
    assert mixing.mix_rates(odd, labels).count() == 3 and mixing.mix(odd, labels).columns == odd.columns
    assert mixing.mix_rates(odd, labels.limit(0)).where("rate = 1").count() == 3
    assert mixing.mix_rates(odd.limit(0), labels).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:30] + 0.15 * rng.standard_normal((30, 32)), base[:5]])
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0),
                                                                      (904, [1.0], 0), (905, [], 0), (None, [0.0] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=8).collect()}
    u = embeddings.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906)) and len(got) == len(rows)
    assert got[90]["component_id"] == got[0]["component_id"] == 0
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7, 0.85])
def test_recall_at_the_asked_cosine(spark, common):
    """Pairs between 0.90 and 0.92 in data with a common direction, against all pairs; a second length is searched too."""
    rng = np.random.default_rng(5)
    dim, n = 64, 2500

    def spread(rows):
        noise = rng.standard_normal((rows, dim - 1))
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        return np.concatenate([np.full((rows, 1), common), np.sqrt(1 - common**2) * noise], axis=1)

    x = spread(n)
    c = rng.uniform(0.901, 0.92, (600, 1))
    side = spread(600) if common else rng.standard_normal((600, dim))
    side -= (side * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    x = np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90_000, [1.0, 0.0]), (90_001, [2.0, 0.0]), (90_002, [0.0, 1.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = embeddings.unit(x)
    near = np.triu(u @ u.T >= 0.9, 1)
    links = sum(got[i]["n_links"] for i in range(len(x)))
    assert near.sum() >= 590 and 0.95 * 2 * near.sum() <= links <= 2 * near.sum()
    assert got[90_001]["component_id"] == 90_000 and got[90_000]["n_links"] == 1 and got[90_002]["n_links"] == 0


def test_large_buckets_are_dealt_in_pieces(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    rows = [(i, [float(v) for v in centre + 0.01 * rng.standard_normal(24)]) for i in range(60)] + [(100 + i, [float(v) for v in rng.standard_normal(24)]) for i in range(200)]
    index_bucket = embeddings._halved.__defaults__
    embeddings._halved.__defaults__ = (8,)
    try:
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    finally:
        embeddings._halved.__defaults__ = index_bucket
    assert all(got[i]["n_links"] == 59 and got[i]["component_id"] == 0 for i in range(60)) and got[100]["n_links"] == 0


def test_warc_links_and_characters(spark):
    html = """<html><a class='x' href='one'>a</a><A HREF = two>b</A><a title="href='no'" href = "th'ree">c</a><p>1 < 2 and 3 > 2</p>
&copy;&#8212;&#x1F600;&#0;&#xD800;&eacute;&amp;#65; <!doctype z><b>end"""
    d = warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", html), (2, "v", "x " * 500_000)], "page_id long, url string, html string")))
    got = {(r["page_id"], r["record_type"]): r["block"] for r in d.collect()}
    assert [x for x in got[1, "metadata"].split("\r\n") if x.startswith("outlink")] == ["outlink: one", "outlink: two", "outlink: th'ree"]
    assert got[1, "conversion"] == "abc\n1 < 2 and 3 > 2\n\u00a9\u2014\U0001F600&#0;&#xD800;\u00e9&#65; end" and len(got[2, "conversion"]) == 999_999


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>A &amp; b</title><p>Hi&nbsp;you<br>there<script>x<y</script>"), (2, None, None), (3, "u", ""),
                                   (3, "u", ""), (4, "h", "HTTP/1.1 404 No\r\nX: y\r\n\r\n<b>gone</b>\r\n\r\nmore")], "page_id long, url string, html string")
    d = warc.derivatives(warc.responses(pages.withColumn("block", F.lit(1))))
    got = {(r["page_id"], r["record_type"]): r for r in d.collect()}
    assert d.count() == 10 and got[1, "conversion"]["block"] == "A & b\nHi you\nthere" and got[2, "conversion"]["block"] == ""
    assert got[4, "conversion"]["block"] == "gone more" and got[4, "metadata"]["source_headers"] == "HTTP/1.1 404 No\r\nX: y"
    assert got[1, "metadata"]["refers_to"] == got[1, "conversion"]["refers_to"] != got[2, "conversion"]["refers_to"]
    warc.write_warc(d, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    cols = ["record_type", "record_id", "refers_to", "target_uri", "block"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, d.select(cols).collect()))
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_pipeline(spark):
    """Each stage against what its operator says on the stage's own input."""
    docs = table(spark, SMOKE, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mix_to_target_weights", "sharding"]
    frames = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        frames.append(written(f(spark, frames[-1], SMOKE), "test-stage"))
        assert frames[-1].columns == docs.columns
    bad = toxicity.score_documents(docs, table(spark, SMOKE, "labels")).where("predicted = 1")
    assert frames[1].count() == docs.count() - bad.count() and frames[1].join(bad, "doc_id").count() == 0
    from pathmine.llm.simhash import fingerprint

    prints = [fingerprint(r["text"]) for r in frames[2].collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    items = [r["text"].lower() for r in table(spark, SMOKE, "benchmark").collect()]
    assert not any(i in r["text"].lower() for r in frames[3].collect() for i in items)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(frames[4]) == ids(frames[3]) and frames[4].count() < 2 * frames[3].count()  # scarce languages come more than once
    out = corpus_pipeline.run(spark, SMOKE)
    assert out.count() == frames[4].count() == out.select("shard", "slot").distinct().count() and ids(out) == ids(frames[4])


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, a column more, and empty tables through all stages."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, None, "en", "a", 0), (3, long, "en", None, 9), (3, long, "en", None, 9),
            (4, long + " more", None, "b", 9), (5, "you are an idiot", "en", "a", 3), (6, "clean words of a fine day", "en", "a", 3),
            (None, "another text that has no id at all", "en", "a", 3), (3, "the third id again, with other words", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component", F.lit("x"))
    items = spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(6, None, 0), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")

    def run(n, d, i, lab):
        sf = str(tmp_path / n)
        for name, df in (("documents", d), ("benchmark", i), ("labels", lab)):
            df.write.parquet(f"{sf}/{name}.parquet")
        return corpus_pipeline.run(spark, sf)

    out = [(r["doc_id"], r["text_crc32"]) for r in run("odd", docs, items, labels).collect()]
    assert len(out) == len(set(out)) and 5 not in {i for i, _ in out} and 4 not in {i for i, _ in out}
    assert run("unlabelled", docs, items.limit(0), labels.limit(0)).count() == 5  # one each: empty, long, clean, without id, id 3 again
    assert run("empty", docs.limit(0), items, labels).count() == 0
