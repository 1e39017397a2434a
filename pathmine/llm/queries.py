"""Registered queries of the training-data operators and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathmine.llm import decontaminate, embeddings, licenses, merkle, mixing, periodic, secrets, sharding, simhash, suffixes, toxicity, warc, whitening
from pathmine.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


@register("op6_simhash_near_dedup")
def op6(spark, sf):
    g = simhash.simhash_groups(table(spark, sf, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                    F.col("component").alias("component_id"))


@register("op1_sharding")
def op1(spark, sf):
    return sharding.shard(table(spark, sf, "documents"))


@register("op3_benchmark_decontamination")
def op3(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op8_secret_scan")
def op8(spark, sf):
    return secrets.scan_secrets(table(spark, sf, "documents"))


@register("op4_mixing_target_weights")
def op4(spark, sf):
    return mixing.mix_rates(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op10_toxicity")
def op10(spark, sf):
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op5_license_scan")
def op5(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@register("op7_embedding_near_dedup")
def op7(spark, sf):
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@register("op9_warc_derivatives", warc.oracle())
def op9(spark, sf):
    return warc.derivatives(warc.responses(table(spark, sf, "pages")))


@register("op2_suffix_array_dedup")
def op2(spark, sf):
    return suffixes.remove_repeats(table(spark, sf, "documents")).drop("kept")


@register("op13_document_fingerprints")
def op13(spark, sf):
    return merkle.edited_fingerprints(table(spark, sf, "documents"))


@register("op12_embedding_whitening")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@register("op11_periodic_runs")
def op11(spark, sf):
    return periodic.periodic_runs(table(spark, sf, "documents"), plant=True)
