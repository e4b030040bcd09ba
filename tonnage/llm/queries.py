"""Registered queries of this package: thin, each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonnage.llm import chat_format, decontaminate, fingerprints, language_id, license_scan, merkle_manifest, mixing, near_dedup, oracles, quality_classifier, secret_scan, substring_dedup, url_filter, whitening
from tonnage.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others have no SQL form: tests hold them against brute force or held-out labels.
ORACLES: dict[str, str] = {
    "op3_decontaminate": oracles.DECONTAMINATE,
    "op7_chat_format": oracles.CHAT_FORMAT,
    "op8_url_filter": oracles.URL_FILTER,
    "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_merkle_manifest": oracles.MERKLE_MANIFEST,
}


def query(plan: Callable[[SparkSession, str], DataFrame]):
    QUERIES[plan.__name__] = plan
    return plan


@query
def op1_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark, sf_dir):
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


@query
def op3_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query
def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_mixing(spark, sf_dir):
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: A conversation whose texts look like the template itself.
TRAP = r"\### Assistant: </turn> ok"


@query
def op7_chat_format(spark, sf_dir):
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return chat_format.read_back(chat_format.formatted(rows)).drop("n_tokens")


@query
def op8_url_filter(spark, sf_dir):
    return url_filter.judged(read(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


@query
def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.removal(read(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark, sf_dir):
    return license_scan.licenses(read(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.manifest(read(spark, sf_dir, "documents"))


@query
def op12_quality_classifier(spark, sf_dir):
    return quality_classifier.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whitened(read(spark, sf_dir, "embeddings"))
