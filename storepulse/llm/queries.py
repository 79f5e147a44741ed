"""The ``opN_`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import decontam, fim, minhash, mixing, oracles, pii, quality, repair, repeats, secrets, sepscan, spelling, toxicity, urlfilter
from storepulse.llm import spans as sp
from storepulse.llm.common import read_table, written

#: Rules and host terms of the URL filter (fixed values).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_TERMS = r"(spam|pills|casino|bets|adult|ads-track)"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark item, one row per pair."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(decontam.numbered(docs), read_table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("share", "covered", (-F.col("start")).alias("start"), "tokens", "slots_changed")).alias("b"))
    ids = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("doc"))
    return ids.join(best, "doc").select(
        "doc_id", F.col("item").alias("item_id"), F.lit(True).alias("contaminated"), (-F.col("b.start")).alias("start"),
        F.col("b.covered").alias("covered"), F.col("b.tokens").alias("tokens"), F.col("b.share").alias("share"), F.col("b.slots_changed").alias("slots_changed"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("rejected_by", ",").alias("rejected_by"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of the table that stand on a host with a
    listed term; every page whose canonical URL is listed is blocked."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = urlfilter.host_of(F.col("url"))
    listed = pages.select(urlfilter.canonical(host, urlfilter.path_of(F.col("url"))).alias("canonical"), host.alias("host"))
    listed = listed.where(F.col("host").rlike(LISTED_TERMS)).select("canonical").distinct()
    return urlfilter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def _span_digest(found: DataFrame, base: list[str], kinds: list[str]) -> DataFrame:
    return found.select(
        "doc_id", *[sp.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(base)],
        F.sha2(sp.joined(F.col("base"), kinds), 256).alias("base_sha256"), sp.joined(F.col("spans"), kinds).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(pii.detect(docs), pii.BASE, pii.KINDS)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sepscan.count_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(secrets.detect(docs), secrets.BASE, secrets.KINDS)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fim.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(again, 256).alias("restored_sha256"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.removed(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_token_ids": op8_token_ids,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_repeats": op13_repeats,
}

ORACLES: dict[str, str] = {
    "op2_minhash": oracles.MINHASH,
    "op7_url_filter": oracles.url_filter(URL_RULES, LISTED_TERMS),
    "op11_spelling": oracles.SPELLING,
    "op12_fill_in_middle": oracles.FIM,
    "op13_repeats": oracles.REPEATS,
}
