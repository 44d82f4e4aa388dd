"""The queries ``opN_<name>`` with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import license_scan, oracles, quality_cnn, toxicity
from codeloom.llm.decontaminate import benchmark_hits
from codeloom.llm.jaccard_join import JaccardJoin
from codeloom.llm.pfair import schedule
from codeloom.llm.quality_rules import judge
from codeloom.llm.resharding import byte_size, old_number, place, rewrite, with_places
from codeloom.llm.secret_scan import scan
from codeloom.llm.shared import content_order, stash, table, work_folder
from codeloom.llm.url_filter import CONTRACT_RULES, PATTERN_RULES, judge_urls

SHARDS = 24
#: Shards that documents lie in before resharding, by a hash of their source.
OLD_SHARDS = 20


def old_shard(source: str = "source"):
    return F.pmod(F.crc32(F.coalesce(F.col(source), F.lit(""))), F.lit(OLD_SHARDS))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repo = F.concat_ws("/", "source", "lang")
    return scan(docs, owner=F.col("source"), repo=repo).withColumnRenamed("id", "doc_id").drop("found")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = JaccardJoin(table(spark, sf_dir, "documents"), ngram=4, percent=85).components()
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("parts")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, and beside it the shards that gain or lose rows, written whole to the shared folder."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), old_number(old_shard()).alias("old_shard"), content_order().alias("_order"))
    placed = stash(place(rows, SHARDS), "places")
    changed = sorted(r["s"] for r in placed.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())
    rewrite(with_places(docs, old_shard(), content_order(), placed), f"{work_folder(spark)}/shards-{uuid.uuid4().hex}", changed, dealt=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", content_order().alias("_order"))
    return schedule(rows).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, CONTRACT_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality_classifier,
        op3_secret_scan,
        op4_quality_rules,
        op5_ngram_jaccard_join,
        op6_license_scan,
        op7_benchmark_decontamination,
        op8_sharding,
        op9_source_mixing,
        op10_url_filter,
    )
}
ORACLES = oracles.SQL
