"""One query per corpus operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from screenfunnel.llm import binary, exact, htmltext, langid, licenses, merkle, minhash, mixing, negatives, packing, quality, secrets, sql, urls
from screenfunnel.llm.registry import REGISTRY, query
from screenfunnel.queries.base import table
from screenfunnel.session import scratch_path

__all__ = ["REGISTRY"]


@query("op1_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify_languages(docs, langid.fit_language_model(docs))


@query("op9_quality_rules", sql.QUALITY)
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.QualityRules()
    # without texts the counts are small: stored once, they serve the references and the verdicts
    path = scratch_path(spark, "quality")
    ids = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    counted = quality.base_counts(ids, rules)
    counted.withColumn("row", F.struct("row.doc_id")).write.parquet(path)
    counted = spark.read.parquet(path)
    return quality.verdicts(counted, rules, quality.language_references(counted, rules)).select("doc_id", "quality.*")


@query("op3_exact_dedup", sql.EXACT)
def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_source_mixing", sql.MIXING)
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without texts the sized rows are small: stored once, they serve the plan and the result
    path = scratch_path(spark, "sizes")
    mixing.sized_rows(table(spark, sf_dir, "documents", "doc_id", "text", "source")).withColumn("row", F.struct("row.doc_id")).write.parquet(path)
    sized = spark.read.parquet(path)
    taken = mixing.take(sized, mixing.mixing_plan(sized.drop("row")))
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_minhash_neardup", sql.NEAR)
def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), minhash.NearDup(words=2))


@query("op5_secret_scan")
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op6_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op7_html_main_text")
def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op10_training_order")
def binary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.materialise(table(spark, sf_dir, "documents", "text"), scratch_path(spark, "shards"))


@query("op8_license_scan")
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op11_hard_negatives", sql.NEGATIVES)
def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


@query("op12_merkle_manifest", sql.MERKLE)
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return merkle.manifest(docs, "lang", "doc_id", merkle.document_leaf, merkle.tampered_leaf).withColumnRenamed("id", "doc_id").drop("copied")


URL_RULES = (
    urls.Rule("com/", "allow"), urls.Rule("example.com/en/", "block"), urls.Rule("www.example.com/en/", "allow"), urls.Rule("net/es/", "block"),
    urls.Rule("net/fr/", "block"),
)


@query("op13_url_filter")
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    model = urls.train(urls.word_labels(pages))
    return urls.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
