"""Registered queries of the operators, over whole tables and with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kneser_ney, line_crf, media, mixing, secrets, sharding, simhash, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark, sf_dir):
    return kneser_ney.report(table(spark, sf_dir, "documents"), 3)


def op1_bigrams(spark, sf_dir):
    """The same model of order 2."""
    return kneser_ney.report(table(spark, sf_dir, "documents"), 2)


def op2_line_crf(spark, sf_dir):
    return line_crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_labels(spark, sf_dir):
    """Every line of every document with its probability of being good."""
    docs = table(spark, sf_dir, "documents")
    return line_crf.line_labels(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op3_virtual_slots(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_grown(spark, sf_dir):
    """The shards of all documents before and after a shard is added to the stored map."""
    return sharding.assign_grown(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark, sf_dir):
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urls.judge(pages, urls.block_list(spark))
    return out.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "canonical_url", "is_listed")


def op7_secret_scan(spark, sf_dir):
    return secrets.scan_report(table(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_motion_jpeg(spark, sf_dir):
    return media.media_report(table(spark, sf_dir, "documents"))


def op10_clips(spark, sf_dir):
    """Timed clips of every document's media."""
    return media.clips(media.store(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_kneser_ney, op1_bigrams, op2_line_crf, op2_line_labels, op3_virtual_slots, op3_grown, op4_simhash, op5_warc_derivatives, op6_url_filter, op7_secret_scan, op8_source_mix, op9_decontaminate, op10_motion_jpeg, op10_clips)}
