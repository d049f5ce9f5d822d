"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lictor.llm import (
    chat, conversation_repair, decontamination, html_text, jaccard_join, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup,
    token_align, token_counts, url_filter,
)
from lictor.llm.sql import ORACLE
from lictor.llm.tables import read, stored
from lictor.session import shared_folder


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of 50 or more words; the first place of each is not removed. Documents without one give no row."""
    return suffix_dedup.passages(read(spark, folder, "documents")).select("doc_id", "begin", "end", "removed", "first_doc_ids")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after three batches: all documents come in, those with repeated lines are revised, toxic ones go.

    A revised text keeps the first of equal lines. Two batches are committed twice, as after a lost driver.
    """
    docs = read(spark, folder, "documents")
    labels = read(spark, folder, "labels")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    revised = docs.where("doc_id IS NOT NULL").where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    images, after = stored(token_counts.counted(docs)), stored(token_counts.counted(revised))
    before = images.join(after.select("doc_id").distinct(), "doc_id", "left_semi")
    now = images.join(after.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(after)
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    store = token_counts.TokenTotals(spark, f"{shared_folder(spark).rstrip('/')}/lictor/token-totals-{uuid.uuid4().hex}")
    store.commit("1-load", token_counts.inserts(images))
    store.commit("2-revise", token_counts.revisions(before, after))
    store.commit("3-toxic", token_counts.deletes(now.join(toxic, "doc_id", "left_semi")))
    store.commit("2-revise", token_counts.revisions(before, after))
    store.commit("1-load", token_counts.inserts(images))
    return store.totals()


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_classifier.scored(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judged(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.judged(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.components(read(spark, folder, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own marks."""
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.examples(given.unionByName(own)))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(read(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(read(spark, folder, "documents"), size=4, percent=85)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by a fixed rule, and what their cheapest repair is."""
    given = read(spark, folder, "conversations")
    return conversation_repair.report(given, conversation_repair.damaged(given))


def op13_token_align(spark: SparkSession, folder: str) -> DataFrame:
    return token_align.measured(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_token_counts, op3_quality, op4_quality_rules, op5_decontamination, op6_url_filter, op7_near_dedup, op8_chat, op9_html_text,
    op10_mixing, op11_jaccard_join, op12_conversation_repair, op13_token_align)}

