"""The corpus queries that ``__spark_entry__`` registers: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import brown_lm, chat_format, decontaminate, filter_audit, html_extract, lexical_search, licenses, line_dedup, minhash, packing, quality, sharding, toxicity
from corroborate.llm.common import table
from corroborate.llm.oracles import ORACLES  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit(spark))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.groups(table(spark, sf_dir, "documents"), minhash.Settings(words=3, percent=85, bands=48, rows=7))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def _listed(ids: str) -> Column:
    """A list of ids as text, '' for none: texts compare alike everywhere, arrays do not."""
    return F.coalesce(F.array_join(F.col(ids).cast("array<string>"), ","), F.lit("")).alias(ids)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_removed", _listed("source_ids"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", _listed("item_ids"), "similarity")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), most=1024)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, number -7, whose texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(turns))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html": op2_html,
    "op3_minhash": op3_minhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_lpt_shards": op7_lpt_shards,
    "op8_quality": op8_quality,
    "op9_brown_lm": op9_brown_lm,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_lexical_search": op13_lexical_search,
}
