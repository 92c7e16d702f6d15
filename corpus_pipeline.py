"""The corpus pipeline: toxic documents go, repeated passages are cut, one document of each group of
near copies stays, documents with benchmark items go, the rest is packed into training sequences.

A document counts as rejected for toxicity at a score of 0.3 or more. Line dedup cuts passages from
the later document and drops a document of which it leaves no word. Near copies are those whose
five-word shingles are similar to 0.8 or more. Each stage is written and read again, so a lost
executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import decontaminate, line_dedup, minhash, packing, toxicity
from corroborate.llm.common import fresh, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that score less than 0.3, learned from the labels of ``docs`` itself.

    Null, empty and blank texts score by the bias alone; without labels nothing is rejected. Equal
    texts score equally, so repeated rows stay or go together; texts of any length are scored whole.
    An empty table comes back empty. Columns may have any names and stay as they are.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return docs.withColumn(score, toxicity.scorer(docs, model)(F.col("text"))).where(F.col(score) < 0.3).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the blocks of lines that earlier documents hold; ``n_chars``, if there, follows the text.

    A document of which no word is left goes; one that had none before stays. Rows with a null id, and
    rows of one id among each other, are not compared. An empty table comes back empty. Columns may
    have any names and stay as they are.
    """
    n_removed, sources = fresh(docs, "n_removed"), fresh(docs, "source_ids")
    out = line_dedup.dedup(docs, n_removed=n_removed, source_ids=sources)
    out = out.where((F.col(n_removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(n_removed, sources)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 of five-word shingles.

    Texts without words are linked with nothing and stay. Rows that repeat an id are judged by their
    own texts, and one of them stays in a group. An empty table comes back empty. Columns may have any
    names and stay as they are.
    """
    return minhash.keep_one(docs, minhash.Settings(words=5, percent=80))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark`` at 0.8 or more.

    Texts and items without words are never found; an empty table, or no items, leaves all as it is.
    Repeated rows stay or go together. Columns may have any names and stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows; a null or empty text is its closing id alone, repeated rows are packed each.

    Only doc_id and text are read; an empty table gives no pieces.
    """
    return packing.pieces(docs, most=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash", minhash_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
