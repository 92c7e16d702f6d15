"""Reviewers' decisions: validation, upsert by key, agreement with the engine and with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.operators import grade as G

VERDICTS = ["accept", "reject", "unresolved"]
SCHEMA = "decision_id string, packet_id string, group_key string, engine string, pipeline_classification string, verdict string, reason string, reviewer string, decided_at timestamp"


def decision_id(packet: Column, group: Column, engine: Column, reviewer: Column) -> Column:
    return F.concat_ws("::", packet, group, engine, reviewer)


def problem(least_reason: int = 8) -> Column:
    """Why a decision cannot be recorded; null if it can."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank("packet_id"), "no packet")
        .when(blank("group_key"), "no group")
        .when(blank("reviewer"), "no reviewer")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < least_reason, "reason too short")
    )


def tidy(decisions: DataFrame) -> DataFrame:
    """Trimmed decisions with their key."""
    out = decisions.withColumns({c: F.trim(c) for c in ("reason", "reviewer")})
    return out.withColumn("decision_id", decision_id(F.col("packet_id"), F.col("group_key"), F.col("engine"), F.col("reviewer")))


def upsert(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with valid decisions added; one row per key, the latest; rejected rows are left out.

    Of equal times the fresh decision stands.
    """
    good = tidy(fresh.where(problem().isNull())).withColumn("_new", F.lit(1))
    both = log.withColumn("_new", F.lit(0)).unionByName(good.select(*log.columns, "_new"))
    latest = Window.partitionBy("decision_id").orderBy(F.col("decided_at").desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def agreement(decisions: DataFrame) -> DataFrame:
    """One row of verdict counts; agreement leaves unresolved ones out."""
    n = {v: F.count_if(F.col("verdict") == v) for v in VERDICTS}
    return decisions.agg(n["accept"].alias("accepted"), n["reject"].alias("rejected"), n["unresolved"].alias("unresolved"), F.try_divide(n["accept"], n["accept"] + n["reject"]).alias("agreement"))


def _graded(decisions: DataFrame, graded: DataFrame) -> DataFrame:
    rows = graded.select("packet_id", "group_key", "label", "expected", "predicted", "confidence", "correct")
    return decisions.where("verdict <> 'unresolved'").join(rows, ["packet_id", "group_key"])


def disputed(decisions: DataFrame, graded: DataFrame) -> DataFrame:
    """Decisions that go against the labels: accepted and wrong, or rejected and right."""
    return _graded(decisions, graded).where((F.col("verdict") == "accept") != F.col("correct"))


def human_calibration(decisions: DataFrame, graded: DataFrame) -> DataFrame:
    """Calibration bins with the reviewers' acceptance in place of the labels."""
    return G.calibration(_graded(decisions, graded).withColumn("accepted", F.col("verdict") == "accept"), correct="accepted")


def latest_voices(decisions: DataFrame, order: str = "log_pos") -> DataFrame:
    """The last decision of each reviewer on a finding, by log order."""
    last = Window.partitionBy("packet_id", "group_key", "engine", "reviewer").orderBy(F.col(order).desc())
    return decisions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def inter_reviewer(decisions: DataFrame, order: str = "log_pos") -> DataFrame:
    """One row: pairs of reviewers on the same finding, and how many agree.

    In closed form from the verdict counts of each finding, so no pair of rows is ever made.
    """
    votes = latest_voices(decisions, order).groupBy("packet_id", "group_key", "engine", "verdict").agg(F.count("*").alias("v"))
    per = votes.groupBy("packet_id", "group_key", "engine").agg(F.sum("v").alias("n"), F.sum(F.col("v") * (F.col("v") - 1) / 2).cast("bigint").alias("agreed"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    return per.where("n > 1").agg(F.count("*").alias("findings"), F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"), F.coalesce(F.sum("agreed"), F.lit(0)).alias("agreed")).withColumn("agreement", F.try_divide("agreed", "pairs"))


def reviewer_disagreements(decisions: DataFrame, order: str = "log_pos") -> DataFrame:
    """Findings on which reviewers differ, with their verdicts."""
    voices = latest_voices(decisions, order).groupBy("packet_id", "group_key", "engine").agg(F.count_distinct("verdict").alias("kinds"), F.array_sort(F.collect_list(F.struct("reviewer", "verdict"))).alias("verdicts"))
    return voices.where("kinds > 1").drop("kinds")
