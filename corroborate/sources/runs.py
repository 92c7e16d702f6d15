"""JSON in and out: other engines' runs, and the review log."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.operators.grade import CLASSES
from corroborate.operators.review import SCHEMA as REVIEWS

RUN = "engineLabel string, packets array<struct<packetId:string,findings:array<struct<groupKey:string,classification:string,confidence:double,rationale:string>>>>"


class BadInput(ValueError):
    """Input that does not have the shape it must have; the message names the first offender."""


def read_run(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per reported finding of a run file, checked; ``lines`` reads what ``write_run`` wrote."""
    return run_findings(spark.read.schema(RUN).option("multiLine", not lines).option("mode", "FAILFAST").json(path))


def run_findings(run: DataFrame) -> DataFrame:
    """(engine, packet_id, entry, pos, group_key, classification, confidence, rationale).

    Raises BadInput on a blank label, a missing id, an unknown class, a confidence outside 0..1, or
    a group reported twice in one entry. Of entries for the same packet the last stands. ``run`` may
    hold several documents; their entries follow one another.
    """
    rows = run.withColumn("document", F.monotonically_increasing_id()).select("document", F.col("engineLabel").alias("engine"), F.posexplode_outer("packets").alias("k", "p"))
    rows = rows.select("engine", F.when(F.col("k").isNotNull(), F.struct("document", "k")).alias("entry"), F.col("p.packetId").alias("packet_id"), F.col("p.findings").isNull().alias("bare"), F.posexplode_outer("p.findings").alias("pos", "f"))
    rows = rows.select("engine", "entry", "packet_id", "bare", "pos", F.col("f.groupKey").alias("group_key"), F.col("f.classification").alias("classification"), F.col("f.confidence").alias("confidence"), F.col("f.rationale").alias("rationale"))
    some = F.col("pos").isNotNull()
    wrong = (
        F.when(F.coalesce(F.trim("engine"), F.lit("")) == "", "engineLabel is blank")
        .when(F.col("entry").isNull(), "packets is missing or empty")
        .when(F.coalesce(F.trim("packet_id"), F.lit("")) == "", "packetId is blank")
        .when(F.col("bare"), "findings is missing")
        .when(some & (F.coalesce(F.trim("group_key"), F.lit("")) == ""), "groupKey is blank")
        .when(some & ~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)), "unknown classification")
        .when(some & ~F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)), "confidence outside 0..1")
    )
    place = lambda r: "run" if r["entry"] is None else f"packets[{r['entry']['k']}]"
    bad = rows.withColumn("wrong", wrong).where("wrong is not null").orderBy("entry", "pos").limit(1).collect()
    if bad:
        raise BadInput(f"{place(bad[0])}{'' if bad[0]['pos'] is None else '.findings[%d]' % bad[0]['pos']}: {bad[0]['wrong']}")
    twice = rows.where(some).groupBy("entry", "group_key").agg(F.count("*").alias("n")).where("n > 1").orderBy("entry").limit(1).collect()
    if twice:
        raise BadInput(f"{place(twice[0])}: {twice[0]['group_key']} is reported twice")
    last = rows.groupBy("packet_id").agg(F.max("entry").alias("entry"))
    return rows.where(some).join(last, ["packet_id", "entry"]).drop("bare")


def borrow_evidence(run: DataFrame, packets: DataFrame, groups: DataFrame) -> DataFrame:
    """Findings of a run with the evidence of our groups; a group we do not know keeps none."""
    unknown = run.join(packets, "packet_id", "left_anti").select("packet_id").limit(1).collect()
    if unknown:
        raise BadInput(f"packet {unknown[0]['packet_id']} is not in the corpus")
    held = groups.select("packet_id", "group_key", "label", "entity_key", "field", F.col("facts").alias("evidence"))
    out = run.join(held, ["packet_id", "group_key"], "left")
    return out.select(
        "packet_id", F.lit("external").alias("engine"), F.col("pos").alias("finding_seq"), "group_key", F.coalesce("label", "group_key").alias("label"), F.coalesce("entity_key", F.lit("policy")).alias("entity_key"), "field", "classification",
        "confidence", F.coalesce("rationale", F.concat(F.lit("Said to be "), "classification", F.lit(" by "), run["engine"], F.lit(", without a reason"))).alias("rationale"), F.array(F.lit("external.reported-finding")).alias("signals"), F.coalesce("evidence", F.array().cast(held.schema["evidence"].dataType)).alias("evidence"),
    )


def pack_run(findings: DataFrame, label: str) -> DataFrame:
    """One JSON document of a run: findings other than consistent, nested by packet."""
    rows = findings.where("classification <> 'consistent'").select("packet_id", F.struct(F.col("group_key").alias("groupKey"), "classification", "confidence", "rationale").alias("f"))
    per = rows.groupBy("packet_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["groupKey"] < b["groupKey"], -1).when(a["groupKey"] > b["groupKey"], 1).otherwise(0)).alias("findings"))
    return per.select(F.to_json(F.struct(F.lit(label).alias("engineLabel"), F.array(F.struct(F.col("packet_id").alias("packetId"), "findings")).alias("packets"))).alias("run"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The review log under ``path``; a missing one is empty, a broken one raises and stays as it is."""
    if not exists(spark, path):
        return spark.createDataFrame([], REVIEWS)
    return spark.read.schema(REVIEWS).option("mode", "FAILFAST").json(path)


def write_reviews(log: DataFrame, path: str, version: str) -> str:
    """Write the log, sorted by time, to a new version folder under ``path``; returns the folder.

    Spark commits the folder as a whole, so readers see the old version or the new one.
    """
    out = f"{path}/{version}"
    log.orderBy("decided_at").write.mode("errorifexists").json(out)
    return out


def clear_reviews(spark: SparkSession, path: str, version: str) -> str:
    """Write an empty log as a new version; the versions before stay as they are."""
    return write_reviews(spark.createDataFrame([], REVIEWS), path, version)


def reviews_path(path: str | None = None, default: str = "data/reviews") -> str:
    """Where the review log is: the argument, else the environment's REVIEW_LOG, else ``default``."""
    return path or os.environ.get("REVIEW_LOG") or default


def write_run(findings: DataFrame, label: str, path: str) -> None:
    """The run of ``pack_run`` as JSON text that ``read_run`` reads back, one document a packet."""
    pack_run(findings, label).write.mode("errorifexists").text(path)


def decisions_for(log: DataFrame, packet_id: str) -> DataFrame:
    return log.where(F.col("packet_id") == packet_id)
