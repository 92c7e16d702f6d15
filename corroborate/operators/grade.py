"""Grading: findings against labels, and every figure that follows from the graded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLASSES = ["conflict", "supersession", "benign_variant", "unresolved", "consistent"]
OUTCOMES = ["conflict_caught", "conflict_missed", "false_conflict", "label_correct", "label_wrong", "dropped", "noise", "quiet"]
#: Edges of the calibration bins, half open; the last lets 1 in.
EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0001]


def outcome(expected: Column, predicted: Column) -> Column:
    return (
        F.when(expected == "conflict", F.when(predicted == "conflict", "conflict_caught").otherwise("conflict_missed"))
        .when(predicted == "conflict", "false_conflict")
        .when(expected == "consistent", F.when(predicted == "consistent", "quiet").otherwise("noise"))
        .when(predicted == "consistent", "dropped")
        .when(expected == predicted, "label_correct")
        .otherwise("label_wrong")
    )


def grade(packets: DataFrame, labels: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per packet and declared or reported group.

    A missing side counts as consistent; of two findings on one group the later (finding_seq) stands;
    packets without any finding are left out, unknown packets too.
    """
    seen = packets.join(findings.select("packet_id").distinct(), "packet_id", "left_semi")
    latest = Window.partitionBy("packet_id", "group_key").orderBy(F.col("finding_seq").desc())
    last = findings.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    said = last.select("packet_id", "group_key", "label", F.col("classification").alias("_predicted"), "confidence", "signals")
    want = labels.select("packet_id", "group_key", F.col("expected").alias("_expected"))
    both = want.join(said, ["packet_id", "group_key"], "full").join(seen.select("packet_id", F.col("title").alias("packet_title"), "taxonomy_case", "bucket"), "packet_id")
    expected, predicted = F.coalesce("_expected", F.lit("consistent")), F.coalesce("_predicted", F.lit("consistent"))
    return both.select(
        "packet_id", "packet_title", "taxonomy_case", "bucket", "group_key", F.coalesce("label", "group_key").alias("label"), F.col("_expected").isNotNull().alias("declared"),
        expected.alias("expected"), predicted.alias("predicted"), "confidence", "signals", (expected == predicted).alias("correct"), outcome(expected, predicted).alias("outcome"),
    )


def reported(o: Column) -> Column:
    """Whether the row reaches a reviewer."""
    return o.isin("conflict_caught", "false_conflict", "label_correct", "label_wrong", "noise")


def rate(n: Column, of: Column) -> Column:
    """struct<n, of, value>; value is null over nothing."""
    n, of = n.cast("bigint"), of.cast("bigint")
    return F.struct(n.alias("n"), of.alias("of"), F.try_divide(n, of).alias("value"))


def _count(test: Column) -> Column:
    return F.count_if(test)


def headline(graded: DataFrame, packets: DataFrame) -> DataFrame:
    """One row with all headline rates; packet denominators come from ``packets``, graded or not."""
    o, hard, true = F.col("outcome"), F.col("bucket") == "hard_negative", F.col("bucket") == "true_conflict"
    rows = graded.agg(
        F.count_distinct(F.when(hard & (o == "false_conflict"), F.col("packet_id"))).alias("hard_hit"),
        _count(hard & (o == "false_conflict")).alias("hard_false"),
        _count(hard).alias("hard_rows"),
        _count(o == "false_conflict").alias("false"),
        _count(F.col("expected") != "conflict").alias("not_conflict"),
        _count(o == "conflict_caught").alias("caught"),
        _count(F.col("expected") == "conflict").alias("conflicts"),
        F.count_distinct(F.when(true & (o == "conflict_caught"), F.col("packet_id"))).alias("true_hit"),
        _count(F.col("declared") & F.col("correct")).alias("right"),
        _count(F.col("declared")).alias("declared"),
        _count(o == "noise").alias("noise"),
        _count(o == "dropped").alias("dropped"),
        _count(F.col("declared") & (F.col("expected") != "consistent")).alias("droppable"),
        _count(reported(o)).alias("reported"),
        F.count("*").alias("graded"),
    )
    of = packets.agg(_count(hard).alias("hard"), _count(true).alias("true"), F.count("*").alias("packets"))
    both = rows.crossJoin(F.broadcast(of))  # one row each
    c = F.col
    return both.select(
        "graded",
        "reported",
        F.coalesce(F.try_divide("reported", "packets"), F.lit(0.0)).alias("review_load"),
        rate(c("hard_hit"), c("hard")).alias("hard_negative_packet_fpr"),
        rate(c("hard_false"), c("hard_rows")).alias("hard_negative_group_fpr"),
        rate(c("false"), c("not_conflict")).alias("false_conflict_rate"),
        rate(c("caught"), c("conflicts")).alias("conflict_recall"),
        rate(c("true_hit"), c("true")).alias("conflict_packet_recall"),
        rate(c("right"), c("declared")).alias("label_accuracy"),
        rate(c("noise"), c("graded") - c("declared")).alias("noise_rate"),
        rate(c("dropped"), c("droppable")).alias("drop_rate"),
    )


def confusion(graded: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Dense (expected, predicted, n) over declared rows."""
    names = classes or CLASSES
    spark = graded.sparkSession
    cells = spark.createDataFrame([(e, p) for e in names for p in names], "expected string, predicted string")
    n = graded.where("declared").groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    return cells.join(n, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def bin_table(spark: SparkSession, edges: list[float] | None = None) -> DataFrame:
    e = edges or EDGES
    rows = [(k, e[k], e[k + 1], f"< {e[1]:.2f}" if k == 0 else f"{e[k]:.2f}–{min(e[k + 1], 1.0):.2f}") for k in range(len(e) - 1)]
    return spark.createDataFrame(rows, "bin int, lower double, upper double, label string")


def bin_of(confidence: Column, edges: list[float] | None = None) -> Column:
    """Number of the half-open bin a confidence falls in; a fixed CASE instead of a range join."""
    e = edges or EDGES
    out = F.when(F.lit(False), F.lit(0))
    for k in range(len(e) - 1):
        out = out.when((confidence >= e[k]) & (confidence < e[k + 1]), k)
    return out


def calibration(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", edges: list[float] | None = None) -> DataFrame:
    """Dense bins: n, correct, observed and claimed means and their gap (null where empty)."""
    got = rows.where(F.col(confidence).isNotNull()).groupBy(bin_of(F.col(confidence), edges).alias("bin")).agg(F.count("*").alias("n"), _count(F.col(correct)).alias("correct"), F.avg(confidence).alias("claimed"))
    zero = F.lit(0).cast("bigint")
    out = bin_table(rows.sparkSession, edges).join(got, "bin", "left").withColumns({"n": F.coalesce("n", zero), "correct": F.coalesce("correct", zero)})
    out = out.withColumn("observed", F.try_divide("correct", "n"))
    return out.select("bin", "lower", "upper", "label", "n", "correct", "observed", "claimed", (F.col("observed") - F.col("claimed")).alias("gap"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: expected calibration error, null over nothing."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"))


def _tallies() -> list[Column]:
    o = F.col("outcome")
    return [
        _count(F.col("declared")).alias("declared"), _count(F.col("declared") & F.col("correct")).alias("correct"), _count(o == "conflict_caught").alias("caught"),
        _count(o == "conflict_missed").alias("missed"), _count(o == "false_conflict").alias("false_conflicts"), _count(o == "noise").alias("noise"), _count(reported(o)).alias("reported"),
    ]


def packet_rollup(graded: DataFrame, packets: DataFrame) -> DataFrame:
    """Per packet; passed if all declared are right and nothing false or noisy was raised."""
    names = ["declared", "correct", "caught", "missed", "false_conflicts", "noise", "reported"]
    out = packets.select("packet_id", "bucket", "taxonomy_case").join(graded.groupBy("packet_id").agg(*_tallies()), "packet_id", "left").fillna(0, names)
    return out.withColumn("passed", (F.col("declared") == F.col("correct")) & (F.col("false_conflicts") == 0) & (F.col("noise") == 0))


def case_rollup(graded: DataFrame, cases: DataFrame, packets: DataFrame) -> DataFrame:
    """Per taxonomy case (all of them); a case without declared rows does not pass."""
    names = ["declared", "correct", "caught", "missed", "false_conflicts", "noise", "reported"]
    held = packets.groupBy("taxonomy_case").agg(F.array_sort(F.collect_set("packet_id")).alias("packets"))
    tallies = graded.groupBy("taxonomy_case").agg(*_tallies())
    out = cases.select(F.col("id").alias("taxonomy_case"), "bucket", "name").join(tallies, "taxonomy_case", "left").join(held, "taxonomy_case", "left").fillna(0, names)
    return out.withColumn("passed", (F.col("declared") > 0) & (F.col("declared") == F.col("correct")) & (F.col("false_conflicts") == 0) & (F.col("noise") == 0))


#: What the rollups count of graded rows; ``_hit`` counts packets.
TALLIES = ["graded", "declared", "correct", "caught", "missed", "false_conflicts", "noise", "dropped", "droppable", "reported", "conflicts", "not_conflict", "hard_rows", "hard_false", "hard_hit", "true_hit"]


def rollups(graded: DataFrame, packets: DataFrame) -> DataFrame:
    """The figures of every level in one pass over ``graded``: level, packet_id, taxonomy_case, bucket, packets and TALLIES.

    Rows are counted per packet first, so that distinct packets are plain sums above; then grouping sets give
    the levels packet, case, bucket and all. ``packets`` (packet_id, bucket, taxonomy_case) gives the
    denominators, graded or not; packet_ids hold the packets of a case.
    """
    o, hard, true = F.col("outcome"), F.col("bucket") == "hard_negative", F.col("bucket") == "true_conflict"
    per = graded.groupBy("packet_id").agg(
        *_tallies(), F.count("*").alias("graded"), _count(o == "dropped").alias("dropped"), _count(F.col("declared") & (F.col("expected") != "consistent")).alias("droppable"),
        _count(F.col("expected") == "conflict").alias("conflicts"), _count(F.col("expected") != "conflict").alias("not_conflict"),
    )
    rows = packets.select("packet_id", "bucket", "taxonomy_case").join(per, "packet_id", "left").fillna(0, [c for c in TALLIES if c in per.columns])
    flag = lambda test: F.when(test, 1).otherwise(0).cast("bigint")
    rows = rows.withColumns({"hard_rows": flag(hard) * F.col("graded"), "hard_false": flag(hard) * F.col("false_conflicts"), "hard_hit": flag(hard & (F.col("false_conflicts") > 0)), "true_hit": flag(true & (F.col("caught") > 0)), "hard": flag(hard), "true": flag(true)})
    levels = [["packet_id", "taxonomy_case", "bucket"], ["taxonomy_case"], ["bucket"], []]
    ids = F.when(F.grouping("taxonomy_case") == 0, F.array_sort(F.collect_list(F.col("own"))))
    level = F.when(F.grouping("packet_id") == 0, "packet").when(F.grouping("taxonomy_case") == 0, "case").when(F.grouping("bucket") == 0, "bucket").otherwise("all")
    out = rows.withColumn("own", F.col("packet_id")).groupingSets([[F.col(c) for c in x] for x in levels], "packet_id", "taxonomy_case", "bucket")
    return out.agg(level.alias("level"), F.count("*").alias("packets"), F.coalesce(F.sum("hard"), F.lit(0)).alias("hard"), F.coalesce(F.sum("true"), F.lit(0)).alias("true"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TALLIES], ids.alias("packet_ids"))


def headline_of(rolled: DataFrame) -> DataFrame:
    """The row of ``headline`` from ``rollups``."""
    c = F.col
    return rolled.where("level = 'all'").select(
        "graded", "reported", F.coalesce(F.try_divide("reported", "packets"), F.lit(0.0)).alias("review_load"),
        rate(c("hard_hit"), c("hard")).alias("hard_negative_packet_fpr"), rate(c("hard_false"), c("hard_rows")).alias("hard_negative_group_fpr"), rate(c("false_conflicts"), c("not_conflict")).alias("false_conflict_rate"),
        rate(c("caught"), c("conflicts")).alias("conflict_recall"), rate(c("true_hit"), c("true")).alias("conflict_packet_recall"), rate(c("correct"), c("declared")).alias("label_accuracy"),
        rate(c("noise"), c("graded") - c("declared")).alias("noise_rate"), rate(c("dropped"), c("droppable")).alias("drop_rate"),
    )


_SHOWN = ["declared", "correct", "caught", "missed", "false_conflicts", "noise", "reported"]


def packets_of(rolled: DataFrame) -> DataFrame:
    """The rows of ``packet_rollup`` from ``rollups``."""
    out = rolled.where("level = 'packet'").select("packet_id", "bucket", "taxonomy_case", *_SHOWN)
    return out.withColumn("passed", (F.col("declared") == F.col("correct")) & (F.col("false_conflicts") == 0) & (F.col("noise") == 0))


def cases_of(rolled: DataFrame, cases: DataFrame) -> DataFrame:
    """The rows of ``case_rollup`` from ``rollups``."""
    got = rolled.where("level = 'case'").select("taxonomy_case", *_SHOWN, F.col("packet_ids").alias("packets"))
    out = cases.select(F.col("id").alias("taxonomy_case"), "bucket", "name").join(got, "taxonomy_case", "left").fillna(0, _SHOWN)
    return out.withColumn("passed", (F.col("declared") > 0) & (F.col("declared") == F.col("correct")) & (F.col("false_conflicts") == 0) & (F.col("noise") == 0))


def engine_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one engine's graded rows have over the other's: (kind, item) for caught and false conflicts."""
    item = F.concat("packet_id", F.lit(" · "), "label").alias("item")
    side = lambda df, x: df.where(F.col("outcome").isin("conflict_caught", "false_conflict")).select("outcome", item, F.lit(x).alias("side"))
    both = side(a, "a").unionByName(side(b, "b")).groupBy("outcome", "item").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    kind = F.concat(F.when(F.col("outcome") == "conflict_caught", "caught_only_").otherwise("false_only_"), "first")
    return both.where(F.col("first") == F.col("last")).select(kind.alias("kind"), "item")


def facets(graded: DataFrame, **equal) -> DataFrame:
    """Graded rows with all the given column values; None leaves a facet open."""
    for name, want in equal.items():
        if want is not None:
            graded = graded.where(F.col(name) == want)
    return graded


def facet_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), _count(~F.col("correct")).alias("wrong"), F.avg("confidence").alias("mean_confidence"))
