"""What a reader of the corpus is shown: neighbours, counts and the two engines side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.functions import normalize as N
from corroborate.sources.shared import materialize


def neighbours(rows: DataFrame, key: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``rows`` with ``previous`` and ``next``: the ``key`` of the rows beside, null at the ends.

    With ``within`` each group is a sequence. Without it all rows are one: they are dealt into ranges, each
    range is ordered for itself, and its first and last row meet those of the ranges beside, one row a range.
    Rows of equal order go by ``key``.
    """
    if within:
        beside = Window.partitionBy(*within).orderBy(*order)
        return rows.withColumns({"previous": F.lag(key).over(beside), "next": F.lead(key).over(beside)})
    own = [*order, key] if key not in order else order
    dealt = materialize(rows.repartitionByRange(*own).withColumn("_range", F.spark_partition_id()), "ranges")
    beside = Window.partitionBy("_range").orderBy(*own)
    inner = dealt.withColumns({"previous": F.lag(key).over(beside), "next": F.lead(key).over(beside), "_n": F.row_number().over(beside), "_left": F.count("*").over(Window.partitionBy("_range"))})
    place = F.struct(*own, F.struct(key).alias("_key"))
    ends = dealt.groupBy("_range").agg(F.min(place)["_key"][key].alias("first"), F.max(place)["_key"][key].alias("last"))
    ends = ends.agg(F.sort_array(F.collect_list(F.struct("_range", "first", "last"))).alias("e"))  # one entry a range
    beyond = F.transform("e", lambda x, i: F.struct(x["_range"].alias("_range"), F.get("e", i - 1)["last"].alias("_before"), F.get("e", i + 1)["first"].alias("_after")))
    out = inner.join(F.broadcast(ends.select(F.inline(beyond))), "_range")
    out = out.withColumns({"previous": F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("previous")), "next": F.when(F.col("_n") == F.col("_left"), F.col("_after")).otherwise(F.col("next"))})
    return out.select(*rows.columns, "previous", "next")


def packet_counts(packets: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """packet_id, bucket, taxonomy_case, how many findings other than consistent and how many decisions."""
    found = findings.where("classification <> 'consistent'").groupBy("packet_id").agg(F.count("*").alias("findings"))
    judged = decisions.groupBy("packet_id").agg(F.count("*").alias("decisions"))
    out = packets.select("packet_id", "bucket", "taxonomy_case").join(found, "packet_id", "left").join(judged, "packet_id", "left")
    return out.fillna(0, ["findings", "decisions"])


def case_packets(packets: DataFrame) -> DataFrame:
    """The packets of each bucket and taxonomy case."""
    return packets.groupBy("bucket", "taxonomy_case").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("packet_id")).alias("packets"))


#: Rates of a headline that are set side by side, with what they are called.
SHOWN = [
    ("hard_negative_packet_fpr", "packets without a conflict that raise one"),
    ("false_conflict_rate", "conflicts raised where there is none"),
    ("conflict_recall", "conflicts caught"),
    ("label_accuracy", "labels reproduced"),
    ("noise_rate", "findings nobody declared"),
]


def ablation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row headlines as a table: measure, both as text, and both as numbers."""
    def lines(h: DataFrame, side: str) -> DataFrame:
        rate = lambda c: F.struct(N.percent_of(F.col(f"{c}.n"), F.col(f"{c}.of")).alias("shown"), F.col(f"{c}.value").alias("value"))
        load = F.struct(F.format_string("%.1f", "review_load").alias("shown"), F.col("review_load").alias("value"))
        cells = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("measure"), x.alias(side)) for k, (name, x) in enumerate([(name, rate(c)) for c, name in SHOWN] + [("findings per packet for review", load)])]
        return h.select(F.explode(F.array(*cells)).alias("x")).select("x.k", "x.measure", f"x.{side}")

    both = lines(a, "a").join(lines(b, "b"), ["k", "measure"]).orderBy("k")
    return both.select("measure", F.col("a.shown").alias("a"), F.col("b.shown").alias("b"), F.col("a.value").alias("a_value"), F.col("b.value").alias("b_value"))


def focus_first(findings: DataFrame, packets: DataFrame) -> DataFrame:
    """Findings other than consistent, the packet's focus group first."""
    rows = findings.where("classification <> 'consistent'").join(packets.select("packet_id", "focus_group"), "packet_id")
    return rows.orderBy("packet_id", (F.col("group_key") == F.col("focus_group")).desc(), "finding_seq")
