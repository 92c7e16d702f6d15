"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins; links shrink towards (node, smallest node), so a
hub's links meet only in partially aggregated minima and in joins that adaptive execution can
split. Each round is written to the shared folder; nothing but a change count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import Scratch, discard, materialize


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the component's smallest node.

    Self links and repeated links change nothing; an empty table gives no rows. The table that the
    result is read from goes with ``scratch``.
    """
    now = materialize(links.where("a != b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        before, now = now, materialize(_small(_large(now)), "links")
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if scratch is not None:
        scratch.tables.append(now)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
