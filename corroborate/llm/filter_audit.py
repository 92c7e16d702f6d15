"""Filter interaction audit: what five filters remove alone, together and in any order.

Native. A document is reduced to five failure bits and the digest of its text. Copies are counted per
(part, text) before they move, so a hot text or source arrives as a few rows; all figures of all orders
follow from the 32 mask counts of a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.llm.common import UPPER, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("n", "good", "toxic")


def own_failures(text: Column, words: Column) -> Column:
    """Bits 0 to 3 of the failure mask: what a document fails by its own text (A to D).

    A: under 200 words. B: less than half of the words distinct. C: more than 2 % of the characters A-Z.
    D: one of #$%&*| occurs. ``words`` are the words of ``text``, which must not be null.
    """
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for k, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters, at most 32 rows a part.

    Bit 4 (E) is set where a smaller doc_id of any part has the same text, by SHA-256. Rows that repeat
    an id with the same text do not fail by each other. A null id is smaller and larger than none. A null
    text is empty, a null part ''. A document is good (toxic) if any of its rows in ``labels`` says so.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"), words_of(t).alias("w"))
    cut = cut.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), own_failures(F.col("t"), F.col("w")).alias("own"))
    said = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = cut.join(said.hint("merge"), F.col("doc_id") == F.col("of"), "left").drop("of")

    # One row for each id of a text, then one for each text of a part: all rows of its smallest id, and all rows.
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    by_id = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    texts = by_id.groupBy("part", "digest", "own").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS))).alias("first"),
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"unnamed_{c}") for c in COUNTS],
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("is_first", F.coalesce(F.col("first.doc_id") == least, F.lit(False)))
    passing = {c: F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0) + F.col(f"unnamed_{c}") for c in COUNTS}
    twice = F.array(
        F.struct(F.col("own").alias("mask"), *[passing[c].alias(c) for c in COUNTS]),
        F.struct((F.col("own") + 16).alias("mask"), *[(F.col(c) - passing[c]).alias(c) for c in COUNTS]),
    )
    split = texts.select("part", F.inline(twice)).where("n > 0")
    return split.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def audit(counted: DataFrame) -> DataFrame:
    """All 120 orders of the filters, step by step, from ``cells``: 600 rows a part.

    Counts within the part: kept after this step, removed here, redundant (fails this filter, was removed
    before), unique_fails (fails this filter only), good_lost and toxic_lost (of those removed here), and
    shapley (what the filter removes, summed over all orders). ``kept`` of the last step is what passes all.
    """
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 32 at most
    steps = parts.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("step"))
    bit = lambda k: F.expr(f"shiftleft(1, locate(substring(filter_order, {k}, 1), '{FILTERS}') - 1)")
    earlier = F.lit(0)
    for k in range(1, 5):
        earlier = earlier + F.when(F.col("step") > k, bit(k)).otherwise(0)
    steps = steps.select("*", bit("step").alias("bit"), earlier.alias("before"))

    def total(test, what: str = "n", times=None) -> Column:
        one = lambda c: c[what] if times is None else c[what] * times(c)
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(test(c["mask"]), one(c)).otherwise(0).cast("long"))

    own, before = F.col("bit"), F.col("before")
    fails, gone = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    # Of all orders of the filters that a document fails, each comes first equally often.
    turns = lambda c: F.lit(len(ORDERS)) / F.bit_count(c["mask"])
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, "n", turns).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``audit`` of the ``cells`` of ``docs``.

    Texts of any length are read whole and leave the row as a digest; repeated rows count each; an empty
    table gives no rows, and without labels good_lost and toxic_lost are 0. Only the named columns are read.
    """
    return audit(cells(docs, labels, doc_id, text, part))
