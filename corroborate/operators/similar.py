"""Pairs of texts within an edit distance that grows with their length, without comparing all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _allowed(length: Column, percent: int) -> Column:
    return F.floor(length * percent / 100).cast("int")


def _pieces(length: Column, percent: int) -> Column:
    """array<struct<k, at, n>>: a text of that length cut into one piece more than edits are allowed."""
    count = _allowed(length, percent) + 1
    edge = lambda k: F.floor(k * length / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("k"), edge(k).alias("at"), (edge(k + 1) - edge(k)).alias("n")))


def similar_pairs(texts: DataFrame, text: str, percent: int = 15) -> DataFrame:
    """(a, b, distance) for all distinct texts a < b whose edit distance is at most ``percent`` of the longer's length.

    The longer text is cut into one piece more than edits are allowed, so one piece at least is
    untouched, and stands in the other text at most that many places away. Texts meet on (length of
    the longer, number of the piece, piece), so no pair is lost and no group of all texts arises.
    Null texts are left out.
    """
    own = texts.select(F.col(text).alias("t")).where("t is not null").distinct().withColumn("l", F.length("t"))
    cut = lambda t, at, n: F.substring(t, at + 1, n)
    held = own.select(F.col("t").alias("x"), F.col("l").alias("longer"), F.explode(_pieces(F.col("l"), percent)).alias("p"))
    held = held.select("x", "longer", F.col("p.k").alias("k"), cut(F.col("x"), F.col("p.at"), F.col("p.n")).alias("piece"))
    # A text may be the shorter side of every length that allows for the difference.
    most = F.floor(F.col("l") * 100 / (100 - percent)).cast("int") + 1
    asked = own.select(F.col("t").alias("y"), "l", F.explode(F.sequence(F.col("l"), most)).alias("longer")).where(F.col("longer") - F.col("l") <= _allowed(F.col("longer"), percent))
    asked = asked.select("y", "longer", F.explode(_pieces(F.col("longer"), percent)).alias("p"))
    shift = _allowed(F.col("longer"), percent)
    asked = asked.select("y", "longer", "p", F.explode(F.sequence(F.greatest(F.col("p.at") - shift, F.lit(0)), F.col("p.at") + shift)).alias("at"))
    asked = asked.select("y", "longer", F.col("p.k").alias("k"), cut(F.col("y"), F.col("at"), F.col("p.n")).alias("piece")).distinct()
    met = held.join(asked, ["longer", "k", "piece"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    far = met.withColumn("distance", F.levenshtein("a", "b").cast("long"))
    return far.where(F.col("distance") * 100 <= F.greatest(F.length("a"), F.length("b")) * percent)
