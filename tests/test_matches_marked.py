"""Matches of texts that hold the marks themselves; labels; and how many parts a rendering query deals its rows to."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corroborate.functions import spans as S
from corroborate.operators import extract as X
from corroborate.plans import extract_queries

DATA = Path("/root/testdata/sf0.001")


def test_matches_as_re_finds_them(spark):
    texts = [None, "", "none", "a1", "a1b22 c333", f"{S.MATCH}a1{S.GROUP}b2{S.MATCH}", "é a1 😀 b2", " ".join(f"a{k}" for k in range(600)), "ab $1 \\ a9"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("t", S.matches(F.col("t"), "([a-c])([0-9]+)?", 2).alias("m")).collect()
    for t, m in rows:
        want = None if t is None else [(x.start(), x.group(), x.group(1), x.group(2) or "") for x in re.finditer("([a-c])([0-9]+)?", t)]
        assert (None if m is None else [tuple(x) for x in m]) == want


def test_cells_of_long_lines(spark):
    line = "|".join(f" é{k} " for k in range(S.CHUNK + 40))
    for text in (line, "a|  b |", "|", "a"):
        got = spark.createDataFrame([(text,)], "t string").select(S.cells(F.col("t"), F.lit(5)).alias("c")).first()["c"]
        assert [x["value"] for x in got] == [x.strip(" ") for x in text.split("|")]
        assert all(text[x["start"] - 5 : x["end"] - 5] == x["value"] for x in got)


def test_label_lines(spark):
    texts = ["POWER UNITS \t: 4 4 \nNote: 5\nLIABILITY LIMIT: $1M CSL  ", "power units: 4\nPOWER UNITS:\nPOWER UNITS: : 7", "x POWER UNITS: 3"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("l", S.lines(F.col("t")))
    got = docs.select("k", X._field_facts(F.col("l"), F.transform("l", lambda _: F.lit(X.OTHER))).alias("f")).orderBy("k").collect()
    assert [[f and (f["raw"], f["start"]) for f in r["f"]] for r in got] == [[("4 4", 15), None, ("$1M CSL", 45)], [None, None, (": 7", 41)], [None]]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_rendered_rows_keep_their_parts(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert extract_queries._orders(spark, str(DATA)).rdd.getNumPartitions() == parts
    assert extract_queries._units(spark, str(DATA)).rdd.getNumPartitions() == parts
