"""Offsets: lines, cells, matches against Python's own, merged intervals."""

import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.functions import spans as S
from corroborate.plans import queries

TEXTS = ["", "a1b22\n333", "é1 😀22", "no digits", "12", "1\n\n2\n", "x|| y |z|", "  | a | b|c "]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1 \n|é😀", max_size=12), min_size=1, max_size=20))
def check(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", "t", S.matches(F.col("t"), "[0-9]+").alias("m"), S.lines(F.col("t")).alias("l"), S.cells(F.col("t"), F.lit(0)).alias("c")).orderBy("k").collect()
    for r in rows:
        assert [(m.start, m.raw) for m in r.m] == [(x.start(), x[0]) for x in re.finditer("[0-9]+", r.t)]
        assert "\n".join(x.text for x in r.l) == r.t
        assert all(r.t[x.start : x.start + len(x.text)] == x.text for x in r.l)
        assert [x.value for x in r.c] == [x.strip(" ") for x in r.t.split("|")]
        assert all(r.t[x.start : x.end] == x.value for x in r.c)


def test_offsets(spark):
    check(spark)


def test_last_index_and_kinds(spark):
    df = spark.createDataFrame([("abcabc", "bc"), ("abc", "x")], "t string, p string")
    assert [r[0] for r in df.select(S.last_index(F.col("t"), F.col("p"))).collect()] == [4, -1]
    kinds = spark.createDataFrame([("a|b|c|d",), ("-----",), ("- -",), ("     ",)], "t string").select(S.is_table_line(F.col("t")), S.is_rule_line(F.col("t"))).collect()
    assert [tuple(k) for k in kinds] == [(True, False), (False, True), (False, False), (False, False)]


def test_merge_and_segments(spark):
    df = spark.createDataFrame([("k", 0, 3), ("k", 3, 5), ("k", 7, 9), ("k", 8, 8), ("j", 1, 2)], "id string, start int, end int")
    merged = S.merge_spans(df, ["id"])
    assert sorted(map(tuple, merged.select("id", "start", "end").collect())) == [("j", 1, 2), ("k", 0, 5), ("k", 7, 9)]
    text = spark.createDataFrame([("k", "0123456789"), ("n", "zz")], "id string, content string")
    got = S.segments(text, merged, ["id"]).orderBy("id", "start").collect()
    assert [(r.id, r.text, r.cited) for r in got] == [("k", "01234", True), ("k", "56", False), ("k", "78", True), ("k", "9", False), ("n", "zz", False)]


def test_merged_days_as_sql_with_nulls_and_fractions(spark, tmp_path):
    con, file = duckdb.connect(), str(tmp_path / "lineitem.parquet")
    rows = "(1, 9, null), (1, 9, 3.0), (1, 9, 3.0), (1, 2, 2.5), (1, 5, 3.5), (1, null, 4.0), (2, 4, null), (2, 4, 1.5), (3, null, 1.0), (3, null, null), (null, 3, 1.0), (null, 4, 0.5), (4, 6, 0.0)"
    con.sql(f"copy (select l_partkey, timestamp '2020-01-01' + to_days(d) as l_shipdate, cast(q as double) as l_quantity from (values {rows}) t(l_partkey, d, q)) to '{file}' (format parquet)")
    want = con.sql(queries.ORACLES["merge_spans"].replace("from lineitem", f"from '{file}'")).fetchall()
    assert sorted(map(tuple, queries.merge_spans(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_starts_in_long_texts(spark):
    """Running sums by chunks: as many lines and matches as around the edges of a chunk, and very many."""
    r = random.Random(8)
    texts = ["\n".join("x" * r.randint(0, 3) + r.choice(["", "a1", "a22é"]) for _ in range(n)) for n in (1, 255, 256, 257, 512, 513, 30_000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for row in df.select("k", S.lines(F.col("t")).alias("l"), S.matches(F.col("t"), "a[0-9]+").alias("m")).collect():
        t, at, want = texts[row.k], 0, []
        for x in t.split("\n"):
            want.append((x, at))
            at += len(x) + 1
        assert [tuple(x) for x in row.l] == want
        assert [(m.start, m.raw) for m in row.m] == [(m.start(), m[0]) for m in re.finditer("a[0-9]+", t)]
