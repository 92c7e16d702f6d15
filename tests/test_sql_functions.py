"""Functions called from SQL give what their Column forms give, and plan no more than a projection."""

import pytest
from pyspark.sql import functions as F

from corroborate.functions import normalize as N
from corroborate.functions import spans as S
from corroborate.functions import sql

RAWS = [
    None, "", " ", "$1,250,000", "$1.25M csl", "900k", "2 million combined single limit", "$10.50", "twelve (12) units", "twelve (13)", "several", "nineteen", "2025-3-1", "03/01/25", "3/1/2025", "March 1st, 2025",
    "Mar. 1", "13/45/2026", "1o-i q5", "12 North Main Street", "12  N. Main, St.", "a|b | c |d", "-----+----", "x\ny\n\nz\n", "vehicle:unit-7", "loss:CL-1", "policy", "é1\U0001f60022|", "A5C", "ASC",
]
ONE = {
    "money_value": N.money_value, "count_value": N.count_value, "date_value": N.date_value, "vin_value": N.vin_value, "address_value": N.address_value, "limit_value": N.limit_value, "text_value": N.text_value,
    "surface": N.surface, "unit_number": N.unit_number, "entity_label": N.entity_label, "is_table_line": S.is_table_line, "is_rule_line": S.is_rule_line, "text_lines": S.lines,
}
TWO = {"confusable": N.confusable, "similarity": N.similarity, "distinguishing_token": N.distinguishing_token}


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def both(df, column, call):
    got = df.select("k", column.alias("want"), F.expr(call).alias("got")).orderBy("k").collect()
    assert [r.got for r in got] == [r.want for r in got]
    return got


def test_of_one_text(spark, names):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(RAWS + ["|".join("ab c" for _ in range(600)), "\n".join("l" * (n % 7) for n in range(900))])], "k int, raw string")
    for name, form in ONE.items():
        assert any(r.got is not None for r in both(df, form(F.col("raw")), f"{name}(raw)")), name
    both(df, N.date_value(F.col("raw"), F.lit(2024)), "date_value(raw, 2024)")
    both(df, S.cells(F.col("raw"), F.lit(3)), "line_cells(raw, 3)")
    both(df, S.matches(F.col("raw"), "[0-9]+"), "text_matches(raw, '[0-9]+')")


def test_of_two_texts(spark, names):
    pairs = [("12 MAIN RD", "12 MAIN DR"), ("12 MAIN ST", "14 MAIN ST"), ("12 N MAIN", "12 S MAIN"), ("1 A", "1 A B"), ("", ""), ("A5C", "ASC"), ("A58", "ASB"), ("558", "SSB"), (None, "a"), ("a", None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for name, form in TWO.items():
        assert len({r.got for r in both(df, form(F.col("a"), F.col("b")), f"{name}(a, b)")}) > 1, name


def test_of_counts_and_lists(spark, names):
    df = spark.createDataFrame([(0, 1, 3, ["a"]), (1, 0, 0, ["a", "b"]), (2, 5000, 7, ["a", "b", "c"]), (3, 2, 2, [])], "k int, n long, of long, x array<string>")
    both(df, N.dollars(F.col("n")), "dollars(n)")
    both(df, N.percent(F.col("n"), F.col("of")), "percentage(n, of)")
    both(df, N.percent_of(F.col("n"), F.col("of")), "percentage_of(n, of)")
    both(df.where("k < 3"), N.listed(F.col("x")), "listed(x)")
    assert df.where("k = 3").select(F.expr("listed(x)")).first()[0] == ""


def test_inlined(spark, names):
    tested = {*ONE, *TWO, "line_cells", "text_matches", "dollars", "percentage", "percentage_of", "listed"}
    assert set(names) == tested
    spark.range(10).select(F.col("id").cast("string").alias("raw")).createOrReplaceTempView("raws")
    plan = spark.sql("SELECT money_value(raw).numeric, limit_value(raw).canonical FROM raws WHERE count_value(raw).numeric > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and not any(x in plan for x in ("Join", "Exchange", "Subquery", "Python"))
    joined = spark.sql("SELECT text_value(raw).canonical AS t, count(*) AS n FROM raws GROUP BY text_value(raw).canonical")
    assert joined.count() == 10
