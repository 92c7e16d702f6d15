"""Registered queries against their SQL on the smallest tables; and the entry module without the corpus part."""

import os
import random
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from corroborate.functions import normalize as N
from corroborate.operators.rules import NEAR_ADDRESS, near_pairs, near_within
from corroborate.operators.similar import similar_pairs
from corroborate.plans import extract_queries, queries, rule_queries

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
QUERIES = queries.QUERIES | rule_queries.QUERIES | extract_queries.QUERIES
ORACLES = queries.ORACLES | rule_queries.ORACLES | extract_queries.ORACLES


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    return f"{float(x):.6f}" if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_near_pairs_against_all_pairs(spark):
    streets = ["MAIN QUARRY", "MAIN  QUARRY", "OAK HILL ROAD EXTENDED"]
    rows = [(p, f"{n} {s} {e}") for p in ("1", "2", None) for n in (1, 2, 10, 11, 100) for s in streets for e in ("ST", "AVE", "*")] + [("1", None), ("1", "10 MAIN QUARRY ST")]
    df = spark.createDataFrame(rows, "packet_id string, address string")
    x, y = df.withColumnRenamed("address", "a"), df.withColumnRenamed("address", "b")
    want = x.join(y, "packet_id").where("a < b").withColumn("similarity", N.similarity(F.col("a"), F.col("b"))).withColumn("told", N.distinguishing_token(F.col("a"), F.col("b")))
    want = want.where(F.col("told").isNotNull() & (F.col("similarity") >= NEAR_ADDRESS))
    got = near_pairs(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) != []
    per = df.where("packet_id is not null").groupBy("packet_id").agg(F.array_sort(F.collect_set("address")).alias("own"))
    inside = per.select("packet_id", F.inline(near_within(F.col("own"))))
    assert sorted(map(tuple, inside.collect())) == sorted(tuple(x) for x in got.select("packet_id", "a", "b", "told").distinct().collect())
    # The join sees one token's alternatives, never all addresses of a packet.
    assert "rest" in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_pairs_against_all_pairs(spark):
    r, texts = random.Random(9), [None, "", "a", "b"]
    for _ in range(40):
        base = [r.choice("abc") for _ in range(r.randint(3, 30))]
        texts.append("".join(base))
        for _ in range(r.randint(0, 4)):  # an edit at either end or in the middle
            at = r.choice([0, len(base) - 1, r.randrange(len(base))])
            base[at : at + 1] = [[], ["x"], [base[at], "y"]][r.randrange(3)] or [""]
        texts.append("".join(base))
    df = spark.createDataFrame([(t,) for t in texts + texts[5:9]], "name string")
    x, y = df.distinct().withColumnRenamed("name", "a"), df.distinct().withColumnRenamed("name", "b")
    want = x.join(y, F.col("a") < F.col("b")).withColumn("d", F.levenshtein("a", "b")).where(F.col("d") * 100 <= F.greatest(F.length("a"), F.length("b")) * 15)
    got = similar_pairs(df, "name", 15)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_entry_without_corpus_part(tmp_path):
    shutil.copytree(ROOT / "corroborate", tmp_path / "corroborate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": ""})
