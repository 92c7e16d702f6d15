"""Packets gathered within a row: the groups of ``packets``, and no second exchange."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corroborate.operators import link as L
from corroborate.operators import rules as U
from corroborate.plans import rule_queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def test_same_groups_as_dealt_packets(spark):
    facts = Q._event_facts(spark, DATA)
    rows = L.evidence(facts).groupBy("packet_id").agg(F.collect_list("ev").alias("evidence")).withColumn("tables", F.array().cast(f"array<{U.table_type()}>"))
    told = lambda d: d.select("packet_id", F.inline("groups")).select("packet_id", "entity_key", "field", "classification", F.transform("evidence", lambda e: e["fact_seq"]).alias("n"))
    seen = lambda d: sorted((r.packet_id, r.entity_key, r.field, r.classification, tuple(r.n)) for r in told(d).collect())
    got = seen(U.gathered(rows))
    assert got == seen(U.packets(facts)) != []
    assert {r[3] for r in got} > {"unresolved", "conflict", "supersession"}


@pytest.mark.parametrize("query,exchanges", [(Q.rule_vehicle_count, 1), (Q.rule_vin_uniqueness, 1), (Q.rule_scheduled_value, 2)])
def test_readings_are_not_dealt_again(spark, query, exchanges):
    plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == exchanges
