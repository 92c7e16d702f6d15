"""Scoring arithmetic on hand-made findings, reviews and runs."""

import json
import random
from datetime import datetime

import pytest

from corroborate.operators import adjudicate as A
from corroborate.operators import browse
from corroborate.operators import grade as G
from corroborate.operators import review as R
from corroborate.plans import pipeline as P
from corroborate.sources import runs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def graded(spark):
    """Two packets with conflicts, one without, and one without findings, which is in denominators only."""
    kinds = [("W1", 7, "hard_negative"), ("W2", 2, "true_conflict"), ("W3", 5, "true_conflict"), ("W4", 9, "hard_negative")]
    packets = spark.createDataFrame([(p, f"packet {p}", k, b) for p, k, b in kinds], "packet_id string, title string, taxonomy_case int, bucket string")
    said = {"W1": "addr benign_variant, date consistent", "W2": "count conflict, total conflict, vin unresolved, date supersession", "W3": "total conflict, date supersession", "W4": "vin benign_variant"}
    labels = spark.createDataFrame([(p, *x.split()) for p, t in said.items() for x in t.split(", ")], "packet_id string, group_key string, expected string")
    found = [
        ("W1", "addr", "conflict", 0.91), ("W1", "date", "consistent", 0.97), ("W1", "spare", "unresolved", 0.52), ("W2", "count", "conflict", 0.84), ("W2", "total", "consistent", 0.93),
        ("W2", "vin", "unresolved", 0.55), ("W3", "total", "unresolved", 0.66), ("W3", "date", "benign_variant", 0.88), ("W3", "total", "conflict", 0.94),
    ]
    findings = spark.createDataFrame([(p, k, g, f"label of {g}", c, x, ["s"]) for k, (p, g, c, x) in enumerate(found)], "packet_id string, finding_seq int, group_key string, label string, classification string, confidence double, signals array<string>")
    return packets, G.grade(packets, labels, findings)


def test_outcomes(graded):
    got = {(r.packet_id, r.group_key): r.outcome for r in graded[1].collect()}
    w2 = {"count": "conflict_caught", "total": "conflict_missed", "vin": "label_correct", "date": "dropped"}
    assert got == {("W1", "addr"): "false_conflict", ("W1", "date"): "quiet", ("W1", "spare"): "noise", ("W3", "total"): "conflict_caught", ("W3", "date"): "label_wrong"} | {("W2", k): v for k, v in w2.items()}


def test_headline(graded):
    packets, rows = graded
    h = G.headline(rows, packets).first()
    assert (h.graded, h.reported, h.review_load) == (9, 6, 1.5)
    rates = {c: (h[c].n, h[c].of) for c in h.asDict() if c.endswith(("fpr", "rate", "recall", "accuracy"))}
    assert rates == {
        "hard_negative_packet_fpr": (1, 2), "hard_negative_group_fpr": (1, 3), "false_conflict_rate": (1, 6), "conflict_recall": (2, 3), "conflict_packet_recall": (2, 2),
        "label_accuracy": (4, 8), "noise_rate": (1, 1), "drop_rate": (1, 7),
    }
    assert h.drop_rate.value == pytest.approx(1 / 7)


def test_confusion_and_calibration(graded):
    _, rows = graded
    cells = {(r.expected, r.predicted): r.n for r in G.confusion(rows).collect()}
    assert len(cells) == 25 and sum(cells.values()) == 8
    assert {k for k, n in cells.items() if n} == {("conflict", "conflict"), ("conflict", "consistent"), ("benign_variant", "conflict"), ("consistent", "consistent"), ("unresolved", "unresolved"), ("supersession", "consistent"), ("supersession", "benign_variant")}
    assert cells["conflict", "conflict"] == 2
    bins = G.calibration(rows.where(G.reported(F.col("outcome"))))
    by = {r.bin: r for r in bins.collect()}
    assert len(by) == 7 and {k: (r.n, r.correct) for k, r in by.items() if r.n} == {1: (2, 1), 4: (2, 1), 5: (2, 1)}
    assert by[1].gap == pytest.approx(-0.035) and by[5].gap == pytest.approx(-0.425)
    assert G.calibration_error(bins).first().ece == pytest.approx(1.64 / 6)
    assert by[0].observed is None and by[0].label.startswith("<")


def test_rollups(spark, graded):
    packets, rows = graded
    got = {r.packet_id: (r.declared, r.correct, r.noise, r.passed) for r in G.packet_rollup(rows, packets).collect()}
    assert got == {"W1": (2, 1, 1, False), "W2": (4, 2, 0, False), "W3": (2, 1, 0, False), "W4": (0, 0, 0, True)}
    cases = spark.createDataFrame([(k, "b", "n") for k in (1, 2, 5, 7, 9)], "id int, bucket string, name string")
    got = {r.taxonomy_case: (r.declared, r.caught, r.missed, r.passed, r.packets) for r in G.case_rollup(rows, cases, packets).collect()}
    assert got == {1: (0, 0, 0, False, None), 2: (4, 1, 1, False, ["W2"]), 5: (2, 1, 0, False, ["W3"]), 7: (2, 0, 0, False, ["W1"]), 9: (0, 0, 0, False, ["W4"])}


def test_facets_and_delta(spark, graded):
    _, rows = graded
    assert G.facets(rows, bucket="true_conflict", predicted="conflict").count() == 2
    s = G.facet_summary(G.facets(rows, packet_id="W2")).first()
    assert (s.rows, s.wrong) == (4, 2) and s.mean_confidence == pytest.approx((0.84 + 0.93 + 0.55) / 3)
    other = rows.withColumn("outcome", F.when(F.col("group_key") == "addr", "noise").when(F.col("group_key") == "spare", "false_conflict").when(F.col("packet_id") == "W3", "label_wrong").otherwise(F.col("outcome")))
    got = sorted(map(tuple, G.engine_delta(rows, other).collect()))
    assert got == [("caught_only_a", "W3 · label of total"), ("false_only_a", "W1 · label of addr"), ("false_only_b", "W1 · label of spare")]


def decisions(spark, rows):
    data = [("p", p, g, "reference", "c", v, "long enough reason", who, datetime(2025, 1, 1, 0, k), k) for k, (p, g, v, who) in enumerate(rows)]
    return spark.createDataFrame(data, R.SCHEMA + ", log_pos int")


def test_reviews(spark, graded):
    d = decisions(spark, [("W1", "addr", "reject", "x"), ("W2", "count", "accept", "x"), ("W2", "vin", "reject", "x"), ("W3", "date", "accept", "x"), ("W3", "total", "unresolved", "x"), ("W9", "none", "unresolved", "x")])
    r = P.score_reviews(d, graded[1])
    assert tuple(r.agreement.first()) == (2, 2, 2, 0.5)
    assert sorted((x.packet_id, x.group_key) for x in r.disputed.collect()) == [("W2", "vin"), ("W3", "date")]
    assert G.calibration_error(r.calibration).first().ece == pytest.approx((0.55 + 2 * 0.14 + 0.91) / 4)
    assert r.reviewers.first().pairs == 0
    two = decisions(spark, [("A", "a", "accept", "x"), ("A", "a", "accept", "y"), ("A", "b", "reject", "x"), ("A", "b", "accept", "x"), ("A", "b", "reject", "y")])
    r = R.inter_reviewer(two).first()
    assert (r.pairs, r.agreed) == (2, 1)
    assert [x.group_key for x in R.reviewer_disagreements(two).collect()] == ["b"]


def test_browsing(spark, graded):
    packets, rows = graded
    findings = rows.select("packet_id", F.col("predicted").alias("classification"))
    got = {r.packet_id: (r.findings, r.decisions) for r in browse.packet_counts(packets, findings, decisions(spark, [("W1", "a", "accept", "x"), ("W1", "b", "accept", "x")])).collect()}
    assert got == {"W1": (2, 2), "W2": (2, 0), "W3": (2, 0), "W4": (0, 0)}
    beside = {r.packet_id: (r.previous, r.next) for r in browse.neighbours(packets, "packet_id", ["packet_id"]).collect()}
    assert beside["W1"] == (None, "W2") and beside["W3"] == ("W2", "W4") and beside["W4"] == ("W3", None)
    assert {(r.bucket, r.taxonomy_case): r.packets for r in browse.case_packets(packets).collect()}[("true_conflict", 5)] == ["W3"]
    h = G.headline(rows, packets)
    table = {r.measure: (r.a, r.b) for r in browse.ablation(h, h).collect()}
    assert table["conflicts caught"] == ("66.7% (2 of 3)",) * 2 and table["findings per packet for review"] == ("1.5", "1.5")
    s = P.Score(rows, h, None, None, None, None)
    lines = P.comparison(s, s, G.engine_delta(rows, rows.limit(0)), "external")
    assert "external" in lines[0] and any(x.endswith("W3 · label of total") for x in lines) and "caught only by the main engine" in lines
    assert len(P.report(s)) == 9


def test_upsert(spark, tmp_path):
    log = runs.read_reviews(spark, str(tmp_path / "none"))
    assert log.count() == 0
    row = lambda v, reason, at: (None, "A", "g", "reference", "c", v, reason, " x ", datetime(2025, 1, 1, 0, at))
    log = R.upsert(log, spark.createDataFrame([row("accept", "  because of x ", 1), row("accept", "ok", 2)], R.SCHEMA))
    log = R.upsert(log, spark.createDataFrame([row("reject", "because of y", 3)], R.SCHEMA))
    out = runs.write_reviews(log, str(tmp_path), "v1")
    got = runs.read_reviews(spark, out).collect()
    assert [(g.verdict, g.reason, g.reviewer) for g in got] == [("reject", "because of y", "x")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"decision_id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        runs.read_reviews(spark, str(tmp_path / "bad")).collect()


def test_log_versions(spark, tmp_path, monkeypatch):
    row = (None, "A", "g", "reference", "c", "accept", "because of x", "x", datetime(2025, 1, 1))
    kept = runs.write_reviews(R.upsert(spark.createDataFrame([], R.SCHEMA), spark.createDataFrame([row], R.SCHEMA)), str(tmp_path), "v1")
    assert runs.read_reviews(spark, runs.clear_reviews(spark, str(tmp_path), "v2")).count() == 0
    assert runs.decisions_for(runs.read_reviews(spark, kept), "A").count() == 1 and runs.decisions_for(runs.read_reviews(spark, kept), "B").count() == 0
    monkeypatch.setenv("REVIEW_LOG", "/from/env")
    assert (runs.reviews_path("/given"), runs.reviews_path()) == ("/given", "/from/env")
    monkeypatch.delenv("REVIEW_LOG")
    assert runs.reviews_path() == "data/reviews"


def run_of(spark, tmp_path, data):
    path = tmp_path / "run.json"
    path.write_text(json.dumps(data))
    return runs.read_run(spark, str(path))


def test_runs(spark, tmp_path):
    finding = {"groupKey": "g", "classification": "conflict", "confidence": 0.8}
    good = {"engineLabel": "other", "packets": [{"packetId": "A", "findings": [finding]}]}
    assert [r.group_key for r in run_of(spark, tmp_path, good).collect()] == ["g"]
    for change in ({"engineLabel": " "}, {"packets": []}, {"packets": [{"packetId": "", "findings": []}]}, {"packets": [{"packetId": "A"}]}, {"packets": [{"packetId": "A", "findings": [finding, finding]}]}):
        with pytest.raises(runs.BadInput):
            run_of(spark, tmp_path, good | change)
    for change in ({"classification": "odd"}, {"confidence": 1.2}, {"groupKey": None}):
        with pytest.raises(runs.BadInput):
            run_of(spark, tmp_path, good | {"packets": [{"packetId": "A", "findings": [finding | change]}]})


def test_run_round_trip(spark, tmp_path):
    found = [("A", "g", "conflict", 0.8, "r"), ("A", "h", "consistent", 0.9, ""), ("B", "g", "unresolved", 0.5, "s"), ("B", "f", "conflict", 0.7, "t")]
    runs.write_run(spark.createDataFrame(found, "packet_id string, group_key string, classification string, confidence double, rationale string").repartition(2), "mine", str(tmp_path / "run"))
    got = runs.read_run(spark, str(tmp_path / "run"), lines=True)
    assert sorted((r.engine, r.packet_id, r.group_key, r.classification, r.confidence, r.rationale) for r in got.collect()) == sorted(("mine", *x) for x in found if x[2] != "consistent")


def test_replies(spark):
    replies = ['x {"classification": "conflict", "confidence": 0.5, "reason": "r"} y', '{"classification": "odd", "confidence": 0.5, "reason": "r"}', "none", '{"classification": "conflict", "confidence": 2, "reason": "r"}', '{"classification": "conflict", "confidence": 1, "reason": " "}']
    got = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string").select("k", A.parse_reply(F.col("r")).alias("p")).orderBy("k").collect()
    assert [g.p is not None for g in got] == [True, False, False, False, False]


def test_neighbours_across_ranges(spark):
    r = random.Random(4)
    rows = [(f"p{k}", r.choice([None, 1, 2, 2, 7])) for k in range(300)] + [("tie", 2)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "packet_id string, pos int")
    for part in (df, df.where("pos = 7 or packet_id = 'p1'"), df.limit(0), df.where("packet_id = 'tie'")):
        want = [x[0] for x in sorted(map(tuple, part.select("packet_id", "pos").collect()), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))]
        out = browse.neighbours(part, "packet_id", ["pos"])
        got = {x.packet_id: (x.previous, x.next) for x in out.collect()}
        assert got == {k: (a, b) for k, a, b in zip(want, [None, *want[:-1]], [*want[1:], None])}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and not any("Window" in x and "SinglePartition" in y for x, y in zip(plan.splitlines(), plan.splitlines()[2:]))
