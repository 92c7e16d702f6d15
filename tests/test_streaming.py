"""Streams, other engines and model adjudication over generated packets."""

import hashlib
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corroborate.operators import adjudicate as A
from corroborate.operators import classify as C
from corroborate.operators import extract as X
from corroborate.operators import link as L
from corroborate.operators import review as R
from corroborate.sources import packets as K
from corroborate.sources import runs
from corroborate.sources.review_log import ReviewLog
from corroborate.sources.shared import materialize
from corroborate.streaming import evidence as E


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, E.STATE_STORE)
    yield
    spark.conf.set(key, before)


def shown(rows):
    """Findings without the numbers that count facts of a document in a stream and of a packet in a batch."""
    evidence = lambda r: [{k: v for k, v in f.asDict(True).items() if k != "fact_seq"} for f in r.evidence]
    return {(r.packet_id, r.group_key): (r.classification, r.confidence, r.rationale, r.signals, evidence(r), r.superseded_by, r.label) for r in rows}


def test_findings_of_any_arrival(spark, tmp_path, state_store):
    """Documents in any order and batches, some again: the last findings are those of the batch engine, and only touched groups are emitted."""
    _, docs, _ = K.generated(spark, 1)
    docs = docs.where("packet_id in ('GP-041', 'GP-061', 'GP-091')").unionByName(K.known_failures(spark)[1])
    facts = X.extract(docs).facts
    want = shown(C.classify(L.groups(facts), C.document_marks(facts)).collect())
    rows = docs.collect()
    random.Random(5).shuffle(rows)
    parts = [rows[:3], rows[3:4], rows[2:9], rows[9:]]
    seen, emitted = {}, []

    def take(found, _):
        got = found.collect()
        emitted.append({(r.packet_id, r.group_key) for r in got})
        assert len(emitted[-1]) == len(got)
        seen.update(shown(got))

    for k, part in enumerate(parts):
        spark.createDataFrame(part, docs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = E.adjudicate(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    assert seen == want and len(want) > 40
    groups = {d: {(f.packet_id, f"{f.entity_key}::{f.field}") for f in facts.collect() if f.document_id == d} for d in {r.doc_id for r in rows}}
    assert [x for x in emitted if x] == [y for y in ({g for r in p if r not in before for g in groups.get(r.doc_id, ())} & set(want) for p, before in ((p, [r for q in parts[:k] for r in q]) for k, p in enumerate(parts))) if y]
    assert E.windowed_arrivals(docs).count() > 0


def test_model_engine_and_borrowed_evidence(spark):
    packets, docs, _ = K.generated(spark, 1)
    groups = L.groups(X.extract(docs.where("packet_id = 'GP-041'")).facts).cache()
    said = A.adjudicate(groups, lambda prompt: '{"classification": "conflict", "confidence": 0.9, "reason": "stub"}', 2).collect()
    many = groups.where(F.size("facts") > 1).count()
    assert sum(r.signals == ["llm.adjudicated"] for r in said) == many and len(said) == groups.count()
    run = spark.createDataFrame([("x", 0, "GP-041", 0, "policy::effective_date", "conflict", 0.8, None), ("x", 0, "GP-041", 1, "policy::unknown", "conflict", 0.8, "r")], "engine string, entry int, packet_id string, pos int, group_key string, classification string, confidence double, rationale string")
    got = {r.group_key: len(r.evidence) for r in runs.borrow_evidence(run, packets, groups).collect()}
    assert got["policy::effective_date"] > 1 and got["policy::unknown"] == 0
    text = runs.pack_run(runs.borrow_evidence(run, packets, groups), "x").first().run
    assert '"engineLabel":"x"' in text and "policy::unknown" in text


def test_model_engine_survives_failures(spark, tmp_path):
    """Slow, failing and partly dead callables: calls are retried, what was answered is asked once."""
    packets, docs, _ = K.generated(spark, 1)
    groups = materialize(L.groups(X.extract(docs.where("packet_id in ('GP-041', 'GP-061')")).facts), "groups")
    seen, store = tmp_path / "asked", str(tmp_path / "replies")
    seen.mkdir()
    prompts = {r.p for r in groups.where(F.size("facts") > 1).select(A.prompt().alias("p")).collect()}
    dead = sorted(prompts)[0]

    def model(prompt, healed=False):
        name = hashlib.sha256(prompt.encode()).hexdigest()
        before = len(list(seen.glob(f"{name}-*")))
        (seen / f"{name}-{before}").touch()
        if prompt == dead and not healed:
            raise ConnectionError("no route")
        if before % 3 < 2 and int(name, 16) % 2:
            raise TimeoutError("busy")
        return '{"classification": "conflict", "confidence": 0.9, "reason": "stub"}'

    calls = A.Calls(tasks=2, threads=3, attempts=4, first_wait=0.01, most_wait=0.02, steps=2)
    with pytest.raises(A.Unanswered, match="no reply for GP-.*; 1 groups are open|no reply for GP-.*; 2 groups are open"):
        A.adjudicate(groups, model, calls, store)
    asked = Counter(x.name.split("-")[0] for x in seen.iterdir())
    dead_name = hashlib.sha256(dead.encode()).hexdigest()
    assert asked.pop(dead_name) == 4 and set(asked.values()) <= {1, 3} and len(asked) == len(prompts) - 1
    got = A.adjudicate(groups, lambda p: model(p, True), calls, store)
    again = Counter(x.name.split("-")[0] for x in seen.iterdir())
    assert again.pop(dead_name) > 4 and again == asked  # only what was missing is asked
    assert got.count() == groups.count() and got.where("signals[0] = 'llm.adjudicated'").count() == groups.where(F.size("facts") > 1).count()
    with pytest.raises(A.Unanswered, match="unusable"):
        A.adjudicate(groups, lambda p: "no json", A.Calls(tasks=1))


def test_waits_grow_up_to_a_cap():
    waits = []
    calls = A.Calls(attempts=6, first_wait=1, most_wait=5)
    fatal = type("Fatal", (Exception,), {"retry": False})

    def fails(kind):
        def model(prompt):
            raise kind(prompt)
        return model

    assert A.with_retries(fails(ValueError), calls, waits.append)("p") == (None, "ValueError: p") and waits == [1, 2, 4, 5, 5]
    waits.clear()
    assert A.with_retries(fails(fatal), calls, waits.append)("p")[0] is None and waits == []
    assert A.with_retries(lambda p: p.upper(), calls, waits.append)("p") == ("P", None)


def row(group, verdict, minute, packet="A", reviewer="x", reason="because of x"):
    return (None, packet, group, "reference", "c", verdict, reason, reviewer, datetime(2025, 1, 1, 0, minute))


def held(df):
    return {(r.packet_id, r.group_key, r.reviewer): r.verdict for r in df.collect()}


def test_review_log(spark, tmp_path):
    log = ReviewLog(spark, str(tmp_path / "log"), buckets=8)
    made = lambda *rows: spark.createDataFrame(list(rows), R.SCHEMA)
    assert log.read().count() == 0 and log.decisions_for("A").count() == 0 and log.manifest().version == 0
    log.upsert(made(row("a", "accept", 0), row("b", "accept", 1), row("c", "accept", 1, reason="short"), *[row("a", "accept", 2, packet=f"P{k}") for k in range(20)]))
    first = log.manifest()
    # Of equal times the later write stands; an older decision changes nothing.
    log.upsert(made(row("a", "reject", 0), row("b", "reject", 0), row("b", "accept", 5, reviewer="y")))
    want = {("A", "a", "x"): "reject", ("A", "b", "x"): "accept", ("A", "b", "y"): "accept"}
    assert held(log.decisions_for("A")) == want and held(log.read()) == want | {(f"P{k}", "a", "x"): "accept" for k in range(20)}
    assert held(log.read()) == held(R.upsert(R.upsert(made(), made(row("a", "accept", 0), row("b", "accept", 1), *[row("a", "accept", 2, packet=f"P{k}") for k in range(20)])), made(row("a", "reject", 0), row("b", "reject", 0), row("b", "accept", 5, reviewer="y"))))
    assert held(log.read(first))[("A", "a", "x")] == "accept"
    # A write holds its own buckets, a lookup reads one.
    (_, all_buckets), (_, own) = log.manifest().segments
    assert len(own) == 1 and len(all_buckets) > 4
    files = log.decisions_for("A").inputFiles()
    assert files and all(f"bucket={own[0]}/" in f for f in files) and len(log.read().inputFiles()) > len(files)


def test_review_log_survives_a_crash_and_other_writers(spark, tmp_path, monkeypatch):
    log, other = ReviewLog(spark, str(tmp_path / "log"), 4), ReviewLog(spark, str(tmp_path / "log"), 4)
    made = lambda *rows: spark.createDataFrame(list(rows), R.SCHEMA)
    log.upsert(made(row("a", "accept", 0)))
    with monkeypatch.context() as m:  # a crash after the segment is written
        m.setattr(ReviewLog, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            log.upsert(made(row("a", "reject", 1)), "s", 0)
    assert held(log.read()) == {("A", "a", "x"): "accept"}
    log.upsert(made(row("a", "reject", 1)), "s", 0)  # the batch is run again
    assert held(log.read()) == {("A", "a", "x"): "reject"}
    version = log.manifest().version
    assert log.upsert(made(row("a", "accept", 9)), "s", 0).version == version  # and once more: nothing
    # Another writer takes the version between our reading and our commit.
    plain, raced = ReviewLog._commit, []

    def late(self, m):
        if not raced:
            raced.append(1)
            other.upsert(made(row("b", "accept", 3)))
        return plain(self, m)

    monkeypatch.setattr(ReviewLog, "_commit", late)
    log.upsert(made(row("c", "accept", 4)))
    assert held(log.read()) == {("A", "a", "x"): "reject", ("A", "b", "x"): "accept", ("A", "c", "x"): "accept"} and log.manifest().version == version + 2


def test_review_log_compacts_and_clears(spark, tmp_path):
    log = ReviewLog(spark, str(tmp_path / "log"), 4)
    made = lambda *rows: spark.createDataFrame(list(rows), R.SCHEMA)
    for k in range(5):
        log.upsert(made(row("a", ["accept", "reject"][k % 2], k), row(f"g{k}", "accept", k)))
    log.upsert(made(*[row("z", "accept", 0, packet=f"P{k}") for k in range(9)]))
    before = held(log.read())
    log.compact(most=4)
    assert held(log.read()) == before and len(log.manifest().segments) == 2 and log.compact(most=4).version == log.manifest().version
    assert len(log.vacuum()) == 5 and held(log.read()) == before
    log.clear()
    assert log.read().count() == 0 and len(log.vacuum()) == 2
    batch = E.review_upserts(spark, str(tmp_path / "log"))
    for _ in range(2):
        batch(made(row("a", "accept", 0)), 0)
    assert held(log.read()) == {("A", "a", "x"): "accept"} and len(log.manifest().segments) == 1
