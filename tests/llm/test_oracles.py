"""Corpus queries against their SQL, and learned operators against plain doubles of them."""

import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import brown_lm, sharding, toxicity
from corroborate.llm.common import materialize
from corroborate.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return str([int(k) for k in x])
    return f"{float(x):.9f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == cols
    rows = lambda data: sorted([tuple(map(plain, r)) for r in data])
    assert rows(got.select(*cols).collect()) == rows(want.select(*(f'"{c}"' for c in cols)).fetchall())


def plain_ftrl(examples, s):
    """FTRL-proximal one coordinate at a time."""
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in examples:
            w, b = {int(i): weight(int(i)) for i in x}, -bz / ((s.beta + math.sqrt(bn)) / s.alpha)
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + b)))) - y
            for i, wi in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * wi
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / s.alpha * b
            bn += g * g
    return {i: weight(i) for i in z if abs(z[i]) > s.l1}, -bz / ((s.beta + math.sqrt(bn)) / s.alpha)


def test_ftrl_against_a_plain_one():
    r, s = np.random.default_rng(6), toxicity.Settings(bits=8, l1=0.5, epochs=3)
    examples = [(np.unique(r.integers(0, 60, 12)), 0) for _ in range(300)]
    examples = [(x, int(x[0] < 2 or r.random() < 0.1)) for x, _ in examples]
    got, (want, bias) = toxicity.fit_rows(examples, s), plain_ftrl(examples, s)
    assert dict(zip(got.index.tolist(), got.weight)) == pytest.approx(want) and got.bias == pytest.approx(bias) and 5 < len(want) < 60


def test_schedule_against_a_plain_one():
    r = np.random.default_rng(3)
    for _ in range(50):
        items, shards = [(k, int(n)) for k, n in enumerate(r.integers(1, 40, r.integers(0, 60)))], int(r.integers(1, 9))
        loads, want = [0] * shards, {}
        for k, n in sorted(items, key=lambda x: (-x[1], x[0])):
            want[k] = loads.index(min(loads))
            loads[want[k]] += n
        assert sharding.schedule(items, shards) == want


def test_shards_place_every_group_as_scheduled(spark):
    """With groups this large each is scheduled alone, longest first."""
    rows = [(k, "x" * (300 * g + 7)) for g in range(1, 30) for k in range(g * 100, g * 100 + 1 + g % 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, shards=5, fine=1 / 1000).collect()
    size = Counter()
    for _, t in rows:
        size[t] += len(t) + 16
    texts, loads = dict(rows), Counter()
    of = {texts[r.doc_id]: r.shard for r in got}
    for t, n in size.items():
        loads[of[t]] += n
    greedy = [0] * 5
    for n in sorted(size.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert sorted(loads.values()) == sorted(greedy)
    slots = {(r.shard, r.slot) for r in got}
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        again = {(r.doc_id, r.shard, r.slot) for r in sharding.assign(df, shards=5, fine=1 / 1000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == {(r.doc_id, r.shard, r.slot) for r in got} and len(slots) == len(rows)


def test_class_score_against_counts(spark):
    r = np.random.default_rng(5)
    rows = [(k, " ".join(f"{x}{min(int(r.exponential(15)), 90)}{'q' if r.random() < 0.3 else 'ly'}" for x in r.choice(["la", "zo", "mi"], r.integers(0, 30)))) for k in range(300)] + [(300, None), (301, "zebra lax, unseen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    s = brown_lm.Settings(head=40, clustered=10, endings=8, classes=6, sweeps=4, ample=20)
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    texts = spark.createDataFrame([(k, t) for k, t in rows if k not in held], "doc_id long, text string").select(F.col("text").cast("binary").alias("text")).coalesce(2)
    v, counts = brown_lm.vocabulary(materialize(brown_lm.word_counts(texts), "counts"), s)
    model = brown_lm.learn(materialize(brown_lm.numbered(texts, v), "ids"), counts, v, s)
    number = v.lookup()
    words = lambda t: (t or "").encode().lower().split()
    cls = lambda t: [int(model.number_class[number[w]]) for w in words(t)]
    edge, pairs, kinds, seen = s.classes - 1, Counter(), {}, Counter()
    for k, t in rows:
        if k not in held:
            c = [edge, *cls(t), edge]
            pairs.update(zip(c, c[1:]))
            seen.update([*words(t), b""])
            kinds |= {w: x for w, x in zip(words(t), cls(t))}
    total = sum(pairs.values())
    after, into = Counter(), Counter()
    for (a, b), n in pairs.items():
        after[a] += n
        into[b] += n
    # One kind for each word, one for an unknown word of each ending, and the edge.
    unknown = [int(x) for x in model.number_class[v.size : v.size + s.endings]]
    mass = [into[c] + sum(x == c for x in kinds.values()) + sum(x == c for x in unknown) + (c == edge) for c in range(s.classes)]
    step = lambda a, b: math.log10((pairs[a, b] + s.backoff * (into[b] + 1) / (total + s.classes)) / (after[a] + s.backoff))
    got = {x.doc_id: x.score for x in brown_lm.score(df, s).collect()}
    for k, t in rows:
        c, w = [edge, *cls(t), edge], [*words(t), b""]
        want = sum(step(a, b) + math.log10((seen[x] + 1) / mass[b]) for a, b, x in zip(c, c[1:], w))
        assert got[k] == pytest.approx(want, abs=1e-6)
    assert len(set(kinds.values())) > 3 and any(number[w] >= v.size for w in kinds)


def test_long_words_have_numbers_of_their_own(spark):
    """A rule of dashes in every second text is a word of the head like any other, and is counted exactly."""
    rule, data = "-" * 90, ["é" * 70 + f"{k}," for k in range(40)]
    rows = [(k, f"a b {rule if k % 2 else 'c'} {data[k % 40]}\n{'x' * 300 if k == 7 else 'y'}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as tail", "3 as ids").repartition(3)
    s = brown_lm.Settings(head=8, clustered=4, endings=8, classes=4, sweeps=2, ample=5)
    train = [t.lower().split() for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    seen = Counter(w for ws in train for w in [*ws, ""])
    texts = spark.createDataFrame([(t,) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2], "text string").select(F.col("text").cast("binary"))
    v, _ = brown_lm.vocabulary(materialize(brown_lm.word_counts(texts), "counts"), s)
    number = v.lookup()
    assert number[brown_lm.kept_short([rule.encode()])[0]] < v.size <= 8 and number[rule.encode()] >= v.size
    total, kinds = seen.total(), len(seen)
    for r in brown_lm.score(df, s).collect():
        words = [*rows[r.doc_id][1].lower().split(), ""]
        assert r.n_known == sum(w in seen for w in words) and r.train_tokens == total and r.n_tokens == len(words)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in words))
