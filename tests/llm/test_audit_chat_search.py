"""Filter audit, chat formatting and lexical search against plain doubles and on odd tables."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corroborate.llm import chat_format, filter_audit, lexical_search


def failures(rows):
    """Per row the filters it fails, one document at a time."""
    out = []
    for doc, _, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [d for d, _, x in rows if (x or "") == t and d is not None and doc is not None and d < doc]
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), same]
        out.append({x for x, f in zip("ABCDE", tests, strict=True) if f})
    return out


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    fails, out, whole = failures(rows), defaultdict(Counter), Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for (doc, part, _), f in zip(rows, fails, strict=True):
            for k, x in enumerate(order, 1):
                c, before = out[part or "", order, k], f & set(order[: k - 1])
                c["kept"] += x not in f and not before
                c["redundant"] += bool(x in f and before)
                c["unique"] += f == {x}
                if x in f and not before:
                    c["removed"] += 1
                    c["good"] += doc in good
                    c["toxic"] += doc in toxic
                    whole[part or "", x] += 1
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    return {k: (*(c[n] for n in names), whole[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit_against_every_order(spark):
    r = np.random.default_rng(2)
    bodies = [None, "", "A B|C " * 90, "word " * 250, " ".join(f"w{k}" for k in range(300)), " ".join(f"W{k}" for k in range(300)), "é" * 50 + "#", " ".join(f"w{k}" for k in range(20_000)) + " $"]
    rows = [(int(d), [None, "", "a", "b"][r.integers(4)], bodies[r.integers(len(bodies))]) for d in r.permutation(120)]
    rows += [rows[0], rows[0], (None, "a", bodies[3]), (None, "a", bodies[3]), (5, "b", "another text of a known id")]
    labels = [(d, int(r.integers(2)), int(r.integers(2))) for d in range(0, 120, 2)] + [(0, 1, None), (0, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as part", "2 as mask", "3 as t", "4 as of")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "7 as good", "8 as source")
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.interactions(df, said).collect()}
    assert got == plain_audit(rows, labels) and len(got) == 3 * 600
    assert filter_audit.interactions(df.limit(0), said).count() == 0
    assert filter_audit.interactions(df, said.limit(0)).agg(F.max("good_lost") + F.max("toxic_lost")).first()[0] == 0


PIECES = ["<", "[", "\\", "\\\\", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "<SYS>>", "</SYS>>", "<<SYS>>", "|im_end|>", "<|im_end|>", "<|im_next|>", "<|im_sep|>", "<|a_1|>", "|", ">", "]", "é", "\n", " ", "ok", "$1", ""]


def test_escape_is_reversible(spark):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(PIECES, r.integers(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escape(F.col("t"))).withColumn("u", chat_format.unescape(F.col("e")))
    rows = df.collect()
    control = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|<\|[A-Za-z0-9_]+\|>")
    assert all(x.u == x.t and not control.search(x.e) for x in rows)
    assert all(x.e == x.t for x in rows if not re.search(r"[<\[]\\*(/?s>|</?SYS>>|/?INST\]|\|[A-Za-z0-9_]+\|>)", x.t)) and sum(x.e != x.t for x in rows) > 500


def test_chats_come_back(spark):
    r = np.random.default_rng(7)
    rows = [(int(c), int(t), str(r.choice(["user", "assistant", "assistant", "system", "<|im_sep|>", ""])), "".join(r.choice(PIECES, r.integers(0, 6)))) for c in range(60) for t in range(r.integers(1, 9))]
    rows += [(100, 1, None, None), (100, None, "assistant", "first"), (100, 1, "assistant", "b"), (100, 1, "assistant", "b"), (101, 0, "assistant", "long [INST] " * 30_000)] + [(102, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(1500)]
    rows += [(None, 0, "user", "alone"), (None, 1, "assistant", "alone too")]
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(x) for x in rows], "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as alone", "3 as formatted").repartition(5)
    by = defaultdict(list)
    for k, (c, t, role, text) in enumerate(rows):
        by[c if c is not None else ("alone", k)].append(((t is not None, t or 0), role or "", text or ""))
    want = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, x, t in turns if x == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((c if isinstance(c, int) else None, len(turns), sha("".join(f"{x}\n{t}\n" for _, x, t in turns)), len(loss), sha(loss)))
    chats = chat_format.format_chats(df)
    got = chat_format.digests(chats).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    one = {x.conv_id: x for x in chats.where("conv_id in (100, 102)").collect()}
    assert one[100].formatted == "<|im_start|>assistant<|im_sep|>first<|im_end|><|im_start|><|im_sep|><|im_end|><|im_start|>assistant<|im_sep|>b<|im_next|>b<|im_end|>"
    assert [one[100].formatted[s.start : s.end] for s in one[100].loss_spans] == ["first", "b", "b"] and len(one[102].loss_spans) == 750
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def plain_rank(docs, items, top):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    counts = [(d, Counter(cut(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n, length, df = len(counts), sum(x for *_, x in counts), Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in counts:
            m = 100 - 50 + (50 * size * n) // length
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(cut(text)) if w in c), d is None, d or 0))
        out += [(item, k, None if none else d, -x) for k, (x, none, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("first", [0, 2, 50])
def test_search_against_all_documents(spark, first):
    r = np.random.default_rng(9)
    word = lambda: f"W{min(int(r.exponential(12)), 60)}"
    docs = [(int(d), " ".join(word() for _ in range(int(r.exponential(30)))) + r.choice([".", "!\t", " é_ü", "", "the " * 700])) for d in r.permutation(400)]
    docs += docs[:3] + [(None, "W1 W2 w50"), (1000, None), (1001, ""), (1002, "..."), (1003, "w3 W4 w60 w60 " * 30_000)]
    items = [(k, " ".join(word() for _ in range(r.integers(1, 20)))) for k in range(25)] + [(3, "W1 w1 W2"), (30, None), (31, ""), (32, "unseen"), (33, "the é"), (None, "w5")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "3 as rank", "4 as q").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as row", "6 as q", "7 as doc_id")
    s = lexical_search.Settings(top=20, documents=45, postings=400, first=max(first, 1), query_terms=40 if first == 0 else 10_000)
    got = sorted((tuple(x) for x in lexical_search.rank(df, it, s).collect()), key=str)
    assert got == plain_rank(docs, items, 20)
    assert lexical_search.rank(df.limit(0), it, s).count() == 0 and lexical_search.rank(df, it.limit(0), s).count() == 0


def test_blocks_below_the_threshold_stay_compressed():
    r = np.random.default_rng(1)
    rows = [(d, 50, list(range(6)), [int(x) for x in r.integers(1, 3, 6)]) for d in range(20_000)]
    for d in range(7_000, 7_060):
        rows[d] = (d, 50, list(range(6)), [40] * 6)
    shard = lexical_search.Shard(pd.DataFrame(lexical_search.shard_lists(rows, 20_000, 1_000_000)))
    got = shard.search([(t, 1000) for t in range(6)], 50, 1)
    assert sorted(d for d, _ in got) == list(range(7_000, 7_050)) and len({x for _, x in got}) == 1
    opened = [len(p.opened) for p in shard.terms.values()]
    assert max(opened) <= 16 < 20_000 // lexical_search.BLOCK
    assert shard.search([(t, 1000) for t in range(6)], 50, got[0][1] + 1) == []


def test_block_round_trip():
    r = np.random.default_rng(3)
    for most in (2, 300, 70_000, 5_000_000_000):
        docs = np.cumsum(r.integers(1, most, 128))
        tf = r.integers(1, most, 128)
        a, b = lexical_search.decompress(lexical_search.compress(docs, tf), docs[0], 128)
        assert (a == docs).all() and (b == tf).all()
