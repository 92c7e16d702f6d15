"""Near duplicates, line dedup, extraction and the pipeline against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corroborate.llm import components, html_extract, line_dedup, minhash
from corroborate.llm.html_blocks import blocks


def variants(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    r, texts = random.Random(3), [None, "", "one", "one two", "ONE two", " \n"]
    for size, n, most in ((8, 8, 1), (30, 12, 3), (60, 25, 4), (200, 60, 14), (900, 12, 30)):
        texts += variants(r, [f"b{size}x{k}" for k in range(size)], n, most)
    return [(k, t) for k, t in enumerate(texts)] + [(3, "one two"), (None, texts[30])]


def brute(rows, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, len(sets[k]), least.get(root(k), d)) for k, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("settings", [minhash.Settings(3, 85, 48, 7, small=3, block=8), minhash.Settings(5, 80)])
def test_groups(spark, settings):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, component_id string, node int").repartition(3)
    got = minhash.groups(df, settings).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, settings.words, settings.percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(df, settings)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({c for _, _, c in brute(rows, settings.words, settings.percent)}, key=str)


def test_keep_one_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "b"), (1, text.replace(" ", "  ").upper(), "a"), (1, text, "b"), (1, "other words of one id", "c"), (2, text, "a"), (3, " ", "x"), (3, " ", "x"), (3, "alone here", None), (None, text, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(map(tuple, minhash.keep_one(df).collect()), key=str)
    assert kept == sorted([rows[1], rows[3], rows[5], rows[6], rows[7]], key=str)
    assert minhash.keep_one(df.limit(0)).columns == df.columns



def test_keep_one_judges_rows_of_an_id_by_their_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    near = lambda t: t + " more"
    rows = [(3, y), (5, x), (5, near(y)), (6, z), (6, near(z)), (None, near(x)), (None, "no id and alone"), (7, None), (7, near(z))]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7]], key=str)


def test_large_bucket_with_one_foreign_member(spark):
    import numpy as np

    r, s, n = np.random.default_rng(2), minhash.Settings(3, 85, 48, 7), 5000
    look = minhash.probes(s.bins)
    sets = [np.sort(r.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(n)]
    for k, like in ((n - 1, 17), (n - 2, 18)):  # two members of another component, one of them near a member of the large one
        sets[k] = np.sort(np.r_[sets[like][: 38 if like == 17 else 20], sets[k][:2]])
    sig = lambda x: minhash.one_permutation(x, s.bins, look).astype(np.uint8).tobytes()
    crowded = spark.createDataFrame([(7, k, n if k >= n - 2 else 0) for k in range(n)] + [(8, 3, 0), (8, n - 1, n)], "bucket long, node long, root long")
    held = spark.createDataFrame([(k, len(x), bytearray(sig(x)), bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, n_shingles long, sig binary, members binary")
    assert sorted(tuple(sorted(x)) for x in minhash._blocks(crowded, held, s).collect()) == [(17, n - 1)]
    cut, met = minhash._chunks(crowded, s)
    both = met.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")).join(cut, ["bucket", "chunk"])
    # The large component's chunks never meet: each is copied once, the others' chunk as often as there are chunks.
    assert both.count() <= n + 2 * (2 + n // s.block) + 10


def test_groups_of_nothing(spark):
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patience():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(12) for _ in range(r.randint(0, 14))], [r.randrange(12) for _ in range(r.randint(0, 14))]
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]


def test_run_keys():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(0, 9)
        hashes, words, least = [r.randrange(3) for _ in range(n)], [r.randint(1, 8) for _ in range(n)], r.randint(1, 14)
        runs = set()
        for i in range(n):
            runs |= {tuple(hashes[i:e]) for e in [next((e for e in range(i + 1, n + 1) if sum(words[i:e]) >= least), None)] if e}
            runs |= {tuple(hashes[k : i + 1]) for k in [next((k for k in range(i, -1, -1) if sum(words[k : i + 1]) >= least), None)] if k is not None}
        assert len(line_dedup.run_keys(hashes, words, least)) == len(runs)
    assert line_dedup.run_keys([], [], 20) == []


def test_line_dedup_of_lines_first_held_apart(spark):
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(12))
    rows = [(1, f"one\n{line(1)}\nx"), (2, f"two\n{line(2)}\ny"), (3, f"three\n{line(1)}\n{line(2)}"), (4, f"{line(1)}\n\n{line(2)}\nfour")]
    got = {r.doc_id: (r.text, r.source_ids) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], None), 2: (rows[1][1], None), 3: (rows[2][1], None), 4: ("\nfour", [3])}


def test_line_dedup(spark):
    passage = "\n".join(" ".join(f"p{j}w{k}" for k in range(15)) for j in range(4))
    own = lambda k: f"title of {k}\n" + " ".join(f"own{k}x{j}" for j in range(30))
    rows = [(1, f"{own(1)}\n{passage}"), (2, own(2)), (3, f"{own(3)}\n{passage.upper()}\nend"), (4, passage), (5, "short line"), (6, "short line"), (7, None), (None, passage), (8, ""), (4, passage)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, gone string, source_ids string")
    out = line_dedup.dedup(df, source_ids="found").collect()
    got = {(r.doc_id, r.text): (r.n_removed, r.found) for r in out}
    assert len(out) == len(rows) and out[0].gone == "x" and out[0].source_ids == "y"
    assert got[(3, f"{own(3)}\nend")] == (4, [1]) and got[(4, "")] == (4, [1])
    assert all(got[(d, t)] == (0, None) for d, t in rows if d in (1, 2, 5, 6, 7, 8, None))
    assert line_dedup.dedup(df.limit(0).drop("source_ids")).count() == 0


def covered(a, b, words, least):
    """Positions in b of runs that a holds too, with enough words."""
    spans = {tuple(a[i:e]) for i in range(len(a)) for e in range(i + 1, len(a) + 1)}
    return sorted({k for j in range(len(b)) for e in range(j + 1, len(b) + 1) if tuple(b[j:e]) in spans and sum(words[j:e]) >= least for k in range(j, e)})


def test_common_lines_against_brute_force():
    r = random.Random(7)
    for _ in range(1500):
        kinds = r.randint(2, 8)
        size = [r.randint(1, 9) for _ in range(kinds)]
        a, b = [r.randrange(kinds) for _ in range(r.randint(0, 12))], [r.randrange(kinds) for _ in range(r.randint(0, 12))]
        words, least = [size[x] for x in b], r.randint(1, 20)
        assert line_dedup.common_lines(a, b, words, least) == covered(a, b, words, least)


def test_nothing_goes_without_alignment(monkeypatch):
    a, least = list(range(40)), 20
    for b in (a, a[20:] + a[:20], a[::-1], a[5:25] * 3):
        words = [20] * len(b)
        assert line_dedup.common_lines(a, b, words, least) == list(range(len(b)))
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    for b in (a, a[20:] + a[:20], a[::-1], a[5:25] * 3):
        assert line_dedup.common_lines(a, b, [20] * len(b), least) == []


def test_rounds_of_alignment_are_few(monkeypatch):
    r, n, calls, plain = random.Random(3), 2500, [], line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: calls.append(1) or plain(a, b))
    for b in (list(range(n))[::-1], r.sample(range(n), n), [k ^ 1 for k in range(n)], [5] * n):
        calls.clear()
        assert line_dedup.common_lines(list(range(n)), b, [20] * n, 20) == list(range(n))
        assert len(calls) <= 1 + 4 * n**0.5


def test_line_dedup_of_repeated_and_swapped_passages(spark):
    r = random.Random(11)
    pool = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate((50, 12, 12, 30, 9, 7))]
    docs = {1: [pool[0], "one", pool[0]], 2: ["two", pool[0], "deux"], 3: [pool[0], "three", pool[0], "trois"], 4: [pool[1], pool[2], "four", pool[3]], 5: [pool[3], "five", pool[1], pool[2]]}
    docs |= {k: [r.choice([*pool, f"own {k} {j}"]) for j in range(r.randint(1, 9))] for k in range(6, 30)}
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark.createDataFrame([(k, "\n".join(t)) for k, t in docs.items()], "doc_id long, text string")).collect()}
    for k, b in docs.items():
        gone = {j for d, a in docs.items() if d < k for j in covered(a, b, [len(x.split()) for x in b], 20)}
        assert got[k] == "\n".join(x for j, x in enumerate(b) if j not in gone)
    assert got[2] == "two\ndeux" and got[3] == "three\ntrois" and got[5] == "five"


PAGE = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Fish &amp;  chips</h1><p><b>First para&shy;graph of some length, which is long enough.<br><p>Second one
 goes on for a while, too.</p></article><div id="comments"><p>Great post, thanks a lot</p></div><footer>&copy; me</footer>"""


def test_blocks():
    got = [(b.text, b.path[-1]) for b in blocks(PAGE)]
    assert got[:3] == [("Home", "li"), ("News", "li"), ("We use cookies", ".notice")]
    assert got[3][0] == "Fish & chips" and got[5][0] == "Second one goes on for a while, too." and got[-1] == ("© me", "footer")
    kept = lambda t: [b.text for b in blocks(t)]
    assert kept("<p>a</p><svg viewBox='0 0'/><p>b</p><svg><text>x</text></svg><p>c") == ["a", "b", "c"]
    assert kept("<p>a</p><object data=x><p>b</p><select><option>no</select><noscript>no</noscript>c<template>d") == ["a", "b", "cd"]
    assert kept("<p>a</p><script>var b = 1") == ["a"] and kept("<p>a</p><!-- b") == ["a"] and kept("<p>a<textarea>b</textarea>c") == ["ac"]
    assert blocks("") == [] and [b.text for b in blocks("a <b>c</b><!-- x")] == ["a c"]


def test_extraction(spark):
    weights = html_extract.fit(spark)
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, None, "<p>" + "word " * 3000, "x"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, weights).collect()
    texts = [r.text for r in sorted(got, key=lambda r: r.page_id)]
    assert texts[0] == texts[1] and texts[0].split("\n\n")[0] == "Fish & chips" and texts[0].endswith("too.") and "cookies" not in texts[0] and "Great" not in texts[0]
    assert texts[2:4] == ["", ""] and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0), weights).count() == 0


def test_labeller_on_unseen_pages(spark):
    import numpy as np

    from corroborate.llm.html_blocks import MINE, made_up_page

    weights, s, r = html_extract.fit(spark), html_extract.Settings(), random.Random(10**6)
    path, word, right, n = html_extract.Slots(s.path_rows), html_extract.Slots(s.word_rows), 0, 0
    for _ in range(100):
        cut = blocks(made_up_page(r))
        want = np.array([b.text.startswith(MINE) for b in cut])
        for b in cut:
            b.text = b.text.replace(MINE, "").strip() or "x"
        p = html_extract.probabilities(weights, [html_extract.encode(cut, path, word)])[0]
        right, n = right + int(((p >= 0.5) == want).sum()), n + len(cut)
    assert right / n > 0.99


ODD = ["_toxicity", "_n_removed", "_source_ids", "_text_key", "_own_key", "_id", "node", "root", "key", "kept"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    block = " ".join(f"b{k}" for k in range(70))
    texts = [(1, block), (1, block), (2, block + "\n" + " ".join(f"own{k}" for k in range(50))), (None, block), (3, None), (4, ""), (5, " \n\t"), (6, " ".join(f"w{k % 9973}" for k in range(120_000))), (7, "item " * 3 + "of five words here"), (None, None)]
    df = spark.createDataFrame([(d, t, *[f"{c} {k}" for c in ODD]) for k, (d, t) in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in ODD))
    spark.createDataFrame([(1, "item item item of five words here"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    for folder in ("some", "none"):
        spark.createDataFrame([(1, 0, 0), (2, 0, None), (None, 1, 0), (1, 1, 0)] if folder == "some" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / folder / "labels.parquet"))
    was = {tuple(r) for r in df.collect()}
    left = {"toxicity": 10, "line_dedup": 10, "minhash": 8, "decontaminate": 9}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for folder in ("some", "none"):
            got = stage(spark, df, str(tmp_path / folder))
            rows = got.collect()
            assert got.columns == df.columns and len(rows) == left[name] + (name == "decontaminate" and folder == "none")
            if name == "line_dedup":
                assert {r.doc_id: r.text for r in rows}[2] == texts[2][1].split("\n")[1] and {tuple(r)[2:] for r in rows} == {x[2:] for x in was}
            else:
                assert {tuple(r) for r in rows} <= was
        assert stage(spark, df.limit(0), str(tmp_path / "none")).collect() == []
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path / "none"))
    assert pieces.where("start = 0").count() == len(texts) and corpus_pipeline.STAGES[-1][1](spark, df.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"pass{k}" for k in range(60))
    item = " ".join(f"item{k}" for k in range(30))
    own = lambda k, n=80: " ".join(f"d{k}w{j}" for j in range(n))
    docs = [(k, own(k) + ("\nyou utter foozle" if k % 4 == 0 else "\nyou kind friend")) for k in range(400)]
    docs += [(1001, own(1001)), (1002, own(1001)), (1003, own(1003) + "\n" + passage), (1004, own(1004) + "\n" + passage), (1005, own(1005) + " " + item), (1006, own(1006).replace("w40", "x")), (1007, own(1006)), (1008, None), (1009, "")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df.select("doc_id", F.lit(1).alias("quality"), ((F.col("doc_id") < 400) & (F.col("doc_id") % 4 == 0)).cast("int").alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == df.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert sorted(seen["toxicity"]) == [d for d, _ in docs if d > 400 or d % 4]
    assert 1002 not in seen["line_dedup"] and seen["line_dedup"][1004] == own(1004) and seen["line_dedup"][1003].endswith(passage) and seen["line_dedup"][1009] == ""
    assert 1006 in seen["minhash"] and 1007 not in seen["minhash"] and 1008 in seen["minhash"]
    assert set(seen["minhash"]) - set(seen["decontaminate"]) == {1005}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["decontaminate"])
