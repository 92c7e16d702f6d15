"""Words below the bound of ample words are exchanged by their own contexts too."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corroborate.llm import brown_lm


def test_rare_words_of_equal_ending_by_their_contexts(spark):
    r = np.random.default_rng(1)
    rows = [(k, " ".join(f"{x}{r.integers(3)}q {x}{r.integers(3)}q {x}{r.integers(30)}same" for _ in range(60))) for k in range(60) for x in ("la", "zo")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("text").cast("binary").alias("text"))
    model, _ = brown_lm.train(texts, brown_lm.Settings(head=100, clustered=6, endings=4, classes=12, ample=10**9))
    words = model.words.decode().split("\n")
    classes = {x: {int(c) for w, c in zip(words, model.word_class) if w.startswith(x) and w.endswith("same")} for x in ("la", "zo")}
    assert len(words) == 66 and not classes["la"] & classes["zo"]


def test_rare_contexts_against_counts(spark):
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(0, 12, n), 12).astype(np.int32) for n in (0, 1, 5, 400)]
    cls = r.integers(0, 3, 13)
    cls[12] = 2
    ids = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary")
    want = {u: Counter() for u in range(4, 10)}
    for t in texts:
        row = [12, *map(int, t)]
        for k in range(1, len(row) - 1):
            if 4 <= row[k] < 10:
                want[row[k]].update([int(cls[row[k + 1]]), 3 + int(cls[row[k - 1]])] + [6] * (row[k] == row[k - 1]))
    got = {x["unit"]: list(x)[1:] for x in brown_lm.rare_contexts(ids, cls, 4, 10, 3).collect()}
    assert got == {u: [c[k] for k in range(7)] for u, c in want.items() if c}
