"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, bigrams and skip-grams (one or two words left out) of the whole
text, hashed to 2**bits. Per-coordinate rates and the L1 penalty leave a few thousand non-zero
weights, which are broadcast; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import batches, byte_words, held_out
from corroborate.llm.hashing import WordHashes, chain, mix


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 4
    #: Labelled rows that are learned from, about: where there are more, those with the lowest id hashes.
    sample: int = 16_000
    #: Distinct features of all rows learned from, at most (they are held in one task, four bytes each).
    features: int = 64_000_000


@dataclass(frozen=True)
class Model:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def feature_ids(words: list[bytes], hashes: WordHashes, bits: int) -> np.ndarray:
    """Feature numbers of a text, with repeats."""
    h = hashes.of(words)
    parts = [mix(h)] + [chain(h[:-gap], h[gap:], gap) for gap in (1, 2, 3) if len(h) > gap]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


def fit_rows(examples: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """FTRL-proximal over (distinct feature numbers, label) in the order given, ``epochs`` times."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias_z = bias_n = 0.0
    for _ in range(s.epochs):
        for x, y in examples:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= s.l1, 0.0, (np.sign(zx) * s.l1 - zx) / ((s.beta + root) / s.alpha + s.l2))
            b = -bias_z / ((s.beta + bias_n**0.5) / s.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
            step = np.sqrt(nx + g * g)
            z[x] = zx + g - (step - root) / s.alpha * w
            n[x] = nx + g * g
            wider = (bias_n + g * g) ** 0.5
            bias_z += g - (wider - bias_n**0.5) / s.alpha * b
            bias_n += g * g
    at = np.flatnonzero(np.abs(z) > s.l1)
    w = (np.sign(z[at]) * s.l1 - z[at]) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
    return Model(s.bits, at.astype(np.int32), w, float(-bias_z / ((s.beta + bias_n**0.5) / s.alpha)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 4) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out (crc32(id) mod ``mod`` is 2).

    Null labels are left out; an id labelled twice counts as toxic if either label says so. Without
    any labelled row the model has no weights and scores everything next to 0 (1e-13). Ids and languages
    are only used to choose rows. The sample is learned in one task in a fixed order of hashes, so a
    repeated task gives the same model. Its size is bounded, whatever the input: by Settings.sample (an
    id that stands for several rows may take it to twice that) and, where texts are very long, by
    Settings.features; rows beyond either bound, last in the order, are not learned from.
    """
    s = settings or Settings()
    marked = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id), mod)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    known = marked.count()
    share = min(1.0, s.sample / max(1, known))
    chosen = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).join(chosen, "_id").select(F.xxhash64("_id", "_text").alias("_order"), "_text", "_y")

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, examples, room = WordHashes(), [], s.features
        for part in parts:
            for batch in batches([part]):
                for raw, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = byte_words(raw) if len(examples) < 2 * s.sample and room > 0 else []
                    if words:
                        x = np.unique(feature_ids(words, hashes, s.bits))
                        room -= len(x)
                        if room >= 0:
                            examples.append((x, y))
        if examples:
            m = fit_rows(examples, s)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1), pa.int32()), pa.array(np.append(m.weight, m.bias))], names=["i", "w"])

    got = rows.repartition(1).sortWithinPartitions("_order").mapInArrow(learn, "i int, w double").toPandas()  # 2**bits rows at most
    got = got.sort_values("i")
    bias = got.loc[got.i < 0, "w"]
    got = got[got.i >= 0]
    return Model(s.bits, got.i.to_numpy(np.int32), got.w.to_numpy(float), float(bias.iloc[0]) if len(bias) else -30.0)


def scorer(docs: DataFrame, model: Model):
    """A function from a text column to its score, 0 to 1; a null or empty text scores the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.index, model.weight, model.bias))

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits, index, weight, bias = shared.value
        dense = np.zeros(1 << bits)
        dense[index] = weight
        hashes = WordHashes()
        for texts in parts:
            total = np.full(len(texts), bias)
            for k, text in enumerate(texts):
                if text and (words := byte_words(text.encode())):
                    ids = feature_ids(words, hashes, bits)
                    total[k] += dense[np.unique(ids[dense[ids] != 0])].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    def call(text: Column) -> Column:
        from pyspark.sql.pandas.functions import pandas_udf

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return pandas_udf(score, "double")(text)

    return call


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, mod: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted.

    A null, empty or blank text scores the bias alone; repeated rows, and equal texts, score equally.
    Texts of any length are scored whole. An empty table gives no rows. Other columns are not read.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), mod).alias("held_out"), scorer(docs, model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
