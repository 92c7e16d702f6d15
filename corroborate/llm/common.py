"""Small helpers that the corpus operators share.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``: all executors
see it, so work that is cut there survives the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.sources.shared import Scratch, discard, materialize  # noqa: F401

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Keys with more than one in so many of the rows are joined by broadcast: fewer than that many keys.
HOT_KEYS = 2000


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted``, in which ``key`` is unique and ``n`` counts the key's rows.

    Rows of the most common keys stay where they are and meet a broadcast of fewer than HOT_KEYS keys,
    whatever the input; all others are shuffled. ``counted`` should be materialised (it is read often).
    """
    total, keys = counted.agg(F.sum(n)).first()[0] or 0, [key] if isinstance(key, str) else key
    hot, cold = counted.where(F.col(n) * HOT_KEYS > total), counted.where(F.col(n) * HOT_KEYS <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (it should be materialised)."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    known, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in known:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily so that column pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, mod: int) -> Column:
    """True where crc32 of the id's text leaves remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == 2, F.lit(False))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered: bytes.split cuts at exactly the ASCII white space."""
    return text.lower().split() if text else []


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches into slices of about ``most_bytes``, so long texts do not pile up."""
    for batch in rows:
        n, step = batch.num_rows, batch.num_rows
        if n and batch.nbytes > most_bytes:
            step = max(1, n * most_bytes // batch.nbytes)
        for at in range(0, n, max(1, step)):
            yield batch.slice(at, step)
