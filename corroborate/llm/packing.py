"""Packing by power-of-two decomposition: a document's ids are cut into pieces of binary length and
each piece is a sequence of its own, so no sequence crosses documents and none is padded.

Sequences of equal length form the training buckets: ``bucket`` is log2 of the length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import batches

#: Cuts a text where the tokenizer's own pattern always cuts: before a word's one leading space.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space, the tokenizer's pattern does not.
ODD = re.compile("[\x1c-\x1f]")
CACHE = 200_000


def tokenizer_path() -> str:
    """The vocabulary file on this machine; looked up in the task, since executors share no folder."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str):
    """The file's byte-level BPE as a tiktoken encoding: the same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path) as f:
        data = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {x["content"] for x in data["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in data["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("corroborate", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str | None = None):
    """A function from texts to little-endian 32-bit ids (bytes), each text's ids in one string.

    Strings of special tokens are ordinary text. Words are encoded once and kept (at most about
    CACHE of them), as most of a corpus is repeated words; new ones are encoded together.
    """
    import numpy as np

    bpe = vocabulary(path or tokenizer_path())
    known: dict[str, bytes] = {}

    def ids(text: str) -> bytes:
        return np.asarray(bpe.encode_ordinary(text), dtype="<u4").tobytes()

    feed = np.frombuffer(ids("\n"), dtype="<u4")[0]

    def learn(new: list[str]) -> None:
        # A line feed is a token of its own before any chunk with a visible character.
        raw = ids("\n".join(new))
        cut = np.flatnonzero(np.frombuffer(raw, dtype="<u4") == feed).tolist()
        if len(cut) != len(new) - 1:
            raise AssertionError("line feeds are not tokens of their own")
        known.update({x: raw[4 * s : 4 * e] for x, s, e in zip(new, [0, *(c + 1 for c in cut)], [*cut, len(raw) // 4], strict=True)})

    def encode(texts: list[str]) -> Iterator[bytes]:
        if len(known) > CACHE:
            known.clear()
        cuts = [None if ODD.search(x) else CHUNK.findall(x) for x in texts]
        new = set().union(*[x for x in cuts if x]).difference(known)
        known.update({x: ids(x) for x in new if x.isspace()})
        if worded := [x for x in new if not x.isspace()]:
            learn(worded)
        for text, cut in zip(texts, cuts, strict=True):
            yield ids(text) if cut is None else b"".join(map(known.__getitem__, cut))

    return encode


def piece_lengths(n: int, most: int) -> list[int]:
    """Lengths that sum to n: as many of ``most`` as fit, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, most: int = 1024, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    ``most`` is a power of two. A document is its text's ids, then id 0; a null or empty text is the
    0 alone, so every row has a piece. Whole texts are encoded. ``with_ids`` adds the ids themselves.
    Repeated rows give their own sequences; an empty table gives none. Other columns are not read.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("the longest sequence must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + (", ids binary" if with_ids else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(path)
        for batch in batches(rows, 2 << 20):
            texts = batch.column(1).to_pylist()
            at, start, length, crc, total, own = [], [], [], [], [], []
            for k, ids in enumerate(encode([x or "" for x in texts])):
                ids += b"\0\0\0\0"
                n, s = len(ids) // 4, 0
                for size in piece_lengths(n, most):
                    cut = ids[4 * s : 4 * (s + size)]
                    at.append(k)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    total.append(n)
                    if with_ids:
                        own.append(cut)
                    s += size
            cols = [batch.column(0).take(pa.array(np.asarray(at, dtype=np.int64))), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                cols.append(pa.array(own, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    cut = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    # The rows come straight from the scan in a fixed order, so a repeated task gives the same numbers.
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})
