"""Ranked lexical search: a block-max index over shards of documents, searched for a set of queries.

Index: documents are numbered within shards of bounded size, each made by one task from rows it reads
anyway. A term's postings are cut into blocks of BLOCK; a block is compressed (gaps and counts at the
least width) and has its first and last document and its largest impact beside it.

Search (Block-Max WAND, for all windows of a query at once): the block ends of a query's terms cut a
shard into windows in which every term has at most one block. Moving over block ends only (shallow
moves), the sum of the blocks' largest impacts bounds every score in a window; windows below the
threshold are passed without decompressing anything, and since a term without a block there adds
nothing, this also covers the pivot test by whole lists. Other windows are decompressed from the
highest bound down, and the threshold, the 50th best score so far, rises until no window is left above
it. A few shards go first; the scores they give are the threshold that all others start from.

Scores are integers, so they are the same however the documents are dealt.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.llm.common import LOWER, UPPER, Scratch, batches, materialize

#: Postings in a block.
BLOCK = 128
#: A term: no ASCII character but digits and letters ends it.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    top: int = 50
    #: Most documents and postings of a shard (a single document may have more postings).
    documents: int = 65_536
    postings: int = 2_000_000
    #: Shards searched first, for the threshold of the rest.
    first: int = 8
    #: Most terms of all queries of one pass, counted per query: what is sent to every task.
    query_terms: int = 500_000


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z lowered."""
    return text.translate(_BYTES).split() if text else []


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a posting's score that does not depend on the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes per value, and the values at that width."""
    most = int(values.max())
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return width, values.astype(f"<u{width}").tobytes()


def compress(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """A block: both widths, then gaps from the first document, then counts."""
    (a, gaps), (b, counts) = _narrow(np.diff(docs, prepend=docs[0])), _narrow(tf)
    return bytes((a, b)) + gaps + counts


def decompress(block: bytes, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = block[0], block[1]
    gaps = np.frombuffer(block, f"<u{a}", n, 2)
    return first + np.cumsum(gaps, dtype=np.int64), np.frombuffer(block, f"<u{b}", n, 2 + a * n).astype(np.int64)


# ---- the index


FORWARD = "doc_id long, n long, terms array<int>, tf array<long>"
LISTS = "shard long, term int, n_docs long, first binary, last binary, most binary, sizes binary, blocks binary"


def forward(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n (terms of the whole text, with repeats) and the counts of the terms of ``vocabulary``."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            ns, terms, tfs = [], [], []
            for t in batch.column(1):
                words = terms_of(t.as_py())
                held = sorted((k, c) for w, c in Counter(words).items() if (k := vocabulary.get(w)) is not None)
                ns.append(len(words))
                terms.append([k for k, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(count, FORWARD)


def _order(ids: list[int | None]) -> list[int]:
    """Places of the ids in ascending order, nulls last."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))


def shard_lists(rows: list[tuple], n_docs: int, n_terms: int) -> Iterator[dict]:
    """A shard's lists from (doc_id, n, terms, tf) rows: one with the documents (term -1), then one per term.

    ``n_docs`` and ``n_terms`` are those of the whole collection: documents with a term, and their terms.
    """
    rows = [rows[i] for i in _order([r[0] for r in rows])]
    n = np.array([r[1] for r in rows], np.int64)
    m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
    ids = np.array([r[0] or 0 for r in rows], np.int64)
    named = np.array([r[0] is not None for r in rows], np.uint8)
    yield {"term": -1, "n_docs": len(rows), "first": ids.tobytes(), "last": m.tobytes(), "most": named.tobytes(), "sizes": b"", "blocks": b""}
    docs = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    terms = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    tf = np.concatenate([np.asarray(r[3], np.int64) for r in rows])
    by_term = np.argsort(terms, kind="stable")
    terms, docs, tf = terms[by_term], docs[by_term], tf[by_term]
    edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1)) if len(terms) else np.array([0])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        cuts = np.arange(a, b, BLOCK)
        ends = np.minimum(cuts + BLOCK, b)
        most = np.maximum.reduceat(impacts(tf[a:b], m[docs[a:b]]), cuts - a)
        blocks = [compress(docs[x:y], tf[x:y]) for x, y in zip(cuts, ends, strict=True)]
        yield {
            "term": int(terms[a]), "n_docs": int(b - a), "first": docs[cuts].astype(np.int64).tobytes(), "last": docs[ends - 1].astype(np.int64).tobytes(), "most": most.astype(np.int64).tobytes(),
            "sizes": np.array([len(x) for x in blocks], np.int64).tobytes(), "blocks": b"".join(blocks),
        }


def index(rows: DataFrame, n_docs: int, n_terms: int, s: Settings) -> DataFrame:
    """The lists of all shards from ``forward`` rows; documents without a term of the vocabulary have no postings."""

    def build(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, shard = [], 0, TaskContext.get().partitionId() << 24

        def write() -> Iterator[pa.RecordBatch]:
            lists = [x | {"shard": shard} for x in shard_lists(held, n_docs, n_terms)]
            schema = pa.schema([(c, pa.int64() if c in ("shard", "n_docs") else pa.int32() if c == "term" else pa.binary()) for c in (x.split()[0] for x in LISTS.split(", "))])
            yield pa.RecordBatch.from_pylist(lists, schema)

        for batch in batches_:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                postings += len(row[2])
                if len(held) >= s.documents or postings >= s.postings:
                    yield from write()
                    held, postings, shard = [], 0, shard + 1
        if held:
            yield from write()

    return rows.where(F.size("terms") > 0).mapInArrow(build, LISTS)


# ---- the search


@dataclass
class Postings:
    """A term's blocks within a shard; decompressed ones are kept."""

    first: np.ndarray
    last: np.ndarray
    most: np.ndarray
    n_docs: int
    places: np.ndarray
    blocks: bytes
    opened: dict = field(default_factory=dict)

    def open(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block ``k``."""
        if k not in self.opened:
            docs, tf = decompress(self.blocks[self.places[k] : self.places[k + 1]], self.first[k], min(BLOCK, self.n_docs - k * BLOCK))
            self.opened[k] = docs, impacts(tf, m[docs])
        return self.opened[k]


class Shard:
    def __init__(self, lists: pd.DataFrame):
        whole = lambda x: np.frombuffer(x, np.int64)
        head = lists[lists.term < 0].iloc[0]
        self.ids, self.m, self.named = whole(head["first"]), whole(head["last"]), np.frombuffer(head["most"], np.uint8)
        self.terms = {}
        for x in lists[lists.term >= 0].itertuples():
            self.terms[x.term] = Postings(whole(x.first), whole(x.last), whole(x.most), x.n_docs, np.concatenate([[0], np.cumsum(whole(x.sizes))]), x.blocks)
        self.scores = np.zeros(len(self.ids), np.int64)
        self.inside = np.zeros(len(self.ids), bool)

    def search(self, query: list[tuple[int, int]], top: int, least: int, step: int = 16) -> list[tuple[int, int]]:
        """(document, score) of the ``top`` highest scores from ``least`` (1 or more) up, equal ones by number; not sorted."""
        held = [(w, self.terms[t]) for t, w in query if w > 0 and t in self.terms]
        if not held:
            return []
        ends = np.unique(np.concatenate([p.last for _, p in held]))
        starts = np.concatenate([[0], ends[:-1] + 1])
        bound, at = np.zeros(len(ends), np.int64), []
        for w, p in held:  # shallow moves
            k = np.searchsorted(p.last, starts)
            there = np.minimum(k, len(p.last) - 1)
            k = np.where((k < len(p.last)) & (p.first[there] <= ends), k, -1)
            bound += np.where(k >= 0, w * p.most[there], 0)
            at.append(k)
        order = np.argsort(-bound, kind="stable")
        docs, scores, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while done < len(order) and bound[order[done]] >= least:
            now = order[done : done + step]
            now = now[bound[now] >= least]
            done, step = done + len(now), step * 2
            spans = [slice(starts[k], ends[k] + 1) for k in now]
            for x in spans:
                self.inside[x] = True
                self.scores[x] = 0
            for (w, p), k in zip(held, at, strict=True):
                for b in np.unique(k[now]):
                    if b >= 0:
                        found, impact = p.open(int(b), self.m)
                        keep = self.inside[found]
                        self.scores[found[keep]] += w * impact[keep]
            fresh = np.concatenate([np.arange(x.start, x.stop)[self.scores[x] >= least] for x in spans])
            for x in spans:
                self.inside[x] = False
            docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, self.scores[fresh]])
            best = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[best], scores[best]
            if len(docs) == top:
                least = max(least, int(scores[-1]))
        return list(zip(docs.tolist(), scores.tolist(), strict=True))


FOUND = "q int, doc_id long, score long"


def search(lists: DataFrame, queries: dict[int, list[tuple[int, int]]], s: Settings, least: dict[int, int] | None = None) -> DataFrame:
    """Each shard's ``top`` documents for each query (its terms and their weights), scores from ``least`` up."""

    def of_shard(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows)
        out = [(q, shard.ids[d] if shard.named[d] else None, x) for q, terms in queries.items() for d, x in shard.search(terms, s.top, (least or {}).get(q, 1))]
        return pd.DataFrame(out, columns=["q", "doc_id", "score"]).astype({"q": "int32", "doc_id": "Int64", "score": "int64"})

    return lists.groupBy("shard").applyInPandas(of_shard, FOUND)


def best(found: DataFrame, top: int) -> DataFrame:
    """(q, rank, doc_id, score) of the ``top`` rows of each query; tasks keep no more than that of what they send."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pass(docs: DataFrame, queries: list[tuple[int, list[str]]], doc_id: str, text: str, s: Settings) -> DataFrame:
    """Search for one block of queries, whose terms are few enough to be sent to every task."""
    vocabulary = {w.encode(): k for k, w in enumerate(sorted({w for _, ws in queries for w in ws}))}
    with Scratch() as scratch:
        rows = scratch(forward(docs, vocabulary, doc_id, text), "forward")
        n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # At most one row for each term of the queries comes back.
        df = {r["t"]: r["n"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        weight = {k: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for k, n in df.items()}
        asked = {q: [(k, weight[k]) for k in (vocabulary[w.encode()] for w in ws) if k in weight] for q, ws in queries}
        lists = scratch(index(rows, n_docs, n_terms, s), "postings")
        shards = [r["shard"] for r in lists.where("term = -1").select("shard").orderBy("shard").limit(s.first + 1).collect()]
        early = scratch(search(lists.where(F.col("shard") <= shards[: s.first][-1]) if shards else lists, asked, s), "early")
        found = early
        if len(shards) > s.first:
            reached = best(early, s.top).where(F.col("rank") == s.top)
            least = {r["q"]: r["score"] for r in reached.select("q", "score").collect()}
            found = early.unionByName(search(lists.where(F.col("shard") > shards[s.first - 1]), asked, s, least))
        return materialize(best(found, s.top), "ranked")


def rank(docs: DataFrame, items: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``s.top`` documents of the highest score above 0 for every item.

    Each row of ``items`` is ranked, so a repeated item gives its ranks again; items without terms, and an
    empty table, give none. Each row of ``docs`` is a document, repeated rows too; equal scores go by
    ascending doc_id, null last. Null and empty texts have no terms and count nowhere. Texts of any length
    are read whole. Items are taken in blocks of about ``s.query_terms`` terms, one pass over ``docs`` each
    (an item is never split). Other columns are unread.
    """
    cut = F.array_remove(F.array_distinct(F.split(F.translate(F.coalesce(F.col(item_text), F.lit("")), UPPER, LOWER), BREAK)), "")
    asked = materialize(items.select(F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("row"), cut.alias("terms")).where(F.size("terms") > 0), "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / s.query_terms))
    out = None
    for k in range(blocks):
        queries = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "item_id", "terms").orderBy("row").collect()
        ranked = _pass(docs, [(q, r["terms"]) for q, r in enumerate(queries)], doc_id, text, s)
        names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(queries)], f"q int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        got = ranked.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out
