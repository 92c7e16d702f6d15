"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges, exact confirmation on full shingle sets.

1. One pass over the texts gives each row its set's size, its set's hash (``node``; equal sets
   share it, so copies are never paired) and its band keys.
2. Every bucket with two or more nodes gets a centre and only the links centre-member are candidates.
3. A star can miss a link between two members. So buckets that still hold several components are
   gone through again: small ones by their cross-component pairs, large ones in blocks that meet in
   memory. Each large component has blocks of its own, and two of its blocks never meet.
4. Candidates are confirmed on the full sets; groups are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import Scratch, batches, byte_words, few, fresh, join_counted, materialize, words_of
from corroborate.llm.components import components
from corroborate.llm.hashing import WordHashes, mix, shingles


#: Sets of up to this many shingles are compared in full inside a block.
SMALL_SET = 1024
#: Ids (of texts that share a bucket, of copies to drop) are broadcast up to this many; beyond, the same joins shuffle.
ID_ROWS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """Sets of ``words``-word shingles are linked at 100 * intersection >= ``percent`` * union.

    With the default bands a pair at the limit is missed with a chance under one in a million.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    #: Buckets up to this many members are paired directly where they hold several components.
    small: int = 16
    #: Members of a larger bucket are compared in blocks of about this many.
    block: int = 256

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def probes(bins: int, attempts: int = 64) -> np.ndarray:
    """For each attempt the bin that an empty bin looks at."""
    at = np.arange(attempts * bins, dtype=np.uint64).reshape(attempts, bins)
    return (mix(at + np.uint64(0xD1B54A32D192ED03)) % np.uint64(bins)).astype(np.int64)


def one_permutation(ordered: np.ndarray, bins: int, look: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin; an empty bin takes that of the first full bin it looks at."""
    own = ((ordered >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    full = own[first].astype(np.int64)
    out = np.zeros(bins, dtype=np.uint64)
    out[full] = ordered[first]
    there = np.zeros(bins, dtype=bool)
    there[full] = True
    empty = np.flatnonzero(~there)
    for row in look:
        if not len(empty):
            return out
        target = row[empty]
        hit = there[target]
        out[empty[hit]] = out[target[hit]]
        empty = empty[~hit]
    # Hardly any bin is full: the rest take the next full bin round the circle.
    out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
    return out


def shingle_set(text: bytes | None, hashes: WordHashes, words: int) -> np.ndarray:
    return np.unique(shingles(hashes.of(byte_words(text)), words))


def node_of(ordered: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ordered.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, node, sig (8 bits a bin), bands; node is null for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, look = WordHashes(), probes(s.bins)
        salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64))
        for batch in batches(parts, 4 << 20):
            n, node, sigs = [], [], np.zeros((batch.num_rows, s.bins), dtype=np.uint64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = shingle_set(text, hashes, s.words)
                n.append(len(own))
                node.append(node_of(own) if len(own) else None)
                if len(own):
                    sigs[k] = one_permutation(own, s.bins, look)
            key = np.broadcast_to(salt, (batch.num_rows, s.bands)).copy()
            cut = sigs.reshape(batch.num_rows, s.bands, s.rows)
            for r in range(s.rows):
                key = mix(key ^ cut[:, :, r])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, s.bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
            low = [x.tobytes() for x in sigs.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary()), bands], names=["doc_id", "n_shingles", "node", "sig", "bands"]
            )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """node and the sorted set (64-bit hashes) of each text of ``docs`` that has words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(parts, 4 << 20):
            sets = [x for x in (shingle_set(t, hashes, s.words) for t in batch.column(0).to_pylist()) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "members"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "node long, members binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bins(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def _least_agreement(smaller: np.ndarray, percent: int) -> np.ndarray:
    """The share of equal bins under which a pair cannot be a link but for a chance below 1e-7.

    The fewer shingles, the fewer independent bins and the wider the margin; tiny sets get no limit.
    """
    return np.select([smaller >= 256, smaller >= 128, smaller >= 32], [percent - 16, percent - 26, percent - 35], 0)


def plausible(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that could be links by their sizes and signatures, before any set moves."""
    side = lambda k: prints.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            same = (_bins(batch.column(3).to_pylist()) == _bins(batch.column(4).to_pylist())).mean(axis=1) * 100
            keep = same >= _least_agreement(batch.column(2).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", F.least("n_a", "n_b"), "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _chunks(crowded: DataFrame, s: Settings, kept=materialize) -> tuple[DataFrame, DataFrame]:
    """``crowded`` (bucket, node, root, ...) with ``chunk``, and the (bucket, i, j) of chunks to compare.

    Components larger than a block are cut into chunks of their own, the others share chunks.
    """
    sizes = kept(crowded.groupBy("bucket", "root").agg(F.count("*").alias("size")), "sizes")
    large = F.col("size") > s.block
    rest = sizes.groupBy("bucket").agg(F.sum(F.when(large, 0).otherwise(F.col("size"))).alias("rest"))
    part = lambda n, by: F.pmod(F.xxhash64(by), F.ceil(F.col(n) / s.block).cast("int")).cast("long")
    cut = join_counted(crowded, kept(sizes.join(rest, "bucket"), "sizes"), ["bucket", "root"], "size")
    home = F.when(large, F.col("root"))
    cut = kept(cut.withColumn("home", home).withColumn("chunk", F.when(large, F.xxhash64("root", part("size", "node"))).otherwise(part("rest", "root"))).drop("size", "rest"), "chunks")
    held = cut.select("bucket", "chunk", "home").distinct()
    one, two = held.alias("p"), held.alias("q")
    apart = F.col("p.home").isNull() | F.col("q.home").isNull() | (F.col("p.home") != F.col("q.home"))
    met = one.join(two, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.chunk") <= F.col("q.chunk"))).where(apart)
    return cut.drop("home"), met.select(F.col("p.bucket").alias("bucket"), F.col("p.chunk").alias("i"), F.col("q.chunk").alias("j")).distinct()


def _blocks(crowded: DataFrame, sets: DataFrame, s: Settings, kept=materialize) -> DataFrame:
    """Pairs of different components in large buckets, chunk against chunk in memory.

    Only pairs leave the task whose sizes allow a link, whose signatures agree about as far as a
    link's would, and, for sets up to SMALL_SET shingles, whose full sets are linked; so what is
    emitted does not grow with the square of a bucket.
    """
    cut, met = _chunks(crowded.select("bucket", "node", "root"), s, kept)
    met = kept(met, "met")
    both = met.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    cut = cut.join(both, ["bucket", "chunk"]).join(sets.withColumn("members", F.when(F.col("n_shingles") <= SMALL_SET, F.col("members"))), "node")
    cut = cut.select("bucket", "i", "j", "chunk", "node", "root", "n_shingles", "sig", "members")

    def run(block: pa.Table) -> pa.Table:
        col = {k: block.column(k).to_numpy() for k in ("node", "root", "n_shingles", "chunk", "i", "j")}
        sig = _bins(block.column("sig").to_pylist())
        sets = [None if x is None else np.frombuffer(x, np.uint64) for x in block.column("members").to_pylist()]
        a, b = [], []
        for k in range(len(sig)):
            rest = slice(k + 1, None)
            ok = col["root"][rest] != col["root"][k]
            if col["i"][0] != col["j"][0]:
                ok &= col["chunk"][rest] != col["chunk"][k]
            small, large = np.minimum(col["n_shingles"][rest], col["n_shingles"][k]), np.maximum(col["n_shingles"][rest], col["n_shingles"][k])
            ok &= 100 * small >= s.percent * large
            at = np.flatnonzero(ok) + k + 1
            if not len(at):
                continue
            at = at[(sig[at] == sig[k]).mean(axis=1) * 100 >= _least_agreement(small[at - k - 1], s.percent)]
            for m in at:
                if sets[k] is None or sets[m] is None or _linked(sets[k], sets[m], s.percent):
                    a.append(col["node"][k])
                    b.append(col["node"][m])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, node, component_id and kept.

    component_id is the smallest doc_id reachable over links, kept says that it is the row's own.
    Texts without words (null, empty, blank) have no shingles and stand alone. Fewer words than a
    shingle count as one shingle. Rows with equal sets are linked however many they are; rows that
    repeat a doc_id are judged by their own texts. Texts of any length count with all their shingles;
    one text's set is held in one task. An empty table gives no rows. Other columns of ``docs`` are not
    read.
    """
    return _rooted(docs, settings or Settings(), doc_id, text).drop("root")


def _rooted(docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """The rows of ``groups`` and the root node of each one's component."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seen = materialize(signatures(own, s), "signatures")
    with Scratch() as kept:
        banded = seen.where("node is not null").select("node", F.explode("bands").alias("bucket"))
        mixed = F.col("node").bitwiseXOR(F.col("bucket"))
        shared = banded.groupBy("bucket").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high"), F.count("*").alias("n")).where("low < high")
        shared = kept(shared.select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("centre"), "n"), "shared")
        members = kept(join_counted(banded, shared, "bucket", "n").select("bucket", "centre", "node").distinct(), "members")

        # Copies are counted before any join, so a large group of them meets nowhere.
        counted = seen.where("node is not null").groupBy("node")
        firsts = kept(counted.agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "firsts")
        nodes = kept(members.select("node").distinct(), "nodes")
        holder = kept(firsts.join(few(nodes, ID_ROWS), "node", "left_semi").select(F.col("node").alias("_node"), F.col("first").alias("_id")), "holders")
        holder = few(holder, ID_ROWS)
        texts = own.join(holder, own["doc_id"].eqNullSafe(holder["_id"]), "left_semi")
        sets = full_sets(texts, s).join(few(nodes, ID_ROWS), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))
        sets = kept(sets, "sets")
        prints = seen.join(holder, (seen["node"] == holder["_node"]) & seen["doc_id"].eqNullSafe(holder["_id"])).groupBy("node")
        prints = kept(prints.agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "prints")

        star = kept(members.where("node != centre").select(*_ordered(F.col("node"), F.col("centre"))).distinct(), "star")
        links = kept(confirm(plausible(star, prints, s.percent), sets, s.percent), "links")
        roots = components(links, scratch=kept)

        labelled = members.join(roots, "node", "left").select("bucket", "centre", "node", F.coalesce("root", "node").alias("root"))
        still = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
        split = kept(join_counted(labelled, kept(still, "still"), "bucket", "n"), "split")
        small = kept(split.where(F.col("n") <= s.small).join(firsts.select("node", "n_shingles"), "node"), "small")
        crowded = split.where(F.col("n") > s.small)
        compared = prints.join(sets, "node")
        one, two = small.alias("p"), small.alias("q")
        sized = 100 * F.least("p.n_shingles", "q.n_shingles") >= s.percent * F.greatest("p.n_shingles", "q.n_shingles")
        direct = one.join(two, F.col("p.bucket") == F.col("q.bucket")).where((F.col("p.node") < F.col("q.node")) & (F.col("p.root") != F.col("q.root")) & sized)
        direct = direct.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
        more = direct.union(_blocks(crowded, compared, s, kept).select(*_ordered(F.col("a"), F.col("b")))).distinct().join(star, ["a", "b"], "left_anti")
        late = kept(confirm(plausible(more, prints, s.percent), sets, s.percent), "late")
        if not late.isEmpty():
            roots = components(late.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch=kept)

        nodes = firsts.drop("n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        nodes = kept(nodes, "nodes")
        least = kept(nodes.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
        placed = materialize(join_counted(nodes, least, "root", "n").select("node", "root", "least", "copies"), "placed")
    out = join_counted(seen.select("doc_id", "n_shingles", "node"), placed, "node", "copies", "left")
    out = out.withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "node", "root", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group left, all columns as they were.

    The group's smallest doc_id stays. Rows that repeat a doc_id are judged by their own texts, and one of
    those in a group stays (the one whose values sort first as JSON); rows without words are linked with
    nothing and stay. An empty table comes back empty. Columns may have any names.
    """
    s = settings or Settings()
    own_id, node_, root_, text_, row_, again_ = (fresh(docs, x) for x in ("id", "node", "root", "text", "row", "again"))
    all_rows = materialize(_rooted(docs, s, doc_id, text).select(F.col("doc_id").alias(own_id), F.col("node").alias(node_), F.col("root").alias(root_), "kept"), "kept")
    per_id = all_rows.groupBy(own_id).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    again = few(materialize(per_id.where("kept and n > 1").select(F.col(own_id).alias(again_)), "again"), ID_ROWS)
    # Most ids stay, so the others are looked up.
    other = few(materialize(per_id.where("not kept or n > 1").select(own_id), "other"), ID_ROWS)
    single = docs.join(other, docs[doc_id].eqNullSafe(other[own_id]), "left_anti")
    repeated = docs.join(again, docs[doc_id].eqNullSafe(again[again_]), "left_semi")
    worded = F.size(words_of(F.col(text))) > 0
    # Nodes of the repeated rows' texts; only they are hashed again.
    texts = repeated.where(worded).select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
    nodes = signatures(texts, s).select(F.col("doc_id").alias(text_), F.col("node").alias(node_))
    roots = all_rows.where("kept").where(F.col(node_).isNotNull()).join(again, F.col(own_id).eqNullSafe(F.col(again_)), "left_semi").select(own_id, node_, root_).distinct()
    values = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row_)
    rows = repeated.where(worded).select(F.col(doc_id).alias(again_), F.xxhash64(text).alias(text_), values).join(nodes, text_)
    rows = rows.join(roots, (rows[node_] == roots[node_]) & rows[again_].eqNullSafe(roots[own_id]))
    one = rows.groupBy(again_, root_).agg(F.min_by(row_, F.to_json(row_)).alias(row_))
    return single.unionByName(repeated.where(~worded)).unionByName(one.select(f"{row_}.*"))
