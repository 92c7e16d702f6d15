"""Line dedup by pairwise alignment.

A single short line is often common, a run of lines rarely is. So the key of a line is the hash of the
shortest run of lines from it, and to it, with ``least_words`` words: two documents share such a block
exactly if they share the keys of its lines. Documents that share a key are paired with its first
holder (a star, so pairs grow with the shared keys and not with their square). Each pair is aligned by
patience diff over its line hashes, and what that leaves is aligned by patience again, over the runs that
both still share, until no common block is left: moved blocks come in a later round. Aligned blocks of at
least ``least_words`` words go from the later document; nothing else does.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import Scratch, batches, byte_words, few, fresh, join_counted, materialize

#: Keys of texts that lose lines are broadcast up to this many (some 170 bytes each); beyond, the same joins shuffle.
KEY_ROWS = 1_000_000
#: First holders of up to this many lines are broadcast if very many documents meet them.
HOT_LINES = 4096


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both.

    Equal ends are taken first; between them, items that occur once on either side are matched in
    their longest common order, and the gaps are aligned the same way.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        left, right = Counter(a[i:p]), Counter(b[j:q])
        where = {x: k for k, x in enumerate(b[j:q], j) if right[x] == 1}
        once = [(k, where[x]) for k, x in enumerate(a[i:p], i) if left[x] == 1 and x in where]
        if not once:
            continue
        tops, at, back = [], [], []
        for k, (_, y) in enumerate(once):
            n = bisect_left(tops, y)
            back.append(at[n - 1] if n else -1)
            tops[n : n + 1] = [y]
            at[n : n + 1] = [k]
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(once[k])
            k = back[k]
        for x, y in [*reversed(chain), (p, q)]:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        out += chain
    return sorted(out)


def shortest_runs(words: list[int], least_words: int) -> set[tuple[int, int]]:
    """(start, stop) of the shortest runs with ``least_words`` words that start, or end, at each line."""
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    n = len(words)
    stop = np.searchsorted(total, total[:n] + least_words)
    start = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    return {(i, int(e)) for i, e in enumerate(stop) if e <= n} | {(int(i), e + 1) for e, i in enumerate(start) if i >= 0}


def _shared_runs(a: list, b: list, words: list[int], least_words: int) -> tuple[list[tuple], dict[tuple, list[tuple[int, int]]]]:
    """Shortest runs that both hold: in the order of their first places in ``a``, and all their places in ``b``."""
    known, ours, at = dict(zip(b, words, strict=True)), {}, 0
    for k in range(len(a) + 1):  # equal lines have equally many words, and lines of one side only end a run
        if k == len(a) or a[k] not in known:
            part = a[at:k]
            for i, e in sorted(shortest_runs([known[x] for x in part], least_words)):
                ours.setdefault(tuple(part[i:e]), None)
            at = k + 1
    places: dict[tuple, list[tuple[int, int]]] = {}
    for i, e in sorted(shortest_runs(words, least_words)):
        if (run := tuple(b[i:e])) in ours:
            places.setdefault(run, []).append((i, e))
    return [run for run in ours if run in places], places


def common_lines(a: list, b: list, words: list[int], least_words: int) -> list[int]:
    """Positions in ``b`` of aligned blocks with at least ``least_words`` words.

    First the lines are aligned. Then, as long as ``b`` has runs left that ``a`` holds, those are aligned,
    each by its first places: in the order of both or, if that aligns more, in opposite order. A run that is
    aligned goes from all its places. Of n runs, one of the two orders aligns the root of n at least, so the
    rounds are few.
    """
    gone, block = set(), []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= least_words:
                gone.update(y for _, y in block)
            block = []
        block.append((i, j))
    held = set(a)
    if all(j in gone or x not in held for j, x in enumerate(b)):
        return sorted(gone)
    order, places = _shared_runs(a, b, words, least_words)
    left = lambda runs: [run for run in runs if any(y not in gone for i, e in places[run] for y in range(i, e))]
    ours, theirs = left(order), left(places)
    while ours:
        turned = theirs[::-1]
        aligned = {theirs[j] for _, j in patience(ours, theirs)}
        other = {turned[j] for _, j in patience(ours, turned)}
        aligned = aligned if len(aligned) >= len(other) else other
        if not aligned:
            break
        for run in aligned:
            gone.update(y for i, e in places[run] for y in range(i, e))
        ours, theirs = left(ours), left(theirs)
    return sorted(gone)


def run_keys(hashes: list[int], words: list[int], least_words: int) -> list[int]:
    """Distinct keys of the shortest runs with ``least_words`` words that start, or end, at each line."""
    raw = np.asarray(hashes, dtype=np.int64).tobytes()
    return list({xxhash.xxh3_64_intdigest(raw[8 * i : 8 * e]) - (1 << 63) for i, e in shortest_runs(words, least_words)})


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, key (of the text), for each line with a word its hash, words and number, and the run keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            hashes, words, places, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                cut = [byte_words(x) for x in text.split(b"\n")] if text else []
                worded = [k for k, x in enumerate(cut) if x]
                hashes.append([xxhash.xxh3_64_intdigest(b" ".join(cut[k])) - (1 << 63) for k in worded])
                words.append([len(cut[k]) for k in worded])
                places.append(worded)
                keys.append(run_keys(hashes[-1], words[-1], least_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "key", "hashes", "words", "places", "runs"],
            )

    cut = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary"))
    return cut.mapInArrow(run, f"doc_id {kind}, key long, hashes array<long>, words array<int>, places array<int>, runs array<long>")


def removals(docs: DataFrame, least_words: int, kept=materialize) -> DataFrame:
    """(doc_id, key, gone, source_ids): line numbers to remove and the earlier documents' ids; ``kept`` writes the tables between."""
    lined = kept(_lines(docs, least_words).where("doc_id is not null").dropDuplicates(["doc_id", "key"]), "lines")
    keyed = lined.select("doc_id", "key", F.explode("runs").alias("h"))
    held = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    held = kept(held.where("first < last").select("h", "first", "n"), "shared")
    pairs = kept(join_counted(keyed, held, "h", "n").where("first < doc_id").select("doc_id", "key", "first").distinct(), "pairs")
    # A first holder's id may be repeated: each of its texts is aligned. One that very many documents
    # meet stays out of the shuffle, unless it is long.
    met = pairs.groupBy("first").agg(F.count("*").alias("n"))
    earlier = lined.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a")).join(met, "first")
    earlier = kept(earlier.withColumn("n", F.when(F.size("a") <= HOT_LINES, F.col("n")).otherwise(0)), "earlier")
    both = join_counted(pairs, earlier, "first", "n").join(lined, ["doc_id", "key"]).select("doc_id", "key", "first", "a", F.col("hashes").alias("b"), "words", "places")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            gone, keep = [], []
            for a, b, words, places in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                at = common_lines(a, b, words, least_words)
                gone.append([places[k] for k in at])
                keep.append(bool(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "key", "source_id", "gone"]).filter(pa.array(keep, pa.bool_()))

    found = both.mapInArrow(run, f"doc_id {kind}, key long, source_id {kind}, gone array<int>")
    return found.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 20, n_removed: str = "n_removed", source_ids: str = "source_ids") -> DataFrame:
    """``docs`` with common blocks of lines cut from later documents, and two columns more.

    Of two documents the one with the larger doc_id is the later; rows with a null doc_id, and rows
    of the same doc_id among each other, are not compared. Lines compare by their words with A-Z
    lowered; lines without words do not count and stay. A text that loses nothing stays as it is, a
    null text null; one that loses all its lines becomes empty. ``n_removed`` counts removed lines
    (0 for none), ``source_ids`` lists the earlier documents (null for none); a column of ``docs``
    with one of those names is replaced, all others are kept, whatever their names. Repeated rows lose
    the same lines. Texts of any length are aligned whole; a pair's line hashes are held in one task.
    An empty table comes back empty.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rest = docs.drop(n_removed, source_ids)
    id_, key_, lines_, ids_, own_key = (fresh(rest, x) for x in ("gone_id", "gone_key", "gone_lines", "gone_ids", "text_key"))
    with Scratch() as kept:
        gone = materialize(removals(own, least_words, kept), "gone").toDF(id_, key_, lines_, ids_)
    keys = few(gone.select(id_, key_), KEY_ROWS)
    keyed = rest.withColumn(own_key, F.xxhash64(text))
    same = lambda other: (keyed[doc_id] == other[id_]) & (keyed[own_key] == other[key_])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(gone.schema[ids_].dataType)
    whole = keyed.join(keys, same(keys), "left_anti").withColumns({n_removed: zero, source_ids: none})
    # Only texts that lose something are shuffled; a merge join at every size, so that needs grow evenly.
    cut = keyed.join(keys, same(keys), "left_semi")
    cut = cut.join(gone.hint("merge"), (cut[doc_id] == gone[id_]) & (cut[own_key] == gone[key_]))
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lines_, i))
    cut = cut.withColumns({text: F.array_join(left, "\n"), n_removed: F.size(lines_).cast("long"), source_ids: F.col(ids_)})
    return whole.drop(own_key).unionByName(cut.drop(own_key, *gone.columns))
