"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming
blocks, exact verification on weighted shingles.

Native. Which windows are fingerprinted: of all windows of an item's length the best one starts with
one of the item's shingles (moving a window past a foreign shingle never lowers the similarity), and
it holds at least as many item shingles as the limit asks for. So windows start only at shingles that
occur in items, where enough of them follow; none that could reach the limit is left out. Equal
windows are fingerprinted once, however many documents hold them.

Each window's 64-bit fingerprint is cut into BLOCKS blocks; within RADIUS bits of an item, one block at
least differs in RADIUS // BLOCKS bits at most, and the items' index holds all such variants, so no
fingerprint within the radius is missed. How far fingerprints differ at a similarity of exactly 0.8
depends on the item's length. Simulated, with the share beyond RADIUS: 4 of 5 shingles 12.0 bits on
average, deviation 3.1, 3 to 4 misses in 10,000; 12 of 15 10.3, 2.9, 5 in 100,000; from 8 of 10 on 8.8 to
9.3, 2.8, 2 in 100,000 at most. Above 0.8 they are fewer, and a copy is never missed. Candidates are
verified on the shingles themselves, counted as often as they occur.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import Scratch, few, fresh, materialize

#: All ASCII but digits and letters separates words (texts are lowered before).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, BLOCKS, RADIUS = 5, 8, 23
#: Broadcast limits, in rows; beyond them the same joins shuffle.
ITEM_ROWS, DOC_ROWS = 2_000_000, 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def shingle_hashes(words: str, n: int) -> Column:
    """64-bit hashes of the n-word windows of a column of words, by position."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def shingle_texts(words: str, n: Column) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def fingerprint(hashes: str) -> Column:
    """SimHash: bit b is set if most of the hashes have it (repeats weigh as often as they occur)."""
    def bit(b: int) -> Column:
        most = 2 * F.size(F.filter(hashes, lambda x: F.getbit(x, F.lit(b)) == 1)) > F.size(hashes)
        return F.when(most, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def blocks(print_: str) -> Column:
    width = 64 // BLOCKS
    return F.array(*[F.shiftrightunsigned(print_, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for k in range(BLOCKS)])


def variants() -> list[int]:
    """Masks over one block with at most RADIUS // BLOCKS bits."""
    width, most = 64 // BLOCKS, RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def similarity(a: str, b: str) -> Column:
    """Sum of the smaller counts over the sum of the larger, per shingle."""
    times = lambda x, own: F.size(F.filter(own, lambda y: y == x))
    simple = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(x, F.col(a)), times(x, F.col(b))))
    both = F.when(simple, F.size(F.array_intersect(a, b))).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def starts(positions: str, m: Column, total: Column, limit: float) -> Column:
    """Those of the sorted ``positions`` of item shingles at which a window of ``m`` shingles could reach ``limit``.

    Of two sets of m and w shingles that reach it, limit / (1 + limit) of m + w at least are common.
    """
    def enough(p: Column, i: Column) -> Column:
        common = F.ceil(F.lit(limit / (1 + limit)) * (m + F.least(m, total - p)) - 1e-9).cast("int")
        return F.coalesce(F.get(positions, i + F.greatest(common, F.lit(1)) - 1) < p + m, F.lit(False))

    return F.filter(positions, enough)


def matches(docs: DataFrame, items: DataFrame, limit: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", kept=materialize) -> DataFrame:
    """(key, item_id, similarity): the best window of each text and item that reaches ``limit``.

    ``key`` is xxhash64(doc_id, text). Items without words are never found; items of fewer words than
    a shingle are one shingle. Repeated rows share a key. ``kept`` writes the tables between.
    """
    keyed = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"))
    bank = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item")).where(F.size("item") > 0).distinct()
    bank = kept(bank.withColumn("n", F.size("item")).withColumn("size", F.least(F.lit(SHINGLE), F.col("n"))), "items")
    sizes = sorted(r["size"] for r in bank.select("size").distinct().collect())  # five at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"key long, item_id {items.schema[item_id].dataType.simpleString()}, similarity double")

    def hashes(words: str, size: Column) -> Column:
        pick = F.when(F.lit(False), F.array().cast("array<bigint>"))
        for s in sizes:
            pick = pick.when(size == s, shingle_hashes(words, s))
        return pick

    pieces = bank.select("n", "size", F.explode(hashes("item", F.col("size"))).alias("h")).distinct()
    pieces = few(kept(pieces, "pieces"), ITEM_ROWS)
    # The length is taken before the words are exploded, so that rows carry it and not the words.
    cut = keyed.select("key", words_of(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    hits = None
    for s in sizes:
        placed = cut.select("key", "length", F.posexplode(shingle_hashes("words", s)).alias("pos", "h"))
        more = placed.join(pieces.where(F.col("size") == s), "h").select("key", "length", "n", "size", "pos")
        hits = more if hits is None else hits.union(more)
    # A group is what one text holds.
    runs = hits.groupBy("key", "length", "n", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    m = F.col("n") - F.col("size") + 1
    runs = runs.select("key", "n", "size", starts("at", m, F.greatest(F.col("length") - F.col("size") + 1, F.lit(1)), limit).alias("starts"))
    runs = kept(runs.where(F.size("starts") > 0), "starts")
    found = kept(runs.select("key").distinct(), "keys")
    near = keyed.join(few(found, DOC_ROWS), "key", "left_semi").dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words"))
    window = lambda p: F.slice("words", p + 1, F.col("n"))
    placed = F.explode(F.transform("starts", lambda p: F.struct(F.xxhash64(window(p)).alias("same"), p.alias("start")))).alias("w")
    places = kept(runs.join(near, "key").select("key", "n", "size", placed).select("key", "n", "size", "w.same", "w.start"), "places")

    first = places.groupBy("same", "n", "size").agg(F.min(F.struct("key", "start")).alias("at"))
    windows = first.select("same", "n", "size", "at.key", "at.start").join(near, "key").select("same", "n", "size", window(F.col("start")).alias("window"))
    windows = windows.withColumn("hashes", hashes("window", F.col("size"))).withColumn("print", fingerprint("hashes"))
    windows = kept(windows.select("same", "n", "size", "window", "print"), "windows")
    probes = windows.select("same", "n", F.col("print").alias("w_print"), F.posexplode(blocks("print")).alias("block", "value"))
    marked = bank.withColumn("hashes", hashes("item", F.col("size"))).withColumn("print", fingerprint("hashes"))
    masks = F.array(*map(F.lit, variants()))
    index = marked.select("item_id", "n", F.col("print").alias("i_print"), F.posexplode(blocks("print")).alias("block", "own"))
    index = index.select("item_id", "n", "i_print", "block", F.explode(F.transform(masks, lambda x: F.col("own").bitwiseXOR(x))).alias("value"))
    index = few(kept(index, "index"), ITEM_ROWS)
    close = probes.join(index, ["n", "block", "value"]).where(F.bit_count(F.col("w_print").bitwiseXOR(F.col("i_print"))) <= RADIUS).select("same", "n", "item_id").distinct()
    pairs = close.join(windows, ["same", "n"]).join(bank.select("item_id", "item", "n"), ["item_id", "n"])
    pairs = pairs.select("same", "n", "item_id", shingle_texts("window", F.col("size")).alias("a"), shingle_texts("item", F.col("size")).alias("b"))
    scored = kept(pairs.select("same", "n", "item_id", similarity("a", "b").alias("similarity")).where(F.col("similarity") >= limit), "scored")
    return places.join(few(scored, DOC_ROWS), ["same", "n"]).groupBy("key", "item_id").agg(F.max("similarity").alias("similarity"))


def mark(docs: DataFrame, items: DataFrame, limit: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids (sorted) and the best similarity.

    Null and empty texts are clean; so is everything when there are no items. Repeated rows are each
    marked; rows that share an id are judged by their own texts. Texts of any length are searched
    whole. An empty table gives no rows. Other columns are unread.
    """
    with Scratch() as kept:
        found = materialize(matches(docs, items, limit, doc_id, text, kept=kept), "matches")
    by_key = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"))
    out = rows.join(by_key, "key", "left")
    none = F.array().cast(by_key.schema["item_ids"].dataType)
    return out.select("doc_id", F.col("similarity").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, items: DataFrame, limit: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were, whatever their names.

    Decides as ``mark`` does: rows without words stay, repeated rows stay or go together, and an empty
    table (or one of no items) comes back as it is.
    """
    with Scratch() as kept:
        found = matches(docs, items, limit, doc_id, text, kept=kept).select(F.col("key").alias(fresh(docs, "found"))).distinct()
        found = materialize(found, "contaminated")
    own = fresh(docs, "own_key")
    rows = docs.withColumn(own, F.xxhash64(doc_id, text))
    return rows.join(few(found, DOC_ROWS), F.col(own) == F.col(found.columns[0]), "left_anti").drop(own)
