"""LM scoring by a Brown class bigram model: exchange clustering puts words into classes; smoothed
class transitions times word emissions give each text's probability.

1. Words of the training texts are counted.
2. Texts become word numbers, once: the ``head`` most frequent words have their own, all others that
   of their ending, so every word has a class, unknown ones too. Exact counts of the long tail are
   joined in a shuffle. What follows reads numbers only.
3. The ``clustered`` most frequent words and the endings are exchanged one by one over the matrix of
   their bigrams, whose size does not depend on the input.
4. Every word with ``ample`` occurrences and one ``share`` of all tokens, and the endings, are exchanged
   by their own contexts (counts of the classes before and after), in sweeps over partitions against
   the grid of classes. By a share of the tokens, and not a rank or a count alone, about as many words
   are summed densely in a task at every size, and the contexts grow in proportion to the texts.
5. All other words of the head are exchanged the same way, by contexts that meet in a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import batches, byte_words, held_out, materialize

#: Stripped from a word before its ending is taken.
MARKS = ".,;:!?#*%$&|"


@dataclass(frozen=True)
class Settings:
    #: Words with a number of their own, at most. A word over LONGEST bytes counts by a stand-in.
    head: int = 1 << 19
    clustered: int = 512
    #: Occurrences, and share of all tokens, from which a word of the head is exchanged before the others.
    ample: int = 100
    share: float = 2.0**-17
    endings: int = 128
    classes: int = 32
    sweeps: int = 12
    #: Sweeps over the contexts of all ample words, at most; later ones rarely raise the likelihood,
    #: since the contexts of all words that move together are those before the sweep.
    rounds: int = 1
    #: Weight of the class frequencies in a transition.
    backoff: float = 20.0


#: Longer words (rules of dashes, data) are counted and looked up by their digest, so that a table of words is bounded in bytes.
LONGEST = 64


def kept_short(words: list[bytes]) -> list[bytes]:
    """``words``, those over LONGEST bytes as a line tabulation (no word has one), their digest and their last two letters."""
    if not words or max(map(len, words)) <= LONGEST:
        return words
    last = lambda w: w.decode().rstrip(MARKS)[-2:].encode()
    return [w if len(w) <= LONGEST else b"\x0b" + xxhash.xxh3_128_hexdigest(w).encode() + last(w) for w in words]


def ending(word: str, n: int) -> int:
    return zlib.crc32(word.rstrip(MARKS)[-2:].encode()) % n


def _ending(word: Column, n: int) -> Column:
    bare = F.rtrim(word, F.lit(MARKS))
    return F.pmod(F.crc32(F.when(F.length(bare) > 2, F.substring(bare, -2, 2)).otherwise(bare).cast("binary")), F.lit(n)).cast("int")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one text column); the end of a text counts as word ''."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own], pa.string()), pa.array(own.values(), pa.int64())], names=["word", "n"])
        for batch in batches(parts):
            for text in batch.column(0).to_pylist():
                own.update(kept_short(byte_words(text)))
                own[b""] += 1
            if len(own) > 400_000:
                yield out()
                own.clear()
        yield out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head: its words by falling frequency, and the numbering of all words.

    Numbers below ``size`` are the head's words, then come the endings, then the edge of a text.
    """

    words: bytes  # one after another, cut at line feeds (no word holds one)
    counts: np.ndarray
    hashed: np.ndarray  # each word's ending
    endings: int

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def edge(self) -> int:
        return self.size + self.endings

    def lookup(self) -> Numbers:
        return Numbers(self.words, self.size, self.endings)


class Numbers(dict):
    """Word -> its number; those of words beyond the head are kept up to a limit."""

    def __init__(self, words: bytes, size: int, endings: int):
        super().__init__({w: k for k, w in enumerate(words.split(b"\n"))} if words else {})
        self.first, self.endings, self.kept = size, endings, 0

    def __missing__(self, word: bytes) -> int:
        got = self.first + ending(word.decode(), self.endings)
        if self.kept < 100_000:
            self.kept += 1
            self[word] = got
        return got


def vocabulary(counts: DataFrame, s: Settings) -> tuple[Vocabulary, DataFrame]:
    """The head of ``counts``, and ``counts`` with a column ``head``."""
    # The least count that leaves the head within its bound, from a histogram of few hundred rows.
    fits = F.length("word") > 0
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.where(fits).groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["k"])
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > s.head:
            break
        least = r["k"]
    counts = counts.withColumn("head", (fits & (level >= least)) if least is not None else F.lit(False))
    got = counts.where("head").select("word", "n", _ending(F.col("word"), s.endings).alias("e")).toArrow()  # s.head rows at most
    got = got.sort_by([("n", "descending"), ("word", "ascending")])
    words = "\n".join(got["word"].to_pylist()).encode()
    return Vocabulary(words, got["n"].to_numpy(), got["e"].to_numpy(), s.endings), counts


def numbered(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """The columns of ``docs`` but text (binary, the last one), ``ids`` and ``tail``.

    ``ids`` packs the numbers of the text's words and the edge as 32-bit integers; ``tail`` holds
    xxhash64 of each word beyond the head.
    """
    # Plain values, so that workers need no copy of this package; the last keeps the lookup between tasks.
    shared, kept = docs.sparkSession.sparkContext.broadcast((v.words, v.size, v.endings, {})), docs.columns[:-1]

    def hashed(word: bytes) -> int:
        x = xxhash.xxh64_intdigest(word, 42)  # as Spark's xxhash64 has it
        return x - (1 << 64) * (x >> 63)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size, endings, held = shared.value
        if not held:
            held["number"] = Numbers(words, size, endings)
        number, edge = held["number"], size + endings
        for batch in batches(parts):
            ids, tail = [], []
            for text in batch.column(len(kept)).to_pylist():
                words = kept_short(byte_words(text))
                at = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))
                ids.append(np.append(at, np.int32(edge)).tobytes())
                tail.append([hashed(words[k]) for k in np.flatnonzero(at >= size)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(tail, pa.list_(pa.int64()))], names=[*kept, "ids", "tail"])

    types = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(run, ", ".join([*types, "ids binary", "tail array<long>"]))


def _streams(parts: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[np.ndarray]:
    """The units of the texts of each batch one after another, an edge before the first and after each."""
    for batch in batches(parts, 4 << 20):
        ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
        yield place[np.append(ids[-1:], ids)]


def pair_counts(ids: DataFrame, place: np.ndarray, units: int) -> DataFrame:
    """(pair, n): how often unit b follows unit a (pair = a * units + b); ``place`` gives a number's unit."""
    shared = ids.sparkSession.sparkContext.broadcast(place)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units * units, dtype=np.int64)
        for row in _streams(parts, shared.value):
            total += np.bincount(row[:-1].astype(np.int64) * units + row[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    return ids.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def matrix(ids: DataFrame, place: np.ndarray, units: int) -> np.ndarray:
    got = pair_counts(ids, place, units).toArrow()  # units ** 2 rows at most
    out = np.zeros(units * units)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(units, units)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(grid: np.ndarray, x: np.ndarray, y: np.ndarray, same: float) -> np.ndarray:
    """Likelihood gained by each class if it takes a unit with ``x`` after it, ``y`` before it and ``same`` times itself."""
    r, c = grid.sum(1), grid.sum(0)
    gain = (_f(grid + x) - _f(grid)).sum(1) + (_f(grid + y[:, None]) - _f(grid)).sum(0)
    d = np.diagonal(grid)
    gain += _f(d + x + y + same) - _f(d + x) - _f(d + y) + _f(d)
    return gain - (_f(r + x.sum() + same) - _f(r) + _f(c + y.sum() + same) - _f(c))


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each unit: units move, one by one, to the class that raises the bigram likelihood most.

    The last unit (the edge of a text) keeps the last class for itself.
    """
    n, open_ = len(pairs), classes - 1
    own = np.full(n, classes - 1)
    own[np.argsort(-pairs.sum(1)[:-1], kind="stable")] = np.arange(n - 1) % open_
    hot = np.zeros((n, classes))
    hot[np.arange(n), own] = 1
    to, frm = pairs @ hot, pairs.T @ hot
    grid = hot.T @ to
    near = np.arange(open_)
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-pairs.sum(1)[:-1], kind="stable"):
            a, same = own[u], pairs[u, u]
            x, y = to[u].copy(), frm[u].copy()
            x[a] -= same
            y[a] -= same
            if not x.any() and not y.any() and not same:
                continue
            grid[a] -= x
            grid[:, a] -= y
            grid[a, a] -= same
            gain = gains(grid, x, y, same)
            b = int(near[np.argmax(gain[:open_])])
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += x
            grid[:, b] += y
            grid[b, b] += same
            if b != a:
                own[u] = b
                moved += 1
                to[:, a] -= pairs[:, u]
                to[:, b] += pairs[:, u]
                frm[:, a] -= pairs[u]
                frm[:, b] += pairs[u]
        if not moved:
            break
    return own


def contexts(ids: DataFrame, place: np.ndarray, own: np.ndarray, classes: int) -> DataFrame:
    """One row per unit but the edge: unit, how often each class follows (a0, ...) and precedes it
    (b0, ...), and how often it follows itself (same).

    Each task sums its share before the shuffle, so rows do not grow with the texts but with units and tasks.
    """
    shared = ids.sparkSession.sparkContext.broadcast((place, own.astype(np.int16)))
    names = [f"a{k}" for k in range(classes)] + [f"b{k}" for k in range(classes)] + ["same"]
    wide, edge = len(names), len(own) - 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, cls = shared.value
        total = np.zeros(len(cls) * wide, dtype=np.int32)
        for row in _streams(parts, units):
            c, at = cls[row].astype(np.int64), row.astype(np.int64) * wide
            np.add.at(total, at[:-1] + c[1:], 1)
            np.add.at(total, at[1:] + classes + c[:-1], 1)
            np.add.at(total, at[1:][row[1:] == row[:-1]] + wide - 1, 1)
        table = total.reshape(-1, wide)[:edge]
        seen = np.flatnonzero(table.any(axis=1))
        for k in range(0, len(seen), 4096):
            some = seen[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x, pa.int32()) for x in table[some].T]], names=["unit", *names])

    parts = ids.select("ids").mapInArrow(run, ", ".join(f"{c} int" for c in ("unit", *names)))
    return parts.groupBy("unit").agg(*[F.sum(c).alias(c) for c in names]).sortWithinPartitions("unit")


def rare_contexts(ids: DataFrame, cls: np.ndarray, first: int, size: int, classes: int) -> DataFrame:
    """The columns of ``contexts`` for the words numbered ``first`` to ``size`` - 1; ``cls`` has the class of each number.

    Such a word has few contexts in a task, so only those that occur are moved.
    """
    shared = ids.sparkSession.sparkContext.broadcast(cls.astype(np.int16))
    names = [f"a{k}" for k in range(classes)] + [f"b{k}" for k in range(classes)] + ["same"]
    wide = len(names)

    def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        got, at = np.unique(np.concatenate(codes), return_inverse=True)
        return got, np.bincount(at, np.concatenate(counts), len(got)).astype(np.int32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_class = shared.value
        same = np.arange(len(number_class), dtype=np.int32)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int32))

        def out() -> Iterator[pa.RecordBatch]:
            unit, slot = np.divmod(held[0], wide)
            for k in range(0, len(unit), 1 << 16):
                some = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(unit[some], pa.int32()), pa.array(slot[some], pa.int16()), pa.array(held[1][some], pa.int32())], names=["unit", "slot", "n"])

        for row in _streams(parts, same):
            at = np.flatnonzero((row >= first) & (row < size))  # never the edges at either end
            base, own = row[at].astype(np.int64) * wide, row[at]
            codes = np.concatenate([base + number_class[row[at + 1]], base + classes + number_class[row[at - 1]], base[own == row[at - 1]] + wide - 1])
            held = summed([held[0], codes], [held[1], np.ones(len(codes), np.int32)])
            if len(held[0]) > 1_000_000:
                yield from out()
                held = (np.zeros(0, np.int64), np.zeros(0, np.int32))
        yield from out()

    def wide_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u: np.ndarray, slot: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            units, at = np.unique(u, return_inverse=True)
            for k in range(0, len(units), 4096):
                some = (at >= k) & (at < k + 4096)
                width = min(4096, len(units) - k)
                table = np.bincount((at[some] - k) * wide + slot[some], n[some], width * wide).astype(np.int64).reshape(width, wide)
                yield pa.RecordBatch.from_arrays([pa.array(units[k : k + width], pa.int32()), *[pa.array(x, pa.int64()) for x in table.T]], names=["unit", *names])

        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in parts:
            u, slot, n = (np.append(r, c.to_numpy().astype(np.int64)) for r, c in zip(rest, batch.columns, strict=True))
            cut = int(np.searchsorted(u, u[-1])) if len(u) else 0  # the last word may go on in the next batch
            yield from out(u[:cut], slot[:cut], n[:cut])
            rest = [u[cut:], slot[cut:], n[cut:]]
        yield from out(*rest)

    parts = ids.select("ids").mapInArrow(run, "unit int, slot short, n int")
    return parts.repartition("unit").sortWithinPartitions("unit").mapInArrow(wide_rows, ", ".join(["unit int", *[f"{c} long" for c in names]]))


def choices(near: DataFrame, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The classes after one sweep over ``near``; each task knows its own moves only."""
    classes = len(grid)
    shared = near.sparkSession.sparkContext.broadcast((own, grid))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, full = shared.value[0].copy(), shared.value[1].copy()
        for batch in parts:
            units = batch.column(0).to_numpy()
            counts = np.stack([x.to_numpy() for x in batch.columns[1:]], axis=1).astype(float)
            for u, row in zip(units, counts, strict=True):
                a, x, y, same = cls[u], row[:classes].copy(), row[classes:-1].copy(), row[-1]
                x[a] -= same
                y[a] -= same
                full[a] -= x
                full[:, a] -= y
                full[a, a] -= same
                gain = gains(full, x, y, same)[: classes - 1]
                b = int(np.argmax(gain))
                if gain[b] <= gain[a] + 1e-9:
                    b = int(a)
                full[b] += x
                full[:, b] += y
                full[b, b] += same
                cls[u] = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls[units], pa.int32())], names=["unit", "class"])

    got = near.mapInArrow(run, "unit int, class int").toArrow()  # a row for each word of the head at most
    out = own.copy()
    out[got["unit"].to_numpy()] = got["class"].to_numpy()
    return out


def likelihood(grid: np.ndarray) -> float:
    return float(_f(grid).sum() - _f(grid.sum(0)).sum() - _f(grid.sum(1)).sum())


def cluster(ids: DataFrame, v: Vocabulary, total: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number and the grid of class bigrams.

    Ample words move first, then all other words of the head. A sweep that does not raise the
    likelihood (tasks do not know each other's moves) is not taken.
    """
    tops = min(s.clustered, v.size)
    last = max(tops, int((v.counts >= max(s.ample, s.share * total)).sum()))
    endings = np.arange(s.endings)
    place = np.r_[np.arange(last), last + v.hashed[last:], last + endings, last + s.endings].astype(np.int32)
    # The seed: the most frequent words one by one, the others by their endings.
    coarse = np.r_[np.arange(tops), tops + v.hashed[tops:last], tops + endings, tops + s.endings].astype(np.int32)
    pairs = matrix(ids, coarse[place], tops + s.endings + 1)
    seed = exchange(pairs, s.classes, s.sweeps)
    own = seed[coarse]
    hot = np.eye(s.classes)[seed]
    grid = hot.T @ pairs @ hot
    for _ in range(s.rounds):
        then = choices(contexts(ids, place, own, s.classes), own, grid)
        new = matrix(ids, then[place].astype(np.int32), s.classes)
        if likelihood(new) <= likelihood(grid):
            break
        own, grid = then, new
    own = own[place]
    if last < v.size:
        then = choices(rare_contexts(ids, own, last, v.size, s.classes), own, grid)
        new = matrix(ids, then.astype(np.int32), s.classes)
        if likelihood(new) > likelihood(grid):
            own, grid = then, new
    return own, grid


@dataclass
class Model:
    words: bytes  # the head's words
    word_class: np.ndarray
    number_class: np.ndarray  # class of each number
    log_count: np.ndarray  # log10(n + 1) of each number; 0 for words beyond the head
    step: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of the emissions' denominators by class
    total: int  # N
    base_spread: float  # log10(N + V + 1)


def learn(ids: DataFrame, counts: DataFrame, v: Vocabulary, s: Settings) -> Model:
    """The model of the texts behind ``ids`` (their numbers) and ``counts`` (all their words)."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own, grid = cluster(ids, v, total, s)
    last = v.size
    # Tokens and kinds of words behind each number.
    tokens, sorts = np.zeros(len(own)), np.zeros(len(own))
    tokens[:last] = v.counts[:last]
    sorts[:last] = 1
    for r in counts.where("word <> ''").groupBy(_ending(F.col("word"), s.endings).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tokens[last + r["e"]], sorts[last + r["e"]] = r["n"], r["kinds"]
    tokens[last:-1] -= np.bincount(v.hashed[:last], v.counts[:last], s.endings)
    sorts[last:-1] -= np.bincount(v.hashed[:last], minlength=s.endings)
    sorts[last:-1] += 1  # an unknown word with that ending
    ends = grid[:, -1].sum()
    tokens[-1], sorts[-1] = ends, 1
    mass = np.bincount(own, tokens, s.classes) + np.bincount(own, sorts, s.classes)
    usual = (grid.sum(0) + 1) / (grid.sum() + s.classes)
    step = np.log10((grid + s.backoff * usual) / (grid.sum(1, keepdims=True) + s.backoff))
    number_class = own.astype(np.int16)
    log_count = np.r_[np.log10(v.counts + 1.0), np.zeros(s.endings), np.log10(ends + 1)]
    return Model(v.words, number_class[: v.size], number_class, log_count, step, np.log10(np.maximum(mass, 1)), int(total), float(np.log10(total + kinds + 1)))


def tail_counts(counts: DataFrame) -> DataFrame:
    """(key, n) of the words beyond the head."""
    return counts.where(~F.col("head") & (F.col("word") != "")).select(F.xxhash64("word").alias("key"), "n")


def train(texts: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    """The model of ``texts`` (one binary column), and the counts (key, n) of the words beyond its head."""
    v, counts = vocabulary(materialize(word_counts(texts), "counts"), s)
    return learn(materialize(numbered(texts, v), "ids"), counts, v, s), tail_counts(counts)


def score(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", mod: int = 7) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id) mod ``mod`` is not 2. A null or empty text is its end token
    alone. base_score is the add-one unigram score, score the class model's log10 probability; an
    unknown word counts as one kind per ending, as it counts as one kind in the base score. Without
    training texts both still are finite. Repeated rows are scored (and learned) each; words of equal
    count are ordered by themselves; a very long text is held whole, as numbers, in one task; an empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    s = settings or Settings()
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), mod).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    v, counts = vocabulary(materialize(word_counts(own.where("not held_out").select("text")), "counts"), s)
    ids = materialize(numbered(own, v), "ids")
    model = learn(ids.where("not held_out"), counts, v, s)
    shared = docs.sparkSession.sparkContext.broadcast((v.size, model.number_class, model.log_count, model.step, model.spread, model.total, model.base_spread))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number_class, log_count, step, spread, total, base_spread = shared.value
        for batch in batches(parts):
            packed = batch.column(3).to_pylist()
            n = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            at = np.frombuffer(b"".join(packed), dtype=np.int32)
            first = np.cumsum(n) - n
            cls = number_class[np.append(at[-1:], at)]
            per = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            logs = per(log_count[at])
            whole = logs + per(step[cls[:-1], cls[1:]] - spread[cls[1:]])
            known = per((at < size).astype(np.int64)) + int(total > 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n), pa.array(known), pa.array(logs - n * base_spread), pa.array(whole)],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score"],
            )

    done = ids.drop("tail").mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double")
    rare = ids.select("row", F.explode("tail").alias("key")).join(tail_counts(counts), "key")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count("*").alias("more"))
    out = done.join(rare, "row", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score")
    )
