"""Seeded glyph noise, as a scanner makes it, and how stable findings are under it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.normalize import fixed_map, let

#: What a scan may read a glyph as.
CONFUSIONS = {
    "0": ["O"], "O": ["0"], "1": ["I", "l"], "I": ["1"], "l": ["1"], "5": ["S"], "S": ["5"], "8": ["B"], "B": ["8"],
    "2": ["Z"], "Z": ["2"], "6": ["G"], "G": ["6"], "m": ["rn"], "e": ["c"], "c": ["e"],
}
MASK = 0xFFFFFFFF


def _times(x: Column, y: Column) -> Column:
    """Low 32 bits of the product of two such numbers; the whole product would not fit a long."""
    high = (x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF))
    return (x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK))


def mulberry32(seed: Column, first: Column, last: Column) -> Column:
    """Numbers ``first`` to ``last`` (from 1) of the public-domain 32-bit generator of that name: doubles in [0, 1).

    The generator counts up, so that every number follows from the seed and its own place.
    """
    folded = lambda x, bits: x.bitwiseXOR(F.shiftright(x, bits))
    start = seed.cast("bigint").bitwiseAND(F.lit(MASK))
    states = F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda k: (start + k * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(MASK)))
    mixed = F.transform(states, lambda x: _times(folded(x, 15), x.bitwiseOR(F.lit(1).cast("bigint"))))
    mixed = F.transform(mixed, lambda x: (x + _times(folded(x, 7), x.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseAND(F.lit(MASK)).bitwiseXOR(x))
    return F.transform(mixed, lambda x: folded(x, 14) / F.lit(4294967296.0))


def perturb(docs: DataFrame, text: str, seed: str, rate: float = 0.015) -> DataFrame:
    """``docs`` with confusable glyphs swapped at ``rate`` in column ``text``, seeded row by row by column ``seed``.

    Each such glyph takes a draw, one that is hit a second for its reading; other characters take none. A rate
    of 0 or less changes nothing. Null texts stay null, a null seed makes its text null.

    No draw depends on the text, so all that k glyphs could need are made first, a letter each: was it a hit, and
    which half is it in. They are k, and two more for each hit among these, whose second draw leaves a glyph
    without its first. A pattern then deals the letters out, one or a hit with the one behind it.
    """
    known = F.col(text).isNotNull() & F.col(seed).isNotNull()
    if rate <= 0:
        return docs.withColumn(text, F.when(known, F.col(text)))

    def letters(first: Column, last: Column) -> Column:
        hit = lambda u: F.when(u < rate, F.when(u < 0.5, "h").otherwise("H")).otherwise(F.when(u < 0.5, "m").otherwise("M"))
        return F.array_join(F.transform(mulberry32(F.col(seed), first, last), hit), "")

    def dealt(glyphs: Column) -> Column:
        hits = lambda x: F.length(x) - F.length(F.translate(x, "hH", ""))
        more = lambda x: F.when(hits(x) > 0, letters(glyphs + 1, glyphs + 2 * hits(x))).otherwise("")
        return let(letters(F.lit(1), glyphs), lambda x: F.regexp_extract_all(F.concat(x, more(x)), F.lit("[mM]|[hH]."), 0))

    def reading(glyph: Column, half: Column) -> Column:
        one, two = ({g: r[k % len(r)] for g, r in CONFUSIONS.items()} for k in (0, 1))
        return F.when(half.isin("m", "h"), fixed_map(one)[glyph]).otherwise(fixed_map(two)[glyph])

    def swapped(pieces: Column, draws: Column) -> Column:
        """Pieces end with a glyph each, but for the last, which has no draw."""

        def read(piece: Column, i: Column) -> Column:
            draw = F.get(draws, i)
            hit = (i < F.size(pieces) - 1) & (F.length(draw) == 2)
            return F.when(hit, F.concat(F.substr(piece, F.lit(1), F.length(piece) - 1), reading(F.right(piece, F.lit(1)), F.right(draw, F.lit(1))))).otherwise(piece)

        return F.array_join(F.transform(pieces, read), "")

    noisy = let(F.split(F.col(text), f"(?<=[{''.join(CONFUSIONS)}])", -1), lambda p: F.when(F.size(p) > 1, let(dealt(F.size(p) - 1), lambda d: swapped(p, d))).otherwise(F.get(p, F.lit(0))))
    return docs.withColumn(text, F.when(known, noisy))


def stability(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """Per packet and seed: what findings other than consistent were lost or gained under noise.

    ``clean`` and ``noisy`` hold (packet_id, seed, group_key, classification).
    """
    item = F.concat("group_key", F.lit("::"), "classification").alias("item")
    left = clean.where("classification <> 'consistent'").select("packet_id", "seed", item).distinct().withColumn("c", F.lit(True))
    right = noisy.where("classification <> 'consistent'").select("packet_id", "seed", item).distinct().withColumn("n", F.lit(True))
    both = left.join(right, ["packet_id", "seed", "item"], "full")
    keys = clean.select("packet_id", "seed").union(noisy.select("packet_id", "seed")).distinct()
    per = both.groupBy("packet_id", "seed").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("item")))).alias("lost"), F.array_sort(F.collect_list(F.when(F.col("c").isNull(), F.col("item")))).alias("gained"))
    none = F.array().cast("array<string>")
    out = keys.join(per, ["packet_id", "seed"], "left").withColumns({"lost": F.coalesce("lost", none), "gained": F.coalesce("gained", none)})
    return out.withColumn("stable", (F.size("lost") == 0) & (F.size("gained") == 0))


def changed_groups(stab: DataFrame) -> DataFrame:
    """How often each finding came or went, most often first."""
    return stab.select(F.explode(F.concat("lost", "gained")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item")
