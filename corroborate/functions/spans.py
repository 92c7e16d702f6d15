"""Text structure with offsets: lines, table cells, every match of a pattern, merged intervals.

Offsets count code points from 0; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corroborate.functions.normalize import let


#: Sums run over so many parts at a time, so that long texts take few copies of what is summed so far.
CHUNK = 256
#: Lines of a text whose starts are measured one by one.
FEW = 24


def _running(lengths: Column, zero: Column) -> Column:
    """``zero`` and the running sums of ``lengths`` after it."""
    return F.aggregate(lengths, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _sums(lengths: Column) -> Column:
    """The sum of all lengths before each one."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def chunked(n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(CHUNK)), lambda i: F.slice(n, i + 1, CHUNK))
        return let(cut, lambda chunks: let(_running(F.transform(chunks, total), F.lit(0)), lambda bases: F.flatten(F.transform(chunks, lambda c, k: F.slice(_running(c, F.get(bases, k)), F.lit(1), F.size(c))))))

    return let(lengths, lambda n: F.when(F.size(n) > CHUNK, chunked(n)).otherwise(F.slice(_running(n, F.lit(0)), F.lit(1), F.size(n))))


def _prefix(parts: Column, gap: int) -> Column:
    """Start of each part in the text that ``parts`` make with ``gap`` characters between them."""
    return _sums(F.transform(parts, lambda p: F.length(p) + gap))


def lines(text: Column) -> Column:
    """array<struct<text, start>> of the lines cut at line feeds."""
    line = lambda t, s: F.struct(t.alias("text"), s.alias("start"))
    few = lambda cut: F.transform(cut, lambda t, i: line(t, before(text, "\n", i)))
    return let(F.split(text, "\n", -1), lambda cut: F.when(F.size(cut) > FEW, F.zip_with(cut, _prefix(cut, 1), line)).otherwise(few(cut)))


def before(text: Column, mark: str, i: Column) -> Column:
    """Where part ``i`` of a text cut at a character starts: measured at once, as sums are for texts of many parts."""
    return F.when(i == 0, 0).otherwise(F.length(F.call_function("substring_index", text, F.lit(mark), i)) + 1)


def cells(line: Column, start: Column) -> Column:
    """array<struct<value, start, end>> of the trimmed cells between pipes, at absolute offsets."""
    def cell(part: Column, at: Column) -> Column:
        found = F.struct(F.trim(part).alias("value"), (start + at + F.length(part) - F.length(F.ltrim(part))).alias("start"))
        return let(found, lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end")))

    few = lambda cut: F.transform(cut, lambda part, i: cell(part, before(line, "|", i)))
    return let(F.split(line, PIPE, -1), lambda cut: F.when(F.size(cut) > CHUNK, F.zip_with(cut, _prefix(cut, 1), cell)).otherwise(few(cut)))


#: Java splits at this without compiling a pattern.
PIPE = r"\|"


def is_table_line(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"))) >= 3


def is_rule_line(line: Column) -> Column:
    return line.rlike(r"^[\s\-+=|]{5,}$") & line.rlike("[-=]")


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


#: What marks matches and groups while a text is cut; a text that holds one of these is searched group by group.
MATCH, GROUP = "\ufdd0", "\ufdd1"


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, raw, g1, g2, ...>> of all matches, left to right, without overlap.

    One search marks every match and its groups; a cut at the marks leaves gaps and matches by turns, so
    starts are a running sum. The pattern must not match an empty text.
    """
    marks = F.concat(F.lit(MATCH + "$0"), *[F.lit(f"{GROUP}${k}") for k in range(1, groups + 1)], F.lit(MATCH))
    none = F.array().cast(f"array<struct<start:int,raw:string{''.join(f',g{k}:string' for k in range(1, groups + 1))}>>")

    def located(cut: Column, own: Column) -> Column:
        befores = _sums(F.transform(own, lambda m, k: F.length(F.get(cut, 2 * k)) + F.length(F.get(m, 0))))
        one = lambda m, b, k: F.struct((b + F.length(F.get(cut, 2 * k))).alias("start"), F.get(m, 0).alias("raw"), *[F.get(m, g).alias(f"g{g}") for g in range(1, groups + 1)])
        first = F.transform(own, lambda m, k: one(m, F.lit(0), k))
        return F.when(F.size(own) == 1, first).otherwise(let(befores, lambda b: F.transform(own, lambda m, k: one(m, F.get(b, k), k))))

    def placed(cut: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda i: F.split(F.get(cut, i), GROUP, -1))
        return F.when(F.size(cut) == 1, none).otherwise(let(own, lambda o: located(cut, o)))

    plain = let(F.split(F.regexp_replace(text, F.lit(pattern), marks), MATCH, -1), placed)
    return F.when(text.contains(MATCH) | text.contains(GROUP), _searched(text, pattern, groups)).when(text.isNotNull(), plain)


def _searched(text: Column, pattern: str, groups: int) -> Column:
    """The same with a search for each group: the gaps are what a split at the pattern leaves."""
    p = F.lit(pattern)

    def placed(x: Column) -> Column:
        whole, gaps = x["whole"], x["gaps"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.length(g) + F.length(m))
        befores = let(steps, lambda n: F.zip_with(_sums(n), n, lambda b, k: b + k))
        return F.zip_with(whole, befores, lambda m, e: F.struct((e - F.length(m)).alias("start"), m.alias("raw")))

    out = let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps")), placed)
    for k in range(1, groups + 1):
        out = _with_field(out, F.regexp_extract_all(text, p, F.lit(k)), f"g{k}")
    return out


def _with_field(structs: Column, values: Column, name: str) -> Column:
    return F.zip_with(structs, values, lambda s, v: s.withField(name, v))


def last_index(text: Column, part: Column) -> Column:
    """Offset of the last occurrence of ``part``, or -1."""
    back = F.position(F.reverse(part), F.reverse(text))
    return F.when(back > 0, F.length(text) - F.length(part) - (back - 1)).otherwise(F.lit(-1))


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the intervals of each key; touching intervals merge.

    An open end comes after its start's other ends, so that it cannot cut them off; an open start joins its key's last interval.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_fresh", fresh).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def segments(text_rows: DataFrame, merged: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """The text of each key cut into cited and uncited segments, in order."""
    cut = merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    rows = text_rows.join(cut, keys, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<start:int,end:int>>")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), F.transform("_s", lambda s: s["start"]), F.transform("_s", lambda s: s["end"]))))
    rows = rows.withColumn("_e", edges)
    pieces = F.filter(F.transform("_e", lambda e, i: F.struct(e.alias("start"), F.get("_e", i + 1).alias("end"))), lambda p: p["end"].isNotNull())
    out = rows.select(*keys, F.col(text).alias("_t"), "_s", F.explode(pieces).alias("p"))
    cited = F.exists("_s", lambda s: (s["start"] <= F.col("p.start")) & (s["end"] >= F.col("p.end")))
    return out.select(*keys, F.col("p.start").alias("start"), F.col("p.end").alias("end"), cited.alias("cited"), F.expr("substring(_t, p.start + 1, p.end - p.start)").alias("text"))
