"""Quality rules: repetition figures per document and line frequency across a host's documents.

Native: every step is a DataFrame expression. Texts are read once; what later steps need (figures
and line hashes) is written to the shared folder, about a twentieth of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import SPACE, join_counted, materialize, words_of

#: A window of this many words counts as repeated when the text holds it twice or more.
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a repeated window of WINDOW words, first occurrences included.

    Windows are compared by 64-bit hash inside the row, so no window is shuffled. Repeated windows
    are neighbours after a sort; the words they cover are summed from the gaps between their starts.
    """
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _with_covered(df: DataFrame) -> DataFrame:
    """Turn the window hashes ``_h`` into n_repeat_words; a column per step, so each is computed once."""
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, j: (F.get("_r", j - 1)["h"] == x["h"]) | (F.get("_r", j + 1)["h"] == x["h"])
    again = F.filter("_r", lambda x, j: F.coalesce(same(x, j), F.lit(False)))
    gap = lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_s", j + 1) - p, F.lit(WINDOW)))
    return (
        df.withColumn("_r", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked))
        .withColumn("_s", F.sort_array(F.transform(again, lambda x: x["i"])))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("_s", gap), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .drop("_h", "_r", "_s")
    )


def figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``lines``.

    A null text counts as empty: all figures 0, no lines. ``lines`` holds for each line with a word
    the hash of its normalised form (A-Z and others lowered, white space folded) and its words.
    Only the named columns are read, so other columns of ``docs`` cannot clash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    folded = lambda x: F.trim(F.regexp_replace(F.lower(x), SPACE, " "))
    line = lambda x: F.struct(F.xxhash64(folded(x)).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    cut = docs.select(*keep, t.alias("_t"), words_of(t).alias("_w"), worded.alias("_l"))
    got = cut.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("_h"),
        F.transform("_l", line).alias("lines"),
        F.xxhash64("_t").alias("text_key"),
    )
    return _with_covered(got)


def frequent_lines(lined: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, h, rows): lines in more distinct documents of a host than ``least_docs`` and ``share`` of them.

    Equal texts count as one document; ``rows`` counts them all. The count is a grouped sum with partial
    aggregation.
    """
    texts = lined.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = texts.select("host", "copies", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).where(F.col("n") > least_docs)
    return counts.join(hosts, "host").where(F.col("n") > F.col("docs") * share).select("host", "h", "rows")


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    least_docs: int = 10,
    share: float = 0.01,
    least_left: float = 0.3,
    least_words: int = 10,
) -> DataFrame:
    """One row per input row: the figures, base_failed, n_removed_words and kept.

    Lines that too many documents of the host hold are removed; a document with fewer than
    ``least_words`` words left, or less than ``least_left`` of its words, is rejected. A null host
    is a host of its own. Repeated rows are judged row by row; empty texts fail the base rule. Texts of
    any length are read whole (a text's windows and lines are held in its row); equal texts of a host
    count once towards a line's frequency. An empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("host"), F.col(text).alias("text"))
    seen = figures(own, "text", ("doc_id", "host")).withColumn("row", F.monotonically_increasing_id())
    seen = materialize(seen, "quality")
    common = materialize(frequent_lines(seen, least_docs, share), "common_lines")
    lines = seen.select("row", "host", F.explode("lines").alias("l")).select("row", "host", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    gone = join_counted(lines, common, ["host", "h"], "rows").groupBy("row").agg(F.sum("n").cast("long").alias("n_removed_words"))
    out = seen.join(gone, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < least_words) | (left < F.col("n_words") * least_left)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_removed_words", (~failed & ~depleted).alias("kept")
    )
