"""License scan over a positional index of rare words.

Native. Texts are split once. The corpus gives each licence word's document frequency; of every
template that a file could hold (all words of its key phrase are there) the highest-IDF key words are
looked up in the postings, postings are intersected by relative position (document position minus
template position), and every place left is verified by the template's mandatory key phrase. All
words looked up stand in the key phrase, so no place of it is missed. The template tables are
constants, so what is broadcast is bounded by them.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import LOWER, UPPER, materialize

#: Separators after lowering: all of ASCII but digits and a-z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase, label
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: label, notice, mandatory key phrase within it. A key phrase stands in the texts of that licence alone:
#: what several licences say in the same words (warranty clauses, use in compliance with the license) is no key.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("isc", "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "with or without fee is hereby granted the software is provided as is"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "released into the public domain under cc0 1 0", "cc0 1 0"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("cddl", "under the terms of the common development and distribution license", "common development and distribution license"),
    ("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    ("ofl", "licensed under the sil open font license version 1 1", "sil open font license"),
    ("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    # Sentences from the bodies of the licences and from their file headers.
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing software distributed under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "this library is free software you can redistribute it"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "used to endorse or promote products derived from this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject to the terms of the mozilla public license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "any person or organization obtaining a copy of the software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "in no event will the authors be held liable for any damages"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without fee and without a written agreement is hereby granted"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("artistic", "under the terms of the artistic license 2 0", "artistic license 2 0"),
    ("psf", "python software foundation license version 2", "python software foundation license"),
]


def _has(found: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(words))), found)) == 0


def _places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of the places where the phrase's words stand consecutively."""
    first, *rest = phrase.split()
    hit = F.transform(words, lambda w, i: F.when((w == first) & F.coalesce(_all(F.get(words, i + k + 1) == x for k, x in enumerate(rest)), F.lit(False)), i))
    return F.filter(hit, lambda x: x.isNotNull())


def _all(tests) -> Column:
    out = F.lit(True)
    for x in tests:
        out = out & x
    return out


def _rows(templates) -> list[tuple]:
    rows = []
    for k, (label, notice, key) in enumerate(templates):
        words, must = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        rows.append((k, label, words, at, must))
    return rows


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, words, and where the key phrase starts in them."""
    return spark.createDataFrame(_rows(templates), "template int, label string, t_words array<string>, key_at int, key_words array<string>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, rarest: int = 8, least_votes: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_words, the base figures, labels, score and n_places.

    ``n_places`` counts the template places that were verified. score is the largest share of a
    verified template's words found in place, at least 0.5 with a base label, 0 without any label.
    Null and empty texts have no words, labels '' and score 0. Rows are scanned one by one, so
    repeated rows repeat; ties between words of equal IDF go by the word. Texts of any length are
    scanned whole. An empty table gives no rows. Other columns are unread.
    ``rarest`` words, and ``least_votes`` at least, are looked up of each template's key phrase; all
    of them must agree on a place.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    vocab = sorted({w for _, notice, _ in templates for w in notice.split()} | {w for p, _ in BASE for w in p.split()})
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.array_remove(F.split(lowered, BREAK), "").alias("words"))
    cut = cut.withColumn("found", F.array_intersect("words", F.array(*map(F.lit, vocab))))
    # A template or base phrase needs all words of its key: the rest of the files cannot match.
    needed = [key for _, _, key in templates] + [p for p, _ in BASE]
    likely = F.lit(False)
    for key in needed:
        likely = likely | _has(F.col("found"), key.split())
    seen = materialize(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "found", F.when(likely, F.col("words")).alias("words")), "licence_words")

    # At most one row for each vocabulary word comes back.
    counts = {r["w"]: r["n"] for r in seen.select(F.explode("found").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = seen.count()
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocab}
    rank = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (-idf[w], w)))}
    asked = [sorted(set(key.split()), key=rank.get)[: max(rarest, least_votes)] for _, _, key in templates]

    files = seen.where(F.col("words").isNotNull())
    keys = F.array(*[F.struct(F.array(*map(F.lit, key.split())).alias("key"), F.array(*map(F.lit, ws)).alias("asked")) for (_, _, key), ws in zip(templates, asked, strict=True)])
    held = F.filter(keys, lambda t: F.size(F.array_except(t["key"], F.col("found"))) == 0)
    own = F.array_distinct(F.flatten(F.transform(held, lambda t: t["asked"])))
    base = [(label, F.size(p), p) for p, label in ((_places(F.col("words"), p), x) for p, x in BASE)]
    files = files.select("row", "words", own.alias("rare"), *[p.alias(f"p_{label}") for label, _, p in base])
    place = files.select("row", "rare", F.posexplode("words").alias("pos", "w")).where(F.array_contains("rare", F.col("w"))).drop("rare")
    # Places of the words asked within the key phrase; a place of the phrase holds them all.
    spots = [(k, i, w) for (k, _, ws, at, must), ask in zip(_rows(templates), asked, strict=True) for i, w in enumerate(ws) if at <= i < at + len(must) and w in ask]
    of_template = Counter(k for k, _, _ in spots)
    postings = spark.createDataFrame([(k, i, w, of_template[k]) for k, i, w in spots], "template int, t_pos int, w string, spots int")
    votes = (
        place.join(F.broadcast(postings), "w")
        .groupBy("row", "template", "spots", (F.col("pos") - F.col("t_pos")).alias("shift"))
        .agg(F.count_distinct("t_pos").alias("votes"))
        .where(F.col("votes") == F.col("spots"))
    )
    near = votes.join(F.broadcast(table), "template").join(files.select("row", "words"), "row")
    there = F.transform("t_words", lambda w, i: F.when(F.get("words", i + F.col("shift")) == w, 1).otherwise(0))
    key = F.transform("key_words", lambda w, i: F.coalesce(F.get("words", i + F.col("shift") + F.col("key_at")) == w, F.lit(False)))
    share = F.aggregate(there, F.lit(0), lambda a, x: a + x) / F.size("t_words")
    found = near.where(F.forall(key, lambda x: x)).groupBy("row").agg(F.collect_set("label").alias("more"), F.max(share).alias("share"), F.count("*").alias("n_places"))

    starts = F.concat(*[F.col(f"p_{label}") for label, _, _ in base])
    labels = F.filter(F.array(*[F.when(F.size(f"p_{label}") > 0, F.lit(label)) for label, _, _ in base]), lambda x: x.isNotNull())
    marked = files.select("row", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), labels.alias("base"))
    none = F.array().cast("array<string>")
    out = seen.select("row", "doc_id", "n_words").join(marked, "row", "left").join(found, "row", "left")
    both = F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none)))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.coalesce("n_base", F.lit(0)) > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_places", F.lit(0).cast("long")).alias("n_places"),
    )
