"""Native and per-row operators against brute force on odd small inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import brown_lm, decontaminate, licenses, packing, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, source string, score string, row string, key string"
LONG = " ".join(f"w{k % 977}" for k in range(6000))
TEXTS = [None, "", " \t\n ", "one", "a b c d e a b c d e", "x\ny\nx\n\nx", "# $ ü%&|<>", "Released under the MIT License. mit\nlicense", "GNU General Public License, version 3; the apacheé license, Apache License", LONG, "a b c d e f g h i j k", "a b c d e f g h i j k"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if k == 3 else k, t, f"s{k % 2}", "s", "r", "k") for k, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_figures(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r, w = got[None if k == 3 else k], words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality.judge(empty).count() == 0


def test_quality_frequent_lines(spark):
    rows = [(k, f"shared line of some words here\n{' '.join(f'own{k}x{j}' for j in range(12))}", "h") for k in range(30)]
    rows += [(100 + k, f"shared line of some words here\nlonely{k}", "h") for k in range(3)] + [(200, "shared line of some words here\nlonely again and a few more words", "other")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept and got[k].n_removed_words == 6 for k in range(30))
    assert not any(got[100 + k].kept for k in range(3)) and got[200].n_removed_words == 0 and got[200].kept


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(TEXTS) and licenses.scan(empty).count() == 0
    for k, t in enumerate(TEXTS):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[None if k == 3 else k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_places_are_verified(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    rows = [(1, f"x y {notice} z"), (2, notice.replace("granted", "denied")), (3, "Licensed under CC BY-NC 4.0."), (4, " ".join(reversed(notice.split())))]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("", 0.0) and got[3] == ("cc-by-nc", 1.0) and got[4] == ("", 0.0)


#: Notices, headers and bodies as they stand in files, each with the labels it must get.
LICENCE_TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("boost", "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."),
    ("bsd", "Copyright (c) 2001. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
    ("gpl,lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),  # gpl: the base phrase
    ("agpl,gpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc0", "The person who associated a work with this deed has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-sa", "This work is licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under CC BY 4.0"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Everyone is permitted to copy and distribute verbatim or modified copies of this license document."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. All rights reserved."),
    ("", "All rights reserved. Provided as is, without warranty of any kind. You may not use this file except in compliance with the license."),
]


def test_licence_texts_get_their_own_label_only(spark):
    df = spark.createDataFrame([(k, f"/* {t} */\nimport x") for k, (_, t) in enumerate(LICENCE_TEXTS)], "doc_id long, text string")
    got = {x.doc_id: x.labels for x in licenses.scan(df).collect()}
    assert {k: got[k] for k in got} == {k: label for k, (label, _) in enumerate(LICENCE_TEXTS)}


def test_every_license_of_a_file(spark):
    notices = [(label, notice) for label, notice, _ in licenses.TEMPLATES]
    r = np.random.default_rng(4)
    rows = [[6, 18, 12], [1, 7], [6, 9, 18], [1, 6, 9, 7, 8], list(range(len(notices)))]
    rows += [r.permutation(len(notices))[: r.integers(2, 8)].tolist() for _ in range(25)]
    texts = [" \n-- ".join(notices[k][1] for k in ks) for ks in rows]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[0-9a-z]+", t)
        places = [label for label, notice, key in licenses.TEMPLATES for k in range(len(w)) if w[k : k + len(key.split())] == key.split()]
        base = [label for p, label in licenses.BASE if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))]
        assert got[i].labels == ",".join(sorted({*places, *base})) and got[i].n_places == len(places) and got[i].score == 1.0


def test_shards(docs, empty):
    rows = sharding.assign(docs, shards=3).collect()
    assert len(rows) == len(TEXTS) and sharding.assign(empty, shards=3).count() == 0
    by_text = {}
    for r in rows:
        t = (TEXTS[3 if r.doc_id is None else r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        assert by_text.setdefault(t, r.shard) == r.shard
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_are_near_equal(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab"), F.col("id").cast("int") % 97), F.col("id").cast("string")).alias("text"))
    loads = [r.b for r in sharding.assign(rows, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) / min(loads) < 1.01


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    extra = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(50, "a  b\n\n c\x1cd\t <|endoftext|> don't  "), (51, "  "), (52, "\n\nx\n")], "doc_id long, text string"))
    rows = packing.pieces(extra, most=256, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in extra.collect()}
    for doc_id, text in texts.items():
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in own)
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids + [0]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids) // 4 for r in own)
    assert len({r.sequence_id for r in rows}) == len(rows) and packing.pieces(empty).count() == 0


def test_toxicity_learns_and_holds_out(spark, docs, empty):
    rows = [(k, f"some plain words number {k % 50} " + ("you utter foozle" if k % 5 == 0 else "you kind friend")) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.train(df, labels, toxicity.Settings(bits=16))
    got = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    assert 0 < len(model.index) < 4000
    held = [k for k in got if got[k].held_out]
    assert held == [k for k in held if zlib.crc32(str(k).encode()) % 4 == 2] and len(held) > 300
    assert all(got[k].predicted == int(k % 5 == 0) for k in held)
    odd = toxicity.classify(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(empty, labels.limit(0), toxicity.Settings(bits=10))
    assert toxicity.classify(docs, none).where("predicted = 1").count() == 0


def test_brown_model(spark, docs, empty):
    rows = [(k, (" ".join(f"la{(k + j) % 40}a" for j in range(60)) if k % 2 else " ".join(f"zo{(k * 7 + j) % 40}e" for j in range(60)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    s = brown_lm.Settings(head=64, clustered=32, endings=16, classes=8, sweeps=6)
    got = brown_lm.score(df, s).collect()
    all_rows = [(r.doc_id, r.text) for r in df.collect()]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in all_rows if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for k, t in all_rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    fresh = [r for r in got if r.held_out and r.doc_id >= len(TEXTS)]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert brown_lm.score(empty, s).count() == 0


def test_brown_words_of_equal_ending_by_their_contexts(spark):
    r = np.random.default_rng(1)
    rows = [(k, " ".join(f"{x}{r.integers(3)}q {x}{r.integers(3)}q {x}{r.integers(30)}same" for _ in range(60))) for k in range(300) for x in ("la", "zo")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("text").cast("binary").alias("text"))
    model, _ = brown_lm.train(texts, brown_lm.Settings(head=100, clustered=6, endings=4, classes=12, ample=50))
    words = model.words.decode().split("\n")
    classes = {x: {int(c) for w, c in zip(words, model.word_class) if w.startswith(x) and w.endswith("same")} for x in ("la", "zo")}
    assert len(words) == 66 and not classes["la"] & classes["zo"]


def test_exchange_finds_the_two_languages():
    r = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    for lang in (0, 1):
        for _ in range(3000):
            pairs[lang * 10 + r.integers(10), lang * 10 + r.integers(10)] += 1
    own = brown_lm.exchange(pairs, 3, 10)
    assert len(set(own[:10])) == len(set(own[10:20])) == 1 and own[0] != own[10] and own[20] == 2


def test_decontamination_against_brute_force(spark, docs, empty):
    item = " ".join(f"item{k}" for k in range(80))
    near = item.replace("item20", "other")
    far = " ".join(f"item{k}" for k in range(0, 80, 2))
    rows = [(1, f"pre words here {item.upper()}!! and after"), (2, f"x {near} y"), (3, far), (4, " ".join(f"item{k}" for k in range(76))), (5, "tiny phrase"), (6, "a tiny phrase."), (6, "clean"), (7, None), (8, (item + " ") * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, "tiny phrase"), (12, ""), (13, None), (14, item)], "item_id long, text string")
    got = sorted((r.doc_id, tuple(r.item_ids)) for r in decontaminate.mark(df, items).collect())
    assert got == [(1, (10, 14)), (2, (10, 14)), (3, ()), (4, (10, 14)), (5, (11,)), (6, ()), (6, (11,)), (7, ()), (8, (10, 14))]
    left = decontaminate.drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 6, 7]
    assert decontaminate.mark(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate.mark(empty, items).count() == 0


def test_fingerprint_radius(spark):
    df = spark.createDataFrame([([k * 7919 + 3 for k in range(60)],), ([5],)], "h array<long>")
    for r in df.select("h", decontaminate.fingerprint("h").alias("p")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.p & (2**64 - 1) == want
    most = decontaminate.RADIUS // decontaminate.BLOCKS
    assert sorted(decontaminate.variants()) == [x for x in range(256) if x.bit_count() <= most] and decontaminate.RADIUS < decontaminate.BLOCKS * (most + 1)


def windows_and_items(rows, items, limit):
    """All windows of each item's length at every place, by counted shingles."""
    cut = lambda t: [w for w in re.split(decontaminate.BREAK, (t or "").lower()) if w]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for d, t in rows:
        w, found = cut(t), {}
        for k, item in items:
            i = cut(item)
            size = min(5, len(i))
            want = grams(i, size)
            for at in range(len(w) if i else 0):
                got = grams(w[at : at + len(i)], size)
                same = (got & want).total() / max(1, (got | want).total())
                if same >= limit:
                    found[k] = max(same, found.get(k, 0.0))
        out.append((d, tuple(sorted(found)), round(max(found.values(), default=0.0), 9)))
    return sorted(out, key=str)


def test_decontamination_against_all_windows(spark):
    r = np.random.default_rng(8)
    items = [(k, " ".join(f"i{k}w{j % (9 if k == 5 else 999)}" for j in range(n))) for k, n in enumerate((60, 40, 40, 120, 12, 45, 3, 60))]
    items[7] = (7, items[0][1].replace("i0w30", "swapped"))
    rows = []
    for n in range(200):
        text = " ".join(f"own{r.integers(400)}" for _ in range(r.integers(0, 120))).split()
        for _ in range(r.integers(0, 3)):
            words = items[r.integers(len(items))][1].split()
            for _ in range(r.integers(0, 4)):
                at = r.integers(len(words))
                words[at : at + 1] = [["x"], [], [words[at], "y"]][r.integers(3)]
            turn = r.integers(len(words) or 1) if r.random() < 0.3 else 0  # a block moved to the front
            words = words[turn:] + words[:turn]
            at = r.integers(len(text) + 1)
            text[at:at] = words[r.integers(0, 6) :] if r.random() < 0.4 else words
        rows.append((n, " ".join(text)))
    got = decontaminate.mark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((x.doc_id, tuple(x.item_ids), round(x.similarity, 9)) for x in got), key=str)
    want = windows_and_items(rows, items, 0.8)
    assert got == want and 40 < sum(bool(x[1]) for x in want) < 160
