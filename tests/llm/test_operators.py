"""Each operator against brute force on small tables that hold nulls, empties, ties, copies and clashing columns."""

import base64
import gzip
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from sonolake.llm import decontam, langid, licenses, mixing, simhash, warc
from sonolake.llm.common import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("component", T.StringType())])


def docs_of(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); two more columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, "x", "y") for r in rows], DOCS)


def sentence(rng, n, words="lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(20):  # near and exact copies
        w = base[k % 7].split()
        if k % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "One"), (205, "a b"), (206, "x " * 60000), (50, base[3]), (50, base[3])]


def components(n, edges):
    root = {x: x for x in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + [(None, 4)], "a long, b long").repartition(5)).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(got.get(x, x) == c for x, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_all_pairs(spark):
    rows = corpus()
    fp = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fp[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = simhash.near_duplicates(docs_of(spark, rows), tile=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_simhash_first_of_each_judges_rows(spark):
    rng = random.Random(15)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, b), (3, c), (4, c), (None, a), (None, a), (5, None), (6, "")]
    got = simhash.first_of_each(docs_of(spark, rows), tile=8)
    assert got.columns == DOCS.names
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted([("1", a), ("1", b), ("3", c), ("None", a), ("None", a), ("5", "")])
    assert simhash.first_of_each(docs_of(spark, [])).collect() == []


def test_simhash_links_every_near_pair(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for k in range(300):
        x = fps[k % 60]
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    got = connected_components(simhash.links(spark.createDataFrame(signed, "fp long, id long"), tile=16)).collect()
    want = components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r["node"]: r["component"] for r in got}
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in langid.identify(docs).collect()]
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert 250 < len(held) < 420
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert np.mean([r["accepted"] for r in got]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_language_edges(spark):
    rows = [(i, "le la les des une bonjour", "fr") for i in range(20)] + [(20 + i, "the and of this with that", "en") for i in range(20)]
    rows += [(90, None, "fr"), (91, "", None), (92, "12 34 !!", "en"), (None, "the and of", "en"), (93, "the and " * 40000, None)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert [got[k]["lang_pred"] for k in (90, 91, 92, None, 93)] == ["und", "und", "und", "en", "en"]
    assert not got[None]["held_out"] and not got[92]["accepted"]
    assert langid.identify(docs_of(spark, [])).collect() == []
    assert langid.identify(docs_of(spark, [(1, "no labels here")])).first()["lang_pred"] == "und"


def test_language_of_long_texts_is_learned(spark):
    """Long texts are sampled by pieces; repeated rows, ties and more languages than dimensions are no trouble."""
    rows = [(i, "le la des une bonjour " * 1200, "fr") for i in range(60)] + [(100 + i, "the and of this with that", "en") for i in range(60)] + [(100, "the and of this with that", "en")] * 5
    pieces = langid.sample(docs_of(spark, rows), rows=30)
    assert {lang for _, lang in pieces} == {"fr", "en"} and max(len(t) for t, _ in pieces) <= langid.PIECE
    got = langid.identify(docs_of(spark, [*rows, (500, "bonjour la une", None), (500, "bonjour la une", None)])).collect()
    assert len(got) == len(rows) + 2 and all(r["lang_pred"] == ("en" if 100 <= r["doc_id"] < 200 else "fr") for r in got)
    many = langid.train([(f"word{k} of{k} tongue{k}", f"x{k:02d}") for k in range(40) for _ in range(40)])
    assert many.table.shape[1] == langid.DIM and np.mean([many.predict(f"word{k} of{k} tongue{k}")[0] == f"x{k:02d}" for k in range(40)]) > 0.9
    same = langid.train([("one text", "b"), ("one text", "a")] * 2)
    same.table[:], same.bias[:] = 0, 0
    assert same.predict("one text")[0] == "a"


def test_language_blocks_equal_whole(monkeypatch):
    m = langid.train([("the and of " * 9, "en"), ("le la les " * 9, "fr")] * 30)
    text = "the and les of la " * 500
    whole = m.logits(text)
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.allclose(whole, m.logits(text), atol=1e-5)


def test_block_max_wand_finds_all_above():
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.randrange(8, 90)) + ". " + sentence(rng, 6)) for i in range(300)]
    index = decontam.build(items)
    for _ in range(40):
        q = sorted(rng.sample(range(len(index.vocab)), 60))
        score = np.zeros(len(index.unit_item))
        for t in q:
            for u, v in zip(*index.lists[t][:2]):
                score[u] += v
        for threshold in (0.1, 0.2, 0.3):
            got = dict(index.retrieve(q, threshold))
            want = {u: s for u, s in enumerate(score) if s >= threshold}
            assert set(got) == {u for u, s in want.items() if s >= threshold} and all(abs(got[u] - want[u]) < 1e-9 for u in got)


def test_items_that_stand_in_a_text_are_leaks():
    rng = random.Random(12)
    items = [(i, "Ab. " + sentence(rng, rng.randrange(2, 60)) + ". Cd. " + sentence(rng, rng.randrange(1, 30)) + rng.choice([". X.", "", "\nno"])) for i in range(80)]
    index = decontam.build(items)
    texts = [sentence(rng, rng.randrange(200)) + " " + t + " " + sentence(rng, rng.randrange(90)) for _, t in items]
    assert {(r, i) for r, i, *_ in decontam.search(index, texts)} >= {(i, i) for i, _ in items}
    for _, t in items:
        q, a = decontam.question_answer(t)
        assert q + a == decontam.words(t) and q and a


@pytest.mark.parametrize("shard", [1000, 7])
def test_leaks_against_scan_of_all(spark, shard):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(10, 130)) + ". " + sentence(rng, rng.randrange(4, 9)) + ".") for i in range(60)]
    rows = [(i, sentence(rng, rng.randrange(5, 900))) for i in range(60)]
    for k in range(25):
        host = sentence(rng, 300).split()
        at = rng.randrange(300)
        rows.append((100 + k, " ".join([*host[:at], items[k][1].upper() if k % 2 else items[k][1], *host[at:]])))
    rows += [(200, items[0][1].split(". ")[0]), (201, None), (202, ""), (None, items[1][1])]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(spark, rows), spark.createDataFrame([*items, (98, None), (99, ""), (97, items[1][1])], "item_id long, text string"), shard=shard).collect()}
    want = set()
    for d, t in rows:
        have = decontam.words(t)
        for i, x in [*items, (97, items[1][1])]:
            ok = True
            for part in decontam.question_answer(x):
                g = decontam.grams(part)
                text = " " + " ".join(have) + " "
                ok &= sum(f" {' '.join(y)} " in text for y in g) >= 0.8 * len(g)
            if ok and t:
                want.add((d, i))
    assert got == want and len(got) >= 27


@pytest.mark.parametrize("items", [[(1, "the cat sat on the mat today. it was grey.")] * 3, [(i, f"What is {i % 10} plus {i // 10}? {i % 10 + i // 10}") for i in range(100)]])
def test_items_of_frequent_terms_are_leaks(items):
    """Three equal items have no rare term, nor have items of one template."""
    index = decontam.build(items)
    host = sentence(random.Random(7), 150)
    texts = [f"{host} {t} {host}" for _, t in items] + [t for _, t in items] + ["", None, "the", host]
    got = {(r, i) for r, i, *_ in decontam.search(index, texts)}
    assert got >= {(k + shift, i) for k, (i, _) in enumerate(items) for shift in (0, len(items))}
    assert max(r for r, _ in got) < 2 * len(items)


def test_scores_do_not_depend_on_shards(spark):
    rng = random.Random(21)
    items = spark.createDataFrame([(i, sentence(rng, rng.randrange(12, 80)) + ". " + sentence(rng, 6), "x", "y") for i in range(120)], "item_id long, text string, key string, shard string")
    texts = [(i, r["text"]) for i, r in enumerate(items.orderBy("item_id").collect())]
    a, b = ({(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(docs_of(spark, texts), items, shard=n).collect()} for n in (1000, 11))
    assert a.keys() == b.keys() >= {(i, i) for i in range(120)} and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert decontam.leaks(docs_of(spark, texts), items.limit(0)).collect() == [] and decontam.leaks(docs_of(spark, []), items).collect() == []
    assert decontam.drop_leaks(docs_of(spark, texts), items.limit(0)).count() == 120 and decontam.drop_leaks(docs_of(spark, texts), items).count() == 0


def test_long_texts_and_parts_that_stand_apart(monkeypatch):
    rng = random.Random(22)
    q, a = sentence(rng, 14), sentence(rng, 12)
    index = decontam.build([(k, f"{sentence(rng, 14)}. {sentence(rng, 12)}.") for k in range(40)] + [(99, f"{q}. {a}.")])
    far = f"{q} " + sentence(rng, 900) + f" {a}"
    long = sentence(rng, 3000) + f" {q}. {a}. " + sentence(rng, 3000)
    want = decontam.search(index, [far, long])
    assert [(r, k) for r, k, *_ in want] == [(0, 99), (1, 99)]
    monkeypatch.setattr(decontam, "PIECE", 3)
    monkeypatch.setattr(decontam, "GROUP", 100)
    assert decontam.search(index, [far, long]) == want


def test_window_bound_loses_no_unit(monkeypatch):
    rng = random.Random(13)
    items = [(i, " ".join([*[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(6, 60))], *(sentence(rng, i % 7).split())]) + ". " + sentence(rng, i % 3)) for i in range(200)]
    texts = [" ".join([sentence(rng, 70), items[rng.randrange(200)][1], *[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(90))]]) for _ in range(60)]
    index = decontam.build(items)
    assert (index.frequent >= decontam.THRESHOLD).any() and (index.frequent < decontam.THRESHOLD).any()
    got = decontam.search(index, texts)
    monkeypatch.setattr(decontam, "_windows", lambda tokens, base, *_: np.arange(base[-1] + max(1, -(-len(tokens[-1]) // decontam.UNIT)) + 1))
    assert got == decontam.search(index, texts) and len(got) >= 60


def test_license_rules(spark):
    t = licenses.SENTENCES
    rows = [
        (1, f"Intro text. {t[1]}; {t[2]}.\n{t[3]}.\nMore."), (2, f"x\n{t[1]}.\nLicensed under CC BY-NC 4.0."), (3, t[4].upper() + "\n" + t[4]), (4, f"{t[22]}.\nAll  Rights reserved."),
        (5, None), (6, ""), (7, "nothing at all"), (8, f"{t[9]}.\n\n{t[10]}.\n\n{t[11]}."), (9, f"{t[17]}: {t[18]}. {t[19]}. {t[20]}."), (None, t[8]),
    ]
    got = sorted(((r["doc_id"] or 0, r["license"], r["rule"]) for r in licenses.scan(docs_of(spark, rows)).collect()))
    assert got == sorted([(1, "Apache-2.0", "apache-notice"), (2, "Apache-2.0", "apache-line"), (2, "CC-BY-NC-4.0", "cc-by-nc-4.0-line"), (3, "MIT", "mit-line"), (3, "MIT", "mit-line"), (4, "MPL-2.0", "mpl-line"), (4, "Proprietary", "reserved-line"), (8, "GPL-3.0", "gpl3-notice"), (9, "BSD-3-Clause", "bsd3-text"), (0, "GPL-3.0", "gpl3-line")])
    assert licenses.scan(docs_of(spark, [])).collect() == []


APACHE = """# Copyright 2020 A. Person
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""
MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla
// Public License,
// v. 2.0. If a copy of the MPL was not distributed with this file, get one.
"""


def test_licenses_as_they_stand_in_files(spark):
    rows = [APACHE, MIT, BSD, BSD + BSD3, GPL, MPL, (BSD + BSD3).replace("1.", "(1)").replace("2.", "b)").replace("3.", "(iii)"), MIT.replace("\n", "\r\n")]
    want = ["apache-notice 3", "mit-text 3", "bsd2-text 3", "bsd3-text 4", "gpl3-notice 3", "mpl-line 1", "bsd3-text 4", "mit-text 3"]
    got = licenses.scan(docs_of(spark, list(enumerate(rows)))).collect()
    assert sorted((r["doc_id"], f"{r['rule']} {r['n_sentences']}") for r in got) == list(enumerate(want))
    # What only begins or goes on like a known sentence is none; a lone number counts as a sentence.
    t = licenses.SENTENCES
    rest = [GPL.split("either")[0], "Licensed under\nthe MIT\nLicense or not", f"{t[17]}:\n7.\n{t[18]}. 8. Else. {t[19]}.", f"{t[4]}\n3\n", f"A {t[4]}"]
    assert [r["rule"] for r in licenses.scan(docs_of(spark, list(enumerate(rest)))).collect()] == ["mit-line"]
    assert licenses.identify(rest[2], licenses.sentence_table()) == [17, -1, 18, 0, 0, 19]


def plain_identifiers(text):
    """Identifiers by joining pieces and looking them up, the longest first."""
    table = {licenses.normal(s): i for i, s in [*licenses.SENTENCES.items(), *licenses.WORDINGS]}
    pieces = licenses.cut(text)
    parts, out, i = [n for n, _ in pieces], [], 0

    def at(i, skip=0):
        for n in range(min(40, len(parts) - i), 0, -1):
            if got := table.get(" ".join(" ".join(parts[i : i + n]).split()[skip:])):
                return got, n
        return 0, 0

    while i < len(parts):
        known, n = at(i)
        if not known and licenses.LABELLED.match(pieces[i][1]):
            known, n = at(i, 1)
        elif not known and licenses.LABEL.fullmatch(parts[i]) and at(i + 1)[0]:
            known, n = -1, 1
        out += [known] + [-1] * (n - 1)
        i += max(n, 1)
    return out


def test_licenses_of_all_rules_wrapped_and_joined(spark):
    """Every rule's sentences, in one line and wrapped as comments: found whole; and random texts against plain look-up."""
    table = licenses.sentence_table()
    rows, want = [], []
    for name, licence, seq, _ in licenses.RULES:
        head, body = "Copyright (c) 2021 Someone", ". ".join(licenses.SENTENCES[i] for i in seq) + "."
        for text in (f"{head}. {body} Code.", "\n".join([head, *textwrap.wrap(body, 60), "Code"]), "\n".join(["/*", f" * {head}", " *", *(f" * {x}" for x in textwrap.wrap(body, 72)), " */"])):
            rows.append((len(rows), text))
            want.append((len(want), name, licence, len(seq)))
    got = sorted((r["doc_id"], r["rule"], r["license"], r["n_sentences"]) for r in licenses.scan(docs_of(spark, [*rows, (9999, "word " * 300_000 + "\n" + MIT)])).collect())
    assert got[:-1] == want and got[-1][:3] == (9999, "mit-text", "MIT")
    rng = random.Random(30)
    known = [*licenses.SENTENCES.values(), *(s for _, s in licenses.WORDINGS)]
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(known), rng.choice(known)[: rng.randrange(80)], sentence(rng, 4), "1.", "(b)", "iv."]) + rng.choice([".", ".\n", ";", "", "\n\n"]) for _ in range(8))
        text = rng.choice([text, "\n".join(textwrap.wrap(text, rng.randrange(20, 90))), text.upper()])
        assert licenses.identify(text, table) == plain_identifiers(text)


def test_mixing_against_plain_walk(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randrange(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src0", "src11", "src2", "odd", None])) for i in range(600)]
    rows += [(5, rows[5][1], "en", "src0"), (None, "null id", "en", "src0"), (900, None, "en", "src0"), (901, " \t", "en", "src0")]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["domain"], r["lang"], r["source"], r["epoch"], r["n_tokens"]) for r in mixing.mix(docs_of(spark, rows), bucket_rows=7).collect()))
    leaves = {}
    for d, t, lang, source in rows:
        n = len((t or "").split())
        digits = re.search("([0-9]+)$", source or "none")
        dom = f"d{int(digits[1][-1]) % 4}" if digits else "dother"
        if n:
            leaves.setdefault((dom, lang or "none", source or "none"), []).append((d, n, hashlib.md5((t or "").encode()).hexdigest()))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}

    def share(budget, caps, weight):
        """Water-filling by repeated rounds."""
        out, left = {}, dict(caps)
        while left:
            unit = budget / sum(weight.get(k, 1) for k in left)
            full = [k for k in left if left[k] / weight.get(k, 1) <= unit]
            if not full:
                return out | {k: int(unit * weight.get(k, 1) + 1e-6) for k in left}
            k = min(full, key=lambda k: (left[k] / weight.get(k, 1), k))
            out[k] = left.pop(k)
            budget -= out[k]
        return out

    want = []
    cap = lambda *p: sum(2 * n for k, n in tokens.items() if k[: len(p)] == p)
    for dom, b in share(sum(tokens.values()) * 600 // 1000, {d: cap(d) for d in {k[0] for k in tokens}}, mixing.DOMAIN_WEIGHTS).items():
        for lang, c in share(b, {x: cap(dom, x) for x in {k[1] for k in tokens if k[0] == dom}}, mixing.LANG_WEIGHTS).items():
            for source, take in share(c, {x: cap(dom, lang, x) for x in {k[2] for k in tokens if k[:2] == (dom, lang)}}, {}).items():
                rows_ = leaves[dom, lang, source]
                for epoch in range(take // tokens[dom, lang, source] + 1):
                    rest = take - epoch * tokens[dom, lang, source]
                    keys = sorted((hashlib.md5(f"mix:{epoch}:{'none:' + tie if d is None else d}".encode()).hexdigest(), tie, -1 if d is None else d, n) for d, n, tie in rows_)
                    for key in sorted({k[:2] for k in keys}):
                        same = [k for k in keys if k[:2] == key]
                        rest -= sum(k[3] for k in same)
                        if rest < 0:
                            break
                        want += [(k[2], dom, lang, source, epoch, k[3]) for k in same]
    assert got == sorted(want)
    assert mixing.mix(docs_of(spark, [])).collect() == []


PAGES = "page_id long, url string, html string, sha string, first long"


@pytest.mark.parametrize("rotate", [8 << 20, 300])
def test_warc_round_trip(spark, tmp_path, rotate):
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}\n", rng.choice(["<p>é</p>", "", None, f"<p>{i}</p>", "long " * 5000, "a\r\n\r\nContent-Length: 3\r\n\r\nb\r\n"]), "s", 1) for i in range(80)] + [(None, None, "<p>é</p>", None, None), (None, "u", "only here", None, None), (3, "again", "<p>3</p>", None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    monoliths, archives = str(tmp_path / "monoliths"), str(tmp_path / "archives")
    warc.write(pages, monoliths)
    warc.normalise(spark, monoliths, archives, rotate)
    got = sorted(((-1 if r["page_id"] is None else r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.read(spark, archives).collect())
    first = {}
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h, *_ in rows:
        f, data = first.get(h or ""), (h or "").encode()
        own = f is None or f == p
        want.append((-1 if p is None else p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", 0 if own else f))
    assert got == sorted(want)
    # The files themselves: a monolith is one gzip member, an archive one for each record at its index' offsets.
    raws = []
    for f in (tmp_path / "monoliths").glob("*.gz"):
        z = zlib.decompressobj(31)
        raws.append(z.decompress(f.read_bytes()))
        assert z.eof and not z.unused_data
    bodies = {f.parent.name.removeprefix("name=").removesuffix(".warc.gz"): f.read_bytes() for f in (tmp_path / "archives").glob("*.warc.gz/*.txt")}
    found, ids = [], set()
    for f in (tmp_path / "archives").glob("*.cdx/*.txt"):
        body, end = bodies.pop(f.parent.name.removeprefix("name=").removesuffix(".cdx")), 0
        for line in f.read_text().strip("\0\n").split("\n"):
            at, n, kind, name = line.split(" ")
            assert int(at) == end
            end += int(n)
            found.append(zlib.decompress(body[int(at) : end], 31))
            ids.add(name)
            assert f"WARC-Type: {kind}\r\n".encode() in found[-1]
        assert body[end:] in (b"", warc.EMPTY)
        assert gzip.decompress(body) == b"".join(found[-body.count(b"\x1f\x8b\x08") :]) or body[end:] or rotate > 300
    assert not bodies and len(ids) == len(rows) and sorted(found) == sorted(r for raw in raws for r in warc.split_stream([raw]))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_record_that_ends_in_no_zero():
    """A record of 16 MB and more: the highest byte of its length is not zero, so an empty member follows."""
    a = warc.Archive("x")
    a.add(warc.record("n", 1, "u", b"z" * (1 << 24), None, None))
    body = a.close().column(1)[0].as_py() + b"\0"
    assert body.endswith(warc.EMPTY) and len(gzip.decompress(body)) > 1 << 24


def test_stream_splits_in_small_pieces():
    raws = [warc.record(str(i), i, "u", b"x" * i + b"\r\n\r\nContent-Length: 9", None, None) for i in range(50)]
    whole = b"".join(raws)
    assert list(warc.split_stream(whole[i : i + 7] for i in range(0, len(whole), 7))) == raws
    with pytest.raises(ValueError):
        list(warc.split_stream([whole[:-30]]))


@pytest.mark.parametrize("least,types", [(0, ["response", "revisit"]), (9, ["response", "response"])])
def test_warc_least_bytes(spark, least, types):
    pages = spark.createDataFrame([(1, "a", "same", "", 0), (2, "b", "same", "", 0)], PAGES)
    assert [r["record_type"] for r in warc.round_trip(pages, least).orderBy("page_id").collect()] == types
