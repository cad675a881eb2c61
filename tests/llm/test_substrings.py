"""Suffix sorting and removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from test_operators import corpus, docs_of, sentence

from sonolake.llm import substrings


def brute(rows):
    """(removed bytes, spans, kept) of each (doc_id, text) row."""
    first = {}
    data = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_suffix_order_is_lexicographic():
    rng = random.Random(1)
    for alphabet in (b"a", b"ab", bytes(range(97, 123))):
        text = bytes(rng.choice(alphabet) for _ in range(400)) * 3 + bytes(rng.choice(alphabet) for _ in range(300))
        starts = np.array(sorted(rng.sample(range(len(text) - 50), 700)))
        got = substrings.suffix_order(np.frombuffer(text, np.uint8), starts)
        keys = [text[s : s + 50] for s in starts.tolist()]
        place = {k: i for i, k in reversed(list(enumerate(sorted(keys))))}
        assert got.tolist() == [place[k] for k in keys]


def test_runs_cover_all_suffixes(monkeypatch):
    b = np.frombuffer(bytes(random.Random(2).choice(b"abc ") for _ in range(5000)) + b"z" * 900, np.uint8)
    whole = substrings.runs(b)
    monkeypatch.setattr(substrings, "PIECE", 333)
    for starts, sizes, values in (whole, substrings.runs(b)):
        assert starts[0] == 0 and sizes.sum() == len(b) - 49 and (starts[1:] == (starts + sizes)[:-1]).all() and sizes.max() <= substrings.RUN
    small = substrings.runs(b)
    assert (np.repeat(small[2], small[1]) == np.repeat(whole[2], whole[1])).all()


def rows_of():
    rng = random.Random(9)
    line = sentence(rng, 14)
    rows = [r for r in corpus() if r[0] != 206]
    for k in range(40):  # a frequent line between other texts, cut at different ends
        rows.append((400 + k, sentence(rng, 20) + line[k % 5 :] + sentence(rng, 9)))
    long = sentence(rng, 3000)
    rows += [(500, long), (501, long[2000:9000] + "tail"), (502, "é" * 200), (503, "x" + "é" * 150), (504, "z" * 600), (505, "z" * 49), (506, "z" * 50 + "q"), (None, line), (None, sentence(rng, 30)), (7, rows[0][1])]
    return rows


def check(spark):
    rows = rows_of()
    got = substrings.remove_repeats(docs_of(spark, rows)).collect()
    got = sorted(((float("inf") if r["doc_id"] is None else r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark)
    assert substrings.remove_repeats(docs_of(spark, [])).collect() == []


def test_what_is_asked_does_not_follow_the_order_of_rows():
    rows = rows_of()
    asked = []
    for order in (rows, rows[::-1]):
        table = pa.table({"__text": [(t or "").encode() for _, t in order], "__id": pa.array([d for d, _ in order], pa.int64()), "__chunk": pa.array([0] * len(order), pa.int32())})
        distinct = substrings._chunk(table)[3]
        codes = substrings._table([(1, 0, 0, None, np.ones(len(distinct), np.uint8).tobytes(), None, None, None)])
        _, _, e, at = substrings._entries(table, codes)
        asked.append([(int(e.keys[i]), e.contents[i], int(e.least[i])) for i in at])
    assert asked[0] == asked[1]


def test_hot_minimizers_go_by_single_suffixes():
    rows = rows_of()
    docs = np.array([substrings.LAST if d is None else d for d, _ in rows])
    texts = [(t or "").encode() for _, t in rows]
    found = [substrings.runs(np.frombuffer(t, np.uint8)) for t in texts]
    n = sum(len(f[0]) for f in found)
    gone = []
    for code in (1, 2):  # all runs whole, all cut up
        e = substrings.Entries(texts, docs, found, np.full(n, code, np.uint8))
        held = substrings.least_holders(e.contents, e.keys, e.least)
        parts = [held.get(i, e.least[i : i + 1]) for i in range(len(e.contents))]
        gone.append([g.sum() for g in substrings.removed(texts, docs, e, np.concatenate(parts), np.array(list(map(len, parts))))])
    assert gone[0] == gone[1] and sorted(gone[0]) == sorted(r[2] for r in brute(rows))
