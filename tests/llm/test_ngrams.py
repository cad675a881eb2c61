"""The automaton against the recursive definition of its probabilities."""

import random
import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pyarrow as pa
import pytest
from test_operators import corpus, docs_of

from sonolake.llm import ngrams


@pytest.mark.parametrize("order,chunk_bytes", [(1, 4 << 20), (2, 4000), (3, 3000), (3, 60_000), (4, 4 << 20)])
def test_against_recursive_definition(spark, order, chunk_bytes):
    rows = [(d, t) for d, t in corpus() if d != 206] + [(None, "Lorem ipsum of nobody"), (300, "é É ÀB ab"), (301, "unseen words only" if zlib.crc32(b"301") % 5 == 1 else "plain")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    seqs = [["<s>", *[x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x], "</s>"] for _, t in rows]
    c = Counter()
    for (d, _), s in zip(rows, seqs):
        if not held(d):
            for k in range(1, order + 1):
                c.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    n = sum(v for k, v in c.items() if len(k) == 1 and k != ("<s>",))
    v = sum(1 for k in c if len(k) == 1) - 1

    def p(ctx, w):
        if not ctx:
            return (c[w,] + 0.5) / (n + 0.5 * (v + 1))
        return (c[(*ctx, w)] + ngrams.STRENGTH * p(ctx[1:], w)) / (c[ctx] + ngrams.STRENGTH)

    want = {}
    for (d, _), s in zip(rows, seqs):
        total = sum(log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        want[d] = (held(d), len(s) - 1, sum(c[w,] > 0 for w in s[1:]), n, sum(log10(p((), w)) for w in s[1:]), total)
    got = ngrams.score(docs_of(spark, rows), order=order, chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4]
        assert isclose(r["base_score"], w[4], abs_tol=1e-6) and isclose(r["score"], w[5], abs_tol=1e-6)


def test_edges(spark):
    assert ngrams.score(docs_of(spark, [])).collect() == []
    only = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = ngrams.score(docs_of(spark, [(only, "a b")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3)
    r = ngrams.score(docs_of(spark, [(only, None), (only + 1, "w " * 60000)])).orderBy("doc_id").collect()
    assert (r[0]["n_tokens"], r[1]["n_tokens"], r[0]["n_known"]) == (1, 60001, 1)


def test_distributions_sum_to_one():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcde") for _ in range(30)).encode() for _ in range(5)]
    chunk = ngrams.Chunk(texts, [True] * 5, 3)
    counts = [g[1] for g in chunk.grams]
    n, v = int(counts[0].sum()) - 5, len(counts[0]) - 1
    m = ngrams.Automaton(chunk, counts, n, v, ngrams.STRENGTH)
    states, tokens = (np.concatenate(x) for x in zip(*m.arcs_from))
    arcs = {(int(s), int(t)): a for a, (s, t) in enumerate(zip(states, tokens))}
    assert len(arcs) == len(states) and {int(m.depth[s]) for s in states} == {1, 2}

    def log_probability(state, token):
        total = 0.0
        while state and (state, token) not in arcs:
            total, state = total + m.fail_weight[state], int(m.fail[state])
        return total + (m.arc_prob[arcs[state, token]] if state else m.base[token])

    for state in {m.start, *m.arc_next.tolist()} - set(m.root_next[1:2].tolist()):
        if any(s == state for s, _ in arcs):  # nothing follows an end
            back, s = 0.0, state
            while s:
                back, s = back + m.fail_weight[s], int(m.fail[s])
            unknown = 0.5 / (n + 0.5 * (v + 1)) * 10**back
            assert isclose(sum(10 ** log_probability(state, t) for t in range(1, chunk.words)) + unknown, 1, abs_tol=1e-9)
    # A chain of failure arcs: from a context of two tokens to one, and to none.
    assert any(m.depth[s] == 2 and m.depth[m.fail[s]] == 1 and m.fail[m.fail[s]] == 0 for s in range(len(m.fail)))


def test_words_are_cut_and_numbered_as_bytes():
    rng = random.Random(2)
    texts = [None, b"", b" \t", "é À\u00a0b\u2003c".encode(), b"\xff\xfe A\x0bb\x85c\x1cd"] + [bytes(rng.choice(b"aB \t\n\x0b\x0c\r\x00\x1f\xc3\xa0.") for _ in range(rng.randrange(40))) for _ in range(200)]
    for part in (texts, texts[3:7], []):
        numbers, sizes, words = ngrams.number_words(pa.array(texts, pa.binary()).slice(texts.index(part[0]) if part else 0, len(part)))
        want = [(t or b"").lower().split() for t in part]
        assert [words[i] for i in numbers] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
        assert words == list(dict.fromkeys(w for t in want for w in t))
