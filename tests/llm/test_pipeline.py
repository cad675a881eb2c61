"""Each stage of the pipeline against brute force over what the stage before it kept."""

import duckdb
import numpy as np
import pytest
import re
import xxhash
from pyspark.sql import functions as F
from test_operators import components

import corpus_pipeline
from sonolake.llm import decontam, mixing, substrings
from sonolake.llm.common import stage

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "accepted", "lang_pred", "__text", "chunk", "__chunk", "kept", "n_removed", "__id", "__row", "fp", "id", "component", "component_id", "row", "n", "key", "shard", "tie", "epoch", "domain", "c0", "c1"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    extra = spark.createDataFrame([(9001, "12 -- 34", "en", "src1", 8), (9002, None, "en", "src1", 0), (9003, "", None, None, 0), (None, "the and of that with this is and the", "en", "src1", 36)], docs.schema)
    both = docs.unionByName(extra).unionByName(docs.where("doc_id < 3"))
    for name in CLASHING:
        both = both.withColumn(name, F.concat(F.lit(name + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = [stage(both, "in")]
    for name, f in corpus_pipeline.STAGES:
        out.append(stage(f(spark, out[-1], SF), name))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def key(r):
    return tuple((x is None, x) for x in r)


def test_columns(tables):
    for t in tables[:-1]:
        assert t.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
        for r in t.collect():
            assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)


def test_language_stage(tables):
    before, after = rows(tables[0]), rows(tables[1])
    assert set(after) <= set(before)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone >= {9001, 9002, 9003} and len(gone) <= 5 and None not in gone


def test_near_duplicate_stage(tables):
    before = {r[0]: r for r in rows(tables[1]) if r[0] is not None}
    fp = {}
    for d, r in before.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        fp[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    want = [before[d] for d in fp if root[d] == d] + [r for r in rows(tables[1]) if r[0] is None]
    assert sorted(rows(tables[2]), key=key) == sorted(want, key=key)


def test_passage_stage(tables):
    before = [r for r in rows(tables[2])]
    first = {}
    inf = float("inf")
    for r in before:
        b = r[1].encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(inf if r[0] is None else r[0], first.get(b[i : i + 50], inf))
    want = []
    for r in before:
        b = r[1].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (inf if r[0] is None else r[0]):
                gone[i : i + 50] = True
        text = ""
        at = 0
        for c in r[1]:
            n = len(c.encode())
            text += "" if gone[at : at + n].any() else c
            at += n
        if not gone.any() or text.strip(" \t\n\r\x0b\x0c"):
            want.append((r[0], text, r[2], r[3], len(text)))
    assert sorted(rows(tables[3]), key=key) == sorted(want, key=key)
    assert len(before) > len(want) or any(len(a[1]) < len(b[1]) for a, b in zip(sorted(want, key=key), sorted(before, key=key)))


def test_leak_stage(spark, tables):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in rows(tables[3]):
        text = " " + " ".join(decontam.words(r[1])) + " "
        leak = any(all(sum(f" {' '.join(g)} " in text for g in decontam.grams(p)) >= 0.8 * len(decontam.grams(p)) for p in decontam.question_answer(x)) for x in items)
        if not leak:
            want.append(r)
    assert sorted(rows(tables[4]), key=key) == sorted(want, key=key)


def test_mix_stage(tables):
    documents = tables[4].toArrow()  # noqa: F841
    want = duckdb.sql(mixing.oracle("documents")).fetchall()
    got = [tuple(r) for r in tables[5].select("doc_id", "domain", "lang", "source", "epoch", "n_tokens").collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and got


def test_whole_characters():
    b = np.frombuffer("aéz€".encode(), np.uint8)
    gone = np.array([0, 0, 1, 0, 0, 0, 1], bool)
    assert b[~substrings.whole_characters(b, gone)].tobytes() == b"az"
