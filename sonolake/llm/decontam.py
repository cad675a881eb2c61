"""Benchmark decontamination: a BM25 index of test items searched by block-max WAND.

Distinct item texts are cut into units of at most ``UNIT`` words (of an item no longer than that, the longer of its
question and answer, as the two can stand apart) and indexed; a unit's impacts are its BM25 weights over the score of
the unit itself, so that one threshold serves all.  Document frequencies and the mean length are those of all items,
counted by Spark, so scores do not depend on how items are dealt into shards.  Every training passage (windows of twice
a unit's length, so that each unit fits in one) is a query: a bound from block maxima rules out passages that cannot
reach the threshold, block-max WAND retrieves all units above it for the rest, and an item that was retrieved counts as
leaked if the document holds enough of the word 5-grams of its question and of its answer.

The index is broadcast in shards of at most about ``SHARD`` texts and ``SHARD_BYTES`` bytes, ``TOGETHER`` of them in one
pass over the documents.

Defined results: a null or empty text, in documents or items, matches nothing; items with the same text all match; rows
with a null doc_id are searched and keep the null; rows of a repeated id are searched each; a text of any length is
searched whole, a piece at a time; an empty benchmark or table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

UNIT, BLOCK_UNITS, SHARD = 48, 4, 1_000
SHARD_BYTES, TOGETHER = 256 << 10, 4
#: Segments of UNIT words in a piece of a text, and words searched together.
PIECE, GROUP = 2048, 1 << 18
THRESHOLD, OVERLAP, GRAM = 0.6, 0.8, 5
K1, B = 1.2, 0.75
RARE = 0.05  # share of units up to which a term is rare
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the answer begins with its last sentence of three words or more,
    or with the last third of its words where that is also the first."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := words(s))]
    at = max((k for k, p in enumerate(parts) if len(p) >= 3), default=0)
    w = words(text)
    cut = sum(map(len, parts[:at])) or max(1, len(w) - max(1, len(w) // 3))
    return w[:cut], w[cut:]


def grams(w: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    """Word n-grams; a shorter sequence is one gram."""
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@dataclass
class Index:
    vocab: dict[str, int]
    unit_item: np.ndarray  # item of each unit
    items: list[tuple]  # (key of the item, question grams, answer grams)
    lists: list[tuple[list[int], list[float], dict[int, float]]]  # by term: units, impacts, maxima by block
    top: list[float]  # largest impact of each term
    rare: dict[str, int]  # terms of few units
    rare_max: np.ndarray  # rare terms x blocks, the same maxima
    frequent: np.ndarray  # by block: the most that all other terms add to one of its units
    bounds: dict[float, list] = field(default_factory=dict)  # parts by threshold

    def parts(self, threshold: float) -> list[tuple[dict[str, int], np.ndarray, np.ndarray]]:
        """(terms, maxima by block, what all other terms can add) of two sets of blocks that hold all between them.

        Where frequent terms alone stay below the threshold, a window needs a rare term; in other blocks every term counts.
        """
        if threshold not in self.bounds:
            low = self.frequent < threshold - 1e-4
            high = {int(b): k for k, b in enumerate(np.flatnonzero(~low))}
            rows, maxima = {}, []
            for word, (_, _, by_block) in zip(self.vocab, self.lists) if high else ():
                if not high.keys().isdisjoint(by_block):
                    rows[word] = len(maxima)
                    maxima.append([by_block.get(b, 0.0) for b in high])
            dense = np.array(maxima, np.float32).reshape(len(rows), len(high))
            self.bounds[threshold] = [(self.rare, self.rare_max[:, low], self.frequent[low]), (rows, dense, np.zeros(len(high)))]
        return self.bounds[threshold]

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all units whose impacts for these distinct terms add up to the threshold."""
        end = len(self.unit_item)
        cursors = [[self.lists[t][0][0], 0, self.top[t], t] for t in terms]
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[2]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            block = unit // BLOCK_UNITS
            if sum([self.lists[c[3]][2].get(block, 0.0) for c in cursors[: pivot + 1]]) < threshold:
                # No unit up to the end of this block, or the next list's unit, can reach the threshold.
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                self._forward(cursors[: pivot + 1], min((block + 1) * BLOCK_UNITS, after))
            elif cursors[0][0] == unit:
                score = sum(self.lists[c[3]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((unit, score))
                self._forward(cursors[: pivot + 1], unit + 1)
            else:
                self._forward(cursors[:pivot], unit)

    def _forward(self, cursors, unit: int) -> None:
        for c in cursors:
            units = self.lists[c[3]][0]
            c[1] = bisect_left(units, unit, c[1])
            c[0] = units[c[1]] if c[1] < len(units) else len(self.unit_item)


def cut_units(text: str) -> list[list[str]]:
    """The units of an item."""
    w = words(text)
    if len(w) <= UNIT:
        longer = max(question_answer(text), key=len)
        return [longer if len(longer) >= GRAM else w]
    n = -(-len(w) // UNIT)
    return [w[k * len(w) // n : (k + 1) * len(w) // n] for k in range(n)]


@dataclass
class Statistics:
    """Units of all items, their mean length, and in how many of them a term is."""

    units: int
    mean: float
    often: dict[str, int]


def statistics(texts: list[str]) -> Statistics:
    units = [u for t in texts if words(t) for u in cut_units(t)]
    often: dict[str, int] = {}
    for u in units:
        for t in set(u):
            often[t] = often.get(t, 0) + 1
    return Statistics(len(units), sum(map(len, units)) / max(1, len(units)), often)


def build(items: list[tuple], stats: Statistics | None = None) -> Index:
    """Index of (key, text) rows; statistics are their own where none are given."""
    stats = stats or statistics([t for _, t in items])
    units, unit_item, kept = [], [], []
    for key, text in sorted(((i, t) for i, t in items if words(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        q, a = question_answer(text)
        for unit in cut_units(text):
            units.append(unit)
            unit_item.append(len(kept))
        kept.append((key, grams(q), grams(a)))
    # Units of like size share blocks: impacts of frequent words, and so a block's bound, follow the size.
    by_size = sorted(range(len(units)), key=lambda u: len(set(units[u])))
    units, unit_item = [units[u] for u in by_size], [unit_item[u] for u in by_size]
    vocab: dict[str, int] = {}
    postings: list[list[tuple[int, int]]] = []
    for u, w in enumerate(units):
        for t in dict.fromkeys(w):
            if t not in vocab:
                vocab[t] = len(vocab)
                postings.append([])
            postings[vocab[t]].append((u, w.count(t)))
    n, spelt = len(units), list(vocab)
    idf = [np.log(1 + (stats.units - stats.often[t] + 0.5) / (stats.often[t] + 0.5)) for t in spelt]
    weights = [[w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(units[u]) / stats.mean)) for u, tf in p] for w, p in zip(idf, postings)]
    own = np.zeros(n)
    for p, x in zip(postings, weights):
        for (u, _), v in zip(p, x):
            own[u] += v
    lists = []
    rare = {t: r for r, t in enumerate(t for t in spelt if stats.often[t] <= max(2, RARE * stats.units))}
    rare_max = np.zeros((len(rare), -(-n // BLOCK_UNITS)), np.float32)
    frequent = np.zeros(-(-n // BLOCK_UNITS) * BLOCK_UNITS)
    for word, p, x in zip(spelt, postings, weights):
        impacts = [v / own[u] for (u, _), v in zip(p, x)]
        maxima: dict[int, float] = {}
        for (u, _), v in zip(p, impacts):
            maxima[u // BLOCK_UNITS] = max(maxima.get(u // BLOCK_UNITS, 0.0), v)
            if word not in rare:
                frequent[u] += v
        if word in rare:
            rare_max[rare[word], list(maxima)] = list(maxima.values())
        lists.append(([u for u, _ in p], impacts, maxima))
    frequent = frequent.reshape(-1, BLOCK_UNITS).max(axis=1)
    return Index(vocab, np.array(unit_item, np.int64), kept, lists, [max(x[1]) for x in lists], rare, rare_max, frequent)


def _windows(tokens: list[list[str]], base: np.ndarray, rows: dict[str, int], maxima: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Windows in which a block's bound, its maxima over the window's terms and the rest, reaches the threshold."""
    get = rows.get
    hits = [[(i, t) for i, t in enumerate(map(get, ws)) if t is not None] for ws in tokens]
    row = np.repeat(np.arange(len(tokens)), [len(h) for h in hits])
    if not len(row):
        return np.zeros(0, np.int64)
    at, ids = np.array([x for h in hits for x in h], np.int64).T
    seg = base[row] + at // UNIT
    v = len(rows)
    keys = np.unique(np.concatenate([seg * v + ids, (seg + 1) * v + ids]))
    window, term = keys // v, keys % v
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    ends = np.append(first[1:], len(keys))
    could = np.zeros(len(first), bool)
    for k in range(0, len(first), 4096):
        few = first[k : k + 4096]
        bound = np.add.reduceat(maxima[term[few[0] : ends[min(k + 4096, len(first)) - 1]]], few - few[0], axis=0)
        could[k : k + 4096] = (bound + rest >= threshold - 1e-4).any(axis=1)
    return window[first[could]]


def pieces(text: str | None):
    """The words of a text in lists of bounded length that overlap by a segment, so that all windows are whole in one."""
    if not text:
        return
    found = (m[0] for m in WORD.finditer(text.lower()))
    piece = list(islice(found, PIECE * UNIT))
    while piece:
        more = list(islice(found, PIECE * UNIT))
        yield piece
        piece = piece[-UNIT:] + more if more else []


def _retrieve(index: Index, rows: list[int], tokens: list[list[str]], threshold: float, found: dict) -> None:
    """Add the best score of each row and item to ``found``."""
    # Windows of two segments of UNIT words; segment s of a piece is in its windows s and s + 1.
    segments = np.maximum(1, -(-np.array([len(ws) for ws in tokens], np.int64) // UNIT))
    base = np.cumsum(segments + 1) - (segments + 1)
    windows = [_windows(tokens, base, *part, threshold) for part in index.parts(threshold)]
    for window in np.unique(np.concatenate(windows)).tolist():
        p = int(np.searchsorted(base, window, side="right")) - 1
        start = (window - int(base[p]) - 1) * UNIT
        terms = {index.vocab[w] for w in tokens[p][max(0, start) : start + 2 * UNIT] if w in index.vocab}
        for unit, score in index.retrieve(sorted(terms), threshold):
            best = found.setdefault(rows[p], {})
            item = int(index.unit_item[unit])
            best[item] = max(best.get(item, 0.0), score)


def search(index: Index, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """(row, item, score, question_overlap, answer_overlap) of every leak in a list of texts."""
    found: dict[int, dict[int, float]] = {}
    rows, tokens, size = [], [], 0
    for r, text in enumerate(texts):
        for piece in pieces(text):
            rows.append(r)
            tokens.append(piece)
            size += len(piece)
            if size >= GROUP:
                _retrieve(index, rows, tokens, threshold, found)
                rows, tokens, size = [], [], 0
    if rows:
        _retrieve(index, rows, tokens, threshold, found)
    out = []
    for r, best in sorted(found.items()):
        wanted: dict[int, set] = {}
        for item in best:
            for g in chain(*index.items[item][1:]):
                wanted.setdefault(len(g), set()).add(g)
        have = {g for ws in pieces(texts[r]) for n, some in wanted.items() for i in range(len(ws) - n + 1) if (g := tuple(ws[i : i + n])) in some}
        for item, score in sorted(best.items()):
            key, q, a = index.items[item]
            part_q, part_a = (len(g & have) / len(g) if g else 1.0 for g in (q, a))
            if part_q >= overlap and part_a >= overlap:
                out.append((r, key, score, part_q, part_a))
    return out


def _terms(batches):
    """(shard, term, units that hold it, words) of each batch of (shard, text); the null term counts all units."""
    for batch in batches:
        often: dict[tuple, list[int]] = {}
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for unit in cut_units(text) if words(text) else ():
                for term in (None, *set(unit)):
                    got = often.setdefault((shard, term), [0, 0])
                    got[0] += 1
                    got[1] += len(unit) if term is None else 0
        if often:
            cols = [[k[0] for k in often], [k[1] for k in often], [v[0] for v in often.values()], [v[1] for v in often.values()]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "term", "units", "words"])


class Shards:
    """The distinct texts of a benchmark dealt into shards, with statistics over all of them."""

    def __init__(self, benchmark: DataFrame, shard: int = SHARD, shard_bytes: int = SHARD_BYTES):
        x = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        x = x.where("octet_length(text) > 0").withColumn("key", F.md5(F.col("text").cast("binary")))
        #: the items of each text
        self.items = stage(x.select("key", "item_id"), "benchmark_items")
        texts = stage(x.groupBy("key").agg(F.first("text").alias("text")), "benchmark_texts")
        n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.count = -(-n // shard) + size // shard_bytes
        self.texts = texts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, self.count))).cast("int"))
        counts = stage(self.texts.select("shard", "text").mapInArrow(_terms, "shard int, term string, units long, words long").groupBy("shard", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words")), "benchmark_counts")
        whole = counts.where("term IS NULL").agg(F.coalesce(F.sum("units"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        self.units, self.mean = int(whole[0]), whole[1] / max(1, whole[0])
        often = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("units").alias("often"))
        self.often = stage(counts.where("term IS NOT NULL").select("shard", "term").join(often, "term"), "benchmark_terms", [counts])

    def index(self, shard: int) -> Index:
        """The index of a shard, from what its bounded number of texts and their terms bring to the driver."""
        often = {r["term"]: r["often"] for r in self.often.where(F.col("shard") == shard).select("term", "often").collect()}
        texts = self.texts.where(F.col("shard") == shard).select("key", "text").collect()
        return build([(r["key"], r["text"]) for r in texts], Statistics(self.units, self.mean, often))

    def passes(self):
        """Broadcast lists of indexes, each for one pass over the documents."""
        context = self.items.sparkSession.sparkContext
        for s in range(0, self.count, TOGETHER):
            yield context.broadcast([self.index(k) for k in range(s, min(s + TOGETHER, self.count))])


def _leaks(shared, texts: list[str | None], threshold: float, overlap: float) -> list[tuple]:
    return [x for index in shared.value for x in search(index, texts, threshold, overlap)]


FOUND = "doc_id long, key string, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item leaked in a document."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    shards = Shards(benchmark, shard)
    for shared in shards.passes():

        def work(batches, shared=shared):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    got = _leaks(shared, piece.column(1).to_pylist(), threshold, overlap)
                    if got:
                        rows, keys, *rest = zip(*got)
                        ids = piece.column(0).take(pa.array(rows))
                        yield pa.record_batch([ids, pa.array(keys, pa.string()), *[pa.array(c, pa.float64()) for c in rest]], names=[f.split()[0] for f in FOUND.split(", ")])

        out = out.unionByName(x.mapInArrow(work, FOUND))
    return out.join(shards.items, "key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """The rows of docs in which no item leaked, whatever their ids and other columns."""
    at = docs.columns.index("text")
    for shared in Shards(benchmark, shard).passes():

        def work(batches, shared=shared):
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    piece = batch.slice(start, 512)
                    gone = {r for r, *_ in _leaks(shared, piece.column(at).to_pylist(), threshold, overlap)}
                    yield piece.filter(pa.array([r not in gone for r in range(piece.num_rows)]))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
