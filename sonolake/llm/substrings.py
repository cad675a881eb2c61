"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

The suffixes of the corpus, to a depth of ``L`` bytes, are sorted a bucket at a time.  A suffix's bucket is
its minimizer, the least hash among its q-grams, so that equal suffixes share a bucket and neighbouring
suffixes mostly travel together, as one run of text.  Documents are dealt into chunks, and:

1. each chunk sends its distinct minimizers to ranges of the hash space, which answer for each: found in
   one document (its suffixes cannot repeat), in several, or more than ``HOT`` times;
2. each chunk sends its distinct runs of repeating minimizers, with the smallest id that holds each; runs
   of hot minimizers are cut into single suffixes, whose bucket is their own hash, so that no bucket grows
   with a frequent line.  A bucket whose runs are all equal needs no sorting; in others the suffixes are
   sorted by difference cover, and each gets the smallest id among its equals;
3. each chunk marks the bytes of suffixes that a smaller id holds.

``suffix_order`` sorts one slab of buckets: by leading word, then, for ties, by precomputed ranks of a
difference-cover sample of positions (mod 7: 0, 1, 3), at the offset that puts both suffixes of a
comparison on sampled positions, then by the last word.

Defined results: null and empty texts have no bytes; a null doc_id is larger than any other; rows with equal
ids do not remove each other's bytes; repeats within one document stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Ids, chunk_count, chunked, mix64, pack_numbers, pack_sorted, stage, tasks_for, text_bytes, unpack_numbers, unpack_sorted

L, Q = 50, 24
HOT = 2048
RUN = 256  # suffixes in a run at most
PIECE = 1 << 20
SLAB = 1 << 20
CHUNK_BYTES = 4 << 20
COVER, MOD = (0, 1, 3), 7
LAST = np.iinfo(np.int64).max
GRAM_B = 0x100000001B3

MARKS = "kind int, chunk int, bucket int, keys binary, counts binary, docs binary, sizes binary, data binary"


def gram_hashes(b: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    x = b.astype(np.uint64) + np.uint64(1)
    n = len(x) - q + 1
    out, at, m, cur = np.zeros(n, np.uint64), 0, 1, x
    while m <= q:
        factor = np.uint64(pow(GRAM_B, m, 1 << 64))
        if q & m:
            out *= factor
            out += cur[at : at + n]
            at += m
        cur = cur[:-m] * factor + cur[m:] if 2 * m <= q else cur
        m *= 2
    return mix64(out)


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, suffixes, minimizer) of the runs of suffixes of L bytes that share a minimizer, in order."""
    if len(b) < L:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    parts = []
    for at in range(0, len(b) - L + 1, PIECE):
        cur, w, m = gram_hashes(b[at : at + PIECE + L - 1]), L - Q + 1, 1
        n = len(cur) - w + 1
        while 2 * m <= w:
            cur = np.minimum(cur[:-m], cur[m:])
            m *= 2
        least = np.minimum(cur[:n], cur[w - m : w - m + n])
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.append(starts, n))
        if (sizes > RUN).any():
            pieces = -(-sizes // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(starts, pieces) + nth * RUN
            sizes = np.diff(np.append(starts, n))
        # Minimizers are small numbers; scrambled again, they spread over all buckets.
        parts.append((starts + at, sizes, mix64(least[starts])))
    return tuple(np.concatenate(x) for x in zip(*parts))


def words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number, zeros after the end."""
    x = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x[: len(b)]


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int = L) -> np.ndarray:
    """For each suffix of ``text`` at ``starts`` its place among them, cut to ``depth`` bytes; equals share a place.

    There are ``depth`` bytes from each start.  Memory is a few words for each byte of text.
    """
    w = words(text)
    order = np.argsort(w[starts], kind="stable")
    lead = w[starts][order]
    first = np.concatenate([[True], lead[1:] != lead[:-1]]) if len(lead) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    place = np.empty(len(starts), np.int64)
    place[order] = np.flatnonzero(first)[group]
    tied = np.zeros(len(starts), bool)
    tied[order] = np.bincount(group, minlength=1)[group] > 1
    x = np.flatnonzero(tied)
    if not len(x):
        return place
    # Ranks of the sample: what is between the least and the largest offset, depth - MOD + 1 bytes.
    m = depth - MOD + 1
    at = np.arange(len(text) + MOD)
    at = at[np.isin(at % MOD, COVER)]
    wide = np.concatenate([w, np.zeros(depth + MOD, np.uint64)])
    cols = [wide[at + k] for k in [*range(0, m - 8, 8), m - 8]]
    by = np.lexsort(cols[::-1])
    new = np.zeros(len(at), bool)
    for c in cols:
        new[1:] |= c[by][1:] != c[by][:-1]
    rank = np.zeros(len(text) + 2 * MOD, np.int64)
    rank[at[by]] = np.cumsum(new)
    tail = np.unique(wide[starts[x] + depth - 8], return_inverse=True)[1]
    ties = np.unique(place[x], return_inverse=True)[1]
    bits = [int(v.max()).bit_length() for v in (rank, tail)]
    if int(ties.max()).bit_length() + sum(bits) > 63:
        raise ValueError("a slab of suffixes is too large")
    residue = starts[x] % MOD
    of = [np.flatnonzero(residue == r) for r in range(MOD)]
    below = np.zeros(len(x), np.int64)

    def keys(members, offset):
        return (((ties[members] << bits[0]) | rank[starts[x[members]] + offset]) << bits[1]) | tail[members]

    for a in range(MOD):
        sorted_by: dict[int, np.ndarray] = {}
        for b in range(MOD):
            if len(of[a]) and len(of[b]):
                offset = next(d for d in range(MOD) if (a + d) % MOD in COVER and (b + d) % MOD in COVER)
                if offset not in sorted_by:
                    sorted_by[offset] = np.sort(keys(of[a], offset))
                below[of[b]] += np.searchsorted(sorted_by[offset], keys(of[b], offset))
    # Places among all tied suffixes, made places in each tie's own range.
    start_of = np.concatenate([[0], np.cumsum(np.bincount(ties))[:-1]])
    place[x] += below - start_of[ties]
    return place


class Entries:
    """Distinct run texts of a chunk that go to buckets, and where they occur.

    ``codes`` has what was answered for each run: 0 leaves it out, 1 takes it whole, 2 cuts it into single suffixes.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, found: list, codes: np.ndarray):
        of = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        starts, sizes, values = (np.concatenate([np.empty(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.int64, np.int64, np.uint64)))
        take = np.flatnonzero(codes)
        times = np.where(codes[take] == 2, sizes[take], 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        take = np.repeat(take, times)
        single = codes[take] == 2
        #: document, start, suffixes and text of each occurrence
        self.doc, self.start = of[take], starts[take] + nth
        self.size = np.where(single, 1, sizes[take])
        number = Ids()
        ends = self.start + self.size + L - 1
        self.entry = np.fromiter((number[texts[d][i:j]] for d, i, j in zip(self.doc.tolist(), self.start.tolist(), ends.tolist())), np.int64, len(take))
        self.contents = list(number)
        self.keys, self.least = np.zeros(len(number), np.uint64), np.full(len(number), LAST)
        self.keys[self.entry] = values[take]
        for e in np.unique(self.entry[single]).tolist():
            self.keys[e] = xxhash.xxh64_intdigest(self.contents[e])
        np.minimum.at(self.least, self.entry, docs[self.doc])


def _chunk(table: pa.Table):
    texts = [b if b is not None else b"" for b in table.column("__text").combine_chunks().to_pylist()]
    docs = np.array([LAST if d is None else d for d in table.column("__id").to_pylist()], np.int64)
    found = [runs(np.frombuffer(t, np.uint8)) for t in texts]
    values = np.concatenate([np.empty(0, np.uint64), *(f[2] for f in found)])
    distinct, index = np.unique(values, return_inverse=True)
    return texts, docs, found, distinct, index


def _table(rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in MARKS.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, pa.int32() if t == "int" else pa.binary()) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _slices(keys: np.ndarray, shift: np.uint64):
    """(bucket, from, to) of ascending keys."""
    of = (keys >> shift).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    return [(int(of[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)])]


def _ask_minimizers(shift: np.uint64):
    def work(table: pa.Table) -> pa.Table:
        _, docs, found, distinct, index = _chunk(table)
        if not len(distinct):
            return _table([])
        doc = np.repeat(docs, [len(f[0]) for f in found])
        low, high = np.full(len(distinct), LAST), np.full(len(distinct), -LAST)
        np.minimum.at(low, index, doc)
        np.maximum.at(high, index, doc)
        counts = 2 * np.bincount(index, minlength=len(distinct)) + (low < high)
        chunk = table.column("__chunk")[0].as_py()
        return _table([(1, chunk, o, pack_sorted(distinct[a:b]), pack_numbers(counts[a:b]), None, None, None) for o, a, b in _slices(distinct, shift)])

    return work


def _answer_minimizers(table: pa.Table) -> pa.Table:
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack_numbers(c) for c in table.column("counts").to_pylist()])
    index = np.unique(np.concatenate(keys), return_inverse=True)[1]
    times = np.bincount(index, weights=counts >> 1)
    several = (np.bincount(index) > 1) | (np.bincount(index, weights=counts & 1) > 0)
    code = (several * (1 + (times > HOT))).astype(np.uint8)[index]
    at, rows = 0, []
    for n, chunk, bucket in zip(map(len, keys), table.column("chunk").to_pylist(), table.column("bucket").to_pylist()):
        rows.append((1, chunk, bucket, None, code[at : at + n].tobytes(), None, None, None))
        at += n
    return _table(rows)


def _sides(side: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in side.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])


def _entries(docs: pa.Table, side: pa.Table) -> tuple[list[bytes], np.ndarray, Entries, np.ndarray]:
    """A chunk's run texts, and the order in which they are asked: by bucket key, then text, as rows of a chunk
    can come in another order each time."""
    texts, ids, found, _, index = _chunk(docs)
    codes = np.frombuffer(b"".join(r["counts"] for r in _sides(side, 1)), np.uint8)
    e = Entries(texts, ids, found, codes[index])
    by_text = np.array(sorted(range(len(e.contents)), key=e.contents.__getitem__), np.int64)
    return texts, ids, e, by_text[np.argsort(e.keys[by_text], kind="stable")]


def _ask_runs(shift: np.uint64):
    def work(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        _, _, e, order = _entries(docs, side)
        chunk, rows = docs.column("__chunk")[0].as_py(), []
        for o, a, b in _slices(e.keys[order], shift) if len(order) else []:
            mine = [e.contents[i] for i in order[a:b].tolist()]
            rows.append((2, chunk, o, pack_sorted(e.keys[order[a:b]]), None, pack_numbers(e.least[order[a:b]]), pack_numbers(np.array(list(map(len, mine)))), b"".join(mine)))
        return _table(rows)

    return work


def least_holders(contents: list[bytes], keys: np.ndarray, docs: np.ndarray) -> dict[int, np.ndarray]:
    """The smallest id that holds each suffix, for the run texts whose key has several; all others repeat as a whole.

    Texts are distinct; equal suffixes are in texts of the same key.  Keys are taken in slabs of bounded text.
    """
    out: dict[int, np.ndarray] = {}
    order = np.argsort(keys, kind="stable")
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]])).tolist()
    slab: list[int] = []

    def sort(members):
        text = np.frombuffer(b"".join(contents[i] for i in members), np.uint8)
        n = np.array([len(contents[i]) for i in members])
        windows = n - L + 1
        base, skip = np.cumsum(n) - n, np.cumsum(windows) - windows
        starts = np.arange(windows.sum()) + np.repeat(base - skip, windows)
        place = suffix_order(text, starts)
        least = np.full(len(place), LAST)
        np.minimum.at(least, place, np.repeat(docs[members], windows))
        held = least[place]
        for i, a, w in zip(members, skip.tolist(), windows.tolist()):
            out[i] = held[a : a + w]

    total = 0
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            slab += order[a:b].tolist()
            total += int(sizes[a:b].sum())
            if total > SLAB:
                sort(np.array(slab))
                slab, total = [], 0
    if slab:
        sort(np.array(slab))
    return out


def _answer_runs(table: pa.Table) -> pa.Table:
    number = Ids()
    keys, docs, of = [], [], []
    for r in range(table.num_rows):
        data, start, mine = table.column("data")[r].as_py(), 0, []
        for end in np.cumsum(unpack_numbers(table.column("sizes")[r].as_py())).tolist():
            mine.append(number[data[start:end]])
            start = end
        of.append(np.array(mine, np.int64))
        keys.append(unpack_sorted(table.column("keys")[r].as_py()))
        docs.append(unpack_numbers(table.column("docs")[r].as_py()))
    which = np.concatenate(of)
    key, least = np.zeros(len(number), np.uint64), np.full(len(number), LAST)
    key[which] = np.concatenate(keys)
    np.minimum.at(least, which, np.concatenate(docs))
    del keys, docs
    held = least_holders(list(number), key, least)
    rows = []
    for mine, chunk, bucket in zip(of, table.column("chunk").to_pylist(), table.column("bucket").to_pylist()):
        parts = [held.get(e) for e in mine.tolist()]
        sizes = np.fromiter((1 if p is None else len(p) for p in parts), np.int64, len(parts))
        values = np.repeat(least[mine], sizes)
        for at, p in zip((np.cumsum(sizes) - sizes).tolist(), parts):
            if p is not None:
                values[at : at + len(p)] = p
        rows.append((2, chunk, bucket, None, None, pack_numbers(values), pack_numbers(sizes), None))
    return _table(rows)


def removed(texts: list[bytes], docs: np.ndarray, e: Entries, values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Which bytes of each text go.  ``values``: entry by entry the smallest holders of its suffixes, ``counts`` of
    them; one stands for all suffixes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes + 1) - sizes - 1
    marks = np.zeros(int((sizes + 1).sum()), np.int32)
    first = np.cumsum(counts) - counts
    whole = counts[e.entry] == 1
    go = np.flatnonzero(whole & (values[first[e.entry]] < docs[e.doc]) if len(e.entry) else whole)
    at = base[e.doc[go]] + e.start[go]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + e.size[go] + L - 1, -1)
    # Entries with a holder for each suffix, laid out suffix by suffix.
    rest = np.flatnonzero(~whole)
    n = e.size[rest]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rest = np.repeat(rest, n)
    less = values[first[e.entry[rest]] + nth] < docs[e.doc[rest]]
    at = (base[e.doc[rest]] + e.start[rest] + nth)[less]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + L, -1)
    gone = np.cumsum(marks, dtype=np.int32) > 0
    return [gone[a : a + k] for a, k in zip(base.tolist(), sizes.tolist())]


def whole_characters(b: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes to go, with those of characters that lose one."""
    character = np.cumsum((b & 0xC0) != 0x80)
    return np.bincount(character, weights=gone)[character] > 0


def _apply(characters: bool):
    def work(docs: pa.Table, side: pa.Table) -> pa.Table:
        fixed = docs.column("__row").combine_chunks()
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        if docs.num_rows:
            texts, ids, e, order = _entries(docs, side)
            answered = _sides(side, 2)
            asked = np.concatenate([np.empty(0, np.int64), *(unpack_numbers(r["sizes"]) for r in answered)])
            values = np.concatenate([np.empty(0, np.int64), *(unpack_numbers(r["docs"]) for r in answered)])
            # From the order in which entries were asked to their own.
            counts, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            counts[order], first[order] = asked, np.cumsum(asked) - asked
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            values = values[np.repeat(first, counts) + nth]
            for text, gone in zip(texts, removed(texts, ids, e, values, counts)):
                n_bytes.append(len(text))
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                b = np.frombuffer(text, np.uint8)
                kept.append(b[~(whole_characters(b, gone) if characters else gone)].tobytes() if n_removed[-1] else text)
        new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        return pa.table([fixed, *new], names=["__row", "n_bytes", "n_removed", "n_spans", "kept"])

    return work


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, chunk_bytes: float = CHUNK_BYTES, characters: bool = False) -> DataFrame:
    """The columns ``carry`` (doc_id, if none are named) of every row with n_bytes, n_removed, n_spans and the kept bytes.

    With ``characters``, what is kept loses the rest of characters that are cut, and so is UTF-8 again.  Carried columns
    may have any names but those four.
    """
    carry = carry or ["doc_id"]
    chunks = chunk_count(text_bytes(docs, "text"), chunk_bytes)
    tasks = tasks_for(chunks)
    shift = np.uint64(64 - max(2, chunks.bit_length()))
    # Carried columns travel as one struct, so that no name of theirs meets a name of the layout.
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    rows = docs.select(held.alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    base = chunked(rows, chunks, "__row", F.col("doc_id").alias("__id"), F.col("text").alias("__text")).withColumnRenamed("chunk", "__chunk").repartition(tasks, "__chunk")
    lean = base.select("__chunk", "__id", "__text")
    minimizers = lean.groupBy("__chunk").applyInArrow(_ask_minimizers(shift), MARKS).repartition(tasks, "bucket")
    codes = stage(minimizers.groupBy("bucket").applyInArrow(_answer_minimizers, MARKS), "minimizers")
    asked = lean.groupBy("__chunk").cogroup(codes.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_ask_runs(shift), MARKS).repartition(tasks, "bucket")
    answers = stage(asked.groupBy("bucket").applyInArrow(_answer_runs, MARKS), "runs")
    side = codes.unionByName(answers).repartition(tasks, "chunk")
    schema = StructType([StructField("__row", base.schema["__row"].dataType)]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    got = base.groupBy("__chunk").cogroup(side.groupBy("chunk")).applyInArrow(_apply(characters), schema)
    return got.select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", "kept")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digest query: every 50-byte string, as hex, with the smallest id that holds it."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, CAST(length(hex(encode(COALESCE(text, '')))) // 2 AS BIGINT) AS n FROM {table}),
k AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * L}) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, n - {L})) AS s FROM d WHERE n >= {L})),
f AS (SELECT g, MIN(doc_id) AS m FROM k GROUP BY g HAVING MIN(doc_id) < MAX(doc_id)),
r AS (SELECT DISTINCT k.doc_id, s FROM k JOIN f USING (g) WHERE f.m < k.doc_id),
i AS (SELECT doc_id, s, SUM(CASE WHEN p IS NULL OR s > p + {L} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM r)),
sp AS (SELECT doc_id, MIN(s) AS a, MAX(s) + {L} AS b FROM i GROUP BY doc_id, island),
t AS (SELECT doc_id, CAST(SUM(b - a) AS BIGINT) AS n_removed, COUNT(*) AS n_spans, MAX(b) AS last FROM sp GROUP BY doc_id),
p AS (SELECT doc_id, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM sp UNION ALL SELECT doc_id, last, n FROM t JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a) AS k FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept.k, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
