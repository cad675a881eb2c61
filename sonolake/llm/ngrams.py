"""Language-model scoring by a weighted backoff automaton.

The model interpolates n-gram counts with lower orders: P(w | ctx) = (c(ctx w) + b P(w | shorter ctx)) /
(c(ctx) + b), down to add-a-half unigrams, so every distribution sums to one.  As an automaton, contexts
seen in training are states, n-grams seen are arcs that carry a whole log-probability, and a state's
failure arc leads to the shorter context and carries log b / (c(ctx) + b).  One left-to-right traversal
of a text carries the state and adds up log-probabilities.

Documents are dealt into chunks.  A chunk's distinct n-gram hashes, with their counts in training rows, go
to buckets of the hash range; a bucket adds up what all chunks send and answers each chunk in the order
that it asked.  A chunk then builds the part of the automaton that its own texts can reach.  Words and pairs are asked
together, then one order after another: an n-gram whose first or last n - 1 tokens no other chunk asked for is in this
chunk alone, so its count is known and not asked.  A frequent n-gram is one entry of each chunk, however
often it occurs; buckets and tasks grow in number with the chunks, so that neither grows in size.  Words have hashes of
64 bits, longer n-grams of ``SPARE`` bits more than it takes to number the corpus' tokens, so that one of them meets
another with probability 2**-SPARE.

Tokens are words between white space, lower-cased in A-Z, then one end for each text.  Defined results: a
null text is empty (one token, the end); rows with a null doc_id are in training (their remainder is not
1); repeated rows count again; a text of any length is one sequence; columns other than doc_id and text are
not read, whatever their names; an empty table gives no rows; with no training rows, N and V are 0.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, chunked, mix64, number_words, pack_numbers, pack_sorted, stage, tasks_for, text_bytes, unpack_numbers, unpack_sorted

ORDER = 3
SPARE = 20
#: The strength b of the lower order in each interpolation.
STRENGTH = 8.0
CHUNK_BYTES = 5 << 19
END, START = b"\n", b"\n\n"  # no word holds white space
SENT = "kind int, chunk int, bucket int, keys binary, counts binary"
ANSWER = "kind int, chunk int, bucket int, counts binary, total long, kinds long"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Chunk:
    """Token sequences of a chunk's texts, each between a start and an end, and their n-gram hashes."""

    def __init__(self, texts: pa.Array | list[bytes], train: np.ndarray, order: int, bits: int = 64):
        numbers, sizes, words = number_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        self.sizes = sizes + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.ones(int(self.sizes.sum()), np.int32)  # 0 starts a text, 1 ends it
        self.tokens[self.starts] = 0
        self.tokens[np.arange(len(numbers)) + np.repeat(self.starts + 1 - (np.cumsum(sizes) - sizes), sizes)] = numbers + 2
        words = [START, END, *words]
        self.words = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        seen = np.repeat(np.asarray(train, bool), self.sizes)
        gram = h[self.tokens]
        inside = np.ones(len(self.tokens), np.int64)
        inside[self.starts] = 0
        depth = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        #: by order: distinct hashes, training counts, and each position's index among them (-1: none ends there)
        self.grams = []
        for k in range(1, order + 1):
            if k > 1:
                gram = np.concatenate([gram[:1], mix64(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens[1:]])])
            at = np.flatnonzero(depth >= k - 1)
            keys, index = np.unique(gram[at] >> np.uint64(64 - bits) if k > 1 else gram[at], return_inverse=True)
            where = np.full(len(self.tokens), -1, np.int32)
            where[at] = index
            self.grams.append((keys, np.bincount(index[seen[at]], minlength=len(keys)), where))


def _texts(table: pa.Table) -> pa.Array:
    return table.column("text").combine_chunks()


def _packets(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, shift: int) -> list[tuple]:
    of = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return [(kind, chunk, int(of[a]), pack_sorted(keys[a:b]), pack_numbers(counts[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])]


def _ask_pairs(order: int, buckets: int, bits: int):
    """Words and pairs of a chunk, all of them."""
    spread = (buckets - 1).bit_length()

    def work(table: pa.Table) -> pa.Table:
        chunk, number = Chunk(_texts(table), table.column("train").to_numpy(), min(order, 2), bits), table.column("chunk")[0].as_py()
        return _table([x for k, (keys, counts, _) in enumerate(chunk.grams) for x in _packets(number, k + 1, keys, counts, (bits if k else 64) - spread)], SENT)

    return work


def _open(chunk: Chunk, k: int, shared: np.ndarray) -> np.ndarray:
    """Which distinct k-grams may occur in other chunks: those of which both ends, of k - 1 tokens, do."""
    at = np.flatnonzero(chunk.grams[k - 1][2] >= 0)
    out = np.zeros(len(chunk.grams[k - 1][0]), bool)
    out[chunk.grams[k - 1][2][at]] = shared[chunk.grams[k - 2][2][at]] & shared[chunk.grams[k - 2][2][at - 1]]
    return out


def _totals(chunk: Chunk, answers: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The corpus' counts of a chunk's n-grams, from what was answered and what only this chunk has; which of the
    longest are in several chunks."""
    parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "counts"))), key=lambda r: r[:2])
    out: list[np.ndarray] = []
    shared = np.empty(0, bool)
    for k in range(1, order + 1):
        got = np.concatenate([np.empty(0, np.int64), *(unpack_numbers(x) for kind, _, x in parts if kind == k)])
        if k > 2:
            all_ = chunk.grams[k - 1][1] << 1
            all_[_open(chunk, k, shared)] = got
            got = all_
        out.append(got >> 1)
        shared = (got & 1) > 0
    return out, shared


def _ask_longer(k: int, buckets: int, bits: int):
    """A chunk's k-grams that may occur elsewhere."""
    spread = (buckets - 1).bit_length()

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], SENT)
        chunk = Chunk(_texts(docs), docs.column("train").to_numpy(), k, bits)
        keys, counts, _ = chunk.grams[k - 1]
        ask = _open(chunk, k, _totals(chunk, answers, k - 1)[1])
        return _table(_packets(docs.column("chunk")[0].as_py(), k, keys[ask], counts[ask], bits - spread) if ask.any() else [], SENT)

    return work


TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _answers(table: pa.Table) -> pa.Table:
    """Add up a bucket's counts over chunks and answer each, with a bit for keys of several chunks; total and kinds of the
    bucket stand on one row."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_numbers(x) for x in table.column("counts").to_pylist()]
    _, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)
    several = np.bincount(index) > 1
    at, rows = 0, []
    for n, chunk in zip(map(len, keys), table.column("chunk").to_pylist()):
        first = not rows
        rows.append((kind, chunk, bucket, pack_numbers((total << 1 | several)[index[at : at + n]]), int(total.sum()) if first else 0, int((total > 0).sum()) if first else 0))
        at += n
    return _table(rows, ANSWER)


class Automaton:
    """States, arcs and failure arcs that a chunk's texts can reach; logarithms to base 10.

    State 0 knows no context, the others are contexts that training saw.  Arcs are numbered; ``arc_at`` has, for each
    length of context, the arc that stands at each position of the texts, so that reading them looks none up.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], n: int, v: int, strength: float):
        order = len(counts)
        root = log10(n + 0.5 * (v + 1))
        base = np.zeros(chunk.words)
        one = chunk.grams[0][2]
        np.put(base, chunk.tokens, np.log10(counts[0][one] + 0.5) - root)
        self.base = base  # of each local token
        self.known = np.zeros(chunk.words, bool)
        np.put(self.known, chunk.tokens, counts[0][one] > 0)
        # A position's state after k tokens: the k-gram that ends there, if training saw it.
        offset, state_of = 1, []
        for k in range(1, order):
            number = np.where(counts[k - 1] > 0, np.arange(offset, offset + len(counts[k - 1])), 0)
            state_of.append(np.where(chunk.grams[k - 1][2] >= 0, number[chunk.grams[k - 1][2]], 0))
            offset += len(counts[k - 1])
        self.fail, self.fail_weight, self.depth = np.zeros(offset, np.int64), np.zeros(offset), np.zeros(offset, np.int8)
        for k in range(1, order):
            s = state_of[k - 1]
            c = counts[k - 1][np.maximum(chunk.grams[k - 1][2], 0)]
            self.fail_weight[s] = np.log10(strength / (c + strength))
            self.fail[s] = state_of[k - 2] if k > 1 else 0
            self.depth[s] = k
        self.fail[0], self.fail_weight[0], self.depth[0] = 0, 0.0, 0
        prob = 10 ** base[chunk.tokens]  # of each position's token after its context of k - 1 tokens
        self.arc_at, probs, after, self.arcs_from = [np.full(len(chunk.tokens), -1, np.int32)], [], [], []
        arcs = 0
        for k in range(2, order + 1):
            at = np.flatnonzero(chunk.grams[k - 1][2] >= 0)
            gram, ctx = chunk.grams[k - 1][2][at], chunk.grams[k - 2][2][at - 1]
            c, cc = counts[k - 1][gram], counts[k - 2][ctx]
            prob[at] = (c + strength * prob[at]) / (cc + strength)
            # One arc for each k-gram that training saw; all places where it stands have the same probability and target.
            place = np.zeros(len(counts[k - 1]), np.int64)
            place[gram] = at
            seen = np.flatnonzero(counts[k - 1] > 0)
            number = np.full(len(counts[k - 1]), -1, np.int32)
            number[seen] = np.arange(arcs, arcs + len(seen))
            here = np.full(len(chunk.tokens), -1, np.int32)
            here[at] = number[gram]
            self.arc_at.append(here)
            probs.append(np.log10(prob[place[seen]]))
            after.append(state_of[min(k, order - 1) - 1][place[seen]])  # the longest context that this k-gram leaves
            self.arcs_from.append((state_of[k - 2][place[seen] - 1], chunk.tokens[place[seen]]))
            arcs += len(seen)
        self.arc_prob, self.arc_next = (np.concatenate([np.empty(0, t), *x]) for x, t in ((probs, np.float64), (after, np.int64)))
        self.root_next = np.zeros(chunk.words, np.int64)
        if order > 1:
            np.put(self.root_next, chunk.tokens, state_of[0])
        self.start = int(self.root_next[0])
        self.tokens = chunk.tokens
        self.lists = self.fail.tolist(), self.fail_weight.tolist(), self.depth.tolist(), self.arc_prob.tolist(), self.arc_next.tolist()

    def score(self, first: int, end: int) -> float:
        """Log-probability of the tokens from one position to another, read once from left to right."""
        fail, weight, depth, prob, after = self.lists
        tokens = self.tokens[first:end]
        here = [x[first:end].tolist() for x in self.arc_at]
        base, root_next = self.base[tokens].tolist(), self.root_next[tokens].tolist()
        state, total = self.start, 0.0
        for i in range(end - first):
            while state:
                arc = here[depth[state]][i]
                if arc >= 0:
                    total += prob[arc]
                    state = after[arc]
                    break
                total += weight[state]
                state = fail[state]
            else:
                total += base[i]
                state = root_next[i]
        return total


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, n: int, v: int, strength: float, bits: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], SCORES)
        train = docs.column("train").to_numpy()
        chunk = Chunk(_texts(docs), train, order, bits)
        m = Automaton(chunk, _totals(chunk, answers, order)[0], n, v, strength)
        rows = []
        for doc, t, at, size in zip(docs.column("doc_id").to_pylist(), train.tolist(), chunk.starts.tolist(), chunk.sizes.tolist()):
            tokens = chunk.tokens[at + 1 : at + size]
            rows.append((doc, not t, size - 1, int(m.known[tokens].sum()), n, float(m.base[tokens].sum()), m.score(at + 1, at + size)))
        return _table(rows, SCORES)

    return work


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, chunk_bytes: float = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    total = text_bytes(docs, "text")
    chunks = chunk_count(total, chunk_bytes)
    tasks, bits = tasks_for(chunks), min(64, SPARE + max(20, total.bit_length()))
    buckets = 1 << max(2, (chunks // 3).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), (~held_out(F.col("doc_id").cast("long"))).alias("train"))
    base = chunked(rows, chunks, "doc_id", "train", "text").repartition(tasks, "chunk")

    def answered(asks: DataFrame, name: str) -> DataFrame:
        return stage(asks.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_answers, ANSWER), name)

    answers = answered(base.groupBy("chunk").applyInArrow(_ask_pairs(order, buckets, bits), SENT), "ngram_counts")
    # The start of each text is a token of the sequences but of neither N nor V.
    got = answers.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    texts = rows.where("train").count()
    n, v = got[0] - texts, got[1] - (texts > 0)

    def with_answers():
        return base.groupBy("chunk").cogroup(answers.select("chunk", "kind", "bucket", "counts").repartition(tasks, "chunk").groupBy("chunk"))

    for k in range(3, order + 1):
        answers = answers.unionByName(answered(with_answers().applyInArrow(_ask_longer(k, buckets, bits), SENT), f"ngram_counts_{k}"))
    return with_answers().applyInArrow(_scores(order, int(n), int(v), strength, bits), SCORES)
