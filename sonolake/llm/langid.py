"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax over that mean gives
class probabilities.  Embeddings and softmax are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled rows; a part of the sample is held back to calibrate a temperature and the
score under which a prediction is rejected.  Every text is scored whole, on executors, in blocks.

The sample is drawn from all labelled rows, at most ``SAMPLE_ROWS`` of a language and ``SAMPLE_ALL`` in all, evenly over
languages; a text of over ``PIECE`` characters is cut whole into pieces, of which one is drawn.  So neither long texts
nor rare languages are left out.

Defined results: a null text, an empty one, or one without a letter is 'und' with score 0 and rejected; of languages
with equal scores the first by name is predicted; rows with a null doc_id are never trained on and are not held out;
repeated rows are scored each, and count once in the sample; columns that are carried may have any names; with no
labelled rows at all, or an empty table, every text is 'und'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stage

#: Bounds of the training sample: rows of a language and of all, characters of a row.
SAMPLE_ROWS, SAMPLE_ALL, PIECE = 1500, 20_000, 2000
#: Languages up to which their counts are broadcast; beyond, they are joined.
BROADCAST_LANGS = 50_000
#: Share of clean calibration rows that rejection may cost.
REJECT = 0.001
UND = "und"
BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
BLOCK = 1 << 19


def ngrams(data: np.ndarray, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Hash buckets of all byte n-grams of a uint8 array."""
    x = data.astype(np.uint32)
    out, h = [], np.full(len(x), 2166136261, np.uint32)
    for n in range(1, max(orders) + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(16777619)
        if n in orders:
            y = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((y ^ (y >> np.uint32(13))) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def prepare(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text between spaces."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # by bucket: what it adds to each class' logit, or its embedding where classes outnumber dimensions
    out: np.ndarray  # from a mean row of the table to logits
    bias: np.ndarray
    temperature: float
    least: float  # scores below are rejected

    def logits(self, text: str) -> np.ndarray:
        data, total, n = prepare(text), np.zeros(self.table.shape[1]), 0
        over = max(ORDERS) - 1
        for at in range(0, max(1, len(data) - over), BLOCK):
            piece = data[at : at + BLOCK + over]
            idx = ngrams(piece)
            if at + BLOCK + over < len(data):  # shorter n-grams of the overlap belong to the next block
                idx = np.concatenate([ngrams(piece[: BLOCK + k - 1], (k,)) for k in ORDERS])
            total += np.take(self.table, idx, axis=0).sum(axis=0, dtype=np.float64)
            n += len(idx)
        return self.out @ (total / max(1, n)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is accepted."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UND, 0.0, False
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 6.0, seed: int = 1) -> Model:
    """Fit (text, lang) rows by SGD; a fifth of them calibrates."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    langs = sorted({lang for _, lang in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    feats = []
    for text, lang in rows:
        u, c = np.unique(ngrams(prepare(text)), return_counts=True)
        feats.append((u, (c / c.sum()).astype(np.float32), number[lang]))
    order = rng.permutation(len(feats))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    fit = order[len(order) // 5 :] if len(order) >= 50 else order
    emb = (rng.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    out, bias = np.zeros((len(langs), DIM), np.float32), np.zeros(len(langs), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            u, w, y = feats[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            e = emb[u]
            h = w @ e
            z = out @ h + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out.T @ g
            out -= (lr * np.float32(0.5)) * np.outer(g, h)
            bias -= (lr * np.float32(0.05)) * g
            emb[u] = e - np.outer(w * lr, back)
    few = len(langs) <= DIM
    table, last = ((emb @ out.T).astype(np.float32), np.eye(len(langs))) if few else (emb, out.astype(np.float64))
    model = Model(langs, table, last, bias.astype(np.float64), 1.0, 0.0)
    z = np.array([last @ (w @ table[u]) + bias for u, w, _ in (feats[i] for i in held)], np.float64)
    y = np.array([feats[i][2] for i in held])

    def probs(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(probs(t)[np.arange(len(y)), y], 1e-12)).mean()))
    p = probs(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    if len(right) and len(langs) > 1:
        model.least = float(min(np.quantile(right, REJECT), 0.5))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_ALL, piece: int = PIECE) -> list[tuple[str, str]]:
    """Labelled texts of the training folds, drawn by a hash of the id, evenly over languages; of long ones a drawn piece.

    At most ``rows`` of each language, or its share of ``most`` where languages are many; one at least.
    """
    x = docs.select(F.col("doc_id").alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    x = x.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc").isNotNull() & ~held_out(F.col("doc")))
    counts = stage(x.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    langs = counts.count()
    each = max(1, min(rows, most // max(1, langs)))
    x = x.join(F.broadcast(counts) if langs <= BROADCAST_LANGS else counts, "lang")
    # Rows are drawn by their id before any text is cut, twice as many as are kept.
    x = x.where((F.xxhash64("doc").cast("double") / float(1 << 63) + 1) / 2 < 2.0 * each / F.col("n"))
    place = F.pmod(F.xxhash64("doc", F.lit("place")), F.greatest(F.lit(1), F.ceil(F.length("text") / piece)))
    x = x.withColumn("place", place).select("doc", "lang", F.expr(f"substring(text, cast(place * {piece} + 1 as int), {piece})").alias("text")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc"), "doc", "text"))
    x = x.withColumn("rank", first).where(F.col("rank") <= each)
    return [(r["text"], r["lang"]) for r in x.select("text", "lang").collect()]


def fit(docs: DataFrame) -> Model:
    return train(sample(docs))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id, if none are named) with lang_pred, score and accepted of every text.

    Of columns of the same names, the new ones are the last three.
    """
    keep = keep or ["doc_id"]
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    x = docs.select(held.alias("row"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x at most DIM, and DIM for each language

    def score(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.record_batch([batch.column(0), *new], names=["row", "lang_pred", "score", "accepted"])

    schema = StructType([x.schema["row"]]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    got = x.mapInArrow(score, schema)
    return got.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(keep)], "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is accepted, all columns as they are."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    texts = plain.select("*", F.col(f"c{docs.columns.index('text')}").alias("text"))
    got = predict(texts, model, plain.columns).where("accepted")
    return got.select(*plain.columns).toDF(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every text, learned from the table itself."""
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return out.withColumn("held_out", held_out(F.col("doc_id")))
