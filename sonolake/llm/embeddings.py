"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Unit vectors are projected on seeded orthonormal directions.  Two vectors collide in a projection if one
lies in the window of fixed half-width around the other, found in sorted order; pairs with enough
collisions are verified by cosine in double precision.  Window and counts are calibrated for pairs exactly
at the threshold (the hardest to find): each of two rounds of counting loses at most ``LOSS`` of them.

Equal vectors are one class throughout.  Classes are dealt into cells by the sides of the mean on which their first
projections lie; a query is asked in its own cell and in those that it reaches by crossing sides at a bounded cost
(the sum of squared distances).  The bound is proven: of any pair at the threshold one end reaches the other's cell, so
cells lose no pair, and what is found of a pair depends on its two vectors alone, whatever the table's size and however
many sides there are.  Their number is chosen for the least work.  Where vectors spread evenly over many dimensions no
number of sides saves any: all are one cell then, and all pairs are counted.  Cells are dealt into tiles of a bounded
size; every pair of tiles is a unit of work and yields numbers of links and spanning stars, never the links themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; rows with equal vec_id are separate vectors; a null vec_id takes
part and yields to any other id; components are read in double precision whatever their size; columns other than
vec_id and embedding are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stage, union_find

LEAST = 0.9
TILE, CELL = 2048, 8192
GROUPS, TOGETHER = 32, 32  # a cell's own tiles are met in so many groups, of at most so many tiles
SIDES, UNITS, STEPS = 24, float(1 << 40), float(1 << 24)
WIDTH = 2.0  # half-width of windows in standard deviations of a pair at the threshold
ROUNDS, LOSS = (16, 32), 0.001  # projections after each round of counting; share of threshold pairs lost in one


@lru_cache(maxsize=8)
def directions(dim: int, seed: int = 3) -> np.ndarray:
    """As many orthonormal directions as rounds use, or as the dimension has."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(dim, ROUNDS[-1]))))[0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(dim: int, sides: int, least: float = LEAST) -> int:
    """The cost up to which cells are asked: of every pair at the threshold one end reaches the other's cell.

    Unit vectors at the threshold are sqrt(2 - 2 * least) apart at most.  On a side that they cross, their distances u
    and v from it add up, so the sums of u * u and of v * v together are at most 2 - 2 * least and the smaller is half of
    that; on a single side u + v is bounded, and the smaller is a half of it.  What is added is far over all rounding.
    """
    if not sides:
        return 0
    return int(((1 - least) / (2 if min(dim, sides) == 1 else 1) + 1e-6) * UNITS)


def sides_of(vectors: np.ndarray, mean: np.ndarray, sides: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, squared distance from each side in whole units) of unit vectors."""
    off = vectors @ directions(vectors.shape[1])[:, :sides] - mean @ directions(vectors.shape[1])[:, :sides]
    return (off > 0) @ (1 << np.arange(sides, dtype=np.int64)), (np.minimum(off * off, 1.0) * UNITS).astype(np.int64)


def reached(home: int, costs: np.ndarray, most: int) -> np.ndarray:
    """The cells that one vector is asked in, its own first."""
    cells, sums = np.array([home], np.int64), np.zeros(1, np.int64)
    for k in np.argsort(costs, kind="stable").tolist():
        further = sums + costs[k]
        keep = further <= most
        if not keep.any():
            break
        cells, sums = np.concatenate([cells, cells[keep] ^ (1 << k)]), np.concatenate([sums, further[keep]])
    return cells


def best_sides(sample: np.ndarray, mean: np.ndarray, n: int, cell: int = CELL) -> int:
    """The number of sides of the least work: cells asked of a vector, times what is in a cell and a share for its move."""
    dim, best = sample.shape[1], (math.inf, 0)
    most = min(SIDES, directions(dim).shape[1], max(0, math.ceil(math.log2(max(1, n) / cell)))) if dim > 2 else 0
    for g in range(most + 1):
        home, costs = sides_of(sample, mean, g)
        asked = np.mean([len(reached(h, c, reach(dim, g))) for h, c in zip(home.tolist(), costs)])
        best = min(best, (asked * (n / 2**g + cell / 4), g))
        if asked > 1 << 14:
            break
    return best[1]


def least_count(m: int, loss: float = LOSS, width: float = WIDTH) -> int:
    """The largest number of collisions in m projections that at most ``loss`` of threshold pairs fall short of."""
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > loss:
            return k
    return m


def collisions(rank: np.ndarray, ordered: np.ndarray, queries: np.ndarray, width: int, counts: np.ndarray) -> None:
    """Add to counts[q, b] whether b lies in the window around query q, by bounds in sorted order."""
    lo, hi = np.searchsorted(ordered, queries - width, "left"), np.searchsorted(ordered, queries + width, "right")
    # Unsigned: what lies below the window wraps to more than any window holds.
    counts += (rank[None, :] - lo[:, None].astype(rank.dtype) < (hi - lo)[:, None].astype(rank.dtype)).view(np.uint8)


def candidates(pa_: np.ndarray, pb: np.ndarray, width: int, step: int = 256):
    """Blocks of (i, j) whose collisions reach the calibrated counts."""
    m = pa_.shape[1]
    rounds = [r for r in ROUNDS if r < m] + [m] if m else []
    order = [np.argsort(pb[:, k], kind="stable") for k in range(rounds[0])]
    ordered = [pb[o, k] for k, o in enumerate(order)]
    # Ranks in as few bytes as hold them, the number of rows included.
    ranks = [np.argsort(o).astype(np.uint16 if len(pb) < 1 << 16 else np.uint32) for o in order]
    for at in range(0, len(pa_), step):
        q = pa_[at : at + step]
        counts = np.zeros((len(q), len(pb)), np.uint8)
        for k in range(rounds[0]):
            collisions(ranks[k], ordered[k], q[:, k], width, counts)
        i, j = np.nonzero(counts >= least_count(rounds[0]))
        got = counts[i, j].astype(np.int32)
        for a, b in zip(rounds, rounds[1:]):
            got = got + (np.abs(q[i, a:b] - pb[j, a:b]) <= width).sum(axis=1)
            keep = got >= least_count(b)
            i, j, got = i[keep], j[keep], got[keep]
        yield at + i, j


def link(a: np.ndarray, b: np.ndarray, same: bool, least: float = LEAST):
    """Blocks of (i, j) with cosine of at least ``least``, by projections and then exactly; i < j if it is one set."""
    ua, ub = unit(a), unit(b)
    d = directions(a.shape[1])
    # Projections in whole units, so that it is the same which of two vectors is the query; the window is wider by more
    # than their rounding.
    width = round((WIDTH * math.sqrt(2 - 2 * least) / math.sqrt(a.shape[1]) + 1e-5 if a.shape[1] > 1 else 3) * STEPS)
    for i, j in candidates(np.rint(ua @ d * STEPS).astype(np.int32), np.rint(ub @ d * STEPS).astype(np.int32), width):
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", ua[x], ub[y]) >= least
            if near.any():
                yield x[near], y[near]


def _means(batches):
    """(dim, n, sum) of the unit vectors of a partition."""
    total: dict[int, list] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            x = unit(batch.column(1).filter(pa.array(dims == dim)).values.to_numpy(zero_copy_only=False).reshape(-1, dim)) if dim else None
            got = total.setdefault(dim, [0, np.zeros(dim)])
            got[0] += len(x)
            got[1] += x.sum(axis=0)
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.list_(pa.float64()))], names=["dim", "n", "sum"])


def _ask(plans: dict, kind: pa.DataType):
    """(dim, cell, home, own, id, n, costs, e): each class in its own cell and in all that it reaches."""

    def work(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                sides, mean = plans[dim]
                most = reach(dim, sides)
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                home, costs = sides_of(unit(flat), mean, sides)
                for at in range(0, len(home), 256):
                    cells = [reached(h, c, most) for h, c in zip(home[at : at + 256].tolist(), costs[at : at + 256])]
                    row = at + np.repeat(np.arange(len(cells)), list(map(len, cells)))
                    cell = np.concatenate(cells)
                    for k in range(0, len(row), 4096):
                        r, c = row[k : k + 4096], cell[k : k + 4096]
                        yield pa.record_batch(
                            [
                                pa.array(np.full(len(r), dim), pa.int32()), pa.array(c), pa.array(home[r]), pa.array(c == home[r]), part.column("id").take(pa.array(r)), part.column("n").take(pa.array(r)),
                                pa.FixedSizeListArray.from_arrays(pa.array(costs[r].ravel()), sides).cast(pa.list_(pa.int64())) if sides else pa.array([[]] * len(r), pa.list_(pa.int64())),
                                pa.FixedSizeListArray.from_arrays(pa.array(flat[r].ravel(), kind), dim).cast(pa.list_(kind)),
                            ], names=["dim", "cell", "home", "own", "id", "n", "costs", "e"],
                        )

    return work


def _pairs(batches):
    """Numbers of links and spanning stars of pairs of tiles: (own, same) and (home, id, n, costs, e) of both."""
    for batch in batches:
        for r in range(batch.num_rows):
            dim, cell, own, same = (batch.column(c)[r].as_py() for c in range(4))
            (ha, ka, na, ca, va), (hb, kb, nb, cb, vb) = ([batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(at, at + 5)] for at in (4, 9))
            sides = len(ca) // len(ka)
            most, bits = reach(dim, sides), np.arange(sides)
            crossed = ((ha ^ cell)[:, None] >> bits) & 1
            ca, cb = ca.reshape(len(ka), sides), cb.reshape(len(kb), sides)
            la, lb, stars = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))
            for i, j in link(va.reshape(-1, dim), vb.reshape(-1, dim), same):
                if not own:
                    # Where both ends reach each other's cell, the pair counts where the one of the smaller cell asks.
                    keep = ((crossed[i] * cb[j]).sum(axis=1) > most) | (ha[i] < cell)
                    i, j = i[keep], j[keep]
                np.add.at(la, i, nb[j])
                np.add.at(lb, j, na[i])
                stars = union_find(np.concatenate([stars[0], ka[i]]), np.concatenate([stars[1], kb[j]]))
            keys, links = np.concatenate([ka[la > 0], kb[lb > 0]]), np.concatenate([la[la > 0], lb[lb > 0]])
            u = pa.array(np.concatenate([stars[0], keys]), pa.int64())
            v = pa.concat_arrays([pa.array(stars[1], pa.int64()), pa.nulls(len(keys), pa.int64())])
            yield pa.record_batch([u, v, pa.array(np.concatenate([np.zeros(len(stars[0]), np.int64), links]), pa.int64())], names=["u", "v", "links"])


def _plans(classes: DataFrame, cell: int) -> dict[int, tuple[int, np.ndarray]]:
    """By length of vectors: sides and mean, from all of them; the number of sides is tried on a few.

    They say how pairs are dealt over tasks, and change nothing in what is found.
    """
    means = classes.select("dim", "e").mapInArrow(_means, "dim int, n long, sum array<double>")
    got: dict[int, list] = {}
    for r in means.toLocalIterator():
        of = got.setdefault(r["dim"], [0, np.zeros(r["dim"])])
        of[0] += r["n"]
        of[1] += np.array(r["sum"])
    out = {}
    for dim, (n, total) in got.items():
        few = classes.where(F.col("dim") == dim).select("e").limit(256).collect() if n > cell else []
        out[dim] = (best_sides(unit(np.array([r["e"] for r in few], np.float64)), total / n, n, cell) if few else 0, total / n)
    return out


def near_duplicates(vectors: DataFrame, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    e = F.col("e")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.coalesce(e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    # Equal vectors by 128 bits of hash; zeros of either sign are equal.
    rows = rows.withColumn("e", F.when(valid, F.transform(e, lambda v: F.when(v == 0, 0).otherwise(v).cast("float" if single else "double"))))
    rows = rows.withColumn("k1", F.when(e.isNotNull(), F.xxhash64("e"))).withColumn("k2", F.when(e.isNotNull(), F.xxhash64(F.lit(7), "e")))
    classes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("e").alias("e"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stage(classes.withColumn("dim", F.size("e")).withColumn("id", F.monotonically_increasing_id()), "classes")
    kind = pa.float32() if single else pa.float64()
    asked = classes.select("dim", "id", "n", "e").mapInArrow(_ask(_plans(classes, cell), kind), f"dim int, cell long, home long, own boolean, id long, n long, costs array<bigint>, e array<{'float' if single else 'double'}>")
    asked = stage(asked, "cells")
    sizes = stage(asked.groupBy("dim", "cell", "own").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")), "cell_sizes")
    dealt = asked.join(sizes, ["dim", "cell", "own"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    columns = ["home", "id", "n", "costs", "e"]
    tiles = dealt.groupBy("dim", "cell", "own", "part").agg(F.collect_list(F.struct(*columns)).alias("x"))
    tiles = stage(tiles.select("dim", "cell", "own", "part", *[(F.flatten(f"x.{c}") if c in ("costs", "e") else F.col(f"x.{c}")).alias(c) for c in columns]), "tiles", [asked])
    # All tiles of a cell meet those of its own vectors; of two of its own, the earlier meets the later.
    # Tiles are sent to groups of tiles, so that what is sent of each does not grow with their number.
    each = F.greatest(F.lit(1), F.least(F.lit(TOGETHER), F.ceil(F.col("parts") / GROUPS).cast("int")))
    whole = sizes.where("own").select("dim", "cell", "parts", each.alias("each"))
    left = tiles.select("dim", "cell", "own", F.col("part").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns]).join(whole, ["dim", "cell"])
    left = left.withColumn("group", F.explode(F.expr("sequence(0, cast((parts - 1) div each as int))"))).where("NOT own OR a div each <= group")
    right = tiles.where("own").drop("own").join(whole, ["dim", "cell"]).withColumn("group", F.expr("cast(part div each as int)")).drop("parts", "each")
    pairs = left.join(right.hint("merge"), ["dim", "cell", "group"]).where("NOT own OR a <= part")
    pairs = pairs.select("dim", "cell", "own", (F.col("own") & (F.col("a") == F.col("part"))).alias("same"), *[f"a_{c}" for c in columns], *columns)
    found = stage(pairs.mapInArrow(_pairs, "u long, v long, links long"), "links", [tiles, sizes])
    linked = found.where("links > 0").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    nodes = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    info = classes.select("k1", "k2", "id", "rep", "n").join(linked, "id", "left").join(nodes.withColumnRenamed("node", "id"), "id", "left")
    info = stage(info.select("k1", "k2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "class_links", [classes, found])
    smallest = info.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = stage(info.join(smallest, "component").select("k1", "k2", "n_links", "component_id"), "class_components", [info])
    out = rows.select("vec_id", "k1", "k2").join(info, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
