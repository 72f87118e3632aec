"""Nearest neighbours over shifted space-filling curves, with an exact completion over the first curve's cells.

Every vector is projected onto a few random orthonormal directions, and each of several shifted Hilbert curves
through the projections orders all rows. The rows are range-partitioned by curve and key; each query is compared
with its window of neighbouring keys on every curve, and the merged, reranked windows give it ten first neighbours
and so a bound on the tenth distance. On vectors without low-dimensional structure no window short of the table
reaches a recall of 0.9 (see the README), so a second step makes the answer exact: the first curve's order is cut into
cells of neighbouring rows, the queries' order into blocks, each with a centre and a radius, and a block is sent to those
cells that the bounds don't rule out. It is one pass, however many queries there are; a task holds one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import cut

CURVES = 3
DIMENSIONS = 6
BITS = 10
WINDOW = 64
"""Neighbouring keys looked at on each side of a query on each curve."""

SAMPLE = 5000
"""Most vectors that fit the projections' ranges; every row is indexed whatever the sample."""

CELL = 8192
"""Rows of a cell, which a task holds while it reads the queries sent there."""

QUERY_BLOCK = 512
"""Neighbouring queries that are sent to a cell together or not at all; more where there would be over BLOCKS blocks."""

BLOCKS = 8192
"""Most blocks of queries, whose centres and radii every task knows."""

CENTRES = 1 << 19
"""Numbers in all blocks' centres (4 MB): fewer blocks where vectors are long."""

_FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (integers below 2**bits, one column for each dimension) on the Hilbert curve.

    The walk from the top bit down: a set bit in a column inverts the lower bits of the first column, a clear one
    swaps those bits that the two columns differ in; Gray-coding the columns then gives the place's digits.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            on = (x[i] >> np.uint64(b) & one).astype(bool)
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] >> np.uint64(b) & one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | ((x[i] ^ t) >> np.uint64(b) & one)
    return key


class Curves:
    """Projections, ranges and shifts of all curves for vectors of one length."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, dims: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.parts = []
        for k in range(curves):
            basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(dims, dim)]
            at = sample @ basis
            lo, hi = at.min(axis=0), at.max(axis=0)
            width = np.where(hi > lo, (hi - lo) * 2.0, 1.0)  # room to shift by up to half the range
            self.parts.append((basis, lo - (hi - lo) * 0.5 * (k / curves + 0.25), width))

    def keys(self, vectors: np.ndarray, first: int | None = None) -> list[np.ndarray]:
        """Places on all curves, or on the first few."""
        top = (1 << self.bits) - 1
        return [hilbert(np.clip((vectors @ b - lo) / width * (top + 1), 0, top), self.bits).astype(np.int64) for b, lo, width in self.parts[:first]]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector that is neither null, empty nor zero and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long"), "embedding")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's k nearest (query, distance, id), an id once."""
    order = np.lexsort((ids, dist, q))
    same = np.lexsort((dist, ids, q))
    first = np.zeros(len(q), bool)
    if len(q):
        first[same] = np.r_[True, (q[same][1:] != q[same][:-1]) | (ids[same][1:] != ids[same][:-1])]
    order = order[first[order]]
    g = q[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.array([], int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


def _found(q: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], ["query_id", "vec_id", "score"])


def windows(rows: DataFrame, dim: int, curves: Curves, k: int, every: int, window: int) -> DataFrame:
    """First neighbours: each curve's windows, compared exactly. rows: valid(), of one length."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, key in enumerate(curves.keys(_matrix(b.column(1), dim)) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key), b.column(0), b.column(1)], ["curve", "key", "vec_id", "embedding"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(curve: np.ndarray, ids: np.ndarray, v: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
            """Queries from lo to hi of a stretch that holds their windows."""
            at = np.flatnonzero(ids[lo:hi] % every == 0) + lo
            out: list[tuple] = []
            for i in at.tolist():
                a, b = max(0, i - window), min(len(ids), i + window + 1)
                pick = np.flatnonzero((curve[a:b] == curve[i]) & (ids[a:b] != ids[i])) + a
                d = np.sqrt(((v[pick] - v[i]) ** 2).sum(axis=1))
                best = _best(np.zeros(len(pick), np.int64), ids[pick], d, k)
                out.append((np.full(len(best), ids[i]), ids[pick][best], d[best]))
            return _found(*(np.concatenate(c) for c in zip(*out))) if out else _found(*([],) * 3)

        held: tuple[np.ndarray, ...] | None = None
        done = 0  # rows of held whose windows were looked at
        for b in batches:
            new = (b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim))
            held = new if held is None else tuple(np.concatenate(c) for c in zip(held, new))
            if len(held[0]) >= 8192 + 2 * window:
                hi = len(held[0]) - window
                yield near(*held, done, hi)
                held, done = tuple(c[hi - window :] for c in held), window
        if held is not None:
            yield near(*held, done, len(held[0]))

    kind = rows.schema["embedding"].dataType.simpleString()
    ordered = rows.mapInArrow(spread, f"curve int, key long, vec_id long, embedding {kind}").repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    return ordered.select("curve", "vec_id", "embedding").mapInArrow(look, _FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of all rows found, an id once; partial bests have been taken where the rows were made."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return once.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def _stretches(rows: DataFrame, dim: int, curves: Curves, size: int, *more: str) -> DataFrame:
    """rows with place: neighbours on the first curve, size of them at most, share it. Equal keys are told apart by vec_id."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["vec_id", "embedding", *more]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(curves.keys(_matrix(b.column(1), dim), 1)[0]), *b.columns], ["key", *names])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for b in batches:
            place = (task << 32) + (done + np.arange(b.num_rows)) // size
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *b.columns], ["place", *names])

    columns = ", ".join(f"{c} {kinds[c]}" for c in names)
    ordered = rows.select(names).mapInArrow(key, f"key long, {columns}").repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    return cut(ordered.select(names).mapInArrow(number, f"place long, {columns}"))


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())


def complete(rows: DataFrame, asked: DataFrame, dim: int, curves: Curves, k: int) -> DataFrame:
    """All rows within each query's bound, k at most from a cell. asked: vec_id, embedding, bound; exact."""
    cells = _stretches(rows, dim, curves, CELL)
    blocks = _stretches(asked, dim, curves, max(QUERY_BLOCK, -(-asked.count() // max(1, min(BLOCKS, CENTRES // dim)))), "bound")

    def block_ball(table: pa.Table) -> pa.Table:
        centre, radius = _ball(_matrix(table["embedding"].combine_chunks(), dim))
        return pa.table([pa.array([table["place"][0].as_py()]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius + max(table["bound"].to_pylist())])], names=["block", "centre", "reach"])

    balls = blocks.groupBy("place").applyInArrow(block_ball, "block long, centre array<double>, reach double").toArrow()  # BLOCKS rows and one for each task, at most
    names, reach = balls["block"].to_numpy(), balls["reach"].to_numpy()
    centres = np.array(balls["centre"].to_pylist(), np.float64).reshape(-1, dim)

    def route(table: pa.Table) -> pa.Table:
        centre, radius = _ball(_matrix(table["embedding"].combine_chunks(), dim))
        away = np.sqrt(((centres - centre) ** 2).sum(axis=1))
        to = names[away * (1 - 1e-9) <= reach + radius]
        return pa.table([pa.array(np.full(len(to), table["place"][0].as_py()), pa.int64()), pa.array(to, pa.int64())], names=["cell", "block"])

    sent = cells.groupBy("place").applyInArrow(route, "cell long, block long").join(blocks.withColumnRenamed("place", "block"), "block")
    every = cells.select(F.col("place").alias("cell"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("bound"))
    every = every.unionByName(sent.select("cell", F.lit(1).alias("kind"), "vec_id", "embedding", "bound"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held = None, np.array([], np.int64), np.zeros((0, dim))
        for b in batches:
            of, kind, every_id, every_v, bounds = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dim), b.column(4).to_numpy()
            edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])]) if len(of) else []
            for a, z in zip(edges, [*edges[1:], len(of)]):
                if not kind[a]:
                    fresh = of[a] != cell
                    cell, ids, held = of[a], every_id[a:z] if fresh else np.r_[ids, every_id[a:z]], every_v[a:z] if fresh else np.concatenate([held, every_v[a:z]])
                    continue
                for lo in range(a, z, 512):
                    part = slice(lo, min(z, lo + 512))
                    q, v, most = every_id[part], every_v[part], bounds[part]
                    square, norm = (v * v).sum(axis=1), (held * held).sum(axis=1)
                    away = square[:, None] + norm[None, :] - 2 * (v @ held.T)
                    i, j = np.nonzero((away <= most[:, None] ** 2 + 1e-9 * (square[:, None] + norm[None, :])) & (ids[None, :] != q[:, None]))
                    dist = np.sqrt(((v[i] - held[j]) ** 2).sum(axis=1))
                    best = _best(i, ids[j], dist, k)
                    yield _found(q[i[best]], ids[j[best]], dist[best])

    return every.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(scan, _FOUND)


def search(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, window: int = WINDOW, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, its k nearest other rows.

    Euclidean distance in double precision, nearest first, ties to the smaller vec_id; all candidates, if fewer.
    Rows without a vec_id, and vectors that are null, empty, zero or hold nulls or non-finite numbers, take no part;
    only vectors of equal length are compared. Rows that repeat a vec_id count as one candidate at their smallest
    distance, and a repeated query id is answered with its smallest vector. exact=False returns what the windows
    alone find, which lack a query's neighbours beyond the window or another task's border, and a repeated query id's
    other vectors. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    results = []
    for size in [r["n"] for r in rows.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]:
        same = rows.where(F.size("embedding") == size)
        total = same.count()
        sample = same.orderBy(F.xxhash64("vec_id")).limit(SAMPLE) if total > SAMPLE else same
        fit = np.array([r[0] for r in sample.select("embedding").collect()], np.float64)
        curve = Curves(fit, size, curves, DIMENSIONS, BITS)
        asked = cut(same.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
        first = windows(same.where(F.col("vec_id") % every != 0).unionByName(asked), size, curve, k, every, window)  # a bound is of the vector that is asked
        if not exact:
            results.append(nearest(first, k))
            continue
        bounds = nearest(first, k).groupBy("query_id").agg(F.max("score").alias("bound"), F.count(F.lit(1)).alias("n"))
        asked = asked.join(bounds.where(F.col("n") >= k), asked["vec_id"] == bounds["query_id"], "left")
        asked = cut(asked.select("vec_id", "embedding", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
        results.append(complete(same, asked, size, curve, k))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return nearest(found.select("query_id", "vec_id", "score"), k)
