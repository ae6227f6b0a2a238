"""Exact top-k inner products by pivot-table elimination.

Vectors are packed into blocks of neighbours: rows of a batch are ordered by their nearest pivot.
Beside each block lies its pivot table: the distances of its vectors to the same 128 pivots, computed
once. The pivots are far from each other: each is the vector of a bounded sample that is farthest from those before. For a query and a candidate the triangle inequality gives
|d(q, p) - d(c, p)| <= d(q, c) for every pivot p; the largest of these lower bounds, with the norms,
bounds the inner product from above. The least and largest distance of a block to each pivot bound all
its candidates at once. Every query carries a floor, its k-th best score in a bounded sample of
candidates, so blocks and candidates whose bound is below the floor go unseen, whichever task holds
them. The others are evaluated in the order of their bounds until the k-th best score exceeds the next
bound, so the answer is exact. Blocks of queries meet blocks of candidates in parallel, and each
query's best rows of all blocks are merged.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows with a
null id, take no part; only vectors of equal length are compared; a repeated id is a candidate each
time (never for itself) and one query for each distinct vector; ties go to the smaller id. Scaled
components of 2**20 and more are multiplied as integers of any size, and scores beyond 64 bits become
the largest or smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, per_batch

BLOCK_BYTES = 1 << 18
#: Candidates whose scores give the queries' floors.
SAMPLE = 1024
#: Shares of the candidates, or four for each core where these are more. Each gets a copy of all queries.
SHARES = 64
WIDE = 1 << 20
LONG = (1 << 63) - 1
PACKED = "dim int, ids binary, vectors binary, pivots binary, floors binary"


def scaled(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, integer vectors) of the valid rows of (id, vector), for each length."""
    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        v = v.values if v.is_valid else None
        if i is None or v is None or not len(v) or v.null_count:
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            ids, rows = by_dim.setdefault(len(x), ([], []))
            ids.append(i), rows.append(np.floor(scale * x))
    for dim, (ids, rows) in by_dim.items():
        yield dim, np.array(ids, np.int64), np.array(rows)


def distances(x: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    if pivots is None:
        return np.zeros((len(x), 1))
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of ``x``, each the farthest from all before it."""
    chosen, nearest = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def draw_sample(vectors: DataFrame, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> (ids, vectors) of ``SAMPLE`` rows by hash order; a constant number of rows reaches the driver."""
    at = F.xxhash64("id")
    # a task sends its first hashes; only then the vectors that they stand for
    last = vectors.select(at.alias("at")).orderBy("at").limit(SAMPLE).agg(F.max("at")).first()[0]
    rows = vectors.where(at <= last).orderBy(at, "id").limit(SAMPLE).toArrow()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in rows.combine_chunks().to_batches():
        for dim, ids, x in scaled(batch, scale):
            out[dim] = ids, x
    return out


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: as floats while all sums stay below 2**53, else as integers of any size."""
    if max(np.abs(q).max(), np.abs(vectors).max(initial=0)) < WIDE and len(q) < 1 << 13:
        return vectors @ q
    whole = [int(a) for a in q]
    return np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in vectors], object)


def floor_of(q_id: int, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> float:
    """The k-th best score in the sample, or less than any score if it has fewer candidates.

    Integers that a float cannot hold are rounded down: a floor above the score that set it would lose it.
    """
    if sample is None:
        return -np.inf
    scores = products(sample[1][sample[0] != q_id], q)
    if len(scores) < k:
        return -np.inf
    best = np.sort(scores)[-k]
    return float(best) if scores.dtype != object or int(float(best)) <= best else float(np.nextafter(float(best), -np.inf))


def pack(vectors: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], pivots: int, scale: float, k: int | None) -> DataFrame:
    """Blocks of ids, integer vectors and pivot distances; with ``k`` also floors, for queries."""

    table = {dim: far_apart(x, pivots) for dim, (_, x) in sample.items()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in scaled(batch, scale):
                far = distances(x, table.get(dim))
                order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
                step = max(1, BLOCK_BYTES // (8 * dim))
                for at in range(0, len(ids), step):
                    pick = order[at : at + step]
                    floors = np.array([floor_of(ids[i], x[i], sample.get(dim), k) for i in pick]) if k else np.empty(0)
                    columns = [ids[pick].tobytes(), np.ascontiguousarray(x[pick]).tobytes(), np.ascontiguousarray(far[pick]).tobytes(), floors.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], ["dim", "ids", "vectors", "pivots", "floors"])

    return vectors.mapInArrow(blocks, PACKED)


def most_possible(q: np.ndarray, squares: np.ndarray | float, lower: np.ndarray | float) -> np.ndarray | float:
    """The largest inner product of q with vectors of these squared norms at these distances or farther."""
    own = q @ q
    return (own + squares - lower**2) / 2 + 1e-9 * (own + squares) + 1e-6  # rounding of distances, norms and wide scores


def best_of_block(query: tuple, block: tuple, k: int, chunk: int = 64) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, id, score) of the k best candidates of one block that reach the query's floor, for each
    query of another block, and how many candidates were evaluated."""
    (q_ids, q_vecs, q_piv, floors), (ids, vecs, piv) = query, block
    squares = (vecs**2).sum(axis=1)
    most, near, far = squares.max(), piv.min(axis=0), piv.max(axis=0)
    out, evaluated = [], 0
    for q_id, q, d, floor in zip(q_ids, q_vecs, q_piv, floors, strict=True):
        if most_possible(q, most, max(0.0, (near - d).max(), (d - far).max())) < floor:
            continue
        upper = most_possible(q, squares, np.abs(piv - d).max(axis=1))
        some = np.flatnonzero((upper >= floor) & (ids != q_id))
        order = some[np.argsort(-upper[some], kind="stable")]
        best: list[tuple] = []
        at, size = 0, chunk
        while at < len(order) and not (len(best) >= k and -best[-1][0] > upper[order[at]]):
            pick = order[at : at + size]
            scores = products(vecs[pick], q)
            good = np.flatnonzero(scores >= (floor if len(best) < k else max(floor, -best[-1][0])))
            best = sorted(best + [(-scores[j], int(ids[pick[j]])) for j in good])[:k]
            at, size, evaluated = at + size, 2 * size, evaluated + len(pick)
        out += [(int(q_id), i, max(-LONG - 1, min(LONG, int(-s)))) for s, i in best]
    return out, evaluated


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, pivots: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (id, vector) that ``queries`` selects, against all others."""
    spark = vectors.sparkSession
    sample = draw_sample(vectors.where("id is not null and vector is not null"), scale)
    blocks = cut(pack(vectors, sample, pivots, scale, None).drop("floors"), "pivot-table")
    asked = pack(vectors.where(queries).dropDuplicates(["id", "vector"]), sample, pivots, scale, k)
    shares = max(1, min(max(SHARES, 4 * spark.sparkContext.defaultParallelism), blocks.count()))
    # every query block meets every candidate block: candidates are dealt out, queries are copied to each share
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    copied = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("q_share"))
    # not broadcast: Spark knows the size of the queries, not how many copies there will be
    pairs = dealt.join(copied.hint("merge"), (F.col("share") == F.col("q_share")) & (F.col("dim") == F.col("q_dim"))).select("dim", "q_ids", "q_vectors", "q_pivots", "ids", "vectors", "pivots", "q_floors")

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int]] = []
        for dim, *parts, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            query, block = ((np.frombuffer(i, np.int64), np.frombuffer(v).reshape(-1, dim), np.frombuffer(p).reshape(len(i) // 8, -1)) for i, v, p in (parts[:3], parts[3:]))
            rows += best_of_block((*query, np.frombuffer(floors)), block, k)[0]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(per_batch(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
