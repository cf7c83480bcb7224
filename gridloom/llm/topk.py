"""Exact top-k inner products with a pivot table.

Distances from every vector to many pivots are computed first. For a query q, a candidate x and any pivot p the triangle
inequality gives |q - x| >= | |q - p| - |x - p| |; the largest of these lower bounds turns into an upper bound of the inner
product, (|q|^2 + |x|^2 - bound^2) / 2. Each query evaluates its candidates from the best bound down and stops at the first
whose bound can't reach its k-th best score so far; the rest is eliminated without losing any result. Pivots come from a
documented sample (farthest-first among ``PIVOT_SAMPLE`` vectors of smallest hash): they set the speed, never the result.

Queries go out in blocks of some ``QUERY_BLOCK``, fewer where vectors are long; each task holds one block, one Arrow batch of candidates and the best k so far of
each query, which later batches have to beat, and passes on its best k per query once, at its end. A vector takes part if its id
is not null, it is not null, and no component is null, NaN or infinite; a pair needs equal lengths. Equal scores go to the smaller
id. Rows of one id are all candidates, and ask once, with the smallest of their vectors. Scores beyond a long count as
plus or minus 2**63 - 1. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import small_arrow_batches

QUERY_BLOCK = 16_384
#: Components that a block of queries holds at most (one query, if longer); they pass through the driver and are broadcast.
QUERY_NUMBERS = 4 << 20
PIVOTS = 32
PIVOT_SAMPLE = 512
SCALE = 64
_MOST, _EXACT = 2**63 - 1, 2**53


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, x as double."""
    whole = lambda y: F.when(F.abs(y) < float(_EXACT), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger ones have no fraction
    return F.transform(vector, lambda x: whole(x.cast("double") * scale))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, matrix) of a list column."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = rows, flat[offsets[rows][:, None] + np.arange(d)]
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a sample."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats while all partial sums are exact, else in whole numbers."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < _EXACT:
        return (x @ q).astype(np.int64)
    whole = (sum(int(a) * int(b) for a, b in zip(row, q)) for row in x)
    return np.array([min(max(s, -_MOST), _MOST) for s in whole], dtype=np.int64)


@dataclass
class Best:
    """The k best (ids, scores) of one query so far, best first."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def least(self, k: int) -> float:
        """What a candidate has to score to come in; equal scores may still win by id. Anything, where floats aren't exact."""
        return float(self.scores[-1]) if len(self.scores) == k and -_EXACT < self.scores[-1] < _EXACT else -np.inf

    def take(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[:k]
        self.ids, self.scores = ids[order], scores[order]


@dataclass
class Candidates:
    """A batch of vectors of one length, with their distances to the pivots (one row per pivot)."""

    ids: np.ndarray
    x: np.ndarray
    pivots: np.ndarray

    def __post_init__(self) -> None:
        self.square = (self.x * self.x).sum(1)
        self.far = np.ascontiguousarray(_distances(self.x, self.pivots).T)
        self.bound, self.gap = np.empty(len(self.ids)), np.empty(len(self.ids))

    def upper(self, q_square: float, q_far: np.ndarray) -> np.ndarray:
        """What each candidate may score at most, by the largest of the pivots' lower bounds of its distance."""
        self.bound.fill(0)
        for far, at in zip(self.far, q_far):
            np.subtract(far, at, out=self.gap)
            np.abs(self.gap, out=self.gap)
            np.maximum(self.bound, self.gap, out=self.bound)
        reach = q_square + self.square
        upper = 0.5 * (reach - self.bound * self.bound) + (1e-9 * reach + 1e-3)
        upper[np.isnan(upper)] = np.inf  # where squares leave the floats nothing is known
        return upper


def improve(best: Best, q_id: int, q: np.ndarray, q_far: np.ndarray, held: Candidates, k: int, step: int = 512) -> None:
    """Evaluate a batch for one query in the order of the bounds, and stop where none that is left can come in."""
    upper = held.upper(float(q @ q), q_far)
    left = np.flatnonzero((upper >= best.least(k)) & (held.ids != q_id))
    left = left[np.argsort(-upper[left])]
    falling = -upper[left]
    done, end = 0, len(left)
    while done < end:
        part = left[done : min(done + step, end)]
        done += len(part)
        scores = _inner(held.x[part], q)
        good = scores >= best.least(k)
        if good.any():
            best.take(held.ids[part[good]], scores[good], k)
            end = int(np.searchsorted(falling, -best.least(k), side="right"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for each query."""
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("x"))
    queries = clean.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))  # a repeated id asks once
    sample = {}
    for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(len(r.x), []).append(r.x)
    pivots = {d: choose_pivots(np.array(rows, dtype=np.float64).reshape(len(rows), d), PIVOTS) for d, rows in sample.items()}
    n, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    blocks = max(1, -(-n // max(1, min(query_block, QUERY_NUMBERS // max(longest or 0, 1)))))
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        held: dict[int, tuple[list, list]] = {}
        for r in part.toLocalIterator():  # one block of queries
            ids, rows = held.setdefault(len(r.x), ([], []))
            ids.append(r.vec_id)
            rows.append(r.x)
        shared = spark.sparkContext.broadcast({d: (np.array(ids), np.array(rows, dtype=np.float64).reshape(len(ids), d)) for d, (ids, rows) in held.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            so_far: dict[int, list[Best]] = {}
            far: dict[int, np.ndarray] = {}
            for batch in batches:
                all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                for d, (rows, x) in _matrix(batch.column("x")).items():
                    if d not in shared.value:
                        continue
                    q_ids, q = shared.value[d]
                    held = Candidates(all_ids[rows], x, pivots.get(d, np.zeros((1, d))))
                    if d not in so_far:
                        so_far[d], far[d] = [Best() for _ in q_ids], _distances(q, held.pivots)
                    for i, best in enumerate(so_far[d]):
                        improve(best, q_ids[i], q[i], far[d][i], held, k)
            for d, found in so_far.items():
                of = np.repeat(shared.value[d][0], [len(f.ids) for f in found])
                yield pa.record_batch([pa.array(of, pa.int64()), pa.array(np.concatenate([f.ids for f in found]), pa.int64()), pa.array(np.concatenate([f.scores for f in found]), pa.int64())], ["query_id", "vec_id", "score"])

        found = clean.mapInArrow(run, "query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
