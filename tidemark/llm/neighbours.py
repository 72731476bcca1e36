"""Nearest neighbours by cosine: a block matrix join on int8 tiles, with error bounds, finished in floating point.

Query rows and candidate rows are dealt into blocks by hash; every pair of blocks is a tile, made by an equi-join on
(query block, candidate block). In a tile, unit vectors are held as int8 multiples of a step. The integer product of
two such vectors misses the cosine by at most a bound that follows from their measured quantisation errors. A candidate
whose upper bound lies under the k-th best lower bound of its query can't be among the k nearest and goes; the cosines
of the others are computed from the original vectors in double precision. A heap keeps each query's k best of a tile, and tiles
are merged ``FAN_IN`` at a time by heaps, in as many rounds as their number takes. So the result is exact.

Scale: a task holds one tile, whose size is a parameter. Each side crosses the network once for each block of the
other, as in any block matrix product, and what leaves a tile is k rows per query. Block numbers come from row counts.

Nulls and ties: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows
without an id. Vectors are compared with those of their own length only. Of equal cosines the smaller id is nearer.
Repeated ids are candidates of their own; a query is searched once, by the smallest of its vectors where an id has
several, against all rows but those of its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import batch
from tidemark.sources.staging import stage

NEAREST = 5
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
FAN_IN = 32
LEVELS = 127
#: Rounding in the bounds themselves is far below this.
SLACK = 1e-9
#: Integer products are summed in float32 as long as every sum is exact there.
EXACT_FLOAT32 = 1 << 24
FOUND = "query_id long, rank int, vec_id long, score double"
_NAMES = ("query_id", "rank", "vec_id", "score")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.float64())


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, size) of the rows that take part, components in double precision."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias(vector_col)).withColumn("v", v)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
        .select("vec_id", "v", F.size("v").alias("size"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first component to the last as a plain loop would."""
    total = np.zeros(len(right))
    for k in range(right.shape[1]):
        total += left[..., k] * right[:, k]
    return total


class Quantised:
    """Rows as int8 multiples of a step each, with the length of what rounding leaves out."""

    def __init__(self, rows: np.ndarray):
        scale = np.ldexp(1.0, np.frexp(np.abs(rows).max(axis=1))[1] - 1)[:, None]  # powers of two: nothing is rounded
        self.rows = rows / scale
        self.norms = np.sqrt(dots(self.rows, self.rows))
        unit = self.rows / self.norms[:, None]
        self.step = np.abs(unit).max(axis=1) / LEVELS
        self.levels = np.rint(unit / self.step[:, None]).astype(np.int8)
        written = self.levels * self.step[:, None]
        self.error = np.sqrt(((unit - written) ** 2).sum(axis=1))
        self.length = np.sqrt((written * written).sum(axis=1))


def cosines(query: np.ndarray, query_norm: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return dots(query, rows) / (query_norm * norms)


def tile_nearest(query_ids, queries: Quantised, ids, candidates: Quantised, k: int) -> Iterator[tuple[int, int, int, float]]:
    """(query_id, rank, vec_id, score): each query's k nearest in the tile."""
    kind = np.float32 if queries.rows.shape[1] * LEVELS * LEVELS < EXACT_FLOAT32 else np.float64
    right = candidates.levels.astype(kind).T
    for at in range(0, len(query_ids), 128):
        part = slice(at, at + 128)
        near = (queries.levels[part].astype(kind) @ right).astype(np.float64)
        near *= queries.step[part, None] * candidates.step
        # |u.v - û.v̂| <= |u - û| |v| + |û| |v - v̂|, and |v| = 1
        margin = queries.error[part, None] + queries.length[part, None] * candidates.error + SLACK
        for row, query_id in enumerate(query_ids[part]):
            others = np.flatnonzero(ids != query_id)
            if len(others) > k:
                low = near[row, others] - margin[row, others]
                least = np.partition(low, len(low) - k)[len(low) - k]
                others = others[near[row, others] + margin[row, others] >= least]
            scores = cosines(queries.rows[at + row], queries.norms[at + row], candidates.rows[others], candidates.norms[others])
            best = heapq.nsmallest(k, zip(-scores, ids[others].tolist()))
            for rank, (score, vec_id) in enumerate(best, 1):
                yield int(query_id), rank, vec_id, -float(score)


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list = []
        if left.num_rows and right.num_rows:
            queries, candidates = Quantised(_matrix(left.column("query"))), Quantised(_matrix(right.column("v")))
            found = list(tile_nearest(left.column("query_id").to_numpy(), queries, right.column("vec_id").to_numpy(), candidates, k))
        size, query_block, candidate_block = (x.as_py() for x in key)
        rows = batch(_NAMES, _TYPES, list(zip(*found)) or [[]] * 4)
        place = [np.full(rows.num_rows, x, np.int64) for x in (size, query_block, candidate_block)]
        return pa.table(dict(zip(("size", "query_block", "tile"), map(pa.array, place))) | dict(zip(_NAMES, rows.columns)))

    return run


def _merge(k: int):
    """Merges the sorted lists of up to ``FAN_IN`` tiles by a heap for each query."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, vecs, scores = (table.column(n).to_numpy() for n in ("query_id", "vec_id", "score"))
        found = []
        order = np.argsort(ids, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
            best = heapq.nsmallest(k, zip((-scores[rows]).tolist(), vecs[rows].tolist()))
            found += [(int(ids[rows[0]]), rank, vec_id, -score) for rank, (score, vec_id) in enumerate(best, 1)]
        size, query_block, tile = (x.as_py() for x in key)
        rows = batch(_NAMES, _TYPES, list(zip(*found)))
        place = [np.full(rows.num_rows, x, np.int64) for x in (size, query_block, tile)]
        return pa.table(dict(zip(("size", "query_block", "tile"), map(pa.array, place))) | dict(zip(_NAMES, rows.columns)))

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, a condition on the column ``vec_id``."""
    numbered = usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    rows = stage(numbered, "neighbours-vectors")  # stored, so that numbers are the same in every attempt
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    n_queries, n_rows = queries.count(), rows.count()
    query_blocks, tiles = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // candidate_block))
    deal = lambda by, n, name: F.pmod(F.xxhash64(by), F.lit(n)).alias(name)
    spread = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = queries.select("size", F.col("vec_id").alias("query_id"), F.col("v").alias("query"), deal("vec_id", query_blocks, "query_block"), spread(tiles, "tile"))
    right = rows.select("size", "vec_id", "v", deal("row", tiles, "tile"), spread(query_blocks, "query_block"))
    keys = ("size", "query_block", "tile")
    schema = "size long, query_block long, tile long, " + FOUND
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), schema)
    while tiles > 1:
        tiles = -(-tiles // FAN_IN)
        found = found.withColumn("tile", F.floor(F.col("tile") / FAN_IN)).groupBy(*keys).applyInArrow(_merge(k), schema)
    return found.select("query_id", "rank", "vec_id", "score")
