"""Exact vector top-k for tables of queries, and exact close pairs, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.scans import top_per
from factloom.session import cut

BLOCK = 2048
#: Blocks of queries a task holds at most, and blocks of vectors that pass by them; an entity has ``GROUPS`` groups of each if it has as many blocks.
HELD, PASSING, GROUPS = 8, 128, 8
#: Queries compared at once.
TILE = 1024
SCORE_DIGITS = 9
#: Vectors per block of a comparison of all with all, and of a tile of it.
NEAR_BLOCK, NEAR_TILE = 16384, 1024


def _groups(blocks: Column, most: int) -> Column:
    return F.greatest(F.least(blocks, F.lit(GROUPS)), F.ceil(blocks / most)).cast("long")


def _blocks(df: DataFrame, size: int, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (entity_id, vid, vec) packed into blocks of about ``size`` rows with the group they go with, and the groups there are.

    The number of blocks of an entity follows its size and ids are spread by
    hash, so no block grows with an entity.
    """
    sizes = df.groupBy("entity_id").agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    groups = sizes.select("entity_id", F.explode(F.sequence(F.lit(0).cast("long"), _groups(F.col("_blocks"), most) - 1)).alias(name))
    placed = df.join(sizes, "entity_id").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("_blocks")))
    packed = placed.groupBy("entity_id", "_blocks", "block").agg(F.collect_list(F.struct("vid", "vec")).alias("_rows"))
    group = F.floor(F.col("block") * _groups(F.col("_blocks"), most) / F.col("_blocks")).alias(name)
    return packed.select("entity_id", group, F.col("_rows.vid").alias("ids"), F.flatten("_rows.vec").alias("vecs")), groups


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    rows = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    norms = np.sqrt((rows * rows).sum(axis=1))
    norms[norms == 0] = np.inf
    return rows / norms[:, None]


class _Nearest:
    """Queries of a group and the best ``k`` hits each has met so far."""

    def __init__(self, k: int | None, min_score: float | None):
        self.k, self.min_score, self.parts, self.ids = k, min_score, [], None

    def hold(self, ids: np.ndarray, flat: np.ndarray) -> None:
        self.parts.append((ids, _unit(flat, len(ids))))

    def meet(self, ids: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Without ``k`` the hits among these vectors: queries, ids, scores."""
        if not self.parts:
            return
        if self.ids is None:
            self.ids, self.whole = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
            self.short = self.whole.astype(np.float32)
            self.scores, self.names = np.full((len(self.ids), self.k or 0), -np.inf), np.full((len(self.ids), self.k or 0), "", dtype=object)
        vectors = _unit(flat, len(ids))
        short, error = vectors.astype(np.float32).T, np.finfo(np.float32).eps * (vectors.shape[1] + 8) + 10.0**-SCORE_DIGITS
        for at in range(0, len(self.ids), TILE):
            own = slice(at, at + TILE)
            rough = self.short[own] @ short
            # What may reach the list in single precision, within its error, is scored in double precision.
            least = np.full(len(rough), -np.inf if self.min_score is None else self.min_score - error)
            if self.k is not None:
                worst = self.scores[own, -1]
                if np.isinf(worst).any() and len(ids) > self.k:
                    least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k] - 2 * error)
                least = np.maximum(least, worst - error)
            i, j = np.nonzero(rough >= least.astype(np.float32)[:, None] - np.finfo(np.float32).eps)
            if not len(i):
                continue
            i += at
            scores = np.round(np.einsum("ij,ij->i", self.whole[i], vectors[j]), SCORE_DIGITS) + 0.0
            fits = np.ones(len(i), dtype=bool) if self.min_score is None else scores >= self.min_score
            if self.k is None:
                yield self.ids[i[fits]], ids[j[fits]], scores[fits]
                continue
            fits &= scores >= self.scores[i, -1]
            if fits.any():
                self._add(i[fits], ids[j[fits]], scores[fits])

    def _add(self, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Merge hits into the lists: by score, then id."""
        own = np.unique(rows)
        rows = np.concatenate((np.repeat(own, self.k), rows))
        scores, names = np.concatenate((self.scores[own].ravel(), scores)), np.concatenate((self.names[own].ravel(), names))
        order = np.lexsort((names, -scores, rows))
        rows = rows[order]
        kept = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
        self.scores[own], self.names[own] = scores[kept].reshape(-1, self.k), names[kept].reshape(-1, self.k)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = ~np.isinf(self.scores)
        return np.repeat(self.ids, there.sum(axis=1)), self.names[there], self.scores[there]


def _compare(k: int, min_score: float | None):
    """Blocks side by side in pairs (q_ids, q_vecs, v_ids, v_vecs); pairs of the same queries in turn give one list."""
    def rows(entity, nearest: _Nearest) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "score"), nearest.best()), entity_id=entity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity = queries = nearest = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = np.asarray(row.q_ids, dtype=object)
                if entity != row.entity_id or queries is None or not np.array_equal(queries, own):
                    if nearest is not None:
                        yield rows(entity, nearest)
                    entity, queries, nearest = row.entity_id, own, _Nearest(k, min_score)
                    nearest.hold(own, row.q_vecs)
                list(nearest.meet(np.asarray(row.v_ids, dtype=object), row.v_vecs))
        if nearest is not None:
            yield rows(entity, nearest)

    return run


def _pass_by(k: int | None, min_score: float | None):
    def rows(entity, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        queries, ids, scores = found
        return pa.RecordBatch.from_arrays(
            [pa.array(queries, pa.string()), pa.array([entity] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(scores)], ["query_id", "entity_id", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of queries come first and are held; blocks of vectors pass by.
        group = nearest = None
        for batch in batches:
            for r in range(batch.num_rows):
                at = tuple(batch.column(c)[r].as_py() for c in ("entity_id", "q_group", "v_group"))
                if at != group:
                    if nearest is not None and k is not None and nearest.ids is not None:
                        yield rows(group[0], nearest.best())
                    group, nearest = at, _Nearest(k, min_score)
                ids, flat = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "vecs"))
                if batch.column("side")[r].as_py() == 0:
                    nearest.hold(ids, flat)
                    continue
                for found in nearest.meet(ids, flat):
                    yield rows(at[0], found)
        if nearest is not None and k is not None and nearest.ids is not None:
            yield rows(group[0], nearest.best())

    return run


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int | None, min_score: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, entity_id, chunk_id, score): k nearest vectors of the query's entity.

    Without ``k``, all vectors of at least ``min_score``, which must be given.

    ``queries`` has (query_id, entity_id, embedding), ``vectors`` (entity_id,
    chunk_id, embedding). Scores are cosines, 0 where a norm is 0, rounded to
    nine digits so that ranking does not depend on the block layout; equal
    scores go by id. A task holds the queries of a group of blocks, with the ``k`` best of each,
    and a group of blocks of vectors passes by; every block is sent to each group of the other side.
    """
    key = ["entity_id", "q_group", "v_group"]
    q, q_groups = _blocks(queries.select("entity_id", F.col("query_id").alias("vid"), F.col("embedding").alias("vec")), block, HELD, "q_group")
    wanted = queries.select("entity_id").distinct()
    mine = vectors.select("entity_id", F.col("chunk_id").alias("vid"), F.col("embedding").alias("vec")).join(wanted, "entity_id", "left_semi")
    v, v_groups = _blocks(mine, block, PASSING, "v_group")
    side = lambda rows, groups, at: rows.join(groups, "entity_id").select(*key, F.lit(at).alias("side"), "ids", "vecs")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = side(q, v_groups, 0).unionByName(side(v, q_groups, 1)).repartition(tasks, *key).sortWithinPartitions(*key, "side")
    hits = met.mapInArrow(_pass_by(k, min_score), "query_id string, entity_id string, chunk_id string, score double")
    return top_per(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _meet(min_score: float):
    """Positions (i, j) of vectors of two blocks that are close in single precision, within its error."""
    def unit(column: pa.Array, r: int, dims: int) -> np.ndarray:
        rows = column[r].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        norms = np.sqrt((rows * rows).sum(axis=1))
        norms[norms == 0] = np.nan
        return (rows / norms[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                entity, dims, x, y = (batch.column(c)[r].as_py() for c in ("entity_id", "dims", "x", "y"))
                left, right = unit(batch.column("left"), r, dims), unit(batch.column("right"), r, dims)
                least = np.float32(min_score - np.finfo(np.float32).eps * (dims + 8))
                for at in range(0, len(left), NEAR_TILE):
                    for to in range(at if x == y else 0, len(right), NEAR_TILE):
                        i, j = np.nonzero(left[at : at + NEAR_TILE] @ right[to : to + NEAR_TILE].T >= least)
                        i, j = i + at, j + to
                        if x == y:
                            i, j = i[i < j], j[i < j]
                        if len(i):
                            n = len(i)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([entity] * n, pa.string()), pa.array(np.full(n, dims, np.int32)), *[pa.array(np.asarray(c, np.int64)) for c in (np.full(n, x), np.full(n, y), i, j)]],
                                ["entity_id", "dims", "x", "y", "i", "j"],
                            )

    return run


def near_pairs(vectors: DataFrame, min_score: float, block: int = NEAR_BLOCK) -> DataFrame:
    """(entity_id, a, b, score), a < b, of vectors (entity_id, vid, vec) with a cosine of ``min_score`` or more.

    Exact: the vectors of an entity are packed into blocks by hash and every block
    meets every other, tile by tile, so memory is bounded by two blocks and the work
    is the square of the distinct vectors of an entity, spread over block pairs. What
    may be close in single precision is scored again in double precision. Zero
    vectors are close to nothing, nor are vectors of different lengths.
    """
    keys = ["entity_id", "dims"]
    rows = vectors.filter(F.size("vec") > 0).select("entity_id", "vid", "vec", F.size("vec").alias("dims"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")))
    packed = placed.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("vid", "vec")).alias("rows"))
    packed = cut(packed.select(*keys, "blocks", "block", F.col("rows.vid").alias("vids"), F.flatten("rows.vec").alias("vecs")))
    left = packed.select(*keys, F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), F.col("vecs").alias("left"))
    right = packed.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("x"), F.col("block").alias("y"), F.col("vecs").alias("right"))
    # A broadcast of few large blocks would leave all their pairs to a few tasks.
    met = left.hint("merge").join(right, [*keys, "x", "y"])
    close = met.mapInArrow(_meet(min_score), "entity_id string, dims int, x bigint, y bigint, i bigint, j bigint")
    place = packed.select(*keys, "block", F.posexplode("vids").alias("at", "vid"))
    named = lambda end, b, at: place.select(*keys, F.col("block").alias(b), F.col("at").cast("long").alias(at), F.col("vid").alias(end))
    found = close.join(named("m", "x", "i"), [*keys, "x", "i"]).join(named("n", "y", "j"), [*keys, "y", "j"])
    met = found.select("entity_id", F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"))
    side = lambda v: vectors.select("entity_id", F.col("vid").alias(v), F.col("vec").alias(f"_{v}"))
    both = met.join(side("a"), ["entity_id", "a"]).join(side("b"), ["entity_id", "b"])
    return both.select("entity_id", "a", "b", F.round(X.cosine(F.col("_a"), F.col("_b")), SCORE_DIGITS).alias("score")).filter(F.col("score") >= min_score)
