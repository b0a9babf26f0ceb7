"""Centroid clustering with the threshold algorithm.

Every dimension keeps the centroids sorted by their component. From a vector's
value the list is walked outward in both directions, one centroid per dimension
and step; each centroid met gets its exact distance. A centroid not met in any
list is at least as far as the sum of the frontier distances, so a vector stops
as soon as that sum strictly exceeds its best exact distance; on equality the
walk goes on, because an unseen centroid of a smaller number might tie.

Components are integers, floor(1024 * x), and all sums are exact: a batch whose
squares might pass 64 bits is computed with Python integers.

Rows: only vectors with exactly ``dims`` components, none null or non-finite,
take part; the others are left out. Repeated rows each count. A null id is an
ordinary row, but no start centroid unless ids run out. Fewer vectors than ``k``
give as many centroids as vectors, an empty table an empty result. A distance or
sum that does not fit a long is null. Other columns of the table are not
returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import settled

SCALE = 1024
#: Components below this keep the squared distance of some 4000 dimensions in 64 bits.
SMALL = 1 << 24
LIMB = 40


def whole_components(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles: int64, or Python integers if one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    # From 2**52 on a double is whole, so it is multiplied as an integer.
    out = [int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in values.ravel().tolist()]
    return np.array(out, dtype=object).reshape(values.shape)


class Lists:
    """Centroids and, per dimension, their order by component."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(x) < SMALL for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=np.int64 if small else object)
        self.order = np.array([sorted(range(len(centroids)), key=lambda c: (centroids[c][d], c)) for d in range(len(centroids[0]))])
        self.sorted = np.take_along_axis(self.centroids.T, self.order, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, squared distance and exact distances computed, per row."""
        count, dims = self.centroids.shape
        centroids, listed = self.centroids, self.sorted
        if object in (rows.dtype, centroids.dtype):
            rows, centroids, listed = rows.astype(object), centroids.astype(object), listed.astype(object)
        n = len(rows)
        every = np.arange(dims)
        best = np.zeros(n, dtype=rows.dtype)
        own = np.full(n, count, dtype=np.int64)  # count: none met yet
        met = np.zeros((n, count), dtype=bool)
        # high: first list place at or above the value, low: the place below it.
        high = np.stack([np.searchsorted(listed[d], rows[:, d]) for d in range(dims)], axis=1) if n else np.zeros((0, dims), dtype=np.int64)
        low = high - 1
        active = np.arange(n)
        while len(active):
            x, lo, hi = rows[active], low[active], high[active]
            below = x - listed[every, np.maximum(lo, 0)]
            above = listed[every, np.minimum(hi, count - 1)] - x
            down = (lo >= 0) & ((hi >= count) | (below <= above))
            place = np.where(down, lo, np.minimum(hi, count - 1))
            fresh = np.zeros((len(active), count), dtype=bool)
            fresh[np.arange(len(active))[:, None], self.order[every, place]] = True
            fresh &= ~met[active]
            met[active] |= fresh
            low[active], high[active] = np.where(down, lo - 1, lo), np.where(down, hi, hi + 1)
            for c in range(count):
                at = active[fresh[:, c]]
                if len(at):
                    gap = rows[at] - centroids[c]
                    d, held = (gap * gap).sum(axis=1), own[at]
                    nearer = (held == count) | (d < best[at]) | ((d == best[at]) & (c < held))
                    best[at[nearer]], own[at[nearer]] = d[nearer], c
            active = active[~met[active].all(axis=1)]
            if len(active):
                x, lo, hi = rows[active], low[active], high[active]
                below = x - listed[every, np.maximum(lo, 0)]
                above = listed[every, np.minimum(hi, count - 1)] - x
                gap = np.where((lo >= 0) & ((hi >= count) | (below <= above)), below, above)
                active = active[~((gap * gap).sum(axis=1) > best[active])]
        return own, best, met.sum(axis=1)


def kept_rows(batch: pa.RecordBatch, name: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their components as integers."""
    column = batch.column(name)
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        raise TypeError(f"{name} must be an array of numbers")
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dims)
    taken = column.take(pa.array(at))
    values = taken.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(values).all(axis=1)
    return at[fine], whole_components(values[fine])


def _batches(df: DataFrame, vec: str, dims: int, fn, schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: (out for b in batches if (out := fn(b, *kept_rows(b, vec, dims))) is not None), schema)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb number, limb) of an integer of any size; the last limb has the sign."""
    n = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield n, value & ((1 << LIMB) - 1)
        value, n = value >> LIMB, n + 1
    yield n, value


def _exact_sums(df: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by (cluster, item) of rows (cluster, item, limb, value); clusters x items rows reach the driver."""
    found: dict[tuple[int, int], int] = {}
    for r in df.groupBy("cluster", "item", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found[r.cluster, r.item] = found.get((r.cluster, r.item), 0) + (int(r.value) << LIMB * r.limb)
    return found


def start_centroids(df: DataFrame, id_col: str, vec: str, k: int, dims: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids hash smallest, in that order."""

    def kept(batch: pa.RecordBatch, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        parts = [[str(x) for x in r] for r in rows.tolist()]
        return pa.record_batch([batch.column("id").take(pa.array(at)), pa.array(parts, type=pa.list_(pa.string()))], names=["id", "parts"])

    rows = _batches(df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).alias("vec")), "vec", dims, kept, "id string, parts array<string>")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256)
    # Equal ids end on their components, so that the choice is one.
    first = rows.orderBy(key.asc_nulls_last(), "parts").limit(k).collect()
    return [[int(x) for x in r.parts] for r in first]


def cluster(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """Vectors with their cluster after ``rounds`` of assignment and update.

    Returns id, cluster, distance (squared, to the final centroid), checked
    (exact distances the walk computed), cluster_inertia, inertia and
    centroid_sha256. Only the k centroids and their sums pass the driver; a
    round is one scan, summed inside each batch and then by Spark.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    centroids = start_centroids(df, id_col, vec, k, dims, seed)
    source = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    wide = df.select(F.col(vec).alias("vec"))
    for _ in range(rounds if centroids else 0):
        lists = spark.sparkContext.broadcast(Lists(centroids))

        def sums(_batch: pa.RecordBatch, _at: np.ndarray, rows: np.ndarray, lists=lists) -> pa.RecordBatch | None:
            own, _, _ = lists.value.nearest(rows)
            out = []
            for c in np.unique(own).tolist():
                mine = rows[own == c]
                totals = [len(mine), *mine.sum(axis=0).tolist()]
                out += [(c, item, n, limb) for item, total in enumerate(totals) for n, limb in _limbs(int(total))]
            return pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["cluster", "item", "limb", "value"]) if out else None

        found = _exact_sums(_batches(wide, "vec", dims, sums, "cluster long, item long, limb long, value long"))
        # Item 0 is the number of vectors; an empty cluster keeps its centroid.
        centroids = [[found[c, 1 + d] // found[c, 0] for d in range(dims)] if (c, 0) in found else centroids[c] for c in range(len(centroids))]
        lists.unpersist()

    last = spark.sparkContext.broadcast(Lists(centroids or [[0] * dims]))

    def assign(batch: pa.RecordBatch, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        own, best, checked = last.value.nearest(rows)
        exact = [int(d) for d in best.tolist()]
        limbs = [[x for _, x in _limbs(d)] for d in exact]
        fits = [d if d < 1 << 63 else None for d in exact]
        return pa.record_batch([batch.column("id").take(pa.array(at)), pa.array(own.astype(np.int32)), pa.array(fits, type=pa.int64()), pa.array(checked.astype(np.int32)), pa.array(limbs, type=pa.list_(pa.int64()))], names=["id", "cluster", "distance", "checked", "limbs"])

    placed = settled(_batches(source, "vec", dims, assign, f"id {kind.simpleString()}, cluster int, distance long, checked int, limbs array<long>"))
    limbs = placed.select("cluster", F.lit(0).alias("item"), F.posexplode("limbs").alias("limb", "value"))
    own_sums = _exact_sums(limbs)
    total = sum(own_sums.values())
    rows = [
        (c, (s if s < 1 << 63 else None), (total if total < 1 << 63 else None), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (c, _), s in own_sums.items()
    ]
    report = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(report), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "checked", "cluster_inertia", "inertia", "centroid_sha256")
