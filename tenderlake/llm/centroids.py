"""Centroid clustering in exact integers, with nearest centroids found by Orchard's search.

Components become the integers floor(scale * x). The first centroids are the vectors whose ids have the smallest hashes; each
round assigns every vector to its nearest centroid and moves a centroid to the componentwise floor of its vectors' mean.

Orchard's search: each centroid has the list of the others by distance from it. A vector starts at some centroid and walks
its list; whenever it meets a centroid that is nearer (or as near, with a smaller number) it jumps to that one's list. A
centroid met before isn't measured again. It stops where the list's next distance is strictly more than twice its own: by
the triangle inequality nothing further on can be as near. All vectors of a batch walk at once. ``n_measured`` says how
many centroids a vector was measured against.

A round is one pass over the packed vectors, which are written once; what is shuffled is a sum for each centroid and task,
added up in MERGERS tasks at most, and what comes to the driver is MERGERS times the centroids. Centroids are broadcast: k times
dim numbers and k * k places, refused beyond LIMIT bytes.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows and ids
count each; equal hashes are told apart by id and components; null ids are never first centroids but are clustered; with
fewer vectors than k there are as many centroids as vectors with an id (with none, no rows); empty clusters keep their
centroid; integers are exact at any size, as components beyond 2**27 are reckoned as Python integers, and distances that no long holds are given as
the largest long; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, tidy, written

SMALL = 1 << 27  # below it, 64-bit sums of squared differences of many components are exact
LONGEST = (1 << 63) - 1
MERGERS = 32
LIMIT = 256 << 20
WALK = 4096  # vectors that walk at once


def _integers(packed: list[bytes], dim: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), as int64 where all are small, else as Python integers."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    exact = not scale & (scale - 1)  # a product with a power of two is exact
    if exact and dim <= 128 and (np.abs(y) < SMALL).all():
        return y.astype(np.int64)
    out = np.empty(x.shape, object)
    for i, v in np.ndenumerate(x):
        n, d = float(v).as_integer_ratio()
        out[i] = n * scale // d
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows; exact, as Python integers where a component is large."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(1)


class Lists:
    """Centroids with, for each, the others in order of distance (then number)."""

    def __init__(self, centroids: list[list[int]]):
        big = any(abs(x) >= SMALL for c in centroids for x in c) or centroids and len(centroids[0]) > 128
        self.at = np.array(centroids, object if big else np.int64).reshape(len(centroids), -1)
        self.apart = np.array([_squared(self.at, np.broadcast_to(c, self.at.shape)) for c in self.at])
        self.order = np.array([sorted((j for j in range(len(self.at)) if j != i), key=lambda j: (self.apart[i, j], j)) for i in range(len(self.at))], np.int64).reshape(len(self.at), -1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: number of the nearest centroid (ties: the smallest), squared distance, centroids measured."""
        n, k = len(x), len(self.at)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        far = _squared(x, self.at[best])
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        live = np.arange(n)
        while k > 1 and len(live):
            live = live[at[live] < k - 1]
            mine, then = best[live], self.order[best[live], at[live]]
            live, then = (z[np.asarray(self.apart[mine, then] <= 4 * far[live], bool)] for z in (live, then))
            at[live] += 1
            new = ~met[live, then]
            i, c = live[new], then[new]
            if not len(i):
                continue
            met[i, c] = True
            d = _squared(x[i], self.at[c])
            jump = np.asarray((d < far[i]) | ((d == far[i]) & (c < best[i])), bool)
            best[i[jump]], far[i[jump]], at[i[jump]] = c[jump], d[jump], 0
        return best, far, met.sum(1)


def _walks(batches: Iterator[pa.RecordBatch], lists: Lists, dim: int, scale: int) -> Iterator[tuple]:
    """(batch, first row, integers, nearest, squared distance, measured) of at most WALK rows at a time."""
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_pylist()
        for at in range(0, len(keys), WALK):
            x = _integers(keys[at : at + WALK], dim, scale)
            yield batch, at, x, *lists.nearest(x)


_SUMS = "cluster int, n long, inertia string, sums array<string>"


def _add(total: dict, cluster: int, n: int, inertia: int, sums: list) -> None:
    have = total.setdefault(cluster, [0, 0, [0] * len(sums)])
    have[0], have[1], have[2] = have[0] + n, have[1] + inertia, [a + b for a, b in zip(have[2], sums, strict=True)]


def _sums_batch(total: dict) -> pa.RecordBatch:
    rows = [(c, n, str(inertia), [str(x) for x in sums]) for c, (n, inertia, sums) in sorted(total.items())]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "n", "inertia", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for batch in batches:
        for cluster, n, inertia, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _add(total, cluster, n, int(inertia), [int(x) for x in sums])
    yield _sums_batch(total)


def _round(packed: DataFrame, lists, dim: int, scale: int) -> dict:
    """cluster -> [vectors, inertia, sums], by one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for _, _, x, best, far, _ in _walks(batches, lists.value, dim, scale):
            for c in np.unique(best).tolist():
                rows = best == c
                of = far[rows] if far.dtype == object else far[rows].astype(object)
                _add(total, c, int(rows.sum()), int(of.sum()), [int(v) for v in x[rows].sum(0)])
        yield _sums_batch(total)

    # Tasks' sums are added up by at most MERGERS others, of which adaptive execution makes one where they are few.
    sums = packed.select("key").mapInArrow(frugal(run), _SUMS).repartition(F.spark_partition_id() % MERGERS).mapInArrow(_merge, _SUMS)
    total: dict = {}
    for r in sums.collect():
        _add(total, r["cluster"], r["n"], int(r["inertia"]), [int(x) for x in r["sums"]])
    return total


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance, n_measured, cluster_size, cluster_inertia, inertia, centroid (decimal integers, comma-joined) of each vector kept."""
    if 8 * k * (dim + 2 * k) > LIMIT:
        raise ValueError("too many centroids to give to every task")
    small_batches(rows)
    spark = rows.sparkSession

    @F.arrow_udf("binary")
    @frugal
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            of = np.flatnonzero(pc.equal(pc.list_value_length(batch), dim).fill_null(False).to_numpy(zero_copy_only=False))
            x = batch.take(pa.array(of)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            fine = np.isfinite(x).all(1)
            keys = pa.Array.from_buffers(pa.binary(8 * dim), int(fine.sum()), [None, pa.py_buffer(np.ascontiguousarray(x[fine], "<f8"))]).cast(pa.binary())
            at = np.full(len(batch), -1)
            at[of[fine]] = np.arange(len(keys))
            yield keys.take(pa.array(at, mask=at < 0))

    with tidy() as kept:
        packed = written(rows.select(F.col(id).alias("id"), pack(F.col(vector)).alias("key")).where("key IS NOT NULL"), "vectors")
        kept(packed)
        mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        first = packed.where("id IS NOT NULL").orderBy(mark, "id", "key").select("key").limit(k).collect()
        centroids = [[int(v) for v in c] for c in _integers([bytes(r[0]) for r in first], dim, scale)] if first else []
        if not centroids:
            packed = packed.limit(0)
            centroids, rounds = [[0] * dim], 0
        for _ in range(rounds):
            lists = spark.sparkContext.broadcast(Lists(centroids))
            for c, (n, _, sums) in _round(packed, lists, dim, scale).items():
                centroids[c] = [s // n for s in sums]
            lists.unpersist()
        lists = spark.sparkContext.broadcast(Lists(centroids))
        last = _round(packed, lists, dim, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _, best, far, measured in _walks(batches, lists.value, dim, scale):
            ids = batch.column(0).slice(at, len(best))
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array([min(int(d), LONGEST) for d in far], pa.int64()), pa.array(measured, pa.int32())], ["id", "cluster", "distance", "n_measured"])

    kind = rows.schema[id].dataType.simpleString()
    placed = packed.select("id", "key").mapInArrow(frugal(assign), f"id {kind}, cluster int, distance long, n_measured int")
    total = min(sum(v[1] for v in last.values()), LONGEST)
    of = spark.createDataFrame([(c, last[c][0], min(last[c][1], LONGEST), total, ",".join(map(str, v))) for c, v in enumerate(centroids) if c in last], "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid string")
    return placed.join(F.broadcast(of), "cluster").select(F.col("id").alias(id), "cluster", "distance", "n_measured", "cluster_size", "cluster_inertia", "inertia", "centroid")
