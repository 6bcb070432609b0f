"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine c are at distance sqrt(2 - 2c) = epsilon, and a projection on orthonormal axes only shortens it. So
vectors are sorted by their grid cells (width epsilon) on the leading principal dimensions, within their label. The sorted
sequence is cut into blocks; intervals of 16 blocks, of 16 such intervals and so on form a tree whose nodes know the box
of their projections. The join descends from pairs of whole sequences to pairs of blocks, a Spark join a level, and
drops a pair of intervals as soon as their boxes are more than epsilon apart. Surviving block pairs are compared exactly, in
tiles of 8 by 8 blocks, so that a block's vectors travel once a tile and not once a pair.

A pair of blocks hands on a count and a root for each linked vector, not its pairs. Equal vectors (up to a power of two) are
folded into one node before the join and count as links of each other. Edge cases: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null label or id, link with nothing (n_links 0, own component, kept); vectors of
unequal length never link; repeated rows count as vectors of their own, and so do
different vectors of one id, each with its own links; an empty table gives an empty result; columns
n_links, component_id and kept of the input are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, frugal, small_batches, tidy, written
from .components import connected

AXES = 6
BLOCK = 512
FANOUT_BITS = 4
TILE_BITS = 3  # blocks of 8 meet blocks of 8 in a task
SAMPLE, SAMPLE_BYTES, LENGTHS = 4096, 32 << 20, 16  # what axes are fitted on


def _vectors(key: bytes) -> np.ndarray:
    return np.frombuffer(key, "<f8")


def _packed(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """rows with the vector's components as packed doubles, null where it can't link. Vectors are scaled by a power of two, so
    that squares of tiny and huge components are no zeros and no infinities; cosines stay the same."""

    @F.arrow_udf("binary")
    @frugal
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                v = None if x is None or None in x else np.array(x, "<f8")
                out.append(np.ldexp(v, -np.frexp(np.abs(v).max())[1]).astype("<f8").tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.array(out, pa.binary())

    return rows.withColumn(key, pack(F.col(vector)))


def _axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal dimensions of the unit vectors of each of the LENGTHS most frequent lengths, fitted on a sample
    of at most SAMPLE vectors and SAMPLE_BYTES of each, those with the smallest hashes. Other lengths use their first
    coordinates. The axes decide how many blocks are compared, never what links."""
    lengths = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    out = {}
    for d, _ in lengths:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
        keys = distinct.where(F.col("dim") == d).select("key").orderBy(F.xxhash64("key"), "key").limit(most).toArrow().column(0).to_pylist()
        m = np.array([_vectors(k) for k in keys])
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        out[d] = np.linalg.svd(m - m.mean(0), full_matrices=False)[2][:AXES].T
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK rows of one label and length, in grid order: part and seq (their place), label, dim, lo, hi, ids, counts, vectors."""
    from pyspark import TaskContext

    part, seq, have = TaskContext.get().partitionId(), 0, []
    names = ["part", "seq", "label", "dim", "lo", "hi", "ids", "counts", "vectors"]

    def block():
        p = np.array([x[3] for x in have])
        return [part, seq, have[0][0], have[0][1], p.min(0).tolist(), p.max(0).tolist(), np.array([x[2] for x in have], "<i8").tobytes(), np.array([x[5] for x in have], "<i8").tobytes(), b"".join(x[4] for x in have)]

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("label", "dim", "id", "at", "key", "n")), strict=True):
            if have and (len(have) == BLOCK or have[0][:2] != row[:2]):
                yield batch_of([block()])
                seq, have = seq + 1, []
            have.append(row)
    if have:
        yield batch_of([block()])


def _near(a: str, b: str, eps: float):
    """Whether two boxes may hold points within eps: the squared gaps on the axes add up to eps squared at most."""
    gap = lambda i: F.greatest(F.lit(0.0), F.get(F.col(f"{a}_lo"), i) - F.get(F.col(f"{b}_hi"), i), F.get(F.col(f"{b}_lo"), i) - F.get(F.col(f"{a}_hi"), i))
    total = F.lit(0.0)
    for i in range(AXES):
        total = total + F.coalesce(F.pow(gap(F.lit(i)), 2), F.lit(0.0))
    return total <= eps * eps


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """label, dim, a, b (a <= b): block pairs that the descent leaves."""
    boxes = blocks.select("label", "dim", "idx", "lo", "hi")
    top = boxes.agg(F.max("idx")).first()[0] or 0
    levels = max(1, -(-int(top).bit_length() // FANOUT_BITS))

    def nodes(level: int, side: str) -> DataFrame:
        at = F.shiftright("idx", FANOUT_BITS * level)
        lo = F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(AXES)])
        hi = F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(AXES)])
        of = boxes.groupBy("label", "dim", at.alias(side)).agg(lo.alias(f"{side}_lo"), hi.alias(f"{side}_hi"))
        return of.withColumn(f"{side}_up", F.shiftright(side, FANOUT_BITS))

    pairs = boxes.groupBy("label", "dim").agg(F.lit(0).cast("long").alias("a_up"), F.lit(0).cast("long").alias("b_up"))
    for level in range(levels - 1, -1, -1):
        both = pairs.join(nodes(level, "a"), ["label", "dim", "a_up"]).join(nodes(level, "b"), ["label", "dim", "b_up"])
        pairs = written(both.where((F.col("a") <= F.col("b")) & _near("a", "b", eps)).select("label", "dim", F.col("a").alias("a_up"), F.col("b").alias("b_up")), "pairs")
    return pairs.select("label", "dim", F.col("a_up").alias("a"), F.col("b_up").alias("b"))


def _compare(cosine: float, eps: float):
    """Exact comparison of the blocks of each tile (label, dim, ta, tb): a block of ta with one of tb, where their boxes are
    near. A tile holds 2 ** TILE_BITS blocks of each side at most."""

    def near(a: dict, b: dict) -> bool:
        gap = np.maximum(0, np.maximum(a["lo"] - b["hi"], b["lo"] - a["hi"]))
        return (gap * gap).sum() <= eps * eps

    def links(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        same = a["idx"] == b["idx"]
        (ia, ca, x), (ib, cb, y) = ((s["ids"], s["counts"], s["vectors"]) for s in (a, b))
        link = (x @ y.T) / np.outer(a["norms"], b["norms"]) >= cosine
        if same:
            np.fill_diagonal(link, False)
        if not link.any():
            return
        big = np.iinfo(np.int64).max
        ra, rb = ia.copy(), ib.copy()
        while True:  # smallest id reachable inside the pair of blocks
            na = np.minimum(ra, np.where(link, rb[None, :], big).min(1))
            nb = np.minimum(rb, np.where(link, na[:, None], big).min(0))
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        sides = [(ia, link @ cb, ra)] if same else [(ia, link @ cb, ra), (ib, ca @ link, rb)]
        for ids, n, root in sides:
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], ["id", "n", "root"])

    def tile(key: tuple, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        _, _, ta, tb = key
        for a in blocks:
            for b in blocks:
                if a["idx"] >> TILE_BITS == ta and b["idx"] >> TILE_BITS == tb and a["idx"] <= b["idx"] and near(a, b):
                    yield from links(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blocks = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                key = tuple(row[n] for n in ("label", "dim", "ta", "tb"))
                if key != last:
                    if blocks:
                        yield from tile(last, blocks)
                    last, blocks = key, []
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                blocks.append({"idx": row["idx"], "lo": np.array(row["lo"]), "hi": np.array(row["hi"]), "ids": np.frombuffer(row["ids"], "<i8"), "counts": np.frombuffer(row["counts"], "<i8"), "vectors": vectors, "norms": np.sqrt((vectors * vectors).sum(1))})
        if blocks:
            yield from tile(last, blocks)

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """blocks with idx: their number in the whole sequence. What comes to the driver is a count for each partition."""
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.max("seq") + 1).collect())
    rows, base = [], 0
    for part, n in sizes:
        rows.append((part, base))
        base += n
    bases = blocks.sparkSession.createDataFrame(rows, "part long, base long")
    return blocks.join(bases, "part").withColumn("idx", F.col("base") + F.col("seq")).drop("part", "seq", "base")


def link_vectors(rows: DataFrame, cosine: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """rows with n_links, component_id and kept; only vectors of equal labels are compared."""
    rows = small_batches(rows).drop(*[c for c in rows.columns if c.lower() in ("n_links", "component_id", "kept")])
    key, rep, lab = (free_name(rows, c) for c in ("key", "rep", "lab"))
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    with tidy() as kept:
        packed = written(_packed(rows, vector, key).withColumn(lab, F.col(label).cast("string")), "vectors")
        usable = F.col(key).isNotNull() & F.col(lab).isNotNull() & F.col(id).isNotNull()
        distinct = packed.where(usable).groupBy(F.col(lab).alias("label"), F.col(key).alias("key")).agg(F.min(F.col(id).cast("long")).alias("id"), F.count(F.lit(1)).alias("n"))
        distinct = written(distinct.withColumns({"dim": (F.octet_length("key") / 8).cast("long"), "node": F.monotonically_increasing_id()}), "distinct")
        axes = rows.sparkSession.sparkContext.broadcast(_axes(distinct))

        @F.arrow_udf("array<double>")
        @frugal
        def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                out = []
                for k in batch.to_pylist():
                    v = _vectors(k)
                    along = v @ axes.value[len(v)] if len(v) in axes.value else v[:AXES]
                    p = np.zeros(AXES)
                    p[: len(along)] = along / np.sqrt(v @ v)
                    out.append(p.tolist())
                yield pa.array(out, pa.list_(pa.float64()))

        placed = distinct.withColumn("at", project("key"))
        cells = [f"cell{i}" for i in range(AXES)]
        placed = placed.withColumns({c: F.floor(F.get("at", F.lit(i)) / eps) for i, c in enumerate(cells)})
        order = ["label", "dim", *cells, "node"]
        ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "dim", F.col("node").alias("id"), "at", "key", "n")
        blocks = written(ordered.mapInArrow(frugal(_blocks), "part long, seq long, label string, dim long, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary"), "blocks")
        blocks = _numbered(blocks)
        tile = ["label", "dim", "ta", "tb"]
        pairs = _pairs(blocks, eps).select("label", "dim", F.shiftright("a", TILE_BITS).alias("ta"), F.shiftright("b", TILE_BITS).alias("tb"), F.explode(F.array("a", "b")).alias("idx")).distinct()
        # A block goes to a tile once, however many blocks it meets there.
        both = pairs.join(blocks, ["label", "dim", "idx"]).repartition(*tile).sortWithinPartitions(*tile, "idx")
        found = written(both.mapInArrow(frugal(_compare(cosine, eps)), "id long, n long, root long"), "found")
        kept(packed, distinct, found)
        counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n_others"))
        comps = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        ids = comps.join(distinct.select("node", "id"), "node")
        least = written(ids.groupBy("component").agg(F.min("id").alias("component_id")), "least")
        comps = written(comps.join(least, "component").select("node", "component_id"), "components")
        kept(comps)
        classes = distinct.select(F.col("label").alias(lab), F.col("key").alias(key), "node", "id", "n").join(counts, "node", "left").join(comps, "node", "left")
        classes = classes.select(lab, key, (F.coalesce("n_others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        own = F.when(usable, F.col("component_id")).otherwise(F.col(id).cast("long"))
        out = packed.join(classes, [lab, key], "left").withColumn("n_links", F.when(usable, F.col("n_links")).otherwise(0).cast("long")).withColumn("component_id", own)
        return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))).select(*rows.columns, "n_links", "component_id", "kept")
