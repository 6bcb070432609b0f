"""Near-duplicate documents by MinHash bands, odd sketches and a check on full shingle sets.

1. Each text becomes its set of word shingles, a MinHash signature in bands, and an odd sketch: every MinHash sample flips
   one bit of a bitmap, so the bits in which two bitmaps differ count the samples that differ, which estimates high
   similarities closely. Texts of equal sets are folded into one first.
2. Within a band's bucket every document is paired with the smallest one only. Pairs whose sketches are clearly below the
   threshold go; the others are checked on full sets. Confirmed links form components.
3. Buckets whose members are now in one component are done. In the others, blocks of sketches are compared across
   components (a run of blocks, never a bucket in one task), which leaves clusters of documents that may still be linked.
   Clusters are then checked block by block on full sets, best estimates first; pairs that have become connected by then
   are skipped. Texts go only to the blocks in which sketches say that they may have a partner. So a group of any size costs about one check a document, and no link between different texts is lost,
   but for those that no band brings together: (1 - s**ROWS)**BANDS, 7e-10 at a similarity s of 0.8.

Edge cases: texts without words (null, empty, blank) have no shingles and link with nothing; a text with fewer words than
a shingle has one shingle, its whole sequence; texts are taken whole; equal rows are duplicates of each other, and rows of
the same id count as linked, whatever their texts; rows with a null id link with nothing (component null, kept); an empty table gives an empty
result; columns n_shingles, component_id and kept of the input are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, tidy, written
from .components import connected

BANDS, ROWS = 40, 4
SKETCH_BITS = 512
MARGIN = 0.2  # estimates lower than the threshold by this (some five standard deviations: one linked pair in 10**7 or fewer, were it not found by another) are dismissed
BLOCK = 512  # members of a bucket or cluster in one block
_FILTER_BITS = 26

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, each computed once until the table is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(best, (shingles[k : k + 512, None] * _A + _B).min(0), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    at = _mix(sig + np.arange(len(sig), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Bits in which two sketches may differ for an estimate of at least similarity - MARGIN."""
    least = max(0.0, similarity - MARGIN)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - least) / SKETCH_BITS))))


def _sketched(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, same, band, sketch = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t, width)
                    sig = signature(s)
                    n.append(len(s))
                    same.append(xxhash.xxh3_128_digest(s.tobytes()))
                    band.append(bands(sig))
                    sketch.append(odd_sketch(sig))
                lists = lambda rows, w: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows)), w).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists(band, BANDS), lists(sketch, SKETCH_BITS // 64)], ["id", "n", "same", "bands", "sketch"])

    return docs.select(F.col(id).cast("long").alias("id"), text).mapInArrow(frugal(run), "id long, n long, same binary, bands array<long>, sketch array<long>")


def _differing(a: str, b: str):
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return total


def _needed(docs: DataFrame, id: str, ids: DataFrame) -> DataFrame:
    """docs that may be among ids, told by a bitmap of 2**26 hashed bits: it only spares later joins rows they'd drop.
    The bitmap has a fixed size (8 MB) whatever the number of ids."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))
    words = ids.select(at.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    @frugal
    def maybe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for place in batches:
            p = place.to_numpy(zero_copy_only=False)
            yield pa.array((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    own = docs.select(F.col(id).cast("long").alias("id"), F.col("text")).where("id is not null")
    # Beyond some 10**8 ids the bitmap lets most rows through, and the joins drop them.
    return own.where(maybe(F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets. The smaller id's text comes once for each of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                b = batch.column("b")[k].as_py()
                if b != last:
                    last, held = b, shingle_set(batch.column("text_b")[k].as_py(), width)
                keep.append(similar(held, shingle_set(batch.column("text_a")[k].as_py(), width), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(frugal(run), "a long, b long")


def _chunked(members: DataFrame, group: str) -> DataFrame:
    """members once for each pair of blocks of their group that holds their block: columns i <= j and own."""
    sizes = written(members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    rows = members.join(sizes, group).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _across(members: DataFrame) -> DataFrame:
    """members (key, id, comp, ...) of buckets with several components, once for each pair of blocks in which they meet
    others. Members of the bucket's smallest component, most of a large group as a rule, meet only the rest, which
    meets itself too; so a large component isn't copied for pairs of its own."""
    # What is told of buckets is written first: joins of two tables can be split where very many rows are in one bucket.
    low = written(members.groupBy("key").agg(F.min("comp").alias("low")), "lows")
    rows = members.join(low, "key").withColumn("main", F.col("comp") == F.col("low")).drop("low")
    sizes = rows.groupBy("key").agg(F.ceil(F.count_if("main") / BLOCK).cast("int").alias("mains"), F.ceil(F.count_if(~F.col("main")) / BLOCK).cast("int").alias("rests"))
    rows = rows.join(written(sizes, "sizes"), "key")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("main"), place(F.col("mains"))).otherwise(F.col("mains") + place(F.col("rests"))))
    first = F.when(F.col("main"), F.col("mains")).otherwise(0)
    rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("rests") - 1)))
    return rows.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], pick: list[str]) -> Iterator[dict[str, list]]:
    """Groups of rows that follow each other with equal values in names."""
    key, have = None, {n: [] for n in pick}
    for batch in batches:
        columns = batch.to_pydict()
        for k, at in enumerate(zip(*(columns[n] for n in names), strict=True)):
            if at != key:
                if have[pick[0]]:
                    yield have
                key, have = at, {n: [] for n in pick}
            for n in pick:
                have[n].append(columns[n][k])
    if have[pick[0]]:
        yield have


def _estimates(sketch: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketch), len(sketch)), np.int16)
    for w in range(sketch.shape[1]):
        out += np.bitwise_count(sketch[:, None, w] ^ sketch[None, :, w])
    return out


def _cluster(most: int):
    """Inside a block pair: components with documents whose sketches may be similar, each with the smallest one that it
    reaches so: a row a component, however many documents it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _runs(batches, ["key", "i", "j"], ["id", "comp", "sketch", "own", "i", "j"]):
            comp, of = np.unique(np.array(rows["comp"]), return_inverse=True)
            if len(comp) < 2:
                continue
            own = np.array(rows["own"])
            may = (_estimates(np.array(rows["sketch"]).view(np.uint64)) <= most) & (of[:, None] != of[None, :])
            if rows["i"][0] != rows["j"][0]:
                may &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(may, 1))
            pairs = np.unique(np.stack([np.minimum(of[a], of[b]), np.maximum(of[a], of[b])]), axis=1)
            root = np.arange(len(comp))
            for x, y in pairs.T.tolist():
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            for x in np.flatnonzero(root != np.arange(len(comp))).tolist():
                out.append((int(comp[x]), int(comp[root[x]])))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])

    return run


def _may_link(most: int):
    """Inside a block pair of a cluster: the documents that have a partner of another component by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "comp", "sketch", "i", "j", "own"]
        for rows in _runs(batches, ["key", "i", "j"], names):
            own, comp = np.array(rows["own"]), np.array(rows["comp"])
            may = (_estimates(np.array(rows["sketch"]).view(np.uint64)) <= most) & (comp[:, None] != comp[None, :])
            if rows["i"][0] != rows["j"][0]:
                may &= own[:, None] != own[None, :]
            some = np.flatnonzero(may.any(1)).tolist()
            if some:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([rows[n][k] for k in some], kind) for n, kind in zip(names, kinds, strict=True)], names)

    return run


def _settle(width: int, percent: int, most: int):
    """Inside a block pair of a cluster: links on full sets across components, best estimates first, until all that can
    be connected is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["key", "i", "j"], ["id", "comp", "sketch", "own", "i", "j", "text"]):
            id, own, comp = np.array(rows["id"]), np.array(rows["own"]), rows["comp"]
            differ = _estimates(np.array(rows["sketch"]).view(np.uint64))
            a, b = np.nonzero(np.triu(differ <= most, 1))
            if rows["i"][0] != rows["j"][0]:
                a, b = a[own[a] != own[b]], b[own[a] != own[b]]
            order = np.argsort(differ[a, b], kind="stable")
            sets: dict[int, np.ndarray] = {}
            parent = {c: c for c in comp}

            def top(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            links = []
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                p, q = top(comp[x]), top(comp[y])
                if p == q:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingle_set(rows["text"][k], width)
                if similar(sets[x], sets[y], percent):
                    parent[max(p, q)] = min(p, q)
                    links.append((int(id[x]), int(id[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    return run


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """Classes of rows with equal sets: same, rep (smallest id) and node, which is rep, or for all but one class of a rep a
    hash that is larger than any id; links between nodes of rows that share an id (None: there are none); whether ids repeat."""
    classes = rows.groupBy("same").agg(F.min("id").alias("rep"))
    lead = classes.groupBy("rep").agg(F.min("same").alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = written(lead.where("n > 1").select(F.col("rep").alias("clash"), "lead"), "clashes")
    if lead.isEmpty():
        classes = classes.withColumn("node", F.col("rep"))
    else:
        hashed = F.shiftright(F.xxhash64("same"), 2).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        classes = classes.join(lead, classes["rep"] == lead["clash"], "left").withColumn("node", F.when(F.col("lead") != F.col("same"), hashed).otherwise(F.col("rep"))).select("same", "rep", "node")
    classes = written(classes, "classes")
    twice = rows.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.count(F.lit(1)).alias("n"))
    twice = written(twice.where("n > 1").select("id", F.expr("lo <> hi").alias("differ")), "repeated-ids")
    several = twice.where("differ").select("id")
    if several.isEmpty():
        return classes, None, not twice.isEmpty()
    of = written(rows.join(several, "id").select("id", "same").distinct().join(classes.select("same", "node"), "same").select("id", "node"), "nodes-of-ids")
    return classes, of.join(of.groupBy("id").agg(F.min("node").alias("b")), "id").where("node <> b").select(F.col("node").alias("a"), "b"), True


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc id, n_shingles, component_id, kept: one row per row of docs."""
    with tidy() as kept:
        most = most_differing_bits(percent / 100)
        rows = written(_sketched(small_batches(docs), id, text, width), "sketched")
        usable = rows.where("n > 0 and id is not null")
        classes, shared, repeated = _nodes(usable.select("id", "same"))
        once = lambda texts: texts.dropDuplicates(["id"]) if repeated else texts
        # Both sides of this join and of the last are tables, so that Spark can split a set that very many rows have.
        reps = usable.join(classes.select("same", F.col("rep").alias("id"), "node"), ["same", "id"]).select("node", "sketch", "bands", "same", "id")
        reps = written(reps.dropDuplicates(["node"]).select(F.col("node").alias("id"), "sketch", "bands", "same", F.col("id").alias("rep")), "representatives")
        texts_all = _texts(docs, id, text, width, reps) if shared is not None else docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
        placed = reps.select("id", F.explode("bands").alias("key"))
        leads = placed.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "lead")
        members = written(placed.join(written(leads, "leads"), "key"), "members")
        sketches = reps.select("id", "sketch")
        pairs = members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
        pairs = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        pairs = written(pairs.where(_differing("sketch_a", "sketch_b") <= most).select("a", "b"), "pairs")
        texts = once(_needed(texts_all, "id", pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
        links = written(_confirm(pairs, texts, width, percent), "confirmed")
        links = links if shared is None else links.unionByName(shared)
        comps = connected(links)

        joined = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        mixed = joined.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        open_ = written(joined.join(written(mixed, "mixed"), "key", "left_semi"), "open")
        group = ["key", "i", "j"]
        spread = lambda df: df.repartition(*group).sortWithinPartitions(*group)
        blocks = spread(_across(open_.join(sketches, "id")))
        clusters = connected(blocks.mapInArrow(frugal(_cluster(most)), "a long, b long"))
        unsettled = open_.select("id", "comp").distinct().join(clusters.select(F.col("node").alias("comp"), F.col("component").alias("key")), "comp")
        unsettled = written(unsettled.select("key", "id", "comp").join(sketches, "id").select("key", "id", "comp", "sketch"), "unsettled")
        open_pairs = spread(_chunked(unsettled, "key")).mapInArrow(frugal(_may_link(most)), "key long, id long, comp long, sketch array<long>, i int, j int, own int")
        open_pairs = written(open_pairs, "open-pairs")
        texts = once(_needed(texts_all, "id", open_pairs.select("id")))
        more = written(spread(open_pairs.join(texts, "id")).mapInArrow(frugal(_settle(width, percent, most)), "a long, b long"), "settled")
        final = connected(links.unionByName(more)) if not more.isEmpty() else comps

        of_class = classes.join(final, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
        of_class = written(of_class, "components-of-classes")
        kept(rows, of_class)
        out = rows.select("id", "n", "same").where("n > 0 and id is not null").join(of_class, "same", "left").select("id", "n", "component")
        out = out.unionByName(rows.where("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component")))
        return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _texts(docs: DataFrame, id: str, text: str, width: int, reps: DataFrame) -> DataFrame:
    """id (a representative's node) and text, where ids don't tell texts apart."""
    import xxhash

    @F.arrow_udf("binary")
    @frugal
    def set_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([xxhash.xxh3_128_digest(shingle_set(t, width).tobytes()) for t in batch.to_pylist()], pa.binary())

    own = docs.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("text")).withColumn("same", set_of("text"))
    return own.join(reps.select("same", "rep", "id"), ["same", "rep"]).select("id", "text")
