"""Token ids as Parquet files that can be read selectively.

``write`` encodes texts and writes ``<path>/ids`` in ascending order of the id column, one file a range of it: the other
columns, file (number of the file in the order), at and until (ids before and after the document in its file), n_tokens, and ids.
Ids are dictionary-encoded (a vocabulary needs a few bytes of dictionary and 16 bits an id or less), sorted ids of documents
and the running at are delta-encoded (dictionaries off, data pages of version 2), row groups and pages have set sizes, and
the page index that the writer adds lets a reader skip pages within a row group. ``<path>/files`` says for each file how
many ids the files before it hold; so a document's place in the stream of all ids is known without reading an id, and no
document waits for those before it while it is written.

Reading: ``documents`` gives places and lengths from metadata columns alone, and ids where they are asked for; ``window``
gives the ids of a range of the stream, and reads the files, row groups and pages that the range touches.

Edge cases: null text counts as empty (the end id alone); null ids come first; equal ids are ordered by a hash of the text
and the text, repeated rows follow each other and may lie in several files; texts of any length are taken whole, a document's ids are one
row; an empty table gives files without rows; extra columns stay, those named like the format's own are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, frugal, small_batches
from .packing import CACHED, encode_texts, tokenizer_path

OWN = ("file", "at", "until", "n_tokens", "ids")
MOST_FILES = 1 << 20  # the table of files is broadcast up to here: 24 bytes a file
ROW_GROUP = 32 << 20
PAGE = 256 << 10
PAGE_ROWS = 2000


def write(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 2, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS, cached: int = CACHED) -> None:
    """Encode the texts of docs, append end_id to each, and write them to path, which must not exist yet."""
    tokenizer = tokenizer or tokenizer_path()
    keep = [f for f in docs.schema if f.name != text and f.name.lower() not in OWN]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("file", T.LongType()), T.StructField("at", T.LongType()), T.StructField("until", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.int32)
        for batch in batches:
            have, first, total = [], 0, 0

            def flush(stop):
                sizes = np.array([len(x) + 1 for x in have], np.int64)
                flat = np.concatenate([x for ids in have for x in (ids, end)])
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
                until = at + np.cumsum(sizes)
                own = [pa.array(np.full(len(have), file)), pa.array(until - sizes), pa.array(until), pa.array(sizes), ids]
                return pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, stop - first) for i in range(len(names))), *own], [*names, *OWN])

            for i, ids in enumerate(encode_texts(tokenizer, [x or "" for x in batch.column(len(names)).to_pylist()], cached), 1):
                have.append(ids)
                total += len(ids) + 1
                if total > 1_000_000:
                    yield flush(i)
                    have, first, at, total = [], i, at + total, 0
            if have:
                yield flush(batch.num_rows)
                at += total

    tie, salt = free_name(docs, "tie"), free_name(docs, "salt")
    # Equal rows may be many: their number in the scan deals them out too. The order among them makes no difference.
    rows = small_batches(docs).select(*names, text).withColumns({tie: F.xxhash64(text), salt: F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(id, tie, salt).sortWithinPartitions(id, tie, text, salt).select(*names, text)
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows,
        "parquet.page.size.row.check.min": 8,  # sizes are looked at after so many rows first, as texts may be long
        "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, **{f"parquet.enable.dictionary#{c}": "false" for c in (*OWN[:-1], id)},
    }
    rows.mapInArrow(frugal(run), schema).write.options(**options).parquet(f"{path}/ids")
    # One row a file: the sums before it are told from metadata columns alone.
    files = docs.sparkSession.read.parquet(f"{path}/ids").groupBy("file").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/files")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 of lists of ids as little-endian unsigned 32-bit integers."""
    values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The table of files, broadcast where it is small enough: a join by shuffle would move ids."""
    files = spark.read.parquet(f"{path}/files")
    return F.broadcast(files) if files.count() <= MOST_FILES else files


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of path: their columns, start (ids of all documents before), n_tokens, ids, file and at. Columns that nobody asks for are
    not read, and conditions on the id column go down to row groups and pages."""
    rows = spark.read.parquet(f"{path}/ids")
    start = free_name(rows, "start")
    return rows.join(_files(spark, path).select("file", F.col("start").alias("before")), "file").select(*rows.columns, (F.col("before") + F.col("at")).alias(start))


def window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The documents that hold ids of the stream's range [start, stop), each with the ids that lie in it (ids) and their
    place (start, under a free name). Conditions on file, at and until, which all ascend, choose the row groups and pages that are read."""
    files = _files(spark, path)
    some = files.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).agg(F.min("file"), F.max("file"), F.min("start"), F.max("start")).first()
    lo, hi, first, last = (-1, -1, 0, 0) if some[0] is None else some
    rows = spark.read.parquet(f"{path}/ids").where(F.col("file").between(lo, hi))
    rows = rows.where(((F.col("file") != lo) | (F.col("until") > start - first)) & ((F.col("file") != hi) | (F.col("at") < stop - last)))
    rows = rows.join(files.select("file", F.col("start").alias("before")), "file")
    place = F.col("before") + F.col("at")
    skip = F.greatest(F.lit(start) - place, F.lit(0))
    upto = F.least(F.lit(stop) - place, F.col("n_tokens"))
    part = F.slice("ids", (skip + 1).cast("int"), F.greatest(upto - skip, F.lit(0)).cast("int"))
    keep = [c for c in rows.columns if c not in (*OWN, "before")]
    return rows.where(upto > skip).select(*keep, (place + skip).alias(free_name(rows, "start")), part.alias("ids"))
