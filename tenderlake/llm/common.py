"""Small helpers shared by the operators: the shared folder and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 8 << 20  # bytes of an Arrow batch that goes to a Python worker


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a local session gets a temporary one;
    on a cluster, whose executors would each write to a disk of their own, it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tenderlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches hold BATCH bytes at most from now on: ten thousand long texts in one batch, or
    64 MB of them, would be held several times over in each Python worker and in Spark's buffers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, "64m").lower()
    size = re.fullmatch(r"(-?\d+)([kmg]?)b?", now)
    if not size or int(size[1]) <= 0 or int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df


def frugal(run: Callable) -> Callable:
    """run, an iterator of Arrow batches or arrays in a Python worker, after which the worker gives freed memory back: idle
    workers stay alive beside the next stage's, and allocators keep what they once had."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].append(out)
    return out


_scopes = threading.local()


@contextlib.contextmanager
def tidy() -> Iterator[Callable[..., None]]:
    """A scope at whose end the tables made by written() are deleted, but for those given to what it yields: what a result
    still reads. These pass on to the scope around it, if there is one."""
    scopes = _scopes.__dict__.setdefault("open", [])
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    scopes.append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        scopes.pop()
        forget(*[df for df in made if not any(df is k for k in kept)])
        if scopes:
            scopes[-1].extend(kept)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores in front, so that no column of df is hidden."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it, even where the optimizer copies expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
