"""Folders and tables that all executors of a session share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tenderlake-")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written and read again, where a flow reads it several times: it is worked out once, and plans stay short."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` has given, when nothing reads them any more."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(session.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def shuffles_dropped(*sessions: SparkSession) -> Iterator[None]:
    """Within this, the files of a shuffle go when the write that made it has ended, and not when the driver happens to collect
    its garbage. For flows of many writes, none of which goes on with a frame that another has worked out."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = [(s, s.conf.get(name)) for s in sessions]
    for s in sessions:
        s.conf.set(name, "true")
    try:
        yield
    finally:
        for s, x in reversed(was):
            s.conf.set(name, x)
