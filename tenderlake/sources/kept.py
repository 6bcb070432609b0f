"""Tables at rest that change by key while they are read: rows in buckets, versions told by small files.

A table is a folder with data/<change>/new and old, each with _bucket=<n> (Parquet), and versions/<number>, JSON texts that
say which folders hold each bucket: one or two. A change writes its rows in buckets, once; of the buckets that its keys fall in
it reads the old rows and writes those that stay beside them, in a folder of its own; and then publishes a version by creating a
file that must not exist yet. So a reader sees the table as before a change or as after it, a change
that fails half way leaves files that nobody reads, and of two changes at a time the second is refused. A version knows the
stream's batch that made it: a batch that comes again changes nothing. Buckets that a change doesn't touch are neither read
nor written, and a reader that knows its keys reads their buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class KeptTable:
    """The table at path; a change replaces the rows that have one of its keys, and a row's bucket follows from the columns
    ``by``, which are some of the keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), list(keys), list(by or keys), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not set(self.by) <= set(self.keys):
            raise ValueError("a bucket must follow from the keys")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self, number: int | None = None) -> dict:
        """A version, the newest by default: number, batch (of the stream that made it), buckets (number to folders)."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "batch": None, "buckets": {}}
        said = json.loads(self.spark.read.text(f"{self.path}/versions/{numbers[-1] if number is None else number}", wholetext=True).first()[0])
        # A version of a table from before buckets had two folders names one.
        return said | {"buckets": {b: [f] if isinstance(f, str) else f for b, f in said["buckets"].items()}}

    def _publish(self, version: dict) -> None:
        fs, p = self._fs(f"{self.path}/versions/{version['number']}")
        out = fs.create(p, False)  # refused if another change was faster
        out.write(bytearray(json.dumps(version).encode()))
        out.close()

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.hash(*self.by), F.lit(self.buckets)))

    def _buckets(self, df: DataFrame) -> list[int]:
        """The buckets of df's keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in self._bucketed(df).select(BUCKET).distinct().collect())

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, rows: DataFrame, folder: str) -> dict[str, str]:
        """Write rows in buckets, and say which folder holds which."""
        self._bucketed(rows).hint("rebalance", BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if "=" in n}

    def read(self, touched: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The table, or, with touched (a frame that has the columns ``by``), its rows for touched's keys, out of their buckets alone."""
        have = self.version(version)["buckets"]
        if touched is None:
            return self._load([f for own in have.values() for f in own])
        some = self._load([f for b in self._buckets(touched) for f in have.get(str(b), [])])
        return some.join(touched.select(*self.by).distinct(), self.by, "left_semi")

    def replace(self, new: DataFrame, batch: int | None = None, gone: DataFrame | None = None) -> bool:
        """Put new in place of the rows with its keys, or with keys of gone; false if batch has been put in before."""
        now = self.version()
        if batch is not None and now["batch"] is not None and now["batch"] >= batch:
            return False
        change = f"data/{uuid.uuid4().hex}"
        # What comes in is written once, and read for its keys alone.
        put = self._write(new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]), f"{change}/new")
        keys = self._load(list(put.values())).select(*self.keys)
        touched = {int(b) for b in put}
        if gone is not None:
            keys, touched = keys.unionByName(gone.select(*self.keys)), touched | set(self._buckets(gone))
        before = [f for b in sorted(touched) for f in now["buckets"].get(str(b), [])]
        left = self._write(self._load(before).join(keys.distinct(), self.keys, "left_anti").select(*self.schema.names), f"{change}/old") if before else {}
        parts = {str(b): [x[str(b)] for x in (left, put) if str(b) in x] for b in sorted(touched)}
        buckets = {b: f for b, f in now["buckets"].items() if int(b) not in touched} | {b: f for b, f in parts.items() if f}
        self._publish({"number": now["number"] + 1, "batch": now["batch"] if batch is None else batch, "buckets": buckets})
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Forget all versions but the newest ones, and delete what none of those reads. Not while a change is under way."""
        numbers = self._numbers()
        live = {f.split("/")[1] for n in numbers[-keep:] for own in self.version(n)["buckets"].values() for f in own}
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{n}")
            fs.delete(p, False)
        fs, p = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)
