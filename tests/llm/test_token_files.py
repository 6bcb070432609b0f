import zlib
from glob import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import token_files
from tenderlake.llm.packing import tokenizer_path

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [(None, "no id"), (None, None), (-5, None), (-4, ""), (-3, "a <|endoftext|> b"), (-3, "other text of the same id"), (2, "same"), (2, "same"), (2, "same"), (10**12, "é 漢字 \U0001f600 " * 3000)]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The odd rows and a whole table, in several files of small row groups and pages."""
    odd = spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in ODD], "doc_id long, text string, start string, at double, source string")
    docs = odd.unionByName(spark.read.parquet(DOCS).select("doc_id", "text", F.lit("z").alias("start"), F.lit(0.5).alias("at"), "source"))
    path = f"file://{tmp_path_factory.mktemp('files')}/out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write(docs.repartition(5), path, row_group=1 << 13, page=1 << 11, page_rows=20)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    encode = library()
    rows = sorted(((r["doc_id"], encode(r["text"])) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    return path, rows


def test_documents_equal_the_library(spark, files):
    path, expected = files
    rows = token_files.documents(spark, path).withColumn("crc", token_files.ids_crc32("ids")).orderBy("_start").collect()
    assert set(rows[0].asDict()) == {"doc_id", "start", "source", *token_files.OWN, "_start", "crc"}  # a clashing column stays
    assert [r["doc_id"] for r in rows] == [i for i, _ in expected]
    place = 0
    for r in rows:
        assert r["_start"] == place and r["n_tokens"] == len(r["ids"]) == r["until"] - r["at"]
        assert r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        place += len(r["ids"])
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in rows) == sorted((str(i), tuple(x)) for i, x in expected)


def test_encodings_and_page_indexes(files):
    path, _ = files
    parts = sorted(glob(path.removeprefix("file://") + "/ids/*.parquet"))
    assert len(parts) > 1
    groups = 0
    for part in parts:
        meta = pq.ParquetFile(part).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                name = column.path_in_schema
                assert column.has_offset_index and (column.has_column_index or column.statistics.null_count == column.num_values)
                if name.startswith("ids."):
                    assert "RLE_DICTIONARY" in column.encodings and "DELTA_BINARY_PACKED" not in column.encodings
                if name in ("doc_id", "file", "until", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in column.encodings and "RLE_DICTIONARY" not in column.encodings
    assert groups > len(parts)


def test_metadata_reads_leave_ids_and_conditions_go_down(spark, files):
    path, _ = files
    plan = token_files.documents(spark, path).where("doc_id = 7").select("doc_id", "_start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert not any("ids:" in line for line in plan.split("\n") if "ReadSchema" in line)


def test_windows_of_the_stream(spark, files):
    path, expected = files
    stream = []
    for r in token_files.documents(spark, path).orderBy("_start").collect():
        stream += r["ids"]
    for start, stop in [(0, 1), (0, 10**9), (5, 5), (len(stream) - 3, len(stream) + 5), (1000, 9000), (len(stream), len(stream) + 9), (12345, 12346)]:
        rows = token_files.window(spark, path, start, stop).select("_start", "ids").collect()
        got = [x for r in sorted(map(tuple, rows), key=lambda r: r[0]) for x in r[1]]
        assert got == stream[start:stop], (start, stop)


def test_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.documents(spark, path).collect() == [] and token_files.window(spark, path, 0, 9).collect() == []


def test_query_on_a_whole_table(spark):
    from tenderlake.llm.queries import op11_token_files

    sf, encode, place = "/root/testdata/sf0.001", library(), 0
    out = op11_token_files(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    for r in spark.read.parquet(DOCS).orderBy("doc_id").collect():
        ids = encode(r["text"])
        assert got.pop(r["doc_id"]) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
    assert not got
