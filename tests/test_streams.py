import pytest
from pyspark.sql import functions as F

from tenderlake.sources.kept import KeptTable
from tenderlake.streaming.status import BIDS, EVENTS, PROGRESS, live_progress, run_status_stream, score_on_complete


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kept_table_is_as_before_or_as_after_a_change(spark, tmp_path, monkeypatch):
    table = KeptTable(spark, f"file://{tmp_path}/t", "p long, id long, v string", ["p", "id"], ["p"], buckets=4)
    frame = lambda *rows: spark.createDataFrame(rows, "p long, id long, v string")
    assert _rows(table.read()) == []
    assert table.replace(frame(*[(p, 1, "a") for p in range(20)]), batch=0)
    before, old = _rows(table.read()), table.version()
    # While it is read, a change is put in; the reader's version stays.
    reader = table.read()
    assert table.replace(frame((3, 1, "b"), (3, 2, "c"), (99, 1, "d")), batch=1)
    after = sorted([x for x in before if x != (3, 1, "a")] + [(3, 1, "b"), (3, 2, "c"), (99, 1, "d")])
    assert _rows(reader) == before and _rows(table.read()) == after
    # A batch that comes again changes nothing.
    assert not table.replace(frame((5, 1, "x")), batch=1) and _rows(table.read()) == after
    # A failure half way, and another change that was faster.
    monkeypatch.setattr(table, "_publish", lambda version: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.replace(frame((5, 1, "x")), batch=2)
    monkeypatch.undo()
    assert _rows(table.read()) == after
    with pytest.raises(Exception, match="exist"):
        table._publish(old | {"number": 2})
    # Keys that go, and rows of touched buckets alone.
    assert table.replace(frame(), gone=frame((3, 1, ""), (3, 2, "")))
    assert _rows(table.read()) == [x for x in after if x[0] != 3]
    some = table.read(spark.createDataFrame([(7,)], "p long"))
    assert _rows(some) == [(7, 1, "a")]
    (bucket,) = table._buckets(frame((7, 0, "")))
    files = {f.split("/_bucket=")[1].split("/")[0] for f in some.inputFiles()}
    assert files == {str(bucket)}
    table.vacuum(keep=1)
    assert _rows(table.read()) == [x for x in after if x[0] != 3] and len(table._numbers()) == 1


def _event(id, second, status, rule=None, value=1.0):
    return (id, id % 3, f"2024-01-01 00:00:{second:02d}" if second < 60 else f"2024-01-01 {second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}", status, value, rule)


def test_progress_over_batches_replays_and_late_events(spark, tmp_path):
    batches = [
        [_event(1, 1, "pending"), _event(1, 5, "processing", "r1"), _event(2, 2, "processing", "r1", None)],
        [_event(1, 5, "processing", "r1"), _event(1, 3, "error"), _event(1, 9, "processing", "r2"), _event(2, 8, "completed", "r2")],  # a replay and a late event
        [_event(1, 2, "processing", "r3"), _event(3, 4, "pending"), _event(2, 8, "completed", "r2")],  # a late rule counts, an old status doesn't
    ]
    source, table = f"file://{tmp_path}/source", KeptTable(spark, f"file://{tmp_path}/bids", PROGRESS, ["id"], buckets=4)
    kind = EVENTS.replace("ts timestamp", "ts string")
    seen = []
    for rows in batches + [batches[1]]:
        seen += rows
        df = spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        kept = run_status_stream(stream, table, f"file://{tmp_path}/checkpoint")
        all_ = spark.createDataFrame(seen, kind).withColumn("ts", F.to_timestamp("ts"))
        want = all_.groupBy("id").agg(F.max_by("status", F.struct("ts", "status")).alias("s"), F.count_distinct("rule").cast("int").alias("n"))
        assert _rows(kept.select("id", "processing_status", "progress_completed_rules")) == _rows(want)
    report = {r["id"]: (r["progress_completed"], r["percent"], r["overall_percent"]) for r in live_progress(kept, spark.range(3).select(F.col("id").alias("project_id"), F.lit(4).alias("progress_total_rules"))).collect()}
    assert report == {1: (3, 75.0, 0.0), 2: (2, 50.0, 100.0), 3: (0, 0.0, 0.0)}


def test_state_of_finished_bids_ends_by_a_timer(spark, tmp_path):
    source, table = f"file://{tmp_path}/source", KeptTable(spark, f"file://{tmp_path}/bids", PROGRESS, ["id"], buckets=2)
    kind = EVENTS.replace("ts timestamp", "ts string")
    batches = [[_event(1, 1, "completed", "r1"), _event(2, 1, "processing", "r1")], [_event(3, 7200, "processing")], [_event(3, 14400, "processing")], [_event(1, 14500, "processing", "r1"), _event(2, 14500, "processing", "r1")]]
    for rows in batches:
        df = spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        kept = run_status_stream(stream, table, f"file://{tmp_path}/checkpoint", delay="1 minute", keep_ms=600_000)
    # Bid 1 was done and starts anew, bid 2 was not and goes on; both have one rule.
    assert _rows(kept.select("id", "processing_status", "progress_completed_rules")) == [(1, "processing", 1), (2, "processing", 1), (3, "processing", 0)]
    state = spark.read.format("statestore").option("stateVarName", "rules").load(f"file://{tmp_path}/checkpoint")
    assert state.count() == 2


def test_complete_projects_get_scores_totals_and_status(spark, tmp_path):
    results = spark.createDataFrame([(i, p, i, f"b{i}", None, None, price, '[{"Child_Item_Name":"x","score":5}]') for i, p, price in [(1, 1, 10.0), (2, 1, 20.0), (3, 2, 30.0), (4, 3, 1.0)]], "id long, project_id long, bid_document_id long, bidder_name string, total_score double, price_score double, extracted_price double, detailed_scores string")
    rules = spark.createDataFrame([(p, p, "价格", 40, None, None, True) for p in (1, 2, 3)], "id long, project_id long, Parent_Item_Name string, Parent_max_score int, Child_Item_Name string, Child_max_score int, is_price_criteria boolean")
    by = ["project_id"]
    bids = KeptTable(spark, f"file://{tmp_path}/bids", BIDS, ["project_id", "id"], by, 4)
    scores, projects = KeptTable(spark, f"file://{tmp_path}/scores", results.schema, by, buckets=4), KeptTable(spark, f"file://{tmp_path}/projects", "project_id long, status string", by, buckets=4)
    handle = score_on_complete(bids, lambda ready: results.join(ready, "project_id", "left_semi"), rules, scores, projects, newest="seq")
    batch = lambda *rows: spark.createDataFrame(rows, "id long, project_id long, processing_status string, seq int")
    read = lambda: (_rows(scores.read().select("id", "price_score", "total_score")), dict(projects.read().collect()))
    handle(batch((1, 1, "completed", 1), (2, 1, "processing", 1), (3, 2, "processing", 1), (3, 2, "error", 2)), 0)
    first = ([(3, 40.0, 45.0)], {1: "processing", 2: "completed_with_errors"})
    assert read() == first
    handle(batch((1, 1, "completed", 1), (2, 1, "processing", 1), (3, 2, "error", 2)), 0)  # comes again
    assert read() == first
    # A run that breaks off after the bids have been taken in, and comes again.
    broken = score_on_complete(bids, lambda ready: 1 / 0, rules, scores, projects)
    with pytest.raises(ZeroDivisionError):
        broken(batch((2, 1, "completed", 3)), 1)
    assert read() == first
    handle(batch((2, 1, "completed", 3)), 1)
    assert read() == ([(1, 40.0, 45.0), (2, 20.0, 25.0), (3, 40.0, 45.0)], {1: "completed", 2: "completed_with_errors"})
    # A bid that is taken up again takes its project's scores away.
    handle(batch((2, 1, "processing", 4)), 2)
    assert read() == ([(3, 40.0, 45.0)], {1: "processing", 2: "completed_with_errors"})


def test_no_part_of_the_stream_of_bids_is_written_by_one_task(spark, monkeypatch):
    from tenderlake.plans import text_queries

    def refused(*_):
        raise AssertionError("a whole part would go through one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    assert text_queries.QUERIES["score_on_complete_stream"](spark, "/root/testdata/sf0.001").count() > 0


def test_the_stream_of_bids_keeps_one_version_no_shuffles_and_texts_at_rest_alone(spark, monkeypatch):
    from tenderlake.plans import text_queries

    made = []
    monkeypatch.setattr(text_queries, "KeptTable", lambda *args, **more: made.append(KeptTable(*args, **more)) or made[-1])
    shuffles = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = shuffles()
    got = text_queries.QUERIES["score_on_complete_stream"](spark, "/root/testdata/sf0.001")
    assert not [f for f in shuffles() - before if "shuffle_" in f]
    assert [len(table._numbers()) for table in made] == [1] * 4
    assert ["detailed_scores" in spark.read.parquet(*[f"{t.path}/{f}" for own in t.version()["buckets"].values() for f in own]).columns for t in made] == [False, True, False, False]
    assert got.count() > 0


def test_a_change_writes_its_rows_once_and_reads_tables_of_one_folder_a_bucket(spark, tmp_path):
    table = KeptTable(spark, f"file://{tmp_path}/t", "p long, v string", ["p"], buckets=2)
    frame = lambda *rows: spark.createDataFrame(rows, "p long, v string")
    table.replace(frame((1, "a"), (2, "a"), (3, "a")), batch=0)
    first = table.version()
    table._publish(first | {"number": 2, "buckets": {b: own[0] for b, own in first["buckets"].items()}})  # as such a table says it
    assert table.replace(frame((2, "b"), (9, "b")), batch=1) and _rows(table.read()) == [(1, "a"), (2, "b"), (3, "a"), (9, "b")]
    stored = [(f, r["p"]) for own in table.version()["buckets"].values() for f in own for r in spark.read.parquet(f"{table.path}/{f}").collect()]
    assert sorted(p for f, p in stored if "/new/" in f) == [2, 9]
    table.vacuum(keep=1)
    assert _rows(table.read()) == [(1, "a"), (2, "b"), (3, "a"), (9, "b")]
