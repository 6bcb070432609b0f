"""Streams: progress of bids, and scores, totals and status of a project as soon as its last bid is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.scores import apply_totals, bid_prices, price_rule_max, score_prices, with_read_scores
from ..operators.status import FINISHED, completion_status, progress_report
from ..sources.kept import KeptTable
from ..sources.shared import forgotten, shuffles_dropped, written

# What an event says of its bid.
STATUS_OF = {"signup": "pending", "view": "processing", "click": "processing", "purchase": "completed", "error": "error"}
EVENTS = "id long, project_id long, ts timestamp, status string, value double, rule string"
PROGRESS = "id long, project_id long, ts timestamp, processing_status string, value double, progress_completed_rules int"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def statuses(events: DataFrame, id: str = "user_id", kind: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """id, latest (ts, status, value): the newest event of each bid."""
    rows = events.select(F.col(id).alias("id"), F.col(ts).cast("timestamp").alias("ts"), status_of(F.col(kind)).alias("status"), F.col(value).alias("value"))
    latest = rows.groupBy("id").agg(F.max(F.struct("ts", "status", "value")).alias("x"))
    return latest.select("id", F.col("x.ts").alias("ts"), F.col("x.status").alias("status"), F.col("x.value").alias("value"))


def status_of(kind):
    return F.coalesce(F.create_map(*[F.lit(x) for p in STATUS_OF.items() for x in p])[kind], kind)


class Progress(StatefulProcessor):
    """What is known of one bid: its newest event (by time, status, value) and the set of its finished rules, so that events
    that come again or late change nothing or what they should. A finished bid's state goes when the watermark is ``keep``
    milliseconds past its newest event; an event after that starts the bid anew."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "rule string", "seen boolean")
        self.newest = handle.getValueState("newest", "project_id long, ts timestamp, status string, value double, done int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.newest.get() if self.newest.exists() else (None, None, None, None, 0)
        (project, ts, status, value, done), old = was, tuple(was)
        for batch in rows:
            for event in batch.itertuples(index=False):
                rule, now = event.rule, (event.ts, event.status or "", -1.0 if pd.isna(event.value) else event.value)
                if ts is None or now > (ts, status or "", -1.0 if value is None else value):
                    project, ts, status, value = event.project_id, event.ts, event.status, None if pd.isna(event.value) else float(event.value)
                if rule is not None and not pd.isna(rule) and not self.rules.containsKey((rule,)):
                    self.rules.updateValue((rule,), (True,))
                    done += 1
        ts = ts.to_pydatetime() if isinstance(ts, pd.Timestamp) else ts
        if (project, ts, status, value, done) == old:
            return
        self.newest.update((int(project), ts, status, value, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if status in FINISHED:
            self.handle.registerTimer(int(pd.Timestamp(ts).timestamp() * 1000) + self.keep)
        yield pd.DataFrame({"id": [key[0]], "project_id": [project], "ts": [ts], "processing_status": [status], "value": [value], "progress_completed_rules": [done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rules.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def bid_progress(events: DataFrame, delay: str = "1 day", keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """A stream of events (id, project_id, ts, status, value, rule: the rule an event finishes, if one) as a stream of changed
    bids (PROGRESS). Events later than delay are dropped."""
    rows = events.withWatermark("ts", delay)
    return rows.groupBy("id").transformWithStateInPandas(Progress(keep_ms), PROGRESS, "Update", "EventTime")


def run_status_stream(events: DataFrame, table: KeptTable, checkpoint: str, delay: str = "1 day", keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Run what is new in a stream of events and keep the changed bids in table (PROGRESS, by id), whose rows are returned. A
    micro-batch reads and writes the buckets of its bids, and one that comes again changes nothing."""
    spark = events.sparkSession
    spark.conf.set(*STATE_STORE)
    out = bid_progress(events, delay, keep_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out.foreachBatch(lambda batch, epoch: table.replace(batch, epoch) and None).start().awaitTermination()
    return table.read()


def live_progress(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """progress_report over kept bids; totals: project_id, progress_total_rules."""
    return progress_report(kept.join(totals, "project_id", "left"))


BIDS = "id long, project_id long, processing_status string"
# What price scores and totals are worked out from.
SCORED_BY = ["id", "project_id", "bidder_name", "total_score", "price_score", "extracted_price", "item_price", "other_total"]


def score_on_complete(bids: KeptTable, load: Callable[[DataFrame], DataFrame], rules: DataFrame, scores: KeptTable, projects: KeptTable, newest: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over changed bids (id, project_id, processing_status; of several rows of a bid the one with the
    highest ``newest`` counts). The bids' table (BIDS, replaced by project and id, in buckets by project) takes the batch in;
    of the projects it names, and of them alone, the status goes to projects (project_id, status and counts) and, where no bid
    is open, the results that load gives for a frame of project ids get price scores and totals, and go to scores by project.
    Every table knows the last batch it has taken in, so a batch that comes again, whole or broken off, ends the same. Texts of
    results are read once, and move on only if scores has a column for them."""

    def handle(batch: DataFrame, epoch: int) -> None:
        with shuffles_dropped(bids.spark, batch.sparkSession):
            take_in(batch, epoch)

    def take_in(batch: DataFrame, epoch: int) -> None:
        if newest is not None:
            last = F.max_by(F.struct("processing_status"), newest)
            batch = batch.groupBy("id", "project_id").agg(last.alias("x")).select("id", "project_id", "x.processing_status")
        bids.replace(batch, epoch)
        touched = written(batch.select("project_id").distinct())
        status = written(completion_status(bids.read(touched)))
        ready = status.where("n_open = 0").select("project_id")
        results = with_read_scores(load(ready))
        needed = {*scores.schema.names, *SCORED_BY}
        results = written(results.select(*[c for c in results.columns if c in needed]))
        scored = score_prices(bid_prices(results), price_rule_max(rules.join(ready, "project_id", "left_semi")))
        scores.replace(apply_totals(results, scored), epoch, gone=touched)
        projects.replace(status, epoch)
        forgotten(touched, status, results)

    return handle
