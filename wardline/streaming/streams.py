"""Structured Streaming forms: govern, exactly-once audit, rolling metrics, review states, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.catalog import views
from wardline.operators import reviews as R
from wardline.plans import govern as plans
from wardline.sources import readers, writers

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STATUS_OF = R.STATUS_OF
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVIEW_OUT = "request_id bigint, outcome string, status string, correct_action string, reviewer_id string, refused bigint"
REVIEW_FIELDS = [field.split()[0] for field in REVIEW_OUT.split(", ")]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on disk, written as changes, looked up by key."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def dedupe(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First copy of each request id within the watermark; the audit sink also checks stored ids."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])


def _parts(rows: DataFrame, frame: Column, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(frame.alias("w"), *keys).agg(
        F.count("*").alias("requests"), F.count_if(F.col("action_taken") == "BLOCK").alias("blocked"),
        F.sum(F.col("risk_score").cast("decimal(20,6)")).cast("decimal(38,6)").alias("risk_sum"),
        F.sum(F.col("latency_ms").cast("bigint")).alias("latency_sum"), F.count("latency_ms").alias("latency_count"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "requests", "blocked", "risk_sum", "latency_sum", "latency_count")


def accounted_metrics(stream: DataFrame, folder: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
                      keys: Sequence[str] = ("tenant_id", "use_case")):
    """Rolling metrics that account for every row: ``folder`` gets parts, late rows and counts, a folder per micro-batch each.

    A row is late if its ``ts`` lies before the watermark, which is the greatest ``ts`` of all earlier micro-batches less ``delay``.
    Late rows are kept beside the metrics; on-time and late rows are counted while they are written (``observe``). Windows are
    kept as mergeable parts, so a micro-batch reads the last batch's counts and nothing else, and a replayed one
    replaces its own folders. Returns the started query; ``read_metrics`` and ``read_accounts`` read the result.
    """
    spark = stream.sparkSession
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = writers.read_or_none(spark, f"{folder}/counts/batch={batch_id - 1}") if batch_id else None
        last = before.first() if before is not None else None
        mark = F.lit(last["newest"] if last else None).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        seen = Observation(f"rows-{batch_id}")
        late = F.coalesce(F.col("ts") < mark, F.lit(False))
        rows = batch.withColumn("_late", late).persist()
        try:
            counted = rows.observe(seen, F.count_if(~F.col("_late")).alias("on_time"), F.count_if("_late").alias("late"), F.max("ts").alias("newest"))
            writers.write_batch(counted.where("_late").drop("_late"), f"{folder}/late", batch_id)
            writers.write_batch(_parts(rows.where(~F.col("_late")), frame, keys), f"{folder}/parts", batch_id)
        finally:
            rows.unpersist()
        got = seen.get
        newest = max((x for x in (got["newest"], last["newest"] if last else None) if x is not None), default=None)
        counts = spark.createDataFrame([(got["on_time"], got["late"], newest)], "on_time bigint, late bigint, newest timestamp")
        writers.write_batch(counts, f"{folder}/counts", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, folder: str, keys: Sequence[str] = ("tenant_id", "use_case")) -> DataFrame:
    """The windows of ``accounted_metrics``: parts of all micro-batches added up."""
    total = spark.read.parquet(f"{folder}/parts").groupBy("window_start", "window_end", *keys).agg(
        *(F.sum(c).alias(c) for c in ("requests", "blocked", "risk_sum", "latency_sum", "latency_count")))
    average = F.try_divide(F.col("latency_sum").cast("double"), "latency_count")
    return total.select("window_start", "window_end", *keys, "requests", "blocked", F.col("risk_sum").cast("double").alias("risk_sum"), average.alias("avg_latency_ms"))


def read_accounts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(on-time and late rows counted per micro-batch, the late rows themselves)."""
    return spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/late").drop("batch")


def rolling_metrics(stream: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Tumbling or sliding metrics per tenant and use case; rows older than the watermark are left out (``accounted_metrics`` keeps them)."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    block = F.col("action_taken") == "BLOCK"
    grouped = stream.withWatermark("ts", watermark).groupBy(frame.alias("w"), "tenant_id", "use_case").agg(
        F.count("*").alias("requests"), F.count_if(block).alias("blocked"),
        F.sum(F.col("risk_score").cast("decimal(20,6)")).cast("double").alias("risk_sum"), F.avg("latency_ms").alias("avg_latency_ms"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tenant_id", "use_case",
                          "requests", "blocked", "risk_sum", "avg_latency_ms")


def session_metrics(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Risk per user session as sessions close."""
    s = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), user).agg(
        F.count("*").alias("requests"), F.max("risk_score").alias("risk_max"))
    return s.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests", "risk_max")


class ReviewStates(StatefulProcessor):
    """Per request: the review's status and the ids of refused decisions; a timer ends the state where a retention is asked for."""

    def __init__(self, retention_ms: int | None = None, ttl_ms: int | None = None) -> None:
        self.retention_ms, self.ttl_ms = retention_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string", self.ttl_ms)
        self.refused = handle.getListState("refused", "decision_id bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        # each call of the state is a message to the JVM: one look-up, and what changed is written
        held = self.status.get()
        status = held[0] if held is not None else None
        opened, best, newest, seen = False, None, 0, []
        for row in rows:  # one at a time
            if row["us"] is not None:
                newest = max(newest, row["us"] // 1000)
            if row["kind"] == "review":
                opened = True
            elif row["kind"] == "decision":
                seen.append(int(row["decision_id"]))
                order = (row["us"] is None, row["us"] or 0, seen[-1])
                if best is None or order < best[0]:
                    best = (order, row["decision"], row["reviewer_id"])
        if status is None and opened:
            status = "PENDING"
        out = None
        if best is not None:
            order, decision, reviewer = best
            if status == "PENDING":
                status = STATUS_OF[decision]
                seen.remove(order[2])
                out = ("applied", status, R.CORRECT_ACTION_OF[decision], reviewer, len(seen))
            else:
                out = ("unknown" if status is None else "conflict", status, None, None, len(seen))
        if status is not None:
            if held is None or status != held[0] or self.ttl_ms is not None:
                self.status.update((status,))
            if seen:
                self.refused.appendList([(x,) for x in seen])
            if self.retention_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.retention_ms)
        if out is not None:
            yield Row(**dict(zip(REVIEW_FIELDS, (key[0], *out), strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        self.status.clear()
        self.refused.clear()
        return iter(())

    def close(self) -> None:
        pass


def review_states(stream: DataFrame, retention_ms: int | None = None, watermark: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """Keyed review state: a review opens PENDING, the earliest decision wins, later ones are refused.

    Reads kind (review or decision), request_id, ts, decision_id, decision, reviewer_id.  Start the query inside ``rocksdb(spark)``.
    States are kept for good; with ``retention_ms`` one is dropped once the watermark is that far past its last event, with
    ``ttl_ms`` once it has not been written for so long by the clock (then without watermark); a decision after that is answered "unknown".
    """
    if retention_ms is not None and ttl_ms is not None:
        raise ValueError("retention_ms counts event time, ttl_ms counts by the clock: choose one")
    timed = stream if ttl_ms is not None else stream.withWatermark("ts", watermark)
    # rows, not frames: most requests have a few rows, and a frame costs more than a thousand of them
    timed = timed.withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("request_id").transformWithState(
        ReviewStates(retention_ms, ttl_ms), REVIEW_OUT, "Append", "ProcessingTime" if ttl_ms is not None else "EventTime")


def distinct_requests(stream: DataFrame) -> DataFrame:
    """Requests with their ``violations``: the first copy of each valid request id and of each rejected row, of any age.

    Ids met are kept in the query's state, looked up by key in RocksDB, so that sinks need not be asked what they hold.
    """
    checked = stream.withColumn("row_sha256", writers.row_digest(stream)).withColumn("violations", readers.request_violations())
    key = F.when(F.size("violations") == 0, F.concat(F.lit("id:"), "request_id")).otherwise(F.concat(F.lit("row:"), "row_sha256"))
    return checked.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def govern_stream(spark: SparkSession, in_dir: str, audit_dir: str, reviews_dir: str, checkpoint: str, evidence=None, rejected_dir: str | None = None, **options):
    """Govern files as they arrive: the batch plan per micro-batch, then audit and review sinks.

    No row is lost: rows that fail the request checks go to ``rejected_dir`` with their
    violations (beside the audit table by default), and rows of any age reach the audit, for
    nothing is dropped by a watermark.  Ids are told apart by the query's state and each sink writes a folder per micro-batch, so a
    replayed batch replaces its own folders and no batch reads what is stored, however much that is.
    """
    rejected_dir = rejected_dir or f"{audit_dir.rstrip('/')}_rejected"
    source = spark.readStream.schema(readers.INTERACTIONS).option("maxFilesPerTrigger", 100).parquet(in_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()  # read by two sinks
        try:
            bad = F.size("violations") > 0
            writers.write_batch(rows.where(bad), rejected_dir, batch_id)
            # ranges of (date, id): a task writes few of the date folders, and a day of any size is dealt over tasks
            valid = rows.where(~bad).drop("violations", "row_sha256").repartitionByRange(F.to_date("ts"), "request_id")
            mine = writers.write_audit(plans.audit_rows(plans.govern(valid, evidence, thin=True, **options)), audit_dir, batch_id)
            writers.write_batch(R.enqueue_reviews(mine, mine.select("request_id").limit(0)), reviews_dir, batch_id)
        finally:
            rows.unpersist()

    with rocksdb(spark):
        return distinct_requests(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, make: Callable[[], DataFrame], folder: str, mode: str = "append", keys: tuple[str, ...] = ("window_start", "tenant_id", "use_case")) -> DataFrame:
    """Run a stream over everything available and read its result table back.

    In update mode the last version of each key counts.
    """
    out, log = f"{folder}/out", f"{folder}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with rocksdb(spark):
        q = make().writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    result = spark.read.parquet(out).drop("batch")
    if mode != "update":
        return result.drop("batch_id")
    rest = [c for c in result.columns if c not in (*keys, "batch_id")]
    last = result.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


def audit_events(spark: SparkSession, sf: str, copies: int = 1) -> DataFrame:
    """The events table as a stream of audit rows, optionally with every row repeated."""
    a = views.audit_from(_event_stream(spark, sf))
    a = a.withColumn("ts", F.col("ts").cast("timestamp"))
    return a if copies == 1 else a.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews and decisions of the events table as one stream."""
    a = views.audit_from(_event_stream(spark, sf))
    opened = F.struct(F.lit("review").alias("kind"), F.col("ts").alias("ts"), F.lit(-1).cast("bigint").alias("decision_id"),
                      F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("reviewer_id"))

    def decided(k: int):
        n = F.floor(F.col("request_id") / 3) + k
        return F.struct(
            F.lit("decision").alias("kind"),
            F.when(F.col("request_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr(f"interval {k} hours")).alias("ts"),
            (F.col("request_id") * 2 + 1 - k).alias("decision_id"),
            F.when(n % 3 == 0, "APPROVE").when(n % 3 == 1, "EDIT").otherwise("REJECT").alias("decision"), F.lit(f"rev{k}").alias("reviewer_id"))

    rows = F.array_compact(F.array(
        F.when(F.col("action_taken") == "ESCALATE", opened), F.when(F.col("request_id") % 3 == 0, decided(0)),
        F.when(F.col("request_id") % 3 == 0, decided(1))))
    flat = a.select("request_id", F.explode(rows).alias("r")).select("request_id", "r.*")
    return flat.withColumn("ts", F.col("ts").cast("timestamp"))


__all__ = ["accounted_metrics", "audit_events", "dedupe", "distinct_requests", "govern_stream", "read_accounts", "read_metrics", "review_events", "review_states", "rocksdb", "rolling_metrics", "run_to_table", "session_metrics"]
