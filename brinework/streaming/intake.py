"""Idempotent intake of daily volume events with Structured Streaming."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from brinework.sources.versioned import VersionedTable

VOLUMES = ["oil", "water", "gas", "water_inj", "gas_inj"]
EVENT = "id_completion long, event_date date, oil double, water double, gas double, water_inj double, gas_inj double, uom string, emitted_ts timestamp"
KEY = ["id_completion", "event_date"]


def parsed(payloads: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of JSON payloads, and the dead letters: payloads that do not parse or lack a key."""
    x = payloads.withColumn("e", F.from_json(F.col(column).cast("string"), EVENT))
    whole = F.col("e").isNotNull() & F.col("e.id_completion").isNotNull() & F.col("e.event_date").isNotNull()
    rest = [c for c in payloads.columns if c != column]
    return x.where(whole).select("e.*", *rest), x.where(~whole).select(column, *rest)


def merged(deliveries: DataFrame, order: str) -> DataFrame:
    """One row for each (id_completion, event_date): the latest delivery's volumes, the first one's unit and emission time, and how
    often it was delivered. It is the same however deliveries are split into batches."""
    latest = F.max_by(F.struct(*VOLUMES), F.struct(F.col(order)))
    first = F.min_by(F.struct("uom", "emitted_ts"), F.struct(F.col(order)))
    out = deliveries.groupBy(*KEY).agg(latest.alias("v"), first.alias("f"), F.max(order).alias(order), F.min(order).alias("first_order"), F.count("*").alias("n_deliveries"))
    return out.select(*KEY, "v.*", "f.*", order, "first_order", "n_deliveries")


def absorb(state: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The merged state with one more batch, by a join on the key."""
    new = merged(batch, order)
    x = state.alias("s").join(new.alias("n"), KEY, "full_outer")
    later = F.col(f"s.{order}").isNull() | (F.col(f"n.{order}") > F.col(f"s.{order}"))
    earlier = F.col("s.first_order").isNull() | (F.col("n.first_order") < F.col("s.first_order"))
    pick = lambda c, test: F.when(test, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    count = F.coalesce(F.col("s.n_deliveries"), F.lit(0)) + F.coalesce(F.col("n.n_deliveries"), F.lit(0))
    return x.select(*KEY, *[pick(c, later) for c in VOLUMES], *[pick(c, earlier) for c in ("uom", "emitted_ts")], pick(order, later), pick("first_order", earlier), count.alias("n_deliveries"))


def redeliveries(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(F.col("n_deliveries") - 1), F.lit(0)).alias("redeliveries"))


def latency(events: DataFrame) -> DataFrame:
    """Seconds between the clocks of each event."""
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return events.withColumns({"emit_to_store": seconds("stored_ts", "emitted_ts"), "emit_to_ingest": seconds("ingest_ts", "emitted_ts"), "ingest_to_store": seconds("stored_ts", "ingest_ts")})


def unpromoted(raw: DataFrame, state: DataFrame) -> DataFrame:
    """(id_completion, prod_date) of the events that the raw volumes lack."""
    days = state.select("id_completion", F.col("event_date").alias("prod_date"))
    return days.join(raw.select("id_completion", "prod_date"), ["id_completion", "prod_date"], "left_anti").distinct()


def promoted(raw: DataFrame, state: DataFrame) -> DataFrame:
    """Raw volumes with the events that they lack."""
    new = state.select("id_completion", F.col("event_date").alias("prod_date"), *VOLUMES)
    return raw.unionByName(new.join(raw.select("id_completion", "prod_date"), ["id_completion", "prod_date"], "left_anti").select(*raw.columns))


def state_table(spark: SparkSession, path: str, order: str, kind: str = "long", buckets: int = 16) -> VersionedTable:
    """The stored state: a row for each (id_completion, event_date), in buckets by completion and day."""
    volumes = ", ".join(f"{c} double" for c in VOLUMES)
    return VersionedTable(spark, path).create(f"id_completion long, event_date date, {volumes}, uom string, emitted_ts timestamp, {order} {kind}, first_order {kind}, n_deliveries long", KEY, buckets)


def stream_to(events: DataFrame, path: str, checkpoint: str, order: str, buckets: int = 16):
    """Runs a stream of events to its end into the state table at path. Each micro-batch is absorbed into the buckets that it touches,
    as one version of the table; a batch that is run again has its number and changes nothing."""
    table = state_table(events.sparkSession, path, order, dict(events.dtypes)[order], buckets)

    def one(batch: DataFrame, number: int) -> None:
        table.change(batch, lambda state, rows: absorb(state, rows, order), writer=checkpoint, number=number)

    query = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# Windows in event time are an extension of this library.
def windowed(events: DataFrame, lateness: str = "7 days", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows, or sliding ones with `slide`. Of a stream, a
    window is given out once, in the first batch whose watermark (the latest ts of all batches before, less `lateness`) is at or behind
    its end; an event is left out if its window's end was at or before the watermark of the batch before its own."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = events.withWatermark("ts", lateness).groupBy(window.alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "7 days") -> DataFrame:
    """Counts and sums of each user's events (ts, user_id, value) in sessions: an event less than `gap` behind the one before is of its
    session. Of a stream, a session is given out once the watermark has passed its end; an event is left out if a session of its own would have
    ended before the watermark of the batch before."""
    x = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select("user_id", F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), "n", "total")


def stream_windows(windows: DataFrame, path: str, checkpoint: str):
    """Runs a windowed stream to its end. Finished windows are appended to the table at path, each batch in a folder of its own, so a
    batch that is run again is written again in its place; windows that the watermark has not passed stay in the stream's state."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = windows.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def resume_date(events: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: the day behind the latest of the events (event_date) and the raw volumes (prod_date); 1900-01-02 if neither has one."""
    last = lambda df, c: df.agg(F.max(c).alias("d"))
    latest = last(events, "event_date").unionByName(last(raw, "prod_date")).agg(F.max("d").alias("d"))
    return latest.select(F.date_add(F.coalesce("d", F.lit("1900-01-01").cast("date")), 1).alias("resume_date"))


def kafka_rows(events: DataFrame) -> DataFrame:
    """(key, value) of each event: its completion, so that a completion's events stay in order, and the event as JSON of EVENT's
    fields; parsed() reads it back."""
    fields = [f.split()[0] for f in EVENT.split(", ")]
    return events.select(F.col("id_completion").cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def publish(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Sends a stream of events to a Kafka topic to its end; each message is acknowledged by all replicas and written once."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.linger.ms": "20", "kafka.compression.type": "lz4"}
    query = kafka_rows(events).writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


PROGRESS = "query string, batch long, started timestamp, n_rows long, seconds double, rows_per_second double, late_rows long"


class ProgressLog(StreamingQueryListener):
    """Writes a row for each micro-batch of a session's streams to a table of one folder for each batch, so that no batch is forgotten
    and one that is reported twice has one row. Add it with spark.streams.addListener(); read() gives the rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = p.batchDuration / 1000
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        row = (str(p.id), p.batchId, datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), p.numInputRows, seconds, p.numInputRows / max(seconds, 1e-3), late)
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/id={p.id}/number={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(self.path)


def batch_progress(query) -> list[dict]:
    """Of the micro-batches that a streaming query remembers (spark.sql.streaming.numRecentProgressUpdates at most): number, rows,
    seconds and rows a second."""
    return [{"batch": p.batchId, "n_rows": p.numInputRows, "seconds": p.batchDuration / 1000, "rows_per_second": p.numInputRows / max(p.batchDuration / 1000, 1e-3)} for p in query.recentProgress]
