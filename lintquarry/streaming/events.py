"""The same operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import webhooks
from ..session import ship


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a table of Parquet files, a folder or a single file, a bounded number of files a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # a stream's source is a folder: that of the file, with nothing else in it read
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def gated_stream(events: DataFrame, triggers: list[dict]) -> DataFrame:
    """Deliveries that may start a scan; stateless."""
    return webhooks.gated(events, triggers)


def daily_counts(events: DataFrame, late: str = "1 day", key: str = "event_type") -> DataFrame:
    """Events of each day and key; a day's row is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def record_states(events: DataFrame) -> DataFrame:
    """The state of each record as a running aggregate: SUCCESS stays, else the last status by ts."""
    last = F.max(F.struct("ts", "status"))
    return events.groupBy("record_id").agg(F.coalesce(F.max(F.when(F.col("status") == "SUCCESS", F.lit("SUCCESS"))), last["status"]).alias("status"))


#: What the state of a group of records holds of each: its status, the time of the event that gave it (microseconds), how many rows it has put out,
#: and when it is given up (milliseconds).
STATE = "record_id array<bigint>, status array<string>, ts array<bigint>, n array<bigint>, due array<bigint>"
STATUS_ROWS = "record_id bigint, status string, ts timestamp, n bigint"


def record_status_stream(events: DataFrame, late: str = "1 day", expire_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """How records' states change, as a stateful stream: a row (record_id, status, ts, n) for each batch that changes one, n counting up.

    events: record_id, status, ts. A record that has succeeded stays so; otherwise the newest event counts, so one that comes late
    doesn't undo a newer one. Records that haven't ended are given up (EXPIRED) when the watermark is ``expire_ms`` past their last event; their
    state then goes, as does that of ended ones when nothing about them can come in time any more. Records are kept in ``buckets`` by their hash,
    as handing a group to Python costs milliseconds and a record in it microseconds; a stream keeps the number that it began with.
    """
    def change(key, batches, state):
        import pandas as pd

        held = {r: now for r, *now in zip(*state.get, strict=True)} if state.exists else {}
        was = {}
        for rows in batches:
            at = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
            for r, s, t in zip(rows["record_id"].tolist(), rows["status"].tolist(), at, strict=True):
                now = held.get(r)
                if now is None:
                    held[r], was[r] = [s, t, 0, 0], None
                    continue
                was.setdefault(r, (now[0], now[1]))
                if now[0] != "SUCCESS" and (s == "SUCCESS" or (t, s) > (now[1], now[0])):
                    now[0], now[1] = s, t
        out = []
        for r, before in was.items():
            now = held[r]
            if (now[0], now[1]) != before:
                now[2] += 1
                out.append((r, *now[:3]))
        if expire_ms is not None:
            mark = state.getCurrentWatermarkMs()
            for r in was:
                held[r][3] = max(held[r][1] // 1000 + expire_ms, mark + 1)
            for r in [r for r, now in held.items() if now[3] < mark]:
                status, ts, n, _ = held.pop(r)
                if status not in ENDED:
                    out.append((r, "EXPIRED", ts, n + 1))
        if out:
            made = pd.DataFrame(out, columns=["record_id", "status", "ts", "n"])
            yield made.assign(ts=pd.to_datetime(made["ts"], unit="us"))
        if not held:
            state.remove()
            return
        state.update(tuple(map(list, zip(*((r, *now) for r, now in held.items()), strict=True))))
        if expire_ms is not None:
            state.setTimeoutTimestamp(max(min(now[3] for now in held.values()), mark))

    ship(events.sparkSession)
    timeout = GroupStateTimeout.EventTimeTimeout if expire_ms is not None else GroupStateTimeout.NoTimeout
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.col("record_id").cast("bigint").alias("record_id"), "status", "ts").filter("record_id IS NOT NULL AND status IS NOT NULL AND ts IS NOT NULL")
    bucketed = keyed.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandasWithState(change, STATUS_ROWS, STATE, "append", timeout)


ENDED = ("SUCCESS", "FAILED")


def gated_by_table(events: DataFrame, settings_path: str, sink: str, checkpoint: str) -> DataFrame:
    """Deliveries that may start a scan by the triggers as the settings table has them: read anew for each batch, so that what changes there
    holds from the next batch on, and each event is judged by the version in force at its own time. A batch that is run again
    replaces its own folder."""
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        settings = spark.read.schema(webhooks.SETTINGS).parquet(settings_path)
        webhooks.gated_by(rows, settings).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    shape = webhooks.gated_by(spark.createDataFrame([], events.schema), spark.createDataFrame([], webhooks.SETTINGS)).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return spark.read.schema(shape).parquet(sink).select(*shape.names)


def available_now(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet, then read the result."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def write_back(states: DataFrame, sink: str, checkpoint: str, template: str, once: bool = True):
    """Tell the outside how records end: for each batch of states (record_id, status, and what the template names) the rows that ended,
    each with its comment, as one folder of the sink named by the batch, so that a batch that is run again replaces itself."""
    from ..functions.text import render

    def batch(rows: DataFrame, number: int) -> None:
        ended = rows.filter(F.col("status").isin("SUCCESS", "FAILED"))
        values = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))])
        ended.withColumn("comment", render(F.lit(template), values)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = states.writeStream.outputMode("update" if states.isStreaming else "append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query
