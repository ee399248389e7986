"""What a stream says about itself: rollups a worker with mergeable quantile sketches, published and read back, and latencies from a carried header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Size of the quantile sketches: ranks are right to within about 0.7 per cent.
SKETCH = 400
_MESSAGE = "window_start timestamp, worker_id string, consumed long, bytes_in long, latency_max long, sketch string, check long"


def rollups(rows: DataFrame, ts: str = "ts", worker: str = "worker_id", size: str = "bytes", latency: str = "latency", seconds: int = 5, late: str = "10 minutes") -> DataFrame:
    """window_start, worker_id, consumed, bytes_in, latency_max and a sketch of the latencies in tumbling windows of a stream; state ends with the watermark. Null latencies count as consumed only."""
    made = rows.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), F.col(worker).cast("string").alias("worker_id"))
    sketch = F.kll_sketch_agg_bigint(F.col(latency).cast("long"), F.lit(SKETCH))
    return made.agg(F.count("*").alias("consumed"), F.sum(size).cast("long").alias("bytes_in"), F.max(latency).cast("long").alias("latency_max"), sketch.alias("sketch")).select(F.col("w.start").alias("window_start"), "worker_id", "consumed", "bytes_in", "latency_max", "sketch")


def messages(made: DataFrame) -> DataFrame:
    """A line of JSON a rollup; ``check`` is the sketch's CRC-32, since a broken sketch can't be read."""
    return made.select(F.to_json(F.struct("window_start", "worker_id", "consumed", "bytes_in", "latency_max", F.base64("sketch").alias("sketch"), F.crc32("sketch").alias("check"))).alias("value"))


def publish(made: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing a stream's rollups to a topic of lines. A batch writes the windows that it changed below its own number, so a batch that runs again replaces itself, and of a window's lines the latest batch's counts."""

    def write(batch: DataFrame, number: int) -> None:
        messages(batch).write.mode("overwrite").text(f"{path}/batch={number}")

    return made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rollups of a topic, of each window and worker the latest. Lines that aren't rollups, whole ones with a good sketch, are passed over."""
    lines = spark.read.schema("value string, batch long").text(path)
    told = lines.select(F.from_json("value", _MESSAGE).alias("m"), "batch").select("m.*", "batch").withColumn("sketch", F.try_to_binary("sketch", F.lit("base64")))
    good = F.col("window_start").isNotNull() & F.col("worker_id").isNotNull() & (F.col("consumed") >= 0) & (F.coalesce("bytes_in", F.lit(0)) >= 0) & (F.crc32("sketch") == F.col("check"))
    rest = F.struct("consumed", "bytes_in", "latency_max", "sketch")
    return told.where(good).groupBy("window_start", "worker_id").agg(F.max_by(rest, "batch").alias("m")).select("window_start", "worker_id", "m.*")


def report(made: DataFrame, seconds: float, *keys: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Events, bytes, their rates over ``seconds``, the highest latency and its percentiles, over all rollups or for each of ``keys``: sketches merge, so percentiles need no latency a second time."""
    w = max(seconds, 1e-6)
    merged = made.groupBy(*keys).agg(F.sum("consumed").alias("consumed"), F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"), F.max("latency_max").alias("latency_max"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH)).alias("_s"))
    known = F.col("latency_max").isNotNull()
    found = [F.when(known, F.kll_sketch_get_quantile_bigint("_s", F.lit(p / 100))).alias(f"p{p}") for p in percents]
    return merged.select(*keys, "consumed", "bytes_in", (F.col("consumed") / w).alias("events_per_second"), (F.col("bytes_in") / w).alias("bytes_per_second"), "latency_max", *found)


def timed(stream: DataFrame, first_seen: str, now: Column | None = None) -> DataFrame:
    """``stream`` with latency_ms from the carried header ``first_seen`` to ``now``, not below 0 and null without the header; every batch's progress tells their number, sum and maximum."""
    now = now if now is not None else F.current_timestamp()
    ms = F.greatest(F.unix_millis(now) - F.unix_millis(F.col(first_seen)), F.lit(0).cast("long"))
    latency = F.col("latency_ms")
    return stream.withColumn("latency_ms", F.when(F.col(first_seen).isNotNull(), ms)).observe("latency", F.count(latency).alias("n"), F.sum(latency).alias("total_ms"), F.max(latency).alias("max_ms"))


class BatchLatencies(StreamingQueryListener):
    """What ``timed`` streams' batches took, as they end: (query's id, batch, n, total_ms, max_ms). The last ``room`` are kept."""

    def __init__(self, room: int = 1000):
        self.room, self.batches = room, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get("latency")
        if found is not None and event.progress.numInputRows:
            self.batches = [*self.batches, (str(event.progress.id), event.progress.batchId, found.n, found.total_ms, found.max_ms)][-self.room :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
