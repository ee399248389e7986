"""Measures of the pipeline itself: rollups, summaries, two definitions of percentile, moving means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(rows: DataFrame, ts: str, seconds: int = 5, worker: str = "worker_id", size: str = "bytes", latency: str = "latency_ms") -> DataFrame:
    """Counts, bytes and latencies of each worker in tumbling windows."""
    at = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds).alias("window_start")
    return rows.groupBy(worker, at).agg(F.count("*").alias("consumed"), F.sum(size).alias("bytes_in"), F.max(latency).alias("latency_max"))


def summary(windows: DataFrame, seconds: float, worker: str = "worker_id") -> DataFrame:
    """Rates over all workers: sums per worker first, then their total over the seconds."""
    each = windows.groupBy(worker).agg(F.sum("consumed").alias("consumed"), F.sum("bytes_in").alias("bytes_in"))
    w = max(seconds, 1e-6)
    return each.agg(F.count("*").alias("workers"), F.sum("consumed").alias("consumed"), (F.sum("consumed") / w).alias("events_per_second"), (F.sum("bytes_in") / w).alias("bytes_per_second"))


def _ranked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of each key with the ranks (from 0) they cover: sorted counts, so no key's values are gathered in one array."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(key).orderBy(value)
    return counted.withColumns({"_end": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(key))}).withColumn("_start", F.col("_end") - F.col("_c"))


def percentile_floor(rows: DataFrame, key: str, value: str, p: float, name: str) -> DataFrame:
    """The value at place floor(p * (n - 1)) of each key's sorted values."""
    at = F.floor(F.lit(p) * (F.col("_n") - 1))
    return _ranked(rows, key, value).where((at >= F.col("_start")) & (at < F.col("_end"))).select(key, F.col(value).alias(name))


def percentile_exclusive(rows: DataFrame, key: str, value: str, percent: int, name: str) -> DataFrame:
    """Interpolated at place percent * (n + 1) / 100 (from 1) between the values around it; within the smallest and largest pair, as a sample's quantiles are extended."""
    n = F.col("_n")
    j = F.least(F.greatest(F.floor(F.lit(percent) * (n + 1) / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    delta = F.lit(percent) * (n + 1) - j * 100
    covers = lambda rank: (rank - 1 >= F.col("_start")) & (rank - 1 < F.col("_end"))
    got = _ranked(rows, key, value).groupBy(key).agg(F.max("_n").alias("_n"), F.max(F.when(covers(j), F.col(value))).alias("_low"), F.max(F.when(covers(j + 1), F.col(value))).alias("_high"), F.max(delta).alias("_delta"))
    return got.select(key, F.when(F.col("_n") == 1, F.col("_low")).otherwise((F.col("_low") * (100 - F.col("_delta")) + F.col("_high") * F.col("_delta")) / 100).alias(name))


def latest_samples(rows: DataFrame, key: str, order: str, room: int = 2000) -> DataFrame:
    """The ``room`` latest rows of each key, as a window's reservoir keeps them. Spark cuts to that many rows a key before it shuffles."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where(F.col("_place") <= room).drop("_place")


def resources(rows: DataFrame, worker: str, *measures: str) -> DataFrame:
    """The mean over workers of each worker's highest measure."""
    highest = rows.groupBy(worker).agg(*[F.max(m).alias(m) for m in measures])
    return highest.agg(*[F.avg(m).alias(m) for m in measures])


def ring_mean(rows: DataFrame, key: str, order: str, value: str, room: int = 128) -> DataFrame:
    """The mean of each row's last ``room`` values of its key."""
    return rows.withColumn("ring_mean", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - room, 0)))


def load_rate(second: Column, rate: int = 1000, burst_rate: int = 0, burst_every: int = 0, burst_seconds: int = 0) -> Column:
    """Events to generate in a second: the burst's rate in its first seconds of every period."""
    if not burst_every:
        return F.lit(rate)
    return F.when(second % burst_every < burst_seconds, burst_rate).otherwise(rate)
