"""The pipeline as streams: topics are directories of Parquet, stages are decisions in columns, state is checkpointed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import computed_once
from ..operators.collect import contract_error
from ..operators.store import event_rows, quarantine_rows
from ..operators.validate import validate
from ..plans.normalize import SECTIONS, normalize
from ..plans.packs import parse
from ..sources.events import spread
from ..sources.shared import dropped
from .poison import isolated

RAW, PARSED, NORMALIZED, RETRY, DEAD, METRICS = "raw-event", "parsed-event", "normalized-event", "retry", "dead-letter", "metrics"
MOST_ATTEMPTS, BACKOFF_S, BACKOFF_CAP_S, HORIZON_MS = 5, 15, 1800, 1_805_000
STAGES = ("parser", "normalizer")


def delay_seconds(attempt: Column) -> Column:
    """15 seconds doubling with each attempt, 1800 at most."""
    return F.least(F.lit(BACKOFF_S) * F.pow(F.lit(2), attempt), F.lit(BACKOFF_CAP_S)).cast("long")


def attempt_of(header: Column) -> Column:
    """The attempt in a header; 0 for text that isn't a number from 0."""
    return F.greatest(F.coalesce(header.cast("string").try_cast("int"), F.lit(0)), F.lit(0))


def decide(error: Column, transient: Column, attempt: Column, to: str, now_ms: Column) -> Column:
    """topic, error_code, attempt, not_before_ms of a processed message.

    A broken contract goes to the dead letters at once; a transient failure is tried again later until its attempts
    are used up; everything else goes on.
    """
    later = F.coalesce(transient, F.lit(False))
    used_up = attempt >= MOST_ATTEMPTS
    topic = F.when(error.isNotNull() | later & used_up, DEAD).when(later, RETRY).otherwise(to)
    code = F.when(error.isNotNull(), error).when(later & used_up, "TRANSIENT_RETRIES_EXHAUSTED").when(later, "TRANSIENT_PROCESSING_ERROR")
    again = (topic == RETRY) & error.isNull()
    return F.struct(topic.alias("topic"), code.alias("error_code"), F.when(again, attempt + 1).otherwise(attempt).alias("attempt"), F.when(again, now_ms + delay_seconds(attempt) * 1000).alias("not_before_ms"))


def retry_route(stage: Column, not_before: Column, now_ms: Column) -> Column:
    """Where a held message goes now: its stage if due, ``hold`` if not, the dead letters if its stage or time makes no sense."""
    due = F.coalesce(not_before.cast("string"), F.lit("0")).try_cast("long")
    bad = ~F.coalesce(stage.isin(*STAGES), F.lit(False)) | due.isNull() | (due < 0) | (due > now_ms + HORIZON_MS)
    return F.when(bad, DEAD).when(due > now_ms, "hold").otherwise(stage)


def parsed_decisions(raw: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Parser stage over envelopes: the parsed event and its decision."""
    now_ms = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    rows = raw.withColumns({"_error": contract_error(), "payload": F.try_to_binary("raw_payload_b64", F.lit("base64"))})
    none = F.lit(False) if "transient" not in raw.columns else F.col("transient")
    attempt = attempt_of(F.col("attempt")) if "attempt" in raw.columns else F.lit(0)
    return parse(rows).withColumn("decision", decide(F.col("_error"), none, attempt, PARSED, now_ms)).drop("_error")


def topic(spark: SparkSession, root: str, name: str, schema, per_batch: int = 64) -> DataFrame:
    """A topic as stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/{name}")


#: Rows of a topic's file at most: a batch takes a number of files.
FILE_ROWS = 250_000


def publish(rows: DataFrame, root: str, name: str) -> None:
    rows.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(f"{root}/{name}")


def dead_letters(rows: DataFrame, code: Column) -> DataFrame:
    """Envelopes as dead letters: the bytes and their hash as key; where the base64 can't be decoded, its own text stands for them, and is kept."""
    coded = F.encode(F.coalesce("raw_payload_b64", F.lit("")), "utf-8")
    payload = F.try_to_binary("raw_payload_b64", F.lit("base64"))
    undecoded = payload.isNull() & F.col("raw_payload_b64").isNotNull()
    return rows.select("event_id", F.sha2(F.coalesce(payload, coded), 256).alias("key"), payload.alias("payload"), F.when(undecoded, F.col("raw_payload_b64")).alias("raw_payload_b64"), code.alias("error_code"))


def run_pipeline(
    spark: SparkSession, root: str, schema, out: str, checkpoint: str, transient: Column | None = None, now_ms: Column | None = None, plug: Callable[[DataFrame], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """From envelopes to the event table, quarantine, dead letters, retries, normalised events and metrics.

    Each batch is written under its own number, so a batch that runs again replaces itself. ``transient`` says of an
    envelope (with its ``attempt``, 0 at first) whether processing fails for now; such envelopes are held in the retry
    topic until ``release_due`` feeds them back, for which ``schema`` must have ``attempt``. The clock is a column
    of the batch; what is parsed and validated is kept as files until the batch's writes are done, so executors hold
    none of it, however large the batch. ``plug`` is code from outside over the
    envelopes, columns and all; rows on which it raises are isolated and go to the dead letters as POISON_MESSAGE,
    while the others go on.
    """
    columns = schema.fieldNames()

    def write(batch: DataFrame, number: int) -> None:
        put = lambda rows, name: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch={number}")

        def kept(rows: DataFrame, name: str) -> DataFrame:
            put(rows, name)
            return batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/{name}/batch={number}")

        clock = {"_now_ms": now_ms if now_ms is not None else F.unix_millis(F.current_timestamp()), "_now": F.current_timestamp()}
        lost = None
        if plug is not None:
            batch, lost = isolated(batch, plug, f"{out}/_isolated/batch={number}")
        timed = computed_once(spread(batch).withColumns(clock), "clock")
        try:
            decided = kept(parsed_decisions(timed if transient is None else timed.withColumn("transient", transient), F.col("_now_ms")), "_decided")
            to = lambda name: decided.where(F.col("decision.topic") == name)
            good = kept(validate(normalize(to(PARSED), F.col("_now"))).select("event_id", *SECTIONS, "validation", "storable"), "_validated")
            stored = kept(event_rows(good.where("storable")), "events")
            put(stored.select("event_id", "normalized_json"), NORMALIZED)
            put(quarantine_rows(good).withColumn("event_id", F.col("event_id").cast("string")), "quarantine")
            dead = dead_letters(to(DEAD), F.col("decision.error_code"))
            put(dead if lost is None else dead.unionByName(dead_letters(lost, F.lit("POISON_MESSAGE"))), DEAD)
            put(to(RETRY).select(*[c for c in columns if c != "attempt"], "decision.attempt", "decision.not_before_ms", F.lit(STAGES[0]).alias("stage")), RETRY)
            put(decided.groupBy("decision.topic").agg(F.count("*").alias("n")), METRICS)
        finally:
            for name in ("_decided", "_validated"):
                dropped(batch.sparkSession, f"{out}/{name}/batch={number}")

    return topic(spark, root, RAW, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def release_due(spark: SparkSession, root: str, schema, out: str, now_ms: Column | None = None) -> int:
    """Feeds held envelopes that are due back into the raw topic and those with a senseless stage or time to the dead letters; returns how many still wait or were fed back.

    An envelope goes on once per attempt: what is already in the raw topic or the dead letters isn't sent again.
    """
    now_ms = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    names = [f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != "attempt"]
    held = spark.read.option("recursiveFileLookup", "true").schema(", ".join([*names, "attempt int", "not_before_ms long", "stage string"])).parquet(f"{out}/{RETRY}")
    sent = spark.read.schema(schema).parquet(f"{root}/{RAW}").select("event_id", F.col("attempt").cast("int").alias("attempt"))
    dead = spark.read.option("recursiveFileLookup", "true").schema("event_id string").parquet(f"{out}/{DEAD}")
    left = held.join(sent, ["event_id", "attempt"], "left_anti").join(dead, "event_id", "left_anti")
    routed = left.withColumn("_route", retry_route(F.col("stage"), F.col("not_before_ms"), now_ms)).persist(StorageLevel.DISK_ONLY)
    try:
        open_ = routed.where(F.col("_route") != DEAD).count()
        lost = dead_letters(routed.where(F.col("_route") == DEAD), F.lit("INVALID_RETRY_HEADERS"))
        lost.write.mode("append").parquet(f"{out}/{DEAD}/released")
        due = routed.where(F.col("_route").isin(*STAGES)).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        publish(spread(due), root, RAW)  # a file a task: those of a shuffle are many and small, and would make as many batches
        return open_
    finally:
        routed.unpersist()


def live_rollup(rows: DataFrame, ts: str = "ts", seconds: int = 5, late: str = "10 minutes") -> DataFrame:
    """Counts per source in tumbling windows of a stream; state ends with the watermark."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), "source_id").agg(F.count("*").alias("n"))
