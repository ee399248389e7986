"""Collection: decoding, rejection, envelopes with evidence, duplicate flags, archive and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES, SAMPLE_BYTES = 65_536, 512


def payload_of(raw_text: str = "raw_text", raw_base64: str = "raw_base64") -> Column:
    """Bytes from exactly one of text and strict base64; null otherwise."""
    text, coded = F.col(raw_text), F.col(raw_base64)
    return F.when(text.isNotNull() & coded.isNull(), F.encode(text, "utf-8")).when(coded.isNotNull() & text.isNull(), F.try_to_binary(coded, F.lit("base64")))


def rejection(payload: Column, most_bytes: int = MOST_BYTES) -> Column:
    """Why a payload can't be taken; null if it can."""
    return F.when(payload.isNull(), "invalid_payload").when(F.length(payload) == 0, "empty_event").when(F.length(payload) > most_bytes, "oversized_event")


def read_lines(spark: SparkSession, path: str, source: str = "file-replay") -> DataFrame:
    """The events of log files, one a line: exactly the bytes up to a line feed, carriage returns included, empty lines too; the last line may lack its feed.

    Ids follow from the file's name, the line's bytes and how many equal lines stand before it in the file, whatever the
    splits: a file that is read again, beside others or not, gives the same. Equal lines are numbered within a split,
    and the splits before it are added by their counts, so lines that are very common, as empty ones, don't meet in one task.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    name, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    placed = lines.select(F.col("value").cast("binary").alias("payload"), name.alias("file"), start.alias("block"), F.monotonically_increasing_id().alias("place")).withColumn("sum", F.sha2("payload", 256))
    inside = placed.withColumn("nth", F.row_number().over(Window.partitionBy("file", "sum", "block").orderBy("place")) - 1)
    earlier = Window.partitionBy("file", "sum").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("file", "sum", "block").agg(F.count("*").alias("n")).select("file", "sum", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = inside.join(before, ["file", "sum", "block"])
    digest = F.sha2(F.concat_ws(":", "file", (F.col("before") + F.col("nth")).cast("string"), F.hex("payload")), 256)
    cut = lambda at, size: F.substring(digest, at, size)
    named = F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(13, 3)), F.concat(F.lit("8"), cut(16, 3)), cut(19, 12))
    fixed = {"ingested_at": F.current_timestamp(), "source_id": F.lit(source), "source_ip": F.lit(None).cast("string"), "transport": F.lit("file")}
    return placed.select(named.alias("event_id"), *[c.alias(n) for n, c in fixed.items()], "payload")


def replay_summary(replayed: DataFrame) -> DataFrame:
    """Attempted, published and failed events of a replay, and how often each error came."""
    codes = replayed.groupBy("error_code").agg(F.count("*").alias("n"))
    return codes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"), F.coalesce(F.sum(F.when(F.col("error_code").isNull(), F.col("n"))), F.lit(0)).alias("published"), F.coalesce(F.sum(F.when(F.col("error_code").isNotNull(), F.col("n"))), F.lit(0)).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("error_code").isNotNull(), F.concat_ws("=", "error_code", F.col("n").cast("string"))))), ",").alias("errors"))


def health(ingested: DataFrame, latency_ms: str, order: str, last: int = 1000) -> DataFrame:
    """Received, accepted, rejected and duplicate events, and the mean latency of the ``last`` ones to three places."""
    recent = ingested.orderBy(F.col(order).desc()).limit(last).agg(F.round(F.avg(latency_ms), 3).alias("latency_mean_ms"))
    counts = ingested.agg(F.count("*").alias("received"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return counts.join(recent)


def ingest(raw: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``raw`` (event_id, source_id, source_ip, payload and more) with reason, raw_size, raw_sha256 and a fallback for source_id."""
    return raw.withColumns({
        "reason": rejection(F.col("payload"), most_bytes),
        "raw_size": F.length("payload").cast("long"),
        "raw_sha256": F.sha2("payload", 256),
        "source_id": F.coalesce("source_id", "source_ip", F.lit("unknown")),
    })


def rejected(ingested: DataFrame) -> DataFrame:
    """The rejection log: reason, size, hash and at most 512 bytes of the payload as text."""
    sample = F.make_valid_utf8(F.substring("payload", 1, SAMPLE_BYTES).cast("string"))
    return ingested.where("reason is not null").select("event_id", "source_id", "reason", "raw_size", "raw_sha256", sample.alias("sample"))


def flag_duplicates(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """``rows`` with duplicate: whether the digest was seen at an earlier place. Nothing is dropped.

    First places are aggregated per digest, with partial results, and joined back: one digest may have any number of rows.
    """
    first = rows.groupBy(digest).agg(F.min(order).alias("_first"))
    return rows.join(first, digest).withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def envelope(ingested: DataFrame, collector: str = "vantalog", version: str = "1.0.0") -> DataFrame:
    """Accepted events on the wire: base64 payload, size and hash for whoever reads them."""
    return ingested.where("reason is null").select(F.lit("1.0.0").alias("contract_version"), "event_id", "ingested_at", "source_id", "source_ip", "transport", F.base64("payload").alias("raw_payload_b64"), "raw_size", "raw_sha256", F.lit(collector).alias("collector_id"), F.lit(version).alias("collector_version"))


def contract_error(prefix: str = "") -> Column:
    """INVALID_RAW_CONTRACT for an envelope whose base64, size, hash, id or transport is wrong; null for a good one."""
    c = lambda n: F.col(prefix + n)
    raw = F.try_to_binary(c("raw_payload_b64"), F.lit("base64"))
    good = raw.isNotNull() & (F.length(raw) == c("raw_size")) & (F.sha2(raw, 256) == c("raw_sha256")) & c("event_id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") & c("transport").isin("udp", "tcp", "file", "api", "replay") & (c("contract_version") == "1.0.0") & c("ingested_at").isNotNull() & c("source_id").isNotNull()
    return F.when(~F.coalesce(good, F.lit(False)), "INVALID_RAW_CONTRACT")


def archive(ingested: DataFrame, path: str) -> None:
    """Exact bytes and their metadata, by day, with filters on id and hash in every file, so that a point read passes over all row groups that can't have it."""
    rows = ingested.where("reason is null").withColumn("day", F.to_date("ingested_at"))
    rows.write.options(**bloom_filters("event_id", "raw_sha256")).mode("append").partitionBy("day").parquet(path)


def bloom_filters(*columns: str, most: int = 1_000_000) -> dict[str, str]:
    """Options of a Parquet writer that gives every row group a Bloom filter of each column, sized for at most ``most`` values."""
    return {f"parquet.bloom.filter.{option}#{c}": value for c in columns for option, value in (("enabled", "true"), ("expected.ndv", str(most)), ("adaptive.enabled", "true"))}


#: Values that a point read hands to the files; Spark hands over longer lists as a range only.
MOST_POINTS = 10


def points(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The rows whose ``column`` is one of a few values: the files' statistics and Bloom filters decide which row groups are read at all. More values than ``MOST_POINTS`` are for ``store.lookup``."""
    if len(values) > MOST_POINTS:
        raise ValueError(f"a point read takes at most {MOST_POINTS} values")
    found = F.lit(False)
    for v in values:
        found = found | (F.col(column) == v)
    return rows.where(found)


def archived_event(archived: DataFrame, event_id: str) -> DataFrame:
    """The archived event of that id, read by point. Nothing if it isn't there whole: bytes and metadata make a pair, and the bytes must have the recorded hash."""
    return points(archived, "event_id", [event_id]).where(F.col("payload").isNotNull() & (F.sha2("payload", 256) == F.col("raw_sha256")))


def replay(archived: DataFrame, asked: DataFrame) -> DataFrame:
    """A row per asked event_id with error_code: ARCHIVE_READ_FAILED if it isn't archived, ARCHIVE_VALIDATION_FAILED if its bytes don't have its hash; else its payload."""
    have = archived.select("event_id", "payload", "raw_sha256")
    joined = asked.select("event_id").join(have, "event_id", "left")
    code = F.when(F.col("payload").isNull(), "ARCHIVE_READ_FAILED").when(F.sha2("payload", 256) != F.col("raw_sha256"), "ARCHIVE_VALIDATION_FAILED")
    return joined.withColumn("error_code", code).withColumn("payload", F.when(F.col("error_code").isNull(), F.col("payload")))


def replay_since(archived: DataFrame, since: str) -> DataFrame:
    return archived.where(F.col("ingested_at") >= F.lit(since).cast("timestamp"))


def split_frames(stream: bytes, most_bytes: int = MOST_BYTES) -> tuple[list[bytes], bytes]:
    """Newline-framed events of a connection's bytes, and the unfinished rest. A frame over the limit is given as it is, for rejection."""
    *frames, rest = stream.split(b"\n")
    return ([*frames, rest], b"") if len(rest) > most_bytes else (frames, rest)
