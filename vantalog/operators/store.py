"""The event table and what is asked of it: projections, latest versions, search, aggregations, dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_token
from ..plans.normalize import LABELS, STATUSES, unified_json
from .collect import bloom_filters, points


def event_rows(events: DataFrame, *kept: str) -> DataFrame:
    """The flat search columns of unified events beside the whole JSON text, and columns that are ``kept``. Missing addresses are empty, missing ports null."""
    c = F.col
    return events.select(
        "event_id", c("time.observed_at").alias("observed_at"), c("time.ingested_at").alias("ingested_at"), c("time.normalized_at").alias("normalized_at"),
        c("observer.vendor").alias("vendor"), c("observer.product").alias("product"), c("event.category").alias("category"), c("event.type").alias("event_type"),
        c("action.normalized").alias("action"), c("severity.normalized").alias("severity"), c("severity.label").alias("severity_label"),
        F.coalesce("source.ip", F.lit("")).alias("source_ip"), c("source.port").alias("source_port"), F.coalesce("destination.ip", F.lit("")).alias("destination_ip"), c("destination.port").alias("destination_port"),
        c("quality.status").alias("quality_status"), c("traceability.raw_event_id").alias("raw_event_id"), c("traceability.raw_sha256").alias("raw_sha256"),
        c("traceability.source_pack.name").alias("source_pack_name"), c("traceability.source_pack.version").alias("source_pack_version"), c("traceability.parser.name").alias("parser_name"), c("traceability.parser.version").alias("parser_version"),
        unified_json().alias("normalized_json"), *kept,
    )


def quarantine_rows(validated: DataFrame) -> DataFrame:
    """Events that can't be stored, with path:rule codes."""
    codes = F.transform("validation", lambda i: F.concat_ws(":", i.path, i.rule))
    codes = F.concat(codes, F.when(F.col("quality.status") == "invalid", F.array(F.lit("$.quality.status:invalid"))).otherwise(F.array().cast("array<string>")))
    return validated.where(~F.col("storable")).select("event_id", F.col("traceability.raw_sha256").alias("raw_sha256"), unified_json().alias("payload_json"), codes.alias("error_codes"), F.col("time.normalized_at").alias("quarantined_at"))


def write_events(validated: DataFrame, path: str) -> None:
    """Events and quarantine below ``path``: by month, in ranges of time and id that Spark sizes, so that scans prune and skip, with Bloom filters on id and hash. ``vendor_key`` is the vendor in lower case, for searches that reach the files."""
    _append(validated.where("storable"), F.col("time.observed_at"), path, lambda r: event_rows(r, "month"))
    quarantine_rows(validated).write.mode("append").parquet(f"{path}/quarantine")


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends event rows to the table; ``stored_at`` and ``stored_row`` tell equal versions of an event apart."""
    _append(rows, F.col("observed_at"), path, lambda r: r)


def _append(rows: DataFrame, observed_at: Column, path: str, project: Callable[[DataFrame], DataFrame]) -> None:
    """Appends what ``project`` makes of ``rows``. It stands above the exchange: ranges are found by a pass of its own over the rows, in which nothing is projected, so the JSON is made once."""
    keys = ("month", "_observed_at", "event_id")
    ranged = rows.withColumns({"month": F.date_format(observed_at, "yyyyMM"), "_observed_at": observed_at}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    more = {"vendor_key": F.lower("vendor"), "stored_at": F.current_timestamp(), "stored_row": F.monotonically_increasing_id()}
    project(ranged).drop("_observed_at").withColumns(more).write.option("compression", "zstd").options(**bloom_filters("event_id", "raw_sha256")).mode("append").partitionBy("month").parquet(f"{path}/events")


def quarantine_payload(message: Column, payload: Column) -> Column:
    """The quarantine row of a message that isn't a JSON object: its bytes as base64 and their hash, with the one code for it; null for JSON objects."""
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(F.when(F.is_valid_utf8(payload.cast("string")), payload.cast("string")))).startswith("OBJECT"), F.lit(False))
    return F.when(~good, F.struct(message.alias("event_id"), F.sha2(F.coalesce(payload, F.lit(b"")), 256).alias("raw_sha256"), F.base64(payload).alias("payload_base64"), F.array(F.lit("INVALID_NORMALIZED_JSON")).alias("error_codes")))


def latest(rows: DataFrame, keys: tuple[str, ...] = ("observed_at", "event_id"), version: tuple[str, ...] = ("normalized_at",)) -> DataFrame:
    """Of the rows of a key, the one of the highest version. One aggregation with partial results; no key is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def current(rows: DataFrame) -> DataFrame:
    """Of every stored event the version that counts: of the highest normalized_at, and of several such the one stored last.

    Only keys and versions are aggregated; the rows themselves are asked whether they are the version that counts. So
    facets asked of the result reach the files below, a time range reaches both scans, and no JSON moves for rows that
    a facet leaves out.
    """
    keys = [k for k in ("month", "observed_at", "event_id") if k in rows.columns]
    version = F.struct("normalized_at", "stored_at", "stored_row")
    newest = rows.select(*keys, version.alias("_v")).groupBy(*keys).agg(F.max("_v").alias("_v")).select(*keys, "_v.*")
    return rows.join(newest, [*keys, "normalized_at", "stored_at", "stored_row"], "left_semi")


#: Rows of a file that one bitmap tells of: 4 KB, as ``bitmap_construct_agg`` makes them.
_BITS = 32_768


def current_all(files: DataFrame) -> DataFrame:
    """``current`` for passes over a whole table as it lies in files: its rows stay where they are, only keys, versions and places move.

    Of every key the place (file and row) of the version that counts is aggregated, and places become bitmaps, a bit a
    stored row, against which each row is held as it is read. Facets reach the scan of the rows, but time ranges and
    ids don't reach that of the keys, so searches and point reads ask ``current``.
    """
    keys = [k for k in ("month", "observed_at", "event_id") if k in files.columns]
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = files.withColumns({"_file": file, "_block": F.floor(row / _BITS), "_bit": (row % _BITS).cast("int")})
    version = F.struct("normalized_at", "stored_at", "stored_row", "_file", "_block", "_bit").alias("_v")
    newest = placed.select(*keys, version).groupBy(*keys).agg(F.max("_v").alias("_v")).select("_v._file", "_v._block", "_v._bit")
    counting = newest.groupBy("_file", "_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(counting), ["_file", "_block"]).where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*files.columns)


def month_range(start: str | None, end: str | None) -> Column:
    """The partitions that a time range can touch."""
    out = F.lit(True)
    if start:
        out = out & (F.col("month") >= F.date_format(F.lit(start).cast("timestamp"), "yyyyMM"))
    if end:
        out = out & (F.col("month") <= F.date_format(F.lit(end).cast("timestamp"), "yyyyMM"))
    return out


def search(rows: DataFrame, vendor=None, category=None, action=None, severity=None, quality=None, text=None, start=None, end=None, limit: int | None = 50) -> DataFrame:
    """Facets (any case; None and "all" don't filter), free text over the JSON, a half-open time range; newest first, 1 to 500 rows (None: all)."""
    # Categories, actions, labels and statuses are lower-case by the schema, so their filters reach the files.
    named = F.col("vendor_key") if "vendor_key" in rows.columns else F.lower("vendor")
    for column, value in ((named, vendor), (F.col("category"), category), (F.col("action"), action), (F.col("severity_label"), severity), (F.col("quality_status"), quality)):
        if value is not None and value.lower() != "all":
            rows = rows.where(column == value.lower())
    if text:
        rows = rows.where(F.lower("normalized_json").contains(text.lower()))
    if start is not None:
        rows = rows.where(F.col("observed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("observed_at") < F.lit(end).cast("timestamp"))
    if "month" in rows.columns:
        rows = rows.where(month_range(start, end))
    return rows if limit is None else rows.orderBy(F.col("observed_at").desc(), "event_id").limit(min(max(limit, 1), 500))


def lookup(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The latest version of every row whose id or hash is asked for."""
    return latest(rows.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi"), (column,))


def point(rows: DataFrame, column: str, *values: str) -> DataFrame:
    """``lookup`` for a few ids or hashes: only row groups that can have them are read."""
    return latest(points(rows, column, list(values)), (column,))


def summary(rows: DataFrame) -> DataFrame:
    """Totals of events, allowed and denied actions, and their shares of all decisions in per mille, half up."""
    allow, deny = F.count_if(F.col("action").isin("allow", "connect", "authenticate")), F.count_if(F.col("action").isin("deny", "block"))
    one = rows.agg(F.count_distinct("event_id").alias("total_events"), allow.alias("allow_events"), deny.alias("deny_events"))
    decided = F.col("allow_events") + F.col("deny_events")
    share = lambda n: F.when(decided > 0, F.floor((F.col(n) * 2000 + decided) / (decided * 2))).otherwise(0).cast("long")
    return one.withColumns({"allow_per_mille": share("allow_events"), "deny_per_mille": share("deny_events")})


def by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vendor", "product").agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Counts of all the names, zeros included, and of unexpected values: one aggregation over the rows and one zero a name."""
    zeros = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(column), F.lit(0).cast("long").alias("n"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def severity_distribution(rows: DataFrame) -> DataFrame:
    return distribution(rows, "severity_label", LABELS)


def quality_distribution(rows: DataFrame) -> DataFrame:
    return distribution(rows, "quality_status", STATUSES)


def action_buckets(rows: DataFrame) -> DataFrame:
    bucket = F.when(F.col("action").isin("allow", "connect", "authenticate"), "allow").when(F.col("action").isin("deny", "block"), "deny").when(F.col("action") == "detect", "detect").otherwise("other")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def per_minute(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.date_trunc("MINUTE", "observed_at").alias("minute")).agg(F.count("*").alias("n"))


def facet(rows: DataFrame, column: str, vendor: str | None = None) -> DataFrame:
    """Distinct values, of one vendor's rows if asked."""
    return (rows.where(F.col("vendor") == vendor) if vendor else rows).select(column).distinct()


#: The columns whose values a dashboard offers for choice.
FACETS = ("vendor", "product", "category", "action", "severity_label", "quality_status")


def facets(rows: DataFrame, columns: tuple[str, ...] = FACETS, vendor: str | None = None) -> DataFrame:
    """facet, value: the distinct values of several columns in order, of one vendor's rows if asked; one pass over the rows."""
    chosen = rows.where(F.col("vendor") == vendor) if vendor else rows
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return chosen.select(F.explode(pairs).alias("pair")).select("pair.*").distinct().orderBy("facet", "value")


def source_shares(rows: DataFrame) -> DataFrame:
    """Events of each vendor and product and their share of all in whole per cent, half up."""
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row a product by now
    return by_source(rows).withColumn("percent", F.floor((F.col("n") * 200 + every) / (every * 2)).cast("long"))


def totals(rows: DataFrame) -> DataFrame:
    """Rows as they are, repeats counted, and distinct events."""
    return rows.agg(F.count("*").alias("total"), F.count_distinct("event_id").alias("distinct_events"))


def quarantine_summary(quarantine: DataFrame, start: str | None = None, end: str | None = None, failure: str = "STORAGE_WRITE_FAILED") -> DataFrame:
    """Quarantined events of a half-open time range, and those among them whose codes name a failed write."""
    at = F.col("quarantined_at")
    inside = F.lit(True) if start is None else at >= F.lit(start).cast("timestamp")
    inside = inside if end is None else inside & (at < F.lit(end).cast("timestamp"))
    return quarantine.where(inside).agg(F.count("*").alias("quarantined"), F.count_if(F.array_contains("error_codes", failure)).alias("storage_failures"))


def newest_inserted(rows: DataFrame, order: str, limit: int = 100) -> DataFrame:
    """The rows that were inserted last, newest first."""
    return rows.orderBy(F.col(order).desc()).limit(max(1, limit))


def contains_any(text: str, *columns: str) -> Column:
    """Whether one of the columns holds the text, in any case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return found


#: Columns of the two tables that an investigation shows.
INVESTIGATION = ("observed_at", "event_id", "vendor", "product", "category", "event_type", "action", "severity", "severity_label", "source_ip", "source_port", "destination_ip", "destination_port", "quality_status", "source_pack_name", "parser_name", "raw_sha256")
PROVENANCE = ("event_id", "raw_event_id", "raw_sha256", "source_pack_name", "source_pack_version", "parser_name", "parser_version", "normalized_at")


def investigation(rows: DataFrame, columns: tuple[str, ...] = INVESTIGATION, limit: int = 500) -> DataFrame:
    """The newest rows with an investigation's columns."""
    return rows.orderBy(F.col("observed_at").desc(), "event_id").limit(limit).select(*columns)


def matching(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """A dashboard's facet by regular expression; ``.*`` is all."""
    return rows if pattern == ".*" else rows.where(F.col(column).rlike(pattern))


def kpis(rows: DataFrame) -> DataFrame:
    """High and critical events, and valid ones in whole per cent, half up."""
    total = F.count("*")
    return rows.agg(total.alias("total"), F.count_if(F.col("severity_label").isin("high", "critical")).alias("high"), F.floor((F.count_if(F.col("quality_status") == "valid") * 200 + total) / (total * 2)).cast("long").alias("valid_percent"))


def lake_rows(rows: DataFrame) -> DataFrame:
    """The lake's columns with its partition keys; events that aren't valid belong to the quarantine."""
    part = lambda form: F.coalesce(F.date_format("observed_at", form), F.lit("unknown"))
    return rows.select(F.lit("1.0.0").alias("schema_version"), "event_id", F.col("category").alias("event_category"), "observed_at", "raw_event_id", "raw_sha256", F.col("vendor").alias("observer_vendor"), F.col("product").alias("observer_product"), "quality_status", "normalized_json", (F.coalesce("quality_status", F.lit("valid")) != "valid").alias("quarantined"), part("yyyy").alias("year"), part("MM").alias("month"), part("dd").alias("day"), safe_token(F.col("category")).alias("category"))
