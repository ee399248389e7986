"""Delivery: CEF and RFC 5424 lines, and what an index's answers mean for each event."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utc_z

VENDOR, PRODUCT, APP = "Vantalog", "Engine", "vantalog"


def _escaped(text: Column, extension: bool = False) -> Column:
    out = text.cast("string")
    for a, b in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("|", "\\|"), *([("=", "\\=")] if extension else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cef_line(vendor: str = VENDOR, product: str = PRODUCT) -> Column:
    """A unified event as one CEF line; absent parts are left out."""
    c = F.col
    pairs = [("schemaVersion", F.lit("1.0.0")), ("externalId", c("event.id")), ("rawSha256", c("traceability.raw_sha256")), ("sourcePack", c("traceability.source_pack.name")), ("sourcePackVersion", c("traceability.source_pack.version")), ("parser", c("traceability.parser.name")), ("parserVersion", c("traceability.parser.version")), ("quality", c("quality.status")), ("act", c("action.normalized")), ("msg", F.nullif(c("event.message"), F.lit(""))), ("src", c("source.ip")), ("spt", c("source.port")), ("dst", c("destination.ip")), ("dpt", c("destination.port"))]
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit("1.0.0"), _escaped(c("event.type")), _escaped(c("event.name")), c("severity.normalized").cast("string"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *[F.concat(F.lit(k + "="), _escaped(v, True)) for k, v in pairs]))


def rfc5424_line(app: str = APP, enterprise: str = "32473") -> Column:
    """A unified event as one RFC 5424 line."""
    c = F.col
    param = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("]"), F.lit("\\]"))
    token = lambda v: F.left(F.regexp_replace(F.coalesce(F.nullif(v, F.lit("")), F.lit("-")), "[^!-~]", "_"), F.lit(48))
    pairs = [("schemaVersion", F.lit("1.0.0")), ("eventId", c("event.id")), ("rawSha256", c("traceability.raw_sha256")), ("sourcePack", c("traceability.source_pack.name")), ("sourcePackVersion", c("traceability.source_pack.version")), ("parser", c("traceability.parser.name")), ("parserVersion", c("traceability.parser.version")), ("quality", c("quality.status"))]
    data = F.concat_ws(" ", *[F.concat(F.lit(f'{k}="'), param(v), F.lit('"')) for k, v in pairs])
    message = F.regexp_replace(F.coalesce(F.nullif(c("event.message"), F.lit("")), c("event.name")), "[\r\n]", " ")
    priority = (128 + F.least(F.greatest(c("severity.normalized"), F.lit(0)), F.lit(7))).cast("string")
    return F.concat(F.lit("<"), priority, F.lit(">1 "), utc_z(c("time.observed_at")), F.lit(" "), token(c("observer.hostname")), F.lit(f" {app} - "), token(c("event.type")), F.lit(f" [{app}@{enterprise} "), data, F.lit("] "), message)


def outcome(status: Column) -> Column:
    """delivered, retryable (408, 429 and 5xx) or terminal, by an item's HTTP status."""
    return F.when(status.between(200, 299), "delivered").when(status.isin(408, 429) | status.between(500, 599), "retryable").otherwise("terminal")


def reconcile(items: DataFrame) -> DataFrame:
    """attempted, delivered, retryable, terminal of answered items, and whether they add up."""
    what = outcome(F.col("status"))
    one = items.agg(F.count("*").alias("attempted"), *[F.count_if(what == k).alias(k) for k in ("delivered", "retryable", "terminal")])
    return one.withColumn("reconciled", F.col("attempted") == F.col("delivered") + F.col("retryable") + F.col("terminal"))


def decision(result: Column, attempt: Column, most: int = 5) -> Column:
    """ack, retry or dead_letter for an outcome."""
    return F.when(result == "delivered", "ack").when((result == "retryable") & (attempt < most), "retry").otherwise("dead_letter")


def send(rows: DataFrame, transport: Callable[[list[str]], list[int]], chunk: int = 500) -> DataFrame:
    """event_id and status after delivery through ``transport`` (documents to statuses) in chunks. A failed call or a wrong number of answers makes its whole chunk retryable (503)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), chunk):
                own = part.iloc[at : at + chunk]
                try:
                    statuses = list(transport(own["document"].tolist()))
                except Exception:  # whatever the transport raises: the events stay to be sent again
                    statuses = []
                yield pd.DataFrame({"event_id": own["event_id"], "status": statuses if len(statuses) == len(own) else [503] * len(own)})

    return rows.select("event_id", "document").mapInPandas(run, "event_id string, status int")
