"""The queries over the given tables, and the SQL each must agree with.

The SQL never parses a log line: it derives the expected fields from the columns the lines were rendered from.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions.text import any_timestamp, computed_once, shuffles_dropped, small_methods, utc_z, valid_ip
from ..operators import collect, deliver, export, metrics, store
from ..operators.validate import structural_issues, validate
from ..sources.events import render, spread, table, uuid_of
from ..sources.shared import new_path
from ..streaming import stages
from .normalize import SECTIONS, normalize
from .packs import parse, parse_only

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: x: the expected outcome of every event, from arithmetic alone.
_X = """
x0 AS (SELECT event_id AS e, user_id AS u, ts, value, event_id % 7 AS k, event_id // 7 AS m FROM events),
x1 AS (SELECT *, printf('00000000-0000-4000-8000-%012d', e) AS id, ts + INTERVAL 5 SECOND AS ingested,
    printf('10.%d.%d.%d', u % 250, e % 250, e % 200 + 1) AS sip, printf('198.51.100.%d', e % 254 + 1) AS dip,
    1024 + e % 50000 AS sport, [443, 80, 22, 53][e % 4 + 1] AS dport,
    CASE WHEN k IN (0, 1) THEN 'cisco_asa' WHEN k IN (2, 3) THEN 'fortinet_fortigate' WHEN k = 4 THEN 'generic_linux_syslog' WHEN k = 5 THEN 'suricata_eve' END AS pack,
    CASE WHEN k = 1 AND m % 4 = 3 THEN 'partial' WHEN k = 4 AND m % 3 = 2 OR k = 5 AND m % 5 = 4 THEN 'failed' WHEN k = 6 THEN 'unrecognized' ELSE 'success' END AS status,
    CASE WHEN k = 0 OR k = 1 AND m % 4 <> 3 OR k = 2 THEN 'network' WHEN k = 3 THEN 'authentication' WHEN k = 4 THEN 'system' WHEN k = 5 THEN ['intrusion_detection', 'network', 'network', 'web', 'web'][m % 5 + 1] ELSE 'unknown' END AS category,
    CASE WHEN k = 0 THEN 'deny' WHEN k = 1 THEN ['allow', 'disconnect', 'allow', 'unknown'][m % 4 + 1] WHEN k = 2 THEN ['allow', 'block'][m % 2 + 1] WHEN k = 3 THEN 'authenticate' WHEN k = 5 AND m % 5 = 0 THEN ['block', 'detect'][e % 2 + 1] WHEN k = 5 THEN 'connect' ELSE 'unknown' END AS action,
    CASE WHEN k = 0 THEN 5 WHEN k = 1 THEN [2, 2, 4, 4][m % 4 + 1] WHEN k = 2 THEN [4, 5][m % 2 + 1] WHEN k = 3 THEN 2 WHEN k = 4 AND m % 3 <> 2 THEN [10, 9, 8, 7, 5, 4, 2, 0][e % 8 + 1] WHEN k = 5 AND m % 5 = 0 THEN [8, 5, 2, 0][e % 4 + 1] ELSE 0 END AS score,
    CASE WHEN k = 4 AND m % 3 = 2 OR k = 6 OR k = 5 AND m % 5 = 0 AND e % 4 = 3 THEN 'unknown' WHEN score = 0 THEN 'informational' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' ELSE 'critical' END AS label
  FROM x0),
x AS (SELECT *, CASE WHEN status = 'failed' OR k = 5 AND label = 'unknown' THEN 'invalid' WHEN k = 6 THEN 'unknown' WHEN status = 'partial' OR k = 2 THEN 'partial' ELSE 'valid' END AS quality,
    CASE WHEN k = 5 THEN ts ELSE ingested END AS observed,
    CASE WHEN k IN (0, 1) THEN 'Cisco' WHEN k IN (2, 3) THEN 'Fortinet' WHEN k = 4 THEN 'Generic' WHEN k = 5 THEN 'OISF' ELSE 'unknown' END AS vendor,
    CASE WHEN k IN (0, 1) THEN 'ASA' WHEN k IN (2, 3) THEN 'FortiGate' WHEN k = 4 THEN 'Linux Syslog' WHEN k = 5 THEN 'Suricata' ELSE 'unknown' END AS product,
    k = 0 OR k = 1 AND m % 4 <> 3 OR k IN (2, 5) AS ends
  FROM x1)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL; a leading ``x:`` puts the expected outcomes before it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {_X} {sql[2:]}" if sql.startswith("x:") else sql
        return f

    return register


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spread(table(spark, sf_dir, "events")))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines as accepted envelopes. Lines are made once, after they were dealt: what asks whether a line is accepted would else be asked of the files' splits, and make them a second time."""
    return collect.envelope(collect.ingest(computed_once(raw(spark, sf_dir), "rendered")))


_STORED: dict[tuple, str] = {}


def _versions(spark: SparkSession, rows: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of writing of the files behind ``rows``: a file that is written anew under its name is another."""
    found = []
    for name in sorted(rows.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def _written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A folder below which ``write`` has put its tables: once an application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _versions(spark, table(spark, sf_dir, "events")))
    if key not in _STORED:
        path = new_path(spark, name)
        with small_methods(spark), shuffles_dropped(spark):
            write(path)
        _STORED[key] = path
    return _STORED[key]


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the unified schema, those that can't be stored too; written once an application and input. The payload and its fields are written once, as parts of the sections."""

    def write(path: str) -> None:
        made = validate(normalize(parse(raw(spark, sf_dir)), F.col("ingested_at") + F.expr("INTERVAL 1 SECOND")))
        made.select("event_id", "pack", *SECTIONS, "validation", "storable").write.option("compression", "zstd").parquet(path)

    return spark.read.parquet(_written(spark, sf_dir, "unified", write))


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the event table and the quarantine made from the unified events: written once an application and input, then read by all queries, as searches and dashboards read what streams have stored. Queries on the unified events alone don't wait for it."""
    made = unified(spark, sf_dir)

    def write(path: str) -> None:
        store.append_rows(superseded(store.event_rows(made.where("storable"))), path)
        store.write_events(made, path)

    return _written(spark, sf_dir, "events", write)


def superseded(rows: DataFrame) -> DataFrame:
    """An earlier version of every third event, which differs in all that searches and dashboards look at: nothing may find it."""
    old = {n: F.lit("superseded") for n in ("vendor", "product", "category", "action", "severity_label", "quality_status", "normalized_json")}
    return rows.where(F.right("event_id", F.lit(12)).cast("long") % 3 == 0).withColumns(old | {"normalized_at": F.col("normalized_at") - F.expr("INTERVAL 1 HOUR")})


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored event table: of every event the version that counts, for passes over all of it."""
    return store.current_all(spark.read.parquet(f"{stored(spark, sf_dir)}/events"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` for searches, lookups and point reads: what is asked of keys reaches the files of all versions."""
    return store.current(spark.read.parquet(f"{stored(spark, sf_dir)}/events"))


def _field(name: str, kind: str = "string") -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name)).cast(kind).alias(name.replace(".", "_"))


@query("x: SELECT coalesce(pack, 'none') AS pack, count(*) AS n FROM x GROUP BY 1")
def route_counts(spark, sf_dir):
    return parse(raw(spark, sf_dir)).groupBy(F.coalesce("pack", F.lit("none")).alias("pack")).agg(F.count("*").alias("n"))


@query("x: SELECT coalesce(pack, 'none') AS pack, status, count(*) AS n FROM x GROUP BY ALL")
def parse_status_counts(spark, sf_dir):
    return parse(raw(spark, sf_dir)).groupBy(F.coalesce("pack", F.lit("none")).alias("pack"), "status").agg(F.count("*").alias("n"))


@query("""x: SELECT code, count(*) AS n FROM (SELECT CASE WHEN k = 1 AND m % 4 = 3 THEN 'ASA_UNKNOWN_MESSAGE_ID' WHEN k = 4 AND m % 3 = 2 THEN 'SOURCE_PACK_FAILED' WHEN k = 5 AND m % 5 = 4 THEN 'SURICATA_PORT_INVALID' END AS code FROM x) WHERE code IS NOT NULL GROUP BY 1""")
def issue_counts(spark, sf_dir):
    return parse(raw(spark, sf_dir)).select(F.explode("issues").alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query("""x: SELECT e AS seq, 'Deny' AS action, CASE WHEN e % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, sip AS src_ip, sport AS src_port, dip AS dst_ip, dport::INT AS dst_port, 'EDGE' AS acl_name, 'acl_deny' AS event_type, printf('edge-%d', u % 10) AS hostname, 4 AS severity, 'warning' AS severity_name FROM x WHERE k = 0""")
def asa_deny_fields(spark, sf_dir):
    found = parse_only(raw(spark, sf_dir), "cisco_asa").where((_field("message_id") == "106023"))
    return found.select("seq", *[_field(n) for n in ("action", "protocol", "src_ip")], _field("src_port", "long"), _field("dst_ip"), _field("dst_port", "int"), *[_field(n) for n in ("acl_name", "event_type", "hostname")], _field("severity", "int"), _field("severity_name"))


@query("""x: SELECT e AS seq, ['302013', '302014', '106100', '111008'][m % 4 + 1] AS message_id, ['Built', 'Teardown', 'permitted', NULL][m % 4 + 1] AS action, ['inbound', 'outbound', NULL, NULL][m % 4 + 1] AS direction, CASE WHEN m % 4 < 2 THEN e END AS connection_id, CASE WHEN m % 4 < 3 THEN sip END AS src_ip, CASE WHEN m % 4 < 3 THEN dport::INT END AS dst_port, ['connection_lifecycle', 'connection_lifecycle', 'acl_hit', NULL][m % 4 + 1] AS event_type FROM x WHERE k = 1""")
def asa_connection_fields(spark, sf_dir):
    found = parse_only(raw(spark, sf_dir), "cisco_asa").where((_field("message_id") != "106023"))
    return found.select("seq", _field("message_id"), _field("action"), _field("direction"), _field("connection_id", "long"), _field("src_ip"), _field("dst_port", "int"), _field("event_type"))


@query("""x: SELECT e AS seq, printf('FG-%d', u % 10) AS hostname, printf('%010d', e) AS log_id, CASE WHEN k = 2 THEN 'traffic' ELSE 'event' END AS event_type, CASE WHEN k = 2 THEN ['accept', 'deny'][m % 2 + 1] ELSE 'login' END AS action, CASE WHEN k = 2 THEN sip END AS src_ip, CASE WHEN k = 2 THEN e % 1000 END AS sent_bytes, CASE WHEN k = 3 THEN printf('login of u%d', u) END AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS event_timestamp, CASE WHEN k = 3 THEN 'info' ELSE 'medium' END AS severity_normalized, CASE WHEN k = 2 THEN 'traffic.forward' ELSE 'event.user' END AS event_category_normalized FROM x WHERE k IN (2, 3)""")
def forti_fields(spark, sf_dir):
    found = parse_only(raw(spark, sf_dir), "fortinet_fortigate")
    return found.select("seq", *[_field(n) for n in ("hostname", "log_id", "event_type", "action", "src_ip")], _field("sent_bytes", "long"), *[_field(n) for n in ("message", "event_timestamp", "severity_normalized", "event_category_normalized")])


@query("""x: SELECT e AS seq, printf('node-%d', u % 10) AS hostname, ['cron', 'sshd'][m % 3 + 1] AS process, e % 9000 AS pid, CASE WHEN m % 3 = 0 THEN printf('job %d finished', e) ELSE printf('session %d opened', e) END AS message, [4, 10][m % 3 + 1] AS syslog_facility, ['auth', 'authpriv'][m % 3 + 1] AS syslog_facility_name, (e % 8)::INT AS severity, ['rfc3164', 'rfc5424'][m % 3 + 1] AS syslog_variant FROM x WHERE k = 4 AND m % 3 < 2""")
def linux_fields(spark, sf_dir):
    found = parse_only(raw(spark, sf_dir), "generic_linux_syslog").where("status = 'success'")
    return found.select("seq", _field("hostname"), _field("process"), _field("pid", "long"), _field("message"), _field("syslog_facility", "int"), _field("syslog_facility_name"), _field("severity", "int"), _field("syslog_variant"))


@query("""x: SELECT e AS seq, ['alert', 'flow', 'dns', 'http', 'http'][m % 5 + 1] AS event_type, sip AS src_ip, CASE WHEN m % 5 = 4 THEN 70000 ELSE sport END AS src_port, dip AS dest_ip, CASE WHEN m % 5 = 0 THEN printf('Rule %d', e % 50) END AS alert_signature, CASE WHEN m % 5 = 1 THEN e % 5000 END AS flow_bytes_toserver, CASE WHEN m % 5 = 2 THEN printf('h%d.example', e % 100) END AS dns_rrname, CASE WHEN m % 5 > 2 THEN 200 END AS http_status FROM x WHERE k = 5""")
def eve_fields(spark, sf_dir):
    found = parse_only(raw(spark, sf_dir), "suricata_eve")
    return found.select("seq", _field("event_type"), _field("src_ip"), _field("src_port", "long"), _field("dest_ip"), _field("alert.signature"), _field("flow.bytes_toserver", "long"), _field("dns.rrname"), _field("http.status", "int"))


@query("x: SELECT vendor, action, count(*) AS n FROM x GROUP BY ALL")
def action_map(spark, sf_dir):
    return unified(spark, sf_dir).groupBy(F.col("observer.vendor").alias("vendor"), F.col("action.normalized").alias("action")).agg(F.count("*").alias("n"))


@query("x: SELECT vendor, category, count(*) AS n FROM x GROUP BY ALL")
def category_map(spark, sf_dir):
    return unified(spark, sf_dir).groupBy(F.col("observer.vendor").alias("vendor"), F.col("event.category").alias("category")).agg(F.count("*").alias("n"))


@query("x: SELECT vendor, score, label, count(*) AS n FROM x GROUP BY ALL")
def severity_map(spark, sf_dir):
    return unified(spark, sf_dir).groupBy(F.col("observer.vendor").alias("vendor"), F.col("severity.normalized").alias("score"), F.col("severity.label").alias("label")).agg(F.count("*").alias("n"))


@query("""x: SELECT coalesce(pack, 'none') AS pack, quality, CASE WHEN status IN ('failed', 'unrecognized') THEN 0.0 WHEN status = 'partial' OR k = 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, count(*) AS n FROM x GROUP BY ALL""")
def quality_by_pack(spark, sf_dir):
    return unified(spark, sf_dir).groupBy(F.coalesce("pack", F.lit("none")).alias("pack"), F.col("quality.status").alias("quality"), F.col("quality.parsing_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query("""x: SELECT field, count(*) AS n FROM (SELECT unnest(CASE WHEN k = 1 AND m % 4 = 3 THEN ['source.ip', 'destination.ip', 'network.transport'] WHEN k = 2 OR k = 4 AND m % 3 = 2 THEN ['event.message'] WHEN k = 6 THEN ['normalization.mapping', 'observer.vendor', 'observer.product'] ELSE [] END) AS field FROM x) GROUP BY 1""")
def missing_fields(spark, sf_dir):
    return unified(spark, sf_dir).select(F.explode("quality.missing_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("""x: SELECT date_trunc('hour', observed) AS hour, count(*) AS n, count(*) FILTER (observed < ingested) AS source_times FROM x GROUP BY 1""")
def observed_hours(spark, sf_dir):
    t = F.col("time.observed_at")
    return unified(spark, sf_dir).groupBy(F.date_trunc("hour", t).alias("hour")).agg(F.count("*").alias("n"), F.count_if(t < F.col("time.ingested_at")).alias("source_times"))


@query("""x: SELECT id AS event_id, observed AS observed_at, ingested AS ingested_at, ingested + INTERVAL 1 SECOND AS normalized_at, vendor, product, category, action, score AS severity, label AS severity_label, CASE WHEN ends THEN sip ELSE '' END AS source_ip, CASE WHEN ends THEN sport END::INT AS source_port, CASE WHEN ends THEN dip ELSE '' END AS destination_ip, CASE WHEN ends THEN dport END::INT AS destination_port, quality AS quality_status FROM x WHERE quality <> 'invalid'""")
def event_row_projection(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", "observed_at", "ingested_at", "normalized_at", "vendor", "product", "category", "action", "severity", "severity_label", "source_ip", "source_port", "destination_ip", "destination_port", "quality_status")


@query("""x: SELECT strftime(observed, '%Y') AS year, strftime(observed, '%m') AS month, strftime(observed, '%d') AS day, category, quality <> 'valid' AS quarantined, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY ALL""")
def lake_partitions(spark, sf_dir):
    return store.lake_rows(rows(spark, sf_dir)).groupBy("year", "month", "day", "category", "quarantined").agg(F.count("*").alias("n"))


@query("""x: SELECT id AS event_id, true AS whole, 'text/plain' AS content_type, 'utf-8' AS encoding, CASE WHEN pack IS NULL THEN 'noise ' || e || ' without a format' ELSE '' END AS noise FROM x WHERE quality <> 'invalid'""")
def canonical_json(spark, sf_dir):
    """The raw event inside every stored event's canonical JSON; ``whole``: its content has the recorded hash. ``noise`` is the content where no pack read it."""
    part = lambda name: F.try_variant_get("j", f"$.traceability.raw_event.{name}", "string")
    found = rows(spark, sf_dir).select("event_id", "raw_sha256", "vendor", F.parse_json("normalized_json").alias("j"))
    return found.select("event_id", (F.sha2(F.encode(part("content"), "utf-8"), 256) == F.col("raw_sha256")).alias("whole"), part("content_type").alias("content_type"), part("encoding").alias("encoding"), F.when(F.col("vendor") == "unknown", part("content")).otherwise("").alias("noise"))


@query("""x: SELECT id AS event_id, true AS whole, vendor, product, category, action, score AS severity, label AS severity_label, CASE WHEN ends THEN sip END AS source_ip, CASE WHEN ends THEN dport END::INT AS destination_port, quality AS quality_status FROM x WHERE quality <> 'invalid'""")
def canonical_json_all(spark, sf_dir):
    """Every stored event read back from its canonical JSON; ``whole``: the embedded payload has the recorded hash."""
    j = lambda path, kind="string": F.try_variant_get("j", f"$.{path}", kind)
    found = rows(spark, sf_dir).select("event_id", "raw_sha256", F.parse_json("normalized_json").alias("j"))
    parts = {"vendor": "observer.vendor", "product": "observer.product", "category": "event.category", "action": "action.normalized"}
    return found.select("event_id", (F.sha2(F.encode(j("traceability.raw_event.content"), "utf-8"), 256) == F.col("raw_sha256")).alias("whole"), *[j(path).alias(n) for n, path in parts.items()], j("severity.normalized", "int").alias("severity"), j("severity.label").alias("severity_label"), j("source.ip").alias("source_ip"), j("destination.port", "int").alias("destination_port"), j("quality.status").alias("quality_status"))


_FOUND = "x: SELECT id AS event_id, observed AS observed_at FROM x WHERE quality <> 'invalid' AND "


def _search(**facets) -> Query:
    return lambda spark, sf_dir: store.search(searched(spark, sf_dir), limit=None, **facets).select("event_id", "observed_at")


for _name, _facets, _where in (
    ("search_vendor", {"vendor": "FORTINET"}, "vendor = 'Fortinet'"),
    ("search_category", {"category": "network"}, "category = 'network'"),
    ("search_action", {"action": "block"}, "action = 'block'"),
    ("search_severity", {"severity": "high"}, "label = 'high'"),
    ("search_quality", {"quality": "partial", "vendor": "all"}, "quality = 'partial'"),
    ("search_time_range", {"start": "2024-01-10 00:00:00", "end": "2024-01-12 00:00:00"}, "observed >= TIMESTAMP '2024-01-10' AND observed < TIMESTAMP '2024-01-12'"),
    ("search_text", {"text": "H4.EXAMPLE"}, "k = 5 AND e % 100 = 4 AND m % 5 IN (2, 3)"),
):
    _f = _search(**_facets)
    _f.__name__ = _name
    query(_FOUND + _where)(_f)


@query("x: SELECT id AS event_id, observed AS observed_at FROM x WHERE quality <> 'invalid' AND category = 'network' AND action = 'allow' ORDER BY observed DESC, id LIMIT 50")
def search_top_50(spark, sf_dir):
    return store.search(searched(spark, sf_dir), category="network", action="allow", limit=50).select("event_id", "observed_at")


@query("x: SELECT id AS event_id, action FROM x WHERE quality <> 'invalid' AND e % 10 = 3")
def lookup_by_id(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_id % 10 = 3").select(uuid_of(F.col("event_id")).alias("id"))
    return store.lookup(searched(spark, sf_dir).select("event_id", "normalized_at", "action"), "event_id", asked, "id").select("event_id", "action")


@query("x: SELECT id AS event_id, sha256('noise ' || e || ' without a format') AS raw_sha256 FROM x WHERE k = 6 AND e % 3 = 0")
def lookup_by_hash(spark, sf_dir):
    asked = table(spark, sf_dir, "events").where("event_id % 7 = 6 and event_id % 3 = 0").select(F.sha2(F.format_string("noise %d without a format", "event_id"), 256).alias("h"))
    return store.lookup(searched(spark, sf_dir).select("event_id", "normalized_at", "raw_sha256"), "raw_sha256", asked, "h").select("event_id", "raw_sha256")


@query("x: SELECT id AS event_id, ingested + CASE WHEN e % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 1 SECOND END AS normalized_at, CASE WHEN e % 3 = 0 THEN 'again' ELSE action END AS action FROM x WHERE quality <> 'invalid'")
def replacing_final(spark, sf_dir):
    found = rows(spark, sf_dir).select("observed_at", "event_id", "ingested_at", "normalized_at", "action")
    again = found.where("cast(right(event_id, 12) as long) % 3 = 0").withColumns({"normalized_at": F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"), "action": F.lit("again")})
    return store.latest(found.unionByName(again)).select("event_id", "normalized_at", "action")


@query("x: SELECT total_events, allow_events, deny_events, (allow_events * 2000 + d) // (d * 2) AS allow_per_mille, (deny_events * 2000 + d) // (d * 2) AS deny_per_mille FROM (SELECT count(DISTINCT id) AS total_events, count(*) FILTER (action IN ('allow', 'connect', 'authenticate')) AS allow_events, count(*) FILTER (action IN ('deny', 'block')) AS deny_events, allow_events + deny_events AS d FROM x WHERE quality <> 'invalid')")
def allow_deny_summary(spark, sf_dir):
    return store.summary(rows(spark, sf_dir))


@query("x: SELECT vendor, product, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY ALL")
def by_source(spark, sf_dir):
    return store.by_source(rows(spark, sf_dir))


@query("x: SELECT l AS severity_label, count(id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low', 'informational', 'unknown']) AS l) LEFT JOIN x ON label = l AND quality <> 'invalid' GROUP BY 1")
def severity_distribution(spark, sf_dir):
    return store.severity_distribution(rows(spark, sf_dir))


@query("x: SELECT q AS quality_status, count(id) AS n FROM (SELECT unnest(['valid', 'partial', 'invalid', 'unknown']) AS q) LEFT JOIN x ON quality = q AND quality <> 'invalid' GROUP BY 1")
def quality_distribution(spark, sf_dir):
    return store.quality_distribution(rows(spark, sf_dir))


@query("x: SELECT CASE WHEN action IN ('allow', 'connect', 'authenticate') THEN 'allow' WHEN action IN ('deny', 'block') THEN 'deny' WHEN action = 'detect' THEN 'detect' ELSE 'other' END AS bucket, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY 1")
def action_buckets(spark, sf_dir):
    return store.action_buckets(rows(spark, sf_dir))


@query("x: SELECT date_trunc('minute', observed) AS minute, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY 1")
def events_per_minute(spark, sf_dir):
    return store.per_minute(rows(spark, sf_dir))


@query("x: SELECT action, count(*) AS n FROM x WHERE quality <> 'invalid' AND action IN ('allow', 'deny', 'block') AND vendor IN ('Cisco', 'Fortinet') GROUP BY 1")
def dashboard_actions(spark, sf_dir):
    return store.matching(rows(spark, sf_dir), "vendor", "Cisco|Fortinet").where(F.col("action").isin("allow", "deny", "block")).groupBy("action").agg(F.count("*").alias("n"))


@query("x: SELECT DISTINCT product FROM x WHERE quality <> 'invalid' AND vendor = 'Fortinet'")
def facet_products(spark, sf_dir):
    return store.facet(rows(spark, sf_dir), "product", "Fortinet")


@query("x: " + " UNION ".join(f"SELECT '{facet}' AS facet, {column} AS value FROM x WHERE quality <> 'invalid'" for facet, column in zip(store.FACETS, ("vendor", "product", "category", "action", "label", "quality"), strict=True)))
def facet_lists(spark, sf_dir):
    return store.facets(rows(spark, sf_dir))


@query("x: SELECT vendor, product, count(*) AS n, (count(*) * 200 + t) // (t * 2) AS percent FROM x, (SELECT count(*) AS t FROM x WHERE quality <> 'invalid') WHERE quality <> 'invalid' GROUP BY vendor, product, t")
def source_shares(spark, sf_dir):
    return store.source_shares(rows(spark, sf_dir))


@query("x: SELECT strftime(observed, '%Y-%m-%d') AS day, category, quality <> 'valid' AS quarantined, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY ALL")
def lake_read_back(spark, sf_dir):
    """The stored events exported as a lake, and what is read back from its partitions."""
    path = new_path(spark, "lake")
    export.lake(rows(spark, sf_dir), path)
    read = lambda at: spark.read.option("basePath", at).parquet(f"{at}/year=*")
    day = F.make_date("year", "month", "day").cast("string").alias("day")
    found = [read(at).select(day, "category", F.lit(apart).alias("quarantined")) for at, apart in ((path, False), (f"{path}/quarantine", True))]
    return found[0].unionByName(found[1]).groupBy("day", "category", "quarantined").agg(F.count("*").alias("n"))


@query("x: SELECT vendor, quality AS quality_status, quality <> 'valid' AS quarantined, count(*) AS n FROM x WHERE quality <> 'invalid' GROUP BY ALL")
def jsonl_read_back(spark, sf_dir):
    """The stored events exported as JSON lines, and what is read back from them."""
    path = new_path(spark, "jsonl")
    export.jsonl(rows(spark, sf_dir), path, "gzip")
    lines = spark.read.text([f"{path}/normalized", f"{path}/quarantine"]).select(F.try_parse_json("value").alias("j"), F.col("_metadata.file_path").contains(f"{path.rsplit('/', 1)[-1]}/quarantine/").alias("quarantined"))
    part = lambda at: F.try_variant_get("j", at, "string")
    return lines.groupBy(part("$.observer.vendor").alias("vendor"), part("$.quality.status").alias("quality_status"), "quarantined").agg(F.count("*").alias("n"))


@query("x: SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN k = 5 AND label = 'unknown' THEN ['$.severity.label:severity_uncertainty', '$.quality.status:invalid'] ELSE ['$.quality.status:invalid'] END) AS code FROM x WHERE quality = 'invalid') GROUP BY 1")
def quarantine_codes(spark, sf_dir):
    return spark.read.parquet(f"{stored(spark, sf_dir)}/quarantine").select(F.explode("error_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("x: SELECT count(*) AS total, count(DISTINCT id) AS distinct_events FROM x WHERE quality <> 'invalid'")
def store_totals(spark, sf_dir):
    return store.totals(rows(spark, sf_dir))


@query("x: SELECT count(*) AS quarantined, 0::BIGINT AS storage_failures FROM x WHERE quality = 'invalid' AND ingested + INTERVAL 1 SECOND < TIMESTAMP '2024-01-15 00:00:00'")
def quarantine_range(spark, sf_dir):
    return store.quarantine_summary(spark.read.parquet(f"{stored(spark, sf_dir)}/quarantine"), end="2024-01-15 00:00:00")


@query("x: SELECT id AS event_id, action FROM x WHERE quality <> 'invalid' ORDER BY ingested DESC, id DESC LIMIT 100")
def newest_events(spark, sf_dir):
    return store.newest_inserted(rows(spark, sf_dir).withColumn("_at", F.struct("ingested_at", "event_id")), "_at").select("event_id", "action")


@query("x: SELECT id AS event_id FROM x WHERE quality <> 'invalid' AND (ends AND (sip LIKE '%10.1.%' OR dip LIKE '%10.1.%'))")
def text_in_columns(spark, sf_dir):
    return rows(spark, sf_dir).where(store.contains_any("10.1.", "vendor", "source_ip", "destination_ip")).select("event_id")


@query("x: SELECT observed AS observed_at, id AS event_id, vendor, action, label AS severity_label, quality AS quality_status FROM x WHERE quality <> 'invalid' ORDER BY observed DESC, id LIMIT 500")
def investigation_table(spark, sf_dir):
    return store.investigation(rows(spark, sf_dir)).select("observed_at", "event_id", "vendor", "action", "severity_label", "quality_status")


@query("x: SELECT id AS event_id, id AS raw_event_id, coalesce(pack, 'unknown_source_pack') AS source_pack_name, CASE WHEN pack IS NULL THEN '0.0.0' ELSE '1.0.0' END AS source_pack_version, ingested + INTERVAL 1 SECOND AS normalized_at FROM x WHERE quality <> 'invalid' ORDER BY observed DESC, id LIMIT 100")
def provenance_table(spark, sf_dir):
    return store.investigation(rows(spark, sf_dir), store.PROVENANCE, 100).select("event_id", "raw_event_id", "source_pack_name", "source_pack_version", "normalized_at")


@query("x: SELECT count(*) AS total, count(*) FILTER (quality = 'valid') AS valid, count(*) FILTER (quality <> 'valid') AS quarantine, '1.0.0' AS schema_version FROM x WHERE quality <> 'invalid'")
def export_split(spark, sf_dir):
    return export.split_counts(store.lake_rows(rows(spark, sf_dir)))


@query("x: SELECT count(*) AS total, count(*) FILTER (label IN ('high', 'critical')) AS high, (count(*) FILTER (quality = 'valid') * 200 + count(*)) // (count(*) * 2) AS valid_percent FROM x WHERE quality <> 'invalid'")
def kpi_cards(spark, sf_dir):
    return store.kpis(rows(spark, sf_dir))


@query("x: SELECT id AS event_id, score AS severity, quality, action AS act, CASE WHEN ends THEN sip END AS src, CASE WHEN ends AND NOT (k = 5 AND m % 5 = 4) THEN sport END::INT AS spt, CASE WHEN ends THEN dip END AS dst, CASE WHEN ends THEN dport END::INT AS dpt FROM x")
def cef_lines(spark, sf_dir):
    """Every unified event's CEF line, read back by the CEF parser."""
    lines = computed_once(unified(spark, sf_dir).select("event_id", deliver.cef_line().alias("line")), "lines")
    found = computed_once(lines.select("event_id", parsers.cef(F.col("line")).alias("fields")), "fields")
    return found.where(_field("externalId") == F.col("event_id")).select("event_id", _field("severity", "int"), *[_field(n) for n in ("quality", "act", "src", "dst")], *[_field(n, "int") for n in ("spt", "dpt")])


@query("x: SELECT id AS event_id, '1' AS version, 128 + least(score, 7) AS pri, strftime(observed, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, 'vantalog' AS appname, coalesce(pack, 'unknown_source_pack') AS pack, quality FROM x")
def rfc5424_lines(spark, sf_dir):
    """Every unified event's RFC 5424 line, read back by the syslog parser."""
    lines = computed_once(unified(spark, sf_dir).select("event_id", deliver.rfc5424_line().alias("line")), "lines")
    found = computed_once(lines.select("event_id", parsers.syslog(F.col("line")).alias("fields")), "fields")
    param = lambda name: F.regexp_extract(_field("structured_data"), f'{name}="([^"]*)"', 1)
    return found.where(param("eventId") == F.col("event_id")).select("event_id", *[_field(n) for n in ("version", "timestamp", "appname")], _field("pri", "int"), param("sourcePack").alias("pack"), param("quality").alias("quality"))


@query()
def cef_lines_all(spark, sf_dir):
    """Every unified event; its SQL would have to render every vendor's line again, so the tests hold it against a serialiser in Python."""
    return unified(spark, sf_dir).select("event_id", deliver.cef_line().alias("line"))


@query()
def rfc5424_lines_all(spark, sf_dir):
    """As ``cef_lines_all``."""
    return unified(spark, sf_dir).select("event_id", deliver.rfc5424_line().alias("line"))


@query("x: SELECT e AS seq, 'forward' AS name, dip AS dst, dport::INT AS dpt, 'a=b|c' AS note FROM x")
def cef_round_trip(spark, sf_dir):
    e = F.col("event_id")
    line = F.format_string('CEF:0|V|P|1|%d|forward|5|dst=198.51.100.%d dpt=%d note="a=b|c"', e, e % 254 + 1, F.element_at(F.array(*map(F.lit, (443, 80, 22, 53))), (e % 4 + 1).cast("int")))
    found = table(spark, sf_dir, "events").select(parsers.cef(line).alias("fields"))
    return found.select(_field("signature_id", "long").alias("seq"), _field("name"), _field("dst"), _field("dpt", "int"), _field("note"))


@query("SELECT o_orderkey AS k, o_orderstatus AS status, '' AS missing, o_orderpriority || ', \"x\"' AS quoted FROM orders")
def csv_named_short(spark, sf_dir):
    text = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""x"""')))
    found = table(spark, sf_dir, "orders").select(parsers.csv(text, ["k", "status", "quoted", "missing"]).alias("fields"))
    return found.select(_field("k", "long"), _field("status"), _field("missing"), _field("quoted"))


@query("SELECT event_id AS seq, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_prefix(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), parsers.json_object(F.concat(F.lit("app log: "), "props")).alias("v"))
    return found.select("seq", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN user_id END AS \"user\", event_type AS kind FROM events")
def regex_named(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(">> user="), "user_id", F.lit(" did "), "event_type")).otherwise(F.concat(F.lit("did "), "event_type"))
    found = table(spark, sf_dir, "events").select("event_id", parsers.first_regex(text, [(r"user=(\d+) did (\w+)", ["user", "kind"]), (r"did (\w+)", ["kind"])]).alias("fields"))
    return found.select(F.col("event_id").alias("seq"), _field("user", "long"), _field("kind"))


@query("SELECT event_id AS seq, ['pass', 'block'][event_id % 2 + 1] AS action, printf('10.0.0.%d', event_id % 250) AS src_ip, 1024 + event_id % 50000 AS src_port FROM events WHERE event_id % 5 <> 0")
def filterlog_fields(spark, sf_dir):
    e = F.col("event_id")
    line = F.format_string("<134>1 2024-01-02T03:04:05Z fw filterlog 77 - - 5,,,1000,em0,match,%s,in,4,0x0,,64,%d,0,DF,6,tcp,60,10.0.0.%d,192.0.2.1,%d,443", F.when(e % 5 == 0, "odd").when(e % 2 == 0, "pass").otherwise("block"), e, e % 250, 1024 + e % 50000)
    found = table(spark, sf_dir, "events").select("event_id", parsers.filterlog(line).alias("fields")).where("fields is not null")
    return found.select(F.col("event_id").alias("seq"), _field("action"), _field("src_ip"), _field("src_port", "long"))


@query("SELECT event_id AS seq, printf('2001:db8::%x:0:0:%x', event_id % 65535 + 1, user_id % 65535 + 1) AS ip FROM events")
def ipv6_canonical(spark, sf_dir):
    text = F.format_string("2001:0DB8:0000:0000:%04X:0:0:%04x", F.col("event_id") % 65535 + 1, F.col("user_id") % 65535 + 1)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), valid_ip(text).alias("ip"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def dup_flag_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return collect.flag_duplicates(docs.select("doc_id", "sha"), "sha", "doc_id").select("doc_id", "duplicate")


@query("SELECT reason, count(*) AS n, sum(strlen(text)) AS bytes FROM (SELECT text, CASE WHEN text IS NULL THEN 'invalid_payload' WHEN strlen(text) = 0 THEN 'empty_event' WHEN strlen(text) > 4096 THEN 'oversized_event' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1")
def reject_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("source_ip"), F.col("text").cast("binary").alias("payload"))
    return collect.ingest(docs, 4096).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.sum("raw_size").alias("bytes"))


@query("SELECT event_id, reason, strlen(text) AS raw_size, sha256(text) AS raw_sha256 FROM (SELECT doc_id::VARCHAR AS event_id, text, CASE WHEN text IS NULL THEN 'invalid_payload' WHEN strlen(text) = 0 THEN 'empty_event' WHEN strlen(text) > 1024 THEN 'oversized_event' END AS reason FROM documents) WHERE reason IS NOT NULL")
def rejection_log(spark, sf_dir):
    """Documents that arrive as text or, every other one, as base64, and the log of those refused."""
    coded = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    sent = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("source_ip"), F.when(~coded, F.col("text")).alias("raw_text"), F.when(coded, F.base64(F.encode("text", "utf-8"))).alias("raw_base64"))
    return collect.rejected(collect.ingest(sent.withColumn("payload", collect.payload_of()), 1024)).select("event_id", "reason", "raw_size", "raw_sha256")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def last_message(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ("conv_id",), ("turn",)).select("conv_id", "text")


@query("SELECT event_id, avg(round(value * 1000000)::BIGINT) OVER (PARTITION BY user_id % 16 ORDER BY event_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS mean FROM events")
def latency_ring(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1000000).cast("long").alias("micros"), (F.col("user_id") % 16).alias("worker"))
    return metrics.ring_mean(events, "worker", "event_id", "micros").select("event_id", F.col("ring_mean").alias("mean"))


@query("SELECT user_id % 4 AS worker_id, time_bucket(INTERVAL 5 SECOND, ts) AS window_start, count(*) AS consumed, sum(strlen(props))::BIGINT AS bytes_in, max(value) AS latency_max FROM events GROUP BY ALL")
def metrics_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("worker_id"), "ts", F.octet_length("props").cast("long").alias("bytes"), F.col("value").alias("latency_ms"))
    return metrics.rollup(events, "ts")


@query("SELECT count(DISTINCT user_id % 4) AS workers, count(*) AS consumed, count(*) / CAST(60 AS DOUBLE) AS events_per_second, sum(strlen(props)) / CAST(60 AS DOUBLE) AS bytes_per_second FROM events")
def metrics_summary(spark, sf_dir):
    return metrics.summary(metrics_rollup(spark, sf_dir), 60)


@query("SELECT l_returnflag, list_sort(list(l_quantity))[floor(CAST(0.95 AS DOUBLE) * (count(*) - 1))::BIGINT + 1] AS p95 FROM lineitem GROUP BY 1")
def percentile_floor(spark, sf_dir):
    return metrics.percentile_floor(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", 0.95, "p95")


@query("SELECT l_returnflag, (l[j] * (100 - d) + l[j + 1] * d) / 100 AS p95 FROM (SELECT l_returnflag, l, n, least(greatest(95 * (n + 1) // 100, 1), n - 1) AS j, 95 * (n + 1) - j * 100 AS d FROM (SELECT l_returnflag, list_sort(list(l_quantity)) AS l, count(*) AS n FROM lineitem GROUP BY 1))")
def percentile_exclusive(spark, sf_dir):
    return metrics.percentile_exclusive(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", 95, "p95")


@query("SELECT worker_id, (l[j] * (100 - d) + l[j + 1] * d) / 100 AS p95 FROM (SELECT worker_id, l, least(greatest(95 * (n + 1) // 100, 1), n - 1) AS j, 95 * (n + 1) - j * 100 AS d FROM (SELECT worker_id, list_sort(list(micros)) AS l, count(*) AS n FROM (SELECT user_id % 4 AS worker_id, round(value * 1000000)::BIGINT AS micros, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) AS place FROM events) WHERE place <= 2000 GROUP BY 1))")
def latest_percentile(spark, sf_dir):
    """The percentile of each worker's reservoir of its latest 2,000 samples."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("worker_id"), F.round(F.col("value") * 1000000).cast("long").alias("micros"))
    return metrics.percentile_exclusive(metrics.latest_samples(events, "worker_id", "event_id"), "worker_id", "micros", 95, "p95")


@query("SELECT avg(cpu) AS cpu, avg(memory) AS memory FROM (SELECT max(round(value * 1000000)::BIGINT) AS cpu, max(strlen(props)) AS memory FROM events GROUP BY user_id % 4)")
def worker_resources(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("worker_id"), F.round(F.col("value") * 1000000).cast("long").alias("cpu"), F.octet_length("props").cast("long").alias("memory"))
    return metrics.resources(events, "worker_id", "cpu", "memory")


@query("SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN ts WHEN 3 THEN try_strptime('1900 ' || strftime(ts, '%m-%d %H:%M:%S'), '%Y %m-%d %H:%M:%S') WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def timestamp_forms(spark, sf_dir):
    """Times written in four forms that are read, and in one that isn't."""
    e, ts = F.col("event_id"), F.col("ts")
    form = lambda pattern, at=ts: F.date_format(at, pattern)
    text = F.when(e % 5 == 0, utc_z(ts)).when(e % 5 == 1, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e % 5 == 2, form("yyyy-MM-dd'T'HH:mm:ss'+0200'", ts + F.expr("INTERVAL 2 HOURS"))).when(e % 5 == 3, form("MMM dd HH:mm:ss")).otherwise(form("dd.MM.yyyy HH:mm"))
    return table(spark, sf_dir, "events").select(e.alias("seq"), any_timestamp(text).alias("at"))


@query("SELECT event_id, event_id % 9 AS attempt, least(15 * (1 << (event_id % 9)::INT), 1800)::BIGINT AS delay FROM events")
def retry_schedule(spark, sf_dir):
    attempt = stages.attempt_of((F.col("event_id") % 9).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", attempt.cast("long").alias("attempt"), stages.delay_seconds(attempt).alias("delay"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_type = 'error' AND event_id % 7 >= 5 THEN 'dead-letter' WHEN event_type = 'error' THEN 'retry' ELSE 'parsed-event' END AS topic, CASE WHEN event_id % 11 = 0 THEN 'INVALID_RAW_CONTRACT' WHEN event_type = 'error' AND event_id % 7 >= 5 THEN 'TRANSIENT_RETRIES_EXHAUSTED' WHEN event_type = 'error' THEN 'TRANSIENT_PROCESSING_ERROR' END AS error_code, event_id % 7 + CASE WHEN topic = 'retry' THEN 1 ELSE 0 END AS attempt, CASE WHEN topic = 'retry' THEN epoch_us(ts) // 1000 + 15000 * (1 << (event_id % 7)::INT) END::BIGINT AS not_before_ms FROM events""")
def decision_routing(spark, sf_dir):
    broken = F.when(F.col("event_id") % 11 == 0, "INVALID_RAW_CONTRACT")
    made = stages.decide(broken, F.col("event_type") == "error", F.col("event_id") % 7, stages.PARSED, F.unix_millis("ts"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("d")).select("event_id", "d.topic", "d.error_code", "d.attempt", "d.not_before_ms")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'dead-letter' WHEN event_id % 3 = 0 THEN 'hold' ELSE ['parser', 'normalizer'][event_id % 2 + 1] END AS route FROM events")
def retry_routing(spark, sf_dir):
    e, now = F.col("event_id"), F.unix_millis("ts")
    stage = F.when(e % 5 == 0, "other").when(e % 2 == 0, "parser").otherwise("normalizer")
    due = F.when(e % 7 == 0, F.lit("soon")).when(e % 3 == 0, (now + 1000).cast("string")).otherwise((now - 1000).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", stages.retry_route(stage, due, now).alias("route"))


@query("x: SELECT id AS event_id, CASE WHEN e % 6 = 0 THEN 'ARCHIVE_READ_FAILED' WHEN e % 10 = 0 THEN 'ARCHIVE_VALIDATION_FAILED' END AS error_code FROM x WHERE e % 2 = 0")
def replay_by_ids(spark, sf_dir):
    lines = collect.ingest(raw(spark, sf_dir)).where("seq % 6 != 0").withColumn("raw_sha256", F.when(F.col("seq") % 10 == 0, F.lit("0" * 64)).otherwise(F.col("raw_sha256")))
    asked = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(uuid_of(F.col("event_id")).alias("event_id"))
    return collect.replay(lines, asked).select("event_id", "error_code")


@query("x: SELECT count(*) AS attempted, count(*) FILTER (code IS NULL) AS published, count(*) FILTER (code IS NOT NULL) AS failed, array_to_string(list_sort(['ARCHIVE_READ_FAILED=' || count(*) FILTER (code = 'ARCHIVE_READ_FAILED'), 'ARCHIVE_VALIDATION_FAILED=' || count(*) FILTER (code = 'ARCHIVE_VALIDATION_FAILED')]), ',') AS errors FROM (SELECT CASE WHEN e % 6 = 0 THEN 'ARCHIVE_READ_FAILED' WHEN e % 10 = 0 THEN 'ARCHIVE_VALIDATION_FAILED' END AS code FROM x WHERE e % 2 = 0)")
def replay_totals(spark, sf_dir):
    return collect.replay_summary(replay_by_ids(spark, sf_dir))


@query("SELECT count(*) AS received, count(*) FILTER (strlen(text) BETWEEN 1 AND 4096) AS accepted, count(*) FILTER (text IS NULL OR strlen(text) NOT BETWEEN 1 AND 4096) AS rejected, (SELECT round(avg(n_chars), 3) FROM (SELECT n_chars FROM documents ORDER BY doc_id DESC LIMIT 1000)) AS latency_mean_ms FROM documents")
def collector_health(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("source_ip"), F.col("text").cast("binary").alias("payload"), "n_chars")
    return collect.health(collect.ingest(docs, 4096), "n_chars", "doc_id")


@query("x: SELECT id AS event_id FROM x WHERE ingested >= TIMESTAMP '2024-01-15 00:00:00'")
def replay_since(spark, sf_dir):
    return collect.replay_since(raw(spark, sf_dir), "2024-01-15 00:00:00").select("event_id")


def _strict_index(documents: list[str]) -> list[int]:
    """The answers of an index that takes valid events only and is too busy for those of the highest scores."""
    found = [json.loads(d) for d in documents]
    return [503 if d["severity"]["normalized"] >= 9 else 200 if d["quality"]["status"] == "valid" else 400 for d in found]


@query("x: SELECT count(*) AS attempted, count(*) FILTER (score < 9 AND quality = 'valid') AS delivered, count(*) FILTER (score >= 9) AS retryable, count(*) FILTER (score < 9 AND quality <> 'valid') AS terminal, true AS reconciled FROM x WHERE quality <> 'invalid'")
def delivery_reconcile(spark, sf_dir):
    """All stored events, sent in chunks to a strict index: what became of them."""
    return deliver.reconcile(deliver.send(rows(spark, sf_dir).select("event_id", F.col("normalized_json").alias("document")), _strict_index))


_RULES = ("timestamp_order", "network_endpoint", "category_requirement", "action_consistency", "severity_consistency", "severity_uncertainty", "outcome_consistency", "partial_explanation", "vendor_namespace", "raw_integrity")


@query(f"x: SELECT r.rule, count(*) AS n FROM x, (SELECT unnest({list(_RULES)}) AS rule) r GROUP BY 1")
def semantic_rule_hits(spark, sf_dir):
    """How many events each rule is found in, of all events, each changed so that it breaks the rule."""
    return semantic_rule_hits_all(spark, sf_dir).groupBy("rule").agg(F.sum("hit").alias("n"))


@query(f"x: SELECT coalesce(pack, 'none') AS pack, r.rule, count(*) AS n, count(*) AS hit FROM x, (SELECT unnest({list(_RULES)}) AS rule) r GROUP BY ALL")
def semantic_rule_hits_all(spark, sf_dir):
    """Every event, changed once for each rule so that it breaks it, and in how many of them the rule is found."""
    good = unified(spark, sf_dir).select("pack", "event", "time", "source", "destination", "action", "severity", "threat", "authentication", "traceability", "quality", "extensions")  # what the rules read
    c, none = F.col, F.array().cast("array<string>")
    user = F.struct(F.lit("u").alias("user"), F.lit("success").alias("result"))
    changes = {
        "timestamp_order": {"time": c("time").withField("observed_at", c("time.ingested_at") + F.expr("INTERVAL 1 HOUR"))},
        "network_endpoint": {"event": c("event").withField("category", F.lit("network")), "source": F.lit(None).cast(good.schema["source"].dataType)},
        "category_requirement": {"event": c("event").withField("category", F.lit("intrusion_detection")), "threat": F.lit(None).cast(good.schema["threat"].dataType)},
        "action_consistency": {"action": c("action").withField("normalized", F.lit("deny")).withField("outcome", F.lit("success"))},
        "severity_consistency": {"severity": c("severity").withField("normalized", F.lit(9)).withField("label", F.lit("low"))},
        "severity_uncertainty": {"severity": c("severity").withField("label", F.lit("unknown")), "quality": c("quality").withField("warnings", none)},
        "outcome_consistency": {"authentication": user, "action": c("action").withField("outcome", F.lit("failure"))},
        "partial_explanation": {"quality": c("quality").withField("status", F.lit("partial")).withField("missing_fields", none).withField("warnings", none)},
        "vendor_namespace": {"extensions": F.create_map(F.lit("Bad-Name"), F.get(F.map_values("extensions"), F.lit(0)))},
        "raw_integrity": {"traceability": c("traceability").withField("raw_sha256", F.lit("0" * 64))},
    }
    copies = good.withColumn("_m", F.explode(F.array(*map(F.lit, _RULES))))
    for column in sorted({n for own in changes.values() for n in own}):
        changed = F.coalesce(*[F.when(c("_m") == rule, F.struct(own[column].alias("v"))) for rule, own in changes.items() if column in own], F.struct(c(column).alias("v")))
        copies = copies.withColumn(f"_{column}", changed["v"])
    for column in sorted({n for own in changes.values() for n in own}):
        copies = copies.withColumn(column, c(f"_{column}")).drop(f"_{column}")
    hit = F.exists("validation", lambda v: v.rule == c("_m"))
    return validate(copies).groupBy(F.coalesce("pack", F.lit("none")).alias("pack"), c("_m").alias("rule")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"))


@query("x: SELECT vendor, rule, count(*) AS n FROM (SELECT vendor, unnest(['additionalProperties', 'maximum']) AS rule FROM x WHERE quality <> 'invalid') GROUP BY ALL")
def structural_rule_hits_all(spark, sf_dir):
    """The issues of every stored event's JSON, changed so that it breaks two rules."""
    broken = F.regexp_replace(F.regexp_replace("normalized_json", r'"normalized":\d+', '"normalized":11'), r"^\{", '{"surprise":1,')
    return rows(spark, sf_dir).select("vendor", F.explode(structural_issues(broken)).alias("i")).groupBy("vendor", F.col("i.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("x: SELECT rule, count(*) AS n FROM (SELECT unnest(['additionalProperties', 'maximum']) AS rule FROM x WHERE quality <> 'invalid') GROUP BY 1")
def structural_rule_hits(spark, sf_dir):
    return structural_rule_hits_all(spark, sf_dir).groupBy("rule").agg(F.sum("n").alias("n"))


@query("x: SELECT count(*) AS n, count(*) FILTER (transport_ok) AS good FROM (SELECT e % 13 <> 0 AS transport_ok FROM x)")
def contract_checks(spark, sf_dir):
    sent = collect.envelope(collect.ingest(raw(spark, sf_dir)))
    broken = sent.withColumn("raw_size", F.col("raw_size") + F.when(F.right("event_id", F.lit(12)).cast("long") % 13 == 0, 1).otherwise(0))
    return broken.agg(F.count("*").alias("n"), F.count_if(collect.contract_error().isNull()).alias("good"))


@query("SELECT second % 60 AS s, count(*) AS n, sum(CASE WHEN second % 60 < 5 THEN 15000 ELSE 2000 END)::BIGINT AS load FROM (SELECT epoch_us(ts) // 1000000 AS second FROM events) GROUP BY 1")
def load_schedule(spark, sf_dir):
    second = F.unix_seconds("ts")
    rate = metrics.load_rate(second, 2000, 15000, 60, 5)
    return table(spark, sf_dir, "events").groupBy((second % 60).alias("s")).agg(F.count("*").alias("n"), F.sum(rate.cast("long")).alias("load"))


def _streamed(spark: SparkSession, sf_dir: str, name: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The result of a stream over the rendered events, run to the end of what is there, from a table in the shared folder."""
    root = new_path(spark, f"stream-{name}")
    sent = envelopes(spark, sf_dir)
    stages.publish(sent, root, stages.RAW)
    stream = transform(stages.topic(spark, root, stages.RAW, sent.schema))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{root}/out")


@query("x: SELECT coalesce(pack, 'none') AS pack, status, count(*) AS n FROM x GROUP BY ALL")
def stream_parse_counts(spark, sf_dir):
    out = _streamed(spark, sf_dir, "parse", lambda s: stages.parsed_decisions(s).select("event_id", "pack", "status", "decision.topic"))
    return out.where(F.col("topic") == stages.PARSED).groupBy(F.coalesce("pack", F.lit("none")).alias("pack"), "status").agg(F.count("*").alias("n"))


@query("x: SELECT m5 AS window_start, 'dev-' || (u % 20) AS source_id, count(*) AS n FROM (SELECT u, time_bucket(INTERVAL 5 SECOND, ingested) AS m5 FROM x) GROUP BY ALL")
def stream_rollup(spark, sf_dir):
    out = _streamed(spark, sf_dir, "rollup", lambda s: stages.live_rollup(s, "ingested_at", 5, "400 days"), "update")
    return out.groupBy(F.col("window.start").alias("window_start"), "source_id").agg(F.max("n").alias("n"))



@query("""x: SELECT id AS event_id, CASE WHEN e % 11 = 0 OR fails > 5 THEN 'dead-letter' WHEN quality = 'invalid' THEN 'quarantine' ELSE 'events' END AS outcome, CASE WHEN e % 11 = 0 THEN 0 ELSE least(fails, 5) END::INT AS attempt FROM (SELECT x.*, CASE WHEN event_type = 'error' THEN e % 7 ELSE 0 END AS fails FROM x JOIN events ON e = event_id)""")
def stream_outcomes(spark, sf_dir):
    """Where each event ends when some fail for a number of attempts and some break the contract: a row per output row."""
    root = new_path(spark, "stream-outcomes")
    number, out = F.right("event_id", F.lit(12)).cast("long"), f"{root}/out"
    kinds = table(spark, sf_dir, "events").select(uuid_of(F.col("event_id")).alias("event_id"), F.when(F.col("event_type") == "error", F.col("event_id") % 7).otherwise(0).alias("fails"))
    sent = envelopes(spark, sf_dir).join(kinds, "event_id").withColumns({"raw_size": F.col("raw_size") + F.when(number % 11 == 0, 1).otherwise(0), "attempt": F.lit("0")})
    with shuffles_dropped(spark):
        stages.publish(sent, root, stages.RAW)
    for turn in range(stages.MOST_ATTEMPTS + 1):  # each turn's clock is past all times set in the turn before
        now = F.lit(1_700_000_000_000 + turn * stages.HORIZON_MS)
        with small_methods(spark):
            stages.run_pipeline(spark, root, sent.schema, out, f"{root}/checkpoint", stages.attempt_of(F.col("attempt")) < F.col("fails"), now).awaitTermination()
        if not stages.release_due(spark, root, sent.schema, out, now + stages.HORIZON_MS):
            break
    ends = [spark.read.option("recursiveFileLookup", "true").schema("event_id string").parquet(f"{out}/{name}").select("event_id", F.lit(name).alias("outcome")) for name in ("events", "quarantine", stages.DEAD)]
    tries = spark.read.schema(sent.schema).parquet(f"{root}/{stages.RAW}").groupBy("event_id").agg(F.max(F.col("attempt").cast("int")).alias("attempt"))
    return ends[0].unionByName(ends[1]).unionByName(ends[2]).join(tries, "event_id")
