"""Queries over streams, topics, committed exports and point reads, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import small_methods
from ..operators import collect, export, recent, store
from ..sources import topics
from ..sources.events import table, uuid_of
from ..sources.shared import new_path
from ..streaming import measures, stages
from . import contracts, legacy
from .catalog import envelopes, query, raw, rows, searched

#: Micro-batches that the streams below take.
_TURNS = 3


def _in_turns(spark: SparkSession, made: DataFrame, turn, path: str) -> DataFrame:
    """``made`` as a stream of ``_TURNS`` micro-batches: a file a turn, written and read in order."""
    for i in range(_TURNS):
        made.where(turn == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: A text is a recent repeat while its source's cache holds it: since it came last, fewer other texts than the cache has room for.
_REPEATS = f"""
    WITH placed AS (SELECT doc_id, coalesce(source, 'unknown') AS source, sha256(text) AS digest, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY doc_id) AS place FROM documents),
    again AS (SELECT *, lag(place) OVER (PARTITION BY source, digest ORDER BY place) AS earlier FROM placed)
    SELECT doc_id, source, digest IS NOT NULL AND earlier IS NOT NULL
        AND count(DISTINCT digest) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN coalesce(place - earlier, 0) PRECEDING AND CURRENT ROW) <= {recent.ROOM} AS duplicate
    FROM again"""


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(_REPEATS)
def recent_duplicates(spark, sf_dir):
    """Documents as a source's events, in order of their ids: whether the source's recent ones held the same text."""
    return recent.flag_recent_duplicates(_digests(spark, sf_dir), "digest", "doc_id", "source").select("doc_id", "source", "duplicate")


@query(_REPEATS)
def stream_recent_duplicates(spark, sf_dir):
    """The same on a stream of micro-batches, whose caches are its state."""
    root, docs = new_path(spark, "stream-recent"), _digests(spark, sf_dir)
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    turn = F.floor(F.col("doc_id") * _TURNS / (most + 1))
    stream = recent.live_flags(_in_turns(spark, docs, turn, f"{root}/in"), "digest", "doc_id", "source")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    with recent.state_in_rocksdb(spark):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out").select("doc_id", "source", "duplicate")


@query(
    """SELECT (user_id % 4)::VARCHAR AS worker_id, count(*) AS consumed, sum(strlen(props))::BIGINT AS bytes_in, max(round(value * 1000000)::BIGINT) AS latency_max,
    true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY 1"""
)
def stream_metrics(spark, sf_dir):
    """Workers' rollups, published by a stream beside broken lines, read back and merged: exact counts, and whether each percentile's true rank is within two per cent."""
    root = new_path(spark, "stream-metrics")
    micros = F.round(F.col("value") * 1000000).cast("long")
    events = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).cast("string").alias("worker_id"), F.octet_length("props").cast("long").alias("bytes"), micros.alias("latency"))
    made = measures.rollups(_in_turns(spark, events, F.col("event_id") % _TURNS, f"{root}/in"), late="400 days", seconds=3600)
    measures.publish(made, f"{root}/topic", f"{root}/checkpoint").awaitTermination()
    broken = ["", "{", '{"worker_id": "0", "consumed": 5}', '{"window_start": "2024-01-01T00:00:00Z", "worker_id": "0", "consumed": 7, "sketch": "AAAA", "check": 1}']
    spark.createDataFrame([(b,) for b in broken], "value string").write.text(f"{root}/topic/batch=999")
    told = measures.report(measures.read(spark, f"{root}/topic"), 3600.0, "worker_id")
    ranks = events.join(F.broadcast(told), "worker_id").groupBy("worker_id")
    near = lambda p: F.abs(F.avg((F.col("latency") <= F.col(f"p{p}")).cast("int")) - p / 100) <= 0.02
    return ranks.agg(F.first("consumed").alias("consumed"), F.first("bytes_in").alias("bytes_in"), F.first("latency_max").alias("latency_max"), *[near(p).alias(f"p{p}_near") for p in (50, 95, 99)])


@query(
    """SELECT turn AS batch, count(*) AS n, sum(ms)::BIGINT AS total_ms, max(ms) AS max_ms
    FROM (SELECT event_id % 3 AS turn, user_id * 10 + event_id % 7 AS ms FROM events WHERE event_id % 5 <> 4) GROUP BY 1"""
)
def stream_latency(spark, sf_dir):
    """Every batch's latencies from the carried first_seen header, as its progress tells them; a fifth of the events carry none."""
    root = new_path(spark, "stream-latency")
    ms = F.col("user_id") * 10 + F.col("event_id") % 7
    header = F.when(F.col("event_id") % 5 != 4, F.timestamp_millis(F.unix_millis("ts") - ms))
    events = table(spark, sf_dir, "events").select("event_id", F.timestamp_millis(F.unix_millis("ts")).alias("seen_at"), header.alias("first_seen"))
    stream = measures.timed(_in_turns(spark, events, F.col("event_id") % _TURNS, f"{root}/in"), "first_seen", F.col("seen_at"))
    done = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    told = [(p.batchId, *(p.observedMetrics["latency"][n] for n in ("n", "total_ms", "max_ms"))) for p in done.recentProgress if p.numInputRows]
    return spark.createDataFrame(told, "batch long, n long, total_ms long, max_ms long")


@query("x: SELECT id AS event_id, quality AS quality_status FROM x WHERE quality <> 'invalid' AND e IN (0, 3, 14, 500, 777)")
def point_read(spark, sf_dir):
    """A few stored events by id: only row groups that can have them are read."""
    ids = [f"00000000-0000-4000-8000-{n:012d}" for n in (0, 3, 14, 500, 777)]
    return store.point(searched(spark, sf_dir), "event_id", *ids).select("event_id", "quality_status")


@query("x: SELECT 'dev-' || (u % 20) AS source_id, count(*) AS n, sum(e)::BIGINT AS seqs, 1::BIGINT AS buckets, count(DISTINCT e % 3)::BIGINT AS commits FROM x GROUP BY 1")
def topic_by_source(spark, sf_dir):
    """Envelopes appended to a topic in three writes, keyed by source, and read back: a source's lines lie in one bucket."""
    path = new_path(spark, "topic")
    sent = collect.envelope(collect.ingest(raw(spark, sf_dir))).withColumn("seq", F.right("event_id", F.lit(12)).cast("long"))
    for turn in range(_TURNS):
        topics.append(sent.where(F.col("seq") % _TURNS == turn), path, "source_id", "seq")
    found = topics.read(spark, path, "event_id string, source_id string, seq long")
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.count_distinct("bucket").alias("buckets"), F.count_distinct("commit").alias("commits"))


@query(
    """x: SELECT count(*) AS total, count(*) FILTER (quality = 'valid') AS valid, count(*) FILTER (quality <> 'valid') AS quarantine, '1.0.0' AS schema_version, '2.0' AS manifest_version, 0::BIGINT AS problems
    FROM x WHERE quality <> 'invalid'"""
)
def committed_export(spark, sf_dir):
    """All stored events exported as one with a manifest: what it says, and how many of its files aren't so."""
    path = new_path(spark, "export")
    export.commit_jsonl(store.lake_rows(rows(spark, sf_dir)), path, "gzip")
    kind = "total long, valid long, quarantine long, schema_version string, manifest_version string"
    told = spark.read.schema(kind).option("multiLine", "true").json(f"{path}/{export.MANIFEST}")
    return told.withColumn("problems", F.lit(export.verify_committed(spark, path).count()).cast("long"))


@query("x: SELECT id AS event_id, CASE WHEN e = 777 THEN 'POISON_MESSAGE' ELSE 'taken' END AS outcome FROM x WHERE quality <> 'invalid' OR e = 777")
def stream_poison(spark, sf_dir):
    """A plugged-in step raises on one message: it alone becomes a dead letter, all others go through the stages."""
    root = new_path(spark, "stream-poison")
    sent = envelopes(spark, sf_dir)
    stages.publish(sent, root, stages.RAW)

    def plug(batch: DataFrame) -> DataFrame:
        bad = F.raise_error(F.concat(F.lit("can't take "), F.col("event_id")))
        return batch.withColumn("source_id", F.when(F.col("event_id") == "00000000-0000-4000-8000-000000000777", bad).otherwise(F.col("source_id")))

    with small_methods(spark):
        stages.run_pipeline(spark, root, sent.schema, f"{root}/out", f"{root}/checkpoint", plug=plug).awaitTermination()
    every = spark.read.option("recursiveFileLookup", "true")
    taken = every.schema("event_id string").parquet(f"{root}/out/events").select("event_id", F.lit("taken").alias("outcome"))
    dead = every.schema("event_id string, error_code string").parquet(f"{root}/out/{stages.DEAD}").select("event_id", F.col("error_code").alias("outcome"))
    return taken.unionByName(dead)


@query(
    """x: SELECT e AS seq, CASE WHEN e % 13 IN (1, 2, 3, 4, 5, 6, 7, 8) THEN 'INVALID_RAW_CONTRACT' END AS raw_code,
    CASE WHEN e % 13 IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) THEN 'INVALID_PARSED_CONTRACT' END AS parsed_code FROM x"""
)
def contract_documents(spark, sf_dir):
    """Every event's envelope and parsed event as documents, most of them broken in one way, and what their contracts say."""
    seq = F.right("event_id", F.lit(12)).cast("long")
    sent = collect.envelope(collect.ingest(raw(spark, sf_dir))).withColumn("ingested_at", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    text, kind = F.to_json(F.struct(*sent.columns)), seq % 13
    swap = lambda old, new: F.regexp_replace(text, old, new)
    broken = F.coalesce(
        F.when(kind == 1, swap(r"^\{", '{"surprise":1,')),
        F.when(kind == 2, swap(r'("ingested_at":"[^"]*)Z"', '$1+02:00"')),
        F.when(kind == 3, swap(r',"collector_id":"[^"]*"', "")),
        F.when(kind == 4, swap(r'"raw_size":(\d+)', '"raw_size":1$1')),
        F.when(kind == 5, swap(r'"raw_size":(\d+)', '"raw_size":"$1"')),
        F.when(kind == 6, swap(r'"transport":"file"', '"transport":"pigeon"')),
        F.when(kind == 7, swap(r'"source_ip":"[^"]*"', '"source_ip":"300.1.1.1"')),
        F.when(kind == 8, swap(r"\}$", ',"metadata":[]}')),
        F.when(kind == 12, swap(r'"source_ip":"[^"]*"', '"source_ip":null')),
        text,
    )
    named = F.when(kind == 9, uuid_of(seq + 1)).otherwise(F.upper("event_id"))
    status = F.when(kind == 10, "maybe").otherwise("partial")
    severity = F.when(kind == 11, "fatal").otherwise("error")
    form = '{"event_id":"%s","parsed_at":"2024-01-01T00:00:00","vendor":null,"product":"P","product_version":null,"parser_id":"p","parser_version":"1","source_pack_id":null,"source_pack_version":null,"detected_format":"f","status":"%s","issues":[{"code":"C","message":"m","severity":"%s","field":null}],"extracted_fields":{"a":[1,{"b":null}]},"raw_event":%s}'
    documents = sent.select(seq.alias("seq"), broken.alias("envelope"), named.alias("named"), status.alias("said"), severity.alias("severity"))
    documents = documents.withColumn("parsed", F.format_string(form, "named", "said", "severity", "envelope"))
    return documents.select("seq", contracts.raw_contract_error(F.col("envelope")).alias("raw_code"), contracts.parsed_contract_error(F.col("parsed")).alias("parsed_code"))


@query(
    """x: SELECT e AS seq, e % 3 <> 0 AS kept_id, sha256('line ' || e) AS raw_sha256, CASE WHEN e % 2 = 0 THEN 'cisco.asa.syslog' ELSE 'unknown.legacy_parser' END AS parser_id,
    CASE WHEN e % 4 = 3 THEN '0.0.0' ELSE '1.2.' || (e % 4) END AS parser_version, CASE WHEN e % 2 = 0 THEN 'syslog' ELSE 'unknown' END AS detected_format,
    ['success', 'partial', 'failed', 'unrecognized', 'failed'][e % 5 + 1] AS status, e::VARCHAR AS number, CASE WHEN e % 3 = 0 THEN 'old-' || e END AS legacy_id,
    array_to_string(list_filter([CASE WHEN e % 2 = 0 THEN 'ASA_HEADER_NO_MATCH' ELSE 'LEGACY_PARSE_ERROR' END, CASE WHEN e % 2 = 1 THEN 'LEGACY_PARSER_PROVENANCE_UNKNOWN' END, CASE WHEN e % 3 = 0 THEN 'LEGACY_EVENT_ID_NOT_UUID' END], lambda c: c IS NOT NULL), ',') AS codes FROM x"""
)
def legacy_events(spark, sf_dir):
    """Every event in one of two earlier shapes, adapted."""
    e = F.col("event_id")
    named = F.when(e % 3 == 0, F.format_string("old-%d", e)).otherwise(uuid_of(e))
    line = F.format_string("line %d", e)
    state = F.element_at(F.array(*map(F.lit, ("success", "partial", "error", "unparsed_fallback", "new"))), (e % 5 + 1).cast("int"))
    version = F.when(e % 4 != 3, F.format_string("1.2.%d", e % 4))
    numbers = F.struct(e.alias("number"))
    error = F.struct(F.lit("ASA_HEADER_NO_MATCH").alias("code"), F.lit("m").alias("message"), F.lit("error").alias("severity"))
    first = F.struct(named.alias("event_id"), F.struct(F.base64(line.cast("binary")).alias("payload_b64")).alias("raw_event"), F.lit("cisco_asa").alias("source_pack_id"), version.alias("source_pack_version"), state.alias("parse_status"), F.array(error).alias("parse_errors"), numbers.alias("extracted_fields"), F.lit("2024-01-01T00:00:00").alias("parsed_at"))
    second = F.struct(named.alias("event_id"), F.struct(line.alias("raw_payload")).alias("raw_event"), F.lit("other").alias("source_pack_id"), version.alias("pack_version"), state.alias("status"), F.array(F.lit("went wrong")).alias("errors"), numbers.alias("fields"), F.lit("2024-01-01T00:00:00Z").alias("parsed_at"))
    documents = table(spark, sf_dir, "events").select(e.alias("seq"), F.when(e % 2 == 0, F.to_json(first)).otherwise(F.to_json(second)).alias("document"))
    found = legacy.adapted(documents)
    kept = F.col("event_id") == uuid_of(F.col("seq"))
    field = lambda n: F.try_element_at("fields", F.lit(n))
    return found.select("seq", kept.alias("kept_id"), F.sha2("payload", 256).alias("raw_sha256"), "parser_id", "parser_version", "detected_format", "status", field("number").alias("number"), field("_legacy_event_id").alias("legacy_id"), F.array_join(F.transform("issues", lambda i: i.code), ",").alias("codes"))
