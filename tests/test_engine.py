"""From raw payloads to stored, searched, exported and replayed events."""

import datetime

import pytest
from pyspark.sql import functions as F

from vantalog.operators import collect, deliver, export, metrics, recent, store
from vantalog.operators.validate import document_issues, validate
from vantalog.plans.normalize import normalize
from vantalog.plans.packs import PACKS, by_priority, parse

AT = datetime.datetime(2024, 1, 2, 3, 4, 5)
LINES = {
    "deny": b'<166>Jan 02 2024 03:04:05 edge : %ASA-4-106023: Deny tcp src out:203.0.113.7/40001 dst in:10.1.0.9/443 by access-group "E"',
    "no_header": b"ASA-4-106023 garbage",
    "bad_body": b"%ASA-4-106023: something else",
    "forti": b'date=2024-01-02 time=03:04:05 devname="F" devid="X" logid="0000000042" type="traffic" subtype="forward" level="notice" srcip=10.1.0.7 srcport=1 dstip=1.1.1.1 dstport=443 proto=6 action="accept" msg="m"',
    "forti_no_type": b'devname="F" action="login"',
    "linux": b"<38>Jan  2 03:04:05 node cron[77]: job finished",
    "eve_cut": b'{"event_type":"alert","timestamp":',
    "eve_bad_ip": b'{"event_type":"dns","timestamp":"2024-01-02T03:04:05Z","src_ip":"x","dest_ip":"1.1.1.1","dns":{}}',
    "eve_late": b'{"event_type":"dns","timestamp":"2030-01-02T03:04:05Z","src_ip":"1.1.1.2","dest_ip":"1.1.1.1","dns":{"rrname":"h"}}',
    "binary": b"\xff\x00\xfe",
    "empty": b"",
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f"00000000-0000-4000-8000-{i:012d}", i, n, AT, None, "192.0.2.1", "udp", p) for i, (n, p) in enumerate(LINES.items())]
    return spark.createDataFrame(rows, "event_id string, seq long, name string, ingested_at timestamp, source_id string, source_ip string, transport string, payload binary")


@pytest.fixture(scope="module")
def unified(raw):
    return {r.name: r for r in validate(normalize(parse(raw), F.col("ingested_at"))).collect()}


def test_status_and_issues(raw):
    found = {r.name: (r.pack, r.status, [i.code for i in r.issues]) for r in parse(raw).collect()}
    assert found["deny"] == ("cisco_asa", "success", [])
    assert found["no_header"] == ("cisco_asa", "failed", ["ASA_HEADER_NO_MATCH"])
    assert found["bad_body"] == ("cisco_asa", "partial", ["ASA_MESSAGE_BODY_NO_MATCH"])
    assert found["forti"] == ("fortinet_fortigate", "success", []) and found["forti_no_type"] == ("fortinet_fortigate", "partial", ["FIELD_EXTRACTION_FAILED"])
    assert found["eve_cut"] == ("suricata_eve", "failed", ["SOURCE_PACK_FAILED"]) and found["eve_bad_ip"][1:] == ("failed", ["SURICATA_IP_INVALID"])
    assert found["binary"][:2] == found["empty"][:2] == (None, "unrecognized")


def test_sections(unified):
    deny = unified["deny"]
    assert (deny.action.normalized, deny.action.outcome, deny.event.category, deny.event.type) == ("deny", "failure", "network", "acl_deny")
    assert (deny.source.ip, deny.source.port, deny.network.transport, deny.severity.label, deny.quality.status) == ("203.0.113.7", 40001, "tcp", "medium", "valid") and deny.storable
    assert unified["forti"].quality.status == "valid" and unified["linux"].event.type == "cron"
    late = unified["eve_late"]
    assert late.time.observed_at == AT and late.quality.status == "partial" and late.quality.warnings == ["the event's own time lies behind its arrival and isn't used"]
    assert unified["binary"].traceability.raw_event is None and unified["binary"].quality.missing_fields == ["normalization.mapping", "observer.product", "observer.vendor"]
    assert not unified["eve_bad_ip"].storable and unified["eve_bad_ip"].quality.status == "invalid"


def test_packs_are_tried_by_priority():
    assert [p.pack_id for p in by_priority()] == ["cisco_asa", "suricata_eve", "fortinet_fortigate", "generic_linux_syslog"]
    with pytest.raises(ValueError):
        by_priority((*PACKS, PACKS[0]))


def test_store_export_and_verify(spark, raw, tmp_path):
    rows = store.event_rows(validate(normalize(parse(raw), F.col("ingested_at"))).where("storable"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert store.search(rows, vendor="cisco", limit=0).count() == 1 and store.search(rows, text="JOB FINISHED").count() == 1
    assert {r.severity_label for r in store.severity_distribution(rows).collect()} == {"critical", "high", "medium", "low", "informational", "unknown"}
    export.lake(rows, str(tmp_path / "lake"))
    recorded = export.manifest(spark, str(tmp_path / "lake")).collect()
    recorded = spark.createDataFrame(recorded, "path string, bytes long, sha256 string")
    assert export.verify(spark, str(tmp_path / "lake"), recorded).count() == 0
    changed = recorded.withColumn("bytes", F.col("bytes") + 1)
    assert {r.problem for r in export.verify(spark, str(tmp_path / "lake"), changed).collect()} == {"changed"}
    assert all(not document_issues(r.normalized_json) or r.source_ip == "" for r in rows.collect())


def test_collection(raw):
    taken = {r.name: r for r in collect.ingest(raw, 60).collect()}
    assert taken["empty"].reason == "empty_event" and taken["deny"].reason == "oversized_event" and taken["linux"].reason is None and taken["linux"].source_id == "192.0.2.1"
    sent = collect.envelope(collect.ingest(raw))
    assert sent.where(collect.contract_error().isNotNull()).count() == 0
    assert sent.withColumn("raw_payload_b64", F.lit("!!")).where(collect.contract_error().isNull()).count() == 0
    assert collect.split_frames(b"a\nb\nc") == ([b"a", b"b"], b"c") and collect.split_frames(b"x" * 10, 5) == ([b"x" * 10], b"")


def test_archive_keeps_exact_bytes(spark, raw, tmp_path):
    collect.archive(collect.ingest(raw), str(tmp_path / "archive"))
    kept = spark.read.parquet(str(tmp_path / "archive"))
    assert {r.name: bytes(r.payload) for r in kept.collect()} == {n: p for n, p in LINES.items() if p}
    assert collect.replay(kept, raw).where("error_code is not null").select("error_code").collect() == [("ARCHIVE_READ_FAILED",)]


def test_rejected_payloads_are_logged_with_a_sample(spark):
    rows = spark.createDataFrame([("a", b"\xff" + b"x" * 600), ("b", None), ("c", b""), ("d", b"ok")], "event_id string, payload binary")
    named = rows.withColumns({"source_id": F.lit(None).cast("string"), "source_ip": F.lit("192.0.2.1")})
    found = {r.event_id: (r.reason, r.raw_size, len(r.sample) if r.sample is not None else None) for r in collect.rejected(collect.ingest(named, 100)).collect()}
    assert found == {"a": ("oversized_event", 601, 512), "b": ("invalid_payload", None, None), "c": ("empty_event", 0, 0)}


def test_delivery_decides_by_the_answers(spark):
    def transport(documents):
        if "down" in documents:
            raise ConnectionError
        return [int(d) for d in documents]

    asked = [("a", "200"), ("b", "429"), ("c", "400")]
    rows = spark.createDataFrame(asked, "event_id string, document string").coalesce(1)
    answered = deliver.send(rows, transport).withColumn("result", deliver.outcome(F.col("status")))
    first = {r.event_id: r.d for r in answered.select("event_id", deliver.decision(F.col("result"), F.lit(1)).alias("d")).collect()}
    assert first == {"a": "ack", "b": "retry", "c": "dead_letter"}
    assert answered.where("event_id = 'b'").select(deliver.decision(F.col("result"), F.lit(5))).collect() == [("dead_letter",)]
    lost = spark.createDataFrame([*asked, ("d", "down")], "event_id string, document string").coalesce(1)
    assert {r.status for r in deliver.send(lost, transport).collect()} == {503}


def test_recent_duplicates_are_those_of_a_bounded_cache(spark):
    digests = list("abcabadeaab") + ["x", "y", "x", "b"]
    rows = spark.createDataFrame([(i, "s", d) for i, d in enumerate(digests)], "n long, source string, sha string")
    for room in (1, 2, 3, 100):
        cache, expected = [], []
        for d in digests:
            expected.append(d in cache)
            cache = [c for c in cache if c != d] + [d]
            cache = cache[-room:]
        assert [r.duplicate for r in recent.flag_recent_duplicates(rows, "sha", "n", "source", room).orderBy("n").collect()] == expected, room


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40)] + [("b", 5.0)], "k string, v double")
    assert {r.k: r.p for r in metrics.percentile_floor(rows, "k", "v", 0.95, "p").collect()} == {"a": 30.0, "b": 5.0}
    assert {r.k: r.p for r in metrics.percentile_exclusive(rows, "k", "v", 50, "p").collect()} == {"a": 25.0, "b": 5.0}


@pytest.mark.parametrize(("text", "issue"), [("[]", ("$", "type")), ("{", ("$", "json")), ('{"surprise":1}', ("$", "additionalProperties"))])
def test_document_issues(text, issue):
    assert issue in [(i["path"], i["rule"]) for i in document_issues(text)]
