"""Packs from manifests, log files, the engine object and its command, and functions that no query reaches."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from vantalog.engine import Engine, main
from vantalog.functions import parsers
from vantalog.operators import collect, store
from vantalog.plans import manifests
from vantalog.plans.packs import asa_confidence, guarded, parse

GOOD = {"pack": {"vendor": "Acme", "product": "Gate", "pack_version": "2.1.0"}, "detection": {"priority": 95, "rules": [{"type": "keyword", "any_of": ["acmegate"]}, {"type": "equals", "target": "source_ip", "equals": "192.0.2.77"}]}, "format": {"type": "key_value"}, "fields": [{"name": "action", "source": "act", "required": True}, {"name": "zone", "source": "zone", "default": "none"}]}


def _with(section, **changes):
    return GOOD | {section: GOOD[section] | changes}


@pytest.mark.parametrize("manifest", [[], {}, {k: v for k, v in GOOD.items() if k != "fields"}, _with("pack", vendor=" "), _with("detection", priority=True), _with("detection", rules={}), _with("detection", rules=[{"type": "regex", "pattern": "("}]), _with("detection", rules=[{"type": "glob"}]), _with("format", type=""), _with("format", type="xml"), GOOD | {"fields": [{"name": "x"}]}, GOOD | {"fields": {}}])
def test_broken_manifests(manifest):
    assert manifests.problems(manifest)


@pytest.fixture(scope="module")
def pack_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packs")
    for name, text in {"acme": json.dumps(GOOD), "broken": "{[", "thin": json.dumps({"pack": {}}), "twin": json.dumps(_with("pack", id="acme"))}.items():
        (root / name).mkdir()
        (root / name / "manifest.json").write_text(text)
    return str(root)


def test_packs_load_and_broken_ones_are_left_out(spark, pack_folder):
    packs, wrong = manifests.load(spark, pack_folder)
    assert [p.pack_id for p in packs] == ["acme"] and set(wrong) == {"broken", "thin", "twin"} and manifests.problems(GOOD) == []
    lines = spark.createDataFrame([(1, "1.1.1.1", b'acmegate act=drop zone="a b"'), (2, "1.1.1.1", b"acmegate zone=z"), (3, "192.0.2.77", b"act=pass"), (4, "1.1.1.1", b"<38>Jan  2 03:04:05 node cron[77]: job")], "n int, source_ip string, payload binary")
    found = {r.n: (r.pack, r.status, r.fields) for r in parse(lines, manifests.merged(packs)).collect()}
    assert found[1] == ("acme", "success", {"action": "drop", "zone": "a b"}) and found[2] == ("acme", "partial", {"zone": "z"})
    assert found[3] == ("acme", "success", {"action": "pass", "zone": "none"}) and found[4][0] == "generic_linux_syslog"


def test_log_files_are_read_by_line_feeds(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo \xff\x00\nlast")
    (tmp_path / "b.log").write_bytes(b"feed\n")
    rows = collect.read_lines(spark, str(tmp_path))
    found = rows.collect()
    assert sorted(bytes(r.payload) for r in found) == sorted([b"one\r", b"", b"two \xff\x00", b"last", b"feed"]) and len({r.event_id for r in found}) == 5
    assert sorted(r.event_id for r in found) == sorted(r.event_id for r in collect.read_lines(spark, str(tmp_path)).collect())
    taken = collect.ingest(rows)
    assert [(r.reason, r.sample) for r in collect.rejected(taken).collect()] == [("empty_event", "")]
    collect.archive(taken, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 4
    total = collect.replay_summary(collect.replay(taken, taken.select("event_id"))).first()
    assert (total.attempted, total.published, total.failed) == (5, 5, 0)


def test_engine_and_command(spark, pack_folder, tmp_path, capsys):
    (tmp_path / "in.log").write_bytes(b'<166>Jan 02 2024 03:04:05 edge : %ASA-4-106023: Deny tcp src out:203.0.113.7/40001 dst in:10.1.0.9/443 by access-group "E"\n\nacmegate act=drop\nnoise\n')
    engine = Engine(spark, str(tmp_path / "store"), pack_folder)
    assert engine.health()["store"] != "ready" and engine.list_packs()[0]["pack_id"] == "cisco_asa" and set(engine.reload()) == {"broken", "thin", "twin"}
    done = engine.process(collect.read_lines(spark, str(tmp_path / "in.log"))).collect()
    assert sorted((r.status, r.pack, r.detail)[:2] for r in done if r.pack) == [("stored", "acme"), ("stored", "cisco_asa")] and [r.detail for r in done if r.status == "rejected"] == ["empty_event"]
    assert engine.search(vendor="ACME").count() == 1 and engine.search(action="deny").first().source_ip == "203.0.113.7" and engine.health()["store"] == "ready"
    assert main(["--store", str(tmp_path / "store"), "search", "--vendor", "cisco"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["action"] == "deny"
    (tmp_path / "doc.json").write_text('{"surprise":1}\n')
    assert main(["validate", str(tmp_path / "doc.json")]) == 1 and main(["--packs", pack_folder, "--store", str(tmp_path / "store"), "packs"]) == 1
    # A file as one document; what can't be read, or a limit beyond its bounds, is the command's fault.
    good = engine.search(vendor="cisco").first().normalized_json
    (tmp_path / "whole.json").write_text(json.dumps(json.loads(good), indent=1))
    assert main(["validate", "--whole", str(tmp_path / "whole.json")]) == 0 and main(["validate", str(tmp_path / "whole.json")]) == 1
    assert main(["validate", str(tmp_path / "absent.json")]) == 2
    for limit in (0, 501):
        with pytest.raises(ValueError):
            engine.search(limit=limit)
        with pytest.raises(SystemExit) as refused:
            main(["search", "--limit", str(limit)])
        assert refused.value.code == 2
    manifest = engine.export(str(tmp_path / "one"), "jsonl", limit=1)
    newest = engine.search(limit=1).first().normalized_json
    lines = [r.value for r in spark.read.text([str(tmp_path / "one" / part) for part in ("normalized", "quarantine")]).collect()]
    assert lines == [newest] and sum(f["rows"] for f in manifest["files"]) == 1
    command = ["--store", str(tmp_path / "store"), "export", str(tmp_path / "cisco"), "--form", "jsonl", "--vendor", "cisco"]
    assert main(command) == 0 and main(command) == 2
    engine.export(str(tmp_path / "lake"))
    assert sum(len(list((tmp_path / "lake").rglob(f"*{end}"))) for end in (".parquet",)) >= 1
    for wrong in ({"form": "csv"}, {"limit": 0}):
        with pytest.raises(ValueError):
            engine.export(str(tmp_path / "none"), **wrong)


def test_small_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(asa_confidence(F.lit(t))) for t in ("%ASA-4-106023: x", "ASA-4-106023", "x")] == [0.98, 0.4, 0.0]
    rows = spark.createDataFrame([("a", None), (None, "YQ=="), ("a", "YQ=="), (None, None), (None, "!")], "raw_text string, raw_base64 string")
    assert [r[0] and bytes(r[0]) for r in rows.select(collect.payload_of()).collect()] == [b"a", b"a", None, None, None]
    assert one(parsers.fallback(F.lit("x"))) == {"message": "x"}
    bad = one(store.quarantine_payload(F.lit("7"), F.lit(b"\xff{")))
    assert bad.error_codes == ["INVALID_NORMALIZED_JSON"] and bad.payload_base64 == "/3s=" and one(store.quarantine_payload(F.lit("7"), F.lit(b'{"a":1}'))) is None
    at = datetime.datetime(2024, 1, 2)
    seen = spark.createDataFrame([("a", ["STORAGE_WRITE_FAILED"], at), ("b", ["x"], at), ("c", ["x"], at + datetime.timedelta(1))], "event_id string, error_codes array<string>, quarantined_at timestamp")
    assert tuple(store.quarantine_summary(seen, end="2024-01-03 00:00:00").first()) == (2, 1)


MAPPED = GOOD | {
    "fields": [{"name": n, "source": n} for n in ("act", "src", "spt", "dst", "dpt", "proto", "sev", "msg", "kind")],
    "mapping": {
        "id": "acme_gate",
        "version": "1.0.0",
        "name": "Acme Gate event",
        "category": {"field": "kind", "values": {"flow": "network", "login": "system"}, "default": "unknown"},
        "type": {"field": "kind", "default": "acme_event"},
        "message": ["msg"],
        "source": {"ip": "src", "port": "spt"},
        "destination": {"ip": "dst", "port": "dpt"},
        "transport": "proto",
        "action": {"field": "act", "values": {"drop": ["deny", "failure"], "pass": ["allow", "success"]}},
        "severity": {"field": "sev", "values": {"1": [8, "high"], "3": [2, "low"]}},
        "observer_type": "firewall",
    },
}


def _mapping(**changes):
    return MAPPED | {"mapping": {k: v for k, v in (MAPPED["mapping"] | changes).items() if v is not None}}


@pytest.mark.parametrize("changes", [{"id": "Acme"}, {"version": "1"}, {"name": None}, {"category": {"default": "sports"}}, {"category": {"field": "kind"}}, {"action": {"field": "act", "values": {"x": "deny"}}}, {"severity": {"field": "sev", "values": {"1": [11, "high"]}}}, {"source": []}, {"message": "msg"}])
def test_broken_mappings(changes):
    assert manifests.problems(_mapping(**changes)) and manifests.problems(MAPPED) == []


def test_a_manifest_with_a_mapping_reaches_valid_events_without_code(spark, tmp_path):
    for name, data in {"acme": MAPPED, "twin": _with("pack", id="other") | {"mapping": MAPPED["mapping"]}}.items():
        (tmp_path / "packs" / name).mkdir(parents=True)
        (tmp_path / "packs" / name / "manifest.json").write_text(json.dumps(data))
    engine = Engine(spark, str(tmp_path / "store"), str(tmp_path / "packs"))
    assert engine.left_out == {"twin": ["mapping acme_gate is taken"]}
    lines = [b'acmegate kind=flow act=DROP src=192.0.2.1 spt=1024 dst=198.51.100.2 dpt=443 proto=tcp sev=1 msg="a b"', b"acmegate kind=flow act=pass src=192.0.2.1 proto=17 sev=9 msg=m", b"acmegate kind=login act=pass sev=3 msg=hello", b"acmegate x=1"]
    (tmp_path / "in.log").write_bytes(b"\n".join(lines))
    found = sorted(engine.evaluated(collect.read_lines(spark, str(tmp_path / "in.log"))).collect(), key=lambda r: lines.index(bytes(r.payload)))
    first, second, third, bare = found
    assert (first.quality.status, first.quality.parsing_confidence, first.storable) == ("valid", 1.0, True)
    assert (first.event.category, first.event.type, first.event.name, first.event.message) == ("network", "flow", "Acme Gate event", "a b")
    assert (first.action.original, first.action.normalized, first.action.outcome) == ("DROP", "deny", "failure")
    assert (first.severity.normalized, first.severity.label, first.network.transport, first.observer.type) == (8, "high", "tcp", "firewall")
    assert (first.source.ip, first.source.port, first.destination.ip, first.destination.port) == ("192.0.2.1", 1024, "198.51.100.2", 443)
    assert (second.quality.status, second.event.category, second.severity.label) == ("partial", "unknown", "unknown")
    assert second.quality.missing_fields == ["destination.ip"] and second.network is None
    assert (third.quality.status, third.event.category, third.action.normalized) == ("valid", "system", "allow")
    assert (bare.event.category, bare.event.type, bare.quality.missing_fields, bare.storable) == ("unknown", "acme_event", ["event.message"], True)


def test_results_that_speak_of_other_events_count_for_nothing(spark):
    rows = parse(spark.createDataFrame([(i, "1.1.1.1", b"<38>Jan  2 03:04:05 node cron[77]: job") for i in ("a", "b", "c")], "event_id string, source_ip string, payload binary"))
    said = rows.withColumns({"said_event_id": F.when(F.col("event_id") == "b", "a").otherwise(F.col("event_id")), "said_raw_sha256": F.when(F.col("event_id") == "c", "0" * 64).otherwise(F.sha2("payload", 256))})
    found = {r.event_id: r for r in guarded(said).collect()}
    assert [found[i].status for i in "abc"] == ["success", "failed", "failed"] and found["a"].fields and not found["b"].fields
    assert [i.code for i in found["c"].issues] == ["PARSER_IDENTITY_MISMATCH"] and "said_event_id" not in found["a"]


def test_fields_of_one_pack_are_looked_up_for_its_events_only(spark, monkeypatch):
    from vantalog.plans import normalize as module

    monkeypatch.setattr(module, "_ASKED", {})
    monkeypatch.setattr(module, "_OWNER", {})
    rows = spark.createDataFrame([("cisco_asa", {"proto": "tcp", "src_ip": "10.0.0.1"}), ("suricata_eve", {"proto": "udp", "src_ip": "10.0.0.2"}), (None, {"proto": "x"})], "pack string, fields map<string,string>")
    found = lambda: [tuple(r.f) for r in rows.select(module._looked_up().alias("f")).collect()]
    module._f("proto", "suricata_eve"), module._f("src_ip")
    assert found() == [(None, "10.0.0.1"), ("udp", "10.0.0.2"), (None, None)]
    module._f("proto")  # a mapping that came as data asks for it too
    assert found() == [("tcp", "10.0.0.1"), ("udp", "10.0.0.2"), ("x", None)]
