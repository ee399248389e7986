"""Queries over all rendered events against their SQL, and delivery lines against serialisers in Python."""

import datetime
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vantalog.functions.text import utc_z
from vantalog.operators import store
from vantalog.plans import catalog
from vantalog.plans.normalize import SECTIONS, unified_json
from vantalog.plans.packs import PACKS
from vantalog.sources import events


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    start = datetime.datetime(2024, 1, 10)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), i * 13 % 50, ("view", "error")[i % 4 == 1], i / 7, "{}") for i in range(280)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(2).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["asa_deny_fields", "asa_connection_fields", "semantic_rule_hits", "canonical_json", "cef_lines", "rfc5424_lines", "delivery_reconcile", "structural_rule_hits", "canonical_json_all", "semantic_rule_hits_all", "structural_rule_hits_all", "stream_outcomes", "facet_lists", "source_shares", "lake_read_back", "jsonl_read_back", "latest_percentile", "worker_resources", "timestamp_forms"])
def test_agrees_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{sf_dir}/events.parquet/*.parquet'")
    con.sql("SET TimeZone = 'UTC'")
    wanted = con.sql(catalog.ORACLE_SQL[name])
    found = catalog.QUERIES[name](spark, sf_dir).select(*wanted.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted.fetchall())) and found


def test_events_are_selected_by_what_was_parsed(spark, sf_dir, monkeypatch):
    raw = catalog.raw
    names = ("asa_deny_fields", "asa_connection_fields", "semantic_rule_hits")
    before = [catalog.QUERIES[n](spark, sf_dir).drop("seq").collect() for n in names]
    monkeypatch.setattr(catalog, "raw", lambda *a: raw(*a).withColumn("seq", F.col("seq") * 7 + 3))
    assert [sorted(catalog.QUERIES[n](spark, sf_dir).drop("seq").collect(), key=repr) for n in names] == [sorted(b, key=repr) for b in before]


def _cef(r):
    def escaped(v, *more):
        for a, b in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("|", "\\|"), *more):
            v = str(v).replace(a, b)
        return v

    t, ends = r.traceability, [(a, getattr(s, n) if s else None) for s, names in ((r.source, ("src", "spt")), (r.destination, ("dst", "dpt"))) for a, n in zip(names, ("ip", "port"), strict=True)]
    pairs = [("schemaVersion", "1.0.0"), ("externalId", r.event_id), ("rawSha256", t.raw_sha256), ("sourcePack", t.source_pack.name), ("sourcePackVersion", t.source_pack.version), ("parser", t.parser.name), ("parserVersion", t.parser.version), ("quality", r.quality.status), ("act", r.action.normalized), ("msg", r.event.message or None), *ends]
    told = " ".join(f"{k}={escaped(v, ('=', chr(92) + '='))}" for k, v in pairs if v is not None)
    return f"CEF:0|Vantalog|Engine|1.0.0|{escaped(r.event.type)}|{escaped(r.event.name)}|{r.severity.normalized}|{told}"


def _rfc5424(r):
    t = r.traceability
    param = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("]", "\\]")
    token = lambda v: "".join(c if "!" <= c <= "~" else "_" for c in v or "-")[:48]
    pairs = [("schemaVersion", "1.0.0"), ("eventId", r.event_id), ("rawSha256", t.raw_sha256), ("sourcePack", t.source_pack.name), ("sourcePackVersion", t.source_pack.version), ("parser", t.parser.name), ("parserVersion", t.parser.version), ("quality", r.quality.status)]
    data = " ".join(f'{k}="{param(v)}"' for k, v in pairs)
    message = (r.event.message or r.event.name).replace("\r", " ").replace("\n", " ")
    return f"<{128 + min(max(r.severity.normalized, 0), 7)}>1 {r.observed} {token(r.observer.hostname)} vantalog - {token(r.event.type)} [vantalog@32473 {data}] {message}"


@pytest.mark.parametrize("name, line", [("cef_lines_all", _cef), ("rfc5424_lines_all", _rfc5424)])
def test_delivery_lines_of_all_events(spark, sf_dir, monkeypatch, name, line):
    raw = catalog.raw
    text = F.replace(F.col("payload").cast("string"), F.lit("login of"), F.lit("a = b|c] of"))
    monkeypatch.setattr(catalog, "raw", lambda *a: raw(*a).withColumn("payload", text.cast("binary")))
    monkeypatch.setattr(catalog, "_STORED", {})
    events = catalog.unified(spark, sf_dir).withColumn("observed", F.date_format("time.observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).collect()
    found = {r.event_id: r.line for r in catalog.QUERIES[name](spark, sf_dir).collect()}
    assert found == {r.event_id: line(r) for r in events}
    assert len(found) == 280 and len({r.pack for r in events}) == 5
    assert any("a = b|c]" in (r.event.message or "") for r in events) and any(r.source and r.source.port for r in events)


def test_unified_json_is_canonical(spark, sf_dir):
    """Structs written in order are the text that a detour over VARIANT gives: sorted keys, no nulls, no trailing .0."""
    time = F.struct(*[utc_z(F.col(f"time.{n}")).alias(n) for n in ("ingested_at", "normalized_at", "observed_at")])
    detour = F.parse_json(F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), *[(time if s == "time" else F.col(s)).alias(s) for s in SECTIONS]))).cast("string")
    found = catalog.unified(spark, sf_dir).select(detour.alias("a"), unified_json().alias("b")).collect()
    assert len(found) > 100 and all(r.a == r.b for r in found)


def test_json_is_made_once_a_row(spark, sf_dir, tmp_path):
    """Ranges are found by a pass over the rows in which no JSON is made."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(event_id):
        asked.add(1)
        return event_id

    stored = catalog.unified(spark, sf_dir).where("storable")
    store._append(stored, F.col("time.observed_at"), str(tmp_path), lambda r: store.event_rows(r, "month").withColumn("normalized_json", made("event_id")))
    assert asked.value == stored.count() == spark.read.parquet(f"{tmp_path}/events").count()


def test_unified_events_do_not_wait_for_the_event_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "_STORED", {})
    monkeypatch.setattr(catalog.store, "write_events", lambda *_: pytest.fail("the event table isn't asked"))
    assert catalog.action_map(spark, sf_dir).count() > 0


def test_parsed_values_are_bound(spark):
    """What a firewall's parser asks several times is computed once: its expression stays small."""
    own = next(p for p in PACKS if p.pack_id == "cisco_asa").parsed(F.col("text"))
    plan = spark.createDataFrame([("a",)], "text string").select(own)._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") < 100


def test_rows_are_dealt_whatever_the_splits(spark, tmp_path, monkeypatch):
    """A file of one row group has as many splits as its bytes make, and all rows lie in one of them."""
    spark.range(9000).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = events.table(spark, str(tmp_path), "events")
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        told = events.spread(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(told) == 4 and max(r["count"] for r in told) < 3000
    monkeypatch.setattr(events, "TASK_ROWS", 1000)
    assert events.spread(spark.range(9000)).rdd.getNumPartitions() == 12


def test_what_is_long_is_written_once(spark, sf_dir):
    """The payload and its fields are parts of the sections; beside them they aren't written again."""
    assert not {"payload", "fields", "text"} & set(catalog.unified(spark, sf_dir).columns)


@pytest.mark.parametrize("name", ["lookup_by_id", "lookup_by_hash", "replacing_final"])
def test_lookups_move_no_json(spark, sf_dir, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert not [line for line in plan.splitlines() if "normalized_json" in line and "Relation [" not in line]


def test_rules_read_their_sections_only(spark, sf_dir):
    """Each event is copied once a rule: what no rule reads isn't."""
    plan = catalog.semantic_rule_hits_all(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    scan = next(line for line in plan.splitlines() if "Relation [" in line)
    assert "traceability#" in scan and not any(f"{n}#" in plan.split("Generate explode")[0] for n in ("http", "network", "observer"))


def test_delivery_lines_are_read_once(spark, sf_dir):
    plan = catalog.cef_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)CEF:(.*)$") == 1


def moved(frame):
    """What the exchanges between tasks say of themselves, columns and all, of the plan for tables that are too large to be sent around."""
    spark = frame.sparkSession
    conf = {"spark.sql.debug.maxToStringFields": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        told = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return [part for part in told.split("\n\n") if part.split("\n")[0].endswith(") Exchange")]


@pytest.mark.parametrize("name", ["structural_rule_hits", "structural_rule_hits_all", "canonical_json", "canonical_json_all", "delivery_reconcile", "event_row_projection"])
def test_passes_over_the_table_leave_its_rows_where_they_are(spark, sf_dir, name):
    """Only keys, versions and places move to find the versions that count."""
    exchanges = moved(catalog.QUERIES[name](spark, sf_dir))
    assert any("event_id" in part for part in exchanges) and not any("normalized_json" in part or "destination_ip" in part for part in exchanges)


def test_the_table_leaves_no_shuffle_behind(spark, sf_dir, monkeypatch, tmp_path):
    """What writing the tables moved is gone when they are there, and they are packed."""
    monkeypatch.setattr(catalog, "_STORED", {})
    local = lambda: sum(len(files) for at, _, files in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for f in files if f.startswith("shuffle_"))
    before = local()
    at = catalog.stored(spark, sf_dir)
    assert local() <= before
    files = [f for table in (at, catalog._written(spark, sf_dir, "unified", lambda _: pytest.fail("it is there"))) for f in Path(table.removeprefix("file://")).rglob("*.parquet")]
    assert files and all(f.name.endswith(".zstd.parquet") for f in files if "quarantine" not in f.parts)


def test_lines_are_made_once_after_they_were_dealt(spark, sf_dir):
    """Whether a line is accepted is asked of the dealt lines, not of the files' splits, which would make them too."""
    plan = catalog.envelopes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Repartition ")[1]
    assert "format_string" not in below and plan.count("executed the") == 1
