"""Streams with state, topics, committed exports, point reads, poison messages, line ids."""

import datetime
import gzip
import json
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vantalog.operators import collect, export, recent, store
from vantalog.sources import topics
from vantalog.streaming import measures, poison, stages


def brute(rows, room):
    """Whether each (n, source, digest) is in its source's list of the latest digests."""
    caches, out = {}, {}
    for n, source, digest in sorted(rows):
        cache = caches.setdefault(source, [])
        out[n] = digest is not None and digest in cache
        if digest is not None:
            caches[source] = ([d for d in cache if d != digest] + [digest])[-room:]
    return out


def arrivals(seed=3, n=240):
    rng = random.Random(seed)
    return [(i, rng.choice("aaab"), rng.choice(["u", "v", "w", "x", "y", "z", None])) for i in range(n)]


@pytest.mark.parametrize("room", [1, 3, 100])
def test_recent_duplicates_of_a_table(spark, room):
    rows = arrivals()
    found = recent.flag_recent_duplicates(spark.createDataFrame(rows, "n long, source string, digest string").repartition(5), "digest", "n", "source", room)
    assert found.columns == ["n", "source", "digest", "duplicate"]
    assert {r.n: r.duplicate for r in found.collect()} == brute(rows, room)


def test_recent_duplicates_of_a_stream_over_batches_and_a_restart(spark, tmp_path):
    rows, kind = arrivals(5), "n long, source string, digest string"
    out = f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with recent.state_in_rocksdb(spark):
            flagged = recent.live_flags(stream, "digest", "n", "source", 3)
            flagged.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:80], rows[80:160]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(rows[160:], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # started anew from its checkpoint
    found = {r.n: r.duplicate for r in spark.read.parquet(out).collect()}
    assert found == brute(rows, 3) and len(list(Path(out).glob("batch=*"))) == 3


def test_rollups_are_read_tolerantly_and_merge(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(seconds=i // 10), f"w{i % 3}", 10, None if i % 50 == 0 else i) for i in range(3000)]
    events = spark.createDataFrame(rows, "ts timestamp, worker_id string, bytes long, latency long")
    for part in (0, 1):
        events.where(F.col("latency").isNull() | (F.col("latency") % 2 == part)).where(F.col("latency").isNotNull() | F.lit(part == 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for checkpoint in ("c1", "c2"):  # the whole stream runs again: its batches replace themselves
        measures.publish(measures.rollups(stream, seconds=60), f"{tmp_path}/topic", f"{tmp_path}/{checkpoint}").awaitTermination()
    good = (Path(tmp_path) / "topic").glob("batch=*/part-*")
    line = next(x for f in good for x in f.read_text().splitlines())
    broken = [line[:-5], line.replace('"check":', '"check":1'), json.dumps({**json.loads(line), "consumed": -1}), "no json", "[]", "null", json.dumps({**json.loads(line), "sketch": "!"})]
    spark.createDataFrame([(b,) for b in broken], "value string").write.text(f"{tmp_path}/topic/batch=99")
    told = measures.read(spark, f"{tmp_path}/topic")
    assert told.count() == 15 and told.agg(F.sum("consumed")).first()[0] == 3000
    whole = measures.report(told, 300.0).first()
    assert (whole.consumed, whole.bytes_in, whole.events_per_second, whole.latency_max) == (3000, 30000, 10.0, 2999)
    for p in (50, 95, 99):
        assert abs(whole[f"p{p}"] / 3000 - p / 100) < 0.015
    assert {r.worker_id: r.consumed for r in measures.report(told, 300.0, "worker_id").collect()} == {"w0": 1000, "w1": 1000, "w2": 1000}
    assert measures.report(told.limit(0), 1.0, "worker_id").count() == 0


def test_latencies_of_batches_reach_a_listener(spark, tmp_path):
    kind = "n long, first_seen timestamp, now timestamp"
    at = datetime.datetime(2024, 1, 1)
    for turn in range(3):
        rows = [(i, None if i % 4 == 3 else at, at + datetime.timedelta(milliseconds=100 * turn + i - 2)) for i in range(10)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = measures.BatchLatencies()
    spark.streams.addListener(listener)
    try:
        stream = measures.timed(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "first_seen", F.col("now"))
        stream.writeStream.foreachBatch(lambda b, i: b.write.parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(listener.batches) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    written = spark.read.parquet(f"{tmp_path}/out").groupBy("batch").agg(F.count("latency_ms").alias("n"), F.sum("latency_ms").alias("t"), F.max("latency_ms").alias("m"))
    assert sorted(b[1:] for b in listener.batches) == sorted(tuple(r) for r in written.collect())
    assert {b[2] for b in listener.batches} == {8}


def test_topics_keep_order_by_key_over_batches(spark, tmp_path):
    path = f"{tmp_path}/topic"
    for turn in range(3):
        rows = [(turn * 100 + i, f"s{i % 7}") for i in range(100)]
        random.Random(turn).shuffle(rows)
        topics.append(spark.createDataFrame(rows, "n long, source string").repartition(4), path, "source", "n", 5)
    buckets = {}
    for f in sorted(Path(path).glob("bucket=*/*.ndjson"), key=lambda f: f.name):
        for line in f.read_text().splitlines():
            r = json.loads(line)
            buckets.setdefault(r["source"], []).append((f.parent.name, r["n"]))
    assert len(buckets) == 7
    for own in buckets.values():
        assert len({b for b, _ in own}) == 1 and [n for _, n in own] == sorted(n for _, n in own)
    found = topics.read(spark, path, "n long, source string")
    assert sorted(r.n for r in found.collect()) == list(range(300)) and found.select("commit").distinct().count() == 3
    with pytest.raises(Exception, match="only appended"):
        found.select("bucket", F.lit("x").alias("value")).write.format(topics.FORMAT).mode("overwrite").save(path)


def test_failed_writes_leave_no_line(spark, tmp_path):
    path = f"{tmp_path}/topic"
    rows = spark.range(200).select(F.col("id").alias("n"), (F.col("id") % 9).cast("string").alias("source"))
    topics.append(rows, path, "source", "n", 6)
    before = topics.lines(spark, path).count()
    failing = rows.withColumn("source", F.when(F.col("n") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("source")))
    with pytest.raises(Exception, match="lost"):
        topics.append(failing, path, "source", "n", 6)
    # A task that wrote before it was lost: its file is there, but no commit names it.
    (Path(path) / "bucket=0").mkdir(exist_ok=True)
    (Path(path) / "bucket=0" / "00000000000000000001-dead-0.ndjson").write_text('{"n":1}\n')
    assert topics.lines(spark, path).count() == before == 200


def lake_rows(spark, n=300):
    rows = [(f"e{i}", "valid" if i % 3 else "partial", f'{{"i":{i},"t":"ä"}}') for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, quality_status string, normalized_json string").withColumn("schema_version", F.lit("1.0.0")).repartition(3)


def test_exports_are_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/export"
    made = export.commit_jsonl(lake_rows(spark), path)
    assert (made["total"], made["valid"], made["quarantine"], made["manifest_version"]) == (300, 200, 100, "2.0")
    assert json.loads((Path(path) / export.MANIFEST).read_text()) == made and not list(Path(tmp_path).glob("*.staged"))
    for f in made["files"]:
        data = (Path(path) / f["path"]).read_bytes()
        assert (len(data), data.count(b"\n")) == (f["bytes"], f["rows"])
    assert export.verify_committed(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        export.commit_jsonl(lake_rows(spark), path)
    victim = next(f["path"] for f in made["files"] if f["rows"])
    for crc in (Path(path) / victim).parent.glob(".*.crc"):
        crc.unlink()
    (Path(path) / victim).write_bytes((Path(path) / victim).read_bytes()[:-3] + b"!!\n")
    assert [tuple(r) for r in export.verify_committed(spark, path).collect()] == [(victim, "changed")]

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(export, "_files", killed)
    with pytest.raises(KeyboardInterrupt):
        export.commit_jsonl(lake_rows(spark), f"{tmp_path}/second")
    assert not (tmp_path / "second").exists()


def test_poison_is_isolated(spark, tmp_path):
    rows = spark.createDataFrame([(f"id-{i}", i) for i in range(10_000)], "event_id string, n long").repartition(4)

    @F.pandas_udf("long")
    def plug(n: pd.Series) -> pd.Series:
        if (n == 4321).any():
            raise ValueError("can't take 4321")
        return n * 2

    good, lost = poison.isolated(rows, lambda part: part.withColumn("n", plug("n")), f"{tmp_path}/a")
    assert good.count() == 9_999 and good.agg(F.sum("n")).first()[0] == 2 * (sum(range(10_000)) - 4321)
    assert [tuple(r) for r in lost.collect()] == [("id-4321", 4321)]
    good, lost = poison.isolated(rows.where("n < 5"), lambda part: part.withColumn("n", plug("n")), f"{tmp_path}/a")  # the same place again
    assert (good.count(), lost.count()) == (5, 0)
    good, lost = poison.isolated(rows.limit(0), lambda part: part, f"{tmp_path}/b")
    assert (good.count(), lost.count()) == (0, 0)


def envelopes(spark, payloads):
    at = datetime.datetime(2024, 1, 1)
    lines = spark.createDataFrame([(f"00000000-0000-4000-8000-{i:012d}", at, "s", None, "file", p) for i, p in enumerate(payloads)], "event_id string, ingested_at timestamp, source_id string, source_ip string, transport string, payload binary")
    return collect.envelope(collect.ingest(lines))


def test_undecodable_messages_keep_their_bytes_and_a_batch_replaces_itself(spark, tmp_path):
    sent = envelopes(spark, [b"<38>Jan  2 03:04:05 node cron[77]: job", b"noise", b"other"])
    sent = sent.withColumn("raw_payload_b64", F.when(F.col("event_id").endswith("2"), "no base64!").otherwise(F.col("raw_payload_b64")))
    stages.publish(sent, f"{tmp_path}/in", stages.RAW)
    for checkpoint in ("c1", "c2"):
        stages.run_pipeline(spark, f"{tmp_path}/in", sent.schema, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").awaitTermination()
    every = spark.read.option("recursiveFileLookup", "true")
    (dead,) = every.parquet(f"{tmp_path}/out/{stages.DEAD}").collect()
    digest = spark.range(1).select(F.sha2(F.lit("no base64!"), 256)).first()[0]
    assert (dead.raw_payload_b64, dead.payload, dead.key, dead.error_code) == ("no base64!", None, digest, "INVALID_RAW_CONTRACT")
    ends = every.schema("event_id string").parquet(f"{tmp_path}/out/events", f"{tmp_path}/out/quarantine").count()
    assert ends == 2  # each event once, though the stream ran twice


def rows_read(frame):
    """Rows that the scans below ``frame`` gave, once it has run."""
    frame.collect()
    todo, found = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_point_reads_pass_over_row_groups(spark, tmp_path):
    lines = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit(None).cast("string").alias("reason"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ingested_at"), F.concat(F.lit("payload "), F.col("id").cast("string")).cast("binary").alias("payload"))
    lines = lines.withColumn("raw_sha256", F.sha2("payload", 256)).repartition(8)
    collect.archive(lines, f"{tmp_path}/archive")
    archived = spark.read.parquet(f"{tmp_path}/archive")
    wanted = archived.where("payload = cast('payload 777' as binary)").first().event_id
    one = collect.archived_event(archived, wanted)
    assert bytes(one.first().payload) == b"payload 777" and rows_read(one) < 20_000 / 4
    assert rows_read(collect.points(archived, "raw_sha256", ["0" * 64])) < 20_000 / 4
    lost = archived.withColumn("payload", F.when(F.col("event_id") == wanted, F.lit(None)).otherwise(F.col("payload")))
    changed = archived.withColumn("raw_sha256", F.lit("0" * 64))
    assert [collect.archived_event(a, wanted).count() for a in (lost, changed)] == [0, 0]
    with pytest.raises(ValueError, match="at most"):
        collect.points(archived, "event_id", list("abcdefghijkl"))


def test_line_ids_follow_from_file_and_line_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %d\n" % (i % 40) for i in range(4000)) + b"\n\n\nend")
    ids = {}
    for splits in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
        try:
            ids[splits] = sorted(r.event_id for r in collect.read_lines(spark, f"{tmp_path}/a.log").collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "0.log").write_bytes(b"another\n")
    beside = {r.event_id for r in collect.read_lines(spark, str(tmp_path)).collect()}
    assert ids["128m"] == ids["4k"] and len(set(ids["4k"])) == 4004 and beside > set(ids["4k"]) and len(beside) == 4005


def test_searches_see_versions_that_count_and_reach_the_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 5)
    kind = ", ".join(f"{n} string" for n in ("event_id", "vendor", "product", "category", "event_type", "action", "severity_label", "quality_status", "raw_sha256", "normalized_json")) + ", observed_at timestamp, normalized_at timestamp"
    row = lambda i, action, turn: (f"e{i}", "Acme", "Gate", "network", "t", action, "low", "valid", f"{i:064d}", f'{{"n":{i}}}', at + datetime.timedelta(days=20 * (i % 4)), at + datetime.timedelta(hours=turn))
    make = lambda rows: spark.createDataFrame(rows, kind)
    store.append_rows(make([row(i, "allow", 0) for i in range(40)]), str(tmp_path))
    store.append_rows(make([row(i, "deny", 1) for i in range(0, 40, 3)] + [row(1, "allow", 0)]), str(tmp_path))
    store.append_rows(make([row(3, "late", 0), row(6, "again", 1)]), str(tmp_path))  # an old version that came late, and a second of one version
    rows = store.current(spark.read.parquet(f"{tmp_path}/events"))
    assert rows.count() == 40
    found = {a: {r.event_id for r in store.search(rows, action=a, limit=None).collect()} for a in ("allow", "deny", "late", "again")}
    denied = {f"e{i}" for i in range(0, 40, 3)} - {"e6"}
    assert found == {"allow": {f"e{i}" for i in range(40) if i % 3}, "deny": denied, "late": set(), "again": {"e6"}}
    plan = store.search(rows, action="deny", start="2024-02-01", end="2024-03-01", limit=None)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
    assert len(scans) >= 2 and all("month" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    wide = [s for s in scans if "vendor" in s]
    assert len(wide) < len(scans) and all("action" in s.split("DataFilters: [")[1].split("]")[0] for s in wide)
    assert {r.event_id for r in store.search(rows, action="deny", start="2024-02-01", end="2024-03-01", limit=None).collect()} == {e for e in denied if int(e[1:]) % 4 == 2}


def test_recent_duplicates_sql_forgets_as_the_cache_does(spark, tmp_path):
    """With more texts than a cache holds, the SQL has the cache's rule too."""
    import duckdb

    from vantalog.plans import live

    texts = ["again", *[f"t{i}" for i in range(recent.ROOM - 1)], "again", *[f"u{i}" for i in range(recent.ROOM)], "again", None, None]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": "s"}).to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    said = {n: flag for n, _, flag in db.execute(live._REPEATS).fetchall()}
    assert said == {r.doc_id: r.duplicate for r in live.recent_duplicates(spark, str(tmp_path)).collect()}
    assert [n for n, flag in said.items() if flag] == [recent.ROOM]


def test_poison_is_sought_in_what_failed(spark, tmp_path):
    """A try reads the rows that it tries: the whole is asked a few times only, however many halvings there are."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(n):
        asked.add(1)
        return n

    rows = spark.range(400).select(count("id").alias("n"), F.col("id").cast("string").alias("event_id"))
    bad = F.when(F.col("n") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("n"))
    good, lost = poison.isolated(rows, lambda part: part.withColumn("n", bad), str(tmp_path))
    assert [r.n for r in lost.collect()] == [77] and good.count() == 399
    assert asked.value <= 400 * 4


def test_versions_that_count_are_told_by_place(spark, tmp_path, monkeypatch):
    """``current_all`` gives the rows of ``current``, over several files, versions and bitmaps, facets and odd places included."""
    at, rng = datetime.datetime(2024, 1, 5), random.Random(4)
    kind = "event_id string, vendor string, action string, raw_sha256 string, normalized_json string, observed_at timestamp, normalized_at timestamp"
    row = lambda i, turn: (f"e{i}", "Acme", f"a{turn}", f"{i:064d}", f'{{"n":{i},"turn":{turn}}}', at + datetime.timedelta(days=20 * (i % 4)), at + datetime.timedelta(hours=turn))
    for turn in (3, 1, 2, 3):
        some = [row(i, turn) for i in range(400) if rng.random() < 0.6]
        store.append_rows(spark.createDataFrame(some, kind), str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/events")
    wanted = sorted(map(tuple, store.current(stored).select(*stored.columns).collect()), key=repr)
    for bits in (store._BITS, 8, 9):
        monkeypatch.setattr(store, "_BITS", bits)
        found = store.current_all(stored)
        assert found.columns == stored.columns and sorted(map(tuple, found.collect()), key=repr) == wanted, bits
    assert {r.event_id for r in found.where("action = 'a2'").collect()} == {w[0] for w in wanted if "a2" in w} != set()
    assert len(wanted) == stored.select("event_id").distinct().count() < stored.count()


def test_compressed_exports_are_there_whole_and_proven(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/export"
    made = export.commit_jsonl(lake_rows(spark), path, "gzip")
    lines = 0
    for f in made["files"]:
        data = (Path(path) / f["path"]).read_bytes()
        assert f["path"].endswith(".txt.gz") and (len(data), gzip.decompress(data).count(b"\n")) == (f["bytes"], f["rows"])
        lines += f["rows"]
    assert lines == made["total"] == 300 and export.verify_committed(spark, path).count() == 0
    victim = next(f["path"] for f in made["files"] if f["rows"])
    for crc in (Path(path) / victim).parent.glob(".*.crc"):
        crc.unlink()
    (Path(path) / victim).write_bytes(gzip.compress(b"{}\n"))
    assert [tuple(r) for r in export.verify_committed(spark, path).collect()] == [(victim, "changed")]


def test_committed_export_is_packed(spark, tmp_path, monkeypatch):
    from vantalog.plans import catalog, live

    rows = [(i, datetime.datetime(2024, 1, 10), i, "view", 0.5, "{}") for i in range(140)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "_STORED", {})
    monkeypatch.setattr(live, "new_path", lambda *_: f"{tmp_path}/export")
    (told,) = live.committed_export(spark, str(tmp_path)).collect()
    files = list((tmp_path / "export").rglob("*.txt*"))
    assert told.problems == 0 and told.total > 100 and files and all(f.name.endswith(".txt.gz") for f in files if not f.name.startswith("."))


def test_a_batch_is_kept_as_files_not_in_memory(spark, tmp_path, monkeypatch):
    """What a batch parsed and validated fills no executor's memory, and is gone when the batch is done; a topic's files are of bounded size."""
    from pyspark.sql.classic.dataframe import DataFrame

    asked, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "cache", lambda rows: pytest.fail("rows are cached"))
    monkeypatch.setattr(DataFrame, "persist", lambda rows, *level: asked.append(level) or persist(rows, *level))
    monkeypatch.setattr(stages, "FILE_ROWS", 30)
    sent = envelopes(spark, [b"<38>Jan  2 03:04:05 node cron[77]: job %d" % i for i in range(70)]).coalesce(1).withColumn("attempt", F.lit("0"))
    stages.publish(sent, f"{tmp_path}/in", stages.RAW)
    files = spark.read.parquet(f"{tmp_path}/in/{stages.RAW}").groupBy(F.col("_metadata.file_path")).count().collect()
    assert sorted(f["count"] for f in files) == [10, 30, 30]
    for turn in range(3):  # a tenth fails twice
        fails = (stages.attempt_of(F.col("attempt")) < 2) & F.col("event_id").endswith("7")
        now = F.lit(1_700_000_000_000 + turn * stages.HORIZON_MS)
        stages.run_pipeline(spark, f"{tmp_path}/in", sent.schema, f"{tmp_path}/out", f"{tmp_path}/c", fails, now).awaitTermination()
        left = stages.release_due(spark, f"{tmp_path}/in", sent.schema, f"{tmp_path}/out", now + stages.HORIZON_MS)
        assert left == (7 if turn < 2 else 0)
    assert asked and not any(level.useMemory for (level,) in asked)
    assert not list(tmp_path.glob("out/_*/batch=*"))
    every = spark.read.option("recursiveFileLookup", "true")
    assert every.parquet(f"{tmp_path}/out/events").select("event_id").distinct().count() == 70
    assert sorted(r.event_id for r in every.parquet(f"{tmp_path}/out/events").collect()) == sorted(r.event_id for r in every.parquet(f"{tmp_path}/out/{stages.NORMALIZED}").collect())


def test_what_is_released_comes_in_few_files(spark, tmp_path):
    """As many files as tasks that have work, not as partitions of the shuffle that sought what is due."""
    sent = envelopes(spark, [b"noise %d" % i for i in range(40)]).withColumn("attempt", F.lit("0"))
    stages.publish(sent, str(tmp_path), stages.RAW)
    held = sent.withColumns({"attempt": F.lit(1), "not_before_ms": F.lit(0).cast("long"), "stage": F.lit("parser")})
    held.write.parquet(f"{tmp_path}/out/{stages.RETRY}/batch=0")
    sent.limit(0).select("event_id").write.parquet(f"{tmp_path}/out/{stages.DEAD}/batch=0")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert stages.release_due(spark, str(tmp_path), sent.schema, f"{tmp_path}/out", F.lit(1_000).cast("long")) == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    released = spark.read.parquet(f"{tmp_path}/{stages.RAW}").where("attempt = '1'")
    assert released.count() == 40 and released.select("_metadata.file_path").distinct().count() <= spark.sparkContext.defaultParallelism
