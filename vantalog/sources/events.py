"""Raw log lines rendered from the events table, so that every query's work follows that table's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its times are UTC, as the session's time zone must be."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [n for n, kind in rows.dtypes if kind == "timestamp_ntz"]
    return rows.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else rows


#: Rows that a task parses at most.
TASK_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over all cores, in tasks of at most ``TASK_ROWS``: parsing costs far more than moving such rows. Splits say nothing of rows: a file's row group lies in one split, and the file's other splits are empty. Rows are counted from the files' footers."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, -(-rows.count() // (TASK_ROWS * cores))))


def uuid_of(number: Column) -> Column:
    return F.format_string("00000000-0000-4000-8000-%012d", number)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def render(events: DataFrame) -> DataFrame:
    """event_id (UUID text), seq, ts, ingested_at, source_id, source_ip, transport, payload: one raw event per row.

    seq % 7 picks the device: 0 firewall denials, 1 firewall connections, access lists and an unknown message, 2
    key-value traffic, 3 key-value logins, 4 syslog of two kinds and a broken one, 5 JSON of four kinds and an invalid
    one, 6 noise.
    """
    e, u, k, m = F.col("event_id"), F.col("user_id"), F.col("event_id") % 7, F.floor(F.col("event_id") / 7)
    say = lambda form, *cols: F.format_string(form, *cols)
    src, dst = say("10.%d.%d.%d", u % 250, e % 250, e % 200 + 1), say("198.51.100.%d", e % 254 + 1)
    sport, dport = (1024 + e % 50000).cast("long"), F.element_at(F.array(*map(F.lit, (443, 80, 22, 53))), (e % 4 + 1).cast("int")).cast("long")
    head = F.concat(F.lit("<166>"), F.date_format("ts", "MMM dd yyyy HH:mm:ss"), say(" edge-%d : ", u % 10))
    proto = F.when(e % 2 == 0, "tcp").otherwise("udp")
    deny = F.concat(head, say('%%ASA-4-106023: Deny %s src outside:%s/%d dst inside:%s/%d by access-group "EDGE"', proto, src, sport, dst, dport))
    conn = F.when(
        m % 4 == 0, F.concat(head, say("%%ASA-6-302013: Built inbound TCP connection %d for outside:%s/%d (%s/%d) to inside:%s/%d", e, src, sport, src, sport, dst, dport))
    ).when(m % 4 == 1, F.concat(head, say("%%ASA-6-302014: Teardown outbound UDP connection %d for outside:%s/%d to inside:%s/%d duration 0:01:00", e, src, sport, dst, dport))
    ).when(m % 4 == 2, F.concat(head, say("%%ASA-5-106100: access-list EDGE permitted tcp outside/%s(%d) -> inside/%s(%d) hit-cnt 1", src, sport, dst, dport))
    ).otherwise(F.concat(head, say("%%ASA-5-111008: User 'u%d' executed the 'write' command.", u)))
    kv_head = F.concat(F.date_format("ts", "'date='yyyy-MM-dd 'time='HH:mm:ss"), say(' devname="FG-%d" devid="FGX%d" logid="%010d" ', u % 10, u % 10, e))
    traffic = F.concat(kv_head, say('type="traffic" subtype="forward" level="%s" srcip=%s srcport=%d srcintf="lan" dstip=%s dstport=%d dstintf="wan" proto=%d action="old" action="%s" sentbyte=%d', F.when(m % 2 == 0, "notice").otherwise("warning"), src, sport, dst, dport, F.when(e % 2 == 0, 6).otherwise(17).cast("long"), F.when(m % 2 == 0, "accept").otherwise("deny"), e % 1000))
    login = F.concat(kv_head, say('type="event" subtype="user" level="information" action="login" user="u%d" status="%s" msg="login of u%d"', u, F.when(m % 3 == 0, "failed").otherwise("success"), u))
    linux = F.when(m % 3 == 0, F.concat(say("<%d>", 8 * 4 + e % 8), F.date_format("ts", "MMM dd HH:mm:ss"), say(" node-%d cron[%d]: job %d finished", u % 10, e % 9000, e))).when(m % 3 == 1, F.concat(say("<%d>1 ", 8 * 10 + e % 8), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), say(" node-%d sshd %d - - session %d opened", u % 10, e % 9000, e))).otherwise(say("sshd lost its header %d", e))
    common = {"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'"), "flow_id": e, "src_ip": src, "src_port": F.when(m % 5 == 4, 70000).otherwise(sport), "dest_ip": dst, "dest_port": dport, "proto": F.upper(proto)}
    eve = (
        F.when(m % 5 == 0, _json(**common, event_type=F.lit("alert"), alert=F.struct(F.when(e % 2 == 0, "blocked").otherwise("allowed").alias("action"), e.alias("signature_id"), say("Rule %d", e % 50).alias("signature"), F.lit("Attempted Recon").alias("category"), (e % 4 + 1).alias("severity"))))
        .when(m % 5 == 1, _json(**common, event_type=F.lit("flow"), flow=F.struct((e % 10).alias("pkts_toserver"), (e % 7).alias("pkts_toclient"), (e % 5000).alias("bytes_toserver"), (e % 3000).alias("bytes_toclient"), F.lit("closed").alias("state"), F.lit("timeout").alias("reason"))))
        .when(m % 5 == 2, _json(**common, event_type=F.lit("dns"), dns=F.struct(F.lit("query").alias("type"), say("h%d.example", e % 100).alias("rrname"))))
        .otherwise(_json(**common, event_type=F.lit("http"), http=F.struct(say("h%d.example", e % 100).alias("hostname"), say("/p/%d", e % 10).alias("url"), F.lit("get").alias("http_method"), F.lit(200).alias("status"))))
    )
    noise = say("noise %d without a format", e)
    line = F.when(k == 0, deny).when(k == 1, conn).when(k == 2, traffic).when(k == 3, login).when(k == 4, linux).when(k == 5, eve).otherwise(noise)
    return events.select(uuid_of(e).alias("event_id"), e.alias("seq"), "ts", (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("ingested_at"), say("dev-%d", u % 20).alias("source_id"), say("192.0.2.%d", u % 250).alias("source_ip"), F.lit("file").alias("transport"), line.cast("binary").alias("payload"))
