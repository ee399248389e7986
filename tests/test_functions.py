"""Scalar helpers and format parsers, on single rows."""

import pytest
from pyspark.sql import functions as F

from vantalog.functions import parsers, text


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(("given", "expected"), [("10.0.0.1", "10.0.0.1"), ("010.0.0.1", None), ("256.1.1.1", None), ("1.2.3", None), ("2001:0DB8::0001", "2001:db8::1"), ("::", "::"), ("::1", "::1"), ("1:0:0:2:0:0:0:3", "1:0:0:2::3"), ("fe80::1%eth0", "fe80::1%eth0"), ("::ffff:1.2.3.4", "::ffff:102:304"), ("::ffff:1.2.3.400", None), ("1.2.3.4%eth0", None), ("1:2:3:4:5:6:7:8:9", None), ("1::2::3", None), ("", None), (None, None), ("abcd", None)])
def test_valid_ip(spark, given, expected):
    assert one(spark, text.valid_ip(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(("given", "expected"), [("443", 443), ("70000", None), ("-1", None), ("x", None), (None, None), ("0", 0)])
def test_valid_port(spark, given, expected):
    assert one(spark, text.valid_port(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(("given", "expected"), [("Attempted Recon!", "attempted_recon"), ("9lives", "other"), ("", "other"), ("  A--b ", "a_b")])
def test_slug(spark, given, expected):
    assert one(spark, text.slug(F.lit(given), F.lit("other"))) == expected


def test_decoding_keeps_good_text_and_replaces_the_rest(spark):
    assert one(spark, text.decoded(F.lit(b"a\xff\x00b").cast("binary"))) == "a�\x00b"


def test_zoned_timestamp_needs_a_zone(spark):
    assert one(spark, text.zoned_timestamp(F.lit("2024-01-02T03:04:05"))) is None
    assert one(spark, text.utc_z(text.zoned_timestamp(F.lit("2024-01-02T03:04:05.5+0100")))) == "2024-01-02T02:04:05.500000Z"


def test_key_value_last_wins_and_quotes(spark):
    assert one(spark, parsers.key_value(F.lit('a=1 b="two words" c="" a=3 junk'))) == {"a": "3", "b": "two words", "c": ""}
    assert one(spark, parsers.key_value(F.lit("nothing here"))) is None


def test_key_value_compares_keys_only_where_some_repeat(spark):
    lines = spark.createDataFrame([("a=1 b=2 a=3",), ('c="" d="x y" e=5',), ("nothing",)], "line string").select(parsers.key_value(F.col("line")).alias("c"))
    assert [r.c for r in lines.collect()] == [{"b": "2", "a": "3"}, {"c": "", "d": "x y", "e": "5"}, None]
    assert "array_distinct" in lines._jdf.queryExecution().analyzed().toString()


def test_syslog_variants(spark):
    old = one(spark, parsers.syslog(F.lit("<38>Jan  2 03:04:05 node cron[7]: job done")))
    assert (old["facility"], old["severity_code"], old["variant"], old["procid"], old["message"]) == ("4", "6", "rfc3164", "7", "job done")
    new = one(spark, parsers.syslog(F.lit("<165>1 2024-01-02T03:04:05Z host app 1 ID7 [x y=\"z\"] hi")))
    assert (new["facility"], new["variant"], new["structured_data"], new["message"]) == ("20", "rfc5424", '[x y="z"]', "hi")
    assert one(spark, parsers.syslog(F.lit("no header"))) is None


def test_csv(spark):
    assert one(spark, parsers.csv(F.lit('1,"a, ""b""",'), ["x", "y", "z", "w"])) == {"x": "1", "y": 'a, "b"', "z": "", "w": ""}
    assert one(spark, parsers.csv(F.lit("p,q"))) == {"col_0": "p", "col_1": "q"}


def test_cef(spark):
    got = one(spark, parsers.cef(F.lit(r"CEF:0|V|P|1|9|a\|b|5|src=10.0.0.1 spt=9")))
    assert (got["name"], got["severity"], got["src"], got["spt"]) == ("a|b", "5", "10.0.0.1", "9")
    assert one(spark, parsers.cef(F.lit("CEF:0|too|short"))) is None


def test_json_object(spark):
    as_text = lambda s: one(spark, parsers.json_object(F.lit(s)).cast("string"))
    assert as_text('{"b":1,"a":2}') == '{"a":2,"b":1}' and as_text("[1]") == '{"value":[1]}' and as_text('log: {"a":1}') == '{"a":1}' and as_text("none") is None
