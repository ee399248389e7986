"""Text helpers as Column expressions: decoding, groups of a pattern, slugs, addresses, ports, timestamps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEP = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BUILT: dict = {}


def built(key, build: Callable):
    """What ``build()`` gives, built once a Spark application: large expressions take seconds to put together, call by call."""
    context = SparkContext._active_spark_context
    at = (context.applicationId if context else None, key)
    if at not in _BUILT:
        _BUILT[at] = build()
    return _BUILT[at]


def computed_once(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a row count observed under ``name``. Filters and projections above don't move below an observation, so what stands below is planned and computed once however often it is used."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


_METHODS = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that run in here fall back to code per projection where a stage's method passes 8,000 bytes: beyond that the JVM doesn't compile methods, and wide stages run interpreted."""
    before = spark.conf.get(_METHODS, None)
    spark.conf.set(_METHODS, "8000")
    try:
        yield
    finally:
        spark.conf.unset(_METHODS) if before is None else spark.conf.set(_METHODS, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Of plans that run in here once, as writes do, the shuffle files go when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def decoded(payload: Column) -> Column:
    """Bytes as text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(payload.cast("string"))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def groups(text: Column, pattern: str, names: list[str], whole: bool = True) -> Column:
    """The pattern's groups as map from name to text, null without a match. One pass of the regex per row.

    Groups that took no part are left out, and so are empty ones. ``whole``: the pattern must reach the end of the text.
    """
    full = f"(?sU)^(?:{pattern})" + ("$" if whole else ".*$")
    parts = F.split(F.regexp_replace(text, full, _SEP.join(f"${i + 1}" for i in range(len(names)))), _SEP)
    found = let(parts, lambda p: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), p), lambda _, v: v != ""))
    return F.when(text.rlike(full), found)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.split(text, r"(?U)\s+")


def after(text: Column, start: Column) -> Column:
    """What stands behind ``start``, with which the text begins."""
    return F.substr(text, F.length(start) + 1)


def entries(**values: Column) -> Column:
    """A map of the values that are neither null nor empty."""
    return F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda _, v: v != "")


def slug(text: Column, fallback: Column) -> Column:
    """Lower-case letters and digits joined by underscores; the fallback if that doesn't begin with a letter."""
    made = F.trim(F.regexp_replace(F.lower(strip(F.when(text != "", text).otherwise(fallback))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.when(made.rlike("^[a-z]"), made), fallback)


_ZONE = r"%[^%/]+$"
_V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
_V6 = r"^(?=.*:)(?!.*:::)(?!.*::.*::)(:|[0-9a-f])(:|[0-9a-f]{1,4}(?=:|$)|(?<=:)[0-9a-f]{1,4})*$"


def _compressed(text: Column) -> Column:
    """An IPv6 address of hexadecimal groups in canonical form, null if it isn't one."""
    short = F.instr(text, "::") > 0
    side = lambda i: F.filter(F.split(F.get(F.split(text, "::"), F.lit(i)), ":"), lambda g: g != "")
    filled = F.concat(side(0), F.array_repeat(F.lit("0"), F.lit(8) - F.size(side(0)) - F.size(side(1))), side(1))
    every = F.when(short, F.when(F.size(side(0)) + F.size(side(1)) <= 7, filled)).otherwise(F.split(text, ":"))
    plain = F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    cut = lambda p: F.coalesce(*[F.when(F.instr(F.concat(F.lit(":"), p, F.lit(":")), F.lit(":" + ":".join(["0"] * n) + ":")) > 0, F.regexp_replace(F.concat(F.lit(":"), p, F.lit(":")), f"^(.*?):{':'.join(['0'] * n)}:(.*)$", "$1::$2")) for n in range(8, 1, -1)], F.concat(F.lit(":"), p, F.lit(":")))
    trimmed = let(cut(plain), lambda c: F.regexp_replace(F.regexp_replace(c, "^:(?!:)", ""), "(?<!:):$", ""))
    return F.when(F.size(every) == 8, trimmed)


def valid_ip(text: Column) -> Column:
    """The canonical text of an IPv4 or IPv6 address, null for anything else. IPv6 may have a zone, which stays as it is, and an IPv4 address as its tail. Leading zeros in IPv4 aren't accepted."""
    zone = F.regexp_extract(text, _ZONE, 0)
    low = F.lower(F.regexp_replace(text, _ZONE, ""))
    tail = F.regexp_extract(low, r":((?:\d{1,3}\.){3}\d{1,3})$", 1)
    byte = lambda i: F.get(F.split(tail, r"\."), F.lit(i)).try_cast("int")
    hexed = F.concat(F.regexp_replace(low, r"[\d.]+$", ""), F.format_string("%x:%x", byte(0) * 256 + byte(1), byte(2) * 256 + byte(3)))
    plain = F.when(tail == "", low).when(tail.rlike(_V4), hexed)
    six = let(plain, lambda p: F.when(p.rlike(_V6) & (F.instr(p, ":") > 0), _compressed(p)))
    return F.when(text.rlike(_V4), text).when(text.isNotNull(), F.concat(six, zone))


def valid_port(text: Column) -> Column:
    """An integer from 0 to 65535, null for anything else."""
    port = text.cast("string").try_cast("int")
    return F.when(port.between(0, 65535), port)


def utc_z(ts: Column) -> Column:
    """ISO 8601 with six digits and Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def zoned_timestamp(text: Column) -> Column:
    """A timestamp from ISO text with a zone; null without one."""
    return F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def any_timestamp(text: Column) -> Column:
    """A timestamp from ISO text that ends in Z or an offset, or from a BSD syslog time, which has no year and gets 1900; null for anything else."""
    iso = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}((\.\d{1,6})?Z|[+-]\d\d:?\d\d)$")
    bsd = text.rlike(r"^[A-Za-z]{3}\s+\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$")
    zoned = F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2")
    dated = F.concat(F.lit("1900 "), F.regexp_replace(text, r"\s+", " "))
    return F.when(iso, F.try_to_timestamp(zoned)).when(bsd, F.try_to_timestamp(dated, F.lit("yyyy MMM d H:m:s")))


def safe_token(text: Column, allowed: str = "A-Za-z0-9_-") -> Column:
    """Text fit for a path: other characters become underscores; ``unknown`` if nothing is left."""
    made = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{allowed}]+", "_"), F.lit("_"))
    return F.when(made == "", "unknown").otherwise(made)


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys, without null fields."""
    return F.parse_json(F.to_json(value)).cast("string")
