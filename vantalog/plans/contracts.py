"""Contracts of documents on the wire: which keys an object may and must have, and what their values must be, read from VARIANT.

Whether a key is absent or null shows in VARIANT, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, valid_ip, zoned_timestamp

Check = Callable[[Column], Column]  # of a value as variant: whether it is good

_UUID = r"^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$"


def _is(value: Column, *kinds: str) -> Column:
    """Whether a value is there and of one of the kinds, as VARIANT names them."""
    return F.coalesce(F.schema_of_variant(value).isin(*kinds), F.lit(False))


def text(value: Column) -> Column:
    return _is(value, "STRING")


def nullable(check: Check) -> Check:
    return lambda value: _is(value, "VOID") | check(value)


def one_of(*allowed: str) -> Check:
    return lambda value: text(value) & value.cast("string").isin(*allowed)


def matching(pattern: str) -> Check:
    return lambda value: text(value) & value.cast("string").rlike(pattern)


def count(value: Column) -> Column:
    return _is(value, "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= 0)


def whole_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def address(value: Column) -> Column:
    return text(value) & valid_ip(value.cast("string")).isNotNull()


def utc_time(value: Column) -> Column:
    """An ISO time whose zone says that it is UTC."""
    told = value.cast("string")
    return text(value) & told.rlike(r"(?i)(z|[+-]00:?00)$") & zoned_timestamp(told).isNotNull()


def any_time(value: Column) -> Column:
    return text(value) & F.try_to_timestamp(value.cast("string")).isNotNull()


def base64(value: Column) -> Column:
    return text(value) & F.try_to_binary(value.cast("string"), F.lit("base64")).isNotNull()


def items(check: Check) -> Check:
    """A list whose items are all good."""
    return lambda value: F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), check), F.lit(False))


def shaped(needed: dict[str, Check], optional: dict[str, Check]) -> Check:
    """An object with all needed keys, perhaps optional ones and no others, whose values are good."""

    def check(value: Column) -> Column:
        part = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
        keys = F.coalesce(F.json_object_keys(value.cast("string")), F.array().cast("array<string>"))
        known = F.size(F.array_except(keys, F.array(*map(F.lit, [*needed, *optional])))) == 0
        there = [good(part(name)) for name, good in needed.items()]
        perhaps = [part(name).isNull() | good(part(name)) for name, good in optional.items()]
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), [*there, *perhaps], whole_object(value) & known)

    return check


# The keys of envelopes and parsed events, and the words that some of them take.
_RAW = shaped(
    {
        "event_id": matching(_UUID),
        "ingested_at": utc_time,
        "source_id": text,
        "transport": one_of("udp", "tcp", "file", "api", "replay"),
        "raw_payload_b64": base64,
        "raw_size": count,
        "raw_sha256": matching("^[0-9a-f]{64}$"),
        "collector_id": text,
        "collector_version": text,
    },
    {"contract_version": one_of("1.0.0"), "source_ip": nullable(address), "metadata": whole_object},
)
_ISSUE = shaped({"code": text, "message": text, "severity": one_of("warning", "error", "critical")}, {"field": nullable(text)})


def raw_contract(value: Column) -> Column:
    """An envelope: its keys and their values, and its bytes have the recorded size and hash."""
    got = lambda name, kind="string": F.try_variant_get(value, f"$.{name}", kind)
    payload = F.try_to_binary(got("raw_payload_b64"), F.lit("base64"))
    evidence = (F.length(payload) == got("raw_size", "bigint")) & (F.sha2(payload, 256) == got("raw_sha256"))
    return _RAW(value) & F.coalesce(evidence, F.lit(False))


_PARSED = shaped(
    {
        "event_id": matching(_UUID),
        "parsed_at": any_time,
        **{name: nullable(text) for name in ("vendor", "product", "product_version", "source_pack_id", "source_pack_version")},
        **{name: text for name in ("parser_id", "parser_version", "detected_format")},
        "status": one_of("success", "partial", "failed", "unrecognized"),
        "raw_event": raw_contract,
    },
    {"contract_version": one_of("1.0.0"), "issues": items(_ISSUE), "extracted_fields": whole_object},
)


def parsed_contract(value: Column) -> Column:
    """A parsed event: its keys and their values, its envelope, and it speaks of that envelope's event."""
    plain = lambda name: F.lower(F.replace(F.try_variant_get(value, f"$.{name}", "string"), F.lit("-"), F.lit("")))
    return _PARSED(value) & F.coalesce(plain("event_id") == plain("raw_event.event_id"), F.lit(False))


def contract_error(document: Column, contract: Check, code: str) -> Column:
    """``code`` for a document that isn't as the contract says, or no JSON; null for a good one."""
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(document), document))
    return let(parsed, lambda v: F.when(~F.coalesce(contract(v), F.lit(False)), code))


def raw_contract_error(document: Column) -> Column:
    return contract_error(document, raw_contract, "INVALID_RAW_CONTRACT")


def parsed_contract_error(document: Column) -> Column:
    return contract_error(document, parsed_contract, "INVALID_PARSED_CONTRACT")
