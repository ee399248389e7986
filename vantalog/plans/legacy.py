"""Parsed events in the two shapes of earlier versions, adapted to the present one without adding or guessing anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import zoned_timestamp
from .packs import ISSUE, issue

# What earlier versions called the states of parsing.
STATES = {"success": "success", "partial": "partial", "failed": "failed", "error": "failed", "unrecognized": "unrecognized", "unparsed_fallback": "unrecognized"}
_ISSUES = f"array<{ISSUE}>"


def adapted(documents: DataFrame, document: str = "document") -> DataFrame:
    """Rows (event_id, payload, parsed_at, vendor, product, parser_id, parser_version, pack, pack_version, detected_format, status, issues, fields) of documents in either earlier shape.

    One shape holds its bytes as ``raw_event.payload_b64`` and issues as objects, the other text as
    ``raw_event.raw_payload`` and issues as texts. An id that is no UUID stays as the field ``_legacy_event_id``; the
    event gets one that follows from it and the bytes. Times without a zone are UTC. Rows that are no JSON object, or
    have neither bytes nor text, have a null payload, status failed and the issue LEGACY_DOCUMENT_UNREADABLE. Other
    columns stay.
    """
    v = F.try_parse_json(F.when(F.is_valid_utf8(F.col(document)), F.col(document)))
    rows = documents.withColumn("_v", v)
    got = lambda path, kind="string": F.try_variant_get("_v", f"$.{path}", kind)
    coded = got("raw_event.payload_b64")
    payload = F.when(coded.isNotNull(), F.try_to_binary(coded, F.lit("base64"))).otherwise(F.encode(got("raw_event.raw_payload"), "utf-8"))
    pack, version = got("source_pack_id"), F.coalesce(got("source_pack_version"), got("pack_version"))
    known = F.coalesce(pack == "cisco_asa", F.lit(False))
    said = F.coalesce(got("event_id"), F.lit(""))
    is_id = said.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    state = F.lower(F.coalesce(got("parse_status"), got("status"), F.lit("")))
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), state), F.lit("failed"))
    told = F.transform(got("parse_errors", "array<variant>"), _told)
    plain = F.transform(got("errors", "array<string>"), lambda m: issue("LEGACY_PARSE_ERROR", m))
    fields = F.coalesce(got("extracted_fields", "map<string,variant>"), got("fields", "map<string,variant>"))
    fields = F.coalesce(F.transform_values(fields, lambda _, x: x.cast("string")), F.create_map().cast("map<string,string>"))
    unread = payload.isNull()
    issues = F.concat(
        F.coalesce(told.cast(_ISSUES), F.array().cast(_ISSUES)),
        F.coalesce(plain.cast(_ISSUES), F.array().cast(_ISSUES)),
        _if(~known, issue("LEGACY_PARSER_PROVENANCE_UNKNOWN", "the document doesn't say which parser made it", "warning")),
        _if(~is_id, issue("LEGACY_EVENT_ID_NOT_UUID", "the document's id is no UUID and stays as a field", "warning", "event_id")),
        _if(unread, issue("LEGACY_DOCUMENT_UNREADABLE", "the document has no bytes", "critical")),
    )
    at = got("parsed_at")
    made = {
        "event_id": F.when(is_id, F.lower(said)).otherwise(_uuid(said, payload)),
        "payload": payload,
        "parsed_at": F.coalesce(zoned_timestamp(at), F.try_to_timestamp(at)),
        "vendor": got("vendor"),
        "product": got("product"),
        "parser_id": F.when(known, "cisco.asa.syslog").otherwise("unknown.legacy_parser"),
        "parser_version": F.coalesce(version, F.lit("0.0.0")),
        "pack": pack,
        "pack_version": version,
        "detected_format": F.when(known, "syslog").otherwise("unknown"),
        "status": F.when(unread, "failed").otherwise(status),
        "issues": issues,
        "fields": F.when(is_id, fields).otherwise(F.map_concat(F.map_filter(fields, lambda k, _: k != "_legacy_event_id"), F.create_map(F.lit("_legacy_event_id"), said))),
    }
    return rows.select(*[c for c in documents.columns if c not in {document, *made}], *[c.alias(n) for n, c in made.items()])


def _told(error: Column) -> Column:
    got = lambda name: F.try_variant_get(error, f"$.{name}", "string")
    return F.struct(got("code").alias("code"), got("message").alias("message"), got("severity").alias("severity"), got("field").alias("field"))


def _if(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one.cast(ISSUE))).otherwise(F.array().cast(_ISSUES))


def _uuid(said: Column, payload: Column) -> Column:
    """A UUID of version 4's form that follows from id and bytes."""
    digest = F.sha2(F.concat(F.encode(said, "utf-8"), F.lit(b"\0"), F.coalesce(payload, F.lit(b""))), 256)
    cut = lambda at, size: F.substring(digest, at, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(13, 3)), F.concat(F.lit("8"), cut(16, 3)), cut(19, 12))
