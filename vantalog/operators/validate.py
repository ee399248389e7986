"""Validation of unified events: semantic rules over the sections, and structural rules for JSON documents."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import built, computed_once
from ..plans.normalize import LABELS

#: Lowest and highest score of each severity label.
BANDS = {"informational": (0, 0), "low": (1, 3), "medium": (4, 6), "high": (7, 8), "critical": (9, 10)}


_ISSUES = "array<struct<path:string,rule:string,message:string>>"


def _issue(when: Column, path: str, rule: str, message: str) -> tuple[Column, Column]:
    """Whether there is the issue, and what it says."""
    return F.coalesce(when, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), F.lit(message).alias("message"))


def semantic_issues() -> Column:
    """Sorted, distinct issues (path, rule, message) of the row's sections. Never fails on absent sections. Arrays are built only for rows that have an issue."""
    c = F.col
    t, sev = "time", c("severity.normalized")
    band = F.coalesce(*[F.when(c("severity.label") == n, sev.between(a, b)) for n, (a, b) in BANDS.items()])
    network = c("event.category") == "network"
    checks = [
        _issue((c(f"{t}.observed_at") > c(f"{t}.ingested_at")) | (c(f"{t}.ingested_at") > c(f"{t}.normalized_at")), "$.time", "timestamp_order", "observed_at, ingested_at and normalized_at must not decrease"),
        *[_issue(network & c(f"{s}.ip").isNull(), f"$.{s}.ip", "network_endpoint", f"network events need {s}.ip") for s in ("source", "destination")],
        _issue((c("event.category") == "intrusion_detection") & c("threat").isNull(), "$.threat", "category_requirement", "intrusion detection events need a threat"),
        _issue((c("event.category") == "authentication") & c("authentication").isNull(), "$.authentication", "category_requirement", "authentication events need an authentication section"),
        _issue(c("action.normalized").isin("deny", "block") & (c("action.outcome") == "success"), "$.action.outcome", "action_consistency", "denied and blocked actions can't succeed"),
        _issue(~band, "$.severity.label", "severity_consistency", "the score isn't in the label's band"),
        _issue((c("severity.label") == "unknown") & (F.size("quality.warnings") == 0), "$.severity.label", "severity_uncertainty", "an unknown severity needs a warning"),
        _issue(c("authentication.result").isin("success", "failure") & c("action.outcome").isin("success", "failure") & (c("authentication.result") != c("action.outcome")), "$.authentication.result", "outcome_consistency", "the action's outcome differs from the result"),
        _issue((c("quality.status") == "partial") & (F.size("quality.missing_fields") == 0) & (F.size("quality.warnings") == 0), "$.quality", "partial_explanation", "a partial event needs a missing field or a warning"),
        _issue(F.sha2(F.encode("traceability.raw_event.content", "utf-8"), 256) != c("traceability.raw_sha256"), "$.traceability.raw_sha256", "raw_integrity", "the embedded text doesn't have the recorded hash"),
    ]
    odd = F.filter(F.map_keys("extensions"), lambda k: ~k.rlike("^[a-z][a-z0-9_]*$"))
    named = F.transform(odd, lambda k: F.struct(F.concat(F.lit("$.extensions."), k).alias("path"), F.lit("vendor_namespace").alias("rule"), F.lit("extension namespaces are snake_case").alias("message")))
    found = F.exists(F.map_keys("extensions"), lambda k: ~k.rlike("^[a-z][a-z0-9_]*$"))
    some = F.coalesce(found, F.lit(False))
    for holds, _ in checks:
        some = some | holds
    every = F.concat(F.array_compact(F.array(*[F.when(holds, told) for holds, told in checks])), F.coalesce(named, F.array()))
    return F.when(some, F.sort_array(F.array_distinct(every))).otherwise(F.array().cast(_ISSUES))


def validate(events: DataFrame) -> DataFrame:
    """``events`` with validation (issues) and storable (no issue, and quality isn't invalid). Events with issues become invalid, with a warning for each."""
    out = computed_once(events.withColumn("validation", built("semantic", semantic_issues)), "validated")
    wrong = F.size("validation") > 0
    told = F.transform("validation", lambda i: F.concat_ws(": ", i.path, i.message))
    q = lambda n: F.col(f"quality.{n}")
    quality = F.struct(F.when(wrong, "invalid").otherwise(q("status")).alias("status"), q("parsing_confidence").alias("parsing_confidence"), q("missing_fields").alias("missing_fields"), F.when(wrong, F.concat(q("warnings"), told)).otherwise(q("warnings")).alias("warnings"))
    return out.withColumns({"quality": quality, "storable": ~wrong & (q("status") != "invalid")})


# The schema of documents that come from outside, as rules on paths: (required keys, allowed keys) of each object.
_UUID, _SNAKE, _HEX = re.compile(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I), re.compile(r"^[a-z][a-z0-9_]*$"), re.compile(r"^[0-9a-f]{64}$")
_END = {"ip": "ip", "port": (0, 65535), "hostname": str, "mac": str, "user": str, "interface": str}
DOCUMENT = {
    "schema_version!": ("1.0.0",),
    "event!": {"id!": _UUID, "kind!": ("event",), "category!": ("network", "intrusion_detection", "authentication", "web", "system", "unknown"), "type!": _SNAKE, "name!": str, "message": str},
    "time!": {"observed_at!": "time", "ingested_at!": "time", "normalized_at!": "time"},
    "source": _END,
    "destination": _END,
    "observer!": {"vendor!": str, "product!": str, "type!": str, "hostname": str, "serial_number": str, "software_version": str},
    "network": {"transport": ("tcp", "udp", "icmp", "icmpv6", "gre", "other", "unknown"), "application_protocol": str, "direction": ("inbound", "outbound", "internal", "external", "unknown"), "bytes": (0, None), "packets": (0, None)},
    "action!": {"original!": str, "normalized!": ("allow", "deny", "block", "detect", "connect", "disconnect", "authenticate", "unknown"), "outcome!": ("success", "failure", "unknown"), "reason": str},
    "severity!": {"original!": str, "normalized!": (0, 10), "label!": LABELS},
    "threat": {"name!": str, "signature_id": str, "category": _SNAKE, "confidence": (0.0, 1.0)},
    "authentication": {"user!": str, "method": str, "result!": ("success", "failure", "unknown"), "failure_reason": str},
    "http": {"method": re.compile("^[A-Z]+$"), "host": str, "path": re.compile("^/"), "status_code": (100, 599), "user_agent": str},
    "traceability!": {"raw_event_id!": _UUID, "raw_sha256!": _HEX, "source_pack!": {"name!": str, "version!": str}, "parser!": {"name!": str, "version!": str}, "raw_event": {"encoding!": str, "content_type!": str, "content!": str}},
    "quality!": {"status!": ("valid", "partial", "invalid", "unknown"), "parsing_confidence!": (0.0, 1.0), "missing_fields!": list, "warnings!": list},
    "extensions": dict,
}


def _check(value, rule, path: str) -> Iterator[tuple[str, str]]:
    """(path, keyword) of what is wrong with a value."""
    if isinstance(rule, dict):
        if not isinstance(value, dict):
            yield path, "type"
            return
        allowed = {k.rstrip("!"): r for k, r in rule.items()}
        if any(k.endswith("!") and k[:-1] not in value for k in rule):
            yield path, "required"
        if set(value) - set(allowed):
            yield path, "additionalProperties"
        if not value and not any(k.endswith("!") for k in rule):
            yield path, "minProperties"
        for k, v in value.items():
            if k in allowed:
                yield from _check(v, allowed[k], f"{path}.{k}")
    elif rule is dict:
        if not isinstance(value, dict):
            yield path, "type"
        elif any(not _SNAKE.match(k) for k in value):
            yield path, "propertyNames"
    elif rule is list:
        if not isinstance(value, list) or any(not isinstance(v, str) for v in value):
            yield path, "type"
        elif path.endswith("missing_fields") and len(set(value)) < len(value):
            yield path, "uniqueItems"
    elif isinstance(rule, tuple) and len(rule) == 2 and not isinstance(rule[0], str):
        whole = isinstance(rule[0], int)  # 5.0 is an integer, 5.5 and what isn't finite are none
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or whole and value % 1 != 0:
            yield path, "type"
        elif value < rule[0]:
            yield path, "minimum"
        elif rule[1] is not None and value > rule[1]:
            yield path, "maximum"
    elif isinstance(rule, tuple):
        if value not in rule:
            yield path, "const" if len(rule) == 1 else "enum"
    elif not isinstance(value, str):
        yield path, "type"
    elif isinstance(rule, re.Pattern):
        if not rule.search(value):
            yield path, "pattern"
    elif rule == "ip":
        try:
            ipaddress.ip_address(value)
        except ValueError:
            yield path, "oneOf"
    elif rule == "time":
        try:
            if not value.endswith("Z") or datetime.fromisoformat(value).tzinfo is None:
                yield path, "format"
        except ValueError:
            yield path, "format"
    elif not value and path.rsplit(".", 1)[-1] in ("name", "original", "message"):
        yield path, "minLength"


def document_issues(text: str | None) -> list[dict[str, str]]:
    """Structural issues of one JSON document: paths, keywords; sorted and distinct. What can't be read as JSON has the one issue ``json``."""
    try:
        document = json.loads(text or "")
    except (ValueError, RecursionError):  # no JSON, or nested deeper than a document can be
        return [{"path": "$", "rule": "json"}]
    found = set(_check(document, DOCUMENT, "$"))
    if isinstance(document, dict):
        category = document["event"].get("category") if isinstance(document.get("event"), dict) else None
        for kind, needs in (("network", ("source", "destination", "network")), ("intrusion_detection", ("threat",)), ("authentication", ("authentication",))):
            if category == kind and any(n not in document for n in needs):
                found.add(("$", "required"))
    return [{"path": p, "rule": r} for p, r in sorted(found)]


def structural_issues(document: str | Column) -> Column:
    """Issues of documents of any shape, whose absent and null keys differ: columns can't tell these apart."""

    @F.pandas_udf("array<struct<path:string,rule:string>>")
    def check(documents: pd.Series) -> pd.Series:
        return documents.map(document_issues)

    return check(document)
