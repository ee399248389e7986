"""Source packs: detection by priority and parsing, compiled from manifests into one CASE per question."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions.text import after, built, decoded, entries, let, strip, valid_ip, words, zoned_timestamp
from .mappings import Mapping

ISSUE = "struct<code:string,message:string,severity:string,field:string>"
PARSED = f"struct<status:string,issues:array<{ISSUE}>,fields:map<string,string>>"


def issue(code: str, message: str | Column, severity: str = "error", of: str | Column | None = None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(code).alias("code"), text(message).alias("message"), F.lit(severity).alias("severity"), text(of).cast("string").alias("field"))


def parsed(status: str | Column, issues: Column, fields: Column) -> Column:
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), issues.cast(f"array<{ISSUE}>").alias("issues"), F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("fields")).cast(PARSED)


@dataclass(frozen=True)
class Rule:
    """One detection rule: ``regex`` (found anywhere), ``keyword`` (any of, whatever the case) or ``equals``, on the text or another column."""

    kind: str
    values: tuple[str, ...]
    target: str = "raw_payload"

    def matches(self, text: Column) -> Column:
        target = text if self.target == "raw_payload" else F.col(self.target)
        if self.kind == "regex":
            found = _any([target.rlike("(?dU)" + v.replace("(?P<", "(?<")) for v in self.values])
        elif self.kind == "keyword":
            found = _any([F.lower(target).contains(v.lower()) for v in self.values])
        else:
            found = _any([target == v for v in self.values])
        return F.coalesce(found, F.lit(False))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


@dataclass(frozen=True)
class Pack:
    """A source pack. Without ``parse`` it is declarative: ``fields`` are (name, source, required, default) over the format's map."""

    pack_id: str
    vendor: str
    product: str
    priority: int
    rules: tuple[Rule, ...]
    format: str
    parser_id: str
    fields: tuple[tuple[str, str, bool, str | None], ...] = ()
    version: str = "1.0.0"
    parse: Callable[[Column], Column] | None = field(default=None, compare=False)
    after: Callable[[Column, Column], dict[str, Column]] | None = field(default=None, compare=False)
    mapping: Mapping | None = None

    def detect(self, text: Column) -> Column:
        return _any([r.matches(text) for r in self.rules])

    def parsed(self, text: Column) -> Column:
        if self.parse:
            return self.parse(text)

        def from_map(raw: Column) -> Column:
            value = {n: F.coalesce(F.try_element_at(raw, F.lit(s)), F.lit(d)) for n, s, _, d in self.fields}
            more = self.after(raw, text) if self.after else {}
            made = F.map_filter(F.create_map(*[v for n, c in (value | more).items() for v in (F.lit(n), c)]), lambda _, v: v.isNotNull())
            missing = F.array_compact(F.array(*[F.when(value[n].isNull(), issue("FIELD_EXTRACTION_FAILED", f"{n} is needed and was not found", "error", n)) for n, _, required, _ in self.fields if required]))
            good = parsed(F.when(F.size(missing) > 0, "partial").otherwise("success"), missing, made)
            return F.when(raw.isNull(), parsed("failed", F.array(issue("SOURCE_PACK_FAILED", f"The payload isn't {self.format}", "critical")), F.lit(None))).otherwise(good)

        return let(parsers.PARSERS[self.format](text), from_map)


# Names of syslog severities and facilities.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
FACILITIES = {0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog", 6: "lpr", 7: "news", 8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp"} | {16 + i: f"local{i}" for i in range(8)}


def _end(word: Column, side: str, mark: str, opening: str, body: Callable[[Column, dict[str, Column]], Column], port_needed: bool = True, more: bool = False) -> Column:
    """``body`` of one end of a connection as a firewall writes it: interface, ``mark``, address, ``opening`` and port, behind which ``more`` may follow. It is given whether the word is one, and its fields."""

    def read(cut: Column) -> Column:
        interface = F.substr(cut["word"], F.lit(1), F.length(cut["word"]) - F.length(cut["tail"]) - 1)
        address, port = F.get(F.split(cut["tail"], f"\\{opening}", 2), F.lit(0)), F.get(F.split(cut["tail"], f"\\{opening}", 2), F.lit(1))
        number = F.regexp_extract(port, r"^\d+", 0) if more else port
        return let(F.struct(interface.alias("interface"), address.alias("address"), number.alias("number")), whole)

    def whole(end: Column) -> Column:
        good = end["interface"].rlike(r"(?U)^\S+$") & end["address"].rlike("^[0-9A-Fa-f:.]+$") & F.coalesce(end["number"].rlike(r"^\d+$"), F.lit(not port_needed))
        return body(good, {f"{side}_interface": end["interface"], f"{side}_ip": end["address"], f"{side}_port": end["number"]})

    return let(F.struct(word.alias("word"), F.substring_index(word, mark, -1).alias("tail")), read)


def _deny(message: Column) -> Column:
    """106023: what was denied, from where to where, and, quoted, the access group that did it."""

    def read(parts: Column) -> Column:
        return let(words(F.get(parts, F.lit(0))), lambda w: told(parts, w))

    def told(parts: Column, w: Column) -> Column:
        at = lambda i: F.get(w, F.lit(i))
        said = F.array_join(F.array(at(0), at(2), at(4), at(6), at(7), at(8)), " ") == "Deny src dst by access-group "
        good = (F.size(parts) > 2) & (F.get(parts, F.lit(1)) != "") & (F.size(w) == 9) & said
        made = lambda src, s, dst, d: F.when(src & dst, entries(action=at(0), protocol=at(1), **s, **d, acl_name=F.get(parts, F.lit(1)), event_type=F.lit("acl_deny")))
        return F.when(good, _end(at(3), "src", ":", "/", lambda src, s: _end(at(5), "dst", ":", "/", lambda dst, d: made(src, s, dst, d), False), False))

    return let(F.split(message, '"', 3), read)


def _hit(message: Column) -> Column:
    """106100: the access list, whether it permitted or denied, and both ends with an arrow between."""

    def read(sides: Column) -> Column:
        return let(words(F.get(sides, F.lit(0))), lambda w: let(F.get(words(F.get(sides, F.lit(1))), F.lit(0)), lambda closed: told(w, closed)))

    def told(w: Column, closed: Column) -> Column:
        at = lambda i: F.get(w, F.lit(i))
        good = (F.size(w) == 5) & (at(0) == "access-list") & at(2).isin("permitted", "denied") & at(4).endswith(")") & closed.contains(")")
        made = lambda src, s, dst, d: F.when(src & dst, entries(acl_name=at(1), action=at(2), protocol=at(3), **s, **d, event_type=F.lit("acl_hit")))
        first, second = F.regexp_replace(at(4), r"\)$", ""), F.substring_index(closed, ")", 1)
        return F.when(good, _end(first, "src", "/", "(", lambda src, s: _end(second, "dst", "/", "(", lambda dst, d: made(src, s, dst, d))))

    return let(F.split(message, r"(?U)\s*->\s*", 2), read)


def _connection(message: Column) -> Column:
    """302013 and 302014: a connection that was built or torn down, its direction and number, for one end to another; translated addresses in parentheses are passed over."""

    def read(parts: Column) -> Column:
        sides = F.split(F.get(parts, F.lit(1)), r"(?U)\s*(?:\([^)]*\))?\s*to\s+", 2)
        return let(words(F.get(parts, F.lit(0))), lambda w: let(sides, lambda s: told(w, s)))

    def told(w: Column, sides: Column) -> Column:
        at = lambda i: F.get(w, F.lit(i))
        good = (F.size(w) == 5) & at(0).isin("Built", "Teardown") & at(1).isin("inbound", "outbound") & (at(3) == "connection") & at(4).rlike(r"^\d+$")
        made = lambda src, s, dst, d: F.when(src & dst, entries(action=at(0), direction=at(1), protocol=at(2), connection_id=at(4), **s, **d, event_type=F.lit("connection_lifecycle")))
        second = F.regexp_extract(F.get(sides, F.lit(1)), r"(?U)^\S+", 0)
        return F.when(good, _end(F.get(sides, F.lit(0)), "src", ":", "/", lambda src, s: _end(second, "dst", ":", "/", lambda dst, d: made(src, s, dst, d), more=True)))

    return let(F.split(message, r"(?U)\s+for\s+", 2), read)


#: How the messages are read beyond their header, by the ids that have them.
_BODIES = {("106023",): _deny, ("106100",): _hit, ("302013", "302014"): _connection}


def _header(text: Column) -> Column:
    """What stands before and in a firewall message's tag, and its text: priority in angle brackets, date and clock in four words, and the device before a colon, each of which may lack; null if something else stands there or there is no tag."""

    def read(parts: Column) -> Column:
        left = F.get(parts, F.lit(0))
        return let(F.regexp_extract(left, r"^<(\d{1,3})>", 1), lambda pri: let(unmarked(left, pri), lambda rest: let(stamp(rest), lambda at: let(device(rest, at), lambda named: told(F.get(parts, F.lit(1)), pri, at, named)))))

    def unmarked(left: Column, pri: Column) -> Column:
        return F.regexp_replace(F.when(pri != "", F.substr(left, F.length(pri) + 3)).otherwise(left), r"(?U)^\s+", "")

    def stamp(rest: Column) -> Column:
        dated = lambda w: F.coalesce((F.size(w) > 4) & F.get(w, F.lit(0)).rlike("^[A-Za-z]{3}$") & F.get(w, F.lit(1)).rlike(r"^\d{1,2}$") & F.get(w, F.lit(2)).rlike(r"^\d{4}$") & F.get(w, F.lit(3)).rlike(r"^\d\d:\d\d:\d\d$"), F.lit(False))
        return F.when(let(words(rest), dated), F.regexp_extract(rest, r"(?U)^(?:\S+\s+){3}\S+", 0))

    def device(rest: Column, at: Column) -> Column:
        return strip(F.when(at.isNotNull(), after(rest, at)).otherwise(rest))

    def told(tagged: Column, pri: Column, at: Column, named: Column) -> Column:
        def whole(host: Column) -> Column:
            good = tagged.rlike(r"^\d-\d{6}:") & ((named == "") | named.endswith(":") & host.rlike(r"(?U)^\S+$"))
            return F.when(good, entries(priority=pri, timestamp_raw=at, hostname=F.when(named != "", host), severity=F.substr(tagged, F.lit(1), F.lit(1)), message_id=F.substr(tagged, F.lit(3), F.lit(6)), message_text=F.regexp_replace(F.substr(tagged, F.lit(10)), r"(?U)^\s+", "")))

        return let(strip(F.substr(named, F.lit(1), F.length(named) - 1)), whole)

    return let(F.split(text, "%ASA-", 2), read)


def _table(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def _asa(text: Column) -> Column:
    def with_header(h: Column) -> Column:
        own = F.try_element_at(h, F.lit("message_id"))
        message = F.coalesce(F.try_element_at(h, F.lit("message_text")), F.lit(""))
        name = _table(dict(enumerate(SEVERITIES)), h["severity"].cast("int"))
        base = F.map_concat(F.map_filter(h, lambda k, _: k != "message_text"), F.create_map(F.lit("severity_name"), F.coalesce(name, F.lit("unknown")), F.lit("message_text"), message))
        known = own.isin(*[i for ids in _BODIES for i in ids])
        trouble = lambda body: F.when(~known, F.array(issue("ASA_UNKNOWN_MESSAGE_ID", F.concat(F.lit("messages with id "), own, F.lit(" are read no further than their header")), "warning", "message_id"))).when(body.isNull(), F.array(issue("ASA_MESSAGE_BODY_NO_MATCH", "the text doesn't have the layout of its message id", "error", "message")))
        made = lambda base, body: parsed(F.when(known & body.isNotNull(), "success").otherwise("partial"), F.coalesce(trouble(body), F.array().cast(f"array<{ISSUE}>")), F.coalesce(F.map_concat(base, body), base))
        return let(base, lambda b: let(F.coalesce(*[F.when(own.isin(*ids), read(message)) for ids, read in _BODIES.items()]), lambda body: made(b, body)))

    none = parsed("failed", F.array(issue("ASA_HEADER_NO_MATCH", "the firewall's tag and what stands before it can't be read")), F.lit(None))
    return let(_header(strip(text)), lambda h: F.when(h.isNull(), none).otherwise(with_header(h)))


EVE_KINDS = ("alert", "flow", "dns", "http")
# Names of the sensor's fields, as they stand in its documents.
_EVE_TEXT = ("timestamp", "flow_id", "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "direction", "in_iface", "out_iface", "community_id", "suricata_version")
_EVE_NESTED = {
    "alert": ("action", "signature_id", "signature", "category", "severity"),
    "flow": ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "state", "reason"),
    "dns": ("type", "rrname", "rrtype", "rdata"),
    "http": ("hostname", "url", "http_method", "status", "http_user_agent"),
}


def _eve(text: Column) -> Column:
    def with_object(v: Column) -> Column:
        got = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
        type_of = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")), F.lit("absent"))
        kind = got("event_type")
        known = kind.isin(*EVE_KINDS) & (type_of("event_type") == "STRING")
        time = F.when(type_of("timestamp") == "STRING", got("timestamp"))
        checks = [
            F.when(~F.coalesce(known, F.lit(False)), issue("SURICATA_EVENT_TYPE_INVALID", "the event type is none of the four that are mapped", "error", "event_type")),
            F.when(time.isNull(), issue("SURICATA_TIMESTAMP_MISSING", "no timestamp", "error", "timestamp")).when(zoned_timestamp(time).isNull(), issue("SURICATA_TIMESTAMP_INVALID", "the timestamp isn't ISO 8601 with a zone", "error", "timestamp")),
            *[F.when(valid_ip(F.when(type_of(f) == "STRING", got(f))).isNull(), issue("SURICATA_IP_INVALID", f"{f} holds no IP address", "error", f)) for f in ("src_ip", "dest_ip")],
            *[F.when((type_of(f) != "absent") & ~((type_of(f) == "BIGINT") & F.coalesce(got(f, "bigint").between(0, 65535), F.lit(False))), issue("SURICATA_PORT_INVALID", f"{f} holds no port number", "error", f)) for f in ("src_port", "dest_port")],
            F.when(known & ~F.coalesce(*[F.when(kind == k, type_of(k).startswith("OBJECT")) for k in EVE_KINDS]), issue("SURICATA_EVENT_BODY_MISSING", F.concat(F.lit("no object under "), kind), "error", kind)),
        ]
        flat = F.create_map(*[x for n in _EVE_TEXT for x in (F.lit(n), got(n))], *[x for k, names in _EVE_NESTED.items() for n in names for x in (F.lit(f"{k}.{n}"), got(f"{k}.{n}"))])
        return let(F.array_compact(F.array(*checks)), lambda issues: parsed(F.when(F.size(issues) > 0, "failed").otherwise("success"), issues, F.map_filter(flat, lambda _, x: x.isNotNull())))

    document = F.try_parse_json(F.when(F.is_valid_utf8(text), text))
    failed = parsed("failed", F.array(issue("SOURCE_PACK_FAILED", "the payload is no JSON object", "critical")), F.lit(None))
    return let(document, lambda v: F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), with_object(v)).otherwise(failed))


# Names of the firewall's fields and the keys they come from.
FORTI_FIELDS = {
    # what happened
    "event_type": "type",
    "event_subtype": "subtype",
    "action": "action",
    "status": "status",
    "reason": "reason",
    "level": "level",
    "message": "msg",
    "log_description": "logdesc",
    # when and where it was seen
    "timestamp": "eventtime",
    "hostname": "devname",
    "device_id": "devid",
    "log_id": "logid",
    "vdom": "vd",
    # the connection
    "src_ip": "srcip",
    "src_port": "srcport",
    "src_intf": "srcintf",
    "src_country": "srccountry",
    "dst_ip": "dstip",
    "dst_port": "dstport",
    "dst_intf": "dstintf",
    "dst_country": "dstcountry",
    "protocol": "proto",
    "service": "service",
    "session_id": "sessionid",
    "duration": "duration",
    # its volume
    "sent_bytes": "sentbyte",
    "rcvd_bytes": "rcvdbyte",
    "sent_pkts": "sentpkt",
    "rcvd_pkts": "rcvdpkt",
    # policy and user
    "policy_id": "policyid",
    "policy_name": "policyname",
    "user": "user",
    # what was found in it
    "virus_name": "virus",
    "virus_id": "virusid",
    "filename": "filename",
    "url": "url",
    "attack_signature": "attack",
    "app_name": "app",
    "app_category": "appcat",
    "app_risk": "apprisk",
}
FORTI_LEVELS = {"emergency": "critical", "alert": "critical", "critical": "critical", "error": "high", "warning": "medium", "notice": "medium", "information": "info", "debug": "info"}


def _forti_after(raw: Column, _: Column) -> dict[str, Column]:
    own = lambda k: F.try_element_at(raw, F.lit(k))
    at = F.try_to_timestamp(F.concat_ws(" ", own("date"), own("time")), F.lit("yyyy-MM-dd HH:mm:ss"))
    level = F.coalesce(_table(FORTI_LEVELS, F.lower(F.trim(own("level")))), F.lit("unknown"))
    return {"event_timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "severity_normalized": level, "event_category_normalized": F.concat_ws(".", own("type"), F.when(own("type").isNotNull(), own("subtype")))}


def _linux_after(raw: Column, _: Column) -> dict[str, Column]:
    return {"syslog_facility_name": F.coalesce(_table(FACILITIES, F.try_element_at(raw, F.lit("facility")).cast("int")), F.lit("unknown"))}


PACKS: tuple[Pack, ...] = (
    Pack("cisco_asa", "Cisco", "ASA", 100, (Rule("regex", (r"%ASA-\d-\d{6}:", r"ASA-\d-\d{6}")),), "syslog", "cisco_asa.syslog", parse=_asa),
    Pack("suricata_eve", "OISF", "Suricata", 90, (Rule("regex", (r'"event_type"\s*:\s*"(alert|flow|dns|http)"',)), Rule("keyword", ('"flow_id"', '"suricata_version"'))), "json", "suricata.eve.json", parse=_eve),
    Pack("fortinet_fortigate", "Fortinet", "FortiGate", 60, (Rule("keyword", ("devname=", "devid=")), Rule("regex", (r'logid="?\d{10}"?',))), "key_value", "fortinet_fortigate.key_value", tuple((n, s, n in ("hostname", "event_type"), None) for n, s in FORTI_FIELDS.items()), after=_forti_after),
    Pack("generic_linux_syslog", "Generic", "Linux Syslog", 10, (Rule("regex", (r"^<\d{1,3}>(\d\s)?[A-Za-z0-9:\-\.]+",)), Rule("keyword", ("sshd", "CRON", "systemd", "sudo", "kernel:"))), "syslog", "generic_linux_syslog.syslog", (("timestamp", "timestamp", False, None), ("hostname", "hostname", True, None), ("process", "appname", False, None), ("pid", "procid", False, None), ("message", "message", True, None), ("syslog_facility", "facility", False, None), ("severity", "severity_code", False, "unknown"), ("syslog_variant", "variant", False, None)), after=_linux_after),
)


def asa_confidence(text: Column) -> Column:
    """How sure the firewall's tag makes: 0.98 with the tag, 0.4 with its core only, else 0."""
    return F.when(text.rlike(r"%ASA-\d-\d{6}:"), 0.98).when(text.rlike(r"ASA-\d-\d{6}"), 0.4).otherwise(0.0)


def by_priority(packs: tuple[Pack, ...] = PACKS) -> list[Pack]:
    """Higher priority first, then by id; duplicates aren't allowed."""
    if len({p.pack_id for p in packs}) < len(packs):
        raise ValueError("pack ids must differ")
    mapped = [p.mapping.mapping_id for p in packs if p.mapping]
    if len(set(mapped)) < len(mapped):
        raise ValueError("mapping ids must differ")
    return sorted(packs, key=lambda p: (-p.priority, p.pack_id))


def detect(raw: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """``raw`` with text (lossy) and pack, the id of the first pack by priority whose rules match; null if none does."""
    text = raw.withColumn("text", decoded(F.col("payload")))
    return text.withColumn("pack", built(("detect", packs), lambda: F.coalesce(*[F.when(p.detect(F.col("text")), F.lit(p.pack_id)) for p in by_priority(packs)])))


def guarded(rows: DataFrame, said_id: str = "said_event_id", said_sha256: str = "said_raw_sha256") -> DataFrame:
    """What a parser from outside gave for each event, beside the event's own id and payload: where it speaks of another id or other bytes, its fields count for nothing and the event has failed. The two columns go."""
    other = ~F.coalesce((F.col(said_id) == F.col("event_id")) & (F.col(said_sha256) == F.sha2("payload", 256)), F.lit(False))
    blame = F.array(issue("PARSER_IDENTITY_MISMATCH", "the parser's result speaks of another event", "critical", "event_id")).cast(f"array<{ISSUE}>")
    none = F.create_map().cast("map<string,string>")
    return rows.withColumns({"status": F.when(other, "failed").otherwise(F.col("status")), "issues": F.when(other, blame).otherwise(F.col("issues")), "fields": F.when(other, none).otherwise(F.col("fields"))}).drop(said_id, said_sha256)


def parse_only(raw: DataFrame, pack_id: str, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """``parse`` for the events of one pack: all packs are tried for detection, and only that one's events are parsed."""
    own = next(p for p in packs if p.pack_id == pack_id)
    found = detect(raw, packs).where(F.col("pack") == pack_id)
    return found.withColumn("_parsed", built(("parse", own), lambda: own.parsed(F.col("text")))).select("*", "_parsed.status", "_parsed.issues", "_parsed.fields").drop("_parsed")


def parse(raw: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """``detect`` with status (success, partial, failed, unrecognized), issues and fields. Never fails on a payload. All packs are one projection: a row is parsed only by the pack that it matched."""
    found = detect(raw, packs)
    none = lambda: parsed("unrecognized", F.array(), F.lit(None))
    chosen = built(("parse", packs), lambda: F.coalesce(*[F.when(F.col("pack") == p.pack_id, p.parsed(F.col("text"))) for p in by_priority(packs)], none()))
    return found.withColumn("_parsed", chosen).select("*", "_parsed.status", "_parsed.issues", "_parsed.fields").drop("_parsed")
