"""Format parsers as Column expressions: text to a map of fields, null where the text doesn't have the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after, entries, groups, let, strip, words

#: A key of letters, digits, dots, dashes and underscores, and a value that is quoted or one word.
_PAIR = r'[\w.-]+=(?:"[^"]*"|\S+)'


def _with(fields: Column, **more: Column) -> Column:
    """The map with entries added; the added ones win."""
    added = F.create_map(*[v for k, c in more.items() for v in (F.lit(k), c)])
    return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*more)), F.map_filter(added, lambda _, v: v.isNotNull()))


def _structured(tail: Column) -> tuple[Column, Column]:
    """RFC 5424, 6.3: the structured data at the start of ``tail`` (a dash for none, or elements in brackets that follow each other directly), null if there are none, and what stands behind."""
    # An element ends at a bracket; the data end at the first bracket that no other element follows.
    last = F.split(tail, r"\](?!\[)", 2)
    first = F.split(tail, r"\]", 2)
    ended = F.when(F.size(last) > 1, last).when(F.size(first) > 1, first)
    data = F.when(tail.startswith("-"), F.lit("-")).when(tail.startswith("["), F.concat(F.get(ended, F.lit(0)), F.lit("]")))
    return data, after(tail, data)


def _rfc5424(pri: Column, rest: Column) -> Column:
    """RFC 5424, 6: a digit for the version, five words (a dash for none), structured data and the message, one white space between them."""
    names = ("version", "timestamp", "hostname", "appname", "procid", "msgid")

    def read(parts: Column) -> Column:
        data, message = _structured(F.get(parts, F.lit(6)))
        good = (F.size(parts) == 7) & F.get(parts, F.lit(0)).rlike(r"^\d$") & ~F.exists(F.slice(parts, 2, 5), lambda w: w == "")
        fields = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
        return F.when(good & data.isNotNull(), entries(pri=pri, **fields, structured_data=data, message=F.regexp_replace(message, r"(?U)^\s", "")))

    return let(F.split(rest, r"(?U)\s", 7), read)


def _rfc3164(pri: Column, rest: Column) -> Column:
    """RFC 3164, 4.1: month, day and clock, the host, and the message: a tag that ends before a colon, bracket or white space, perhaps the process in brackets, and the content."""
    dated = F.regexp_replace(F.substr(rest, F.lit(4)), r"(?U)^\s+", "")  # from the day on

    def read(parts: Column) -> Column:
        day, clock, host, body = (F.get(parts, F.lit(i)) for i in range(4))
        tag = F.regexp_extract(body, r"(?U)^[^\s:\[]+", 0)
        behind = after(body, tag)
        process = F.regexp_extract(behind, r"^\[(\d+)\]", 1)
        content = F.regexp_replace(F.when(process != "", after(behind, F.concat(F.lit("["), process, F.lit("]")))).otherwise(behind), r"(?U)^:?\s?", "")
        stamp = F.substr(rest, F.lit(1), F.length(rest) - F.length(dated) + F.length(day) + F.length(clock) + 1)
        good = (F.size(parts) == 4) & rest.rlike(r"(?U)^[A-Z][a-z]{2}\s") & day.rlike(r"^\d{1,2}$") & clock.rlike(r"^\d\d:\d\d:\d\d$") & (host != "") & (tag != "")
        return F.when(good, entries(pri=pri, timestamp=stamp, hostname=host, appname=tag, procid=process, message=content))

    return let(F.split(dated, r"(?U)\s", 4), read)


def syslog(text: Column) -> Column:
    """RFC 5424, else RFC 3164, with facility, severity_code and variant. The priority is up to three digits in angle brackets; what follows it is read word by word."""

    def numbered(fields: Column, variant: str) -> Column:
        pri = fields["pri"].cast("int")
        return _with(fields, facility=F.floor(pri / 8).cast("string"), severity_code=(pri % 8).cast("string"), variant=F.lit(variant), message=F.coalesce(F.try_element_at(fields, F.lit("message")), F.lit("")))

    def read(parts: Column) -> Column:
        pri, rest = F.substr(F.get(parts, F.lit(0)), F.lit(2)), F.get(parts, F.lit(1))
        new = let(_rfc5424(pri, rest), lambda f: F.when(f.isNotNull(), numbered(f, "rfc5424")))
        old = let(_rfc3164(pri, rest), lambda f: F.when(f.isNotNull(), numbered(f, "rfc3164")))
        return F.when(F.get(parts, F.lit(0)).rlike(r"^<\d{1,3}$"), F.coalesce(new, old))

    return let(F.split(strip(text), ">", 2), read)


def key_value(text: Column) -> Column:
    """All key=value and key="value" pairs; of repeated keys the last counts."""
    pairs = F.regexp_extract_all(text, F.lit(f"({_PAIR})"), F.lit(1))
    entry = lambda p: let(F.instr(p, "="), lambda at: F.struct(F.substr(p, F.lit(1), at - 1).alias("key"), F.regexp_replace(F.substr(p, at + 1), '^"(.*)"$', "$1").alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later.key == e.key))
    repeats = lambda es: F.size(F.array_distinct(es["key"])) < F.size(es)
    # Comparing each key with all later ones costs their number squared: only lines that repeat a key pay for it.
    return let(pairs, lambda found: F.when(F.size(found) > 0, let(F.transform(found, entry), lambda es: F.map_from_entries(F.when(repeats(es), last(es)).otherwise(es)))))


def json_object(text: Column) -> Column:
    """A JSON object as variant; other JSON is wrapped as ``value``; else the text from its first brace is tried."""
    first = F.try_parse_json(strip(text))
    rest = F.try_parse_json(F.substr(text, F.instr(text, "{")))
    wrap = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.try_parse_json(F.concat(F.lit('{"value":'), v.cast("string"), F.lit("}"))))
    return F.when(first.isNotNull(), wrap(first)).when(F.instr(text, "{") > 0, rest)


def csv(text: Column, columns: list[str] | None = None, sep: str = ",") -> Column:
    """One CSV row as map: named columns, missing ones empty and further ones ignored; without names col_0, col_1 and so on."""
    cells = F.transform(F.regexp_extract_all(text, F.lit(rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    if columns:
        return let(cells, lambda c: F.create_map(*[v for i, n in enumerate(columns) for v in (F.lit(n), F.coalesce(F.get(c, F.lit(i)), F.lit("")))]))
    return let(cells, lambda c: F.map_from_arrays(F.transform(c, lambda _, i: F.concat(F.lit("col_"), i.cast("string"))), c))


CEF_NAMES = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]


def cef(text: Column) -> Column:
    """CEF: the seven header fields and the key-value pairs of the extension."""
    plain = lambda c: F.replace(F.replace(c, F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))

    def read(parts: Column) -> Column:
        header = F.map_from_arrays(F.array(*map(F.lit, CEF_NAMES)), F.transform(F.slice(parts, 1, 7), plain))
        extension = F.coalesce(key_value(F.get(parts, F.lit(7))), F.create_map().cast("map<string,string>"))
        return F.when(F.size(parts) >= 7, F.map_concat(header, F.map_filter(extension, lambda k, _: ~k.isin(*CEF_NAMES))))

    return F.when(text.contains("CEF:"), let(F.split(F.regexp_extract(text, r"(?s)CEF:(.*)$", 1), r"(?<!\\)\|", 8), read))


def first_regex(text: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    """The groups of the first of several patterns that is found anywhere in the text."""
    return F.coalesce(*[groups(text, f".*?{p}", names, whole=False) for p, names in patterns])


def fallback(text: Column) -> Column:
    return F.create_map(F.lit("message"), text)


FILTERLOG_NAMES = ["rule", "sub_rule", "anchor", "tracker", "interface", "reason", "action", "direction", "ip_version"]


def filterlog(text: Column) -> Column:
    """The comma-separated body of a packet filter's log behind a syslog header: at least 19 fields and a known action."""
    cells = F.split(F.regexp_extract(text, r"(?s)filterlog\S*\s(?:-\s)*(.*)$", 1), ",")
    cell = lambda i: F.get(cells, F.lit(i))
    made = F.create_map(*[v for i, n in enumerate(FILTERLOG_NAMES) for v in (F.lit(n), cell(i))], F.lit("protocol"), cell(16), F.lit("src_ip"), cell(18), F.lit("dst_ip"), F.coalesce(cell(19), F.lit("")), F.lit("src_port"), F.coalesce(cell(20), F.lit("")), F.lit("dst_port"), F.coalesce(cell(21), F.lit("")))
    return F.when((F.size(cells) >= 19) & cell(6).isin("pass", "block", "reject", "match"), made)


PARSERS = {"syslog": syslog, "key_value": key_value, "json": json_object, "csv": csv, "cef": cef, "regex": first_regex, "fallback": fallback}
