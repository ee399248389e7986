"""Source packs from manifests: a new vendor is a file, not code. Manifests are read with Spark from any folder that it reads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions import parsers
from .mappings import ACTIONS, CATEGORIES, OUTCOMES, of_manifest
from .packs import PACKS, Pack, Rule, by_priority

@dataclass(frozen=True)
class Form:
    """What a value must be: ``good`` says so of the value itself, ``parts`` of a mapping's entries, ``each`` of a list's. An entry may lack if its form is ``optional``. ``by`` names the entry that chooses one of ``forms``."""

    said: str
    good: Callable[[object], bool] = lambda v: True
    parts: dict[str, Form] = field(default_factory=dict)
    each: Form | None = None
    optional: bool = False
    by: str = ""
    forms: dict[str, Form] = field(default_factory=dict)


def _compiles(pattern: object) -> bool:
    try:
        return isinstance(pattern, str) and re.compile(pattern) is not None
    except re.error:
        return False


def _mapping(v: object) -> bool:
    return isinstance(v, dict)


def _texts(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(w, str) for w in v)


# Labels of severities.
LABELS = ("critical", "high", "medium", "low", "informational", "unknown")

_NAME = Form("a text", lambda v: isinstance(v, str))
_FILLED = Form("a text that isn't blank", lambda v: isinstance(v, str) and bool(v.strip()))
#: What a detection rule may look at beside the text, and how rules of each type name their values.
_TARGET = Form("one of raw_payload, source_ip", lambda v: v in ("raw_payload", "source_ip"), optional=True)
VALUES = {"regex": "pattern", "keyword": "any_of", "equals": "equals"}
_VALUE_FORMS = {"regex": Form("a regular expression", _compiles), "keyword": Form("a list of texts", _texts), "equals": _NAME}
_RULE = Form("a mapping", _mapping, by="type", forms={kind: Form("a mapping", _mapping, {VALUES[kind]: form, "target": _TARGET}) for kind, form in _VALUE_FORMS.items()})


def _form_of(good: Callable[[object], bool], said: str, optional: bool = True) -> Form:
    return Form(said, good, optional=optional)


def _table_form(stands: Callable[[object], bool], optional: bool = True) -> Form:
    """A table from a field's values to what they stand for, or a default alone."""
    values = _form_of(lambda v: isinstance(v, dict) and all(isinstance(k, str) and stands(x) for k, x in v.items()), "a mapping of texts to what they stand for")
    field_ = _form_of(lambda v: isinstance(v, str) and bool(v), "a field's name")
    return Form("a mapping with field and values, or a default", lambda v: _mapping(v) and ("default" in v or {"field", "values"} <= set(v)), {"field": field_, "values": values, "default": _form_of(stands, "what a value stands for")}, optional=optional)


def _pair(first: Callable[[object], bool], second: tuple[str, ...]) -> Callable[[object], bool]:
    return lambda v: isinstance(v, list) and len(v) == 2 and first(v[0]) and v[1] in second


_SNAKE = _form_of(lambda v: isinstance(v, str) and re.fullmatch("[a-z][a-z0-9_]*", v) is not None, "a snake_case name", False)
_END = Form("a mapping", _mapping, {n: _form_of(lambda v: isinstance(v, str), "a field's name") for n in ("ip", "port", "interface")}, optional=True)
#: How a pack reaches the unified schema.
MAPPING = Form(
    "a mapping",
    _mapping,
    {
        "id": _SNAKE,
        "version": _form_of(lambda v: isinstance(v, str) and re.fullmatch(r"\d+\.\d+\.\d+", v) is not None, "a semantic version", False),
        "name": _FILLED,
        "category": _table_form(lambda v: v in CATEGORIES, False),
        "type": Form("a mapping", _mapping, {"field": _form_of(lambda v: isinstance(v, str), "a field's name"), "default": Form(_SNAKE.said, _SNAKE.good, optional=True)}, optional=True),
        "message": _form_of(_texts, "a list of fields"),
        "source": _END,
        "destination": _END,
        "transport": _form_of(lambda v: isinstance(v, str), "a field's name"),
        "action": _table_form(_pair(lambda a: a in ACTIONS, OUTCOMES)),
        "severity": _table_form(_pair(lambda n: isinstance(n, int) and not isinstance(n, bool) and 0 <= n <= 10, LABELS)),
        "observer_type": _form_of(lambda v: isinstance(v, str) and bool(v), "a text"),
    },
    optional=True,
)
#: The whole of a manifest.
MANIFEST = Form(
    "a mapping",
    _mapping,
    {
        "pack": Form("a mapping", _mapping, {n: _FILLED for n in ("vendor", "product", "pack_version")}),
        "detection": Form(
            "a mapping",
            _mapping,
            {
                "priority": Form("an integer", lambda v: isinstance(v, int) and not isinstance(v, bool), optional=True),
                "rules": Form("a list", lambda v: isinstance(v, list), each=_RULE, optional=True),
            },
        ),
        "format": Form("a mapping", _mapping, {"type": Form(f"one of {', '.join(parsers.PARSERS)}", lambda v: isinstance(v, str) and v in parsers.PARSERS)}),
        "fields": Form("a list", lambda v: isinstance(v, list), each=Form("a mapping", _mapping, {"name": _NAME, "source": _NAME})),
        "mapping": MAPPING,
    },
)


def problems(value: object, form: Form = MANIFEST, at: str = "manifest") -> list[str]:
    """Where a value, a whole manifest if nothing else is said, isn't what its form says; empty for a good one."""
    if not form.good(value):
        return [f"{at} must be {form.said}"]
    if form.by:
        chosen = form.forms.get(str(value.get(form.by)))
        return problems(value, chosen, at) if chosen else [f"{at}.{form.by} must be one of {', '.join(form.forms)}"]
    found = [f"{at}.{n} is missing" for n, part in form.parts.items() if n not in value and not part.optional]
    found += [p for n, part in form.parts.items() if n in value for p in problems(value[n], part, f"{at}.{n}")]
    if form.each:
        found += [p for i, v in enumerate(value) for p in problems(v, form.each, f"{at}[{i}]")]
    return found


def pack_of(manifest: dict, name: str) -> Pack:
    """The pack of a good manifest; ``name`` is its id where it gives none."""
    meta, detection = manifest["pack"], manifest["detection"]
    pack_id = meta.get("id", name)
    rules = tuple(Rule(r["type"], tuple(r["any_of"]) if r["type"] == "keyword" else (r[VALUES[r["type"]]],), r.get("target", "raw_payload")) for r in detection.get("rules", []))
    default = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    fields = tuple((f["name"], f["source"], bool(f.get("required", False)), default(f.get("default"))) for f in manifest["fields"])
    return Pack(pack_id, meta["vendor"], meta["product"], detection.get("priority", 0), rules, manifest["format"]["type"], f"{pack_id}.{manifest['format']['type']}", fields, meta["pack_version"], mapping=of_manifest(manifest["mapping"]) if "mapping" in manifest else None)


def _decoded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # only manifests in YAML need it

        return yaml.safe_load(text)


def load(spark: SparkSession, folder: str) -> tuple[tuple[Pack, ...], dict[str, list[str]]]:
    """The packs of all manifests ``folder/<pack>/manifest.json`` (or .yaml, .yml), by name of their folders, and what is wrong with those that are left out: broken ones and those whose id another has."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.{json,yaml,yml}").text(folder)
    packs: dict[str, Pack] = {}
    wrong: dict[str, list[str]] = {}
    for row in files.selectExpr("input_file_name() as file", "value").orderBy("file").toLocalIterator():
        name = row.file.rstrip("/").split("/")[-2]
        try:
            manifest = _decoded(row.value)
        except Exception as e:  # whatever the reader of the format raises: this pack is left out, the others load
            wrong[name] = [f"can't be read: {type(e).__name__}"]
            continue
        if found := problems(manifest):
            wrong[name] = found
        elif (pack := pack_of(manifest, name)).pack_id in packs:
            wrong[name] = [f"id {pack.pack_id} is taken"]
        elif pack.mapping and pack.mapping.mapping_id in {p.mapping.mapping_id for p in packs.values() if p.mapping}:
            wrong[name] = [f"mapping {pack.mapping.mapping_id} is taken"]
        else:
            packs[pack.pack_id] = pack
    return tuple(by_priority(tuple(packs.values()))), wrong


def merged(more: tuple[Pack, ...], packs: tuple[Pack, ...] = PACKS) -> tuple[Pack, ...]:
    """The built-in packs and others; one with a built-in id replaces it."""
    return tuple(by_priority((*[p for p in packs if p.pack_id not in {m.pack_id for m in more}], *more)))
