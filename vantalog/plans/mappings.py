"""Mappings of packs to the unified schema as data: a manifest's pack reaches the schema without code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import slug

CATEGORIES = ("network", "intrusion_detection", "authentication", "web", "system", "unknown")
ACTIONS = ("allow", "deny", "block", "detect", "connect", "disconnect", "authenticate", "unknown")
OUTCOMES = ("success", "failure", "unknown")


@dataclass(frozen=True)
class Table:
    """What a field's value (in any case) stands for; ``default`` for all others and where it lacks."""

    field: str = ""
    values: tuple[tuple[str, tuple], ...] = ()
    default: tuple = ()

    def column(self, of: Callable[[str], Column], place: int = 0) -> Column:
        """The ``place``-th part of what the value stands for; null without a default."""
        default = F.lit(self.default[place] if self.default else None)
        if not self.values:
            return default
        known = F.create_map(*[F.lit(x) for value, stands in self.values for x in (value.lower(), stands[place])])
        return F.coalesce(F.try_element_at(known, F.lower(of(self.field))), default)

    def original(self, of: Callable[[str], Column]) -> Column:
        return F.coalesce(of(self.field), F.lit("unknown")) if self.field else F.lit("unknown")


@dataclass(frozen=True)
class Mapping:
    """Which fields of a pack hold what. Ends are (ip, port, interface), '' for none. ``type_field`` gives the event's type, ``fallback_type`` where it lacks."""

    mapping_id: str
    version: str
    name: str
    category: Table
    type_field: str
    fallback_type: str
    message: tuple[str, ...] = ()
    source: tuple[str, str, str] = ("", "", "")
    destination: tuple[str, str, str] = ("", "", "")
    transport: str = ""
    action: Table = Table()
    severity: Table = Table()
    observer_type: str = "unknown"

    @property
    def has_ends(self) -> bool:
        return bool(self.source[0] or self.destination[0])

    def one(self, of: Callable[[str], Column], *names: str) -> Column:
        """The first of the fields that is there."""
        return F.coalesce(*[of(n) for n in names if n], F.lit(None).cast("string"))

    def event_type(self, of: Callable[[str], Column]) -> Column:
        return slug(F.coalesce(self.one(of, self.type_field), F.lit("")), F.lit(self.fallback_type))


def of_manifest(data: dict) -> Mapping:
    """The mapping of a manifest's good ``mapping`` section."""

    def table(section: dict | None) -> Table:
        section = section or {}
        whole = lambda v: tuple(v) if isinstance(v, list) else (v,)
        default = section.get("default")
        return Table(section.get("field", ""), tuple((k, whole(v)) for k, v in section.get("values", {}).items()), () if default is None else whole(default))

    end = lambda name: tuple(data.get(name, {}).get(n, "") for n in ("ip", "port", "interface"))
    kind = data.get("type", {})
    return Mapping(data["id"], data["version"], data["name"], table(data["category"]), kind.get("field", ""), kind.get("default", "unmapped_event"), tuple(data.get("message", ())), end("source"), end("destination"), data.get("transport", ""), table(data.get("action")), table(data.get("severity")), data.get("observer_type", "unknown"))
