"""The engine as one object and as a command: packs, processing with a status a row, the event table, searches and exports."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import small_methods
from .operators import collect, export, store
from .operators.validate import structural_issues, validate
from .plans import manifests
from .plans.normalize import normalize
from .plans.packs import PACKS, Pack, parse
from .sources.shared import saved


class Engine:
    """All stages over one set of packs and one store. ``store_path`` is any folder that Spark writes; ``pack_folder`` holds further packs as manifests."""

    def __init__(self, spark: SparkSession, store_path: str, pack_folder: str | None = None):
        self.spark, self.store_path, self.pack_folder = spark, store_path.rstrip("/"), pack_folder
        self.packs: tuple[Pack, ...] = PACKS
        self.left_out: dict[str, list[str]] = {}
        self.reload()

    def reload(self) -> dict[str, list[str]]:
        """Reads the manifests again and returns what is wrong with those left out. Queries made before keep their packs."""
        if self.pack_folder:
            more, self.left_out = manifests.load(self.spark, self.pack_folder)
            self.packs = manifests.merged(more)
        return self.left_out

    def list_packs(self) -> list[dict]:
        """The packs by priority."""
        return [{"pack_id": p.pack_id, "vendor": p.vendor, "product": p.product, "version": p.version, "priority": p.priority, "format": p.format} for p in self.packs]

    def health(self) -> dict:
        """Whether packs and store can be used; the store's files are listed, none is read."""
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store_path}/events/month=*/part-*")
            stored = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
            stored = len(stored) if stored is not None else 0
        except Exception as e:  # an unreadable store is what a health report is for
            return {"status": "degraded", "packs": len(self.packs), "store": type(e).__name__, "left_out": self.left_out}
        return {"status": "ok" if not self.left_out else "degraded", "packs": len(self.packs), "store": "ready" if stored else "empty", "left_out": self.left_out}

    def evaluated(self, raw: DataFrame) -> DataFrame:
        """``raw`` (event_id, ingested_at, source_id, source_ip, transport, payload) as validated unified events; rejected payloads aren't among them."""
        taken = collect.ingest(raw).where("reason is null")
        return validate(normalize(parse(taken, self.packs), packs=self.packs))

    def process(self, raw: DataFrame) -> DataFrame:
        """Stores all events and answers with a row each: event_id, status (stored, quarantined or rejected), reason or validation codes, pack, parse status, quality, hash."""
        made = self.evaluated(raw).persist()
        try:
            with small_methods(self.spark):
                store.write_events(made, self.store_path)
            codes = F.array_join(F.transform("validation", lambda i: F.concat_ws(":", i.path, i.rule)), ",")
            kept = made.select("event_id", F.when(F.col("storable"), "stored").otherwise("quarantined").alias("status"), codes.alias("detail"), "pack", F.col("status").alias("parse_status"), F.col("quality.status").alias("quality"), F.col("traceability.raw_sha256").alias("raw_sha256"))
            refused = collect.ingest(raw).where("reason is not null").select("event_id", F.lit("rejected").alias("status"), F.col("reason").alias("detail"), *[F.lit(None).cast("string").alias(n) for n in ("pack", "parse_status", "quality")], "raw_sha256")
            return saved(kept.unionByName(refused), "processed")
        finally:
            made.unpersist()

    def events(self) -> DataFrame:
        """Of every stored event the version that counts."""
        return store.current(self.spark.read.parquet(f"{self.store_path}/events"))

    def search(self, limit: int = 50, **facets) -> DataFrame:
        """The newest events of these facets; a ``limit`` beyond 1 to 500 is refused."""
        return store.search(self.events(), limit=within_bounds(limit), **facets)

    def export(self, path: str, form: str = "lake", limit: int | None = None, **facets) -> dict | None:
        """The events of these facets below ``path``, as a lake or as JSON lines committed as one, whose manifest is returned.

        ``limit``: only the newest so many, however large; None: all.
        """
        if form not in ("lake", "jsonl"):
            raise ValueError(f"unknown form: {form}")
        if limit is not None and limit < 1:
            raise ValueError(f"limit below 1: {limit}")
        rows = store.search(self.events(), limit=None, **facets)
        if limit is not None:
            rows = rows.orderBy(F.col("observed_at").desc(), "event_id").limit(limit)
        if form == "lake":
            return export.lake(rows, path)
        return export.commit_jsonl(rows.withColumn("schema_version", F.get_json_object("normalized_json", "$.schema_version")), path)


def within_bounds(limit: int | str) -> int:
    """The limit of a search, 1 to 500."""
    if not 1 <= int(limit) <= 500:
        raise ValueError(f"limit beyond 1 to 500: {limit}")
    return int(limit)


def document_problems(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """path, rule, document (its beginning): what is wrong with the JSON documents at ``path``, one a line or, if ``whole``, one a file."""
    text = spark.read.text(path, wholetext=whole)
    return text.select("value", F.explode(structural_issues("value")).alias("issue")).select("issue.path", "issue.rule", F.substring("value", 1, 80).alias("document"))


def main(argv: list[str] | None = None) -> int:
    """Commands: packs, health, process FILES, search, export PATH, validate FILES. Exit codes: 0 good, 1 something is wrong with the input, 2 the command is, or a path can't be read or is taken."""
    ask = argparse.ArgumentParser(prog="vantalog")
    ask.add_argument("--store", default="vantalog-store")
    ask.add_argument("--packs")
    commands = ask.add_subparsers(dest="command", required=True)
    commands.add_parser("packs")
    commands.add_parser("health")
    commands.add_parser("process").add_argument("path")
    check, find, out = (commands.add_parser(name) for name in ("validate", "search", "export"))
    check.add_argument("path")
    check.add_argument("--whole", action="store_true", help="a file is one document")
    for facet in ("vendor", "category", "action", "severity", "quality", "text", "start", "end"):
        find.add_argument(f"--{facet}")
        out.add_argument(f"--{facet}")
    find.add_argument("--limit", type=within_bounds, default=50)
    out.add_argument("path")
    out.add_argument("--form", choices=("lake", "jsonl"), default="lake")
    out.add_argument("--limit", type=int)
    given = ask.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    say = lambda df: [print(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    try:
        return _run(spark, given, say)
    except (AnalysisException, FileExistsError) as e:
        if isinstance(e, AnalysisException) and e.getCondition() not in ("PATH_NOT_FOUND", "PATH_ALREADY_EXISTS"):
            raise
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2


def _run(spark: SparkSession, given: argparse.Namespace, say) -> int:
    if given.command == "validate":
        return int(bool(say(document_problems(spark, given.path, given.whole))))
    engine = Engine(spark, given.store, given.packs)
    if given.command in ("packs", "health"):
        print(json.dumps(engine.list_packs() if given.command == "packs" else engine.health()))
        return int(bool(engine.left_out))
    if given.command == "process":
        counts = engine.process(collect.read_lines(spark, given.path)).groupBy("status").agg(F.count("*").alias("n"))
        return int(any(json.loads(r.j)["status"] == "rejected" for r in counts.select(F.to_json(F.struct("*")).alias("j")).collect() if not print(r.j)))
    asked = {k: v for k, v in vars(given).items() if k not in ("command", "store", "packs")}
    if given.command == "export":
        print(json.dumps(engine.export(**asked)))
    else:
        say(engine.search(**asked))
    return 0


if __name__ == "__main__":
    sys.exit(main())
