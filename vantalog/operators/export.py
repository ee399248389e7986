"""Exports: JSON lines, a partitioned Parquet lake, and manifests that prove their integrity."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import lake_rows

KEYS = ("year", "month", "day", "category")


def split_counts(rows: DataFrame) -> DataFrame:
    """total, valid, quarantine, schema_version (the only one, mixed, or unknown if there is none) of an export."""
    valid = F.coalesce("quality_status", F.lit("valid")) == "valid"
    versions = F.collect_set("schema_version")
    return rows.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("quarantine"), F.when(F.size(versions) == 0, "unknown").when(F.size(versions) == 1, F.get(versions, F.lit(0))).otherwise("mixed").alias("schema_version"))


def jsonl(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Canonical JSON, a line an event, valid events and the rest apart. The committer makes each directory appear whole. ``compression``: as of Spark's text files, such as gzip."""
    valid = F.coalesce("quality_status", F.lit("valid")) == "valid"
    rows.where(valid).select(F.col("normalized_json").alias("value")).write.option("compression", compression).text(f"{path}/normalized")
    rows.where(~valid).select(F.col("normalized_json").alias("value")).write.option("compression", compression).text(f"{path}/quarantine")


def lake(rows: DataFrame, path: str, files_per_partition: int = 1) -> None:
    """Hive partitions by day and category with zstd; large partitions are spread over several files."""
    out = lake_rows(rows)
    for quarantined, at in ((False, path), (True, f"{path}/quarantine")):
        part = out.where(F.col("quarantined") == quarantined).drop("quarantined")
        part.repartition(*KEYS, F.pmod(F.xxhash64("event_id"), F.lit(files_per_partition))).sortWithinPartitions(*KEYS, "observed_at").write.option("compression", "zstd").partitionBy(*KEYS).parquet(at)


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of files, read piece by piece."""
    for batch in rows:
        sums = []
        for path in batch.column(0).to_pylist():
            system, at = fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:") else path)
            digest = hashlib.sha256()
            with system.open_input_stream(at) as source:
                while piece := source.read(8 << 20):
                    digest.update(piece)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], ["file", "bytes", "sha256"])


def manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """path (below ``path``), bytes and sha256 of every file. Files are listed without their contents and hashed by the tasks in pieces, so their size doesn't matter."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    at, system = _hadoop(spark, path)
    root = system.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    found = files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_hashed, "file string, bytes long, sha256 string")
    return found.select(F.substring_index("file", root, -1).alias("path"), "bytes", "sha256")


#: What the manifest of a committed export says of itself.
MANIFEST, MANIFEST_VERSION = "manifest.json", "2.0"
#: The files of lines, compressed or not.
_LINES = "*.txt*"


def commit_jsonl(rows: DataFrame, path: str, compression: str = "none") -> dict:
    """Exports canonical JSON, a line an event, valid events and the rest apart, as one: nothing is at ``path`` before all is.

    Lines are written beside ``path``, below a name of their own, then the manifest: its version, totals and, of every
    file, part, rows, bytes and SHA-256 as it lies there, compressed or not. One rename puts the whole export in place; a run that ends before leaves none.
    The manifest is what is returned. A path that is taken is refused.
    """
    spark = rows.sparkSession
    at, system = _hadoop(spark, path)
    if system.exists(at):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    jsonl(rows, staged, compression)
    files = _files(spark, staged).orderBy("path")
    totals = split_counts(rows).first()
    told = [{"path": r.path, "part": r.path.split("/")[0], "rows": r.rows, "bytes": r.bytes, "sha256": r.sha256} for r in files.toLocalIterator()]
    counted = {part: sum(f["rows"] for f in told if f["part"] == part) for part in ("normalized", "quarantine")}
    if counted != {"normalized": totals.valid, "quarantine": totals.quarantine}:
        raise ValueError(f"{counted} lines were written of {totals.valid} valid and {totals.quarantine} other events")
    made = {"manifest_version": MANIFEST_VERSION, "schema_version": totals.schema_version, "total": totals.total, "valid": totals.valid, "quarantine": totals.quarantine, "files": told}
    out = system.create(_hadoop(spark, f"{staged}/{MANIFEST}")[0], False)
    out.write(json.dumps(made, indent=1, sort_keys=True).encode())
    out.close()
    if not system.rename(_hadoop(spark, staged)[0], at):
        raise OSError(f"{staged} can't be renamed to {path}")
    return made


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, rows, bytes, sha256 of the text files of an export, empty ones too."""
    at, system = _hadoop(spark, path)
    root = system.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    counted = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _LINES).option("lineSep", "\n").text(path).groupBy(F.substring_index("_metadata.file_path", root, -1).alias("path")).agg(F.count("*").alias("rows"))
    return manifest(spark, path, _LINES).join(counted, "path", "left").select("path", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "bytes", "sha256")


def verify_committed(spark: SparkSession, path: str) -> DataFrame:
    """path and problem (missing, unexpected, outside, changed, rows) of every file of a committed export that isn't as its manifest says; empty if all are."""
    kind = "manifest_version string, files array<struct<path:string,part:string,rows:long,bytes:long,sha256:string>>"
    recorded = spark.read.schema(kind).option("multiLine", "true").json(f"{path}/{MANIFEST}").select(F.explode("files").alias("f")).select("f.*")
    wrong = verify(spark, path, recorded.select("path", "bytes", "sha256"), _LINES)
    counted = _files(spark, path).select("path", F.col("rows").alias("_rows"))
    miscounted = recorded.join(counted, "path").where(F.col("rows") != F.col("_rows")).select("path", F.lit("rows").alias("problem"))
    return wrong.unionByName(miscounted.join(wrong, "path", "left_anti"))


def verify(spark: SparkSession, path: str, recorded: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """path and problem (missing, unexpected, outside, changed) of every file that isn't as recorded; empty if all are."""
    now = manifest(spark, path, pattern).select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    joined = recorded.join(now, "path", "full")
    problem = (
        F.when(F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))"), "outside")
        .when(F.col("_sha").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unexpected")
        .when((F.col("bytes") != F.col("_bytes")) | (F.col("sha256") != F.col("_sha")), "changed")
    )
    return joined.select("path", problem.alias("problem")).where("problem is not null")
