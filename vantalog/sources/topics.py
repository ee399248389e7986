"""Append-only topics of JSON lines: a data source whose writes appear whole or not at all, dealt into buckets by key.

``path/bucket=3/<commit>-<task>.ndjson`` holds the lines of a task and a bucket. A write's files count once its commit is
there, ``path/_commits/<commit>``, which is the last thing that is written; what failed tasks left is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "vantalog_topic"
#: Buckets of a topic, as many as consumers may share its keys.
BUCKETS = 48


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    lines: int


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class TopicWriter(DataSourceArrowWriter):
    """Lines (bucket, value) as they come, a file a bucket and task; rows of a task are sorted by bucket."""

    def __init__(self, path: str):
        self.path, self.name = path.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _at(self.path)
        task, files, lines, now, out = uuid.uuid4().hex, [], 0, None, None
        try:
            for batch in iterator:
                for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("value").to_pylist(), strict=True):
                    if bucket != now:
                        if out:
                            out.close()
                        now, folder = bucket, f"{root}/bucket={bucket}"
                        system.create_dir(folder, recursive=True)
                        files.append(f"bucket={bucket}/{self.name}-{task}-{len(files)}.ndjson")
                        out = system.open_output_stream(f"{root}/{files[-1]}")
                    if "\n" in value:
                        raise ValueError("a line of a topic holds no line feed")
                    out.write(value.encode() + b"\n")
                    lines += 1
        finally:
            if out:
                out.close()
        return Written(files, lines)

    def commit(self, messages: list[Written | None]) -> None:
        """Tells the write's tasks, and with that their lines: a file that another attempt of a task left isn't among them."""
        system, root = _at(self.path)
        system.create_dir(f"{root}/_commits", recursive=True)
        said = [{"file": f, "commit": self.name} for m in messages if m for f in m.files]
        draft = f"{root}/_commits/.{self.name}"
        with system.open_output_stream(draft) as out:
            out.write("".join(json.dumps(s) + "\n" for s in said).encode())
        system.move(draft, f"{root}/_commits/{self.name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{root}/{f}")


class TopicSource(DataSource):
    """``df.write.format("vantalog_topic").mode("append").save(path)`` for rows (bucket int, value string)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "bucket int, value string"

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("topics are only appended to")
        return TopicWriter(self.options["path"])


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key: the same for all time, null keys share the first."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % buckets, F.lit(0)).cast("int")


def append(rows: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Appends every row as one line of JSON, without null fields: rows of a key go to one bucket, in their order. ``rows`` may be a micro-batch."""
    spark = rows.sparkSession
    spark.dataSource.register(TopicSource)
    lines = rows.select(bucket_of(F.col(key), buckets).alias("bucket"), F.col(order).alias("_order"), F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.repartition(buckets, "bucket").sortWithinPartitions("bucket", "_order").select("bucket", "value").write.format(FORMAT).mode("append").save(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """bucket, commit, file, value of all committed lines. Within a bucket, lines stand in the order of commits and of their file."""
    every = spark.read.schema("value string, bucket int").option("pathGlobFilter", "*.ndjson").text(path).select("bucket", F.concat(F.lit("bucket="), F.col("bucket").cast("string"), F.lit("/"), F.col("_metadata.file_name")).alias("file"), "value")
    commits = spark.read.schema("file string, commit string").json(f"{path}/_commits")
    return every.join(commits, "file").select("bucket", "commit", "file", "value")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a topic: ``schema``'s columns of all committed lines, and bucket and commit. Lines that aren't JSON objects of that schema give null columns."""
    return lines(spark, path).select(F.from_json("value", schema).alias("v"), "bucket", "commit").select("v.*", "bucket", "commit")
