"""What the operators share: words, hashes, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of letters, digits and everything beyond ASCII, for Java and RE2.
ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between white space.
SPACED_RE = r"[^\x20\x09-\x0D]+"

_ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of ``ALNUM_RE`` in UTF-8 bytes; none for null."""
    return text.translate(_ALNUM).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of ``SPACED_RE`` in UTF-8 bytes; none for null."""
    return text.lower().split() if text else []


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """Word to 64-bit hash. Forgets everything beyond ``room`` words, so memory stays bounded."""

    def __init__(self, room: int = 400_000, seed: int = 42):
        super().__init__()
        self.room, self.seed = room, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind, which else stay until the driver's next garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Deletes the table behind a ``saved`` frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df``, marked for broadcast only if its counted rows stay within ``limit`` bytes; else Spark joins by shuffle.

    Meant for ``saved`` tables, whose count reads footers only.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``most_bytes``, or one row if that is larger."""
    for batch in rows:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)


def doc_key(text: Column) -> Column:
    """XXH64 of the text (null as empty): with doc_id it tells rows apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
