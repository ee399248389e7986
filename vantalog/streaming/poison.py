"""Rows that code from outside can't take: found by halving what failed, put aside, while all others go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Halvings before what is left counts as one message: repeats of one key can't be told apart.
MOST_HALVINGS = 40


def isolated(rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """What ``work`` makes of the rows that it can take, and the rows on which it raises.

    The whole is tried first, written below ``path``. What fails is halved by a bit of the key's hash, each half tried
    by itself, until a single row fails: for every such row about log2 of the rows in tries, of half the size each. What
    failed is put down before it is halved, so the tries read what they try, and one such row costs about two readings
    of the whole, not two for every halving. A try that fails leaves nothing behind that counts. ``path`` is written anew if the same rows are tried again.
    Without rows on which it raises, ``work`` runs once.
    """
    spark = rows.sparkSession
    good, lost = f"{path}/good", f"{path}/lost"
    read = lambda at, schema: spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(at)
    tried = work(rows)
    tried.limit(0).write.mode("overwrite").parquet(good)
    rows.limit(0).write.mode("overwrite").parquet(lost)

    def attempt(part: DataFrame, bits: str) -> None:
        try:
            work(part).write.mode("overwrite").parquet(f"{good}/part={bits}")
        except PySparkException:
            if len(bits) > MOST_HALVINGS or part.limit(2).count() < 2:
                part.write.mode("overwrite").parquet(f"{lost}/part={bits}")
                return
            part.write.mode("overwrite").parquet(f"{path}/halved/part={bits}")
            part = read(f"{path}/halved/part={bits}", rows.schema)
            bit = F.shiftrightunsigned(F.xxhash64(key), len(bits)).bitwiseAND(F.lit(1).cast("long"))
            for side in (0, 1):
                attempt(part.where(bit == side), f"{bits}{side}")

    attempt(rows, "p")
    return read(good, tried.schema), read(lost, rows.schema)
