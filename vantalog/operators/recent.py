"""Repeated events among the recent ones of a source: a bounded cache of digests, over sorted rows and on streams."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

#: Digests that a source's cache holds.
ROOM = 10_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recent:
    """The ``room`` digests seen last. A hit renews a digest; what was seen longest ago goes first. Each has the place at which it was seen last."""

    def __init__(self, room: int, held: list[tuple[int, str]] = (), following: int = 0):
        self.room, self.following = room, following
        self.place: OrderedDict[str, int] = OrderedDict((digest, at) for at, digest in sorted(held))

    def seen(self, digest: str | None) -> bool:
        """Whether the cache holds the digest, which it does from now on. Null is never a repeat."""
        if digest is None:
            return False
        known = digest in self.place
        self.place[digest] = self.following
        self.place.move_to_end(digest)
        self.following += 1
        if len(self.place) > self.room:
            self.place.popitem(last=False)
        return known


def _flagged(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("duplicate", BooleanType())


def flag_recent_duplicates(rows: DataFrame, digest: str, order: str, source: str, room: int = ROOM) -> DataFrame:
    """``rows`` with duplicate: whether the source's cache of its ``room`` latest distinct digests held the row's digest.

    Rows are dealt out by source and sorted by source and order; a task passes over them with one cache at a time, so
    neither a source's rows nor its digests are ever gathered. Nothing is dropped; null digests aren't repeats; null
    sources are one source.
    """
    at, of = rows.columns.index(digest), rows.columns.index(source)
    kinds = _flagged(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = object(), Recent(room)
        for batch in batches:
            flags = []
            for own, value in zip(batch.column(of).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if own != now:
                    now, cache = own, Recent(room)
                flags.append(cache.seen(value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*batch.schema.names, "duplicate"])

    return rows.repartition(source).sortWithinPartitions(source, order).mapInArrow(run, kinds)


class RecentDigests(StatefulProcessor):
    """A source's cache as state: place and digest of each entry. A batch reads the entries once and writes what it changed."""

    def __init__(self, digest: str, order: str, room: int):
        self.digest, self.order, self.room = digest, order, room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "place bigint", "digest string")
        self.clock = handle.getValueState("clock", "following bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(place[0], digest[0]) for place, digest in self.entries.iterator()]
        cache = Recent(self.room, held, self.clock.get()[0] if self.clock.exists() else 0)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        flags = [cache.seen(None if pd.isna(d) else d) for d in batch[self.digest]]
        before, after = set(held), {(at, digest) for digest, at in cache.place.items()}
        for at, _ in before - after:
            self.entries.removeKey((at,))
        for at, digest in after - before:
            self.entries.updateValue((at,), (digest,))
        self.clock.update((cache.following,))
        yield batch.assign(duplicate=flags)

    def close(self) -> None:
        pass


def live_flags(rows: DataFrame, digest: str, order: str, source: str, room: int = ROOM) -> DataFrame:
    """A stream's rows with duplicate, as ``flag_recent_duplicates`` flags them; nothing is dropped.

    State is one cache a source, whatever has passed; it outlives restarts with the query's checkpoint. A micro-batch's
    rows of one source meet in one task, so its size is what a trigger takes at a time. Start the query inside
    ``state_in_rocksdb``. Sources are never null here (``collect.ingest`` names those without a name).
    """
    return rows.groupBy(source).transformWithStateInPandas(RecentDigests(digest, order, room), outputStructType=_flagged(rows.schema), outputMode="Append", timeMode="None")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in here keep their state where maps of state can be kept."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
