"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 4, native).

How many rows each input partition sends to each shard is drawn first, exactly as a uniform shuffle of all rows would
have it: row sums are the partitions' row counts, column sums the shards' sizes. Each partition then permutes its rows
locally and deals them out by the matrix. A shard permutes what it received by a random key; bins of that key's range
are counted first, so that its rows are ordered in many tasks and slots still have no gaps. Rows move once.
Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

_LOW_33 = (1 << 33) - 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(n: Column, own: Column, total: Column, u: Column) -> Column:
    """A hypergeometric draw by inversion: how many of ``n`` rows, dealt at random into ``total`` places, land in ``own`` of them. ``u`` is uniform in [0, 1).

    Outcomes are taken from the mode outwards, each weight following from its neighbour's, as far as 9 standard
    deviations and 9: what lies beyond has a probability under 1e-15.
    """
    asked = F.struct(n.cast("double").alias("n"), own.cast("double").alias("k"), total.cast("double").alias("t"), u.alias("u"))

    def with_window(a: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), a.n + a.k - a.t), F.least(a.n, a.k)
        mode = F.least(F.greatest(F.floor((a.n + 1) * (a.k + 1) / (a.t + 2)).cast("double"), low), high)
        wide = F.ceil(9 * F.sqrt(F.greatest(F.lit(0.0), a.n * (a.k / F.greatest(a.t, F.lit(1.0))) * (1 - a.k / F.greatest(a.t, F.lit(1.0)))))) + 9
        return F.struct(a.n.alias("n"), a.k.alias("k"), a.t.alias("t"), a.u.alias("u"), mode.alias("mode"), F.greatest(low, mode - wide).alias("low"), F.least(high, mode + wide).alias("high"))

    def steps(a: Column, up: bool) -> Column:
        count = (a.high - a.mode if up else a.mode - a.low).cast("long")
        return F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<long>"))

    def ratio(a: Column, i: Column, up: bool) -> Column:
        x = a.mode + i - 1 if up else a.mode - i + 1
        if up:
            return (a.k - x) * (a.n - x) / ((x + 1) * (a.t - a.k - a.n + x + 1))
        return x * (a.t - a.k - a.n + x) / ((a.k - x + 1) * (a.n - x + 1))

    def mass(a: Column, up: bool) -> Column:
        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps(a, up), one, lambda s, i: _let(s.w * ratio(a, i, up), lambda w: F.struct(w.alias("w"), (s.sum + w).alias("sum"))), lambda s: s.sum)

    def chosen(a: Column, target: Column, up: bool) -> Column:
        """Steps from the mode until the running weight passes the target; -1 if it never does."""
        one = F.struct(F.lit(1.0).alias("w"), target.alias("left"), F.lit(-1).cast("long").alias("at"))
        return F.aggregate(
            steps(a, up),
            one,
            lambda s, i: _let(s.w * ratio(a, i, up), lambda w: F.struct(w.alias("w"), (s.left - w).alias("left"), F.when((s.at < 0) & (s.left < w), i).otherwise(s.at).alias("at"))),
            lambda s: s.at,
        )

    def pick(a: Column) -> Column:
        return _let(
            F.struct(mass(a, True).alias("up"), mass(a, False).alias("down")),
            lambda m: _let(
                a.u * (1 + m.up + m.down),
                lambda t: F.when(t < 1, a.mode)
                .when(t < 1 + m.up, a.mode + F.greatest(chosen(a, t - 1, True), F.lit(0)))
                .otherwise(a.mode - F.greatest(chosen(a, t - 1 - m.up, False), F.lit(0))),
            ),
        )

    return _let(_let(asked, with_window), pick).cast("long")


def _unit(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def matrix(sizes: DataFrame, group: str, seed: int) -> DataFrame:
    """The communication matrix, one row per part: ``group``, part, sends (array of rows for each cell).

    ``sizes`` has ``group``, parts (array of structs part, n in order of part) and cells (array of long whose sum is
    that of n), one row per group: each is drawn by itself, part after part and cell after cell.
    """

    def row(n: Column, part: Column, cells: Column) -> Column:
        start = F.struct(n.alias("n"), F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c).alias("t"), F.array().cast("array<long>").alias("sends"))
        deal = lambda s, c: _let(_draw(s.n, c, s.t, _unit(F.lit(seed), part, F.size(s.sends))), lambda d: F.struct((s.n - d).alias("n"), (s.t - c).alias("t"), F.concat(s.sends, F.array(d)).alias("sends")))
        return F.aggregate(cells, start, deal, lambda s: s.sends)

    start = F.struct(F.col("cells"), F.array().cast("array<struct<part:long,sends:array<long>>>").alias("rows"))
    step = lambda s, p: _let(row(p.n, p.part, s.cells), lambda r: F.struct(F.zip_with(s.cells, r, lambda c, d: c - d).alias("cells"), F.concat(s.rows, F.array(F.struct(p.part.alias("part"), r.alias("sends")))).alias("rows")))
    return sizes.select(group, F.inline(F.aggregate("parts", start, step, lambda s: s.rows)))


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan only reads, projects and filters files, so that partitions hold the same rows each time."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+\-|]*(Project|Filter|Relation)\b", line) for line in plan.splitlines() if line.strip())


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, rows_per_bin: int = 2048, group_parts: int = 256) -> DataFrame:
    """All rows and columns of ``docs`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Each row count is total / shards, rounded down or up (law ``rows``), and every arrangement is equally likely up to
    the hash that serves as the source of randomness. Repeated rows, nulls and empty texts are rows like any other; an
    empty table gives an empty result. Columns named shard or slot are replaced; others keep their names, whatever they
    are. The same files and seed give the same result; a frame that isn't a plain scan of files is written to the
    shared folder first, because all passes must see the same partitions. The matrix has a row a partition and a column
    a shard. It is drawn in two levels (groups of partitions, then the partitions of each group), so no task draws
    more than ``group_parts`` rows of it. Bins hold about ``rows_per_bin`` rows; their table grows in proportion.
    """
    docs = docs.drop("shard", "slot")
    if not _is_scan(docs):
        docs = saved(docs, "shard-input")
    part = F.spark_partition_id().cast("long")
    sizes = saved(docs.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n")), "shard-parts")
    total, parts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    if not total:
        return docs.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    of_shard = [total // shards + (s < total % shards) for s in range(shards)]
    groups = -(-parts // group_parts)
    in_group = sizes.withColumn("group", F.pmod(F.col("part"), F.lit(groups)))
    ordered = lambda df, key, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("part"), "n"))).alias("parts"))
    top = ordered(in_group.groupBy("group").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), "all", "group").withColumn("cells", F.lit(of_shard).cast("array<long>"))
    top = matrix(top, "all", seed * 3 + 1).select(F.col("part").alias("group"), F.col("sends").alias("cells"))
    sends = matrix(ordered(in_group, "group", "part").join(top, "group"), "group", seed * 3 + 2)
    running = F.aggregate("sends", F.array().cast("array<long>"), lambda a, c: F.concat(a, F.array(c + F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)))))
    ends = small(saved(sends.select("part", running.alias("ends")), "shard-matrix"), 8 * shards + 32)
    bins = max(1, -(-of_shard[0] // rows_per_bin))

    def dealt(row: list[Column]) -> DataFrame:
        """own (the row's number in the input), shard, key (random within the shard) and bin of every row, beside ``row``."""
        numbered = docs.select(F.monotonically_increasing_id().alias("own"), *row)
        local = numbered.withColumns({"part": F.shiftright("own", 33), "local": F.xxhash64(F.lit(seed * 3), "own")}).sortWithinPartitions("local", "own")
        rank = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33))
        placed = local.withColumn("rank", rank).join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
        key = F.xxhash64(F.lit(seed * 3 + 1), "own")
        return placed.select("own", *[c for c in ("row",) if row], "shard", key.alias("key")).withColumn("bin", F.floor(F.shiftrightunsigned("key", 11).cast("double") / float(1 << 53) * bins).cast("long"))

    counts = dealt([]).groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    first = saved(counts.select(F.col("shard").alias("s"), F.col("bin").alias("b"), F.coalesce(before, F.lit(0)).alias("first")), "shard-bins")
    again = Window.partitionBy("shard", "bin").orderBy(F.shiftrightunsigned("key", 11), "own")
    rows = dealt([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]).withColumn("at", F.row_number().over(again) - 1)
    placed = rows.join(small(first, 32), (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("b")))
    return placed.select("row.*", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))
