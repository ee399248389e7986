"""Mixing sources to target weights (operator 6).

Tokens are aggregated per source; each source's target gives its repetition rate; each document is emitted
floor(rate) times, plus one copy drawn by a hash-seeded Bernoulli trial with the rate's fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_RE, saved, small

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_RE)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: one row per source, in words.

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all words. No target
    is above ``most`` times its source's size: with the sources in order of most * size / weight, those before some
    place stop there and the rest share what is left by weight, which is where repeated resharing ends.
    """
    sizes = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    # From here on there is one row per source: windows without a partition see the sources, of which one task takes some millions, not the documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, all_of = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_of) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(after)
    sizes = sizes.withColumn("_level", level)
    free = F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * most, F.col("_level"))
    sizes = sizes.withColumn("_free", F.max(free).over(all_of))
    stop = F.col("source_size") * most
    return sizes.select("source", "source_size", F.when(F.col("_free") * F.col("weight") <= stop, F.col("_free") * F.col("weight")).otherwise(stop).cast("double").alias("target"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_copies(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target and copies (how often the mix takes the row, 0 at least).

    Null texts have size 0; null is a source of its own; sources without words have rate 0. The draw depends on doc_id
    and text: rows with null ids or with one id draw by their texts, and only rows equal in both share a draw. The
    table of sources is broadcast only if its counted size is small.
    """
    by = saved(targets(docs.select("source", "text"), weights, share, most), "mix-targets")
    by = small(by.select(F.col("source").alias("of"), "source_size", "target"), 200)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("sum"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (uniform(seed, F.col("row.doc_id"), F.col("sum")) < rate - F.floor(rate)).cast("long")
    return row.join(by, F.col("row.source").eqNullSafe(F.col("of")), "left").select("row", "size", "source_size", "target", (F.floor(rate) + extra).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, with the columns of ``docs``."""
    return with_copies(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
