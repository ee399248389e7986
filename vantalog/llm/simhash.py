"""SimHash near-duplicates with pigeonring filtering (operator 7).

Fingerprints are cut into a ring of 8 segments of 8 bits. With at most 2 differing bits in all, some segment starts a
chain whose running sums of differences never exceed their share of the budget (length * 2 / 8): its first three
segments agree, the next four add up to one bit at most. So fingerprints meet by 24 agreeing bits, and the chain is
checked before the full Hamming distance. Crowded meeting points are split by further agreeing bits instead of paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, doc_key, forget, saved, spaced_words, texts

BITS, SEGMENTS, WIDTH, DISTANCE = 64, 8, 8, 2
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 bits: each is 1 if set in over half of the shingles' XXH64. Texts shorter than a shingle are one shingle, those without words 0."""
    words = spaced_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    stops = (ends[shingle - 1 :] - 1).tolist()
    for at in range(0, n, 65536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)), "<u8", min(65536, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        prints = np.array([fingerprint(t) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(prints)], ["doc_id", "doc_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key (hash of the text), fp (the 64 bits as a signed long), a row per row of ``docs``."""
    return docs.select("doc_id", "text", doc_key(F.col("text"))).mapInArrow(_rows, "doc_id long, doc_key long, fp long")


def _segment_bits(x: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(x, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1)))


def _chain(x: Column, start: int) -> Column:
    """Whether the chain of all lengths that starts at a segment of the difference ``x`` stays within its proportional budgets."""
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        total = total + _segment_bits(x, start + length - 1)
        ok = ok & (total <= length * DISTANCE // SEGMENTS)
    return ok


#: Leading segments whose budget is 0: the part of the chain on which fingerprints meet.
_AGREE = max(n for n in range(1, SEGMENTS) if n * DISTANCE // SEGMENTS == 0)


def _mask(start: int) -> int:
    bits = 0
    for i in range(_AGREE):
        bits |= ((1 << WIDTH) - 1) << WIDTH * ((start + i) % SEGMENTS)
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame, crowd: int = 256) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that are at most ``DISTANCE`` bits apart.

    Where at most ``crowd`` fingerprints share an agreeing part, all pairs are checked and each link comes once. Where
    more do, the pairs would grow with their square: there each fingerprint is filed under every way to blank two of
    the remaining bits, and linked to the smallest in the same file; two are in one file exactly if they differ in
    those bits only, so the same fingerprints are connected.
    """
    prints = saved(prints.select("fp").distinct(), "simhash-prints")
    tables = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(i))).alias("key")) for i in range(SEGMENTS)])
    filed = prints.select("fp", F.inline(tables))
    counts = saved(filed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
    met = filed.join(counts, ["start", "key"])
    few = met.where(F.col("n") <= crowd).drop("n")
    x = F.col("a").bitwiseXOR(F.col("b"))
    chains = [_chain(x, i) for i in range(SEGMENTS)]
    first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(chains)])  # a pair that several chains let through comes from the first
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    pairs = left.join(right, (left["start"] == right["start"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (first == left["start"]) & (F.bit_count(x) <= DISTANCE)).select("a", "b")
    if counts.where(F.col("n") > crowd).isEmpty():
        return pairs
    many = met.where(F.col("n") > crowd).drop("n")
    blanks = [(s, _blank(s, i, j)) for s in range(SEGMENTS) for i in range(BITS - _AGREE * WIDTH) for j in range(i)]
    by_start = F.create_map(*[v for s in range(SEGMENTS) for v in (F.lit(s), F.lit([b for t, b in blanks if t == s]).cast("array<long>"))])
    blanked = many.select("fp", F.explode(F.element_at(by_start, F.col("start"))).alias("blank")).withColumn("key", F.col("fp").bitwiseAND(F.col("blank")))
    least = blanked.groupBy("blank", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = blanked.join(least, ["blank", "key"]).where("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _blank(start: int, i: int, j: int) -> int:
    free = [WIDTH * ((start + s) % SEGMENTS) + b for s in range(_AGREE, SEGMENTS) for b in range(WIDTH)]
    bits = (1 << 64) - 1 & ~(1 << free[i]) & ~(1 << free[j])
    return bits - (1 << 64) if bits >> 63 else bits


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that the edges (a, b) connect it with, for every node of an edge.

    Rounds of large stars (neighbours above a node join its smallest neighbour) and small stars (those below do) until
    nothing changes; each round is a written table. Minima are aggregated, so no node's neighbours meet in one task.
    """
    edges = saved(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("u")).agg(F.least(F.min("hi"), F.first("lo")).alias("m"))
        large = both.where("hi > lo").join(least, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct()
        large = saved(large.where("lo < hi"), "components")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        both = large.join(least, F.col("hi") == F.col("u"))
        after = both.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(both.select(F.col("m").alias("lo"), "hi")).where("lo < hi").distinct()
        after = saved(after, "components")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        forget(edges), forget(large)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: no end after the most rounds allowed")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def _grouped(rows: DataFrame, crowd: int) -> DataFrame:
    """``rows`` (with fp) and group: the smallest fingerprint that the links connect theirs with."""
    labels = saved(components(links(rows, crowd)), "simhash-labels")
    return rows.join(labels, rows["fp"] == labels["node"], "left").withColumn("group", F.coalesce("label", "fp")).drop("node", "label")


def near_duplicates(docs: DataFrame, crowd: int = 256) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, the document's own included), a row per row of ``docs``.

    Equal fingerprints always link; those of texts without words (null and empty ones too) are 0. Repeated rows each
    get their row. Rows with null doc_id take part but give no component its id; a component of only such rows has
    null. An empty table gives an empty result.
    """
    rows = saved(fingerprints(docs), "simhash-docs")
    prints = saved(_grouped(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), crowd), "simhash-groups")
    ids = prints.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component_id"))
    every = prints.join(ids, F.col("group") == F.col("g")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(every, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, crowd: int = 256) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), of several texts of that id the one with the smallest hash, of rows equal in both any one."""
    rows = saved(fingerprints(docs), "simhash-docs")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "doc_key")
    of_print = rows.groupBy("fp").agg(F.min(name).alias("name"))
    chosen = _grouped(of_print, crowd).groupBy("group").agg(F.min("name").alias("name"))
    chosen = saved(chosen.select(F.col("name.doc_id").alias("id"), F.col("name.doc_key").alias("key")), "simhash-kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.col("text")).alias("of"))
    kept = keyed.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("key")), "left_semi")
    repeated = rows.groupBy("doc_id", "doc_key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.select("row", F.col("row.doc_id").alias("id"), "of").dropDuplicates(["id", "of"])
    return kept.select("row.*")
