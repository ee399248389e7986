"""Substring dedup by content-defined chunking (operator 2).

A gear rolling hash over 16 bytes is taken at the end of each word; chunks end where it is the smallest of some
``span`` neighbouring words, so an insertion moves only the chunks around it and every long enough passage holds a whole
chunk wherever it stands. Chunks are deduplicated by digest in Spark; only around chunks that several documents hold
the windows of 50 words are compared, which gives the repeats word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, batches, doc_key, forget, saved, shuffles_dropped, small, texts

#: Bytes that the hash sees, and the most words of a passage whose ends see bytes before it.
WINDOW = 16
LEAD = WINDOW // 2
#: Words of which the one with the smallest hash ends a chunk; chunks have (SPAN + 1) / 2 words on average, SPAN at most.
SPAN = 16
_CHUNK = "digest long, doc_id long, doc_key long, a int, b int, again boolean"
_GRAM = "digest long, doc_id long, doc_key long, at int, start int, stop int, again boolean"
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)

#: Tasks that the rows of a crowded digest go to.
_SALTS = 64


def gear_table() -> np.ndarray:
    """16 random bits a byte, from a digest of the byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def rolled(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte."""
    own = gear[data]
    h = own.copy()
    for j in range(1, WINDOW):
        h[j:] += own[:-j] << np.uint16(j)
    return h


def smallest(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` neighbours, by doubling."""
    width = 1
    while width * 2 <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])


def chunk(texts_: list[bytes | None], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """For all texts at once: text's index, first word and word after the last (within the text), digest of the words joined by one blank."""
    pad = b" " * WINDOW
    plain = [b" ".join(t.split()) if t else b"" for t in texts_]
    raw = pad + pad.join(plain) + pad
    data = np.frombuffer(raw, np.uint8)
    blank = data == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(ends):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sizes = np.array([len(t) for t in plain]) + WINDOW
    text = np.searchsorted(np.cumsum(sizes) + WINDOW, starts, "right")
    # Words by place; places without a word stand between texts and have the largest hash.
    place = np.arange(len(ends)) + (text + 1) * span
    keys = np.full(place[-1] + span + 1, 0xFFFF << 32 | 0xFFFFFFFF, np.uint64)
    keys[place] = rolled(data, gear_table())[ends].astype(np.uint64) << np.uint64(32)
    keys[place] |= np.arange(len(ends), dtype=np.uint64)
    least = np.unique(smallest(keys, span) & np.uint64(0xFFFFFFFF))
    last = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    cut = np.unique(np.concatenate([least[least < len(ends)].astype(np.int64), last]))
    first = np.concatenate([[0], cut[:-1] + 1])
    begin = np.searchsorted(text, text[cut])
    digest = xxhash.xxh64_intdigest
    digests = np.fromiter((digest(raw[a : b + 1]) for a, b in zip(starts[first].tolist(), ends[cut].tolist(), strict=True)), np.uint64, len(cut)).view(np.int64)
    return text[cut], first - begin, cut + 1 - begin, digests


def _seen_before(text: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether the same text has the digest further up."""
    order = np.lexsort((digest, text))
    same = (text[order][1:] == text[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    again = np.zeros(len(text), bool)
    again[order[1:][same]] = True
    return again


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _chunker(span: int):
    def rows_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 6 << 20):
            docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            text, a, b, digest = chunk(texts(batch.column(1)), span)
            if len(text):
                own = [digest, docs[text].astype(np.int64), keys[text], a.astype(np.int32), b.astype(np.int32), _seen_before(text, digest)]
                yield _batch(["digest", "doc_id", "doc_key", "a", "b", "again"], own)

    return rows_of


def chunks(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """All chunks of all whole texts: digest, doc_id, doc_key (hash of the text), a and b (first word, word after the last), and whether the text had the chunk before. Null ids and null or empty texts have none."""
    return docs.select("doc_id", "text", doc_key(F.col("text"))).where("doc_id is not null").mapInArrow(_chunker(span), _CHUNK)


def regions(spans: list[tuple[int, int]], n_words: int, least_words: int, span: int) -> list[tuple[int, int]]:
    """Where repeats of ``least_words`` can lie, from the chunks that other documents hold too: runs of them, widened by the words whose chunks may differ."""
    found: list[list[int]] = []
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for a, b in runs:
        if b - a >= least_words - 2 * span - LEAD + 1:
            a, b = max(0, a - LEAD - span), min(n_words, b + span - 1)
            if found and found[-1][1] >= a:
                found[-1][1] = b
            else:
                found.append([a, b])
    return [(a, b) for a, b in found if b - a >= least_words]


def window_digests(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit digest of every ``size`` neighbouring words, from the words' hashes."""
    powers, back = np.full(len(hashes), _BASE, np.uint64), np.full(len(hashes), _UNBASE, np.uint64)
    powers[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers))])
    return ((sums[size:] - sums[:-size]) * np.cumprod(back)[: len(sums) - size]).view(np.int64)


def _windows(least_words: int, span: int):
    def rows_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        blanks = np.zeros(256, bool)
        blanks[[9, 10, 11, 12, 13, 32]] = True
        for batch in batches(rows, 2 << 20):
            for doc, key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                found = regions([(s["a"], s["b"]) for s in spans], len(words), least_words, span)
                if not found:
                    continue
                blank = np.concatenate([[True], blanks[np.frombuffer(text, np.uint8)], [True]])
                begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
                digest = np.concatenate([window_digests(hashes.of(words[a:b]), least_words) for a, b in found])
                at = np.concatenate([np.arange(a, b - least_words + 1) for a, b in found])
                again = _seen_before(np.zeros(len(at), np.int8), digest)
                own = [digest, np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32), begin[at].astype(np.int32), end[at + least_words - 1].astype(np.int32), again]
                yield _batch(["digest", "doc_id", "doc_key", "at", "start", "stop", "again"], own)

    return rows_of


def _held(rows: DataFrame, within: bool, crowd: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (digest, doc_id, again and more) whose digest several documents hold, or, if ``within``, one text twice; with first_doc_id, the smallest of them. Also the table of digests that they are joined to.

    Digests are aggregated before the shuffle; those of more than ``crowd`` rows are joined in several tasks each,
    their rows by document, their first holder sent to all.
    """
    twice = F.expr("first_doc_id < _last")
    found = [F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"), F.count("*").alias("n")]
    if within:
        found.append(F.max("again").alias("_again"))
        twice = twice | F.col("_again")
    else:
        rows = rows.drop("again")
    first = saved(rows.groupBy("digest").agg(*found).where(twice).select(F.col("digest").alias("of"), "first_doc_id", "n"), f"{name}-firsts")
    hot = first.where(F.col("n") > crowd).select(F.col("of").alias("hot"))
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).cast("int").alias("salt")
    spread = first.select("of", "first_doc_id", F.explode(F.when(F.col("n") > crowd, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("of_salt"))
    salted = rows.join(small(saved(hot, f"{name}-crowds"), 16), F.col("digest") == F.col("hot"), "left").select("*", salt)
    return salted.join(spread, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("of_salt"))).drop("hot", "salt", "of", "of_salt"), first


def repeats(docs: DataFrame, least_words: int = 50, within: bool = False, crowd: int = 2048) -> DataFrame:
    """doc_id, doc_key, start, n_bytes, n_words, first_doc_id: passages that earlier documents (smaller doc_id) hold, or, if ``within``, the text itself further up.

    Words stand between white space; what kind of it, and how much, makes no difference. A word is repeated if it lies in
    ``least_words`` (10 at least) consecutive words that an earlier document holds too, all such words are found and no
    others. Windows that overlap form one passage; ``first_doc_id`` is the smallest document that holds its first
    ``least_words`` words. Windows are told apart by 64-bit digests. Rows that share a doc_id count as one document
    that holds all their texts: what they share is no repeat, but each text has its own passages, told apart by
    ``doc_key``; rows equal in both have theirs once. Null ids and null, empty and shorter texts have none. Nothing is
    capped: a chunk in a third of all documents is aggregated before the shuffle, and digests with more than ``crowd``
    rows are joined in several tasks each.
    """
    if least_words < LEAD + 2:
        raise ValueError(f"passages of {LEAD + 2} words at least")
    span = min(SPAN, (least_words - LEAD) // 2)
    of_text = [F.col("doc_id").alias("of"), F.col("doc_key").alias("of_key")]
    # A step's tables and shuffles go when the next table is written.
    with shuffles_dropped(docs.sparkSession):
        own = saved(chunks(docs, span), "chunks")
        held, first = _held(own, within, crowd, "chunk")
        spans = saved(held.groupBy(*of_text).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "chunk-spans")
        forget(own), forget(first)
        near = docs.select("doc_id", doc_key(F.col("text")).alias("doc_key"), "text").join(spans, (F.col("doc_id") == F.col("of")) & (F.col("doc_key") == F.col("of_key")))
        grams = saved(near.select("doc_id", "doc_key", "text", "spans").mapInArrow(_windows(least_words, span), _GRAM), "chunk-windows")
        forget(spans)
        hits, first = _held(grams, within, crowd, "window")
        later = F.expr("doc_id > first_doc_id" + (" or again" if within else ""))
        hits = saved(hits.where(later).select("doc_id", "doc_key", "at", "start", "stop", "first_doc_id"), "chunk-hits")
        forget(grams), forget(first)
    hits = hits.repartition("doc_id", "doc_key").dropDuplicates(["doc_id", "doc_key", "at"])
    along = Window.partitionBy("doc_id", "doc_key").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(along) >= least_words, F.lit(True))
    runs = hits.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(along)).groupBy("doc_id", "doc_key", "run").agg(
        F.min("start").cast("long").alias("start"),
        (F.max("stop") - F.min("start")).cast("long").alias("n_bytes"),
        (F.max("at") - F.min("at") + least_words).cast("long").alias("n_words"),
        F.min_by("first_doc_id", "at").alias("first_doc_id"),
    )
    return runs.drop("run")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its repeats cut out of the texts; all rows stay, repeated ones too, and each is cut by the runs of its own text. Null ids and texts stay as they are. Cuts that split a character drop what is left of it."""
    spans = repeats(docs, **options).groupBy(F.col("doc_id").alias("of"), F.col("doc_key").alias("of_key")).agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.col("text")).alias("key"))
    joined = rows.join(spans, (F.col("row.doc_id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    raw = F.col("row.text").cast("binary")
    step = lambda s, x: F.struct(F.concat(s.kept, F.substring(raw, (s.at + 1).cast("int"), (x.start - s.at).cast("int"))).alias("kept"), (x.start + x.n_bytes).alias("at"))
    rest = lambda s: F.concat(s.kept, F.substring(raw, (s.at + 1).cast("int"), F.octet_length(raw)))
    cut = F.aggregate("spans", F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("at")), step, rest)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�", ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
