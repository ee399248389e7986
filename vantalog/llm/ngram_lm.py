"""Language-model scoring with an Elias-Fano n-gram trie (operator 9).

All texts are cut into chunks of documents. Each chunk asks for its distinct n-grams and tells how often its training
documents have them; Spark shuffles these lists to shards by n-gram. A shard adds the counts up, builds its part of
the trie (levels in Elias-Fano code: contexts, which are n-grams of one order, pointers to each one's successors, which
make those of the next, successors relative to their context, quantised log probabilities of the corpus), maps it into
memory and answers every chunk. Each chunk then smooths what it was told and scores its texts. Orders beyond the second
go round one at a time, and a round's lists are deleted when it is answered: no two rounds' lists are on disk together.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, saved, shuffles_dropped, spaced_words, texts

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 254


class EliasFano:
    """A monotone sequence: the low bits of each number packed, the high bits in unary. Decodes by place, for many places at once."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low = n, low_bits, low
        self.ones = np.flatnonzero(np.unpackbits(high, bitorder="little")).astype(np.int64)  # select

    @staticmethod
    def coded(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """n, low bits, packed low bits and unary high bits of sorted uint64 ``values``."""
        n = len(values)
        if not n:
            return 0, 0, np.zeros(8, np.uint8), np.zeros(0, np.uint8)
        bits = min(56, max(0, int(int(values[-1]) // n).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1, np.uint8)
        unary[high] = 1
        packed = []
        for at in range(0, n, 1 << 16):  # 8 numbers fill whole bytes, so blocks join without gaps
            part = values[at : at + (1 << 16)]
            packed.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        return n, bits, np.concatenate([*packed, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little")

    def at(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        base = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for b in range((self.bits + 7 + 7) // 8):
            word |= self.low[base + b].astype(np.uint64) << np.uint64(8 * b)
        low = (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        return (self.ones[i] - i).astype(np.uint64) << np.uint64(self.bits) | low

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """For each of the sorted wanted numbers the first place that holds it or more. Blocks of the sequence are decoded one after the other, each searched for the numbers that fall into it."""
        out = np.zeros(len(wanted), np.int64)
        for at in range(0, self.n, 1 << 18):
            block = self.at(np.arange(at, min(self.n, at + (1 << 18))))
            lo, hi = np.searchsorted(wanted, block[[0, -1]], "right")
            out[lo:hi] = at + np.searchsorted(block, wanted[lo:hi])
            out[hi:] = at + len(block)
        return out


class Level:
    """One level of a shard's trie, over a file that is mapped into memory."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, values: np.ndarray):
        """``contexts`` and ``words``: hashes of both parts of each n-gram, sorted by context, then word. ``values``: what to find there."""
        context, first = np.unique(contexts, return_index=True)
        pointers = np.append(first, len(contexts)).astype(np.uint64)
        rank = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(pointers.astype(np.int64)))
        relative = rank << np.uint64(32) | words.astype(np.uint64)
        parts, head = [], []
        for coded in (EliasFano.coded(context), EliasFano.coded(pointers), EliasFano.coded(relative)):
            head.append((coded[0], coded[1], len(coded[2]), len(coded[3])))
            parts += coded[2:]
        file, name = tempfile.mkstemp()
        try:
            with os.fdopen(file, "wb") as out:
                for p in (*parts, values):
                    out.write(p.tobytes())
            mapped = np.memmap(name, np.uint8, "r") if os.path.getsize(name) else np.zeros(0, np.uint8)
        finally:
            os.unlink(name)  # the mapping keeps the file until it is dropped
        at, made = 0, []
        for n, bits, low, high in head:
            made.append(EliasFano(n, bits, mapped[at : at + low], mapped[at + low : at + low + high]))
            at += low + high
        self.context, self.pointers, self.words = made
        self.values = mapped[at:].view(values.dtype)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The values of n-grams, sorted by context, then word; 0 where one is missing. A context's place points to its successors, among which the word is searched for."""
        out = np.zeros(len(contexts), self.values.dtype)
        if not len(contexts) or not self.context.n:
            return out
        rank = self.context.successor(contexts)
        ask = np.flatnonzero(rank < self.context.n)
        ask = ask[self.context.at(rank[ask]) == contexts[ask]]
        r = rank[ask]
        lo, hi = self.pointers.at(r).astype(np.int64), self.pointers.at(r + 1).astype(np.int64)
        wanted = r.astype(np.uint64) << np.uint64(32) | words[ask].astype(np.uint64)
        place = self.words.successor(wanted)
        good = (place >= lo) & (place < hi)
        good[good] = self.words.at(place[good]) == wanted[good]
        out[ask[good]] = self.values[place[good]]
        return out


def quantise(counts: np.ndarray, top: float) -> np.ndarray:
    """8 bits for log10(count / N), evenly from log10(1 / N) = -top up to 0; 0 stays free for unseen."""
    step = max(top, 1.0) / _STEPS
    return (1 + np.minimum(_STEPS, np.rint(np.log10(np.maximum(counts, 1)) / step))).astype(np.uint8)


def dequantise(codes: np.ndarray, top: float) -> np.ndarray:
    """Counts again, 0 for unseen."""
    step = max(top, 1.0) / _STEPS
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) * step), 0.0)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of the same rank side by side, so that those of sorted differences and small counts compress."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * np.dtype(kind).itemsize), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def _chunks(most_bytes: int):
    """Runs of documents as numbered words: the distinct words' hashes, sorted, and each token's place among them; every document closes with an end."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, hashes = TaskContext.get().partitionId(), 0, WordHashes(200_000)
        ids, train, own, size = [], [], [], 0

        def out():
            words, tokens = np.unique(np.concatenate(own), return_inverse=True)
            columns = {"chunk": (part << 32) + seq, "ids": ids, "train": train, "sizes": [len(o) for o in own], "kinds": len(words), "words": _pack(np.diff(words, prepend=np.uint64(0))), "tokens": _pack(tokens.astype(np.uint32))}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns))

        for batch in batches(rows, 2 << 20):
            for doc, text, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if own and size + len(text or b"") > most_bytes:
                    yield out()
                    seq += 1
                    ids, train, own, size = [], [], [], 0
                ids.append(doc), train.append(t), own.append(np.append(hashes.of(spaced_words(text)), END))
                size += len(text or b"")
        if own:
            yield out()

    return cut


_CHUNK = "chunk long, ids array<long>, train array<boolean>, sizes array<long>, kinds long, words binary, tokens binary"


def _rounds(order: int) -> list[range]:
    """The levels (order less one) that are asked together."""
    return [range(min(2, order)), *(range(n, n + 1) for n in range(2, order))]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ b >> np.uint64(32)) * _MIX + b
        h = (h ^ h >> np.uint64(29)) * _MIX
        return h ^ h >> np.uint64(32)


def _grams(row: dict, levels: range, buckets: int):
    """Per level the distinct n-grams of a chunk (48 bits of the context's hash and 32 of the word's; at the first level all 64 of the word's), ordered by bucket and context, where each bucket's begin, and each token's place among them; and the number of tokens and the training mark of each document.

    Inside a chunk n-grams are told apart by the numbers of their context and word, so only distinct ones are hashed.
    """
    lengths = np.array(row["sizes"])
    words = np.cumsum(_unpack(row["words"], row["kinds"], np.uint64), dtype=np.uint64)
    tokens = _unpack(row["tokens"], int(lengths.sum()), np.uint32).astype(np.int64)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lengths) - lengths] = True
    whole, back, out = words, tokens, []
    for n in range(levels.stop):
        context, word = words, np.zeros(len(words), np.uint32)
        if n:
            of = np.where(first, len(whole), np.concatenate([[0], back[:-1]]))
            pairs, back = np.unique(of * len(words) + tokens, return_inverse=True)
            own, hashes = words[pairs % len(words)], np.append(whole, BEGIN + np.uint64(n))[pairs // len(words)]
            whole = _mixed(hashes, own)
            context, word = hashes >> np.uint64(16), (own >> np.uint64(32)).astype(np.uint32)
        if n in levels:
            bucket = ((whole >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((context, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            out.append((context[order], word[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[back]))
    return out, lengths, np.repeat(np.array(row["train"], bool), lengths)


def _ask(levels: range, buckets: int):
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                grams, _, train = _grams(row, levels, buckets)
                counts = [np.bincount(back, train, len(context)).astype(np.uint32) for context, _, _, back in grams]
                made = []
                for b in range(buckets):
                    spans = [slice(ends[b], ends[b + 1]) for _, _, ends, _ in grams]
                    if any(s.start < s.stop for s in spans):  # so there are never more messages than n-grams
                        own = list(zip(grams, counts, spans, strict=True))
                        made.append((b, row["chunk"], [s.stop - s.start for s in spans], [_pack(np.diff(g[0][s], prepend=np.uint64(0))) for g, _, s in own], [_pack(g[1][s]) for g, _, s in own], [_pack(c[s]) for _, c, s in own]))
                kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["bucket", "chunk", "sizes", "contexts", "words", "counts"])

    return ask


_ASKED = "bucket int, chunk long, sizes array<long>, contexts array<binary>, words array<binary>, counts array<binary>"
_TOLD = "chunk long, bucket int, level int, tokens long, kinds long, told array<binary>"


def _answer(levels: range, top: float):
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told: list[list[bytes]] = [[] for _ in rows]
        tokens = kinds = 0
        for at, n in enumerate(levels):
            sizes = [r["sizes"][at] for r in rows]
            context = np.concatenate([np.cumsum(_unpack(r["contexts"][at], m, np.uint64), dtype=np.uint64) for r, m in zip(rows, sizes, strict=True)])
            word = np.concatenate([_unpack(r["words"][at], m, np.uint32) for r, m in zip(rows, sizes, strict=True)])
            counts = np.concatenate([_unpack(r["counts"][at], m, np.uint32) for r, m in zip(rows, sizes, strict=True)])
            # every n-gram is looked up once, however many chunks ask for it
            contexts, rank = np.unique(context, return_inverse=True)
            wanted, back = np.unique(rank.astype(np.uint64) << np.uint64(32) | word, return_inverse=True)
            contexts, words = contexts[(wanted >> np.uint64(32)).astype(np.int64)], wanted.astype(np.uint32)
            sums = np.bincount(back, counts, len(wanted)).astype(np.int64)
            known = sums > 0
            if n == 0:
                tokens, kinds = int(sums.sum()), int(known.sum())
            level = Level(contexts[known], words[known], sums[known] if n == 0 else quantise(sums[known], top))
            values, ends = level.find(contexts, words), np.cumsum([0, *sizes])
            for i in range(len(rows)):
                told[i].append(_pack(values[back[ends[i] : ends[i + 1]]]))
        return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "level": pa.array([levels.start] * len(rows), pa.int32()), "tokens": pa.array([tokens * (i == 0) for i in range(len(rows))], pa.int64()), "kinds": pa.array([kinds * (i == 0) for i in range(len(rows))], pa.int64()), "told": pa.array(told, pa.list_(pa.binary()))})

    return answer


def _score(order: int, buckets: int, tokens: int, kinds: int, top: float, mass: float):
    def score(chunk: pa.Table, told: pa.Table) -> pa.Table:
        cols: dict[str, list] = {c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")}
        answers = {(r["level"] + i, r["bucket"]): own for r in told.to_pylist() for i, own in enumerate(r["told"])}
        for row in chunk.to_pylist():
            grams, lengths, _ = _grams(row, range(order), buckets)
            found = []
            for n, (_, _, ends, back) in enumerate(grams):
                sizes = np.diff(ends)
                own = np.concatenate([_unpack(answers[n, b], int(sizes[b]), np.int64 if n == 0 else np.uint8) for b in np.flatnonzero(sizes).tolist()])
                found.append(own[back])
            ends = np.cumsum(lengths)
            per_doc = lambda x, e=ends: np.add.reduceat(x, e - lengths)  # noqa: E731, B023
            c = found[0].astype(np.float64)
            lower = (c + 1.0) / (tokens + 1.0 * (kinds + 1))
            base = per_doc(np.log10(lower))
            begins = np.zeros(len(c), bool)
            begins[ends - lengths] = True
            ends_seen = float(found[0][ends[0] - 1])  # training texts: each has one end
            seen = np.where(begins, ends_seen, np.concatenate([[0.0], c[:-1]]))
            for n in range(1, order):
                count = dequantise(found[n], top)
                whole = np.maximum(seen, count)
                lower = (count + mass * lower) / (whole + mass)
                seen = np.concatenate([[0.0], count[:-1]])
                seen[begins] = ends_seen
            cols["doc_id"] += row["ids"]
            cols["train"] += row["train"]
            cols["n_tokens"] += lengths.tolist()
            cols["n_known"] += per_doc((found[0] > 0).astype(np.int64)).tolist()
            cols["base_score"] += base.tolist()
            cols["score"] += per_doc(np.log10(lower)).tolist()
        kinds_of = {"doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds_of[c]) for c, v in cols.items()})

    return score


def score(docs: DataFrame, held_out: Column, order: int = 3, mass: float = 8.0, chunk_bytes: int = 3 << 20, bucket_tokens: int = 3 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    The model learns from all whole texts for which ``held_out`` is false, of which null ids are. Tokens are the words
    between white space with A-Z lower-cased, and one end a text; null texts count as empty. ``base_score`` is the sum
    of log10((c + 1) / (N + V + 1)). ``score`` interpolates: each order's count, with ``mass`` counts spread as the
    order below has it, over the context's count and ``mass`` (Dirichlet smoothing). Words are told apart by 64-bit
    hashes, longer n-grams by 48 bits of their context's and 32 of their word's, which differ for all but a few in a
    thousand of unseen n-grams at a trillion contexts. Chunks send a message to each shard that has one of their
    n-grams, so there are fewer messages than n-grams. Without any training text, N and V are 0.
    """
    rows = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    chunks = saved(rows.mapInArrow(_chunks(chunk_bytes), _CHUNK), "lm-chunks")
    tokens_all = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()[0]
    if not tokens_all:
        return rows.limit(0).selectExpr("doc_id", "not train held_out", "0L n_tokens", "0L n_known", "0L train_tokens", "0D base_score", "0D score")
    buckets = max(48, -(-int(tokens_all) // bucket_tokens))
    top = float(np.log10(max(10, tokens_all)))  # at least log10 of any count
    told = None
    for levels in _rounds(order):
        asked = chunks.mapInArrow(_ask(levels, buckets), _ASKED)
        with shuffles_dropped(docs.sparkSession):
            part = saved(asked.groupBy("bucket").applyInArrow(_answer(levels, top), _TOLD), "lm-told")
        told = part if told is None else told.unionByName(part)
    tokens, kinds = told.agg(F.sum("tokens"), F.sum("kinds")).first()
    found = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(order, buckets, int(tokens), int(kinds), top, mass), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
