"""Benchmark decontamination with suffix arrays over the training texts (operator 8).

The texts of each shard (a bounded run of documents) become one suffix array over their words' hashes. Every suffix of
every benchmark item is binary-searched in every shard, word by word, as far as its first window: the range that is left
holds all places of the window. A range is taken once, however many item suffixes lead to it, and marks words and items
by place, so no pair of an item's place and a text's is ever made. ``locate`` follows each place to the longest verbatim
match, which the nearest item suffixes in one order of both sides' suffixes give.
"""

from collections.abc import Iterator
from itertools import product
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words, batches, texts

WINDOW = 10
#: Bytes of text that a shard holds.
SHARD_BYTES = 8 << 20
#: spans are word ranges [first, end), merged.
_FOUND = "doc_id long, n_words long, spans array<struct<first:long,end:long>>, items array<long>"
#: A match is as long as text and item agree: its item, its first word in text and item, its words.
_LOCATED = "doc_id long, longest long, matches array<struct<item:long,first:long,start:long,words:long>>"


class Items:
    """A block of benchmark items: their words' hashes one item after the other, and the suffixes to search for."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        hashes, own = WordHashes(), []
        self.ids: list[int | None] = []
        for item, text in items:
            if words := alnum_words(text):
                self.ids.append(item)
                own.append(hashes.of(words))
        sizes = np.array([len(o) for o in own], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *own])
        self.item = np.repeat(np.arange(len(own)), sizes)
        self.first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # where the word's item begins
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.words))
        #: Words that make a window of the item: all of them if it is shorter.
        self.window = np.minimum(window, np.repeat(sizes, sizes))
        self.suffixes = np.flatnonzero(self.left >= self.window)


class Shard:
    """The suffix array of a run of texts. A separator no word has stands behind each text, so no match runs into the next."""

    def __init__(self, texts_: list[bytes | None], hashes: WordHashes):
        own = [hashes.of(alnum_words(t)) for t in texts_]
        self.sizes = np.array([len(o) for o in own], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.zeros(int(self.sizes.sum()) + len(own), np.uint64)  # 0: the separator
        for at, words in zip(self.begins.tolist(), own, strict=True):
            self.words[at : at + len(words)] = words
        self.suffixes = suffix_array(self.words)

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranges of suffixes that agree in their first ``depth`` words: the part whose next word is the wanted one."""
        ends = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            live = np.flatnonzero(a < b)
            while len(live):
                mid = (a[live] + b[live]) >> 1
                at = self.suffixes[mid] + depth[live]
                word = np.where(at < len(self.words), self.words[np.minimum(at, len(self.words) - 1)], 0)
                below = word <= wanted[live] if right else word < wanted[live]
                a[live[below]] = mid[below] + 1
                b[live[~below]] = mid[~below]
                live = live[a[live] < b[live]]
            ends.append(a)
        return ends[0], ends[1]

    def ranges(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ranges of suffixes that start with a window, each once: start, end and words; and the range of every suffix of the items that has one, with its item."""
        live = items.suffixes
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.suffixes))
        done = [np.zeros((4, 0), np.int64)]
        for depth in range(int(items.window.max(initial=0))):
            lo, hi = self.narrowed(lo, hi, np.full(len(live), depth), items.words[live + depth])
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
            whole = items.window[live] == depth + 1
            done.append(np.stack([lo[whole], hi[whole], np.full(int(whole.sum()), depth + 1), items.item[live[whole]]]))
            live, lo, hi = live[~whole], lo[~whole], hi[~whole]
        found = np.concatenate(done, 1)
        each, of = np.unique(found[:3], axis=1, return_inverse=True)
        return each[0], each[1], each[2], np.stack([of.reshape(-1), found[3]])

    def mark(self, items: Items, hit: np.ndarray, ids: list[set]) -> None:
        """Marks the words that lie inside a window in ``hit``, and adds each text's items to ``ids``.

        Texts meet sets of items, not items: ranges of equal sets count as one.
        """
        lo, hi, words, asked = self.ranges(items)
        counts = hi - lo
        of = np.repeat(np.arange(len(lo)), counts)
        place = self.suffixes[np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(len(of))]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + words[of], -1)
        hit |= np.cumsum(edge[:-1]) > 0
        asked = np.unique(asked, axis=1)
        cuts = np.searchsorted(asked[0], np.arange(len(lo) + 1))
        sets: dict[bytes, int] = {}
        named = np.array([sets.setdefault(asked[1, i:j].tobytes(), len(sets)) for i, j in zip(cuts, cuts[1:], strict=False)], np.int64)
        members = [np.frombuffer(s, np.int64).tolist() for s in sets]
        met = np.unique((np.searchsorted(self.begins, place, "right") - 1) * max(len(sets), 1) + named[of]) if len(place) else place
        for doc, own in zip((met // max(len(sets), 1)).tolist(), (met % max(len(sets), 1)).tolist(), strict=True):
            ids[doc].update(items.ids[i] for i in members[own])


def suffix_array(words: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """The places of all suffixes in order, by doubling: suffixes ranked by their first n words are ranked by 2 n; those already alone stay. ``levels`` gets the ranks by the first 1, 2, 4... words."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], words[order][1:] != words[order][:-1]])[:n]
    rank[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    # Rank: where the suffix's group begins. Groups of more than one are sorted by the rank that stands ``step`` further on.
    step = 1
    group = np.flatnonzero(~(starts & np.append(starts[1:], True)[:n]))
    while len(group):
        if levels is not None:
            levels.append(rank.astype(np.int32))
        own = order[group]
        ahead = own + step
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        again = np.argsort(rank[own] * (n + 1) + following + 1, kind="stable")
        own, following = own[again], following[again]
        order[group] = own
        old = rank[own]
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (following[1:] != following[:-1])])
        rank[own] = group[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.append(new[1:], True)
        group = group[~alone]
        step *= 2
    return order


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` have in common, from the ranks of ``suffix_array``."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        left, right = a + out, b + out
        inside = (left < len(levels[k])) & (right < len(levels[k]))
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        out[same] += 1 << k
    return out


def _located(shard: Shard, blocks: list[Broadcast]) -> tuple[list[int], list[list[dict]]]:
    """Each text's longest match, and one match for each place at which none of the word before goes on: the longest that starts there."""
    left = np.repeat(shard.begins + shard.sizes, shard.sizes + 1) - np.arange(len(shard.words))
    best, at, whose = np.zeros(len(shard.words), np.int64), np.zeros(len(shard.words), np.int64), np.zeros(len(shard.words), np.int64)
    names: list[int | None] = []
    for block in blocks:
        items, levels = SimpleNamespace(**block.value), []
        if not len(items.words):
            continue
        n = len(shard.words)
        order = suffix_array(np.concatenate([shard.words, [0], items.words]).astype(np.uint64), levels)
        place, rows = np.arange(len(order)), np.flatnonzero(order < n)
        window_of = np.zeros(len(order), np.int64)  # of the suffixes that begin a window; items of different window sizes each have nearest ones
        window_of[n + 1 + items.suffixes] = items.window[items.suffixes]
        window_of = window_of[order]
        for window, side in product(np.unique(window_of[window_of > 0]).tolist(), (1, -1)):
            near = np.where(window_of == window, place, -1 if side == 1 else len(order))[::side]
            near = (np.maximum if side == 1 else np.minimum).accumulate(near)[::side]
            inside = rows[(near[rows] >= 0) & (near[rows] < len(order))]
            own, other = order[inside], order[near[inside]] - n - 1
            size = np.minimum(common(levels, own, other + n + 1), np.minimum(left[own], items.left[other]))
            start = other - items.first[other]
            # A match counts if it holds a window of its item.
            better = (size >= items.window[other]) & (size > best[own])
            own, other, size, start = own[better], other[better], size[better], start[better]
            best[own], at[own], whose[own] = size, start, items.item[other] + len(names)
        names += items.ids
    goes_on = np.concatenate([[False], best[1:] == best[:-1] - 1]) & (best > 0)
    longest, out = [], []
    for begin, size in zip(shard.begins.tolist(), shard.sizes.tolist(), strict=True):
        own = begin + np.flatnonzero(best[begin : begin + size])
        longest.append(int(best[own].max(initial=0)))
        out.append([{"item": names[whose[p]], "first": int(p - begin), "start": int(at[p]), "words": int(best[p])} for p in own if not goes_on[p] or p == begin])
    return longest, out


def _found(shard: Shard, blocks: list[Broadcast]) -> tuple[np.ndarray, list[set]]:
    """The shard's words that lie inside windows, and each text's items. Blocks are held one at a time."""
    hit, ids = np.zeros(len(shard.words), bool), [set() for _ in shard.sizes]
    for block in blocks:
        shard.mark(SimpleNamespace(**block.value), hit, ids)
    return hit, ids


def _spans(shard: Shard, hit: np.ndarray) -> list[list[dict]]:
    """Each text's ranges of marked words."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out: list[list[dict]] = [[] for _ in shard.sizes]
    doc = np.searchsorted(shard.begins, turns[::2], "right") - 1  # separators are never marked, so no range leaves its text
    for d, first, end in zip(doc.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        begin = int(shard.begins[d])
        out[d].append({"first": first - begin, "end": end - begin})
    return out


def item_blocks(benchmark: DataFrame, window: int, most_bytes: int) -> list[Broadcast]:
    """The benchmark as broadcast blocks of at most ``most_bytes`` of text (or one item): the driver and a task hold one block of it at a time, whatever its size. Blocks are plain arrays, which workers read without this package."""
    context, blocks, own, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        own.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += len(own[-1][1] or b"")
        if size >= most_bytes:
            blocks.append(context.broadcast(vars(Items(own, window))))
            own, size = [], 0
    if own:
        blocks.append(context.broadcast(vars(Items(own, window))))
    return blocks


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (merged word ranges inside a window's occurrence), items (ids found, sorted).

    A window is ``window`` consecutive words of an item, or all words of a shorter one; items without words have none.
    Null and empty texts have no words. Items with null id count for spans only. Repeated rows each get their row; the
    same text in the benchmark under two ids counts for both. The documents are read once and don't move; the stated
    set of items meets each shard of them in blocks of ``most_bytes``. Words repeated on both sides cost no pairs.
    """
    blocks = item_blocks(benchmark, window, most_bytes)

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows, SHARD_BYTES):
            shard = Shard(texts(batch.column(1)), hashes)
            hit, ids = _found(shard, blocks)
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "end")]))
            columns = [pa.array(shard.sizes), pa.array(_spans(shard, hit), span), pa.array([sorted(own - {None}) for own in ids], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", "n_words", "spans", "items"])

    return docs.select("doc_id", "text").mapInArrow(search, _FOUND)


def locate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, longest (words of the longest verbatim match), matches.

    A match is as long as text and item agree and holds a window. Each place of a text gives the longest one that starts
    there, unless it is the rest of the one before; where several items have it, one of them stands for all. Shards are
    smaller than in ``find``, since the ranks of all lengths are kept. Edge cases as in ``find``.
    """
    blocks = item_blocks(benchmark, window, most_bytes)

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows, 2 << 20):
            longest, matches = _located(Shard(texts(batch.column(1)), hashes), blocks)
            match = pa.list_(pa.struct([(n, pa.int64()) for n in ("item", "first", "start", "words")]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(longest, pa.int64()), pa.array(matches, match)], ["doc_id", "longest", "matches"])

    return docs.select("doc_id", "text").mapInArrow(search, _LOCATED)


def hit_words(spans: str) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.first)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; columns and all other rows as they are. Each row is judged by its own text: rows of one id, or of none, stay or go by themselves."""
    blocks = item_blocks(benchmark, window, most_bytes)

    @F.pandas_udf("boolean")
    def affected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for part in parts:
            whole = pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["text"])
            out = []
            for batch in batches(iter([whole]), SHARD_BYTES):
                shard = Shard(batch.column(0).to_pylist(), hashes)
                seen = np.concatenate([[0], np.cumsum(_found(shard, blocks)[0])])
                out += (seen[shard.begins + shard.sizes] > seen[shard.begins]).tolist()
            yield pd.Series(out, dtype=bool)

    return docs.where(~affected(F.col("text").cast("binary")))
