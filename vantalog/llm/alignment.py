"""Alignment of two tokenizers' tokens over the same bytes (operator 11).

An array gives each A id the B id of the same bytes. A group of one A and one B token that are such a pair is counted
in a vector as long as A's vocabulary; only the links of all other groups enter the shuffle of pairs. Texts are encoded
once, in units between which no token of either side reaches and which are remembered: what a document links is kept as
packed pairs, counted over the corpus, and looked up again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, saved, shuffles_dropped, texts

#: Where the public vocabulary files are.
VOCABULARIES = "/opt/tokenizers"
#: Bytes of text that are aligned at once.
BATCH_BYTES = 2 << 20
#: How A's file splits text before it merges bytes (its byte-level rule); fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after a character that is no white space, white space that is long, and all white space but the space.
_BEFORE_SPACE, _LONG_WHITE = re.compile(r"(?<=\S) "), re.compile(r"\s{2000}")
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
_LINKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, same_n binary, pair binary, pair_n binary"


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and ``same``: each A id's B id of the same bytes, or -1."""

    def __init__(self, folder: str = VOCABULARIES, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model"):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(f"{folder}/{a_file}", encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Byte-level files write bytes as characters: printable ones as they are, the others from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{a_file}: ids don't follow the order of merges")  # then ranks would merge otherwise
        self.a = tiktoken.Encoding(a_file, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        self.slow = Tokenizer.from_file(f"{folder}/{a_file}")  # for long white space, on which the quick one overflows its stack
        self.slow.encode_special_tokens = True
        self.space = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.b_told = [b"\xff" if t is None else t for t in self.b_bytes]  # a byte that no text has
        self.a_size, self.b_size = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_told))
        of = {token: i for i, token in reversed(list(enumerate(self.b_bytes))) if token and not self.b.is_byte(i)}
        self.same = np.array([of.get(token, -1) for token in self.a_bytes], np.int64)
        # Ids as they stand in a document's groups, inside their side of a group and at its end: all A ids, then all B ids.
        told = [b"%d%b" % (i, end) for n, last in ((len(self.a_bytes), b"|"), (len(self.b_bytes), b";")) for i in range(n) for end in (b",", last)]
        self.told, self.told_size = np.array(told, object), np.array([len(t) for t in told], np.int64)

    def _piece(self, i: int) -> bytes | None:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return None
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def split(self, text: str) -> list[str]:
        """The text's units, each without the space that stands before it.

        A unit starts at a space after a character that is no white space. No token of either side reaches across such
        a place: A splits there before it merges, and B has no piece with a space after another character.
        """
        if not self.apart:
            return [text]
        units = text.split(" ")
        return units if all(units) and not any(w + " " in text for w in _WHITE) else _BEFORE_SPACE.split(text)

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of the units and their spaces, one unit's after the other's, how many each has, and whether both have the unit's bytes; no ids if not.

        A takes in one go all units that end with no white space, since it splits between them.
        """
        whole = [b" %b" % u.encode() for u in units]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        plain = sum(map(_ends_plain, units))  # they come first
        joined = " " + " ".join(units[:plain])
        if _LONG_WHITE.search(joined):
            plain, joined = 0, ""
        a = np.array(self.a.encode_ordinary(joined) if plain else [], np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum(size[:plain]), "right"), prepend=0)
        odd = [self.slow.encode(" " + u, add_special_tokens=False).ids if _LONG_WHITE.search(u) else self.a.encode_ordinary(" " + u) for u in units[plain:]]
        a, n_a = np.concatenate([a, *odd]).astype(np.int64), np.concatenate([n_a, np.fromiter(map(len, odd), np.int64, len(odd))])
        of_b = [ids or [self.space] for ids in self.b.encode(units, num_threads=1)]  # B's encoder gives none for a lone space
        n_b, b = np.fromiter(map(len, of_b), np.int64, len(of_b)), np.fromiter(chain.from_iterable(of_b), np.int64)
        good = np.ones(len(units), bool)
        if b"".join(map(self.b_told.__getitem__, b.tolist())) != b"".join(whole) or (np.add.reduceat(self.b_size[b], np.cumsum(n_b) - n_b) != size).any():
            good = np.array([b"".join(map(self.b_told.__getitem__, ids)) == w for ids, w in zip(of_b, whole, strict=True)])
        if (np.add.reduceat(self.a_size[a], np.cumsum(n_a) - n_a) != size).any():
            raise ValueError("A's tokens don't have the text's bytes")  # a byte-level vocabulary that lacks bytes
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return a, b, n_a, n_b, good


def _ends_plain(unit: str) -> bool:
    return bool(unit) and not unit[-1].isspace()


@lru_cache(maxsize=1)
def vocabularies(folder: str) -> Vocabularies:
    return Vocabularies(folder)


def _packed(docs: int, doc: np.ndarray, code: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Per document its distinct codes, as steps from one to the next, and how often it has each, as bytes of 32-bit numbers."""
    keys = np.sort(doc << 40 | code)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.diff(first, append=len(keys))
    doc, code = keys[first] >> 40, keys[first] & ((1 << 40) - 1)
    cuts = np.searchsorted(doc, np.arange(docs + 1))
    steps = np.diff(code, prepend=0)
    begins = cuts[:-1][cuts[1:] > cuts[:-1]]
    steps[begins] = code[begins]
    ends = [(4 * i, 4 * j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return tuple([whole[i:j] for i, j in ends] for whole in (steps.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))


def _unpacked(steps: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document's place in the batch, code and count of all that ``_packed`` wrote."""
    own = [np.frombuffer(s, np.int32) for s in steps.to_pylist()]
    doc = np.repeat(np.arange(len(own)), [len(s) for s in own])
    code = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(s, dtype=np.int64) for s in own]])
    return doc, code, np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(s, np.int32) for s in n.to_pylist()]]).astype(np.int64)


class Ragged:
    """Lists of numbers by place, and ``of``: the lists of many places, one after the other."""

    def __init__(self):
        self.sizes, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begins = self.sizes

    def append(self, count: int, place: np.ndarray, values: np.ndarray) -> None:
        self.sizes = np.concatenate([self.sizes, np.bincount(place, minlength=count)])
        self.values = np.concatenate([self.values, values])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def of(self, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and value of all numbers of the places."""
        sizes = self.sizes[places]
        at = np.repeat(self.begins[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(owner, sizes), self.values[at]


class Units:
    """What is known of units of text: counts, groups as text, regular groups' A ids, other links. Forgets all beyond ``room`` units, so memory stays bounded."""

    def __init__(self, v: Vocabularies, room: int = 250_000):
        self.v, self.room = v, room
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.told: list[bytes] = []
        self.counts, self.good = np.zeros((4, 0), np.int64), np.zeros(0, bool)
        self.same, self.pair = Ragged(), Ragged()

    def learn(self, units: list[str]) -> None:
        """Aligns new units.

        Their bytes stand one after the other, so a unit's end is a cut like any other. A byte range between neighbouring
        ends of either side's tokens lies in one A and one B token, and every overlapping pair has one such range.
        """
        v, count = self.v, len(units)
        units = sorted(units, key=_ends_plain, reverse=True)
        a, b, n_a, n_b, good = v.encoded(units)
        end_a, end_b = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        meets = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[meets] == end_a)  # the groups' last tokens
        last_b = meets[last_a]
        group_a, group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        regular = (group_a == 1) & (group_b == 1) & (v.same[a[last_a]] == b[last_b])
        unit = np.repeat(np.arange(count), n_a)
        same_unit, same = unit[last_a[regular]], a[last_a[regular]]

        ends = np.sort(np.concatenate([end_a[np.repeat(~regular, group_a)], end_b[np.repeat(~regular, group_b)]]))
        ends = ends[np.diff(ends, prepend=0) > 0]
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pair_unit, pair = unit[in_a], a[in_a] * len(v.b_bytes) + b[in_b]

        # A group's A tokens stand before its B tokens and after all tokens of earlier groups.
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(last_b - group_b + 1, group_a)] = 2 * a + closes_a
        order[np.arange(len(b)) + np.repeat(last_a + 1, group_b)] = 2 * (len(v.a_bytes) + b) + closes_b
        whole = b"".join(v.told[order].tolist())
        cuts = np.concatenate([[0], np.cumsum(v.told_size[order])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.told += [whole[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:], strict=False)]
        groups = np.bincount(unit[last_a], minlength=count)
        links = np.bincount(same_unit, minlength=count) + np.bincount(pair_unit, minlength=count)
        self.counts = np.concatenate([self.counts, [n_a, n_b, groups, links]], 1)
        self.good = np.concatenate([self.good, good])
        self.same.append(count, same_unit, same)
        self.pair.append(count, pair_unit, pair)
        self.place.update(zip(units, range(len(self.place), len(self.place) + count), strict=True))

    def columns(self, raw: list[bytes | None]) -> list[list | np.ndarray]:
        """The columns of ``_LINKS`` for texts; nothing but zeros for null, empty and invalid ones and those that a tokenizer changes."""
        own: list[list[str]] = []
        for text in raw:
            try:
                name = (text or b"").decode()
            except UnicodeDecodeError:
                name = ""
            own.append(self.v.split(name) if name else [])
        docs, sizes = len(own), np.fromiter(map(len, own), np.int64, len(own))
        flat = list(chain.from_iterable(own))
        got = list(map(self.place.get, flat))
        if missing := [i for i, place in enumerate(got) if place is None]:
            new = {flat[i] for i in missing}
            if len(self.place) + len(new) > self.room:
                self.clear()
                new, missing = set(flat), range(len(flat))
            self.learn(list(new))
            for i in missing:
                got[i] = self.place[flat[i]]
        places = np.array(got, np.int64)
        doc = np.repeat(np.arange(docs), sizes)
        bad = np.zeros(docs, bool)
        bad[doc[~self.good[places]]] = True
        keep = ~bad[doc]
        places, doc = places[keep], doc[keep]
        counts = []
        for row in self.counts:
            n = np.zeros(docs, np.int64)
            np.add.at(n, doc, row[places])
            counts.append(n)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        sums = [sha256(b";".join(map(self.told.__getitem__, got[i:j]))).hexdigest() if j > i and not b else "" for i, j, b in zip(cuts, cuts[1:], bad.tolist(), strict=False)]
        return [*counts, sums, *(x for kind in (self.same, self.pair) for x in _packed(docs, *kind.of(places, doc)))]


def encode(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, row (tells rows apart once written) and ``_LINKS`` of every row of ``docs``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(vocabularies(folder))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 4
        names = ["doc_id", "row", *[c.split()[0] for c in _LINKS.split(", ")]]
        for batch in batches(rows, BATCH_BYTES):
            columns = units.columns(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), *map(pa.array, columns, kinds)], names)

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, f"doc_id long, row long, {_LINKS}")


def pair_counts(encoded: DataFrame, folder: str = VOCABULARIES, room: int = 1 << 21) -> DataFrame:
    """code (A id times B's vocabulary, plus B id) and n: links of every id pair. A task adds regular groups up in one vector and emits other pairs counted for ``room`` of a document's pairs at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(folder)
        vector, held, size = np.zeros(len(v.a_bytes), np.int64), [], 0

        def counted() -> pa.RecordBatch:
            code, at = np.unique(np.concatenate([np.zeros(0, np.int64), *[c for c, _ in held]]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([np.zeros(0, np.int64), *[n for _, n in held]]))
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in rows:
            _, same, n = _unpacked(batch.column(0), batch.column(1))
            np.add.at(vector, same, n)
            _, code, n = _unpacked(batch.column(2), batch.column(3))
            held.append((code, n))
            size += len(code)
            if size >= room:
                yield counted()
                held, size = [], 0
        seen = np.flatnonzero(vector)
        held.append((seen * len(v.b_bytes) + v.same[seen], vector[seen]))
        yield counted()

    return encoded.select("same", "same_n", "pair", "pair_n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, folder: str = VOCABULARIES, most_hot: int = 500_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    A encodes a space and the text, B the text, before which it sets a space; where the bytes of both agree with space
    and text, byte offsets at which both have a token end cut the tokens into groups, and tokens whose bytes overlap
    are linked. An id pair's count is the number of its links in all documents; n_best counts a document's links whose
    count is the highest of their B id (ties too), count_sum adds the counts of its links. Null, empty and invalid
    texts and those that a tokenizer changes have no tokens: zeros and ''. Repeated rows each count and each get a
    row; null ids stay; an empty table gives none.

    The counts of the most frequent pairs, at most ``most_hot`` of them and all if there are no more, go to the tasks
    with the highest count of each B id (as many as B's vocabulary); the rarer ones are joined by their code, none of
    which is then on many rows. Codes must fit 31 bits.
    """
    spark = docs.sparkSession
    v = vocabularies(folder)
    pieces, same_of = len(v.b_bytes), v.same
    if len(v.a_bytes) * pieces >= 1 << 31:
        raise ValueError("codes of pairs must fit 31 bits")
    encoded = saved(encode(docs, folder), "aligned")
    with shuffles_dropped(spark):
        totals = saved(pair_counts(encoded, folder), "pairs")
    best_rows = totals.groupBy((F.col("code") % pieces).alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(pieces, np.int64)
    best[best_rows.column("b").to_numpy()] = best_rows.column("n").to_numpy()
    # Pairs by the binary digits of their counts: where to cut so that few enough lie above.
    digits = totals.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count("*").alias("pairs")).orderBy(F.desc("digits")).collect()
    upto = np.cumsum([r.pairs for r in digits])
    hot = int((upto <= most_hot).sum())
    rare = hot < len(digits)
    least = 1 << (digits[hot - 1].digits - 1) if hot else 1 << 62
    known = totals.where(F.col("n") >= least).sort("code").toArrow()
    codes, counts = known.column("code").to_numpy(), known.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((codes, counts, counts == best[codes % pieces]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, is_best = shared.value
        for batch in rows:
            docs_, code_, n_ = [], [], []
            for first in (0, 2):
                doc, code, n = _unpacked(batch.column(first + 1), batch.column(first + 2))
                docs_.append(doc)
                code_.append(code * pieces + same_of[code] if first == 0 else code)
                n_.append(n)
            doc, code, n = (np.concatenate(x) for x in (docs_, code_, n_))
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            found = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            best_n, sum_n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sum_n, doc[found], n[found] * counts[at[found]])
            np.add.at(best_n, doc[found], n[found] * is_best[at[found]])
            left = np.flatnonzero(~found)
            left = left[np.argsort(doc[left], kind="stable")]
            cuts = np.searchsorted(doc[left], np.arange(batch.num_rows + 1)).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(code[left]), pa.array(n[left])], ["code", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_n), pa.array(sum_n), others, *[batch.column(i) for i in range(5, batch.num_columns)]], ["row", "n_best", "count_sum", "others", *rest])

    rest = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    told = "row long, n_best long, count_sum long, others array<struct<code:long,n:long>>, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    out = encoded.select("row", "same", "same_n", "pair", "pair_n", *rest).mapInArrow(run, told)
    if rare:
        out = saved(out, "scored")
        highest = F.broadcast(spark.createDataFrame(best_rows.rename_columns(["_b", "_best"])))  # as many rows as B has ids
        cold = totals.where(F.col("n") < least).withColumnRenamed("n", "count").withColumn("_b", F.col("code") % pieces).join(highest, "_b").select("code", "count", (F.col("count") == F.col("_best")).alias("best"))
        asked = out.select("row", F.explode("others").alias("o")).select("row", "o.code", "o.n")
        more = asked.join(cold, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("count")).alias("_sum"))
        zero = F.lit(0).cast("long")
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", zero), "count_sum": F.col("count_sum") + F.coalesce("_sum", zero)})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
