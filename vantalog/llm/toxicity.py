"""Toxicity by subword-bag embeddings and a linear softmax (operator 3).

A word is the mean of the vectors of its character n-grams and of itself; a text is the mean of its words; a linear
softmax over that mean gives the classes. Vectors and softmax are trained jointly in numpy, so a misspelling that was
never seen shares most of its vectors with the word it comes from.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, batches, texts

#: Most labelled rows that training reads, and most bytes of text in all; the rows are chosen by a hash of doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 10 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    vectors: np.ndarray  # buckets by dim
    softmax: np.ndarray  # dim by 2
    bias: np.ndarray  # 2
    without_words: float = 0.0  # logit of texts that have no words

    def bucket_scores(self) -> np.ndarray:
        """Each bucket's share of the logit of class 1 over class 0."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])


def grams(words: list[bytes], buckets: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (a power of two of them) of all words, one word's after the other's, and how many each word has: one for the word itself, and those of the character n-grams of ``<word>`` that are shorter than it."""
    names = [w.decode("utf-8", "replace") for w in words]
    text = np.frombuffer("".join(f"<{w}>" for w in names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, names), np.int64, len(names)) + 2
    owner = np.repeat(np.arange(len(names)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(text))
    mask = buckets - 1
    found, of = [np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) & mask], [np.arange(len(names))]
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, high + 1):
            ahead = np.zeros(len(text), np.uint64)
            ahead[: max(0, len(text) - n + 1)] = text[n - 1 :]
            h = (h ^ ahead) * _MIX
            h ^= h >> np.uint64(29)
            if n >= low:
                inside = np.flatnonzero((left >= n) & (lengths[owner] > n))
                found.append((h[inside] * _MIX >> np.uint64(40)).astype(np.int64) & mask)
                of.append(owner[inside])
    of = np.concatenate(of)
    return np.concatenate(found)[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=len(names))


class Bags:
    """Texts as means of their words, distinct words as means of their buckets: two sparse matrices, applied one after the other."""

    def __init__(self, texts_: list[bytes | None], buckets: int):
        self.buckets, self.n = buckets, len(texts_)
        places: dict[bytes, int] = {}
        own = [np.fromiter((places.setdefault(w, len(places)) for w in alnum_words(t)), np.int32) for t in texts_]
        self.sizes = np.array([len(o) for o in own], np.int64)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
        self.word = np.concatenate([np.zeros(0, np.int32), *own])
        self.share = np.repeat(1 / np.maximum(self.sizes, 1), self.sizes).astype(np.float32)
        self.words, names = len(places), list(places)
        made = [grams(names[i : i + 20_000], buckets) for i in range(0, len(names), 20_000)]
        self.bucket = np.concatenate([np.zeros(0, np.int32), *[m[0] for m in made]])
        self.of = np.repeat(np.arange(self.words, dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *[m[1] for m in made]]))
        self.in_word = np.maximum(np.bincount(self.of, minlength=self.words), 1)

    def forward(self, score: np.ndarray) -> np.ndarray:
        """Each text's mean of a number a bucket."""
        by_word = np.bincount(self.of, score[self.bucket], self.words) / self.in_word
        return np.bincount(self.text, by_word[self.word] * self.share, self.n)

    def backward(self, pull: np.ndarray) -> np.ndarray:
        """What each bucket gets of a number a text: the transpose of ``forward``."""
        by_word = np.bincount(self.word, pull[self.text] * self.share, self.words) / self.in_word
        return np.bincount(self.bucket, by_word[self.of], self.buckets)

    def texts_of(self) -> np.ndarray:
        """In how many texts each bucket's words stand, added up over its words."""
        pairs = np.unique(self.word.astype(np.int64) * max(self.n, 1) + self.text) // max(self.n, 1)
        return np.bincount(self.bucket, np.bincount(pairs, minlength=self.words)[self.of].astype(float), self.buckets)


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut at which the share of class 1 at or above it exceeds that of class 0 the most: halfway to the next text below."""
    order = np.argsort(-logits, kind="stable")
    gain = np.cumsum(y[order]) / y.sum() - np.cumsum(1 - y[order]) / (1 - y).sum()
    last = np.append(logits[order][1:] < logits[order][:-1], True)  # texts of one logit stay together
    at = int(np.argmax(np.where(last, gain, -np.inf)))
    return float(logits[order][at] + logits[order][min(at + 1, len(order) - 1)]) / 2


def train(rows: list[tuple[bytes | None, int]], buckets: int = 1 << 17, dim: int = 8, steps: int = 100, sparsity: float = 0.05, least_texts: int = 5, seed: int = 0) -> Model:
    """Fits vectors and softmax together by accelerated proximal gradient steps on the log loss over all rows.

    Vectors start at random, uniform up to 1 / dim either way, and each step moves both factors along their gradients.
    A bucket's steps are weighed by the inverse of its root mean square over the texts. A text has thousands of
    n-grams, of which very few matter, so a bucket whose pull is below ``sparsity`` times the strongest is drawn back
    to where it started; those in fewer than ``least_texts`` texts stay at zero. The bias then moves so that a score
    of 0.5 is the cut that tells the training rows' classes apart best, whatever the classes' shares. Texts without
    words get the mean logit of class 0. Without rows, or with one class only, all scores follow the class counts.
    """
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in rows], np.int64)
    counts = np.bincount(y, minlength=2)[:2]
    softmax = rng.normal(0, 1, (dim, 2))
    even = np.log((counts + 1.0) / (counts.sum() + 2.0))
    if not counts.all():
        return Model(np.zeros((buckets, dim)), softmax, even, even[1] - even[0])
    bags, n = Bags([text for text, _ in rows], buckets), len(rows)
    held_by = bags.texts_of()
    active = np.flatnonzero(held_by >= least_texts)
    if not len(active):
        return Model(np.zeros((buckets, dim)), softmax, even, even[1] - even[0])
    mean = bags.backward(np.full(n, 1 / n))[active]
    scale = np.zeros(buckets)
    scale[active] = np.sqrt(held_by[active] / n) / mean
    scale[active] /= np.median(scale[active])

    def back(pull: np.ndarray) -> np.ndarray:
        return (scale * bags.backward(pull))[active]

    def ahead_of(score: np.ndarray) -> np.ndarray:
        far = np.zeros(buckets)
        far[active] = score
        return bags.forward(scale * far)

    v = rng.random(len(active))
    for _ in range(12):  # the largest singular value bounds the step
        v = back(ahead_of(v))
        bound = np.linalg.norm(v)
        v /= bound
    bound /= 4 * n
    start = rng.uniform(-1 / dim, 1 / dim, (len(active), dim))
    vectors, ahead, momentum, bias = start, start, 1.0, np.log(counts[1] / counts[0])
    most = np.abs(back(counts[1] / n - y)).max() / n
    for _ in range(steps):
        # The mean commutes with the softmax's matrix, so texts meet one number a bucket instead of whole vectors.
        turn = softmax[:, 1] - softmax[:, 0]
        p = 1 / (1 + np.exp(-np.clip(ahead_of(ahead @ turn) + bias, -60, 60)))
        pull = back((p - y) / n)
        step = 1 / (1.1 * bound * (turn @ turn))
        moved = ahead - step * pull[:, None] * turn - start
        moved *= np.maximum(0, 1 - step * sparsity * most * np.linalg.norm(turn) / np.maximum(np.linalg.norm(moved, axis=1), 1e-300))[:, None]
        moved += start
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        of_softmax = vectors.T @ pull
        ahead = moved + (momentum - 1) / following * (moved - vectors)
        vectors, momentum = moved, following
        bias -= 2 * (p - y).mean()
        pace = 0.02 * np.linalg.norm(turn) / max(1.0, np.linalg.norm(of_softmax))
        softmax[:, 1] -= pace * of_softmax
        softmax[:, 0] += pace * of_softmax
    whole = np.zeros((buckets, dim))
    whole[active] = vectors * scale[active, None]
    model = Model(whole, softmax, np.zeros(2))
    logits, worded = bags.forward(model.bucket_scores()), bags.sizes > 0
    cut = best_cut(logits[worded], y[worded]) if len(np.unique(y[worded])) == 2 else float(-bias)
    model.bias = np.array([cut / 2, -cut / 2])
    calm = logits[worded & (y == 0)]
    model.without_words = float(calm.mean() if len(calm) else 0.0) - cut
    return model


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes | None, int]]:
    """At most ``most_rows`` labelled texts, half of each class, and about ``most_bytes`` in all, whole, in order of a hash of doc_id. Labels other than 0 and 1 and null ids are left out; of several labels of one id the highest counts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64(F.lit("toxicity"), "_doc")
    of = [known.where(F.col("_toxic") == c).orderBy(order, "_doc").limit(most_rows // 2) for c in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(of[0].unionByName(of[1])), F.col("doc_id") == F.col("_doc"))
    out, size = [], 0
    for text, label in rows.orderBy(order, "_doc").select("text", "_toxic").limit(most_rows).toLocalIterator():
        out.append((bytes(text) if text is not None else None, int(label)))
        size += len(out[-1][0] or b"")
        if size >= most_bytes:
            break
    return out


def held_out(doc_id: Column, mod: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


class WordScores(dict):
    """Word to its share of a text's logit; new words are worked out many at a time. Forgets everything beyond ``room`` words, so memory stays bounded."""

    def __init__(self, model: Model, room: int = 300_000):
        super().__init__()
        self.scores, self.room = model.bucket_scores(), room
        self.shift, self.without_words = float(model.bias[1] - model.bias[0]), model.without_words

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20_000):
            block = words[i : i + 20_000]
            bucket, sizes = grams(block, len(self.scores))
            self.update(zip(block, (np.add.reduceat(self.scores[bucket], np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))

    def score(self, text: bytes | None) -> float:
        """0 to 1."""
        words = alnum_words(text)
        if not words:
            return float(1 / (1 + np.exp(-np.clip(self.without_words, -500, 500))))
        if new := {w for w in words if w not in self}:
            if len(self) + len(new) > self.room:
                self.clear()
                new = set(words)
            self.learn(list(new))
        return float(1 / (1 + np.exp(-np.clip(self.shift + sum(map(self.__getitem__, words)) / len(words), -500, 500))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text, a row per row of ``docs``, repeated rows included. Null texts and those without words all get one score, that of the mean text of class 0. The words' scores are kept from batch to batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(model)
        for batch in batches(rows):
            found = pa.array(map(words.score, texts(batch.column(1))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), found], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, remainder: int = 0, **options) -> Model:
    """Trains on a bounded sample of the labelled rows that aren't held out."""
    open_to = ~held_out(F.col("doc_id"), mod, remainder)
    return train(sample(docs.where(open_to), labels.where(open_to)), **options)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches the threshold, which is op3's ``predicted`` at 0.5; columns and all other rows as they are, repeated rows and null ids included: each row is judged by its own text alone."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordScores(model)
        for part in parts:
            yield pd.Series([words.score(bytes(t) if t is not None else None) for t in part], dtype=float)

    return docs.where(score(F.col("text").cast("binary")) < threshold)
