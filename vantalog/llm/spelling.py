"""Spelling variants grouped by asymmetric q-chunks (operator 13).

Of two words that differ by one inserted, deleted or replaced code point, the longer one gives two disjoint chunks, each
half of it, and the other its positional grams of that length. One edit spares one chunk, which then stands in the
other word at its own place or one place before: those grams alone are joined, and the pairs verified. Everything is
columns: words are counted with partial results, candidates meet by equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lower_ascii, saved, shuffles_dropped

#: Latin letters of ASCII and Latin-1.
RUN_RE = "[A-Za-zÀ-ÿ]+"


def slipped(run: Column, doc_id: Column, one_in: int) -> Column:
    """The run with one code point deleted where crc32 of ``<doc_id>:<run>`` is divisible by ``one_in``; the place follows from the same number. Null ids count as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int | None = None) -> DataFrame:
    """word, n: the lower-cased (A-Z) runs of letters in whole texts that have ``least_length`` code points and occur ``least_count`` times in all documents. ``one_in``: runs slip, as ``slipped`` says, before they are measured and counted. Null texts have none."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN_RE), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run") if one_in is None else slipped(F.col("run"), F.col("doc_id"), one_in)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(slot: int, word: Column, start: Column, size: Column) -> Column:
    return F.struct(F.lit(slot).alias("slot"), F.substring(word, start + 1, size).alias("gram"))


def chunks(words: DataFrame) -> DataFrame:
    """Each word's two disjoint chunks of half its length."""
    word, half = F.col("word"), F.floor(F.length("word") / 2).cast("int")
    return words.select(word.alias("giver"), F.col("n").alias("giver_n"), F.explode(F.array(_keyed(0, word, F.lit(0), half), _keyed(1, word, half, half))).alias("key")).select("giver", "giver_n", "key.*")


def grams(words: DataFrame) -> DataFrame:
    """Each word's positional grams that a chunk of a word as long as it, or longer by one, can join: one at the first chunk's place, and two at the second's and one before. The giver is never shorter, so no other place within one is left."""
    word, size = F.col("word"), F.length("word")
    made = []
    for longer in (0, 1):
        half = F.floor((size + longer) / 2).cast("int")
        made += [_keyed(0, word, F.lit(0), half), _keyed(1, word, half - 1, half), F.when(half * 2 <= size, _keyed(1, word, half, half))]
    every = F.array_distinct(F.array_compact(F.array(*made)))
    return words.select(word.alias("taker"), F.col("n").alias("taker_n"), F.explode(every).alias("key")).select("taker", "taker_n", "key.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """giver, giver_n, taker, taker_n: every unordered pair of different words (distinct, of two code points or more) at one edit, once. A pair that both chunks find is taken by the first."""
    met = chunks(words).join(grams(words), ["slot", "gram"])
    longer = F.length("giver") - F.length("taker")
    half = F.floor(F.length("giver") / 2).cast("int")
    other_start = F.substring(F.col("giver"), F.lit(1), half) != F.substring(F.col("taker"), F.lit(1), half)
    once = ((longer == 1) | (longer == 0) & (F.col("giver") < F.col("taker"))) & ((F.col("slot") == 0) | other_start)
    return met.where(once & (F.levenshtein("giver", "taker", 1) == 1)).select("giver", "giver_n", "taker", "taker_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: each word's last form. Every round doubles the steps taken; a form is ``ratio`` times as frequent as its word, so chains are short. ``forms`` has one row (word, form) per word that has a form, and no cycles."""
    now = saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        with shuffles_dropped(now.sparkSession):
            moved = saved(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        forget(now)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        now = saved(moved.select("word", "root"), "forms")
        forget(moved)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n).

    form: of the words at one edit the most frequent, of ties the smallest in code-point order, if it is at least
    ``ratio`` (over 1) times as frequent as the word; else null, and form_n too. n_near counts the words at one edit.
    root: where forms lead in the end; the word itself if it has none. Words are distinct; other columns are left out;
    null words and counts are no words. A word has only so many neighbours as its length and the letters allow, so no
    word's group is large. Without words there are no rows.
    """
    spark = words.sparkSession
    words = words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and n is not null")
    with shuffles_dropped(spark):
        words = saved(words, "words")
        pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("giver").alias("word"), F.col("taker").alias("other"), F.col("taker_n").alias("other_n")), F.struct(F.col("taker").alias("word"), F.col("giver").alias("other"), F.col("giver_n").alias("other_n")))).alias("p")).select("p.*")
        best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other")))
        near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        taken = -F.col("best.rank") >= F.col("n") * ratio
        told = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n")), "near")
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
