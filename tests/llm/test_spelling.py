"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from vantalog.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n int, root string, slot int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        own = [x for x in counts if near(w, x)]
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(own), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def counted(docs, one_in=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def some_docs(seed=3):
    rng = random.Random(seed)
    stems = ["license", "reading", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "Größen", "étêèàç", "straße", "banana", "ananab", "abcabc", "abcdefghij", "abcdefghi", "bcdefghij"]
    words = list(stems)
    for s in stems:
        for _ in range(6):
            i = rng.randrange(len(s))
            words += [s[:i] + s[i + 1 :], s[:i] + rng.choice("abeÿÀ") + s[i:], s[:i] + rng.choice("abé") + s[i + 1 :]]
    docs = [(i, " ".join(rng.choices(words, [30 if w in stems else 1 for w in words], k=rng.randrange(200)))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "9 --"), (None, "license license license"), (5, docs[5][1]), (5, docs[5][1]), (63, "Reading-reading_READING " * 900), (64, "q" * 5000 + " short")]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("spelling"))
    spark.createDataFrame([(d, t, "clash", 1, "clash", 2) for d, t in some_docs()], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, queries.op13_spelling_variants(spark, at).toPandas()


def test_query_is_brute_force(found):
    want = brute(counted(some_docs()))
    got = {r["word"]: tuple(None if x != x else x for x in (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in found[1].to_dict("records")}
    assert any(v[0] for v in want.values())
    assert got == want


def test_sql_agrees(found):
    at, got = found
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
        want = db.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.ORACLE_SQL['op13_spelling_variants']})").fetchall()
    key = lambda rows: sorted(rows, key=lambda r: r[0])
    assert key([tuple(None if x != x else x for x in r) for r in got[["word", "form", "root", "n", "n_near", "form_n"]].itertuples(index=False)]) == key(want)


def test_random_words_of_two_letters(spark):
    rng = random.Random(8)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 9))): rng.choice([1, 2, 5, 10, 50, 300]) for _ in range(150)}
    rows = spark.createDataFrame([(w, n, 1, "x") for w, n in counts.items()] + [(None, 3, 1, "x"), ("nulls", None, 1, "x")], "word string, n int, slot int, gram string")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(rows).collect()}
    assert got == brute(counts)


def test_chains_are_followed_to_the_end(spark):
    chain = ["a" * i for i in range(3, 12)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame([(w, 5**i) for i, w in enumerate(chain)], "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1]}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([(1, None, "w", 1, "r", 1)], SCHEMA)).count() == 0
