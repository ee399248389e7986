"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; and against brute force."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantalog.llm import decontaminate, html_extract, licenses, mixing, ngram_lm, queries, sharding, simhash, substrings, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, _key string, key long, n int, fp long"
ALNUM, SPACED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


def make_texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)] + ["The", "MIT", "License", "license", "Apache", "general", "public"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(n)]
    texts += [None, "", " \n", "!!!", texts[3], texts[3], texts[4] + " tail", "x " * 20_000, "Größe\x85 null"]
    return texts


def table(spark, texts, **columns):
    rows = [(i, t, "en", columns.get("source", lambda i: "abc"[i % 3])(i), len(t or ""), "clash", "clash", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    table(spark, texts).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_license_scan(docs, texts, empty):
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        own, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [j for j in range(len(own)) if own[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan(empty).count() == 0


def test_license_template_with_changed_words(spark):
    text = licenses.TEMPLATES[0][1]
    own = text.split()
    changed = " ".join(own[:20] + ["indeed", "truly"] + own[20:])
    rows = table(spark, ["intro " * 9 + changed, "free of charge to any person", text, text[:80]])
    found = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert found[0].labels == "mit" and 0.8 <= found[0].score < 1
    assert found[1].labels == "" and found[2].score == 1 and found[3].labels == ""
    span = [r for r in licenses.spans(rows).collect() if r.doc_id == 0]
    assert len(span) == 1 and (span[0].first, span[0].last) == (9, 9 + len(words(changed)) - 1)


def test_substring_repeats(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(60) for _ in range(8)]
    line = "the same nine words stand in each of them"
    texts = [fresh(100) + "\n" + line for _ in range(20)]
    for i, p in enumerate(passages):
        texts += [f"{fresh(30 + i)} {p} {fresh(20)}", f"{fresh(3 + i)} {p} {fresh(9)}"]
    texts += [None, "", "a " * 3000, fresh(70)]
    texts.append(texts[-1])
    rows = table(spark, texts)
    found = substrings.repeats(rows).collect()
    assert {r.doc_id for r in found} == {21 + 2 * i for i in range(8)} | {len(texts) - 1}
    for r in found:
        piece = texts[r.doc_id].encode()[r.start + r.n_bytes // 4 : r.start + r.n_bytes * 3 // 4]
        assert piece in texts[r.first_doc_id].encode() and r.first_doc_id < r.doc_id
    cleaned = {r.doc_id: r.text for r in substrings.clean(rows).collect()}
    assert cleaned[0] == texts[0] and cleaned[20] == texts[20] and len(cleaned[21]) < len(texts[21]) - 200 and cleaned[36] is None
    assert substrings.repeats(rows.limit(0)).count() == 0
    assert substrings.repeats(rows.unionByName(rows)).count() == len(found)


def test_one_id_and_two_texts(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    first, second = fresh(70), fresh(70)
    rows = [(1, f"{fresh(30)} {first} {fresh(5)}"), (2, f"{fresh(20)} {second}"), (9, f"{fresh(60)} {first} {fresh(40)}"), (9, f"{second} {fresh(80)}"), (9, None), (None, first), (None, "x")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, of string, row string")
    found = substrings.repeats(docs).collect()
    assert sorted(r.first_doc_id for r in found) == [1, 2] and len({r.doc_key for r in found}) == 2
    cleaned = [(r.doc_id, r.text) for r in substrings.clean(docs).collect()]
    assert len(cleaned) == len(rows) and sorted(map(str, (x for x in cleaned if x[0] != 9))) == sorted(map(str, (x for x in rows if x[0] != 9)))
    for text, passage in ((rows[2][1], first), (rows[3][1], second)):
        own = text.replace(passage, "").strip()
        left = [t for i, t in cleaned if i == 9 and t and own[len(own) // 2 : len(own) // 2 + 30] in t]
        assert len(left) == 1 and len(left[0]) < len(text) - 150

    kept = simhash.keep_one(docs.where("doc_id = 9 or doc_id is null"))
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for i, t in rows if i in (9, None))
    again = simhash.keep_one(docs.unionByName(docs))
    assert again.columns == docs.columns and again.count() == len(rows)

    benchmark = spark.createDataFrame([(1, first)], "item_id long, text string")
    assert sorted((r.doc_id or 0, str(r.text)) for r in decontaminate.clean(docs, benchmark).collect()) == sorted((i or 0, str(t)) for i, t in rows if first not in str(t))

    many = spark.createDataFrame([(None, f"{fresh(10)} {i}", "s") for i in range(4000)], "doc_id long, text string, source string")
    taken = mixing.with_copies(many).selectExpr("sum(size * copies) as n", "max(target) as t").first()
    assert abs(taken.n - taken.t) < 0.05 * taken.t


def test_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    parts = [None, b"", text, b"new words " + text, "é".encode() * 700, b"\0\0a\0", b" \n", b"x " * 500]
    at, first, end, digest = substrings.chunk(parts)
    for i, t in enumerate(parts):
        own = [(a, b) for k, a, b in zip(at, first, end, strict=True) if k == i]
        assert [w for a, b in own for w in range(a, b)] == list(range(len((t or b"").split())))
        assert all(0 < b - a <= substrings.SPAN for a, b in own)
    assert len(set(digest[at == 2]) - set(digest[at == 3])) <= 4
    assert all(len(x) == 0 for x in substrings.chunk([None, b"  "]))


def _repeats_by_force(texts, size):
    """(text's index, first word, words, first holder) of all passages, from every window of every text."""
    holder, found = {}, []
    for i, t in enumerate(texts):
        own = (t or "").encode().split()
        grams = [tuple(own[j : j + size]) for j in range(len(own) - size + 1)]
        run = None
        for j, g in enumerate(grams):
            if g in holder:
                if run and j - run[1] < size:
                    run[1] = j
                else:
                    found.append(run := [j, j, i, holder[g]])
        for g in grams:
            holder.setdefault(g, i)
    return sorted((i, a, b - a + size, h) for a, b, i, h in found)


@pytest.mark.parametrize("size, crowd", [(50, 2048), (20, 3), (10, 2048)])
def test_substring_repeats_agree_with_brute_force(spark, size, crowd):
    rng = random.Random(size)
    fresh = lambda n, most: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, most))) for _ in range(n))
    texts = []
    for most in (1, 3, 9):
        for n in [size - 5, size - 1, size, size + 1, size + 5, size * 2] * 6:
            p = fresh(n, most)
            texts.append(f"{fresh(rng.randint(0, 40), most)} {p} {fresh(rng.randint(0, 40), most)}")
            before, after = rng.choice([(0, 30), (30, 0), (9, 9), (0, 0)])
            texts.append(f"{fresh(before, most)}\n{p.replace(' ', rng.choice([' ', '  ', chr(10)]))} {fresh(after, most)}")
    long = fresh(300, 9)
    texts += [long, "x " * 700, "y " + "x " * 400, "a b " * 300, None, "", " \n", fresh(size - 1, 9), "w" * 5000, long, long[:900] + " " + long[300:], "x " * 700]
    # A passage whose halves come from two documents is none, but overlapping windows of two holders are one.
    left, right, middle = fresh(size - 1, 9), fresh(size - 1, 9), fresh(size - 4, 9)
    texts += [left, right, f"{left} {right}", f"{fresh(4, 9)} {middle}", f"{middle} {fresh(4, 9)}"]
    texts.append(" ".join([texts[-2], *texts[-1].split()[-4:]]))
    docs = table(spark, texts).repartition(5)
    found = substrings.repeats(docs, size, crowd=crowd).collect()
    expected = _repeats_by_force(texts, size)
    assert sorted((r.doc_id, len(texts[r.doc_id].encode()[: r.start].split()), r.n_words, r.first_doc_id) for r in found) == expected
    for r in found:
        piece = texts[r.doc_id].encode()[r.start : r.start + r.n_bytes]
        assert piece == piece.strip() and len(piece.split()) == r.n_words
    cleaned = {r.doc_id: r.text for r in substrings.clean(docs, least_words=size).collect()}
    for i, t in enumerate(texts):
        left = (t or "").split()
        for k, a, n, _ in reversed(expected):
            if k == i:
                del left[a : a + n]
        assert (cleaned[i] is None) == (t is None) and (cleaned[i] or "").split() == left


def test_substring_repeats_within_a_text(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    p = fresh(55)
    docs = table(spark, [f"{fresh(10)} {p} {fresh(9)} {p}", fresh(200)])
    assert substrings.repeats(docs).count() == 0
    assert [(r.doc_id, r.n_words, r.first_doc_id) for r in substrings.repeats(docs, within=True).collect()] == [(0, 55, 0)]
    with pytest.raises(ValueError):
        substrings.repeats(docs, least_words=9)


def test_op2_query_agrees_with_brute_force(spark, docs, texts, tmp_path):
    long = [t for t in texts if len(words(t, SPACED)) == 200]
    more = texts + [f"{i} {long[i % 3]} {long[i % 2]} {i}" for i in range(9)]
    table(spark, more).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((r.doc_id, len(more[r.doc_id].encode()[: r.start].split()), r.n_words, r.first_doc_id) for r in queries.op2_substring_dedup(spark, str(tmp_path)).collect())
    assert found and found == _repeats_by_force(more, 50)


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(3)
    calm, bad = [f"word{i}x" for i in range(300)], ["idiotic", "moronic", "pathetic"]
    texts, labels = [], []
    for i in range(600):
        own = [rng.choice(calm) for _ in range(40)]
        if i % 4 == 0:
            own[rng.randrange(40)] = rng.choice(bad)
            own[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append((i, int(i % 4 == 0)))
    texts += [None, "", "!!", " ".join(calm[:30]) + " idioticc patheticc", " ".join(calm[:30])]
    docs = table(spark, texts)
    known = spark.createDataFrame([*labels, (1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    found = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert len(found) == len(texts) and all(0 <= s <= 1 for s in found.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    assert found[603] > found[604] and found[600] == found[601] == found[602]
    kept = {r.doc_id for r in toxicity.clean(docs, known).collect()}
    assert kept == {i for i, s in found.items() if s < 0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.clean(docs, known.limit(0)).columns == docs.columns


def test_toxicity_vectors_use_all_dimensions_and_one_class_trains():
    rng = random.Random(4)
    rows = [(" ".join([rng.choice("abcdefgh") * rng.randint(3, 6) for _ in range(30)] + ["awful"] * (i % 3 == 0)).encode(), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train(rows)
    used = model.vectors[np.abs(model.vectors).sum(axis=1) > 0]
    assert (np.linalg.svd(used, compute_uv=False) > 1e-3).all()
    words = toxicity.WordScores(model)
    assert np.mean([(words.score(t) >= 0.5) == y for t, y in rows]) > 0.98 and words.score(b"bbbb aaaa awfull cccc") > words.score(b"bbbb aaaa cccc")
    for only in ([(b"x y", 1)], [(b"x", 0), (None, 0)], []):
        assert 0 <= toxicity.WordScores(toxicity.train(only)).score(b"x y z") <= 1


def test_grams_of_a_word_agree_with_brute_force():
    words = ["ab", "größe", "a", "abcdefg", "日本語の"]
    found, sizes = toxicity.grams([w.encode() for w in words], 1 << 16)
    assert sizes.tolist() == [1 + sum(max(0, len(w) + 2 - n + 1) for n in range(3, 6) if n < len(w) + 2) for w in words]
    alone = [toxicity.grams([w.encode()], 1 << 16)[0].tolist() for w in words]
    assert [x for a in alone for x in a] == found.tolist()


def test_toxicity_held_out(docs):
    for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_shards(docs, texts, empty):
    for rows, shards in ((docs, 7), (docs.unionByName(docs), 40), (docs, 200)):
        found = sharding.shard(rows, shards, rows_per_bin=8).collect()
        by = defaultdict(list)
        for r in found:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(shards)]
        assert sum(sizes) == rows.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert sharding.shard(empty, 5).count() == 0
    again = lambda: sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard(docs, 7).collect())
    assert again() == again()


def test_whole_shuffles_are_uniform_and_keep_clashing_columns(spark, tmp_path):
    """Where rows land depends neither on their partition nor on their place in it, and the law of a place is the uniform one."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i if i % 3 else None, "a", 2, i, 4) for i in range(6000)], "doc_id long, own string, part int, rank int, bin int").repartitionByRange(3, "rank").write.parquet(path)
    rows = spark.read.parquet(path)
    found = sharding.shard(rows, 4, seed=5, rows_per_bin=50)
    assert found.columns == [*rows.columns, "shard", "slot"]
    places = {r["rank"]: (r.shard, r.slot) for r in found.collect()}
    cells = Counter((rank // 500, shard, slot // 300) for rank, (shard, slot) in places.items())
    expected = 6000 / (12 * 4 * 5)
    chi = sum((cells[i, s, t] - expected) ** 2 / expected for i in range(12) for s in range(4) for t in range(5))
    assert len(set(places.values())) == 6000 and 140 < chi < 330  # about 239 degrees of freedom
    order = np.array([places[i][0] * 1500 + places[i][1] for i in range(6000)])
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.05 and abs(np.corrcoef(order, np.arange(6000))[0, 1]) < 0.05


def test_hypergeometric_draws_follow_the_law(spark):
    n, k, t = 6, 5, 14
    draws = spark.range(20_000).select(sharding._draw(F.lit(n), F.lit(k), F.lit(t), sharding._unit(F.lit(9), F.col("id"))).alias("d")).groupBy("d").count().collect()
    law = {d: math.comb(k, d) * math.comb(t - k, n - d) / math.comb(t, n) for d in range(0, 6)}
    assert sum(abs(r["count"] / 20_000 - law[r.d]) for r in draws) < 0.03


def test_matrix_rows_and_columns_are_exact(spark):
    parts, cells = [5, 0, 90, 17], [28, 28, 28, 28]
    sizes = spark.createDataFrame([(0, [(i, n) for i, n in enumerate(parts)], cells)], "g int, parts array<struct<part:long,n:long>>, cells array<long>")
    rows = {r.part: r.sends for r in sharding.matrix(sizes, "g", 1).collect()}
    assert [sum(rows[i]) for i in range(4)] == parts and [sum(c) for c in zip(*rows.values(), strict=True)] == cells


@pytest.mark.parametrize("scale", [1.0, 3e9])
def test_top_k(spark, scale):
    rng = np.random.default_rng(0)
    data = rng.normal(0, 0.2, (300, 12)) * scale
    data[50:120] = data[50]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(data)]
    rows += [(1000, None, 1), (1001, [1.0, None] * 6, 1), (1002, [float("nan")] * 12, 1), (None, [0.1] * 12, 1), (1003, [0.5] * 3, 1), (1004, [float("inf")] * 12, 1), rows[7], (7, [float(x) for x in -data[7]], 1), (1050, [], 1)]
    quantised = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = defaultdict(list)
    for r in topk.top_k(quantised, quantised.where("vec_id % 50 = 0"), 5, rows_per_shard=90, leaf=8).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and i < 300]
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q][1], v, strict=True)), i) for i, v in whole if i != q)[:5]
        assert sorted(found[q]) == [(i + 1, v, max(-(2**63), min(2**63 - 1, -s))) for i, (s, v) in enumerate(best)]
    assert set(found) == set(range(0, 300, 50))
    few = quantised.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    assert topk.top_k(quantised, quantised.where('vec_id = 50'), 5, queries_per_block=1).count() == 5
    assert topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


def test_mix(spark, docs, texts):
    sizes = {i: len(SPACED.findall(t or "")) for i, t in enumerate(texts)}
    rows = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source")))
    found = {r.doc_id: r for r in mixing.with_copies(rows).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()}
    by, weight, target = defaultdict(int), {}, {}
    for i in sizes:
        by[found[i].source] += sizes[i]
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    free, left = set(names), 1.5 * sum(by.values())
    while True:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * by[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by[s]
            free.discard(s)
            left -= target[s]
    target |= {s: share * weight[s] for s in free}
    for i, r in found.items():
        assert r.size == sizes[i] and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        rate = r.target / r.source_size
        assert r.copies in (math.floor(rate), math.floor(rate) + 1)
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.copies for i, r in found.items() if r.copies})
    assert mixing.mix(rows.limit(0)).count() == 0


def brute_fingerprint(text):
    own = words(text, SPACED)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_fingerprints_and_components(docs, texts, empty):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp % 2**64 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == components(prints)
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(components(prints).values()))
    assert simhash.near_duplicates(empty).count() == 0


def components(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("crowd", [256, 4])
def test_links_connect_what_brute_force_connects(spark, crowd):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.choice([1, 2, 3]))))
    prints = dict(enumerate(sorted(prints)))
    rows = spark.createDataFrame([(i, p - (p >> 63 << 64)) for i, p in prints.items()], "id long, fp long")
    edges = simhash.links(rows, crowd)
    for r in edges.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 2 or crowd == 4
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    own = {i: labels.get(p - (p >> 63 << 64), p - (p >> 63 << 64)) for i, p in prints.items()}
    expected = components(prints)
    assert {frozenset(i for i in own if own[i] == v) for v in own.values()} == {frozenset(i for i in expected if expected[i] == v) for v in expected.values()}


def test_chains_keep_every_pair_within_distance():
    for bits in [()] + [(i,) for i in range(64)] + [(i, j) for i in range(64) for j in range(i)]:
        x = sum(1 << b for b in bits)
        segment = [(x >> 8 * i & 255).bit_count() for i in range(8)]
        assert any(all(sum(segment[(s + j) % 8] for j in range(n)) <= n * 2 // 8 for n in range(1, 9)) for s in range(8))


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, texts, empty, most_bytes):
    rng = random.Random(4)
    items = [(i, " ".join(words(texts[rng.randrange(100)])[:40])) for i in range(12)]
    items += [(20, "w1 w2"), (21, None), (22, ""), (23, items[0][1]), (None, "w3 w4 w5"), (24, "never seen words")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = {r.doc_id: r for r in decontaminate.find(docs, benchmark, most_bytes=most_bytes).collect()}
    assert len(found) == len(texts)
    for d, text in enumerate(texts):
        own, hit, ids = words(text), set(), set()
        for i, t in items:
            w = words(t)
            n = min(10, len(w))
            for at in range(len(w) - n + 1 if n else 0):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[at : at + n]:
                        hit |= set(range(p, p + n))
                        ids |= {i}
        r = found[d]
        assert r.n_words == len(own) and {w for s in r.spans for w in range(s.first, s.end)} == hit and r["items"] == sorted(ids - {None}), d
    whole = {i: words(t) for i, t in items if i is not None}
    located = {r.doc_id: r for r in decontaminate.locate(docs, benchmark, most_bytes=most_bytes).collect()}
    for d, r in located.items():
        own = words(texts[d])
        starts = {m.first: m for m in r.matches}
        assert r.longest == max((m["words"] for m in r.matches), default=0) and bool(r.matches) == bool(found[d].spans)
        for p in range(len(own)):
            best = max((n for _, t in items for n in agreeing(own[p:], words(t))), default=0)
            if p in starts:
                m = starts[p]
                assert m["words"] == best
                if m["item"] is not None:
                    assert own[p : p + best] == whole[m["item"]][m.start : m.start + best]
            elif best:
                assert any(m.first < p and m.first + m["words"] >= p + best for m in r.matches), (d, p)
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, r in found.items() if not r.spans}
    assert decontaminate.find(empty, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)


def agreeing(rest, item):
    """Lengths of matches at the start of ``rest`` that hold a window of the item."""
    n = min(10, len(item))
    for at in range(len(item) - n + 1 if n else 0):
        if rest[:n] == item[at : at + n]:
            size = n
            while size < len(rest) and at + size < len(item) and rest[size] == item[at + size]:
                size += 1
            yield size


def test_decontamination_of_repeated_words_is_brute_force(spark):
    rng = random.Random(9)
    items = [(1, "a " * 40), (2, "a b " * 15), (3, "a b c d e f g h i j k l " * 4), (4, "b"), (5, "c c c")]
    docs_ = [" ".join(rng.choices("abc", [8, 2, 1], k=rng.randrange(1, 200))) for _ in range(25)] + ["a " * 300, "a b " * 100, "a b c d e f g h i j k l " * 30, "b b"]
    rows = spark.createDataFrame(list(enumerate(docs_)), "doc_id long, text string")
    for r in decontaminate.find(rows, spark.createDataFrame(items, "item_id long, text string")).collect():
        own, hit, ids = words(docs_[r.doc_id]), set(), set()
        for i, t in items:
            w = words(t)
            n = min(10, len(w))
            grams = {tuple(w[at : at + n]) for at in range(len(w) - n + 1)}
            for p in range(len(own) - n + 1):
                if tuple(own[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids |= {i}
        assert {w for s in r.spans for w in range(s.first, s.end)} == hit and r["items"] == sorted(ids)


def test_decontamination_makes_no_pairs_of_places():
    class Block:
        def __init__(self, items):
            self.value = vars(decontaminate.Items(items))

    for item, text in (("w " * 10_000, "w " * 100_000), ("a b c d e f g h i j k l " * 40, "a b c d e f g h i j k l " * 8_000)):
        tracemalloc.start()
        began = time.perf_counter()
        shard = decontaminate.Shard([text.encode()], decontaminate.WordHashes())
        hit, ids = decontaminate._found(shard, [Block([(7, item.encode())])])
        took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert hit[:-1].all() and ids == [{7}] and took < 10 and most < 200 << 20, (took, most)


@pytest.mark.parametrize("order", [3, 4])
def test_language_model(docs, texts, empty, order):
    held = toxicity.held_out(F.col("doc_id"), 7, 2)
    found = {r.doc_id: r for r in ngram_lm.score(docs, held, order=order, chunk_bytes=9_000).collect()}
    tokens = {i: [*words(t, SPACED), None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [Counter() for _ in range(order)]
    for i in train:
        padded = ["<"] * (order - 1) + tokens[i]
        for j in range(order - 1, len(padded)):
            for n in range(order):
                grams[n][tuple(padded[j - n : j + 1])] += 1
    total, kinds = sum(grams[0].values()), len(grams[0])
    assert len(found) == len(texts)
    for i, own in tokens.items():
        r = found[i]
        base = sum(math.log10((grams[0][(w,)] + 1) / (total + kinds + 1)) for w in own)
        assert r.held_out == (i not in train) and r.n_tokens == len(own) and r.train_tokens == total and r.n_known == sum(grams[0][(w,)] > 0 for w in own)
        assert r.base_score == pytest.approx(base) and r.score < 0
        padded, score = ["<"] * (order - 1) + own, 0.0
        for j in range(order - 1, len(padded)):
            p = (grams[0][(padded[j],)] + 1) / (total + kinds + 1)
            for n in range(1, order):
                context = tuple(padded[j - n : j])
                seen = len(train) if set(context) == {"<"} else grams[n - 1][context]
                p = (grams[n][(*context, padded[j])] + 8 * p) / (max(seen, grams[n][(*context, padded[j])]) + 8)
            score += math.log10(p)
        assert r.score == pytest.approx(score, rel=0.03, abs=0.05 + 1e-4 * len(own))  # counts are quantised to 8 bits
    assert ngram_lm.score(empty, held).count() == 0


def test_registered_language_model_reads_two_words_of_context(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda f: sorted((r.doc_id, round(r.score, 6)) for r in f.collect())
    made = rows(queries.op9_ngram_lm(spark, str(tmp_path)))
    held = toxicity.held_out(F.col("doc_id"), 7, 2)
    assert made == rows(ngram_lm.score(docs, held, order=3)) != rows(ngram_lm.score(docs, held, order=2))


def test_main_text_behind_a_script_in_a_page_with_dotted_capital_i(spark):
    told = "The story of the bridge is long, and many people have told it, each in words of their own. " * 4
    html = f"<html><body><article><p>{'İ' * 20} {told}</p><SCRIPT>var a = 1;</SCRIPT><p>{told} zuletzt</p></article></body></html>"
    row = html_extract.extract(spark.createDataFrame([(1, "https://h.example/1", html)], "page_id long, url string, html string")).first()
    assert "zuletzt" in str(row) and "var a" not in str(row)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 2**20), (1000, 2**60), (5, 6)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = ngram_lm.EliasFano(*ngram_lm.EliasFano.coded(values))
        assert (coded.at(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 50).astype(np.uint64)])
        assert (coded.successor(np.sort(asked)) == np.searchsorted(values, np.sort(asked))).all()


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><header>Site</header>%s<aside>Side</aside><div class="ad">Buy</div><form>Sign up</form><footer>&copy; x</footer></body></html>'


def test_main_text(spark):
    body = '<div id="c1" class="content"><h1>Head &amp; line</h1><p>One <b>bo</b>ld\n text&nbsp;here.<p>Two<br>three<ul><li>four<li>five</ul><!-- no --><div class="cookie-notice">Accept</div></div>'
    pages = [(i, f"https://a.example/{i}", PAGE % body, "x") for i in range(5)]
    pages += [(5, "http://b.example/1", PAGE % f'<article>{body}<section class="comments"><p>first!</p></section></article>', "x"), (6, None, None, "x"), (7, "nohost", "", "x"), (8, "https://a.example/9", "plain words", "x"), (9, "https://a.example/8", PAGE % "<main><p>Another kind of page with its own text.</p></main>", "x"), (10, "https://c.example", "<p>open <i>tags<p>and &lt;more&gt; &#233;", "x")]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, path string")).collect()}
    whole = "Head & line One bold text here. Two three four five"
    assert all(found[i].text == whole for i in range(6)), [found[i].text for i in range(6)]
    assert found[6].text == found[7].text == "" and found[8].text == "plain words" and found[9].text == "Another kind of page with its own text." and found[10].text == "open tags and <more> é"
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suffix_array_is_in_order():
    rng = random.Random(8)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (300, 3), (300, 100)):
        own = np.array([rng.randrange(kinds) for _ in range(n)], np.uint64)
        assert decontaminate.suffix_array(own).tolist() == sorted(range(n), key=lambda i: own[i:].tolist())


def test_main_text_of_templates_deep_pages_and_harmless_class_names():
    rng = random.Random(3)
    said = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    templates = (
        "<body><nav><ul><li><a href=/>{0}</a></ul></nav><article><h1>{1}</h1><p>{2}<div class=ad>{3}</div><p>{4}</article><footer>{5}</footer>",
        "<body><div class='site-header'>{0}</div><div class='story'><h2>{1}</h2><p>{2}</p><ul><li>{4}</li></ul></div><div id='comments-list'>{3}</div><div class='cookie-notice'>{5}</div>",
        "<body><header>{0}</header><main><section><p>{1}<p>{2}<p>{4}</section><aside>{3}</aside></main><div class='sidebar left'>{5}</div>",
        "<body><table><tr><td class='nav-menu'>{0}<td><p>{1}</p><p>{2}</p><p class='ad-hoc'>{4}</p></table><form>{3}</form><div class='newsletter-signup'>{5}</div>",
    )
    for template in templates:
        hit = wanted = given = 0
        for _ in range(20):
            parts = [said(n) for n in (4, 6, 60, 12, 40, 8)]
            page = html_extract.Page(template.format(*parts))
            found, good = page.at(page.path(page.best())).split(), " ".join((parts[1], parts[2], parts[4])).split()
            hit, wanted, given = hit + sum((Counter(found) & Counter(good)).values()), wanted + len(good), given + len(found)
        assert hit >= 0.95 * wanted and hit >= 0.95 * given, template
    for tag in ("div", "span", "p"):
        page = html_extract.Page(f"<{tag}>" * 100_000 + "deep")
        assert page.at(page.path(page.best())) == "deep"
    kept = "<p class='ad-hoc'>one</p><section id='comment-on-method'>two</section><div class='related-work'>three</div><p class='widget'>four <math>E=mc</math></p>"
    assert html_extract.Page(f"<article>{kept}<div class='ads'>no</div></article>").at(None) == "one two three four E=mc"


def test_hosts_vote(spark):
    pages = [(i, "http://h.example/", PAGE % "<div class='story2'><p>text of the page</p></div>") for i in range(3)] + [(9, "http://h.example/", PAGE % "<section><p>something else here</p></section>")]
    paths = html_extract.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [(r.host, r.votes, r.pages) for r in paths] == [("h.example", 3, 4)] and paths[0].path.endswith("div.story#")


@pytest.mark.parametrize("broken", ["<p", "<p ", '<p "', '<a">"', "<a '\">", "<!", "</", "<!--", '<div><p "x\' >'])
def test_broken_markup_takes_linear_time(broken):
    began = time.perf_counter()
    for end in ("", ">", "<p>kept"):
        html_extract.Page(broken * (1_000_000 // len(broken)) + end)
    assert time.perf_counter() - began < 15


def test_tags_end_at_the_first_end_outside_quotes():
    for source, want in (('<a b="x>y">z', [" z"]), ('<a b="x>y', ['y']), ("<p a=\"1\" b='2>'>one</p>", ["one"]), ('<a">"<a">"t', ['"', '"t']), ("text <p", ["text ", "<p"]), ("a<!-- b", ["a"])):
        pieces = [t for _, t in html_extract.Page(source).pieces if t]
        assert "".join(pieces).strip() == "".join(want).strip(), source


def test_adverts_go_whatever_the_element(spark):
    page = "<html><body><article><h1>Title of it</h1><p>" + "One long sentence of the article. " * 8 + "</p><p class='ad'>Buy this</p><p>More of the <span class='advert'>Buy that</span> article and a <p class='ad-hoc'>remark.</p></article></body></html>"
    rows = spark.createDataFrame([(1, "http://h.org/a", page)], "page_id long, url string, html string")
    (row,) = html_extract.extract(rows).collect()
    assert "Buy" not in row.text and "remark." in row.text and row.text.startswith("Title of it")
