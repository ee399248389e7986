"""Alignment of two tokenizers against a plain version of its definition, on odd texts and an empty table."""

import hashlib
import random
from collections import Counter

import pytest

from vantalog.llm import alignment, queries

SCHEMA = "doc_id long, text string, row string, code int, n int"


def odd_texts():
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", "don't", "'ll", "été", "größe", "12", "3456", "!?", "漢字", "٣", "\x85", "\xa0", "\x1c", "…", "<s>", "</s>", "<0x41>", "<|endoftext|>", "<unk>", "ing", "aaaa", "x" * 40, "\x00", "🙂", "a\n ", " \n b", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([*range(32, 127), 233, 8364, 0x1F600])) for _ in range(50)) for _ in range(50)]
    return [*texts, None, "", " ", "  ", "\n", " a", "a ", "a▁b c", "▁", texts[0], texts[0], "word " * 3000, " " * 5000 + "end", "lost \n" * 500, "b" * 3000]


def brute(texts):
    """The contract's columns from whole encodings, all pairs of ranges compared."""
    from tokenizers import Tokenizer

    v = alignment.Vocabularies()
    a_tok = Tokenizer.from_file(f"{alignment.VOCABULARIES}/byte_bpe_50k.json")
    a_tok.encode_special_tokens = True
    rows, counts = [], Counter()
    for text in texts:
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)) if text else ([], [])
        if text and (b"".join(v.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(v.b_bytes[i] or b"\xff" for i in b) != (" " + text).encode()):
            a, b = [], []
        spans = []
        for ids, size in ((a, v.a_size), (b, v.b_size)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + int(size[i]), i))
                at = own[-1][1]
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        told, i, j = [], 0, 0
        for cut in cuts:
            sides = []
            for own, at in ((spans[0], i), (spans[1], j)):
                end = at
                while end < len(own) and own[end][1] <= cut:
                    end += 1
                sides.append((",".join(str(x[2]) for x in own[at:end]), end))
            (left, i), (right, j) = sides
            told.append(f"{left}|{right}")
        links, low = [], 0
        for start, end, x in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= start:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < end:
                links.append((x, spans[1][k][2]))
                k += 1
        counts.update(links)
        rows.append((a, b, told, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), len(told), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(told).encode()).hexdigest() if a else "") for a, b, told, links in rows]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("most_hot", [500_000, 40, 0])
def test_alignment_is_brute_force(docs, texts, most_hot):
    found = {r.doc_id: tuple(r)[1:] for r in alignment.alignments(docs, most_hot=most_hot).collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert found[i] == want, repr(texts[i])[:200]


def test_query_columns_repeats_and_null_ids(spark, tmp_path):
    rows = [(1, "one text", "c", 1, 2), (1, "one text", "c", 1, 2), (None, "one text", "c", 1, 2), (2, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_tokenizer_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = found.collect()
    same = {tuple(r)[1:] for r in got if r.n_a}
    assert len(got) == 4 and len(same) == 1
    (one,) = same
    assert one[5] == 3 * one[3]  # each link occurs in three rows
    assert tuple(next(r for r in got if r.doc_id == 2)) == (2, 0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_units_are_forgotten_but_results_stay(texts):
    v = alignment.vocabularies(alignment.VOCABULARIES)
    raw = [t.encode() if t is not None else None for t in texts] + [b"\xff\xfe", b"ok \xff"]
    whole, narrow = alignment.Units(v), alignment.Units(v, room=50)
    left = whole.columns(raw)
    right = [narrow.columns(raw[i : i + 7]) for i in range(0, len(raw), 7)]
    for k, column in enumerate(left):
        assert list(column) == [x for part in right for x in part[k]]
    assert list(left[0][-2:]) == [0, 0] and left[4][-2:] == ["", ""]  # not UTF-8


def test_same_bytes_have_one_id():
    v = alignment.vocabularies(alignment.VOCABULARIES)
    for i in (0, 262, 11, 1169):
        assert v.same[i] == -1 or v.b_bytes[v.same[i]] == v.a_bytes[i]
    assert (v.same >= 0).sum() > 5000
