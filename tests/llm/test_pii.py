"""Personal data: base spans against the plain patterns, boosted trees on texts they weren't trained on, edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from vantalog.llm import pii, queries

SCHEMA = "doc_id long, text string, base string, spans int, kind string"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The contract's patterns as they are."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def told(spans):
    return [(pii.KINDS[s[0]], *s[1:3]) for s in spans]


def odd_texts():
    rng = random.Random(2)
    parts = ["@", ".", "a", "b-c", "x.y", "+", "1", "255", "256", "0012", " ", "-", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (269) 555-3296", "10.0.0.1", "me@host.org", "%", "_", "é", "🙂", "\n", "..", " at ", " dot ", "[at]", ":", "::1", "fe80:"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["re", "tion", "an", "the", "ou", "ñ", "éa", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.train(prose(1, 200), rounds=40)


def test_base_spans_are_the_patterns():
    found = 0
    for text in odd_texts():
        assert told(pii.base_spans(text)) == plain(text), text
        found += len(plain(text))
    assert found > 2000


def test_model_on_texts_it_has_not_seen(model):
    rng = random.Random(77)
    hit, wrong, missed = np.zeros(4), np.zeros(4), np.zeros(4)
    for text in prose(5, 100):
        whole, truth = pii.spoilt(text, rng)
        ((base, spans),) = pii.found_in([whole.encode()], model)
        assert set(base) <= {s[:3] for s in spans}
        more, want = {s[:3] for s in spans} - set(base), truth - set(base)
        for kind in range(4):
            a, b = {s for s in more if s[0] == kind}, {s for s in want if s[0] == kind}
            hit[kind] += len(a & b)
            wrong[kind] += len(a - b)
            missed[kind] += len(b - a)
    assert (hit / (hit + missed) > 0.75).all(), (hit, wrong, missed)
    assert (hit / (hit + wrong) > 0.93).all(), (hit, wrong, missed)


def test_selected_spans_do_not_overlap(model):
    texts = [*odd_texts()[:300], "call +1 (578) 555-6437 4918187128635271 now"]
    for text, (base, spans) in zip(texts, pii.found_in([t.encode() for t in texts], model), strict=True):
        more = sorted((s[1], s[2]) for s in spans if s[:3] not in base)
        ranges = pii.merged(base)
        assert all(a[1] <= b[0] for a, b in zip(more, more[1:], strict=False))
        assert not any(a < end and start < b for a, b in ranges for start, end in more)
        assert told(spans) == sorted(told(spans), key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
    assert ("card", 23, 39) in told(spans) and ("phone", 5, 22) in told(spans)


def test_long_repetitive_texts_take_linear_time(model):
    for piece in ("a", "1", "1.", "1 ", "a@", "a@b", "+1", "(1", ":", "a:", " at a", "1234-5678 ", "@a.b "):
        began = time.perf_counter()
        pii.found_in([(piece * (40_000 // len(piece))).encode()], model)
        assert time.perf_counter() - began < 20, piece


def test_query_and_edge_cases(spark, tmp_path):
    texts = [None, "", "mail a.b@c.org or 10.0.0.1", "mail a.b@c.org or 10.0.0.1", "no data", "é 🙂 +1 (269) 555-3296 4524132264652876", "x" * 200_000 + " me@host.org"]
    rows = [(i if i != 3 else 2, t, "clash", 1, "clash") for i, t in enumerate(texts)] + [(None, "me@host.org", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_personal_data(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = found.collect()
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        want = plain(text or "")
        line = ",".join(":".join(map(str, s)) for s in want)
        mine = next(r for r in got if r.doc_id == doc_id)
        assert mine.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [mine.n_email, mine.n_ip, mine.n_card, mine.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(line.split(",")) - {""} <= set(mine.spans.split(","))
    assert pii.find(spark.createDataFrame([], SCHEMA), pii.train([])).count() == 0


def test_redact(spark, model):
    docs = spark.createDataFrame([(1, "mail a.b@c.org, then 10.0.0.1", "k", 1, "c"), (2, None, None, None, None), (3, "é nothing", "k", 1, "c")], SCHEMA)
    out = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert out[1].text == "mail [EMAIL], then [IP]" and out[2].text is None and out[3].text == "é nothing" and out[1].base == "k"


def test_trees_learn_what_one_split_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = pii.Trees().fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0) == y[2000:]).mean() > 0.95
