"""Personal data by candidate gradient boosting (operator 12).

Generators propose every span that might be an e-mail address, an IP address, a card or a phone number, overlapping ones
too; boosted trees over the spans' format and context tell them apart, and a threshold a kind, set on calibrated
probabilities of texts that training didn't see, selects what is redacted. Spans of the plain patterns stay, whatever
the trees say.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Most documents that training reads for context, and about the most bytes of their text; chosen by a hash of doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 4 << 20
Span = tuple[int, int, int]  # kind's number, start, end in code points

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_GAP = re.compile(r"[ ().\-/]{0,3}")
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_AT = re.compile(r"@| ?[(\[{<] ?at ?[)\]}>] ?|(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9])", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{<] ?dot ?[)\]}>] ?| dot )[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
_DOT = re.compile(r"\.| ?[(\[{<] ?dot ?[)\]}>] ?| dot ", re.IGNORECASE)
#: Words that stand before a span, by what they speak of.
_HINTS = [re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.IGNORECASE) for words in ("phone|tel|telephone|call|fax|mobile|cell|whatsapp|handy|telefon", "card|visa|credit|payment|pay|mastercard|amex|karte|carte|tarjeta", "ip|host|server|addr|address|client|gateway|from", "mail|email|e-mail|contact|write|correo", "version|release|build|section|chapter|v|figure|table", "order|invoice|isbn|issn|id|ref|number|no|ticket|sku|item|article", "on|date|since|until|year|dated|between|born|le|am")]


def luhn(digits: str) -> bool:
    """The check of card numbers: from the right, every second digit is doubled, and the sum of all digits ends in 0."""
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The plain patterns' spans by kind and start: leftmost and not overlapping within a kind; those that fail their check are dropped. Linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((0, start, host.end()))
        end = host.end() if host else at + 1
        at = text.find("@", end)
    out += [(1, m.start(), m.end()) for m in _QUAD.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CHAIN.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _CALL.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """All spans that might be personal data, overlapping ones too.

    E-mail: a local part of at most 64 characters before a sign or word for "at" and a host whose dots may be words.
    Numbers: all windows of at most eight neighbouring runs of digits, at most three separators apart, that have a card's
    (13 to 19) or a phone's (7 to 15) digits, or are four bytes. IPv6: groups between colons.
    """
    out: list[Span] = []
    for m in _AT.finditer(text):
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            out.append((0, start, host.end()))
    out += [(1, m.start(), m.end()) for m in _V6.finditer(text) if sum(c != ":" for c in m[0]) >= 2]
    runs = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    joined = [_GAP.fullmatch(text, a[1], b[0]) is not None for a, b in zip(runs, runs[1:], strict=False)]
    for i, (start, _) in enumerate(runs):
        digits, j = 0, i
        while True:
            digits += runs[j][1] - runs[j][0]
            if digits > 19:
                break
            end = runs[j][1]
            if digits >= 13:
                out.append((2, start, end))
            if 7 <= digits <= 15:
                first = start
                while first > 0 and start - first < 2 and text[first - 1] in "(+":
                    first -= 1
                out.append((3, first, end))
            if j - i == 3 and all(text[runs[k][1] : runs[k + 1][0]] == "." for k in range(i, j)) and all(_byte(text[a:b]) for a, b in runs[i : j + 1]):
                out.append((1, start, end))
            if j + 1 == len(runs) or not joined[j] or j - i == 7:
                break
            j += 1
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span: what its runs of digits and separators are like, its check sum, its host, what stands beside it, and which words stand before it."""
    kind, start, end = span
    own = text[start:end]
    runs = [len(d) for d in _DIGITS.findall(own)] or [0]
    digits = "".join(c for c in own if "0" <= c <= "9")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    near_left = _DIGITS.search(text[max(0, start - 3) : start])
    near_right = _DIGITS.match(text[end : end + 4].lstrip(" ().-/+"))
    out = [kind, kind == 0, kind == 1, kind == 2, kind == 3, len(own), len(digits), len(runs), min(runs), max(runs), runs[0], runs[-1]]
    out += [own.count(c) for c in " -./:"] + ["+" in own, "(" in own, own.count("(") == own.count(")"), len(set(digits)), int(digits[:1] or 0), digits[:2] == "00"]
    out += [kind == 2 and luhn(digits), len(digits) in (15, 16), runs[:4] == [4, 4, 4, 4], runs[-2:] == [3, 4] or runs[-2:] == [4, 4], len(set(re.sub("[0-9]", "", own))) <= 1]
    if kind == 0:
        anchor = next(m for m in _AT.finditer(own) if m.start() > 0)
        host = _DOT.split(own[anchor.end() :])
        out += [anchor[0] == "@", anchor[0].lower() == " at ", anchor.start(), sum(map(str.isdigit, own[: anchor.start()])), len(host), len(host[-1]), host[-1].isalpha(), host[-1].islower(), bool(re.search(" dot |[(\\[{<] ?dot", own, re.IGNORECASE))]
    else:
        out += [0] * 9
    out += [before.isalnum(), before in "-./:#_=" and before != "", before in "$€£", after.isalnum(), after in "-./:%_" and after != "", after in "$€£%", near_left is not None, near_right is not None, start == 0, end == len(text)]
    words = text[max(0, start - 24) : start]
    return [float(x) for x in out] + [float(bool(hint.search(words))) for hint in _HINTS]


@dataclass
class Trees:
    """Boosted regression trees of one depth on the log loss, level by level over binned features."""

    depth: int = 4
    rounds: int = 60
    rate: float = 0.2
    least: float = 8.0  # sum of curvature, times 4, that a leaf needs
    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 32) -> Trees:
        """Splits a node where the gain of both sides' squared pull over their curvature is largest; a node without gain sends all rows left."""
        if not len(y):
            return self
        edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins))) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            pull, bend = y - p, p * (1 - p)
            node, features_, cuts = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                chosen, at = np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64)
                for f, column in enumerate(binned):
                    key = node * (bins + 1) + column
                    g, h = (np.cumsum(np.bincount(key, w, nodes * (bins + 1)).reshape(nodes, -1), 1) for w in (pull, bend))
                    rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                    gain = g * g / (h + 1) + rest_g * rest_g / (rest_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(h < self.least / 4) | (rest_h < self.least / 4)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(nodes), top] > best
                    best[better], chosen[better], at[better] = gain[np.arange(nodes), top][better], f, top[better]
                node = 2 * node + (binned[chosen[node], np.arange(len(y))] > at[node])
                features_.append(chosen)
                cuts.append(np.array([edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(chosen, at, strict=True)]))
            g, h = np.bincount(node, pull, 1 << self.depth), np.bincount(node, bend, 1 << self.depth)
            leaf = self.rate * g / (h + 1)
            self.feature.append(np.concatenate(features_))
            self.cut.append(np.concatenate(cuts))
            self.leaf.append(leaf)
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of every row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


@dataclass
class Model:
    trees: Trees
    slope: np.ndarray  # a kind: calibrated log odds are slope * score + shift
    shift: np.ndarray
    threshold: np.ndarray  # a kind: the least calibrated probability that is selected

    def probability(self, x: np.ndarray) -> np.ndarray:
        kind = x[:, 0].astype(np.int64)
        return 1 / (1 + np.exp(-np.clip(self.slope[kind] * self.trees.score(x) + self.shift[kind], -60, 60)))


def select(text: str, spans: list[Span], base: list[Span], p: np.ndarray, threshold: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Base spans (probability 1) and, likeliest first, the longer of equals, the spans that reach their kind's threshold and overlap neither a base span nor one selected before."""
    out = [(*b, 1.0) for b in base]
    taken = merged(base)
    for k in sorted((k for k, s in enumerate(spans) if p[k] >= threshold[s[0]]), key=lambda k: (-p[k], spans[k][1] - spans[k][2], spans[k])):
        kind, start, end = spans[k]
        i = bisect_left(taken, (start, start))
        if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
            continue
        taken.insert(i, (start, end))
        out.append((kind, start, end, float(p[k])))
    return sorted(out)


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Ranges of any kind, those that overlap put together."""
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _number(rng: Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))


def _card(rng: Random, n: int) -> str:
    front = _number(rng, n - 1)
    return next(front + d for d in "0123456789" if luhn(front + d))


def personal(rng: Random) -> list[tuple[int, str]]:
    """One made-up piece of personal data in one of the ways it is written, or two side by side."""
    word = lambda low, high: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(low, high)))
    kind = rng.randrange(4)
    if kind == 0:
        local = rng.choice([word(3, 8), f"{word(2, 6)}.{word(3, 8)}", f"{word(3, 7)}{rng.randrange(100)}", f"{word(2, 6)}_{word(2, 6)}"])
        at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT "), (" @ ", ".")])
        text = local + at + dot.join([*[word(3, 9) for _ in range(rng.choice([1, 1, 2]))], rng.choice(["com", "org", "net", "de", "fr", "es", "io", "example", "edu"])])
    elif kind == 1:
        text = ".".join(str(rng.randrange(256)) for _ in range(4)) if rng.random() < 0.5 else ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
        if ":" in text and rng.random() < 0.5:
            text = re.sub(r":[^:]+:[^:]+:", "::", text, count=1)
    elif kind == 2:
        digits = _card(rng, rng.choice([16, 16, 16, 15, 19, 13]))
        sizes = {15: [4, 6, 5], 16: [4, 4, 4, 4]}.get(len(digits), [len(digits)])
        cuts = np.cumsum([0, *sizes])
        text = rng.choice(["", " ", "-", "."]).join(digits[i:j] for i, j in zip(cuts, cuts[1:], strict=False))
    else:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        cc = rng.randrange(1, 99)
        text = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}", f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b}{c}", f"+{cc}-{a}-{b}-{c}", f"0{a}/{b}{c}", f"0{a} {c}{b}", f"1-{a}-{b}-{c}"])
    made = [(kind, text)]
    return made + personal(rng)[:1] if rng.random() < 0.25 else made


def decoy(rng: Random) -> str:
    """One made-up thing that looks like personal data and is none."""
    n = lambda a, b: rng.randrange(a, b)
    date = rng.choice([f"{n(1950, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1950, 2030)}", f"{n(1, 13):02d}/{n(1, 29):02d}/{n(1950, 2030)}", f"{n(1900, 1990)}-{n(1991, 2030)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}"])
    wrong = _number(rng, rng.choice([13, 14, 15, 16, 16, 16, 17, 18]))
    wrong = wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    host = "".join(rng.choice("abcdefgilmnoprst") for _ in range(6))
    number = rng.choice([f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(1, 9)}.{n(10**6, 10**9)}", f"{n(1, 99)}.{n(0, 99)}.{n(0, 99)}", f"978-{n(1, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{_number(rng, n(7, 13))}", f"{wrong}", " ".join(_number(rng, n(1, 5)) for _ in range(n(2, 7))), f"{n(1, 10**6):x}-{n(10**6, 10**9):x}-{n(10**6, 10**9):x}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), "-".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), f"{n(10, 99)} {n(100, 999)} {n(1000, 9999)}", f"{n(1, 300)}.{n(256, 999)}.{n(0, 300)}.{n(0, 300)}", f"#{_number(rng, 8)}", f"{n(10, 90)}.{n(10**5, 10**6)}, -{n(10, 90)}.{n(10**5, 10**6)}"])
    return rng.choice([date, date, number, number, number, f"{date} {date}", f"{date} {number}", f"look at {host}.com", f"@{host}", f"at {host}. {host.title()}", f"{host} @ {n(1, 90)}.{n(10, 99)}", f"std::{host}::{host}", f"meet at {host} dot"])


_LEADS = (["tel", "phone:", "call", "fax"], ["ip", "server", "from"], ["card", "visa", "pay with"], ["order", "invoice no.", "version", "isbn", "id:", "on", "ref"])


def spoilt(text: str, rng: Random, room: int = 4_000) -> tuple[str, set[Span]]:
    """A stretch of the text with personal data and decoys put between its words, and where the data stand."""
    start = rng.randrange(max(1, len(text) - room))
    words = text[start : start + room].split(" ")
    out, at, truth = [], 0, set()

    def put(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece) + 1

    for word in words:
        put(word)
        dice = rng.random()
        if dice < 0.03:
            for kind, piece in personal(rng):
                if rng.random() < 0.3:
                    put(rng.choice(_LEADS[{0: 0, 1: 1, 2: 2, 3: 0}[kind]]))
                truth.add((kind, at, at + len(piece)))
                put(piece + rng.choice(["", "", "", ".", ",", ")"]))
        elif dice < 0.07:
            if rng.random() < 0.3:
                put(rng.choice(_LEADS[3]))
            put(decoy(rng))
    return " ".join(out), truth


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through scores and labels, smoothed as by one more row of each label, by Newton's steps."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([score, np.ones(len(score))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * (w - [1, 0]))
    return float(max(w[0], 1e-3)), float(w[1])


def train(own: list[str], seed: int = 12, precision: float = 0.98, **options) -> Model:
    """Fits the trees on four fifths of the texts with made-up data and decoys among their words, calibrates and sets the thresholds on the last fifth: the lowest probability, at least one half, above which ``precision`` of a kind's candidates are personal data. Without texts nothing but base spans is selected."""
    rng = Random(seed)
    x: tuple[list, list] = ([], [])
    y: tuple[list, list] = ([], [])
    for i, text in enumerate(own):
        whole, truth = spoilt(text, rng)
        truth |= {s for s in base_spans(whole) if not any(t[1] < s[2] and s[1] < t[2] for t in truth)}
        for span in candidates(whole):
            x[i % 5 == 4].append(features(whole, span))
            y[i % 5 == 4].append(float(span in truth))
    width = len(features("1", (2, 0, 1)))
    xs, ys = [np.array(part, float).reshape(-1, width) for part in x], [np.array(part) for part in y]
    trees = Trees(**options).fit(xs[0], ys[0])
    score, kind = trees.score(xs[1]), xs[1][:, 0]
    slope, shift, threshold = np.ones(4), np.zeros(4), np.full(4, 2.0)
    for k in range(4):
        s, t = score[kind == k], ys[1][kind == k]
        if not len(t) or not t.any():
            continue
        slope[k], shift[k] = calibrated(s, t)
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(t) + 1) >= precision
        last = np.append(np.diff(s[order]) < 0, True)  # candidates of one score stay together
        if (good & last).any():
            lowest = s[order][np.flatnonzero(good & last)[-1]]
            threshold[k] = max(0.5, 1 / (1 + np.exp(-(slope[k] * lowest + shift[k]))) - 1e-9)
    return Model(trees, slope, shift, threshold)


def sample(docs: DataFrame, most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``most_rows`` texts and about ``most_bytes``, whole, in order of a hash of doc_id: context for training, nothing else."""
    order = F.xxhash64(F.lit("pii"), "doc_id")
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", F.xxhash64("text")).limit(most_rows)
    out, size = [], 0
    for row in rows.select("text").toLocalIterator():
        text = bytes(row[0] or b"").decode("utf-8", "replace")
        out.append(text)
        size += len(text)
        if size >= most_bytes:
            break
    return out


def fit(docs: DataFrame, **options) -> Model:
    """Trains on the driver on a bounded sample."""
    return train(sample(docs), **options)


def found_in(raw: list[bytes | None], model: Model, block: int = 20_000) -> list[tuple[list[Span], list[tuple[int, int, int, float]]]]:
    """Base spans and all selected spans of each text; ``block`` candidates are scored together, whichever texts they are of."""
    names = [(t or b"").decode("utf-8", "replace") for t in raw]
    base, spans = [base_spans(t) for t in names], [candidates(t) for t in names]
    every = ((t, s) for t, own in zip(names, spans, strict=True) for s in own)
    p = [np.zeros(0)]
    while x := [features(t, s) for t, s in islice(every, block)]:
        p.append(model.probability(np.array(x)))
    p, cuts = np.concatenate(p), np.cumsum([0, *map(len, spans)])
    return [(b, select(t, own, b, p[i:j], model.threshold)) for t, own, b, i, j in zip(names, spans, base, cuts, cuts[1:], strict=False)]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base, spans (each an array of kind, start, end, score) of every whole text, a row per row of ``docs``.

    Places are code points, end exclusive; spans are ordered by kind as in ``KINDS``, then start. ``base`` are the
    patterns' spans, ``spans`` those and the model's. Null and empty texts have none; repeated rows each get their
    row; null ids stay.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            told = found_in(texts(batch.column(1)), model)
            as_rows = lambda spans: [{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "score": s[3] if len(s) > 3 else 1.0} for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([as_rows(b) for b, _ in told], _SPAN), pa.array([as_rows(s) for _, s in told], _SPAN)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; of overlapping spans the first kind's name stands for all. Null texts stay null; all other columns and rows as they are."""

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            raw = [None if t is None else bytes(t) for t in part]
            out = []
            for text, (_, spans) in zip(raw, found_in(raw, model), strict=True):
                if text is None:
                    out.append(None)
                    continue
                name, at, pieces = text.decode("utf-8", "replace"), 0, []
                for start, end in merged([s[:3] for s in spans]):
                    kind = next(KINDS[s[0]] for s in spans if s[1] < end and start < s[2])
                    pieces += [name[at:start], f"[{kind.upper()}]"]
                    at = end
                out.append("".join([*pieces, name[at:]]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text").cast("binary")))
