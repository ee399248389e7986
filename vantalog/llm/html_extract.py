"""Main-text extraction by consensus host paths (operator 10).

Each page's containers are scored by the text they hold; the best one's generalised tag-class path is the page's vote.
Spark counts the votes per host, and every page is extracted again at its host's winning path, or at its own best
container where the page has no such path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, saved, small, texts

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select option input textarea head title dialog menu canvas audio video object embed applet map datalist noembed noframes xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption math".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}
# Names of parts of a page that aren't the article, as classes and ids have them.
NOISE = frozenset("nav navbar navigation menu menus sidebar sidebars footer masthead cookie cookies consent gdpr notice notices notification notifications ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo promos promotion popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager paging toolbar topbar login searchbox disclaimer".split())
# Words that name the shape or place of a part, which stand beside those above.
SHAPES = frozenset("area bar bars body bottom bottomlinks box block blocks button buttons center column container content fixed form global header head inner item items js left level link links list lists main outer page panel post posts primary right row secondary section sections side site slot slots sticky story stories article articles thread top unit units widget widgets wrap wrapper zone banner banners".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--(?:.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>", re.S)
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_UP_TO_QUOTE = re.compile(r"""[^>"']*+""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_OTHER_ATTR = re.compile(r"""(?<![\w:.-])(?!(?:class|id|role|hidden|aria-hidden|style)(?![\w:.-]))[\w:.-]++\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to split() only
_BLANKS = re.compile(r"[ \t\n\r\f\v\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_RAW_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(_OTHER_ATTR.sub(" ", text)):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


class _Ends:
    """Where tags end: at the first ``>`` outside quotes, or at the first one at all if there is none outside.

    Whoever looks for the end of broken markup may walk to the end of the page in vain. Places that such a walk passed
    are remembered, and a walk that comes to one of them is in vain too, so all walks together stay linear.
    """

    def __init__(self, source: str):
        self.source, self.last, self.vain = source, source.rfind(">"), None

    def of(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; there is a ``>`` behind it."""
        if self.vain is None:
            if m := _INSIDE.match(self.source, at):
                return m.end()
            self.vain = set()
        passed, place = [], at
        while True:
            place = _UP_TO_QUOTE.match(self.source, place).end()
            if place >= len(self.source) or place in self.vain:
                break
            if self.source[place] == ">":
                return place + 1
            passed.append(place)
            end = self.source.find(self.source[place], place + 1)
            if end < 0:
                break
            place = end + 1
        self.vain.update(passed)
        return self.source.find(">", at) + 1


def _noisy(tag: str, names: str, inside: bool = False) -> bool:
    """Whether a class name or id says that the element isn't part of the article: it names such a part, alone or beside words for shapes and places only. ``cookie-notice``, ``ad`` and ``comments-list`` do; ``ad-hoc``, ``related-work`` and ``comment-on-method`` don't. Articles and main parts go for readers' comments only; ``header`` and ``site-header`` go where they don't stand ``inside`` an article."""
    known = READERS if tag in ("article", "main") else NOISE
    header = known is NOISE and not inside
    for name in names.lower().split():
        parts = [p for p in _SPLIT.split(name) if p and not p.isdigit()]
        if any(p in known for p in parts) and all(p in NOISE or p in SHAPES for p in parts):
            return True
        if header and "header" in parts and {"site", "global", "top", "header"}.issuperset(parts):
            return True
    return False


def _advert(names: str) -> bool:
    """Whether a class name or id names an advert, alone or beside words for shapes and places only: that goes for any element."""
    parts = [[p for p in _SPLIT.split(name) if p and not p.isdigit()] for name in names.lower().split()]
    return any(ADVERTS.intersection(own) and all(p in ADVERTS or p in SHAPES for p in own) for own in parts)


def _label(tag: str, classes: str) -> str:
    """A step of a generalised path: the tag and its class names in order, digits as #."""
    names = sorted({re.sub(r"\d+", "#", c.lower()).replace(">", "") for c in classes.split()})
    return ".".join([tag, *names])


class Page:
    """A page's elements (parent, tag, label, dropped or not) and its pieces of text in order, with None where a block begins or ends.

    Paths are built from the parents' labels where they are asked for, and open elements are filed by tag, so that
    memory and time stay in proportion to the page, however deep its elements stand in each other.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.drop = [-1], ["html"], [""], [False]
        self.open: dict[str, list[int]] = {}  # places in the stack
        self.blocks = [0]
        self.pieces: list[tuple[int, str | None]] = []
        stack, at, size = [0], 0, len(source)
        pieces = self.pieces
        find, ends = _TOKEN.search, _Ends(source)
        while at < size:
            m = find(source, at) if at <= ends.last else None
            if not m or m.start() > ends.last:  # an open comment hides the rest; what else is open behind the last ``>`` is text
                comment = source.find("<!--", at)
                pieces.append((stack[-1], source[at : comment if comment >= 0 else size]))
                break
            if m.start() > at:
                pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2]
            if not name:
                continue
            tag, closing = name.lower(), m[1]
            at = ends.of(at)
            rest = source[m.end() : at - 1]
            if tag not in INLINE:
                pieces.append((stack[-1], None))
            if closing:
                self._close(stack, tag)
                continue
            if tag == "body" and self.open.get("body"):
                continue
            if tag == "html":
                continue
            if tag in ENDS_P:
                self._close(stack, "p", ("table", "td", "th", "button"))
            if tag in SAME_ENDS:
                for other in SAME_ENDS[tag][0].split():
                    self._close(stack, other, SAME_ENDS[tag][1])
            if tag in VOID:
                continue
            up = stack[-1]
            found = _attributes(rest) if rest and not rest.isspace() else {}
            drop = self.drop[up] or tag in DROPPED or self._hidden(tag, found)
            self.parent.append(up), self.tag.append(tag), self.drop.append(drop)
            self.label.append("" if drop else _label(tag, found.get("class", "")))
            node = len(self.tag) - 1
            if rest.endswith("/") and tag in ("svg", "path", "use", "iframe"):
                continue
            stack.append(node)
            self.open.setdefault(tag, []).append(len(stack) - 1)
            if tag not in INLINE:
                self.blocks.append(len(stack) - 1)
            if tag in RAW:
                end = _RAW_ENDS[tag].search(source, at)
                at = end.start() if end else size

    def _hidden(self, tag: str, found: dict[str, str]) -> bool:
        if tag == "header":  # of the page, not of the article
            return not self.open.get("article")
        if not found or tag == "body":
            return False
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in NOISE_ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        if tag in INLINE or tag in PROSE:
            return _advert(found.get("class", "") + " " + found.get("id", ""))
        return _noisy(tag, found.get("class", "") + " " + found.get("id", ""), bool(self.open.get("article")))

    def _close(self, stack: list[int], tag: str, scope: tuple[str, ...] = ()) -> None:
        """Closes the nearest open element of that tag, and what is open inside it; nothing if there is none, or something of ``scope`` stands before it."""
        if not (own := self.open.get(tag)):
            return
        if any((others := self.open.get(t)) and others[-1] > own[-1] for t in scope):
            return
        if tag in INLINE and self.blocks[-1] > own[-1]:  # an inline end doesn't close blocks
            return
        for _ in range(len(stack) - own[-1]):
            kind = self.tag[stack.pop()]
            self.open[kind].pop()
            if kind not in INLINE:
                self.blocks.pop()

    def path(self, node: int) -> str:
        """The labels from the page down to the element; empty for the page itself."""
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return ">".join(labels[::-1])

    def found(self, path: str) -> list[int]:
        """The elements at the path that aren't dropped. Each element keeps how many of the path's steps lead to it."""
        steps = path.split(">")
        depth, out = [0] * len(self.tag), []
        for i in range(1, len(self.tag)):
            up = depth[self.parent[i]]
            if up < 0 or self.drop[i] or up >= len(steps) or self.label[i] != steps[up]:
                depth[i] = -1
            else:
                depth[i] = up + 1
                if depth[i] == len(steps):
                    out.append(i)
        return out

    def scores(self) -> dict[int, float]:
        """Text of each container: all that stands directly in its blocks, half of what stands one container further down; text in links counts against it."""
        nearest, linked = [0] * len(self.tag), [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            nearest[i] = i if self.tag[i] in CONTAINERS else nearest[up]
            linked[i] = self.tag[i] == "a" or linked[up]
        out: dict[int, float] = {}
        for node, text in self.pieces:
            if text is None or self.drop[node] or not (n := len(text.strip())):
                continue
            worth = -0.5 * n if linked[node] else n
            own = nearest[node]
            out[own] = out.get(own, 0.0) + worth
            if own:
                up = nearest[self.parent[own]]
                out[up] = out.get(up, 0.0) + worth / 2
        return out

    def best(self) -> int:
        """The container with the best score, or the article (else the main part) around it; 0 is the page."""
        scores = self.scores()
        if not scores:
            return 0
        node = max(scores, key=lambda i: (scores[i], -i))
        for kind in ("article", "main"):
            up = node
            while up:
                if self.tag[up] == kind:
                    return up
                up = self.parent[up]
        return node

    def text(self, roots: set[int]) -> str:
        """The text under the roots, in page order: blocks trimmed, joined by one space."""
        inside = [i in roots for i in range(len(self.tag))]
        for i in range(1, len(self.tag)):
            inside[i] = (inside[i] or inside[self.parent[i]]) and not self.drop[i]
        parts = [" " if text is None else text for node, text in self.pieces if inside[node]]
        told = html.unescape("".join(parts))
        return " ".join(told.split() if not _SEPARATORS.search(told) else (w for w in _BLANKS.split(told) if w))

    def at(self, path: str | None) -> str:
        """The text at the path (of several articles the best one), or at the page's own best container if the path has none."""
        if path:
            roots = self.found(path)
            if len(roots) > 1 and self.tag[roots[0]] in ("article", "main"):
                scores = self.scores()
                roots = [max(roots, key=lambda i: (scores.get(i, 0.0), -i))]
            if roots and (found := self.text(set(roots))):
                return found
        return self.text({self.best()})


def host(url: str = "url"):
    """The host of a URL, lower-cased; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _decoded(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts(column)]


def _votes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 4 << 20):
        paths = []
        for source in _decoded(batch.column(1)):
            page = Page(source)
            paths.append(page.path(page.best()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 4 << 20):
        found = [Page(source).at(path) for source, path in zip(_decoded(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes, pages: each host's winning path, that of most pages; ties go to the smaller path. Pages without text don't vote."""
    votes = pages.select(host().alias("host"), "html").mapInArrow(_votes, "host string, path string")
    counted = votes.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("n"), "path")).alias("b"), F.sum("votes").alias("pages"))
    return best.select("host", F.col("b.path").alias("path"), (-F.col("b.n")).alias("votes"), "pages")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty pages give empty texts; repeated rows give theirs each; pages whose URL has no host share one.
    White space is that of Unicode (no-break spaces too); other control characters stay.
    Tag soup is read as browsers do in the main: unclosed paragraphs, list items and cells end where the next begins.
    Hosts are joined by broadcast only if their counted table is small, so the pages themselves don't move.
    """
    paths = saved(host_paths(pages).select(F.col("host").alias("_host"), "path"), "host-paths")
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    joined = rows.join(small(paths, 300), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    found = joined.mapInArrow(_texts, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
