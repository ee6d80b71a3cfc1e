r"""Main text of web pages by consensus paths of each host.

Every page is parsed once and its containers are scored by the running text in them, links counting against it. The
best container, or the article or main around it, or the lowest one around it with nearly all running text, gives its
generalised tag-class path as the page's vote; Spark counts the votes of each host and the path with
most pages wins. Every page is then extracted anew from the containers that the host's winning path names; a page
that has none uses its own best path.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever
they stand. Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one ``\n``.

Defined cases: null or empty html gives the empty text; a null url counts as the empty host; repeated rows give
repeated results; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts, written
from .urls import host_of

#: Elements by their role in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noscript template".split())
CONTAINERS = frozenset("body main article section div td center content".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside button select option input dialog menu script style noscript template iframe svg canvas object audio video map head title textarea".split())  # and a form that holds no article or main
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that mark boilerplate.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup login comment comments respond reply replies disqus sidebar sidebars aside rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs related recommended share sharing social popup modal overlay footer header masthead toolbar widget widgets pagination pager "
    "skip search form copyright".split()
)
#: Beginnings of such words.
DROPPED_STEMS = ("advert", "breadcrumb", "comment", "cookie", "footer", "newsletter", "sidebar", "sidenav", "sponsor", "subscri", "topnav")
#: Words that make a compound name a state or a topic of the element ("has-sidebar", "comments-open", "tag-search").
STATE_FIRST, STATE_LAST = frozenset("has no not with without category tag tagged".split()), frozenset("open closed enabled disabled".split())
SAFE_FROM_WORDS = frozenset(("html", "body", "main", "article"))
#: Share of a page's running text that the extracted container has where no article or main marks it.
NEARLY_ALL = 0.9
#: Characters of a path from which on it is written as a digest, so that deep pages do not hold long paths.
LONG_PATH = 200
#: An open element that the start of another ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an implied end does not reach beyond.
BARRIERS = frozenset("table td th ul ol dl div section article main body aside nav footer header form blockquote".split())
#: Elements that the end of a paragraph or list item does not reach beyond.
ITEM_BARRIERS = frozenset("table td article section body".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""", re.S)
_IN_TAG = re.compile(r"""=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _boilerplate(marks: str) -> tuple[bool, bool]:
    """Whether a class or id of ``marks`` is boilerplate as a whole, and whether a part of a compound one is."""
    whole = part = False
    for token in marks.split():
        words = [w for w in _WORDS.split(_CAMEL.sub("-", token).lower()) if w]
        if len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        found = [w in DROPPED_WORDS or w.startswith(DROPPED_STEMS) for w in words]
        whole |= bool(found) and all(found)
        part |= any(found)
    return whole, part


@lru_cache(maxsize=1024)
def _kinds(tag: str) -> tuple[str, ...]:
    """The names under which the place of an open element is kept: its own, and those of the barriers it is one of."""
    return tag, *[">"] * (tag in BARRIERS), *[">>"] * (tag in ITEM_BARRIERS)


def _step(path: str, label: str) -> str:
    """The path of a container inside ``path``: all tags and class words from the page down, or their digest if that is long."""
    whole = f"{path}/{label}" if path else label
    return whole if len(whole) <= LONG_PATH else "#" + hashlib.blake2b(whole.encode(), digest_size=16).hexdigest()


class Page:
    """Blocks of a page: each has its container, its text and how much of that stands in links."""

    def __init__(self, source: str) -> None:
        self.parents: list[int] = [-1]
        self.labels: list[str] = ["body"]
        self.paths: list[str] = [_step("", "body")]  # of the containers, from the page down
        self.depths: list[int] = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.doubts: list[int] = [-1]  # the parent of each element that a part of its class speaks against; 0 is the page
        self.holders: set[int] = set()  # those that stand directly round an article or main
        self._strict: set[int] = set()  # those that stay only if they hold the article or main
        self._doubts_of: list[int] = []  # for each block
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, container, dropped, in a link, doubt
        container, dropped, linked, doubt = 0, False, False, 0
        buffer: list[str] = []
        links, at, end = 0, 0, len(source)
        places: dict[str, list[int]] = {}  # of the open elements of each tag, and of the barriers
        last_quote = {q: source.rfind(q) for q in "\"'"}

        def place(tag: str) -> int:
            return found[-1] if (found := places.get(tag)) else -1

        def tag_end(at: int) -> tuple[str, int]:
            """The attributes of the tag that has its name up to ``at``, and the place after it."""
            if source.startswith(">", at):
                return "", at + 1
            begin = at
            while m := _IN_TAG.search(source, at):
                at = m.end()
                if m[0] == ">":
                    return source[begin : at - 1], at
                if last_quote[m[0][-1]] >= at:
                    at = source.index(m[0][-1], at) + 1
            return source[begin:], end

        def flush() -> None:
            nonlocal links
            if buffer:
                if text := " ".join("".join(buffer).split()):
                    self.blocks.append((container, text, links))
                    self._doubts_of.append(doubt)
                buffer.clear()
                links = 0

        def close(upto: int) -> None:
            nonlocal container, dropped, linked, doubt
            for tag, *_ in stack[upto:]:
                if tag not in INLINE:
                    flush()
                    break
            _, container, dropped, linked, doubt = stack[upto]
            for tag, *_ in stack[upto:]:
                for kind in _kinds(tag):
                    places[kind].pop()
            del stack[upto:]

        while at < end:
            m = _TAG.search(source, at)
            if not dropped and (stop := m.start() if m else end) > at:
                text = references.unescape(source[at:stop])
                buffer.append(text)
                if linked:
                    links += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            rest, at = tag_end(at)
            if m[1]:
                if tag == "br":
                    buffer.append(" ")
                if (found := place(tag)) > (place(">") if tag in INLINE else place(">>") if tag in ("p", "li") else -1):
                    close(found)
                continue
            if tag == "br" or tag in ("wbr", "img", "input"):
                if tag == "br" and not dropped:
                    buffer.append(" ")
                continue
            if tag not in INLINE:
                found = place("p")
                for ended in CLOSES.get(tag, ()):
                    found = max(found, place(ended))
                if found >= 0 and found >= place(">"):
                    close(found)
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = found.end() if found else end
                continue
            if tag in ("html", "body"):
                continue
            for kind in _kinds(tag):
                places.setdefault(kind, []).append(len(stack))
            stack.append((tag, container, dropped, linked, doubt))
            if tag == "a":
                linked = True
            words: list[str] = []
            whole = part = False
            if rest and "=" in rest or rest and "hidden" in rest:
                attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
                marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
                words = [w for w in _WORDS.split(_CAMEL.sub("-", marks).lower()) if w] if marks != " " else []
                if "hidden" in attributes or attributes.get("role", "").lower() in DROPPED_ROLES or attributes.get("aria-hidden") == "true":
                    dropped = True
                elif words:
                    whole, part = _boilerplate(marks)
            if tag in DROPPED or whole and tag not in SAFE_FROM_WORDS:
                dropped = True
            if (part or tag == "form") and not dropped and tag not in SAFE_FROM_WORDS:
                if tag in INLINE:
                    dropped = True
                else:
                    self.doubts.append(doubt)
                    doubt = len(self.doubts) - 1
                    if tag == "form":
                        self._strict.add(doubt)
            if tag in ("article", "main") and not dropped and not part:
                self.holders.add(doubt)
            if tag in CONTAINERS and not dropped:
                self.parents.append(container)
                self.labels.append(".".join([tag, *sorted(set(words))]))
                self.paths.append(_step(self.paths[container], self.labels[-1]))
                self.depths.append(self.depths[container] + 1)
                container = len(self.parents) - 1
        flush()

    def _worth_of_doubts(self, gone: set[int]) -> list[int]:
        """The running text in each doubtful element, and in the page first, without those that are gone."""
        worth = [0] * len(self.doubts)
        for (_, text, links), d in zip(self.blocks, self._doubts_of, strict=True):
            if d not in gone:
                worth[d] += max(0, len(text) - 2 * links)
        for d in range(len(self.doubts) - 1, 0, -1):
            worth[self.doubts[d]] += worth[d]
        return worth

    def _settle(self) -> None:
        """Drop the blocks of the doubtful elements, but for those that hold the article or main, or most running text."""
        if len(self.doubts) == 1:
            return
        worth = self._worth_of_doubts(set())
        depths = [0] * len(self.doubts)
        for d in range(1, len(self.doubts)):
            depths[d] = depths[self.doubts[d]] + 1
        kept = {0}
        if self.holders:  # the outermost; of equals the one with most text
            d = min(self.holders, key=lambda d: (depths[d], -worth[d], d))
            while d > 0:
                kept.add(d)
                d = self.doubts[d]
        gone = self._strict - kept
        for d in range(1, len(self.doubts)):
            if self.doubts[d] in gone:
                gone.add(d)
        worth = self._worth_of_doubts(gone)
        kept |= {d for d in range(1, len(self.doubts)) if 2 * worth[d] > worth[0]}
        self.blocks = [b for b, d in zip(self.blocks, self._doubts_of, strict=True) if d in kept]

    def scores(self) -> Counter:
        """Running text of each container: its own blocks in full, its children's by half; links count against it."""
        out: Counter = Counter()
        for container, text, links in self.blocks:
            worth = max(0, len(text) - 2 * links)
            out[container] += 2 * worth
            if self.parents[container] >= 0:
                out[self.parents[container]] += worth
        return out

    def vote(self) -> tuple[str, int] | None:
        """The best container's path and its score; the deeper, then the earlier one of equals."""
        scores = self.scores()
        if not scores:
            return None
        best = min(scores, key=lambda c: (-scores[c], -self.depths[c], c))
        return self.paths[self._lifted(best)], scores[best]

    def _lifted(self, best: int) -> int:
        """The article or main next around a container; where there is none, the lowest one around it with nearly all running text."""
        around = [best]
        while self.parents[around[-1]] >= 0:
            around.append(self.parents[around[-1]])
        for c in around:
            if self.labels[c].partition(".")[0] in ("article", "main"):
                return c
        worth = [0] * len(self.parents)
        for container, text, links in self.blocks:
            worth[container] += max(0, len(text) - 2 * links)
        for c in range(len(self.parents) - 1, 0, -1):
            worth[self.parents[c]] += worth[c]
        return next(c for c in around if worth[c] >= NEARLY_ALL * worth[0])

    def text(self, path: str | None) -> str:
        """The blocks under the containers that ``path`` names; under the page's own best where it names none."""
        inside = {c for c, p in enumerate(self.paths) if p == path} if path else set()
        if not inside and (own := self.vote()):
            inside = {c for c, p in enumerate(self.paths) if p == own[0]}
        for c in range(len(self.parents)):
            if self.parents[c] in inside:
                inside.add(c)
        return "\n".join(text for c, text, _ in self.blocks if c in inside)


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The winning path of each host: ``host, path``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pages_of, worth = Counter(), Counter()
        for host, source in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if found := Page(source).vote():
                pages_of[host, found[0]] += 1
                worth[host, found[0]] += found[1]
        keys = list(pages_of)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pages_of[k] for k in keys], pa.int64()), pa.array([worth[k] for k in keys], pa.int64())],
            ["host", "path", "pages", "worth"],
        )

    each = map_batches(pages.select(host_of(F.col(url_col)).alias("host"), html_col), run, "host string, path string, pages long, worth long")
    paths = each.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("worth").alias("worth"))
    return paths.groupBy("host").agg(F.max(F.struct("pages", "worth", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url, text, n_chars`` for every page.

    The winning paths are written first, so Spark knows their size and broadcasts them only below its threshold; above
    it, it joins by host and splits large hosts.
    """
    winners = written(votes(pages, html_col, url_col), "host-paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(winners, "host", "left").select("id", "url", "html", "path")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Page(source).text(path) for source, path in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return map_batches(rows, run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, `{url_col}` string, text string, n_chars long")
