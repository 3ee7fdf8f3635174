"""Main text of web pages, from the standard library's streaming parser.

Events build lines: a block element begins a new line, inline elements don't. Elements that never hold article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments: by tag, role, or words
of class and id) are passed over. Each line has its text-to-tag ratio, characters per tag. The ratios are smoothed by
a Gaussian and split in two clusters by the threshold that leaves least variance within (for two clusters of numbers,
exactly k-means). Each line has a container: the article or main element it stands in, else the block element around
its own. Where a page marks articles, the lines of the upper cluster vote for theirs with their characters; all lines
of the one that wins are content, and those of all others, but for teasers: articles that stand in what is passed over,
or that are links for the most part. Else the content goes from the first to the last line of all containers with a
line of the upper cluster, short lines and what stands between them too, with headings just before it. Where the
container is the page's whole body, the content begins and ends with lines of the upper cluster, and goes on from there
over the body's own lines that aren't links for the most part.

Edge cases: null and empty pages, and pages without text, give an empty text. An unclosed element ends with the page,
or where an article begins. Equal ratios form one cluster, the upper. Rows are independent: null or repeated ids and
other columns change nothing."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asserta.llm._common import chunks

SIGMA = 1.0
#: Kinds of elements, roles, and words of class or id.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = set("script style noscript template head title nav header footer aside form button select textarea iframe svg canvas object dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside header masthead topbar footer foot bottombar "
    "comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe subscription signup login search searchform "
    "share sharing social related recommended widget widgets toolbar pagination pager copyright legal disclaimer skip".split()
)
COMMENTS = set("comment reply".split())  # what makes an article a reader's
BODY = set("content main maincontent body".split())
TEXT_ROOT = ("article", "main")
HEADING = re.compile("h[1-6]$")


def passed_over(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in SKIPPED:
        return True
    if tag in ("html", "body") or HEADING.match(tag):
        return False
    said = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
    if not said:
        return False
    words = set(re.split(r"[^a-z0-9]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", f"{said.get('class', '')} {said.get('id', '')}").lower()))
    if tag in TEXT_ROOT:
        return bool(words & COMMENTS)
    return said.get("role", "").lower() in ROLES or bool(words & WORDS) and not words & BODY


class Line:
    __slots__ = ("block", "chars", "linked", "parts", "tags")

    def __init__(self, block: int):
        self.block = block
        self.parts: list[str] = []
        self.tags = self.chars = self.linked = 0


class Lines(HTMLParser):
    """The lines of a page, each with the number of the block element around it. Of each block element (0 is the
    page): its tag, the one around it, and the outermost article and main element it is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, passed over, number (0 for inline elements)
        self.places: dict[str, list[int]] = defaultdict(list)  # by tag, where it is in `open`
        self.hidden = self.tags = 0
        self.tag, self.around, self.article, self.main = ["page"], [0], [0], [0]
        self.blocks = [0]  # the open ones
        self.teasers: set[int] = set()  # articles that stood in what is passed over
        self.lines: list[Line] = []
        self.line: Line | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        over = passed_over(tag, attrs)
        teaser = False
        if tag in TEXT_ROOT and self.hidden and not over:
            # An article ends what was passed over and left open around it, unless that is itself in an article
            at = next(i for i, (_, hides, _) in enumerate(self.open) if hides)
            if not any(t in TEXT_ROOT for t, _, _ in self.open[:at]):
                self._close(at)
                teaser = True
        if tag in BLOCK:
            self.line = None
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and self.open and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)
        self.hidden += over
        number = 0
        if tag in BLOCK:
            number, outer = len(self.tag), self.blocks[-1]
            self.tag.append(tag)
            self.around.append(outer)
            self.article.append(self.article[outer] or number * (tag == "article"))
            self.main.append(self.main[outer] or number * (tag == "main"))
            self.blocks.append(number)
            if teaser:
                self.teasers.add(number)
        self.places[tag].append(len(self.open))
        self.open.append((tag, over, number))

    def _close(self, at: int) -> None:
        for tag, over, number in self.open[at:]:
            self.places[tag].pop()
            self.hidden -= over
            if number:
                self.blocks.pop()
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        if tag in BLOCK:
            self.line = None
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(self.blocks[-1])
            self.line.tags = self.tags
            self.tags = 0
            self.lines.append(self.line)
        self.line.parts.append(data)
        self.line.chars += len(data)
        self.line.linked += len(data) * bool(self.places.get("a"))


def upper_cluster(ratios: np.ndarray) -> np.ndarray:
    """Which of the smoothed ratios are in the upper of two clusters."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratios, reach, "edge"), kernel / kernel.sum(), "valid")
    order = np.sort(smooth)
    n = len(order)
    if n < 2 or order[0] == order[-1]:
        return np.ones(n, bool)
    k = np.arange(1, n)
    low = np.cumsum(order)[:-1]
    between = (low / k - (order.sum() - low) / (n - k)) ** 2 * k * (n - k)
    return smooth >= order[between.argmax() + 1]


def spanned(parser: Lines, upper: np.ndarray, containers: list[int]) -> list[int]:
    """The lines from the first to the last of all containers that lines of the upper cluster stand in."""
    lines, n = parser.lines, len(parser.tag)
    first, last = [len(lines)] * n, [-1] * n  # by block, of the lines in it
    for i, x in enumerate(lines):
        first[x.block] = min(first[x.block], i)
        last[x.block] = i
    for k in range(n - 1, 0, -1):  # a block's number is greater than that of the one around it
        outer = parser.around[k]
        first[outer], last[outer] = min(first[outer], first[k]), max(last[outer], last[k])
    begin, end = len(lines), -1
    body = [parser.tag[k] in ("page", "html", "body") for k in containers]
    for i, k in enumerate(containers):
        if upper[i]:
            begin, end = min(begin, i if body[i] else first[k]), max(end, i if body[i] else last[k])

    def own(i: int) -> bool:
        return body[i] and 2 * lines[i].linked < lines[i].chars

    while begin and own(begin - 1):
        begin -= 1
    while end + 1 < len(lines) and own(end + 1):
        end += 1
    while begin and HEADING.match(parser.tag[lines[begin - 1].block]):
        begin -= 1
    return list(range(begin, end + 1))


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    upper = upper_cluster(np.array([x.chars / (x.tags + 1) for x in lines]))
    votes: dict[int, int] = defaultdict(int)

    def container(x: Line) -> int:
        return parser.article[x.block] or parser.main[x.block] or parser.around[x.block]

    for x, up in zip(lines, upper):
        if up:
            votes[container(x)] += x.chars
    marked = [n for x in lines if parser.tag[n := container(x)] in TEXT_ROOT]
    if marked:  # only marked text is an article
        best = max(marked, key=lambda n: (votes.get(n, 0), -n))
        chars, linked = defaultdict(int), defaultdict(int)
        for x in lines:
            chars[container(x)] += x.chars
            linked[container(x)] += x.linked
        roots = {n for n in marked if n == best or parser.tag[n] == "article" and n not in parser.teasers and 2 * linked[n] < chars[n]}
        inside = [False]
        for n in range(1, len(parser.tag)):
            inside.append(n in roots or inside[parser.around[n]])
        kept = [i for i, x in enumerate(lines) if inside[x.block]]
    else:
        kept = spanned(parser, upper, [container(x) for x in lines])
    return " ".join(t for i in kept if (t := " ".join("".join(lines[i].parts).split())))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of pages, then text and n_chars. pages has a column html; `keep` has neither new name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, piece in chunks(batch.column(batch.num_columns - 1)):
                texts = [main_text(x) for x in piece.to_pylist()]
                rest = [batch.column(i).slice(start, len(piece)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kept = [F.col(f"`{c}`") for c in keep]
    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(*kept, F.col("html").alias("html_read")).mapInArrow(run, schema)
