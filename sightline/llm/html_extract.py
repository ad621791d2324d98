"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read once into a sequence of items: words (by where they stand: text, heading, list, link) and tags (by
kind). Words score positive and tags negative, with weights learned from labelled pages; elements that never hold
main text (navigation, forms, adverts, comments and so on, told by name, role, class or id) are one negative item
each, whatever is in them. A linear scan finds the contiguous region of the highest sum, the earlier and shorter of
equal ones; the text of its blocks is the result. The weights come from pages made by page(), whose main region is
known, by a perceptron over regions: the region found loses and the true one gains its counts, words never falling
below LEAST and tags never rising above -LEAST.

Defined cases: null html is empty; a page without a word outside such elements has empty text; unclosed elements end
with their parents, comments, scripts and quotes that never end with the page; white space is what Unicode calls so;
repeated rows are judged each by itself; further columns are not read; an empty table gives no rows. Time and memory
are linear in the page.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import map_batches, slices

LEAST = 0.01
RESULT = "page_id long, url string, text string, n_chars long"

# Names of HTML elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = set(
    "head title script style noscript template iframe object embed svg canvas math select button textarea dialog menu map audio video nav footer aside form search".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY = {  # an open element of the first kind ends where one of the others begins
    "p": BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "head"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
KINDS = {
    "p": "block", "blockquote": "block", "pre": "block", "figure": "block", "figcaption": "block", "address": "block", "dd": "block", "dt": "block", "summary": "block", "center": "block", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "li": "listing", "ul": "listing", "ol": "listing", "dl": "listing",
    "a": "link", "article": "main", "main": "main", "body": "page", "html": "page", "header": "part", "section": "part", "div": "part", "hr": "block", "img": "inline",
    "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "tfoot": "table",
}
#: Words of class, id and role that name what is no main text, whole or as a beginning.
NOISE = re.compile(
    r"(?:ads?|adbox|banner|sponsor\w*|promo\w*|advert\w*|sidebar\w*|sidenav|rail|nav\w*|menu\w*|breadcrumbs?|footer\w*|masthead|topbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|pop(?:up|over)\w*|modal|overlay"
    r"|newsletter|subscri\w+|signup|login|share|sharing|social\w*|comment\w*|respond|repl(?:y|ies)|disqus\w*|related\w*|recommend\w*|teasers?|widgets?|pagination|pager|search\w*|toolbar|skip|copyright|disclaimer|complementary|contentinfo|navigation|dialog)\Z"
)
TALK = re.compile(r"(?:comment\w*|respond|repl(?:y|ies)|disqus\w*|related\w*|recommend\w*|teasers?|sponsor\w*|promo\w*|ads?|advert\w*)\Z")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"""["'>]""")

ENDING = set().union(*CLOSED_BY.values())
SPACED = BLOCKS | {"br"}
UNSEEN = RAW | {"head", "noscript", "template", "meta", "link", "base"}
WITH = re.compile(r"(?:has|with|without|no)[-_]\w+")

#: What the perceptron begins with; words within an article or main element end in _in.
START = {
    "text": 1.0, "heading": 1.0, "list": 1.0, "linked": 0.1, "text_in": 1.0, "heading_in": 1.0, "list_in": 1.0, "linked_in": 1.0,
    "block": -0.1, "head": -0.1, "listing": -0.1, "link": -0.1, "inline": -0.02, "table": -0.1, "part": -0.5, "main": -1.0, "page": -1.0, "skip": -0.5,
}
WORDS = {"text", "heading", "list", "linked", "text_in", "heading_in", "list_in", "linked_in"}


def tags(html: str):
    """(text, name, closing, attributes) in order: a stretch of text, and the tag that ends it (name None: the end)."""
    at, begin, n, quotes = 0, 0, len(html), {'"': True, "'": True}
    parts: list[str] = []
    while True:
        at = html.find("<", at)
        if at < 0:
            parts.append(html[begin:])
            yield "".join(parts), None, False, ""
            return
        if html.startswith("<!--", at):
            parts.append(html[begin:at])
            end = html.find("-->", at + 4)
            at = begin = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            parts.append(html[begin:at])
            end = html.find(">", at)
            at = begin = n if end < 0 else end + 1
            continue
        found = TAG.match(html, at + 1)
        if not found:
            if html.startswith("</", at):  # a bogus comment
                parts.append(html[begin:at])
                end = html.find(">", at)
                at = begin = n if end < 0 else end + 1
            else:
                at += 1
            continue
        end = found.end()
        while True:
            stop = QUOTE.search(html, end)
            if stop is None:
                end = n
                break
            if stop[0] == ">":
                end = stop.start()
                break
            closed = html.find(stop[0], stop.end()) if quotes[stop[0]] else -1
            quotes[stop[0]] = closed >= 0
            if closed < 0:
                end = html.find(">", stop.end())
                end = n if end < 0 else end
                break
            end = closed + 1
        name = found[2].lower()
        yield "".join(parts) + html[begin:at], name, bool(found[1]), html[found.end() : end]
        parts = []
        at = begin = min(n, end + 1)
        if name in RAW and not found[1]:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = begin = close.start() if close else n


def names_of(attributes: str) -> set[str]:
    """The words of an element's class, id and role, without what it says it has, has not, or stands with."""
    said = " ".join("".join(found).lower() for found in NAMED.findall(attributes))
    return set(re.split(r"[^a-z0-9]+", WITH.sub(" ", said)))


def skipped(name: str, words: set[str], attributes: str, inside: bool) -> bool:
    """Whether an element holds no main text; inside: within an article or main element."""
    if name in SKIPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    noise = TALK if name == "article" else NOISE
    return bool(HIDDEN.search(attributes)) or any(noise.match(w) for w in words)


class Page:
    """One page's items: kinds, counts and the block of each stretch of words."""

    def __init__(self, html: str):
        self.kinds: list[str] = []
        self.counts: list[int] = []
        self.texts: list[str | None] = []
        self.blocks: list[int] = []
        self.block = 0
        self.open: list[tuple | None] = []  # open elements (name, holds no main text, may hold articles of others); None: closed before its parent
        self.at: dict[str, list[int]] = {}  # where the open elements of a name stand
        self.solid: list[int] = []  # where those stand that others can end
        self.skip = self.talks = self.inside = self.heads = 0  # open elements of those kinds
        for text, name, closing, attributes in tags(html):
            if text and not self.skip:
                self.words(text)
            if name is None:
                break
            if name in BLOCKS and not self.skip:
                self.block += 1
            if closing:
                self.closed(name)
            else:
                self.opened(name, attributes)

    def opened(self, name: str, attributes: str) -> None:
        if name in ENDING:
            while self.solid and name in CLOSED_BY.get(self.open[self.solid[-1]][0], ()):
                self.cut(self.solid[-1])
        if name in ("article", "main") and self.skip and not self.talks:
            while self.skip:  # an element that never closed does not swallow the article
                self.cut(len(self.open) - 1)
            self.block += 1
        words = names_of(attributes) if attributes else set()
        off = skipped(name, words, attributes, self.inside > 0)
        if not self.skip and name not in UNSEEN:
            self.item(name, off)
        if name in VOID:
            return
        if name in BLOCKS or name in CLOSED_BY:
            self.solid.append(len(self.open))
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, off, off and (name in ("aside", "dialog") or any(TALK.match(w) for w in words))))
        self.count(self.open[-1], 1)

    def closed(self, name: str) -> None:
        at, before = self.at.get(name), self.skip
        if not at or name not in BLOCKS and self.solid and at[-1] < self.solid[-1]:
            return  # nothing of that name is open, or only around an open block
        if name in BLOCKS or name in CLOSED_BY:
            self.cut(at[-1])
        else:
            place = at.pop()
            self.count(self.open[place], -1)
            self.open[place] = None
        if not before:
            self.item(name, False)
        elif not self.skip and name in BLOCKS:
            self.block += 1

    def cut(self, size: int) -> None:
        """Close all that is open beyond the first size elements."""
        while len(self.open) > size:
            gone = self.open.pop()
            if gone:
                self.at[gone[0]].pop()
                self.count(gone, -1)
        while self.solid and self.solid[-1] >= size:
            self.solid.pop()

    def count(self, element: tuple[str, bool, bool], by: int) -> None:
        name, off, talk = element
        self.skip += off * by
        self.talks += talk * by
        self.inside += (name in ("article", "main")) * by
        self.heads += (KINDS.get(name) == "head") * by

    def item(self, name: str, off: bool) -> None:
        self.kinds.append("skip" if off else KINDS.get(name, "part" if name in BLOCKS else "inline"))
        self.counts.append(1)
        self.texts.append(" " if name in SPACED else None)
        self.blocks.append(self.block)

    def words(self, text: str) -> None:
        text = unescape(text)
        kind = "linked" if self.at.get("a") else "heading" if self.heads else "list" if self.at.get("li") else "text"
        self.kinds.append(kind + "_in" if self.inside else kind)
        self.counts.append(len(text.split()))
        self.texts.append(text)
        self.blocks.append(self.block)

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First and last item of the best region; (0, -1) if none scores."""
        best, found, total, begin = 0.0, (0, -1), 0.0, 0
        for i, (kind, count) in enumerate(zip(self.kinds, self.counts, strict=True)):
            if total <= 0:
                total, begin = 0.0, i
            total += weights[kind] * count
            if total > best:
                best, found = total, (begin, i)
        return found

    def text(self, region: tuple[int, int]) -> str:
        """The text of a region's blocks; line breaks are white space within their block, cells are blocks."""
        out: dict[int, list[str]] = {}
        for i in range(region[0], region[1] + 1):
            if self.texts[i] is not None:
                out.setdefault(self.blocks[i], []).append(self.texts[i])
        said = (" ".join("".join(parts).split()) for parts in out.values())
        return "\n".join(block for block in said if block)

    def sums(self, region: tuple[int, int]) -> dict[str, int]:
        found = dict.fromkeys(START, 0)
        for i in range(region[0], region[1] + 1):
            found[self.kinds[i]] += self.counts[i]
        return found


def page(rng: random.Random) -> tuple[str, str]:
    """A made page and the main text that it is labelled with."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    prose = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + "."
    links = lambda low, high: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (word() for _ in range(rng.randint(low, high))))
    blocks, body = [prose(1, 8)], []
    heading = blocks[0]
    for _ in range(rng.choice((1, 1, 2, 4, 8))):
        kind, said = rng.random(), prose(1, rng.choice((4, 20, 80)))
        if kind < 0.12:
            items = [prose(1, 6) for _ in range(rng.randint(2, 5))]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            blocks += items
        elif kind < 0.2:
            body.append(f"<h2>{said}</h2>")
            blocks.append(said)
        elif kind < 0.3:
            a, b = prose(1, 8), word()
            body.append(f'<p>{a} <a href="/{b}">{b}</a> {said}</p>')
            blocks.append(f"{a} {b} {said}")
        elif kind < 0.4:
            body.append(f"<blockquote><p><em>{said}</em></p></blockquote>")
            blocks.append(said)
        elif kind < 0.5:
            body.append(f"<p><b>{said}<br>")
            blocks.append(said)
        else:
            body.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<figure><figcaption>{}</figcaption></figure>")).format(said))
            blocks.append(said)
        if rng.random() < 0.1:
            body.append(rng.choice((f'<div class="ad">{prose(3, 30)}</div>', f"<aside><p>{prose(3, 30)}</p></aside>", f"<script>var {word()} = '<p>{word()}</p>';</script>")))
    plain = lambda: f"<div>{''.join(f'<div><a href=/{w}>{w} {w}</a></div>' for w in (word() for _ in range(rng.randint(2, 6))))}</div>"
    before = [f"<nav><ul>{links(2, 8)}</ul></nav>", f"<header><h2>{word()}</h2><p>{prose(1, 8)}</p></header>", f'<div class="cookie-notice">{prose(5, 30)}</div>', f'<div class="ad">{prose(2, 20)}</div>', f"<form><label>{word()}</label><input name=q></form>", f'<ul class="menu">{links(2, 8)}</ul>', plain()]
    after = [f'<section class="comments"><h3>{word()}</h3><div><p>{prose(5, 90)}</p></div></section>', f'<div id="sidebar"><p>{prose(3, 20)}</p><ul>{links(2, 5)}</ul></div>', f"<aside><p>{prose(3, 30)}</p></aside>", f"<footer>&copy; {word()} &middot; {prose(2, 15)}</footer>", f'<div class="related-posts"><ul>{links(2, 6)}</ul></div>', plain(), f"<div><p>{prose(2, 5)}</p></div>"]
    begin, end = rng.choice((("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="wrap"><article class="post">', "</article></div>"), ('<div id="content"><div>', "</div></div>")))
    top = "".join(rng.sample(before, rng.randint(1, 4)))
    bottom = "".join(rng.sample(after, rng.randint(1, 4)))
    html = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{heading}</title><style>p{{margin:0}}</style></head><body>{top}{begin}<h1>{heading}</h1>{''.join(body)}{end}{bottom}</body></html>"
    return html, "\n".join(blocks)


def truth(read: Page, text: str) -> tuple[int, int]:
    """The items of a made page that its label covers: from the words of its heading to the last of its last block."""
    first, last = text.partition("\n")[0], text.rpartition("\n")[2].split()[-1]
    said = [(i, t.strip()) for i, (t, k) in enumerate(zip(read.texts, read.kinds, strict=True)) if k in WORDS and t.strip()]
    return next(i for i, t in said if t == first), max(i for i, t in said if t.split()[-1] == last)


@lru_cache(maxsize=4)
def learn(pages: int = 600, rounds: int = 12, seed: int = 13) -> dict[str, float]:
    """Weights of the kinds of items, from made pages: averaged over the perceptron's steps."""
    rng, weights = random.Random(seed), dict(START)
    made = [page(rng) for _ in range(pages)]
    examples = [(read, truth(read, text), text) for html, text in made for read in [Page(html)]]
    total, steps = dict.fromkeys(START, 0.0), 0
    for _ in range(rounds):
        for read, region, text in examples:
            found = read.region(weights)
            if found != region and read.text(found) != text:
                gain, loss = read.sums(region), read.sums(found)
                size = 1 + sum(abs(gain[k] - loss[k]) for k in START)
                for k in START:
                    moved = weights[k] + (gain[k] - loss[k]) / size
                    weights[k] = max(LEAST, moved) if k in WORDS else min(-LEAST, moved)
            steps += 1
            for k in START:
                total[k] += weights[k]
    return {k: v / steps for k, v in total.items()}


def main_text(html: str | None, weights: dict[str, float]) -> str:
    read = Page(html or "")
    return read.text(read.region(weights))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = learn()
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))

    def make():
        def work(batch: pa.RecordBatch):
            for cut in slices(batch, "html"):
                texts = [main_text(html, weights) for html in cut.column("html").to_pylist()]
                yield {"page_id": cut.column("page_id"), "url": cut.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_batches(rows, RESULT, make)
