"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold outside links; each page gives its host's
tag-class paths shares of one vote. The path with most votes is the host's; pages are then extracted again
from the containers on that path, or from their own best container where they have none on it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# A tag ends before the next one begins, and no part of the pattern gives back what it has read: time is linear in any markup.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)"
    r"((?:[^<>\"']++|<(?![a-zA-Z/!?])|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL,
)
# Elements nested deeper become neighbours of those at this depth.
DEEPEST = 64
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"'<>]+)")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed"}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr", "param"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul option select button".split()
)
# Elements that hold no article text, whatever their class; and those that hold none unless they wrap the page.
OUTSIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "head", "button", "select", "search", "svg"}
FORMS = {"form", "fieldset"}
# Their class words speak of the whole page.
WHOLE = {"html", "body", "main", "article"}
# Words of a class, id or role that name something else than the article.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription share sharing social "
    "sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "comment comments commentlist respond reply replies disqus discussion related recommended recommendations popup modal "
    "overlay widget widgets toolbar pagination pager login signup signin search skip paywall complementary contentinfo".split()
)
# Readers may write more than the author.
READERS = set("comment comments commentlist respond reply replies disqus discussion".split())
# A paragraph's end is implied by the next block; these also close an open element of their own kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
LISTS = {"ul", "ol", "dl", "table", "menu", "tbody", "thead", "tfoot"}
# What a container's text counts for the containers around it.
UPWARDS = (1.0, 0.75, 0.5)
# A container widens to one around it of which it has so much unlinked text.
WIDEN = 0.75
INNER = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figcaption", "tr"}


@dataclass
class Block:
    """A run of text: its containers' paths from the root, and how much of it is in links."""

    text: str
    containers: tuple[tuple[str, int], ...]
    linked: int
    # Elements around it that are left out unless they hold most of the page.
    doubts: tuple[int, ...] = ()


@dataclass
class _Open:
    tag: str
    outside: bool
    doubts: tuple[int, ...]
    path: str
    # The containers that it lies in, itself included.
    held: tuple[tuple[str, int], ...]


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    opened: int = 0

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].outside):
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw)

    def close_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                held = (self.stack[-1].held if self.stack else ()) or (("", 0),)
                self.blocks.append(Block(text, held, min(self.linked, len(text)), self.stack[-1].doubts if self.stack else ()))
        self.parts, self.linked = [], 0

    def pop_to(self, place: int) -> None:
        self.close_block()
        del self.stack[place:]

    def open(self, tag: str, attributes: str) -> None:
        self.close_block()
        kinds = {"p"} | CLOSES.get(tag, set())
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag in kinds:
                del self.stack[place:]
                break
            if self.stack[place].tag in LISTS:
                break
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else None
        names, hidden = _names(attributes) if attributes.strip() else ([], False)
        noise = set() if tag in WHOLE else _noise(names)
        outside = bool(above and above.outside) or hidden or tag in OUTSIDE or bool(noise & READERS)
        own = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names[0]})]) if names else tag
        self.opened += 1
        doubts = above.doubts if above else ()
        if len(self.stack) >= DEEPEST:
            above = self.stack[-2]
            self.stack.pop()
        if noise or tag in FORMS:
            doubts += (self.opened,)
        path, held = f"{above.path}/{own}" if above else own, above.held if above else ()
        self.stack.append(_Open(tag, outside, doubts, path, held if tag in INNER else (*held, (path, self.opened))))

    def close(self, tag: str) -> None:
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag == tag:
                self.pop_to(place)
                return
        self.close_block()


def _names(attributes: str) -> tuple[list[list[str]], bool]:
    """Class words, then id and role words; and whether the element is hidden."""
    classes, others, hidden = [], [], False
    for name, value, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), html.unescape(value.strip("\"'"))
        if name == "class":
            classes += value.lower().split()
        elif name in ("id", "role"):
            others += value.lower().split()
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return [classes, others], hidden


def _noise(names: list[list[str]]) -> set[str]:
    return {word for group in names for name in group for word in re.split(r"[^a-z]+", name) if word in NOISE}


def _kept(found: list[Block]) -> list[Block]:
    """The blocks without those of doubtful elements; one with more than half of the unlinked text wraps the page."""
    if not any(b.doubts for b in found):
        return found
    held: dict[int, int] = {}
    for block in found:
        for number in block.doubts:
            held[number] = held.get(number, 0) + len(block.text) - block.linked
    half = sum(len(b.text) - b.linked for b in found) / 2
    return [b for b in found if all(held[number] > half for number in b.doubts)]


def blocks(page: str) -> list[Block]:
    """The text blocks of a page that are in no excluded element, in page order."""
    state, at = _Page(), 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            state.text(page[at:])
            break
        state.text(page[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in RAW:
            if not tag[1]:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^<>]*+>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif name == "br":
            state.text(" ")
        elif name in BLOCKS or name == "svg":
            if tag[1]:
                state.close(name)
            else:
                state.open(name, tag[3])
        elif name == "a":
            state.links = max(0, state.links - 1) if tag[1] else 1
    state.close_block()
    return _kept(state.blocks)


def container_scores(found: list[Block]) -> dict[str, float]:
    """Shares of one vote for the paths of a page's containers."""
    scores: dict[str, float] = {}
    for block in found:
        worth = len(block.text) - block.linked
        for (path, _), share in zip(reversed(block.containers), UPWARDS):
            tag = _tag_of(path)
            scores[path] = scores.get(path, 0.0) + worth * share * (1.5 if tag in ("article", "main") else 1.0)
    total = sum(scores.values())
    return {path: score / total for path, score in scores.items()} if total > 0 else {}


def _tag_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def _widened(found: list[Block], inside: list[Block], path: str) -> tuple[list[Block], str]:
    """With the blocks beside the containers on ``path``, as a headline or lead, and the path that holds them.

    An article or main element is whole; html and body aren't widened to. Blocks that are mostly links stay out.
    """
    own = sum(len(b.text) - b.linked for b in inside)
    chosen, at = {id(b) for b in inside}, path
    if _tag_of(path) in WHOLE:
        return inside, path
    around = next(([p for p, _ in b.containers] for b in inside), [])
    around = around[: around.index(path)] if path in around else []
    for outer in reversed(around):
        if _tag_of(outer) in ("html", "body"):
            break
        more = [b for b in found if any(p == outer for p, _ in b.containers)]
        if own < WIDEN * sum(len(b.text) - b.linked for b in more):
            break
        beside = {id(b) for b in more if 2 * b.linked <= len(b.text)} - chosen
        if beside:
            chosen, at = chosen | beside, outer
        if _tag_of(outer) in WHOLE:
            break
    return [b for b in found if id(b) in chosen], at


def main_text(found: list[Block], path: str | None) -> tuple[str, str]:
    """The text of the containers on ``path``, or of the page's best one, with what stands beside it in a container
    of little else; and the path that was used."""
    inside = [b for b in found if any(p == path for p, _ in b.containers)] if path is not None else []
    if not inside:
        scores = container_scores(found)
        if not scores:
            return "\n\n".join(b.text for b in found), ""
        path = max(sorted(scores), key=scores.__getitem__)
        inside = [b for b in found if any(p == path for p, _ in b.containers)]
    inside, path = _widened(found, inside, path)
    return "\n\n".join(b.text for b in inside), path


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and for anything else."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, path, votes``: the winning path of every host; a tie goes to the path first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for name, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for path, share in container_scores(blocks(text.as_py() or "")).items():
                    votes[name, path] = votes.get((name, path), 0.0) + share
            keys = list(votes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(votes.values(), pa.float64())],
                ["host", "path", "votes"],
            )

    sent = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("html"))
    votes = sent.mapInArrow(run, "host string, path string, votes double").groupBy("host", "path").agg(
        # Whole numbers add up alike in any order.
        F.sum(F.round(F.col("votes") * 1_000_000).cast("long")).alias("votes")
    )
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("against"), "path")).alias("best"))
    return best.select("host", "best.path", (-F.col("best.against")).alias("votes"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, host, path`` for every row of ``pages``.

    Null and empty pages, and pages without article text, have an empty text. Blocks are joined by a blank
    line; character references are decoded and white space inside a block is one space. Other columns are not
    read; rows that share an id are extracted each for itself.
    """
    winners = written(host_paths(pages, url, page).select("host", "path"), "paths")
    sent = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host(F.col(url)).alias("host")
    ).join(winners, "host", "left")
    kept = [sent.schema[c] for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for text, path in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True):
                found, used = main_text(blocks(text.as_py() or ""), path)
                texts.append(found)
                paths.append(used)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    batch.column("host"),
                    pa.array(paths, pa.string()),
                ],
                ["page_id", "url", "text", "n_chars", "host", "path"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return sent.mapInArrow(run, f"{fields}, text string, n_chars long, host string, path string")
