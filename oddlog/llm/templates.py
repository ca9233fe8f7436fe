"""Main text of web pages by template deduction from same-host pages.

* Tokens are the elements of a page, named by their path from the root (tags with their class), and every page gives
  each token a count.
* Tokens of a host with the same counts on the same pages, its occurrence vector, form an equivalence class. Vectors
  are compared as digests that are summed up over pages, so a host of any size is one aggregate per token.
* A class is valid if it has at least ``TOKENS`` tokens and ``PAGES`` pages. Valid classes are nested by their paths and
  make up the host's template; what lies between template tokens are slots.
* The host's main slot is the template element that holds the article: an ``article`` or ``main`` element before others,
  then the one with the most text outside links; never a menu, header, footer, sidebar, notice, advert, form or comment
  part, by its tag or the words of its class and id.
* Words about the layout (``with-sidebar``, ``social-article``) may also stand on what surrounds the article. A page that
  would have no text is therefore read again without them on its ``article`` and ``main`` elements and those around them.
* The slot is extracted from each page without such parts inside it. A page that has no such slot, or is of a host
  without a valid class, is judged by the same order among its own elements.

White space within a block becomes one space, character references are decoded, blocks are joined by a line break. Null
and empty pages have empty texts. Unclosed and misplaced tags are tolerated as browsers do; scripts, styles and comments
hold no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import nested, slices, stage, text_batches, unnested

TOKENS = 3
PAGES = 3
SMALL_ROWS = 100_000
SMALL_BYTES = 16 << 20

MARKUP = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|button|object|canvas|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
# Elements of the public HTML standard.
HIDDEN = set("script style noscript template svg iframe textarea select button object canvas title".split())
BLOCKS = set(
    "html body article main section div nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th"
    " p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr fieldset details summary caption dialog center".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "li"}
ASIDE = {"nav", "footer", "aside", "form", "dialog"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo notice notices cookie cookies consent"
    " comment comments reply replies discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header"
    " masthead share sharing social related newsletter subscribe popup modal widget pagination pager login search".split()
)
NO_LAYOUT = set(  # of these, words that never stand around an article
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent"
    " comment comments reply replies discussion popup modal pagination pager login".split()
)
TEXTUAL = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")  # hold text, but are no place for an article
ROOMS = {"article": 3, "main": 2}


class Element:
    """``aside`` is 2 in parts that are surely no article text, 1 in those that words about the layout name."""

    __slots__ = ("tag", "path", "aside", "room")

    def __init__(self, tag: str, path: str, aside: int, room: int):
        self.tag, self.path, self.aside, self.room = tag, path, aside, room


def opened(tag: str, attributes: str, parent: Element | None, trusted: bool = False) -> Element:
    """An element below ``parent``; whether it is, or lies in, a part that is no article text.

    With ``trusted``, words about the layout do not count on an article or main element and those around it.
    """
    label, words, role = tag, [], ""
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if name.lower() == "role":
            role = value
        else:
            words += re.split(r"[^a-z0-9]+", value)
            if name.lower() == "class":
                label += "." + ".".join(value.split())
    room = max(ROOMS.get(tag, 0), ROOMS.get(role, 0))
    inside = parent.room if parent else 0
    header = tag == "header" and inside < 2  # an article's own header holds its headline
    aside = parent.aside if parent else 0
    if tag in ASIDE or header:
        aside = 2
    elif tag not in ("html", "body"):
        aside = max(aside, 2 if not NO_LAYOUT.isdisjoint(words) else 1 if not ASIDE_WORDS.isdisjoint(words) else 0)
    if trusted and aside == 1 and (ROOMS.get(tag) or ROOMS.get(role)):
        aside = 0
    return Element(tag, f"{parent.path}/{label}" if parent else label, aside, max(room, inside))


def blocks(page: str, trusted: bool = False):
    """Text blocks of a page: (elements around it, text, text in links, is new block), and the counts of all elements."""
    stack: list[Element] = []
    counts: Counter = Counter()
    found = []
    text: list[str] = []
    linked: list[str] = []
    link = 0

    def flush():
        joined = "".join(text)
        if joined.strip():
            found.append((tuple(stack), joined, "".join(linked)))
        text.clear()
        linked.clear()

    at, end = 0, len(page)
    while at < end:
        mark = MARKUP.search(page, at)
        stop = mark.start() if mark else end
        if stop > at:
            text.append(page[at:stop])
            if link:
                linked.append(page[at:stop])
        if not mark:
            break
        at = mark.end()
        hidden, closing, tag, attributes = mark.group(1), mark.group(2), mark.group(3), mark.group(4)
        if hidden:
            if not mark.group().endswith("/>"):
                close = re.compile(rf"</{hidden}\s*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                if any(e.tag == tag for e in stack):
                    while stack.pop().tag != tag:
                        pass
                continue
            if tag == "hr":
                continue
            if tag in CLOSES_P and stack and stack[-1].tag == "p":
                stack.pop()
            if tag in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1].tag == tag:
                stack.pop()
            element = opened(tag, attributes, stack[-1] if stack else None, trusted)
            stack.append(element)
            counts[element.path] += 1
    flush()
    return found, counts


def tidy(raw: str) -> str:
    """Character references decoded, white space as one space."""
    return " ".join(html.unescape(raw).split())



def tokens_of(page: str) -> list[dict]:
    """Every element path of a page with its count, and the size of the text in it that is not in links."""
    found, counts = blocks(page)
    mass: Counter = Counter()
    aside = set()
    for elements, text, linked in found:
        size = len(text) - 2 * len(linked)
        for path in {e.path for e in elements}:
            mass[path] += size
        aside.update(e.path for e in elements if e.aside)
    return [{"path": p, "n": n, "mass": mass[p], "aside": p in aside} for p, n in counts.items()]


def best_slot(found) -> str | None:
    """The path of a page's own main element: article, main, then the one with the most text, the innermost of equals.

    None stands for the whole page, where text lies outside all containers.
    """
    mass: Counter = Counter()
    rooms: dict[str, int] = {"": 0}
    for elements, text, linked in found:
        if not (elements and elements[-1].aside):
            mass[""] += len(text) - 2 * len(linked)
        for element in elements:
            if not element.aside:
                mass[element.path] += len(text) - 2 * len(linked)
                rooms[element.path] = ROOMS.get(element.path.rsplit("/", 1)[-1].split(".")[0], 0)
    containers = [p for p in mass if p.rsplit("/", 1)[-1].split(".")[0] not in TEXTUAL]
    return max(containers, key=lambda p: (rooms[p], mass[p], len(p), p), default=None) or None


def main_text(page: str, slot: str | None) -> str:
    """The text of the host's main slot in a page, or of the page's own best element."""
    found, counts = blocks(page)
    if slot not in counts:
        slot = best_slot(found)
    text = text_in(found, slot)
    if not text:
        found, _ = blocks(page, trusted=True)
        found = [b for b in found if b[0] and b[0][-1].room]
        text = text_in(found, best_slot(found)) if found else ""
    return text


def text_in(found, slot: str | None) -> str:
    """The text of a slot, or of the whole page, without the parts that are no article text."""
    lines = []
    for elements, text, _ in found:
        inside = slot is None or any(e.path == slot for e in elements)
        if inside and not (elements and elements[-1].aside):
            lines.append(tidy(text))
    return "\n".join(line for line in lines if line)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def tokens(pages: Column) -> Column:
    kind = pa.list_(pa.struct([("path", pa.string()), ("n", pa.int32()), ("mass", pa.int64()), ("aside", pa.bool_())]))

    @F.arrow_udf("array<struct<path:string,n:int,mass:long,aside:boolean>>")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([tokens_of(p) for part in slices(column) for p in part], kind)

    return found(pages)


def template(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Tokens of the valid equivalence classes: (host, path, class, tokens, pages, mass, aside).

    The digest of an occurrence vector is the sum of hashes of (page, count). Pages are told apart by their address and
    content; pages equal in both count alike for all their tokens, and each of them counts.
    """
    text_batches(pages.sparkSession)
    page = F.xxhash64(url_col, html_col).alias("page")
    seen = pages.select(host(F.col(url_col)).alias("host"), page, F.explode(tokens(F.col(html_col))).alias("t"))
    per_token = seen.groupBy("host", F.col("t.path").alias("path")).agg(
        F.sum(F.xxhash64("page", "t.n").cast("decimal(20,0)")).alias("vector"),  # a decimal sum never overflows
        F.count("*").alias("pages"),
        F.sum("t.n").alias("n"),
        F.sum("t.mass").alias("mass"),
        F.max("t.aside").alias("aside"),
    )
    alike = ["host", "vector", "pages", "n"]
    members = F.collect_list(F.struct("path", "mass", "aside")).alias("members")
    classes = per_token.groupBy(*alike).agg(F.count("*").alias("tokens"), members)
    valid = classes.where((F.col("tokens") >= TOKENS) & (F.col("pages") >= PAGES))
    nested = valid.select("host", F.col("vector").alias("class"), "tokens", "pages", F.explode("members").alias("m"))
    return nested.select("host", "m.path", "class", "tokens", "pages", "m.mass", "m.aside")


def main_slots(tokens: DataFrame) -> DataFrame:
    """(host, slot): the template element that holds the article."""
    last = F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?$", 1)
    room = F.create_map(*(F.lit(x) for pair in ROOMS.items() for x in pair))
    named = tokens.where(~F.col("aside")).withColumn("room", F.coalesce(room[last], F.lit(0)))
    named = named.where(~last.isin(*TEXTUAL, "html"))
    best = F.max_by("path", F.struct("room", "mass", F.length("path").alias("depth"), "path"))
    return named.groupBy("host").agg(best.alias("slot"))


def checked(side: DataFrame, label: str, *texts: str) -> DataFrame:
    """A staged join side, marked for broadcasting if its rows and bytes are few; otherwise it is joined by shuffle."""
    staged = stage(side, label)
    rows, size = staged.agg(F.count("*"), F.sum(sum((F.octet_length(t) for t in texts), F.lit(0)))).first()
    return F.broadcast(staged) if rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else staged


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``pages`` with their main text in ``out_col`` (replaced if it exists). Repeated rows each get theirs."""
    slots = checked(main_slots(template(pages, url_col, html_col)), "slots", "host", "slot")

    @F.arrow_udf("string")
    def text(column: pa.Array, slot: pa.Array) -> pa.Array:
        known = slot.to_pylist()
        rows = [p for part in slices(column) for p in part]
        return pa.array([main_text(p, s) for p, s in zip(rows, known)], pa.string())

    named = pages.select(nested(pages), host(F.col(url_col)).alias("at"), F.col(html_col).alias("page"))
    joined = named.join(slots, F.col("at") == F.col("host"), "left")
    return unnested(joined.select("row", text(F.col("page"), F.col("slot")).alias(out_col)), pages.columns, out_col)
