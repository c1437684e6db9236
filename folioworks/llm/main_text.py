"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to one line of text per block element, without elements that
never hold an article (scripts, navigation, forms and the like, by tag, role or
class, unless the page's article is in them).  Over sliding windows of ``WINDOW`` lines text lengths are summed.  Where
the sum surges over the threshold a stretch of the text starts, where it falls off
it ends; stretches with ``GAP`` lines or fewer between them are one.  All text
between a surge and its dive is kept, widened to the element around the stretch
with most text (the core), so that short first and last lines stay.  Where the page
itself marks an article around the core, that article is the text.

The work is linear in the page, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the least text in a window inside the core.
WINDOW = 3
LEAST_CHARS = 60
#: Lines between two stretches that are one.
GAP = 4

# Element names with a meaning in HTML.
_DROPPED = set("head script style noscript template svg math iframe object canvas audio video nav header footer aside form button select option textarea input dialog menu".split())
_RAW = "script style noscript template textarea title".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = {"article", "main", "section", "div", "td", "body", "html", "center"}
_ENDS_P = _BLOCK - {"body", "html"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
# Parts of class and id names of what is not the article, those that tell it whatever
# stands beside them, and parts that may stand beside the others.
_ASIDE = set("""ad ads adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu
breadcrumb breadcrumbs sidebar side widget widgets footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe
subscription signup login share sharing social related recommended recommendations comment comments commentlist replies respond disqus pagination pager toolbar skip""".split())
_STRONG = set("comment comments commentlist replies respond disqus newsletter cookie cookies consent gdpr breadcrumb breadcrumbs pagination pager popup navbar advert adverts advertisement".split())
_BESIDE = set("site main top bottom global left right primary secondary user box bar wrap wrapper container list area section block links link form content inner slot unit label group row posts articles stories news items".split())
_COMMENTS, _OF_COMMENTS = {"comment", "comments", "reply", "replies"}, {"body", "item", "entry", "thread", "parent", "child", "odd", "even", "depth"}
_ADVERTS = set("ad ads adslot advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion".split())
_NOT = {"has", "with", "no", "without", "is"}
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "figcaption"}

_COMMENT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
_TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_BROKEN_TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"  # quotes that do not close
_TOKEN = re.compile(f"{_COMMENT}|{_TAG}|{_BROKEN_TAG}", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Line:
    """The text of one block, the name of the block and the innermost container around it (a number)."""

    __slots__ = ("container", "name", "text")

    def __init__(self, text: str, name: str, container: int):
        self.text, self.name, self.container = text, name, container


class Containers:
    """The containers of a page, numbered as they open (0 is the page): what each is in, and the last one inside it."""

    def __init__(self) -> None:
        self.names, self.parents, self.ends, self.articles = ["html"], [0], [0], [0]

    def open(self, name: str, parent: int) -> int:
        own = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.ends.append(own)
        self.articles.append(own if name in ("article", "main") else self.articles[parent])
        return own

    def holds(self, outer: int, inner: int) -> bool:
        return outer <= inner <= self.ends[outer] or not outer

    def around(self, some: list[int]) -> int:
        """The innermost container that holds all of ``some``."""
        low, high = min(some), max(some)
        while not self.holds(low, high):
            low = self.parents[low]
        return low


def _named_aside(value: str, words: set[str] = _ASIDE) -> bool:
    """Whether a class or id names, by ``words``, a part that is not the article."""
    for name in value.lower().split():
        parts = [x.rstrip("0123456789") for x in re.split(r"[-_]+", name)]
        parts = [x for x in parts if x]
        if not parts or parts[0] in _NOT:
            continue
        if not _STRONG.isdisjoint(parts) or (not words.isdisjoint(parts) and all(x in words or x in _BESIDE for x in parts)):
            return True
    return False


def _names_comment(value: str) -> bool:
    """Whether a class or id names a reader's comment (``comment-12``), and not a state of the article (``comment-open``)."""
    for name in value.lower().split():
        parts = [x for x in (p.rstrip("0123456789") for p in re.split(r"[-_]+", name)) if x]
        if not _COMMENTS.isdisjoint(parts) and all(x in _COMMENTS or x in _BESIDE or x in _OF_COMMENTS for x in parts):
            return True
    return False


def _set_aside(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element never holds the article, and whether its class or id alone says so."""
    if name in _DROPPED and not (name == "header" and in_article):
        return True, False
    if not attributes or name in ("html", "body", "main"):
        return False, False
    by_name = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if name == "article":
            if key in ("class", "id") and _names_comment(value):
                return True, False
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in _ROLES):
            return True, False
        # a paragraph of an article is set aside as an advert, not for a word that styles it
        by_name |= key in ("class", "id") and name != "header" and _named_aside(value, _ADVERTS if in_article and name in _TEXTUAL else _ASIDE)
    return by_name, by_name


def lines_of(page: str) -> tuple[list[Line], Containers]:
    """Strip markup: the non-empty blocks outside parts set aside, in page order, and the containers they are in.

    Parts set aside by class are read as well, until it is known which of them hold
    a main or, where all articles are in such parts, those in the fewest of them.
    """
    tree = Containers()
    read: list[tuple[int, str | None, str, int]] = []  # part by class, text or the end of a block, its name and container
    stack: list[tuple[str, int, bool, bool]] = []  # name, container or 0, set aside, by class
    places: dict[str, list[int]] = {}  # where elements of a name are in the stack
    walls: list[int] = []  # where containers are in it, and parts set aside
    asides: list[int] = []
    inside = [0]  # open containers
    above, deep = [0], [0]  # parts by class: the one each is in, and how many
    part = 0
    mains: set[int] = set()
    articles: set[int] = set()
    aside = at = 0
    block = "body"

    def add(text: str) -> None:
        if text:
            read.append((part, text, "", 0))

    def flush() -> None:
        if read and (read[-1][0] != part or read[-1][1] is not None):
            read.append((part, None, block, inside[-1]))

    def close(depth: int) -> None:
        nonlocal aside, part
        while len(stack) > depth:
            name, container, gone, soft = stack.pop()
            places[name].pop()
            if container:
                walls.pop()
                inside.pop()
                tree.ends[container] = len(tree.names) - 1
            if gone or soft:
                asides.pop()
            aside -= gone and not soft
            part = above[part] if soft else part

    last = page.rfind(">")
    while True:
        match = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not aside:
            add(page[at : match.start() if match else len(page)])
        if not match:
            break
        at = match.end()
        slash, name, attributes = match[1] or match[4], (match[2] or match[5] or "").lower(), match[3] or match[6] or ""
        if not name:
            continue
        if slash:
            if name in _BLOCK and not aside:
                flush()
                block = "body"
            found = places.get(name)
            if found and (name in _CONTAINER or name in _DROPPED or not walls or found[-1] > walls[-1]):
                close(found[-1])
            continue
        if name == "br":
            if not aside:
                add(" ")
            continue
        if name in _BLOCK and not aside:
            flush()
            block = name
        if name in _ENDS_P and places.get("p") and places["p"][-1] > max(walls[-1] if walls else -1, asides[-1] if asides else -1):
            close(places["p"][-1])
        if name in _VOID or attributes.endswith("/"):
            continue
        gone, soft = _set_aside(name, attributes, bool(tree.articles[inside[-1]]))
        if gone and not aside:
            add(" ")
        if name in ("article", "main") and not gone and not aside:
            (mains if name == "main" else articles).add(part)
        soft = soft and not aside
        places.setdefault(name, []).append(len(stack))
        if gone or soft:
            asides.append(len(stack))
        container = tree.open(name, inside[-1]) if name in _CONTAINER else 0
        if container:
            walls.append(len(stack))
            inside.append(container)
        stack.append((name, container, gone, soft))
        if soft:
            above.append(part)
            deep.append(deep[part] + 1)
            part = len(above) - 1
        else:
            aside += gone
        if name in _RAW:
            end_of = re.compile(rf"</{name}\b", re.I).search(page, at)
            closed = page.find(">", end_of.end()) if end_of else -1  # where the first has no end, none has
            if not aside:
                add(page[at : end_of.start() if closed >= 0 else len(page)])
            close(len(stack) - 1)
            at = closed + 1 if closed >= 0 else len(page)
    part = 0  # text before a part that does not close
    flush()
    close(0)
    fewest = min((deep[x] for x in mains | articles), default=0)
    held = {0}
    for x in [*mains, *(x for x in articles if deep[x] == fewest)]:
        while x not in held:
            held.add(x)
            x = above[x]
    out: list[Line] = []
    parts: list[str] = []
    for own, text, name, container in read:
        if own not in held:
            continue
        if text is not None:
            parts.append(text)
            continue
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Line(text, name, container))
    return out, tree


def stretches(lengths: np.ndarray) -> list[tuple[int, int]]:
    """First line and end of each stretch between a surge and a dive of the window sums, those close together joined."""
    if not len(lengths):
        return []
    padded = np.concatenate([lengths, np.zeros(WINDOW - 1, np.int64)])
    sums = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")
    dense = np.concatenate([[False], sums >= min(LEAST_CHARS, sums.max()), [False]])
    surge, dive = np.flatnonzero(~dense[:-1] & dense[1:]), np.flatnonzero(dense[:-1] & ~dense[1:])
    end = np.minimum(dive + WINDOW - 1, len(lengths))
    apart = surge[1:] - end[:-1] > GAP
    return list(zip(surge[np.concatenate([[True], apart])].tolist(), end[np.concatenate([apart, [True]])].tolist(), strict=True))


def main_text(page: str | None) -> str:
    """The article of ``page``: its blocks, joined by newlines; empty for null, empty or text-free pages."""
    if not page:
        return ""
    lines, tree = lines_of(page)
    lengths = np.array([len(x.text) for x in lines], np.int64)
    found = stretches(lengths)
    if not found:
        return ""
    return "\n".join(lines[i].text for i in _kept(lines, tree, lengths, found))


def _kept(lines: list[Line], tree: Containers, lengths: np.ndarray, found: list[tuple[int, int]]) -> list[int]:
    """Lines of the article around the core, or else of all stretches and of the element around the core."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    first, end = max(found, key=lambda x: total[x[1]] - total[x[0]])
    core = range(first, end)
    around = tree.around([lines[i].container for i in core])
    article = tree.articles[around]
    if article:
        return [i for i, x in enumerate(lines) if tree.holds(article, x.container)]
    own = [tree.articles[lines[i].container] for i in core]
    if 2 * sum(lengths[i] for i, x in zip(core, own, strict=True) if x) > total[end] - total[first]:
        # the core runs over the end of its articles: it brings its other lines with it, but for short ones at its ends
        long = [i for i, x in zip(core, own, strict=True) if x or WINDOW * lengths[i] >= LEAST_CHARS]
        inside = {tree.articles[lines[i].container] for i in range(long[0], long[-1] + 1)} - {0}
        return [i for i, x in enumerate(lines) if long[0] <= i <= long[-1] or tree.articles[x.container] in inside]
    kept = set()
    for low, high in found:  # windows reach over short lines at both ends that may be of other parts
        while low < high and WINDOW * lengths[low] < LEAST_CHARS and lines[low].name not in _TEXTUAL:
            low += 1
        while low < high and WINDOW * lengths[high - 1] < LEAST_CHARS and lines[high - 1].name not in _TEXTUAL:
            high -= 1
        kept.update(range(low, high) if low < high else range(first, end) if (low, high) == (first, end) else ())
    if around and tree.names[around] not in ("body", "html"):
        kept.update(i for i, x in enumerate(lines) if tree.holds(around, x.container))
    return sorted(kept or core)


def extract(pages: DataFrame) -> DataFrame:
    """Return ``page_id, url, text`` of ``pages`` (with ``html``); one row for each, repeated rows included.

    Null and empty pages have an empty text; pages may be of any length and nesting;
    of stretches with equal text the first is the core; other columns are ignored; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op3(pages: DataFrame) -> DataFrame:
    """Main text of every page with its length in code points."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
