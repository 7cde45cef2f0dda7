"""Main text of web pages by composite text density.

Every page becomes a tree of its elements. Elements that name themselves as something else than the article
(scripts, menus, adverts, forms, reader comments, ...) leave first. Each node of the rest gets a composite text
density: its characters per tag, adjusted by its share of linked characters and links against the whole body's,

    density = C / T * log(C / LC * T / LT) / log(log(C / notLC * LC + LC_body / C_body * C + e))

with C characters, T tags, LC linked characters, LT links and zeros counted as one. A node's density sum is that
of its children, stretches of its own text being children too. The block of the largest sum holds the main text,
and the least density on its path up to the body is the threshold: from the body down, every node that reaches it
gives the block of the largest sum inside it. A block in an `article` or `main` stands for that element, and one
beside nothing but headings for the element around both, so that a heading stays with its text. Lists of links inside the selection (three links or more that hold most of the
characters) are left out.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
Rows are read as a stream and pages are independent, so memory is bounded by a batch and one page.

Edge cases: a null, empty or blank html, and one with nothing but markup and left-out parts, have the empty text.
Unclosed elements end with their parent or the page, an unclosed comment, script or style runs to the end, a tag
without `>` is text. Text outside any element counts as the body's. Pages of any length are read whole, in time
proportional to their length. Repeated rows are extracted each, an empty table gives an empty result, and other
columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by their role, and names under which pages keep other parts than the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
LEFT_OUT = frozenset(
    """script style noscript template title head nav aside footer form button select option textarea fieldset label datalist
    svg canvas iframe frame frameset object embed applet audio video map dialog menu xmp""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist tooltip".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adbanner banner banners sponsor
    sponsored sponsors promo promos promotion promoted teaser teasers cookie cookies cookiebar consent gdpr privacy notice notices
    notification notifications alert alerts popup popups modal overlay lightbox toast paywall subscribe subscription newsletter
    signup signin login register nav navbar navigation navi menu menus submenu menubar breadcrumb breadcrumbs toolbar topbar
    masthead header footer foot bottombar copyright colophon imprint legal disclaimer sidebar sidebars side aside rail widget
    widgets related recommended recommendations trending popular share sharing sharebar social comment comments commentlist
    discussion disqus replies respond feedback reviews guestbook form forms search searchbox pagination pager skip hidden
    sitemap outbrain taboola""".split()
)
NOT_SO = frozenset("has with no without not".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_TITLES = frozenset(
    """comments comment reader readers discussion kommentare kommentar leserkommentare commentaires commentaire comentarios comentario
    replies responses""".split()
)
#: A start tag that ends the open element of the same group, up to the nearest element that holds such a group.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}

#: A list of links: at least so many links, and this part of the characters inside them.
LINKS, LINKED = 3, 0.6

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Page:
    """The elements of a page in page order: parents come before their children. `items` holds the texts and breaks."""

    def __init__(self, html: str):
        self.names, self.parents, self.attributes = ["#body"], [-1], [""]
        self.items: list[tuple[int, str]] = []  # (element, text); an empty text is a break between blocks
        self._read(html)

    def _text(self, at: int, text: str) -> None:
        if text:
            self.items.append((at, references.unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        stack, opened = [0], Counter()
        names, here, start, pattern = self.names, 0, 0, _TAG

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                last = names[stack.pop()]
                opened[last] -= 1
                if last not in INLINE:
                    self.items.append((stack[-1], ""))

        while (at := html.find("<", here)) >= 0:
            if html.startswith("<!--", at):
                self._text(stack[-1], html[start:at])
                end = html.find("-->", at + 4)
                here = start = len(html) if end < 0 else end + 3
                continue
            follows = html[at + 1 : at + 2]
            if follows in ("!", "?") or (follows == "/" and not html[at + 2 : at + 3].isalpha()):
                end = html.find(">", at)
                if end < 0:
                    break
                self._text(stack[-1], html[start:at])
                here = start = end + 1
                continue
            if not follows.isascii() or not (follows.isalpha() or follows == "/"):
                here = at + 1
                continue
            tag = pattern.match(html, at)
            if not tag and pattern is _TAG:  # a quote that never ends: from here on quotes mean nothing
                pattern = _PLAIN_TAG
                tag = pattern.match(html, at)
            if not tag:
                if html.find(">", at) < 0:
                    break
                here = at + 1
                continue
            self._text(stack[-1], html[start:at])
            here = start = tag.end()
            name = tag[2].lower()
            if tag[1]:
                if opened[name]:
                    depth = len(stack) - 1
                    while names[stack[depth]] != name:
                        depth -= 1
                    close(depth)
                elif name in ("p", "br"):
                    self.items.append((stack[-1], ""))
                continue
            if name not in INLINE:
                self.items.append((stack[-1], ""))
                if opened["p"] and name not in VOID and name not in RAW:
                    depth = len(stack) - 1
                    while names[stack[depth]] != "p":
                        depth -= 1
                    close(depth)
            group, holders = SIBLINGS.get(name, ((), ()))
            if any(opened[x] for x in group):
                depth = len(stack) - 1
                while depth > 0 and names[stack[depth]] not in group and names[stack[depth]] not in holders:
                    depth -= 1
                if depth > 0 and names[stack[depth]] in group:
                    close(depth)
            names.append(name)
            self.parents.append(stack[-1])
            self.attributes.append(tag[3])
            if name in RAW:
                end = _CLOSE[name].search(html, here)
                here = start = end.start() if end else len(html)
                if end:
                    closing = html.find(">", here)
                    here = start = len(html) if closing < 0 else closing + 1
            elif name not in VOID and not tag[3].endswith("/") or name == "a":
                stack.append(len(names) - 1)
                opened[name] += 1
        self._text(stack[-1], html[start:])


def _labels(attributes: str) -> bool:
    """Whether an element's attributes say that it is not part of the article, or not shown."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            for name in value.split():
                words = {w.lower() for w in _WORD.findall(name)}
                if words & NAMES and not words & NOT_SO:
                    return True
    return False


def _left_out(page: Page) -> list[bool]:
    """For every element, whether it or an element around it is something else than the article."""
    names, parents = page.names, page.parents
    n = len(names)
    holds, titled = [False] * n, [False] * n  # an article or main inside; a heading inside
    for k in range(n - 1, 0, -1):
        holds[parents[k]] |= holds[k] or names[k] in ("article", "main")
        titled[parents[k]] |= titled[k] or names[k] in HEADINGS
    out, inside = [False] * n, [False] * n
    for k in range(1, n):
        name, up = names[k], parents[k]
        inside[k] = inside[up] or name in ("article", "main")
        if name in ("html", "body", "main") or (holds[k] and name not in LEFT_OUT - {"form"}):
            out[k] = out[up]
        elif name == "header" or (page.attributes[k] and "header" in page.attributes[k].lower() and titled[k] and inside[up]):
            out[k] = out[up] or not (inside[up] and titled[k])
        else:
            out[k] = out[up] or name in LEFT_OUT or bool(page.attributes[k] and _labels(page.attributes[k]))
    _comment_sections(page, out)
    return out


def _comment_sections(page: Page, out: list[bool]) -> None:
    """Leaves out the blocks that begin with a heading such as `Comments`."""
    seen: set[int] = set()
    found: set[int] = set()
    blocks = [0] * len(out)  # the block around an inline element
    for k in range(1, len(out)):
        blocks[k] = blocks[page.parents[k]] if page.names[k] in INLINE else k
    for at, text in page.items:
        if not text.strip() or out[at]:
            continue
        heading = blocks[at]
        up = page.parents[heading]
        if up > 0 and up not in seen and page.names[heading] in HEADINGS and page.names[up] in ("div", "section", "article", "ul", "ol"):
            words = re.findall(r"\w+", text.lower())
            if len(words) <= 3 and any(w in COMMENT_TITLES for w in words):
                found.add(up)
        while at > 0 and at not in seen:
            seen.add(at)
            at = page.parents[at]
    if found:
        for k in range(1, len(out)):
            out[k] = out[k] or k in found or (out[page.parents[k]])


def density(chars: float, tags: float, linked: float, links: float, ratio: float) -> float:
    """Link-adjusted characters per tag; `ratio` is the share of linked characters in the body."""
    if not chars:
        return 0.0
    plain, linked = max(chars - linked, 1), max(linked, 1)
    tags, links = max(tags, 1), max(links, 1)
    return chars / tags * math.log(max(chars / linked * tags / links, 1)) / math.log(math.log(chars / plain * linked + ratio * chars + math.e))


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html or not html.strip():
        return ""
    page = Page(html)
    names, parents, n = page.names, page.parents, len(page.names)
    out = _left_out(page)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    runs: list[tuple[int, int]] = []
    for at, text in page.items:
        if text and not out[at]:
            size = len(" ".join(text.split()))
            chars[at] += size
            runs.append((at, size))
    for k in range(n - 1, 0, -1):  # children come after their parents
        if out[k]:
            continue
        tags[k] += 1
        if names[k] == "a":
            linked[k], links[k] = chars[k], links[k] + 1
        up = parents[k]
        chars[up] += chars[k]
        tags[up] += tags[k]
        linked[up] += linked[k]
        links[up] += links[k]
    if not chars[0]:
        return ""
    ratio = linked[0] / chars[0]
    dense = [0.0 if out[k] else density(chars[k], tags[k], linked[k], links[k], ratio) for k in range(n)]
    sums = [0.0] * n
    for at, size in runs:
        if size:
            sums[at] += density(size, 1, size if names[at] == "a" else 0, names[at] == "a", ratio)
    for k in range(1, n):
        if not out[k]:
            sums[parents[k]] += dense[k]
    blocks = [k for k in range(n) if not out[k] and names[k] not in INLINE and names[k] not in VOID]
    # the block of the largest sum in every subtree, the outer one of equal sums
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = parents[k]
        if out[k]:
            continue
        mine = best[k]
        if names[mine] in INLINE or names[mine] in VOID:
            continue
        if names[best[up]] in INLINE or sums[mine] > sums[best[up]] or (sums[mine] == sums[best[up]] and best[up] != up and mine < best[up]):
            best[up] = mine
    top = best[0]
    threshold, k = dense[top], top
    while k > 0:
        k = parents[k]
        threshold = min(threshold, dense[k])
    whole = list(range(n))  # the article or main around an element, or itself
    for k in range(1, n):
        if names[k] not in ("article", "main") and names[whole[parents[k]]] in ("article", "main"):
            whole[k] = whole[parents[k]]
    titles = [0] * n  # characters of the headings inside
    for k in range(n - 1, 0, -1):
        if not out[k]:
            titles[k] = chars[k] if names[k] in HEADINGS else titles[k]
            titles[parents[k]] += titles[k]
    outer = list(range(n))  # the element around that adds nothing but headings
    for k in range(1, n):
        up = parents[k]
        if not out[k] and chars[up] - titles[up] == chars[k] - titles[k]:
            outer[k] = outer[up]
    reached, chosen = [False] * n, [False] * n
    for k in blocks:
        reached[k] = k == 0 or (reached[parents[k]] and dense[k] >= threshold)
        if reached[k]:
            chosen[outer[whole[best[k]]]] = True
    for k in range(1, n):
        chosen[k] = chosen[k] or chosen[parents[k]]
    lists = [False] * n
    for k in range(1, n):
        many = links[k] >= LINKS and linked[k] > LINKED * chars[k] and k != top and names[k] not in INLINE and names[k] not in ("article", "main", "body", "html")
        lists[k] = lists[parents[k]] or many
    # a break keeps texts apart wherever it stands
    kept = (text or " " for at, text in page.items if not text or (chosen[at] and not out[at] and not lists[at]))
    return " ".join("".join(kept).split())


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
