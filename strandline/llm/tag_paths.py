"""Main text of HTML pages by tag-path ratios.

Every text node has a root-to-leaf tag path.  Per page, the nodes of a path are taken together: characters and
punctuation marks per node, and the share of characters in links.  Both ratios are smoothed over the paths in page order,
fused into one score, and the paths over a share of the text-weighted mean score are content.  The smallest
element that holds most of the content's text is the container, or the article or main element around it; the result is every text node on a
content path, what else is in the container, and the page's heading of the first rank (its only one, or one that its title begins with).

Evidence against an element: what never shows text (scripts, styles, hidden parts), and what its element or role says is a menu, footer, sidebar or dialog, is out.  Names (of class or
id) for these and for adverts, notices and reader comments, forms and page headers weigh the scores of all paths inside the element down, each time they are nested.  So a name
tells parts of a page apart and never rules a page out: where all prose is inside one such element, all paths weigh alike.  An element that holds HELD of what would be content if names meant nothing is
a wrapper, whose name says nothing; where the page has a heading of the first rank, article or main element, it must hold one besides, and one named for comments must in any case, as comments
may be longer than what they are about.  Evidence on elements around the container is no evidence either; inside it, what bears any and is not on a content path is left out.  A name counts as a whole: one that tells a state (`menu-closed`,
`with-sidebar`, `ad-free`) says nothing, and one that also has a word for content is not sure.  A heading of the first rank in a page header stays if the page has no
other and its title begins with it.

Work.  One pass over the page: tags are found by their first character and ended outside quoted values; an element knows its parent, and from it
the nearest open paragraph, item, cell and row, so depth costs nothing.  Sums over elements go up the tree once.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by one space, in page order.  Nothing else is dropped or cut.

Cases.  A null or empty page, or one without text, gives an empty text.  Broken markup, unclosed elements and cut-off
pages are read as far as they go.  Repeated pages are all kept; extra columns are ignored whatever their names;
an empty table gives no rows.  Long pages are read whole, one at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, small_batches

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
WORD = re.compile(r"[a-z]+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: What an element is as a scope for others (paragraph, item, definition, cell, row, part of a table, option), which of them a new one ends, and for which it is a border.
OWN = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "option": 6}
ENDS = {"li": (1,), "dt": (2,), "dd": (2,), "td": (3,), "th": (3,), "tr": (4, 3), "thead": (5, 4), "tbody": (5, 4), "tfoot": (5, 4), "option": (6,)}
BORDERS = {"table": (0, 3, 4, 5), "td": (0,), "th": (0,), "caption": (0,), "button": (0,), "object": (0,), "ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "select": (6,), "tr": (3,), "thead": (3, 4), "tbody": (3, 4), "tfoot": (3, 4)}

# What is no main text: never (3; by element or role), surely (2), or likely (1; by a word of class or id, or an element).
NEVER, SURELY, LIKELY = 3, 2, 1
BY_TAG = dict.fromkeys([*RAW, "head", "button", "select", "svg", "canvas", "object", "audio", "video", "map", "datalist"], NEVER) | dict.fromkeys("nav footer aside menu dialog".split(), NEVER) | dict.fromkeys("form fieldset header".split(), LIKELY)
BY_ROLE = dict.fromkeys("navigation contentinfo complementary search alertdialog dialog menu menubar toolbar tablist".split(), NEVER) | dict.fromkeys("banner form alert".split(), LIKELY)
SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu menus"
    " nav navbar navigation navi newsletter notice notices pager pagination paywall popup promo promoted promotion replies respond sidebar sidenav sponsor sponsored subscribe subscription".split()
)
LIKELY_WORDS = frozenset(
    "alert disclaimer donate header hidden login modal notification overlay recommend recommended recommendations related reply share sharing shares signin signup skip social teaser toc toolbar topbar tracking widget widgets".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: A name with one of these says how something else is, or that it is not there.
STATE_WORDS = frozenset("closed free has no offset open opened with without".split())
HEADER_WORDS = frozenset(["header", "masthead"])
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: What evidence leaves of a path's score.
WEIGHTS = {0: 1.0, LIKELY: 1 / 32, SURELY: 1 / 512, NEVER: 0.0}
MARKS = re.compile(r"[.,;:!?…。、，！？；：·¿¡\"'«»“”()-]")
#: A path is content if its score is this share of the mean score, weighted by text.
SHARE = 0.3
#: The container holds this share of the content's text.
HELD = 0.8


class _Node:
    __slots__ = ("path", "text", "size", "block", "element", "link", "title")

    def __init__(self, path: int, text: str, block: int, element: int, link: bool, title: int) -> None:
        self.path, self.text, self.size, self.block, self.element, self.link, self.title = path, text, len(text.strip()), block, element, link, title


class _Open:
    __slots__ = ("tag", "n", "path", "shown", "inside", "link", "title", "scopes")

    def __init__(self, tag: str, n: int, path: int, shown: bool, inside: bool, link: bool, title: int, scopes: tuple[int, ...]) -> None:
        self.tag, self.n, self.path, self.shown, self.inside, self.link, self.title, self.scopes = tag, n, path, shown, inside, link, title, scopes


class _Page:
    """The text nodes of a page; the parent of each element (an earlier one; the first has itself), the evidence against it alone, the article or main element around it (itself if none); the
    elements that hold a heading of the first rank, article or main element, and those named for comments; and the title."""

    def __init__(self) -> None:
        self.nodes: list[_Node] = []
        self.parents, self.levels, self.majors, self.comments, self.major, self.title = [0], [0], [0], set(), [False], ""


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(raw)}


def _level(tag: str, had: dict[str, str], inside: bool) -> int:
    """The evidence against an element.  inside: within an article or main element, whose own header is part of it."""
    level = 0 if tag == "header" and inside else BY_TAG.get(tag, 0)
    if not had or tag in ("html", "body", "article", "main"):
        return level
    if "hidden" in had or "display:none" in had.get("style", "").replace(" ", ""):
        return NEVER
    level = max(level, BY_ROLE.get(had.get("role", ""), 0), NEVER * (had.get("aria-hidden") == "true"))
    for name in f"{had.get('class', '')} {had.get('id', '')}".split():
        words = set(WORD.findall(name))
        if inside:
            words -= HEADER_WORDS
        if words & STATE_WORDS:
            continue
        if words & SURE_WORDS:
            level = max(level, LIKELY if words & CONTENT_WORDS else SURELY)
        elif words & LIKELY_WORDS and not words & CONTENT_WORDS:
            level = max(level, LIKELY)
    return level


def _tag_end(page: str, at: int, spent: set[str]) -> int:
    """The place after the `>` that ends a tag; a quote counts if it opens a value.  spent: quotes that the rest of the page has no second of."""
    while m := STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and m[0] not in spent:
            end = page.find(m[0], at)
            if end < 0:
                spent.add(m[0])
            else:
                at = end + 1
    return len(page)


def read(page: str) -> _Page:
    own = _Page()
    stack, parents, majors, count, found = [_Open("", 0, 0, True, False, False, 0, (-1,) * 7)], own.parents, own.majors, {"": 1}, own.nodes
    paths: dict[tuple[int, str, int], int] = {}
    block, at, size, spent = 0, 0, len(page), set()

    def text(raw: str) -> None:
        top = stack[-1]
        if top.shown and raw and (found or not raw.isspace()):
            found.append(_Node(top.path, entities.unescape(raw), block, top.n, top.link, top.title))

    def close(k: int) -> None:
        while len(stack) > k:
            count[stack.pop().tag] -= 1

    pending = 0  # where text that is not yet taken begins
    while True:
        at = page.find("<", at)
        if at < 0:
            text(page[pending:])
            return own
        m = NAME.match(page, at + 1)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1  # no markup
            continue
        text(page[pending:at])
        if m is None:
            begin, mark = at, "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(mark, at + 4 if mark == "-->" else at + 2)
            at = pending = size if end < 0 else end + len(mark)
            if mark == "]]>":
                text(entities.escape(page[begin + 9 : end if end >= 0 else size], quote=False))
            continue
        tag, begin = m[1].lower(), at
        at = pending = _tag_end(page, m.end(), spent)
        if tag not in INLINE:
            block += 1
        if page[begin + 1] == "/":
            if tag and count.get(tag, 0):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        closed = page[at - 2] == "/" and tag not in RAW
        if tag in VOID or closed:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag == "title" and not own.title:
                own.title = " ".join(entities.unescape(page[at : end.start() if end else size]).split())
            at = pending = _tag_end(page, end.end(), spent) if end else size
            continue
        if tag in CLOSES_P and stack[-1].scopes[0] >= 0:
            close(stack[-1].scopes[0])
        for kind in ENDS.get(tag, ()):
            if stack[-1].scopes[kind] >= 0:
                close(stack[-1].scopes[kind])
                break
        up, had = stack[-1], _attributes(page[m.end() : at])
        level = _level(tag, had, up.inside)
        path = up.path if tag in INLINE and not level else paths.setdefault((up.path, f"{tag}.{had.get('class', '')}", level), len(paths) + 1)
        scopes = up.scopes
        if tag in OWN or tag in BORDERS:
            scopes = list(scopes)
            for kind in BORDERS.get(tag, ()):
                scopes[kind] = -1
            if tag in OWN:
                scopes[OWN[tag]] = len(stack)
            scopes = tuple(scopes)
        parents.append(up.n)
        own.levels.append(level)
        own.major.append(tag in ("h1", "article", "main") and up.shown)
        if level == SURELY and COMMENT_WORDS.intersection(WORD.findall(f"{had.get('class', '')} {had.get('id', '')}")):
            own.comments.add(len(parents) - 1)
        majors.append(majors[up.n] if up.inside and tag not in ("article", "main") else len(majors))
        count[tag] = count.get(tag, 0) + 1
        stack.append(_Open(tag, len(parents) - 1, path, up.shown and level < NEVER, up.inside or tag in ("article", "main"), up.link or tag == "a", up.title or (len(parents) - 1) * (tag == "h1"), scopes))


def _smooth(x: list[float]) -> list[float]:
    """A kernel of 1, 2, 1 over neighbouring paths."""
    return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]


def path_scores(nodes: list[_Node], weights: list[float]) -> dict[tuple[int, float], tuple[float, int]]:
    """The fused score and the characters of each path, in order of its first node.  weights: of each element; a path whose nodes weigh differently counts as several."""
    sums: dict[tuple[int, float], list[float]] = {}
    for x in nodes:
        s = sums.setdefault((x.path, weights[x.element]), [0, 0, 0, 0])
        s[0] += x.size
        s[1] += len(MARKS.findall(x.text))
        s[2] += x.size > 0
        s[3] += x.size * x.link
    text = _smooth([a / max(c, 1) for a, _, c, _ in sums.values()])
    mark = _smooth([b / max(c, 1) for _, b, c, _ in sums.values()])
    free = [1 - d / max(a, 1) for a, _, _, d in sums.values()]
    return {p: (t * (1 + m) * f * p[1], int(s[0])) for (p, s), t, m, f in zip(sums.items(), text, mark, free, strict=True)}


def content_paths(nodes: list[_Node], weights: list[float]) -> set[tuple[int, float]]:
    """The paths over SHARE of the mean score."""
    scores = path_scores(nodes, weights)
    size = sum(n for _, n in scores.values())
    if not size:
        return set()
    limit = SHARE * sum(s * n for s, n in scores.values()) / size
    return {p for p, (s, n) in scores.items() if s >= limit and n}


def held_text(page: _Page, content: set[tuple[int, float]], weights: list[float]) -> list[int]:
    """The characters of content in each element.  Parents come before their children."""
    out = [0] * len(page.parents)
    for x in page.nodes:
        out[x.element] += x.size * ((x.path, weights[x.element]) in content)
    for e in range(len(out) - 1, 0, -1):
        out[page.parents[e]] += out[e]
    return out


def element_weights(page: _Page) -> list[float]:
    """What the evidence around and on each element leaves of a score, without that on wrappers."""
    n = len(page.parents)
    if not any(0 < x < NEVER for x in page.levels):
        return [1.0] * n
    plain = [1.0] * n
    held = held_text(page, content_paths(page.nodes, plain), plain)
    major = page.major.copy()
    for e in range(n - 1, 0, -1):
        major[page.parents[e]] |= major[e]
    out = plain
    for e in range(1, n):
        wraps = held[0] and held[e] >= HELD * held[0] and (major[e] or not (major[0] or e in page.comments))
        out[e] = out[page.parents[e]] * (1.0 if wraps else WEIGHTS[page.levels[e]])
    return out


def heading_of(nodes: list[_Node], against: list[int], title: str) -> set[int]:
    """The places of the nodes of the page's heading.  against: the evidence inside the container, or beside it, against each element."""
    heads: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        if x.title and against[x.element] <= LIKELY:
            heads.setdefault(x.title, []).append(i)
    words = {h: " ".join("".join(nodes[i].text for i in own).split()) for h, own in heads.items()}
    clear = [h for h, own in heads.items() if words[h] and not against[nodes[own[0]].element]]
    chosen = [h for h in words if words[h] and title.startswith(words[h]) and (h in clear or not clear)][:1] or (clear if len(clear) == 1 else [])
    return {i for h in chosen for i in heads[h]}


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = read(html)
    nodes, parents, n = page.nodes, page.parents, len(page.parents)
    weights = element_weights(page)
    content = content_paths(nodes, weights)
    if not content:
        return ""
    held = held_text(page, content, weights)
    # The first and last block and the depth of each element.
    depth, first, last = [0] * n, [1 << 60] * n, [-1] * n
    for x in nodes:
        e = x.element
        first[e], last[e] = min(first[e], x.block), max(last[e], x.block)
    for e in range(1, n):
        depth[e] = depth[parents[e]] + 1
    for e in range(n - 1, 0, -1):
        up = parents[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    # The deepest element with enough of the text and more than one block, so that one long paragraph is not the container.
    holder = max((e for e, w in enumerate(held) if w >= HELD * held[0] and (last[e] > first[e] or e == 0)), key=lambda e: (depth[e], e))
    around, e = {holder}, holder
    while e:
        e = parents[e]
        around.add(e)
    against = [0] * n  # but for what stands around the content as well
    for e in range(1, n):
        against[e] = max(against[parents[e]], 0 if e in around else page.levels[e])
    holder = page.majors[holder]
    inside = [False] * n
    for e in range(n):
        inside[e] = e == holder or inside[parents[e]]
    heading = heading_of(nodes, against, page.title)
    out: dict[int, list[str]] = {}
    for i, x in enumerate(nodes):
        if inside[x.element] and not against[x.element] or (x.path, weights[x.element]) in content or i in heading:
            out.setdefault(x.block, []).append(x.text)
    return " ".join(t for parts in out.values() if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(rows, step, "page_id long, url string, text string, n_chars long")
