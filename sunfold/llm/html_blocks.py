"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as a flat list of text blocks, cut at every block-level tag. A block is described by its number of
words and its link density, by those of the blocks before and after it, and by what encloses it. A decision tree,
trained on the small table of labelled blocks below, says which blocks are main text. Each page is read once from its
start to its end, in time linear in its length however broken its tags are, and worked on alone in whatever task
reads it; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements whose content is no text, elements within a line, and elements that enclose parts of a page.
_RAW = "script style noscript template iframe object svg math canvas select textarea button head title".split()
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_AROUND = set("nav header footer aside form dialog menu article main section div ul ol table figure body details fieldset datalist option".split())
_SIDE = set("nav footer aside form dialog menu fieldset datalist option".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_LAYOUT = re.compile(r"(?<![\w-])(?:has|with|without|no)[-_][\w-]+", re.I)  # names of a layout, not of a part
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")  # the words of a compound name
# Words that say what a part is, wherever they stand in a name; words that say it only as a whole name, as its end or before one of _PLACES;
# words that say it of an article too; and how names begin that are written in one word.
_ANYWHERE = set("advert adverts advertisement advertising banner breadcrumb breadcrumbs comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notification overlay pager pagination popup promo promotion recommended related replies respond sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_WHOLE = set("ad ads comment header masthead notice notices reply search share tags".split())
_PLACES = set("area bar box block button buttons cloud container field form holder icons input item items links list panel row section slot space tools unit widget wrap wrapper".split())
_OF_ARTICLES = set("ad ads advert advertisement comment comments promo related reply sponsored widget".split())
_GLUED = re.compile(r"(?:comment(?:s|list|area|box|form|section|thread|block)|cookie|advert|newsletter|sidebar|breadcrumb|navbar|navmenu|footer|popup|modal|related(?:post|article|link)|social(?:bar|icon|link|media|share)|share(?:bar|box|button|icon|link|tool)|search(?:bar|box|form)|tag(?:cloud|list))[a-z]*|ads?(?:box|bar|slot|unit|block|wrap|wrapper|container|space|holder|banner|sense)?s?")
_CONTENT = set("article content entry main post story text body hentry".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())

_TAG = re.compile(r"</?([a-zA-Z][\w:-]*)")
_STEP = re.compile(r">|=\s*([\"'])")
_RAW_END = {x: re.compile(f"</{x}(?![\\w:-])[^>]*>", re.I) for x in _RAW}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "side", "hinted", "within_main", "heading")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """The page from left to right, as (kind, name or text, attributes): kind is text, open or close. Comments, declarations
    and raw elements are left out.

    A quoted value begins behind an equals sign; where a quote is never closed, quotes mean nothing from there on. Raw
    elements end at their end tag, svg and math also at "/>"; without an end tag script and style run to the page's end, and
    of the others only the start tag goes. Whatever was sought in vain is not sought again, so every character is passed a
    bounded number of times."""
    at, n, quotes, endless = 0, len(page), True, set()

    def tag_end(i: int) -> int:
        """Where the tag ends whose name ends at i; -1 if nowhere."""
        nonlocal quotes
        j = i
        while quotes:
            m = _STEP.search(page, j)
            if m is None:
                quotes = False
            elif not m[1]:
                return m.start()
            elif (j := page.find(m[1], m.end()) + 1) == 0:
                quotes = False
        return page.find(">", i)

    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4) + 3
            yield "text", page[at:i], ""
            at = end if end > 2 else n
            continue
        if page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            yield "text", page[at:i], ""
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, i)
        if m is None:
            yield "text", page[at : i + 1], ""
            at = i + 1
            continue
        end = tag_end(m.end())
        if end < 0:
            break
        yield "text", page[at:i], ""
        name, attrs, at = m[1].lower(), page[m.end() : end], end + 1
        if page[i + 1] == "/":
            if name not in _RAW_END:
                yield "close", name, ""
        elif name not in _RAW_END:
            yield "open", name, attrs
        elif not (name in ("svg", "math") and attrs.endswith("/")) and name not in endless:
            if stop := _RAW_END[name].search(page, at):
                at = stop.end()
            elif name in ("script", "style"):
                at = n
            else:
                endless.add(name)
    yield "text", page[at:], ""


def _hints(name: str, article: bool, within: bool) -> bool:
    """Whether a class name or an id says that its element is a side part. article: whether it is an article or the main part,
    whose names also say what it is about; within: whether a main part encloses it, whose header is its title."""
    words = [w.lower() for w in _NAME.findall(name)]
    if article:
        return len(words) > 0 and (name.lower() in _OF_ARTICLES or (words[0] in ("comment", "reply") and len(words) == 2 and words[1] in _PLACES | {"body"}))
    if _GLUED.fullmatch("".join(words)):
        return True
    for i, w in enumerate(words):
        last = i == len(words) - 1
        if w in _ANYWHERE or (w not in _WHOLE and _GLUED.fullmatch(w)):
            return True
        if w in ("header", "masthead"):
            if last and not within and not (set(words[:i]) & _CONTENT):
                return True
        elif w in _WHOLE and (last or words[i + 1] in _PLACES):
            return True
    return False


def _kind(tag: str, attrs: str, within: bool) -> tuple[bool, bool, bool]:
    """Whether an element is a side part by its tag or role, is hinted to be one by its names, and is a main part."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    names = _LAYOUT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").split()
    gone = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    role = found.get("role", "").lower()
    side = tag in _SIDE or role in _ROLES or gone or (tag == "header" and not within)
    article = tag in ("article", "main") or role in ("main", "article")
    content = tag in ("div", "section", "td") and any((words := [w.lower() for w in _NAME.findall(n)]) and words[-1] in _CONTENT for n in names)
    subject = article or (content and any(n.lower() in ("hentry", "post", "article", "entry", "story") for n in names))
    hinted = tag != "body" and any(_hints(n, subject, within) for n in names)
    return side, hinted, not hinted and (article or content)


def blocks_of(page: str | None) -> list[tuple[str, int, float, bool, bool, bool, bool]]:
    """The text blocks in page order: text, words, link density, side part, hinted, within a main part, heading.

    Character references are decoded, runs of white space become one space. Pages cut off anywhere are read to their end."""
    page = page or ""
    if head := re.search(r"<head(?![\w:-])[^>]*>", page, re.I):
        end = re.compile(r"</head\s*>|<body(?![\w:-])", re.I).search(page, head.end())
        if end:
            page = page[: head.start()] + page[end.end() if end[0][1] == "/" else end.start() :]
    out, stack, text, linked = [], [], [], []
    side = hinted = main = 0
    heading = link = False
    depth: dict[str, int] = {}

    def flush():
        words = html.unescape("".join(text)).split()
        if words:
            inside = len(html.unescape(" ".join(linked)).split())
            out.append((" ".join(words), len(words), min(1.0, inside / len(words)), side > 0, hinted > 0, main > 0, heading))
        text.clear()
        linked.clear()

    for what, name, attrs in _tokens(page):
        if what == "text":
            text.append(name)
            if link:
                linked.append(name)
            continue
        if name == "a":
            link = what == "open"
        if name in _INLINE:
            if name in ("br", "wbr", "img"):
                text.append(" ")
            continue
        flush()
        heading = what == "open" and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in _VOID or name not in _AROUND:
            continue
        if what == "open":
            if name == "option" and stack and stack[-1][0] == "option":
                side, hinted, main = (v - k for v, k in zip((side, hinted, main), stack.pop()[1], strict=True))  # its end tag may be left out
                depth["option"] -= 1
            kind = _kind(name, attrs, main > 0)
            stack.append((name, kind))
            depth[name] = depth.get(name, 0) + 1
            side, hinted, main = (v + k for v, k in zip((side, hinted, main), kind, strict=True))
        elif depth.get(name):
            while True:
                closed, kind = stack.pop()
                depth[closed] -= 1
                side, hinted, main = (v - k for v, k in zip((side, hinted, main), kind, strict=True))
                if closed == name:
                    break
    flush()
    return out


def features(blocks: list[tuple]) -> np.ndarray:
    """One row for each block, in the order of FEATURES; beyond the page's ends there are no words and no links."""
    if not blocks:
        return np.empty((0, len(FEATURES)))
    own = np.array([(n, d) for _, n, d, *_ in blocks], float)
    pad = np.zeros((1, 2))
    flags = np.array([b[3:] for b in blocks], float)
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), flags])


def _prose(n: int, at: int = 0) -> str:
    """n words."""
    some = "rain fell on the hills for nine days and the old river rose so farmers moved their sheep to the upper fields while two roads in the valley stayed closed".split()
    return " ".join(some[(at + i) % len(some)] for i in range(n)).capitalize() + "."


def _links(n: int) -> str:
    return "".join(f"<li><a href=/{i}>{_prose(1 + i % 4, i)}</a></li>" for i in range(n))


#: What a page is put together from: (before, after) around the main text, the main text, and what is not main text.
SHELLS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post>", "</div>"), ("<section class='content wide'><article>", "</article></section>"),
    ("<div class='page with-sidebar'><main role=main>", "</main></div>"), ("<article class='post-12 post type-post hentry category-a tag-news'><header class=entry-header>", "</header></article>"), ("<div id=main-content class=story>", "</div>"),
    ("<div><div>", "</div></div>"), ("", ""), ("<div class=wrap><div id=p7>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>"),
)
MARKED_SHELLS = 7  # of these, which say that they are the main part: links within them are its own
BODIES = (
    f"<h1>{_prose(5)}</h1><p>{_prose(60)}</p><p>{_prose(4, 3)}</p><p>{_prose(25, 7)}</p>",
    f"<h1>{_prose(3, 2)}</h1><p>{_prose(12)} <a href=/x>{_prose(2)}</a> {_prose(20, 4)}</p><ul><li>{_prose(3)}</li><li>{_prose(9, 5)}</li></ul><p>{_prose(1)}</p><p>{_prose(44)}</p>",
    f"<h2>{_prose(7)}</h2><blockquote>{_prose(17)}</blockquote><p>{_prose(80, 9)}</p><h3>{_prose(2)}</h3><p>{_prose(6)}</p><p>{_prose(33)}</p><p>{_prose(2, 9)}</p>",
    f"<p>{_prose(150)}</p><p>{_prose(8)}</p><p><a href=/q>{_prose(6)}</a></p><p>{_prose(90)}</p>",
    f"<p>{_prose(3)}</p><p>{_prose(28)}</p><p>{_prose(1, 8)}</p><p>{_prose(28, 2)}</p><p>{_prose(3, 5)}</p>",
    f"<h1>{_prose(6, 4)}</h1><p>{_prose(11)}</p>",
    f"<h1>{_prose(4, 6)}</h1><p>{_prose(20)}</p><p><a href=/s>{_prose(5)}</a></p><p>{_prose(15)}</p><p>{_prose(2)}</p><p>{_prose(9)} <a href=/y>{_prose(8)}</a></p><p>{_prose(30)}</p>",
    f"<p>{_prose(18)}</p><p><a href=/u>{_prose(3)}</a></p><p>{_prose(3)}</p><p>{_prose(70)}</p><p><a href=/v>{_prose(9)}</a></p><p>{_prose(14)}</p>",
    f"<h1>{_prose(2)}</h1><p>{_prose(100)}</p><p><a href=/w>{_prose(7)}</a></p><p>{_prose(12)}</p><p>{_prose(5)}</p><p><a href=/z>{_prose(2)}</a></p><p>{_prose(64)}</p>",
    f"<h1>{_prose(1)}</h1><p>{_prose(35)}</p><p><a href=/r>{_prose(4)}</a></p><p>{_prose(7)}</p><p>{_prose(120)}</p>",
)
MARKED = (
    f"<nav><ul>{_links(6)}</ul></nav>", f"<header><a href=/>{_prose(2)}</a><p>{_prose(12)}</p></header>", f"<aside><h3>{_prose(3)}</h3><p>{_prose(40)}</p><p>{_prose(2)}</p></aside>",
    f"<form><p>{_prose(4)}</p><label>{_prose(1)}</label><p>{_prose(30)}</p></form>", f"<footer><p>{_prose(35)}</p><p>{_prose(3)}</p></footer>", f"<div class=comments><h3>{_prose(1)}</h3><p>{_prose(50)}</p><p>{_prose(2)}</p><p>{_prose(18)}</p></div>",
    f"<div id=cookie-notice><p>{_prose(22)}</p></div>", f"<div class=ad>{_prose(9)}</div>", f"<div class=newsletter><p>{_prose(15)}</p></div>", f"<div class=related><p>{_prose(5)}</p><p>{_prose(26)}</p></div>", f"<div role=alert>{_prose(14)}</div>",
    f"<ol class=commentlist><li><p>{_prose(24)}</p></li><li><p>{_prose(3)}</p></li></ol>", f"<div id=disqus_thread><p>{_prose(28)}</p></div>", f"<div class=cookieBar>{_prose(17)}</div>",
    f"<section id=comments><article class=comment><p>{_prose(31)}</p></article></section>", f"<footer>&copy; {_prose(20)}</footer>",
)
INNER = tuple(m for m in MARKED if not m.startswith("<header"))  # what may stand within a main part, whose header is its title
UNMARKED = (f"<ul>{_links(5)}</ul>", f"<p><a href=/>{_prose(1)}</a> | <a href=/m>{_prose(3)}</a></p><p><a href=/t>{_prose(2)}</a></p>", f"<div><a href=/1>{_prose(5)}</a></div><div><a href=/2>{_prose(7)}</a></div><div><a href=/3>{_prose(4)}</a></div>")


def labelled_pages() -> list[list[tuple[str, int]]]:
    """The labelled table: pages in pieces, each piece with 1 where its text is main text. Every shell is put around every
    main text, with different other parts before, within, between and behind."""
    out = []
    for i, (before, after) in enumerate(SHELLS):
        for j, body in enumerate(BODIES):
            side = lambda k, i=i, j=j: MARKED[(5 * i + 3 * j + k) % len(MARKED)]
            inner = lambda k, i=i, j=j: INNER[(5 * i + 3 * j + k) % len(INNER)]
            links = UNMARKED[(i + j) % len(UNMARKED)]
            page = [(side(0), 0), (links if j % 2 else "", 0), (side(1), 0), (before, 1), (body, 1), (inner(2) if j % 3 else "", 0)]
            page += [(body if j % 3 else "", 1), (inner(3) if i % 2 else "", 0), (links if j in (1, 3) else "", int(i < MARKED_SHELLS)), (after, 1), (side(4), 0), (side(6), 0), (links if j % 2 == 0 else "", 0)]
            out.append([(part, label) for part, label in page if part])
    return out


def labelled_blocks(pages: list[list[tuple[str, int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    x, y = [], []
    for pieces in labelled_pages() if pages is None else pages:
        upto = [len(blocks_of("".join(part for part, _ in pieces[:i]))) for i in range(len(pieces) + 1)]
        x.append(features(blocks_of("".join(part for part, _ in pieces))))
        y.append(np.repeat([label for _, label in pieces], np.diff(upto)))
    return np.vstack(x), np.concatenate(y)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, tree at or below it, tree above it), or (share of label 1,)."""
    p = y.mean()
    if depth == 0 or p in (0, 1) or len(y) < 2 * least:
        return (float(p),)
    best = (p * (1 - p) * len(y) - 1e-9, None, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = ones[:-1], ones[-1] - ones[:-1]
        gini = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        gini = np.where((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least), gini, np.inf)
        if gini.min() < best[0]:
            i = int(gini.argmin())
            best = (gini[i], f, float(v[i] + v[i + 1]) / 2)
    _, f, t = best
    if f is None:
        return (float(p),)
    low = x[:, f] <= t
    return f, t, train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least)


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The share of label 1 in each row's leaf."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


def extract_main_text(pages: DataFrame, html: str = "html", main: str = "main_text", tree: tuple | None = None) -> DataFrame:
    """pages with the main text of each whole page: its main blocks in page order, joined by an empty line.

    A null or empty page, and one without main text, gives "". A column of pages named like `main` is replaced, others
    are carried, whatever their names; repeated rows stay; an empty table gives an empty result. `tree` takes the place
    of the tree trained on the labelled table.
    """
    tree = tree or train_tree(*labelled_blocks())
    columns = [c for c in pages.columns if c != main or c == html]
    at = columns.index(html)
    plain = pages.select(*(pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)))

    def text_of(page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n\n".join(b[0] for b, p in zip(blocks, classify(tree, features(blocks)), strict=True) if p >= 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.record_batch([*part.columns, pa.array(list(map(text_of, part[at].to_pylist())), pa.string())], [*part.schema.names, "main"])

    schema = T.StructType([*plain.schema.fields, T.StructField("main", T.StringType())])
    return plain.mapInArrow(run, schema).toDF(*columns, main)
