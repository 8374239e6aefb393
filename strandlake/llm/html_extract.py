"""HTML extraction: gradient-boosted trees over the nodes of a page's DOM, decoded from the top down.

A page becomes a tree of block elements and text blocks. Each node has features of its subtree (text, links, density), its
attribute tokens, depth, position and siblings; trees trained on generated pages (training_pages) give the probability that it
holds main text. The decoding takes the most probable choice of nodes in which a dropped element keeps nothing inside it and
a kept block has only kept ancestors; a nav element never holds main text. Kept blocks are joined in page order.

A null or empty page has an empty text. Unclosed and stray tags and cut pages are read as far as they go; a quote after which no
attribute can end is taken for a plain character, so its tag ends at the next `>`. Repeated rows each get a row; columns other than page_id, url and html are passed by.
"""

from __future__ import annotations

import html as html_codes
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import trees
from strandlake.llm.common import pieces, table

# Names of HTML elements by their role, and words of class, id and role attributes.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = set("script style title textarea noscript template iframe svg math select object xmp head".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which no open element is closed by these.
P_SCOPE = set("table caption td th button".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
GROUPS = ["#text", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "article", "main", "section", "form fieldset button", "table tbody thead tr td th", "figure figcaption", "blockquote pre", "div", "body html"]
NOISE = set("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disqus foot footer form head header hidden login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget complementary contentinfo search alert".split())
MAIN = set("article articlebody body content entry main maincontent page post prose story text copy".split())

GROUP_OF = {tag: i for i, g in enumerate(GROUPS) for tag in g.split()}
OTHER = len(GROUPS)
NAV = GROUP_OF["nav"]
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^<>])*+)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.,;:!?]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SKIPPED}
#: Marks main text in generated pages.
MARK = "\ue000"


@lru_cache(maxsize=4096)
def attribute_flags(attributes: str) -> int:
    """1: a token of NOISE, 2: a token of MAIN, 4: hidden, 8: a name of nothing but tokens of NOISE."""
    flags = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            flags |= 4 * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("hidden", "aria-hidden"):
            flags |= 4 * (name == "hidden" or value == "true")
        else:
            for one in value.split():
                tokens = set(_TOKENS.findall(_CAMEL.sub(" ", one).lower()))
                flags |= bool(tokens & NOISE) | 2 * bool(tokens & MAIN) | 8 * (bool(tokens) and tokens <= NOISE)
    return flags


class Page:
    """The nodes of a page in order: lists of group, parent, depth, flags, end (one past the last node of the subtree), and block texts."""

    def __init__(self, source: str, marks: bool = False):
        """marks: MARK in the source stands for main text; else it is a character like any other."""
        self.group, self.parent, self.depth, self.flags, self.end = [], [], [], [], []
        self.texts: dict[int, str] = {}
        self.chars, self.links, self.words, self.stops = [], [], [], []
        self.marked: set[int] = set()
        self.add("body", -1, 0)
        stack: list[tuple[str, int]] = [("body", 0)]
        opened: dict[str, int] = defaultdict(int)
        inside, held, linked, at = 0, [], 0, 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = "".join(held)
                clean = " ".join((text.replace(MARK, "") if marks else text).split())
                if clean:
                    node = self.add("#text", stack[-1][1], 0)
                    self.texts[node] = clean
                    self.chars[node], self.links[node] = len(clean), min(linked, len(clean))
                    self.words[node], self.stops[node] = clean.count(" ") + 1, len(_STOPS.findall(clean))
                    if marks and MARK in text:
                        self.marked.add(node)
                held.clear()
            linked = 0

        def pop() -> None:
            tag, node = stack.pop()
            opened[tag] -= 1
            self.end[node] = len(self.group)

        def close(tags: set[str], scope: set[str]) -> None:
            """Ends the innermost open element of these names, unless one of `scope` is inside it."""
            low = len(stack) - 1
            while low > 0 and stack[low][0] not in tags and stack[low][0] not in scope:
                low -= 1
            if stack[low][0] in tags:
                while len(stack) > low:
                    pop()

        def say(text: str) -> None:
            nonlocal linked
            if text:
                text = html_codes.unescape(text) if "&" in text else text
                held.append(text)
                if inside:
                    linked += len(text)

        position = 0
        while (m := _TOKEN.search(source, position)) is not None:
            say(source[at : m.start()])
            at = position = max(m.end(), m.start() + 1)
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in SKIPPED:
                if not m[1] and not m[3].rstrip().endswith("/"):
                    if (found := _ENDS[tag].search(source, at)) is not None:
                        at = position = found.end()
                    elif tag != "head":  # a head that isn't closed hides nothing but its own elements
                        at = position = len(source)
                continue
            if tag in INLINE:
                if tag == "a":
                    inside = 0 if m[1] else 1
                continue
            if tag == "br":
                held.append(" ")
                continue
            flush()
            inside = 0
            if m[1]:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in ("html", "body") or tag in VOID:
                continue
            closes = CLOSED_BY.get(tag)
            if tag in CLOSES_P and opened["p"]:
                close({"p"}, P_SCOPE)
            elif closes and any(opened[t] for t in closes):
                close(closes, SCOPE.get(tag, {"table"}))
            opened[tag] += 1
            stack.append((tag, self.add(tag, stack[-1][1], attribute_flags(m[3]) if m[3] else 0)))
        say(source[at:])
        flush()
        while stack:
            pop()

    def add(self, tag: str, parent: int, flags: int) -> int:
        node = len(self.group)
        self.group.append(GROUP_OF.get(tag, OTHER))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.flags.append(flags)
        self.end.append(node + 1)
        for counts in (self.chars, self.links, self.words, self.stops):
            counts.append(0)
        return node


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of all pages, in order."""
    size = np.array([len(p.group) for p in pages])
    first = np.cumsum(size) - size
    page = np.repeat(np.arange(len(pages)), size)
    column = lambda name: np.concatenate([np.array(getattr(p, name), dtype=np.int64) for p in pages])
    group, depth, flags = column("group"), column("depth"), column("flags")
    node = np.arange(len(group))
    end = column("end") + first[page]
    parent = column("parent")
    parent = np.where(parent < 0, node, parent + first[page])

    def subtree(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[end] - sums[node]

    def above(x: np.ndarray) -> np.ndarray:
        """Whether x holds for an ancestor (not the node itself)."""
        return np.cumsum(np.bincount(node[x] + 1, minlength=len(x) + 1) - np.bincount(end[x], minlength=len(x) + 1))[:-1] > 0

    chars, links, words, stops = (subtree(column(c)) for c in ("chars", "links", "words", "stops"))
    is_text = group == 0
    blocks, kids = subtree(is_text.astype(np.int64)), end - node
    paragraphs = subtree((group == 1).astype(np.int64))
    noise, main, hidden, pure = (flags & 1) > 0, (flags & 2) > 0, (flags & 4) > 0, (flags & 8) > 0
    total = chars[first][page]
    before = np.concatenate([[0], np.cumsum(np.where(is_text, chars, 0))])
    offset = before[node] - before[first][page]
    # Places among siblings: nodes in order of parent are in order of place.
    by_parent = np.lexsort((node, parent))
    sorted_parent = parent[by_parent]
    starts = np.concatenate([[True], sorted_parent[1:] != sorted_parent[:-1]])
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(node)), 0))
    place = np.empty(len(node), dtype=np.int64)
    place[by_parent] = np.arange(len(node)) - begin
    siblings = np.bincount(parent, minlength=len(node))[parent]
    same = np.bincount(parent * (OTHER + 1) + group, minlength=len(node) * (OTHER + 1))[parent * (OTHER + 1) + group]
    one = np.maximum
    # Whether an article or a main element is in the page, and in the subtree; forms and buttons in the subtree.
    parts = [subtree((group == GROUP_OF[t]).astype(np.int64)) for t in ("article", "main", "form")]
    parts = [parts[0][first][page] > 0, parts[1][first][page] > 0, parts[0] > 0, parts[1] > 0, np.log1p(parts[2])]
    up_group = [above(group == g) for g in (5, 6, 7, 8, 9, 10, 12, 4, 3)]
    columns = [
        *((group == g) for g in range(OTHER + 1)), depth, np.log1p(chars), np.log1p(words), links / one(chars, 1), stops / one(words, 1), words / one(blocks, 1), chars / kids, np.log1p(kids), np.log1p(blocks), np.log1p(paragraphs),
        chars / one(total, 1), chars / one(chars[parent], 1), offset / one(total, 1), place, place / one(siblings, 1), same / one(siblings, 1), np.log1p(siblings), noise, main, hidden, pure, above(noise), above(main), above(hidden), above(pure), *up_group,
        *((group[parent] == g) for g in (1, 2, 4, 15, 16, 17)), noise[parent], main[parent], links[parent] / one(chars[parent], 1), np.log1p(chars[parent]), np.log1p(paragraphs[parent]), *parts, subtree((noise | hidden).astype(np.int64)) / kids,
    ]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


def training_pages(count: int, seed: int = 11) -> list[str]:
    """Generated pages of many layouts, with MARK in every block of main text."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tu sa vel dor pin esh ar con ti mun gra bel".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        out = [word() for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.6:
            out = [w + (r.choice(",.;") if r.random() < 0.15 else "") for w in out]
        elif style < 0.7:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.8:
            out = [w + r.choice(["***", "%%%", "&amp;&amp;"]) for w in out]
        elif style < 0.85:
            out = [w + " |" for w in out]
        return " ".join(out).capitalize() + r.choice([".", ".", ""])

    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda low=3, high=9: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(low, high))) + "</ul>"
    name = lambda *options: r.choice(options)

    def wrap(body: str, tags: str, names: str, plain: float = 0.25) -> str:
        tag = r.choice(tags.split())
        attribute = "" if tag != "div" and r.random() < plain else f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}"'
        return f"<{tag}{attribute}>{body}</{tag}>"

    def menu() -> str:
        if r.random() < 0.15:  # prose in a menu is no main text either
            body = "".join(f"<p>{words(5, 60)}</p>" for _ in range(r.randint(1, 3)))
            for _ in range(r.randint(0, 3)):
                body = f"<div>{body}</div>"
            return f"<nav>{body}</nav>"
        return wrap(links() if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(3, 8))), "nav nav div", "nav menu navbar main-menu top-nav")

    def noise() -> str:
        kind = r.randrange(7)
        if kind == 0:
            return wrap(words(3, 30), "div div aside section", "ad ads advert banner promo sponsored ad-slot")
        if kind == 1:
            return wrap(f"<h3>{words(1, 3)}</h3>{links()}", "aside div", "sidebar related widget sidebar-right")
        if kind == 2:
            return wrap(f"<p>{words(6, 25)} <button>{words(1, 2)}</button></p>", "div section", "cookie-notice notice cookie-banner alert popup")
        if kind == 3:
            return f"<form class=\"{name('subscribe', 'search', 'newsletter', 'login')}\"><label>{words(2, 6)}</label><input name=q><button>{words(1, 2)}</button></form>"
        if kind == 4:
            return wrap(" ".join(link() for _ in range(3)), "div", "share social-share tags breadcrumb pagination")
        if kind == 5:
            return wrap(words(4, 20), "aside", "x")
        return wrap(f"<p>{words(5, 20)}</p>", "div", "promo newsletter ad sponsor")

    def comments() -> str:
        item = lambda: f'<{(t := name("div", "li", "article"))} class="comment"><p>{words(1, 3)}</p><p>{words(5, 60)}</p></{t}>'
        return f"<{(t := name('section', 'div'))} {name('id', 'class')}=\"{name('comments', 'reader-comments', 'replies', 'disqus')}\"><h2>{words(1, 3)}</h2>{''.join(item() for _ in range(r.randint(1, 6)))}</{t}>"

    def main() -> str:
        out = [f"<h1>{MARK}{words(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.55:
                out.append(f"<p>{MARK}{words(1, 90)}</p>")
            elif kind < 0.68:
                out.append(f"<p><b>{MARK}{words(1, 60)}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{MARK}{words(1, 6)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{MARK}{words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{MARK}{words(5, 40)}</blockquote>")
            elif kind < 0.90:
                out.append(f"<div>{MARK}{words(10, 80)}</div>")
            elif kind < 0.93:
                out.append(f"<p>{MARK}{words(4, 20)} {link()} {words(3, 12)}</p>")
            elif kind < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{MARK}{words(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                out.append(f"<pre>{MARK}{words(5, 20)}</pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{MARK}{words(3, 12)}</figcaption></figure>")
        while r.random() < 0.25:
            out.insert(r.randint(0, len(out)), noise())
        body = "".join(out)
        kind = r.random()
        # Names of main text may hold a word of menus or comments.
        odd = f"{name('comment', 'header', 'sidebar', 'ad', 'menu', 'footer', 'related', 'cookie', 'newsletter')}-{name('policy', 'free', 'story', 'guide', 'less', 'review', 'facts')}"
        if kind < 0.1:
            return f"<article {name('class', 'id')}=\"{odd}\">{body}</article>"
        if kind < 0.14:
            return f"<{(t := name('div', 'section', 'main'))} class=\"{name(odd, 'content ' + odd, 'no-sidebar content', 'post has-comments')}\">{body}</{t}>"
        if kind < 0.5:
            return f"<article>{body}</article>"
        if kind < 0.62:
            return f"<main>{body}</main>"
        if kind < 0.9:
            return wrap(body, "div section", "content post-content entry article-body story main-content post text")
        return f"<div>{body}</div>" if kind < 0.95 else body

    made = []
    for _ in range(count):
        parts = []
        if r.random() < 0.05:  # nothing but the text
            made.append("".join(f"<p>{MARK}{words(1, 40)}</p>" for _ in range(r.randint(1, 4))))
            continue
        if r.random() < 0.5:
            parts.append(wrap(f"<p>{words(1, 5)}</p>" + (menu() if r.random() < 0.5 else ""), "header div", "header site-header masthead topbar"))
        if r.random() < 0.8:
            parts.append(menu())
        parts += [noise() for _ in range(r.choice([0, 1, 1, 2]))]
        parts.append(main())
        if r.random() < 0.3:
            parts.append(comments())
        parts += [noise() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.85:
            parts.append(wrap(f"&copy; {words(1, 4)} &middot; {words(2, 20)}" + (links() if r.random() < 0.4 else ""), "footer footer div", "footer site-footer foot", 0.7))
        page = "<html><head><title>x</title></head><body>" + "".join(f"<div class={name('wrap', 'row', 'col')}>{p}</div>" if r.random() < 0.1 else p for p in parts) + "</body></html>"
        made.append(page[: len(page) - r.randint(0, 20)] if r.random() < 0.1 else page)
    return made


@lru_cache(maxsize=1)
def model(count: int = 480) -> trees.Trees:
    """Trees fitted on generated pages: a node is positive if its subtree has main text."""
    pages = [Page(x, marks=True) for x in training_pages(count)]
    y = []
    for p in pages:
        marks = np.zeros(len(p.group) + 1, dtype=np.int64)
        marks[[*(m + 1 for m in p.marked)]] = 1
        sums = np.cumsum(marks)
        y.append(sums[np.array(p.end)] - sums[np.arange(len(p.group))] > 0)
    return trees.fit(features(pages), np.concatenate(y).astype(float), rounds=60, depth=4, rate=0.25)


def decode(page: Page, yes: list[float], no: list[float]) -> list[str]:
    """The kept blocks. yes, no: logarithms of the probabilities that a node has main text or none."""
    n = len(page.group)
    drop = [0.0] * n
    best = [0.0] * n
    keep = [0.0] * n
    parent = page.parent
    below_best, below_drop = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        keep[i] = yes[i] + below_best[i] if page.group[i] != NAV else float("-inf")
        drop[i] = no[i] + below_drop[i]
        best[i] = max(keep[i], drop[i])
        below_best[parent[i]] += best[i]
        below_drop[parent[i]] += drop[i]
    kept, out = [False] * n, []
    for i in range(n):
        kept[i] = keep[i] >= drop[i] and (parent[i] < 0 or kept[parent[i]])
        if kept[i] and (text := page.texts.get(i)) is not None:
            out.append(text)
    return out


def extract(sources: list[str | None], chosen: trees.Trees) -> list[str]:
    pages = [Page(x or "") for x in sources]
    p = np.clip(chosen.probability(features(pages)), 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    out, at = [], 0
    for page in pages:
        n = len(page.group)
        out.append(" ".join(decode(page, yes[at : at + n], no[at : at + n])))
        at += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html", 1 << 20):
                texts = extract(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
