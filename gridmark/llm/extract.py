"""Main text of web pages by tag-path ratios.

A page becomes a tree of block elements and a sequence of text blocks.  Every different path of tags
and names from the root is one observation: how much text outside links and how much punctuation its
blocks carry per block.  The two ratios are smoothed along the page and fused into one score.  A block
weighs its score times its text; names and tags that usually mark a menu, notice or comment are one
factor of that weight, as the article's own tags are.  From the root the search goes into the only
child whose weight is not far below the heaviest one's; where there is more than one such child, or
only text, it has found the region of the article, whose blocks are the result.

Reading, paths and weights are linear in the page: a tag is looked at once, paths are numbers in a
tree, and sums go from the leaves up.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the heaviest child's weight from which another child is content too; so is one whose heaviest block has the same path.
THRESHOLD = 0.25
#: Neighbouring blocks, on each side, that a ratio is smoothed over, and their weight.
SMOOTHING = (0.25, 0.5, 0.25)
#: Factors of a block's weight inside elements named like boilerplate, and inside article and main.
STRANGE_WEIGHT, OWN_WEIGHT = 0.01, 10.0

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMED = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_QUOTE = re.compile(r"[>\"']")
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_SPOKEN = re.compile(r"[.,;:!?…。，！？؟،]")
_RAW = frozenset("script style textarea title noscript template svg math iframe object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Tags that usually hold no part of the article.
_ASIDE = frozenset("nav header footer aside form button select option dialog menu head".split())
#: A class, id or role says so too if its words are some of the first set and else only some of the second.
_STRANGE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent "
                     "disqus footer header masthead menu menubar nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar "
                     "social sponsor sponsored subscribe toolbar widget".split())
_PLAIN = frozenset("area bar block bottom box button buttons col column container content footer form global group icons inner item items left link links list "
                   "main message module outer page panel primary reader right row secondary section site sticky sub text thread top unit user users web wrap wrapper".split())
#: Words that make a header or footer of the first set one of the article's own.
_OWN = frozenset("article entry post story".split())
#: A start tag of the first set ends an open tag of the second (optional end tags).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def strange_name(name: str) -> bool:
    """Whether one word of a class, id or role is put together like the name of boilerplate: ``site-footer``, not ``notice-period``."""
    words = {w.lower() for w in _WORDS.split(name) if w}
    some = words & _STRANGE
    return bool(some) and words <= _STRANGE | _PLAIN and words.isdisjoint(_OWN)


def _tags(page: str) -> Iterator[tuple[str, bool, str]]:
    """(tag, whether an end tag, attributes) or ("", False, text), in order; what no tag can be is text, a tag cut short is dropped with what follows.

    Every character is passed a bounded number of times: once a quoted attribute turns out never to
    end, quotes are no longer heeded.
    """
    at, n, strict = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "", False, page[at:]
            return
        if lt > at:
            yield "", False, page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("/", lt + 1)
        name = _OPEN.match(page, lt + 1 + closing)
        if name is None:
            yield "", False, "<"
            at = lt + 1
            continue
        end = begin = name.end()
        while strict:
            found = _QUOTE.search(page, end)
            if found is None:
                strict = False
            elif found[0] == ">":
                end = found.start()
                break
            else:
                end = page.find(found[0], found.end()) + 1
                strict = end > 0
        if not strict:
            end = page.find(">", begin)
        if end < 0:
            return
        tag = name[0].lower()
        yield tag, closing, page[begin:end]
        at = end + 1
        if tag in _RAW and not closing and not page.startswith("/", end - 1):
            stop = re.compile(f"</{re.escape(tag)}(?![a-z0-9])[^>]*>?", re.I).search(page, at)
            if stop is None:
                return
            at = stop.end()


class _Page:
    """Block elements (parent, tag, path, how many on the way are named like boilerplate, whether in an article) and text blocks in page order."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.strange, self.own = [-1], ["html"], [0], [0], [False]
        self.node, self.text, self.linked = [], [], []
        self.paths: dict[tuple[int, str], int] = {}
        stack, open_tags, text, links = [0], {}, [], 0
        link_depth = 0  # blocks open where the link began, 0 outside links

        def close() -> None:
            nonlocal text, links
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                self.node.append(stack[-1])
                self.text.append(whole)
                self.linked.append(min(links, len(whole)))
            text, links = [], 0

        def leave() -> None:
            nonlocal link_depth
            open_tags[self.tag[stack.pop()]] -= 1
            link_depth = 0 if len(stack) < link_depth else link_depth

        for tag, closing, rest in _tags(page):
            if not tag:
                text.append(rest)
                links += len(rest) if link_depth else 0
            elif tag == "a":
                link_depth = 0 if closing else len(stack)
            elif tag in _VOID:
                if tag == "hr":
                    close()
                if tag != "wbr":
                    text.append(" ")
            elif tag in _BLOCK and closing:
                close()
                if open_tags.get(tag):
                    while self.tag[stack[-1]] != tag:
                        leave()
                    leave()
            elif tag in _BLOCK:
                close()
                ends = _CLOSES.get(tag, ())
                while len(stack) > 1 and (self.tag[stack[-1]] == "p" or self.tag[stack[-1]] in ends):
                    leave()
                names = [w for g in _NAMED.findall(rest) for w in "".join(g).split()]
                self._element(stack[-1], tag, names)
                stack.append(len(self.tag) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        close()

    def _element(self, parent: int, tag: str, names: list[str]) -> None:
        step = ".".join([tag, *names])
        self.path.append(self.paths.setdefault((self.path[parent], step), len(self.paths) + 1))
        whole = tag in ("html", "body", "article", "main")
        own = tag in ("article", "main") or "main" in names
        self.strange.append(self.strange[parent] + (not whole and (tag in _ASIDE or any(map(strange_name, names)))))
        self.own.append(self.own[parent] or own)
        self.parent.append(parent)
        self.tag.append(tag)

    def scores(self) -> np.ndarray:
        """The fused ratio of every block's path."""
        _, at = np.unique(np.array(self.path)[self.node], return_inverse=True)
        count = np.bincount(at)
        plain = np.array([len(t) - n for t, n in zip(self.text, self.linked)], float)  # text of links is no evidence
        spoken = np.array([len(_SPOKEN.findall(t)) if n < len(t) else 0 for t, n in zip(self.text, self.linked)], float)
        ratios = []
        for values in (plain, spoken + 1.0):
            per_path = np.bincount(at, values) / count
            along = np.convolve(np.pad(per_path[at], 1, mode="edge"), np.array(SMOOTHING), "valid")
            ratios.append(np.bincount(at, along) / count)
        return (ratios[0] * ratios[1])[at]


def _up(page: _Page, blocks: np.ndarray) -> np.ndarray:
    """Sums of a block value over every element's subtree; children come after their parents."""
    total = np.bincount(page.node, blocks, minlength=len(page.tag)).tolist()
    for i in range(len(total) - 1, 0, -1):
        total[page.parent[i]] += total[i]
    return np.array(total)


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article of one page, a block per line; empty if the page has none."""
    p = _Page(page or "")
    if not p.text:
        return ""
    node, tags, parent = np.array(p.node), p.tag, p.parent
    chars = np.array([len(t) for t in p.text], float)
    plain = chars - np.array(p.linked)
    score = p.scores()
    factor = STRANGE_WEIGHT ** np.minimum(np.array(p.strange)[node], 5) * np.where(np.array(p.own)[node], OWN_WEIGHT, 1.0)
    weight = score * factor * plain
    if not weight.any():
        return ""
    mass, all_chars, all_plain = _up(p, weight), _up(p, chars), _up(p, plain)
    blocks_of: dict[int, list[int]] = {}
    for b, x in enumerate(p.node):
        blocks_of.setdefault(x, []).append(b)
    children: dict[int, list[int]] = {}
    for x in range(1, len(tags)):
        if all_chars[x]:
            children.setdefault(parent[x], []).append(x)
    first = np.full(len(tags), len(node))
    np.minimum.at(first, node, np.arange(len(node)))
    for x in range(len(tags) - 1, 0, -1):
        first[parent[x]] = min(first[parent[x]], first[x])

    top = np.full(len(tags), -1)  # heaviest block of every element
    for b in np.argsort(weight, kind="stable").tolist():
        top[node[b]] = b
    for x in range(len(tags) - 1, 0, -1):
        if top[x] >= 0 and (top[parent[x]] < 0 or weight[top[x]] > weight[top[parent[x]]]):
            top[parent[x]] = top[x]

    def route(unit: tuple[int, float, int | None]) -> int:
        return p.path[node[unit[0] if unit[2] is None else top[unit[2]]]]

    def is_content(unit: tuple[int, float, int | None], best: tuple[int, float, int | None]) -> bool:
        return unit[1] >= threshold * best[1] and (unit[1] > 0 or threshold <= 0) or unit[1] > 0 and route(unit) == route(best)

    def units(x: int) -> list[tuple[int, float, int | None]]:
        """(first block, weight, element or None for text of ``x`` itself) in page order."""
        return sorted([(b, float(weight[b]), None) for b in blocks_of.get(x, ())] + [(int(first[c]), float(mass[c]), c) for c in children.get(x, ())])

    keep = np.zeros(len(node), bool)
    region = 0
    while True:
        inside = units(region)
        most = max(inside, key=lambda u: u[1])
        content = [u for u in inside if is_content(u, most)]
        child = content[0][2] if len(content) == 1 else None
        if child is None or child not in children or tags[region] in ("article", "main"):
            break
        for b, _, x in reversed(inside[:inside.index(content[0])]):  # headings right before what is entered
            if x is None or tags[x] not in _HEADING:
                break
            keep[b] = True
        region = child

    outer = tags[region] in ("html", "body")
    low, high = inside.index(content[0]), inside.index(content[-1])
    led = low  # headings right before the content
    while led and inside[led - 1][2] is not None and tags[inside[led - 1][2]] in _HEADING:
        led -= 1
    dropped = set()
    if tags[region] not in ("article", "main"):
        for i, (b, w, x) in enumerate(inside):
            links = (2 * all_plain[x] < all_chars[x]) if x is not None else (2 * plain[b] < chars[b])
            between = low <= i <= high
            if outer and not (is_content((b, w, x), most) or between and not links or led <= i < low):
                dropped.add((b, x))
            elif not outer and not between and links and x in children:
                dropped.add((b, x))
    # what of the elements is left: inside the region, in no dropped child, and in none named like boilerplate unless its ratio stands out
    state = np.zeros(len(tags), bool)
    state[region] = True
    gone = {x for _, x in dropped if x is not None}
    calm = np.array(p.strange)[node] == p.strange[region]
    ratio, calm_ratio, calm_plain = _up(p, score * plain), _up(p, np.where(calm, score * plain, 0.0))[region], _up(p, np.where(calm, plain, 0.0))[region]
    usual = calm_ratio / calm_plain if calm_plain else ratio[region] / max(float(all_plain[region]), 1.0)
    for x in range(region + 1, len(tags)):
        if state[parent[x]] and x not in gone:
            named = p.strange[x] > p.strange[parent[x]]
            state[x] = not named or STRANGE_WEIGHT * ratio[x] >= threshold * usual * max(float(all_plain[x]), 1.0)
    own_gone = {b for b, x in dropped if x is None}
    for b in range(len(node)):
        keep[b] |= bool(state[node[b]]) and b not in own_gone
    return "\n".join(t for t, k in zip(p.text, keep.tolist()) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, url, text, n_chars)`` of every row.

    Character references are decoded, white space inside a block is one space, blocks are joined in
    page order by a line feed.  Null, empty and article-less pages have the empty text; repeated rows
    and null keys are rows like any other.  Ill-formed, deep and very long pages take time in proportion
    to their length; a tag, comment or script that never ends takes the rest of its page with it.
    """
    schema = pages.select(key, url).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [main_text(p, threshold) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 schema.names)

    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, schema)
