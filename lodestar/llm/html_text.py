"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A tolerant scanner builds the tree of block-level nodes in one pass; inline markup only contributes its text. Each
node has features of itself and of its subtree: tag, depth, text and link density, sentence punctuation, attribute
tokens of its own and of its ancestors, its place among its siblings and theirs in text. Trees boosted for the
logistic loss give each node the probability that it or something below it is main text. Decoding maximises the
sum of log-odds under the rule that nothing below a dropped node is kept, so ancestors and descendants never
contradict each other. A kept node's own text runs are its blocks.

The model is fitted on the driver once a process, on pages composed from a fixed seed out of layouts whose main text
is known (`training_pages`); it is a few kilobytes and the same in every run.

Defined results: no text for null and empty pages and for an empty table no rows; a page without tags is one block.
Unclosed and stray tags follow the usual repairs. A quote that never closes, or whose value runs past a > into the
next tag, ends with its tag, so that text is not lost; a tag without > at the end of a page is dropped. Very long
pages are whole and take time in proportion to their length. Repeated rows are extracted each for itself. Columns
other than those named are not read, so they may have any name.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("script style template noscript iframe object embed svg math canvas head title meta link select option textarea button input xmp noembed noframes audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
#: Tags that have a feature of their own.
TAGS = ("body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "dl", "dd")
GOOD_WORDS = frozenset("article content post entry story body text main page hentry blog read prose".split())
BAD_WORDS = frozenset("ad ads advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments consent contact cookie cookies copyright disqus footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice outbrain pagination pager popup privacy promo promotion promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toc toolbar trending widget widgets".split())

NAME = re.compile(r"[^\t\n\f\r />]*+")
BETWEEN = re.compile(r"[\t\n\f\r /]*+")
ATTRIBUTE = re.compile(r"([^\t\n\f\r />][^\t\n\f\r />=]*+)[\t\n\f\r ]*+(=[\t\n\f\r ]*+)?+")
BARE = re.compile(r"[^\t\n\f\r >]*+")
RUNS_ON = re.compile(r"[^<>]*+>[^<]*+</?[a-zA-Z]")
NONE = re.compile(r"display\s*+:\s*+none", re.I)
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "hidden", "runs", "n_links", "link_chars", "children", "first", "last")

    def __init__(self, tag: str, parent: int, depth: int, attributes: list[tuple[str, str]]):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.good = self.bad = 0
        self.hidden = tag in NEVER
        for name, value in attributes:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and NONE.search(value)):
                self.hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                words = {w.lower() for w in SPLIT.split(value) if w}
                self.good += len(words & GOOD_WORDS)
                self.bad += len(words & BAD_WORDS)
        self.runs: list[tuple[int, list[str]]] = []  # number on the page, and pieces
        self.n_links = self.link_chars = 0
        self.children: list[int] = []


class Scanner:
    """Text and tags of a page from left to right. No place is searched again for what is not there."""

    def __init__(self, source: str):
        self.source, self.pos = source, 0
        self.gone: set[str] = set()  # what does not occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def skip_to(self, what: str, at: int) -> None:
        found = self.find(what, at)
        self.pos = len(self.source) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int] | None:
        """Attributes from `at` on, whether the tag closes itself, and its end; None where the page ends before."""
        source, out = self.source, []
        while True:
            start = at
            at = BETWEEN.match(source, at).end()
            if at >= len(source):
                return None
            if source[at] == ">":
                return out, at > start and source[at - 1] == "/", at + 1
            m = ATTRIBUTE.match(source, at)
            name, at = m[1].lower(), m.end()
            if not m[2]:
                out.append((name, ""))
            elif source[at : at + 1] in ("'", '"'):
                close = self.find(source[at], at + 1)
                if close < 0 or RUNS_ON.match(source, at + 1, close):
                    end = self.find(">", at + 1)
                    if end < 0:
                        return None
                    return [*out, (name, source[at + 1 : end])], False, end + 1
                out.append((name, source[at + 1 : close]))
                at = close + 1
            else:
                m = BARE.match(source, at)
                out.append((name, m[0]))
                at = m.end()

    def __iter__(self) -> Iterator[tuple[str | None, str, list[tuple[str, str]], bool]]:
        """(tag, text, attributes, closes itself): text where tag is null; an end tag's name starts with /."""
        source, said = self.source, 0
        while True:
            at = self.find("<", self.pos)
            if at < 0:
                if said < len(source):
                    yield None, source[said:], [], False
                return
            nxt, after = source[at + 1 : at + 2], source[at + 2 : at + 3]
            is_tag = nxt.isascii() and nxt.isalpha() or (nxt == "/" and after.isascii() and after.isalpha())
            if not is_tag and nxt not in ("!", "?") and not (nxt == "/" and after):
                self.pos = at + 1  # a < of the text
                continue
            if at > said:
                yield None, source[said:at], [], False
            if is_tag:
                m = NAME.match(source, at + 1 + (nxt == "/"))
                made = self.attributes(m.end())
                if made is None:
                    return
                self.pos = said = made[2]
                yield ("/" if nxt == "/" else "") + m[0].lower(), "", made[0], made[1]
            elif source.startswith("<!--", at):
                if source.startswith((">", "->"), at + 4):
                    self.skip_to(">", at + 4)
                else:
                    ends = [k for k in (self.find("-->", at + 4), self.find("--!>", at + 4)) if k >= 0]
                    self.pos = self.source.index(">", min(ends)) + 1 if ends else len(source)
            elif source.startswith("<![CDATA[", at):
                end = self.find("]]>", at + 9)
                end = len(source) if end < 0 else end
                yield None, html.escape(source[at + 9 : end]), [], False
                self.pos = end + 3
            else:
                self.skip_to(">", at + 2)
            said = self.pos

    def skip_raw(self, tag: str) -> None:
        """Passes the content of an element that holds no markup, and its end tag."""
        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.source, self.pos)
        self.skip_to(">", close.end()) if close else self.skip_to("", len(self.source))


def parse(source: str) -> list[Node]:
    """Block-level nodes in page order; node 0 is the page."""
    nodes = [Node("html", -1, 0, [])]
    stack: list[tuple[str, int]] = [("html", 0)]  # open tags, inline ones with their block
    places: dict[str, list[int]] = {}  # of each open tag on the stack
    run: list[str] | None = None
    n_runs, in_link = 0, 0

    def say(piece: str) -> None:
        nonlocal run, n_runs
        owner = nodes[stack[-1][1]]
        if run is None:
            if not piece or piece.isspace():
                return
            run = []
            owner.runs.append((n_runs, run))
            n_runs += 1
        run.append(piece)
        if in_link:
            owner.link_chars += len(piece.strip())

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def shut(at: int) -> None:
        """Closes what is open from place `at` of the stack on."""
        nonlocal run, in_link
        for tag, _ in stack[at:]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in INLINE:
                run = None
            places[tag].pop()
        del stack[at:]

    def opened(tags, fence) -> int:
        """The place of the innermost open one of `tags`, 0 if a tag of `fence` stands between or none is open."""
        at = max((places[t][-1] for t in tags if places.get(t)), default=0)
        wall = max((places[t][-1] for t in fence if t not in tags and places.get(t)), default=0)
        return at if at > wall else 0

    def block(tag: str, attributes) -> None:
        nonlocal run
        run = None
        up = stack[-1][1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, attributes))
        nodes[up].children.append(len(nodes) - 1)
        push(tag, len(nodes) - 1)

    page = Scanner(source)
    for tag, text, attributes, closes_itself in page:
        if tag is None:
            say(html.unescape(text))
        elif tag[0] == "/":
            tag = tag[1:]
            if tag == "p" and not opened({"p"}, ()):
                run = None
            elif k := opened({tag}, () if tag in ("body", "html", "table") or tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else {"table"}):
                shut(k)
        elif tag == "br":
            say(" ") if run is not None else None
        elif tag in VOID:
            if tag == "hr":
                run = None
        elif tag in RAW:
            page.skip_raw(tag)
        elif tag in ("html", "head") or (tag == "body" and opened({"body"}, ())):
            if tag == "head":
                block(tag, attributes)
        else:
            if tag == "body" and (k := opened({"head"}, ())):
                shut(k)
            if tag in CLOSES_P and (k := opened({"p"}, {"table", "td", "th", "button", "object"})):
                shut(k)
            if tag in ENDS and (k := opened(ENDS[tag], FENCE[tag])):
                shut(k)
            if tag == "a" and (k := opened({"a"}, {"table", "td"})):
                shut(k)
            if tag in INLINE and (tag == "a" or not any("hidden" in n or "hidden" in v or NONE.search(v) for n, v in attributes)):
                if tag == "a":
                    nodes[stack[-1][1]].n_links += 1
                if not closes_itself:
                    in_link += tag == "a"
                    push(tag, stack[-1][1])
            elif not (closes_itself and tag in ("svg", "path", "embed")):
                block(tag, attributes)
    return nodes


SENTENCE = re.compile(r"[.!?…。](?:\s|$)|,\s")
N_FEATURES = 24 + len(TAGS)


def blocks_of(node: Node) -> list[tuple[int, str]]:
    """The node's own text runs with white space made one and trimmed, without empty ones."""
    return [(k, t) for k, pieces in node.runs if (t := SPACE.sub(" ", "".join(pieces)).strip())]


def features(nodes: list[Node]) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """A row for each node, and its blocks."""
    n = len(nodes)
    blocks = [blocks_of(x) for x in nodes]
    own = np.array([sum(len(t) for _, t in b) for b in blocks], float)
    punct = np.array([sum(len(SENTENCE.findall(t)) for _, t in b) for b in blocks], float)
    link = np.array([x.link_chars for x in nodes], float)
    links = np.array([x.n_links for x in nodes], float)
    chars, marks, in_links, n_links, size, paragraphs = own.copy(), punct.copy(), link.copy(), links.copy(), np.ones(n), np.array([x.tag == "p" for x in nodes], float)
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = nodes[k].parent
        for total in (chars, marks, in_links, n_links, size, paragraphs):
            total[up] += total[k]
    bad, good = np.array([x.bad for x in nodes], float), np.array([x.good for x in nodes], float)
    nav = {"nav": 1, "footer": 1, "aside": 1, "header": 1, "form": 1, "menu": 1}
    weak = np.array([x.tag in nav for x in nodes], float)
    strong = np.array([x.tag in ("article", "main") for x in nodes], float)
    hidden = np.array([x.hidden for x in nodes], float)
    up_bad, up_good, up_weak, up_strong, up_hidden = (np.zeros(n) for _ in range(5))
    place, among, same = np.zeros(n), np.ones(n), np.ones(n)
    for k, x in enumerate(nodes):
        if k:
            p = x.parent
            up_bad[k], up_good[k] = up_bad[p] + bad[p], up_good[p] + good[p]
            up_weak[k], up_strong[k], up_hidden[k] = max(up_weak[p], weak[p]), max(up_strong[p], strong[p]), max(up_hidden[p], hidden[p])
        if x.children:
            tags: dict[str, int] = {}
            for c in x.children:
                tags[nodes[c].tag] = tags.get(nodes[c].tag, 0) + 1
            for j, c in enumerate(x.children):
                place[c], among[c], same[c] = j, len(x.children), tags[nodes[c].tag]
    parent = np.array([max(0, x.parent) for x in nodes])
    total = max(1.0, chars[0])
    out = np.zeros((n, N_FEATURES), np.float32)
    columns = [
        [x.depth for x in nodes], own, chars, chars / total, own / np.maximum(chars, 1), chars / size, size, in_links / np.maximum(chars, 1), n_links, n_links / size,
        marks, marks / np.maximum(chars, 1) * 100, paragraphs, place, place / among, among, same / among, chars / np.maximum(chars[parent], 1),
        bad, np.minimum(up_bad, 3), good, np.minimum(up_good, 3), np.minimum(up_weak, 1) + 2 * np.minimum(up_strong, 1), np.maximum(hidden, up_hidden),
    ]
    for c, values in enumerate(columns):
        out[:, c] = values
    at = {t: c for c, t in enumerate(TAGS, len(columns))}
    for k, x in enumerate(nodes):
        if x.tag in at:
            out[k, at[x.tag]] = 1
    return out, blocks


class Boosted:
    """Regression trees of fixed depth, boosted for the logistic loss on quantile bins."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.cut, self.leaf, self.start = feature, cut, leaf, start

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25, l2: float = 2.0, bins: int = 32) -> Boosted:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score = np.full(len(y), start := float(np.log(y.mean() / (1 - y.mean()))))
    inner, wide = 2**depth - 1, x.shape[1]
    all_f, all_c, all_leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            key = ((at - low)[:, None] * wide + np.arange(wide)) * bins + coded
            sums = [np.bincount(key.ravel(), np.repeat(w, wide), count * wide * bins).reshape(count, wide, bins) for w in (g, h)]
            left_g, left_h = (np.cumsum(s, 2) for s in sums)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < 0.5) | (right_h < 0.5)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    f[low + k], c[low + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        leaf_of = at - inner
        sums = [np.bincount(leaf_of, w, inner + 1) for w in (g, h)]
        leaf = rate * sums[0] / (sums[1] + l2)
        score += leaf[leaf_of]
        all_f.append(f), all_c.append(c), all_leaf.append(leaf)
    return Boosted(np.array(all_f), np.array(all_c, np.float32), np.array(all_leaf), start)


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely choice in which nothing below a dropped node is kept.

    Text counts: a node weighs 1 and more with its own text. Hidden nodes and those that never show are dropped.
    """
    weight = log_odds * np.array([1 + sum(len(p) for _, r in x.runs for p in r) / 50 for x in nodes])
    keep_value = weight.copy()
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].hidden:
            keep_value[k] = -np.inf
        if k and keep_value[k] > 0:
            keep_value[nodes[k].parent] += keep_value[k]
    kept = np.zeros(len(nodes), bool)
    for k, x in enumerate(nodes):
        kept[k] = (k == 0 or kept[x.parent]) and (k == 0 or keep_value[k] > 0)
    return kept


PAGES_AT_ONCE = 256


def main_texts(sources: list[str | None], model: Boosted) -> Iterator[str]:
    """The main text of each page. Trees are walked for the nodes of many pages at once."""
    for at in range(0, len(sources), PAGES_AT_ONCE):
        trees = [parse(s) if s else [] for s in sources[at : at + PAGES_AT_ONCE]]
        rows = [features(nodes) for nodes in trees if nodes]
        scores = model.log_odds(np.concatenate([x for x, _ in rows])) if rows else np.zeros(0)
        left, first = iter(rows), 0
        for nodes in trees:
            if not nodes:
                yield ""
                continue
            _, blocks = next(left)
            kept = decode(nodes, scores[first : first + len(nodes)])
            first += len(nodes)
            yield "\n".join(t for _, t in sorted(b for k in np.flatnonzero(kept) for b in blocks[k]))


# --- training pages -------------------------------------------------------------------------------------------


def training_pages(n: int = 400, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Pages of many layouts with the set of their main-text blocks. Words are made of random syllables."""
    rng = np.random.Generator(np.random.PCG64(seed))
    syllables = "an be con der el fi ga ho in jo ka lo mi nor or pe qu re st ti un va wer xi ya zo é ü ñ".split()

    vocabulary = np.array(["".join(syllables[k] for k in rng.integers(0, len(syllables), rng.integers(1, 5))) for _ in range(3000)], object)

    def word() -> str:
        return vocabulary[rng.integers(len(vocabulary))]

    def words(low: int, high: int) -> str:
        return " ".join(vocabulary[rng.integers(0, len(vocabulary), rng.integers(low, high))])

    def sentence() -> str:
        s = words(3, 22)
        if rng.random() < 0.5:
            s += ", " + words(2, 10)
        return s.capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(low: int = 1, high: int = 8) -> str:
        return " ".join(sentence() for _ in range(rng.integers(low, high)))

    def pick(*options):
        return options[rng.integers(len(options))]

    def links(low: int, high: int) -> str:
        kind = rng.integers(3)
        items = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(rng.integers(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if kind < 2 else " | ".join(items)

    def noise(kind: str) -> str:
        if kind == "menu":
            return pick("<nav>{}</nav>", '<div class="nav menu">{}</div>', '<div id="navigation">{}</div>', '<header><nav>{}</nav></header>', "<div><ul>{}</ul></div>").format(links(3, 9))
        if kind == "ad":
            return pick('<div class="ad">{}</div>', '<div class="advert-box"><p>{}</p></div>', '<aside class="sponsored">{}</aside>', '<div id="ads">{}</div>', '<section class="promo"><h3>{}</h3></section>').format(prose(1, 4))
        if kind == "notice":
            return pick('<div class="cookie-notice"><p>{}</p><button>OK</button></div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>', '<div class="gdpr banner" role="dialog"><p>{}</p></div>').format(prose(1, 3))
        if kind == "side":
            inner = pick(links(2, 8), f"<h3>{words(1, 4)}</h3>" + links(2, 6), f"<p>{prose(1, 3)}</p>", f"<div class=widget><h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p></div>")
            return pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related"><h2>More</h2>{}</div>', '<section class="newsletter">{}</section>').format(inner)
        if kind == "form":
            return pick("<form>{}<input></form>", '<form class="search"><label>{}</label><input type=text></form>', '<div class="login"><form><p>{}</p></form></div>').format(words(1, 9))
        if kind == "comments":
            each = "".join(pick("<div class=comment><p>{}</p></div>", "<li class='reply'>{}</li>", "<div class='comment-body'><b>x</b><p>{}</p></div>").format(prose(1, 6)) for _ in range(rng.integers(1, 7)))
            return pick('<section class="comments"><h3>Comments</h3>{}</section>', '<div id="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<div id="disqus" class="replies">{}</div>').format(each)
        if kind == "footer":
            return pick("<footer>{}</footer>", '<div class="footer"><p>{}</p></div>', '<div id="footer">{}</div>', "<footer><p>{}</p></footer>").format(pick("&copy; " + words(1, 4) + " &middot; " + prose(1, 4), links(2, 6), prose(1, 5)))
        return pick("<header><p>{}</p></header>", '<div class="header masthead">{}</div>', "<header><h1>{}</h1></header>").format(words(1, 6))

    for _ in range(n):
        main: list[str] = []

        def block(text: str, main=main) -> str:
            main.append(text)
            return text

        parts = [f"<h1>{block(words(2, 14))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 11)):
            r = rng.random()
            if r < 0.7:
                parts.append(f"<p>{block(prose())}" + pick("</p>", "</p>", ""))
            elif r < 0.78:
                parts.append(f"<h2>{block(words(1, 8))}</h2><p>{block(prose(1, 4))}</p>")
            elif r < 0.84:
                parts.append("<ul>" + "".join(f"<li>{block(pick(prose(1, 3), words(2, 9)))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif r < 0.89:
                parts.append(f"<blockquote>{block(prose(1, 3))}</blockquote>")
            elif r < 0.93:
                parts.append(f"<p><b>{block(prose(1, 3))}<br>")
            elif r < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{block(words(1, 4))}</td><td>{block(words(1, 5))}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            else:
                parts.append(noise(pick("ad", "ad", "side")))
        if rng.random() < 0.15:
            parts.append(noise("comments"))
        body = "".join(parts)
        body = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><div class="post entry">{}</div></div>', "<main><article>{}</article></main>", '<div class="page"><div>{}</div></div>', "<section>{}</section>", "<div>{}</div>", "{}").format(body)
        before = [noise(k) for k in ("header", "menu", "notice", "ad", "side", "form") if rng.random() < 0.4]
        after = [noise(k) for k in ("comments", "side", "ad", "form", "menu", "notice") if rng.random() < 0.3]
        if rng.random() < 0.8:
            after.append(noise("footer"))
        yield "<html><head><title>x</title></head><body>" + pick("{}", "{}", '<div id="wrapper">{}</div>').format("".join(before) + body + "".join(after)) + "</body></html>", set(main)


@functools.cache
def train() -> Boosted:
    """The model, fitted once a process."""
    xs, ys = [], []
    for page, main in training_pages():
        nodes = parse(page)
        x, blocks = features(nodes)
        y = np.array([any(t in main for _, t in b) for b in blocks], float)
        for k in range(len(nodes) - 1, 0, -1):
            y[nodes[k].parent] = max(y[nodes[k].parent], y[k])
        xs.append(x)
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, model: Boosted, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns of `keep`, text and n_chars (code points)."""
    slim = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    kept = slim.drop("__html").schema
    held = pages.sparkSession.sparkContext.broadcast((model.feature, model.cut, model.leaf, model.start))  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Boosted(*held.value)
        for batch in batches:
            texts = list(main_texts(batch.column(len(keep)).to_pylist(), m))
            cols = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return slim.mapInArrow(run, f"{out}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
