"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
CONTAINER = frozenset("article main section div td body html".split())
ENDS_P = BLOCK - frozenset("body html button caption legend option select summary tbody td tfoot th thead tr".split())
#: An element of the first kind is ended by the start of any of the second, up to an enclosing element of the third.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
#: Elements that never hold the article.
ASIDE = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu label fieldset title xmp noembed noframes".split())
#: Words in a class, id or role that mark any element as none of the article's, whatever other words stand beside them.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead sidebar sidebars comment comments commentlist disqus newsletter subscribe subscription copyright complementary contentinfo".split())
#: Words that hint at it; where such an element holds most of what the ratios select, or the article or main element, the hint is overruled.
WEAK = frozenset("banner popup modal overlay notice notices alert widget widgets header replies discussion share sharing social related recommended signup login toolbar dialog".split())
#: Words that hint at it only if they are a whole token.
ALONE = frozenset("follow search skip reply respond rail label".split())
#: Words before a noise word that say what a page has or lacks, not what an element is.
PREFIX = frozenset("has with no without hide show is".split())
COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
OTHER = re.compile(r"<(?:[!?][^>]*|/[^a-zA-Z>]*)>")
TEXT = re.compile(r"<?[^<]*")
#: Quoted attributes of a tag that its end is looked for behind.
QUOTES = 200
#: Share of link text from which an unselected part of the article's container is a list of links.
LINKS = 0.5
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The end tag of each raw element, and what a script's end depends on: one that opens inside a comment hides its own end tag.
ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW}
SCRIPT = re.compile(r"<!--|-->|<script(?=[\s/>])|</script(?=[\s/>])", re.I)
HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、]")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Width of the smoothing over neighbouring text nodes.
SIGMA = 1.0


class Element:
    __slots__ = ("depth", "hint", "link", "name", "noise", "parent", "path")

    def __init__(self, name: str, parent: Element | None, noise: bool, hint: bool, path: int):
        self.name, self.parent, self.noise, self.path = name, parent, noise, path
        self.depth = parent.depth + 1 if parent else 0
        self.link = name == "a" or bool(parent and parent.link)
        # the outermost element that a weak word marks
        self.hint = (parent and parent.hint) or (self if hint else None)


def marks(name: str, tag: str, parent: Element) -> tuple[bool, bool]:
    """(noise, hint): noise by its name, by a strong word or as hidden; a hint by a weak word. A header inside an article is the article's."""
    if name in ASIDE:
        return name != "footer" or not inside(parent, "blockquote"), False
    if name == "header":
        return not (inside(parent, "article") or inside(parent, "main")), False
    if name in ("article", "main", "body", "html"):
        return name not in ("body", "html") and bool(HIDDEN.search(tag)), False
    if "=" not in tag:
        return "hidden" in tag.lower() and bool(HIDDEN.search(tag)), False
    strong = hint = False
    for groups in HINTS.findall(tag):
        for token in " ".join(groups).split():
            words = WORDS.findall(CAMEL.sub(r"\1 \2", token).lower())
            if not words or words[0] in PREFIX:
                continue
            found = {*words, "".join(words)}
            strong = strong or bool(found & STRONG)
            weak = found & WEAK
            if weak == {"header"} and (inside(parent, "article") or inside(parent, "main")):
                weak = set()
            hint = hint or bool(weak) or (len(words) == 1 and words[0] in ALONE)
    return strong or bool(HIDDEN.search(tag)), hint


def inside(element: Element | None, name: str) -> bool:
    while element is not None:
        if element.name == name:
            return True
        element = element.parent
    return False


def raw_end(html: str, name: str, at: int) -> int:
    """Where the page goes on after the text of a raw element that begins at `at`; the page's end if nothing ends it."""
    comment = nested = False
    while name == "script" and (m := SCRIPT.search(html, at)):
        mark = m[0].lower()
        if mark == "</script" and not nested:
            at = m.start()
            break
        # the dashes that open a comment may close it
        at = m.start() + 2 if mark == "<!--" else m.end()
        if mark == "-->":
            comment = nested = False
        elif mark == "<!--":
            comment = True
        else:
            nested = mark == "<script" and comment
    else:
        if name == "script":
            return len(html)
    end = ENDS[name].search(html, at)
    return end.end() if end else len(html)


class Tags:
    """Ends of a page's tags, each found in bounded steps, so that no page takes time in the square of its length."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Behind the > that ends the tag at `at`, one in a quoted attribute not counted; 0 if no tag ends there."""
        html, pos = self.html, at + 1
        if at > self.last:
            return 0
        for _ in range(QUOTES):
            stop = html.find(">", pos)
            if stop < 0:
                break
            quotes = [i for q in "\"'" if (i := html.find(q, pos, stop)) >= 0]
            if not quotes:
                return stop + 1
            first = min(quotes)
            # a quote that nothing closes is an ordinary character
            pos = html.find(html[first], first + 1) + 1 if self.last_quote[html[first]] > first else first + 1
        return html.find(">", at) + 1


def tokens(html: str) -> Iterator[tuple[str, int]]:
    """(token, where it ends): comments, tags and the text between; the caller may send where to read on."""
    tags, pos, size = Tags(html), 0, len(html)
    while pos < size:
        end = 0
        if html[pos] == "<" and pos + 1 < size:
            after = html[pos + 1 : pos + 3].lstrip("!/")[:1]
            if html.startswith("<!--", pos):
                end = COMMENT.match(html, pos).end()
            elif after.isascii() and after.isalpha() and not html.startswith("<!/", pos):
                end = tags.end(pos)
            elif html[pos + 1] in "!?/" and (m := OTHER.match(html, pos) if pos <= tags.last else None):
                end = m.end()
        if not end:
            end = TEXT.match(html, pos).end()
        sent = yield html[pos:end], end
        pos = sent if sent is not None else end


def text_nodes(html: str) -> list[tuple[str, Element, int]]:
    """(text, leaf element, block number) in page order, from a lenient reading that closes what authors leave open."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", None, False, False, 0)
    stack, nodes, block = [root], [], 0
    reader = tokens(html)
    item = next(reader, None)
    while item:
        token, end = item
        jump = None
        if token[0] != "<" or len(token) == 1 or token[-1] != ">" or not (token.startswith("<!--") or token[1] in "!?/" or token[1].isalpha()):
            if stack[-1] is not root or token.strip():
                nodes.append((token, stack[-1], block))
        elif n := NAME.match(token):
            name = n[1].lower()
            if token[1] == "/":
                if name in BLOCK:
                    block += 1
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at].name == name:
                        del stack[at:]
                        break
                    if stack[at].name in ("table", "article", "body") and name not in BLOCK:
                        break
            else:
                if name in BLOCK:
                    block += 1
                if not (name in ("html", "body") and name in (e.name for e in stack[: 2 if name == "body" else 1])):
                    if name == "body":
                        del stack[1:]
                    closed(stack, name)
                    if name == "br":
                        nodes.append((" ", stack[-1], block))
                    if name not in VOID and not token.endswith("/>"):
                        parent = stack[-1]
                        noise, hint = (True, False) if parent.noise else marks(name, token, parent)
                        element = Element(name, parent, noise, hint, paths.setdefault((parent.path, name), len(paths) + 1))
                        if name in RAW:
                            jump = raw_end(html, name, end)
                        else:
                            stack.append(element)
        try:
            item = next(reader) if jump is None else reader.send(jump)
        except StopIteration:
            break
    return nodes


def closed(stack: list[Element], name: str) -> None:
    """Take off the stack what the start of an element ends."""
    if name in ENDS_P:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name == "p":
                del stack[at:]
                break
            if stack[at].name in BLOCK:
                break
    if name in IMPLIED:
        ended, up_to = (x.split() for x in IMPLIED[name])
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in up_to:
                break
            if stack[at].name in ended:
                del stack[at:]
                break


def path_ratios(nodes: list[tuple[str, Element, int]]) -> np.ndarray:
    """For each node its tag path's fused ratio, smoothed over page order and averaged over the path; 0 for noise and blanks.

    Of a path: its nodes' text length without links, and their punctuation marks, a node each; fused
    as their product, a mark more than there are.
    """
    live = [not leaf.noise and bool(text.strip()) for text, leaf, _ in nodes]
    length, marks_, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for (text, leaf, _), use in zip(nodes, live, strict=True):
        if use:
            count[leaf.path] += 1
            if not leaf.link:
                length[leaf.path] += len(text)
                marks_[leaf.path] += len(PUNCTUATION.findall(text))
    ratio = {p: max(length[p] / n, 0.5) * (1 + marks_[p] / n) for p, n in count.items()}
    fused = np.asarray([ratio[leaf.path] if use else 0.0 for (_, leaf, _), use in zip(nodes, live, strict=True)])
    if len(fused) < 3:
        return fused
    window = np.exp(-0.5 * (np.arange(-2, 3) / SIGMA) ** 2)
    near = np.convolve(np.pad(fused, 2, mode="edge"), window / window.sum(), mode="valid")
    # a path is judged whole, so a node beside long text is not taken for its neighbour's sake
    path = np.fromiter((leaf.path for _, leaf, _ in nodes), np.int64, len(nodes))
    total, number = np.bincount(path, np.where(fused > 0, near, 0.0)), np.bincount(path, fused > 0)
    return np.where(fused > 0, (total / np.maximum(number, 1))[path], 0.0)


def selected(fused: np.ndarray) -> np.ndarray:
    """Nodes at or above half of the fused ratios' standard deviation; all the same: all."""
    live = fused[fused > 0]
    return (fused > 0) & (fused >= min(live.max(), live.std() / 2)) if len(live) else fused > 0


def ancestors(element: Element | None) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def main_text(html: str | None) -> str:
    """The article's blocks, one a line.

    Tag paths are thresholded at half their fused ratio's standard deviation; the article is the
    smallest container that holds all that is selected, widened to the article or main element around
    it. Weak class words drop an element only if it holds less than half of the selected text, and no
    article. Inside the article the nodes of unselected parts stay, as titles and short lists belong
    to it, but for parts that are mostly links. Null, empty and text-free pages give the empty text;
    equal pages give equal texts; a very long page takes time in proportion to its length.
    """
    nodes = text_nodes(html or "")
    fused = path_ratios(nodes)
    chosen = selected(fused)
    if not chosen.any():
        return ""
    weight: dict[Element, int] = defaultdict(int)
    mass = 0
    articles = {e for _, leaf, _ in nodes if leaf.hint for e in ancestors(leaf) if e.name in ("article", "main")}
    for (text, leaf, _), use in zip(nodes, chosen.tolist(), strict=True):
        if use:
            mass += len(text.strip())
            if leaf.hint:
                weight[leaf.hint] += len(text.strip())
    wraps = {leaf_hint for a in articles for leaf_hint in [a.hint] if leaf_hint}
    kept = {e for e, w in weight.items() if 2 * w >= mass} | wraps
    use = chosen & np.fromiter((leaf.hint is None or leaf.hint in kept for _, leaf, _ in nodes), bool, len(nodes))
    home = lowest([leaf for (_, leaf, _), u in zip(nodes, use.tolist(), strict=True) if u])
    for element in ancestors(home):
        if element.name in ("article", "main"):
            home = element
    holds = {e for (_, leaf, _), u in zip(nodes, use.tolist(), strict=True) if u for e in ancestors(leaf)} if home else set()
    links: dict[Element, list[int]] = defaultdict(lambda: [0, 0])
    parts: list[Element | None] = []
    for (text, leaf, _), u in zip(nodes, use.tolist(), strict=True):
        top = None
        if not u and home:
            for element in ancestors(leaf):
                if element in holds:
                    break
                top = element
        if top is not None:
            links[top][leaf.link] += len(text.strip())
        parts.append(top)
    lists = {e for e, (plain, linked) in links.items() if linked and linked >= LINKS * (plain + linked) and e.name not in HEADINGS and not inside(e, "p")}
    blocks: dict[int, list[str]] = {}
    for (text, leaf, block), top in zip(nodes, parts, strict=True):
        if not leaf.noise and (leaf.hint is None or leaf.hint in kept) and top not in lists and (home is None or held(leaf, home)):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(some)).split()) for some in blocks.values())
    return "\n".join(line for line in lines if line)


def lowest(leaves: list[Element]) -> Element | None:
    """The lowest container that holds all of these elements."""
    home = None
    for leaf in leaves:
        if home is None:
            home = leaf
            continue
        other = leaf
        while home is not other and home is not None and other is not None:
            if home.depth >= other.depth:
                home = home.parent
            else:
                other = other.parent
    while home is not None and home.name not in CONTAINER:
        home = home.parent
    return home


def held(element: Element | None, home: Element) -> bool:
    while element is not None:
        if element is home:
            return True
        element = element.parent
    return False


def main_text_column(html: Column) -> Column:
    """main_text of a html column; null, empty and text-free pages give the empty string. One pass, no shuffle."""

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None)

    return extract(html)
