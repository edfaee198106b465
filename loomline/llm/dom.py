"""A page as a tree of labelled elements with blocks of text, for tag soup; standard library only.

Only elements that make blocks are nodes; inline ones count as part of the text around them. Siblings with the same label
are one node, as repeats of one thing; plain containers (a div without class or id) stay apart up to `PLAIN` of them.
A node deeper than `DEEP` is its parent's. Elements that end early or never are closed as browsers do for p, li, dt, dd and tr,
and by the end of what is around them. Of a page truncated inside a tag that tag is left out.
"""

from __future__ import annotations

import re
from html import unescape

PLAIN, DEEP = 8, 96
#: Tags by what they do. BLOCKS end the text before them.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav noscript ol p pre search section select summary table tbody template tfoot thead tr caption ul head".split()
)
CELLS, VOID = frozenset(("td", "th", "br", "wbr", "img")), frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup up to their end tag, and no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never part of an article.
NEVER = frozenset("head nav footer aside form script style noscript template button select option datalist textarea object svg math canvas audio video map menu dialog search iframe".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist tooltip".split())
#: Words in a class or an id that mark what is not the article. WEAK ones also stand in names of wrappers around it.
WEAK = frozenset("header masthead sidebar menu nav navigation banner notice notices alert share social promo widget widgets popup modal overlay hidden ad ads".split())
STRONG = frozenset(
    "adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promoted footer navbar topnav subnav sitenav navmenu breadcrumb breadcrumbs "
    "topbar toolbar pagination pager submenu comment comments commentlist respond disqus reply replies cookie cookies cookiebar consent gdpr newsletter subscribe signup login sharing "
    "follow related recommended recommendations outbrain taboola trending lightbox skip copyright disclaimer".split()
)
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')|["'=])*+)>?|[!?/][^>]*>?)""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?=[\s=/]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A start tag ends open elements of these names, up to the given fence.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"})}


class Node:
    __slots__ = ("label", "kids", "by_label", "plain", "number")

    def __init__(self, label: str):
        self.label, self.kids, self.by_label, self.plain, self.number = label, [], {}, {}, -1

    def child(self, label: str, plain: bool) -> Node:
        if plain:
            self.plain[label] = n = self.plain.get(label, 0) + 1
            key = f"{label}:{min(n, PLAIN)}"
        else:
            key = label
        if key not in self.by_label:
            self.by_label[key] = Node(label)
            self.kids.append(self.by_label[key])
        return self.by_label[key]


class _Open:
    """An element that is open: its node; out: not of the article, and if that may be taken back (`soft`); main: in an article."""

    __slots__ = ("tag", "node", "out", "soft", "main", "closed", "up", "holds", "header", "depth")

    def __init__(self, tag, node, out, soft, main, up, header):
        self.tag, self.node, self.out, self.soft, self.main, self.up, self.header = tag, node, out, soft, main, up, header
        self.closed = self.holds = False
        self.depth = up.depth + 1 if up else 0


def _marks(raw: str, own: bool) -> tuple[str, str, bool]:
    """Label's suffix; "strong", "weak" or ""; whether the article's body is named. own: a header there is the article's own."""
    found = {}
    for name, a, b, c in _ATTR.findall(raw):
        found.setdefault(name.lower(), a or b or c)
    kind, ident = unescape(found.get("class", "")), unescape(found.get("id", ""))
    words = {w.lower() for w in _WORDS.findall(f"{kind} {ident}")} - ({"header"} if own else set())
    role = found.get("role", "").lower()
    mark = "strong" if words & STRONG or role in ROLES else "weak" if words & WEAK else ""
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()):
        mark = "strong"
    first = (kind.split() or [f"#{ident}" if ident else ""])[0]
    first = re.sub(r"[^\w#-]", "_", re.sub(r"\d.*", "0", first))  # what follows a digit is a number or made up
    return first, mark, role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"


def page(html: str) -> tuple[Node, list[tuple[Node, bool, str, int]]]:
    """The tree, and the blocks that may be of the article: (node, in an article, text, letters in links)."""
    root = _Open("", Node("page"), False, False, False, None, False)
    stack, blocks, elements = [root], [], []
    text, links = [], 0  # the block so far
    inline, count = [], {}  # open inline elements (tag, out); how many there are of a tag, and of those that are out
    opened: dict[str, int] = {}  # elements in the stack by tag

    def flush() -> None:
        nonlocal links
        body = " ".join(unescape("".join(text)).split())
        if body:
            blocks.append((stack[-1], body, min(links, len(body))))
        text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if count.get(True):
            return
        text.append(raw)
        if count.get("a"):
            links += len(raw)

    def close(n: int, explicit: bool) -> None:
        """Pops the stack to a length of n."""
        flush()
        inline.clear()
        count.clear()
        stack[n].closed = explicit
        for x in stack[n:]:
            opened[x.tag] -= 1
        del stack[n:]

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        end, tag, raw = m[1], m[2].lower(), m[3]
        if end:
            if tag in BLOCKS:
                same = HEADINGS if tag in HEADINGS else {tag}
                if any(opened.get(t) for t in same):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in same), True)
                elif tag == "p":
                    flush()
            elif tag in CELLS:
                text.append(" ")
            else:
                while count.get(tag):
                    t, out = inline.pop()
                    count[t] -= 1
                    count[True] = count.get(True, 0) - out
                    if t == tag:
                        break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else len(html) if tag in ("script", "style") else at
            continue
        if tag in CELLS:
            text.append(" ")
            continue
        suffix, mark, named = _marks(raw, stack[-1].main or tag in HEADINGS) if raw.strip() else ("", "", False)
        if tag not in BLOCKS:
            if tag not in VOID and not raw.endswith("/"):
                out = bool(mark) or tag in NEVER
                inline.append((tag, out))
                count[tag] = count.get(tag, 0) + 1
                count[True] = count.get(True, 0) + out
            continue
        flush()
        inline.clear()
        count.clear()
        ends, fence = _ENDS.get(tag, ((), ()))
        n = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in fence), 0)
        if n and stack[n].tag in ends:
            close(n, False)
        if stack[-1].tag == "p":  # no block stands in a paragraph
            close(len(stack) - 1, False)
        if tag == "hr":
            continue
        if opened.get("head") and tag != "head":
            close(next(i for i in range(1, len(stack)) if stack[i].tag == "head"), False)
        up = stack[-1]
        main = tag in ("article", "main") or named
        top = tag in ("html", "body", "main") or (tag == "article" and mark == "weak")
        out = not top and (tag in NEVER or bool(mark) or tag == "header")
        header = up.header or (up.main and tag == "header")
        if header and not up.header:
            out = False  # an article's own header: its headings count
        label = f"{tag}{'.' * bool(suffix)}{suffix}{'!' * out}"
        node = up.node.child(label, tag in ("div", "section", "table") and not suffix) if up.depth < DEEP else up.node
        own = _Open(tag, node, out, mark == "weak" or tag == "form", up.main or (main and not out), up, header)
        elements.append(own)
        stack.append(own)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    for e in elements:  # what holds an article is not out, if it was never closed or its name says little
        if e.main and not e.out and e.tag in ("article", "main") and not (e.up.main and e.tag == "article"):
            up = e.up
            while up:
                up.holds, up = True, up.up
    verdict = {}

    def state(e: _Open | None) -> bool:
        """Whether the element is out, by itself or by what is around it."""
        path = []
        while e is not None and e not in verdict:
            path.append(e)
            e = e.up
        out = verdict[e] if e is not None else False
        for x in reversed(path):
            out = verdict[x] = out or (x.out and not (x.holds and (x.soft or not x.closed)))
        return out

    kept = [(e.node, e.main, body, n) for e, body, n in blocks if not state(e) and (not e.header or e.tag in HEADINGS)]
    return root.node, kept


def shape(root: Node) -> str:
    """The tree as text, its nodes numbered on the way: a label, its children in brackets."""
    out, count, todo = [], 0, [root]
    while todo:
        x = todo.pop()
        if x is None:
            out.append(")")
            continue
        x.number, count = count, count + 1
        out.append(f" {x.label}" if out and out[-1] != "(" else x.label)
        if x.kids:
            out.append("(")
            todo.append(None)
            todo.extend(reversed(x.kids))
    return "".join(out)
