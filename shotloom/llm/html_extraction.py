"""HTML extraction with a tree-structured graphical model.

Each block element of a page is a node with two states, content or not. Unary potentials come from
what the node shows (kind of tag, words in class and id; share of text in links and length of text, in the zone of
the page that the nearest telling ancestor names), pair potentials from how states pass from parent to child. Both are counted on labelled pages, which
``labelled_pages`` writes from templates of many layouts. Sum-product messages go up from the leaves and
down from the root; blocks whose content marginal reaches one half are the main text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import small_batches

_NAME, _STOP = re.compile(r"(/?)([a-zA-Z][^\s/><]*)"), re.compile(r"[<>\"']")
_HINTED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"}  # text up to the closing tag or the end
_UNSEEN = {"template", "svg", "object", "canvas", "select", "datalist", "annotation", "annotation-xml"}  # dropped if closed
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set("html body head article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary center dialog menu search hgroup button label legend".split())
_ENDS_P = _BLOCK - {"html", "body", "head", "button", "label", "legend"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
_SCOPE = {"table", "ul", "ol", "dl", "body", "article", "section", "div", "main"}
_KINDS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "label": "form", "legend": "form", "search": "form", "dialog": "notice", "head": "head", "html": "root", "body": "root", "article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "p": "p", "blockquote": "p", "pre": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "p"} | {f"h{i}": "head line" for i in range(1, 7)}
#: Words in class, id and role that speak for a kind of part; the first that fits counts.
_WORDS = (
    ("comment", "comment comments disqus reply replies responses respond discussion"),
    ("advert", "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner"),
    ("notice", "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall signup disclaimer"),
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs tags skip"),
    ("side", "sidebar side aside widget related recommended recommendations trending popular rail"),
    ("edge", "header masthead topbar footer foot bottom copyright legal credits logo"),
    ("form", "form login search share sharing social toolbar"),
    ("content", "content article post entry story main body text prose page-content article-body post-content entry-content"),
)
_WORD_OF = {w: name for name, ws in reversed(_WORDS) for w in ws.split()}
#: Words beside those that change nothing about what they say.
_PLAIN = set("box list lists wrapper wrap container item items area block inner outer panel bar row col column group slot unit zone holder section link links btn site page global primary secondary top left right center region layout grid main body content".split())
_OUT = {"comment", "advert", "notice", "menu", "side", "edge", "form"}


@dataclass
class Node:
    kind: str
    tag: str
    hint: str
    up: int
    texts: list = field(default_factory=list)  # own text pieces, by block number
    chars: int = 0
    linked: int = 0


def _named(name: str) -> tuple[str, bool]:
    """What one name says, and whether it says only that: "related-work" may be anything about related work, "related-box" is not."""
    parts = [w for w in re.split(r"[^a-z0-9]+", name) if len(w) > 1 and not w.isdigit()]
    said = [_WORD_OF[w] for w in parts if w in _WORD_OF]
    found = next((x for x in said if x != "content"), said[0] if said else "none")
    other = [w for w in parts if w not in _PLAIN and (w not in _WORD_OF or (_WORD_OF[w] == "content" and found not in ("content", "comment")))]
    return found, not other


def _hint(attributes: str, kind: str) -> str:
    """What the names in class, id and role say, with a question mark where a name says other things too; those of a whole page say nothing about its parts."""
    if kind == "root":
        return "none"
    first = loose = "none"
    for m in _HINTED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            found, sure = _named(name)
            if found in ("none", "content"):
                first = found if first == "none" else first
            elif sure:
                return found
            elif loose == "none":
                loose = f"{found}?"
        if first == "content" and kind in ("article", "main"):
            return first
    return loose if loose != "none" else first


class Markup:
    """Splits a page into (text before, closing mark, tag, attributes) in one pass: no part is looked through twice for the same mark."""

    def __init__(self, page: str):
        self.page, self.at, self.gone = page, 0, set()

    def _past(self, mark: str, at: int) -> int:
        """Where ``mark`` ends, from ``at`` on; -1 if it does not occur."""
        found = -1 if mark in self.gone else self.page.find(mark, at)
        if found < 0:
            self.gone.add(mark)
            return -1
        return found + len(mark)

    def _attributes(self, at: int) -> tuple[str, int]:
        """Attributes from ``at`` on and where the tag ends: at > outside quotes, or before the next <."""
        page, begin = self.page, at
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return page[begin : m.start()], m.end()
            if m[0] == "<":
                return page[begin : m.start()], m.start()
            at, k = m.end(), m.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=" and (past := self._past(m[0], at)) > 0:
                at = past
        return page[begin:], len(page)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        page, end = self.page, len(self.page)
        begin = 0
        while self.at < end:
            i = page.find("<", self.at)
            if i < 0:
                break
            m = _NAME.match(page, i + 1)
            if m:
                attributes, past = self._attributes(m.end())
                text, self.at, begin = page[begin:i], past, past
                yield text, m[1], m[2].lower(), attributes
                begin = self.at
            elif page[i + 1 : i + 2] in ("!", "?", "/"):
                past = self._past("-->", i + 2) if page.startswith("<!--", i) else self._past(">", i + 2)
                text, self.at = page[begin:i], past if past > 0 else end
                begin = self.at
                yield text, "", "", ""
            else:
                self.at = i + 1  # just a sign
        yield page[begin:], "", "", ""

    def skip(self, tag: str, to_end: bool) -> None:
        """Goes past the closing tag of ``tag``; if there is none, to the end or nowhere."""
        close = None if tag in self.gone else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(self.page, self.at)
        if close:
            self.at = close.end()
        else:
            self.gone.add(tag)
            if to_end:
                self.at = len(self.page)


def tree(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Block nodes in page order and the text blocks as (node, pieces). Parents come before children."""
    nodes, blocks = [Node("root", "html", "none", -1)], []
    open_, opened, current, link = [0], Counter(), None, 0

    def say(text: str) -> None:
        nonlocal current
        if text:
            text = entities.unescape(text)
            node = nodes[open_[-1]]
            if current is None:
                current = []
                blocks.append((open_[-1], current))
            current.append(text)
            shown = len(text.strip())
            node.chars += shown
            node.linked += shown if link else 0

    def shut_from(depth: int) -> None:
        opened.subtract(nodes[i].tag for i in open_[depth:])
        del open_[depth:]

    markup = Markup(page)
    for text, closing, tag, attributes in markup:
        say(text)
        if not tag:
            continue
        if closing:
            if tag == "a":
                link = max(0, link - 1)
            if tag in _BLOCK or any(nodes[i].tag == tag for i in open_[-2:]):
                if opened[tag] > 0:
                    depth = len(open_) - 1
                    while nodes[open_[depth]].tag != tag:
                        depth -= 1
                    shut_from(depth)
                current, link = None, 0
            continue
        if tag in _RAW or tag in _UNSEEN:
            if not attributes.endswith("/"):
                markup.skip(tag, tag in _RAW)
            continue
        if tag == "a":
            link += 1
        if tag == "br" or tag == "wbr":
            if current is not None:
                current.append(" " if tag == "br" else "")
            continue
        if tag in _VOID:
            if tag == "hr":
                current = None
            continue
        hint = _hint(attributes, _KINDS.get(tag, "div")) if attributes else "none"
        if tag in _BLOCK:
            current, link = None, 0
            if tag in _ENDS_P and nodes[open_[-1]].tag == "p":
                shut_from(len(open_) - 1)
            shut = _CLOSES.get(tag, ())
            while shut and len(open_) > 1 and nodes[open_[-1]].tag in shut:
                shut_from(len(open_) - 1)
            if tag in ("li", "td", "th", "tr", "dd", "dt") and any(opened[t] > 0 for t in shut):
                for depth in range(len(open_) - 1, 0, -1):
                    if nodes[open_[depth]].tag in _SCOPE:
                        break
                    if nodes[open_[depth]].tag in shut:
                        shut_from(depth)
                        break
            if tag == "html":
                continue
        elif hint in _OUT and tag != "a":
            current = None  # an inline part of its own
        else:
            continue
        if not attributes.endswith("/") or tag in _BLOCK:
            nodes.append(Node(_KINDS.get(tag, "div"), tag, hint, open_[-1]))
            open_.append(len(nodes) - 1)
            opened[tag] += 1
    return nodes, blocks


def _zone(node: Node, outer: str) -> str:
    """The part of the page that a node lies in: named by itself or by the nearest ancestor that tells."""
    if node.hint in _OUT:
        return node.hint
    if node.hint.endswith("?"):  # not told by the name alone
        return outer if outer.endswith("?") else f"{outer}?"
    if node.kind in ("header", "footer") and outer.startswith("article"):  # also where a name leaves it open
        return f"article {node.kind}"
    if node.kind in ("menu", "header", "footer", "aside", "form", "notice", "head"):
        return node.kind
    if node.kind in ("article", "main") or node.hint == "content":
        return "article" if outer in ("", "?", "article") else outer
    return outer


def seen(nodes: list[Node]) -> list[tuple[str, str]]:
    """What each node shows: its kind with the hint, and its zone with its subtree's links and length."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].up] += chars[i]
        linked[nodes[i].up] += linked[i]
    out, zones = [], [""] * len(nodes)
    for i, n in enumerate(nodes):
        zones[i] = _zone(n, zones[n.up]) if i else ""
        share = linked[i] / chars[i] if chars[i] else 0
        out.append((f"{n.kind}/{n.hint}", f"{zones[i]}: {'no' if share < 0.05 else 'few' if share < 0.34 else 'half' if share < 0.67 else 'all'} {'0' if not chars[i] else 's' if chars[i] < 30 else 'm' if chars[i] < 150 else 'l'}"))
    return out


@dataclass
class Model:
    """Log potentials: unary by observation and state, pair by (kind of child, parent state, state)."""

    own: dict
    look: dict
    kind: dict
    pair: dict
    root: tuple

    def unary(self, shown: tuple[str, str]) -> tuple[float, float]:
        kind, hint = shown[0].split("/")
        a = self.own.get(shown[0]) or tuple(x + y for x, y in zip(self.kind.get(kind, (0.0, 0.0)), self.kind.get(f"/{hint}", (0.0, 0.0)), strict=True))
        b = self.look.get(shown[1], (0.0, 0.0))
        return a[0] + b[0], a[1] + b[1]


def _logs(counts: dict, alpha: float) -> dict:
    """Log odds of each observation under the states, as (0, log P(o | content) / P(o | other))."""
    total = [sum(c[s] for c in counts.values()) + alpha * len(counts) for s in (0, 1)]
    return {o: (0.0, math.log((c[1] + alpha) / total[1]) - math.log((c[0] + alpha) / total[0])) for o, c in counts.items()}


def train(pages: list[tuple[str, set[str]]]) -> Model:
    """Counts potentials on (html, set of texts that belong to the article)."""
    own, look, kind, pair, root = (defaultdict(lambda: [0, 0]) for _ in range(5))
    for page, wanted in pages:
        nodes, blocks = tree(page)
        state, own_text = [0] * len(nodes), [[0, 0] for _ in nodes]
        for i, pieces in blocks:
            if text := _SPACES.sub(" ", "".join(pieces)).strip():
                own_text[i][text in wanted] += len(text)
        for i in range(len(nodes) - 1, -1, -1):  # a node is content if most text below it is
            state[i] = int(own_text[i][1] > own_text[i][0])
            if nodes[i].up >= 0:
                for s in (0, 1):
                    own_text[nodes[i].up][s] += own_text[i][s]
        shown = seen(nodes)
        for i, n in enumerate(nodes):
            k, hint = shown[i][0].split("/")
            own[shown[i][0]][state[i]] += 1
            kind[k][state[i]] += 1
            kind[f"/{hint}"][state[i]] += 1
            look[shown[i][1]][state[i]] += 1
            if n.up >= 0:
                pair["", state[n.up]][state[i]] += 1
                pair[k, state[n.up]][state[i]] += 1
    chance = {key: tuple(math.log((c[s] + 1) / (sum(c) + 2)) for s in (0, 1)) for key, c in pair.items()}
    return Model({o: v for o, v in _logs(own, 0.5).items() if sum(own[o]) >= 8}, _logs(look, 0.5), _logs(kind, 0.5), chance, (math.log(0.5), math.log(0.5)))


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """P(content) of every node by sum-product messages, upward then downward."""
    shown = seen(nodes)
    belief = [list(model.unary(s)) for s in shown]  # unary and messages from the children
    up: list = [None] * len(nodes)
    trans = [(model.pair.get((n.kind, 0)) or model.pair["", 0], model.pair.get((n.kind, 1)) or model.pair["", 1]) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        b, t = belief[i], trans[i]
        up[i] = tuple(_add(t[s][0] + b[0], t[s][1] + b[1]) for s in (0, 1))
        parent = belief[nodes[i].up]
        parent[0] += up[i][0]
        parent[1] += up[i][1]
    belief[0][0] += model.root[0]
    belief[0][1] += model.root[1]
    for i in range(1, len(nodes)):
        p, t = belief[nodes[i].up], trans[i]
        outer = (p[0] - up[i][0], p[1] - up[i][1])  # the parent without this child
        down = tuple(_add(outer[0] + t[0][s], outer[1] + t[1][s]) for s in (0, 1))
        belief[i][0] += down[0]
        belief[i][1] += down[1]
    return [1 / (1 + math.exp(min(700.0, max(-700.0, b[0] - b[1])))) for b in belief]


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, blocks = tree(page)
    p = marginals(nodes, model)
    found = (_SPACES.sub(" ", "".join(pieces)).strip() for i, pieces in blocks if p[i] >= 0.5)
    return "\n\n".join(x for x in found if x)


_OPEN = ("related", "share", "alert", "tabs", "comment", "notice", "recommended", "legal", "search", "navigation", "promotion", "side", "popular", "header", "footer", "widget", "signup", "disclaimer", "nav", "skip")


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages of many layouts with the texts that make up their articles."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    made = [0]

    def say(low: int, high: int) -> str:
        made[0] += 1
        return " ".join([*rng.choices(stock, k=rng.randint(low, high)), f"q{made[0]}"]).capitalize() + rng.choice([".", ".", "", "!"])

    def links(n: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{i}">{say(1, 3)}</a></{wrap}>' for i in range(n))

    pages = []
    for _ in range(count):
        wanted: set[str] = set()

        def linked(text: str) -> str:
            """Some of the words, or all of them, in a link."""
            w = text.split(" ")
            i = rng.randrange(len(w))
            j = rng.randint(i + 1, len(w)) if rng.random() < 0.8 else len(w)
            i = 0 if rng.random() < 0.25 else i
            return " ".join([*w[:i], f'<a href="/x{i}">{" ".join(w[i:j])}</a>', *w[j:]])

        def keep(tag: str, low: int, high: int, wanted=wanted, linked=linked) -> str:
            text = say(low, high)
            if tag == "p" and rng.random() < 0.04:
                wanted.add(f"{text} x = 1")
                return f"<p>{text} <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math></p>"
            wanted.add(text)
            inner = rng.choice([text, text, text, f"<b>{text}</b>", linked(text), linked(text)])
            return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "")

        def sources(wanted=wanted) -> str:
            """A list of links that belongs to the article."""
            texts = [say(1, 8) for _ in range(rng.randint(1, 12))]
            wanted.update(texts)
            return keep("h2", 1, 3) + "<ul>" + "".join(f'<li><a href="/s">{t}</a></li>' for t in texts) + "</ul>"

        def open_name() -> str:
            """A name with a word that speaks for a part of the page, and another that doesn't."""
            word, other = rng.choice(_OPEN), rng.choice(stock)
            return rng.choice([f"{word}-{other}", f"{other}-{word}", f"{other}_{word}", f"story-{word}"])

        def article(keep=keep) -> str:
            out = [keep("h1", 2, 9)] if rng.random() < 0.9 else []
            if out and rng.random() < 0.1:
                out = [out[0].replace("<h1>", f'<h1 class="{open_name()}">', 1)]
            if out and rng.random() < 0.15:
                out = [f"<header>{out[0]}</header>"]
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
                kind = rng.random()
                if kind < 0.7:
                    out.append(keep("p", rng.choice([1, 5, 20]), rng.choice([25, 40, 70])))
                elif kind < 0.78:
                    out.append(keep(rng.choice(["h2", "h3"]), 1, 6))
                elif kind < 0.84:
                    out.append("<ul>" + "".join(keep("li", 2, 15) for _ in range(rng.randint(2, 5))) + "</ul>")
                elif kind < 0.87:
                    out.append(sources())
                elif kind < 0.91:
                    out.append(f"<blockquote>{keep('p', 5, 20)}</blockquote>")
                elif kind < 0.94:
                    out.append("<table>" + "".join(f"<tr>{keep('td', 1, 5)}{keep('td', 1, 5)}</tr>" for _ in range(2)) + "</table>")
                elif kind < 0.97:
                    out.append(keep("pre", 4, 15))
                else:
                    out.append(f'<figure><img src="x"><figcaption>{(lambda t: (wanted.add(t), t)[1])(say(3, 9))}</figcaption></figure>')
                if rng.random() < 0.12:
                    inner = (keep("h2", 1, 4) if rng.random() < 0.6 else "") + "".join(keep("p", rng.choice([3, 12, 20]), 60) for _ in range(rng.randint(1, 3)))
                    out.append(rng.choice(['<section class="{}">{}</section>', '<div class="{}">{}</div>', '<div id="{}">{}</div>']).format(open_name(), inner))
                if rng.random() < 0.08:
                    out.append(f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo-box"])}">{say(3, 15)}</div>')
                if rng.random() < 0.04:
                    out.append(f"<aside>{say(5, 25)}</aside>")
            if rng.random() < 0.1:
                out.append(f"<footer><p>{say(1, 6)}</p>{links(2)}</footer>")
            return "".join(out)

        def comments() -> str:
            each = "".join(rng.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"]).format(say(4, 40)) for _ in range(rng.randint(1, 5)))
            return rng.choice(['<section class="comments"><h2>{}</h2>{}</section>', '<div id="comments"><h3>{}</h3>{}</div>', '<section id="comments"><h2>{}</h2><ul>{}</ul></section>', '<div class="comment-list"><h3>{}</h3>{}</div>']).format(say(1, 2), each)

        body = article()
        layout = rng.random()
        if layout < 0.45:
            core = f"<article>{body}{comments() if rng.random() < 0.15 else ''}</article>"
        elif layout < 0.6:
            core = f"<main>{body}</main>"
        elif layout < 0.7:
            core = f"<main><article>{body}</article></main>"
        elif layout < 0.9:
            core = f'<div class="{rng.choice(["content", "post", "entry-content", "article-body", "story", "main"])}">{body}</div>'
        elif layout < 0.96:
            core = f"<div>{body}</div>"
        else:  # a name that speaks for another part is all there is
            core = f'<div class="{rng.choice(["tabs", "toc", "widget", "side", "rail", "pager", open_name()])}">{body}</div>'
        before, after = [], []
        if rng.random() < 0.75:
            before.append(rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul class="nav">{}</ul>', "<nav>{}</nav>"]).format(links(rng.randint(3, 9))))
        if rng.random() < 0.4:
            before.insert(0, rng.choice(["<header><h2>{}</h2><p>{}</p></header>", '<div class="header"><div>{}</div><p>{}</p></div>', '<div id="masthead"><p>{}</p><p>{}</p></div>']).format(say(1, 4), say(2, 12)))
        if rng.random() < 0.5:
            (before if rng.random() < 0.6 else after).append(f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "sponsored"])}">{rng.choice(["", "<p>"])}{say(3, 25)}</div>')
        if rng.random() < 0.35:
            (before if rng.random() < 0.5 else after).append(f'<div class="{rng.choice(["cookie-notice", "notice", "cookie-banner", "newsletter", "alert"])}" ><p>{say(5, 30)}</p></div>')
        if rng.random() < 0.4:
            (before if rng.random() < 0.3 else after).append(rng.choice(['<aside><h3>{}</h3><p>{}</p><ul>{}</ul></aside>', '<div class="sidebar"><h3>{}</h3><p>{}</p><ul>{}</ul></div>', '<div class="related"><h4>{}</h4><p>{}</p><ul>{}</ul></div>']).format(say(1, 3), say(4, 25), links(3)))
        if rng.random() < 0.15:
            part = rng.choice(['<div class="{}"><h3>{}</h3><p>{}</p><ul>{}</ul></div>', '<section class="{}"><h3>{}</h3><p>{}</p><ul>{}</ul></section>'])
            after.append(part.format(open_name().replace("story-", "more-"), say(1, 3), say(3, 20), links(rng.randint(2, 5))))
        if rng.random() < 0.3:
            (before if rng.random() < 0.5 else after).append(f'<form action="/s"><label>{say(1, 4)}</label><input name="q"><p>{say(2, 9)}</p><button>{say(1, 1)}</button></form>')
        if rng.random() < 0.35:
            after.append(comments())
        if rng.random() < 0.75:
            after.append(rng.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>']).format(say(4, 25)))
        inner = "".join(before) + core + "".join(after)
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(["wrapper", "container", "page"])}">{inner}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>", wanted))
    return pages


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null or empty html gives empty text. White space in a block becomes one space; blocks are joined by
    two line feeds. Other columns are ignored; repeated rows come back as often. Markup that is
    broken is read leniently: open elements end with the page.
    """
    small_batches(pages.sparkSession)
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
