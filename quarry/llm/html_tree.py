"""Main text of web pages by a tree-structured graphical model.

A page's tree has a node for each block element and for each run of inline text between block borders. Each node is content or
not. Unary potentials come from the node's own features, pair potentials tie a child to its parent; one sum-product pass from the
leaves up and one from the root down give exact marginals, and the runs whose marginal is above one half are the main text.
Both kinds of potentials are trained from labelled pages (training_pages()).
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("head script style noscript template title iframe object svg math canvas audio video select option textarea button input datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr"}, "tbody": {"thead", "tbody", "tr"}, "tfoot": {"tbody", "tr"}}
NESTING = frozenset("svg math object template".split())
SCOPES = frozenset("table ul ol dl div article section body html main aside nav header footer form".split())

#: Parts of a head; any other tag, and text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript template noframes".split())

# quotes matter only where an attribute's value starts, as HTML has it
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|))?+)*+)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[a-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("text", text, "", place), ("open", tag, attributes, place) and ("close", tag, "", place); comments, declarations and a tag cut off at the end go."""
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        m = _TAG.match(page, i) if i >= 0 else None
        if m is None:
            # a bare '<' is text
            j = page.find("<", i + 1) if i >= 0 else -1
            end = n if j < 0 else j
            yield "text", page[at:end], "", at
            at = end
            continue
        if i > at:
            yield "text", page[at:i], "", at
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, "", i
            continue
        yield "open", name, m[3] or "", i
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            yield "close", name, "", at
            # without an end tag the rest of the page is the element's, unless it was written as an empty one
            at = end.end() if end else at if m[3].endswith("/") else n


def _ends(page: str, name: str, at: int, known: dict) -> bool:
    """Whether the element opened at a place has an end tag before the next of its name opens; those that nest, whether there is any."""
    if name not in known:
        found = [(m.start(), bool(m[1])) for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I)]
        known[name] = [i for i, _ in found], [close for _, close in found]
    places, closes = known[name]
    k = bisect.bisect_right(places, at)
    return k < len(places) and (closes[k] or (name in NESTING and True in closes[k:]))


class Node:
    __slots__ = ("tag", "parent", "names", "role", "text", "links", "kids", "total", "linked", "paragraphs")

    def __init__(self, tag: str, parent: int, names: str = "", role: str = ""):
        self.tag, self.parent, self.names, self.role = tag, parent, names, role
        self.text, self.links = [], 0
        self.kids = self.total = self.linked = self.paragraphs = 0


class _Open:
    """The open elements, with the places of each name, so that no look-up walks through them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]  # every open element with its block node
        self.places: dict[str, list[int]] = {}
        self.blocks, self.skipped, self.links = [0], 0, []

    def push(self, name: str, node: int | None = None, link: bool = False) -> None:
        at = len(self.stack)
        self.places.setdefault(name, []).append(at)
        if node is not None:
            self.blocks.append(at)
        if link:
            self.links.append(at)
        self.skipped += name in SKIPPED
        self.stack.append((name, self.stack[-1][1] if node is None else node))

    def cut(self, at: int) -> bool:
        """Close everything from a place on; whether a block was among it."""
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.places[name].pop()
            self.skipped -= name in SKIPPED
        while self.links and self.links[-1] >= at:
            self.links.pop()
        block = self.blocks[-1] >= at
        while self.blocks[-1] >= at:
            self.blocks.pop()
        return block

    def last(self, names) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def imply_end(self, names, scope) -> None:
        """Close the nearest open element of names, unless one of scope lies nearer."""
        at = self.last(names)
        if at > self.last(scope - names):
            self.cut(at)


P_SCOPE = SCOPES | {"td", "th", "li"}


def tree(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the text of a "#text" node is a run of inline text, white space made single."""
    nodes = [Node("html", -1)]
    now, ends = _Open(), {}
    run: Node | None = None
    linked = False  # whether the open link has had text
    for kind, name, extra, place in tokens(page):
        if now.stack[-1][0] == "head" and (name not in IN_HEAD if kind == "open" else kind == "text" and not name.isspace()):
            now.cut(len(now.stack) - 1)
        if kind == "text":
            if now.skipped:
                continue
            text = entities.unescape(name)
            if run is None:
                if not text.strip():
                    continue
                run = Node("#text", now.stack[-1][1])
                nodes.append(run)
            run.text.append(text)
            if now.links:
                size = len(text.strip())
                run.links += size
                linked = linked or size > 0
            continue
        if kind == "open":
            if name in VOID:
                if name == "hr":
                    run = None
                elif run is not None and name == "br":
                    run.text.append(" ")
                continue
            if name in SKIPPED:
                # what has no end of its own holds nothing back
                if name in RAW or name == "head" or (not extra.rstrip().endswith("/") and _ends(page, name, place, ends)):
                    now.push(name)
                continue
            if now.skipped:
                # markup inside a skipped element
                now.push(name)
                continue
            if name in ENDS_P:
                now.imply_end({"p"}, P_SCOPE)
            if name in SIBLINGS:
                now.imply_end(SIBLINGS[name], SCOPES)
            if name in BLOCK and name != "html":
                run = None
                if now.links and linked:
                    # a link that had text before a block starts was never closed
                    now.links.clear()
                found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(extra)} if extra else {}
                hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
                nodes.append(Node(name, now.stack[-1][1], f"{found.get('class', '')} {found.get('id', '')}".lower(), "hidden" if hidden else found.get("role", "").lower()))
                now.push(name, len(nodes) - 1)
            elif name == "a":
                now.links.clear()
                linked = False
                now.push(name, link="href" in extra.lower())
            else:
                now.push(name)
        else:
            if name == "a":
                now.links.clear()
            at = now.last((name,))
            if at < 0 or name not in BLOCK and now.blocks[-1] > at:
                continue
            if now.cut(at):
                run = None
    for node in nodes:
        if node.tag == "#text":
            node.text = " ".join("".join(node.text).split())
            node.total, node.linked = len(node.text), min(node.links, len(node.text))
    for node in reversed(nodes):
        if node.parent >= 0:
            up = nodes[node.parent]
            up.total += node.total
            up.linked += node.linked
            up.kids += 1
            up.paragraphs += (node.tag == "p") + (node.paragraphs if node.tag not in ("#text", "p") else 0)
    return nodes


# Parts of class and id names that pages use for what they hold.
HINTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs pager pagination toc topbar toolbar skip",
    "frame": "header footer masthead copyright colophon legal bottom top credits",
    "side": "sidebar side aside rail widget related recommended popular trending teaser more tags",
    "ad": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored promoted",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer warning",
    "form": "form login search searchbox register contact",
    "comment": "comment comments reply replies discussion disqus respond reader feedback responses",
    "share": "share sharing social follow meta byline author date tagline",
    "body": "article content main post entry story body text page text maincontent",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}


def features(node: Node, nodes: list[Node]) -> list[str]:
    out = ["bias", f"tag={node.tag}"]
    if node.role:
        out.append(f"role={node.role}")
    for k in {_HINT[w] for w in _PART.findall(node.names) if w in _HINT}:
        out.append(f"name={k}")
    text = node.tag == "#text"
    size = 0 if not node.total else min(6, int(math.log(node.total, 4)))
    density = int(4 * node.linked / node.total + 0.5) if node.total else 5
    out += [f"links={density},{text}", f"size={size},{text}"]
    if node.parent >= 0:
        up = nodes[node.parent]
        out.append(f"in={up.tag},{text}")
        out += [f"up={k},{text}" for k in {_HINT[w] for w in _PART.findall(up.names) if w in _HINT}]
        if text and up.role:
            out.append(f"uprole={up.role}")
    if text:
        if "©" in node.text or "copyright" in node.text.lower():
            out.append("copyright")
        if node.text[-1:] in ".!?:;\"”»…)":
            out.append("sentence")
    else:
        out.append(f"paragraphs={min(3, node.paragraphs)}")
    return out


class Model:
    """Log potentials: unary weights by feature (for content against not), and pair[parent label][child label]."""

    def __init__(self, unary: dict[str, float], pair: list[list[float]]):
        self.unary, self.pair = unary, pair

    def marginals(self, nodes: list[Node], agreement: bool = False):
        """Probability of content for each node, by sum-product up and down the tree; with agreement also that its parent has its label."""
        n, get = len(nodes), self.unary.get
        (p00, p01), (p10, p11) = [[math.exp(v) for v in row] for row in self.pair]
        own = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(get(f, 0.0) for f in features(x, nodes)))))) for x in nodes]
        # up: what each node's subtree says of it, as (not content, content), kept to a sum of one
        low, high = [1 - p for p in own], list(own)
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b = low[i], high[i]
            u, v = p00 * a + p01 * b, p10 * a + p11 * b
            m0[i], m1[i] = u / (u + v), v / (u + v)
            j = nodes[i].parent
            x, y = low[j] * m0[i], high[j] * m1[i]
            s = x + y
            low[j], high[j] = (x / s, y / s) if s > 0 else (0.5, 0.5)
        # down: the parent's belief without this child, passed through the pair potential
        out, agree = [0.0] * n, [0.0] * n
        b0, b1 = [0.0] * n, [0.0] * n
        b0[0], b1[0], out[0] = low[0], high[0], high[0]
        for i in range(1, n):
            j = nodes[i].parent
            a, b = b0[j] / max(m0[i], 1e-12), b1[j] / max(m1[i], 1e-12)
            s = a + b
            a, b = a / s, b / s
            x, y = low[i] * (p00 * a + p10 * b), high[i] * (p01 * a + p11 * b)
            s = x + y
            agree[i] = (low[i] * p00 * a + high[i] * p11 * b) / s
            b0[i], b1[i] = x / s, y / s
            out[i] = b1[i]
        return (out, agree) if agreement else out

    def text(self, page: str) -> str:
        nodes = tree(page)
        return "\n".join(x.text for x, p in zip(nodes, self.marginals(nodes), strict=True) if x.tag == "#text" and x.text and p > 0.5)


MARK = "\ue000"  # a private-use character: stands before each content text of a training page


def training_pages(count: int = 300, seed: int = 7) -> list[str]:
    """Labelled pages: layouts of many kinds with invented words, each content text marked with MARK."""
    rng = random.Random(seed)
    bits = "an ba co de en fi ga ho in ju ka lo mi ne or pa qui re so ta un ve wa xi yo zu th st er".split()

    def words(lo: int, hi: int, sentence: bool = True) -> str:
        out = ["".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        if not sentence:
            return " ".join(out)
        return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(out)) + "."

    def links(tag: str, n: int) -> str:
        item = "li" if tag in ("ul", "ol") else "span"
        return f"<{tag}>" + "".join(f'<{item}><a href="/{k}">{words(1, 3, False)}</a></{item}>' for k in range(n)) + f"</{tag}>"

    def named(tag: str, *names: str) -> str:
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'

    def menu() -> str:
        inner = links(rng.choice(["ul", "div"]), rng.randint(3, 9))
        return rng.choice([f"<nav>{inner}</nav>", f"{named('div', 'nav', 'menu', 'main-menu', 'breadcrumbs', 'navbar')}{inner}</div>", f'<div role="navigation">{inner}</div>'])

    def header() -> str:
        inner = rng.choice([words(1, 5, False), menu(), f"<h2>{words(1, 4, False)}</h2>", f"<p>{words(3, 9)}</p>"])
        return rng.choice([f"<header>{inner}</header>", f"{named('div', 'header', 'site-header', 'masthead', 'top-bar')}{inner}</div>"])

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(2, 8)}", f"<p>{words(4, 12)}</p>", links("ul", 4), f"Copyright {words(2, 5)}", f"&copy; x.example &middot; {words(4, 14)}"])
        return rng.choice([f"<footer>{inner}</footer>", f"{named('div', 'footer', 'site-footer', 'copyright', 'legal')}{inner}</div>"])

    def aside() -> str:
        inner = "".join(rng.choice([f"<p>{words(4, 30)}</p>", links("ul", 4), f"<h3>{words(1, 4, False)}</h3>"]) for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<aside>{inner}</aside>", f"{named('div', 'sidebar', 'related', 'widget', 'side-rail', 'popular-posts')}{inner}</div>"])

    def advert() -> str:
        text = words(3, 30)
        return rng.choice([f"{named('div', 'ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner')}{rng.choice([text, f'<p>{text}</p>'])}</div>", f"<section class=\"sponsored\"><p>{text}</p></section>"])

    def notice() -> str:
        inner = f"<p>{words(5, 30)}</p>{rng.choice(['', '<button>' + words(1, 2, False) + '</button>'])}"
        return f"{named('div', 'cookie-notice', 'consent', 'newsletter', 'popup', 'alert', 'notice')}{rng.choice([inner, words(5, 30)])}</div>"

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4, False)}</label><input name="q"><p>{words(2, 14)}</p><button>{words(1, 2, False)}</button></form>'

    def comments() -> str:
        each = rng.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", '<article class="comment"><p>{}</p></article>'])
        inner = "".join(each.format(words(4, 60)) for _ in range(rng.randint(1, 5)))
        if each.startswith("<li"):
            inner = f"<ol>{inner}</ol>"
        return f"{named(rng.choice(['div', 'section']), 'comments', 'reader-comments', 'discussion', 'replies')}{rng.choice(['', f'<h3>{words(1, 3, False)}</h3>'])}{inner}</{'section' if rng.random() < 0 else 'div'}>"

    def block(depth: int = 0) -> str:
        text = MARK + words(1, 120 if rng.random() < 0.6 else 15)
        return rng.choice(
            [f"<p>{text}</p>"] * 8
            + [f"<p><b>{text}<br>", f"<p>{text}", f"<h2>{MARK}{words(1, 6, False)}</h2>", f"<h3>{MARK}{words(1, 6, False)}</h3>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>", f"<div>{text}</div>"]
            + ["<ul>" + "".join(f"<li>{MARK}{words(1, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"]
            + ["<table>" + "".join(f"<tr><td>{MARK}{words(1, 4, False)}</td><td>{MARK}{words(1, 4, False)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"]
            + [f'<p>{text} <a href="/x">{words(1, 4, False)}</a> {words(2, 20)}</p>', f"<figure><img src=x><figcaption>{text}</figcaption></figure>"]
            + ([f"<section>{block(1)}{block(1)}</section>"] if not depth else [])
        )

    def article() -> str:
        parts = [block() for _ in range(rng.choice([0, 1, 2, 4, 8, 14]))]
        if rng.random() < 0.25 and parts:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([advert, aside, notice, menu])())
        title = rng.choice([f"<h1>{MARK}{words(2, 9, False)}</h1>"] * 3 + [f"<header><h1>{MARK}{words(2, 9, False)}</h1></header>", ""])
        if rng.random() < 0.15:
            title += f'<div class="share">{links("div", 3)}</div>'
        inner = title + "".join(parts)
        if rng.random() < 0.2:
            inner += comments()
        kind = rng.random()
        if kind < 0.55:
            return f"<article>{inner}</article>"
        if kind < 0.75:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return f"{named('div', 'content', 'post', 'entry-content', 'article-body', 'story', 'main')}{inner}</div>"
        return f"<div>{inner}</div>"

    pages = []
    for _ in range(count):
        before = [f() for f in rng.sample([menu, header, advert, notice, form, aside], rng.randint(1, 4))]
        after = [f() for f in rng.sample([comments, aside, advert, form, notice, menu], rng.randint(0, 3))] + [footer()] * (rng.random() < 0.85)
        middle = article()
        if rng.random() < 0.3:
            middle = f"<div class=\"{rng.choice(['wrapper', 'container', 'layout', 'row'])}\">{middle}{rng.choice(['', aside()])}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6, False)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"
        pages.append(page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.1 else page)
    return pages


def labelled(page: str) -> tuple[list[Node], list[bool | None]]:
    """A training page's tree and labels: a node is content if most of its text is; None where there is no text."""
    nodes = tree(page)
    good, held = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            marked = MARK in x.text
            x.text = x.text.replace(MARK, "")
            good[i], held[i] = (len(x.text) if marked else 0), len(x.text)
        if x.parent >= 0:
            good[x.parent] += good[i]
            held[x.parent] += held[i]
    return nodes, [2 * g > h if h else None for g, h in zip(good, held, strict=True)]


def train(pages: list[str], rounds: int = 8, ridge: float = 1e-3) -> Model:
    """Logistic regression and counts give a first model; gradient steps on the likelihood of whole trees then fit both kinds of potentials together.

    The gradient of a weight is what the labels show less what the marginals expect, so every step runs the messages.
    """
    trees, index = [], {}
    for page in pages:
        nodes, label = labelled(page)
        trees.append((nodes, label, [[index.setdefault(f, len(index)) for f in features(x, nodes)] for x in nodes]))
    held = [(own, y) for _, label, feats in trees for own, y in zip(feats, label, strict=True) if y is not None]
    x, y, w = np.zeros((len(held), len(index))), np.array([v for _, v in held], float), np.zeros(len(index))
    for i, (own, _) in enumerate(held):
        x[i, own] = 1
    for _ in range(6):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        step = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        w -= np.linalg.solve(step, x.T @ (p - y) + ridge * len(y) * w)
    names, pair = list(index), 0.0
    speed, pair_speed = np.full(len(w), 1e-2), 1e-2
    for _ in range(rounds):
        for at in range(0, len(trees), 20):
            grad, pair_grad = -1e-3 * w, 0.0
            model = Model(dict(zip(names, w.tolist(), strict=True)), [[pair, -pair], [-pair, pair]])
            for nodes, label, feats in trees[at : at + 20]:
                believed, agree = model.marginals(nodes, agreement=True)
                for i, own in enumerate(feats):
                    if label[i] is None:
                        continue
                    for f in own:
                        grad[f] += label[i] - believed[i]
                    j = nodes[i].parent
                    if j >= 0 and label[j] is not None:
                        pair_grad += 2 * ((label[i] == label[j]) - agree[i])
            speed += grad**2
            pair_speed += pair_grad**2
            w = w + 0.5 * grad / np.sqrt(speed)
            pair += 0.3 * pair_grad / math.sqrt(pair_speed)
    return Model(dict(zip(names, w.tolist(), strict=True)), [[pair, -pair], [-pair, pair]])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages cut off anywhere are read as far as they go; no text is dropped or cut for
    its length; repeated rows give repeated results; an empty table gives no rows; other columns play no part.
    """
    model = model or train(training_pages())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [model.text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
