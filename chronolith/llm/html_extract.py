"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree whose nodes are its block elements and their runs of inline text. Each node is
content or boilerplate. Node potentials come from the words of class, id and role attributes (ids of paragraphs,
headings and the like are anchors and say nothing), from hiding, and from what an element holds: the share of
its text in links, its sentences, its part of the page's text. Parent-child potentials say how a parent's label
passes to a child of a given tag, inside an article or main element, around it, outside of it, or, on a page
that has none, beside paragraphs or not.
Sum-product messages, upward from the leaves and then
downward from the root, give every node's exact marginal, and the text runs whose content marginal is at
least one half are the main text. Potentials are smoothed counts from labelled pages, which are made here
by a seeded generator (TRAIN_PAGES pages of known labels: no labelled pages come with the tables).

Output: character references decoded; white space in a block turned into one space and trimmed; blocks in
page order, joined by one line feed. Defined cases: null or empty html gives an empty text; unclosed and
stray tags are repaired as browsers do for blocks; text of hidden elements is not text of the page, that of
formulas is; page_id and url may be null or repeat (one row per row in); an empty table gives an empty result;
other columns are ignored. Nothing is cut, however long.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TRAIN_PAGES, TRAIN_SEED, SMOOTHING, PRIOR_WEIGHT, CLIP, WEAK, STRONG, LEAST_SEEN = 900, 7, 0.5, 4.0, 7.0, 0.7, 1.5, 20

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is never text of the page.
SKIPPED = frozenset("script style noscript template iframe textarea title svg object canvas annotation annotation-xml xmp noembed noframes audio video".split())
#: Of these, the ones that hold markup: without an end tag of their own, only their start tag is skipped.
MARKUP = frozenset("template svg object canvas annotation annotation-xml audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes these open elements, as far up as the nearest one of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+>",
    re.S,
)
#: Elements that hold a piece of text: their ids are anchors.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption blockquote pre figcaption summary".split())
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
# Words of class, id and role that mark a region.
GROUPS = {
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner outbrain taboola dfp",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead topbar branding logo tagline",
    "footer": "footer foot copyright legal colophon contentinfo",
    "side": "sidebar aside widget related recommended trending popular complementary rail",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe disclaimer paywall toast overlay",
    "comment": "comment comments disqus replies reply respond discussion responses feedback",
    "share": "share sharing social follow",
    "form": "form login signin signup search register",
    "content": "content article post entry story main body text page prose",
    "hidden": "hidden invisible",
}
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
GROUP_OF = {w: g for g, words in GROUPS.items() for w in words.split()}


class Page:
    """Nodes in page order (a parent precedes its children): kinds and features, texts of the leaves."""

    __slots__ = ("parent", "feats", "text", "leaf", "links", "context")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.feats: list[list[str]] = [["t:#root"]]
        self.leaf: list[bool] = [False]
        self.text: dict[int, str] = {}
        #: Of a leaf, the share of its text in links; of every node: in an article or main element, out of it, or off limits for one.
        self.links: dict[int, float] = {}
        self.context: list[str] = ["out"]


def _marks(attrs: str, tag: str) -> list[str]:
    out: dict[str, None] = {}
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDING.search(value)):
            out["hidden"] = None
        elif name in ("class", "id", "role", "aria-label") and not (name == "id" and tag in TEXTUAL):
            out |= dict.fromkeys(GROUP_OF[w] for w in re.split(r"[^a-z]+", value) if w in GROUP_OF)
    # Words for content beside others tell nothing.
    return ["both"] if "content" in out and len(out) > 1 and "hidden" not in out else list(out)


#: Text blocks that content is made of; the least part of a page's text for its article elements to be its article.
PROSE, LEAST_WITHIN = frozenset("p h1 h2 h3 h4 blockquote".split()), 0.02


def _step(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def _describe(page: Page) -> None:
    """Features of what each element holds, and the contexts of all nodes, once the whole page is known."""
    n = len(page.parent)
    size, linked, said, items = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.leaf[i]:
            text = page.text[i]
            size[i], linked[i], items[i] = len(text), len(text) * page.links[i], 1
            said[i] = int(len(text) > 30 and page.links[i] < 0.5 and text.rstrip("\"')”»")[-1:] in ".!?…。！？:")
        for total in (size, linked, said, items):
            total[page.parent[i]] += total[i]
    whole = max(1.0, size[0] - linked[0])
    within = sum((1 - page.links[i]) * len(t) for i, t in page.text.items() if page.context[i] == "in")
    has = within >= LEAST_WITHIN * whole
    around, paragraphs = [False] * n, [0] * n
    for i in range(n - 1, 0, -1):
        k = page.parent[i]
        around[k] |= around[i] or page.context[i] == "in"
        paragraphs[k] += page.feats[i][0][2:] in PROSE
    for i in range(1, n):
        if has:
            ctx = "in" if page.context[i] == "in" else "around" if around[i] else "out"
        else:
            ctx = "beside" if paragraphs[page.parent[i]] > 1 else "none"
        f = page.feats[i]
        f[0] += f"@{ctx}"
        if page.leaf[i]:
            f += [f"l {ctx} links|{_step(page.links[i], 0.1, 0.6)}", f"l {ctx} size|{_step(size[i], 12, 40, 120)} {min(said[i], 1)}"]
        else:
            tag = kind_tag(f[0])
            if len(f) == 1 and tag in ("div", "section"):
                f.append(f"g {ctx} {tag}|plain")
            share = linked[i] / size[i] if size[i] else 0.0
            if tag not in TEXTUAL:
                f.append(f"e {ctx} holds|{_step(share, 0.1, 0.6) if size[i] else 3} {_step(said[i], 1, 3)} {_step(items[i], 2, 4)}")
                f.append(f"e {ctx} part|{_step((size[i] - linked[i]) / whole, 0.02, 0.15, 0.5)}")


def _lowered(source: str) -> str:
    low = source.lower()
    if len(low) != len(source):  # rare letters change their length in lower case
        low = re.sub(r"</[A-Za-z]+", lambda x: x[0].lower(), source)
    return low


def _ends(source: str, low: str) -> dict[int, int]:
    """Where each element of MARKUP that has an end tag starts, and where that end tag does."""
    out: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    at = 0
    while m := TOKEN.search(source, at):
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if tag not in SKIPPED:
            continue
        if m["end"] or m["end2"]:
            if starts.get(tag):
                out[starts[tag].pop()] = m.start()
        elif tag not in MARKUP:
            if not (m["attrs"] or "").rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                k = low.find(f"</{tag}", at)
                at = len(source) if k < 0 else k
        elif not (m["attrs"] or "").rstrip().endswith("/"):
            starts.setdefault(tag, []).append(m.start())
    return out


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]
    pieces: list[str] = []
    linked = 0
    depth_a = 0
    unseen: list[str] = []  # open elements inside a hidden inline one, itself first
    at, end, low, ends = 0, len(source), None, None

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                tag, up = stack[-1]
                page.links[len(page.parent)] = min(1.0, linked / max(1, sum(map(len, pieces))))
                page.text[len(page.parent)] = text
                page.parent.append(up)
                page.leaf.append(True)
                page.context.append(page.context[up])
                page.feats.append([f"l:{tag}"])
        pieces, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if unseen:
            return
        pieces.append(text)
        if depth_a:
            linked += len(text)

    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"]:
                add(entities.escape(m["cdata"]))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                depth_a = 0
            elif tag not in BLOCKS and tag in unseen:
                del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
            elif tag in BLOCKS:
                unseen.clear()
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                flush()
                if k and tag not in ("html", "body"):
                    del stack[k:]
            continue
        attrs = m["attrs"] or ""
        if tag in SKIPPED:
            if low is None:
                low = _lowered(source)
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                if tag in MARKUP:
                    if ends is None:
                        ends = _ends(source, low)
                    at = ends.get(m.start(), at)
                else:
                    k = low.find(f"</{tag}", at)
                    at = end if k < 0 else k
            add(" ")
            continue
        if tag == "a":
            depth_a = 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            unseen.clear()
            flush()
            if tag in ("html", "body") and any(x == tag for x, _ in stack):
                continue
            if stack[-1][0] == "p" or any(x == "p" for x, _ in stack[-3:]):
                k = max(i for i, (x, _) in enumerate(stack) if x == "p")
                del stack[k:]
            if tag in CLOSES:
                closed, bounds = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in closed:
                        del stack[i:]
                        if tag != "tr":
                            break
            if tag == "hr":
                continue
            node = len(page.parent)
            page.parent.append(stack[-1][1])
            page.leaf.append(False)
            marks = _marks(attrs, tag) if attrs else []
            kind = "p" if tag in TEXTUAL else "g"
            page.feats.append([f"t:{tag}", *[f"{'x' if x == 'hidden' else kind} marks|{x}" for x in marks]])
            sound = all(x in ("content", "both") for x in marks) or tag in TEXTUAL
            ctx = page.context[stack[-1][1]]
            if ctx == "out" and (tag in ("nav", "aside", "footer", "form") or not sound):
                ctx = "off"  # an article element in here is none of the page's own
            page.context.append("in" if ctx == "out" and sound and tag in ("article", "main") else ctx)
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.append((tag, node))
        elif tag not in VOID and not attrs.rstrip().endswith("/") and (unseen or ("hid" in attrs or "none" in attrs) and "hidden" in _marks(attrs, "p")):
            unseen.append(tag)
    flush()
    _describe(page)
    return page


class Model:
    """P(child label | parent label) by the child's kind (its first feature), and log-odds of the other features.

    odds weighs a feature for content against boilerplate where the parent is content, away for boilerplate
    below boilerplate against boilerplate below content.
    """

    def __init__(self, odds: dict[str, float], away: dict[str, float], pass_on: dict[str, list[list[float]]], prior: float):
        self.odds, self.away, self.pass_on, self.prior = odds, away, pass_on, prior

    def pair(self, feats: list[str]) -> list[list[float]]:
        """The potential of a node and its parent: rows are the parent's label, columns the node's."""
        move = next(t for k in up_from(feats[0]) if (t := self.pass_on.get(k)))
        on, off = (math.exp(max(-CLIP, min(CLIP, sum(w.get(f, 0.0) for f in feats[1:])))) for w in (self.odds, self.away))
        return [[move[0][0] * off, move[0][1] * on], [move[1][0], move[1][1] * on]]


def kind_tag(kind: str) -> str:
    return kind[2:].partition("@")[0]


def up_from(kind: str) -> tuple[str, str, str]:
    """A kind, all of its sort in its context, and all of its sort."""
    return kind, f"{kind[:2]}@{kind.partition('@')[2]}", kind[:2]


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every node: one pass of messages up the tree, one down."""
    n = len(page.parent)
    below0, below1 = [1.0] * n, [1.0] * n
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    pairs: list = [None] + [model.pair(f) for f in page.feats[1:]]
    for i in range(n - 1, 0, -1):
        (p00, p01), (p10, p11) = pairs[i]
        b0, b1 = below0[i], below1[i]
        m0, m1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        up[i] = (m0, m1)
        k = page.parent[i]
        c0, c1 = below0[k] * m0, below1[k] * m1
        z = c0 + c1
        below0[k], below1[k] = c0 / z, c1 / z
    out = [0.0] * n
    z = below0[0] * (1 - model.prior) + below1[0] * model.prior
    belief = [(0.0, 0.0)] * n
    belief[0] = (below0[0] * (1 - model.prior) / z, below1[0] * model.prior / z)
    out[0] = belief[0][1]
    for i in range(1, n):
        q0, q1 = belief[page.parent[i]]
        m0, m1 = up[i]
        d0, d1 = q0 / max(m0, 1e-300), q1 / max(m1, 1e-300)
        (p00, p01), (p10, p11) = pairs[i]
        b0 = below0[i] * (d0 * p00 + d1 * p10)
        b1 = below1[i] * (d0 * p01 + d1 * p11)
        z = b0 + b1
        belief[i] = (b0 / z, b1 / z)
        out[i] = belief[i][1]
    return out


STATES = ON, OPEN, AWAY = "content", "boilerplate below content", "boilerplate below boilerplate"


def train(pages: list[tuple[str, set[str]]]) -> Model:
    """From pages with the set of their content blocks' texts. An element is content if it holds any."""
    # States: content; boilerplate below content; boilerplate below boilerplate.
    count, base = {x: Counter() for x in STATES}, {x: Counter() for x in STATES}
    moves: Counter = Counter()
    for source, content in pages:
        page = parse(source)
        label = [0] * len(page.parent)
        for i in range(len(label) - 1, -1, -1):
            if page.leaf[i]:
                label[i] = int(page.text[i] in content)
            if label[i] and i:
                label[page.parent[i]] = 1
        for i in range(1, len(label)):
            up = label[page.parent[i]]
            for k in set(up_from(page.feats[i][0])):
                moves[k, up, label[i]] += 1
            x = ON if label[i] else OPEN if up else AWAY
            count[x].update(page.feats[i][1:])
            # A mark is weighed against all elements of its sort, having none against all of its tag, and what
            # an element holds against others in its context.
            if not page.leaf[i]:
                tag, _, ctx = page.feats[i][0][2:].partition("@")
                sort = "p" if tag in TEXTUAL else "g"
                base[x].update((f"{sort} marks", f"{sort} {ctx} {tag}", "x marks"))
            base[x].update({b for f in page.feats[i][1:] if (b := f.partition("|")[0]).startswith(("l ", "e "))})

    def weighed(a: str, b: str) -> dict[str, float]:
        """Log-odds of the features in state a against state b; of leaves only what is strong, for they are many."""
        out = {}
        for f in set(count[a]) | set(count[b]):
            of = f.partition("|")[0]
            if min(base[a][of], base[b][of]) >= LEAST_SEEN:
                rate = [(count[x][f] + SMOOTHING) / (base[x][of] + 3 * SMOOTHING) for x in (a, b)]
                if abs(w := math.log(rate[0] / rate[1])) >= (STRONG if f.startswith("l ") else WEAK):
                    out[f] = w
        return out

    def table(kind: str, before: list[list[float]], weight: float) -> list[list[float]]:
        """Rates of a kind, drawn towards those of all its like."""
        n = [[moves[kind, p, x] + weight * before[p][x] for x in (0, 1)] for p in (0, 1)]
        return [[c / sum(row) for c in row] for row in n]

    pass_on = {k: table(k, [[0.5, 0.5], [0.5, 0.5]], 2 * SMOOTHING) for k in ("t:", "l:")}
    for kind in sorted({k for k, _, _ in moves}, key=lambda k: (k[2:3] != "@", k)):
        if kind not in pass_on:
            pass_on[kind] = table(kind, pass_on[next(k for k in up_from(kind)[1:] if k in pass_on)], PRIOR_WEIGHT)
    return Model(weighed(ON, OPEN), weighed(AWAY, OPEN), pass_on, 0.999)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[tuple[str, set[str]]]:
    """Pages of varied templates with their content blocks. Boilerplate holds long and short text alike, class
    names are listed words, others, or none, and content carries misleading ids and some misleading classes."""
    r = random.Random(seed)
    made = 0

    def say(lo: int, hi: int) -> str:
        nonlocal made
        made += 1
        words = ["".join(r.choice("aeiourstlnmdk") for _ in range(r.randint(2, 8))) for _ in range(r.randint(lo, hi))]
        return f"{' '.join(words).capitalize()} {made}{r.choice(['.', '.', '.', '!', '?', ''])}"

    def other() -> str:
        return "".join(r.choice("bcdfgjkz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))

    def anchor() -> str:
        """An id that may be any word, and now and then a class of no meaning."""
        x = r.random()
        return f' id="{r.choice(sorted(GROUP_OF))}"' if x < 0.12 else f' class="{other()}"' if x < 0.2 else f' class="{r.choice(GROUPS["content"].split())}"' if x < 0.24 else ""

    def para(tag: str = "p") -> tuple[str, str]:
        t = say(1, 60) if r.random() < 0.8 else say(1, 3)
        return f"<{tag}{anchor()}>{t}</{tag}>" if r.random() < 0.8 or tag not in ("p", "li", "td") else f"<{tag}><b>{t}</b><br>", t

    def menu(k: int, keep=None) -> str:
        out = []
        for i in range(k):
            t = say(1, 3)
            if keep:
                keep((t, t))
            out.append(f'<a href="/{i}">{t}</a>')
        shape = r.random()
        return f"<ul>{''.join(f'<li>{x}</li>' for x in out)}</ul>" if shape < 0.7 or keep else " | ".join(out) if shape < 0.85 else "".join(f"<div>{x}</div>" for x in out)

    def prose(k: int) -> str:
        return "".join(para()[0] for _ in range(k))

    def mark(kind: str) -> str:
        w = r.choice(GROUPS[kind].split())
        return r.choice([f'class="{w}"', f'id="{w}"', f'class="box {w}-{r.randint(1, 9)}"', f'class="{w}_wrap"', f'class="{other()} {w}"'])

    def inside(kind: str) -> str:
        if kind == "nav":
            return menu(r.randint(2, 9))
        if kind == "comment":
            each = r.choice(['<div class="comment">{}</div>', "<div><b>{}</b>{}</div>", "<li>{}</li>"])
            return (f"<h3>{say(1, 2)}</h3>" if r.random() < 0.4 else "") + "".join(each.replace("{}", say(1, 2), each.count("{}") - 1).replace("{}", prose(r.randint(1, 3))) for _ in range(r.randint(1, 5)))
        if kind == "footer":
            return r.choice([f"<p>&copy; {say(2, 8)}</p>", menu(r.randint(2, 5)) + say(2, 10), f"<div>{menu(4)}</div><div>{say(3, 20)}</div>"])
        if kind == "form":
            return f"<label>{say(1, 2)}</label><input name=q><button>{say(1, 1)}</button>{say(2, 9) if r.random() < 0.5 else ''}"
        return r.choice([lambda: say(3, 25), lambda: prose(r.randint(1, 5)), lambda: menu(3), lambda: f"<h3>{say(1, 4)}</h3>{prose(2)}"])()

    def region(kind: str, plainly: bool) -> str:
        """A boilerplate region; `plainly` lets it go without any listed word."""
        tags = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "comment": ["section", "div", "ol"], "form": ["form", "div"]}
        tag = r.choice(tags.get(kind, ["div", "div", "section", "aside"]))
        if kind == "hidden":
            hide = r.choice(["hidden", 'style="display:none"', 'style="color:red; display: none;"', 'aria-hidden="true"', 'class="hidden"'])
            if r.random() < 0.4:
                return f"<p {hide}>{say(1, 30)}</p>"
            return f"<{tag} {hide}>{inside('side')}</{tag}>"
        if tag == "ul":
            return f"<ul {mark(kind)}>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(3)) + "</ul>"
        x = r.random()
        how = "" if tag in ("nav", "header", "footer", "aside", "form") and x < 0.6 else f' class="{other()}"' if plainly and x < 0.5 else " " + mark(kind)
        return f"<{tag}{how}>{inside(kind)}</{tag}>"

    pages = []
    for _ in range(n):
        content: set[str] = set()

        def keep(pair: tuple[str, str], held: set[str] = content) -> str:
            held.add(pair[1])
            return pair[0]

        def block(keep=keep, content=content) -> str:
            x = r.random()
            if x < 0.6:
                return keep(para())
            if x < 0.69:
                return keep(para(r.choice(["h2", "h3"])))
            if x < 0.79:
                items = "".join(keep(para("li")) for _ in range(r.randint(1, 5)))
                return f"<ul>{items}</ul>" if r.random() < 0.6 else f"<ol>{items}</ol>"
            if x < 0.83:
                return menu(r.randint(2, 6), keep)
            if x < 0.87:
                return f"<blockquote>{keep(para())}</blockquote>"
            if x < 0.9:
                t = say(8, 30)
                content.add(f"{t} {t} link")
                return f'<p>{t} <a href="/x">{t} link</a></p>'
            if x < 0.92:
                return f"<table>{''.join('<tr>' + keep(para('td')) + '</tr>' for _ in range(2))}</table>"
            if x < 0.95:
                tag = r.choice(["div", "div", "section", "pre", "figcaption"])
                t = say(2, 50)
                return f"<{tag}>{keep(para('p')) if r.random() < 0.4 else keep((t, t))}</{tag}>"
            how = r.choice(["", f' class="{other()}"', ' class="text more"', f' class="{r.choice(GROUPS["content"].split())} {r.choice(sorted(GROUP_OF))}"'])
            tag = r.choice(["section", "div"])
            return f"<{tag}{how}>{keep(para('h2'))}{keep(para())}{keep(para())}</{tag}>"

        wrap = r.choice(
            ["<article>{}</article>"] * 5
            + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><article>{}</article></div>', '<section class="post">{}</section>', "<div>{}</div>", '<article class="entry">{}</article>', '<div class="col"><div class="inner">{}</div></div>', '<article class="news {}">{{}}</article>'.format(other())]
        )
        semantic = "<article" in wrap or "<main" in wrap
        blocks = [keep(para("h1"))] if r.random() < 0.9 else []
        blocks += [block() for _ in range(r.randint(1, 12) if semantic else r.randint(3, 14))]
        for kind, often in (("ad", 0.07), ("share", 0.07), ("notice", 0.05), ("side", 0.07), ("form", 0.05), ("hidden", 0.08)):
            if r.random() < often:
                blocks.insert(r.randint(0, len(blocks)), region(kind, False))
        if r.random() < 0.1:
            blocks.append(f'<p class="{r.choice(["share", "social", "advert", "sponsored", "copyright"])}">{say(2, 9)}</p>')
        if r.random() < 0.2:
            blocks.append(region("comment", False))
        # Without an article element, prose in a box of no name could be either: only menus and footers go unnamed.
        before = [region(k, semantic or k == "nav") for k in ("header", "nav", "ad", "notice", "form", "hidden") if r.random() < (0.45 if k != "hidden" else 0.1)]
        after = [region(k, semantic or k in ("nav", "footer")) for k in ("side", "share", "comment", "ad", "notice", "nav", "footer", "hidden") if r.random() < (0.4 if k != "hidden" else 0.1)]
        r.shuffle(before)
        body = f"{''.join(before)}{wrap.format(''.join(blocks))}{''.join(after)}"
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["container", "wrapper", other(), "page"])}">{body}</div>'
        source = f"<html><head><title>{say(2, 5)}</title></head><body>{body}</body></html>"
        pages.append((source, content))
    return pages


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    p = marginals(page, model)
    return "\n".join(t for i, t in page.text.items() if p[i] >= 0.5)


OUT = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "html").mapInArrow(run, OUT)
