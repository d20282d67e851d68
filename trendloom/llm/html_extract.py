"""Main text of web pages by a tree-structured graphical model over the page's blocks.

Every block-level element is a binary variable (article content or not) with a potential from its own features;
parent and child share a potential. Sum-product messages upward and downward give the exact marginals, with which
the model is trained on labelled pages (written by ``labelled_pages``) and read: text runs of elements whose marginal
exceeds one half are the page's text.

Defined results: null or empty html gives an empty text; so does a page without article content; broken markup is
read as far as it goes, and of forms only the controls are dropped unread, as whole pages stand in some (an unclosed comment, script or tag swallows the rest); repeated rows are extracted one by one;
other columns are kept out; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: names of HTML elements
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noframes noembed xmp title textarea".split())
DROPPED = set("head select option input object applet audio video canvas svg map datalist".split())
# text within a form is a control's; elsewhere it belongs to the sentence around it, and goes where it is all of a block
CONTROLS = set("button label legend".split())
CLOSES_P = BLOCK - {"body", "html"}
# fixed values: words in class, id and role attributes
GOOD_HINTS = set("article content post entry main story text body page blog news read prose maincontent articlebody posttext".split())
BAD_HINTS = set("nav navbar navigation menu menubar topmenu header masthead footer foot bottom sidebar side aside rail widget ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist respond reply replies disqus discussion share sharing social related recommended more breadcrumb breadcrumbs pagination pager tags tagcloud copyright legal disclaimer skip toolbar meta author byline".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_attribute = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_word = re.compile(r"[a-z]+")
_end_mark = re.compile(r"[.!?…。](?:\s|$|[\"')])")
# elements that the model takes for others: what heads a table is a cell of it
ALIKE = {"th": "td", "caption": "figcaption", "summary": "p", "dir": "ul"}
TAGS = "body div section article main p li ul ol td tr table h1 h2 h3 h4 h5 h6 blockquote pre nav header footer aside dl dt dd figure figcaption details form fieldset dialog menu".split()


class Page:
    """Elements in page order, with their parents, and the text runs that stand directly in them."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.hint: list[int] = [0]
        self.size: list[int] = [0]
        self.linked: list[int] = [0]
        self.ends: list[int] = [0]
        self.runs: list[tuple[int, str]] = []

    def add(self, tag: str, parent: int, attributes: str) -> int:
        hint = 0
        if attributes:
            for m in _attribute.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hint |= 4
                elif name not in ("style", "hidden", "aria-hidden"):
                    words = set(_word.findall(value))
                    hint |= (1 if words & GOOD_HINTS else 0) | (2 if words & BAD_HINTS else 0)
        self.parent.append(parent)
        self.tag.append(tag)
        self.hint.append(hint)
        self.size.append(0)
        self.linked.append(0)
        self.ends.append(0)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """The block tree of a page: inline elements give their text to the block around them."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block that each belongs to
    pieces: list[str] = []
    linked: list[int] = [0]
    pressed: list[int] = [0]  # characters of controls
    gone: list[bool] = [False]  # of each open element, whether its text goes
    dropped = anchors = forms = controls = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text and pressed[0] < sum(not c.isspace() for c in text):
                node = stack[-1][1]
                page.runs.append((node, text))
                page.size[node] += len(text)
                page.linked[node] += min(len(text), linked[0])
                page.ends[node] += len(_end_mark.findall(text))
        linked[0] = pressed[0] = 0

    def close(depth: int) -> None:
        nonlocal dropped, anchors, forms, controls
        while len(stack) > depth:
            name = stack[-1][0]
            if name in BLOCK:
                flush()
            dropped -= gone.pop()
            anchors -= name == "a"
            forms -= name == "form"
            controls -= name in CONTROLS
            stack.pop()

    def text(value: str) -> None:
        if value and not dropped:
            pieces.append(value)
            if anchors:
                linked[0] += len(value.strip())
            if controls:
                pressed[0] += sum(not c.isspace() for c in entities.unescape(value))

    at, n = 0, len(source)
    while at < n:
        m = _token.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if not source.startswith(">", m.end() - 1):
            break  # the page ends within a tag
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                close(depth)
            elif name == "p" or name == "br":
                text(" ")
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
            if end is None:
                break
            at = end.start()
            close_at = source.find(">", at)
            at = n if close_at < 0 else close_at + 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            text(" ")
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        for closing, until in ((("li",), ("ul", "ol", "menu", "dir")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",)), (("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "article", "section", "body", "main", "header"))):
            if name in closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closing:
                        close(i)
                        break
                    if stack[i][0] in until:
                        break
        if name == "body" or name == "html":
            close(1)
        elif name == "head":
            pass
        attributes = m[3] or m[6] or ""
        if name in BLOCK and name != "html":
            flush()
            node = page.add(name, stack[-1][1], attributes)
        else:
            node = stack[-1][1]
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        stack.append((name, node))
        gone.append(name in DROPPED or (name in CONTROLS and forms > 0))
        dropped += gone[-1]
        anchors += name == "a"
        forms += name == "form"
        controls += name in CONTROLS
    close(1)
    flush()
    return page


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


SIZES, SHARES = (0, 25, 80, 250, 1000), (0.0, 0.25, 0.6)
N_TAGS = len(TAGS) + 1
N_FEATURES = N_TAGS + 4 + (len(SIZES) + 1) + (len(SHARES) + 1) + 3 + (len(SIZES) + 1) + (len(SHARES) + 1) + 2
KINDS = 3  # potentials for plain children, semantic boilerplate, semantic content


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Indices of each element's binary features, and the kind of its bond with its parent."""
    n = len(page.tag)
    below, below_linked = list(page.size), list(page.linked)
    for i in range(n - 1, 0, -1):
        below[page.parent[i]] += below[i]
        below_linked[page.parent[i]] += below_linked[i]
    out, kinds = [], []
    for i in range(n):
        tag = ALIKE.get(page.tag[i], page.tag[i])
        own = page.size[i]
        at = 0
        f = [TAGS.index(tag) if tag in TAGS else N_TAGS - 1]
        at = N_TAGS
        f.append(at + (0 if page.hint[i] == 0 else 3 if page.hint[i] & 4 else 2 if page.hint[i] & 2 else 1))
        at += 4
        f.append(at + _bucket(own, SIZES))
        at += len(SIZES) + 1
        f.append(at + _bucket(page.linked[i] / own if own else 0.0, SHARES))
        at += len(SHARES) + 1
        f.append(at + min(2, page.ends[i]))
        at += 3
        f.append(at + _bucket(below[i], SIZES))
        at += len(SIZES) + 1
        f.append(at + _bucket(below_linked[i] / below[i] if below[i] else 0.0, SHARES))
        at += len(SHARES) + 1
        f.append(at + (page.parent[i] <= 0))
        out.append(f)
        bad = tag in ("nav", "header", "footer", "aside", "fieldset", "dialog", "menu") or page.hint[i] & 6
        kinds.append(1 if bad else 2 if tag in ("article", "main") or page.hint[i] & 1 else 0)
    return out, kinds


def marginals(parent: list[int], unary: list[float], bond: list[list[float]], kinds: list[int]) -> tuple[list[float], list[list[float]], float]:
    """Content probabilities, joint probabilities with the parent (00, 01, 10, 11), log normaliser.

    ``bond`` has, by kind, log potentials of (parent, child) labels; elements come after their parents."""
    n = len(parent)
    up0, up1 = [0.0] * n, list(unary)
    table = [[math.exp(x) for x in row] for row in bond]
    m0, m1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        t = table[kinds[i]]
        top = max(up0[i], up1[i])
        a, b = math.exp(up0[i] - top), math.exp(up1[i] - top)
        m0[i] = math.log(t[0] * a + t[1] * b) + top
        m1[i] = math.log(t[2] * a + t[3] * b) + top
        up0[parent[i]] += m0[i]
        up1[parent[i]] += m1[i]
    top = max(up0[0], up1[0])
    log_z = math.log(math.exp(up0[0] - top) + math.exp(up1[0] - top)) + top
    p = [0.0] * n
    joint = [[0.0] * 4] * n
    p[0] = math.exp(up1[0] - log_z)
    down0, down1 = [0.0] * n, [0.0] * n
    for i in range(1, n):
        j = parent[i]
        # the parent's belief without this child
        o0, o1 = up0[j] + down0[j] - m0[i], up1[j] + down1[j] - m1[i]
        t = bond[kinds[i]]
        q = [o0 + t[0] + up0[i], o0 + t[1] + up1[i], o1 + t[2] + up0[i], o1 + t[3] + up1[i]]
        top = max(q)
        e = [math.exp(x - top) for x in q]
        total = sum(e)
        joint[i] = [x / total for x in e]
        p[i] = joint[i][1] + joint[i][3]
        top = max(o0, o1)
        a, b = math.exp(o0 - top), math.exp(o1 - top)
        w = table[kinds[i]]
        down0[i] = math.log(w[0] * a + w[2] * b) + top
        down1[i] = math.log(w[1] * a + w[3] * b) + top
    return p, joint, log_z


class TreeModel:
    def __init__(self) -> None:
        self.weight = np.zeros(N_FEATURES)
        self.bond = np.zeros((KINDS, 4))

    def scores(self, page: Page) -> list[float]:
        f, kinds = features(page)
        w = self.weight.tolist()
        return marginals(page.parent, [sum(w[k] for k in x) for x in f], self.bond.tolist(), kinds)[0]

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> list[float]:
        """Gradient ascent (Adam) on the log likelihood of the labels; its values by round."""
        data = [(page, labels, *features(page)) for page, labels in pages]
        size = N_FEATURES + KINDS * 4
        first, second, history = np.zeros(size), np.zeros(size), []
        for r in range(1, rounds + 1):
            g, total = np.zeros(size), 0.0
            w, bond = self.weight.tolist(), self.bond.tolist()
            for page, labels, f, kinds in data:
                unary = [sum(w[k] for k in x) for x in f]
                p, joint, log_z = marginals(page.parent, unary, bond, kinds)
                total -= log_z
                for i, (x, y) in enumerate(zip(f, labels, strict=True)):
                    total += unary[i] * y
                    for k in x:
                        g[k] += y - p[i]
                    if i:
                        base, right = N_FEATURES + 4 * kinds[i], 2 * labels[page.parent[i]] + y
                        total += bond[kinds[i]][right]
                        g[base + right] += 1
                        for k in range(4):
                            g[base + k] -= joint[i][k]
            g = g / len(data) - decay * np.r_[self.weight, self.bond.ravel()]
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            step = rate * first / (1 - 0.9**r) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
            self.weight += step[:N_FEATURES]
            self.bond += step[N_FEATURES:].reshape(KINDS, 4)
            history.append(total / len(data))
        return history


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with the text runs that are content, in order."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 10))) for _ in range(r.randrange(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + r.choice(["."] * 6 + ["!", "?"])

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(r.randrange(1, k)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' for _ in range(r.randrange(2, k)))

    def boilerplate() -> str:
        return r.choice([
            lambda: f"<nav{r.choice(['', ' class=\"menu\"'])}><ul>{links(9)}</ul></nav>",
            lambda: f'<div class="{r.choice(["nav", "menu", "navbar", "breadcrumbs"])}">{"".join(f"<a href=#>{words(1, 3)}</a> | " for _ in range(r.randrange(2, 7)))}</div>',
            lambda: f"<header><h2>{words(1, 4)}</h2><p>{words(2, 8)}</p></header>",
            lambda: f'<div class="{r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo"])}">{sentence()}</div>',
            lambda: f'<div class="{r.choice(["ad", "promo", "advertisement"])}"><p>{prose(3)}</p></div>',
            lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["notice", "cookie-consent", "newsletter", "alert"])}"><p>{prose(3)}</p><a href=#>{words(1, 3)}</a></div>',
            lambda: f'<aside{r.choice(["", " class=\"sidebar\""])}><h3>{words(1, 4)}</h3><ul>{links(7)}</ul><p>{prose(3)}</p></aside>',
            lambda: f'<div id="{r.choice(["sidebar", "related", "widget", "share"])}"><h4>{words(1, 3)}</h4><ul>{links(6)}</ul></div>',
            lambda: f'<section class="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{prose(4)}</p></div>' for _ in range(r.randrange(1, 5))) + "</section>",
            lambda: f'<div id="comments"><ol class="commentlist">{"".join(f"<li><p>{prose(4)}</p></li>" for _ in range(r.randrange(1, 5)))}</ol></div>',
            lambda: f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>",
            lambda: f"<footer><p>{prose(3)}</p><ul>{links(5)}</ul></footer>",
            lambda: f'<div class="footer">{words(2, 9)}</div>',
            lambda: f"<ul>{links(8)}</ul>",
            lambda: f"<form><p>{sentence()}</p><input name=q></form>",
            lambda: f'<form{r.choice(["", " method=post", " id=f"])}>{r.choice(["<p>%s</p>", "<div>%s</div>", "<fieldset><p>%s</p></fieldset>", "%s", "<h3>%s</h3>"]) % prose(3)}<label>{words(1, 3)}</label><input name=m><button>{words(1, 2)}</button></form>',
            lambda: f"<dialog open><p>{prose(3)}</p><button>{words(1, 2)}</button></dialog>",
            lambda: f"<menu>{links(6)}</menu>",
        ])()

    def article(out: list[str]) -> str:
        def own(text: str) -> str:
            out.append(text)
            return text

        parts = [f"<h1>{own(words(2, 10))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.6:
                parts.append(f"<p>{own(prose(8))}</p>")
            elif kind < 0.66:
                parts.append(f"<p>{own(sentence(1, 4))}</p>")
            elif kind < 0.72:
                parts.append(f"<p>{own(words(2, 30))}</p>")
            elif kind < 0.77:
                parts.append(f"<h2>{own(words(1, 7))}</h2>")
            elif kind < 0.82:
                parts.append(f"<blockquote>{own(prose(4))}</blockquote>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{own(sentence(2, 12))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{own(words(1, 5))}</td><td>{own(words(1, 5))}</td></tr>" for _ in range(r.randrange(1, 4))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<pre>{own(words(3, 30))}</pre>")
            else:
                parts.append(boilerplate() if r.random() < 0.5 else f"<div>{own(prose(5))}</div>")
        return "".join(parts)

    pages = []
    for _ in range(n):
        out: list[str] = []
        inner = article(out)
        open_, close = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ('<div class="entry-content"><div>', "</div></div>"), ("", "")])
        if r.random() < 0.12:  # laid out as a table
            cells = r.choice([" | ", "<br>"]).join(f"<a href=/{words(1, 2)}>{words(1, 3)}</a>" for _ in range(r.randrange(2, 7)))
            top = " | ".join(f"<a href=/>{words(1, 3)}</a>" for _ in range(r.randrange(2, 5)))
            foot = r.choice([f"<small>Copyright {words(1, 4)}</small>", f"<font size=1>&copy; {words(2, 6)}</font>", words(2, 7)])
            rows = [f"<tr><td colspan=2>{top}</td></tr>", f"<tr><td width=150>{cells}</td><td>{inner}</td></tr>", f"<tr><td colspan=2>{foot}</td></tr>"]
            pages.append((f"<html><body><table>{''.join(rows)}</table></body></html>", out))
            continue
        before = "".join(boilerplate() for _ in range(r.randrange(0, 4)))
        skip = r.random() < 0.25  # a link that stands in the page's own element
        if skip:
            before = f'<a{r.choice(["", " class=skip-link"])} href="#c">{words(1, 5)}</a>' + before
        after = "".join(boilerplate() for _ in range(r.randrange(0, 4)))
        wrap = ("<div id=page>", "</div>") if skip else r.choice([("<div class=wrapper>", "</div>")] * 3 + [('<form method=post id="page">', "</form>")] * 2 + [("", "")] * 5)
        pages.append((f"<html><body>{wrap[0]}{before}{open_}{inner}{close}{after}{wrap[1]}</body></html>", out))
    return pages


def label(page: Page, content: list[str]) -> list[int]:
    """Labels of elements: by their own text where they have some, else by most of the text below them."""
    wanted = {" ".join(c.split()) for c in content}
    good, all_ = [0] * len(page.tag), [0] * len(page.tag)
    for node, text in page.runs:
        all_[node] += len(text)
        good[node] += len(text) * (text in wanted)
    own = [2 * g > a if a else None for g, a in zip(good, all_, strict=True)]
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        all_[page.parent[i]] += all_[i]
    return [int(2 * g > a if o is None else o) for o, g, a in zip(own, good, all_, strict=True)]


@lru_cache(maxsize=1)
def trained(n: int = 400) -> TreeModel:
    model = TreeModel()
    model.fit([(page, label(page, content)) for source, content in labelled_pages(n) for page in [parse(source)]])
    return model


def main_text(source: str | None, model: TreeModel) -> str:
    if not source:
        return ""
    page = parse(source)
    if not page.runs:
        return ""
    p = model.scores(page)
    return "\n\n".join(text for node, text in page.runs if p[node] > 0.5)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    model = trained()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
