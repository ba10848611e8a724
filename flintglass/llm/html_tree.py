"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are nodes with a hidden state (content or not). Node potentials come from features of the
element (tag, class and id words, text length, link share), edge potentials from parent and child state and from
whether the child's tag opens an article or page furniture. Sum-product messages go upward and downward once and
give each node's marginal; blocks of nodes with a marginal of at least 0.5 are the main text. The model is trained by
maximum likelihood on labelled pages: the ones written below, and a bounded sample (`MAX_TRAINING` pages of at most
`MAX_PAGE_CHARS` characters) of the table's own pages, labelled by their article or main element. Each of the latter is
also taken with that element turned into a plain and into a named div, so that the model does not rest on the tag alone.

The parser follows HTML's rules for optional tags, attributes and comments and reads each character a bounded number
of times. A form is left out unless it holds an article or main element or more than half of the page's text.

Defined results: null or empty html, or html without text, gives an empty text with 0 characters; one row for each input
row, repeated rows included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import hash_below, per_row

MAX_TRAINING, MAX_PAGE_CHARS = 200, 65_536

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noframes".split())
HEAD = frozenset("title meta link base basefont bgsound script style noscript template noframes".split())
BLOCK = frozenset(
    "html body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset details summary address hr dialog menu search center option select button legend hgroup dir listing".split()
)
CLOSES_P = BLOCK - frozenset(("html", "body", "td", "th", "caption", "option"))
TAGS = ("html", "body", "article", "main", "section", "header", "footer", "nav", "aside", "div", "p", "li", "ul", "form", "table", "blockquote", "pre", "figure", "dialog")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NEVER = frozenset(("head", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "svg", "object", "textarea", "noframes", "xmp", "datalist", "audio", "video", "canvas", "math"))
#: A start tag closes an open element of its group unless one of the others stands between.
IMPLIED = {
    "li": (("li",), ()), "dt": (("dt", "dd"), ()), "dd": (("dt", "dd"), ()), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)), "option": (("option",), ("select",)),
}
LOOSE = frozenset(("address", "div", "p"))
CUES = (
    r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner)(?:$|[^a-z])", r"nav|menu|breadcrumb|pagination|pager|toolbar", r"comment|reply|replies|respond|discuss|disqus",
    r"cookie|consent|notice|popup|modal|newsletter|subscribe|gdpr|alert", r"sidebar|aside|widget|related|recommend|share|social|tags", r"foot|header|masthead|copyright|legal", r"article|content|post|entry|story|main|text|body",
)
_CUES = [re.compile(c) for c in CUES]
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
_END = re.compile(r"[\s/]*>?")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
_HINTS = frozenset(("class", "id", "role"))
_BLANK = re.compile(r"\s+")
N_FEATURES = len(TAGS) + len(CUES) + 8
N_EDGES = 4 * 3


@dataclass
class Page:
    """Nodes in page order (a parent before its children) and text blocks (node, text)."""

    parent: list[int]
    tag: list[str]
    hint: list[str]
    linked: list[int]
    size: list[int]
    blocks: list[tuple[int, str]]


def _attributes(source: str, at: int, unclosed: set[str]) -> tuple[list[str], int]:
    """Values of class, id and role, and the place after the tag. A quote that is never closed is part of its value;
    `unclosed` remembers such quotes, so that no text is searched for them twice."""
    hints: list[str] = []
    while m := _ATTRIBUTE.match(source, at):
        at, value = m.end(), m[3]
        if m[2]:
            end = -1 if m[2] in unclosed else source.find(m[2], at)
            if end < 0:
                unclosed.add(m[2])
                end = at
                while end < len(source) and source[end] != ">" and not source[end].isspace():
                    end += 1
            value = source[at:end]
            at = min(end + (end < len(source) and source[end] == m[2]), len(source))
        if value and m[1].lower() in _HINTS:
            hints.append(value.lower())
    return hints, _END.match(source, at).end()


def _markup(source: str, at: int) -> int | None:
    """The place after a comment, declaration or instruction that starts at `at`; None where there is none."""
    if source.startswith("<!--", at):
        if source.startswith((">", "->"), at + 4):
            return source.index(">", at) + 1
        m = _COMMENT_END.search(source, at + 4)
        return m.end() if m else len(source)
    if source[at + 1 : at + 2] in ("!", "?", "/"):
        end = source.find(">", at)
        return end + 1 if end >= 0 else len(source)
    return None


def parse(source: str) -> Page:
    """Block elements become nodes; inline elements only add text; script, style and form controls are never text."""
    page = Page([-1], ["html"], [""], [0], [0], [])
    stack, buffer, muted, links, linked = [(0, "html")], [], 0, 0, 0
    opened: dict[str, int] = {"html": 1}
    found: list[tuple[int, str, int, int]] = []  # node, text, characters in links, innermost form
    forms: list[int] = []
    outer: dict[int, int] = {}
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _BLANK.sub(" ", "".join(buffer)).strip()
            if text:
                found.append((stack[-1][0], text, linked, forms[-1] if forms else -1))
            buffer.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal muted
        flush()
        while len(stack) > depth:
            node, name = stack.pop()
            opened[name] -= 1
            muted -= name in NEVER
            if name == "form":
                forms.pop()

    def text(piece: str) -> None:
        nonlocal linked
        if stack[-1][1] == "head" and piece and not piece.isspace():
            close(len(stack) - 1)  # text ends a head that was left open
        if piece and not muted:
            decoded = htmllib.unescape(piece)
            buffer.append(decoded)
            if links:
                linked += len(decoded)

    at = seen = 0  # `seen`: text before it is taken
    while (at := source.find("<", at)) >= 0:
        name = _NAME.match(source, at + 1)
        shut = None if name else _NAME.match(source, at + 2) if source.startswith("</", at) else None
        if not name and not shut:
            end = _markup(source, at)
            if end is None:
                at += 1  # a plain character
                continue
            text(source[seen:at])
            at = seen = end
            continue
        text(source[seen:at])
        if shut:
            tag = shut[0].lower()
            end = source.find(">", shut.end())
            at = seen = end + 1 if end >= 0 else len(source)
            if opened.get(tag):
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][1] == tag)
                if depth:
                    close(depth)
                    links = 0
            elif tag == "a":
                links = max(0, links - 1)
            continue
        tag = name[0].lower()
        hints: list[str] = []
        at = name.end()
        if source.startswith(">", at):
            at += 1
        else:
            hints, at = _attributes(source, at, unclosed)
        seen = at
        if stack[-1][1] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            m = _RAW_END[tag].search(source, at)
            at = seen = m.end() if m else len(source)
            continue
        if tag == "a":
            links += 1
        if tag in ("br", "hr", "img", "wbr"):
            buffer.append(" " if tag != "wbr" else "")
        if tag in VOID or not (tag in BLOCK or tag in NEVER or tag == "head"):
            continue
        if tag in ("svg", "math") and source[at - 2 : at] == "/>":
            continue
        if tag in ("html", "body", "head") and (opened.get(tag) and len(stack) > 1 or tag == "head" and (found or len(stack) > 2)):
            continue
        if tag in CLOSES_P and opened.get("p") and stack[-1][1] == "p":
            close(len(stack) - 1)
        if tag in HEADINGS and stack[-1][1] in HEADINGS:
            close(len(stack) - 1)
        ends, walls = IMPLIED.get(tag, ((), ()))
        if any(opened.get(x) for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                other = stack[i][1]
                if other in ends:
                    close(i)
                    break
                if other in walls or not walls and other not in LOOSE:
                    break
        flush()
        links = 0
        page.parent.append(stack[-1][0])
        page.tag.append(tag)
        page.hint.append(" ".join(hints))
        node = len(page.tag) - 1
        if tag == "form":
            outer[node] = forms[-1] if forms else -1
            forms.append(node)
        stack.append((node, tag))
        opened[tag] = opened.get(tag, 0) + 1
        muted += tag in NEVER
    text(source[seen:])
    close(1)
    flush()
    _fill(page, found, outer)
    return page


#: Elements that stand around a page's text and not in a form that is filled in.
AROUND = ("article", "main", "nav", "header", "footer", "aside")


def _fill(page: Page, found: list[tuple[int, str, int, int]], outer: dict[int, int]) -> None:
    """Blocks, sizes and link sizes without the forms' own text. A form that encloses the article or the page's furniture,
    or the outermost one where no text stands outside of forms, is a frame around the page and becomes a div."""
    page.size, page.linked = [0] * len(page.tag), [0] * len(page.tag)
    wide = set()
    if outer:
        if found and all(form >= 0 for *_, form in found):
            wide = {f for f, o in outer.items() if o < 0}
        for i, tag in enumerate(page.tag):
            if tag in AROUND:
                while i >= 0:
                    if page.tag[i] == "form":
                        wide.add(i)
                    i = page.parent[i]
    for node, text, linked, form in found:
        while form >= 0 and form in wide:
            form = outer[form]
        if form < 0:
            page.blocks.append((node, text))
            page.size[node] += len(text)
            page.linked[node] += linked
    for f in wide:
        page.tag[f] = "div"


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Node features, and the kind of each node's edge to its parent: 0 plain, 1 opens an article, 2 opens furniture."""
    x, kind = np.zeros((len(page.tag), N_FEATURES)), np.zeros(len(page.tag), int)
    for i, (tag, hint) in enumerate(zip(page.tag, page.hint, strict=True)):
        if tag in TAGS:
            x[i, TAGS.index(tag)] = 1
        base = len(TAGS)
        if hint:
            for k, cue in enumerate(_CUES):
                x[i, base + k] = bool(cue.search(hint))
        n, linked = page.size[i], page.linked[i]
        x[i, base + len(CUES) :] = (
            1, tag in HEADINGS, min(n, 400) / 400, n > 80, min(linked / n, 1) if n else 0, n > 0 and linked > 0.6 * n, tag in ("td", "tr", "th", "tbody", "dl", "dd", "dt"), tag in ("ol", "figcaption"),
        )
        bad = tag in ("nav", "header", "footer", "aside", "form", "dialog") or bool(x[i, base : base + len(CUES) - 1].any())
        kind[i] = 2 if bad else 1 if tag in ("article", "main") else 0
    return x, kind


@dataclass
class TreeModel:
    weights: np.ndarray  # log potential of content against furniture
    edges: np.ndarray  # kind, parent state, child state


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    depth = np.zeros(len(parent), int)
    for i, p in enumerate(parent.tolist()):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(parent) else []


def sum_product(parent: np.ndarray, score: np.ndarray, edge: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(state) of every node and P(parent state, state) of every edge, exact on a forest.

    score: content log potential of each node; edge: log potentials (node, parent state, state)."""
    n = len(parent)
    node = np.stack([np.zeros(n), score], 1)
    up, inside = np.zeros((n, 2)), node.copy()
    for level in reversed(levels[1:]):  # upward: what a subtree says about its parent's state
        up[level] = np.logaddexp(edge[level, :, 0] + inside[level, 0, None], edge[level, :, 1] + inside[level, 1, None])
        np.add.at(inside, parent[level], up[level])
    belief, pair = inside.copy(), np.zeros((n, 2, 2))
    for level in levels[1:]:  # downward: what the rest of the page says about the state
        rest = belief[parent[level]] - up[level]
        joint = rest[:, :, None] + edge[level] + inside[level][:, None, :]
        belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint - np.logaddexp(belief[level][:, 0], belief[level][:, 1])[:, None, None]
        pair[level] = np.exp(joint)
    total = np.logaddexp(belief[:, 0], belief[:, 1])
    return np.exp(belief - total[:, None]), pair


def train(pages: list[tuple[Page, list[bool]]], steps: int = 250) -> TreeModel:
    """Maximum likelihood with exact marginals; all pages form one forest, every page weighs the same."""
    xs, kinds, parents, ys, weight, base = [], [], [], [], [], 0
    for page, labels in pages:
        x, kind = features(page)
        xs.append(x)
        kinds.append(kind)
        parents.append(np.array([p + base if p >= 0 else -1 for p in page.parent]))
        ys.append(np.array(labels, float))
        weight.append(np.full(len(labels), 1 / max(1, len(labels))))
        base += len(labels)
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((3, 2, 2)))
    if not xs:
        return model
    x, kind, parent, y, w = (np.concatenate(v) for v in (xs, kinds, parents, ys, weight))
    levels = _levels(parent)
    child = np.flatnonzero(parent >= 0)
    observed = np.zeros((len(parent), 2, 2))
    observed[child, y[parent[child]].astype(int), y[child].astype(int)] = 1
    m, v = np.zeros(N_FEATURES + 12), np.zeros(N_FEATURES + 12)
    for step in range(1, steps + 1):
        p, pair = sum_product(parent, x @ model.weights, model.edges[kind], levels)
        gw = x.T @ ((y - p[:, 1]) * w) / len(pages) - 2e-4 * model.weights
        ge = np.zeros((3, 2, 2))
        np.add.at(ge, kind[child], (observed - pair)[child] * w[child, None, None])
        g = np.concatenate([gw, (ge / len(pages) - 2e-4 * model.edges).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights, model.edges = model.weights + move[:N_FEATURES], model.edges + move[N_FEATURES:].reshape(3, 2, 2)
    return model


#: Labelled training pages: y marks content elements; everything below one is content unless an n element stands between.
LABELLED = (
    "<body><header><h1>Site</h1><nav><a href=1>Home</a><a href=2>News</a></nav></header><article y><h1>Title of the piece</h1><p>{long}</p><p>{long}</p></article><aside n><h3>More</h3><ul><li><a href=3>Other</a></ul></aside><footer>Imprint and terms</footer></body>",
    "<body><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=content y><h2>Head</h2><p>{long}</p><p>{short}</p><ul><li>{short}</li><li>{short}</li></ul><blockquote>{long}</blockquote></div><div class=sidebar><p>{short}</p></div><div class=footer><p>{short}</p></div></body>",
    "<body><div class='cookie-notice'><p>{short}</p></div><main y><h1>Head</h1><p>{long}</p><div class='ad' n><p>{short}</p></div><p>{long}</p></main><section class=comments><h3>Comments</h3><div class=comment><p>{long}</p></div><div class=comment><p>{short}</p></div></section></body>",
    "<body><nav><ul><li><a href=1>One</a></li></ul></nav><div class=ad>{short}</div><article y><h1>{short}</h1><p>{long}<p>{short}<table><tr><td>{short}</td><td>{short}</td></tr></table></article><div id=comments><article class=comment n><p>{long}</p></article></div><footer>{short}</footer></body>",
    "<body><article y><header><h1>{short}</h1></header><p>{long}</p><pre>{short}</pre><div class=share n><a href=1>Share</a></div><section class=comments n><p>{long}</p><p>{short}</p></section><figure><figcaption>{short}</figcaption></figure></article><aside class=related><p>{long}</p></aside><div class='newsletter'><p>{short}</p></div></body>",
    "<body><div class=banner>{short}</div><div id=main-content y><p>{long}</p><p>{long}</p><h2>{short}</h2><p>{short}</p><nav n><a href=1>Next</a></nav></div><div class=copyright>{short}</div><dialog class=popup><p>{long}</p></dialog></body>",
    "<body><header><p>{long}</p></header><main y><article><h1>{short}</h1><p>{long}</p><aside n><p>{long}</p></aside><p>{short}</p><div><p>{long}</p><div>{short}</div></div></article></main><footer><p>{long}</p></footer></body>",
    "<body><p y>{long}</p><div class=comment><p>{long}</p></div><aside><p>{long}</p></aside></body>",
    "<body><header y><h1>{short}</h1></header><p y>{long}</p><p y>{long}</p><div class=ads><p>{short}</p></div><p y>{short}</p></body>",
)


def labelled_pages() -> list[tuple[Page, list[bool]]]:
    """The written pages with short and long fillings; the y and n marks become states of the nodes (one for each)."""
    out = []
    for words in (3, 8):
        for source in LABELLED:
            text = source.replace("{short}", "word " * words).replace("{long}", "a longer run of text " * 4 * words)
            marked = re.sub(r"<(\w+)([^<>]*?) ([yn])>", r"<\1\2 role='mark-\3'>", text)
            page = parse(marked)
            states = [False]
            for i in range(1, len(page.tag)):
                mark = page.hint[i][-6:] if "mark-" in page.hint[i] else ""
                page.hint[i] = page.hint[i].replace("mark-y", "").replace("mark-n", "").strip()
                states.append(mark == "mark-y" or (states[page.parent[i]] and mark != "mark-n"))
            out.append((page, states))
    return out


def own_labels(page: Page) -> list[bool] | None:
    """States by the page's article or main element; None where it has none."""
    states, kind, found = [False], features(page)[1], False
    for i in range(1, len(page.tag)):
        opens = page.tag[i] in ("article", "main") and kind[i] != 2
        found |= opens
        states.append(kind[i] != 2 and (opens or states[page.parent[i]]))
    return states if found else None


def disguised(page: Page, hint: str) -> Page:
    """The page with its article and main elements turned into div elements."""
    opens = [t in ("article", "main") for t in page.tag]
    tags = ["div" if o else t for t, o in zip(page.tag, opens, strict=True)]
    hints = [hint if o else h for h, o in zip(page.hint, opens, strict=True)]
    return Page(page.parent, tags, hints, page.linked, page.size, page.blocks)


def fit(pages: DataFrame, max_training: int = MAX_TRAINING) -> TreeModel:
    """Train on the written pages and about `max_training` distinct pages of the table, drawn by a hash of the html."""
    drawn = pages.select("html").filter(hash_below("html", max_training, pages.count())).filter(F.length("html") <= MAX_PAGE_CHARS)
    rows = drawn.distinct().orderBy(F.xxhash64("html"), "html").limit(max_training).collect()  # max_training * MAX_PAGE_CHARS characters at most
    written, own = labelled_pages(), []
    for page in (parse(r.html) for r in rows if r.html):
        if states := own_labels(page):
            own += [(page, states), (disguised(page, ""), states), (disguised(page, "content"), states)]
    repeat = max(1, len(own) // (2 * len(written)))
    return train(written * repeat + own)


def extract(source: str | None, model: TreeModel) -> str:
    if not source:
        return ""
    page = parse(source)
    if not page.blocks:
        return ""
    x, kind = features(page)
    parent = np.array(page.parent)
    p, _ = sum_product(parent, x @ model.weights, model.edges[kind], _levels(parent))
    return "\n".join(text for node, text in page.blocks if p[node, 1] >= 0.5)


def extract_pages(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def one(source: str | None) -> tuple:
        text = extract(source, model)
        return text, len(text)

    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html").mapInArrow(per_row(["html"], schema, one, ["page_id", "url"]), "page_id long, url string, text string, n_chars long")
