"""Operator 4, main text of web pages by tree scoring.

The page becomes a tree of its block elements. Each paragraph earns points for its length and its commas and passes
them to its ancestors, whole to its parent, half to the next, less beyond; an element's score is its points times the
share of its text that is not in links. The element of the best score holds the article; an article or main element
around it is taken instead. Siblings stay with it: all that are not noise where no article or main element is marked, else those
that score a fifth as much or are prose. What stands in menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by element, role, class or
id, earns nothing and is left out, as are lists of links. A class or id counts as a whole name; one that only holds such a word
counts beside the main text, and not within or around it.

Blocks: character references are decoded, white space becomes one space, ends are trimmed; blocks are joined in page
order by an empty line. ``br`` is white space. Pages are read in one pass over their tags, so long pages and deep trees
take linear time and no recursion.

Defined results: null, empty and text-free pages give an empty text. Pages whose paragraphs are all short give the text
of the article or main element, or else all that is not left out; of elements of one score the first is taken. Very long
pages are read whole, in batches bounded by bytes. Repeated rows stay rows. An empty table gives an empty result. Only
the id, the url and the html are read, so clashing names (text, n_chars) do no harm.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+>|[^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Fixed lists.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul caption noscript template iframe object select button svg canvas audio video label legend optgroup option datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp noembed noframes".split())
TITLED = frozenset("title textarea".split())
LEFT_OUT = frozenset("head nav aside footer form dialog menu search noscript template iframe object select button svg canvas audio video fieldset label legend datalist optgroup option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist directory note status".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
TALK = frozenset("respond replies reply discussion feedback".split())
NOISE = frozenset(
    "nav navbar navigation menu menus sidebar side aside footer foot header masthead topbar banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs widget pagination pager toolbar search"
    " form alert skip outbrain taboola copyright".split()
)
#: Words that a name of comments or noise may have besides: "comment-list", "related-posts", "cookie-notice".
AFFIXES = frozenset(
    "list lists area section box thread wrapper wrap container block bar row column col inner outer item items link links button buttons icon icons top bottom left right site page global primary secondary"
    " user fb facebook post posts article articles story stories entry news author meta body text content title heading label mobile desktop sticky fixed slot unit zone message policy law media".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes: the same or a kindred element, up to the enclosing list or table.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th", "caption"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)), "option": (("option",), ("select", "datalist", "optgroup")),
}
#: Characters from which a paragraph earns points; ancestors that earn; shares a sibling needs.
LEAST, LEVELS, SIBLING = 25, 6, 0.2
#: Share of links in a list of links; share of the points that a main element has.
LINKS, MAIN = 0.6, 0.25
_COMMAS = re.compile("[,،、，;]")

#: WEAK: a name that only holds a word of a list, or one of TALK; it counts beside the main text, not in it or around it.
KEEP, WEAK, SOFT, HARD = 0, 1, 2, 3


def _named(value: str) -> int:
    """The kind that the names of a class or id give."""
    kind = KEEP
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        for listed, then in ((COMMENTS, HARD), (NOISE, SOFT)):
            if words & listed:
                kind = max(kind, then if words <= listed | COMMENTS | NOISE | AFFIXES or "disqus" in words else WEAK)
        if words & TALK:
            kind = max(kind, WEAK)
    return kind


def _kind(tag: str, attrs: str, in_article: bool, names: bool) -> tuple[int, bool]:
    """Whether an element is kept, perhaps left out, or left out; and whether it is marked as the main text."""
    out, marked = KEEP, tag in ("article", "main")
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return HARD, False
    if not attrs.strip(" />"):
        return out, marked
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if tag in ("html", "body"):
                continue
            named = _named(value) if names and tag != "main" and tag not in HEADINGS else KEEP
            if named == HARD:
                return HARD, False
            if tag != "article":
                out = max(out, named)
        elif name == "role":
            value = value.lower()
            if value in ROLES:
                return HARD, False
            marked |= value in ("main", "article")
        elif name == "itemprop":
            marked |= value.lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD, False
    return out, marked


class _Tree:
    """Block elements in page order (parents first), and the blocks of text that stand directly in them."""

    def __init__(self, page: str, names: bool = True):
        self.names = names
        self.tag, self.parent, self.kind, self.marked = ["#root"], [0], [KEEP], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(page)

    def _read(self, page: str) -> None:
        stack, open_ = [0], {"#root": 1}
        pieces: list[str] = []
        linked: list[str] = []
        links, article, at, n = 0, 0, 0, len(page)
        tag_, parent, kind, marked, blocks = self.tag, self.parent, self.kind, self.marked, self.blocks

        def flush() -> None:
            if pieces:
                text = " ".join(html_lib.unescape("".join(pieces)).split())
                if text:
                    inside = len(" ".join(html_lib.unescape(" ".join(linked)).split())) if linked else 0
                    blocks.append((stack[-1], text, min(inside, len(text))))
                pieces.clear()
                linked.clear()

        def pop() -> None:
            nonlocal article
            i = stack.pop()
            open_[tag_[i]] -= 1
            article -= marked[i]

        def close(names: tuple, stops: tuple) -> None:
            for k in range(len(stack) - 1, 0, -1):
                t = tag_[stack[k]]
                if t in stops:
                    return
                if t in names:
                    while len(stack) > k:
                        pop()
                    return

        def text(piece: str) -> None:
            if kind[stack[-1]] != HARD:
                pieces.append(piece)
                if links:
                    linked.append(piece)

        find = _TAG.search
        while at < n:
            m = find(page, at)
            if not m:
                text(page[at:])
                break
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK and open_.get(tag):
                    flush()
                    while tag_[stack[-1]] != tag:
                        pop()
                    pop()
                    links = 0
                elif tag in BLOCK:
                    flush()
                continue
            if tag in RAW or tag in TITLED:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = n
                pieces.append(" ")
                continue
            if tag == "a":
                links = 1
            elif tag == "br":
                text(" ")
            elif tag in BLOCK:
                flush()
                links = 0
                if tag_[stack[-1]] == "p":
                    pop()
                if open_.get("head") and tag not in ("head", "noscript", "template", "object"):
                    while open_.get("head"):
                        pop()
                if tag in HEADINGS and tag_[stack[-1]] in HEADINGS:
                    pop()
                if tag in CLOSES and any(open_.get(x) for x in CLOSES[tag][0]):
                    close(*CLOSES[tag])
                if tag in VOID:
                    continue
                if tag in ("html", "body") and open_.get(tag):
                    continue
                above = stack[-1]
                k, main = (HARD, False) if kind[above] == HARD else _kind(tag, m[3][:-1], article > 0, self.names)
                stack.append(len(tag_))
                tag_.append(tag)
                parent.append(above)
                kind.append(k)
                marked.append(main)
                open_[tag] = open_.get(tag, 0) + 1
                article += main
        flush()


def _sums(parent: list[int], own: list[float]) -> list[float]:
    """Each element's own value and those below it."""
    out = own[:]
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; if all of it stands in elements named as noise, the names do not count."""
    return (_main_text(page, True) or _main_text(page, False)) if page else ""


def _main_text(page: str, names: bool) -> str:
    t = _Tree(page, names)
    n = len(t.tag)
    if not t.blocks:
        return ""
    points, chars, linked, count, heads = ([0.0] * n for _ in range(5))
    for e, text, inside in t.blocks:
        chars[e] += len(text)
        linked[e] += inside
        count[e] += inside > 0
        if t.tag[e] == "h1":
            heads[e] += 1
        if len(text) >= LEAST:
            points[e] += (1 + len(_COMMAS.findall(text)) + len(text) / 100) * (1 - inside / len(text))
    below = {k: _sums(t.parent, v) for k, v in (("points", points), ("chars", chars), ("linked", linked), ("count", count), ("heads", heads))}
    total = below["points"][0]

    # Elements that are left out: by kind, unless one that only might be holds the main element of most points, or the
    # heading and most points of the page.
    main = max((i for i in range(n) if t.marked[i]), key=lambda i: (below["points"][i], -i), default=0)
    holds = set()
    if below["points"][main] >= MAIN * total:
        while main:
            holds.add(main)
            main = t.parent[main]
    def left_out(inside: list[bool] | None) -> list[bool]:
        gone = [False] * n
        for i in range(1, n):
            out = gone[t.parent[i]] or t.kind[i] == HARD
            if not out and t.kind[i] in (WEAK, SOFT):
                out = i not in holds and not (below["heads"][i] and below["points"][i] > 0.5 * total)
                if t.kind[i] == WEAK:
                    out = out and below["points"][i] <= MAIN * total and not (inside and inside[i])
            if not out and t.tag[i] in ("ul", "ol", "div", "section", "table", "dl") and below["count"][i] >= 2:
                out = below["linked"][i] > LINKS * below["chars"][i]
            if not out and t.tag[t.parent[i]] == "header" and t.tag[i] not in HEADINGS and t.tag[i] not in ("div", "section", "hgroup"):
                out = True  # of an article's own header only the headings
            gone[i] = out
        return gone

    gone = left_out(None)
    kept = [(e, x, inside) for e, x, inside in t.blocks if not gone[e] and t.tag[e] != "header"]
    if not kept:
        return ""

    # Paragraphs pass points up; the first ancestor is the one that holds the paragraph element.
    score = [0.0] * n
    for e, text, inside in kept:
        if len(text) < LEAST or t.tag[e] in HEADINGS:
            continue
        gain = (1 + len(_COMMAS.findall(text)) + len(text) / 100) * (1 - inside / len(text))
        up = t.parent[e] if t.tag[e] in ("p", "pre", "li", "dd", "dt", "td", "th", "blockquote") else e
        for level in range(LEVELS):
            score[up] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if up == 0:
                break
            up = t.parent[up]
    for i in range(n):
        if below["chars"][i]:
            score[i] *= 1 - below["linked"][i] / below["chars"][i]
    best = max(range(n), key=lambda i: (score[i], -i))
    if not score[best]:
        whole = [i for i in range(n) if t.marked[i] and not gone[i] and below["chars"][i]]
        best = max(whole, key=lambda i: (below["chars"][i], -i)) if whole else 0
    up, inner = best, None
    while up:  # the outermost article around it, else the innermost main element
        if t.marked[up]:
            inner = up if inner is None or t.tag[up] == "article" else inner
        up = t.parent[up]
    top = best if inner is None else inner
    while t.tag[top] in ("p", "li", "ul", "ol", "blockquote", "tr", "td", "tbody", "table", "dl", "dd"):
        top = t.parent[top]
    roots = {top}
    if top and t.tag[top] not in ("main", "body", "html"):
        floor = max(1.0, SIBLING * score[best]) if inner is not None else 0.0  # without mark-up all that is not noise stays
        for i in range(1, n):
            if t.parent[i] != t.parent[top] or i == top or gone[i]:
                continue
            size = below["chars"][i]
            prose = t.tag[i] == "p" and size > 80 and below["linked"][i] < 0.25 * size
            heading = t.tag[i] in HEADINGS and i < top
            if score[i] >= floor or prose or heading:
                roots.add(i)
    chosen = [False] * n
    for i in range(n):
        chosen[i] = i in roots or bool(i) and chosen[t.parent[i]]
    if WEAK in t.kind:
        gone = left_out(chosen)
    return "\n\n".join(x for e, x, _ in t.blocks if chosen[e] and not gone[e] and t.tag[e] != "header")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    import pyarrow as pa

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(d.dtypes)
    return bounded_batches(d, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
