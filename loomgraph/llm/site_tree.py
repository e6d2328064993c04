"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree. An element node of the tree
is a path of tags and class names; its style nodes are the sequences of child
elements that pages have there, and its content features the texts that pages
have there. The presentation importance of a node is the normalised entropy of
its style nodes, its content importance one less the mean normalised entropy of
its features: a text that every page repeats is worth nothing. The importance of
a branch combines its own with that of its children, weighted by how often each
is there. Only counts by (host, node, style or feature) are shuffled, summed on
the map side first, so a host with a third of all pages is no large group.

Branches of low importance are removed from the pages of their host. A host may
have too few pages to tell, or menus that differ from page to page, so the roles
that HTML itself gives (nav, footer, form) and class names that are nothing but a
role (``sidebar``, ``ad-slot``, not ``share-price-analysis``) count as of no
importance. Within what a page marks as its article unimportant branches go too,
but not the article itself nor its plain paragraphs, lists and tables: copies of an
article are articles. Names that may be a topic as well (``legal``, ``social``) are
only a prior there: such a branch goes if its host's tree finds it half
unimportant (``PRIOR``). Exact copies of a page count as one, and an article of
which only headings would be left stays whole.

The model is a table of unimportant nodes by host, written in the shared folder;
Spark broadcasts it if its size is below the session's threshold, and else joins
by host with its own handling of skew.

Defined cases: a null html is empty and has an empty text. A null or malformed
url has the empty host. Unclosed, stray and overlapping tags are read as
browsers do in the common cases. Very long and very deep pages are read in time in
proportion to their length, without recursion. Nodes of equal importance are judged
alike. Repeated rows give repeated rows; extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages that must have a node before it can be judged, and the least importance.
LEAST_PAGES, LEAST_IMPORTANCE = 8, 0.25
#: The least importance of branches whose name may be a role or a topic.
PRIOR = 0.6
#: Weight of a node's own presentation against that of its children's.
OWN = 0.3

# Fixed values of HTML: elements without end tag, without markup inside, that end
# a paragraph, and that are no part of a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend".split())
NO_TEXT = frozenset("script style textarea title xmp iframe noembed noframes head template noscript svg math canvas object audio video select button input datalist".split())
#: Roles without importance: elements, ARIA roles, and words of class and id.
NO_ROLE = frozenset("nav footer aside form menu dialog search".split())
NO_ARIA = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert tablist".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion reviews".split())
ADS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsense adbox adslot".split())
OTHER = frozenset(
    "nav navbar navigation menu menus submenu header masthead topbar footer foot bottombar sidebar sidebars side aside rail widget widgets banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager toolbar copyright legal skip search form paywall teaser toc".split()
)
NO_NAME = COMMENTS | ADS | OTHER
#: Of these, words that may name a topic, too; and words that say only where or how.
TOPICS = frozenset("legal social notice notices alert notification notifications copyright share sharing search header teaser banner aside side rail foot register form related recommended recommendations toc menu menus reviews discussion cookie cookies consent".split())
NEUTRAL = frozenset("box block wrapper wrap container list item section bar link links button buttons area inner outer row col panel module slot unit zone top bottom left right sticky fixed main global site page js mobile desktop".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = HEADINGS | frozenset("p b i em strong code mark span a".split())
#: Elements that, without class and id, are an article's own text.
PLAIN = HEADINGS | frozenset("p b i em strong code mark span a u s small sub sup q cite abbr time kbd var samp pre blockquote ul ol li dl dt dd table caption tbody thead tfoot tr td th".split())
#: What ends an open element of the same group, and where the search stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
SCOPE = frozenset("table td th html button object template caption".split())
_IN_HEAD = RAW | VOID | {"head", "html", "template", "noscript"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


@lru_cache(maxsize=1 << 14)
def names_in(raw: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _NAME.findall(raw))


@lru_cache(maxsize=1 << 14)
def role_in(raw: str) -> str:
    """What a class and an id say: ``remark`` (comments, adverts), ``role``, or
    ``topic`` where it may be one as well; empty if no name is made of role words
    and neutral ones alone."""
    found = ""
    for name in raw.split():
        words = {w.lower() for w in _NAME.findall(name)} - NEUTRAL
        if not words or not words <= NO_NAME:
            continue
        if words & TOPICS == words and len(words) == 1:
            found = found or "topic"
        elif words & (COMMENTS | ADS):
            return "remark"
        else:
            found = "role"
    return found


class Node:
    """An element. ``open_p``, ``open_head`` and ``open_raw`` are the nearest open
    paragraph in scope, head, and template or such within that head."""

    __slots__ = ("tag", "attributes", "children", "parent", "path", "open_p", "open_head", "open_raw", "holds")

    def __init__(self, tag: str, attributes: dict[str, str], parent: "Node | None"):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.path, self.holds = 0, False
        up = parent
        self.open_p = self if tag == "p" else None if up is None or tag in SCOPE else up.open_p
        self.open_head = self if tag == "head" else up.open_head if up is not None else None
        self.open_raw = self if tag in ("template", "noscript", "svg") else None if up is None or tag == "head" else up.open_raw

    def _raw(self) -> str:
        a = self.attributes
        return f"{a.get('class', '')} {a.get('id', '')}" if a else ""

    def names(self) -> frozenset[str]:
        return names_in(self._raw()) if self.attributes else frozenset()

    def role(self) -> str:
        return role_in(self._raw()) if self.attributes else ""


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)
    return out


def parse(text: str) -> Node:
    """The tree of a page; children are nodes and decoded strings."""
    root = top = Node("#", {}, None)
    opened: Counter = Counter()  # open elements by tag
    at = 0

    def up_to(tags, stop) -> Node | None:
        if not any(opened[t] for t in tags):
            return None
        n = top
        while n.parent is not None:
            if n.tag in tags:
                return n
            if n.tag in stop:
                return None
            n = n.parent
        return None

    def close(n: Node) -> None:
        nonlocal top
        while top is not n.parent:
            opened[top.tag] -= 1
            top = top.parent

    def say(s: str) -> None:
        if s:
            top.children.append(entities.unescape(s) if "&" in s else s)

    while True:
        m = _TAG.search(text, at)
        if m is None:
            say(text[at:])
            return root
        say(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            if tag == "br":
                top.children.append(Node("br", {}, top))
            elif tag == "p" and top.open_p is None:
                top.children.append(Node("p", {}, top))
            elif tag not in ("html", "body"):
                n = up_to({tag}, () if tag == "table" else {"table", "td", "th"} - {tag} if tag not in BLOCK else {"table"} - {tag})
                if n is not None:
                    close(n)
            continue
        tag = m[2] if m[2] is not None else m[4]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag, raw = tag.lower(), m[3] if m[2] is not None else m[5]
        if tag in ("html", "body") and (same := up_to({tag}, ())) is not None:
            for k, v in _attributes(raw).items():
                same.attributes.setdefault(k, v)
            continue
        if top.open_head is not None and (tag == "body" or tag not in _IN_HEAD and top.open_raw is None):
            close(top.open_head)
        if tag in CLOSES_P and top.open_p is not None:
            close(top.open_p)
        if tag in SIBLINGS:
            n = up_to(*SIBLINGS[tag])
            if n is not None:
                close(n)
        if tag in HEADINGS and top.tag in HEADINGS:
            close(top)
        node = Node(tag, _attributes(raw), top)
        top.children.append(node)
        if tag in RAW:
            end = _ENDS[tag].search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not (raw and raw.endswith("/") and tag not in BLOCK):
            top = node
            opened[tag] += 1


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def number(root: Node) -> list[Node]:
    """All element nodes in page order, each with the hash of its path (the tags and
    class names from the root, without digits) and whether it holds an article."""
    out, todo, known = [], [root], {}
    while todo:
        n = todo.pop()
        if n.parent is not None:
            key = (n.parent.path, n.tag, n.names())
            path = known.get(key)
            if path is None:
                path = known[key] = _hash(n.parent.path, n.tag, tuple(sorted(key[2])))
            n.path = path
            out.append(n)
        if n.tag not in NO_TEXT:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    for n in reversed(out):
        if n.holds or _is_article(n):
            n.parent.holds = True
    return out


def _is_article(n: Node) -> bool:
    if n.tag in ("article", "main") and n.role() != "remark":
        return True
    a = n.attributes
    return bool(a) and (a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody")


def without_role(n: Node, in_article: bool) -> bool:
    """Whether HTML or the author's names give this branch no importance."""
    a = n.attributes
    if n.tag in NO_TEXT:
        return True
    if a and ("hidden" in a or a.get("aria-hidden") == "true" or "style" in a and _HIDDEN.search(a["style"])):
        return True
    if n.tag in ("html", "body"):
        return False
    role = n.role()
    if n.tag in ("article", "main"):
        return role == "remark"
    if n.tag == "header":
        return not (in_article and _has_heading(n)) and not n.holds
    if n.tag in NO_ROLE or a.get("role") in NO_ARIA:
        return not n.holds
    if role == "remark" or role and n.tag not in INLINE:
        return not n.holds and not (in_article and role == "topic")
    return False


def _has_heading(n: Node) -> bool:
    todo = [n]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.tag in ("h1", "h2"):
                    return True
                if c.tag in ("div", "hgroup"):
                    todo.append(c)
    return False


def main_text(root: Node, noise: frozenset[int]) -> str:
    """The text of a numbered page without unimportant branches."""
    found = _blocks(root, noise)
    return "\n".join(found or (_blocks(root, frozenset()) if noise else []))


def _blocks(root: Node, noise: frozenset[int]) -> list[str]:
    starts = _tops(root)
    out: list[str] = []
    for start in starts or [root]:
        lines, more = _walk(start, bool(starts), noise)
        if starts and noise and not more:
            lines, _ = _walk(start, True, frozenset())
        out += lines
    return out


def _walk(start: Node, inside: bool, noise: frozenset[int]) -> tuple[list[str], bool]:
    """The lines of a branch, and whether there is text that is no heading."""
    out: list[str] = []
    held: list[str] = []
    more = False

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    # (node, number of its next child, whether in an article, whether in a heading)
    todo = [(start, 0, inside, False)]
    while todo:
        n, k, in_article, titled = todo.pop()
        if k == 0 and n.tag in BLOCK:
            flush()
        moved = False
        for j in range(k, len(n.children)):
            c = n.children[j]
            if isinstance(c, str):
                held.append(c)
                more = more or not titled and bool(c.strip())
            elif c.tag == "br":
                held.append(" ")
            elif without_role(c, in_article) or _unimportant(c, in_article, noise):
                if c.tag in BLOCK:
                    flush()
            elif c.tag not in VOID:
                todo += [(n, j + 1, in_article, titled), (c, 0, in_article or _is_article(c), titled or c.tag in HEADINGS)]
                moved = True
                break
            elif c.tag in BLOCK:
                flush()
        if not moved and n.tag in BLOCK:
            flush()
    flush()
    return out, more


def _unimportant(n: Node, in_article: bool, noise: frozenset[int]) -> bool:
    """Whether the tree removes a branch; ``~path`` stands for a branch that is only
    less important than ``PRIOR``."""
    if not noise or _is_article(n):
        return False
    if n.path in noise:
        return not (in_article and n.tag in PLAIN and not n.names())
    return ~n.path in noise and n.tag not in INLINE and n.role() == "topic" and not n.holds


def _tops(root: Node) -> list[Node]:
    """The outermost articles that hold text; the innermost container of all of
    them where a main element holds them."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if _is_article(n) and _text_in(n):
            inner = _tops_below(n) if n.tag == "main" or n.attributes.get("role") == "main" else []
            out += inner or [n]
            continue
        if n.tag in NO_TEXT or n.parent is not None and _never(n):
            continue
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def _tops_below(main: Node) -> list[Node]:
    out, todo = [], [c for c in reversed(main.children) if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        if _is_article(n) and _text_in(n):
            out.append(n)
        elif n.tag not in NO_TEXT and not _never(n):
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def _never(n: Node) -> bool:
    return n.role() == "remark" or n.tag in ("aside", "nav", "footer") or "hidden" in n.attributes


def _text_in(n: Node) -> bool:
    todo = [n]
    while todo:
        x = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                if not c.isspace():
                    return True
            elif c.tag not in NO_TEXT:
                todo.append(c)
    return False


# -- the style tree -----------------------------------------------------------


def facts(root: Node) -> list[tuple[int, int, int, int]]:
    """What a page adds to its host's tree: (node, parent, kind, value), kind 0
    for a style and 1 for a content feature. A node that a page has more than
    once counts once for each style and feature."""
    found: set[tuple[int, int, int, int]] = set()
    for n in number(root):
        parent = n.parent.path if n.parent is not None else 0
        inner = [c for c in n.children if isinstance(c, Node) and c.tag not in ("br", "script", "style")]
        found.add((n.path, parent, 0, _hash(*(c.tag for c in inner))))
        if n.tag not in NO_TEXT:
            own = " ".join("".join(c if isinstance(c, str) else " " for c in n.children).split())
            if own:
                found.add((n.path, parent, 1, _hash(own)))
    return sorted(found)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, parent, pages, importance) of all nodes of all hosts' trees."""
    common.bound_batches(pages.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*counts)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            made = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array(list(counts.values()), pa.float64())], names=["host", "node", "parent", "kind", "value", "n"])
            counts.clear()
            return made

        for batch in batches:
            for of, text, copies in zip(batch.column(1).to_pylist(), common.texts_of(batch, "html"), batch.column(2).to_pylist()):
                for fact in facts(parse(text)):
                    key = (of, *fact)
                    counts[key] = counts.get(key, 0) + 1 / (copies or 1)
            if len(counts) > 200_000:
                yield out()
        yield out()

    # exact copies of a page in a host share a weight of one
    own = pages.select("html", host(F.col("url")).alias("host"), F.xxhash64("html").alias("of"))
    copies = common.stash(own.groupBy("host", "of").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    found = own.join(copies, ["host", "of"], "left").select("html", "host", "copies").mapInArrow(common.lean(parsed), "host string, node long, parent long, kind int, value long, n double")
    cells = found.groupBy("host", "node", "parent", "kind", "value").agg(F.round(F.sum("n"), 6).alias("n"))
    n, plogp = F.col("n"), F.col("n") * F.ln("n")
    style, feature = F.col("kind") == 0, F.col("kind") == 1
    nodes = cells.groupBy("host", "node", "parent").agg(
        F.round(F.sum(F.when(style, n))).cast("long").alias("pages"),
        F.coalesce(F.sum(F.when(style, plogp)), F.lit(0.0)).alias("style"),
        F.coalesce(F.sum(F.when(feature, n)), F.lit(0.0)).alias("texts"),
        F.coalesce(F.sum(F.when(feature, plogp)), F.lit(0.0)).alias("repeats"),
    )
    m = F.col("pages")
    spread = F.when(m > 1, (F.ln(m) - F.col("style") / m) / F.ln(m)).otherwise(1.0)
    # each occurrence of a feature that k of m pages have weighs 1 - ln k / ln m
    content = F.when(F.col("texts") == 0, F.lit(None)).when(m > 1, F.greatest(F.lit(0.0), 1 - F.col("repeats") / F.col("texts") / F.ln(m))).otherwise(1.0)
    return nodes.select("host", "node", "parent", "pages", F.round(spread, 9).alias("presentation"), F.round(content, 9).alias("content"))


def importance(nodes: list[tuple]) -> dict[int, float]:
    """Importance of each branch of one host, by node. nodes: (node, parent, pages,
    presentation, content or null, whether it has children that few pages have).
    Nothing is known of such children, nor of a node without text and children:
    their branch is of full importance."""
    below: dict[int, list] = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)
    order, todo = [], [n for n in nodes if n[1] == 0]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += below.get(n[0], [])
    out: dict[int, float] = {}
    for node, _, pages, presentation, content, rare in reversed(order):
        parts = [(c[2], out[c[0]]) for c in below.get(node, [])] + ([(pages, content)] if content is not None else [])
        if rare or not parts:
            out[node] = 1.0
            continue
        inner = sum(w * x for w, x in parts) / sum(w for w, _ in parts)
        out[node] = (1 - OWN) * inner + OWN * presentation if below.get(node) else inner
    return out


def noisy(nodes: list[tuple], least_pages: int, least: float) -> list[int]:
    """The nodes that are less important than ``least``, as is all below them; and
    as ``~node`` those less important than ``PRIOR``."""
    worth = importance(nodes)
    parent = {n[0]: n[1] for n in nodes}
    kept = {n[0] for n in nodes if n[2] < least_pages or worth.get(n[0], 1.0) >= least}
    for node in list(kept):
        while (node := parent.get(node, 0)) and node not in kept:
            kept.add(node)
    doubtful = [~n[0] for n in nodes if n[0] in kept and n[2] >= least_pages and worth.get(n[0], 1.0) < max(least, PRIOR)]
    return sorted([n[0] for n in nodes if n[0] not in kept] + doubtful)


def noise(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, noise): the nodes of each host whose branch is unimportant."""

    def of_host(key, rows):
        import pandas as pd

        nodes = [(int(r.node), int(r.parent), int(r.pages), float(r.presentation), None if pd.isna(r.content) else float(r.content), bool(r.rare)) for r in rows.itertuples()]
        low = noisy(nodes, least_pages, least)
        return pd.DataFrame({"host": pd.Series([key[0]] if low else [], dtype=object), "noise": pd.Series([low] if low else [], dtype=object)})

    # a node that few pages have becomes a mark of its parent, so that the nodes of
    # a host are those of its templates, whatever the number of its pages
    rare = F.col("pages") < max(2, least_pages // 4)
    own = lambda c: F.max(F.when(~rare, F.col(c))).alias(c)
    marked = style_tree(pages).groupBy("host", F.when(rare, F.col("parent")).otherwise(F.col("node")).alias("node")).agg(*(own(c).alias(f"_{c}") for c in ("parent", "pages", "presentation", "content")), F.max(rare).alias("rare"))
    tree = marked.filter("_pages is not null").select("host", "node", *(F.col(f"_{c}").alias(c) for c in ("parent", "pages", "presentation", "content")), "rare")
    return tree.groupBy("host").applyInPandas(of_host, "host string, noise array<bigint>")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) by page."""
    common.bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    model = common.stash(noise(pages, least_pages, least))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, low in zip(common.texts_of(batch, "html"), batch.column(3).to_pylist()):
                root = parse(text)
                number(root)
                texts.append(main_text(root, frozenset(low or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return rows.join(model, "host", "left").select("page_id", "url", "html", "noise").mapInArrow(common.lean(read), "page_id long, url string, text string, n_chars long")
