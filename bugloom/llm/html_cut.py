"""Main text of web pages by a minimum cut through their blocks.

A page is read into blocks of text with their open elements. A linear classifier over structure,
names and wording gives each block a leaning; its size is the block's capacity to the content
side or to the boilerplate side. Neighbouring blocks, and the next block below the same parent,
are tied by capacities that fall with their distance in the tree. The minimum cut labels all
blocks of the page together: a weakly leaning block goes with its surroundings. Blocks whose own
capacity outweighs all their ties are settled first, which leaves the minimum as it is; the rest
is cut by augmenting paths.
"""

import heapq
import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bugloom.llm.common import in_runs

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
# Dropped to their end tags; without one, what follows is the page's own text.
EMBEDDED_TAGS = frozenset(["svg", "object", "canvas", "audio", "video"])
SELF_CLOSING_TAGS = frozenset(["svg", "math"])
DROPPED_TAGS = frozenset(["button", "select", "option", "head"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# What an opening tag closes, up to the nearest of its containers.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
# Names in classes, ids and roles that mark parts of a page.
COMMENT_NAMES = frozenset(
    "comment comments commentlist reply replies respond disqus".split()
)
BOILERPLATE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion "
    "banner navigation nav navbar menu menubar breadcrumb breadcrumbs sidebar aside footer copyright "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget pagination pager "
    "toolbar search complementary contentinfo dialog alertdialog tooltip skip hidden".split()
)
PAGE_TOP_NAMES = frozenset(["header", "masthead", "topbar"])
CONTENT_NAMES = frozenset(
    "article content post entry story main body text page document prose".split()
)
# Words after a name that only say what holds it.
CONTAINER_WORDS = frozenset(
    "area articles bar block body bottom box buttons card cards col column container content entry "
    "fluid form group heading holder inner item items layer left link links list main meta module "
    "news outer page panel placeholder posts primary rail region right row section secondary slot "
    "stories tags text thread title top unit widgets wrap wrapper zone".split()
)
# Names after these are those of other elements, or styles.
STATE_WORDS = frozenset(["has", "with", "no", "not", "without", "is", "js", "overflow", "when"])
BOILERPLATE_TAGS = frozenset(["nav", "footer", "aside", "menu", "dialog"])

# Weights of the classifier: positive ones speak for content.
W_BASE, W_ARTICLE, W_MAIN, W_CONTENT_NAME = 0.2, 4.0, 3.0, 1.0
W_PARAGRAPH, W_HEADING, W_SENTENCE, W_LENGTH, W_LINKS = 1.0, 0.5, 0.7, 1.5, -4.0
W_BOILERPLATE_TAG, W_BOILERPLATE_NAME, W_DROPPED, W_PAGE_TOP = -12.0, -10.0, -20.0, -8.0
W_FORM, W_WEAK_NAME = -12.0, -3.0
W_PHRASE = -2.0
# Capacities of ties between blocks.
TIE_ADJACENT, TIE_SIBLING = 1.0, 0.5
# An element wraps the page if it holds this share of all text, and the prose outside is at most
# this share of the prose inside.
WRAPPER_TEXT, WRAPPER_OUTSIDE = 0.5, 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_EMBEDDED_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in EMBEDDED_TAGS}
_ATTRIBUTE = re.compile(
    r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+"
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_PHRASE = re.compile(
    r"^\W*(?:©|copyright\b|all rights reserved|we use cookies|accept (?:all )?cookies|advertisement\b"
    r"|subscribe to|sign up for|share this|log in|skip to)", re.I
)


@dataclass(eq=False)
class Element:
    tag: str
    parent: "Element | None"
    depth: int
    in_article: bool
    link: bool
    content: float = 0.0  # the strongest sign for content, of its own and its ancestors'
    against: float = 0.0  # its own sign against content that always counts
    doubtful: float = 0.0  # its own sign that does not count if it wraps the page
    comments: bool = False
    leaning: float = 0.0  # of all blocks inside, once the page is read
    size: int = 0  # characters inside
    prose: int = 0  # those of prose, without links, outside of doubtful elements further inside
    paragraphs: int = 0
    landmark: bool = False  # a headline or an article is inside
    main: bool = False


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters inside links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)  # parents come first


def _name_sign(name: str) -> tuple[set[str], set[str]]:
    """Words of one class, id or role that name the element, and those that may."""
    parts = [w.lower() for w in _WORD.findall(name)]
    if not parts or parts[0] in STATE_WORDS:
        return set(), set()
    cut = len(parts)
    while cut > 1 and (parts[cut - 1] in CONTAINER_WORDS or parts[cut - 1].isdigit()):
        cut -= 1
    if cut > 1 and parts[cut - 2] in STATE_WORDS:
        return set(), set()
    # What is cut off still speaks for content, as in "post-content".
    return {parts[cut - 1]}, set(parts)


def _attribute_signs(attrs: str) -> tuple[set[str], set[str], bool]:
    """Names of an element, words that may be names, and whether it is hidden."""
    names, words, unseen = set(), set(), False
    for key, *values in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            for name in value.split():
                own, may = _name_sign(name)
                names |= own
                words |= may
        elif key == "hidden":
            unseen = unseen or value.lower() != "until-found"
        elif key == "aria-hidden":
            unseen = unseen or value.strip().lower() == "true"
        elif key == "style":
            unseen = unseen or _UNSEEN.search(value) is not None
    return names, words, unseen


_SIGNS: dict[str, tuple[set[str], set[str], bool]] = {}


def _remembered_signs(attrs: str) -> tuple[set[str], set[str], bool]:
    """The same, for short attributes from a bounded memory."""
    if len(attrs) > 200:
        return _attribute_signs(attrs)
    found = _SIGNS.get(attrs)
    if found is None:
        if len(_SIGNS) >= 4096:
            _SIGNS.clear()
        found = _SIGNS[attrs] = _attribute_signs(attrs)
    return found


def _open(tag: str, attrs: str, parent: Element | None) -> Element:
    e = Element(
        tag, parent, parent.depth + 1 if parent else 0, bool(parent and parent.in_article),
        tag == "a" or bool(parent and parent.link), parent.content if parent else 0.0,
    )
    outside = not e.in_article
    if tag == "article":
        e.content, e.in_article, e.landmark = max(e.content, W_ARTICLE), True, True
    elif tag == "main":
        e.content, e.main = max(e.content, W_MAIN), True
    elif tag == "h1":
        e.landmark = True
    elif tag in BOILERPLATE_TAGS:
        e.against = W_BOILERPLATE_TAG
    elif tag in DROPPED_TAGS:
        e.against = W_DROPPED
    elif tag == "header" and outside:
        e.against = W_PAGE_TOP
    elif tag == "form":
        e.doubtful = W_FORM
    if attrs and not attrs.isspace() and tag not in ("html", "body", "a"):
        names, words, unseen = _remembered_signs(attrs)
        if names & BOILERPLATE_NAMES and tag not in ("article", "main"):
            e.doubtful = min(e.doubtful, W_BOILERPLATE_NAME)
            e.comments = bool(names & COMMENT_NAMES)
        elif outside and names & PAGE_TOP_NAMES:
            e.doubtful = min(e.doubtful, W_PAGE_TOP)
        elif words & BOILERPLATE_NAMES and tag not in ("article", "main"):
            e.doubtful = min(e.doubtful, W_WEAK_NAME)
        elif words & CONTENT_NAMES:
            e.content = max(e.content, W_CONTENT_NAME)
        if unseen:
            e.against = W_DROPPED
    return e


def _unclosed(m: re.Match) -> bool:
    """A comment or an element without markup inside that runs to the end of the page."""
    token = m[0]
    if m["raw"]:
        return not token.rstrip("> \t\n\r\f").lower().endswith("</" + m["raw"].lower())
    return token.startswith("<!--") and not token.endswith(("-->", "--!>"))


def read_page(html: str) -> Page:
    """Blocks of text in page order; white space is single, references are decoded."""
    page = Page()
    root = Element("", None, 0, False, False)
    page.elements.append(root)
    now, holder, parts, linked, at = root, root, [], 0, 0
    counts: dict[str, int] = {}  # open elements by tag
    endless: set[str] = set()  # embedded elements without an end tag from here on

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append(Block(text, holder, linked))
            parts, linked = [], 0

    def add(piece: str):
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if now.link:
                linked += len(piece) - piece.count(" ")

    def close(tags, containers):
        """Leave the nearest open one of these tags, if no container is before it."""
        nonlocal now
        if not any(counts.get(t) for t in tags):
            return
        e = now
        while e.parent is not None and e.tag not in containers:
            if e.tag in tags:
                while now is not e.parent:
                    counts[now.tag] -= 1
                    now = now.parent
                return
            e = e.parent

    # Behind the last ">" there are no tags, and no search for one's end runs into nothing.
    last = html.rfind(">") + 1
    while m := _TOKEN.search(html, at, last):
        add(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if _unclosed(m):
                at = len(html)
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if not m["close"]:
            if tag in SELF_CLOSING_TAGS and m["attrs"].endswith("/"):
                continue
            if tag in EMBEDDED_TAGS:
                end = None if tag in endless else _EMBEDDED_ENDS[tag].search(html, at, last)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                continue
        is_block = tag in BLOCK_TAGS or tag in DROPPED_TAGS
        if is_block:
            flush()
        if m["close"]:
            close((tag,), () if is_block else BLOCK_TAGS)
        elif tag not in VOID_TAGS:
            if is_block:
                close(("p",), ("table", "td", "th", "button", "li", "blockquote"))
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif tag == "body":
                close(("head",), ())
            now = _open(tag, m["attrs"], now)
            page.elements.append(now)
            counts[tag] = counts.get(tag, 0) + 1
        if is_block:
            holder = now
    add(html[at:].partition("<!--")[0])
    flush()
    _lean(page)
    return page


def _is_prose(block: Block) -> bool:
    text = block.text
    reads = block.element.tag == "p" or text[-1] in ".!?…。" or len(text) >= 80
    return reads and not _PHRASE.match(text)


def _wrappers(page: Page) -> set[Element]:
    """Doubtful elements that wrap the page, whose doubt says nothing of what is inside."""
    doubted = [e for e in page.elements if e.doubtful]
    if not doubted:
        return set()
    for block in page.blocks:
        e = block.element
        e.size += len(block.text)
        if _is_prose(block):
            e.prose += max(0, len(block.text) - block.linked)
            e.paragraphs += 1
    for e in reversed(page.elements[1:]):
        up = e.parent
        up.size += e.size
        up.main |= e.main
        if not e.against and not e.doubtful:
            up.prose += e.prose
            up.paragraphs += e.paragraphs
            up.landmark |= e.landmark
    # Doubtful elements by the nearest one around them; below a sign that always counts, none.
    around: dict[Element, Element | None] = {page.elements[0]: page.elements[0]}
    inside: dict[Element, list[Element]] = {page.elements[0]: []}
    holder: dict[Element, Element] = {}
    for e in page.elements[1:]:
        above = around[e.parent]
        if above is None or e.against:
            around[e] = None
        elif e.doubtful:
            inside[above].append(e)
            inside[e], around[e], holder[e] = [], e, above
        else:
            around[e] = above
    root = page.elements[0]
    found, outside, order = set(), root.prose, 0
    heap: list[tuple[bool, int, int, Element]] = []

    def offer(above: Element):
        nonlocal order
        for e in inside[above]:
            heapq.heappush(heap, (not e.main, -e.prose, order, e))
            order += 1

    offer(root)
    while heap:
        _, _, _, e = heapq.heappop(heap)
        wraps = e.main or (
            not e.comments and e.size > WRAPPER_TEXT * root.size
            and outside <= WRAPPER_OUTSIDE * e.prose and (e.landmark or e.paragraphs > 1)
        )
        # A wrapper may hold another one, in which all of its prose is.
        if wraps or (not e.comments and e.prose == 0 and e.size > WRAPPER_TEXT * root.size):
            offer(e)
        if wraps:
            outside += e.prose
            while e is not root and e not in found:
                found.add(e)
                e = holder[e]
    return found


def _lean(page: Page) -> None:
    """Set what the open elements say of the blocks inside them."""
    wrappers = _wrappers(page)
    against: dict[Element, float] = {}
    for e in page.elements:
        above = against[e.parent] if e.parent else 0.0
        against[e] = min(above, e.against, 0.0 if e in wrappers else e.doubtful)
        e.leaning = e.content + against[e]


def leaning(block: Block) -> float:
    """How much a block looks like content (above 0) or boilerplate."""
    text, e = block.text, block.element
    w = W_BASE + e.leaning + W_LENGTH * min(len(text), 400) / 400
    if e.tag == "p":
        w += W_PARAGRAPH
    elif e.tag in HEADINGS:
        w += W_HEADING
    if text[-1] in ".!?…。" and " " in text:
        w += W_SENTENCE
    w += W_LINKS * min(1.0, block.linked / max(1, len(text) - text.count(" ")))
    return w + W_PHRASE if _PHRASE.match(text) else w


def tree_distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in the page, and each block with the next one below the same parent."""
    out, last = [], {}
    for k, block in enumerate(found):
        if k:
            near = tree_distance(found[k - 1].element, block.element)
            out.append((k - 1, k, TIE_ADJACENT * 2 / (2 + near)))
        parent = id(block.element.parent)
        before = last.get(parent)
        if before is not None and before < k - 1:
            out.append((before, k, TIE_SIBLING))
        last[parent] = k
    return out


def minimum_cut(weights: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the weights labelled against plus the edges cut; ties go to False.

    Node k costs max(0, weights[k]) if it is False and max(0, -weights[k]) if it is True.
    """
    n = len(weights)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    own, label, queue = list(weights), [None] * n, deque(range(n))
    while queue:
        # A node that outweighs all its open ties keeps its side in some minimum cut; its ties
        # then pull at the neighbours.
        k = queue.popleft()
        if label[k] is not None:
            continue
        pull = sum(near[k].values())
        if own[k] > pull or own[k] <= -pull:
            label[k] = own[k] > pull
            for j, c in near[k].items():
                own[j] += c if label[k] else -c
                del near[j][k]
                queue.append(j)
            near[k] = {}
    for k in range(n):
        if label[k] is None:
            # What is left falls apart into pieces that are cut each by itself.
            piece, queue = {k: None}, deque([k])
            while queue:
                for j in near[queue.popleft()]:
                    if j not in piece:
                        piece[j] = None
                        queue.append(j)
            for j, side in zip(piece, _augment(list(piece), own, near)):
                label[j] = side
    return label


def _augment(free: list[int], own: list[float], near: list[dict]) -> list[bool]:
    """The minimum cut by shortest augmenting paths from content (-1) to boilerplate (-2)."""
    residual: dict[int, dict[int, float]] = {-1: {}, -2: {}}
    for k in free:
        residual[k] = dict(near[k])
    for k in free:
        if own[k] > 0:
            residual[-1][k], residual[k][-1] = own[k], 0.0
        elif own[k] < 0:
            residual[k][-2], residual[-2][k] = -own[k], 0.0

    def reach() -> dict[int, int]:
        before, queue = {-1: -1}, deque([-1])
        while queue:
            a = queue.popleft()
            for b, c in residual[a].items():
                if c > 1e-12 and b not in before:
                    before[b] = a
                    if b == -2:
                        return before
                    queue.append(b)
        return before

    while True:
        before = reach()
        if -2 not in before:
            return [k in before for k in free]
        path, b = [], -2
        while b != -1:
            path.append((before[b], b))
            b = before[b]
        flow = min(residual[a][b] for a, b in path)
        for a, b in path:
            residual[a][b] -= flow
            residual[b][a] = residual[b].get(a, 0.0) + flow


def main_text(html: str | None) -> str:
    """The blocks labelled as content, one per line; empty if there are none."""
    found = read_page(html or "").blocks
    labels = minimum_cut([leaning(b) for b in found], ties(found))
    return "\n".join(b.text for b, content in zip(found, labels) if content)


def extracted(pages: DataFrame) -> DataFrame:
    """All columns of the pages and text, n_chars; a null html has an empty text.

    Every page is read whole, on its own, and a batch is passed on in slices of bounded size. Columns named text or n_chars are replaced.
    """
    new = ("text", "n_chars")
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in new])
    schema = StructType([*kept.schema.fields]).add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            for part in in_runs(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                new = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return kept.mapInArrow(run, schema)
