"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a node for each path of containers, with how many pages show it, in which
styles (the sequence of its children) and with which content. A node's importance is 1 - (1 - p)(1 - c) of the normalised entropies
of its styles (p) and contents (c): what looks and reads alike on all pages has none. Nodes that say
themselves what they are weigh it: nav, footer, aside, forms, class names of adverts and comments by LOW_WEIGHT, article and main to 1, as one
page of a host shows no entropy, a host's adverts differ from page to page, and copies of one article don't. Branches of low importance are cut from each page;
nothing else decides what is cut.

Inside an article or main node a container counts once for each distinct text of that node,
so that copies of one article, which repeat all of it, say nothing about its parts. There only whole names of containers tell what a node is, not parts of names and not headings' or paragraphs'.

The tree moves as counts, not as pages: (host, path, style, content, article) is pre-aggregated, so a host with a third of the pages is many
partial counts. The paths to cut are written out, and only they are joined to the pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, tidy

THRESHOLD = 0.3
#: Fewer pages show no entropy.
MIN_PAGES = 3
#: What is left of the importance of a node that says it is no article; under the threshold, as is any product with it.
LOW_WEIGHT = 0.25
#: Content hashes are polynomials of the blocks' hashes, so that a container's is the difference of two running ones.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51

# A quote opens a value only behind an equals sign; the possessive group keeps a broken tag from being read again.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("body div section nav header footer aside form article main ul ol dl table dialog center menu fieldset".split())
_LOW_TAGS = frozenset("nav header footer aside form dialog menu button head".split())
_LOW_NAME = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notice|newsletter|subscribe|popup|modal|social|share|related|comments?|comment-list|respond|disqus|widget|search|login)"
_LOW_PART, _LOW_WHOLE = re.compile(rf"(?:^|[\s_-]){_LOW_NAME}(?:$|[\s_-])", re.I), re.compile(rf"(?:^|\s){_LOW_NAME}(?:$|\s)", re.I)
_HIGH_TAGS = frozenset(("article", "main"))
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_NUMBER = re.compile(r"[0-9]+")


class Node:
    """An element: a container has a path of its own, any other its container's; inside says that it is in an article or main node or is one."""

    __slots__ = ("tag", "path", "children", "prior", "container", "inside")

    def __init__(self, tag: str, path: str, prior: float | None, container: bool, inside: bool) -> None:
        self.tag, self.path, self.prior, self.container, self.inside = tag, path, prior, container, inside
        self.children: list[Node | str] = []


def _prior(tag: str, names: dict[str, str], inside: bool) -> float | None:
    """0 or 1 for a node that says what it is."""
    told = " ".join((names.get("class", ""), names.get("id", ""), names.get("role", "")))
    if tag in _LOW_TAGS:
        return 0.0
    if inside or tag == "article":
        if tag in _CONTAINERS and tag != "main" and _LOW_WHOLE.search(told):
            return 0.0
    elif tag not in ("body", "html", "main") and _LOW_PART.search(told):
        return 0.0
    return 1.0 if tag in _HIGH_TAGS or names.get("role") == "main" else None


def _node(above: Node, tag: str, attributes: str) -> Node:
    names = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            names.setdefault(name.lower(), "".join(values))
    prior = _prior(tag, names, above.inside)
    container = tag in _CONTAINERS or prior is not None
    path = above.path
    if container:
        # the path above goes in as a digest, so that a path's length doesn't grow with its depth; running numbers in names don't tell nodes apart
        words = " ".join(filter(None, (names.get("class"), names.get("id"), names.get("role")))).split()
        path = f"{xxhash.xxh3_128_hexdigest(above.path.encode('utf-8', 'surrogatepass'))}/{_NUMBER.sub('0', '.'.join([tag, *words]))}"
    return Node(tag, path, prior, container, above.inside or prior == 1.0)


def parse(page: str) -> Node:
    """The page's tree: elements and text, without comments, scripts and other raw parts. Never fails, whatever is unclosed; linear in the page's length."""
    root = Node("", "", None, False, False)
    stack, at, end = [root], 0, len(page)
    opened: dict[str, list[int]] = defaultdict(list)  # where each tag stands in the stack
    outer = [0]  # how many elements of the stack up to each are not inline

    def close(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()
            outer.pop()

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            if not m[0].startswith(("<!", "<?", "</")):
                stack[-1].children.append(m[0])
            continue
        if m[1]:
            if opened[tag] and (tag not in _INLINE or outer[-1] == outer[opened[tag][-1]]):
                close(opened[tag][-1])
            continue
        if tag in _RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag not in _INLINE:
            while stack[-1].tag in _INLINE:
                close(len(stack) - 1)
            if stack[-1].tag == "p" or stack[-1].tag in _CLOSES.get(tag, ()):
                close(len(stack) - 1)
        node = _node(stack[-1], tag, m[3])
        stack[-1].children.append(node)
        if tag not in _VOID:
            opened[tag].append(len(stack))
            outer.append(outer[-1] + (tag not in _INLINE))
            stack.append(node)
    return root


def _contents(root: Node) -> dict[int, int]:
    """Hash of the text of each container by id(), in one walk at any depth: the blocks of text in order, white space as one blank."""
    sums, powers, now, began, out = [0], [1], [], {}, {}

    def done() -> None:
        if text := " ".join("".join(now).split()):
            sums.append((sums[-1] * _BASE + xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) + 1) % _PRIME)
            powers.append(powers[-1] * _BASE % _PRIME)
        now.clear()

    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        x, end = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif end:
            done()
            if id(x) in began:
                k = began.pop(id(x))
                out[id(x)] = (sums[-1] - sums[k] * powers[len(sums) - 1 - k]) % _PRIME
        else:
            if x.tag not in _INLINE or x.container:
                done()
                if x.container:
                    began[id(x)] = len(sums) - 1
                todo.append((x, True))
            todo += ((c, False) for c in reversed(x.children))
    return out


def branches(root: Node) -> Iterator[tuple[str, float | None, str, int, int | None]]:
    """(path, prior, style, content's hash, enclosing article's hash or None) of every container but the body."""
    told = _contents(root)
    todo: list[tuple[Node, int | None]] = [(root, None)]
    while todo:
        node, main = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                if c.container and c.tag != "body":
                    seen = [x.tag for x in c.children if isinstance(x, Node)]
                    style = ",".join(t for k, t in enumerate(seen) if not k or seen[k - 1] != t)
                    yield c.path, c.prior, style, told[id(c)], main
                todo.append((c, told[id(c)] if c.prior == 1.0 and main is None else main))


def blocks(root: Node, cut: frozenset[str]) -> list[str]:
    """The blocks of text that are left without the branches that the tree cuts, in page order. Only what is in article or main parts counts, unless more than twice as much is outside."""
    out: list[tuple[bool, str]] = []
    now: list[str] = []

    def done(inside: bool) -> None:
        if text := " ".join(html.unescape("".join(now)).split()):
            out.append((inside, text))
        now.clear()

    work: list[tuple[Node | str, Node, bool]] = [(root, root, False)]
    while work:
        x, above, end = work.pop()
        if isinstance(x, str):
            now.append(x)
        elif end:
            done(x.inside)
        elif not (x.container and x.path in cut):
            if x.tag == "br":
                now.append(" ")
            if x.tag not in _INLINE:
                done(above.inside)
                work.append((x, above, True))
            work += [(c, x, False) for c in reversed(x.children)]
    done(False)
    sizes = Counter()
    for inside, text in out:
        sizes[inside] += len(text)
    return [text for inside, text in out if inside or sizes[False] > 2 * sizes[True]]


def main_text(page: str | None, cut: frozenset[str] | None = None) -> str:
    """The page's text without the branches in `cut`; None: those that a tree of this page alone cuts."""
    root = parse(page or "")
    if cut is None:
        cut = frozenset(path for path, prior, *_ in branches(root) if prior == 0.0)
    return "\n\n".join(blocks(root, cut))


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, pages, style_entropy, content_entropy, importance) of the merged pages with columns host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h.as_py(), *b) for h, p in zip(batch.column(0), batch.column(1)) for b in dict.fromkeys(branches(parse(p.as_py() or "")))]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "path", "prior", "style", "content", "main"])

    ship(pages.sparkSession)
    keys = ["host", "path", "prior", "style", "content"]
    shown = pages.select("host", "html").mapInArrow(tidy(run), "host string, path string, prior double, style string, content long, main long").groupBy(*keys, "main").agg(F.count("*").alias("n"))
    seen = settle(shown.groupBy(*keys).agg(F.sum(F.when(F.col("main").isNull(), F.col("n")).otherwise(1)).alias("n")))
    entropy = lambda by: (
        seen.groupBy("host", "path", by).agg(F.sum("n").alias("n"), F.max("prior").alias("prior")).groupBy("host", "path")
        .agg(F.sum("n").alias("pages"), F.max("prior").alias("prior"), F.sum(F.col("n") * F.log("n")).alias("s"))
        .select("host", "path", "pages", "prior", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(f"{by}_entropy"))
    )
    both = entropy("style").join(entropy("content").drop("pages", "prior"), ["host", "path"])
    own = F.when(F.col("pages") >= min_pages, 1 - (1 - F.col("style_entropy")) * (1 - F.col("content_entropy"))).otherwise(1.0)
    weighed = F.when(F.col("prior") == 1, 1.0).when(F.col("prior") == 0, own * LOW_WEIGHT).otherwise(own)
    return both.select("host", "path", "pages", "style_entropy", "content_entropy", weighed.alias("importance"))


def low_branches(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, cut): the paths that each host's style tree cuts."""
    low = style_tree(pages, min_pages).where(F.col("importance") < threshold)
    return settle(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("cut")))


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    A null or empty page has an empty text; pages without a host in their url (null too) share one tree; repeated rows count as
    pages of their own; other columns are ignored; an empty table gives an empty table.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"))
    cut = low_branches(own, threshold, min_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), frozenset(c.as_py() or ())) for p, c in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = own.join(cut, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "cut")
    return joined.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
