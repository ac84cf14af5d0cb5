"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged into one tree: a node is the chain of block elements (tag,
class and id tokens) from the root. For each node the pages give a presentation (the kinds of its
children) and contents (the text that stands directly in it). Text whose node's contents and
presentation are spread evenly over the pages has a high entropy and is important; text that reads
alike on all pages, such as a notice, has a low one. That entropy is drawn towards 1 where a host
has few pages to judge by, and lowered for lists of links. A node's importance is composed from
below, the largest of its own text's and its children's, so that a branch goes only if all of it is
low; times the weight of its own role: HTML's sectioning elements and class tokens that say menu,
footer, advert, form, sidebar or comment have ``SIDE``; html, body, article and main never have it,
nor does a node that holds half of its host's text. Pages with an article or main element have a
tree of their own, in which branches beside that element have ``SIDE`` too. Every page loses the
branches whose root is of low importance, with all that stands in them. Nothing else is removed.

Statistics are sums over (host, node, value), (host, node) and (host, node, ancestor): a host that
holds a third of all pages is pre-aggregated, never gathered; copies of a page (the same html under
any of the host's URLs) count once. Only the low nodes travel back to the pages: to where the pages
are read if they are few (``FEW`` rows are counted first), else by a join on the host that is spread
over ``SPREAD`` tasks for each host.

Defined results: a null or empty page, or one without main text, gives an empty text; a null URL
has the empty host; pages are read whole, unclosed elements end as HTML says; elements nested deeper
than ``DEEPEST`` blocks count as part of the one at that depth; repeated rows are each extracted; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, slices, texts
from spanloom.llm.url_rules import host_and_path

# HTML element classes.
RAW = frozenset("script style textarea title noscript template iframe object canvas select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article
    header footer nav aside main blockquote pre figure figcaption form fieldset address details summary dialog menu center
    hgroup search button label""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SIDE_TAGS = frozenset("nav footer aside form menu dialog button label search head".split())
MAIN_TAGS = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))
SIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb
    breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login signin search share sharing social related recommended recommendations comment comments
    reply replies discussion disqus respond toolbar pagination pager legal copyright disclaimer skip tags trending
    complementary contentinfo""".split()
)
SIDE_WORDS_OUTSIDE = frozenset(("header", "masthead", "topbar"))  # of the main part
MAIN_WORDS = frozenset("article content post entry story main".split())
FILLERS = frozenset(
    """list box wrapper wrap container area section block inner outer bar body text link links item items group panel site page
    global top bottom left right post article entry main primary secondary thread""".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
MAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1[\s>]|\Z)|(<(?:article|main)[\s>])", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

KEEP, KEEP_MAIN = 0.5, 0.3  # least importance of a branch, and of one inside a main element
SIDE = 0.25  # weight of a role that is not the article's
DOUBT = 10.0  # pages at which entropy and doubt weigh the same
LINKED = 0.6  # share of link text from which text counts as a list of links
LISTED = 0.3  # weight of such a list
DEEPEST = 48
FEW = 100_000  # low nodes, of some twenty bytes each, that may be sent to every executor
SPREAD = 32


@dataclass(slots=True)
class Node:
    tag: str
    id: int
    up: Node | None
    main: bool  # inside a main part, or one itself
    side: bool  # its own role
    kept: bool  # neither it nor an ancestor is low
    depth: int
    kinds: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int  # characters inside links


def _tokens(attributes: str) -> list[str]:
    """Class, id and role tokens in lower case, without digits."""
    values = (m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes))
    return [t for v in values for w in v.lower().split() if (t := re.sub("[0-9]+", "", w).strip("-_"))]


@lru_cache(maxsize=8192)
def _says(token: str, words: frozenset[str]) -> bool:
    """Whether all parts of a token are such words or fillers, and one is such a word."""
    parts = [p for p in re.split("[-_]+", token) if p]
    return any(p in words for p in parts) and all(p in words or p in FILLERS for p in parts)


def _role(tag: str, tokens: list[str], inside: bool) -> tuple[bool, bool]:
    """main, side: what the element is by itself."""
    if tag in MAIN_TAGS:
        return True, False
    if tag in ROOTS:
        return inside, False
    if tag in SIDE_TAGS or any(_says(t, SIDE_WORDS) for t in tokens):
        return inside, True
    if not inside and (tag == "header" or any(_says(t, SIDE_WORDS_OUTSIDE) for t in tokens)):
        return inside, True
    return inside or (tag in ("div", "section", "td") and any(_says(t, MAIN_WORDS) for t in tokens)), False


def has_main(page: str) -> bool:
    """Whether an article or main element stands in the page, outside of comments and scripts."""
    return any(m[2] for m in MAIN.finditer(page))


def parse(page: str, low: frozenset[int] | set[int] = frozenset()) -> tuple[list[Block], dict[int, list[str]]]:
    """Text blocks in page order, and for each node the kinds of its children at each place it stands.

    ``low`` holds nodes of low importance: blocks in their branches are of nodes that are not kept.
    """
    root = Node("", int(has_main(page)), None, False, False, True, 0)
    stack, blocks, kinds = [root], [], {}
    held: list[str] = []
    links: list[str] = []
    in_link = False

    def flush() -> None:
        nonlocal held, links
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                linked = len(" ".join(entities.unescape("".join(links)).split()))
                blocks.append(Block(stack[-1], text, linked))
            held, links = [], []

    def pop() -> None:
        node = stack.pop()
        kinds.setdefault(node.id, []).append(" ".join(node.kinds))

    def push(tag: str, attributes: str) -> None:
        above = stack[-1]
        tokens = _tokens(attributes) if attributes else []
        label = f"{tag}.{'.'.join(tokens)}" if tokens else tag
        if not above.kinds or above.kinds[-1] != label:  # repeated siblings are one kind
            above.kinds.append(label)
        main, side = _role(tag, tokens, above.main)
        if above.depth >= DEEPEST:
            stack.append(Node(tag, above.id, above.up, main, above.side, above.kept, above.depth))
            return
        own = _hashed(f"{above.id} {label}")
        stack.append(Node(tag, own, above, main, side, above.kept and own not in low, above.depth + 1))

    def close(tag: str, barriers: tuple[str, ...] = ()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                flush()
                while len(stack) > depth:
                    pop()
                return
            if stack[depth].tag in barriers:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                links.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in RAW and not closing:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = size if end is None else page.find(">", end.start()) + 1 or size
        elif tag == "hr":
            flush()
        elif tag in BLOCKS and not closing:
            flush()
            if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
                pop()
            if tag in CLOSES_SELF:
                close(tag, CLOSES_SELF[tag])
            push(tag, m[3])
        elif tag in BLOCKS:
            close(tag)
    flush()
    while len(stack) > 1:
        pop()
    return blocks, kinds


def _hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 5) - (1 << 63)


def _observed(pages: DataFrame) -> DataFrame:
    """mark, host, node, kind, value, n, chars, linked: what each page shows of each node.

    Kinds: ``content`` (value: hash of a text), ``style`` (hash of the children's kinds), and ``up``,
    the node's chain to the root (value: an ancestor or itself; n: whether that is of a side role;
    chars: whether it is inside a main part; linked: whether the node is; mark: whether the page has
    a main element), which is the same for all pages.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows: list[tuple] = []
            chains: set[tuple] = set()
            marks, hosts = batch.column("mark").to_pylist(), batch.column("host").to_pylist()
            for mark, host, page in zip(marks, hosts, texts(batch.column("html")), strict=True):
                blocks, kinds = parse(page)
                mains = int(has_main(page))
                seen: dict[tuple[int, str, int], list[int]] = {}
                for b in blocks:
                    one = seen.setdefault((b.node.id, "content", _hashed(b.text)), [0, 0, 0])
                    for k, n in enumerate((1, len(b.text), b.linked)):
                        one[k] += n
                for node in {b.node.id: b.node for b in blocks}.values():
                    for value, n in Counter(kinds.get(node.id, ())).items():
                        seen[node.id, "style", _hashed(value)] = [n, 0, 0]
                    at: Node | None = node
                    while at is not None and at.depth and (host, node.id, at.id) not in chains:
                        chains.add((host, node.id, at.id))
                        rows.append((mains, host, node.id, "up", at.id, int(at.side), int(at.main), int(node.main)))
                        at = at.up
                rows += [(mark, host, node, kind, value, *n) for (node, kind, value), n in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds_ = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["mark", "host", "node", "kind", "value", "n", "chars", "linked"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names=names)

    return pages.select("mark", "host", "html").mapInArrow(
        scan, "mark bigint, host string, node bigint, kind string, value bigint, n bigint, chars bigint, linked bigint"
    )


def _texts(shown: DataFrame) -> DataFrame:
    """host, node, chars, worth: the importance of the text that stands directly in each node."""
    once = shown.dropDuplicates(["host", "mark", "node", "kind", "value"])
    values = once.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    spread = values.groupBy("host", "node").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"m_{k}") for k in ("content", "style")),
        *(F.sum(F.when(F.col("kind") == k, F.col("n") * F.log("n")).otherwise(0.0)).alias(f"l_{k}") for k in ("content", "style")),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
    )

    def entropy(k: str) -> Column:
        """log m - sum(n log n) / m, as a share of log m; 1 where there is one observation only."""
        m, held = F.col(f"m_{k}"), F.col(f"l_{k}")
        return F.when(m > 1, F.greatest(F.lit(0.0), 1 - held / m / F.log(m.cast("double")))).otherwise(1.0)

    trust = F.col("m_content") / (F.col("m_content") + F.lit(DOUBT))
    evidence = F.greatest(entropy("content"), 0.5 * entropy("style"))
    listed = F.when(F.col("linked") >= F.lit(LINKED) * F.col("chars"), LISTED).otherwise(1.0)
    return spread.select("host", "node", "chars", ((1 - trust * (1 - evidence)) * listed).alias("worth"))


def importance(observed: DataFrame) -> DataFrame:
    """host, node, side, main, importance of every node that holds text, composed of all texts in its branch."""
    own = _texts(observed.where("kind <> 'up'"))
    yes = lambda c: F.col(c) > 0
    chains = observed.where("kind = 'up'").select(
        "host", "node", F.col("value").alias("ancestor"), yes("n").alias("side"), yes("chars").alias("main"),
        yes("linked").alias("in_main"), yes("mark").alias("has_main"),
    )
    met = chains.distinct().join(own, ["host", "node"])
    branch = met.groupBy("host", F.col("ancestor").alias("node"), "side", "main").agg(
        F.sum("chars").alias("chars"), F.max("worth").alias("most"), (F.max("has_main") & ~F.max("in_main")).alias("beside")
    )
    whole = own.groupBy("host").agg(F.sum("chars").alias("whole"))
    role = F.when(F.col("beside") | (F.col("side") & (2 * F.col("chars") < F.col("whole"))), SIDE).otherwise(1.0)
    return branch.join(whole, "host").select("host", "node", "side", "main", (F.col("most") * role).alias("importance"))


def low_nodes(observed: DataFrame) -> DataFrame:
    """host, node of the nodes whose branches go."""
    least = F.when(F.col("main"), KEEP_MAIN).otherwise(KEEP)
    return importance(observed).where(F.col("importance") < least).select("host", "node")


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's blocks without the branches of ``low``."""
    return "\n".join(b.text for b in parse(page, low)[0] if b.node.kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars for every page."""
    kind = dict(pages.select(key).dtypes)[key]
    host, _ = host_and_path(F.col(url))
    given = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"),
        F.xxhash64(html).alias("mark"), F.pmod(F.xxhash64(url, html), F.lit(SPREAD)).cast("int").alias("spread"),
    )
    low = checkpoint(low_nodes(_observed(given)))
    few = low.count() <= FEW
    shared = None
    if few:
        of_host: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            of_host.setdefault(r["host"], set()).add(r["node"])
        shared = pages.sparkSession.sparkContext.broadcast(of_host)
        joined = given
    else:
        # at most as many as a host's pages have kinds of nodes
        by_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
        copies = by_host.withColumn("spread", F.explode(F.array(*[F.lit(k) for k in range(SPREAD)])))
        joined = given.join(copies, ["host", "spread"], "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            known: dict[str, set[int]] = shared.value if few else {}
            found = []
            for k, (host, page) in enumerate(zip(batch.column("host").to_pylist(), texts(batch.column("html")), strict=True)):
                if not few and host not in known:
                    known[host] = set(batch.column("low")[k].as_py() or ())
                found.append(main_text(page, known.get(host, frozenset())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(found, pa.string()), pa.array(np.array([len(t) for t in found], np.int64))],
                names=[key, "url", "text", "n_chars"],
            )

    columns = ["key", "url", "host", "html"] + ([] if few else ["low"])
    return joined.select(*columns).mapInArrow(scan, f"`{key}` {kind}, url string, text string, n_chars bigint")
