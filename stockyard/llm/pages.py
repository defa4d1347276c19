"""Main text of web pages by a site style tree.

Pages of one host are merged: nodes with the same path of tags, classes and ids are one
node of the host's style tree. Two things tell how much a node matters:

* Presentation: a node whose children come in many different orders matters; its
  entropy over the pages, in units of log(pages).
* Content: a text that stands on one page has importance 1, one that stands on k of the
  m pages with this node 1 - log k / log m; the node has the mean over its texts.

The importance of a node is a weighted sum of both, and every text is also a node of its
own below the tags that lead to it, so a repeated text goes without its neighbours and
whatever its class is called. What matters less than its prior asks for is cut, on hosts
with at least `MIN_PAGES` different pages with that node:

* Outside `article` and `main`, nodes and texts below `THRESHOLD`. Tags, and whole
  classes, ids and roles, whose meaning is a menu, header, footer, sidebar, notice,
  advert, form or comment section have no importance there from the start. A name that
  has such a word among others (`with-sidebar`, `related-work`) only asks for more: what
  it holds is cut below `NAMED`, and on pages that have an article elsewhere.
* An `article` or `main` ends what names, headers and forms around it say, unless the
  page has one outside of them too: then it is a teaser or a reader's comment.
* Inside, texts below `SURE`, so only what stands on nearly every page; a heading, term
  or cell stays as long as what follows it beside it does. Tags of no content have no
  importance, nor have the names of adverts and reader comments, alone or with words for
  a container (`ad-slot`, `comment-list`), which are other people's texts and need not
  repeat. Other whole names of `NAMED_NOISE` only ask for more: such nodes and their
  texts are cut below `NAMED`, and where they lie in `main` beside an article. A page
  whose article would be left without any text keeps it.

The tree is never built in one place: tasks count (host, path, feature), the counts are
shuffled, and only the nodes to be cut come back, per host. A host with a third of all
pages costs as many rows as it has paths and distinct texts; texts are filtered by their
count before they meet the pages of their node.

Defined results: null or empty html gives an empty text; markup that never closes is
closed at the end; a null url is a host of its own. Blocks begin and end at block tags;
inline tags, line breaks among them, do not end a block. Repeated rows each get a
result, but count once in the tree. Extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.sizing import is_small
from stockyard.session import store
from stockyard.shipping import ship_by_value

ship_by_value(__name__)

#: Share of the content in a node's importance.
CONTENT = 0.9
#: Nodes that matter less are cut: in general, inside article and main, and there below names that mean something else.
THRESHOLD, SURE, NAMED = 0.2, 0.05, 0.4
#: A node must stand on so many different pages of its host to be cut for its contents.
MIN_PAGES = 8

# HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
NO_CONTENT = frozenset(
    "head script style textarea title noscript template iframe nav footer aside form button select option menu dialog svg "
    "math object audio video canvas map input xmp noembed noframes".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
SCOPES = frozenset("ul ol dl table body html article section main div nav aside footer header form select".split())
# Words in classes, ids and roles that name something other than the article.
NAMED_NOISE = frozenset(
    "nav navbar navigation menu menubar header masthead footer contentinfo sidebar complementary aside ad ads advert "
    "adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay dialog subscribe subscription newsletter signup login search form share sharing social "
    "comment comments disqus replies respond related recommended breadcrumb breadcrumbs pagination pager toolbar widget "
    "widgets skip copyright".split()
)
# Names of other people's texts, also inside an article, and words for what holds them.
NAMED_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising comments commentlist disqus replies sponsored".split()
)
HOLDERS = frozenset(
    "area banner block body box container content frame holder item label list panel section slot space thread unit wrap "
    "wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LABELS = frozenset("h1 h2 h3 h4 h5 h6 dt th td caption summary".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


PLAIN, INSIDE, DOUBTED = 0, 1, 2
#: Noise by what an article below it outweighs, such an article until the whole page is known, and noise for good.
NAMED_SO, HELD, SURELY = 1, 2, 3
#: How close a node is to the article.
OUTSIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2


class Block:
    __slots__ = ("above", "core", "noise", "path", "place", "prior", "tag", "text")

    def __init__(self, top: Open, text: str):
        self.tag, self.above, self.path, self.place = top.tag, top.above, top.path, top.place
        self.noise, self.prior, self.core, self.text = top.noise, top.prior, top.core, text


class Open:
    """An open element: its path and its parent's, the tags alone of it, whether it is noise by what it is, prior and core."""

    __slots__ = ("above", "children", "core", "noise", "path", "place", "prior", "tag")

    def __init__(self, tag: str, above: str, path: str, place: str, noise: int, prior: int, core: int):
        self.tag, self.above, self.path, self.place = tag, above, path, place
        self.noise, self.prior, self.core = noise, prior, core
        self.children: list[str] = []


def _named(attributes: str) -> tuple[str, set[str], list[str], set[str]]:
    """Class and id as they stand in a path, the words in them and in the role, whole classes and roles, and whole ids."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    names = f".{found['class']}" if found.get("class") else ""
    names += f"#{found['id']}" if found.get("id") else ""
    words = {w.lower() for value in found.values() for w in _WORDS.findall(value)}
    return names, words, f"{found.get('class', '')} {found.get('role', '')}".split(), set(found.get("id", "").split())


def _foreign(name: str) -> bool:
    """Whether a name says adverts or reader comments, and nothing else but what holds them."""
    first, *rest = [w.lower() for w in _WORDS.findall(name)] or [""]
    holds = HOLDERS.issuperset(rest)
    return holds and (first in NAMED_FOREIGN or (first == "comment" and bool(rest)))


def _settle(blocks: list[Block]) -> None:
    """What only the whole page tells: which articles in named noise count, and whether doubted blocks have an article beside."""
    free = any(b.core and not b.noise for b in blocks)
    for b in blocks:
        if b.noise == HELD:
            b.noise = NAMED_SO if free else 0
    core = max((b.core for b in blocks if not b.noise and b.prior != DOUBTED), default=OUTSIDE)
    for b in blocks:
        if b.prior == DOUBTED and b.core < core:
            b.noise = b.noise or NAMED_SO


def parse(html: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Text blocks in page order, and (path, tags of the children) for every element."""
    root = Open("", "", "", "", 0, PLAIN, OUTSIDE)
    stack, blocks, styles, parts = [root], [], [], []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", references.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append(Block(stack[-1], text))

    def close(to: int) -> None:
        while len(stack) > to:
            top = stack.pop()
            styles.append((top.path, " ".join(top.children)))

    at, end = 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        if found is None:
            parts.append(html[at:])
            break
        if found.start() > at:
            parts.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            continue
        flush()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if stack[-1].tag in CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    close(k)
                elif stack[k].tag in SCOPES:
                    break
        names, words, classes, ids = _named(found[3])
        whole = {name.lower() for name in (*classes, *ids)}
        parent = stack[-1]
        parent.children.append(tag)
        noise, prior, core = parent.noise, parent.prior, parent.core
        if tag in ("article", "main"):
            if core == OUTSIDE:
                prior, noise = INSIDE, HELD if noise == NAMED_SO else noise
            core = max(core, IN_ARTICLE if tag == "article" else IN_MAIN)
        elif tag in NO_CONTENT:
            noise = max(noise, NAMED_SO) if tag == "form" and core == OUTSIDE else SURELY
        elif core == OUTSIDE and tag not in ("html", "body"):
            if tag == "header" or not whole.isdisjoint(NAMED_NOISE):
                noise = noise or NAMED_SO
            elif not words.isdisjoint(NAMED_NOISE):
                prior = DOUBTED
        elif core != OUTSIDE:
            # The ids of headings are made of their texts.
            if any(map(_foreign, classes if tag in HEADINGS else (*classes, *ids))):
                noise = SURELY
            prior = prior if whole.isdisjoint(NAMED_NOISE) else DOUBTED
        own = Open(tag, parent.path, f"{parent.path}/{tag}{names}", f"{parent.place}/{tag}", noise, prior, core)
        if tag in RAW:
            close_at = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            at = close_at.start() if close_at else end
            stack.append(own)
        elif tag not in VOID and not found[3].endswith("/>"):
            stack.append(own)
    flush()
    close(1)
    _settle(blocks)
    return blocks, styles


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


STANDS, SAYS, LOOKS, AT, SAID = range(5)
_FEATURES = "host string, path long, kind int, feature long, n double"


def _node(block: Block) -> int:
    return _hash(f"{block.prior}{block.path}")


def _place(block: Block) -> int:
    return _hash(f"{block.prior}>{block.place}")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and host: on how many pages a node stands, says a text, has an order of children; a place stands, has a text.

    Every row of `c` copies counts for 1 / c pages. The feature of a node or place that stands is its prior.
    """
    for batch in batches:
        sums: dict = {}
        columns = (batch.column(name).to_pylist() for name in ("host", "html", "c"))
        for host, html, copies in zip(*columns, strict=True):
            blocks, styles = parse(html or "")
            own, nodes = set(), {}
            for block in blocks:
                if block.noise:
                    continue
                text, place = _hash(block.text), _place(block)
                own.add((host, place, AT, block.prior))
                own.add((host, place, SAID, text))
                if block.prior != INSIDE:
                    node = nodes[block.path] = _node(block)
                    own.add((host, node, STANDS, block.prior))
                    own.add((host, node, SAYS, text))
            own |= {(host, nodes[path], LOOKS, _hash(children)) for path, children in styles if path in nodes}
            weight = 1 / copies
            for key in own:
                sums[key] = sums.get(key, 0.0) + weight
        if sums:
            host, path, kind, feature = zip(*sums, strict=True)
            yield pa.record_batch(
                {
                    "host": pa.array(host, pa.string()),
                    "path": pa.array(path, pa.int64()),
                    "kind": pa.array(kind, pa.int32()),
                    "feature": pa.array(feature, pa.int64()),
                    "n": pa.array(list(sums.values()), pa.float64()),
                }
            )


def host_of(url: str | Column = "url") -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def _least(prior: str) -> Column:
    return F.when(F.col(prior) == INSIDE, SURE).when(F.col(prior) == DOUBTED, NAMED).otherwise(THRESHOLD)


def importance(pages: DataFrame) -> DataFrame:
    """host, key, pages, prior and importance of the nodes of all style trees that hold text, and of texts that repeat.

    The key of a node is its hash, that of a text the exclusive or of the hashes of its place and of itself.
    """
    given = pages.select(host_of().alias("host"), "html").where("html is not null").withColumn("copy", F.xxhash64("html"))
    # Copies of a page say nothing about the site: the same html counts once per host.
    repeated = given.groupBy("host", "copy").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    repeated = store(repeated, "page-copies")
    weighed = given.join(F.broadcast(repeated) if is_small(repeated, 100_000) else repeated, ["host", "copy"], "left")
    weighed = weighed.select("host", "html", F.coalesce("c", F.lit(1)).alias("c"))
    counted = weighed.mapInArrow(_features, _FEATURES).groupBy("host", "path", "kind", "feature")
    counted = store(counted.agg(F.round(F.sum("n"), 6).alias("n")), "page-features")

    def over(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    log = F.log("n")
    nodes = counted.where(F.col("kind") <= LOOKS).groupBy("host", F.col("path").alias("key")).agg(
        over(STANDS, F.col("n")).alias("pages"),
        over(STANDS, F.col("feature")).alias("prior"),
        F.avg(F.when(F.col("kind") == SAYS, log)).alias("said"),
        over(LOOKS, F.col("n")).alias("looks"),
        over(LOOKS, F.col("n") * log).alias("looks_log"),
    )
    span = F.log(F.greatest("pages", F.lit(2.0)))
    # The entropy of the orders, each on n of the pages: - sum(n / pages * log(n / pages)).
    entropy = (F.col("looks") * F.log("pages") - F.col("looks_log")) / F.col("pages") / span
    content = 1 - F.col("said") / span
    both = CONTENT * content + (1 - CONTENT) * F.coalesce(F.least(entropy, F.lit(1.0)), F.lit(1.0))
    nodes = nodes.select("host", "key", "pages", "prior", both.alias("importance"))

    # Of the texts only those that can be cut on the fewest pages and with the weakest prior meet their places.
    places = counted.where((F.col("kind") == AT) & (F.col("n") >= MIN_PAGES))
    places = places.select("host", "path", F.col("n").alias("pages"), F.col("feature").alias("prior"))
    often = (F.col("kind") == SAID) & (F.col("n") >= MIN_PAGES ** (1 - max(THRESHOLD, SURE, NAMED)))
    texts = counted.where(often).join(places, ["host", "path"])
    key = F.col("path").bitwiseXOR(F.col("feature")).alias("key")
    return nodes.unionByName(texts.select("host", key, "pages", "prior", (1 - log / span).alias("importance")))


def _keeps(blocks: list[Block], away: set[int]) -> list[Block]:
    """The blocks of a page without those whose node or text is cut."""
    stays = [
        (b.prior == INSIDE or _node(b) not in away) and _place(b) ^ _hash(b.text) not in away for b in blocks
    ]
    for k in range(len(blocks) - 2, -1, -1):
        # Labels inside an article go with what follows them beside or below.
        label, after = blocks[k], blocks[k + 1]
        if not stays[k] and label.prior == INSIDE and stays[k + 1] and after.prior == INSIDE:
            stays[k] = label.tag in LABELS and after.path.startswith(label.above + "/")
    inside = [k for k, b in enumerate(blocks) if b.core]
    if not any(stays[k] for k in inside):
        for k in inside:
            stays[k] = True
    return [b for b, stay in zip(blocks, stays, strict=True) if stay]


def _main_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, cut in batches:
        out = []
        for text, keys in zip(html.to_pylist(), cut.to_pylist(), strict=True):
            away = set(keys or ())
            blocks = [b for b in parse(text or "")[0] if not b.noise]
            out.append("\n".join(b.text for b in (_keeps(blocks, away) if away else blocks)))
        yield pa.array(out, pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    low = importance(pages).where((F.col("importance") < _least("prior")) & (F.col("pages") >= MIN_PAGES))
    # The nodes and texts to cut on one host are part of its template.
    cut = store(low.groupBy("host").agg(F.collect_set("key").alias("cut")), "page-cuts")
    rows = pages.select(F.col("page_id"), F.col("url"), host_of().alias("host"), F.col("html"))
    rows = rows.join(F.broadcast(cut) if is_small(cut, 10_000) else cut, "host", "left")
    main_text = F.arrow_udf(_main_texts, "string")
    texts = rows.select("page_id", "url", main_text("html", "cut").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
