"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. An element node is a box's place in its parent's
style, and a style is the sequence of box children (tag, classes, id and role) that a parent
has on a page; so equal boxes are told apart by their place, and pages that are laid out alike
share nodes. Over the pages that have a node, two entropies tell its worth. Presentation: the
entropy of the styles it occurs with, if it has box children. Content: one less the mean entropy, over the pages, of
its text features (clauses: runs of words between other signs); a clause that every page
repeats has entropy one, a clause of a single page zero. A node's importance is their weighted
sum, over all that hangs on it. The tree merged over all hosts is asked too.

Entropies decide for every branch, menus and footers included:

* importance below ``THRESHOLD``, its clauses on ``LEAST_REPEATS`` pages or more (geometric
  mean), in either tree: the branch is cut, whatever it is named;
* importance of ``PROVEN`` or more over ``PROVEN_PAGES`` pages or more: it stays, whatever it
  is named;
* else the tree leaves it open (too few pages, or importance between): names break the tie.
  Elements and words of class, id and role that stand for menus, footers, side bars, notices
  and adverts cut a branch, unless it holds the page's only article or main element.

Three things no entropy can see, because they differ on each page or are no text, and go by
name always: reader comments, forms, and scripts, styles and other raw matter. A page that
would keep no text is left to names, and then keeps all.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, materialize, slices

#: Pages that a style node must occur on before a tree is asked.
MIN_PAGES = 10
THRESHOLD = 0.8
LEAST_REPEATS = 2.5
PROVEN, PROVEN_PAGES = 0.95, 100
CONTENT_SHARE = 0.9
#: Decided nodes (host and path) that are broadcast (16 bytes each); more are joined.
BROADCAST_NODES = 200_000
#: Parts into which the pages of one node are dealt where decided nodes are joined.
NODE_SALTS = 32

# Element names of HTML by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math".split())
_NEVER = frozenset("head script style noscript template iframe textarea title xmp noembed noframes svg math object audio video canvas map datalist select option button input form dialog".split())
#: Elements that stand for something else than the article.
_MARKS = frozenset("nav menu footer aside header".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCKS - frozenset("body caption dd dt head html legend li tbody td tfoot th thead title tr".split())
#: An element that ends open ones of these names, up to the nearest of the second names.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "body": (("head",), ()),
}
#: Containers: the nodes of the tree.
_BOXES = frozenset("article main div section ul ol dl table header footer nav aside menu center details fieldset figure span".split())
#: Words of class, id and role that name what is not the article.
_CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social sidebar sidebars widget widgets menu menus navbar nav navigation breadcrumb breadcrumbs footer header masthead topbar related recommended recommendations pagination pager login search toolbar skip copyright legal disclaimer contentinfo complementary alert alertdialog dialog rail teaser teasers trending".split()
)
#: Words that name reader comments.
_READERS = frozenset("comment comments commentlist disqus respond replies".split())
_CUES_OUTSIDE_ARTICLES = frozenset(("header", "banner", "masthead"))
_NOT_CUES_AFTER = frozenset(("has", "with", "no", "without", "main", "article", "post", "entry"))
#: Elements that names do not mark.
_EXEMPT = frozenset("html body main".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLAUSE = re.compile(r"[\w'’\- ]*\w")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_END_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in _RAW}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Page:
    """Light tree of one page: nodes in page order, and blocks of (node, text) pieces."""

    __slots__ = ("blocks", "boxes", "children", "cues", "hidden", "in_article", "labels", "parent", "paths", "styles", "tags", "up")

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tags: list[str] = ["#root"]
        self.labels: list[str] = ["#root"]
        self.cues: list[bool] = [False]
        self.hidden: list[bool] = [False]
        self.in_article: list[bool] = [False]
        self.children: list[list[int]] = [[]]
        self.blocks: list[list[tuple[int, str]]] = []
        self._parse(source)
        self._place()

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        label, cue, hidden = tag, False, False
        inside = self.in_article[parent]
        if attributes and not attributes.isspace():
            names: list[str] = []
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role"):
                    names.append(f"{name}={value}")
                    for part in value.split():
                        before = ""
                        for w in (x.lower() for x in _WORD.findall(part)):
                            if before not in _NOT_CUES_AFTER:
                                hidden |= w in _READERS
                                cue |= w in _CUES and not (inside and w in _CUES_OUTSIDE_ARTICLES)
                            before = w
                    if name == "role" and value.strip().lower() == "main":
                        tag = "main"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
            label = " ".join((tag, *sorted(names)))
        node = len(self.tags)
        self.parent.append(parent)
        self.tags.append(tag)
        self.labels.append(label)
        self.cues.append(tag not in _EXEMPT and (cue or (tag in _MARKS and not (tag == "header" and inside))))
        self.hidden.append(tag in _NEVER or (hidden and tag not in _EXEMPT))
        self.in_article.append(inside or tag == "article")
        self.children.append([])
        self.children[parent].append(node)
        return node

    def _place(self) -> None:
        """Paths of nodes, styles of boxes, and of each node the boxes it hangs on, itself first."""
        n = len(self.tags)
        self.boxes = [t in _BOXES for t in self.tags]
        self.styles, self.paths, self.up = [0] * n, [0] * n, [()] * n
        for i in range(n):
            mine = [c for c in self.children[i] if self.boxes[c]]
            style = self.styles[i] = xxhash.xxh64_intdigest("|".join([self.labels[c] for c in mine])) >> 1 if mine else 0
            own = self.up[i] = (self.paths[i], *self.up[self.parent[i]]) if self.boxes[i] else self.up[self.parent[i]]
            for c in self.children[i]:
                self.up[c] = own
                if not self.boxes[c]:
                    self.paths[c] = xxhash.xxh64_intdigest(f"{self.paths[i]}>{self.labels[c]}") >> 1
            for place, c in enumerate(mine):
                self.paths[c] = xxhash.xxh64_intdigest(f"{self.paths[i]}>{style}>{place}") >> 1

    def _parse(self, source: str) -> None:
        stack, block, at = [0], [], 0
        blocks = self.blocks

        def text(raw: str) -> None:
            if raw:
                block.append((stack[-1], html_lib.unescape(raw) if "&" in raw else raw))

        def flush() -> None:
            nonlocal block
            if block:
                blocks.append(block)
                block = []

        while m := _TOKEN.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            end, start, attributes = m[1], m[2] or m[4], m[3] if m[2] else m[5]
            if end:
                tag = end.lower()
                if tag in _BLOCKS:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tags[stack[k]]
                    if name == tag or (tag == "div" and name == "main"):
                        del stack[k:]
                        break
                    if name in ("td", "th", "table", "article", "body") and tag not in _BLOCKS:
                        break
                continue
            if not start:
                continue
            tag = start.lower()
            if tag in _BLOCKS:
                flush()
            if tag in _CLOSES_P:
                self._close(stack, ("p",), ("td", "th", "table", "button", "object"))
            if tag in _IMPLIED:
                self._close(stack, *_IMPLIED[tag])
            if tag == "br":
                block.append((stack[-1], " "))
                continue
            if tag in _VOID:
                continue
            node = self._open(stack[-1], tag, attributes or "")
            if attributes and attributes.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            if tag in _RAW:
                close = _END_RAW[tag].search(source, at)
                at = close.end() if close else len(source)
                continue
            stack.append(node)
        text(source[at:])
        flush()

    def _close(self, stack: list[int], names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in stop:
                break
            if tag in names:
                found = k
        if found:
            del stack[found:]

    def features(self) -> tuple[set[tuple[int, int, int]], dict[int, tuple[bool, tuple[int, ...]]]]:
        """(path, kind, feature) of the page's boxes, and for each path whether names mark it and
        the paths it hangs on. Kind 0 is a clause, 1 a style, 2 presence."""
        out: set[tuple[int, int, int]] = set()
        known: dict[int, tuple[bool, tuple[int, ...]]] = {}
        dropped = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            dropped[i] = dropped[self.parent[i]] or self.hidden[i]
            if self.boxes[i] and not dropped[i]:
                out.add((self.paths[i], 1, self.styles[i]))
                out.add((self.paths[i], 2, 0))
                known[self.paths[i]] = (self.cues[i], self.up[i])
        for block in self.blocks:
            # A block's pieces hang on the boxes of the first one that has words.
            where = next((self.up[node] for node, t in block if not dropped[node] and t.strip()), ())
            if where and where[0] in known:
                words = " ".join("".join([t for node, t in block if not dropped[node]]).split())
                out.update((where[0], 0, xxhash.xxh64_intdigest(c.strip()) >> 1) for c in _CLAUSE.findall(words))
        return out, known

    def text(self, low: set[int] | frozenset[int] = frozenset(), proven: set[int] | frozenset[int] = frozenset()) -> str:
        """Blocks of what is left when branches that the tree or, where it leaves them open, names rule out are cut."""
        for tree, names in ((True, True), (False, True), (False, False)):
            text = "\n".join(self._lines(self._kept(low if tree else frozenset(), proven, names)))
            if text or not self.blocks:
                break
        return text

    def _kept(self, low: set[int] | frozenset[int], proven: set[int] | frozenset[int], names: bool) -> list[bool]:
        n = len(self.tags)
        # Articles and main elements that hang on each node.
        mains = [int(t in ("article", "main")) for t in self.tags]
        for i in range(n - 1, 0, -1):
            mains[self.parent[i]] += mains[i]
        every, kept = mains[0], [True] * n
        for i in range(1, n):
            if not kept[self.parent[i]] or self.hidden[i] or (self.boxes[i] and self.paths[i] in low):
                kept[i] = False
            elif names and self.cues[i] and self.paths[i] not in proven:
                kept[i] = bool(every) and mains[i] == every
        return kept

    def _lines(self, kept: list[bool]) -> list[str]:
        lines = (" ".join("".join(t for node, t in block if kept[node]).split()) for block in self.blocks)
        return [x for x in lines if x]


def _statistics(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n, named, up): pages with the feature, summed a task before the
    shuffle; rows of presence tell whether names mark the node and what it hangs on."""
    schema = "host string, path bigint, kind int, feature bigint, n bigint, named boolean, up array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known: dict[int, tuple[bool, tuple[int, ...]]] = {}

        def out() -> pa.RecordBatch:
            keys = list(counts)
            told = [known[k[1]] if k[2] == 2 else (None, None) for k in keys]
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
            columns += [pa.array([counts[k] for k in keys], pa.int64()), pa.array([t[0] for t in told], pa.bool_()), pa.array([t[1] for t in told], pa.list_(pa.int64()))]
            counts.clear()
            known.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "path", "kind", "feature", "n", "named", "up"])

        for batch in slices(batches, "html"):
            for url, source in zip(batch.column("url").to_pylist(), as_texts(batch.column("html")), strict=True):
                host = host_of(url)
                features, boxes = Page(source).features()
                counts.update((host, *f) for f in features)
                known.update(boxes)
                if len(counts) > 100_000:
                    yield out()
        if counts:
            yield out()

    rows = pages.select("url", "html").mapInArrow(run, schema)
    return rows.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("named").alias("named"), F.max("up").alias("up"))


def importance(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, named, importance, repeats) of each style node of ``counts``.

    ``m`` is its pages; ``repeats`` the geometric mean of the pages that have each of its clauses.
    """
    ln = F.log(F.col("n").cast("double"))
    of_kind = lambda kind, value: F.when(F.col("kind") == kind, value)
    own = counts.groupBy(*keys).agg(
        F.sum(of_kind(2, F.col("n"))).alias("m"),
        F.max("named").alias("named"),
        F.max("up").alias("up"),
        F.coalesce(F.sum(of_kind(1, F.col("n") * ln)), F.lit(0.0)).alias("styles"),
        F.coalesce(F.sum(of_kind(0, ln)), F.lit(0.0)).alias("texts"),
        F.count(of_kind(0, 1)).alias("features"),
        F.coalesce(F.max(of_kind(1, F.col("feature") == 0)) & F.min(of_kind(1, F.col("feature") == 0)), F.lit(True)).alias("leaf"),
    )
    # What hangs on a node counts for it.
    spread = own.select(*keys[:-1], F.explode("up").alias(keys[-1]), "texts", "features")
    whole = spread.groupBy(*keys).agg(F.sum("texts").alias("texts"), F.sum("features").alias("features"))
    by = own.drop("texts", "features").join(whole, list(keys))
    log_m = F.log(F.col("m").cast("double"))
    mean = F.when(F.col("features") > 0, F.col("texts") / F.col("features")).otherwise(log_m)
    presentation = (log_m - F.col("styles") / F.col("m")) / log_m
    content = 1 - mean / log_m
    # A node that never has box children has no styles to tell apart.
    worth = F.when(F.col("m") <= 1, 1.0).when(F.col("leaf"), content).otherwise((1 - CONTENT_SHARE) * presentation + CONTENT_SHARE * content)
    return by.select(*keys, "m", "named", worth.alias("importance"), F.exp(mean).alias("repeats"))


def decided_nodes(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, path, low) of style nodes that a tree decides: cut if ``low``, else kept despite their name."""
    counts = materialize(_statistics(pages), "style-tree")
    merged = counts.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("named").alias("named"), F.max("up").alias("up"))
    every = importance(merged, "path").select("path", *(F.col(c).alias("all_" + c) for c in ("m", "importance", "repeats")))
    both = importance(counts, "host", "path").join(every, "path")

    def below(prefix: str) -> F.Column:
        return (F.col(prefix + "m") >= min_pages) & (F.col(prefix + "importance") < threshold) & (F.col(prefix + "repeats") >= LEAST_REPEATS)

    low = below("") | below("all_")
    proven = F.col("named") & (F.col("all_m") >= PROVEN_PAGES) & (F.col("all_importance") >= PROVEN)
    return both.select("host", "path", low.alias("low"), proven.alias("proven")).where("low OR proven").select("host", "path", "low")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text; pages of a null or odd url share the
    empty host. Repeated rows give repeated rows, and an empty table none. Other columns are not
    read. Counts for the tree are summed by node and feature, so a host of any size is dealt
    over all tasks.
    """
    pages = pages.select("page_id", "url", "html")
    decided = materialize(decided_nodes(pages, min_pages, threshold), "style-nodes")
    schema = "page_id bigint, url string, text string, n_chars bigint"
    if decided.count() <= BROADCAST_NODES:
        nodes: dict[str, tuple[set[int], set[int]]] = {}
        for host, path, low in decided.toLocalIterator():
            nodes.setdefault(host, (set(), set()))[not low].add(path)
        shared = pages.sparkSession.sparkContext.broadcast(nodes)
        none = (frozenset(), frozenset())

        def of_hosts(batch: pa.RecordBatch) -> list[tuple[set[int], set[int]]]:
            return [shared.value.get(host_of(u), none) for u in batch.column("url").to_pylist()]

        return pages.mapInArrow(_extractor(of_hosts), schema)

    def of_rows(batch: pa.RecordBatch) -> list[tuple[set[int], set[int]]]:
        return [(set(a or ()), set(b or ())) for a, b in zip(batch.column("low").to_pylist(), batch.column("proven").to_pylist(), strict=True)]

    return _with_own_nodes(pages, decided).mapInArrow(_extractor(of_rows), schema)


def _with_own_nodes(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """``pages`` with the decided paths that each page has, as ``low`` and ``proven``.

    Pages go by a hash of their address and text, so each has a key of its own but for copies,
    which share their paths. The pages of a node are dealt over ``NODE_SALTS`` parts.
    """
    keyed = pages.withColumn("key", F.xxhash64("url", "html")).withColumn("other", F.hash("html", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "other", "url")), as_texts(batch.column("html")), strict=True)
            out = [(key, other, host_of(url), path) for key, other, url, source in rows for path in Page(source).features()[1]]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["key", "other", "host", "path"])

    boxes = keyed.select("key", "other", "url", "html").mapInArrow(run, "key bigint, other int, host string, path bigint")
    boxes = boxes.withColumn("salt", F.pmod("key", F.lit(NODE_SALTS)).cast("int"))
    salted = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(NODE_SALTS - 1))))
    own = boxes.join(salted, ["host", "path", "salt"]).groupBy("key", "other").agg(*(F.collect_set(F.when(F.col("low") == x, F.col("path"))).alias(name) for name, x in (("low", True), ("proven", False))))
    return keyed.join(own, ["key", "other"], "left")


def _extractor(nodes_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [Page(s).text(*nodes) for s, nodes in zip(as_texts(batch.column("html")), nodes_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run
