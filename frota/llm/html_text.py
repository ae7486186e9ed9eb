"""Main text of web pages with site templates removed.

Pages are parsed into element trees. Every element subtree is hashed over its tag, class, text and children; Spark
counts on how many pages of a host each hash occurs, and subtrees that recur on many pages of their host are
deleted. "Many" is a fixed number (``min_pages``) at every host size. Text blocks count like all others.

Three things decide what is left of a page:

- Elements whose tag or ``hidden`` attribute makes them no text of the page (``DROPPED``: scripts, styles, nav, footer, aside,
  form ...) are deleted on every page. A page with ``article`` or ``main`` is read from there only, unless more words stand outside
  of them that nothing declares: then it is read as a whole.
- Counts: subtrees on ``min_pages`` or more pages of their host are deleted, whatever their names.
- Names of classes, ids and roles (``MARKS``, and compounds that begin or end with one of ``PARTS``) delete on every page what differs from
  page to page and so escapes the counts, such as reader comments and adverts. A name says nothing about an element that holds nine
  tenths of the words read: it wraps the page.

All three are the same at every size of a host and of a page. Scanning is linear in the length of a page: tags are
read with possessive patterns up to the last ">". A quote counts only behind "=" and where it is closed, an unclosed tag is text.

Copies of an article repeat its blocks as well, but a template stands among different articles: inside ``article`` or ``main`` a
subtree counts once for each distinct article around it. Articles of a host that share a name of four minimum
hashes over their runs of four words are taken as one (of two that share 83 % of all runs practically always, of two
that share a third about one in six). So a subtree of which nearly the whole article consists, on pages with little
else, counts as article copies and stays. Identical pages of a host count once. Inline elements in running text are part of
their sentence and stay.

Null html is empty; a url without a host belongs to host "". A page without ``article`` or ``main`` is read from its
whole body. Extra columns of ``pages`` are not carried.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from frota.llm.common import mixed, over_text, stored

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form button select textarea script style noscript template iframe svg object canvas dialog menu "
    "title audio video".split()
)
#: Names of classes, ids and roles that mark what is no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice "
    "newsletter subscribe subscription signup menu nav navbar navigation navigationlist breadcrumb breadcrumbs sidebar aside footer "
    "comment comments commentlist respond reply replies discussion disqus share sharing social related popup modal "
    "complementary contentinfo search widget masthead topbar pager pagination skip toolbar".split()
)
#: Words that mark a compound name (``comment-body``, ``site-footer``) where they are its first or last part.
PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies newsletter nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer comment comments disqus related".split()
)
#: Compounds with one of these parts say how a page is set up and mark nothing.
SETTINGS = frozenset("no not has with without hide is open closed on off enabled disabled".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body article main section div nav aside header footer td th form select".split())

_TAG = re.compile(
    r"<!-->|<!--->|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INERT = DROPPED - frozenset("nav footer aside form dialog menu".split())
_COMMENTS = frozenset("comment comments commentlist".split())
_PART = re.compile(r"[-_]+")
#: Minimum hashes of an article: 16 names of 4 each.
_BANDS = 16
_SEEDS = mixed(np.arange(1, 4 * _BANDS + 1, dtype=np.uint64)) | np.uint64(1)


class Node:
    __slots__ = ("tag", "marks", "children", "hidden", "digest", "worded", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.digest, self.worded, self.words = tag, [], 0, False, 0
        names, self.hidden = [], False
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                if key.lower() in ("hidden", "aria-hidden"):
                    self.hidden = self.hidden or value != "false"
                else:
                    names += value.split()
        self.marks = names

    def closed(self) -> None:
        """Hash of the subtree; children are closed before their parent."""
        digest = xxhash.xxh64(f"{self.tag}\0{' '.join(self.marks)}\0")
        for child in self.children:
            if isinstance(child, str):
                if words := child.split():
                    self.worded = True
                    self.words += 0 if self.tag in _INERT else len(words)
                    digest.update(" ".join(words).encode("utf-8", "surrogatepass") + b"\1")
            else:
                self.worded = self.worded or child.worded
                self.words += 0 if self.tag in _INERT else child.words
                digest.update(child.digest.to_bytes(8, "little") + b"\2")
        self.digest = digest.intdigest()


def parse(text: str) -> Node:
    """The element tree; end tags may be missing and stray ones are ignored."""
    root = Node("html", "")
    stack, open_tags, at = [root], {"html": 1}, 0

    def pop() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        node.closed()

    def close_to(tags: set[str]) -> None:
        """Close the innermost open element of ``tags`` unless a scope stands in between."""
        if not any(open_tags.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in _SCOPES:
                return

    last = text.rfind(">") + 1  # no tag ends behind it, so every "<" that could begin a tag before it does
    while True:
        found = _TAG.search(text, at, last)
        if found is None:
            open_comment = text.find("<!--", max(at, last))
            rest = text[at:] if open_comment < 0 else text[at:open_comment]
            if rest:
                stack[-1].children.append(rest)
            break
        if found.start() > at:
            stack[-1].children.append(text[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if found[1]:
            if open_tags.get(tag, 0) > (tag == "html"):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag == "html":
            continue
        if tag in BLOCKS and open_tags.get("p"):
            close_to({"p"})
        if tag in _CLOSES:
            close_to(_CLOSES[tag])
        node = Node(tag, found[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            stop = end.start() if end else len(text)
            node.children.append(text[at:stop])
            node.closed()
            if end:
                close = text.find(">", end.end() - 1)
                at = close + 1 if close >= 0 else len(text)
            else:
                at = len(text)
        elif tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            node.closed()
        else:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while stack:
        pop()
    return root


def _marked(names: list[str], words: frozenset[str], parts: frozenset[str]) -> bool:
    """Whether a name is one of ``words``, or a compound that begins or ends with one of ``parts``."""
    if not words.isdisjoint(names):
        return True
    for name in names:
        some = _PART.split(name)
        if len(some) > 1 and (some[0] in parts or some[-1] in parts) and SETTINGS.isdisjoint(some):
            return True
    return False


def _declared(node: Node, in_article: bool, by_name: bool = True, read: int = 0) -> bool:
    """Whether the markup says that this is no article; classes, ids and roles count only ``by_name``, and not on an
    element that holds nine tenths of the ``read`` words."""
    if node.tag in DROPPED or node.hidden:
        return True
    if node.tag == "header":
        return not in_article
    if node.tag in ("body", "html") or (read and 10 * node.words >= 9 * read):
        return False
    if node.tag in ("article", "main"):
        return _marked(node.marks, _COMMENTS, _COMMENTS)
    return by_name and (_marked(node.marks, MARKS, PARTS) or (not in_article and "header" in node.marks))


def _has_own_text(main: Node) -> bool:
    """Whether there is text in ``main`` outside its articles and outside what is declared."""
    queue = [main]
    while queue:
        for child in queue.pop().children:
            if isinstance(child, str):
                if child.strip():
                    return True
            elif child.worded and child.tag != "article" and not _declared(child, True):
                queue.append(child)
    return False


def _roots(root: Node) -> list[Node]:
    """The outermost articles, and mains with text outside their articles; the whole page without either, or if
    more words stand outside of them that nothing declares.

    Wrappers that look declared are searched where nothing stands outside of them, forms always.
    """
    for through in (False, True):
        found, queue = [], [root]
        while queue:
            node = queue.pop()
            hidden = _declared(node, False)
            if node.worded and not hidden and (node.tag == "article" or node.tag == "main" and _has_own_text(node)):
                found.append(node)
            elif not hidden or node.tag == "form" or (through and node.tag not in _INERT):
                queue += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found if _words_beside(root, found) <= sum(node.words for node in found) else [root]
    return [root]


def _words_beside(root: Node, roots: list[Node]) -> int:
    """Words outside ``roots`` and outside all that is declared."""
    words, queue, inside = 0, [root], set(map(id, roots))
    while queue:
        for child in queue.pop().children:
            if isinstance(child, str):
                words += len(child.split())
            elif child.worded and id(child) not in inside and not _declared(child, False):
                queue.append(child)
    return words


def _wrappers(root: Node) -> set[int]:
    """Forms around most of the words of a page that is read as a whole: they wrap it and are no part of it."""
    found, node = set(), root
    while node is not None:
        if node.tag == "form":
            found.add(id(node))
        node = next((c for c in node.children if isinstance(c, Node) and 2 * c.words > root.words), None)
    return found


def _running(parent: Node) -> bool:
    """Whether ``parent`` has words of its own, so that inline elements in it are parts of a sentence."""
    return any(isinstance(c, str) and c.strip() for c in parent.children)


def template_candidates(root: Node) -> tuple[set[int], set[int]]:
    """Hashes of the subtrees with text of a page, and those among them that stand in what would be extracted.

    An element inside running text is part of its sentence and no candidate, nor are the roots and what is around them.
    """
    roots = _roots(root)
    whole = roots == [root]
    every, inside, queue = set(), set(), [(root, whole, False)]
    starts, wrappers = set(map(id, roots)), _wrappers(root) if whole else set()
    while queue:
        node, within, running = queue.pop()
        start = id(node) in starts
        within = within or start
        if node.worded and not start and node.tag not in ("html", "body", "article", "main") and (node.tag in BLOCKS or not running):
            every.add(node.digest)
            if within and _declared(node, not whole, False) and id(node) not in wrappers:
                within = False
            if within:
                inside.add(node.digest)
        running = _running(node)
        queue += [(c, within, running) for c in node.children if isinstance(c, Node)]
    return every, inside


def article_bands(root: Node) -> list[int]:
    """Names of ``_BANDS`` groups of minimum hashes over the runs of four words inside the article or main.

    Articles that differ in few words have a name in common, others hardly ever. A page read as a whole has none: its
    template can be most of it, so it counts by itself.
    """
    roots = _roots(root)
    if roots == [root]:
        return []
    names, stack = [], list(reversed(roots))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            names += [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in item.split()]
        elif item.tag not in _INERT:
            stack += reversed(item.children)
    word = np.array(names, np.uint64)
    if len(word) >= 4:
        run = mixed(mixed(word[:-3], word[1:-2]), mixed(word[2:-1], word[3:]))
    else:
        run = mixed(np.array([zlib.crc32(word.tobytes())], np.uint64))
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(run), 4096):
        at = run[i : i + 4096, None] * _SEEDS
        least = np.minimum(least, (at ^ (at >> np.uint64(32))).min(axis=0))
    rows = least.reshape(_BANDS, -1)
    name = np.arange(_BANDS, dtype=np.uint64)
    for column in rows.T:
        name = mixed(name, np.ascontiguousarray(column))
    return name.view(np.int64).tolist()


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the article in page order, without what is declared or template."""
    blocks, now = [], []

    def flush() -> None:
        words = entities.unescape("".join(now)).split()
        if words:
            blocks.append(" ".join(words))
        now.clear()

    roots = _roots(root)
    whole = roots == [root]
    wrappers = _wrappers(root) if whole else set()
    read = sum(node.words for node in roots)
    for start in roots:
        stack: list = [(start, False, not whole)]
        while stack:
            item, running, within = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                now.append(item)
            elif item is not start and (
                (_declared(item, within, True, read) and id(item) not in wrappers)
                or (item.digest in template and (item.tag in BLOCKS or not running) and item.tag not in ("html", "body", "article", "main"))
            ):
                if item.tag in BLOCKS:
                    flush()
            elif item.tag == "br":
                now.append(" ")
            else:
                block = item.tag in BLOCKS
                if block:
                    flush()
                    stack.append((None, False, within))
                running = bool(template) and _running(item)
                within = within or item.tag in ("article", "main")
                stack += [(c, running, within) for c in reversed(item.children)]
        flush()
    return "\n\n".join(blocks)


def host(url: str = "url") -> Column:
    """Host name of a url, lower-cased, without user and port; "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


_EVERY = "host bigint, hash bigint, inside boolean"
_FOUND = "key bigint, host bigint, hashes array<bigint>, inside array<boolean>, bands array<bigint>"


def _signed(h: int) -> int:
    return h - (1 << 63)


def template_hashes(pages: DataFrame, min_pages: int) -> DataFrame:
    """(key, hashes): for pages (by content key) the hashes of their template subtrees inside the article, stored."""
    texts = pages.select("key", "_host", "html")

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, hashes, within = [], [], []
        for name, text in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            every, inside = template_candidates(parse(text or ""))
            hosts += [name] * len(every)
            hashes += map(_signed, every)
            within += [h in inside for h in every]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(within, pa.bool_())], names=["host", "hash", "inside"])

    # identical pages still count each here, so that rows shrink before they move: what is left out occurs too rarely
    counted = over_text(texts, listed, _EVERY, "html").groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
    often = stored(counted.where((F.col("n") >= min_pages) & F.col("inside")).select(F.col("host").alias("_h"), F.col("hash").alias("_x")), "html-recurring")
    if often.isEmpty():
        return pages.sparkSession.createDataFrame([], "key bigint, hashes array<bigint>")

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, name, text in zip(batch.column("key").to_pylist(), batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            root = parse(text or "")
            every, inside = template_candidates(root)
            every = list(every)
            rows.append((key, name, list(map(_signed, every)), [h in inside for h in every], article_bands(root) if inside else []))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "host", "hashes", "inside", "bands"])

    at = over_text(texts, found, _FOUND, "html").select("key", "host", "bands", F.inline(F.arrays_zip("hashes", "inside")))
    at = at.withColumnRenamed("hashes", "hash").join(often, (F.col("host") == F.col("_h")) & (F.col("hash") == F.col("_x")))
    at = stored(at.select("key", "host", "hash", "inside", "bands"), "html-occurrences")
    # an article stands for the articles of its host that nearly equal it: its name is the smallest key that shares a band
    bands = at.where("inside").groupBy("key", "host").agg(F.first("bands").alias("bands"))
    bands = stored(bands.select("key", "host", F.explode("bands").alias("band")), "html-bands")
    least = bands.groupBy("host", "band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("host").alias("_h"), F.col("band").alias("_b"), "least")
    same = bands.join(least, (F.col("host") == F.col("_h")) & (F.col("band") == F.col("_b"))).groupBy(F.col("key").alias("_k")).agg(F.min("least").alias("least"))
    around = at.join(same, F.col("key") == F.col("_k"), "left")
    around = around.select("host", "hash", F.when(F.col("inside"), F.coalesce("least", "key")).otherwise(F.col("key")).alias("around")).distinct()
    template = around.groupBy("host", "hash").count().where(F.col("count") >= min_pages).select(F.col("host").alias("_h"), F.col("hash").alias("_x"))
    marked = at.where("inside").join(template, (F.col("host") == F.col("_h")) & (F.col("hash") == F.col("_x")))
    return stored(marked.groupBy("key").agg(F.collect_set("hash").alias("hashes")), "html-template")


def extracted(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", F.xxhash64(host()).alias("_host"))
    pages = pages.withColumn("key", F.xxhash64("_host", F.coalesce("html", F.lit(""))))
    template = template_hashes(pages, min_pages).withColumnRenamed("key", "_k")
    # a small table is broadcast below Spark's own threshold; then no page is moved
    pages = pages.join(template, F.col("key") == F.col("_k"), "left").select("page_id", "url", "html", "hashes")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            main_text(parse(text or ""), frozenset(h + (1 << 63) for h in hashes or ()))
            for text, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return over_text(pages, work, "page_id bigint, url string, text string", "html")
