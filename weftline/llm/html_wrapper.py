"""HTML extraction by wrapper induction.

Pages of one host are aligned by the paths of their containers: a slot is a path of
labels and its number among the page's containers of that path. Slots whose text is
the same on all pages that have them are the host's template, all others are content.
A host's wrapper is the set of its template slots; a page's text is what stands in its
other slots outside menus, headers, footers, notices, adverts and the like. A page
whose host has no other page, or of which nothing would be left, falls back on its own
article, main or body element.

Every page takes part: a slot needs only the least and greatest hash of its texts,
pages and titles, which are merged from anywhere.
"""

from __future__ import annotations

import html as _html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bound_batches, checkpointed, fresh, slices

#: Wrappers are broadcast up to so many bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never article text.
DROP = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select input textarea dialog menu audio video map".split())
#: Names of classes, ids and roles of adverts, notices, menus beside the text and reader comments: as a whole name anywhere.
ANYWHERE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent notice gdpr comment comments disqus newsletter subscribe".split())
#: Names that mark page furniture outside articles, as the first or last part of one too; inside they may be what the article is about.
FURNITURE = ANYWHERE | frozenset("promo promotion menu share sharing social related recommended popup modal login search pagination pager".split())
OUTSIDE = frozenset("header masthead topbar".split())
#: An element of the first kind is closed by a start tag of the second.
CLOSES = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: A comment (`<!-->` is a whole one), declaration or well-formed tag. No part of a tag runs over `<` or `>`, and attributes are never read another way once read, so each place is read a few times at most.
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"'=]*+=[ \t\n]*+(?>"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]*+))*+[^<>"'=]*+)>)""", re.S)
#: The beginning of a tag of any form, and one attribute of it.
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?(\s*=\s*)?""")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[-_]+")


class _Tags:
    """Tags of a page in order, read as browsers do: a quoted value may hold anything, an unquoted one may hold quotes."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int):
        """(start, end, whether it closes, name, attributes) of the next tag from `at` on; the name is None for a comment. None at the end."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            m = _TAG.match(page, at)
            if m:
                return at, m.end(), bool(m[1]), m[2], m[3]
            m = _OPEN.match(page, at)
            if m:
                end, marks = self._attributes(m.end())
                return at, end, bool(m[1]), m[2], marks
            at += 1

    def _attributes(self, at: int) -> tuple[int, str]:
        page, size, marks = self.page, len(self.page), []
        while at < size and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            name, at = m[1], max(m.end(), at + (m.end() == at))
            if m[2] is None or at >= size:
                if name is None and m.end() == m.start():
                    continue
                marks.append(name or "")
                continue
            quote = page[at]
            if quote in self.last and self.last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:  # unquoted, or a quote that nothing closes
                end = at
                while end < size and page[end] != ">" and not page[end].isspace():
                    end += 1
                value, at = page[at:end], end
            if (name or "").lower() in ("class", "id", "role"):
                marks.append(f'{name}="{value.replace(chr(34), " ")}"')
        closed = "/" if page[at - 1 : at] == "/" else ""
        return min(size, at + 1), " ".join(marks) + closed


class Node:
    __slots__ = ("tag", "label", "marks", "items")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.items, self.label, self.marks = tag, [], tag, frozenset()
        if attrs and not attrs.isspace():
            names = [(kind.lower(), (a or b or c).lower().split()) for kind, a, b, c in _MARK.findall(attrs)]
            classes = next((sorted(n) for kind, n in names if kind == "class"), None)
            if classes is not None:
                self.label = f"{tag}.{'.'.join(classes)}"
            self.marks = frozenset(x for _, n in names for x in n)

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """A tree of elements; text lies between them undecoded. Open elements end with their parent."""
    root, tags = Node("#root"), _Tags(page)
    stack, at, size = [root], 0, len(page)
    while at < size:
        found = tags.after(at)
        if found is None:
            stack[-1].items.append(page[at:])
            break
        start, end, closing, tag, attrs = found
        if start > at:
            stack[-1].items.append(page[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE and tag != "br":
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t in CLOSES:
                    if CLOSES[t] is None or tag in CLOSES[t]:
                        del stack[i:]
                    break
                if t not in INLINE:
                    break
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.items.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else size
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element is none of the article's; `inside`: it stands in an article."""
    if node.tag in DROP or node.marks & ANYWHERE:
        return True
    if inside or not node.marks and node.tag != "header":
        return False
    if node.tag == "header" or node.marks & (FURNITURE | OUTSIDE):
        return True
    return any({p[0], p[-1]} & (FURNITURE | OUTSIDE) for p in map(_SPLIT.split, node.marks))


def blocks(node: Node, inside: bool = True) -> list[str]:
    """Texts of the blocks under `node` in page order, white space folded, references decoded."""
    out, run = [], []

    def flush():
        text = " ".join(_html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    # an explicit stack: pages may nest deeper than Python's calls
    todo = [(node, inside, 0)]
    while todo:
        x, within, i = todo.pop()
        if i < len(x.items):
            todo.append((x, within, i + 1))
            y = x.items[i]
            if isinstance(y, str):
                run.append(y)
            elif y.tag == "br":
                run.append(" ")
            elif not furniture(y, within):
                if y.tag not in INLINE:
                    flush()
                todo.append((y, within or y.tag in ("article", "main"), 0))
            elif y.tag not in INLINE:
                flush()
        elif x.tag not in INLINE:
            flush()
    flush()
    return out


#: Paragraph-like nodes are text of their parent: they are not slots of their own.
_LEAF = frozenset("p li dt dd tr td th br hr h1 h2 h3 h4 h5 h6 pre blockquote".split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def slots(root: Node) -> tuple[list[tuple[str, ...]], list[int], list[tuple[int, str]]]:
    """Of a page outside furniture: the paths and the slot hashes of containers, and (container, block) in page order."""
    paths, keys, seen, out, run = [], [], {}, [], []

    def container(path: tuple[str, ...]) -> int:
        k = seen[path] = seen.get(path, -1) + 1
        paths.append(path)
        keys.append(_hash(f"{k} {' '.join(path)}"))
        return len(paths) - 1

    def flush(owner: int):
        text = " ".join(_html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append((owner, text))

    todo = [(root, False, 0, container((root.label,)), False)]
    while todo:
        x, within, i, owner, leaf = todo.pop()
        if i < len(x.items):
            todo.append((x, within, i + 1, owner, leaf))
            y = x.items[i]
            if isinstance(y, str):
                run.append(y)
            elif y.tag == "br":
                run.append(" ")
            elif y.tag in RAW or furniture(y, within):
                if y.tag not in INLINE:
                    flush(owner)
            else:
                if y.tag not in INLINE:
                    flush(owner)
                # what a paragraph or an inline element holds is its text
                inner = leaf or y.tag in _LEAF or y.tag in INLINE
                todo.append((y, within or y.tag in ("article", "main"), 0, owner if inner else container((*paths[owner], y.label)), inner))
        elif x.tag not in INLINE:
            flush(owner)
    flush(0)
    return paths, keys, out


def slot_texts(root: Node) -> dict[int, tuple[tuple[str, ...], str]]:
    """Path and text (its own and its paragraphs') of each slot that has text."""
    paths, keys, found = slots(root)
    texts: dict[int, list[str]] = {}
    for owner, text in found:
        texts.setdefault(owner, []).append(text)
    return {keys[o]: (paths[o], "\n".join(t)) for o, t in texts.items()}


def induce(pages: list[str]) -> list[str] | None:
    """The path of labels to the lowest container of all varying slots of pages of one host, or None where nothing varies."""
    texts: dict[int, set[str]] = {}
    paths = {}
    for page in pages:
        for key, (path, text) in slot_texts(parse(page)).items():
            paths[key] = path
            texts.setdefault(key, set()).add(text)
    varying = [paths[k] for k, t in texts.items() if len(t) > 1]
    if not varying:
        return None
    n = 0
    while n < min(map(len, varying)) and len({v[n] for v in varying}) == 1:
        n += 1
    return list(varying[0][:n])


def _title(root: Node) -> str:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag == "title":
            return "".join(x for x in n.items if isinstance(x, str))
        todo += reversed(n.children())
    return ""


def _first(root: Node, tags: tuple[str, ...]) -> list[Node]:
    """Outermost elements of `tags`, outside furniture."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            out.append(n)
        elif n is root or not furniture(n, False):
            todo += reversed(n.children())
    return out


def extract(page: str | None, template: frozenset[int] | None = None) -> str:
    """The main text of a page: blocks of the slots that aren't the host's template, else of article, main, body or all."""
    if not page:
        return ""
    root = parse(page)
    if template is not None:
        _, keys, found = slots(root)
        made = [text for owner, text in found if keys[owner] not in template]
        if made:
            return "\n".join(made)
    for nodes in (_first(root, ("article",)), _first(root, ("main",)), _first(root, ("body",)), [root]):
        if nodes:
            made = [b for n in nodes for b in blocks(n, inside=n.tag in ("article", "main"))]
            if made:
                return "\n".join(made)
    return ""


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the template slots of each host with at least two different pages and a varying slot, as a JSON list of hashes.

    Pages of one title that differ elsewhere don't make a template while the host has
    other titles, so that copies of a page don't pass for one.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    # pages without a host have nothing in common
    keyed = pages.select(host.alias("host"), F.col(html_col).alias("html")).where("html is not null and host <> ''")

    def told(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for name, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    root = parse(page)
                    whole, title = _hash(page), _hash(_title(root))
                    rows += [(name, key, _hash(text), whole, title) for key, (_, text) in slot_texts(root).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(5)], names=["host", "slot", "text", "page", "title"])

    rows = keyed.mapInArrow(told, "host string, slot long, text long, page long, title long")
    ends = lambda *cs: [f(c).alias(f"{c}_{n}") for c in cs for f, n in ((F.min, "a"), (F.max, "z"))]
    slot = rows.groupBy("host", "slot").agg(*ends("text", "page", "title"))
    same = F.expr("text_a = text_z and page_a < page_z")
    of_host = slot.groupBy("host").agg(
        F.collect_list(F.when(same, F.col("slot"))).alias("loose"), F.collect_list(F.when(same & F.expr("title_a < title_z"), F.col("slot"))).alias("strict"), F.max(F.expr("text_a < text_z")).alias("varies"),
        F.expr("min(title_a) < max(title_z)").alias("titled"),
    )
    return of_host.where("varies").select("host", F.to_json(F.array_sort(F.when(F.col("titled"), F.col("strict")).otherwise(F.col("loose")))).alias("path"))


def add_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", name: str = "main", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`pages` with a struct column `name`: text and n_chars of the main text.

    Null or empty html gives an empty text; a page whose url is null or without a host
    is read by itself. Rows repeat as they are, copies of a page count as one for its
    host's wrapper, pages of any length are read whole, broken tags as browsers read them. Hosts are told
    apart by their names in lower case. An empty table gives none. Other columns pass through, and one
    named like `name` gets company with underscores in front.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    found = checkpointed(wrappers(pages, url_col=url_col, html_col=html_col))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("path")).cast("long")).first()[0] or 0
    host, path = fresh(pages, "host"), fresh(pages, "path")
    keyed = pages.withColumn(host, F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1)))
    told = found.select(F.col("host").alias(host), F.col("path").alias(path))
    if size <= broadcast_bytes:
        told = F.broadcast(told)  # its size has just been measured
    both = fresh(pages, "both")
    joined = keyed.join(told, host, "left").withColumn(both, F.concat(F.coalesce(F.col(path), F.lit("")), F.lit("\n"), F.coalesce(F.col(html_col), F.lit("")))).drop(host, path)
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        known: dict[str, frozenset[int]] = {}

        def one(column):
            texts = []
            for x in column.to_pylist():
                head, _, page = x.partition("\n")
                if head and head not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[head] = frozenset(json.loads(head))
                texts.append(extract(page, known.get(head)))
            return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

        return one

    return annotate(joined, both, make, kind, fresh(joined, name)).drop(both)
