"""Raw web pages as blocks: headings, passages, lists, tables and images with their links, a row each.

A page is parsed by the standard library's tolerant tokenizer into a tree whose end tags close the
nearest open element of their name; unclosed elements last until an ancestor closes.  All state is within a
page, so pages parse in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = "https://en.wikipedia.org"
COMMONS = "https://commons.wikimedia.org"
#: Headings after which a page's own content has ended.
LAST_HEADINGS = ("References", "External links", "Notes", "See also")
#: Classes of a page's title, body, headings (before their level), tables that are read whole, and a notice that isn't read.
TITLE, BODY, HEADING = "firstHeading mw-first-heading", "mw-content-ltr mw-parser-output", "mw-heading"
WHOLE_TABLES, NOTICE = {"infobox", "wikitable"}, "box-More_citations_needed_section"
#: Where an image's own page shows it and says what it is.
FULL_IMAGE, SUMMARY_ID, SUMMARY_TABLE = "fullImageLink", "Summary", "vevent"

_LINK = "struct<text:string,hyperlink:string,start:int,end:int>"
_CELL = f"struct<text:string,links:array<{_LINK}>,header:boolean,image:string,ref:string>"
BLOCK = (
    "title string, pos int, cid string, kind string, section array<string>, text string, "
    f"links array<{_LINK}>, image string, n_columns int, cells array<array<{_CELL}>>, refs map<string,{_CELL}>"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; no recursion, as pages nest without bound."""
        open_ = [iter(self.kids)]
        while open_:
            for kid in open_[-1]:
                if isinstance(kid, Node):
                    yield kid
                    open_.append(iter(kid.kids))
                    break
            else:
                open_.pop()

    def find(self, *tags: str, cls: str | None = None) -> Node | None:
        return next(self.all(*tags, cls=cls), None)

    def all(self, *tags: str, cls: str | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags and (cls is None or set(cls.split()) <= set(n.classes)))

    def strings(self, skip: frozenset = frozenset()) -> Iterator[str]:
        open_ = [iter(self.kids)]
        while open_:
            for kid in open_[-1]:
                if isinstance(kid, str):
                    yield kid
                elif kid.tag not in skip:
                    open_.append(iter(kid.kids))
                    break
            else:
                open_.pop()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def rich_text(node: Node) -> tuple[str, list[dict]]:
    """Text and links of an element: a space before each string, white space inside as one space; notes (sup), styles and scripts are left out.

    Offsets of a link are those of its text.
    """
    parts, links, at = [], [], 0
    open_ = [iter([node])]
    while open_:
        kid = next(open_[-1], None)
        if kid is None:
            open_.pop()
        elif isinstance(kid, Node) and kid.tag == "a" and kid is not node:
            said = _squeeze("".join(kid.strings()))
            links.append({"text": said, "hyperlink": kid.attrs.get("href"), "start": at + 1, "end": at + 1 + len(said)})
            parts.append(" " + said)
            at += 1 + len(said)
        elif isinstance(kid, str):
            said = " " + _squeeze(kid)
            parts.append(said)
            at += len(said)
        elif kid.tag not in ("sup", "style", "script"):
            open_.append(iter(kid.kids))
    return "".join(parts), links


def list_text(node: Node) -> tuple[str, list[dict]]:
    """One line for each item, "- " before it; offsets are those in the whole."""
    lines, links, at = [], [], 0
    for item in (k for k in node.kids if isinstance(k, Node) and k.tag == "li"):
        said, inside = rich_text(item)
        links += [x | {"start": x["start"] + at + 2, "end": x["end"] + at + 2} for x in inside]
        lines.append("- " + said)
        at += len(lines[-1]) + 1
    return "\n".join(lines), links


def _span(node: Node, name: str) -> int:
    raw = node.attrs.get(name) or "1"
    return int(raw) if raw.isdecimal() else 1


def table_cells(node: Node) -> tuple[list[list[dict]], dict[str, dict], int]:
    """Rows of cells, spanning cells by number, and the width of the first row.

    A cell over several columns or rows is kept once among the references;
    each place that it covers refers to it.
    """
    rows, refs, pending, width = [], {}, {}, 0
    for r, tr in enumerate(node.all("tr")):
        due, row = pending.pop(r, {}), []
        for td in tr.all("th", "td"):
            while len(row) in due:
                row.append({"ref": due.pop(len(row))})
            said, links = rich_text(td)
            img = td.find("img")
            src = img.attrs.get("src") if img else None
            cell = {"text": said, "links": links, "header": td.tag == "th", "image": src and (src if "https://" in src else SITE + src), "ref": None}
            across, down = _span(td, "colspan"), _span(td, "rowspan")
            if across < 2 and down < 2:
                row.append(cell)
                continue
            name = str(len(refs) + 1)
            refs[name] = cell
            for later in range(r + 1, r + down):
                pending.setdefault(later, {}).update({len(row) + k: name for k in range(across)})
            row += [{"ref": name}] * across
        while len(row) in due:
            row.append({"ref": due.pop(len(row))})
        rows.append(row)
        if r == 0:
            width = len(row)
    return rows, refs, width


def _leaf_tables(node: Node) -> list[Node]:
    return [t for t in node.all("table") if t.find("table") is None]


def _title(page: Node) -> str:
    head = page.find("h1", cls=TITLE) or page.find("h1")
    return " ".join(s.strip() for s in head.strings()) if head else ""


def _content(page: Node, url: str) -> tuple[list[Node], bool]:
    """The elements of a page's body, and whether plain h2 to h6 count as headings there."""
    body = page.find("div", cls=BODY)
    if COMMONS in url:
        full = page.find("div", cls=FULL_IMAGE)
        summary = next((n for n in page.all("h2") if n.attrs.get("id") == SUMMARY_ID), None)
        found = [full.find("img") if full else None, summary, page.find("table", cls=SUMMARY_TABLE)]
        return [n for n in found if n is not None], False
    if body is None:
        body = page.find("article") or page.find("body") or page
        return [k for k in body.kids if isinstance(k, Node)], True
    elements = lambda n: [k for k in n.kids if isinstance(k, Node)]
    if SITE not in url:  # the mobile site, with a section around each heading's content
        return [x for kid in elements(body) for x in (elements(kid) if kid.tag == "section" else [kid])], False
    out, queue = [], elements(body)[::-1]
    while queue:
        kid = queue.pop()
        if kid.tag == "meta":
            queue += elements(kid)[::-1]
        else:
            out.append(kid)
    return out, False


def _heading(node: Node, plain: bool) -> tuple[int, str] | None:
    """Level and text, if the element is a heading."""
    if node.tag == "div" and any(c.startswith(HEADING) for c in node.classes):
        levels = [c.removeprefix(HEADING) for c in node.classes if c.startswith(HEADING)]
        level = next((int(x) for x in levels if x.isdecimal()), 2)
        head = node.find("h2", "h3", "h4", "h5", "h6")
        return level, "".join(head.strings()).strip() if head else "Unknown"
    if plain and node.tag in ("h2", "h3", "h4", "h5", "h6"):
        return int(node.tag[1]), "".join(node.strings()).strip()
    return None


def blocks(url: str | None, html: str | None) -> list[dict]:
    """The blocks of one page in order; none for a page without HTML.

    Passages are po_<i> and lists pl_<i> on one counter, tables t_<i>, images
    i_<i>, headings h<level - 2>_<i> and the title h1_1.  section holds the
    headings above a block.  A layout table gives its innermost tables.
    """
    if not html:
        return []
    page = tree(html)
    title, (content, plain) = _title(page), _content(page, url or "")
    out: list[dict] = []
    count = dict.fromkeys("hpti", 0)
    path: list[str | None] = []

    def emit(letter: str, prefix: str, kind: str, **rest) -> None:
        count[letter] += 1
        out.append({"title": title, "pos": len(out), "cid": f"{prefix}_{count[letter]}", "kind": kind, "section": [p for p in path if p is not None]} | rest)

    def table(node: Node) -> None:
        cells, refs, width = table_cells(node)
        caption = node.find("caption")
        emit("t", "t", "table", text="".join(caption.strings()).strip() if caption else None, links=[], n_columns=width, cells=cells, refs=list(refs.items()))

    out.append({"title": title, "pos": 0, "cid": "h1_1", "kind": "title", "section": [], "text": title, "links": []})
    for node in content:
        head = _heading(node, plain)
        if head:
            level, said = head
            emit("h", f"h{level - 2}", "heading", text=said, links=[])
            if said in LAST_HEADINGS:
                break
            depth = max(level - 2, 0)
            path = [*path[:depth], *[None] * (depth - len(path)), said]
        elif node.tag == "p":
            said, links = rich_text(node)
            emit("p", "po", "passage", text=said, links=links)
        elif node.tag == "ul":
            said, links = list_text(node)
            emit("p", "pl", "list", text=said, links=links)
        elif node.tag in ("figure", "img"):
            img, caption = (node if node.tag == "img" else node.find("img")), node.find("figcaption")
            said, links = rich_text(caption) if caption else ("", [])
            src = img.attrs.get("src") if img else None
            emit("i", "i", "image", text=said, links=links, image=src and SITE + src)
        elif node.tag == "table" and NOTICE in node.classes:
            continue
        elif node.tag == "table" and (WHOLE_TABLES & set(node.classes) or node.find("table") is None):
            table(node)
        else:
            for inner in _leaf_tables(node):
                table(inner)
    return out


def _arrow(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], BLOCK).schema)


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The blocks of all pages, with the page's id before them; see blocks()."""
    made = _arrow(pages.sparkSession)
    kept = pages.select(id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, rows = [], []
                for k, (url, html) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    found = blocks(url, html)
                    rows += found
                    ids += [k] * len(found)
                table = pa.RecordBatch.from_pylist(rows, schema=made)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int64())), *table.columns], names=[id_col, *made.names])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, {BLOCK}")


def anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, k, text, hyperlink): every link of a whole page with an address, menus included, in order from 0."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [
                    (row, k, _squeeze("".join(a.strings())), a.attrs["href"])
                    for row, page in enumerate(part.column(1).to_pylist())
                    for k, a in enumerate(n for n in tree(page or "").all("a") if n.attrs.get("href") is not None)
                ]
                rows, ks, texts, hrefs = zip(*found, strict=True) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(ks, pa.int32()), pa.array(texts, pa.string()), pa.array(hrefs, pa.string())], names=[id_col, "k", "text", "hyperlink"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, k int, text string, hyperlink string")


def links(parsed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, cid, text, hyperlink, start, end): every link of passages, lists, captions and cells; those in cells have the offsets of their cell."""
    own = parsed.select(id_col, "cid", F.explode("links").alias("l"))
    cells = F.flatten(F.transform(F.flatten(F.coalesce("cells", F.array())), lambda c: F.coalesce(c["links"], F.array())))
    spans = F.flatten(F.transform(F.map_values("refs"), lambda c: c["links"]))
    inside = parsed.where("kind = 'table'").select(id_col, "cid", F.explode(F.concat(cells, F.coalesce(spans, F.array()))).alias("l"))
    return own.unionByName(inside).select(id_col, "cid", "l.text", "l.hyperlink", "l.start", "l.end")
