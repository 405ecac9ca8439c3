"""From parsed documents to a graph of components: segments, sentences, links and their edges.

Components have (doc, cid): a document and an id by the grammar of
functions.ids.  Every operator is a few joins on these keys; nothing is
gathered beyond one paragraph or table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..functions import ids

#: Fixed value: what link targets without a site are on.
SITE = "https://en.wikipedia.org"
#: Fixed value: where images' thumbnails are kept.
THUMBS = "https://upload.wikimedia.org"
#: Fixed value: the folder that sub-images lie under.
SUBIMAGES = "imagesProcessed_sub/"
#: Characters of a stretch of a paragraph.
REACH = 256
#: The default sentence: up to the last of a run of full stops, question or exclamation marks, with the space behind it.
SENTENCE = r"[^.!?]+[.!?]*\s*"


def decoded(url: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus sign stays one.  A URL with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def full_url(link: Column, site: str = SITE) -> Column:
    """The link with a site before it if it names none, decoded; null for an empty link."""
    return F.when(F.length(link) > 0, decoded(F.when(link.contains(site), link).otherwise(F.concat(F.lit(site), link))))


def dereference(links: DataFrame, titles: DataFrame, documents: DataFrame, link_col: str = "hyperlink", site: str = SITE) -> DataFrame:
    """links with edge, the file that each points to; links to unknown pages or to pages that are not documents go.

    titles is (url, title), each url once; documents has title.
    """
    known = titles.join(documents.select(F.col("title").alias("t")).distinct(), F.col("title") == F.col("t"), "left_semi")
    known = known.select(F.col("url").alias("known_url"), F.concat("title", F.lit(".json")).alias("edge"))
    return links.join(known, full_url(F.col(link_col), site) == F.col("known_url")).drop("known_url")


def thumbnail(url: Column) -> Column:
    """The last thumbnail address within a URL; null without one."""
    return F.when(url.contains(THUMBS), F.concat(F.lit(THUMBS), F.substring_index(url, THUMBS, -1)))


def resolve_images(images: DataFrame, thumbs: DataFrame, files: DataFrame, url_col: str = "image") -> DataFrame:
    """images with filename, null if the map (url, name) has no file for it or the file (name) is not there."""
    there = files.select(F.col("name").alias("f")).distinct()
    known = thumbs.join(there, F.col("name") == F.col("f"), "left_semi").select(F.col("url").alias("thumb"), F.col("name").alias("filename"))
    return images.join(known, thumbnail(F.col(url_col)) == F.col("thumb"), "left").drop("thumb")


def subimage_path(path: Column) -> Column:
    """What follows the sub-images' folder."""
    return F.substring_index(path, SUBIMAGES, -1)


def caption(text: Column) -> Column:
    return F.coalesce(text, F.lit(" "))


def table_segments(tables: DataFrame, cells_col: str = "cells") -> DataFrame:
    """One row for each data row of a table, cid <table>_s<i>, cells the header row and that row; other columns are kept.

    Tables without a data row give none.
    """
    others = [c for c in tables.columns if c not in ("cid", cells_col)]
    rows = tables.select(*others, "cid", F.col(cells_col)[0].alias("head"), F.posexplode(F.slice(cells_col, 2, 2**30)).alias("at", "row"))
    return rows.select(*others, F.concat("cid", F.lit("_s"), F.col("at") + 1).alias("cid"), F.array("head", "row").alias(cells_col))


def split_sentences(text: Column) -> Column:
    """Sentences of a text by SENTENCE; all of it if nothing matches; no empty ones."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.when(F.size(found) > 0, found).otherwise(F.array(text)), lambda s: s != "")


def sentences(paragraphs: DataFrame, splitter=split_sentences) -> DataFrame:
    """(doc, cid, pos, text): the sentences of paragraphs (doc, cid, text), cid <paragraph>_s<i>; splitter maps a text column to an array column."""
    found = paragraphs.select("doc", "cid", F.posexplode(splitter(F.col("text"))).alias("pos", "s"))
    return found.select("doc", F.concat("cid", F.lit("_s"), F.col("pos") + 1).alias("cid"), "pos", F.col("s").alias("text"))


def _loose(said: str) -> re.Pattern:
    """A pattern for a text with any white space, or none, where it has some."""
    return re.compile(r"\s*".join(map(re.escape, re.split(r"\s+", said.strip(" "), flags=re.A))), re.A)


def _starts(whole: str, said: list[str]) -> list[int]:
    """Where each of said stands first in whole; all are searched at once, so that the work grows with the text."""
    automaton = ahocorasick.Automaton()
    for x in said:
        automaton.add_word(x, x)
    first: dict[str, int] = {}
    if said:
        automaton.make_automaton()
        for end, x in automaton.iter(whole):
            first.setdefault(x, end + 1 - len(x))
    for x in said:
        if x not in first:
            m = _loose(x).search(whole)
            if not m:
                raise ValueError(f"sentence not in its paragraph: {x[:80]!r}")
            first[x] = m.start()
    return [first[x] for x in said]


def located(sentences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """sentences with para and start, the offset of the first place in the paragraph where they stand; an error if there is none.

    Equal sentences of a paragraph have the same start.  A paragraph meets its sentences once, as a list; sentences
    without a paragraph go.
    """
    s = sentences.withColumn("para", ids.highest(F.col("cid")))
    held = s.groupBy(F.col("doc").alias("_doc"), F.col("para").alias("_para")).agg(F.collect_list(F.struct(*[F.col(c) for c in s.columns])).alias("_rows"))
    p = paragraphs.select(F.col("doc").alias("d"), F.col("cid").alias("c"), F.col("text").alias("whole"))
    both = held.join(p, (F.col("_doc") == F.col("d")) & (F.col("_para") == F.col("c")))

    @F.pandas_udf("array<int>")
    def starts(whole: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([_starts(w, list(x)) for w, x in zip(whole, said, strict=True)])

    found = both.select("_rows", starts("whole", F.transform("_rows", lambda r: r["text"])).alias("_starts"))
    each = found.select(F.posexplode("_rows").alias("_k", "_r"), "_starts")
    return each.select("_r.*", F.get("_starts", F.col("_k")).alias("start"))


def edges_to_sentences(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, cid, start, end, ...): each edge of a paragraph (doc, para, start, end, ...) at the first sentence that holds it, with its offsets there.

    placed is what located() gives.  Edges across sentences go.  The join is
    on the paragraph and the stretch of REACH characters that the edge starts
    in, so that a long paragraph doesn't meet all of its sentences with all of its edges.
    """
    s = placed.select(F.col("doc").alias("sd"), F.col("para").alias("sp"), "cid", F.col("start").alias("from"), (F.col("start") + F.length("text")).alias("to"))
    s = s.select("*", F.explode(F.sequence(F.expr(f"from div {REACH}"), F.expr(f"to div {REACH}"))).alias("at"))
    rest = [c for c in edges.columns if c not in ("doc", "para", "start", "end")]
    keyed = edges.withColumn("edge_at", F.expr(f"start div {REACH}"))
    same = (F.col("doc") == F.col("sd")) & (F.col("para") == F.col("sp")) & (F.col("edge_at") == F.col("at"))
    held = keyed.join(s, same & (F.col("from") <= F.col("start")) & (F.col("end") <= F.col("to")))
    # Grouped by the keys of the join and more, so that rows stay where the join has put them. Repeated edges
    # stay: they are counted before the first sentence is chosen.
    key = ["doc", "para", "edge_at", "start", "end", *rest]
    times = held.groupBy(*key, "cid", "from").agg(F.count("*").alias("n"))
    best = times.groupBy(*key).agg(F.min(F.struct("from", F.length("cid").alias("l"), "cid", "n")).alias("b"))
    once = best.select("doc", "start", "end", *rest, F.col("b.cid").alias("cid"), F.col("b.from").alias("from"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("b.n"))).alias("copy"))
    return once.select("doc", "cid", (F.col("start") - F.col("from")).alias("start"), (F.col("end") - F.col("from")).alias("end"), *rest)


def _spaced(text: Column) -> Column:
    """The words of text, runs of a-z and 0-9 in lower case, with spaces between."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")


def edges_to_propositions(propositions: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, cid, text, edge, hyperlink): each edge (doc, para, text, edge, hyperlink) of a paragraph at all of its propositions (doc, cid, text) that have the anchor's words.

    An anchor of punctuation only is in every proposition.  A paragraph's
    propositions and edges are gathered and its words indexed, so that the work grows
    with the paragraph and what is found, not with edges times propositions.
    """
    p = propositions.select("doc", ids.highest(F.col("cid")).alias("para"), F.struct("cid", _spaced(F.col("text")).alias("said")).alias("prop"))
    e = edges.where("text is not null").select("doc", "para", F.struct("text", "edge", "hyperlink", _spaced(F.col("text")).alias("want")).alias("link"))
    # A proposition of null text holds no anchor, not even one without words.
    both = p.where("prop.said is not null").unionByName(e, allowMissingColumns=True).where("doc is not null and para is not null")
    met = both.groupBy("doc", "para").agg(F.collect_list("prop").alias("props"), F.collect_list("link").alias("links")).where("size(props) > 0 and size(links) > 0").drop("para")
    schema = T.StructType([met.schema["doc"], propositions.schema["cid"], *[edges.schema[c] for c in ("text", "edge", "hyperlink")]])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                places: dict[str, set[int]] = {}
                for i, x in enumerate(r["props"]):
                    for word in x["said"].split():
                        places.setdefault(word, set()).add(i)
                for x in r["links"]:
                    want = x["want"].split()
                    if not all(w in places for w in want):
                        continue
                    for i in sorted(set.intersection(*[places[w] for w in want])) if want else range(len(r["props"])):
                        yield r["doc"], r["props"][i]["cid"], x["text"], x["edge"], x["hyperlink"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while some := list(islice(rows, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=schema.names)

    return met.mapInArrow(run, schema)


def subimages(images: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, cid, path, ...): sub-images of images (doc, cid, filename, ...) from files (folder, name); the folder is the image's name without ending.

    A sub-image's number is what stands before the first _ of its name;
    drawings of boxes and lists of detections are none.
    """
    mine = files.where(~F.col("name").isin("BOXED.png", "boxed.png", "detections.json")).select("folder", "name")
    both = images.where("filename is not null").join(mine, ids.stem(F.col("filename")) == F.col("folder"))
    number = F.substring_index("name", "_", 1)
    others = [c for c in images.columns if c not in ("doc", "cid", "filename")]
    return both.select("doc", F.concat("cid", F.lit("_s"), number).alias("cid"), F.concat("folder", F.lit("/"), "name").alias("path"), *others)


def inter_edges(edges: DataFrame) -> DataFrame:
    """(doc, cid, edge), each once: files that components (doc, cid, edge) link to."""
    return edges.where("edge is not null").select("doc", "cid", "edge").distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    """(modality, n): edges by the modality of their component."""
    return edges.groupBy(ids.modality(F.col("cid")).alias("modality")).agg(F.count("*").alias("n"))


def component_statistics(components: DataFrame) -> DataFrame:
    """(modality, n, per_doc): components by modality and in all, with the mean over all documents."""
    docs = components.agg(F.count_distinct("doc").alias("docs"))
    by = components.rollup(ids.modality(F.col("cid")).alias("modality")).agg(F.count("*").alias("n"), F.grouping_id().alias("all"))
    return by.crossJoin(F.broadcast(docs)).select(F.when(F.col("all") == 1, "all").otherwise(F.col("modality")).alias("modality"), "n", (F.col("n") / F.col("docs")).alias("per_doc"))  # docs is one row


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct keys with pos, in the order of their first row."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy(keys[0]).orderBy("first"))).drop("first")


def pending(work: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """What of work is not among done; all of it where results are to be made anew."""
    return work if overwrite else work.join(done.select(key).distinct(), key, "left_anti")


def components(parsed: DataFrame, doc_col: str = "page_id") -> DataFrame:
    """(doc, cid, title, section, text, modality): the components among parsed blocks, without headings."""
    held = parsed.where(F.col("kind").isin("passage", "list", "table", "image"))
    return held.select(F.col(doc_col).alias("doc"), "cid", "title", "section", "text", ids.modality(F.col("cid")).alias("modality"))


def children_of(parents: DataFrame, low: DataFrame) -> DataFrame:
    """(doc, top, cid): lower components (doc, cid) of each of parents (doc, cid); of a paragraph, its sentences only."""
    p = parents.select(F.col("doc").alias("pd"), ids.highest(F.col("cid")).alias("top")).distinct()
    c = low.where(~ids.is_top(F.col("cid")))
    both = c.join(p, (F.col("doc") == F.col("pd")) & (ids.highest(F.col("cid")) == F.col("top")))
    return both.where(~F.col("top").startswith("p") | (F.instr("cid", "s") > 0)).select("doc", "top", "cid")

#: Characters of passages that are broadcast at once.
HELD = 4_000_000


def _rounds(passages: DataFrame, most: int) -> Iterator[dict[str, list]]:
    """The passages with their item_ids, in rounds of at most `most` characters, or of one passage."""
    named: dict[str, list] = {}
    size = 0
    for r in passages.where("passage <> ''").toLocalIterator():
        new = 0 if r.passage in named else len(r.passage)
        if named and size + new > most:
            yield named
            named, size = {}, 0
            new = len(r.passage)
        named.setdefault(r.passage, []).append(r.item_id)
        size += new
    if named:
        yield named


def containing(docs: DataFrame, passages: DataFrame, most: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id), once each for a row of docs: documents and the passages (item_id, passage) that their text contains.

    The passages make an automaton, through which each text goes once.  At most `most` characters of passages are
    broadcast at once; more take as many rounds over the documents.  Empty and null ones are in no text.
    """
    schema = T.StructType([docs.schema[id_col], passages.schema["item_id"]])
    item = to_arrow_type(passages.schema["item_id"].dataType)
    context = docs.sparkSession.sparkContext

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for passage, ids in held.value.items():
                automaton.add_word(passage, ids)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    inside = {i for _, ids in automaton.iter(text or "") for i in ids}
                    at += [k] * len(inside)
                    found += sorted(inside)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, item)], names=[id_col, "item_id"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    out = None
    for named in _rounds(passages, most):
        part = search(context.broadcast(named))
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


#: The kinds of components that a parsed document holds, with their layer.
KINDS = {"text": "top", "table": "top", "image": "top", "sentence": "low", "proposition": "low", "table_segment": "low", "subimage": "low"}


def document_components(docs: DataFrame, doc_col: str = "file") -> DataFrame:
    """(doc, cid, kind, level, text): all components of parsed documents, whose columns of KINDS are maps from id to a struct.

    A kind without a column is an error, as a document must say that it has
    none.  text is that of the struct, its caption's text, or null for a table.
    """
    missing = sorted(set(KINDS) - set(docs.columns))
    if missing:
        raise KeyError(f"documents have no {', '.join(missing)}")
    out = None
    for kind, level in KINDS.items():
        fields = docs.schema[kind].dataType.valueType.fieldNames()
        text = F.col("value.text") if "text" in fields else F.col("value.caption.text") if "caption" in fields else F.lit(None)
        part = docs.select(F.col(doc_col).alias("doc"), F.explode(kind).alias("cid", "value"))
        part = part.select("doc", "cid", F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.cast("string").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def with_cell_images(tables: DataFrame, thumbs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """tables with their cells' and references' image addresses replaced by file names; null where there is no such file.  keys name a table."""
    asked = tables.select(*keys, F.explode(F.array_distinct(F.concat(F.transform(F.flatten("cells"), lambda c: c["image"]), F.transform(F.map_values("refs"), lambda c: c["image"])))).alias("_url"))
    found = resolve_images(asked.where("_url is not null"), thumbs, files, "_url").where("filename is not null")
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_url", "filename")))).alias("_files"))
    name = lambda c: c.withField("image", F.try_element_at("_files", c["image"]))
    both = tables.join(maps, keys, "left").withColumn("_files", F.coalesce("_files", F.create_map().cast("map<string,string>")))
    both = both.withColumn("cells", F.transform("cells", lambda row: F.transform(row, name)))
    return both.withColumn("refs", F.transform_values("refs", lambda _, c: name(c))).drop("_files")


def table_edges(tables: DataFrame, titles: DataFrame, documents: DataFrame, site: str = SITE) -> DataFrame:
    """(doc, cid, place, text, hyperlink, edge): the links in cells and references of tables that point to documents.

    Cells and references have links, an array of (text, hyperlink); place is row,column from 1, or ref and its name.
    """
    at = F.flatten(F.transform("cells", lambda row, i: F.transform(row, lambda c, j: F.struct(F.concat_ws(",", i + 1, j + 1).alias("place"), c["links"].alias("links")))))
    named = F.transform(F.map_entries("refs"), lambda e: F.struct(F.concat(F.lit("ref "), e["key"]).alias("place"), e["value"]["links"].alias("links")))
    each = tables.select("doc", "cid", F.explode(F.concat(at, F.coalesce(named, F.slice(at, 1, 0)))).alias("c"))
    links = each.select("doc", "cid", "c.place", F.explode("c.links").alias("link")).select("doc", "cid", "place", "link.text", "link.hyperlink")
    return dereference(links, titles, documents, site=site)
