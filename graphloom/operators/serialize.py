"""Components as text: for encoders, in chunks, and in prompts.

Tables carry cells, an array of rows of structs with text, image (a path or
null) and ref, and refs, a map from a ref to such a struct.  Images of a
table are numbered from 1 in reading order, a repeated path once; a path that
is null is none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ids

SEP = " [SEP] "


def section(path: Column) -> Column:
    return F.array_join(F.coalesce(path, F.array()), ", ")


def _heading(title: Column, path: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(SEP), section(path), F.lit(SEP))


def text_line(title: Column, path: Column, text: Column) -> Column:
    """Title, sections and text with separators, on one line."""
    return F.translate(F.concat(_heading(title, path), F.coalesce(text, F.lit(""))), "\n\t", "  ")


def commas(text: Column) -> Column:
    """One space on both sides of each comma."""
    return F.when(text.contains(","), F.regexp_replace(text, r"(?U)\s*,\s*", " , ")).otherwise(text)


#: Fixed value: all white space of Unicode, and the four separators of ASCII.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def resolved(cells: Column, refs: Column) -> Column:
    """Rows of (text, image) with references looked up."""

    def one(c: Column) -> Column:
        at = F.try_element_at(refs, c["ref"])
        text, image = F.when(c["ref"].isNull(), c["text"]).otherwise(at["text"]), F.when(c["ref"].isNull(), c["image"]).otherwise(at["image"])
        return F.struct(F.coalesce(text, F.lit("")).alias("text"), image.alias("image"))

    return F.transform(cells, lambda row: F.transform(row, one))


def table_images(rows: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.flatten(rows), lambda c: c["image"]), lambda x: x.isNotNull()))


def _mark(image: Column, images: Column, before: str, after: str) -> Column:
    return F.when(image.isNotNull(), F.concat(F.lit(before + "<Image "), F.array_position(images, image).cast("string"), F.lit(">" + after))).otherwise(F.lit(""))


def row_line(row: Column, images: Column) -> Column:
    """The cells of a row with their image marks, joined by commas."""
    return F.array_join(F.transform(row, lambda c: stripped(commas(F.concat(c["text"], _mark(c["image"], images, " ", " "))))), ", ")


def _basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def image_lines(images: Column, mode: tuple[str, ...], summaries: Column | None = None) -> Column:
    """A line for each image: its mark, with the file's name in mode image and its summary in mode summary, if there is one."""

    def one(path: Column, k: Column) -> Column:
        parts = [F.concat(F.lit("<Image "), (k + 1).cast("string"), F.lit(">"))]
        if "image" in mode:
            parts.append(_basename(path))
        if "summary" in mode and summaries is not None:
            said = F.try_element_at(summaries, ids.stem(path))
            parts.append(F.when(said != "", said))
        return F.concat(F.concat_ws(" ", *parts), F.lit(SEP))

    return F.transform(images, one)


def serialize_tables(tables: DataFrame, mode: tuple[str, ...] = ("image", "summary")) -> DataFrame:
    """tables with target, the whole table as a line, and target_images, its images' paths in mode image; summaries, a map from stem to text, is used if there."""
    t = tables.withColumn("_rows", resolved(F.col("cells"), F.col("refs"))).withColumn("_images", table_images(F.col("_rows")))
    lines = F.transform("_rows", lambda r: F.concat(row_line(r, F.col("_images")), F.lit(SEP)))
    summaries = F.col("summaries") if "summaries" in tables.columns else None
    line = F.concat(_heading(F.col("title"), F.col("section")), F.array_join(lines, ""), F.array_join(image_lines(F.col("_images"), mode, summaries), ""))
    paths = F.col("_images") if "image" in mode else F.slice("_images", 1, 0)
    return t.withColumn("target", F.replace(line, F.lit("\n"), F.lit(" "))).withColumn("target_images", paths).drop("_rows", "_images")


def with_summaries(df: DataFrame, summaries: DataFrame, paths: Column, keys: list[str]) -> DataFrame:
    """df with summaries, a map from the stem of a row's image paths to the text of (stem, summary); keys name a row."""
    asked = df.select(*keys, F.explode(F.array_distinct(F.transform(paths, ids.stem))).alias("_stem"))
    found = asked.join(summaries.select(F.col("stem").alias("_stem"), "summary"), "_stem")
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_stem", "summary")))).alias("summaries"))
    return df.join(maps, keys, "left")


def summary_stem(path: Column) -> Column:
    """What an image's summary is filed under: the last folder of its path, or its own name without ending if it has none."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.when(path.contains("/"), folder).otherwise(ids.stem(path))


def serialize_images(images: DataFrame, mode: tuple[str, ...] = ("image", "summary")) -> DataFrame:
    """images (title, section, text, ocr, summary, image) with target and target_images; a missing caption or OCR text is one space, a missing summary is left out."""
    said = F.when(F.col("text").isNotNull(), F.concat(F.lit(SEP), "text")).otherwise(F.lit(" "))
    parts = [F.coalesce("title", F.lit("")), F.lit(SEP), section(F.col("section")), F.lit(SEP), said]
    if "summary" in mode:
        own = F.when(F.col("image").isNull(), F.lit(" ")).otherwise(F.col("summary"))
        parts.append(F.coalesce(F.concat(F.lit(SEP), own), F.lit("")))
    if "ocr" in mode:
        parts += [F.lit(SEP), F.when(F.col("ocr").isNotNull(), F.concat(F.lit(SEP), "ocr")).otherwise(F.lit(" "))]
    paths = F.when(F.col("image").isNotNull() & F.lit("image" in mode), F.array("image")).otherwise(F.array().cast("array<string>"))
    return images.withColumn("target", F.replace(F.concat(*parts), F.lit("\n"), F.lit(" "))).withColumn("target_images", paths)


def chunked(header: str, rows: list[str], row_images: list[list[int]], lines: list[str], size: int) -> list[tuple[str, list[int]]]:
    """Greedy chunks of at most size words: the header, then rows, then the lines of images that these bring.

    row_images holds, from the header on, what images each row is the first to show.
    The header's images go into the first chunk's text and are listed with every chunk.
    A row too long for any chunk is one by itself.  A header alone is a chunk.
    """
    head_images, rest = row_images[0], row_images[1:]
    words = lambda s: len(s.split())
    out: list[tuple[str, list[int]]] = []
    held: list[int] = []

    def close() -> None:
        shown = [i for k in held for i in rest[k]]
        mentioned = (head_images if not out else []) + shown
        text = (header + "".join(rows[k] for k in held)).strip() + "".join(lines[i] for i in mentioned).strip()
        out.append((text.replace("\n", " "), list(dict.fromkeys(head_images + shown))))
        held.clear()

    used = words(header)
    for k, row in enumerate(rows):
        cost = words(row) + sum(words(lines[i]) for i in rest[k])
        if held and used + cost > size:
            close()
            used = words(header)
        held.append(k)
        used += cost
    if held or not rows:
        close()
    return out


def table_chunks(tables: DataFrame, size: int = 512, mode: tuple[str, ...] = ("image", "summary")) -> DataFrame:
    """(doc, cid, target, images): chunks <table>_c<i> of tables (doc, cid, title, section, cells, refs); images are numbers from 1, comma-joined."""
    t = tables.withColumn("_rows", resolved(F.col("cells"), F.col("refs"))).withColumn("_images", table_images(F.col("_rows")))
    summaries = F.col("summaries") if "summaries" in tables.columns else None
    lines = F.transform("_rows", lambda r: F.concat(row_line(r, F.col("_images")), F.lit(SEP)))
    shown = F.transform("_rows", lambda r: F.transform(F.filter(r, lambda c: c["image"].isNotNull()), lambda c: F.array_position(F.col("_images"), c["image"]).cast("int") - 1))
    head = F.concat(_heading(F.col("title"), F.col("section")), F.coalesce(F.get(lines, 0), F.lit("")))
    made = t.where(F.size("_rows") > 0).select("doc", "cid", head.alias("head"), F.slice(lines, 2, 2**30).alias("rows"), shown.alias("shown"), image_lines(F.col("_images"), mode, summaries).alias("lines"))

    @F.pandas_udf("array<struct<target string, images string>>")
    def cut(head: pd.Series, rows: pd.Series, shown: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for h, r, s, n in zip(head, rows, shown, lines, strict=True):
            seen: set[int] = set()
            fresh = []
            for row in s:
                new = [int(i) for i in dict.fromkeys(row) if i not in seen]
                seen.update(new)
                fresh.append(new)
            out.append([{"target": x, "images": ",".join(str(i + 1) for i in y)} for x, y in chunked(h, list(r), fresh, list(n), size)])
        return pd.Series(out)

    parts = made.select("doc", "cid", F.posexplode(cut("head", "rows", "shown", "lines")).alias("k", "c"))
    return parts.select("doc", F.concat("cid", F.lit("_c"), F.col("k") + 1).alias("cid"), "c.target", "c.images")


def prompt_text(title: Column, path: Column, text: Column) -> Column:
    return F.concat(F.lit("/*\n[Passage]\nTitle: "), title, F.lit("\nSection: "), section(path), F.lit("\n\n"), text, F.lit("\n*/\n\n"))


def prompt_image(title: Column, path: Column, image: Column, text: Column, number: Column) -> Column:
    """An image with its number in the prompt, if it has a file, and its caption, if it has one."""
    mark = F.when(image.isNotNull(), F.concat(F.lit("<Image "), number.cast("string"), F.lit(">\n"))).otherwise(F.lit(""))
    said = F.when(text.isNotNull(), F.concat(F.lit("Caption: "), text, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("/*\n[Image]\nTitle: "), title, F.lit("\nSection: "), section(path), F.lit("\n\n"), mark, said, F.lit("*/\n\n"))


def prompt_table(title: Column, path: Column, rows: Column, number: Column) -> Column:
    """Rows of resolved cells, one a line, bars between cells; only the first image is shown."""
    shown = F.transform(rows, lambda r: F.exists(r, lambda c: c["image"].isNotNull()))
    line = F.array_position(shown, F.lit(True)) - 1
    place = F.array_position(F.transform(F.get(rows, line), lambda c: c["image"].isNotNull()), F.lit(True)) - 1

    def cell(c: Column, here: Column) -> Column:
        mark = F.when(here, F.concat(F.lit("<Image "), number.cast("string"), F.lit(">"))).otherwise(F.lit(""))
        both = F.concat(mark, F.when((mark != "") & (c["text"] != ""), F.lit(", ")).otherwise(F.lit("")), c["text"])
        return commas(both)

    # The first image's place is found once, not in each cell.
    lines = F.get(
        F.transform(
            F.array(F.struct(line.alias("i"), place.alias("j"))),
            lambda at: F.transform(rows, lambda r, i: F.array_join(F.transform(r, lambda c, j: cell(c, F.coalesce((at["i"] == i) & (at["j"] == j), F.lit(False)))), " | ")),
        ),
        0,
    )
    body = F.when(F.size(rows) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("/*\n[Table]\nTitle: "), title, F.lit("\nSection: "), section(path), F.lit("\n\n"), body, F.lit("*/\n\n"))


INSTRUCTION = (
    "Answer the question from the retrieved components below, each {kinds}. Give the answer as a short list, "
    'as f_answers(["..."]); for yes or no questions as f_answers(["yes"]) or f_answers(["no"]).\n\n'
)
WITHOUT_IMAGES = INSTRUCTION.format(kinds="a passage or a table")
WITH_IMAGES = INSTRUCTION.format(kinds="a passage, a table or an image")
EXAMPLE = '/*\n[Passage]\nTitle: Lake\nSection: Size\n\nThe lake is 12 km long.\n*/\n\nQuestion = How long is the lake?\nThe answer is: f_answers(["12 km"])\n'
PAGE = "The images are pages of documents. Answer the question about them in a word or a short phrase.\nQuestion: {}\nAnswer: "


def build_prompts(questions: DataFrame, ranked: DataFrame, components: DataFrame, most: int = 9, text_only: bool = False) -> DataFrame:
    """(qid, prompt, images): a prompt for each question (qid, question) from the first most of its components (qid, rank, doc, cid).

    components has (doc, cid, title, section, text, image, rows); rows holds a
    table's resolved cells, image an image's file.  Images are numbered through
    a prompt.  A component that is not known is left out.  At most `most` components
    of a question are gathered.
    """
    c = components.select(F.col("doc").alias("d"), F.col("cid").alias("c"), "title", "section", "text", "image", "rows")
    got = ranked.where(F.col("rank") <= most).join(c, (F.col("doc") == F.col("d")) & (F.col("cid") == F.col("c")))
    kind = ids.modality(F.col("cid"))
    shown = F.when(kind == "table", F.get(table_images(F.col("rows")), 0)).when(kind == "image", F.col("image"))
    before = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    got = got.withColumn("shown", shown).withColumn("number", F.coalesce(F.sum(F.col("shown").isNotNull().cast("int")).over(before), F.lit(0)) + 1)
    part = (
        F.when(kind == "text", prompt_text(F.col("title"), F.col("section"), F.col("text")))
        .when(kind == "table", prompt_table(F.col("title"), F.col("section"), F.col("rows"), F.col("number")))
        .otherwise(prompt_image(F.col("title"), F.col("section"), F.col("image"), F.col("text"), F.col("number")))
    )
    each = got.select("qid", F.struct("rank", part.alias("part"), "shown").alias("x")).groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    q = questions.select(F.col("qid").alias("q"), "question")
    both = each.join(q, F.col("qid") == F.col("q"))
    images = F.filter(F.transform("xs", lambda x: x["shown"]), lambda x: x.isNotNull())
    head = F.when(F.size(images) > 0, F.lit(WITH_IMAGES)).otherwise(F.lit(WITHOUT_IMAGES))
    prompt = F.concat(head, F.lit(EXAMPLE + "\n"), F.array_join(F.transform("xs", lambda x: x["part"]), "\n"), F.lit("\nQuestion = "), F.col("question"), F.lit("\nThe answer is: "))
    return both.select("qid", prompt.alias("prompt"), (F.slice(images, 1, 0) if text_only else images).alias("images"))


def build_page_prompts(questions: DataFrame, ranked: DataFrame, pages: DataFrame, most: int = 3, last_image_only: bool = False) -> DataFrame:
    """(qid, prompt, images) from ranked pages (qid, rank, doc) and pages (doc, image, summary), whose summaries, if any, come first.

    All pages' images are given; last_image_only keeps the last one alone.
    """
    p = pages.select(F.col("doc").alias("d"), "image", "summary")
    got = ranked.where(F.col("rank") <= most).join(p, F.col("doc") == F.col("d"))
    each = got.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "image", "summary"))).alias("xs"))
    both = each.join(questions.select(F.col("qid").alias("q"), "question"), F.col("qid") == F.col("q"))
    said = F.transform(F.filter("xs", lambda x: x["summary"].isNotNull()), lambda x: F.concat(F.lit("/* \n\n Image summary: "), x["summary"], F.lit("\n\n */\n")))
    images = F.filter(F.transform("xs", lambda x: x["image"]), lambda x: x.isNotNull())
    a, b = PAGE.split("{}")
    prompt = F.concat(F.array_join(said, ""), F.lit(a), F.col("question"), F.lit(b))
    return both.select("qid", prompt.alias("prompt"), (F.slice(images, -1, 1) if last_image_only else images).alias("images"))


def serialize_all(texts: DataFrame, tables: DataFrame, images: DataFrame, mode: tuple[str, ...] = ("image", "summary")) -> DataFrame:
    """(doc, cid, target, images): all components for an encoder, texts and sentences, tables and segments, images and sub-images alike."""
    text = texts.select("doc", "cid", text_line(F.col("title"), F.col("section"), F.col("text")).alias("target"), F.array().cast("array<string>").alias("images"))
    table = serialize_tables(tables, mode).select("doc", "cid", "target", F.col("target_images").alias("images"))
    image = serialize_images(images, mode).select("doc", "cid", "target", F.col("target_images").alias("images"))
    return text.unionByName(table).unionByName(image)
