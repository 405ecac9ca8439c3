"""What vision models say about images, as tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import spread
from ..functions import llm_text, pixels
from ..functions.models import generate
from .corpus import pending
from .layout import reading_plan

#: What is asked of an image, by step of its reading plan.
ASKED = {
    "figure_ocr": "Write down all text in this figure.",
    "description": "Describe this figure in a few sentences.",
    "table_ocr": "Write down this table, a line for each row, cells parted by bars.",
    "ocr": "Write down all text in this image.",
}


def _boxes(raw: str | None) -> list[dict]:
    out = []
    for k, said in enumerate(llm_text.json_objects(raw), 1):
        found = json.loads(said)
        box = found.get("bbox_2d")
        if isinstance(box, list) and len(box) == 4 and all(isinstance(x, (int, float)) for x in box):
            out.append({"k": k, "class": str(found.get("class", "object")), **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True))})
    return out


_BOX = T.StructType().add("k", "integer").add("class", "string")
for _side in ("x1", "y1", "x2", "y2"):
    _BOX = _BOX.add(_side, "double")


@F.pandas_udf(T.ArrayType(_BOX))
def _parsed(raw: pd.Series) -> pd.Series:
    return raw.map(_boxes)


def detections(answers: DataFrame) -> DataFrame:
    """(image, k, class, x1, y1, x2, y2, name): boxes in a model's answers (image, raw), and the name of the k-th cut-out.

    Objects that are cut off, are no JSON or have no box are left out, but the first ones are counted.
    """
    rows = answers.select("image", F.explode(_parsed("raw")).alias("b")).select("image", "b.*")
    return rows.withColumn("name", F.concat(F.col("k").cast("string"), F.lit("_"), "class", F.lit(".png")))


def read_texts(files: DataFrame, model: Callable) -> DataFrame:
    """(name, step, text): what a model answers to each step of an image's reading plan; its prompt is the step's question and the image's name."""
    steps = reading_plan(files).select("name", F.explode(F.split("steps", ",")).alias("step"))
    told = F.lit(None).cast("string")
    for step, said in ASKED.items():
        told = F.when(F.col("step") == step, said).otherwise(told)
    return steps.select("name", "step", generate(F.concat(told, F.lit("\n<image> "), "name"), model).alias("text"))


def summarize(files: DataFrame, done: DataFrame, model: Callable, overwrite: bool = False) -> DataFrame:
    """(name, summary) of images that have none yet, or of all."""
    todo = pending(files.select("name"), done, "name", overwrite)
    return todo.select("name", generate(F.concat(F.lit("Describe this image for a search engine.\n<image> "), "name"), model).alias("summary"))


_IMAGE = T.StructType().add("content", "binary").add("width", "integer").add("height", "integer").add("error", "string")


def _image(make: Callable[[], np.ndarray]) -> dict:
    """A PNG file of what make() gives, or why there is none."""
    try:
        made = make()
        return {"content": pixels.encoded(made), "width": made.shape[1], "height": made.shape[0], "error": None}
    except ValueError as e:
        return {"content": None, "width": None, "height": None, "error": str(e)}


def cut_outs(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, name, content, width, height, error): each box of detections() cut out of its image (image, content), a PNG file.

    What can't be read or cut has an error and no content.  Boxes without an image go.
    """

    @F.pandas_udf(_IMAGE)
    def run(content: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        held: tuple[bytes, np.ndarray] | None = None

        def read(data: bytes) -> np.ndarray:
            nonlocal held
            if held is None or held[0] != data:  # boxes of an image come one after the other
                held = (data, pixels.decoded(data))
            return held[1]

        rows = [_image(lambda c=c, box=box: pixels.cut(read(c), box)) for c, *box in zip(content, x1, y1, x2, y2, strict=True)]
        return pd.DataFrame(rows, columns=_IMAGE.names, dtype=object)

    # Never a broadcast: images are far larger than the table that they may be made from, whose size the planner goes by.
    held = spread(images.select(F.col("image").alias("_i"), "content"), "_i").hint("merge")
    both = spread(boxes, "image").join(held, F.col("image") == F.col("_i"))
    return both.select("image", "name", run("content", "x1", "y1", "x2", "y2").alias("v")).select("image", "name", "v.*")


def resized_images(images: DataFrame, box: int = 640) -> DataFrame:
    """(image, content, width, height, error): images (image, content) within a square of box pixels, in proportion, as PNG files."""

    @F.pandas_udf(_IMAGE)
    def run(content: pd.Series) -> pd.DataFrame:
        def fitted(data: bytes) -> np.ndarray:
            given = pixels.decoded(data)
            ratio = min(box / given.shape[1], box / given.shape[0])
            return pixels.resized(given, max(int(given.shape[1] * ratio), 1), max(int(given.shape[0] * ratio), 1))

        return pd.DataFrame([_image(lambda c=c: fitted(c)) for c in content], columns=_IMAGE.names, dtype=object)

    return images.select("image", run("content").alias("v")).select("image", "v.*")
