"""Boxes on page images, and how images are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIGURE = "figure"


def filter_boxes(boxes: DataFrame, least_confidence: float = 0.2) -> DataFrame:
    """The boxes (image, class_id, class, confidence, x1, y1, x2, y2) that stay, with idx, from 0, their place in reading order before any go.

    Of equal boxes that of the smallest class stays (of these, the surest).
    A box within another one goes if both are figures or neither is.
    Pairs are compared within an image only and none is emitted.
    """
    sure = boxes.where(F.col("confidence") >= least_confidence)
    place = ["image", "x1", "y1", "x2", "y2"]
    best = sure.groupBy(*place).agg(F.min(F.struct("class_id", -F.col("confidence"), "class")).alias("b"))
    one = best.select(*place, "b.class_id", "b.class", (-F.col("b.col2")).alias("confidence"))
    one = one.withColumn("idx", F.row_number().over(W.partitionBy("image").orderBy("y1", "x1", "x2", "y2")) - 1)
    o = one.select(*[F.col(c).alias(f"o_{c}") for c in (*place, "class")])
    inside = (F.col("o_x1") <= F.col("x1")) & (F.col("o_y1") <= F.col("y1")) & (F.col("o_x2") >= F.col("x2")) & (F.col("o_y2") >= F.col("y2"))
    other = (F.col("o_x1") != F.col("x1")) | (F.col("o_y1") != F.col("y1")) | (F.col("o_x2") != F.col("x2")) | (F.col("o_y2") != F.col("y2"))
    alike = (F.col("class") == FIGURE) == (F.col("o_class") == FIGURE)
    return one.join(o, (F.col("image") == F.col("o_image")) & inside & other & alike, "left_anti")


def fit(width: Column, height: Column, box: int = 640) -> tuple[Column, Column]:
    """Width and height of an image within a square box, in proportion, a pixel at least."""
    ratio = F.least(F.lit(float(box)) / width, F.lit(float(box)) / height)
    return F.greatest((width * ratio).cast("int"), F.lit(1)), F.greatest((height * ratio).cast("int"), F.lit(1))


def reading_plan(files: DataFrame) -> DataFrame:
    """(name, steps): what to ask of each image (name): figures are read and described, tables read as tables, all else as text.

    The class is within the name; captions of figures and tables go with these.
    """
    images = files.where(~F.col("name").contains(".json") & ~F.col("name").contains("result"))
    steps = F.when(F.col("name").contains("figure"), "figure_ocr,description").when(F.col("name").contains("table"), "table_ocr").otherwise("ocr")
    return images.select("name", steps.alias("steps"))
