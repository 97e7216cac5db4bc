"""Page blocks: filter, de-duplicate, reading order, page and document text."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.text import drop_space, strip, strip_commas

PAGE = ["doc_id", "page"]


def region_filter(blocks: DataFrame) -> DataFrame:
    """Drop picture regions too small to hold text."""
    wide = F.col("x1") - F.col("x0") >= K.MIN_REGION_WIDTH
    tall = F.col("y1") - F.col("y0") >= K.MIN_REGION_HEIGHT
    return blocks.filter(wide & tall)


def block_key(text) -> Column:
    return drop_space(F.lower(text))


def drop_repeated_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """OCR blocks whose text the page does not already hold. Native texts are made distinct first."""
    keyed = ocr.withColumn("_text", block_key(F.col("text")))
    known = native.select(*PAGE, block_key(F.col("text")).alias("_text")).distinct()
    return keyed.join(known, [*PAGE, "_text"], "left_anti").drop("_text")


def merge_blocks(native: DataFrame, ocr: DataFrame) -> DataFrame:
    tag = lambda df, name, at: df.withColumn("source", F.lit(name)).withColumn("_src", F.lit(at))
    return tag(native, "native", 0).unionByName(tag(drop_repeated_ocr(native, ocr), "ocr", 1))


def drop_repeated(blocks: DataFrame) -> DataFrame:
    """Native blocks, and the OCR blocks whose text no native block of their page holds; blocks without text stay.

    Rows meet by page, which later steps by page use again, and equal texts of a page stand together in one sort.
    """
    native = F.col("source") == "native"
    same = Window.partitionBy(*PAGE, "_key")
    marked = blocks.repartition(*PAGE).withColumn("_key", block_key(F.col("text"))).withColumn("_known", F.max(native).over(same))
    return marked.filter(native | F.col("_key").isNull() | ~F.col("_known")).drop("_key", "_known")


def line_numbers(tops: list[float | None], bottoms: list[float | None], threshold: float) -> list[int]:
    """The line (from 1) of every block of a page, blocks given from top to bottom.

    A block joins the first line whose mean centre is nearer than ``threshold``, else it opens one. Lines lie in cells
    as high as the threshold, so a block looks only into its own cell and those beside it.
    """
    total: list[float] = []
    count: list[int] = []
    cells: dict[int, set[int]] = {}
    out = []
    for top, bottom in zip(tops, bottoms):
        if top is None or bottom is None or not math.isfinite(top + bottom):
            total.append(math.nan)
            count.append(1)
            out.append(len(total))
            continue
        centre = (top + bottom) / 2
        cell = math.floor(centre / threshold)
        near = [
            line for c in (cell - 1, cell, cell + 1) for line in cells.get(c, ())
            if abs(centre - total[line] / count[line]) < threshold
        ]
        if near:
            line = min(near)
            before = math.floor(total[line] / count[line] / threshold)
            total[line] += centre
            count[line] += 1
            now = math.floor(total[line] / count[line] / threshold)
            if now != before:
                cells[before].discard(line)
                cells.setdefault(now, set()).add(line)
        else:
            line = len(total)
            total.append(centre)
            count.append(1)
            cells.setdefault(cell, set()).add(line)
        out.append(line + 1)
    return out


def _lines(threshold: float):
    """Line numbers of whole pages; only coordinates go to Python, texts stay where they are."""

    @F.pandas_udf("array<int>")
    def lines(tops: pd.Series, bottoms: pd.Series) -> pd.Series:
        return pd.Series([line_numbers(list(t), list(b), threshold) for t, b in zip(tops, bottoms)])

    return lines


def reading_order(blocks: DataFrame, threshold: float = K.LINE_THRESHOLD, unique: bool = False) -> DataFrame:
    """One row per page with ``blocks`` in reading order (line, then left to right).

    ``blocks`` has ``doc_id, page, pos, x0, y0, x1, y1, text, source``. Only the blocks of one
    page meet in a task, in time that grows with n log n. ``unique`` leaves out OCR blocks whose text a native
    block of the page holds.
    """
    if unique:
        blocks = drop_repeated(blocks)
    source_rank = F.when(F.col("source") == "native", 0).otherwise(1)
    item = F.struct(
        F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"),
        source_rank.alias("s"), "pos", F.col("y1").cast("double").alias("y1"), "source", "text",
    )
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("_b"))
    lined = pages.withColumn(
        "_line", _lines(threshold)(F.transform("_b", lambda b: b["y0"]), F.transform("_b", lambda b: b["y1"])))
    placed = F.transform("_b", lambda b, i: F.struct(
        F.get("_line", i).alias("line"), b["x0"].alias("x0"), i.alias("seq"), b["source"].alias("source"), b["text"].alias("text")))
    return lined.select(*PAGE, F.array_sort(placed).alias("blocks"))


def page_text(ordered: DataFrame) -> DataFrame:
    texts = F.filter(F.transform("blocks", lambda b: strip(b["text"])), lambda t: t != "")
    return ordered.select(*PAGE, F.array_join(texts, " ").alias("page_text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages (``page`` counted from 1) joined into one text per document with page separators."""
    part = F.concat(
        F.lit("\n--- "), F.col("page").cast("string"), F.lit(" Page ---\n"), strip_commas("page_text")
    )
    parts = F.sort_array(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy("doc_id").agg(F.array_join(parts["part"], "").alias("text"))
