"""Page texts to the paragraphs of a right-to-left document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import full_strip

# Looks of text and of page separators.
TEXT_STYLE = ("right", True, "Arial", 12, None)
SEPARATOR_STYLE = ("center", False, None, 9, "999999")


def number_pages(items: DataFrame, group: str, order: str) -> DataFrame:
    """Adds page, from 1 in order."""
    return items.withColumn("page", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("int"))


def split_lines(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, page, line_no (from 1), kind (text or blank), text; an empty page is one blank line, trailing blanks stay."""
    lines = pages.select(*keys, "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "raw"))
    text = full_strip(F.col("raw"))
    return lines.select(*keys, "page", (F.col("at") + 1).cast("int").alias("line_no"), F.when(text == "", "blank").otherwise("text").alias("kind"), text.alias("text"))


def page_separators(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A separator before each page after the first."""
    text = F.format_string("-- Page %d --", F.col("page"))
    return pages.filter("page > 1").select(*keys, "page", F.lit(0).alias("line_no"), F.lit("separator").alias("kind"), text.alias("text"))


def paragraph_style(paragraphs: DataFrame) -> DataFrame:
    """Adds align, rtl, font, size_pt and color by kind; a blank paragraph has no style."""
    names, kinds = ("align", "rtl", "font", "size_pt", "color"), ("string", "boolean", "string", "int", "string")
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        value = F.when(F.col("kind") == "text", F.lit(TEXT_STYLE[i])).when(F.col("kind") == "separator", F.lit(SEPARATOR_STYLE[i]))
        paragraphs = paragraphs.withColumn(name, value.cast(kind))
    return paragraphs


def section_style(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document: its section runs from right to left, whatever its paragraphs do."""
    return pages.groupBy(*keys).agg(F.count_distinct("page").alias("pages")).select(*keys, "pages", F.lit("section").alias("kind"), F.lit(True).alias("rtl"))


def build_layout(pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, seq, page, line_no, kind, text in the order of the document."""
    order = Window.partitionBy(*keys).orderBy("page", "line_no")
    return split_lines(pages, keys).unionByName(page_separators(pages, keys)).withColumn("seq", F.row_number().over(order).cast("long"))


def assemble_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: the page texts in page order, one line break between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
