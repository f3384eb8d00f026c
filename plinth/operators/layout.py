"""Slides and pages: titles, tags, page numbers, paragraphs, footnotes.

Inputs are tables of positioned items and lines, as an extractor would give
them.  Reading slide decks and page files themselves needs parsers that are not
part of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import text as T

# A page number, the marks of a source line, the titles of a table of contents.
PAGE = r"^\s*\d+\s*/\s*\d+\s*$"
SOURCE = r"(?i)(?:출처|source|references?|doi)\s*[:：]|한국예술연구|Korean\s+J\.|\|\s*제?\d+호"
CONTENTS = r"(?i)^(?:발표\s*구성|목차|차례)$"


def without_page_numbers(items: DataFrame) -> DataFrame:
    """Items but page numbers; items has slide_width and slide_height."""
    corner = (F.col("top") >= F.col("slide_height") * 0.85) & (F.col("left") >= F.col("slide_width") * 0.75)
    number = F.col("text").rlike(T.at_end(PAGE)) | (F.col("text").rlike(r"^\d{1,3}\z") & corner)
    return items.where(~number)


def titles(items: DataFrame) -> DataFrame:
    """deck_id, slide, item_id, text of each slide's title: the largest font of the upper 40 %, the topmost of equals."""
    ok = F.col("source_type").isin("text", "chart_title") & (F.col("top") < F.col("slide_height") * 0.40)
    ok = ok & ~F.col("text").rlike(r"^\d{1,4}(?:[–-]\d{1,4})?\z")
    w = Window.partitionBy("deck_id", "slide").orderBy(F.desc("font_size"), "top", "item_id")
    return items.where(ok).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("deck_id", "slide", "item_id", "text")


def tagged(items: DataFrame) -> DataFrame:
    """deck_id, slide, item_id, tag of every item, by rules in order of precedence."""
    slide = ["deck_id", "slide"]
    title = titles(items).select(*slide, F.col("item_id").alias("title_id"))
    i = items.join(title, slide, "left")
    is_title = F.col("item_id").eqNullSafe(F.col("title_id"))
    w = Window.partitionBy(*slide)
    of_title = lambda c: F.max(F.when(is_title, F.col(c))).over(w)
    i = i.select(
        "*",
        *[of_title(c).alias(f"t_{c}") for c in ("text", "top", "left", "width", "height", "font_size")],
        F.coalesce(F.median(F.when(~is_title & (F.col("font_size") > 0), F.col("font_size"))).over(w), F.lit(0.0)).alias("med"),
        F.count("*").over(Window.partitionBy(*slide, "left", "width", "height", F.round("font_size", 1))).alias("alike"),
    )
    t, n, font, med = F.col("text"), F.length("text"), F.col("font_size"), F.col("med")
    gap = F.col("top") - (F.col("t_top") + F.col("t_height"))
    aligned = (F.abs(F.col("left") - F.col("t_left")) <= F.greatest(F.col("t_width") * 0.15, F.lit(100_000))) & (
        F.col("width") >= F.col("t_width") * 0.55
    )
    large = (F.col("t_font_size") > 0) & (font >= F.col("t_font_size") * 0.35)
    subtitle = F.col("t_top").isNotNull() & gap.between(F.lit(0), F.col("slide_height") * 0.14) & aligned & large & (n <= 120)
    tag = (
        F.when(is_title, "제목")
        .when(t.rlike(SOURCE), "출처표기")
        .when(F.coalesce(F.col("t_text").rlike(T.at_end(CONTENTS)), F.lit(False)), "목차항목")
        .when((F.col("source_type") == "table_row") | F.startswith("source_type", F.lit("chart_data_")), "행")
        .when(F.col("source_type") == "chart_title", "카드헤더")
        .when(t.rlike(r"^(?:18|19|20)\d{2}(?:[–—-]\d{2,4})?\s*\S") & (n > 6), "연표행")
        .when(t.rlike(r"^[+−-]?\d+(?:[.,]\d+)?\s*(?:%|배|명|개|건|점|종|균주)?\z"), "스탯")
        .when(t.rlike(T.BULLET), "불릿")
        .when(t.rlike("^[“”\"‘’']"), "인용")
        .when(subtitle, "부제")
        .when((med > 0) & (font >= med * 1.2) & (n <= 45), "카드헤더")
        .when((n >= 55) | t.rlike(r"[.!?。]\z"), "카드본문")
        .otherwise("본문")
    )
    repeated = F.when((font >= med * 1.05) & (n <= 35), "카드헤더").otherwise("불릿")
    i = i.withColumn("tag", tag)
    return i.select(*slide, "item_id", F.when((F.col("tag") == "본문") & (F.col("alike") >= 2), repeated).otherwise(F.col("tag")).alias("tag"))


def shape_groups(items: DataFrame) -> DataFrame:
    """deck_id, slide, item_id, alike: how many items of a slide share place, size and font."""
    w = Window.partitionBy("deck_id", "slide", "left", "width", "height", F.round("font_size", 1))
    return items.select("deck_id", "slide", "item_id", F.count("*").over(w).alias("alike"))


def body_lines(lines: DataFrame, floor: float = 0.4) -> DataFrame:
    """lines (doc_id, page, line, indent, text) without running heads and footnotes.

    A page of four lines or more is cut at the first line, at 40 % of its height
    or lower, that starts with a footnote number used in the document or is
    nearly all Latin.
    """
    used = (
        lines.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"""(?<=[가-힣.’”"')])(\d{1,2})\)"""), F.lit(1))).alias("n"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.col("n").cast("int")).alias("used"))
    )
    page = Window.partitionBy("doc_id", "page")
    kept = lines.where(~T.is_running_head(F.col("text"))).join(used, "doc_id", "left")
    kept = kept.withColumn("i", F.row_number().over(page.orderBy("line")) - 1).withColumn("n", F.count("*").over(page))
    mark = F.regexp_extract("text", r"^(\d{1,2})\)", 1).try_cast("int")
    note = F.coalesce(F.array_contains("used", mark), F.lit(False)) | (T.latin_ratio(F.col("text")) > 0.85)
    low = (F.col("n") >= 4) & (F.col("i") >= F.floor(F.col("n") * floor))
    cut = F.min(F.when(low & note, F.col("i"))).over(page)
    return kept.withColumn("cut", cut).where("cut IS NULL OR i < cut").select("doc_id", "page", "line", "indent", "text", "i")


def paragraphs(body: DataFrame) -> DataFrame:
    """body_lines with paragraph, counted from 1 in each document.

    A paragraph starts at a heading, after one, and at a line set in further than
    the page's least indent, unless it is the first of a later page.
    """
    page, doc = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id").orderBy("page", "line")
    head = T.is_heading(F.col("text"), T.PDF_HEADING, ("다.", "다"))
    b = body.withColumn("base", F.min("indent").over(page)).withColumn("head", head)
    first_of_page = (F.row_number().over(page.orderBy("line")) == 1) & (F.col("page") > 1)
    b = b.withColumn("first_of_page", first_of_page).withColumn("after", F.lag("head", 1, True).over(doc))
    new = F.col("head") | F.col("after") | ((F.col("indent") > F.col("base")) & ~F.col("first_of_page"))
    n = F.sum(new.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    return b.select("doc_id", "page", "line", "text", n.cast("int").alias("paragraph"))
