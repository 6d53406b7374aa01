"""Pages' spans, drawings, images, scanned lines and tables, as arrays of structs; each row is judged by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T


def bbox_text(box: Column) -> Column:
    """Four numbers with one decimal each; null for anything else."""
    return F.when(F.size(box) == 4, F.array_join(F.transform(box, lambda x: F.format_string("%.1f", x.cast("double"))), ","))


def ocr_lines(lines: Column) -> Column:
    """(text, n_words, area) of scanned lines (box of points x and y, text): the texts, and the areas of their hulls."""
    span = lambda box, axis: F.array_max(F.transform(box, lambda p: p[axis])) - F.array_min(F.transform(box, lambda p: p[axis]))
    areas = F.transform(lines, lambda x: F.coalesce(span(x["box"], "x") * span(x["box"], "y"), F.lit(0.0)))
    text = F.array_join(F.filter(F.transform(lines, lambda x: T.stripped(x["text"])), lambda t: t != ""), "\n")
    return F.struct(text.alias("text"), F.size(T.words(text)).alias("n_words"), F.aggregate(areas, F.lit(0.0), lambda s, a: s + a).alias("area"))


def ocr_dominant(n_words: Column, area_ratio: Column) -> Column:
    return (n_words >= DEFAULT.ocr_words) & (area_ratio >= DEFAULT.ocr_area)


def vector_stats(rects: Column, page_area: Column) -> Column:
    """(drawings, coverage) of rectangles (width, height): those of some size, and the share of the page that all take."""
    areas = F.transform(rects, lambda x: F.greatest(x["width"], F.lit(0.0)) * F.greatest(x["height"], F.lit(0.0)))
    drawn = F.size(F.filter(areas, lambda a: a / page_area >= DEFAULT.drawn_ratio))
    covered = F.least(F.aggregate(areas, F.lit(0.0), lambda s, a: s + a) / page_area, F.lit(1.0))
    some = page_area > 0
    return F.struct(F.when(some, drawn).otherwise(0).alias("drawings"), F.when(some, covered).otherwise(0.0).alias("coverage"))


def has_visuals(n_images: Column, stats: Column) -> Column:
    return (n_images > 0) | (stats["drawings"] >= DEFAULT.drawings) | (stats["coverage"] >= DEFAULT.drawn_coverage)


def image_route(source: Column, visual: Column) -> Column:
    """How a page's pictures are read: whole or each, by vision or by scanning first."""
    whole = (source == "ocr") | visual
    return F.when(whole & (source == "text"), "page_vision").when(whole, "page_ocr_or_vision").otherwise("each_image")


def large_images(images: DataFrame) -> DataFrame:
    return images.where((F.col("width") >= DEFAULT.least_image) & (F.col("height") >= DEFAULT.least_image))


def described(description: Column, ocr_text: Column) -> Column:
    """An image's description, or what stands for none, with the text scanned in it."""
    said = F.coalesce(F.nullif(T.stripped(description), F.lit("")), F.lit("[no description]"))
    return F.when(F.length(T.stripped(ocr_text)) > 0, F.concat(said, F.lit("\n\n[OCR text in image]:\n"), T.stripped(ocr_text))).otherwise(said)


def upper_median(sizes: Column) -> Column:
    """The middle of sorted positive sizes, of two the greater; 12 of none."""
    found = F.array_sort(F.filter(sizes, lambda x: x > 0))
    return F.when(F.size(found) > 0, F.element_at(found, F.floor(F.size(found) / 2).cast("int") + 1)).otherwise(F.lit(12.0))


def span_text(lines: Column) -> Column:
    """A block's lines: stripped spans joined by spaces, lines by line breaks, empty ones left out."""
    line = lambda x: F.array_join(F.filter(F.transform(x["spans"], lambda s: T.stripped(s["text"])), lambda t: t != ""), " ")
    return F.array_join(F.filter(F.transform(lines, line), lambda t: t != ""), "\n")


def is_heading(average: Column, median: Column, n_words: Column, bold: Column) -> Column:
    """Short text that is larger than the page's, or bold and nearly as large."""
    return ((average > DEFAULT.heading_ratio * median) & (n_words <= DEFAULT.heading_words)) | (bold & (n_words <= DEFAULT.bold_words) & (average >= DEFAULT.bold_ratio * median))


def span_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_index, block_type, text_content) of pages' blocks (type, lines of spans (text, size, flags)); other types and empty ones go, indices stay."""
    written = lambda spans: F.filter(spans, lambda s: F.length(T.stripped(s["text"])) > 0)
    spans = F.flatten(F.transform("b.lines", lambda x: written(x["spans"])))
    all_sizes = F.flatten(F.transform(F.filter("blocks", lambda b: b["type"] == 0), lambda b: F.flatten(F.transform(b["lines"], lambda x: F.transform(written(x["spans"]), lambda s: s["size"])))))
    df = pages.select("page_id", upper_median(all_sizes).alias("median"), F.posexplode("blocks").alias("block_index", "b")).where("b.type = 0")
    df = df.select("page_id", "median", "block_index", span_text(F.col("b.lines")).alias("text_content"), spans.alias("spans")).where("text_content <> ''")
    average = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["size"]) / F.size("spans")
    bold = F.exists("spans", lambda s: s["flags"].bitwiseAND(16) != 0)
    heading = is_heading(average, F.col("median"), F.size(T.words(F.col("text_content"))), bold)
    return df.select("page_id", "block_index", F.when(heading, "heading").otherwise("text").alias("block_type"), "text_content")


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, block_index, block_type, text_content) with section_title: the page's last heading so far."""
    order = W.partitionBy("page_id").orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    title = F.array_join(T.words(F.col("text_content")), " ")
    return blocks.withColumn("section_title", F.last(F.when(F.col("block_type") == "heading", title), ignorenulls=True).over(order))


def _cell(cell: Column) -> Column:
    return F.replace(F.replace(T.stripped(cell), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("&#124;"))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def markdown(grid: Column) -> Column:
    """A grid as a table: the first row is the header, which other rows are padded or cut to."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def table(g: Column, cols: Column) -> Column:
        fitted = lambda row: F.slice(F.concat(F.transform(row, _cell), F.array_repeat(F.lit(""), F.greatest(cols - F.size(row), F.lit(0)))), F.lit(1), cols)
        rows = F.transform(g, lambda row: line(fitted(row)))
        rule = F.array(line(F.array_repeat(F.lit("---"), cols)))
        whole = _bound(rows, lambda r: F.array_join(F.concat(F.slice(r, 1, 1), rule, F.slice(r, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))), "\n"))
        return F.when(F.coalesce(cols, F.lit(0)) > 0, whole).otherwise("")

    return _bound(grid, lambda g: _bound(F.size(F.get(g, 0)), lambda cols: table(g, cols)))


def valid_grid(grid: Column) -> Column:
    """Whether a grid is a table: rows and columns enough, of even length, not mostly empty, cells not paragraphs."""
    widths = F.transform(grid, F.size)
    cells = F.transform(F.flatten(grid), T.stripped)
    full = F.transform(F.filter(cells, lambda c: c != ""), F.length)
    most = F.array_max(widths)
    uneven = F.size(F.filter(widths, lambda n: F.abs(n - most) > 1))
    average = F.aggregate(full, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(full)
    enough = (F.size(grid) >= 2) & (most >= 2) & (uneven <= F.size(grid) * DEFAULT.uneven_ratio) & (F.size(full) > 0)
    return F.coalesce(enough & ((F.size(cells) - F.size(full)) / F.size(cells) <= DEFAULT.empty_ratio) & (average <= DEFAULT.cell_average) & (F.array_max(full) <= DEFAULT.cell_most), F.lit(False))


def page_lines(lines: Column) -> Column:
    """(horizontal, vertical) drawn lines (x0, x1, top, bottom) long and thin enough."""
    wide = lambda x: x["x1"] - x["x0"]
    high = lambda x: F.abs(x["bottom"] - x["top"])
    return F.struct(F.filter(lines, lambda x: (wide(x) >= 20) & (high(x) < 3)).alias("horizontal"), F.filter(lines, lambda x: (wide(x) < 3) & (high(x) >= 15)).alias("vertical"))


def forms_grid(lines: Column, tolerance: float = 5.0) -> Column:
    """Whether a horizontal line crosses a vertical one, within tolerance."""

    def crosses(h: Column, v: Column) -> Column:
        y = (h["top"] + h["bottom"]) / 2
        return v["x0"].between(h["x0"] - tolerance, h["x1"] + tolerance) & y.between(F.least(v["top"], v["bottom"]) - tolerance, F.greatest(v["top"], v["bottom"]) + tolerance)

    return F.exists(lines["horizontal"], lambda h: F.exists(lines["vertical"], lambda v: crosses(h, v)))


def table_records(tables: DataFrame) -> DataFrame:
    """Records of tables (page_id, strategy, ord, grid, accuracy) that are valid; strategies with an accuracy must reach the least."""
    df = tables.where(valid_grid(F.col("grid"))).where(F.coalesce(F.col("accuracy") >= DEFAULT.stream_accuracy, F.lit(True)))
    df = df.withColumn("markdown", markdown(F.col("grid"))).where(F.size(F.split("markdown", "\n")) >= 3)
    return df.select(
        "page_id", "strategy", "ord", F.size("grid").alias("row_count"), F.array_max(F.transform("grid", F.size)).alias("col_count"), F.transform(F.col("grid")[0], T.stripped).alias("header_names"),
        "markdown", F.to_json("grid").alias("cells_json"), F.round("accuracy", 2).alias("accuracy"),
    )


def distinct_tables(records: DataFrame) -> DataFrame:
    """records (page_id, strategy, ord, markdown) without a page's repeats of one markdown, numbered by table_index; strategies sort by confidence."""
    first = records.withColumn("again", F.row_number().over(W.partitionBy("page_id", F.md5("markdown")).orderBy("strategy", "ord"))).where("again = 1").drop("again")
    return first.withColumn("table_index", F.row_number().over(W.partitionBy("page_id").orderBy("strategy", "ord")) - 1)
