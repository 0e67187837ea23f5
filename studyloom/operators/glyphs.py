"""Text placed on pages: glyphs to lines, cells to table grids. Glyphs are rows, as a decoder gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyloom.functions.text import word_count
from studyloom.session import spread

#: Least columns and rows of a grid.
LEAST_COLUMNS, LEAST_ROWS = 3, 3


def lines(glyphs: DataFrame, page: str | list[str], x: str, y: str, text: str, ties: list[str], height: float) -> DataFrame:
    """(page, line, x, y, text): glyphs whose heights differ by less than half of `height` from the one above are one line.

    A page's glyphs are sorted by y; a gap opens a line. Within a line they stand from left
    to right, with ties in the order of the columns given. page may be several columns, as
    those of a page's column.
    """
    keys = [page] if isinstance(page, str) else page
    w = Window.partitionBy(*keys).orderBy(y)
    opens = F.coalesce(F.col(y) - F.lag(y).over(w) >= height / 2, F.lit(True))
    g = glyphs.withColumn("__opens", opens.cast("int")).withColumn("line", F.sum("__opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = g.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct(x, *ties, F.col(text).alias("__t")))).alias("gs"), F.min(x).alias("x"), F.min(y).alias("y"))
    return rows.select(*keys, F.col("line").cast("long").alias("line"), "x", "y", F.array_join(F.transform("gs", lambda t: t["__t"]), " ").alias("text"))


def grids(cells: DataFrame, page: str, line: str, x: str, tolerance: float) -> DataFrame:
    """(page, lines, columns, is_grid): cells that begin within `tolerance` of the one to the left are one column.

    A column counts where it has cells of two lines or more, three if the page has as many.
    """
    w = Window.partitionBy(page).orderBy(x)
    opens = F.coalesce(F.col(x) - F.lag(x).over(w) > tolerance, F.lit(True))
    cells = spread(cells.select(page, line, x), page)
    c = cells.withColumn("__opens", opens.cast("int")).withColumn("__column", F.sum("__opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    n = cells.groupBy(page).agg(F.count_distinct(line).alias("lines"))
    hits = c.groupBy(page, "__column").agg(F.count_distinct(line).alias("hits")).join(n, page)
    columns = hits.where(F.col("hits") >= F.greatest(F.lit(2), F.least(F.lit(LEAST_ROWS), F.col("lines")))).groupBy(page).agg(F.count("*").alias("columns"))
    out = n.join(columns, page, "left").withColumn("columns", F.coalesce("columns", F.lit(0)))
    return out.select(page, "lines", "columns", ((F.col("columns") >= LEAST_COLUMNS) & (F.col("lines") >= LEAST_ROWS)).alias("is_grid"))


#: Fixed values, as shares of the page's width: where the middle of a gap between columns may lie, and its least width.
GAP_ZONE, GAP_WIDTH = (0.3, 0.7), 0.08
#: Fixed values of a table: least share of filled cells, greatest share of the page from the first to the last column, most words of a cell, most columns.
LEAST_FILL, WIDEST, MOST_WORDS, MOST_COLUMNS = 0.45, 0.92, 8, 12


def column_borders(glyphs: DataFrame, page: str, x: str, width: float) -> DataFrame:
    """(page, border) of the pages in two columns: the middle of the widest valley in the profile of glyphs.

    The profile is the distinct places where glyphs begin; of equally wide valleys the left one counts.
    """
    profile = glyphs.where(F.col(x).isNotNull()).select(page, x).distinct()
    before = F.lag(x).over(Window.partitionBy(page).orderBy(x))
    gaps = profile.select(page, (F.col(x) - before).alias("gap"), ((F.col(x) + before) / 2).alias("middle"))
    low, high = (share * width for share in GAP_ZONE)
    gaps = gaps.where(F.col("middle").between(low, high))
    widest = gaps.groupBy(page).agg(F.max(F.struct("gap", (-F.col("middle")).alias("back"))).alias("g"))
    return widest.where(F.col("g.gap") > GAP_WIDTH * width).select(page, (-F.col("g.back")).alias("border"))


def reading_lines(glyphs: DataFrame, page: str, x: str, y: str, text: str, ties: list[str], height: float, width: float) -> DataFrame:
    """(page, place, column, x, y, text): the lines of each page in reading order, the left column before the right one.

    Pages without a border have one column, 0. place counts from 1. Glyphs are dealt by page
    once; all that follows, what a caller groups by page as well, stays in its task.
    """
    borders = column_borders(glyphs, page, x, width).withColumnRenamed(page, "__page")
    # null pages are a page as well; a null-safe join would deal by other keys
    of_null = borders.where(F.col("__page").isNull()).agg(F.max("border").alias("__of_null"))
    g = glyphs.repartition(page).join(borders, F.col(page) == F.col("__page"), "left").crossJoin(F.broadcast(of_null))
    border = F.when(F.col(page).isNull(), F.col("__of_null")).otherwise(F.col("border"))
    side = F.when(border.isNull() | (F.col(x) < border), 0).otherwise(1)
    out = lines(g.withColumn("__side", side).drop("__page", "border", "__of_null"), [page, "__side"], x, y, text, ties, height)
    place = F.row_number().over(Window.partitionBy(page).orderBy("__side", "line"))
    return out.select(page, place.cast("long").alias("place"), F.col("__side").alias("column"), "x", "y", "text")


def filled_grids(cells: DataFrame, page: str, line: str, x: str, text: str, tolerance: float, width: float) -> DataFrame:
    """(page, lines, columns, fill, is_table): grids whose cells are filled, narrow and short enough for a table.

    Columns are those of `grids`. fill: cells of columns that hold a text, over lines times
    columns. A table has LEAST_ROWS lines and LEAST_COLUMNS columns at least, MOST_COLUMNS at
    most, and no cell of more than MOST_WORDS words.
    """
    w = Window.partitionBy(page).orderBy(x)
    opens = F.coalesce(F.col(x) - F.lag(x).over(w) > tolerance, F.lit(True))
    full = F.trim(F.coalesce(text, F.lit(""))) != ""
    # of a text only what is asked of it is sent
    cells = spread(cells.select(page, line, x, full.alias("__full"), word_count(F.col(text)).alias("__words")), page)
    c = cells.withColumn("__opens", opens.cast("int")).withColumn("__column", F.sum("__opens").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    n = cells.groupBy(page).agg(F.count_distinct(line).alias("lines"))
    # a line of a column first, then the column: two counts of distinct lines at once would double the rows
    placed = c.groupBy(page, "__column", line).agg(F.max("__full").alias("__full"), F.min(x).alias("__at"), F.max("__words").alias("__words"))
    each = placed.groupBy(page, "__column").agg(F.count(line).alias("hits"), F.count(F.when(F.col("__full"), F.col(line))).alias("full"), F.min("__at").alias("at"), F.max("__words").alias("words"))
    kept = each.join(n, page).where(F.col("hits") >= F.greatest(F.lit(2), F.least(F.lit(LEAST_ROWS), F.col("lines"))))
    sums = kept.groupBy(page).agg(F.count("*").alias("columns"), F.sum("full").alias("full"), (F.max("at") - F.min("at")).alias("span"), F.max("words").alias("words"))
    out = n.join(sums, page, "left").withColumn("columns", F.coalesce("columns", F.lit(0)))
    fill = F.when(F.col("columns") > 0, F.col("full") / (F.col("lines") * F.greatest(F.col("columns"), F.lit(1)))).otherwise(0.0)
    fits = F.col("columns").between(LEAST_COLUMNS, MOST_COLUMNS) & (F.col("lines") >= LEAST_ROWS) & (fill >= LEAST_FILL) & (F.col("span") <= WIDEST * width) & (F.col("words") <= MOST_WORDS)
    return out.select(page, "lines", "columns", fill.alias("fill"), F.coalesce(fits, F.lit(False)).alias("is_table"))
