"""Blank-cell and blank-row limits over a table of cells, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import BLANK_CELLS, BLANK_ROWS


def within_limits(cells: DataFrame, blank_cells: int = BLANK_CELLS, blank_rows: int = BLANK_ROWS) -> DataFrame:
    """The filled cells (sheet, row, col, value) that are read.

    A row is read until it has had more than `blank_cells` blanks in all; a sheet until more than `blank_rows` rows in succession gave nothing.
    """
    return rows_within_limits(cells.groupBy("sheet", "row").agg(F.collect_list(F.struct("col", "value")).alias("cells")), blank_cells, blank_rows)


def rows_within_limits(rows: DataFrame, blank_cells: int = BLANK_CELLS, blank_rows: int = BLANK_ROWS) -> DataFrame:
    """The same of rows (sheet, row, cells array<struct<col, value>>); a row may come in several parts.

    What is dealt out is rows: of each part its filled cells, and of the blank ones the first columns. One exchange and one order of the rows serve every step.
    """
    blank = lambda c: F.coalesce(c["value"] == "", F.lit(True))
    first = F.slice(F.sort_array(F.transform(F.filter("cells", blank), lambda c: c["col"])), 1, blank_cells + 1)
    parts = rows.select("sheet", "row", first.alias("blanks"), F.filter("cells", lambda c: ~blank(c)).alias("filled")).repartition("sheet")
    by_row = Window.partitionBy("sheet").orderBy("row")
    together = parts.withColumn("blanks", F.sort_array(F.flatten(F.collect_list("blanks").over(Window.partitionBy("sheet", "row"))))).withColumn("number", F.dense_rank().over(by_row))
    ends, end = F.size("blanks") > blank_cells, F.get("blanks", F.lit(blank_cells))
    before = lambda c: ~ends | (end.isNotNull() & (c["col"].isNull() | (c["col"] < end)))
    data = together.select("sheet", "row", "number", F.filter("filled", before).alias("filled")).where(F.size("filled") > 0)
    # rows between that gave nothing; a further part of the same row has -1
    idle = data.withColumn("idle", F.col("number") - F.coalesce(F.lag("number").over(by_row), F.lit(0)) - 1)
    read = idle.withColumn("idle", F.max("idle").over(by_row)).where((F.col("idle") <= blank_rows) | F.col("sheet").isNull())
    return read.select("sheet", "row", F.inline("filled"))
