"""From words and cells to columns, rows and sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_GAP, COLUMN_GAP = 1.8, 1.2


def split_cells(words: DataFrame, key: list[str], gap: float = CELL_GAP, then: str = "text") -> DataFrame:
    """Words of a line joined into cells: a new one where the gap is wider than gap characters. words: key, text, x0, x1, width (of a character); then: what orders words of one place."""
    order = ["x0", "x1", then]
    line = Window.partitionBy(*key).orderBy(*[F.asc_nulls_last(c) for c in order])
    new = F.coalesce(F.col("x0") - F.lag("x1").over(line) > F.col("width") * gap, F.lit(True))
    numbered = words.withColumn("_new", new.cast("int")).withColumn("cell", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = f"listagg(text, ' ') within group (order by {', '.join(f'`{c}` nulls last' for c in order)})"
    return numbered.groupBy(*key, "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.expr(joined).alias("text"))


def column_bounds(words: DataFrame, key: list[str], gap: float = COLUMN_GAP) -> DataFrame:
    """Unions of word intervals that lie closer than gap characters: one row a column. Words without a place come last."""
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_last("x0"), F.asc_nulls_last("x1"))
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("x0") - reach > F.col("width") * gap, F.lit(True)).cast("int")
    numbered = words.withColumn("_new", new).withColumn("column", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "column").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def assign_columns(words: DataFrame, columns: DataFrame, key: list[str], slack: float = 0.0) -> DataFrame:
    """Each word's column: the first that holds its middle, else the nearest."""
    middle = (F.col("x0") + F.col("x1")) / 2
    c = columns.select(*[F.col(k) for k in key], "column", F.col("x0").alias("c0"), F.col("x1").alias("c1"))
    both = words.withColumn("_m", middle).join(c, key)
    inside = F.col("_m").between(F.col("c0") - slack, F.col("c1") + slack)
    far = F.when(inside, F.lit(0.0)).otherwise(F.least(F.abs(F.col("_m") - F.col("c0")), F.abs(F.col("_m") - F.col("c1"))))
    best = Window.partitionBy(*key, "word").orderBy(F.when(inside, 0).otherwise(1), far, "column")
    return both.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*key, "word", "text", "column")


def cluster_lines(words: DataFrame) -> DataFrame:
    """Lines of a page: a word opens a new line when it lies further from the running mean of the current one than half the median height (1 at least).

    The threshold moves with the line, so each page folds alone. words: document_id, page, text, x0, centre, height.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["centre", "x0", "text"], kind="stable")
        most = max(1.0, 0.5 * float(g["height"].median()))
        line, mean, n, out = -1, 0.0, 0, []
        for y in g["centre"]:
            if line < 0 or abs(y - mean) > most:
                line, mean, n = line + 1, 0.0, 0
            mean = (mean * n + y) / (n + 1)
            n += 1
            out.append(line)
        return g.assign(line=out)[["document_id", "page", "line", "text", "x0"]]

    return words.select("document_id", "page", "text", "x0", "centre", "height").groupBy("document_id", "page").applyInPandas(fold, "document_id long, page int, line int, text string, x0 double")


def furniture(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Row texts that stand on max(2, half of the pages) or more of a document's pages and hold no digits. rows: document_id, page, text."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"page\s+\d+\s+of\s+\d+", ""), r"\s+", " "))
    seen = rows.withColumn("text", t).where("text <> '' and not text rlike '[0-9]'").groupBy("document_id", "text").agg(F.countDistinct("page").alias("on_pages"))
    return seen.join(pages, "document_id").where("on_pages >= greatest(2, cast(floor(pages / 2) as bigint))").select("document_id", "text", "on_pages")


def without_furniture(rows: DataFrame, found: DataFrame) -> DataFrame:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"page\s+\d+\s+of\s+\d+", ""), r"\s+", " "))
    return rows.withColumn("_t", t).join(found.select("document_id", F.col("text").alias("_t")), ["document_id", "_t"], "left_anti").drop("_t")


def map_headers(headers: DataFrame) -> DataFrame:
    """One column for each field: the most confident, then the first; the others are contested. headers: document_id, column, field, confidence."""
    best = Window.partitionBy("document_id", "field").orderBy(F.desc("confidence"), "column")
    k = F.row_number().over(best)
    state = F.when(F.col("field").isNull(), "UNMAPPED").when(k == 1, "MAPPED").otherwise("AMBIGUOUS")
    return headers.withColumn("state", state).withColumn("contested_field", F.when(F.col("state") == "AMBIGUOUS", F.col("field")))


def continuations(lines: DataFrame) -> DataFrame:
    """Lines that open no claim, joined to the claim above on their document. lines: document_id, page, line, claim (null on a continuation), text."""
    order = Window.partitionBy("document_id").orderBy("page", "line")
    owned = lines.withColumn("owner", F.last("claim", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return owned.where("owner is not null").groupBy("document_id", "owner").agg(F.expr("listagg(text, ' ') within group (order by page, line)").alias("text"), F.count_if(F.col("claim").isNull()).alias("continued"))


def scope_sections(sections: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that a printed subtotal covers: those between it and the one above on its page, if their number is the printed one.

    sections: document_id, page, line, printed; rows: document_id, page, line, row_id.
    """
    above = F.coalesce(F.lag("line").over(Window.partitionBy("document_id", "page").orderBy("line")), F.lit(-1))
    s = sections.withColumn("lo", above).select(F.col("document_id").alias("s_doc"), F.col("page").alias("s_page"), "lo", F.col("line").alias("hi"), "printed")
    inside = (F.col("document_id") == F.col("s_doc")) & (F.col("page") == F.col("s_page")) & (F.col("line") > F.col("lo")) & (F.col("line") < F.col("hi"))
    g = s.join(rows, inside, "left").groupBy("s_doc", "s_page", "hi", "printed").agg(F.sort_array(F.collect_list("row_id")).alias("covers"))
    return g.select(F.col("s_doc").alias("document_id"), F.col("s_page").alias("page"), F.col("hi").alias("line"), F.when(F.size("covers") == F.col("printed"), F.col("covers")).alias("covers"))


def split_pages(pages: DataFrame) -> DataFrame:
    """Neighbouring pages that hold two halves of one table: the letters of their columns follow on and their row keys are the same. pages: document_id, page, first_column, last_column, keys (array)."""
    right = pages.select(F.col("document_id"), (F.col("page") - 1).alias("page"), F.col("first_column").alias("r_first"), F.sort_array("keys").alias("r_keys"))
    both = pages.join(right, ["document_id", "page"]).where((F.col("r_first") == F.col("last_column") + 1) & (F.sort_array("keys") == F.col("r_keys")))
    return both.select("document_id", F.col("page").alias("left_page"), (F.col("page") + 1).alias("right_page"))


def covered_area(rects: pd.DataFrame) -> float:
    """The area of the union of rectangles (x0, y0, x1, y1): a sweep over x."""
    edges = sorted({*rects["x0"], *rects["x1"]})
    total = 0.0
    for a, b in zip(edges, edges[1:], strict=False):
        spans = sorted((r.y0, r.y1) for r in rects.itertuples() if r.x0 <= a and r.x1 >= b)
        reach, height = float("-inf"), 0.0
        for lo, hi in spans:
            height += max(0.0, hi - max(lo, reach))
            reach = max(reach, hi)
        total += height * (b - a)
    return total
