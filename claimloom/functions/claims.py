"""What a claim, a row of cells and a page say about themselves. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.types import REVIEW_REASONS


def where(page: Column, line: Column, method: Column, read_method: Column) -> Column:
    """Where a claim came from, in words; lines are counted from one."""
    added = (method == "MANUAL") & read_method.isNull()
    return F.when(added, "added on the review screen").when(line.isNull(), F.concat(F.lit("page "), page)).otherwise(F.concat(F.lit("page "), page, F.lit(", line "), line + 1))


def provenance_of(field: Column, edited: Column, method: Column, read_method: Column) -> Column:
    """How a field came by its value: by hand where it was edited, else as the row was read. edited: an array of fields."""
    return F.when(F.array_contains(edited, field), "MANUAL").otherwise(F.coalesce(read_method, method))


def is_medical_only(flag: Column, paid_medical: Column, reserve_medical: Column, paid_indemnity: Column, reserve_indemnity: Column) -> Column:
    """What the document states; else whether there is medical money and no indemnity, nulls counting as none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.coalesce(flag, (zero(paid_medical) + zero(reserve_medical) > 0) & (zero(paid_indemnity) + zero(reserve_indemnity) == 0))


def confidence(scores: Column) -> Column:
    """A row's confidence: that of its least confident field, 1 without any. scores: a map of field and score."""
    return F.coalesce(F.array_min(F.map_values(scores)), F.lit(1.0))


def confidence_for(scores: Column, field: Column) -> Column:
    return F.coalesce(F.try_element_at(scores, field), F.lit(1.0))


def issue(issues: Column, field: Column) -> Column:
    """Why a field is null; null without a recorded reason. issues: an array of (field, reason). Also reads original values and issues, which have the same form."""
    return F.get(F.filter(issues, lambda x: x["field"] == field), F.lit(0))["reason"]


def needs_review(issues: Column) -> Column:
    """Whether any of a claim's nulls has a reason that a person reviews."""
    return F.exists(issues, lambda x: x["reason"].isin(REVIEW_REASONS))


def cell(cells: Column, index: Column) -> Column:
    """A row's cell, trimmed; empty beyond its end."""
    return F.coalesce(F.trim(F.get(cells, index)), F.lit(""))


def row_text(cells: Column) -> Column:
    """A row's cells that aren't blank, as one text."""
    return F.array_join(F.filter(F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")


def is_blank(cells: Column) -> Column:
    return row_text(cells) == ""


def column_count(headers: Column, rows: Column) -> Column:
    """Columns of a table: those of its headers or of its longest row. rows: an array of arrays."""
    return F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))


def recovery_label(convention: Column) -> Column:
    return F.when(convention == "credit", "credits, normalised to positive amounts").otherwise("positive amounts")


def unread_fraction(areas: Column, page_area: Column) -> Column:
    """The part of a page that unread pictures cover, 1 at most. areas: an array."""
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    return F.when(page_area > 0, F.least(F.lit(1.0), total / page_area)).otherwise(0.0)


def extraction_method(digital: Column, scanned: Column) -> Column:
    """How a document is read, by its numbers of pages of each kind."""
    return F.when((digital > 0) & (scanned > 0), "mixed").when(scanned > 0, "vision").otherwise("digital")
