"""Printed amounts, dates, statuses and labels: a value or a reason, never a guess."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.functions import dates, money, text

MONEY = [
    (None, None, None, "EMPTY"), ("", None, None, "EMPTY"), ("N/A", None, None, "NOT_APPLICABLE"), ("--", None, None, "DASH_PLACEHOLDER"), ("-0-", None, "0", None), ("$ -", None, "0", None),
    ("1,234.56", None, "1234.56", None), ("1.234,56", None, "1234.56", None), ("(1,234.56)", None, "-1234.56", None), ("$ (1,000.00)", None, "-1000", None), ("3,500.00-", None, "-3500", None),
    ("(5.00-)", None, "5", None), ("100.00 CR", None, "-100", None), ("100.00 DR", None, "100", None), ("1,234", None, None, "AMBIGUOUS_SEPARATOR"), ("1,234", "us", "1234", None), ("1,234", "eu", "1.234", None),
    ("1.234", "us", "1.234", None), ("1.234", "eu", "1234", None), ("12345.678", None, "12345.678", None), ("1,234,567", None, "1234567", None), ("1,23,567", None, None, "UNPARSEABLE"),
    ("12,34.5", None, None, "UNPARSEABLE"), ("abc", None, None, "UNPARSEABLE"), ("12%", None, None, "UNPARSEABLE"), ("(5.00", None, None, "UNPARSEABLE"), ("€ 12,50", None, "12.50", None),
    ("USD 12.50", None, "12.50", None), ("−5.00", None, "-5", None), (" 7 ", None, "7", None), (".5", None, "0.5", None),
]


def test_money(spark):
    rows = spark.createDataFrame([(i, p, loc) for i, (p, loc, _, _) in enumerate(MONEY)], "i int, p string, loc string")
    got = {r["i"]: r["m"] for r in rows.select("i", money.parse_money(F.col("p"), F.col("loc")).alias("m")).collect()}
    for i, (p, loc, value, reason) in enumerate(MONEY):
        assert got[i]["reason"] == reason, (p, loc, got[i])
        assert (got[i]["value"] is None) == (value is None) and (value is None or got[i]["value"] == Decimal(value)), (p, loc, got[i])


def test_money_currency_and_dash(spark):
    rows = spark.createDataFrame([("£5", "GBP"), ("C$5", "CAD"), ("5 EUR", "EUR"), ("5", None), ("$ -", "USD")], "p string, c string")
    assert all(r["m"]["currency"] == r["c"] for r in rows.select("c", money.parse_money(F.col("p")).alias("m")).collect())
    assert spark.createDataFrame([("--",)], "p string").select(money.parse_money(F.col("p"), dash_is_zero=True).alias("m")).first()["m"]["value"] == 0


DATES = [
    (None, None, None, "EMPTY"), ("n/a", None, None, "NOT_APPLICABLE"), ("2024-02-29", None, "2024-02-29", None), ("2023-02-29", None, None, "INVALID_DATE"), ("20240131", None, "2024-01-31", None),
    ("Jan 5, 2024", None, "2024-01-05", None), ("5-Sept-87", None, "1987-09-05", None), ("13/02/2024", None, "2024-02-13", None), ("02/13/2024", None, "2024-02-13", None), ("03/04/2024", None, None, "AMBIGUOUS_DATE_ORDER"),
    ("03/04/2024", "mdy", "2024-03-04", None), ("03/04/2024", "dmy", "2024-04-03", None), ("04/04/24", None, "2024-04-04", None), ("01/02/0007", "mdy", None, "OUT_OF_RANGE"), ("1899-01-01", None, None, "OUT_OF_RANGE"),
    ("someday", None, None, "UNPARSEABLE"), ("2024-03-01 10:30", None, "2024-03-01", None), ("01/31/70", None, "1970-01-31", None), ("01/31/69", None, "2069-01-31", None),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, p, o) for i, (p, o, _, _) in enumerate(DATES)], "i int, p string, o string")
    got = {r["i"]: r["d"] for r in rows.select("i", dates.parse_date(F.col("p"), F.col("o")).alias("d")).collect()}
    for i, (p, order, value, reason) in enumerate(DATES):
        assert (str(got[i]["value"]) if got[i]["value"] else None, got[i]["reason"]) == (value, reason), (p, order, got[i])


@pytest.mark.parametrize(("printed", "status"), [("Open", "OPEN"), ("CLSD", "CLOSED"), ("closed - paid", "CLOSED_PAID"), ("Re-Opened", "REOPENED"), ("report only", "REPORT_ONLY"), ("open pending suit", "OPEN"), ("paid", "UNKNOWN"), (None, "UNKNOWN")])
def test_status(spark, printed, status):
    assert spark.createDataFrame([(printed,)], "p string").select(text.parse_status(F.col("p"))).first()[0] == status


def test_shapes_and_pages(spark):
    row = spark.createDataFrame([("GL-0012", "GL-00123", "Page 2 of 9 and page 12 of 3")], "a string, b string, t string")
    got = row.select(
        text.identifier_shape(F.col("a")).alias("s"), text.same_series(text.identifier_shape(F.col("a")), text.identifier_shape(F.col("b"))).alias("near"), text.paginations(F.col("t")).alias("p"), text.is_identifier(F.col("a")).alias("ok"),
        text.is_identifier(F.lit("1,234.50")).alias("money"), text.is_identifier(F.lit("03/04/2024")).alias("date"), text.needs_quote(F.lit(" =SUM(A1)")).alias("formula"), text.parse_int(F.lit("no. 1,204 of")).alias("n"),
    ).first()
    assert (got["s"], got["near"], [tuple(p) for p in got["p"]]) == ("AA-9999", True, [(2, 9)])
    assert (got["ok"], got["money"], got["date"], got["formula"], got["n"]) == (True, False, False, True, 1204)


def test_parse_amount_reads_as_parse_money(spark):
    texts = ["12.50", "0.00", "123456789012.34", "1234567890123456789.00", "1.234", "12.5", "-12.50", "($3.20)", "--", "-", "\u2013", "n/a", "", " 7.00", "7.00\n", "1,234.50", "USD 4.00", "abc", "\u0661.25", None]
    rows = spark.createDataFrame([(t, w) for t in texts for w in ("us", "eu", None)], "t string, w string")
    got = rows.select("t", "w", money.parse_amount(F.col("t"), F.col("w")).alias("a"), money.parse_money(F.col("t"), F.col("w")).alias("b"))
    assert [r for r in got.collect() if r["a"] != r["b"]] == []


def test_headers_are_guessed_once_each(spark):
    from claimloom.operators import mapping

    headers = spark.createDataFrame([(1, 0, "Paid"), (2, 0, "Paid"), (2, 1, None), (3, 4, "Claim #")], "document_id long, column int, header string")
    got = {(r["document_id"], r["column"]): (r["field"], r["state"]) for r in mapping.build_mapping(headers).collect()}
    assert got == {(1, 0): ("paid_total", "MAPPED"), (2, 0): ("paid_total", "MAPPED"), (2, 1): (None, "UNMAPPED"), (3, 4): ("claim_number", "MAPPED")}
    plan = mapping.build_mapping(headers)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [header" in plan or "Aggregate [_h" in plan


def test_parse_day_reads_as_parse_date(spark):
    texts = ["2024-03-04", "2024-02-30", "1850-01-01", "2101-01-01", "Mar 4, 2024", "Feb 30, 2024", "Mar 04, 1899", "Abc 1, 2024", "MAR 4, 2024", "March 4, 2024", "03/04/2024", "2024-03-04\n", "2024-03-04 10:00", "N/A", "", "--", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_day(F.col("t")).alias("a"), dates.parse_date(F.col("t")).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []


def test_claims_of_rows_are_those_of_their_cells(spark):
    from claimloom.operators import mapping

    heads = {1: ["Claim #", "Status", "Paid", "Total Paid", "DOL", "Weather"], 2: ["Total Incurred", "Claim Number", "Date Reported"], 3: ["Weather"], 4: ["Total Incurred", "Claim Number", "Date Reported"]}
    table = [
        (1, 1, 1, ["CL-1", "open", "$1.00", "($2.50)", "Mar 4, 2024", "sun"]), (1, 1, 2, ["CL-2", None, "x", None, "03/04/2024"]), (1, 2, 1, ["12.00", "open", "1.00", "2.00", ""]), (1, 2, 2, ["CL-3"]),
        (2, 1, 5, ["EUR 3.00", " CL-4 ", "N/A"]), (2, 1, 4, ["1.234", "CL-5", "2024-03-04"]), (3, 1, 1, ["sun"]), (4, 1, 1, ["--", "CL-6", "Feb 30, 2024"]), (5, 1, 1, ["CL-7"]),
    ]
    cells = spark.createDataFrame([(d, p, r, i, t) for d, p, r, ts in table for i, t in enumerate(ts)], "document_id long, page int, row int, column int, text string")
    headers = spark.createDataFrame([(d, i, h) for d, hs in heads.items() for i, h in enumerate(hs)], "document_id long, column int, header string")
    want, _ = mapping.claims_of(cells, headers)
    got = mapping.build_claims_of_rows(spark.createDataFrame(table, "document_id long, page int, row int, cells array<string>"), spark.createDataFrame(list(heads.items()), "document_id long, headers array<string>"))
    assert got.columns == want.columns and want.count() == 6
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cells_to_claims_shuffles_the_lines_once(spark):
    from claimloom.plans.registry import QUERIES

    plan = QUERIES["cells_to_claims"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan.split("FileScan")[0]  # down to the lines
    assert top.count("Exchange hashpartitioning") == 1 and "Generate" not in top
