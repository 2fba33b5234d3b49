"""Reconciliation rules on small tables: each rule, runs of packets, skipping, order and status."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.operators import accounting, review, rules

D = Decimal
MONEY = "decimal(18,2)"
CLAIM = (
    "document_id long, run_id string, row_id int, page int, claim_number string, claim_status string, date_of_loss date, date_reported date, paid_indemnity decimal(18,2), paid_medical decimal(18,2), paid_expense decimal(18,2), paid_total decimal(18,2), "
    "reserve_indemnity decimal(18,2), reserve_medical decimal(18,2), reserve_expense decimal(18,2), reserve_total decimal(18,2), recovery_total decimal(18,2), incurred_total decimal(18,2), currency string, deductible_basis string, alae_treatment string"
)
DOC = "document_id long, run_id string, carrier string, insured string, policy_number string, valuation_date date, period_start date, period_end date, printed_count long, currency string, page_count int"


def columns(schema):
    return [f.split()[0] for f in schema.replace("array<int>", "array").split(", ")]


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in columns(schema)) for r in rows], schema)


def claim(**k):
    return dict(document_id=1, run_id="", row_id=1, page=1, claim_number="C1", claim_status="OPEN", date_of_loss=date(2024, 1, 5), date_reported=date(2024, 1, 6), deductible_basis="GROSS", alae_treatment="INSIDE", paid_total=D(10), reserve_total=D(5), incurred_total=D(15)) | k


def document(**k):
    return dict(document_id=1, run_id="", valuation_date=date(2024, 3, 1), page_count=0) | k


def evidence(spark, claims, docs, **tables):
    return rules.Evidence(table(spark, CLAIM, claims), table(spark, DOC, docs), {n: table(spark, rules.TABLES[n], r) for n, r in tables.items()})


def found(spark, rule, claims=(), docs=None, config=None, **tables):
    e = evidence(spark, claims, [document()] if docs is None else docs, **tables)
    return rules.REGISTRY[rule](e, config or rules.Config()).collect()


@pytest.mark.parametrize(
    ("rule", "row", "n"),
    [
        ("R-01", {}, 0), ("R-01", {"incurred_total": D("15.01")}, 0), ("R-01", {"incurred_total": D("15.02")}, 1), ("R-01", {"incurred_total": None}, 0), ("R-01", {"paid_total": None, "reserve_total": None}, 0),
        ("R-01", {"paid_total": None, "incurred_total": D(5)}, 0), ("R-01", {"paid_total": None, "paid_indemnity": D(3), "paid_medical": D(3), "paid_expense": D(4)}, 0), ("R-01", {"recovery_total": D(2)}, 1),
        ("R-01", {"paid_total": None, "reserve_total": None, "paid_indemnity": D(3)}, 0),
        ("R-02", {"paid_indemnity": D(9)}, 1), ("R-02", {}, 0), ("R-02", {"paid_total": None, "paid_indemnity": D(9)}, 0), ("R-03", {"reserve_medical": D(5)}, 0), ("R-07", {"date_of_loss": None, "incurred_total": None}, 2),
        ("R-08", {"claim_status": "CLOSED"}, 1), ("R-08", {"claim_status": "CLOSED_PAID"}, 0), ("R-10", {"date_reported": date(2024, 1, 1)}, 1), ("R-10", {"date_reported": date(2024, 5, 1), "date_of_loss": date(2024, 4, 1)}, 1),
        ("R-10", {"date_reported": date(2024, 5, 1), "date_of_loss": date(2024, 6, 1)}, 2), ("R-14", {"paid_total": D(-1)}, 1),
        ("R-17", {"paid_total": D(0), "reserve_total": D(0)}, 1), ("R-17", {"paid_total": None, "reserve_total": D(0)}, 1), ("R-17", {"paid_total": None, "reserve_total": None}, 0), ("R-17", {"paid_total": D(0), "reserve_total": D(5)}, 0),
        ("R-17", {"paid_total": D(0), "reserve_total": None, "claim_status": "REPORT_ONLY"}, 0), ("R-17", {"paid_total": D(0), "reserve_total": D(0), "incurred_total": D(9)}, 1),
        ("R-18", {"deductible_basis": "UNKNOWN"}, 1), ("R-18", {"deductible_basis": "UNKNOWN", "alae_treatment": "UNKNOWN"}, 2), ("R-18", {}, 0),
    ],
)
def test_rules_of_claims(spark, rule, row, n):
    assert len(found(spark, rule, [claim(**row)])) == n


def test_rules_of_units(spark):
    same_page = [claim(), claim(row_id=2)]
    assert [(r["subject"], r["page"]) for r in found(spark, "R-11", same_page)] == [("claim-number:C1", 1)] and not found(spark, "R-12", same_page)
    two_pages = [claim(), claim(row_id=2, page=2)]
    assert len(found(spark, "R-12", two_pages)) == 1 and not found(spark, "R-11", two_pages)
    assert [(r["actual"], r["expected"]) for r in found(spark, "R-16", [claim(currency="USD")], [document(currency="EUR")])] == [("EUR, USD", "EUR")]
    assert len(found(spark, "R-05", [], [document(printed_count=2)])) == 1 and len(found(spark, "R-20")) == 1 and len(found(spark, "R-18")) == 2
    assert len(found(spark, "R-06", [], [document(valuation_date=None)])) == 1
    odd = [claim(row_id=i, paid_total=None, reserve_total=None, incurred_total=D(x)) for i, x in enumerate([1, 1, 101])]
    assert [(r["expected"], r["actual"]) for r in found(spark, "R-13", odd)] == [("<= 100.00", "101.00")]
    assert not found(spark, "R-13", odd, config=rules.Config(outlier_multiple=101))
    window = [document(period_start=date(2024, 2, 1))]
    assert [(r["expected"], r["actual"]) for r in found(spark, "R-09", [claim()], window)] == [("2024-02-01 to ?", "2024-01-05")]


def test_printed_totals(spark):
    """One finding for each printed money column; nulls are skipped, other fields ignored, within the tolerance nothing."""
    printed = [dict(document_id=1, run_id="", field=f, amount=a) for f, a in (("incurred_total", D(30)), ("paid_total", D("10.01")), ("reserve_total", D(7)), ("claim_count", D(1)), ("recovery_total", None))]
    got = found(spark, "R-04", [claim(), claim(row_id=2, claim_number="C2", paid_total=None, reserve_total=None)], printed=printed)
    assert [(r["field"], r["expected"], r["actual"]) for r in got] == [("reserve_total", "7.00", "5.00")]
    got = found(spark, "R-04", [claim(incurred_total=None)], printed=[dict(document_id=1, run_id="", field="incurred_total", amount=D(1))])
    assert [(r["expected"], r["actual"]) for r in got] == [("1.00", "0.00")]
    assert not found(spark, "R-04", [claim(incurred_total=D("14.5"))], config=rules.Config(tolerance="0.5"), printed=[dict(document_id=1, run_id="", field="incurred_total", amount=D(15))])


def test_rules_of_evidence(spark):
    at = dict(document_id=1, run_id="")
    issues = [dict(at, row_id=1, claim_number="C1", field="paid_total", reason="UNPARSEABLE", page=1), dict(at, row_id=1, claim_number="C1", field="recovery_total", reason="EMPTY", page=1), dict(at, field="valuation_date", reason="AMBIGUOUS_DATE_ORDER")]
    assert [(r["scope"], r["field"], r["actual"]) for r in found(spark, "R-15", issues=issues)] == [("claim", "paid_total", "UNPARSEABLE"), ("document", "valuation_date", "AMBIGUOUS_DATE_ORDER")]
    assert [(r["expected"], r["actual"]) for r in found(spark, "R-19", [claim()], seen=[dict(at, page=1, rows=2), dict(at, page=2, rows=1)])] == [("3", "1")]
    columns_ = [dict(document_id=1, column=0, state="MAPPED", field="incurred_total"), dict(document_id=1, column=4, header="Incurred Medical", state="AMBIGUOUS", contested_field="incurred_total"), dict(document_id=1, column=6, state="AMBIGUOUS", contested_field="incurred_total")]
    got = found(spark, "R-21", mapping=[*columns_, dict(document_id=1, issue="saved format fits twice")])
    assert sorted((r["scope"], r["subject"], r["actual"]) for r in got) == [("column", "column 5", "3 columns claimed it"), ("column", "column 7", "3 columns claimed it"), ("document", "document", "profile rejected; conservative mapping used")]
    outcomes = [dict(document_id=1, page=p, outcome=o, reason=r) for p, o, r in ((1, "processed", None), (2, "failed", None), (2, "skipped", None), (3, "unresolved", "a picture"), (4, "unresolved", None))]
    got = sorted((r["condition"], r["actual"]) for r in found(spark, "R-22", [], [document(page_count=5)], outcomes=outcomes))
    assert got == [("page-2", "processing failed"), ("page-3", "a picture"), ("page-4", "the reader returned no rows for it"), ("page-5", "no processing outcome was recorded")]
    unplaced = [dict(at, page=2, row=7, field="paid_total", text="5.00", ambiguous=False), dict(at, page=2, row=7, field="incurred_total", text="6.00", ambiguous=False), dict(at, page=3, row=1, field="paid_total", text="9", ambiguous=True)]
    assert sorted((r["condition"], r["actual"]) for r in found(spark, "R-23", unplaced=unplaced)) == [("page-2-row-7", "incurred total 6.00, paid total 5.00"), ("page-3-row-1", "paid total 9")]
    assert [(r["condition"], r["page"]) for r in found(spark, "R-24", splits=[dict(document_id=1, left_page=2, right_page=3)])] == [("pages-2-3", 2)]
    assert [(r["condition"], r["page"]) for r in found(spark, "R-26", unreadable=[dict(at, field="paid_total", text="4 30,000.00")])] == [("page-0-row-unknown-paid_total", None)]
    assert [r["actual"] for r in found(spark, "R-27", counts=[dict(at, page=2, count=4), dict(at, page=1, count=3)])] == ["3 on page 1, 4 on page 2"]
    assert not found(spark, "R-27", docs=[document(printed_count=7)], counts=[dict(at, page=2, count=4)])
    refused = [dict(at, page=1, row=i, identifier=f"X{i}", report=i > 0) for i in range(13)]
    assert found(spark, "R-29", refused=refused)[0]["actual"].startswith("12: page 1 line 2 (X1); ") and found(spark, "R-29", refused=refused)[0]["actual"].endswith(" and 2 more")


def test_section_totals(spark):
    """A captured subtotal is checked for each of its money fields against the claims that it covers; one without claims is unchecked."""
    at = dict(document_id=1, run_id="", page=1, line=9, label="Subtotal")
    claims = [claim(incurred_total=D("30692.75"), paid_total=D(10)), claim(row_id=2, claim_number="C2", incurred_total=D(5), paid_total=None)]
    covers = [dict(document_id=1, page=1, line=9, row_id=1)]
    totals = lambda x: [dict(document_id=1, page=1, line=9, field="incurred_total", amount=D(x)), dict(document_id=1, page=1, line=9, field="paid_total", amount=D(10))]
    assert not found(spark, "R-25", claims, sections=[at | {"scope_known": True}], totals=totals("30692.75"), covers=covers)
    got = found(spark, "R-25", claims, sections=[at | {"scope_known": True}], totals=totals("999999.00"), covers=covers)
    assert [(r["condition"], r["expected"], r["actual"], r["category"]) for r in got] == [("mismatch-page-1-row-9-incurred_total", "999999.00", "30692.75", "financial")]
    got = found(spark, "R-25", claims, sections=[at | {"scope_known": False}], totals=totals("1.00"), covers=covers)
    assert [(r["condition"], r["category"]) for r in got] == [("unscoped-page-1-row-9", "extraction")]


def test_empty_tables(spark):
    for rule in rules.REGISTRY:
        assert found(spark, rule, [], []) == []
    e = evidence(spark, [], [], runs=[])
    assert rules.reconcile(e).count() == 0 and rules.document_status(e.docs, rules.reconcile(e)).count() == 0


def packet(spark, ambiguity=None, valuation=(date(2024, 3, 1), date(2024, 4, 1)), claims=None, **tables):
    run = lambda n, pages: dict(document_id=1, run_id=f"r{n}", ordinal=n, pages=pages, confidence="PRINTED", ambiguity=ambiguity if n == 2 else None)
    schema = rules.TABLES["runs"] + ", valuation_date date, printed_count long"
    runs = [run(1, [1, 2]) | dict(valuation_date=valuation[0], printed_count=1), run(2, [3]) | dict(valuation_date=valuation[1], printed_count=1)]
    claims = [claim(page=1), claim(row_id=2, page=3, claim_number="C2")] if claims is None else claims
    e = evidence(spark, claims, [document(printed_count=9)], **tables)
    return rules.Evidence(e.claims, e.docs, e.tables | {"runs": table(spark, schema, runs)})


def test_packets_are_judged_run_by_run(spark):
    """Each run has its own count; a finding that all runs give is reported once, and names no run."""
    got = rules.reconcile(packet(spark)).collect()
    assert got == []
    got = rules.reconcile(packet(spark, valuation=(None, None))).collect()
    assert [(r["rule"], r["run_id"]) for r in got] == [("R-06", "")]
    got = rules.reconcile(packet(spark, valuation=(date(2024, 3, 1), None), claims=[claim(page=1), claim(row_id=2, page=3, claim_number="C2"), claim(row_id=3, page=9, claim_number="C3")])).collect()
    assert sorted((r["rule"], r["run_id"], r["condition"]) for r in got) == [("R-06", "r2", "primary"), ("R-11", "", "no-run:3")]
    both = [claim(page=1), claim(row_id=2, page=3)]
    assert [(r["rule"], r["condition"], r["actual"]) for r in rules.reconcile(packet(spark, claims=both)).collect()] == [("R-11", "across-runs:C1:2024-01-05", "r1, r2")]


def test_unsettled_packets(spark):
    """Where a boundary isn't settled, printed figures are the whole packet's and an empty run is no finding of its own."""
    e = packet(spark, ambiguity="page 3 prints no number", claims=[claim(page=1)])
    got = sorted((r["rule"], r["run_id"], r["expected"], r["actual"]) for r in rules.reconcile(e).collect())
    assert [(r, u) for r, u, _, _ in got] == [("R-05", ""), ("R-18", "r2"), ("R-18", "r2"), ("R-28", "r2")] and got[0][2:] == ("9", "1")
    status = rules.run_status(e.table("runs"), rules.reconcile(e)).orderBy("run_id").collect()
    assert [(r["run_id"], r["status"]) for r in status] == [("r1", "CLEAN"), ("r2", "NEEDS_REVIEW")]
    settled = packet(spark, claims=[claim(page=1)])
    assert sorted({(r["rule"], r["run_id"]) for r in rules.reconcile(settled).collect()}) == [("R-05", "r2"), ("R-18", "r2"), ("R-20", "r2")]


def test_disabled_rules_order_and_status(spark):
    e = packet(spark, ambiguity="page 3 prints no number", claims=[claim(page=1, incurred_total=None, paid_total=D(-1))])
    findings = rules.ordered(rules.reconcile(e, rules.Config(disabled=("R-05",))), e.table("runs")).orderBy("place").collect()
    assert [(r["severity"], r["rule"]) for r in findings] == [("ERROR", "R-07"), ("ERROR", "R-28"), ("WARN", "R-18"), ("WARN", "R-18"), ("INFO", "R-14")]
    assert [r["status"] for r in rules.document_status(e.docs, rules.reconcile(e)).collect()] == ["NEEDS_REVIEW"]
    assert [r["status"] for r in rules.document_status(e.docs, rules.reconcile(e, rules.Config(disabled=tuple(rules.REGISTRY)))).collect()] == ["CLEAN"]


def test_all_rules_shuffle_each_table_once(spark):
    from claimloom.plans.registry import QUERIES

    plan = QUERIES["document_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "l_orderkey" in x]
    assert scans and all("Bucketed: true" in x or "claimloom_" in x for x in scans)


def test_triage_folds_histories_once(spark):
    from claimloom.plans.registry import QUERIES

    plan = QUERIES["triage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "claimloom_" in plan


def test_tally_numbers_what_reconcile_finds(spark):
    kind = ["document_id", "rule", "severity", "category", "scope"]
    odd = [claim(row_id=i, page=p, claim_number=c, currency=x, paid_total=a) for i, (p, c, x, a) in enumerate([(1, "A", "USD", D(-1)), (1, "A", "EUR", None), (3, "A", None, D(900)), (9, None, "USD", D(1)), (3, "B", "", D(1)), (3, "C", "USD", D(1))])]
    for doubt in (None, "page 3 prints no number"):
        e = packet(spark, ambiguity=doubt, claims=odd)
        want = {tuple(r) for r in rules.reconcile(e).groupBy(*kind).count().collect()}
        got = [tuple(r) for r in rules.tally(e).select(*kind, "n").collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
    assert rules.tally(e, rules.Config(disabled=tuple(rules.REGISTRY))).count() == 0


def test_counting_queries_make_no_texts_of_claim_findings(spark):
    from claimloom.plans.registry import QUERIES

    for name in ("review_status", "worst_severity", "finding_counters", "reconcile_counts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "reported-before-loss" not in plan and "R-10" in plan


def test_tally_by_unit_gives_the_accounting_of_the_findings(spark):
    kind = ["document_id", "run_id", "rule", "severity", "category", "scope"]
    odd = [claim(row_id=i, page=p, claim_number=c, paid_total=a) for i, (p, c, a) in enumerate([(1, "A", D(-1)), (1, "A", None), (3, "A", D(900)), (9, None, D(1))])]
    e = packet(spark, claims=odd)
    findings = rules.reconcile(e)
    blocking = findings.where(~F.col("rule").isin(list(review.HARMLESS)))
    counts = rules.tally(e, rules.Config(disabled=review.HARMLESS), rules.KEY)
    want = {tuple(r) for r in blocking.groupBy(*kind).count().collect()}
    assert want and {tuple(r) for r in counts.select(*kind, "n").collect()} == want
    assert findings.where(review.blocks_trust() & F.col("rule").isin(list(review.HARMLESS))).count() == 0
    judged = e.docs.select("document_id", F.lit(True).alias("reconciled"), F.lit(False).alias("needs_mapping"))
    of = lambda f: sorted(map(str, accounting.claim_accounting(rules.run_view(e), f, review.canonical_status(judged, f), review.canonical_run_status(e.table("runs"), f, judged)).collect()))
    assert of(counts) == of(findings)


def test_document_facts_of_a_tally_are_those_of_the_findings(spark):
    e = packet(spark, claims=[claim(row_id=i, page=p, claim_number="A", paid_total=D(a)) for i, (p, a) in enumerate([(1, -1), (1, 5), (3, 900), (9, 1)])])
    judged = e.docs.select("document_id", F.lit(True).alias("reconciled"), F.lit(False).alias("needs_mapping"))
    papers = e.docs.withColumns({"extraction_method": F.lit("digital"), "page_count": F.lit(4)})
    of = lambda f: sorted(map(str, accounting.document_facts(papers, f, accounting.printed_facts(rules.run_view(e)), review.canonical_status(judged, f)).collect()))
    assert of(rules.tally(e)) == of(rules.reconcile(e)) != []
