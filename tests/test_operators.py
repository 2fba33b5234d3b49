"""Rules, accounts, triage, structure and output on small tables."""

import random
from datetime import date
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import account, export, inference, packets, review, structure, submission, summary, triage

def naive_fold(rows):
    histories, unsure, place = [], set(), []
    for r in rows:
        states = [{account.same_claim(x, r) for x in h} for h in histories]
        same = [i for i, s in enumerate(states) if s == {"SAME"}]
        unknown = [i for i, s in enumerate(states) if s not in ({"SAME"}, {"DISTINCT"})]
        if len(same) == 1 and not unknown:
            histories[same[0]].append(r)
            place.append(same[0])
            continue
        histories.append([r])
        place.append(len(histories) - 1)
        if same or unknown:
            unsure |= {*same, *unknown, len(histories) - 1}
    return [(p, p in unsure) for p in place]



D = Decimal


def test_account_fold_against_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(f"a{rng.randrange(2)}", f"C{rng.randrange(4)}", i, 1, rng.choice(["x", "y", None]), rng.choice(["P1", "P2", None]), rng.choice(["t1", "t2", None])) for i in range(160)]
    df = spark.createDataFrame(rows, "account string, claim_number string, seq int, row_id long, carrier string, policy_number string, term string")
    got = {r["seq"]: (r["history"], r["uncertain"]) for r in account.histories(df).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        group = [r for r in rows if (r[0], r[1]) == key]
        want = naive_fold([{"carrier": r[4] and r[4].upper(), "policy": r[5], "term": r[6]} for r in group])
        assert [got[r[2]] for r in group] == want


SOURCES = "account string, document_id long, run_id string, filename string, carrier string, insured string, policy_number string, valuation_date date, terms array<struct<start:date,end:date>>"
ROWS = "document_id long, run_id string, row_id int, claim_number string, claim_status string, date_of_loss date, incurred_total decimal(18,2)"


def build(spark, sources, rows, trusted=True):
    s = account.in_order(spark.createDataFrame([("a", *x) for x in sources], SOURCES))
    shown = account.appearances(spark.createDataFrame(rows, ROWS), s).withColumn("trusted", F.lit(trusted))
    rolled = account.rollup(shown, account.histories(shown))
    return s, shown, rolled


def test_account_sources_development_and_drops(spark):
    """A later run that covers the loss and doesn't show the claim drops it; undated runs come first, and runs of one day in the order of their names."""
    year = (date(2023, 1, 1), date(2023, 12, 31))
    loss = date(2023, 5, 5)
    one = lambda i, carrier, policy, valued, term=year: (i, "", f"f{i}.pdf", carrier, "a", policy, valued, [term] if term else [])
    shows = lambda i, number="C1", amount=D(10), day=loss: (i, "", 1, number, "OPEN", day, amount)
    later = one(2, "X", "P", date(2024, 6, 1))

    def gone(sources, rows):
        s, shown, rolled = build(spark, sources, rows)
        return [(r["claim_number"], r["document_id"]) for r in account.omitted(rolled, shown, s).collect()]

    assert gone([one(1, " x ", "p", date(2024, 1, 1)), later], [shows(1), shows(2, "C2")]) == [("C1", 1)]
    assert gone([one(1, "X", "P", date(2024, 1, 1)), later], [shows(1), shows(2)]) == []
    assert gone([one(1, "X", "P", None), later], [shows(1)]) == [("C1", 1)]
    assert gone([one(1, "X", "P", date(2024, 6, 1)), later], [shows(1)]) == [("C1", 1)]
    assert gone([one(3, "X", "P", date(2024, 6, 1)), later], [shows(3)]) == []
    assert gone([one(1, "Y", "P", date(2024, 1, 1)), later], [shows(1)]) == []
    assert gone([one(1, "X", "P", date(2024, 1, 1)), one(2, "X", "P", date(2024, 6, 1), None)], [shows(1)]) == []
    assert gone([one(1, "X", "P", date(2024, 1, 1)), later], [shows(1, day=None)]) == []
    s, shown, rolled = build(spark, [one(1, "X", "P", date(2024, 1, 1)), later, one(4, None, "P", date(2025, 1, 1))], [shows(1), shows(2, amount=D(35)), shows(4, "C9", None)])
    got = {r["claim_number"]: r for r in rolled.collect()}
    assert (got["C1"]["movement"], got["C1"]["document_id"], got["C1"]["carriers"], got["C1"]["trusted"]) == (D(25), 2, ["X"], True) and got["C9"]["movement"] is None
    assert [r["claim_number"] for r in account.developed(rolled).collect()] == ["C1"]
    _, _, unsure = build(spark, [one(1, "X", "P", date(2024, 1, 1)), one(2, None, "P", date(2024, 6, 1))], [shows(1), shows(2)])
    assert [(r["uncertain"], r["trusted"]) for r in unsure.collect()] == [(True, False)] * 2
    status = spark.createDataFrame([(1, "CLEAN"), (2, "NEEDS_REVIEW")], "document_id long, status string")
    why = account.reasons(s.join(status, "document_id", "left").withColumn("insured", F.when(F.col("document_id") == 1, "Someone else").otherwise("A")), unsure).collect()[0]
    assert why["reasons"] == ["f1.pdf: names another insured", "f2.pdf: needs review", "f4.pdf: not reconciled", "carrier or policy not printed on every run for claim(s) C1: one claim counted twice, or two claims sharing a number"]
    assert (why["documents"], why["status"]) == (3, "NEEDS_REVIEW")


def test_identity():
    a = {"carrier": "X", "policy": "P", "term": None}
    assert account.same_claim(a, a) == "SAME" and account.same_claim(a, a | {"policy": "Q"}) == "DISTINCT" and account.same_claim(a, a | {"carrier": None}) == "UNKNOWN" and account.same_claim(a, a | {"policy": None}) == "UNKNOWN"


HISTORIES = "account string, claim_number string, history int, claim_status string, date_of_loss date, incurred_total decimal(28,2), earliest decimal(28,2), movement decimal(28,2), appearances long, uncertain boolean, line string, sources array<struct<document_id:bigint,run_id:string,row_id:bigint,claim_number:string>>, current array<struct<document_id:bigint,run_id:string,row_id:bigint,claim_number:string>>, alae_treatment string, deductible_basis string"


def history(number="C1", status="OPEN", incurred=D(10), earliest=None, movement=None, appearances=1, line=None, uncertain=False, documents=(1,), loss=date(2023, 5, 5), history=0):
    at = [(i, "", 1, number) for i in documents]
    return ("a", number, history, status, loss, incurred, earliest, movement, appearances, uncertain, line, at, at[-1:], "UNKNOWN", "GROSS")


def test_triage_says_what_it_could_not_judge(spark):
    rows = spark.createDataFrame([history(), history("C2", incurred=None), history("C3", "CLOSED", D(99)), history("C4", line="AUTO"), history("C5", "UNKNOWN")], HISTORIES)
    lines = {"AUTO": triage.Line(open_incurred_ceiling=D(50))}
    got = {(r["claim_numbers"][0], r["evaluated"]) for r in triage.open_incurred(rows, triage.Appetite(open_incurred_ceiling=D(5), by_line=lines)).collect()}
    assert got == {("C1", True), ("C2", False)}
    assert {(r["claim_numbers"][0], r["evaluated"]) for r in triage.open_incurred(rows, triage.Appetite(by_line=lines)).collect()} == {("C1", False), ("C2", False)}
    assert [(r["reason"], r["severity"]) for r in triage.open_incurred(rows, triage.Appetite()).collect()] == [("open-incurred ceiling not configured", "INFO")]
    assert [r["reason"] for r in triage.open_incurred(rows, triage.Appetite(open_incurred_ceiling=D(5), open_statuses=())).collect()] == [triage.NO_OPEN]
    assert [r["claim_numbers"] for r in triage.unknown_status(rows, triage.Appetite()).collect()] == [["C5"]]
    for bad in (dict(development_amount=1.5), dict(open_incurred_ceiling=D(-1)), dict(open_statuses=("NEW",)), dict(term_claim_count_ceiling=-1)):
        with pytest.raises(ValueError):
            triage.Appetite(**bad)


def test_development_alerts(spark):
    """Movement counts up and down, both thresholds are strict, and an unknown or zero basis is said."""
    rows = [("up", D(100), D(60)), ("down", D(100), D(-60)), ("small", D(100), D(50)), ("share", D(1000), D(60)), ("none", None, None), ("zero", D(0), D(60)), ("still", D(100), None)]
    df = spark.createDataFrame([history(n, earliest=e, movement=m, appearances=2) for n, e, m in rows], HISTORIES)
    rules = triage.Appetite(development_amount=D(50), development_percent=D(50))
    got = {r["claim_numbers"][0]: (r["evaluated"], r["reason"]) for r in triage.development_alert(df, rules).collect()}
    assert {k: v[0] for k, v in got.items()} == {"up": True, "down": True, "none": False, "zero": False}
    assert got["up"][1] == "incurred grew from 100.00 to 10.00 - movement 60.00 exceeds alert amount 50.00; 60.00% of the earliest valuation exceeds the 50.00% alert"
    only = triage.development_alert(df, triage.Appetite(development_amount=D(50))).collect()
    assert sorted(r["claim_numbers"][0] for r in only) == ["down", "share", "up", "zero"]


def test_flags_merge(spark):
    """Two histories of one number give one flag, whose reasons keep their order; terms hold their claims."""
    df = spark.createDataFrame([history(incurred=D(99), documents=(7,)), history(incurred=None, documents=(3,), history=1), history("C2", incurred=D(99))], HISTORIES)
    rules = triage.Appetite(open_incurred_ceiling=D(5), term_claim_count_ceiling=2)
    got = {r["claim_numbers"][0]: r for r in triage.merged(triage.open_incurred(df, rules)).collect()}
    assert not got["C1"]["evaluated"] and got["C1"]["reason"].startswith("open claim C1 carries no") and [x["document_id"] for x in got["C1"]["sources"]] == [3, 7] and got["C2"]["evaluated"]
    terms = spark.createDataFrame([("a", date(2023, 1, 1), date(2023, 12, 31))], "account string, term_start date, term_end date")
    flag = triage.term_counts(triage.periods(df, terms), rules).collect()
    assert [(r["claim_numbers"], r["reason"]) for r in flag] == [(["C1", "C2"], "period 2023-01-01 to 2023-12-31 holds 3 claims, above the ceiling of 2")]
    sources = spark.createDataFrame([("a", "f.pdf", "", 1, None)], "account string, filename string, run_id string, seq int, status string")
    items = triage.not_evaluated(df, triage.merged(triage.open_incurred(df, rules)), sources).collect()[0]["items"]
    assert items[1:] == ["3 claim(s) carry UNKNOWN ALAE treatment - ALAE treatment not evaluated", "f.pdf: not reconciled - source not trusted"]


def test_terms(spark):
    c = spark.createDataFrame([(1, 1, "OPEN", date(2024, 1, 5)), (1, 2, "OPEN", date(2024, 2, 1)), (1, 3, "CLOSED", date(2030, 1, 1)), (2, 1, "OPEN", None)], "document_id long, row_id int, claim_status string, date_of_loss date").withColumn("claim_number", F.concat(F.lit("C"), "row_id"))
    c = c.withColumns({f: F.lit(1).cast("decimal(18,2)") for f in summary.FIELDS})
    t = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 12, 31)), (1, date(2024, 2, 1), date(2024, 2, 28)), (1, date(2020, 1, 1), date(2020, 12, 31))], "document_id long, term_start date, term_end date")
    got = {(r["document_id"], r["term"]): r["claims"] for r in summary.by_term(c, t).collect()}
    assert got == {(1, "2024-01-01 to 2024-12-31"): 1, (1, summary.SEVERAL): 1, (1, summary.OUTSIDE): 1, (1, "2020-01-01 to 2020-12-31"): 0, (1, "2024-02-01 to 2024-02-28"): 0, (2, summary.UNDATED): 1}


def test_runs_of_a_packet(spark):
    pages = [(1, 1, 1, 2, "A", None), (1, 2, 2, 2, "A", None), (1, 3, 1, 3, "B", None), (1, 4, 2, 3, None, None), (1, 5, None, None, None, None)]
    got = packets.plan_runs(spark.createDataFrame(pages, "document_id long, page int, k int, n int, heading string, policy string")).orderBy("page").collect()
    assert [(r["page"], r["run"], r["evidence"]) for r in got] == [(1, 0, "first"), (2, 0, "printed"), (3, 1, "printed"), (4, 1, "printed"), (5, 1, "silent")]
    assert [r["ambiguous"] for r in got] == [False, False, True, True, True]


def test_structure(spark):
    words = spark.createDataFrame([(1, 1, "a", 0.0, 10.0, 8.0), (1, 1, "b", 5.0, 12.0, 8.0), (1, 1, "c", 0.0, 30.0, 8.0)], "document_id long, page int, text string, x0 double, centre double, height double")
    assert sorted((r["text"], r["line"]) for r in structure.cluster_lines(words).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert structure.covered_area(pd.DataFrame({"x0": [0, 1], "y0": [0, 1], "x1": [2, 3], "y1": [2, 3]})) == 7
    cells = spark.createDataFrame([(1, 1, "x", 5.0, 9.0), (1, 2, "y", 40.0, 44.0)], "k int, word int, text string, x0 double, x1 double")
    cols = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 20.0, 30.0)], "k int, column int, x0 double, x1 double")
    assert sorted((r["text"], r["column"]) for r in structure.assign_columns(cells, cols, ["k"]).collect()) == [("x", 1), ("y", 2)]


def test_redaction(spark):
    texts = spark.createDataFrame([(1, "Paid MARY ann o'brien; Ann left. Annex"), (2, "none")], "k int, t string")
    secrets = spark.createDataFrame([(1, "Mary Ann O'Brien"), (1, None), (1, " ")], "k int, value string")
    got = {r["k"]: r["t"] for r in export.redact(texts, secrets, "k", "t").collect()}
    assert got == {1: "Paid [redacted]; [redacted] left. Annex", 2: "none"}


def test_review_and_votes(spark):
    log = spark.createDataFrame([("k", 1, "ACCEPTED", "ERROR", "1.00", None), ("k", 2, "CORRECTED", "ERROR", "1", None)], "key string, seq int, action string, severity string, expected string, actual string")
    f = spark.createDataFrame([("k", "ERROR", "1.000", None), ("z", "WARN", None, None)], "key string, severity string, expected string, actual string")
    assert {r["key"]: r["decision"] for r in review.open_findings(f, log).collect()} == {"k": "CORRECTED", "z": None}
    votes = spark.createDataFrame([(1, "1,234.50"), (1, "12"), (2, "1.234,50"), (2, "1,234.50"), (3, "1,234")], "k int, t string")
    assert {r["k"]: r["locale"] for r in inference.infer_locale(votes, "k", "t").collect()} == {1: "us", 2: None, 3: None}
    parts = spark.createDataFrame([("s", i, str(i % 3), 1, "pdf") for i in range(5)], "submission string, position int, sha string, bytes long, kind string")
    assert [r["outcome"] for r in submission.attachments(parts, most=2).orderBy("position").collect()] == ["accepted", "accepted", "over_limit", "duplicate", "duplicate"]


@pytest.mark.parametrize("parts", [(3, 3, 4), (2, 3, 30), (6, 2, 1), (1, 9, 9)])
def test_history_fold_of_many_letterheads_against_a_plain_version(parts):
    rng = random.Random(sum(parts))
    for n in (1, 7, 40, 150):
        for empty in (0.0, 0.05, 0.4):
            one = lambda n: None if rng.random() < empty else str(rng.randrange(n))  # noqa: E731, B023
            rows = [dict(zip(("carrier", "policy", "term"), map(one, parts), strict=True)) for _ in range(n)]
            assert account.fold_histories(rows) == naive_fold(rows)


def test_history_fold_does_not_compare_every_pair(monkeypatch):
    rng, calls, plain = random.Random(1), [0], account.same_claim

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)

    monkeypatch.setattr(account, "same_claim", counted)
    rows = [{"carrier": rng.choice([None, "a", "b"]), "policy": rng.choice([None, "P", "Q"]), "term": rng.choice([None, *map(str, range(50))])} for _ in range(3000)]
    assert len(account.fold_histories(rows)) == 3000 and calls[0] < 10 * 3000


def test_swept_terms_are_those_of_the_label(spark):
    terms = spark.sql("select concat('A', id % 3) as account, date_add(date'2020-01-01', cast(id * 37 % 300 as int)) as term_start, date_add(date'2020-01-01', cast(id * 37 % 300 + id % 9 * 10 - 5 as int)) as term_end from range(40)")
    rows = spark.sql("select concat('A', id % 4) as account, id as row_id, case when id % 50 > 1 then date_add(date'2019-12-20', cast(id as int)) end as date_of_loss from range(400)")
    want = rows.join(summary.declared_terms(terms, "account"), "account", "left").withColumn("term", summary.term_label(F.col("terms"), F.col("date_of_loss"))).select("row_id", "term")
    got = summary.with_term(rows, terms, "account").select("row_id", "term")
    assert sorted(got.collect()) == sorted(want.collect()) and got.where(f"term = '{summary.SEVERAL}'").count() and got.where("term like '% to %'").count()


def test_run_status_reads_the_findings_once(spark):
    runs = spark.createDataFrame([(1, "r1"), (1, "r2"), (2, "r1"), (3, "r1"), (4, "r1")], "document_id long, run_id string")
    docs = spark.createDataFrame([(1, True, False), (2, True, False), (3, True, False)], "document_id long, reconciled boolean, needs_mapping boolean")
    findings = spark.createDataFrame([(1, "r2", "R-01", "ERROR", "financial"), (2, "", "R-01", "ERROR", "financial")], "document_id long, run_id string, rule string, severity string, category string").withColumn("_read", F.uuid())
    got = review.canonical_run_status(runs, findings, docs)
    assert {(r["document_id"], r["run_id"]): r["review_status"] for r in got.collect()} == {(1, "r1"): "CLEAN", (1, "r2"): "NEEDS_REVIEW", (2, "r1"): "NEEDS_REVIEW", (3, "r1"): "CLEAN", (4, "r1"): "NEEDS_REVIEW"}
    assert got._jdf.queryExecution().analyzed().toString().count("uuid(") == 1
