"""Reconciliation rules: findings about claims, documents and the runs of packets.

What rules read is an Evidence: claims, documents and the tables of what was read beside them. A unit is what rules judge:
a document, or one run of a packet (a document of several runs). Units are keyed by document_id and run_id, which is
empty for a whole document. Rules of single claims are one pass over the claims, and rules of whole units one aggregation
of them, by claim number and then by unit, with map-side partial sums; each gives an array of findings, exploded. A null is never a zero:
each rule says how it treats one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.types import MONEY_FIELDS, OUTLIER_MULTIPLE, PAID_PARTS, RESERVE_PARTS, REVIEW_REASONS, TOLERANCE

KEY = ["document_id", "run_id"]
FINDING = ["rule", "severity", "category", "scope", *KEY, "subject", "claim_number", "field", "condition", "page", "expected", "actual"]
#: Findings of one kind about a document, and their number.
COUNTED = ["document_id", "rule", "severity", "category", "scope", "n"]
AMOUNT = "decimal(28,2)"

#: Severity, category and scope of each rule.
KINDS = {
    "R-01": ("ERROR", "financial", "claim"), "R-02": ("ERROR", "financial", "claim"), "R-03": ("ERROR", "financial", "claim"), "R-04": ("ERROR", "financial", "document"),
    "R-05": ("ERROR", "financial", "document"), "R-06": ("ERROR", "extraction", "document"), "R-07": ("ERROR", "extraction", "claim"), "R-08": ("WARN", "underwriting", "claim"),
    "R-09": ("WARN", "underwriting", "claim"), "R-10": ("WARN", "underwriting", "claim"), "R-11": ("ERROR", "extraction", "group"), "R-12": ("WARN", "extraction", "group"),
    "R-13": ("WARN", "underwriting", "claim"), "R-14": ("INFO", "underwriting", "claim"), "R-15": ("WARN", "extraction", "claim"), "R-16": ("WARN", "underwriting", "document"),
    "R-17": ("WARN", "underwriting", "claim"), "R-18": ("WARN", "underwriting", "document"), "R-19": ("WARN", "underwriting", "document"), "R-20": ("ERROR", "extraction", "document"),
    "R-21": ("ERROR", "extraction", "document"), "R-22": ("ERROR", "extraction", "document"), "R-23": ("ERROR", "extraction", "document"), "R-24": ("ERROR", "extraction", "document"),
    "R-25": ("ERROR", "financial", "document"), "R-26": ("ERROR", "extraction", "document"), "R-27": ("ERROR", "extraction", "document"), "R-28": ("ERROR", "extraction", "document"),
    "R-29": ("ERROR", "extraction", "document"),
}

#: Rules that compare with printed figures, which belong to a run only where the packet's split is settled.
PRINTED_RULES = ["R-04", "R-05", "R-25", "R-26", "R-27"]
#: Rules about the whole document, reported once where every run gives the same finding.
DOCUMENT_WIDE = ["R-06", "R-15", "R-16", "R-18", "R-21", "R-22", "R-24"]
#: Ways of bounding a run that settle it.
SETTLED_BY = ["PRINTED", "STRUCTURAL"]
#: Rows that a finding lists.
LISTED = 10

#: What is not stated on a document.
BASES = {"deductible_basis": "UNKNOWN", "alae_treatment": "UNKNOWN"}

TABLES = {
    "printed": "document_id long, run_id string, field string, amount decimal(28,2)",
    "issues": "document_id long, run_id string, page int, row_id int, claim_number string, field string, reason string",
    "mapping": "document_id long, column int, header string, state string, field string, contested_field string, issue string",
    "outcomes": "document_id long, page int, outcome string, reason string",
    "unplaced": "document_id long, run_id string, page int, row int, field string, text string, ambiguous boolean",
    "splits": "document_id long, left_page int, right_page int",
    "sections": "document_id long, run_id string, page int, line int, label string, scope_known boolean",
    "totals": "document_id long, page int, line int, field string, amount decimal(28,2)",
    "covers": "document_id long, page int, line int, row_id int",
    "unreadable": "document_id long, run_id string, page int, line int, field string, text string",
    "counts": "document_id long, run_id string, page int, count int",
    "seen": "document_id long, run_id string, page int, rows int",
    "refused": "document_id long, run_id string, page int, row int, identifier string, report boolean",
    "runs": "document_id long, run_id string, ordinal int, pages array<int>, confidence string, ambiguity string, incomplete string, borrowed string",
}


@dataclass(frozen=True)
class Config:
    """Settings of a reconciliation: the money tolerance, how many medians make an outlier, the reasons that a person reviews, rules left out."""

    tolerance: str = TOLERANCE
    outlier_multiple: int = OUTLIER_MULTIPLE
    review_reasons: tuple[str, ...] = tuple(REVIEW_REASONS)
    disabled: tuple[str, ...] = ()


@dataclass(frozen=True)
class Evidence:
    """Claims and documents, both with document_id and run_id, and TABLES; an absent table is an empty one. A printed amount or count belongs to the unit that it names."""

    claims: DataFrame
    docs: DataFrame
    tables: dict[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else empty(self.claims.sparkSession, name)

    def has(self, name: str) -> bool:
        return name in self.tables


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, joined as a balanced tree, so that the plan of no part is analysed more than a few times."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def said(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("'", "\\'") + "'"


# Findings are SQL texts, so that a plan of many rules is built in few calls.


def _fields(name: str, subject="'document'", claim="null", field="null", condition="'primary'", page="null", expected="null", actual="null", scope: str | None = None, category: str | None = None) -> dict[str, str]:
    severity, kind, usual = KINDS[name]
    text = lambda x: f"cast({x} as string)"
    return {
        "rule": said(name), "severity": said(severity), "category": said(category or kind), "scope": said(scope or usual), "subject": text(subject), "claim_number": text(claim), "field": text(field),
        "condition": text(condition), "page": f"cast({page} as int)", "expected": text(expected), "actual": text(actual),
    }


def _finding(name: str, run: str = "run_id", **k) -> list[str]:
    """The columns of FINDING as SQL; run: the run's id."""
    c = _fields(name, **k) | {"document_id": "document_id", "run_id": run}
    return [f"{c[x]} as {x}" for x in FINDING]


def _row(name: str, **k) -> str:
    """A finding without its keys."""
    return "named_struct(" + ", ".join(f"'{x}', {c}" for x, c in _fields(name, **k).items()) + ")"


def _when(test: str, name: str, **k) -> str:
    """A finding without its keys where the test holds, else null."""
    return f"case when {test} then {_row(name, **k)} end"


def _spread(rows: DataFrame, found: str) -> DataFrame:
    """One row for each element of an array of findings."""
    return rows.selectExpr(*KEY, f"explode({found}) as f").selectExpr(*KEY, "f.*").select(*FINDING)


def _sum(fields: list[str], skip_null: bool) -> str:
    """The sum of columns: null where any is null, or, skipping nulls, where all are."""
    if not skip_null:
        return f"cast({' + '.join(fields)} as {AMOUNT})"
    return f"case when coalesce({', '.join(fields)}) is not null then cast({' + '.join(f'coalesce({f}, 0)' for f in fields)} as {AMOUNT}) end"


def _beyond(c: str, config: Config) -> str:
    return f"abs({c}) > cast('{config.tolerance}' as decimal(18,6))"


def label(field: str) -> str:
    return f"replace({field}, '_', ' ')"


# --- rules of single claims -------------------------------------------------

CLAIM_RULES = ["R-01", "R-02", "R-03", "R-07", "R-08", "R-09", "R-10", "R-14", "R-17"]


def _claim_facts(e: Evidence) -> DataFrame:
    """Claims with their unit's dates, and what the rules compare."""
    own = e.claims.join(e.docs.select(*KEY, "valuation_date", "period_start", "period_end"), KEY, "left")
    own = own.selectExpr("*", f"coalesce(paid_total, {_sum(PAID_PARTS, False)}) as _paid", f"coalesce(reserve_total, {_sum(RESERVE_PARTS, False)}) as _reserve", f"{_sum(PAID_PARTS, True)} as _paid_parts", f"{_sum(RESERVE_PARTS, True)} as _reserve_parts")
    return own.selectExpr("*", f"cast(coalesce(_paid, 0) + coalesce(_reserve, 0) - coalesce(recovery_total, 0) as {AMOUNT}) as _expected", "case when date_reported > valuation_date then 'date_reported' when date_of_loss > valuation_date then 'date_of_loss' end as _late")


def _claim_checks(config: Config, only: list[str] | None = None) -> list[tuple[str, str, dict]]:
    """Each rule of single claims: its id, its test, and what its finding says."""
    window = "concat(coalesce(cast(period_start as string), '?'), ' to ', coalesce(cast(period_end as string), '?'))"
    no_money = "(paid_total is not null or reserve_total is not null) and coalesce(paid_total, 0) = 0 and coalesce(reserve_total, 0) = 0 and claim_status <> 'REPORT_ONLY'"
    checks = [
        ("R-01", f"incurred_total is not null and (_paid is not null or _reserve is not null) and {_beyond('incurred_total - _expected', config)}", dict(field="'incurred_total'", expected="_expected", actual="incurred_total")),
        ("R-02", _beyond("paid_total - _paid_parts", config), dict(field="'paid_total'", expected="_paid_parts", actual="paid_total")),
        ("R-03", _beyond("reserve_total - _reserve_parts", config), dict(field="'reserve_total'", expected="_reserve_parts", actual="reserve_total")),
        ("R-07", "date_of_loss is null", dict(field="'date_of_loss'", expected="'a value'")),
        ("R-07", "incurred_total is null", dict(field="'incurred_total'", expected="'a value'")),
        ("R-08", f"claim_status = 'CLOSED' and {_beyond('reserve_total', config)}", dict(field="'reserve_total'", expected="'0'", actual="reserve_total")),
        ("R-09", "date_of_loss < period_start or date_of_loss > period_end", dict(field="'date_of_loss'", expected=window, actual="date_of_loss")),
        ("R-10", "date_reported < date_of_loss", dict(field="'date_reported'", condition="'reported-before-loss'", expected="concat('on or after ', cast(date_of_loss as string))", actual="date_reported")),
        ("R-10", "_late is not null", dict(field="_late", condition="'after-valuation'", expected="concat('on or before ', cast(valuation_date as string))", actual="case when _late = 'date_reported' then date_reported else date_of_loss end")),
        ("R-14", "paid_total < 0", dict(field="'paid_total'", actual="paid_total")),
        ("R-17", no_money, dict(field="'paid_total'", expected="'a paid or reserve amount'", actual="'0.00 and 0.00'")),
    ]
    return [x for x in checks if not only or x[0] in only]


def claim_rules(e: Evidence, config: Config = Config(), only: list[str] | None = None) -> DataFrame:
    """The rules that look at one claim and its unit's dates, in one pass over the claims."""
    found = [_when(test, n, subject="row_id", claim="claim_number", page="page", **k) for n, test, k in _claim_checks(config, only)]
    return _spread(_claim_facts(e), f"array_compact(array({', '.join(found)}))")


def claim_counts(e: Evidence, config: Config = Config(), only: list[str] | None = None, by: list[str] = KEY[:1]) -> DataFrame:
    """COUNTED of the findings of claim_rules: the same tests, added up by document, or by unit."""
    checks = _claim_checks(config, only)
    each = {n: " + ".join(f"if(coalesce({test}, false), 1, 0)" for m, test, _ in checks if m == n) for n, _, _ in checks}
    g = _claim_facts(e).groupBy(*by).agg(*[F.expr(f"sum({x})").alias(n) for n, x in each.items()])
    rows = [f"case when `{n}` > 0 then named_struct('rule', {said(n)}, 'severity', {said(KINDS[n][0])}, 'category', {said(KINDS[n][1])}, 'scope', {said(KINDS[n][2])}, 'n', `{n}`) end" for n in each]
    return g.selectExpr(*by, f"explode(array_compact(array({', '.join(rows)}))) as f").selectExpr(*by, "f.*").select(*by, *COUNTED[1:])


def unpivot(claims: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """One row for each field: keys, field, amount."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast(AMOUNT).alias("amount")) for f in fields]))
    return claims.select(*keys, each.alias("x")).select(*keys, "x.field", "x.amount")


def outliers(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-13: amounts beyond a multiple of the exact median of their unit's column; three amounts other than zero at least.

    No median lies below the least amount, so only units with a column whose largest is beyond the multiple of its least are ranked.
    """
    sizes = [f"nullif(abs({f}), 0)" for f in MONEY_FIELDS]
    wide = e.claims.groupBy(*KEY).agg(*[F.expr(f"{g}({x})").alias(f"{g}{i}") for i, x in enumerate(sizes) for g in ("min", "max")])
    may = wide.where(" or ".join(f"max{i} > min{i} * {config.outlier_multiple}" for i in range(len(sizes)))).select(*KEY)
    rows = unpivot(e.claims.join(may, KEY, "left_semi"), MONEY_FIELDS, [*KEY, "claim_number", "row_id", "page"]).withColumn("size", F.abs("amount")).where("size > 0")
    one = Window.partitionBy(*KEY, "field")
    ranked = rows.withColumn("k", F.row_number().over(one.orderBy("size", "row_id"))).withColumn("n", F.count("*").over(one))
    middle = (F.col("k") == F.expr("(n + 1) div 2")) | (F.col("k") == F.expr("(n + 2) div 2"))
    twice = F.sum(F.when(middle, F.when(F.col("n") % 2 == 1, F.col("size") * 2).otherwise(F.col("size")))).over(one)
    found = ranked.withColumn("twice", twice).where(f"n >= 3 and size * 2 > twice * {config.outlier_multiple}")
    ceiling = f"concat('<= ', cast(cast(twice * {config.outlier_multiple} / 2 as {AMOUNT}) as string))"
    return found.selectExpr(*_finding("R-13", subject="row_id", claim="claim_number", field="field", page="page", expected=ceiling, actual="amount"))


# --- rules of whole units ----------------------------------------------------

UNIT_RULES = ["R-04", "R-05", "R-06", "R-11", "R-12", "R-16", "R-18", "R-20"]


def unit_facts(claims: DataFrame, asked: list[str]) -> list[DataFrame]:
    """What the asked rules need of all claims of a unit, by unit: n, sums by field and the bases that no claim states; currencies; repeated claim numbers. Each apart, so that numbers add up without lists."""
    aggs = [F.expr("count(*) as n")]
    if "R-04" in asked:
        aggs += [F.expr(f"cast(sum({f}) as {AMOUNT}) as {f}") for f in MONEY_FIELDS]
    if "R-18" in asked:
        aggs += [F.expr(f"bool_and({b} = '{unknown}') as {b}") for b, unknown in BASES.items()]
    facts = [claims.groupBy(*KEY).agg(*aggs)] if {"R-04", "R-05", "R-18", "R-20"} & {*asked} else []
    if "R-16" in asked:
        facts.append(claims.where("currency <> ''").select(*KEY, "currency").distinct().groupBy(*KEY).agg(F.expr("collect_list(currency) as currencies")))
    if {"R-11", "R-12"} & {*asked}:
        same = claims.groupBy(*KEY, "claim_number").agg(F.expr("count(*) as n"), F.expr("min(page) as lo"), F.expr("max(page) as hi")).where("n > 1")
        facts.append(same.groupBy(*KEY).agg(F.expr("collect_list(struct(claim_number, n, lo, hi)) as repeated")))
    return facts


def unit_rules(e: Evidence, config: Config = Config(), only: list[str] | None = None) -> DataFrame:
    """R-04, R-05, R-06, R-11, R-12, R-16, R-18 and R-20, from aggregations of the claims. Sums skip nulls, and no claims sum to zero."""
    rules = only or UNIT_RULES
    unit = e.docs.selectExpr(*KEY, "valuation_date", "printed_count", "currency as own_currency")
    for facts in unit_facts(e.claims, rules):
        unit = unit.join(facts, KEY, "left")
    if "R-04" in rules:
        unit = unit.join(e.table("printed").where("amount is not null").groupBy(*KEY).agg(F.expr(f"collect_list(struct(field, cast(amount as {AMOUNT}) as amount)) as printed")), KEY, "left")
    sums = ", ".join(f"'{f}', coalesce({f}, cast(0 as {AMOUNT}))" for f in MONEY_FIELDS)
    used = "sort_array(filter(array_compact(array_distinct(concat(coalesce(currencies, array()), array(own_currency)))), x -> x <> ''))"
    made = {"n": "coalesce(n, 0)", "used": used if "R-16" in rules else None, "sums": f"map({sums})" if "R-04" in rules else None}
    unit = unit.selectExpr(*[c for c in unit.columns if c not in (*MONEY_FIELDS, "n")], *[f"{x} as {c}" for c, x in made.items() if x and (c != "n" or "n" in unit.columns)])
    whole = [
        ("R-05", _when("n <> printed_count", "R-05", field="'claim_count'", expected="printed_count", actual="n")),
        ("R-06", _when("valuation_date is null", "R-06", field="'valuation_date'", expected="'a date'")),
        ("R-16", _when("size(used) > 1", "R-16", field="'currency'", expected="own_currency", actual="array_join(used, ', ')")),
        *[("R-18", _when(f"coalesce({b}, true)", "R-18", field=said(b), expected="'stated on the document'", actual="'unknown'")) for b in BASES],
        ("R-20", _when("n = 0", "R-20", expected="'at least one claim'", actual="'0'")),
    ]
    same = dict(subject="concat('claim-number:', r.claim_number)", claim="r.claim_number", field="'claim_number'", page="r.lo", expected="1", actual="r.n")
    missed = f"filter(printed, p -> {_beyond('sums[p.field] - p.amount', config)})"
    lists = [
        ("R-04", f"transform({missed}, p -> {_row('R-04', field='p.field', expected='p.amount', actual='sums[p.field]')})"),
        ("R-11", f"transform(filter(repeated, r -> r.lo = r.hi), r -> {_row('R-11', **same)})"), ("R-12", f"transform(filter(repeated, r -> r.lo < r.hi), r -> {_row('R-12', **same)})"),
    ]
    asked = lambda parts: [x for r, x in parts if r in rules]
    parts = ([f"array_compact(array({', '.join(asked(whole))}))"] if asked(whole) else []) + asked(lists)
    return _spread(unit, f"flatten(array_compact(array({', '.join(parts)})))")


# --- rules of what was read beside the claims ------------------------------------


def field_issues(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-15: nulls whose reason a person should look at, of claims, and of documents (row_id null)."""
    rows = e.table("issues").where(F.col("reason").isin(list(config.review_reasons)))
    of_claim = rows.where("row_id is not null").selectExpr(*_finding("R-15", subject="row_id", claim="claim_number", field="field", page="page", actual="reason"))
    return of_claim.unionByName(rows.where("row_id is null").selectExpr(*_finding("R-15", field="field", actual="reason", scope="document")))


def rows_seen(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-19: rows that looked like claims against claims read, where any were counted."""
    n = e.claims.groupBy(*KEY).agg(F.expr("count(*) as n"))
    total = e.table("seen").groupBy(*KEY).agg(F.expr("sum(rows) as seen"))
    return total.join(n, KEY, "left").where("seen <> coalesce(n, 0)").selectExpr(*_finding("R-19", expected="seen", actual="coalesce(n, 0)"))


def mapping_issues(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-21: a saved format that the document rejects, and each column that could carry a field that another one carries."""
    rows = e.table("mapping")
    rejected = rows.where("issue is not null").selectExpr(*_finding("R-21", "''", condition="'profile-mismatch'", expected="'saved source-column structure to match uniquely'", actual="'profile rejected; conservative mapping used'"))
    contested = rows.where("state = 'AMBIGUOUS' and contested_field <> ''").selectExpr("*", "count(*) over (partition by document_id) as n")
    name = f"concat('one column per ', {label('contested_field')})"
    each = contested.selectExpr(*_finding("R-21", "''", subject="concat('column ', column + 1)", field="contested_field", expected=name, actual="concat(n + 1, ' columns claimed it')", scope="column"))
    return rejected.unionByName(each)


#: What became of a page, the gravest first, and how findings say it.
OUTCOMES = {"failed": "processing failed", "skipped": "processing was skipped", "unresolved": "the reader returned no rows for it", "unaccounted": "no processing outcome was recorded"}


def page_outcomes(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-22: pages that were not processed, by their gravest outcome; an unresolved page by its own reason. docs: page_count."""
    docs = e.docs.where("page_count > 0").groupBy("document_id").agg(F.expr("max(page_count) as page_count"))
    pages = docs.selectExpr("document_id", "explode(sequence(1, page_count)) as page")
    names = list(OUTCOMES)
    gravity = f"array_position(array({', '.join(map(said, names[:3]))}), outcome)"
    known = e.table("outcomes").groupBy("document_id", "page").agg(F.expr(f"min(case when {gravity} > 0 then {gravity} end) as worst"), F.expr("bool_or(outcome = 'processed') as done"), F.expr("min(case when outcome = 'unresolved' then reason end) as reason"))
    both = pages.join(known, ["document_id", "page"], "full").selectExpr("*", f"coalesce(worst, case when not coalesce(done, false) then {len(names)} end) as gravity").where("gravity is not null")
    words = f"element_at(array({', '.join(map(said, OUTCOMES.values()))}), cast(gravity as int))"
    actual = f"case when gravity = 3 then coalesce(reason, {words}) else {words} end"
    return both.selectExpr(*_finding("R-22", "''", condition="concat('page-', page)", page="page", expected="'source page processed successfully'", actual=actual))


def unplaced_rows(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-23: rows with money, or with numbers under money columns, that no claim or total took; one finding a row."""
    shown = f"array_join(transform(sort_array(collect_list(struct(field, concat_ws(' ', {label('field')}, text) as shown))), x -> x.shown), ', ') as shown"
    rows = e.table("unplaced").groupBy(*KEY, "page", "row").agg(F.expr(shown), F.expr("bool_or(ambiguous) as ambiguous"))
    expected = "case when ambiguous then 'every number under a monetary column resolved' else 'every printed amount attached to a claim' end"
    return rows.selectExpr(*_finding("R-23", condition="concat('page-', page, '-row-', `row`)", page="page", expected=expected, actual="shown"))


def split_columns(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-24: pages that hold two halves of one table."""
    what = dict(condition="concat('pages-', left_page, '-', right_page)", page="left_page", expected=said("one table's columns readable from a single page"), actual="concat('table continues from page ', left_page, ' to page ', right_page)")
    return e.table("splits").selectExpr(*_finding("R-24", "''", **what))


def section_totals(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-25: printed subtotals, each money field against the claims that its section covers; nulls count as zero.

    A section whose claims are not known is an extraction finding; one that its claims' sum misses a financial one.
    """
    place = ["document_id", "page", "line"]
    sections = e.table("sections")
    at = "concat('{}-page-', page, '-row-', line{})"
    unscoped = sections.where("not scope_known").selectExpr(*_finding("R-25", condition=at.format("unscoped", ""), page="page", expected="'a subtotal whose claims can be identified'", actual="concat('page ', page, ' scope not established')", category="extraction"))
    rows = e.claims.select("document_id", "run_id", "row_id", *MONEY_FIELDS)
    covered = e.table("covers").join(sections.where("scope_known").select(*place, "run_id"), place).join(rows, [*KEY, "row_id"])
    sums = covered.groupBy(*place, "run_id").agg(*[F.expr(f"cast(sum({f}) as {AMOUNT}) as {f}") for f in MONEY_FIELDS])
    told = sections.where("scope_known").select(*place, "run_id").join(e.table("totals").where(F.col("amount").isNotNull() & F.col("field").isin(MONEY_FIELDS)), place)
    of_field = " ".join(f"when '{f}' then {f}" for f in MONEY_FIELDS)
    both = told.join(sums, [*place, "run_id"], "left").selectExpr(*place, "run_id", "field", "amount", f"coalesce(case field {of_field} end, cast(0 as {AMOUNT})) as found")
    missed = both.where(_beyond("found - amount", config))
    return unscoped.unionByName(missed.selectExpr(*_finding("R-25", condition=at.format("mismatch", ", '-', field"), field="field", page="page", expected=f"cast(amount as {AMOUNT})", actual="found")))


def unreadable_totals(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-26: printed totals that the reader refused, with the text; a page or line may be unknown."""
    where = "concat('page-', coalesce(page, 0), '-row-', coalesce(cast(line as string), 'unknown'), '-', field)"
    return e.table("unreadable").selectExpr(*_finding("R-26", condition=where, field="field", page="page", expected="'a printed total that can be read'", actual="text"))


def count_evidence(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-27: counts are printed, but none is the unit's."""
    shown = "array_join(transform(sort_array(collect_list(struct(page, `count`))), x -> concat(x.count, ' on page ', x.page)), ', ') as shown"
    g = e.table("counts").groupBy(*KEY).agg(F.expr(shown))
    return e.docs.where("printed_count is null").select(*KEY).join(g, KEY).selectExpr(*_finding("R-27", condition="'unresolved-claim-count'", field="'claim_count'", expected="'a printed claim count covering the whole report'", actual="shown"))


def _listed(refused: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, first_page, and the first LISTED refused rows as text."""
    ranked = refused.selectExpr("*", f"row_number() over (partition by {', '.join(keys)} order by page, `row`, identifier) as k")
    shown = "concat('page ', page, coalesce(concat(' line ', `row` + 1), ''), ' (', identifier, ')')"
    texts = f"array_join(transform(sort_array(collect_list(case when k <= {LISTED} then struct(k, {shown} as shown) end)), x -> x.shown), '; ') as shown"
    g = ranked.groupBy(*keys).agg(F.expr("count(*) as n"), F.expr("min(page) as first_page"), F.expr(texts))
    return g.selectExpr(*keys, "n", "first_page", f"concat(shown, case when n > {LISTED} then concat(' and ', n - {LISTED}, ' more') else '' end) as shown")


def run_problems(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-28: runs of packets that are incomplete, or whose beginning is not settled, then with the refused rows on their pages."""
    runs = e.table("runs")
    rows = _listed(e.table("refused").where("run_id <> ''"), KEY).select(*KEY, "shown")
    ended = runs.where("incomplete is not null").selectExpr(*_finding("R-28", condition="concat(run_id, ':incomplete')", page="array_max(pages)", expected="'every page the report numbers'", actual="incomplete"))
    unsure = runs.where("ambiguity is not null").join(rows, KEY, "left")
    return ended.unionByName(unsure.selectExpr(*_finding("R-28", condition="run_id", page="array_min(pages)", expected="'page furniture settling where the run begins'", actual="concat_ws('; refused: ', ambiguity, shown)")))


def refused_rows(e: Evidence, config: Config = Config()) -> DataFrame:
    """R-29: rows that look like claims, were refused, and that a reviewer must be told of."""
    g = _listed(e.table("refused").where("report"), KEY)
    return g.selectExpr(*_finding("R-29", page="first_page", expected="'every claim-like row read as a claim or bounded to its run'", actual="concat(n, ': ', shown)"))


def duplicates_across_runs(e: Evidence) -> DataFrame:
    """R-11 of a packet: one claim number and date of loss in two runs or more."""
    g = e.claims.where("run_id <> '' and date_of_loss is not null").groupBy("document_id", "claim_number", "date_of_loss").agg(F.expr("sort_array(collect_set(run_id)) as runs")).where("size(runs) > 1")
    return g.selectExpr(*_finding("R-11", "''", condition="concat_ws(':', 'across-runs', claim_number, cast(date_of_loss as string))", expected="'each claim in one run'", actual="array_join(runs, ', ')", scope="document"))


def claims_in_no_run(claims: DataFrame) -> DataFrame:
    """R-11 of a packet: claims on a page that no run holds. claims: those of packets, with a null run_id there."""
    return claims.where("run_id is null").selectExpr(*_finding("R-11", "''", condition="concat('no-run:', row_id)", expected="'each claim in one run'", actual="'no run'", scope="document"))


def borrowed_conventions(runs: DataFrame) -> DataFrame:
    """R-15 of a packet: runs read by another run's number format, date order or profile."""
    return runs.where("borrowed is not null").selectExpr(*_finding("R-15", condition="concat('borrowed-convention:', run_id)", expected=said("conventions proven on the run's own pages"), actual="borrowed", scope="document"))


#: Every rule by its id: a function of Evidence and Config.
REGISTRY: dict[str, Callable[[Evidence, Config], DataFrame]] = {
    "R-13": outliers, "R-15": field_issues, "R-19": rows_seen, "R-21": mapping_issues, "R-22": page_outcomes, "R-23": unplaced_rows, "R-24": split_columns,
    "R-25": section_totals, "R-26": unreadable_totals, "R-27": count_evidence, "R-28": run_problems, "R-29": refused_rows,
}
for _name in CLAIM_RULES:
    REGISTRY[_name] = lambda e, config=Config(), _n=_name: claim_rules(e, config, [_n])
for _name in UNIT_RULES:
    REGISTRY[_name] = lambda e, config=Config(), _n=_name: unit_rules(e, config, [_n])
REGISTRY = dict(sorted(REGISTRY.items()))
#: The table without which a rule has nothing to judge.
NEEDS = {"R-15": "issues", "R-19": "seen", "R-21": "mapping", "R-23": "unplaced", "R-24": "splits", "R-25": "sections", "R-26": "unreadable", "R-27": "counts", "R-28": "runs", "R-29": "refused"}


def rule(name: str):
    """Register a rule of one's own under its id; KINDS needs its severity, category and scope."""

    def add(f: Callable[[Evidence, Config], DataFrame]) -> Callable:
        REGISTRY[name] = f
        return f

    return add


def _on(e: Evidence, config: Config) -> list[str]:
    """The registered rules but for the disabled ones and those whose table is absent."""
    return [r for r in REGISTRY if r not in config.disabled and (r not in NEEDS or e.has(NEEDS[r]))]


def _parts(e: Evidence, config: Config, on: list[str]) -> list[DataFrame]:
    """The findings of rules about each unit: rules of claims and rules of units together, the others one by one."""
    single, whole = [r for r in on if r in CLAIM_RULES], [r for r in on if r in UNIT_RULES]
    parts = [f(e, config, own) for f, own in ((claim_rules, single), (unit_rules, whole)) if own]
    return parts + [REGISTRY[r](e, config) for r in on if r not in CLAIM_RULES and r not in UNIT_RULES]


def _none(e: Evidence) -> DataFrame:
    return e.claims.sparkSession.createDataFrame([], "rule string, severity string, category string, scope string, document_id long, run_id string, subject string, claim_number string, field string, condition string, page int, expected string, actual string")


def reconcile_units(e: Evidence, config: Config = Config()) -> DataFrame:
    """The findings of all registered rules about each unit, but for the disabled ones. Rules whose table is absent give none, except that pages without an outcome are R-22's business."""
    return union_all(_parts(e, config, _on(e, config)) or [_none(e)])


# --- packets ---------------------------------------------------------------------

#: What a run states for itself; nothing is taken from another run's letterhead.
RUN_FACTS = ["carrier", "insured", "policy_number", "period_start", "period_end", "valuation_date", "printed_count"]


@dataclass(frozen=True)
class Packets:
    """An Evidence by units, and what tells units apart: document_id, run_id, kind (single, run, whole), ambiguous, settled; claims of packets in no run."""

    evidence: Evidence
    kinds: DataFrame
    lost: DataFrame


def split_is_settled(runs: DataFrame) -> DataFrame:
    """document_id, runs, settled for each packet: whether every run is bounded by what is printed, or by structure, and none is ambiguous."""
    sure = F.col("confidence").isin(SETTLED_BY) & F.col("ambiguity").isNull()
    return runs.groupBy("document_id").agg(F.count("*").alias("runs"), F.bool_and(F.coalesce(sure, F.lit(False))).alias("settled")).where("runs > 1")


def run_view(e: Evidence, printed: bool | None = None) -> Packets:
    """Each run of a packet as a unit of its own, beside the documents that are no packets.

    A run has the claims and rows of its pages and its own facts; page accounting and mapping stay the document's. A
    packet whose split isn't settled is a unit as a whole too, for the rules that compare with what is printed. printed: only
    the units that these rules are asked of, which such a packet's runs are not, or (False) those of the others, which it is not.
    """
    packets = split_is_settled(e.table("runs"))
    runs = e.table("runs").join(packets, "document_id")
    inside = packets.select("document_id", F.col("settled").alias("packet"))
    held = runs.groupBy("document_id").agg(F.bool_and("settled").alias("packet"), F.collect_list(F.struct("run_id", "pages")).alias("_held"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with a page, at their run and, where the split is unsettled, at the whole document; null where no run holds the page."""
        at = "transform(filter(_held, h -> array_contains(h.pages, page)), h -> h.run_id)"
        own = f"case when size({at}) > 0 then {at} else array(cast(null as string)) end"
        unsettled = {None: f"concat({own}, array(''))", True: "array('')", False: own}[printed]
        units = F.expr(f"case when packet is null then array('') when packet then {own} else {unsettled} end")
        return rows.drop("run_id").join(held, "document_id", "left").withColumn("run_id", F.explode(units)).select(*rows.columns)

    def named(rows: DataFrame) -> DataFrame:
        """Rows that name their unit: those of runs, of documents that are no packets, and of packets whose split is unsettled."""
        if printed:
            asked = "packet is null and run_id = '' or packet and run_id <> '' or not packet and not exists(_held, h -> h.run_id <=> run_id)"
            return rows.join(held, "document_id", "left").where(asked).select(*rows.columns)
        return rows.join(inside, "document_id", "left").where("packet is null and run_id = '' or packet and run_id <> '' or not packet").drop("packet")

    facts = [c for c in RUN_FACTS if c in e.docs.columns]
    single = e.docs.join(inside, "document_id", "left").where("packet is null" if printed is False else "packet is null or not packet").drop("packet").withColumn("run_id", F.lit(""))
    others = [c for c in e.docs.columns if c not in facts and c != "run_id"]
    own = (runs.where("settled") if printed else runs).select("document_id", "run_id", *[c for c in facts if c in runs.columns], *[F.lit(None).cast(e.docs.schema[c].dataType).alias(c) for c in facts if c not in runs.columns])
    docs = single.unionByName(own.join(e.docs.select(*others), "document_id").select(*e.docs.columns))
    claims = dealt(e.claims)
    tables = dict(e.tables) | {"runs": runs.drop("settled").join(packets.select("document_id"), "document_id", "left_semi")}
    for name in ("seen", "unplaced", "refused", "sections"):
        if name in e.tables:
            tables[name] = dealt(e.table(name)).where("run_id is not null")
    if "issues" in e.tables:
        rows = e.table("issues")
        of_claim = dealt(rows.where("row_id is not null")).where("run_id is not null")
        tables["issues"] = of_claim.unionByName(rows.where("row_id is null").withColumn("run_id", F.lit("")))
    for name in ("printed", "counts", "unreadable"):
        if name in e.tables:
            tables[name] = named(e.table(name))
    kinds = docs.select(*KEY).join(inside, "document_id", "left").join(runs.select(*KEY, F.col("ambiguity").isNotNull().alias("ambiguous")), KEY, "left")
    kind = F.when(F.col("run_id") != "", "run").when(F.col("packet").isNull(), "single").otherwise("whole")
    kinds = kinds.select(*KEY, kind.alias("kind"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("packet", F.lit(True)).alias("settled"))
    return Packets(Evidence(claims.where("run_id is not null"), docs, tables), kinds, claims.join(inside, "document_id", "left_semi"))


def skipped(rule: Column, kind: Column, ambiguous: Column, settled: Column) -> Column:
    """Whether a rule is not asked of a unit: printed figures of an unsettled split are the whole packet's, which is asked nothing else but R-20."""
    printed = rule.isin(PRINTED_RULES)
    return F.when(kind == "run", ~settled & (printed | ((rule == "R-20") & ambiguous))).when(kind == "whole", ~printed & (rule != "R-20")).otherwise(F.lit(False))


def once_per_packet(findings: DataFrame, packets: DataFrame) -> DataFrame:
    """Findings about the whole document that every run of a packet repeats, once and without a run. packets: document_id, runs."""
    wide = F.col("rule").isin(DOCUMENT_WIDE) & F.col("scope").isin("document", "column") & (F.col("run_id") != "") & ~F.col("condition").startswith("borrowed-convention")
    same = [c for c in FINDING if c != "run_id"]
    folded = findings.where(wide).groupBy(*same).agg(F.sort_array(F.collect_set("run_id")).alias("held")).join(packets.select("document_id", "runs"), "document_id")
    units = F.when(F.size("held") == F.col("runs"), F.array(F.lit(""))).otherwise(F.col("held"))
    return findings.where(~wide).unionByName(folded.withColumn("run_id", F.explode(units)).select(*FINDING))


def _kinds(e: Evidence, config: Config) -> tuple[Evidence, list[str], list[DataFrame]]:
    """All findings about documents and packets in parts, no two of which have findings of one rule, category and scope: the rules of single claims that are on with what they read, and the parts of the others.

    Each rule reads only the units that it is asked of, so no finding has to meet its unit's kind, but for R-20, which is asked of both views. Only rules about the whole document are compared across runs.
    """
    on = _on(e, config)
    single = [r for r in on if r in CLAIM_RULES]
    rest = [r for r in on if r not in CLAIM_RULES]
    if not e.has("runs"):
        return e, single, _parts(e, config, rest)
    packets = split_is_settled(e.table("runs"))
    p = run_view(e, False)
    parts = _parts(run_view(e, True).evidence, config, [r for r in rest if r in PRINTED_RULES])
    rest = [r for r in rest if r not in PRINTED_RULES]
    unsettled = e.docs.select("document_id").join(packets.where("not settled").select("document_id"), "document_id").distinct().withColumn("unsettled", F.lit(True))
    more = {"R-11": [duplicates_across_runs(p.evidence), claims_in_no_run(p.lost)], "R-15": [borrowed_conventions(p.evidence.table("runs"))]}
    for rule in [r for r in rest if r not in UNIT_RULES]:
        found = REGISTRY[rule](p.evidence, config).join(unsettled, "document_id", "left").where("unsettled is null or run_id <> ''").select(*FINDING)
        parts.append(union_all([once_per_packet(found, packets) if rule in DOCUMENT_WIDE else found, *more.pop(rule, [])]))
    wide, own = [r for r in rest if r in UNIT_RULES and r in DOCUMENT_WIDE], [r for r in rest if r in UNIT_RULES and r not in DOCUMENT_WIDE and r != "R-20"]
    if wide:
        parts.append(once_per_packet(unit_rules(p.evidence, config, wide), packets))
    if own:
        parts.append(unit_rules(p.evidence, config, own))
    if "R-20" in rest:
        every = run_view(e)
        found = unit_rules(every.evidence, config, ["R-20"]).join(every.kinds, KEY, "left")
        parts.append(found.where(~F.coalesce(skipped(F.col("rule"), F.col("kind"), F.col("ambiguous"), F.col("settled")), F.lit(False))).select(*FINDING))
    return p.evidence, single, parts + [union_all(x) for r, x in more.items() if r not in config.disabled]


def reconcile(e: Evidence, config: Config = Config()) -> DataFrame:
    """All findings about documents and packets. A packet is judged run by run, each against what it printed about itself; run_id is empty for findings about a whole document."""
    read, single, parts = _kinds(e, config)
    return union_all(([claim_rules(read, config, single)] if single else []) + parts or [_none(e)])


def tally(e: Evidence, config: Config = Config(), by: list[str] = KEY[:1]) -> DataFrame:
    """COUNTED of all findings that reconcile gives, one row for each kind that a document has, or, by KEY, a document and each of its runs: for whoever needs their numbers and not what they say."""
    read, single, parts = _kinds(e, config)
    kind = [*by, *[c for c in COUNTED[1:] if c != "n"]]
    counts = [x.groupBy(*kind).agg(F.count("*").alias("n")) for x in parts or [_none(e)]]
    return union_all(([claim_counts(read, config, single, by).select(*kind, "n")] if single else []) + counts)


def ordered(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings with place, their order in a document: by severity, rule, claim number, field and run."""
    gravity = F.array_position(F.array(F.lit("ERROR"), F.lit("WARN"), F.lit("INFO")), F.col("severity"))
    both = findings.join(runs.select(*KEY, "ordinal"), KEY, "left")
    order = [gravity, F.col("rule"), F.coalesce("claim_number", F.lit("")), F.coalesce("field", F.lit("")), F.coalesce("ordinal", F.lit(-1)), F.col("subject"), F.col("condition"), F.coalesce("page", F.lit(-1)), F.coalesce("actual", F.lit(""))]
    return both.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).select(*FINDING, "place")


def number(findings: DataFrame, test: Column | None = None) -> Column:
    """How many findings pass a test, of findings or of a tally of them."""
    n = F.col("n") if "n" in findings.columns else F.lit(1).cast("bigint")
    return F.sum(n if test is None else F.when(test, n).otherwise(0))


def document_status(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """CLEAN, or NEEDS_REVIEW where any finding is an error; with the numbers of findings by severity. findings: or their tally."""
    g = findings.groupBy("document_id").agg(*[number(findings, F.col("severity") == s).alias(n) for s, n in (("ERROR", "errors"), ("WARN", "warnings"), ("INFO", "infos"))])
    both = docs.select("document_id").join(g, "document_id", "left").fillna(0, ["errors", "warnings", "infos"])
    return both.withColumn("status", F.when(F.col("errors") > 0, "NEEDS_REVIEW").otherwise("CLEAN"))


def run_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """document_id, run_id, status of each run of a packet: a run needs review for its own errors, and for those that all runs share."""
    errors = findings.where("severity = 'ERROR'")
    own = errors.where("run_id <> ''").select(*KEY).distinct().withColumn("own", F.lit(True))
    shared = errors.where(F.col("rule").isin(DOCUMENT_WIDE) & (F.col("run_id") == "")).select("document_id").distinct().withColumn("shared", F.lit(True))
    several = Window.partitionBy("document_id")
    both = runs.withColumn("several", F.count("*").over(several)).where("several > 1").select(*KEY).join(own, KEY, "left").join(shared, "document_id", "left")
    return both.select(*KEY, F.when(F.col("own") | F.col("shared"), "NEEDS_REVIEW").otherwise("CLEAN").alias("status"))


def with_whole(e: Evidence) -> Evidence:
    """The same evidence with every claim and document as a unit of its document."""
    return replace(e, claims=e.claims.withColumn("run_id", F.lit("")), docs=e.docs.withColumn("run_id", F.lit("")))
