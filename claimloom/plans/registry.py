"""Every registered query of the library over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import dates, money, text, vocabulary
from claimloom.operators import account, export, inference, mapping, measure, packets, review, rules, structure, submission, summary, triage
from claimloom.plans.adapter import claims, docs, evidence, kept, runs, tables
from claimloom.plans.base import ORACLE_SQL, QUERIES, query
from claimloom.plans import review_queries  # noqa: F401
from claimloom.plans.rule_queries import ALL_RULES, RULE_SQL, counted, found
from claimloom.sources import files
from claimloom.streaming import events as streaming
from claimloom.types import FALSE_TEXTS, STATUSES, TRUE_TEXTS

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["document_status"](spark, sf_dir)


# --- printed text ---------------------------------------------------------

#: Eight ways to print l_extendedprice, and the value, reason and currency that each reads back as.
PRINTED = """SELECT l_orderkey AS k, l_partkey AS part, l_linenumber AS line, l_quantity AS q, cast(l_extendedprice AS decimal(12,2)) AS amount, cast(cast(l_extendedprice AS decimal(12,2)) AS string) AS us FROM {lineitem}"""
SHAPES = ["us", "concat('$', us)", "concat('(', us, ')')", "concat(us, '-')", "concat(us, ' CR')", "replace(us, '.', ',')", "'--'", "'n/a'"]
PRINT = "CASE " + " ".join(f"WHEN line % 8 = {i} THEN {s}" for i, s in enumerate(SHAPES)) + " END"


@query("parse_money", f"""SELECT k, line, part, q, cast(CASE WHEN line % 8 IN (2, 3, 4) THEN -amount WHEN line % 8 IN (6, 7) THEN NULL ELSE amount END AS double) AS amount,
    CASE line % 8 WHEN 6 THEN 'DASH_PLACEHOLDER' WHEN 7 THEN 'NOT_APPLICABLE' END AS reason, CASE WHEN line % 8 = 1 THEN 'USD' END AS currency FROM ({PRINTED.format(lineitem='lineitem')})""", entities=False)
def _(spark, d):
    rows = spark.sql(PRINTED, lineitem=tables(spark, d, "lineitem")[0]).withColumn("printed", F.expr(PRINT))
    return text.projected(rows, "m", lambda: money.parse_money(F.col("printed"))).select("k", "line", "part", "q", F.col("m.value").alias("amount"), F.col("m.reason").alias("reason"), F.col("m.currency").alias("currency"))


@query("parse_money_ambiguous", """SELECT k, cast(amount AS double) AS amount, reason FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN cast(o_orderkey % 900 + 1 AS decimal(28,6)) * 1000 + 234 ELSE (cast(o_orderkey % 900 + 1 AS decimal(28,6)) * 1000 + 234) / 1000 END AS amount,
    CASE WHEN o_orderkey % 3 = 0 THEN 'AMBIGUOUS_SEPARATOR' END AS reason FROM orders)""", entities=False)
def _(spark, d):
    o = tables(spark, d, "orders")[0].select(F.col("o_orderkey").alias("k"), F.expr("concat(cast(o_orderkey % 900 + 1 as string), ',234')").alias("printed"), F.expr("case o_orderkey % 3 when 1 then 'us' when 2 then 'eu' end").alias("loc"))
    return o.withColumn("m", money.parse_money(F.col("printed"), F.col("loc"))).select("k", F.col("m.value").alias("amount"), F.col("m.reason").alias("reason"))


@query("parse_date", """SELECT k, CASE WHEN k % 6 = 4 AND day(dt) <= 12 AND day(dt) <> month(dt) THEN NULL WHEN k % 6 = 5 THEN NULL ELSE strftime(dt, '%Y-%m-%d') END AS value,
    CASE WHEN k % 6 = 4 AND day(dt) <= 12 AND day(dt) <> month(dt) THEN 'AMBIGUOUS_DATE_ORDER' WHEN k % 6 = 5 THEN 'INVALID_DATE' END AS reason FROM (SELECT o_orderkey AS k, cast(o_orderdate AS date) AS dt FROM orders)""", entities=False)
def _(spark, d):
    c = F.col("o_orderdate")
    f = lambda p: F.date_format(c, p)
    k = F.col("o_orderkey") % 6
    printed = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyyMMdd")).when(k == 2, f("MMM d, yyyy")).when(k == 3, f("dd-MMM-yyyy")).when(k == 4, f("MM/dd/yyyy")).otherwise(F.lit("02/30/2001"))
    return tables(spark, d, "orders")[0].select(F.col("o_orderkey").alias("k"), dates.parse_date(printed).alias("p")).select("k", "p.value", "p.reason")


STATUS_TEXTS = [t for v in STATUSES.values() for t in v]
STATUS_CASE = " ".join(f"WHEN t IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in STATUSES.items())


@query("parse_status", f"""SELECT k, CASE {STATUS_CASE} ELSE 'UNKNOWN' END AS status FROM (SELECT e.event_id AS k, ([{', '.join(repr(t) for t in [*STATUS_TEXTS, 'mystery'])}])[cast(e.event_id % {len(STATUS_TEXTS) + 1} AS int) + 1] AS t FROM events e)""", entities=False)
def _(spark, d):
    texts = F.array(*[F.lit(t) for t in [*STATUS_TEXTS, "mystery"]])
    printed = F.concat(F.lit("  "), F.upper(F.element_at(texts, (F.col("event_id") % (len(STATUS_TEXTS) + 1) + 1).cast("int"))), F.lit(". "))
    return tables(spark, d, "events")[0].select(F.col("event_id").alias("k"), text.parse_status(printed).alias("status"))


FLAGS = [*TRUE_TEXTS, *FALSE_TEXTS, "maybe"]


@query("parse_bool", f"SELECT k, CASE WHEN i <= {len(TRUE_TEXTS)} THEN true WHEN i < {len(FLAGS)} THEN false END AS flag FROM (SELECT event_id AS k, event_id % {len(FLAGS)} + 1 AS i FROM events)", entities=False)
def _(spark, d):
    return tables(spark, d, "events")[0].select(F.col("event_id").alias("k"), text.parse_bool(F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("event_id") % len(FLAGS) + 1).cast("int"))).alias("flag"))


@query("clean_and_label", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned, md5(trim(regexp_replace(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '#', ' number '), '[^\p{L}\p{Nd}]+', ' ', 'g'))) AS label FROM documents", entities=False)
def _(spark, d):
    t = tables(spark, d, "documents")[0]
    return t.select("doc_id", F.length(text.clean_text(F.col("text"))).alias("cleaned"), F.md5(F.encode(text.normalize_label(F.col("text")), "UTF-8")).alias("label"))


@query("identifier_shapes", "SELECT regexp_replace(regexp_replace(p_brand || '-' || cast(p_partkey AS string), '\\p{L}', 'A', 'g'), '\\p{Nd}', '9', 'g') AS shape, count(*) AS n FROM part GROUP BY 1", entities=False)
def _(spark, d):
    p = tables(spark, d, "part")[0]
    return p.groupBy(text.identifier_shape(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("shape")).agg(F.count("*").alias("n"))


@query("paginations", "SELECT l_orderkey AS k, count(*) AS pages FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5 GROUP BY 1", entities=False)
def _(spark, d):
    p = tables(spark, d, "lineitem")[0].select(F.col("l_orderkey").alias("k"), text.paginations(F.concat(F.lit("Loss run PAGE "), F.col("l_linenumber").cast("string"), F.lit(" of 5"))).alias("p"))
    return p.where("size(p) > 0").groupBy("k").agg(F.sum(F.size("p")).alias("pages"))


@query("page_spans", """SELECT k, string_agg(CASE WHEN a = b THEN cast(a AS string) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS pages FROM (SELECT k, min(page) AS a, max(page) AS b FROM (SELECT k, page, page - row_number() OVER (PARTITION BY k ORDER BY page) AS g FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS page FROM lineitem)) GROUP BY k, g) GROUP BY k""", entities=False)
def _(spark, d):
    return summary.page_spans(tables(spark, d, "lineitem")[0].select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page")), "k")


#: Printed labels and the fields that they name.
LABELS = {
    "Claim #": "claim_number", "CLM. NBR": "claim_number", "Our File Reference": "claim_number", "TOTAL INCURRED": "incurred_total", "Incurred (net of recoveries)": "recovery_total", "Amount Paid (net)": "paid_total", "Medical Paid": "paid_medical",
    "Paid Expense": "paid_expense", "Indemnity Reserve": "reserve_indemnity", "O/S Reserve": "reserve_total", "Rem Reserve": "reserve_total", "Description of Loss": "loss_description", "Loss Narrative": "loss_description", "Proximate Cause": "cause_of_loss",
    "Date/Time Reported": "date_reported", "Accident Dt": "date_of_loss", "Claim Status Code": "claim_status", "ALAE": "paid_expense", "Suit Filed": "litigation_flag", "Weather": None, "": None, "Med Only": "medical_only_flag",
}
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
LABEL_FIELDS = "[" + ", ".join("NULL" if f is None else f"'{f}'" for f in LABELS.values()) + "]"


@query("guess_field", f"SELECT event_id AS k, ({LABEL_LIST})[cast(event_id % {len(LABELS)} AS int) + 1] AS label, ({LABEL_FIELDS})[cast(event_id % {len(LABELS)} AS int) + 1] AS field FROM events", entities=False)
def _(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % len(LABELS) + 1).cast("int"))
    return tables(spark, d, "events")[0].select(F.col("event_id").alias("k"), label.alias("label")).withColumn("field", vocabulary.guess_field(F.col("label"))["field"])


#: Three ways to head a table of claims: the fields of its columns.
HEADS = {
    0: ["Claim #:claim_number", "Status:claim_status", "Date of Loss:date_of_loss", "Medical Paid:paid_medical", "Total Paid:paid_total", "Reserves:reserve_total", "Total Incurred:incurred_total", "Weather:"],
    1: ["CLM NBR:claim_number", "Weather:", "Paid:paid_total", "Incurred:incurred_total", "Loss Date:date_of_loss", "Stat:claim_status", "Rem Reserve:reserve_total", "Reserve:"],
    2: ["Claim Number:claim_number", "Date Reported:date_reported", "Total Paid:paid_total", "Payment:", "Outstanding:reserve_total", "Recoveries:recovery_total", "Net Incurred:incurred_total", "DOL:date_of_loss"],
}


def printed_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of the claims printed as tables, one way in three: cells and headers as arrays by column; amounts with signs and brackets, dates and statuses as text."""
    c = claims(spark, d)
    amount = lambda f: F.when(F.col(f) < 0, F.concat(F.lit("($"), (-F.col(f)).cast("string"), F.lit(")"))).otherwise(F.coalesce(F.col(f).cast("string"), F.lit("--")))
    shown = {
        "claim_number": F.concat(F.lit("CL-"), F.substring("claim_number", 2, 9), F.lit("-"), F.col("row_id").cast("string")), "claim_status": F.upper("claim_status"), "date_of_loss": F.coalesce(F.date_format("date_of_loss", "MMM d, yyyy"), F.lit("")),
        "date_reported": F.coalesce(F.col("date_reported").cast("string"), F.lit("N/A")), "paid_medical": amount("paid_medical"), "paid_total": amount("paid_total"), "reserve_total": amount("reserve_total"), "recovery_total": amount("recovery_total"), "incurred_total": amount("incurred_total"), "": F.lit("sun"),
    }
    way = (F.col("document_id") % 3).cast("int")
    by_way = lambda of: F.when(way == 0, of(HEADS[0])).when(way == 1, of(HEADS[1])).when(way == 2, of(HEADS[2]))
    cells = by_way(lambda heads: F.array(*[shown[h.split(":")[1]] for h in heads]))
    headers = by_way(lambda heads: F.array(*[F.lit(h.split(":")[0]) for h in heads]))
    return c.select("document_id", "page", F.col("row_id").cast("int").alias("row"), cells.alias("cells")), docs(spark, d).select("document_id", headers.alias("headers"))


CELL_VALUES = {"date_of_loss": "0, 1, 2", "date_reported": "2", "paid_medical": "0", "paid_total": "0, 1, 2", "reserve_total": "0, 1, 2", "recovery_total": "2", "incurred_total": "0, 1, 2"}
CELL_SQL = ", ".join(f"CASE WHEN document_id % 3 IN ({ways}) THEN cast({f} AS {'string' if f.startswith('date') else 'double'}) END AS {f}" for f, ways in CELL_VALUES.items())
DASHED = " + ".join(f"CASE WHEN document_id % 3 IN ({ways}) AND {f} IS NULL THEN 1 ELSE 0 END" for f, ways in CELL_VALUES.items())


@query("cells_to_claims", f"""SELECT document_id, page, row_id, concat('CL-', substr(claim_number, 2), '-', row_id) AS claim_number, CASE WHEN document_id % 3 = 2 OR claim_status = 'UNKNOWN' THEN 'UNKNOWN' ELSE claim_status END AS claim_status, {CELL_SQL}, {DASHED} AS issues
    FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY document_id ORDER BY page, row_id) AS row_id), row_id AS r FROM claims) c""".replace("'-', row_id)", "'-', r)"))
def _(spark, d):
    return mapping.build_claims_of_rows(*printed_rows(spark, d)).select("document_id", "page", "row_id", "claim_number", "claim_status", *CELL_VALUES, F.size("issues").alias("issues"))


@query("column_mapping", """SELECT document_id, CASE document_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 6 ELSE 7 END AS mapped, CASE WHEN document_id % 3 = 2 THEN '' WHEN document_id % 3 = 0 THEN '7' ELSE '1' END AS unmapped, CASE WHEN document_id % 3 = 0 THEN 0 ELSE 1 END AS contested, true AS usable FROM docs""")
def _(spark, d):
    _, heads = printed_rows(spark, d)
    got = mapping.mapping_facts(mapping.build_mapping(heads.select("document_id", F.posexplode("headers").alias("column", "header"))))
    return got.select("document_id", F.size("fields").alias("mapped"), F.array_join(F.col("unmapped").cast("array<string>"), ",").alias("unmapped"), "contested", "usable")


#: First lines of pages and the carriers that they name.
LETTERHEADS = [
    ("Carrier: Acme Casualty  Page 1 of 3\nLoss Run", "Acme Casualty"), ("LOSS RUN\nSTATE AUTO INSURANCE - HISTORICAL LOSS REPORT\nNamed Insured: Whitfield Engineering Ltd", "STATE AUTO INSURANCE"), ("Claim No Date of Loss Status Paid Total Incurred\nC-1 01/02/2024 Open", None),
    ("River Valley Pool  Printed: 3/1/24\nPage 2 of 9", "River Valley Pool"), ("All claims where status is open\nNorthern Lights Mutual Ltd", "Northern Lights Mutual Ltd"), ("Somebody\nClaims Listing", "Somebody"), ("", None),
]


@query("detect_carrier", "SELECT c_custkey AS k, (" + "[" + ", ".join("NULL" if c is None else f"'{c}'" for _, c in LETTERHEADS) + "]" + f")[c_custkey % {len(LETTERHEADS)} + 1] AS carrier FROM customer", entities=False)
def _(spark, d):
    top = F.element_at(F.array(*[F.lit(t) for t, _ in LETTERHEADS]), (F.col("c_custkey") % len(LETTERHEADS) + 1).cast("int"))
    return tables(spark, d, "customer")[0].select(F.col("c_custkey").alias("k"), vocabulary.detect_carrier(top).alias("carrier"))


@query("document_fields", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'policy_number' WHEN 1 THEN 'policy_period_start' WHEN 2 THEN 'named_insured' WHEN 3 THEN 'currency' END AS field FROM part", entities=False)
def _(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Policy No.", "EFFECTIVE DATE", "Named  Insured:", "CCY", "Loss State"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return tables(spark, d, "part")[0].select(F.col("p_partkey").alias("k"), vocabulary.guess_document_field(label).alias("field"))


@query("template_labels", "SELECT doc_id, array_to_string(list_sort(list_filter(['" + "', '".join(vocabulary.listed(vocabulary.TEMPLATE_LABELS)) + "'], lambda x: contains(t, x))), ',') AS labels FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)", entities=False)
def _(spark, d):
    return tables(spark, d, "documents")[0].select("doc_id", F.array_join(vocabulary.template_labels(F.col("text")), ",").alias("labels"))


@query("formula_guard", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(t, '^[\\t\\r\\n]|^[ \\t\\r\\n]*[=+@-]')) AS guarded FROM (SELECT CASE WHEN conv_id % 3 = 0 THEN '=' || text ELSE text END AS t FROM conversations)", entities=False)
def _(spark, d):
    t = tables(spark, d, "conversations")[0].select(F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text")).alias("t"))
    return t.agg(F.count("*").alias("n"), F.count_if(text.needs_quote(F.col("t"))).alias("guarded"))


@query("fingerprints", "SELECT c_mktsegment AS segment, substr(sha256(concat_ws(chr(10), lower(c_mktsegment), 'claim number', 'paid', 'a', 'b')), 1, 32) AS fingerprint, count(*) AS n FROM customer GROUP BY 1, 2", entities=False)
def _(spark, d):
    f = text.fingerprint(F.col("c_mktsegment"), F.array(F.lit("Claim #"), F.lit("PAID")), F.array(F.lit("b"), F.lit("a")))
    return tables(spark, d, "customer")[0].groupBy(F.col("c_mktsegment").alias("segment"), f.alias("fingerprint")).agg(F.count("*").alias("n"))


@query("line_of_business", "SELECT p_type AS t, 'AUTO' AS line, count(*) AS n FROM part GROUP BY 1, 2", entities=False)
def _(spark, d):
    return tables(spark, d, "part")[0].groupBy(F.col("p_type").alias("t"), text.line_of_business(F.concat_ws(" / ", F.lit("Auto"), "p_type")).alias("line")).agg(F.count("*").alias("n"))


# --- inference ------------------------------------------------------------


@query("infer_locale", """SELECT k, us, eu, CASE WHEN us > 0 AND eu = 0 THEN 'us' WHEN eu > 0 AND us = 0 THEN 'eu' END AS locale, (us > 0) <> (eu > 0) AS confident
    FROM (SELECT l_orderkey % 500 AS k, count(*) FILTER (l_orderkey % 500 % 3 <> 1) AS us, count(*) FILTER (l_orderkey % 500 % 3 = 1 OR (l_orderkey % 500 % 3 = 2 AND l_linenumber = 7)) - 0 AS eu, 0 AS z FROM lineitem WHERE NOT (l_orderkey % 500 % 3 = 2 AND l_linenumber = 7) GROUP BY 1)""", entities=False)
def _(spark, d):
    amount = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    rows = tables(spark, d, "lineitem")[0].where("not (l_orderkey % 500 % 3 = 2 and l_linenumber = 7)").select((F.col("l_orderkey") % 500).alias("k"), F.when(F.col("l_orderkey") % 500 % 3 == 1, F.regexp_replace(amount, r"\.", ",")).otherwise(amount).alias("token"))
    return inference.infer_locale(rows, "k", "token")


@query("infer_date_order", """SELECT k, dmy, mdy, CASE WHEN dmy > 0 AND mdy = 0 THEN 'dmy' WHEN mdy > 0 AND dmy = 0 THEN 'mdy' END AS "order", CASE WHEN (dmy > 0) <> (mdy > 0) THEN 'evidence' WHEN dmy > 0 THEN 'conflict' ELSE 'none' END AS source
    FROM (SELECT o_custkey % 300 AS k, count(*) FILTER (o_custkey % 300 % 2 = 0 AND day(o_orderdate) > 12) AS dmy, count(*) FILTER (o_custkey % 300 % 2 = 1 AND day(o_orderdate) > 12) AS mdy FROM orders GROUP BY 1)""", entities=False)
def _(spark, d):
    o = tables(spark, d, "orders")[0].select((F.col("o_custkey") % 300).alias("k"), F.when(F.col("o_custkey") % 300 % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("t"))
    return inference.infer_date_order(o, "k", "t")


SIGN = "FROM (SELECT document_id, abs(incurred_total - (paid_total + reserve_total - recovery_total)) <= 0.01 AS l, abs(incurred_total - (paid_total + reserve_total + recovery_total)) <= 0.01 AS m FROM claims WHERE recovery_total <> 0) GROUP BY 1"


@query("infer_recovery_sign", f"SELECT document_id, s AS subtracts, a AS adds, a > 0 AND s = 0 AS credit, (a > 0) <> (s > 0) AS confident FROM (SELECT document_id, count(*) FILTER (l AND NOT m) AS s, count(*) FILTER (m AND NOT l) AS a {SIGN})")
def _(spark, d):
    return inference.infer_recovery_sign(claims(spark, d), "document_id")


@query("consensus_shapes")
def _(spark, d):
    rows = tables(spark, d, "part")[0].select((F.col("p_partkey") % 20).alias("k"), F.concat_ws("-", F.lit("CL"), F.col("p_partkey").cast("string")).alias("token"))
    return inference.consensus_shapes(rows, "k", "token")


# --- summaries ------------------------------------------------------------

TOTALS = ", ".join(f"cast(coalesce(sum({f}), 0) AS double) AS {f}" for f in summary.FIELDS)
AGG = f"count(row_id) AS claims, count(*) FILTER (claim_status IN ('OPEN', 'REOPENED')) AS open_claims, count(*) FILTER (claim_status = 'CLOSED') AS closed_claims, {TOTALS}, cast(max(incurred_total) AS double) AS largest, arg_max(claim_number, (incurred_total, -row_id)) FILTER (incurred_total IS NOT NULL) AS largest_claim"
TERMS = "SELECT DISTINCT insured, cast(strftime(period_start, '%Y-01-01') AS date) + cast((document_id % 2) * 30 AS int) AS term_start, cast(strftime(period_start, '%Y-12-31') AS date) AS term_end FROM docs WHERE period_start IS NOT NULL AND insured NOT LIKE '%7'"
OWN = "SELECT insured, document_id * 100 + row_id AS row_id, claim_number, claim_status, date_of_loss, paid_total, reserve_total, recovery_total, incurred_total FROM claims JOIN docs USING (document_id)"


def account_claims(spark, d) -> DataFrame:
    return claims(spark, d).join(docs(spark, d).select("document_id", "insured", "carrier", "policy_number", "valuation_date"), "document_id")


def account_rows(spark, d) -> DataFrame:
    """Claims with a row number of their own in the account."""
    return account_claims(spark, d).withColumn("row_id", F.col("document_id") * 100 + F.col("row_id"))


def account_terms(spark, d) -> DataFrame:
    start = F.to_date(F.concat(F.year("period_start").cast("string"), F.lit("-01-01")))
    t = docs(spark, d).where("period_start is not null and insured not like '%7'")
    return t.select("insured", F.date_add(start, ((F.col("document_id") % 2) * 30).cast("int")).alias("term_start"), F.to_date(F.concat(F.year("period_start").cast("string"), F.lit("-12-31"))).alias("term_end")).distinct()


PERIODS = f"""WITH t AS ({TERMS}), c AS ({OWN}), hit AS (SELECT c.insured, c.row_id, count(t.term_start) AS n, min(concat(term_start, ' to ', term_end)) AS one FROM c LEFT JOIN t ON c.insured = t.insured AND date_of_loss BETWEEN term_start AND term_end GROUP BY 1, 2),
    lab AS (SELECT c.*, CASE WHEN c.insured NOT IN (SELECT insured FROM t) THEN coalesce(cast(year(date_of_loss) AS string), '{summary.UNDATED}') WHEN n = 1 THEN one WHEN n = 0 THEN '{summary.OUTSIDE}' ELSE '{summary.SEVERAL}' END AS term FROM c JOIN hit USING (insured, row_id)),
    alls AS (SELECT DISTINCT insured, concat(term_start, ' to ', term_end) AS term FROM t UNION SELECT DISTINCT insured, term FROM lab)
    SELECT insured, term, {AGG} FROM alls LEFT JOIN lab USING (insured, term) GROUP BY 1, 2"""


@query("period_summary", PERIODS)
def _(spark, d):
    return summary.by_term(account_rows(spark, d), account_terms(spark, d), "insured")


@query("period_sections", f"""WITH p AS (SELECT * FROM ({PERIODS})), s AS (SELECT * FROM p WHERE term LIKE '% to %' AND insured LIKE '%1'),
    x AS (SELECT insured, term, min(substr(term, 1, 10)) OVER (PARTITION BY insured, substr(term, 1, 10)) AS start, claims, incurred_total FROM s QUALIFY row_number() OVER (PARTITION BY insured, substr(term, 1, 10) ORDER BY term) = 1)
    SELECT p.insured, p.term, p.claims, x.claims + CASE WHEN x.insured LIKE '%11' THEN 1 ELSE 0 END AS printed_claims, round(p.incurred_total - x.incurred_total, 2) AS difference,
      CASE WHEN x.insured IS NOT NULL THEN p.claims = x.claims + CASE WHEN x.insured LIKE '%11' THEN 1 ELSE 0 END AND abs(p.incurred_total - x.incurred_total) < 0.011 END AS ties
    FROM p LEFT JOIN x ON x.insured = p.insured AND p.term LIKE '% to %' AND substr(p.term, 1, 10) = x.start""")
def _(spark, d):
    found_ = summary.by_term(account_rows(spark, d), account_terms(spark, d), "insured")
    dated = found_.where("term like '% to %' and insured like '%1'")
    line = F.row_number().over(Window.partitionBy("insured").orderBy("term"))
    printed = F.create_map(F.lit("incurred_total"), F.col("incurred_total"), F.lit("paid_total"), F.lit(None).cast("decimal(28,2)"))
    more = F.when(F.col("insured").like("%11"), 1).otherwise(0)
    sections = dated.select("insured", line.alias("line"), F.substring("term", 1, 10).alias("period_start"), (F.col("claims") + more).alias("printed_claims"), printed.alias("printed"))
    return summary.against_sections(found_, sections, "insured").select("insured", "term", "claims", "printed_claims", F.col("differences")["incurred_total"].alias("difference"), "ties")


@query("loss_snapshot", f"SELECT insured, {AGG} FROM ({OWN}) GROUP BY 1")
def _(spark, d):
    return summary.loss_snapshot(account_claims(spark, d), "insured")


@query("printed_ties", """SELECT document_id, CASE WHEN printed_count IS NOT NULL OR printed_incurred IS NOT NULL THEN coalesce(coalesce(n, 0) = printed_count, true) AND coalesce(abs(coalesce(s, 0) - printed_incurred) <= 0.01, true) END AS ties, cast(coalesce(s, 0) - printed_incurred AS double) AS difference
    FROM docs LEFT JOIN (SELECT document_id, count(*) AS n, sum(incurred_total) AS s FROM claims GROUP BY 1) c USING (document_id)""")
def _(spark, d):
    return summary.ties(summary.loss_snapshot(claims(spark, d), "document_id"), docs(spark, d).select("document_id", "printed_count", "printed_incurred"))


@query("large_losses", "SELECT document_id, row_id, claim_number, cast(incurred_total AS double) AS incurred_total FROM claims WHERE incurred_total >= 12000")
def _(spark, d):
    return summary.large_losses(claims(spark, d), "12000").select("document_id", "row_id", "claim_number", "incurred_total")


@query("severity", "SELECT insured, count(*) AS frequency, cast(coalesce(sum(incurred_total), 0) AS double) AS incurred_total FROM claims JOIN docs USING (document_id) GROUP BY 1")
def _(spark, d):
    return summary.severity(summary.loss_snapshot(account_claims(spark, d), "insured")).select("insured", "frequency", "incurred_total")


GAP = "SELECT insured, term_start, term_end, max(term_end) OVER (PARTITION BY insured ORDER BY term_start, term_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM (SELECT DISTINCT insured, period_start AS term_start, period_end AS term_end FROM docs WHERE period_start IS NOT NULL AND period_end IS NOT NULL)"


@query("coverage_gaps", f"SELECT insured, cast(u AS string) AS covered_until, cast(term_start AS string) AS resumes, cast(term_start - u AS bigint) AS days FROM ({GAP}) WHERE term_start - u > 1")
def _(spark, d):
    return summary.coverage_gaps(docs(spark, d).select("insured", F.col("period_start").alias("term_start"), F.col("period_end").alias("term_end")), "insured")


# --- accounts -------------------------------------------------------------

#: Sources of accounts: documents, and each run of a packet, in the order of their valuation; those whose policy is printed are known.
SOURCES = """SELECT *, row_number() OVER (PARTITION BY account ORDER BY coalesce(valuation_date, DATE '0001-01-01'), filename, run_id) AS seq FROM (
    SELECT insured AS account, document_id, '' AS run_id, concat('doc', document_id, '.pdf') AS filename, carrier, insured, policy_number, valuation_date, CASE WHEN period_start IS NOT NULL AND period_end IS NOT NULL THEN period_start END AS term_start, CASE WHEN period_start IS NOT NULL THEN period_end END AS term_end FROM docs WHERE document_id % 4 <> 0
    UNION ALL SELECT d.insured, d.document_id, r.run_id, concat('doc', d.document_id, '.pdf'), r.carrier, CASE WHEN d.document_id % 24 = 0 THEN 'Another' ELSE upper(d.insured) END, r.policy_number, r.valuation_date, CASE WHEN r.period_start IS NOT NULL AND r.period_end IS NOT NULL THEN r.period_start END, CASE WHEN r.period_start IS NOT NULL THEN r.period_end END FROM docs d JOIN runs r USING (document_id)) x"""
ACC = f"""SELECT s.account, s.carrier, s.policy_number, s.seq, s.valuation_date, s.filename, s.document_id, s.run_id, c.claim_number, c.row_id, c.claim_status, c.date_of_loss, c.incurred_total, c.page, CASE WHEN c.date_of_loss BETWEEN term_start AND term_end THEN term_start END AS term, s.term_start, s.term_end
    FROM ({SOURCES}) s JOIN claims c ON c.document_id = s.document_id AND (s.run_id = '' OR EXISTS (SELECT 1 FROM runs r WHERE r.document_id = s.document_id AND r.run_id = s.run_id AND c.page BETWEEN r.first_page AND r.last_page))"""
#: Histories of claims whose carrier and policy are printed, each of them by its letterhead; a carrier and policy are one claim's.
PLAIN = f"SELECT * FROM ({ACC}) a WHERE policy_number IS NOT NULL"
KEYS = ["account", "carrier", "policy_number", "claim_number"]
MOVES = f"SELECT account, carrier, policy_number, claim_number, count(*) AS appearances, arg_min(struct_pack(a := incurred_total), (seq, row_id)).a AS earliest, arg_max(struct_pack(a := incurred_total), (seq, row_id)).a AS latest FROM ({PLAIN}) GROUP BY 1, 2, 3, 4"
CURRENT = f"SELECT * FROM ({PLAIN}) QUALIFY row_number() OVER (PARTITION BY account, carrier, policy_number, claim_number ORDER BY seq DESC, row_id DESC) = 1"


def account_sources(spark, d) -> DataFrame:
    own = docs(spark, d).withColumn("filename", F.concat(F.lit("doc"), "document_id", F.lit(".pdf")))
    named = own.select("document_id", F.when(F.col("document_id") % 24 == 0, "Another").otherwise(F.upper("insured")).alias("insured"))
    terms = own.select("document_id", F.col("period_start").alias("term_start"), F.col("period_end").alias("term_end"))
    return account.in_order(account.sources_of(own, terms, runs(spark, d).join(named, "document_id")))


def account_appearances(spark, d, sources: DataFrame | None = None) -> DataFrame:
    """Claims at their sources: those of packets at the run of their page."""
    e = rules.run_view(evidence(spark, d))
    packets_ = runs(spark, d).select("document_id").distinct()
    whole = e.evidence.claims.where("run_id = ''").join(packets_, "document_id", "left_anti")
    rows = whole.unionByName(e.evidence.claims.where("run_id <> ''"))
    line = F.when(F.col("document_id") % 3 == 0, "AUTO").when(F.col("document_id") % 3 == 1, "PROPERTY")
    return account.appearances(rows, account_sources(spark, d) if sources is None else sources).withColumn("line_of_business", line)


def plain_histories(spark, d, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(appearances with a printed policy, their histories by letterhead): terms are left out, as one policy has several."""
    rows = account_appearances(spark, d, sources).where("policy_number is not null").withColumns({"term": F.lit(None).cast(account.TERM), "trusted": F.col("document_id") % 2 == 0})
    return rows, account.histories(rows)


@query("sources", f"SELECT account, document_id, run_id, filename, carrier, insured, policy_number, cast(valuation_date AS string) AS valuation_date, cast(term_start AS string) AS term_start, cast(term_end AS string) AS term_end, seq FROM ({SOURCES})")
def _(spark, d):
    t = F.get("terms", F.lit(0))
    return account_sources(spark, d).select("account", "document_id", "run_id", "filename", "carrier", "insured", "policy_number", "valuation_date", t["start"].alias("term_start"), t["end"].alias("term_end"), "seq")


@query("appearances", f"SELECT account, seq, claim_number, row_id, cast(term AS string) AS term, cast(incurred_total AS double) AS incurred_total FROM ({ACC})")
def _(spark, d):
    return account_appearances(spark, d).select("account", "seq", "claim_number", "row_id", F.col("term.start").alias("term"), "incurred_total")


@query("development", f"SELECT account, carrier, policy_number, claim_number, appearances, cast(earliest AS double) AS earliest, cast(CASE WHEN appearances > 1 THEN latest - earliest END AS double) AS movement FROM ({MOVES})")
def _(spark, d):
    return account.rollup(*plain_histories(spark, d)).select(*KEYS, "appearances", "earliest", "movement")


@query("current_claims", f"SELECT account, carrier, policy_number, claim_number, document_id, run_id, row_id, cast(valuation_date AS string) AS valuation_date, cast(incurred_total AS double) AS incurred_total FROM ({CURRENT})")
def _(spark, d):
    return account.rollup(*plain_histories(spark, d)).select(*KEYS, "document_id", "run_id", "row_id", "valuation_date", "incurred_total")


@query("history_trust", f"SELECT account, carrier, policy_number, claim_number, false AS uncertain, bool_and(document_id % 2 = 0) AS trusted, any_value(carrier) AS carriers FROM ({PLAIN}) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return account.rollup(*plain_histories(spark, d)).select(*KEYS, "uncertain", "trusted", F.array_join("carriers", ",").alias("carriers"))


@query("developed", f"""SELECT account, claim_number, carrier, policy_number, cast(m AS double) AS movement, dense_rank() OVER (PARTITION BY account ORDER BY abs(m) DESC) AS rank FROM (SELECT account, claim_number, carrier, policy_number, latest - earliest AS m FROM ({MOVES}) WHERE appearances > 1) WHERE m <> 0""")
def _(spark, d):
    size = Window.partitionBy("account").orderBy(F.abs("movement").desc())
    return account.developed(account.rollup(*plain_histories(spark, d))).withColumn("rank", F.dense_rank().over(size)).select("account", "claim_number", "carrier", "policy_number", "movement", "rank")


@query("dropped_claims", f"""WITH cur AS ({CURRENT}), src AS ({SOURCES}), app AS ({PLAIN}),
    later AS (SELECT c.account, c.carrier, c.policy_number, c.claim_number, s.seq AS s, c.carrier = s.carrier AND coalesce(c.policy_number = s.policy_number, true) AS own FROM cur c JOIN src s ON c.account = s.account AND s.seq > c.seq AND c.date_of_loss BETWEEN s.term_start AND s.term_end)
    SELECT account, carrier, policy_number, claim_number FROM later GROUP BY ALL HAVING bool_or(own) AND NOT bool_or(EXISTS (SELECT 1 FROM app WHERE app.account = later.account AND app.claim_number = later.claim_number AND app.seq = s))""")
def _(spark, d):
    sources = account_sources(spark, d)
    rows, placed = plain_histories(spark, d, sources)
    return account.omitted(account.rollup(rows, placed), rows, sources).select(*KEYS)


@query("account_histories")
def _(spark, d):
    rows = account_appearances(spark, d).withColumn("carrier", F.when(F.col("document_id") % 13 != 0, F.col("carrier")))
    return account.histories(rows)


@query("account_status", f"""WITH src AS ({SOURCES}), st AS (SELECT document_id, bool_or(severity = 'ERROR') AS bad FROM ({ALL_RULES}) f GROUP BY 1),
    said AS (SELECT account, seq, filename || CASE WHEN run_id <> '' THEN ' ' || run_id ELSE '' END AS w, document_id % 31 = 0 AS unread, coalesce(bad, false) AS bad, upper(insured) <> upper(account) AS other, document_id FROM src LEFT JOIN st USING (document_id)),
    why AS (SELECT account, seq, 0 AS k, w || CASE WHEN unread THEN ': not reconciled' ELSE ': needs review' END AS t FROM said WHERE unread OR bad UNION ALL SELECT account, seq, 1, w || ': names another insured' FROM said WHERE other)
    SELECT account, count(DISTINCT document_id) AS documents, count(*) AS sources, (SELECT string_agg(t, '|' ORDER BY seq, k) FROM why WHERE why.account = said.account) AS reasons, CASE WHEN bool_or(unread OR bad OR other) THEN 'NEEDS_REVIEW' ELSE 'CLEAN' END AS status FROM said GROUP BY account""")
def _(spark, d):
    status = rules.document_status(docs(spark, d), counted(spark, d)).where("document_id % 31 <> 0").select("document_id", "status")
    sources = account_sources(spark, d)
    rolled = account.rollup(*plain_histories(spark, d, sources))
    got = account.largest_first(account.reasons(sources.join(status, "document_id", "left"), rolled))
    return got.select("account", "documents", "sources", F.nullif(F.array_join("reasons", "|"), F.lit("")).alias("reasons"), "status")


RULES = triage.Appetite(open_incurred_ceiling=Decimal("9000"), term_claim_count_ceiling=15, development_amount=Decimal("500"), development_percent=Decimal("25"), by_line={"AUTO": triage.Line(open_incurred_ceiling=Decimal("3000"), development_percent=Decimal("50"))})
LINED = f"SELECT account, carrier, policy_number, claim_number, CASE WHEN count(DISTINCT l) = 1 THEN any_value(l) END AS line FROM (SELECT *, CASE document_id % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'PROPERTY' END AS l FROM ({PLAIN})) GROUP BY 1, 2, 3, 4"
AT = "USING (account, carrier, policy_number, claim_number)"


def triaged(spark, d) -> tuple[DataFrame, DataFrame]:
    """(histories with line, sources and current claim, the account's declared terms)."""
    rows, placed = plain_histories(spark, d)
    return triage.with_sources(account.rollup(rows, placed), rows, placed), account_terms(spark, d).withColumnRenamed("insured", "account")


def shown(flags: DataFrame) -> DataFrame:
    return flags.select("rule", "severity", "account", F.array_join("claim_numbers", ",").alias("claim_numbers"), "evaluated", "reason", F.size("sources").alias("n_sources"))


@query("triage_open_incurred", f"""SELECT 'T-01' AS rule, 'WARN' AS severity, account, claim_number AS claim_numbers, incurred_total IS NOT NULL AS evaluated, CASE WHEN incurred_total IS NULL THEN concat('open claim ', claim_number, ' carries no incurred total - cannot evaluate against ceiling')
    ELSE concat('open claim ', claim_number, ' incurred ', cast(incurred_total AS decimal(28,2)), ' exceeds ceiling ', c) END AS reason, 1 AS n_sources FROM (SELECT *, cast(CASE WHEN line = 'AUTO' THEN 3000 ELSE 9000 END AS decimal(28,2)) AS c FROM ({CURRENT}) JOIN ({LINED}) {AT}) WHERE claim_status IN ('OPEN', 'REOPENED') AND (incurred_total IS NULL OR incurred_total > c)""")
def _(spark, d):
    return shown(triage.open_incurred(triaged(spark, d)[0], RULES))


@query("triage_development", f"""SELECT 'T-03' AS rule, 'WARN' AS severity, account, claim_number AS claim_numbers, NOT blind AS evaluated, CASE WHEN earliest IS NULL THEN concat('cannot compute development percentage for ', claim_number, ' (earliest valuation has no incurred total)') WHEN blind THEN concat('cannot compute development percentage for ', claim_number, ' (earliest valuation has a zero incurred total)') ELSE 'moved' END AS reason, appearances AS n_sources
    FROM (SELECT *, latest - earliest AS m, earliest IS NULL OR (latest IS NOT NULL AND earliest = 0) AS blind FROM ({MOVES}) JOIN ({LINED}) {AT} WHERE appearances > 1) WHERE blind OR (abs(m) > 500 AND earliest > 0 AND abs(m) * 100 > earliest * CASE WHEN line = 'AUTO' THEN 50 ELSE 25 END)""")
def _(spark, d):
    return shown(triage.development_alert(triaged(spark, d)[0], RULES)).withColumn("reason", F.when(F.col("reason").startswith("incurred"), "moved").otherwise(F.col("reason")))


TERMED = f"""SELECT c.*, line, CASE WHEN c.account NOT IN (SELECT insured FROM t) THEN coalesce(cast(year(date_of_loss) AS string), '{summary.UNDATED}') WHEN n = 1 THEN one WHEN n = 0 THEN '{summary.OUTSIDE}' ELSE '{summary.SEVERAL}' END AS term_label
    FROM ({CURRENT}) c JOIN ({LINED}) l {AT} JOIN (SELECT c.account, c.carrier, c.policy_number, c.claim_number, count(t.insured) AS n, min(concat(t.term_start, ' to ', t.term_end)) AS one FROM ({CURRENT}) c LEFT JOIN t ON t.insured = c.account AND c.date_of_loss BETWEEN t.term_start AND t.term_end GROUP BY 1, 2, 3, 4) h {AT}"""


@query("triage_term_counts", f"""WITH t AS ({TERMS}) SELECT 'T-02' AS rule, 'WARN' AS severity, account, coalesce(string_agg(DISTINCT claim_number, ',' ORDER BY claim_number) FILTER (length(term_label) > 4 AND term_label <> '{summary.UNDATED}'), '') AS claim_numbers, true AS evaluated, concat('period ', term_label, ' holds ', count(*), ' claims, above the ceiling of 15') AS reason, count(*) FILTER (length(term_label) > 4 AND term_label <> '{summary.UNDATED}') AS n_sources
    FROM ({TERMED}) GROUP BY account, term_label HAVING count(*) > 15""")
def _(spark, d):
    rolled, terms = triaged(spark, d)
    return shown(triage.term_counts(triage.periods(rolled, terms), RULES))


@query("triage_unknown_status", f"SELECT 'T-06' AS rule, 'WARN' AS severity, account, claim_number AS claim_numbers, false AS evaluated, 'claim status UNKNOWN - cannot price' AS reason, 1 AS n_sources FROM ({CURRENT}) WHERE claim_status = 'UNKNOWN'")
def _(spark, d):
    return shown(triage.unknown_status(triaged(spark, d)[0], RULES))


@query("triage_merged", f"""SELECT 'T-06' AS rule, 'WARN' AS severity, account, claim_number AS claim_numbers, false AS evaluated, 'claim status UNKNOWN - cannot price' AS reason, count(*) AS n_sources FROM ({CURRENT}) WHERE claim_status = 'UNKNOWN' GROUP BY 3, 4
    UNION ALL SELECT 'T-01', 'WARN', account, claim_number, NOT bool_or(incurred_total IS NULL), CASE WHEN bool_or(incurred_total IS NULL) THEN concat('open claim ', claim_number, ' carries no incurred total - cannot evaluate against ceiling') ELSE 'over' END, count(*)
      FROM (SELECT *, CASE WHEN line = 'AUTO' THEN 3000 ELSE 9000 END AS c FROM ({CURRENT}) JOIN ({LINED}) {AT}) WHERE claim_status IN ('OPEN', 'REOPENED') AND (incurred_total IS NULL OR incurred_total > c) GROUP BY account, claim_number""")
def _(spark, d):
    rolled, _ = triaged(spark, d)
    flags = triage.merged(triage.open_incurred(rolled, RULES).unionByName(triage.unknown_status(rolled, RULES)))
    return shown(flags).withColumn("reason", F.when(F.col("evaluated"), "over").otherwise(F.col("reason")))


#: What triage reads of an appearance.
SEEN = ["account", "claim_number", "seq", "row_id", "document_id", "run_id", "valuation_date", "claim_status", "date_of_loss", "incurred_total", "carrier", "policy_number", "term", "terms", "line_of_business"]


@query("triage")
def _(spark, d):
    key = ("account", "claim_number")
    sources = kept(account_sources(spark, d), "account")
    rows = kept(account_appearances(spark, d, sources).select(*SEEN, F.lit(True).alias("trusted")), *key)
    placed = kept(account.histories(rows), *key)
    rolled = kept(triage.with_sources(account.rollup(rows, placed), rows, placed), *key)
    terms = sources.select("account", F.explode("terms").alias("t")).select("account", F.col("t.start").alias("term_start"), F.col("t.end").alias("term_end"))
    return triage.triage(rolled, account.omitted(rolled, rows, sources), terms, RULES)


# --- packets ---------------------------------------------------------------


def _packet_pages(spark, d) -> DataFrame:
    p = docs(spark, d).where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return p.select("document_id", "page", F.when(F.col("page") % 4 != 0, (F.col("page") - 1) % 4 + 1).alias("k"), F.when(F.col("page") % 4 != 0, 3).alias("n"), F.when(F.col("page") % 4 != 0, F.concat(F.lit("heading "), F.floor((F.col("page") - 1) / 4).cast("string"))).alias("heading"), F.lit(None).cast("string").alias("policy"))


@query("plan_runs")
def _(spark, d):
    p = _packet_pages(spark, d)
    return packets.incomplete_runs(packets.plan_runs(p), p)


# --- structure ------------------------------------------------------------

WORDS = "SELECT l_orderkey AS k, l_linenumber AS line, cast(l_partkey % 90 AS double) AS x0, cast(l_partkey % 90 + l_suppkey % 9 + 1 AS double) AS x1 FROM lineitem"


@query("column_bounds", f"""WITH w AS ({WORDS}), f AS (SELECT *, coalesce(x0 - max(x1) OVER (PARTITION BY k ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2.4, true) AS new FROM w), g AS (SELECT *, sum(cast(new AS int)) OVER (PARTITION BY k ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS c FROM f)
    SELECT k, cast(c AS bigint) AS "column", min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY 1, 2""", entities=False)
def _(spark, d):
    w = tables(spark, d, "lineitem")[0].selectExpr("l_orderkey as k", "cast(l_partkey % 90 as double) as x0", "cast(l_partkey % 90 + l_suppkey % 9 + 1 as double) as x1", "2.0D as width")
    return structure.column_bounds(w, ["k"])


@query("split_cells", f"""WITH w AS ({WORDS}), f AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY k ORDER BY x0, x1, line) > 3.6, true) AS new FROM w), g AS (SELECT *, sum(cast(new AS int)) OVER (PARTITION BY k ORDER BY x0, x1, line ROWS UNBOUNDED PRECEDING) AS c FROM f)
    SELECT k, cast(c AS bigint) AS cell, min(x0) AS x0, max(x1) AS x1, string_agg(cast(line AS string), ' ' ORDER BY x0, x1, line) AS text FROM g GROUP BY 1, 2""", entities=False)
def _(spark, d):
    w = tables(spark, d, "lineitem")[0].selectExpr("l_orderkey as k", "l_linenumber as line", "cast(l_linenumber as string) as text", "cast(l_partkey % 90 as double) as x0", "cast(l_partkey % 90 + l_suppkey % 9 + 1 as double) as x1", "2.0D as width")
    return structure.split_cells(w, ["k"], then="line")


@query("page_furniture", r"""WITH r AS (SELECT conv_id % 40 AS document_id, turn AS page, trim(regexp_replace(regexp_replace(lower(role || ' says' || CASE WHEN turn % 2 = 0 THEN ' 7' ELSE '' END), 'page\s+\d+\s+of\s+\d+', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations), p AS (SELECT document_id, count(DISTINCT page) AS pages FROM r GROUP BY 1)
    SELECT document_id, t AS text, count(DISTINCT page) AS on_pages FROM r JOIN p USING (document_id) WHERE NOT regexp_matches(t, '[0-9]') GROUP BY 1, 2, pages HAVING count(DISTINCT page) >= greatest(2, pages // 2)""", entities=False)
def _(spark, d):
    r = tables(spark, d, "conversations")[0].select((F.col("conv_id") % 40).alias("document_id"), F.col("turn").alias("page"), F.concat("role", F.lit(" SAYS"), F.when(F.col("turn") % 2 == 0, " 7").otherwise("")).alias("text"))
    return structure.furniture(r, r.groupBy("document_id").agg(F.countDistinct("page").alias("pages")))


@query("header_contest", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY document_id, field ORDER BY conf DESC, page, row_id) = 1 THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS state FROM (SELECT document_id, page, row_id, claim_number AS field, cast(page % 3 AS double) AS conf FROM claims)) GROUP BY 1")
def _(spark, d):
    h = claims(spark, d).select("document_id", (F.col("page") * 1000 + F.col("row_id")).alias("column"), F.col("claim_number").alias("field"), (F.col("page") % 3).cast("double").alias("confidence"))
    return structure.map_headers(h).groupBy("state").agg(F.count("*").alias("n"))


@query("continuations", """SELECT document_id, owner, string_agg(cast(row_id AS string), ' ' ORDER BY row_id) AS text, count(*) FILTER (c IS NULL) AS continued FROM (SELECT document_id, row_id, c, last_value(c IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY row_id) AS owner FROM (SELECT document_id, row_id, CASE WHEN row_id % 3 = 1 THEN concat(claim_number, ':', cast(row_id AS string)) END AS c FROM claims)) WHERE owner IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    lines = claims(spark, d).select("document_id", F.lit(1).alias("page"), F.col("row_id").alias("line"), F.when(F.col("row_id") % 3 == 1, F.concat_ws(":", "claim_number", F.col("row_id").cast("string"))).alias("claim"), F.col("row_id").cast("string").alias("text"))
    return structure.continuations(lines)


@query("section_scope", """WITH s AS (SELECT document_id, 1 AS page, row_id AS line, 2 AS printed, coalesce(lag(row_id) OVER (PARTITION BY document_id ORDER BY row_id), -1) AS lo FROM claims WHERE row_id % 3 = 0)
    SELECT s.document_id, s.line, count(c.row_id) = 2 AS scoped FROM s LEFT JOIN claims c ON c.document_id = s.document_id AND c.row_id > s.lo AND c.row_id < s.line AND c.row_id % 3 > 0 GROUP BY 1, 2""")
def _(spark, d):
    rows = claims(spark, d).select("document_id", F.lit(1).alias("page"), F.col("row_id").alias("line"), "row_id")
    sections = rows.where("row_id % 3 = 0").withColumn("printed", F.lit(2)).drop("row_id")
    return structure.scope_sections(sections, rows.where("row_id % 3 > 0")).select("document_id", "line", F.col("covers").isNotNull().alias("scoped"))


# --- review, edits, measurement -------------------------------------------


@query("latest_decision", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", entities=False)
def _(spark, d):
    return review.latest_decisions(tables(spark, d, "events")[0], "user_id", "event_id").select("user_id", "event_id", "event_type")


#: A log of decisions on findings of R-05: the last entry counts, and only while it saw the same severity and amounts.
@query("open_findings", f"""SELECT document_id, run_id, CASE WHEN document_id % 3 = 0 THEN NULL WHEN document_id % 5 = 0 THEN NULL WHEN document_id % 7 = 0 THEN NULL ELSE 'confirmed' END AS decision FROM ({RULE_SQL['R-05']}) f""")
def _(spark, d):
    e = evidence(spark, d)
    raised = rules.REGISTRY["R-05"](rules.run_view(e).evidence, rules.Config()).withColumn("key", review.finding_key())
    by = F.col("document_id")
    first = raised.select("key", F.lit(1).alias("seq"), F.lit("dismissed").alias("action"), "severity", "expected", "actual")
    second = raised.where(by % 3 != 0).select("key", F.lit(2).alias("seq"), F.when(by % 5 == 0, "OPEN").otherwise("confirmed").alias("action"), F.when(by % 7 == 0, "WARN").otherwise(F.col("severity")).alias("severity"), F.concat(F.col("expected"), F.lit(".00")).alias("expected"), "actual")
    log = first.join(second.select("key"), "key", "left_semi").unionByName(second)
    return review.open_findings(raised, log).select("document_id", "run_id", "decision")


@query("edits", "SELECT field, change, count(*) AS n FROM (SELECT 'claim_status' AS field, 'changed' AS change FROM claims WHERE page = 1 AND claim_status <> 'CLOSED' UNION ALL SELECT f, 'deleted' FROM claims, (VALUES ('claim_status'), ('incurred_total')) v(f) WHERE page = 7) GROUP BY 1, 2")
def _(spark, d):
    before = claims(spark, d)
    after = before.where("page <> 7").withColumn("claim_status", F.when(F.col("page") == 1, "CLOSED").otherwise(F.col("claim_status")))
    return review.edits(before, after, ["document_id", "row_id"], ["claim_status", "incurred_total"]).groupBy("field", "change").agg(F.count("*").alias("n"))


@query("telemetry_rates", """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, round_even(count(*) FILTER (value > 50) / count(*), 4) AS high, round_even(count(*) FILTER (user_id % 2 = 0) / count(*), 4) AS even FROM l GROUP BY ROLLUP (event_type)""", entities=False)
def _(spark, d):
    e = measure.latest(tables(spark, d, "events")[0], "user_id", ["ts", "event_id"])
    return measure.rates(e, "event_type", {"high": F.col("value") > 50, "even": F.col("user_id") % 2 == 0})


@query("null_counts", "SELECT document_id, count(*) FILTER (date_of_loss IS NULL) AS date_of_loss, count(*) FILTER (incurred_total IS NULL) AS incurred_total, count(*) FILTER (paid_total IS NULL) AS paid_total FROM claims GROUP BY 1")
def _(spark, d):
    return measure.null_counts(claims(spark, d), "document_id", ["date_of_loss", "incurred_total", "paid_total"])


@query("accuracy", """SELECT coalesce(carrier, 'ALL') AS carrier, count(*) AS fields, count(*) FILTER (NOT lost AND NOT wrong) AS "right", count(*) FILTER (lost) AS missing, count(*) FILTER (NOT lost AND zero) AS null_as_zero
    FROM (SELECT carrier, page = 7 AS lost, (f = 'p' AND page = 2 AND paid_total IS NULL) AS zero, (f = 'p' AND page = 2 AND paid_total IS NULL) AS wrong FROM claims JOIN docs USING (document_id), (VALUES ('p'), ('i')) v(f)) GROUP BY ROLLUP (carrier)""")
def _(spark, d):
    e = account_claims(spark, d).withColumn("ord", F.lit(1))
    x = e.where("page <> 7").withColumn("paid_total", F.when(F.col("page") == 2, F.coalesce("paid_total", F.lit(0).cast("decimal(18,2)"))).otherwise(F.col("paid_total")))
    return measure.accuracy(e, x, ["document_id", "row_id"], ["paid_total", "incurred_total"], "carrier")


@query("revision_diff", "SELECT path, allowed, count(*) AS n FROM (SELECT 'claim_status' AS path, document_id % 2 = 0 AS allowed FROM claims WHERE page = 1 AND claim_status <> 'CLOSED') GROUP BY 1, 2")
def _(spark, d):
    c = claims(spark, d).withColumn("id", F.col("document_id") * 100 + F.col("row_id"))
    after = c.withColumn("claim_status", F.when(F.col("page") == 1, "CLOSED").otherwise(F.col("claim_status")))
    allowed = c.where("document_id % 2 = 0").select(F.col("id").alias("document_id"), F.lit("claim_status").alias("path"))
    fields = ["claim_status", "incurred_total", "date_of_loss"]
    return measure.revision_diff(measure.flattened(c, "id", fields), measure.flattened(after, "id", fields), allowed).groupBy("path", "allowed").agg(F.count("*").alias("n"))


@query("qualification", """WITH t AS (SELECT document_id, claim_number, count(*) AS n, count(*) FILTER (page <> 7) AS m FROM claims GROUP BY 1, 2) SELECT document_id, cast(sum(n) AS bigint) AS expected, cast(sum(m) AS bigint) AS extracted, cast(sum(least(n, m)) AS bigint) AS matched FROM t GROUP BY 1""")
def _(spark, d):
    t = claims(spark, d).withColumn("ord", F.col("row_id"))
    return measure.score(t, t.where("page <> 7"), ["claim_number"], "document_id").select("document_id", "expected", "extracted", "matched")


@query("document_recall", "SELECT document_id, count(*) AS expected, count(*) FILTER (page <= 4) AS extracted, count(*) FILTER (page <= 4) / count(*) AS recall FROM claims GROUP BY 1")
def _(spark, d):
    c = claims(spark, d)
    return measure.document_recall(c, c.where("page <= 4"), "document_id")


# --- output, submissions, streaming ---------------------------------------


@query("export_projection", "SELECT claim_number, claim_status, cast(incurred_total AS double) AS incurred_total, document_id FROM claims")
def _(spark, d):
    return export.project(claims(spark, d), "compact", redact=True, provenance=("document_id",))


@query("worst_severity", f"SELECT document_id, CASE min(CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END) WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' ELSE 'INFO' END AS severity FROM ({ALL_RULES}) f GROUP BY 1")
def _(spark, d):
    return export.worst_severity(counted(spark, d), ["document_id"])


@query("redaction", "SELECT c_custkey, '[redacted] owes 5 to [redacted]' AS note FROM customer", entities=False)
def _(spark, d):
    c = tables(spark, d, "customer")[0].select("c_custkey", "c_name")
    notes = c.select("c_custkey", F.concat(F.upper("c_name"), F.lit(" owes 5 to "), "c_name").alias("note"))
    return export.redact(notes, c.select("c_custkey", F.col("c_name").alias("value")), "c_custkey", "note")


@query("attachments", """WITH p AS (SELECT user_id AS s, event_id AS pos, event_id % 97 AS sha, CASE WHEN event_type = 'click' THEN 'txt' ELSE 'pdf' END AS kind FROM events), f AS (SELECT *, min(pos) OVER (PARTITION BY s, sha) AS first FROM p), n AS (SELECT *, sum(CASE WHEN first = pos AND kind = 'pdf' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM f)
    SELECT s AS submission, pos AS position, CASE WHEN first < pos THEN first END AS repeats, CASE WHEN kind <> 'pdf' THEN 'rejected' WHEN first < pos THEN 'duplicate' WHEN c > 10 THEN 'over_limit' ELSE 'accepted' END AS outcome FROM n""", entities=False)
def _(spark, d):
    e = tables(spark, d, "events")[0].select(F.col("user_id").alias("submission"), F.col("event_id").alias("position"), (F.col("event_id") % 97).cast("string").alias("sha"), F.lit(1).cast("long").alias("bytes"), F.when(F.col("event_type") == "click", "txt").otherwise("pdf").alias("kind"))
    return submission.attachments(e, most=10).select("submission", "position", "repeats", "outcome")


@query("event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents FROM events GROUP BY 1, 2", entities=False)
def _(spark, d):
    return streaming.windowed_rates(tables(spark, d, "events")[0])


@query("event_latest", "SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", entities=False)
def _(spark, d):
    return streaming.latest_by_user(tables(spark, d, "events")[0])


@query("event_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, g""", entities=False)
def _(spark, d):
    return streaming.sessions(tables(spark, d, "events")[0])


@query("new_files", "SELECT page_id FROM pages WHERE page_id % 3 <> 0", entities=False)
def _(spark, d):
    p = tables(spark, d, "pages")[0].select("page_id", F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "html"), 256).alias("sha256"))
    return files.new_files(p, p.where("page_id % 3 = 0")).select("page_id")
