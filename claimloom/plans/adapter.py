"""Claim entities as projections of the driver's tables, in SQL that Spark and DuckDB read alike.

Nothing is generated: documents come from orders, claims from lineitem, sources of an
account from the orders of a customer. Fields are made null, off by a little, or
repeated by remainders of keys, so every rule meets data that it reports.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.rules import Evidence

CLAIMS = """
SELECT document_id, row_id, page, run_id, claim_number, claim_status, date_of_loss, date_reported, paid_indemnity, paid_medical, paid_expense, paid_total,
       reserve_indemnity, reserve_medical, reserve_expense, reserve_total, recovery_total, currency, deductible_basis, alae_treatment,
       CASE WHEN quantity % 13 = 0 THEN NULL ELSE cast(coalesce(paid_total, cast(0 AS decimal(18,2))) + coalesce(reserve_total, cast(0 AS decimal(18,2))) - coalesce(recovery_total, cast(0 AS decimal(18,2)))
         + CASE WHEN part % 7 = 0 THEN cast(10 AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS decimal(18,2)) END AS incurred_total
FROM (SELECT *,
         CASE WHEN part % 5 = 0 THEN NULL ELSE cast(paid0 * cast(0.5 AS decimal(3,2)) AS decimal(18,2)) END AS paid_indemnity,
         cast(paid0 * cast(0.25 AS decimal(3,2)) AS decimal(18,2)) AS paid_medical,
         cast(paid0 - cast(paid0 * cast(0.5 AS decimal(3,2)) AS decimal(18,2)) - cast(paid0 * cast(0.25 AS decimal(3,2)) AS decimal(18,2)) + CASE WHEN part % 17 = 0 THEN cast(1 AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS decimal(18,2)) AS paid_expense,
         CASE WHEN part % 11 = 0 THEN NULL ELSE paid0 END AS paid_total,
         cast(reserve0 * cast(0.5 AS decimal(3,2)) AS decimal(18,2)) AS reserve_indemnity,
         CASE WHEN part % 4 = 0 THEN NULL ELSE cast(reserve0 * cast(0.5 AS decimal(3,2)) AS decimal(18,2)) END AS reserve_medical,
         cast(CASE WHEN part % 19 = 0 THEN 2 ELSE 0 END AS decimal(18,2)) AS reserve_expense,
         CASE WHEN supplier % 7 = 0 THEN NULL ELSE reserve0 END AS reserve_total,
         CASE WHEN page = 3 THEN cast(amount * cast(0.02 AS decimal(3,2)) AS decimal(18,2)) END AS recovery_total
      FROM (SELECT *,
               cast(amount * share AS decimal(18,2)) * (CASE WHEN part % 23 = 0 THEN -1 ELSE 1 END) AS paid0,
               CASE WHEN claim_status IN ('CLOSED', 'CLOSED_PAID', 'REPORT_ONLY') AND part % 3 > 0 THEN cast(0 AS decimal(18,2)) ELSE cast(amount * cast(0.10 AS decimal(3,2)) AS decimal(18,2)) END AS reserve0
            FROM (SELECT l_orderkey AS document_id, l_partkey AS part, l_suppkey AS supplier, cast(l_quantity AS int) AS quantity, l_linenumber AS page,
                     cast(cast(l_extendedprice AS decimal(12,2)) * (CASE WHEN l_partkey % 97 = 0 THEN 300 ELSE 1 END) AS decimal(14,2)) AS amount, cast(l_discount AS decimal(4,2)) AS share,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_id,
                     concat('r', cast(l_suppkey % 3 AS string)) AS run_id, concat('C', cast(l_partkey % 40 AS string)) AS claim_number,
                     CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'REOPENED' WHEN l_partkey % 31 = 0 THEN 'REPORT_ONLY' WHEN l_partkey % 29 = 0 THEN 'UNKNOWN'
                          WHEN l_linestatus = 'O' THEN 'OPEN' WHEN l_returnflag = 'A' THEN 'CLOSED_PAID' ELSE 'CLOSED' END AS claim_status,
                     CASE WHEN cast(l_quantity AS int) % 11 = 0 THEN NULL ELSE cast(l_shipdate AS date) END AS date_of_loss,
                     CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE cast(l_shipdate AS date) + cast(l_partkey % 30 - 2 AS int) END AS date_reported,
                     CASE WHEN l_suppkey % 41 = 0 THEN 'EUR' WHEN l_suppkey % 2 = 0 THEN 'USD' END AS currency,
                     CASE WHEN l_linenumber % 4 = 0 THEN 'PER_CLAIM' ELSE 'UNKNOWN' END AS deductible_basis, CASE WHEN l_linenumber % 3 = 0 THEN 'INSIDE' ELSE 'UNKNOWN' END AS alae_treatment
                  FROM {lineitem}) a) b) c
"""

DOCUMENTS = """
SELECT o_orderkey AS document_id, concat('account ', cast(o_custkey % 200 AS string)) AS insured, concat('carrier ', cast(o_orderkey % 5 AS string)) AS carrier,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('P', cast(o_custkey % 200 AS string), '-', cast(o_orderkey % 2 AS string)) END AS policy_number,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE cast(o_orderdate AS date) + 60 END AS valuation_date,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS period_start,
       CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE cast(o_orderdate AS date) + 90 END AS period_end,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 7 + 1 AS bigint) END AS printed_count,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE cast(o_totalprice AS decimal(18,2)) END AS printed_incurred,
       CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS currency, cast(o_orderkey % 9 AS int) AS page_count, o_orderpriority AS priority
FROM {orders}
"""

#: A quarter of the documents are packets of two runs: pages 1 and 2, and pages 3 to 5; later pages are in no run.
RUNS = """
SELECT document_id, run_id, ordinal, first_page, last_page, carrier, policy_number, valuation_date, period_start, period_end, printed_count, confidence, ambiguity, incomplete, borrowed
FROM (SELECT document_id, concat('r', cast(n AS string)) AS run_id, n AS ordinal, 2 * n - 1 AS first_page, 3 * n - 1 AS last_page, concat('carrier ', cast((document_id + n) % 5 AS string)) AS carrier, policy_number,
             CASE WHEN document_id % 16 = 0 THEN NULL ELSE valuation_date + n END AS valuation_date, CASE WHEN n = 2 THEN NULL ELSE period_start END AS period_start, period_end,
             CASE WHEN document_id % 3 = 0 THEN NULL ELSE cast(document_id % 4 + n AS bigint) END AS printed_count, CASE WHEN document_id % 20 = 0 AND n = 1 THEN 'READ' ELSE 'PRINTED' END AS confidence,
             CASE WHEN document_id % 12 = 0 AND n = 2 THEN 'an unnumbered page follows a finished report' END AS ambiguity, CASE WHEN document_id % 8 = 0 AND n = 2 THEN 'page 3 of 4 is the last one held' END AS incomplete,
             CASE WHEN document_id % 28 = 0 AND n = 1 THEN 'number format of another run' END AS borrowed
      FROM {docs} JOIN (SELECT 1 AS n UNION ALL SELECT 2) numbers ON document_id % 4 = 0) a
"""

SIDES = {
    "printed": """
SELECT document_id, '' AS run_id, 'incurred_total' AS field, printed_incurred AS amount FROM {docs}
UNION ALL SELECT document_id, '', 'paid_total', cast(printed_incurred * cast(0.05 AS decimal(3,2)) AS decimal(18,2)) FROM {docs} WHERE document_id % 5 = 1
UNION ALL SELECT document_id, run_id, 'reserve_total', cast(1000 * ordinal AS decimal(18,2)) FROM {runs} WHERE document_id % 3 = 0
""",
    "issues": """
SELECT document_id, cast('' AS string) AS run_id, page, cast(row_id AS int) AS row_id, claim_number, 'paid_total' AS field, CASE WHEN row_id % 2 = 0 THEN 'DASH_PLACEHOLDER' ELSE 'NOT_APPLICABLE' END AS reason FROM {claims} WHERE paid_total IS NULL
UNION ALL SELECT document_id, '', cast(NULL AS int), cast(NULL AS int), cast(NULL AS string), 'policy_period_end', 'UNPARSEABLE' FROM {docs} WHERE period_end IS NULL
""",
    "mapping": """
SELECT document_id, 2 AS column_index, 'Paid' AS header, 'MAPPED' AS state, 'paid_total' AS field, cast(NULL AS string) AS contested_field, CASE WHEN document_id % 40 = 7 THEN 'two columns fit the saved format' END AS issue FROM {docs}
UNION ALL SELECT document_id, 8 + n, concat('Total ', cast(n AS string)), 'AMBIGUOUS', cast(NULL AS string), CASE WHEN n = 1 THEN 'incurred_total' ELSE 'paid_total' END, cast(NULL AS string) FROM {docs} JOIN (SELECT 1 AS n UNION ALL SELECT 2) numbers ON document_id % 10 >= 6 + n
""",
    "outcomes": """
SELECT document_id, page, CASE (document_id + page) % 12 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'unresolved' ELSE 'processed' END AS outcome, CASE WHEN (document_id + page) % 24 = 2 THEN 'a picture that nobody read' END AS reason
FROM {docs} JOIN (SELECT 1 AS page UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) numbers ON page <= page_count WHERE (document_id + page) % 12 <> 3
UNION ALL SELECT document_id, 1, 'processed', cast(NULL AS string) FROM {docs} WHERE page_count > 0
""",
    "unplaced": """
SELECT document_id, '' AS run_id, page, cast(row_id AS int) AS row, 'paid_total' AS field, cast(paid_total AS string) AS text, row_id % 2 = 0 AS ambiguous FROM {claims} WHERE (document_id + row_id) % 9 = 0 AND paid_total IS NOT NULL
UNION ALL SELECT document_id, '', page, cast(row_id AS int), 'incurred_total', cast(incurred_total AS string), false FROM {claims} WHERE (document_id + row_id) % 9 = 0 AND incurred_total IS NOT NULL
""",
    "splits": "SELECT document_id, 1 AS left_page, 2 AS right_page FROM {docs} WHERE document_id % 25 = 4",
    "sections": "SELECT DISTINCT document_id, '' AS run_id, page, 90 AS line, 'Subtotal' AS label, document_id % 5 <> 0 AS scope_known FROM {claims}",
    "totals": """
SELECT document_id, page, 90 AS line, 'incurred_total' AS field, cast(coalesce(sum(incurred_total), 0) + CASE WHEN (document_id + page) % 6 = 0 THEN 1 ELSE 0 END AS decimal(28,2)) AS amount FROM {claims} GROUP BY document_id, page
UNION ALL SELECT document_id, page, 90, 'paid_total', cast(sum(paid_total) - CASE WHEN (document_id + page) % 7 = 0 THEN 3 ELSE 0 END AS decimal(28,2)) FROM {claims} GROUP BY document_id, page
""",
    "covers": "SELECT document_id, page, 90 AS line, cast(row_id AS int) AS row_id FROM {claims}",
    "unreadable": """
SELECT DISTINCT document_id, '' AS run_id, page, 90 AS line, 'reserve_total' AS field, '4 30,000.00' AS text FROM {claims} WHERE (document_id + page) % 13 = 0 AND document_id % 4 <> 0
UNION ALL SELECT document_id, '', cast(NULL AS int), cast(NULL AS int), 'paid_total', '1,23,4' FROM {docs} WHERE document_id % 17 = 0
UNION ALL SELECT document_id, run_id, last_page, 7, 'paid_total', '9 9.00' FROM {runs} WHERE document_id % 11 = 0
""",
    "counts": """
SELECT document_id, '' AS run_id, 1 AS page, 3 AS count FROM {docs} WHERE document_id % 2 = 1 UNION ALL SELECT document_id, '', 2, 4 FROM {docs} WHERE document_id % 7 = 1
UNION ALL SELECT document_id, run_id, first_page, 5 FROM {runs} WHERE document_id % 24 = 0
""",
    "seen": "SELECT document_id, '' AS run_id, page, cast(count(*) + CASE WHEN page = 2 THEN 1 ELSE 0 END AS int) AS rows FROM {claims} GROUP BY document_id, page",
    "refused": "SELECT document_id, '' AS run_id, page, cast(row_id AS int) AS row, claim_number AS identifier, row_id % 2 = 1 AS report FROM {claims} WHERE (document_id * 3 + row_id) % 5 < 2",
}

#: What rules judge, for DuckDB alone: packets, units, the claims of units, and the rows beside them, by the page's run or the unit that they name.
UNITS = {
    "packets": "SELECT document_id, count(*) AS n_runs, bool_and(confidence IN ('PRINTED', 'STRUCTURAL') AND ambiguity IS NULL) AS settled FROM {runs} GROUP BY 1 HAVING count(*) > 1",
    "units": """
SELECT document_id, '' AS run_id, carrier, policy_number, valuation_date, period_start, period_end, printed_count, currency, page_count, CASE WHEN settled IS NULL THEN 'single' ELSE 'whole' END AS kind, false AS ambiguous, coalesce(settled, true) AS settled
FROM {docs} LEFT JOIN packets USING (document_id) WHERE settled IS NOT true
UNION ALL SELECT r.document_id, r.run_id, r.carrier, r.policy_number, r.valuation_date, r.period_start, r.period_end, r.printed_count, d.currency, d.page_count, 'run', ambiguity IS NOT NULL, settled FROM {runs} r JOIN {docs} d USING (document_id) JOIN packets USING (document_id)
""",
    "uclaims": """
SELECT c.* EXCLUDE (run_id), '' AS run_id FROM {claims} c LEFT JOIN packets USING (document_id) WHERE settled IS NOT true
UNION ALL SELECT c.* EXCLUDE (run_id), r.run_id FROM {claims} c JOIN {runs} r ON c.document_id = r.document_id AND c.page BETWEEN first_page AND last_page
""",
}
for _name in ("seen", "unplaced", "refused", "sections"):
    UNITS[f"at_{_name}"] = f"""
SELECT x.* EXCLUDE (run_id), '' AS run_id FROM side_{_name} x LEFT JOIN packets USING (document_id) WHERE settled IS NOT true
UNION ALL SELECT x.* EXCLUDE (run_id), r.run_id FROM side_{_name} x JOIN {{runs}} r ON x.document_id = r.document_id AND x.page BETWEEN first_page AND last_page
"""
for _name in ("printed", "counts", "unreadable"):
    UNITS[f"of_{_name}"] = f"SELECT x.* FROM side_{_name} x LEFT JOIN packets USING (document_id) WHERE settled IS NULL AND run_id = '' OR settled AND run_id <> '' OR settled = false"
UNITS["at_issues"] = """
SELECT x.* EXCLUDE (run_id), '' AS run_id FROM side_issues x LEFT JOIN packets USING (document_id) WHERE row_id IS NULL OR settled IS NOT true
UNION ALL SELECT x.* EXCLUDE (run_id), r.run_id FROM side_issues x JOIN {runs} r ON row_id IS NOT NULL AND x.document_id = r.document_id AND x.page BETWEEN first_page AND last_page
"""

SQL = {"claims": CLAIMS, "docs": DOCUMENTS, "runs": RUNS} | {f"side_{k}": v for k, v in SIDES.items()} | UNITS


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


#: The line's place in its order, as the SQL of CLAIMS states it.
PLACE = re.search(r"row_number\(\) OVER \([^)]*\)", CLAIMS).group()


def by_document(rows: DataFrame, *key: str) -> DataFrame:
    """rows as a table in files of equal hashes of key, a document's or another, so that plans which read it often shuffle it once; its files go when the driver's JVM ends.

    Joins on more columns than the key then leave both sides where they are.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket of one file is not sorted again
    name = f"claimloom_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/claimloom/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("path", path.toString()).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    spark._jvm.System.gc()  # the shuffle's files go once nothing refers to them
    return spark.table(name)


def kept(rows: DataFrame, *key: str) -> DataFrame:
    """rows as such a table, dealt by key first: for what several steps of a plan read and is dear to compute."""
    return by_document(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key), *key)


def dealt_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(claims, docs) from lineitem and orders that lie by document, with the place of each line."""
    lines, orders = tables(spark, sf_dir, "lineitem", "orders")
    placed = by_document(in_place(lines), "l_orderkey")
    held = kept(orders, "o_orderkey")
    return spark.sql(CLAIMS.replace(PLACE, "place"), lineitem=placed), spark.sql(DOCUMENTS, orders=held)


def in_place(lines: DataFrame) -> DataFrame:
    """lines with place, by which they are shuffled before they become claims; so claims lie by document_id and need no second shuffle by it."""
    return lines.sparkSession.sql(f"SELECT *, {PLACE} AS place FROM {{lines}}", lines=lines)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLAIMS.replace(PLACE, "place"), lineitem=in_place(tables(spark, sf_dir, "lineitem")[0]))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOCUMENTS, orders=tables(spark, sf_dir, "orders")[0])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pages(spark.sql(RUNS, docs=docs(spark, sf_dir)))


def with_pages(found: DataFrame) -> DataFrame:
    return found.withColumn("pages", F.expr("sequence(first_page, last_page)")).drop("first_page", "last_page")


def evidence(spark: SparkSession, sf_dir: str, once: bool = False) -> Evidence:
    """All that the rules read; once: from tables that are shuffled once, which pays where many rules read them."""
    read, papers = dealt_once(spark, sf_dir) if once else (claims(spark, sf_dir), docs(spark, sf_dir))
    named = {"claims": read, "docs": papers, "runs": spark.sql(RUNS, docs=papers)}
    sides = {}
    for name, text in SIDES.items():
        used = {k: v for k, v in named.items() if f"{{{k}}}" in text}
        sides[name] = spark.sql(text.replace("AS count FROM", "AS `count` FROM").replace("AS rows FROM", "AS `rows` FROM"), **used)
    sides["mapping"] = sides["mapping"].withColumnRenamed("column_index", "column")
    empty_run = F.lit("")
    return Evidence(named["claims"].withColumn("run_id", empty_run), named["docs"].withColumn("run_id", empty_run), sides | {"runs": with_pages(named["runs"])})


def with_entities(query: str) -> str:
    """DuckDB SQL with the entities that it names in front."""
    used: list[str] = []

    def need(text: str) -> None:
        for n in SQL:
            if n not in used and re.search(rf"\b{n}\b", text):
                need(SQL[n].format(lineitem="lineitem", orders="orders", claims="claims", docs="docs", runs="runs"))
                if n not in used:
                    used.append(n)

    need(query)
    parts = ", ".join(f"{n} AS ({SQL[n].format(lineitem='lineitem', orders='orders', claims='claims', docs='docs', runs='runs')})" for n in used)
    if not parts:
        return query
    return f"WITH {parts} {query}" if not query.lstrip().upper().startswith("WITH") else f"WITH {parts}, {query.lstrip()[4:]}"
