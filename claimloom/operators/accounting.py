"""What each run of a document printed, and what of it was read; and the events that measure it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators.review import blocks_trust
from claimloom.operators.rules import KEY, Packets, number


def tie(present: Column, failed: Column, words: tuple[str, str, str] = ("not printed", "does not tie", "ties")) -> Column:
    """Whether a printed figure ties: what isn't printed can't."""
    return F.when(~F.coalesce(present, F.lit(False)), words[0]).when(F.coalesce(failed, F.lit(False)), words[1]).otherwise(words[2])


def printed_facts(units: Packets) -> DataFrame:
    """One row for each run of a packet, and for each other document: what it printed, claims read, rows refused and unplaced with their pages; packet: null, or true for a run."""
    e = units.evidence
    packet = units.kinds.where("kind = 'run'").select("document_id").distinct().withColumn("packet", F.lit(True))
    kept = units.kinds.where("kind <> 'whole'").select(*KEY, "settled")
    rows = lambda t: t.select(*KEY, "page", "row").distinct().groupBy(*KEY)
    refused = rows(e.table("refused")).agg(F.count("*").alias("refused_rows"), F.sort_array(F.collect_set("page")).alias("refused_pages"))
    unplaced = rows(e.table("unplaced")).agg(F.count("*").alias("unplaced_rows"), F.sort_array(F.collect_set("page")).alias("unplaced_pages"))
    n = e.claims.groupBy(*KEY).agg(F.count("*").alias("claims_read"))
    printed = e.table("printed").groupBy(*KEY).agg(F.bool_or(F.col("amount").isNotNull()).alias("totals_present"))
    facts = e.docs.select(*KEY, "carrier", "policy_number", "period_start", "period_end", "printed_count")
    both = kept.join(packet, "document_id", "left").join(facts, KEY)
    for t in (n, refused, unplaced, printed):
        both = both.join(t, KEY, "left")
    pages = lambda c: F.coalesce(c, F.array().cast("array<int>")).alias(c)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(
        *KEY, "packet", "carrier", "policy_number", "period_start", "period_end", F.when(F.col("packet"), F.col("settled")).otherwise(True).alias("boundary_settled"), "printed_count", none("claims_read"),
        none("refused_rows"), pages("refused_pages"), none("unplaced_rows"), pages("unplaced_pages"), F.coalesce("totals_present", F.lit(False)).alias("printed_totals_present"),
    )


def claim_accounting(units: Packets, findings: DataFrame, status: DataFrame, run_status: DataFrame) -> DataFrame:
    """printed_facts, whether figures tie, and what blocks trust.

    findings: those of the documents, or their tally by unit; one without a run counts for every run. status: document_id, review_status; run_status: document_id, run_id, review_status.
    """
    printed = printed_facts(units)
    said = [F.bool_or(F.col("rule") == r).alias(f"r{r[2:]}") for r in ("R-04", "R-05")] + [F.sort_array(F.collect_set(F.when(blocks_trust(), F.col("rule")))).alias("blocking")]
    own = findings.where("run_id <> ''").groupBy(*KEY).agg(*said)
    whole = findings.where("run_id = ''").groupBy("document_id").agg(*said)
    both = printed.join(own.withColumnsRenamed({c: f"o_{c}" for c in ("r04", "r05", "blocking")}), KEY, "left").join(whole, "document_id", "left")
    both = both.join(status.select("document_id", "review_status"), "document_id", "left").join(run_status.withColumnRenamed("review_status", "own_status"), KEY, "left")
    either = lambda c: F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"o_{c}"), F.lit(False))
    none = F.array().cast("array<string>")
    return both.select(
        *[c for c in printed.columns if c != "packet"], tie(F.col("printed_totals_present"), either("r04")).alias("totals"), tie(F.col("printed_count").isNotNull(), either("r05")).alias("claim_count"),
        F.when(F.col("packet"), F.col("own_status")).otherwise(F.col("review_status")).alias("status"), F.array_sort(F.array_union(F.coalesce("blocking", none), F.coalesce("o_blocking", none))).alias("reasons"),
    )


def document_class(method: Column, packet: Column) -> Column:
    """Reader and shape of a document."""
    return F.concat_ws(":", F.coalesce(method, F.lit("unknown")), F.when(packet, "packet").otherwise("single"))


def document_facts(docs: DataFrame, findings: DataFrame, accounts: DataFrame, status: DataFrame) -> DataFrame:
    """The measured facts of processed documents: counts and tokens alone, no value of a claim. docs: document_id, extraction_method, page_count; findings: or their tally; accounts: printed_facts; status: document_id, review_status, trust."""
    counter = lambda keys, name: F.map_from_entries(F.sort_array(F.collect_list(F.struct(keys, "n")))).alias(name)
    by = findings.groupBy("document_id", "rule", "severity", "category").agg(number(findings).alias("n"))
    rule = by.groupBy("document_id", "rule").agg(F.sum("n").alias("n")).groupBy("document_id").agg(counter(F.col("rule"), "by_rule"), F.sum("n").alias("total"))
    parts = {c: by.withColumn("key", F.concat_ws("/", "rule", F.lower(c))).groupBy("document_id", "key").agg(F.sum("n").alias("n")).groupBy("document_id").agg(counter(F.col("key"), f"by_rule_{c}")) for c in ("severity", "category")}
    run = accounts.groupBy("document_id").agg(
        F.count("*").alias("runs"), F.bool_or(F.col("run_id") != "").alias("packet"), F.count_if(~F.col("boundary_settled")).alias("unsettled"), F.sum("claims_read").alias("claims"), F.sum("refused_rows").alias("refused"),
        F.sum("unplaced_rows").alias("unplaced"), F.bool_or("printed_totals_present").alias("totals_present"), F.bool_or(F.col("printed_count").isNotNull()).alias("count_present"),
    )
    both = docs.select("document_id", "extraction_method", "page_count").join(run, "document_id").join(rule, "document_id", "left").join(parts["severity"], "document_id", "left").join(parts["category"], "document_id", "left").join(status.drop("blocking"), "document_id")
    n = lambda r: F.coalesce(F.try_element_at("by_rule", F.lit(r)), F.lit(0)) > 0
    words = ("not_printed", "mismatch", "tie")
    return both.select(
        "document_id", document_class(F.col("extraction_method"), F.col("packet")).alias("document_class"), "page_count", "runs", "packet", "unsettled", "claims", "refused", "unplaced", tie(F.col("totals_present"), n("R-04"), words).alias("r04"),
        tie(F.col("count_present"), n("R-05"), words).alias("r05"), F.coalesce("total", F.lit(0)).alias("findings"), "by_rule", "by_rule_severity", "by_rule_category", "review_status", "trust",
    )


#: Shapes of strings that an event may hold beside its vocabulary.
SAFE = r"^(R-\d{2}(/[a-z_]+)?|\d{4}-\d{2}-\d{2}T[\d:.]+Z|[0-9a-f]{32}|[a-z_]+(:[a-z_]+)?)$"


def is_safe(c: Column) -> Column:
    """Whether a text may stand in an event: a rule, a time, an id or a token, and so no value of a document."""
    return c.isNull() | F.coalesce(c.rlike(SAFE), F.lit(False))


def review_events(log: DataFrame, status: DataFrame) -> DataFrame:
    """One event for each log entry: the field's name and whether its value was and is empty, never the value. log: document_id, seq, action, rule, severity, field, old, new; status: document_id, review_status."""
    changed = F.lower("action").isin("corrected", "edited", "deleted") & ~F.col("old").eqNullSafe(F.col("new"))
    blank = lambda c: F.when(changed, F.coalesce(F.col(c) == "", F.lit(True)))
    kind = F.when(F.lower("action").isin("edited", "deleted"), "claim_edited").otherwise("finding_resolved")
    return log.join(status.select("document_id", "review_status"), "document_id", "left").select(
        "document_id", "seq", kind.alias("event"), F.lower("action").alias("action"), F.when(F.col("rule").rlike(r"^R-\d{2}$"), F.col("rule")).alias("rule"), F.lower("severity").alias("severity"), "field",
        blank("old").alias("was_null"), blank("new").alias("now_null"), F.col("review_status").alias("review_status_after"),
    )


def export_events(facts: DataFrame, form: str, redacted: bool) -> DataFrame:
    """One event for each exported document. facts: document_facts."""
    return facts.select("document_id", F.lit("exported").alias("event"), F.lit(form).alias("format"), F.lit(redacted).alias("redacted"), "review_status", "trust", "document_class")
