"""Trust, review decisions and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.rules import KINDS, number

#: Rules that say a claim or page may not be accounted for at all.
UNACCOUNTED = ["R-19", "R-20", "R-22", "R-23", "R-28", "R-29"]
BUCKETS = ["financial", "extraction", "underwriting"]
#: Decisions that replace a value.
CHANGES = ["corrected", "edited", "deleted"]
REVIEWER = "local reviewer"


def finding_key() -> Column:
    """A finding's identity."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule", "category", "scope", "document_id", "subject", "field", "condition", "run_id")]))


def latest_decisions(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last entry for each key."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_k = 1").drop("_k")


def same_amount(a: Column, b: Column) -> Column:
    """Equal as numbers, else as trimmed texts; null equals null."""
    x, y = a.try_cast("decimal(28,6)"), b.try_cast("decimal(28,6)")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.trim(a).eqNullSafe(F.trim(b)))


def open_findings(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings with the decision that still applies: the last one, if it saw the same severity and amounts. log: key, seq, action, severity, expected, actual."""
    last = latest_decisions(log, "key", "seq").select("key", "action", F.col("severity").alias("l_severity"), F.col("expected").alias("l_expected"), F.col("actual").alias("l_actual"))
    both = findings.join(last, "key", "left")
    applies = (F.col("severity") == F.col("l_severity")) & same_amount(F.col("expected"), F.col("l_expected")) & same_amount(F.col("actual"), F.col("l_actual"))
    return both.withColumn("decision", F.when(applies & (F.upper("action") != "OPEN"), F.col("action"))).drop("action", "l_severity", "l_expected", "l_actual")


def resolutions(findings: DataFrame, actions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Log entries of decisions, with all that the finding said and the document's status before and after. findings: with key; actions: key, seq, action, note, old, new; before, after: document_id, status."""
    said = findings.select("key", "document_id", "rule", "severity", "claim_number", "field", "subject", "expected", "actual")
    status = lambda df, name: df.select("document_id", F.col("status").alias(name))
    rows = actions.join(said, "key").join(status(before, "status_before"), "document_id", "left").join(status(after, "status_after"), "document_id", "left")
    return rows.withColumn("reviewer", F.lit(REVIEWER)).withColumn("changed_a_value", changed_a_value(F.col("action"), F.col("old"), F.col("new")))


def changed_a_value(action: Column, old: Column, new: Column) -> Column:
    return F.lower(action).isin(CHANGES) & ~old.eqNullSafe(new)


def corrections(log: DataFrame) -> DataFrame:
    """Entries that replaced a value. log: action, old, new."""
    return log.where(changed_a_value(F.col("action"), F.col("old"), F.col("new")))


def blocks_trust() -> Column:
    """Whether a finding alone stops its document from being trusted: all but underwriting observations that account for every claim and page."""
    return (F.col("category") != "underwriting") | (F.col("severity") == "ERROR") | F.col("rule").isin(UNACCOUNTED)


#: Rules whose findings block no trust.
HARMLESS = tuple(r for r, (severity, category, _) in KINDS.items() if category == "underwriting" and severity != "ERROR" and r not in UNACCOUNTED)


def review_bucket() -> Column:
    """The question that a finding answers: an observation that a claim may be missing counts with extraction."""
    return F.when((F.col("category") == "underwriting") & F.col("rule").isin(UNACCOUNTED), "extraction").otherwise(F.col("category"))


def finding_facts(findings: DataFrame) -> DataFrame:
    """document_id and the numbers of its findings: by the question that they answer, in total, still open, blocking trust, and about what may be missing. findings: or their tally, with decision, or all open."""
    open_ = F.col("decision").isNull() if "decision" in findings.columns else F.lit(True)
    return findings.groupBy("document_id").agg(
        *[number(findings, review_bucket() == b).alias(b) for b in BUCKETS], number(findings).alias("total"), number(findings, open_).alias("outstanding"), number(findings, blocks_trust()).alias("blocking"), number(findings, F.col("rule").isin(UNACCOUNTED)).alias("missing"),
    )


def judged(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """docs with their finding_facts, review_status, trust, reviewed, fully_reviewed and headline, from one aggregation of the findings. docs: document_id, reconciled, needs_mapping.

    CLEAN only where nothing says that the document needs a person; it fails closed. trust: auto_safe, needs_review, or unresolved where something
    may not be accounted for or columns aren't mapped. The headline names the worst thing that is true; a decision is no proof, so it never
    makes a document healthier than its checks.
    """
    counts = [*BUCKETS, "total", "outstanding", "blocking", "missing"]
    both = docs.join(finding_facts(findings), "document_id", "left").fillna(0, counts)
    known = F.coalesce("reconciled", F.lit(False)) & ~F.coalesce("needs_mapping", F.lit(True))
    clean = known & (F.col("blocking") == 0)
    trust = F.when(clean, "auto_safe").when(~known | (F.col("missing") > 0), "unresolved").otherwise("needs_review")
    headline = (
        F.when(F.col("extraction") > 0, "not read cleanly").when(F.col("financial") > 0, "does not reconcile")
        .when((F.col("underwriting") > 0) & (F.col("outstanding") > 0), "reconciled, flags to review").when(F.col("underwriting") > 0, "reconciled, flags reviewed").otherwise("reconciled")
    )
    looked = {"reviewed": F.col("total") - F.col("outstanding"), "fully_reviewed": (F.col("total") > 0) & (F.col("outstanding") == 0)}
    return both.withColumns({"review_status": F.when(clean, "CLEAN").otherwise("NEEDS_REVIEW"), "trust": trust, "headline": headline} | looked)


def canonical_status(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """document_id, review_status, trust and blocking of judged documents."""
    return judged(docs, findings).select("document_id", "review_status", "trust", "blocking")


def canonical_run_status(runs: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, run_id, review_status: findings without a run count for every run. runs: document_id, run_id of packets; docs: document_id, reconciled, needs_mapping."""
    blocked = findings.where(blocks_trust()).groupBy("document_id").agg(F.collect_set("run_id").alias("blocked"))
    both = runs.select("document_id", "run_id").join(blocked, "document_id", "left").join(docs.select("document_id", "reconciled", "needs_mapping"), "document_id", "left")
    held = F.coalesce(F.arrays_overlap("blocked", F.array(F.lit(""), F.col("run_id"))), F.lit(False))
    clean = F.coalesce("reconciled", F.lit(False)) & ~F.coalesce("needs_mapping", F.lit(True)) & ~held
    return both.select("document_id", "run_id", F.when(clean, "CLEAN").otherwise("NEEDS_REVIEW").alias("review_status"))


def buckets(findings: DataFrame) -> DataFrame:
    """Findings of a document by the question that they answer, with those still open (no decision). A question passes where it has no finding, whatever was decided."""
    open_ = F.col("decision").isNull() if "decision" in findings.columns else F.lit(True)
    g = findings.withColumn("bucket", review_bucket()).groupBy("document_id", "bucket")
    return g.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(open_).alias("outstanding"))


def edits(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Changed, added and deleted fields between two versions of rows: keys, field, change, old, new."""

    def long(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]))
        return df.select(*keys, each.alias("x")).select(*keys, "x.field", f"x.{name}", F.lit(True).alias(f"in_{name}"))

    both = long(before, "old").join(long(after, "new"), [*keys, "field"], "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "field", "change", "old", "new")
