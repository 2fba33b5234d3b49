"""Submissions: attachments of one email, their outcome, and what blocks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTACHMENTS, MAX_BYTES = 25, 200 * 1024 * 1024


def attachments(parts: DataFrame, most: int = MAX_ATTACHMENTS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Each part's outcome in order: a repeat of an earlier file, beyond a limit (which then stays shut), or accepted. parts: submission, position, sha, bytes, kind."""
    order = Window.partitionBy("submission").orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("position").over(Window.partitionBy("submission", "sha"))
    rows = parts.withColumn("repeats", F.when(first < F.col("position"), first)).withColumn("_new", F.col("repeats").isNull() & (F.col("kind") == "pdf"))
    rows = rows.withColumn("_n", F.sum(F.col("_new").cast("int")).over(upto)).withColumn("_b", F.sum(F.when(F.col("_new"), F.col("bytes")).otherwise(0)).over(upto))
    shut = F.max(((F.col("_n") > most) | (F.col("_b") > most_bytes)).cast("int")).over(upto) == 1
    outcome = F.when(F.col("kind") != "pdf", "rejected").when(F.col("repeats").isNotNull(), "duplicate").when(shut, "over_limit").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("_new", "_n", "_b")


#: What a submission's status says.
LABELS = {"ready": "Complete and reconciled", "needs_review": "Needs review", "incomplete": "Incomplete: attachments outstanding"}
LARGE = "25000"


def incurred_or_reason(accounts: DataFrame) -> DataFrame:
    """accounts with incurred, or the first reason for none, in this order. accounts: awaiting (documents whose columns aren't mapped), accounts (of its submission), named, currencies, currency_known, uncertain, missing (claims without an amount), total."""
    c = F.col
    count = lambda n, text: F.concat(F.lit("not totalled: "), c(n), F.lit(text))
    reason = (
        F.when(c("awaiting") > 0, count("awaiting", " document(s) still need their columns mapped, so their claims are not included yet"))
        .when((c("accounts") > 1) | ~c("named"), "not combined: this submission holds more than one insured, or documents that do not name one")
        .when(~c("currency_known") | (c("currencies") != 1), "not totalled: the documents are in more than one currency, or it is unclear")
        .when(c("uncertain") > 0, "not totalled: some claims may be one claim counted twice, because a run does not print its carrier or policy")
        .when(c("missing") > 0, count("missing", " claim(s) have no incurred amount"))
    )
    return accounts.withColumn("reason", reason).withColumn("incurred", F.when(F.col("reason").isNull(), F.coalesce("total", F.lit(0).cast("decimal(28,2)"))))


def resolved() -> Column:
    """Whether an attachment needs nothing more: set aside, rightly left out, or read. Columns: outcome, set_aside, processing."""
    return F.col("set_aside") | F.col("outcome").isin("duplicate", "skipped") | ((F.col("outcome") == "accepted") & (F.col("processing") == "processed"))


def intake(submissions: DataFrame, attachments: DataFrame) -> DataFrame:
    """submissions with the numbers of attachments by outcome, those set aside and unresolved, and whether intake is complete. submissions: submission, inventory_complete, problems (array)."""
    g = attachments.groupBy("submission").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "duplicate", "rejected", "failed")], F.count_if("set_aside").alias("set_aside"), F.count_if(~resolved()).alias("unresolved"),
    )
    both = submissions.join(g, "submission", "left").fillna(0, ["accepted", "duplicate", "rejected", "failed", "set_aside", "unresolved"])
    return both.withColumn("intake_complete", F.col("inventory_complete") & (F.size("problems") == 0) & (F.col("unresolved") == 0))


def blockers(submissions: DataFrame, attachments: DataFrame, documents: DataFrame, accounts: DataFrame) -> DataFrame:
    """submission, blockers: what stands in the way, once each, in order: of intake, of attachments and documents by position, of accounts.

    attachments: submission, position, filename, outcome, reason, set_aside, processing, document_id; documents: document_id, needs_mapping, review_status, blocking;
    accounts: submission, account, reasons (array), several_terms, dropped.
    """
    read = F.struct("needs_mapping", "review_status", "blocking")
    rows = attachments.join(documents.select("document_id", read.alias("read")), "document_id", "left")
    who = F.concat(F.lit("Attachment "), "position", F.lit(" ("), "filename", F.lit(")"))
    bad = F.col("outcome").isin("rejected", "failed")
    unread = (F.col("outcome") == "accepted") & ~F.coalesce(F.col("processing") == "processed", F.lit(False))
    said = (
        F.when(F.col("set_aside"), F.lit(None).cast("string")).when(bad, F.concat(who, F.lit(" was "), "outcome", F.lit(": "), "reason", F.lit(" Confirm it is not a loss run this submission needs.")))
        .when(unread, F.concat(who, F.lit(" was not read: "), F.coalesce("reason", F.lit("processing has not finished."))))
        .when(F.col("document_id").isNotNull() & F.col("read").isNull(), F.concat(who, F.lit(" was read, but its document has since been removed from this session.")))
    )
    open_ = F.when(F.col("read.needs_mapping"), F.concat(who, F.lit(" needs its columns mapped before its claims can be used."))).when(F.col("read.review_status") != "CLEAN", F.concat(who, F.lit(" needs review: "), F.col("read.blocking"), F.lit(" open issue(s).")))
    item = lambda stage, at, text: F.struct(F.lit(stage).alias("stage"), at.cast("bigint").alias("at"), text.alias("text"))
    of_files = rows.select("submission", F.explode(F.array(item(2, F.col("position"), said), item(3, F.col("position"), open_))).alias("i"))
    complete = F.when(~F.col("inventory_complete"), "The email could not be read completely, so some attachments may not be listed.")
    of_mail = submissions.select("submission", F.explode(F.concat(F.array(item(0, F.lit(0), complete)), F.transform("problems", lambda p, i: F.struct(F.lit(1).alias("stage"), i.cast("bigint").alias("at"), p.alias("text"))))).alias("i"))
    place = F.row_number().over(Window.partitionBy("submission").orderBy(F.desc("documents"), "account"))
    named = accounts.withColumn("at", place)
    own = F.filter("reasons", lambda r: ~r.contains("needs review") & ~r.contains("not reconciled"))
    lines = F.concat(F.transform(own, lambda r: F.concat(F.col("account"), F.lit(": "), r)), F.array(
        F.when(F.col("several_terms") > 0, F.concat("account", F.lit(": "), "several_terms", F.lit(" claim(s) fall inside more than one printed policy term; which term covers them needs review."))),
        F.when(F.col("dropped") > 0, F.concat("account", F.lit(": "), "dropped", F.lit(" claim(s) listed in an earlier valuation are missing from a later one."))),
    ))
    of_accounts = named.select("submission", F.explode(F.transform(lines, lambda t, i: F.struct(F.lit(4).alias("stage"), (F.col("at") * 1000 + i).cast("bigint").alias("at"), t.alias("text")))).alias("i"))
    several = accounts.groupBy("submission").agg(F.count("*").alias("n"), F.bool_or(~F.col("named")).alias("unnamed"))
    split = F.when(F.col("n") > 1, "The documents do not agree on one insured; their figures are shown separately and not combined.").when(F.col("unnamed"), "No document names the insured. Confirm whose loss history this is before using the figures.")
    every = of_mail.unionByName(of_files).unionByName(of_accounts).unionByName(several.select("submission", item(5, F.lit(0), split).alias("i"))).where("i.text is not null")
    g = every.groupBy("submission").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("i")), lambda x: x["text"])).alias("blockers"))
    return submissions.select("submission").join(g, "submission", "left").withColumn("blockers", F.coalesce("blockers", F.array().cast("array<string>")))


def submission_status(received: DataFrame, attachments: DataFrame, documents: DataFrame, found: DataFrame, accounts: DataFrame) -> DataFrame:
    """submission, status, label: ready only with a clean document, one named account and no blocker; incomplete where intake is, or a read document is gone. received: intake; found: blockers."""
    rows = attachments.where("document_id is not null").join(documents.select("document_id", "needs_mapping", "review_status"), "document_id", "left")
    g = rows.groupBy("submission").agg(F.count("review_status").alias("documents"), F.bool_or(F.col("review_status").isNull() & ~F.col("set_aside")).alias("removed"), F.bool_and((F.col("review_status") == "CLEAN") & ~F.col("needs_mapping")).alias("clean"))
    a = accounts.groupBy("submission").agg(F.count("*").alias("n"), F.bool_and(F.col("named") & (F.col("status") == "CLEAN")).alias("sure"))
    both = received.join(g, "submission", "left").join(a, "submission", "left").join(found, "submission")
    ready = F.coalesce(F.col("clean") & F.col("sure") & (F.col("n") == 1) & (F.col("documents") > 0) & (F.size("blockers") == 0), F.lit(False))
    status = F.when(~F.col("intake_complete") | F.coalesce("removed", F.lit(False)), "incomplete").when(ready, "ready").otherwise("needs_review")
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("status")]
    aside = F.when((F.col("status") == "ready") & (F.col("set_aside") > 0), F.concat(F.lit(" ("), "set_aside", F.lit(" attachment(s) set aside by a reviewer)"))).otherwise("")
    return both.withColumn("status", status).select("submission", "status", F.concat(label, aside).alias("label"))
