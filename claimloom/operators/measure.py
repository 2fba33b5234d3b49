"""Measurement: event rates, accuracy, scores and differences between revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.rules import number


def latest(events: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key."""
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order]))).where("_k = 1").drop("_k")


def rates(events: DataFrame, group: str, tests: dict) -> DataFrame:
    """Rates of tests (name -> boolean column) over all rows and by group, in one pass; the group null is all of them."""
    g = events.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("n"), *[F.count_if(t).alias(f"_{n}") for n, t in tests.items()])
    return g.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(group)).alias(group), "n", *[F.bround(F.col(f"_{n}") / F.col("n"), 4).alias(n) for n in tests])


def counters(findings: DataFrame) -> DataFrame:
    """Findings counted by rule, and by rule with severity, category and scope, in one pass over grouping sets. findings: or their tally."""
    sets = [["rule"], ["rule", "severity"], ["rule", "category"], ["rule", "scope"]]
    cols = ["rule", "severity", "category", "scope"]
    return findings.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(number(findings).alias("n"))


def null_counts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])


def digest(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One hash a key over its rows in any order."""
    return df.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.to_json(F.struct(*cols))))), 256).alias("digest"))


def accuracy(expected: DataFrame, found: DataFrame, keys: list[str], fields: list[str], group: str) -> DataFrame:
    """Fields right, wrong, missing and nulls read as zero, by group and over all. The first of repeated keys counts; order is a column named ord."""

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_k = 1")

    e = first(expected).select(*keys, F.col(group).alias("_group"), *[F.col(f).alias(f"e_{f}") for f in fields])
    x = first(found).select(*keys, *[F.col(f).alias(f"x_{f}") for f in fields], F.lit(True).alias("_found"))
    both = e.join(x, keys, "left")
    one = lambda f: F.struct(F.col(f"e_{f}").eqNullSafe(F.col(f"x_{f}")).alias("same"), (F.col(f"e_{f}").isNull() & (F.col(f"x_{f}") == 0)).alias("zero"))
    rows = both.select("_group", F.col("_found").isNull().alias("lost"), F.explode(F.array(*[one(f) for f in fields])).alias("f"))
    g = rows.rollup("_group").agg(F.grouping("_group").alias("_all"), F.count("*").alias("fields"), F.count_if(F.col("f.same") & ~F.col("lost")).alias("right"), F.count_if(F.col("lost")).alias("missing"), F.count_if(F.coalesce("f.zero", F.lit(False))).alias("null_as_zero"))
    return g.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_group")).alias(group), "fields", "right", "missing", "null_as_zero")


def regressions(now: DataFrame, baseline: DataFrame, key: str, metric: str) -> DataFrame:
    """Keys that are gone or lie below the baseline by more than a billionth."""
    b = baseline.select(key, F.col(metric).alias("was"))
    return b.join(now.select(key, F.col(metric).alias("is")), key, "left").where("is is null or is < was - 1e-9")


def revision_diff(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Paths (document_id, path, value as JSON text) that changed, each with whether it is allowed. allowed: document_id, path."""
    a, b = before.withColumnRenamed("value", "old"), after.withColumnRenamed("value", "new")
    change = a.join(b, ["document_id", "path"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    if allowed is None:
        return change.withColumn("allowed", F.lit(False))
    return change.join(allowed.select("document_id", "path").distinct().withColumn("allowed", F.lit(True)), ["document_id", "path"], "left").fillna(False, ["allowed"])


def flattened(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows as (document_id, path, value as JSON text)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("path"), F.to_json(F.struct(F.col(f).alias("v"))).alias("value")) for f in fields]))
    return df.select(F.col(key).alias("document_id"), each.alias("x")).select("document_id", "x.path", "x.value")


def score(truth: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Precision and recall of found rows, matched one to one by keys; null where nothing can be measured."""

    def numbered(df: DataFrame, flag: str) -> DataFrame:
        return df.select(group, *keys, F.row_number().over(Window.partitionBy(group, *keys).orderBy("ord")).alias("_i"), F.lit(1).alias(flag))

    both = numbered(truth, "_t").join(numbered(found, "_f"), [group, *keys, "_i"], "full")
    g = both.groupBy(group).agg(F.count("_t").alias("expected"), F.count("_f").alias("extracted"), F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("matched"))
    return g.select("*", F.try_divide("matched", "extracted").alias("precision"), F.try_divide("matched", "expected").alias("recall"))


def document_recall(expected: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """min(extracted, expected) / expected of each document."""
    both = expected.groupBy(key).agg(F.count("*").alias("expected")).join(extracted.groupBy(key).agg(F.count("*").alias("extracted")), key, "left").fillna(0, ["extracted"])
    return both.withColumn("recall", F.least("expected", "extracted") / F.col("expected"))
