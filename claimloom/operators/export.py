"""Output: projections, redaction, and text that a spreadsheet can't run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import needs_quote, without_controls

#: Named projections and the fields that redaction drops.
TEMPLATES = {
    "standard": ["document_id", "claim_number", "claim_status", "date_of_loss", "paid_total", "reserve_total", "recovery_total", "incurred_total"],
    "bordereau": ["claim_number", "date_of_loss", "date_reported", "claim_status", "incurred_total"],
    "financial": ["claim_number", "paid_total", "reserve_total", "recovery_total", "incurred_total"],
    "compact": ["claim_number", "claim_status", "incurred_total"],
}
REDACTED = ["claimant_name", "loss_description"]


def project(df: DataFrame, template: str | list[str], redact: bool = False, provenance: tuple[str, ...] = ()) -> DataFrame:
    cols = TEMPLATES[template] if isinstance(template, str) else template
    return df.select(*[c for c in cols if not (redact and c in REDACTED)], *provenance)


def safe_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Texts without control signs, with a quote before what would be a formula."""
    clean = {c: without_controls(F.col(c)) for c in cols}
    return df.withColumns({c: F.when(needs_quote(x), F.concat(F.lit("'"), x)).otherwise(x) for c, x in clean.items()})


def worst_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    """ERROR where any finding of the key is one, else WARN, else INFO. findings: or their tally."""
    rank = F.min(F.array_position(F.array(F.lit("ERROR"), F.lit("WARN"), F.lit("INFO")), F.col("severity")))
    return findings.groupBy(*keys).agg(F.element_at(F.array(F.lit("ERROR"), F.lit("WARN"), F.lit("INFO")), rank.cast("int")).alias("severity"))


def redact(texts: DataFrame, secrets: DataFrame, key: str, text: str, mark: str = "[redacted]") -> DataFrame:
    """text with every secret of its key replaced, the longest first, in any case; and name parts of three letters or more. secrets: key, value."""
    parts = secrets.where("value is not null").select(key, F.explode(F.concat(F.array(F.trim("value")), F.filter(F.split("value", r"[^\p{L}]+"), lambda w: F.length(w) >= 3))).alias("v")).where("v <> ''").distinct()
    pattern = parts.groupBy(key).agg(F.expr(r"concat('(?i)(?<!\\p{L})(?:', listagg(concat('\\Q', replace(v, '\\E', ''), '\\E'), '|') within group (order by length(v) desc, v), ')(?!\\p{L})')").alias("_p"))
    return texts.join(pattern, key, "left").withColumn(text, F.when(F.col("_p").isNull(), F.col(text)).otherwise(F.regexp_replace(F.col(text), F.col("_p"), F.lit(mark)))).drop("_p")


def documents_json(docs: DataFrame, claims: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested JSON text a document."""
    c = claims.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "claim_number", "incurred_total"))).alias("claims"))
    f = findings.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rule", "severity", "subject"))).alias("findings"))
    return docs.join(c, "document_id", "left").join(f, "document_id", "left").select("document_id", F.to_json(F.struct("document_id", "insured", "valuation_date", "claims", "findings")).alias("json"))
