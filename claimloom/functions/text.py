"""Text expressions: cleaning, labels, shapes, guards. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.types import FALSE_TEXTS, NOT_APPLICABLE, STATUSES, TRUE_TEXTS

#: Signs that stand for a hyphen, and wide digits and signs with their plain forms.
DASHES = "−–—‐‑‒⁃­"
WIDE = "０１２３４５６７８９．，（）＄"
PLAIN = "0123456789.,()$"


_steps: list[tuple[str, Column]] | None = None


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once however often body uses it: as a column of its own inside projected(), else as the element of an array."""
    if _steps is None:
        return F.get(F.transform(F.array(value), body), F.lit(0))
    name = f"_let{len(_steps)}"
    _steps.append((name, value))
    return body(F.col(name))


def projected(df: DataFrame, out: str, build) -> DataFrame:
    """df with the column out that build() gives; every let() in it becomes a projection, which keeps the plan compiled."""
    global _steps
    _steps = []
    try:
        result = build()
        steps = _steps
    finally:
        _steps = None
    names = df.columns
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.select(*[n for n in names if n != out], result.alias(out))


def clean_text(c: Column) -> Column:
    """Dashes as hyphens, wide forms as plain ones, white space collapsed; null becomes the empty text."""
    plain = F.translate(F.coalesce(c, F.lit("")), DASHES + WIDE, "-" * len(DASHES) + PLAIN)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def normalize_label(c: Column) -> Column:
    """Lower case, '#' as the word number, everything but letters and digits as one space."""
    low = F.regexp_replace(F.lower(clean_text(c)), "#", " number ")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{Nd}]+", " "))


def one_of(c: Column, groups: dict[str, list[str]]) -> Column:
    """The name of the group whose list holds the text, or null."""
    out = F.lit(None).cast("string")
    for name, texts in groups.items():
        out = F.when(c.isin(texts), F.lit(name)).otherwise(out)
    return out


def parse_status(c: Column) -> Column:
    """The status whose vocabulary has the label; else that of its first word, if more words follow; else UNKNOWN."""
    label = normalize_label(c)
    first = F.when(F.instr(label, " ") > 0, one_of(F.substring_index(label, " ", 1), STATUSES))
    return F.coalesce(one_of(label, STATUSES), first, F.lit("UNKNOWN"))


def parse_bool(c: Column) -> Column:
    label = normalize_label(c)
    return F.when(label.isin(TRUE_TEXTS), True).when(label.isin(FALSE_TEXTS), False)


def parse_text(c: Column) -> Column:
    """The cleaned text; null where it is blank, dashes, or says that nothing applies."""
    t = clean_text(c)
    return F.when((t != "") & ~F.upper(t).isin(NOT_APPLICABLE) & ~t.rlike("^-+$"), t)


def parse_int(c: Column) -> Column:
    """The first run of digits, thousands separators removed."""
    digits = F.regexp_replace(F.regexp_extract(clean_text(c), r"(\d[\d,]*)", 1), ",", "")
    return F.when(digits != "", digits).try_cast("bigint")


def identifier_shape(c: Column) -> Column:
    """Letters as A, digits as 9."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), r"\p{Nd}", "9")


def is_identifier(c: Column) -> Column:
    """Three characters or more with a digit, shaped neither like money nor like a date."""
    money = c.rlike(r"^[($€£-]*\d{1,3}(,\d{3})*(\.\d+)?[)-]?$") & c.rlike(r"[.,$€£()]")
    date = c.rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}$")
    return (F.length(c) >= 3) & c.rlike(r"\d") & ~money & ~date


def shape_runs(c: Column) -> Column:
    """A shape's runs of one sign."""
    return F.regexp_extract_all(c, F.lit(r"((.)\2*)"), F.lit(1))


def same_series(a: Column, b: Column) -> Column:
    """Whether two shapes have equal runs, but for runs of digits that differ in length by one at most."""
    x, y = shape_runs(a), shape_runs(b)
    near = F.zip_with(x, y, lambda p, q: (p == q) | (p.startswith("9") & q.startswith("9") & (F.abs(F.length(p) - F.length(q)) <= 1)))
    return (F.size(x) == F.size(y)) & F.forall(near, lambda z: F.coalesce(z, F.lit(False)))


def paginations(c: Column) -> Column:
    """Every 'page k of n' with 1 <= k <= n, as an array of (k, n)."""
    pattern = r"(?i)page\s+(\d{1,6})\s+of\s+(\d{1,6})"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("n"))
    typed = F.transform(pairs, lambda p: F.struct(p["k"].cast("int").alias("k"), p["n"].cast("int").alias("n")))
    return F.filter(typed, lambda p: (p["k"] >= 1) & (p["k"] <= p["n"]))


def needs_quote(c: Column) -> Column:
    """Whether a spreadsheet would read the text as a formula."""
    return F.coalesce(c.rlike(r"^[\t\r\n]|^[ \t\r\n]*[=+@-]"), F.lit(False))


def without_controls(c: Column) -> Column:
    """Signs that XML forbids as U+FFFD."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�")


def safe_name(c: Column) -> Column:
    """A file name without paths or odd signs."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(base, r"[^A-Za-z0-9._ -]", "_")), F.lit("")), F.lit("unnamed"))


def fingerprint(carrier: Column, headers: Column, labels: Column) -> Column:
    """The format's key: 32 hex digits over carrier, headers and sorted labels."""
    text = F.concat_ws("\n", F.coalesce(normalize_label(carrier), F.lit("")), F.concat_ws("\n", F.transform(headers, normalize_label)), F.concat_ws("\n", F.sort_array(labels)))
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32)


def line_of_business(c: Column) -> Column:
    """A line's name by the words that it holds, in this order; else OTHER; null stays null."""
    label = normalize_label(c)
    out = F.lit("OTHER")
    for word, line in reversed(LINES):
        out = F.when(F.concat(F.lit(" "), label, F.lit(" ")).contains(f" {word} "), line).otherwise(out)
    return F.when(label != "", out)


#: Words and lines of business.
LINES = [("workers", "WORKERS_COMP"), ("wc", "WORKERS_COMP"), ("auto", "AUTO"), ("automobile", "AUTO"), ("property", "PROPERTY"), ("umbrella", "UMBRELLA"), ("excess", "UMBRELLA"), ("liability", "GENERAL_LIABILITY"), ("gl", "GENERAL_LIABILITY")]
