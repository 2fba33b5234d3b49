"""Reading: file kinds by their bytes, delimited text, JSON lines, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 64 * 1024 * 1024


def sniff_kind(content: Column) -> Column:
    """pdf, xlsx or csv by the first bytes; null for the rest."""
    head = F.substring(F.hex(content), 1, 10)
    text = ~F.substring(F.hex(content), 1, 2000).rlike("^(..)*00")
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "xlsx").when((F.length(content) > 0) & text, "csv")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: name, kind, sha256, size, and why one is refused."""
    files = spark.read.format("binaryFile").load(path)
    kind = sniff_kind(F.col("content"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    refused = F.when(F.col("length") > MAX_UPLOAD, "too large").when(F.col("kind").isNull(), "unknown kind").when(F.col("suffix").isin("pdf", "xlsx", "csv") & (F.col("suffix") != F.col("kind")), "name contradicts content")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), kind.alias("kind"), suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"), "length").withColumn("refused", refused)


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose content was not processed before."""
    return files.join(done.select("sha256"), "sha256", "left_anti")


def delimiter(line: Column) -> Column:
    """The most frequent of comma, semicolon, tab and pipe; the first of equals."""
    n = F.array(*[F.regexp_count(line, F.lit(p)) for p in (",", ";", "\t", r"\|")])
    return F.element_at(F.array(*map(F.lit, [",", ";", "\t", "|"])), F.array_position(n, F.array_max(n)).cast("int"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as arrays of cells: file, line (its byte order), cells. Each file's delimiter comes from its first line with text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("text"))
    first = lines.where("trim(text) <> ''").groupBy("file").agg(F.min_by("text", "line").alias("head"))
    both = lines.join(first.select("file", delimiter(F.col("head")).alias("sep")), "file").where("trim(text) <> ''")
    pattern = F.concat(F.lit("(?:^|["), "sep", F.lit('])("(?:[^"]|"")*"|[^'), "sep", F.lit("]*)"))
    quoted = F.regexp_extract_all("text", pattern, F.lit(1))
    return both.select("file", "line", F.transform(quoted, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))).alias("cells"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that can't be read are left out."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def recording_key(*parts: Column) -> Column:
    """The key of a recorded answer."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def is_scanned(text: Column) -> Column:
    """A page with fewer than 50 readable characters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 50


def load_profiles(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Runs with the saved format of their fingerprint. The profiles are left to the planner to broadcast by their size."""
    return runs.join(profiles, "fingerprint", "left")
