"""Conventions of a document by votes of its printed tokens: unanimous, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text, identifier_shape, is_identifier, same_series


def locale_vote(c: Column) -> Column:
    """us or eu, where a number's separators can mean only one; else null."""
    t = F.regexp_replace(clean_text(c), r"[$€£()\s-]", "")
    us = t.rlike(r"^\d{1,3}(,\d{3})+\.\d+$|^\d{1,3}(,\d{3}){2,}$|^\d+\.(\d{1,2}|\d{4,})$")
    eu = t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$|^\d{1,3}(\.\d{3}){2,}$|^\d+,(\d{1,2}|\d{4,})$")
    return F.when(us, "us").when(eu, "eu")


def infer_locale(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """key, us and eu votes, locale where all votes agree, confident."""
    g = tokens.withColumn("_v", locale_vote(F.col(token))).groupBy(key).agg(F.count_if(F.col("_v") == "us").alias("us"), F.count_if(F.col("_v") == "eu").alias("eu"))
    return g.withColumn("locale", F.when((F.col("us") > 0) & (F.col("eu") == 0), "us").when((F.col("eu") > 0) & (F.col("us") == 0), "eu")).withColumn("confident", F.col("locale").isNotNull())


def infer_date_order(tokens: DataFrame, key: str, token: str, locales: DataFrame | None = None) -> DataFrame:
    """key, order (mdy or dmy) by dates that only one order explains; else by the locale; and the source of the answer."""
    a = F.regexp_extract(clean_text(F.col(token)), r"^(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}$", 1).try_cast("int")
    b = F.regexp_extract(clean_text(F.col(token)), r"^(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}$", 2).try_cast("int")
    g = tokens.select(key, a.alias("a"), b.alias("b")).groupBy(key).agg(F.count_if((F.col("a") > 12) & (F.col("b") <= 12)).alias("dmy"), F.count_if((F.col("b") > 12) & (F.col("a") <= 12)).alias("mdy"))
    own = F.when((F.col("dmy") > 0) & (F.col("mdy") == 0), "dmy").when((F.col("mdy") > 0) & (F.col("dmy") == 0), "mdy")
    g = g.withColumn("own", own)
    g = g.join(locales.select(key, "locale"), key, "left") if locales is not None else g.withColumn("locale", F.lit(None).cast("string"))
    torn = (F.col("dmy") > 0) & (F.col("mdy") > 0)
    by_locale = F.when(~torn & (F.col("locale") == "us"), "mdy").when(~torn & (F.col("locale") == "eu"), "dmy")
    return g.select(key, "dmy", "mdy", F.coalesce("own", by_locale).alias("order"), F.when(F.col("own").isNotNull(), "evidence").when(torn, "conflict").when(by_locale.isNotNull(), "locale").otherwise("none").alias("source"))


def infer_recovery_sign(claims: DataFrame, key: str) -> DataFrame:
    """Whether recoveries are printed as credits: votes of rows that tie with one sign only."""
    paid, reserve, got, incurred = (F.col(c) for c in ("paid_total", "reserve_total", "recovery_total", "incurred_total"))
    near = lambda x: F.abs(x) <= F.lit("0.01").cast("decimal(28,2)")
    less, more = near(incurred - (paid + reserve - got)), near(incurred - (paid + reserve + got))
    g = claims.where("recovery_total <> 0").groupBy(key).agg(F.count_if(less & ~more).alias("subtracts"), F.count_if(more & ~less).alias("adds"))
    return g.withColumn("credit", (F.col("adds") > 0) & (F.col("subtracts") == 0)).withColumn("confident", ((F.col("adds") > 0) != (F.col("subtracts") > 0)))


def consensus_shapes(rows: DataFrame, key: str, token: str) -> DataFrame:
    """The identifier shapes that a document accepts: those near its most frequent one, and their series. rows: key, token."""
    shapes = rows.where(is_identifier(F.col(token))).groupBy(key, identifier_shape(F.col(token)).alias("shape")).agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy(key))
    voted = shapes.withColumn("top", top).withColumn("accepted", F.col("n") >= F.least("top", F.greatest(F.lit(2), F.floor(F.col("top") * 0.25))))
    main = voted.where("accepted").select(F.col(key).alias("m_key"), F.col("shape").alias("main"))
    near = voted.where("not accepted and n >= 2").join(main, (F.col(key) == F.col("m_key")) & same_series(F.col("shape"), F.col("main"))).select(key, "shape", "n").distinct()
    return voted.where("accepted").select(key, "shape", "n").unionByName(near)
