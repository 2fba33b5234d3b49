"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The texts are read twice. The first scan takes lengths and prefix hashes, which group the rows by length and, within
a length, by prefix. The second takes the full hash of rows whose group has two or more. The surviving keys meet the rows
of the second scan as a counted bitmap, or by a shuffle of key hashes where they are too many for one
(common.flagged), so texts are never shuffled; collisions only let a row through to the full hash. What
the second scan finds is written as a narrow table, from which all else follows. Only lengths, hashes and
ids are shuffled, with partial aggregation, so a huge group costs one row a task.

Cases: a null text is the empty text. A null id never wins against another id; a
group of null ids has a null keep_id and keeps each of its rows. Rows equal in id
and text are the same document: all carry the same marks. An empty table gives an
empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import flagged, written

#: Characters that the second level hashes.
PREFIX_CHARS = 256
#: Parts of a group of copies, when its rows meet its result.
SALTS = 16


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept; with hash_all also text_sha256 of every row.

    Of equal texts the row with the largest id stays.
    """
    return _marked(docs, id_col, text_col, hash_all).select("doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if hash_all else []))


def _marked(docs: DataFrame, id_col: str, text_col: str, hash_all: bool) -> DataFrame:
    """exact_duplicates with the text's length n and its text_sha256; without hash_all the latter only where the prefix has a like."""
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("n", F.octet_length("t")).withColumn("p", F.xxhash64(F.substring("t", 1, PREFIX_CHARS)))
    prefixes = rows.groupBy("n", "p").count().where("count > 1")
    by_prefix = flagged(rows, F.xxhash64("n", "p"), prefixes, F.xxhash64("n", "p"), "same_prefix")

    full = F.sha2(F.encode("t", "UTF-8"), 256)
    hashed = written(by_prefix.select("i", "n", "same_prefix", (full if hash_all else F.when(F.col("same_prefix"), full)).alias("h")), "hashes")
    survivors = hashed.where("same_prefix")
    groups = (
        survivors.groupBy("n", "h")
        .agg(F.max("i").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    # A huge group's rows meet its one result row in SALTS tasks.
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = survivors.withColumn("salt", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(SALTS)).cast("int"))
    same = dealt.join(salted, ["n", "h", "salt"], "left").select(
        F.col("i").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("i")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "n",
        F.col("h").alias("text_sha256"),
    )
    alone = hashed.where("not same_prefix").select(F.col("i").alias("doc_id"), F.col("i").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "n", F.col("h").alias("text_sha256"))
    return alone.unionByName(same).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one for each text: that with the largest id; of rows equal in id and text, one.

    A row is known by its id and its text, so null and repeated ids have a verdict for each text. Only rows whose id and
    length occur in a group of copies are shuffled, and rows equal in id and text meet their verdict as one.
    """
    same = _marked(docs, id_col, text_col, False).where("group_size > 1").select("doc_id", F.col("n").alias("m"), F.col("text_sha256").alias("g"), "kept").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.octet_length(text).alias("n"), text.alias("t"))
    own = flagged(rows, F.xxhash64(F.col("i").cast("string"), "n"), same, F.xxhash64(F.col("doc_id").cast("string"), "m"), "copy")
    single = own.where("copy").select("row", "i", "n", F.sha2(F.encode("t", "UTF-8"), 256).alias("h")).dropDuplicates(["i", "n", "h"])
    copies = single.join(same, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("m")) & (F.col("h") == F.col("g")), "left").where("coalesce(kept, true)")
    return own.where("not copy").select("row.*").unionByName(copies.select("row.*"))
