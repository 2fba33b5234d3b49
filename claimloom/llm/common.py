"""Helpers shared by the corpus operators: reading tables, shared folders, fixed-size bitmaps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker; kernels cut them further by bytes.
ARROW_ROWS = 1000
#: Rows of one where a plan holds several workers' batches at once, or what a worker makes of a batch takes many times its bytes.
FEW_ROWS = 250
#: Bytes of one Arrow batch; a row that is larger makes a batch of its own.
ARROW_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, so that whole texts fit a worker's memory. Plans read the settings when they run, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES * rows // ARROW_ROWS))


#: Bytes of a table's estimated size that one partition of its blobs takes.
PART_BYTES = 64 << 20
#: An estimate of as many bytes says that the planner knows nothing.
UNKNOWN = 1 << 60


def partitions_for(df: DataFrame) -> int:
    """Partitions for what a worker gathers from df: the session's number, or more where the planner's estimate of df's size, if it has one, asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size >= UNKNOWN else max(own, -(-size // PART_BYTES))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as __) for what runs inside; the former ones hold again afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_kept: dict[str, tuple[object, object]] = {}


def kept(operator: str, key: object, build: Callable[[], object]) -> object:
    """What an operator keeps in a worker process between tasks: one value, built anew for another key."""
    if operator not in _kept or _kept[operator][0] != key:
        _kept.pop(operator, None)
        _kept[operator] = (key, build())
    return _kept[operator][1]


class Remembered(dict):
    """Ids by text, emptied when they have come to take a number of bytes; an entry counts ENTRY besides its text and ids."""

    ENTRY = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.taken = most, 0

    def learn(self, found) -> None:
        new = dict(found)
        self.update(new)
        self.taken += self.ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))

    def shed(self) -> None:
        if self.taken > self.most:
            self.clear()
            self.taken = 0


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker(run: Callable, operator: str = "") -> Callable:
    """run for mapInArrow, where a worker process first drops what other operators keep in it, and afterwards gives freed memory back."""

    def tidy(batches):
        others = [k for k in _kept if k != operator]
        for k in others:
            del _kept[k]
        if others:
            release()
        yield from run(batches)
        release()

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by written() that no later plan reads."""
    for df in frames:
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for root in roots:
            if "/claimloom/" in root:
                remove(df.sparkSession, root)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


#: Bits that a bitmap has for each key that it holds, and the most bits of one that rows are joined to (a million rows).
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def bits_for(keys: int, most: int) -> int:
    """The bits of a bitmap for a number of keys: a power of two, 4,096 at least."""
    return min(most, 1 << max(12, (max(1, keys) * BITS_A_KEY - 1).bit_length()))


def flagged(df: DataFrame, key_hash: Column, keys: DataFrame, their_hash: Column, flag: str, most_bits: int | None = None) -> DataFrame:
    """df with a boolean column flag: whether the key hash may be among those of keys (no false negatives).

    The hashes of keys are written and counted. Up to most_bits / BITS_A_KEY of them become a bitmap of a size that fits
    their number, which is broadcast; more than that meet df by a shuffle of its key hashes, and flags are exact.
    """
    names, most = df.columns, MOST_BITS if most_bits is None else most_bits
    held = written(keys.select(their_hash.alias("fl_key")).distinct(), "keys")
    n = held.count()
    if n * BITS_A_KEY > most:
        got = df.withColumn("fl_own", key_hash).join(held.withColumn("fl_met", F.lit(True)), F.col("fl_own") == F.col("fl_key"), "left")
        return got.select(*names, F.coalesce("fl_met", F.lit(False)).alias(flag))
    bits = bits_for(n, most)
    words = held.select(F.pmod("fl_key", F.lit(bits)).alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("fl_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("fl_bits"))
    got = df.withColumn("fl_bit", F.pmod(key_hash, F.lit(bits))).join(F.broadcast(words), F.expr("shiftright(fl_bit, 6) = fl_word"), "left")
    return got.select(*names, F.expr("coalesce((shiftright(fl_bits, cast(fl_bit & 63 as int)) & 1) = 1, false)").alias(flag))


#: The most bits of a bitmap that workers receive: sixteen megabytes.
WORKER_BITS = 1 << 27


def worker_bitmap(hashes: DataFrame, column: str):
    """A broadcast array with one bit set for each 64-bit hash in a column, of a size that fits their number.

    Beyond WORKER_BITS / BITS_A_KEY hashes it fills up, so it may only spare work, never decide a result.
    """
    bits = bits_for(hashes.count(), WORKER_BITS)
    bit = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word"))
    got = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set: true for every hash that was put in, and by chance for a few others."""
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
