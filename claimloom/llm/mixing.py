"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash of their id, so a source of any
size has a bounded number of blocks and no source is gathered anywhere. A source's target
is its whole size a number of times and a part of it: the blocks of the part are the
first ones of the source's permuted blocks. The block at which the target lies is
cut again by further digits of the same permutation, until what remains is one
document or nothing, so the words taken differ from the target by less than about one
document. These draws are exact quotas: the tree splits each source's number of draws
between the two halves of the output shards by a multivariate hypergeometric draw, and
so on down to single shards, which take disjoint runs of the source's permuted
draws. The number of shards, and with it the depth of the tree and the number of blocks, follows from the words that
are taken; a shard that would still be too large for a task is split further by a hash. Within a shard, rows are ordered by a hash.

All randomness comes from the seed and from ids, so reruns agree.

Cases: a null text has size 0. A null source is a source of its own and comes
last. Rows equal in id and source share their fate. Documents without words and
sources without words have nothing to take. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, small_batches, worker, written
from claimloom.llm.kernel import PLAIN, slices, spans

#: Words that a shard should take, the least and most shards of a tree, and blocks of a source for each shard (BLOCKS at least).
SHARD_WORDS = 1 << 22
LEAST_SHARDS, MOST_SHARDS = 8, 4096
BLOCKS, SHARD_BLOCKS = 512, 8
LEVELS = 4
SEED = 20240917
#: A table on the driver with more rows than this is joined by a shuffle.
BROADCAST_ROWS = 200_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size: the words of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = [np.diff(spans(data, offs, PLAIN)[2]) for _, _, data, offs in slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], names=["doc_id", "source", "size"])

    return rows.mapInArrow(worker(run), f"doc_id {kind}, source string, size long")


def targets(size: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """The words that each source should give: shares by weight of share times all words, none above most times its own."""
    open_, out = set(range(len(size))), [0.0] * len(size)
    left = share * sum(size)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / total > most * size[i]]
        if not full:
            for i in sorted(open_):
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * size[i]
            open_.discard(i)
        left = share * sum(size) - sum(out[i] for i in range(len(size)) if i not in open_)
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard; columns add up to the quotas."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1 or not q.sum():
            out[lo] += q
            return
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, n, method="marginals")
        split(lo, mid, left)
        split(mid, hi, q - left)

    if quotas:
        split(0, shards, np.array(quotas, np.int64))
    return out


def _digit(level: int, blocks: int):
    """A document's block at one level: an independent hash of its id."""
    return F.pmod(F.xxhash64(F.lit(SEED + level), F.col("doc_id").cast("string")), F.lit(blocks)).cast("int")


def _path(level: int, blocks: int):
    """The blocks above a level, from the first."""
    return F.concat_ws("/", *[_digit(j, blocks).cast("string") for j in range(level)]) if level else F.lit("")


@dataclass
class Plan:
    """What a mix takes: a row for each source (source, source_number, source_size, target), a row for each draw of a block
    (source_number, level, path, block, epoch, shard; path is the blocks above it), and the numbers of blocks, shards and splits of a shard."""

    sources: pd.DataFrame
    draws: pd.DataFrame
    blocks: int
    shards: int
    splits: int


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast where its counted rows are few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _order(source: int, level: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, source, level]).permutation(n)


def plan(sized: DataFrame, weights: list[float], share: float, most: float) -> Plan:
    """What the mix takes. sized: a table of doc_id, source, size.

    Sources and their blocks are all that reaches the driver: at most max(BLOCKS, SHARD_BLOCKS * MOST_SHARDS) rows a source and level.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [int(r["n"]) for r in found]
    goal = targets([float(s) for s in size], [weights[i % len(weights)] for i in range(len(size))], share, most)
    sources = pd.DataFrame({"source": [r["source"] for r in found], "source_number": np.arange(len(found), dtype=np.int32), "source_size": size, "target": goal})

    wanted = max(1, int(sum(goal)) // SHARD_WORDS)
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, 1 << (wanted - 1).bit_length()))
    splits, n_blocks = max(1, -(-wanted // shards)), max(BLOCKS, SHARD_BLOCKS * shards)

    draws: list[tuple[int, int, str, int, int]] = []
    whole = [min(int(t // s) if s else 0, int(most)) for t, s in zip(goal, size, strict=True)]
    edge = {k: ("", t - w * s) for k, (t, w, s) in enumerate(zip(goal, whole, size, strict=True)) if s}
    for level in range(LEVELS):
        if not edge:
            break
        inside = sized.where("size > 0")
        if level:
            edges = sized.sparkSession.createDataFrame([(found[k]["source"], p) for k, (p, _) in edge.items()], "e_source string, e_path string")
            inside = inside.withColumn("path", _path(level, n_blocks)).join(bounded(edges, len(edge)), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("path") == F.col("e_path")), "left_semi")
        blocks: dict[str | None, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy("source", _digit(level, n_blocks).alias("block")).agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect():
            blocks.setdefault(r["source"], {})[r["block"]] = (int(r["n"]), int(r["docs"]))
        after: dict[int, tuple[str, float]] = {}
        for k, (p, left) in edge.items():
            own = blocks.get(found[k]["source"], {})
            if not level:
                draws += [(k, 0, "", b, e) for e in range(whole[k]) for b in sorted(own)]
            order = [b for b in _order(k, level, n_blocks).tolist() if b in own]
            for i, b in enumerate(order):
                n, docs = own[b]
                if n <= left:
                    draws.append((k, level, p, b, whole[k]))
                    left -= n
                elif docs > 1 and level + 1 < LEVELS:
                    after[k] = (f"{p}/{b}" if p else str(b), left)
                    break
                else:  # the target lies in one document: of those still to come, the one that ends nearest to it
                    best = min(order[i:], key=lambda x: abs(own[x][0] - left))
                    if abs(own[best][0] - left) < left:
                        draws.append((k, level, p, best, whole[k]))
                    break
        edge = after
    table = pd.DataFrame(draws, columns=["source_number", "level", "path", "block", "epoch"])
    at = table.groupby("source_number").indices
    none = np.zeros(0, np.int64)
    tree = splitting_tree([len(at.get(k, none)) for k in range(len(size))], shards, SEED)
    shard = np.zeros(len(table), np.int64)
    for k, own in at.items():
        order = np.random.default_rng([SEED, k, 99]).permutation(len(own))
        shard[own[order]] = np.repeat(np.arange(shards), tree[:, k])
    table["shard"] = shard
    return Plan(sources, table, n_blocks, shards, splits)


def placed(rows: DataFrame, found: Plan) -> DataFrame:
    """rows (doc_id, source, has_words and others) with source_size, target and draws, an array of (copy, shard, place).

    Each document finds the draws of its blocks by their paths, so only the tables of sources and draws meet the rows,
    and are broadcast only where they are small.
    """
    spark, sources, table = rows.sparkSession, found.sources, found.draws
    names = rows.columns
    known = spark.createDataFrame([(r.source, int(r.source_number), int(r.source_size), float(r.target)) for r in sources.itertuples()], "k_source string, number int, source_size long, target double")
    rows = rows.join(bounded(known, len(sources)), F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source")
    deep = int(table["level"].max()) + 1 if len(table) else 1
    drawn: dict[tuple[int, str, int], list[tuple[int, int]]] = {}
    for r in table.itertuples():
        drawn.setdefault((r.source_number, r.path, r.block), []).append((int(r.epoch), int(r.shard)))
    for level in range(deep):
        here = [(int(k), p, int(b), d) for (k, p, b), d in drawn.items() if p.count("/") + bool(p) == level]
        blocks = spark.createDataFrame(here, f"b_number int, b_path string, b_block int, d{level} array<struct<copy:int,shard:int>>")
        on = (F.col("number") == F.col("b_number")) & (_path(level, found.blocks) == F.col("b_path")) & (_digit(level, found.blocks) == F.col("b_block")) & F.col("has_words")
        rows = rows.join(bounded(blocks, len(here)), on, "left").drop("b_number", "b_path", "b_block")
    none = F.expr("cast(array() as array<struct<copy:int,shard:int>>)")
    draws = F.concat(*[F.coalesce(F.col(f"d{level}"), none) for level in range(deep)])
    place = F.transform(draws, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(F.lit(SEED), d["shard"], d["copy"], F.col("doc_id").cast("string")).alias("place")))
    return rows.select(*names, "source_size", "target", place.alias("draws"))


def mix(docs: DataFrame, weights: list[float], share: float, most: float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target and draws, an array of (copy, shard, place).

    A draw is one copy of the document in one output shard; a shard's copies stand in the order of place.
    """
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    return placed(sized.withColumn("has_words", F.col("size") > 0), plan(sized, weights, share, most)).drop("has_words")


def sharded(docs: DataFrame, weights: list[float], share: float, most: float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, that the mix takes, each copy once: one partition for a shard, or for each of its splits, shuffled within it."""
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    word = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word.alias("has_words"))
    found = plan(sized, weights, share, most)
    discard(sized)
    copies = placed(rows, found).select("row", F.explode("draws").alias("d"))
    part = (F.col("d.shard") * found.splits + F.pmod("d.place", F.lit(found.splits))).cast("int")
    return copies.repartitionById(found.shards * found.splits, part).sortWithinPartitions("d.place").select("row.*")


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words that the mix takes of each document, repeats counted) and shards, the shard of each copy, ascending."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.sort_array("draws.shard").alias("shards"))
