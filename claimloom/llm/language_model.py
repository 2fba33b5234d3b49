"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read from sorted hash arrays.

Counting. A task counts the word pairs of its texts and deals them, as blocks of
arrays, by ranges of the first word's hash and by SPLIT classes of the second's, so that
the followers of one very frequent word are spread over SPLIT partitions. Each partition
adds up its pairs, writes them as a file of sorted pair hashes and counts, and passes on, for
each first word, its total and how many followers occur once, twice and more often, and,
for each second word, how many different words it follows. A second exchange, by
ranges of the word's hash, adds these up into files of sorted word hashes.

Scoring. Workers map the files into memory and look up all distinct words and all
pairs of a slice of texts at once, in sorted order, so a worker's memory depends on the
slice and not on the model.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + gamma(v) * p(w)
    p(w)     = max(n(w) - D'(n(w)), 0) / n + gamma' / (V + 1)

where n(w) is the number of different words before w and n their sum, D and D' follow
from the counts of counts, and gamma returns what the discounts take. A word that no
training text has gets gamma' / (V + 1). All words of all training texts count.

Cases: a null text is the empty text: one end token. A null id is learned from. Repeated
rows count repeatedly. With no training text at all every token has the same
probability. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fresh_path, kept, partitions_for, settings, small_batches, worker
from claimloom.llm.kernel import LOWER, PLAIN, mix, owners, prefix_sums, slices, span_hashes, spans
from claimloom.llm.shared_files import map_arrays, write_arrays

U = np.uint64
#: Hashes of the token that ends a text and of the context that begins one.
END, BEGIN = U(0x0E0D0E0D0E0D0E0D), U(0x0B0E0B0E0B0E0B0E)
SPLIT = 8
#: Pairs that a task holds before it counts them.
HELD = 3_000_000
SLICE = 2 << 20

PAIR_KINDS = ["<u8", "<u4"]
WORD_KINDS = ["<u8", "<u8", "<u4", "<u4", "<u4", "<u4"]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the token before each, and each text's bounds in them."""
    low = LOWER[data]
    starts, ends, bounds = spans(low, offs, PLAIN)
    n = len(offs) - 1
    bounds_all = bounds + np.arange(n + 1)
    tok = np.full(len(starts) + n, END, np.uint64)
    tok[np.arange(len(starts)) + owners(bounds)] = span_hashes(prefix_sums(low), starts, ends)
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[bounds_all[:-1]] = BEGIN
    return tok, before, bounds_all


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def pair_part(v: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a pair: ranges of v, and classes of w that lie far apart."""
    return (range_of(v, parts) + (w % U(SPLIT)).astype(np.int64) * -(-parts // SPLIT)) % parts


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9E3779B97F4A7C15) + w)


def _totals(keys: tuple[np.ndarray, ...], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in ascending order, the first key foremost, and the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Small numbers compressed; hashes, which don't compress, as they are."""
    parts = []
    for a in arrays:
        raw = a.tobytes()
        parts.append(raw if a.dtype == np.uint64 else zlib.compress(raw, 1))
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<i8", len(kinds)).tolist()
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        raw = blob[at : at + n]
        out.append(np.frombuffer(raw if kind == np.uint64 else zlib.decompress(raw), kind))
        at += n
    return out


def _dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The slices of an ascending array of partitions."""
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, slice(int(cut[p]), int(cut[p + 1]))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "blob"])


SCHEMA = "part int, kind int, blob binary"
PAIRS, CONTEXTS, FOLLOWERS, COUNTS = range(4)


def _count_pairs(parts: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        p = pair_part(v, w, parts).astype(np.uint64)
        (p, v, w), (c,) = _totals((p, v, w), [np.ones(len(v), np.uint32)])
        for part, s in _dealt(p.astype(np.int64), parts):
            first = np.ones(s.stop - s.start, bool)
            first[1:] = v[s][1:] != v[s][:-1]
            at = np.flatnonzero(first)
            yield _rows([(part, PAIRS, _pack([v[s][at], np.diff(np.append(at, len(first))).astype(np.uint32), w[s], c[s].astype(np.uint32)]))])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, offs in slices(b.column(0), SLICE):
                tok, before, _ = tokens(data, offs)
                held.append((before, tok))
                n += len(tok)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _add_pairs(parts: int, path: str):
    def run(batches):
        me, blobs = TaskContext.get().partitionId(), []
        for b in batches:
            blobs += [_unpack(x, [np.uint64, np.uint32, np.uint64, np.uint32]) for x in b.column(2).to_pylist()]
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        v = join([np.repeat(x[0], x[1]) for x in blobs], np.uint64)
        w, c = join([x[2] for x in blobs], np.uint64), join([x[3] for x in blobs], np.uint32)
        del blobs
        (v, w), (c,) = _totals((v, w), [c])
        g = pair_hash(v, w)
        order = np.argsort(g)
        write_arrays(f"{path}/pairs-{me}", [g[order], c[order].astype(np.uint32)])
        del g, order
        yield _rows([(0, COUNTS, _pack([np.array([len(c), *((c == i).sum() for i in (1, 2, 3, 4))], np.uint32)]))])
        if not len(v):
            return
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(new)
        add = lambda x: np.add.reduceat(x, at).astype(np.uint32)
        context = [v[at], np.add.reduceat(c.astype(np.uint64), at).astype(np.int64), add(c == 1), add(c == 2), add(c > 2)]
        for part, s in _dealt(range_of(context[0], parts), parts):
            yield _rows([(part, CONTEXTS, _pack([x[s] for x in context]))])
        word, n = np.unique(w, return_counts=True)
        for part, s in _dealt(range_of(word, parts), parts):
            yield _rows([(part, FOLLOWERS, _pack([word[s], n[s].astype(np.uint32)]))])

    return run


def _add_words(path: str):
    def run(batches):
        me, contexts, followers, stats = TaskContext.get().partitionId(), [], [], np.zeros(5, np.int64)
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == CONTEXTS:
                    contexts.append(_unpack(blob, [np.uint64, np.int64, np.uint32, np.uint32, np.uint32]))
                elif kind == FOLLOWERS:
                    followers.append(_unpack(blob, [np.uint64, np.uint32]))
                else:
                    stats += _unpack(blob, [np.uint32])[0].astype(np.int64)
        h = [x[0] for x in contexts] + [x[0] for x in followers]
        zero = [np.zeros(len(x[0]), np.int64) for x in followers]
        cols = [np.concatenate([np.zeros(0, np.int64), *(x[i].astype(np.int64) for x in contexts), *zero]) for i in range(1, 5)]
        cols.append(np.concatenate([np.zeros(0, np.int64), *(np.zeros(len(x[0]), np.int64) for x in contexts), *(x[1].astype(np.int64) for x in followers)]))
        (word,), (c, n1, n2, n3, cont) = _totals((np.concatenate([np.zeros(0, np.uint64), *h]),), cols)
        write_arrays(f"{path}/words-{me}", [word, c.astype("<u8"), *(x.astype("<u4") for x in (n1, n2, n3, cont))])
        begin = int(c[word == BEGIN].sum())
        is_word = word != BEGIN
        out = [*stats.tolist(), int(c.sum()) - begin, begin, int((is_word & (word != END)).sum()), *(int((cont[is_word] == i).sum()) for i in (1, 2, 3, 4)), int((cont[is_word] > 2).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.int64()))], names=["stats"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The discounts of counts of one, two and more; halves where too few counts exist to estimate them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


class Model:
    """A trained model: where its files are and its few numbers. Workers map the files at their first use."""

    def __init__(self, path: str, parts: int, stats: list[int]):
        self.path, self.parts = path, parts
        pairs, p1, p2, p3, p4, words, texts, types, c1, c2, c3, c4, c_more = stats
        self.pairs, self.n, self.texts = pairs, words + texts, texts
        self.v = types + (1 if texts else 0)
        self.d = (0.0, *discounts(p1, p2, p3, p4))
        self.e = (0.0, *discounts(c1, c2, c3, c4))
        taken = self.e[1] * c1 + self.e[2] * c2 + self.e[3] * c_more
        self.rest = taken / pairs if pairs else 1.0

    def _files(self):
        return kept("language_model", self.path, lambda: [[map_arrays(f"{self.path}/{kind}-{i}", kinds) for i in range(self.parts)] for kind, kinds in (("words", WORD_KINDS), ("pairs", PAIR_KINDS))])

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """Of each of the ascending hashes: count, followers of count one, two and more, number of different words before."""
        files = self._files()[0]
        out = [np.zeros(len(h), np.int64) for _ in range(5)]
        for p, s in _dealt(range_of(h, self.parts), self.parts):
            keys, *cols = files[p]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[s]), len(keys) - 1)
                hit = keys[at] == h[s]
                for o, c in zip(out, cols, strict=True):
                    o[s] = np.where(hit, c[at], 0)
        out[0][h == END] = self.texts
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        files = self._files()[1]
        p, g = pair_part(v, w, self.parts), pair_hash(v, w)
        order = np.lexsort((g, p))
        p, g = p[order], g[order]
        found = np.zeros(len(g), np.int64)
        for k, s in _dealt(p, self.parts):
            keys, counts = files[k]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, g[s]), len(keys) - 1)
                found[s] = np.where(keys[at] == g[s], counts[at], 0)
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, model score."""
        tok, before, bounds = tokens(data, offs)
        h, back = np.unique(np.concatenate([tok, np.array([BEGIN])]), return_inverse=True)
        c, n1, n2, n3, cont = self.words(h)
        d, e = np.array(self.d), np.array(self.e)
        base = np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))
        lower = np.maximum(cont - e[np.minimum(cont, 3)], 0) / max(self.pairs, 1) + self.rest / (self.v + 1)
        total = np.maximum(c, 1)
        gamma = np.where(n1 + n2 + n3 > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)
        now = back[:-1]
        prior = np.empty_like(now)
        prior[1:] = now[:-1]
        prior[bounds[:-1]] = back[-1]
        pair = self.pair_counts(before, tok)
        p = np.maximum(pair - d[np.minimum(pair, 3)], 0) / total[prior] + gamma[prior] * lower[now]
        sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(bounds) > 1 else x[:0]
        return np.diff(bounds), sums((c > 0)[now].astype(np.int64)), sums(base[now]), sums(np.log10(p))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from every whole text of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    parts, path = partitions_for(docs), fresh_path(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("t"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="64"):  # blocks are large
        pairs = texts.mapInArrow(worker(_count_pairs(parts)), SCHEMA).repartitionById(parts, F.col("part"))
        words = pairs.mapInArrow(worker(_add_pairs(parts, path)), SCHEMA).repartitionById(parts, F.col("part"))
        stats = words.mapInArrow(worker(_add_words(path)), "stats array<long>").collect()
    return Model(path, parts, [sum(x) for x in zip(*(r["stats"] for r in stats), strict=True)])


def score(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns (named by their aliases) with n_tokens, n_known, base_score, score and perplexity of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("scored_text"))
    names = rows.columns[:-1]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in slices(b.column(len(names)), SLICE):
                n, known, base, own = model.score(data, offs)
                kept = [c.slice(lo, hi - lo) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(known), pa.array(base), pa.array(own), pa.array(np.power(10.0, np.minimum(-own / n, 300)))], names=[*names, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return rows.mapInArrow(worker(run, "language_model"), ", ".join([*kinds, "n_tokens long, n_known long, base_score double, score double, perplexity double"]))
