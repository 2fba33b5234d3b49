"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf holds the rank of the pair that begins at its position, an inner node the
least (rank, position) below it, so the root names the leftmost least pair. A merge
updates three leaves (the merged pair, its live left neighbour, the position that
is no longer live) and their paths. Pieces of up to 64 bytes run together, one tree
a row, in numpy; longer ones run alone in a list.

Splitting by the pattern depends only on a word and the single space before it, so
distinct words are encoded once a worker and remembered in caches of bounded size;
texts in which white space stands before a space are split as a whole.

Cases: a null text is the empty text, which has no ids and decodes to nothing. Ids
of no token raise an error. Any id or other column may be null or repeated; rows
are independent of one another, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import FEW_ROWS, Remembered, kept, small_batches, worker
from claimloom.llm.kernel import slices

#: Bytes that the remembered pieces, and words, of a worker may take.
CACHE_BYTES = 40 << 20
#: Longer texts between spaces are not remembered.
LONGEST = 256
NONE = np.iinfo(np.int32).max
WIDEST = 64


class LeftmostMin:
    """A segment tree over one piece: the least rank and, among equals, the leftmost."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        none = (NONE, 0)
        self.tree = [none] * self.size + [(r, i) for i, r in enumerate(ranks)] + [none] * (self.size - len(ranks))
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def least(self) -> tuple[int, int]:
        return self.tree[1]

    def set(self, i: int, rank: int) -> None:
        k = i + self.size
        self.tree[k] = (rank, i)
        while k > 1:
            k //= 2
            new = min(self.tree[2 * k], self.tree[2 * k + 1])
            if self.tree[k] == new:
                break
            self.tree[k] = new


class ByteBPE:
    """Encodes by a file of ranks, one base64 token and its rank a line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.unsafe = regex.compile(r"\s ").search
        self.pieces, self.words = Remembered(CACHE_BYTES), Remembered(CACHE_BYTES)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        ids: list[int] = [int(self.single[b]) for b in piece]
        n, rank = len(ids), lambda a, b: self.pairs.get(a << 32 | b, NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = LeftmostMin([rank(ids[i], ids[i + 1]) for i in range(n - 1)] + [NONE])
        while (least := tree.least())[0] != NONE:
            r, i = least
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = r, -1
            tree.set(j, NONE)
            if k < n:
                before[k] = i
            tree.set(i, rank(r, ids[k]) if k < n else NONE)
            if before[i] >= 0:
                tree.set(before[i], rank(ids[before[i]], r))
        return [x for x in ids if x >= 0]

    def together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids, as little-endian 32-bit bytes, of pieces of at most width bytes; one tree a row."""
        m = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        tok = self.single[raw]
        live = np.arange(width)
        tok[live >= sizes[:, None]] = -1
        after = np.broadcast_to(live + 1, (m, width)).copy()
        before = np.broadcast_to(live - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), NONE, np.int64)
        leaf = self._rank(tok[:, :-1], tok[:, 1:]).astype(np.int64)
        tree[:, width : 2 * width - 1] = np.where(leaf == NONE, NONE * width, leaf * width + live[:-1])
        tree[:, 2 * width - 1] = NONE * width
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        tok = np.concatenate([tok, np.full((m, 1), -1)], axis=1)  # column width stands for no neighbour
        rows = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(rows):
            root = tree[rows, 1]
            i, r = root % width, root // width
            j = after[rows, i]
            k = after[rows, j]
            tok[rows, i], tok[rows, j] = r, -1
            after[rows, i] = k
            inside = k < width
            before[rows[inside], k[inside]] = i[inside]
            p = before[rows, i]
            right = self._rank(r, tok[rows, k])
            q = np.maximum(p, 0)
            left = np.where(p >= 0, self._rank(tok[rows, q], r), NONE)
            tree[rows, width + j] = NONE * width
            tree[rows, width + i] = np.where(right == NONE, NONE * width, right.astype(np.int64) * width + i)
            has = p >= 0
            tree[rows[has], width + p[has]] = np.where(left == NONE, NONE * width, left.astype(np.int64) * width + p)[has]
            nodes = [width + j, width + i, width + q]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] < NONE * width]
        tok = tok[:, :width]
        mask = tok >= 0
        flat = tok[mask].astype("<u4").tobytes()
        ends = np.cumsum(mask.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn_pieces(self, new: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces; short ones are put into the cache, the others returned."""
        long: dict[str, bytes] = {}
        known: list[tuple[str, bytes]] = []
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            b = s.encode()
            if (r := self.ranks.get(b)) is not None:
                known.append((s, r.to_bytes(4, "little")))
            elif len(b) > LONGEST:
                long[s] = np.array(self.one(b), "<u4").tobytes()
            elif len(b) > WIDEST:
                known.append((s, np.array(self.one(b), "<u4").tobytes()))
            else:
                by_width.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((s, b))
        self.pieces.learn(known)
        for width, todo in by_width.items():
            for at in range(0, len(todo), 20_000):
                part = todo[at : at + 20_000]
                self.pieces.learn(zip((s for s, _ in part), self.together([b for _, b in part], width), strict=True))
        return long

    def split(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, split as a whole."""
        found = [self.find(t) for t in texts]
        self.pieces.shed()
        long = self.learn_pieces(set(chain.from_iterable(found)).difference(self.pieces))
        self.pieces.update(long)  # for this call alone
        get = self.pieces.__getitem__
        out = [b"".join(map(get, f)) for f in found]
        for s in long:
            del self.pieces[s]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            (odd if self.unsafe(t) else plain).append(i)
        for i, b in zip(odd, self.split([texts[i] for i in odd]), strict=True):
            out[i] = b
        firsts, rest = [], []
        for i in plain:
            a, *more = texts[i].split(" ")
            firsts.append(a)
            rest.append(more)
        self.words.shed()
        new = list(set(chain.from_iterable(rest)).difference(self.words))
        ids = self.split([" " + w for w in new])
        long = {w: b for w, b in zip(new, ids, strict=True) if len(w) > LONGEST}
        self.words.learn((w, b) for w, b in zip(new, ids, strict=True) if len(w) <= LONGEST)
        self.words.update(long)  # for this call alone
        get = self.words.__getitem__
        for i, a, more in zip(plain, self.split(firsts), rest, strict=True):
            out[i] = a + b"".join(map(get, more))
        for w in long:
            del self.words[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a worker process: one, until another operator runs there."""
    return kept("byte_bpe", (path, pattern), lambda: ByteBPE(path, pattern))


def _texts(col: pa.Array) -> Iterator[list[str]]:
    for a, b, _, _ in slices(col):
        yield ["" if t is None else t for t in col.slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array of token ids in place of any column ids_col."""
    small_batches(docs.sparkSession, FEW_ROWS)
    keep = [c for c in docs.columns if c != ids_col]

    def run(batches):
        bpe = codec(path, pattern)
        for b in batches:
            t = b.column(keep.index(text_col))
            ids = [i for part in _texts(t) for i in bpe.encode(part)]
            offs = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offs, flat)], names=[*keep, ids_col])

    chosen = docs.select(*keep)
    return chosen.mapInArrow(worker(run, "byte_bpe"), T.StructType([*chosen.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with the decoded bytes in place of any column bytes_col; null ids decode to nothing."""
    small_batches(encoded.sparkSession, FEW_ROWS)
    keep = [c for c in encoded.columns if c != bytes_col]

    def run(batches):
        bpe = codec(path, pattern)
        for b in batches:
            got = [bpe.decode(np.array(i or [], "<u4").tobytes()) for i in b.column(keep.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*keep, bytes_col])

    chosen = encoded.select(*keep)
    return chosen.mapInArrow(worker(run, "byte_bpe"), T.StructType([*chosen.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the hashes of each text's ids and of what they decode to, in one pass; with keep_ids also ids."""
    small_batches(docs.sparkSession, FEW_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = codec(path, pattern)
        for b in batches:
            n, ids_hash, back_hash, kept = [], [], [], []
            for part in _texts(b.column(1)):
                for ids in bpe.encode(part):
                    n.append(len(ids) // 4)
                    if keep_ids:
                        kept.append(ids)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    back_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            more = [pa.ListArray.from_arrays(np.cumsum([0, *n], dtype=np.int32), np.frombuffer(b"".join(kept), "<u4").astype(np.int32))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string()), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return rows.mapInArrow(worker(run, "byte_bpe"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
