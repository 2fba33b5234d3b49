"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A segment is a plain binary file in the shared folder. It holds the ids of consecutive documents in the narrowest
unsigned type that fits the vocabulary. The n + 1 boundaries, which never fall, are split into low
bits, packed, and high bits in unary; a sample of every SAMPLE-th one makes select a
short scan, so a boundary costs about 2 + log2(mean length) bits and no 64-bit table
of offsets exists. Document ids ascend within a file and are stored alike, as distances from the first. Readers map a
segment into memory and find a document by select. A small table beside the segments names them, with their file's number and their numbers of ids.

Documents are dealt to files by ranges of their id, ascending through the files.
Rows with equal ids are ordered by their text; a null id comes first.

Cases: a null text is the empty text and gives only the end id. An empty table gives
no segments and an empty result. Texts may be of any length: a segment ends with
the document that fills it. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import Remembered, fresh_path, kept, partitions_for, small_batches, worker
from claimloom.llm.kernel import slices
from claimloom.llm.shared_files import map_bytes, write_bytes

SEGMENT_IDS = 1 << 21
SAMPLE = 64
MAGIC = b"EFIDS002"
#: Bytes that a worker's remembered words may take, and the longest word that is remembered.
CACHE_BYTES, LONGEST = 96 << 20, 256
#: A word of letters or digits and a tail of ASCII signs other than the apostrophe.
PARTS = re.compile(rb"([a-z0-9\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
SCHEMA = "file int, seq int, ids_before long, n_docs int, n_ids long, segment string"


class EliasFano:
    """Values that never fall, from 0 to the last: low bits packed, high bits in unary, a sample of the ones' places."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._low, self._high = memoryview(low), memoryview(high)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th one, from the sample before it, and the low bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at // 8, at % 8
        high = self._high
        word = high[byte] >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        b = i * self.low_bits
        packed = int.from_bytes(self._low[b // 8 : (b + self.low_bits + 7) // 8], "little") >> b % 8
        return (place - i) << self.low_bits | packed & (1 << self.low_bits) - 1

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, buf, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", buf, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(buf, np.uint8, a, at)
        high = np.frombuffer(buf, np.uint8, b, at + a)
        samples = np.frombuffer(buf, "<u4", c, at + a + b)
        return cls(n, bits, low, high, samples), at + a + b + 4 * c


class Segment:
    """Consecutive documents: their ids, boundaries and token ids, over bytes or a memory map."""

    HEAD = "<BQQQq"

    def __init__(self, buf):
        if bytes(buf[:8]) != MAGIC:
            raise ValueError("not a token segment")
        width, self.n_docs, n_ids, self.unnamed, self.first_id = struct.unpack_from(self.HEAD, buf, 8)
        self.names, at = EliasFano.from_buffer(buf, 8 + struct.calcsize(self.HEAD))
        self.bounds, at = EliasFano.from_buffer(buf, at)
        self.ids = np.frombuffer(buf, "<u2" if width == 2 else "<u4", n_ids, at)

    @staticmethod
    def pack(doc_ids: list, ids: list[bytes], width: int) -> list[bytes]:
        """The parts of a segment. doc_ids ascend, nulls first; ids: each document's ids in little-endian integers of width bytes."""
        bounds = np.cumsum([0, *(len(i) // width for i in ids)])
        names = [i for i in doc_ids if i is not None]
        first = names[0] if names else 0
        head = MAGIC + struct.pack(Segment.HEAD, width, len(ids), int(bounds[-1]), len(doc_ids) - len(names), first)
        return [head, EliasFano.of(np.array([i - first for i in names], np.uint64)).to_bytes(), EliasFano.of(bounds).to_bytes(), *ids]

    def __len__(self) -> int:
        return self.n_docs

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.first_id + self.names.select(i - self.unnamed)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class WordEncoder:
    """A tokenizer that drops white space and folds case, run once for each distinct word of a worker's texts.

    White space ends every token and leaves none, so words can be encoded alone, in lower case. A word of letters
    and a tail of ASCII signs other than apostrophes are two pieces, encoded apart. Words of letters are one piece
    each, so many go to the library in one text and the word ends among the ids part them again; if the ends don't
    match the words, and for all other words, the library gets them one by one. Texts that may hold a special token's
    string go to it whole, and so do all texts where the file asks for another normalizer or pre-tokenizer than KNOWN.
    """

    #: The normalizers and the pattern that make words independent of one another.
    KNOWN = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.width = int(self.kind[2])
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = Remembered(CACHE_BYTES)
        self.by_word = self._known(path)

    def _known(self, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        normalizers = [n["type"] for n in (found.get("normalizer") or {}).get("normalizers", [])]
        steps = (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split"]
        return normalizers == self.KNOWN[0] and patterns == [self.KNOWN[1]]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], texts: list[str]) -> None:
        for at in range(0, len(words), 4096):
            self.words.learn(zip(words[at : at + 4096], self._ids(texts[at : at + 4096]), strict=True))

    def _learn_letters(self, words: list[bytes], texts: list[str]) -> None:
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.frombuffer(self._ids([" ".join(texts[at : at + 256])])[0], self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) == len(part) and ends[-1] == ids.nbytes:
                raw = ids.tobytes()
                self.words.learn((w, raw[a:z]) for w, a, z in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            else:
                self._learn(part, texts[at : at + 256])

    def learn(self, new: list[bytes]) -> None:
        """Put the ids of words in lower case into the cache."""
        parted, alone = [], []
        letters: dict[bytes, str] = {}
        for w in new:
            m = PARTS(w)
            stem = (m[1] if m else w).decode()
            if m and stem.lower().isalpha():
                parted.append((w, m[1], m[2]))
                letters[m[1]] = stem
            elif stem.lower().isalpha():
                letters[w] = stem
            else:
                alone.append(w)
        alone += {t for _, _, t in parted if t not in self.words}
        for w in [w for w in letters if w in self.words]:
            del letters[w]
        self._learn(alone, [w.decode() for w in alone])
        self._learn_letters(list(letters), list(letters.values()))
        self.words.learn((w, self.words[stem] + self.words[tail]) for w, stem, tail in parted)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Each text's ids."""
        split = [None if b"<|" in t or not self.by_word else t.lower().split() for t in texts]
        self.words.shed()
        new = set(chain.from_iterable(s for s in split if s)).difference(self.words)
        long = [w for w in new if len(w) > LONGEST]
        self.learn(list(new.difference(long)))
        if long:  # for this call alone
            self.words.update(zip(long, self._ids([w.decode() for w in long]), strict=True))
        get = self.words.__getitem__
        out = [self._ids([t.decode()])[0] if s is None else b"".join(map(get, s)) for s, t in zip(split, texts, strict=True)]
        for w in long:
            del self.words[w]
        return out


def encoder(path: str) -> WordEncoder:
    """The encoder of a worker process: one, until another operator runs there."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept("token_files", path, lambda: WordEncoder(path))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each followed by end_id, as segments under path/segments, ascending by id, and the table of segments as path/index."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions_for(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc, file = encoder(tokenizer), TaskContext.get().partitionId()
        end = end_id.to_bytes(enc.width, "little")
        ids_col, held, size, seq, before = [], [], 0, 0, 0

        def segment():
            nonlocal ids_col, held, size, seq, before
            n, name = size // enc.width, f"{path}/segments/{file:06d}-{seq:06d}"
            write_bytes(name, Segment.pack(ids_col, held, enc.width))
            row = [[file], [seq], [before], [len(held)], [n], [name]]
            ids_col, held, size, seq, before = [], [], 0, seq + 1, before + n
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)

        names = ["file", "seq", "ids_before", "n_docs", "n_ids", "segment"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), 4 << 20):
                raw = data.tobytes()
                texts = [raw[a:z] for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                for i, ids in zip(b.column(0).slice(lo, hi - lo).to_pylist(), enc.encode(texts), strict=True):
                    ids_col.append(i)
                    held.append(ids + end)
                    size += len(ids) + enc.width
                    if size >= SEGMENT_IDS * enc.width:
                        yield segment()
        if held:
            yield segment()

    ranged.mapInArrow(worker(run, "token_files"), SCHEMA).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 of the ids as 32-bit integers.

    Segments are mapped into memory, one at a time, and documents found by select. Where a file's ids begin follows from
    the files' totals, one number a file.
    """
    small_batches(spark)
    files = spark.read.schema(SCHEMA).parquet(f"{path}/index")
    totals = {r["file"]: r["n"] for r in files.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for f in sorted(totals):
        base[f], at = at, at + totals[f]

    def run(batches):
        for b in batches:
            for file, before, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s, rows = Segment(map_bytes(name)), []
                wide, start, shift = memoryview(s.ids.astype("<u4")), s.bounds.select(0), base[file] + before
                for i in range(len(s)):
                    end = s.bounds.select(i + 1)
                    rows.append((s.doc_id(i), start + shift, end - start, zlib.crc32(wide[start:end])))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = files.select("file", "ids_before", "segment").repartition(max(1, min(len(totals) or 1, 1 << 20)), "segment")
    return dealt.mapInArrow(worker(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to files in the shared folder and return what the files hold."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
