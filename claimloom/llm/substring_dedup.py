"""Repeated byte strings: every byte covered by a SPAN-byte string that also starts anywhere else.

Anchors. In each SPAN-byte window the K-gram with the least hash, the leftmost among equals, is the
window's anchor. It depends on the window's bytes alone, so two equal windows have equal
anchors at equal distances. Consecutive windows with one anchor form a block. Only
blocks that share an anchor can hold a repeated window.

Blocks. Blocks meet by ranges of the anchor's hash. A block whose bytes occur twice is repeated as
a whole; a task settles the copies that it holds itself and sends one of them on, so a block of any number of copies
costs one row a task. Of blocks that share an anchor and differ, one occurrence of each sends its bytes. Their
suffixes are sorted in shards, and the shards' Burrows-Wheeler transforms are merged by
iterative interleave refinement (bwt_merge), which gives the common prefixes of neighbours;
windows that start in an interval of common prefixes of SPAN bytes are repeated. Strings
are equal where their 64-bit hashes are, for blocks with that of the anchor.

Hot anchors. Of an anchor in more than HOT differing blocks, windows are dealt by the anchor's distance, in classes
of CLASS distances, and by the bytes that all windows of the class have in common, SPAN - CLASS + 1
of them: equal windows still meet, and only texts that share so long a passage meet in one task.

Marks. The repeated intervals of a text meet its bytes once, and only texts that have any are shuffled.

Bitmaps tell the second and third pass which texts and blocks matter, and which anchors are hot; a
collision only moves a text or a block that was not needed, or deals an anchor's windows finer.

Cases: a null text is the empty text. Texts shorter than SPAN lose nothing. Rows are
told apart by id and text; rows equal in both repeat each other. Null ids
are allowed. A text is never cut, whatever its length. An empty table gives an empty
result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.bwt_merge import repeated
from claimloom.llm.common import may_hold, partitions_for, settings, small_batches, worker, worker_bitmap, written
from claimloom.llm.kernel import mix, prefix_sums, slices, span_hashes
from claimloom.llm.language_model import _dealt, _pack, _unpack, range_of

U = np.uint64
SPAN = 200
K = 64
#: Bytes of a symbol of the transforms; SPAN is a whole number of symbols.
STEP = 20
#: Bytes whose transforms are merged at once, but for a larger group of blocks that share an anchor.
MERGED = 1 << 20
#: Blocks that a task holds before it deals them out.
HELD = 400_000
#: Differing blocks of one anchor beyond which it is hot, and the distances of a class of its windows.
HOT, CLASS = 4096, 23

BLOCKS = [np.uint64, np.uint64, np.uint64, np.uint32, np.uint8, np.uint8, np.uint8]  # anchor, bytes, text, start, anchor's distance, windows - 1, whether its copies are settled
SETTLED = [np.uint64, np.uint32, np.uint32]  # text, start, end


def blocks(data: np.ndarray, offs: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """First and last window start and anchor position of each block, with the hashes of anchor and bytes, and the text's number."""
    n, w = len(data), span - k + 1
    sizes = np.diff(offs)
    long = np.flatnonzero(sizes >= span)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    sums = prefix_sums(data)
    at = np.arange(n - k + 1)
    grams = span_hashes(sums, at, at + k)
    bits = int(n).bit_length()
    key = (grams >> U(bits) << U(bits)) | at.astype(np.uint64)
    rows = -(-len(key) // w) + 1
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    anchor = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & U((1 << bits) - 1)).astype(np.int64)

    begin, end = offs[long], offs[long] + sizes[long] - span
    inside = np.zeros(m + 1, np.int64)
    inside[begin] += 1
    inside[end + 1] -= 1
    inside = np.cumsum(inside)[:-1] > 0
    change = anchor[1:] != anchor[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= change
    first[begin] = True
    last[:-1] &= change
    last[end] = True
    s1, s2 = np.flatnonzero(first), np.flatnonzero(last)
    p = anchor[s1]
    whole = mix(span_hashes(sums, s1, s2 + span) + (p - s1).astype(np.uint64))
    # An anchor has the least hash of many, so its hash is mixed again to spread over all ranges.
    return s1, s2, p, mix(grams[p]), whole, np.searchsorted(offs, s1, "right") - 1


def text_keys(ids: list, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each row's id and text."""
    own = np.array([int.from_bytes(hashlib.blake2b(repr(i).encode(), digest_size=8).digest(), "little") for i in ids], np.uint64)
    return mix(span_hashes(prefix_sums(data), offs[:-1], offs[1:]) ^ own)


def place_hash(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(key ^ (start.astype(np.uint64) * U(0x9E3779B97F4A7C15)))


def _rows(part: int, blob: bytes, kind: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])


DEALT = "part int, kind int, blob binary"
INTERVALS, REQUESTS, HOTS = 0, 1, 2
#: Kinds of dealt rows: blocks that must meet others, and intervals that a task has settled.
MEET, KNOWN = 0, 1


def _same(a: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (anchor, bytes), and where a new anchor and a new block begin in it."""
    order = np.lexsort((whole, a))
    a, whole = a[order], whole[order]
    new_a = np.append(True, a[1:] != a[:-1])
    return order, new_a, new_a | np.append(True, whole[1:] != whole[:-1])


def _deal_blocks(parts: int):
    def flush(held) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        order, _, new = _same(cols[0], cols[1])
        a, whole, key, start, ahead, more = (c[order] for c in cols)
        again = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        end = (start + more.astype(np.uint32) + np.uint32(SPAN))[again]
        part = range_of(mix(key[again]), parts)
        by = np.argsort(part, kind="stable")
        for p, s in _dealt(part[by], parts):
            i = by[s]
            yield _rows(p, _pack([key[again][i], start[again][i], end[i]]), KNOWN)
        cols = [c[new] for c in (a, whole, key, start, ahead, more, again.astype(np.uint8))]
        part = range_of(cols[0], parts)  # ascending, as anchors are
        for p, s in _dealt(part, parts):
            yield _rows(p, _pack([c[s] for c in cols]), MEET)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                s1, s2, p, a, whole, doc = blocks(data, offs)
                if not len(s1):
                    continue
                keys = text_keys(b.column(0).slice(lo, hi - lo).to_pylist(), data, offs)
                held.append((a, whole, keys[doc], (s1 - offs[doc]).astype(np.uint32), (p - s1).astype(np.uint8), (s2 - s1).astype(np.uint8)))
                n += len(s1)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return worker(run)


FOUND = "kind int, key long, starts array<int>, ends array<int>"


def _found(kind: int, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each text, some thousands of texts a batch."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order].astype(np.int32), end[order].astype(np.int32)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    bounds = np.append(at, len(key))
    for i in range(0, len(at), 4096):
        cut = bounds[i : i + 4097]
        lists = [pa.ListArray.from_arrays((cut - cut[0]).astype(np.int32), x[cut[0] : cut[-1]]) for x in (start, end)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut) - 1, kind, np.int32)), pa.array(key[cut[:-1]].view(np.int64)), *lists], names=["kind", "key", "starts", "ends"])


def _meet_blocks(batches):
    """Blocks that repeat as a whole, as intervals; one occurrence of each block that must be compared by windows, as requests; and the hot anchors."""
    found = []
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if kind == KNOWN:
                yield from _found(INTERVALS, *_unpack(blob, SETTLED))
            else:
                found.append(_unpack(blob, BLOCKS))
    if not found:
        return
    a, whole, key, start, ahead, more, settled = (np.concatenate(c) for c in zip(*found, strict=True))
    del found
    order, new_a, new_b = _same(a, whole)
    a, key, start, more, settled = a[order], key[order], start[order].astype(np.int64), more[order].astype(np.int64), settled[order]
    group, kind = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    copies = np.bincount(kind)[kind]
    kinds = np.bincount(group[new_b])[group]
    some = np.bincount(kind, settled)[kind] > 0
    again = ((copies > 1) | some) & (settled == 0)
    yield from _found(INTERVALS, key[again], start[again], (start + more + SPAN)[again])
    ask = new_b & (kinds > 1)
    yield from _found(REQUESTS, key[ask], start[ask], (start + more + SPAN)[ask])
    hot = new_a & (kinds > HOT)
    yield from _found(HOTS, a[hot], start[hot], start[hot])


def classes(data: np.ndarray, s1: np.ndarray, s2: np.ndarray, p: np.ndarray, a: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (first and last window start, anchor's place and hash), the hot ones cut into classes of distances, whose hash is that of the bytes common to the class; and each one's block."""
    sums = prefix_sums(data)
    out = [(s1[~hot], s2[~hot], p[~hot], a[~hot], np.flatnonzero(~hot))]
    own = np.flatnonzero(hot)
    for lo in range(0, SPAN - K + 1, CLASS):
        hi = min(lo + CLASS - 1, SPAN - K)
        first, last = np.maximum(s1[own], p[own] - hi), np.minimum(s2[own], p[own] - lo)
        some = first <= last
        b, c = p[own][some] - lo, p[own][some] - hi + SPAN
        out.append((first[some], last[some], p[own][some], mix(span_hashes(sums, b, c) + U(lo)), own[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _send_bytes(parts: int, texts, places, hots):
    """The bytes of the requested blocks, dealt by ranges of the anchor's hash, or, for hot anchors, of their classes' hashes."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        a, key, start, ahead, more, raw = zip(*held, strict=True)
        a, key, start, ahead, more = (np.concatenate(x) for x in (a, key, start, ahead, more))
        raw = [r for x in raw for r in x]
        part = range_of(a, parts)
        order = np.argsort(part, kind="stable")
        for p, s in _dealt(part[order], parts):
            i = order[s]
            yield _rows(p, _pack([a[i], key[i], start[i], ahead[i], more[i], np.frombuffer(b"".join(raw[j] for j in i.tolist()), np.uint8)]))

    def run(batches):
        held, n = [], 0
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                keys = text_keys(b.column(0).slice(lo, hi - lo).to_pylist(), data, offs)
                asked = np.flatnonzero(may_hold(texts.value, keys))
                if not len(asked):
                    continue
                own = np.concatenate([[0], np.cumsum(np.diff(offs)[asked])])
                part = np.concatenate([data[offs[i] : offs[i + 1]] for i in asked])
                s1, s2, p, a, _, doc = blocks(part, own)
                key, start = keys[asked][doc], (s1 - own[doc]).astype(np.uint32)
                send = np.flatnonzero(may_hold(places.value, place_hash(key, start)))
                if len(send):
                    raw = part.tobytes()
                    s1, s2, p, a, of = classes(part, s1[send], s2[send], p[send], a[send], may_hold(hots.value, a[send]))
                    doc = doc[send][of]
                    held.append((a, keys[asked][doc], (s1 - own[doc]).astype(np.uint32), (p - s1).astype(np.uint8), (s2 - s1).astype(np.uint8), [raw[x:y] for x, y in zip(s1.tolist(), (s2 + SPAN).tolist(), strict=True)]))
                    n += len(s1)
                if n >= HELD // 4:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return worker(run)


def _compare_windows(batches):
    """Intervals of windows that stand in two of the blocks that share an anchor, from the merged transforms of shards of blocks."""
    found = [_unpack(x, [np.uint64, np.uint64, np.uint32, np.uint8, np.uint8, np.uint8]) for b in batches for x in b.column(2).to_pylist()]
    if not found:
        return
    a, key, start, ahead, more, raw = (np.concatenate(c) for c in zip(*found, strict=True))
    del found
    windows = more.astype(np.int64) + 1
    base = np.concatenate([[0], np.cumsum(windows + SPAN - 1)])[:-1]
    order = np.argsort(a, kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])), len(a))

    def settle(chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = windows[chosen] + SPAN - 1
        offs = np.concatenate([[0], np.cumsum(size)])
        block = np.repeat(chosen, size)
        step = np.arange(offs[-1]) - np.repeat(offs[:-1], size)
        data = raw[base[block] + step]
        sums = prefix_sums(data)
        twice = repeated(lambda x, y: span_hashes(sums, x, y), len(data), np.repeat(offs[:-1], size), np.repeat(offs[1:], size), step < windows[block], STEP, SPAN // STEP)
        # A block's last bytes begin no window, so runs of repeated windows never join over blocks.
        first = np.flatnonzero(twice & ~np.append(False, twice[:-1]))
        last = np.flatnonzero(twice & ~np.append(twice[1:], False))
        s = start[block].astype(np.int64) + step
        yield from _found(INTERVALS, key[block[first]], s[first], s[last] + SPAN)

    held, size = [], 0
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # whole groups, about MERGED bytes at once
        held.append(order[x:y])
        size += int((windows[order[x:y]] + SPAN - 1).sum())
        if size > MERGED:
            yield from settle(np.concatenate(held))
            held, size = [], 0
    if held:
        yield from settle(np.concatenate(held))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """key, starts, ends: intervals of bytes, overlapping or not, that repeated SPAN-byte strings cover. docs: doc_id, text."""
    spark = docs.sparkSession
    parts = partitions_for(docs)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="64"):  # blobs are large
        dealt = docs.mapInArrow(_deal_blocks(parts), DEALT).repartitionById(parts, F.col("part"))
        met = written(dealt.mapInArrow(worker(_meet_blocks), FOUND), "intervals")
        asked = met.where(f"kind = {REQUESTS}")
        places = asked.mapInArrow(_place_hashes, "h long")
        bits = [worker_bitmap(asked, "key"), worker_bitmap(places, "h"), worker_bitmap(met.where(f"kind = {HOTS}"), "key")]
        sent = docs.mapInArrow(_send_bytes(parts, *bits), DEALT).repartitionById(parts, F.col("part"))
        compared = written(sent.mapInArrow(worker(_compare_windows), FOUND), "intervals")
    for b in bits:
        b.destroy()
    return met.where(f"kind = {INTERVALS}").unionByName(compared).drop("kind")


def _place_hashes(batches):
    for b in batches:
        lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
        key = np.repeat(b.column(1).to_numpy().view(np.uint64), lengths)
        start = b.column(2).flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(place_hash(key, start).view(np.int64))], names=["h"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_bytes also kept, the remaining bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(repeated_intervals(docs), "intervals")
    marked = worker_bitmap(found, "key")
    grouped = found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def keyed(batches):
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                ids = b.column(0).slice(lo, hi - lo)
                keys = text_keys(ids.to_pylist(), data, offs)
                raw, has = data.tobytes(), may_hold(marked.value, keys).tolist()
                texts = [raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()), pa.array(has)], names=["doc_id", "own", "raw", "has"])

    rows = docs.mapInArrow(worker(keyed), f"doc_id {kind}, own long, raw binary, has boolean")
    plain = rows.where("not has").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), *([F.col("raw").alias("kept")] if keep_bytes else []))

    def cut(batches):
        for b in batches:
            out = []
            for raw, starts, ends in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if starts.is_valid and len(starts.values):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, starts.values.to_numpy(zero_copy_only=False), 1)
                    np.subtract.at(edge, ends.values.to_numpy(zero_copy_only=False), 1)
                    gone = np.cumsum(edge)[:-1] > 0
                    spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    spans, kept = 0, raw
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])))
            cols = list(zip(*out, strict=True)) or [[]] * (4 + keep_bytes)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=["doc_id", *names[: len(cols)]])

    joined = rows.where("has").join(grouped, F.col("own") == F.col("key"), "left").select("doc_id", "raw", "starts", "ends")
    changed = joined.mapInArrow(worker(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    return plain.unionByName(changed)
