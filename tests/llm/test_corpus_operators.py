"""Every corpus operator against a brute-force version, on a small table with hard cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import byte_bpe, common, exact_dedup, jaccard, language_id, language_model, licenses, mixing, quality, queries, substring_dedup, token_files
from claimloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bm_bit int, row string"


def corpus():
    rng = random.Random(3)
    vocab = {"en": [f"{a}{b}" for a in "the of and ing on er".split() for b in "a th ou nd re".split()], "fr": [f"{a}{b}" for a in "é è qu eau ment".split() for b in "le ion x que".split()]}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) + (rng.choice([".", ",", ""])) for _ in range(n))
    passage = say("en", 60)
    texts = [None, "", " \n\t ", "one", "One", "two words", "a  b\n c d", "word " * 40, "#$% " * 30, "日本語 " * 30 + "é" * 300, "x" * 3000, "Under the MIT License. under the mit license; Apache License, Version 2.0", "CC BY-NC 4.0"]
    texts += [say(rng.choice(["en", "fr"]), rng.randrange(20, 90)) for _ in range(25)]
    texts += [say("en", 30) + " " + passage + " " + say("en", 30) for _ in range(6)]
    base = say("en", 120).split(" ")
    for k in range(14):  # near copies of one text
        words = list(base)
        for _ in range(k // 4):
            words[rng.randrange(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [texts[20]] * 12 + ["One"] * 2 + ["a\r\n\r\nb\n\nb\n\nb"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), 0, 1, "r") for i, t in enumerate(texts)]
    rows.append(rows[15])  # a row twice
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark, docs, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_duplicates(docs, hash_all=True).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        g = groups[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g))
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    kept = exact_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in exact_dedup.exact_duplicates(nulls).collect()) == [(0, 0, 1), (0, 1, 3), (0, 1, 3), (1, 1, 3)]


def test_exact_dedup_by_row(spark):
    """Null and repeated ids have a verdict for each of their texts."""
    rows = [(None, "a"), (1, "a"), (None, "b"), (None, "b"), (None, "e"), (2, "c"), (2, "d"), (3, "d"), (4, "f"), (4, "f"), (4, "g"), (0, "g")]
    kept = exact_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept) == [("a", 1), ("b", None), ("c", 2), ("d", 3), ("e", None), ("f", 4), ("g", 4)]


def classes(rows, k, percent):
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sets, {i: find(i) for i in sets}


def links_of(sets, percent):
    """For each document, the different sets that its set is linked with."""
    distinct = {s for s in sets.values() if s}
    linked = {s: sum(t != s and 100 * len(s & t) >= percent * len(s | t) for t in distinct) for s in distinct}
    return {i: linked.get(s, 0) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50), (1, 60), (2, 70)])
def test_ngram_jaccard(docs, rows, k, percent):
    sets, want = classes(rows, k, percent)
    links = links_of(sets, percent)
    found, _ = jaccard.similar(docs, k, percent)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], links[r["doc_id"]]), r


def test_ngram_jaccard_of_small_sets(spark, empty):
    """Low similarities link sets of one and two tokens; percent 100 and 0 are refused; an empty table gives an empty result."""
    texts = ["a b", "a", "c d e", "c d", "f", "g h i j", "g h i j k l m"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for percent, want in ((50, [0, 0, 2, 2, 4, 5, 5]), (60, [0, 1, 2, 2, 4, 5, 6])):
        found, _ = jaccard.similar(df, 1, percent)
        assert [r["component_id"] for r in found.orderBy("doc_id").collect()] == want
    for percent in (0, 100):
        with pytest.raises(ValueError, match="percent"):
            jaccard.similar(df, 1, percent)
    assert jaccard.similar(empty)[0].count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_blocks_of_a_hub(spark, monkeypatch):
    """A hub of many blocks: sets are dealt once, files hold the blocks, and links are those of all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(w), None, None, 0, 0, ""))
    sets, want = classes(rows, 3, 80)
    links = links_of(sets, 80)
    found, _ = jaccard.similar(spark.createDataFrame(rows, SCHEMA), 3, 80)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in found.collect()} == {i: (want[i], links[i]) for i in want}


def test_flagged_by_bitmap_and_by_shuffle(spark):
    """Both ways of meeting keys flag all of them; the shuffle flags no other row."""
    from claimloom.llm.common import flagged

    rows, keys = spark.range(500).withColumnRenamed("id", "bm_bit"), spark.range(0, 500, 7)
    want = set(range(0, 500, 7))
    for most, exact in ((1 << 26, False), (64, True)):
        got = flagged(rows, F.xxhash64("bm_bit"), keys, F.xxhash64("id"), "met", most).where("met").collect()
        met = {r["bm_bit"] for r in got}
        assert met == want if exact else met >= want


def test_ngram_jaccard_of_a_large_group(spark):
    """A group larger than RARE, of different texts: links go through hubs and across components."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(150)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w), None, None, 0, 0, ""))
    rows += [(100 + i, f"other {i} " * 3 + " ".join(base[:8]), None, None, 0, 0, "") for i in range(30)]
    _, want = classes(rows, 3, 90)
    found, _ = jaccard.similar(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want


def test_near_copies_by_row(spark):
    """Null and repeated ids have a verdict for each of their texts, and one row of each component stays."""
    text = lambda name, edit=None: " ".join(f"{name}{edit if i == 50 and edit else i}" for i in range(100))
    rows = [(1, text("a")), (None, text("a", "x")), (None, text("b")), (7, text("c")), (7, text("a", "y"))]
    rows += [(None, text("d")), (None, text("d", "x")), (9, text("e")), (9, text("e", "x")), (None, text("f")), (None, text("f")), (5, text("g")), (6, text("g").upper())]
    rows += [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["text"], r["doc_id"]) for r in jaccard.one_of_each(df).collect()]
    assert sorted(((t or "-")[0], i or 0) for t, i in kept) == [("-", 0), ("-", 0), ("a", 1), ("b", 0), ("c", 7), ("d", 0), ("e", 9), ("f", 0), ("g", 5)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_language_id(spark, docs, rows, empty):
    labelled = docs.where("lang is not null")
    net = language_id.train(labelled)
    got = language_id.predict(docs, net, [docs["doc_id"]]).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r["score"] <= 1
    assert language_id.train(empty) is None and language_id.predict(empty, None, [empty["doc_id"]]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, None, [docs["doc_id"]]).collect()} == {"und"}
    data = np.frombuffer(b"".join((r[1] or "").encode() for r in rows), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len((r[1] or "").encode()) for r in rows])])
    probabilities = language_id.documents(net, data, offs)
    for i in [3, 5, 7, 9, 10, 14, 20]:
        assert np.allclose(probabilities[i], naive_probabilities(net, (rows[i][1] or "").encode()), atol=1e-4)
    rare = docs.where("lang is not null").limit(20).union(docs.sparkSession.createDataFrame([(999, "zzz zz zzzz", "zz", None, 0, 1, "r")], SCHEMA))
    assert "zz" in language_id.train(rare, train_docs=4).languages


def naive_probabilities(net, raw):
    """The network over one text, a byte and a gate at a time."""
    core, context, outside = language_id.CORE, language_id.CONTEXT, language_id.OUTSIDE
    low = [c + 32 if 65 <= c <= 90 else c for c in raw]

    def states(layer, symbols):
        p, n, out = layer.params, layer.h, []
        h = [0.0] * n
        for c in symbols:
            a = [p["c"][j] + sum(h[i] * p["u"][i][j] for i in range(n)) for j in range(3 * n)]
            x = p["x"][c]
            z = [1 / (1 + math.exp(-(x[j] + a[j]))) for j in range(n)]
            r = [1 / (1 + math.exp(-(x[n + j] + a[n + j]))) for j in range(n)]
            new = [math.tanh(x[2 * n + j] + r[j] * a[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
            out.append(h)
        return out

    total = np.zeros(len(net.languages))
    for at in range(0, len(low), core):
        symbols = [low[i] if 0 <= i < len(low) else outside for i in range(at - context, at + core + context)]
        there = states(net.there, symbols[: context + core])[context:]
        back = states(net.back, symbols[: context - 1 : -1])[context:][::-1]
        for c, f, b in zip(symbols[context:], there, back, strict=False):
            if c != outside:
                e = np.exp(np.array([*f, *b]) @ net.out["w"] + net.out["b"])
                total += e / e.sum()
    return total / max(total.sum(), 1e-9)


def test_network_gradients():
    net = language_id.Network(["a", "b", "c"], hidden=4, seed=1)
    rng = np.random.default_rng(0)
    for layer in (net.there, net.back):
        layer.params = {k: v.astype(np.float64) for k, v in layer.params.items()}
    net.out = {k: v.astype(np.float64) for k, v in net.out.items()}
    w, y = rng.integers(97, 103, (6, 5)), rng.integers(0, 3, 6)
    _, grads = net.gradients(w, y)
    for params, grad in zip([net.there.params, net.back.params, net.out], grads, strict=True):
        for k in params:
            at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
            old = params[k][at]
            params[k][at] = old + 1e-5
            up = net.gradients(w, y)[0]
            params[k][at] = old - 1e-5
            down = net.gradients(w, y)[0]
            params[k][at] = old
            assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-3, k


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)


BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe(docs, rows):
    import tiktoken

    codec = byte_bpe.codec(BPE, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice(" \n\tab1é'.,s   ") for _ in range(60)) for _ in range(400)] + ["<|endoftext|> don't", "a" * 700, "́ ab\x1c c"]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t[:50])
        assert codec.decode(ids) == t.encode()
    got = by_id(byte_bpe.digests(docs, BPE, public_tokenizers.PATTERN))
    for r in rows:
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()
        assert (got[r[0]]["n_tokens"], got[r[0]]["ids_sha256"], got[r[0]]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())


def test_segment_tree():
    rng = random.Random(4)
    ranks = [rng.randrange(5) for _ in range(23)]
    tree = byte_bpe.LeftmostMin(ranks)
    for _ in range(100):
        assert tree.least() == min((r, i) for i, r in enumerate(ranks))
        i = rng.randrange(23)
        ranks[i] = rng.randrange(9)
        tree.set(i, ranks[i])


def test_language_model(docs, rows, empty):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(r[0], [*words((r[1] or "").translate(LOWER)), None]) for r in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in toks:
        if not held(i):
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    model = language_model.train(docs.where(~queries.fold(1)))
    assert (model.n, model.v, model.pairs) == (n, v, len(bi))
    context, before = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, b), c in bi.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1
        before[b] += 1
    d, e = model.d, model.e

    def p(a, b):
        low = max(before[b] - e[min(before[b], 3)], 0) / len(bi) + model.rest / (v + 1)
        if a not in context:
            return low
        c, x = bi.get((a, b), 0), context[a]
        return max(c - d[min(c, 3)], 0) / x[0] + sum(d[k] * x[k] for k in (1, 2, 3)) / x[0] * low

    got = by_id(language_model.score(docs, model, [docs["doc_id"]]))
    for i, t in toks:
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(uni[w] > 0 for w in t))
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t[:-1]], t, strict=True)), rel_tol=1e-9)
    total = sum(p("the", w) for w in [*uni]) + p("the", "never seen")
    assert total < 1.0001
    nothing = language_model.train(empty)
    assert nothing.n == 0 and all(math.isfinite(r["score"]) for r in language_model.score(docs, nothing, [docs["doc_id"]]).collect())


def test_quality_rules(docs, rows, empty):
    got = by_id(quality.judge(docs))
    for r in rows:
        t, w = r[1] or "", words(r[1])
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = collections.Counter(windows)
        cover = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
        x = got[r[0]]
        assert [x[c] for c in quality.COUNTS[:5]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)], t[:40]
        assert x["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (x["base_failed"] and x["kept"])
    assert quality.judge(empty).count() == 0
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if got[r[0]]["kept"])


def test_quality_limits_tighten_and_are_bounded(spark):
    """A group with 40% junk, or of one text, does not lift its own limit; a uniform group's limit lies below the wide distances."""
    rng = random.Random(5)
    say = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    rows = [(i, say(60, 5), "en", f"s{i % 4}", 0, 1, "r") for i in range(200)]
    junk = " ".join(f"{w} ##$" for w in say(60, 5).split())
    rows += [(1000 + i, junk + f" {i}", "en", "dirty", 0, 1, "r") for i in range(40)] + [(2000 + i, say(60, 5), "en", "dirty", 0, 1, "r") for i in range(60)]
    rows += [(3000, junk, "en", "alone", 0, 1, "r"), (3001, say(60, 8), "en", "s1", 0, 1, "r")]
    twice, once = [say(9, 5) for _ in range(3)], say(9, 5)
    rows.append((3002, " ".join([*twice, say(146, 5), *twice]), "en", "s2", 0, 1, "r"))  # 54 of 200 words
    rows.append((3003, f"{once} {say(62, 5)} {once}", "en", "s2", 0, 1, "r"))  # one stretch that comes twice
    got = by_id(quality.judge(spark.createDataFrame(rows, SCHEMA)))
    failed = {i: r["failed"] for i, r in got.items() if not r["kept"]}
    assert not any(r["base_failed"] for r in got.values())
    assert failed == {**{1000 + i: ["symbol_rate"] for i in range(40)}, 3000: ["symbol_rate"], 3001: ["word_length"], 3002: ["repeat_rate"]}


def test_sketch_quantiles(spark):
    """A bin's start lies within its part of the value, and sketches of parts add up to that of the whole."""
    df = spark.range(0, 5000).selectExpr("id", f"{quality.bin_of('id')} as b").selectExpr("id", f"{quality.bin_start('b')} as s").collect()
    assert all(r["s"] <= r["id"] <= r["s"] * (1 + 1 / quality.STEPS) + 1 for r in df)


def test_sketches_of_parts_add_up(spark):
    """The bins of two halves, added, are those of the whole, and quantiles follow."""
    df = spark.range(3000).selectExpr(f"{quality.bin_of('id * 7 % 911')} as bin", "id % 2 as half")
    of = lambda rows: {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    a, b = (collections.Counter(of(df.where(f"half = {h}"))) for h in (0, 1))
    assert a + b == collections.Counter(of(df))


def test_null_ids_and_empty_tables(spark, empty):
    """Every operator gives a row for each row with a null or repeated id, ignores further columns, and an empty result for an empty table."""
    texts = [None, "", "x", "some words of a text " * 30, "some words of a text " * 30, "other words " * 40]
    rows = [(None, t, None, None, None, None, None) for t in texts] + [(1, t, "en", "s", 0, 1, "r") for t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    net = language_id.train(df)
    runs = {
        "op1": lambda d: jaccard.similar(d)[0], "op2": lambda d: language_id.predict(d, net, [d["doc_id"]]), "op3": lambda d: byte_bpe.digests(d, BPE, public_tokenizers.PATTERN), "op4": lambda d: language_model.score(d, language_model.train(d), [d["doc_id"]]),
        "op5": quality.judge, "op6": substring_dedup.remove_repeats, "op7": lambda d: licenses.summary(*licenses.scan(d)), "op8": lambda d: token_files.round_trip(d, public_tokenizers.path("word_bpe_49k.json"), 2), "op9": lambda d: mixing.mix(d, [1.0], 1.5, 2.0), "op10": exact_dedup.exact_duplicates,
    }
    for name, run in runs.items():
        got = run(df).collect()
        assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == len(texts), name
        assert run(empty).count() == 0, name
    for stage in (quality.filtered, exact_dedup.one_of_each, jaccard.one_of_each, lambda d: mixing.sharded(d, [1.0], 1.5, 2.0)):
        assert stage(df).columns == df.columns and stage(empty).count() == 0


def test_long_text(spark):
    """A text of a megabyte, beside its copy with one change."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(180_000))
    df = spark.createDataFrame([(1, long), (2, long[:500_000] + "!" + long[500_001:])], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    assert {r["component_id"] for r in jaccard.similar(df)[0].collect()} == {1}
    got = by_id(byte_bpe.digests(df, BPE, public_tokenizers.PATTERN))
    assert got[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).orderBy("doc_id").collect()] == [len(long) - 1] * 2


def test_substring_dedup(docs, rows):
    span = substring_dedup.SPAN
    raw = [(r[1] or "").encode() for r in rows]
    often = collections.Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    got = collections.defaultdict(list)
    for r in substring_dedup.remove_repeats(docs, keep_bytes=True).collect():
        got[r["doc_id"]].append(r)
    removed = 0
    for r, x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - span + 1):
            if often[x[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        removed += int(gone.sum())
        for g in got[r[0]]:
            assert (g["n_bytes"], g["n_removed"], bytes(g["kept"]), g["kept_sha256"]) == (len(x), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest())
            assert g["n_spans"] == int((gone & ~np.append(False, gone[:-1])).sum())
    assert removed > 3000 and sum(map(len, got.values())) == len(rows)


def test_license_scan(docs, rows, empty):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(licenses.summary(*licenses.scan(docs)))
    for r in rows:
        w = token.findall((r[1] or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        x = got[r[0]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({b for _, b in at})))
    assert licenses.summary(*licenses.scan(empty)).count() == 0


def test_license_template_with_edits(spark):
    words_ = licenses.TEMPLATES[1][0].split()
    words_[5] = "anybody"
    text = "intro words here " + " ".join([*words_[:12], "extra", *words_[12:]]) + " outro"
    got = licenses.summary(*licenses.scan(spark.createDataFrame([(1, text), (2, "permission is hereby granted to nobody")], "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "mit", 2: ""}


def test_token_files(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), token_files.encoder(path)
    rng = random.Random(8)
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice(" \n\tab1é'.,sΣ*<|İ́") for _ in range(60)) for _ in range(300)] + ["İstanbul ΣΑΣ", "a<|endoftext|>b"]
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    got = token_files.round_trip(docs, path, 2).orderBy("start").collect()
    start = 0
    for r, x in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (r[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.round_trip(empty, path, 2).count() == 0


def test_elias_fano_and_segments(tmp_path):
    for n in (1, 2, 65, 700):
        v = np.sort(np.random.default_rng(n).integers(0, 10**5, n))
        ef, _ = token_files.EliasFano.from_buffer(token_files.EliasFano.of(v).to_bytes(), 0)
        assert v.tolist() == [ef.select(i) for i in range(n)]
    for names in ([None, 5, 7], [None, None, None], [-(2**63), 0, 2**63 - 1]):
        with open(tmp_path / "s.bin", "wb") as f:
            f.writelines(token_files.Segment.pack(names, [b"\x01\x00\x02\x00", b"", b"\x03\x00"], 2))
        s = token_files.Segment(np.memmap(tmp_path / "s.bin", mode="r"))
        assert [s.document(i).tolist() for i in range(3)] == [[1, 2], [], [3]]
        assert [s.doc_id(i) for i in range(3)] == names


def test_select_from_the_shared_folder(spark, docs, rows):
    """One document, found by select in a mapped segment of the shared folder; null and repeated ids."""
    from tokenizers import Tokenizer

    from claimloom.llm.common import fresh_path
    from claimloom.llm.shared_files import map_bytes

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = fresh_path(spark, "tokens")
    more = spark.createDataFrame([(None, "no name", None, None, 0, 1, "r"), (None, None, None, None, 0, 1, "r"), (3, "again", None, None, 0, 1, "r")], SCHEMA)
    token_files.write_token_files(docs.union(more), path, tokenizer, 2)
    found = {}
    for r in spark.read.parquet(f"{path}/index").collect():
        s = token_files.Segment(map_bytes(r["segment"]))
        assert (len(s), len(s.ids)) == (r["n_docs"], r["n_ids"])
        for i in range(len(s)):
            found.setdefault(s.doc_id(i), []).append(s.document(i).tolist())
    lib = Tokenizer.from_file(tokenizer)
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted(found[None]) == sorted([ids("no name"), ids("")]) and found[20] == [ids(rows[20][1])]
    assert sorted(found[3]) == sorted([ids(rows[3][1]), ids("again")])


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs, [5.0, 2.0, 1.0], 1.5, 2.0).collect()
    again = mixing.mix(docs.repartition(5), [5.0, 2.0, 1.0], 1.5, 2.0).collect()
    key = lambda x: sorted((r["doc_id"], len(r["draws"])) for r in x)
    assert key(got) == key(again) and len(got) == len(rows)
    for source in ("s1", "s2", None):
        own = [r for r in got if r["source"] == source]
        taken = sum(r["size"] * len(r["draws"]) for r in own)
        assert all(len(r["draws"]) <= 2 for r in own) and own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"]
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), 1.5 * sum(r["size"] for r in got))
    tree = mixing.splitting_tree([40, 7, 0], 8, 1)
    assert tree.sum(0).tolist() == [40, 7, 0] and tree.sum(1).max() - tree.sum(1).min() <= 3
    assert mixing.targets([100.0, 10.0, 100.0], [5.0, 2.0, 1.0], 1.5, 2.0)[1] == 20.0
    assert mixing.mix(empty, [1.0], 1.5, 2.0).count() == 0 and mixing.sharded(docs, [1.0], 1.5, 2.0).columns == docs.columns


def test_mixing_follows_the_tree(spark, docs, monkeypatch):
    """Copies of one block share a shard, shards hold the tree's numbers of blocks, and partitions are the shards in order of place."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    weights, share, most = [5.0, 2.0, 1.0], 1.5, 2.0
    sized = mixing.sizes(docs).cache()
    found = mixing.plan(sized, weights, share, most)
    assert found.shards > mixing.LEAST_SHARDS and found.blocks >= mixing.SHARD_BLOCKS * found.shards
    tree = mixing.splitting_tree([int((found.draws["source_number"] == k).sum()) for k in range(len(found.sources))], found.shards, mixing.SEED)
    for (k, shard), n in found.draws.groupby(["source_number", "shard"]).size().items():
        assert tree[shard, k] == n
    assert tree.sum() == len(found.draws)
    digits = [mixing._digit(j, found.blocks).alias(f"b{j}") for j in range(mixing.LEVELS)]
    number = {(None if r.source is None or r.source != r.source else r.source): r.source_number for r in found.sources.itertuples()}
    drawn = {(r.source_number, r.path, r.block): [] for r in found.draws.itertuples()}
    for r in found.draws.itertuples():
        drawn[r.source_number, r.path, r.block].append((r.epoch, r.shard))
    got = mixing.mix(docs, weights, share, most).select("*", *digits).collect()
    copies = collections.Counter()
    for r in got:
        path = [str(r[f"b{j}"]) for j in range(mixing.LEVELS)]
        want = [x for j in range(mixing.LEVELS) for x in drawn.get((number[r["source"]], "/".join(path[:j]), r[f"b{j}"]), [])] if r["size"] else []
        assert sorted((d["copy"], d["shard"]) for d in r["draws"]) == sorted(want)
        copies.update((d["shard"], r["doc_id"]) for d in r["draws"])
    parts = mixing.sharded(docs, weights, share, most).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    assert collections.Counter((r["p"] // found.splits, r["doc_id"]) for r in parts) == copies


def test_pipeline(spark, docs, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    text = {}
    for r in rows:
        text[r[1]] = max(r[0], text.get(r[1], -1))
    rows = [r for r in {r[0]: r for r in rows}.values() if text[r[1]] == r[0]]
    _, component = classes(rows, 5, 80)
    stay = {r[0] for r in rows if component[r[0]] == r[0]}
    d = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, "")
        assert d.columns == docs.columns
    assert sorted(r["doc_id"] for r in d.collect()) == sorted(stay)
    mixed = corpus_pipeline.STAGES[3][1](spark, d, "")
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: len(r["draws"]) for r in mixing.mix(d, queries.WEIGHTS, queries.SHARE, queries.MOST).collect()}
    assert counts == {k: v for k, v in want.items() if v}
    last = corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()
    assert collections.Counter(r["doc_id"] for r in last) == counts and all(len(r["ids"]) == r["n_tokens"] for r in last)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_and_has_its_columns(spark, name, tmp_path):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns[0] == "doc_id" and df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_bwt_merge(monkeypatch):
    """Merged orders sort the suffixes of all shards, and common prefixes are those of neighbours."""
    from claimloom.llm import bwt_merge
    from claimloom.llm.kernel import prefix_sums, span_hashes

    monkeypatch.setattr(bwt_merge, "SHARD", 300)
    rng = np.random.default_rng(1)
    base, step, size = rng.integers(97, 100, 120).astype(np.uint8), 5, 4
    for _ in range(5):
        strings = []
        for _ in range(25):
            x = base.copy()
            x[rng.integers(0, 120, rng.integers(0, 4))] = 100
            at = rng.integers(0, 40)
            strings.append(x[at : at + rng.integers(20, 80)])
        data, offs = np.concatenate(strings), np.concatenate([[0], np.cumsum([len(x) for x in strings])])
        start, end = np.repeat(offs[:-1], np.diff(offs)), np.repeat(offs[1:], np.diff(offs))
        sums = prefix_sums(data)
        spans = lambda a, b: span_hashes(sums, a, b)  # noqa: B023, E731
        counted = (np.arange(len(data)) + 20 <= end) & (rng.random(len(data)) < 0.8)
        often = collections.Counter(data[i : i + 20].tobytes() for i in np.flatnonzero(counted))
        got = bwt_merge.repeated(spans, len(data), start, end, counted, step, size)
        assert got.tolist() == [bool(counted[i]) and often[data[i : i + 20].tobytes()] > 1 for i in range(len(data))]


def test_interleave_refinement(monkeypatch):
    """The merged interleave sorts the suffixes of all shards, its common prefixes are those of neighbours, and a wrong shard order gives wrong results."""
    from claimloom.llm import bwt_merge

    rng = np.random.default_rng(2)
    step, size = 2, 4
    strings = [rng.integers(1, 4, rng.integers(5, 30)) for _ in range(12)]
    shards = []
    for part in (strings[:5], strings[5:8], strings[8:]):
        symbol = np.concatenate([np.append(x, [0] * step) for x in part])
        ends = np.cumsum([len(x) + step for x in part])
        starts = np.concatenate([[0], ends[:-1]])
        length = ends - starts
        start, end = np.repeat(starts, length), np.repeat(ends, length)
        order = bwt_merge.shard_order(symbol, end, step, size)
        shards.append((symbol, start, end, order))

    def key(shard, p):
        symbol, _, end, _ = shard
        return tuple(int(symbol[q]) for q in range(p, int(end[p]), step))[:size]

    def keys_of(transforms):
        of, common = bwt_merge.merged(transforms, size)
        place = [0] * len(shards)
        out = []
        for k in of.tolist():
            out.append(key(shards[k], int(shards[k][3][place[k]])))
            place[k] += 1
        return out, common

    transforms = [bwt_merge.transform(symbol, start, order, step) for symbol, start, _, order in shards]
    keys, common = keys_of(transforms)
    assert keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], common[1:].tolist(), strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (size if a == b else same) or not a[0]
    keys, _ = keys_of([rng.permutation(t) for t in transforms])
    assert keys != sorted(keys)


def test_hot_anchors(docs, monkeypatch):
    """Windows of hot anchors, dealt by classes of distances, give what anchors give."""
    before = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == before


def test_few_rows_and_one_copy_of_a_text_cross_to_a_worker_at_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(600)], "doc_id long, text string")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    for plan in (lambda: jaccard.one_of_each(docs), lambda: byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)):
        common.small_batches(spark)
        plan().count()
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= common.FEW_ROWS
    rows = docs.selectExpr("struct(*) as row", "doc_id as i")
    noded = jaccard._with_node(rows, 5, "text")
    assert noded.columns == ["row", "i", "node"]
    assert noded.where("node is null").count() == 0
