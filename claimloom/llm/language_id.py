"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every byte, white space included, a distribution over
the languages; a document's probabilities are the mean over all its bytes. It is trained in numpy by
backpropagation through time.

Reading. A text is cut into rows of CORE bytes, which are read together. Each direction begins CONTEXT bytes before a
row's own bytes, so its state has seen what stands before them; beyond a text's ends it reads a symbol of its own. ASCII
capitals are read in lower case.

Training. Of each language the TRAIN_DOCS labelled documents with the least hashes of their ids, or about as many,
give TRAIN_WINDOWS windows of WINDOW characters each, evenly spread over the text: a bounded sample for the driver,
whatever the sizes of languages and texts. Languages are drawn with equal shares.

Cases: a null text, and a text without a letter, is "und" with score 0. With no labelled
document every text is "und". Any id may be null or repeated; rows are
independent of one another. Texts of any length are read whole. An empty table gives
an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import small_batches, worker
from claimloom.llm.kernel import LOWER, slices

#: The bounded sample that training draws from, for each language.
TRAIN_DOCS, TRAIN_WINDOWS, WINDOW = 400, 8, 72
#: Bytes of a row, and those before and behind it that each direction reads first.
CORE, CONTEXT = 240, 16
HIDDEN = 8
STEPS, BATCH, RATE = 220, 256, 0.02
SEED = 7
#: The symbol beyond a text's ends.
OUTSIDE = 256
ROWS = 2048
SLICE = 4 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """A gated recurrent layer that reads bytes in one direction."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.params = {
            "x": rng.normal(0, 0.3, (OUTSIDE + 1, 3 * hidden)).astype(np.float32),
            "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "c": np.zeros(3 * hidden, np.float32),
        }

    def steps(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The state of all rows after each of their bytes; the array is used again. The gates' halves and constants are put into the tables."""
        p, n = self.params, self.h
        half = np.repeat(np.float32([0.5, 1]), [2 * n, n])
        table, u, c = p["x"] * half, p["u"] * half, p["c"][2 * n :]
        table[:, : 2 * n] += 0.5 * p["c"][: 2 * n]
        h = np.zeros((len(rows), n), np.float32)
        x, a = (np.empty((len(rows), 3 * n), np.float32) for _ in range(2))
        for t in range(rows.shape[1]):
            np.take(table, rows[:, t], axis=0, out=x, mode="clip")
            np.matmul(h, u, out=a)
            g, new, past = x[:, : 2 * n], x[:, 2 * n :], a[:, 2 * n :]
            g += a[:, : 2 * n]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            past += c
            past *= g[:, n:]
            new += past
            np.tanh(new, out=new)
            h -= new
            h *= g[:, :n]
            h += new
            yield h

    def forward(self, words: np.ndarray, keep: bool = False):
        """States after each byte of words (rows of equal length): an array (length, rows, hidden)."""
        p, n = self.params, self.h
        h = np.zeros((len(words), n), np.float32)
        states, tape = [], []
        for t in range(words.shape[1]):
            x = p["x"][words[:, t]]
            a = h @ p["u"] + p["c"]
            gates = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
            if keep:
                tape.append((h, z, r, new, a[:, 2 * n :]))
            h = new + z * (h - new)
            states.append(h)
        return np.stack(states), tape

    def backward(self, words: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time; grad is the loss's gradient by each state."""
        p, n = self.params, self.h
        out = {k: np.zeros_like(v) for k, v in p.items()}
        later = np.zeros((len(words), n), np.float32)
        for t in range(words.shape[1] - 1, -1, -1):
            h, z, r, new, a_new = tape[t]
            d = grad[t] + later
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_new * a_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(out["x"], words[:, t], d_x)
            out["u"] += h.T @ d_a
            out["c"] += d_a.sum(0)
            later = d * z + d_a @ p["u"].T
        return out


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.there, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = {"w": rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def _labels(self, words: np.ndarray, keep: bool = False):
        there, tape = self.there.forward(words, keep)
        back, tape_back = self.back.forward(words[:, ::-1], keep)
        both = np.concatenate([there, back[::-1]], axis=2)
        logits = both @ self.out["w"] + self.out["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, tape, tape_back

    def label(self, words: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte: an array (rows, length, languages)."""
        return self._labels(words)[0].transpose(1, 0, 2)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The sums of the distributions over the bytes of each row that lie in its text, without the CONTEXT at both ends."""
        n, size = self.there.h, rows.shape[1] - 2 * CONTEXT
        there = np.empty((size, len(rows), n), np.float32)
        for t, h in enumerate(self.there.steps(rows[:, : CONTEXT + size])):
            if t >= CONTEXT:
                there[t - CONTEXT] = h
        out = np.zeros((len(rows), len(self.languages)), np.float32)
        back = rows[:, : CONTEXT - 1 : -1]
        for t, h in enumerate(self.back.steps(back)):
            if t >= CONTEXT:
                e = there[size - 1 - (t - CONTEXT)] @ self.out["w"][:n] + h @ self.out["w"][n:] + self.out["b"]
                e -= e.max(axis=1, keepdims=True)
                np.exp(e, out=e)
                e *= ((back[:, t] != OUTSIDE) / e.sum(axis=1))[:, None].astype(np.float32)
                out += e
        return out

    def gradients(self, words: np.ndarray, language: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """The mean cross entropy over all bytes of texts, and its gradients."""
        p, both, tape, tape_back = self._labels(words, keep=True)
        inside = (words.T != OUTSIDE).astype(p.dtype)
        picked = np.arange(p.shape[1])
        loss = -float((np.log(p[:, picked, language] + 1e-9) * inside).sum() / inside.sum())
        d = p.copy()
        d[:, picked, language] -= 1
        d *= inside[:, :, None] / inside.sum()
        n = self.there.h
        d_both = d @ self.out["w"].T
        out = {"w": np.einsum("tbi,tbj->ij", both, d, optimize=True), "b": d.sum((0, 1))}
        return loss, [self.there.backward(words, tape, d_both[:, :, :n]), self.back.backward(words[:, ::-1], tape_back, d_both[::-1, :, n:]), out]

    def fit(self, windows: np.ndarray, language: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Train with Adam on windows (rows of bytes) and their languages' numbers, languages in equal shares; returns the losses."""
        rng = np.random.default_rng(seed)
        groups = [self.there.params, self.back.params, self.out]
        moment = [[{k: np.zeros_like(v) for k, v in g.items()} for g in groups] for _ in range(2)]
        of = [np.flatnonzero(language == k) for k in range(len(self.languages))]
        of = [x for x in of if len(x)]
        losses = []
        for step in range(1, steps + 1):
            at = np.concatenate([x[rng.integers(0, len(x), -(-batch // len(of)))] for x in of])
            loss, grads = self.gradients(windows[at], language[at])
            losses.append(loss)
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for g, d, m, v in zip(groups, grads, *moment, strict=True):
                for k in g:
                    m[k] = 0.9 * m[k] + 0.1 * d[k]
                    v[k] = 0.99 * v[k] + 0.01 * d[k] ** 2
                    g[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return losses


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of texts, CORE bytes each with CONTEXT before and behind, and the text of each row."""
    n = -(-np.diff(offs) // CORE)
    text = np.repeat(np.arange(len(n)), n)
    first = offs[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * CORE
    at = first[:, None] + np.arange(-CONTEXT, CORE + CONTEXT)
    inside = (at >= offs[:-1][text][:, None]) & (at < offs[1:][text][:, None])
    return np.where(inside, LOWER[data].astype(np.int64)[np.clip(at, 0, max(len(data) - 1, 0))], OUTSIDE), text


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, train_docs: int) -> list[tuple[str, list[str]]]:
    """(language, windows) of about train_docs documents of each language: those with the least hashes of their ids, never more than train_docs."""
    h = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col).cast("string")), F.lit(1 << 40))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(h.alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return []
    below = docs.sparkSession.createDataFrame([(k, int(min(1.0, 1.3 * train_docs / n) * (1 << 40))) for k, n in held.items()], "b_lang string, below long")
    chosen = rows.join(F.broadcast(below), F.col("lang") == F.col("b_lang")).where("h < below")  # a row a language
    spread = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring("text", F.floor(i * F.length("text") / TRAIN_WINDOWS).cast("int") + 1, F.lit(WINDOW)))
    found: dict[str, list] = {}
    for r in chosen.select("h", "lang", F.array_distinct(spread).alias("windows")).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["windows"]))
    return [(k, w) for k in sorted(found) for _, w in sorted(found[k])[:train_docs]]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network for the languages of docs, or none where no row is labelled. At most train_docs documents of a language are learned from."""
    found = sample(docs, text_col, lang_col, id_col, train_docs)
    languages = sorted({k for k, _ in found})
    texts = [(languages.index(k), w.encode()) for k, ws in found for w in ws if w]
    if not texts:
        return None
    rows = np.full((len(texts), WINDOW), OUTSIDE, np.int64)
    for row, (_, raw) in zip(rows, texts, strict=True):
        part = LOWER[np.frombuffer(raw[:WINDOW], np.uint8)]
        row[: len(part)] = part
    net = Network(languages)
    net.fit(rows, np.array([k for k, _ in texts]))
    return net


def documents(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each text's probabilities; zeros where it is empty."""
    rows, text = cut(data, offs)
    n, k = len(offs) - 1, len(net.languages)
    sums = np.concatenate([np.zeros((0, k), np.float32), *(net.pooled(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS))])
    total = np.stack([np.bincount(text, sums[:, j], minlength=n) for j in range(k)], axis=1)
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def predict(docs: DataFrame, net: Network | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns (named by their aliases) with lang_pred, score and probs (one probability a language) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*keep, F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("has_letter"), F.col(text_col).alias("read_text"))
    names = rows.columns[:-2]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        languages = np.array(net.languages if net else [], object)
        for b in batches:
            for lo, hi, data, offs in slices(b.column(len(names) + 1), SLICE):
                letters = b.column(len(names)).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                p = documents(net, data, offs) if net else np.zeros((hi - lo, 1))
                known = letters & (p.sum(1) > 0)
                lang = np.where(known, languages[p.argmax(1)] if net else "und", "und")
                kept = [c.slice(lo, hi - lo) for c in b.columns[:-2]]
                probs = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang.tolist(), pa.string()), pa.array(np.where(known, p.max(1), 0.0)), probs], names=[*names, "lang_pred", "score", "probs"])

    return rows.mapInArrow(worker(run), ", ".join([*kinds, "lang_pred string, score double, probs array<double>"]))
