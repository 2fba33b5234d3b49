"""Quality rules with thresholds that adapt to each language and source.

Fixed rules (base_failed) reject very short and very repetitive texts. On top, four
rates of every text are counted into mergeable quantile sketches, one for each
(lang, source, rate): histograms whose bins are exact below EXACT and then
grow by a part of 1 / STEPS, so any two sketches add up to the sketch of
both, in any order, and a quantile is within that part of the true one. Texts that fail
the fixed rules are not counted. A text fails where a rate lies beyond the median of its
group by REACH times the spread between the median and the upper (or lower) quantile, and
beyond a least distance, which only a very uniform group comes to. The sketches of a
language's groups add up to its own, and all of them to the corpus's: the same rule with a
wider least distance gives limits of these, and no group's limit lies beyond them, so a
dirty or tiny group does not set its own. Words of other languages differ in length, so
that rate is bounded by the language alone. The thresholds are joined to the rates by
(lang, source).

Cases: a null text has no words, which fails. Null lang and source are groups of
their own. Of a language with one source only the corpus bounds the limits. A single
repeated line or stretch is chance, however short its text (CHANCE). Texts of
any length are read whole. Rows are independent but for the sketches, so repeated
rows count repeatedly. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import discard, small_batches, worker, written
from claimloom.llm.kernel import LEADS, PLAIN, mix, owners, prefix_sums, rolled, slices, span_hashes, spans, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

EXACT, STEPS = 64, 32
REACH = 8
MEDIAN, UPPER, LOWER = 0.5, 0.75, 0.25
#: Rates in whole numbers, and how far beyond the median of its language or the corpus a text of any group may lie.
RATES = {
    "symbol_rate": ("1000 * n_symbols", "n_words", 150, None),
    "dup_line_rate": ("1000 * n_dup_lines", "n_lines", 400, None),
    "repeat_rate": ("1000 * n_repeat_words", "n_words", 290, None),
    "word_length": ("100 * word_chars", "n_words", 500, 250),
}
#: How far beyond the median of its own group a text may lie, if the group is uniform.
NEAR = {"symbol_rate": 50, "dup_line_rate": 250, "repeat_rate": 100, "word_length": 100}
#: Fewer than these are one event: a line that comes twice, a stretch of REPEAT_WINDOW or more words that comes twice.
CHANCE = {"dup_line_rate": ("n_dup_lines", 2), "repeat_rate": ("n_repeat_words", 4 * REPEAT_WINDOW)}
#: Rates that the whole corpus bounds too.
OF_ALL = ("symbol_rate", "dup_line_rate", "repeat_rate")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _same_in_text(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an equal element stands earlier in its text, whether one stands anywhere else in it)."""
    key = mix(hashes ^ (doc.astype(np.uint64) << np.uint64(40)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    if len(key):
        again[1:] = key[order][1:] == key[order][:-1]
    earlier, both = np.empty(len(key), bool), np.empty(len(key), bool)
    earlier[order] = again
    both[order] = again | np.append(again[1:], False)
    return earlier, both


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS of each text of a slice, one row a text."""
    n = len(offs) - 1
    starts, ends, bounds = spans(data, offs, PLAIN)
    in_texts = lambda mark: (c := np.concatenate([[0], np.cumsum(mark)]))[offs[1:]] - c[offs[:-1]]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    sums = prefix_sums(data)

    not_newline = np.ones(256, bool)
    not_newline[0x0A] = False
    l_starts, l_ends, l_bounds = spans(data, offs, not_newline)
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_doc = owners(l_bounds)[worded]
    earlier, _ = _same_in_text(span_hashes(sums, l_starts[worded], l_ends[worded]), l_doc)

    at, w_doc = windows(bounds, REPEAT_WINDOW)
    _, twice = _same_in_text(rolled(span_hashes(sums, starts, ends), REPEAT_WINDOW)[at], w_doc)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.subtract.at(cover, at[twice] + REPEAT_WINDOW, 1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.stack(
        [
            np.diff(bounds),
            in_texts(LEADS[data] & PLAIN[data]),
            in_texts(symbol[data]),
            np.bincount(l_doc[earlier], minlength=n),
            np.bincount(owners(bounds)[covered], minlength=n),
            np.bincount(l_doc, minlength=n),
        ],
        axis=1,
    ).astype(np.int64)


def measured(docs: DataFrame, text_col: str, keep: list) -> DataFrame:
    """The kept columns, renamed k0, k1, ..., and COUNTS of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]

    def run(batches):
        for b in batches:
            parts = [measure(data, offs) for _, _, data, offs in slices(b.column(len(names)))]
            table = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *parts])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(table[:, i]) for i in range(len(COUNTS)))], names=[*names, *COUNTS])

    return rows.mapInArrow(worker(run), ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))


def bin_of(value: str) -> str:
    """The sketch's bin of a whole number: the number itself, or its exponent and STEPS parts of it."""
    e = f"(cast(length(bin({value})) as int) - {STEPS.bit_length()})"
    return f"case when {value} < {EXACT} then {value} else {e} * {STEPS} + shiftright({value}, {e}) end"


def bin_start(b: str) -> str:
    """The least number of a bin."""
    e = f"cast(div({b}, {STEPS}) - 1 as int)".replace("div(", "floor(").replace(f", {STEPS})", f" / {STEPS})")
    return f"case when {b} < {EXACT} then cast({b} as bigint) else shiftleft(cast({b} - {e} * {STEPS} as bigint), {e}) end"


def base_failed() -> Column:
    """The fixed rules."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _limits(sketch: DataFrame, keys: list[str], ends: dict[str, tuple[int, int | None]], mark: str) -> DataFrame:
    """For each of keys, {rate}_most and {rate}_least (each with mark) from the sums of the sketches that share the keys; ends: the least distances of each rate."""
    summed = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*keys, "rate")
    ranked = summed.withColumn("below", F.sum("n").over(one.orderBy("bin"))).withColumn("total", F.sum("n").over(one)).withColumn("start", F.expr(bin_start("bin")))
    at = lambda q: F.min(F.when(F.col("below") >= F.col("total") * q, F.col("start")))
    limits = ranked.groupBy(*keys, "rate").agg(at(MEDIAN).alias("median"), at(UPPER).alias("upper"), at(LOWER).alias("lower"))
    out = []
    for r, (above, below) in ends.items():
        pick = lambda x, r=r: F.max(F.when(F.col("rate") == r, x))
        out.append(pick(F.col("median") + F.greatest((F.col("upper") - F.col("median")) * REACH, F.lit(above))).alias(f"{r}_most{mark}"))
        if below is not None:
            out.append(pick(F.col("median") - F.greatest((F.col("median") - F.col("lower")) * REACH, F.lit(below))).alias(f"{r}_least{mark}"))
    return limits.groupBy(*keys).agg(*out)


def thresholds(rates: DataFrame) -> DataFrame:
    """For each (lang, source), the limits of its rates, from sketches that add up over tasks, groups and languages."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES]))
    bins = rates.where(~base_failed()).select("lang", "source", each.alias("x")).select("lang", "source", "x.rate", "x.value").withColumn("bin", F.expr(bin_of("value")))
    sketch = written(bins.groupBy("lang", "source", "rate", "bin").agg(F.count("*").alias("n")), "sketch")
    wide = {r: (above, below) for r, (_, _, above, below) in RATES.items()}
    group = _limits(sketch, ["lang", "source"], {r: (NEAR[r], None if below is None else NEAR[r]) for r, (_, below) in wide.items()}, "")
    language = _limits(sketch, ["lang"], wide, "_l").withColumnRenamed("lang", "b_lang")
    corpus = _limits(sketch, [], {r: wide[r] for r in OF_ALL}, "_c")
    joined = group.join(language, F.col("lang").eqNullSafe(F.col("b_lang"))).crossJoin(corpus)
    out = []
    for r, (_, below) in wide.items():
        out.append(F.least(f"{r}_most", f"{r}_most_l", *([f"{r}_most_c"] if r in OF_ALL else [])).alias(f"{r}_most"))
        if below is not None:
            out.append(F.greatest(f"{r}_least", f"{r}_least_l").alias(f"{r}_least"))
    return joined.select("lang", "source", *out)


def with_rates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({r: F.expr(f"coalesce(cast(floor(try_divide({a}, {b})) as bigint), 0L)") for r, (a, b, _, _) in RATES.items()})


def limits_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(a table of every document's id, lang, source, COUNTS and rates; a table of each group's limits)."""
    rows = measured(docs, text_col, [F.col(id_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string")])
    rates = written(with_rates(rows.withColumnsRenamed({"k0": "doc_id", "k1": "lang", "k2": "source"})), "rates")
    return rates, written(thresholds(rates).withColumnsRenamed({"lang": "l_lang", "source": "l_source"}), "limits")


def verdict(rates: DataFrame, limits: DataFrame) -> DataFrame:
    """rates with base_failed, kept and failed (the rates beyond their limits)."""
    joined = rates.join(limits, F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source")), "left")
    beyond = []
    for r, (_, _, _, below) in RATES.items():
        over = F.col(r) > F.col(f"{r}_most")
        if r in CHANCE:
            over &= F.col(CHANCE[r][0]) >= CHANCE[r][1]
        beyond.append(F.when(over if below is None else over | (F.col(r) < F.col(f"{r}_least")), F.lit(r)))
    base = base_failed()
    failed = F.array_compact(F.array(*beyond))
    return joined.select(*rates.columns, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, lang, source, COUNTS, the rates, base_failed, kept and failed (the rates beyond their limits)."""
    return verdict(*limits_of(docs, text_col, lang_col, source_col, id_col))


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Rates are measured again beside the rows, so texts are not shuffled."""
    rates, limits = limits_of(docs, text_col, lang_col, source_col, id_col)
    discard(rates)
    rows = measured(docs, text_col, [F.struct("*"), F.col(lang_col).cast("string"), F.col(source_col).cast("string")])
    return verdict(with_rates(rows.withColumnsRenamed({"k1": "lang", "k2": "source"})), limits).where("kept").select("k0.*")
