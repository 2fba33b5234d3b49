"""Merging successive valuations of an account into claim histories."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.folds import by_group

AMOUNT = "decimal(28,2)"
UNNAMED = "Insured not named"
FIRST_DAY = "0001-01-01"


def account_name(c: Column) -> Column:
    """The insured's name with white space collapsed; case counts."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t != "", t).otherwise(F.lit(UNNAMED))


def compare_key(c: Column) -> Column:
    """Upper case, spaces collapsed; blank becomes null."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), r"\s+", " "), F.lit(""))


SAYS = ("carrier", "policy", "term")


def same_claim(a: dict, b: dict) -> str:
    """SAME, DISTINCT or UNKNOWN for two appearances of one claim number: carriers must be said; policy or term must agree."""
    for k in SAYS:
        if a[k] is not None and b[k] is not None and a[k] != b[k]:
            return "DISTINCT"
    if a["carrier"] is None or b["carrier"] is None:
        return "UNKNOWN"
    known = any(a[k] is not None and b[k] is not None for k in ("policy", "term"))
    return "SAME" if known else "UNKNOWN"


class _Letterheads:
    """Values of letterheads, each (carrier, policy, term), found by what is printed: those that don't contradict a letterhead without a walk over all."""

    def __init__(self, merge: Callable[[int, int], int]) -> None:
        self.merge, self.tables = merge, {}

    @staticmethod
    def part(says: tuple, keep: tuple) -> tuple:
        return tuple(x if k else None for x, k in zip(says, keep, strict=True))

    def put(self, says: tuple, value: int) -> None:
        own = self.tables.setdefault(tuple(x is not None for x in says), {})
        for keep in product(*((False,) if x is None else (False, True) for x in says)):
            table, key = own.setdefault(keep, {}), self.part(says, keep)
            table[key] = self.merge(table[key], value) if key in table else value

    def near(self, says: tuple) -> set[int]:
        found = set()
        for printed, tables in self.tables.items():
            keep = tuple(p and x is not None for p, x in zip(printed, says, strict=True))
            found.add(tables[keep].get(self.part(says, keep)))
        return found - {None}


SEVERAL = -1


def fold_histories(rows: list[dict]) -> list[tuple[int, bool]]:
    """The history of each appearance, in order, and whether that history is uncertain.

    An appearance joins a history only if it is the one SAME and no history is UNKNOWN; else it begins one, and all
    histories that it might belong to become uncertain with it. A history is the different (carrier, policy, term) of its appearances.

    Histories only grow, so a letterhead that met an UNKNOWN or two SAME joins nothing later either. Of those only the last row is
    kept, from which the uncertain histories follow at the end; so the work grows with the rows and not with their square.
    """
    holders = _Letterheads(lambda a, b: a if a == b else SEVERAL)  # the history that holds a letterhead, or SEVERAL
    histories: list[dict[tuple, int]] = []  # letterheads, and the row that brought each
    first: dict[tuple, int] = {}
    shared: set[tuple] = set()  # letterheads of several histories
    last: dict[tuple, int] = {}  # the last row of letterheads that join nothing
    place: list[int] = []

    def same(h: int, says: tuple) -> bool:
        named = dict(zip(SAYS, says, strict=True))
        return all(same_claim(dict(zip(SAYS, x, strict=True)), named) == "SAME" for x in histories[h])

    for i, row in enumerate(rows):
        says = (row["carrier"], row["policy"], row["term"])
        if says in last:
            near, joins = {SEVERAL}, False
        else:
            near = holders.near(says)
            joins = len(near) == 1 and SEVERAL not in near and same(min(near), says)
        if not joins and near:
            last[says] = i
        h = min(near) if joins else len(histories)
        place.append(h)
        if not joins:
            histories.append({says: i})
        elif says in histories[h]:
            continue
        else:
            histories[h][says] = i
        if says not in shared:
            holders.put(says, h)
            if first.setdefault(says, h) != h:
                shared.add(says)
    doubted = _Letterheads(max)
    for says, i in last.items():
        doubted.put(says, i)
    until = {says: max(doubted.near(says), default=-1) for says in first}
    unsure = [any(until[says] >= i for says, i in h.items()) for h in histories]
    return [(h, unsure[h]) for h in place]


HISTORY = "account string, claim_number string, seq int, row_id long, history int, uncertain boolean"


def histories(appearances: DataFrame) -> DataFrame:
    """The history of each appearance: account, claim_number, seq, row_id, history, uncertain. appearances: account, claim_number, seq (of the source), row_id, carrier, policy_number, term.

    Claims of different numbers are never one, so each (account, claim number) folds alone, in order of the sources.
    """

    def fold(rows: list[dict]) -> list[tuple]:
        return [(r["account"], r["claim_number"], r["seq"], r["row_id"], p, unsure) for r, (p, unsure) in zip(rows, fold_histories(rows), strict=True)]

    rows = appearances.select("account", "claim_number", F.col("seq").cast("int"), F.col("row_id").cast("long"), compare_key(F.col("carrier")).alias("carrier"), compare_key(F.col("policy_number")).alias("policy"), F.col("term").cast("string").alias("term"))
    return by_group(rows, ["account", "claim_number"], ["seq", "row_id"], fold, HISTORY)


SOURCE = ["account", "document_id", "run_id", "filename", "carrier", "insured", "policy_number", "valuation_date", "terms"]
TERM = "struct<start:date,end:date>"


def covers(term: Column, day: Column) -> Column:
    return F.coalesce(day.between(term["start"], term["end"]), F.lit(False))


def term_of(day: Column, terms: Column) -> Column:
    """The one term that covers a day; null where none does, or several do."""
    inside = F.filter(terms, lambda t: covers(t, day))
    return F.when(F.size(inside) == 1, F.get(inside, F.lit(0)))


def sources_of(docs: DataFrame, terms: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The logical runs of each document, with its account and their own facts: a document, or each run of a packet.

    docs: document_id, filename, insured, carrier, policy_number, valuation_date; terms: document_id, term_start, term_end; runs: those of
    packets, document_id, run_id, carrier, insured, policy_number, valuation_date, period_start, period_end.
    """
    term = lambda a, z: F.struct(F.col(a).alias("start"), F.col(z).alias("end")).cast(TERM)
    own = terms.where("term_start is not null and term_end is not null").groupBy("document_id").agg(F.array_sort(F.collect_set(term("term_start", "term_end"))).alias("terms"))
    none = F.array().cast(f"array<{TERM}>")
    named = docs.withColumn("account", account_name(F.col("insured")))
    whole = named.join(own, "document_id", "left").withColumns({"terms": F.coalesce("terms", none), "run_id": F.lit("")})
    if runs is None:
        return whole.select(*SOURCE)
    alone = whole.join(runs.select("document_id").distinct(), "document_id", "left_anti").select(*SOURCE)
    one = F.when(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), F.array(term("period_start", "period_end"))).otherwise(none)
    return alone.unionByName(runs.withColumn("terms", one).join(named.select("document_id", "account", "filename"), "document_id").select(*SOURCE))


def in_order(sources: DataFrame) -> DataFrame:
    """Sources with seq, their place in the account: by valuation, undated ones first, then file name and run, as texts."""
    order = Window.partitionBy("account").orderBy(F.coalesce("valuation_date", F.lit(FIRST_DAY).cast("date")), "filename", "run_id")
    return sources.withColumn("seq", F.row_number().over(order))


def appearances(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims as their sources recorded them, with the term that covers the loss. claims: document_id, run_id and others; sources: with seq."""
    facts = sources.select("document_id", "run_id", "account", "filename", "carrier", "policy_number", "valuation_date", "terms", "seq", *([c for c in ("trusted",) if c in sources.columns]))
    rows = claims.drop("carrier", "policy_number", "valuation_date", "account").join(facts, ["document_id", "run_id"])
    return rows.withColumn("term", term_of(F.col("date_of_loss"), F.col("terms")))


def rollup(appeared: DataFrame, placed: DataFrame) -> DataFrame:
    """One row for each history: its current claim (the last appearance), when it was valued, its movement, carriers and trust.

    appeared: appearances with trusted; placed: histories of them. movement is null with one appearance, or where the first or last amount is.
    """
    both = appeared.join(placed, ["account", "claim_number", "seq", "row_id"])
    facts = ["seq", "row_id", "document_id", "run_id", "valuation_date", "claim_status", "date_of_loss", "incurred_total", "carrier", "policy_number", "term", "terms"]
    place = F.struct(*facts)
    g = both.groupBy("account", "claim_number", "history").agg(
        F.count("*").alias("appearances"), F.min_by("incurred_total", F.struct("seq", "row_id")).alias("earliest"), F.max_by(place, F.struct("seq", "row_id")).alias("last"),
        F.bool_or("uncertain").alias("uncertain"), F.bool_and("trusted").alias("sources_trusted"), F.sort_array(F.collect_set(F.nullif(F.col("carrier"), F.lit("")))).alias("carriers"),
    )
    movement = F.when(F.col("appearances") > 1, (F.col("last.incurred_total") - F.col("earliest")).cast(AMOUNT))
    trusted = ~F.col("uncertain") & F.col("sources_trusted")
    return g.select("account", "claim_number", "history", "appearances", "uncertain", trusted.alias("trusted"), "carriers", "earliest", movement.alias("movement"), *[F.col(f"last.{c}").alias(c) for c in facts])


def developed(rolled: DataFrame) -> DataFrame:
    """Histories that moved, with place: the biggest movement of an account first."""
    order = Window.partitionBy("account").orderBy(F.abs("movement").desc(), F.coalesce("date_of_loss", F.lit(FIRST_DAY).cast("date")), "claim_number", "history")
    return rolled.where("movement <> 0").withColumn("place", F.row_number().over(order))


def by_loss(rolled: DataFrame) -> DataFrame:
    """Histories with place, their order in an account: by current date of loss, undated ones first, and claim number."""
    return rolled.withColumn("place", F.row_number().over(Window.partitionBy("account").orderBy(F.coalesce("date_of_loss", F.lit(FIRST_DAY).cast("date")), "claim_number", "history")))


def omitted(rolled: DataFrame, appeared: DataFrame, sources: DataFrame) -> DataFrame:
    """Histories that a later source of the account should show and none does, with the columns of rolled.

    Later is by the order of sources. A history is omitted if a later source covers its loss, may hold the claim (carrier, policy and term
    don't contradict it), and no later source that covers the loss shows the claim number. Sources that say the same are
    one row, with the last of their places, so a history meets an account's different letterheads and not all its documents.
    """
    key = ["account", "claim_number", "history"]
    own = rolled.select(*key, "seq", "date_of_loss", compare_key(F.col("carrier")).alias("carrier"), compare_key(F.col("policy_number")).alias("policy"), "term")
    showing = appeared.groupBy("account", "claim_number", "terms").agg(F.max("seq").alias("s_seq"))
    inside = lambda terms: F.exists(terms, lambda t: covers(t, F.col("date_of_loss")))
    shown = own.select(*key, "seq", "date_of_loss").join(showing, ["account", "claim_number"]).where((F.col("s_seq") > F.col("seq")) & inside(F.col("terms"))).select(*key).distinct()
    letterheads = sources.groupBy("account", compare_key(F.col("carrier")).alias("s_carrier"), compare_key(F.col("policy_number")).alias("s_policy"), "terms").agg(F.max("seq").alias("s_seq")).where("size(terms) > 0")
    probe = term_of(F.col("date_of_loss"), F.col("terms"))
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    other = differ(F.col("carrier"), F.col("s_carrier")) | differ(F.col("policy"), F.col("s_policy")) | differ(F.col("term").cast("string"), probe.cast("string"))
    may = own.join(letterheads, "account").where((F.col("s_seq") > F.col("seq")) & inside(F.col("terms")) & ~other).select(*key).distinct()
    return rolled.join(may, key, "left_semi").join(shown, key, "left_anti")


def reasons(sources: DataFrame, rolled: DataFrame) -> DataFrame:
    """Accounts with status and the reasons why their merged history needs review, in order. sources: with seq, status (null where not reconciled)."""
    where = F.concat(F.col("filename"), F.when(F.col("run_id") != "", F.concat(F.lit(" "), "run_id")).otherwise(""))
    bad = F.when(F.col("status").isNull(), F.concat(where, F.lit(": not reconciled"))).when(F.col("status") != "CLEAN", F.concat(where, F.lit(": needs review")))
    named, own = compare_key(F.col("insured")), compare_key(F.col("account"))
    stranger = F.when(named.isNotNull() & (F.col("account") != UNNAMED) & (named != own), F.concat(where, F.lit(": names another insured")))
    said = F.array_compact(F.array(F.when(bad.isNotNull(), F.struct("seq", F.lit(0).alias("k"), bad.alias("said"))), F.when(stranger.isNotNull(), F.struct("seq", F.lit(1).alias("k"), stranger.alias("said")))))
    a = sources.groupBy("account").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("sources"), F.transform(F.sort_array(F.flatten(F.collect_list(said))), lambda x: x["said"]).alias("said"))
    numbers = rolled.where("uncertain").groupBy("account").agg(F.array_join(F.slice(F.sort_array(F.collect_set("claim_number")), 1, 8), ", ").alias("numbers"))
    unsure = F.when(F.col("numbers").isNotNull(), F.array(F.concat(F.lit("carrier or policy not printed on every run for claim(s) "), "numbers", F.lit(": one claim counted twice, or two claims sharing a number"))))
    every = a.join(numbers, "account", "left").withColumn("reasons", F.concat("said", F.coalesce(unsure, F.array().cast("array<string>"))))
    return every.select("account", "documents", "sources", "reasons", F.when(F.size("reasons") > 0, "NEEDS_REVIEW").otherwise("CLEAN").alias("status"))


def largest_first(accounts: DataFrame) -> DataFrame:
    """Accounts with place: by documents, most first, and name."""
    return accounts.orderBy(F.desc("documents"), "account")


def development(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each history's first, last and movement of incurred: null with one appearance, or where the first or last is. rows: keys, incurred_total, valuation_date, document_id, row_id."""
    order = [F.coalesce("valuation_date", F.lit(FIRST_DAY).cast("date")), F.col("document_id"), F.col("row_id")]
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("incurred_total").alias("amount"))
    g = rows.groupBy(*keys).agg(F.count("*").alias("appearances"), F.min(place).alias("a"), F.max(place).alias("z"))
    return g.select(*keys, "appearances", F.col("a.amount").alias("earliest"), F.col("z.amount").alias("latest"), F.when(F.col("appearances") > 1, (F.col("z.amount") - F.col("a.amount")).cast(AMOUNT)).alias("movement"))


def current_claims(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last appearance of each history."""
    last = Window.partitionBy(*keys).orderBy(F.coalesce("valuation_date", F.lit(FIRST_DAY).cast("date")).desc(), F.desc("document_id"), F.desc("row_id"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
