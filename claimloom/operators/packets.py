"""Packets: several reports in one file, told apart by what is printed on their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.folds import by_group

RUN = "document_id long, page int, run int, evidence string, ambiguous boolean"


def plan_runs(pages: DataFrame) -> DataFrame:
    """The run of each page. pages: document_id, page, k, n (the printed 'page k of n', null where none), heading, policy.

    A page that continues the printed count stays; one that begins a count anew, or whose count is another, opens a run.
    Without a printed count a page stays where its heading and policy say nothing else; a page that says nothing
    at all stays too, and marks its run as ambiguous. The walk depends on the page before, so each document folds alone.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        run, last, out, unsure = 0, None, [], set()
        for p in rows:
            why = "first"
            if last is not None:
                if p["k"] is not None and last["k"] is not None and p["n"] == last["n"] and p["k"] == last["k"] + 1:
                    why = "printed"
                elif p["k"] is not None:
                    run, why = run + 1, "printed"
                elif last["n"] is not None and last["k"] is not None and last["k"] >= last["n"]:
                    run, why = run + 1, "exhausted"
                elif any(p[x] is not None and last[x] is not None and p[x] != last[x] for x in ("heading", "policy")):
                    run, why = run + 1, "heading"
                elif p["heading"] is None and p["policy"] is None:
                    why = "silent"
                    unsure.add(run)
                else:
                    why = "heading"
            kept = {x: p[x] if p[x] is not None or why in ("first", "exhausted") or (last is None) else last[x] for x in ("heading", "policy")}
            last = {**p, **kept}
            out.append((p["document_id"], p["page"], run, why))
        return [(d, pg, r, w, r in unsure) for d, pg, r, w in out]

    return by_group(pages.select("document_id", "page", "k", "n", "heading", "policy"), ["document_id"], ["page"], walk, RUN)


def incomplete_runs(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs whose printed count promises more pages than they hold."""
    both = planned.join(pages.select("document_id", "page", "n"), ["document_id", "page"])
    return both.groupBy("document_id", "run").agg(F.count("*").alias("held"), F.max("n").alias("promised"), F.bool_or("ambiguous").alias("ambiguous")).withColumn("incomplete", F.coalesce(F.col("promised") > F.col("held"), F.lit(False)))


def borrowed_votes(runs: DataFrame) -> DataFrame:
    """The run whose vote an unsettled run takes: the last settled one before it. runs: document_id, run, ambiguous."""
    order = Window.partitionBy("document_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("vote_of", F.last(F.when(~F.col("ambiguous"), F.col("run")), True).over(order))


def run_view(claims: DataFrame, run_pages: DataFrame) -> DataFrame:
    """Claims with the run that holds their page."""
    return claims.drop("run_id").join(run_pages.select("document_id", "page", "run_id"), ["document_id", "page"])
