"""Deterministic selection of windows: hash-ordered frontier, then greedy choice under constraints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence, intervals
from tracequill.functions import canonical
from tracequill.sources.storage import cut


@dataclass(frozen=True)
class Rules:
    half_window: int = 12_500
    least_assessable: int = 5_000
    per_contig: int = 2
    per_context: int = 10
    cross_overlap: int = 12_500
    last_limit: int = 320_000
    least_contigs: int = 1


def candidates(anchors: DataFrame, cover: DataFrame, payload: dict, prefix: str, salt: str, rules: Rules = Rules()) -> DataFrame:
    """Windows around anchors (contig, start, end, ordinal) with enough assessable positions.

    payload: constants of the candidate's identity beside contig, start and end. Anchors that make
    the same window are one candidate; the first in file order stands for it.
    """
    windows = intervals.windows_at(anchors, rules.half_window, keep=["ordinal"])
    first = F.min(F.struct("ordinal", "anchor_start", "anchor_end"))
    windows = windows.groupBy("contig", "start", "end").agg(first.alias("a")).select("contig", "start", "end", "a.*")
    constants = {k: F.lit(v) for k, v in payload.items()}
    identity = canonical.content_id(prefix, constants | {"chromosome": F.col("contig"), "nominal_start_0based": F.col("start"), "nominal_end_0based": F.col("end")})
    windows = windows.withColumn("candidate_id", identity).withColumn("selection_hash", canonical.selection_hash(salt, F.col("candidate_id")))
    covered = intervals.covered_length(windows, cover, "candidate_id").withColumnRenamed("candidate_id", "c_id")
    rows = windows.join(covered, F.col("candidate_id") == F.col("c_id")).drop("c_id").withColumnRenamed("covered", "assessable_bp")
    return rows.filter(F.col("assessable_bp") >= rules.least_assessable)


def frontier(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` candidates with the smallest selection hashes, in their order."""
    return rows.orderBy("selection_hash", "candidate_id").limit(limit)


def _overlap(a: dict, b: dict) -> int:
    return max(0, min(a["end"], b["end"]) - max(a["start"], b["start"])) if a["contig"] == b["contig"] else 0


def greedy(ordered: Iterable[dict], earlier: list[dict], rules: Rules = Rules()) -> tuple[list[dict], list[dict]]:
    """selected and evaluated rows; stops when a context is full. Works on rows in their order, one at a time."""
    selected: list[dict] = []
    evaluated: list[dict] = []
    of_contig: Counter = Counter()
    for rank, row in enumerate(ordered, 1):
        if of_contig[row["contig"]] >= rules.per_contig:
            why = "MAX_WINDOWS_PER_CHROMOSOME"
        elif any(_overlap(row, s) > 0 for s in selected):
            why = "WITHIN_CONTEXT_OVERLAP"
        elif any(_overlap(row, s) >= rules.cross_overlap for s in earlier):
            why = "CROSS_CONTEXT_OVERLAP_GE_50_PERCENT"
        else:
            why = ""
        evaluated.append(row | {"evaluation_rank": rank, "decision": "REJECTED" if why else "SELECTED", "rejection_reason": why})
        if not why:
            of_contig[row["contig"]] += 1
            selected.append(row | {"selection_rank": len(selected) + 1, "chromosome_selection_rank": of_contig[row["contig"]]})
            if len(selected) == rules.per_context:
                break
    return selected, evaluated


def select_context(rows: DataFrame, earlier: list[dict], rules: Rules = Rules()) -> tuple[list[dict], list[dict]]:
    """Greedy choice over the frontier of last_limit rows, which are ordered once and stream to the driver until it is full.

    A context that can't be filled from it, or whose windows lie on too few contigs, fails.
    """
    selected, evaluated = greedy((r.asDict() for r in frontier(rows, rules.last_limit).toLocalIterator()), earlier, rules)
    if len(selected) < rules.per_context:
        raise ValueError(f"{len(selected)} of {rules.per_context} windows after {len(evaluated)} candidates")
    if (contigs := len({s["contig"] for s in selected})) < rules.least_contigs:
        raise ValueError(f"windows on {contigs} contigs, {rules.least_contigs} are asked for")
    return selected, evaluated


def _overlaps(taken: str, least: int) -> Column:
    """Whether a window of the array ``taken`` overlaps the row's by ``least`` positions or more."""
    return F.coalesce(F.exists(taken, lambda w: intervals.overlap_length(F.col("start"), F.col("end"), w["start"], w["end"]) >= least), F.lit(False))


def _of_contig(rows: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """rows with an array of the windows on their contig; windows are few on a contig, by the rules' quotas."""
    marks = windows.groupBy("contig").agg(F.collect_list(F.struct("selection_hash", "candidate_id", "start", "end")).alias(name))
    return rows.join(marks, "contig", "left")


def _free(rows: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    return _of_contig(rows, windows, "__taken").filter(~_overlaps("__taken", least)).drop("__taken")


def winners(rows: DataFrame, earlier: DataFrame, rules: Rules) -> DataFrame:
    """contig and window of the choice in each contig of one context, as if the context were never full.

    Contigs don't bear on each other until the context is full. The next window of a contig is its free candidate with the
    least hash: those before it are taken or overlap what is. So a round is one minimum by contig over all
    candidates at once, and there are as many rounds as a contig may have windows.
    """
    rows = _free(rows, earlier, rules.cross_overlap)
    taken = None
    for _ in range(rules.per_contig):
        free = rows if taken is None else _free(rows, taken, 1)
        best = free.groupBy("contig").agg(F.min(F.struct("selection_hash", "candidate_id", "start", "end")).alias("w")).select("contig", "w.*")
        taken = cut(best if taken is None else taken.unionByName(best))
    return taken


def evaluation(rows: DataFrame, selected: DataFrame, earlier: DataFrame, rules: Rules) -> DataFrame:
    """The candidates up to the last selected one in their order, each with its rank, decision and the first reason against it."""
    last = selected.agg(F.max(F.struct("selection_hash", "candidate_id")).alias("w")).select("w.*").first()  # one row
    seen = rows.filter((F.col("selection_hash") < last[0]) | ((F.col("selection_hash") == last[0]) & (F.col("candidate_id") <= last[1])))
    seen = _of_contig(_of_contig(seen, selected, "__own"), earlier, "__earlier")
    mine = F.struct("selection_hash", "candidate_id")
    seen = seen.withColumn("__own", F.filter("__own", lambda w: F.struct(w["selection_hash"], w["candidate_id"]) < mine))
    why = F.when(F.size("__own") >= rules.per_contig, "MAX_WINDOWS_PER_CHROMOSOME").when(_overlaps("__own", 1), "WITHIN_CONTEXT_OVERLAP").when(_overlaps("__earlier", rules.cross_overlap), "CROSS_CONTEXT_OVERLAP_GE_50_PERCENT").otherwise("")
    seen = seen.withColumn("rejection_reason", why).withColumn("decision", F.when(F.col("rejection_reason") == "", "SELECTED").otherwise("REJECTED")).drop("__own", "__earlier")
    return evidence.numbered(seen, "evaluation_rank", "selection_hash", "candidate_id")


@dataclass
class Panel:
    selected: DataFrame
    evaluated: DataFrame


def panel(candidates: DataFrame, order: list[str], rules: Rules = Rules()) -> Panel:
    """The choice of every context (context_id, candidate_id, selection_hash, contig, start, end), in the order of contexts.

    A context's windows keep their distance from those of the contexts before it. All candidates are looked at, so a choice that
    can be filled is filled; one that can't, or that lies on too few contigs, fails. Beside candidates, only rows that the
    rules bound are moved: per_contig windows a contig and context.
    """
    candidates = cut(candidates.select("context_id", "candidate_id", "selection_hash", "contig", "start", "end"))
    earlier, chosen, evaluated = candidates.limit(0), [], []
    for context in order:
        rows = candidates.filter(F.col("context_id") == context)
        first = winners(rows.drop("context_id"), earlier, rules).orderBy("selection_hash", "candidate_id").limit(rules.per_context)
        ranks = {"selection_rank": Window.orderBy("selection_hash", "candidate_id"), "chromosome_selection_rank": Window.partitionBy("contig").orderBy("selection_hash", "candidate_id")}
        own = cut(first.withColumn("context_id", F.lit(context)).withColumns({name: F.row_number().over(w) for name, w in ranks.items()}))
        n, contigs = own.agg(F.count(F.lit(1)), F.count_distinct("contig")).first()
        if n < rules.per_context:
            raise ValueError(f"{context}: {n} of {rules.per_context} windows")
        if contigs < rules.least_contigs:
            raise ValueError(f"{context}: windows on {contigs} contigs, {rules.least_contigs} are asked for")
        evaluated.append(evaluation(rows, own, earlier, rules))
        chosen.append(own)
        earlier = earlier.unionByName(own.select(earlier.columns))
    return Panel(reduce(DataFrame.unionByName, chosen), reduce(DataFrame.unionByName, evaluated))


def panel_violations(selected: DataFrame, order: list[str], rules: Rules = Rules(), excluded: tuple[str, ...] = ()) -> DataFrame:
    """rule and key of what a panel may not be: short or long contexts, doubled windows, full or few contigs, contigs left out, overlaps."""
    as_rule = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    wanted = selected.sparkSession.createDataFrame([(c,) for c in order], "context_id string")
    of_context = selected.groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contig").alias("contigs"))
    sizes = wanted.join(of_context, "context_id", "full_outer")
    of_contig = selected.groupBy("context_id", "contig").agg(F.count(F.lit(1)).alias("n"))
    near = selected.select("contig", F.struct("candidate_id", "context_id", "start", "end").alias("a"))
    pairs = near.join(near.withColumnRenamed("a", "b"), "contig").filter("a.candidate_id < b.candidate_id")  # the panel's windows alone, few on a contig
    overlap = intervals.overlap_length(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    same = F.col("a.context_id") == F.col("b.context_id")
    parts = [
        as_rule(sizes.filter(~F.col("n").eqNullSafe(F.lit(rules.per_context))), "CONTEXT_SIZE", "context_id"), as_rule(sizes.filter(F.coalesce("contigs", F.lit(0)) < rules.least_contigs), "FEW_CONTIGS", "context_id"),
        as_rule(selected.groupBy("candidate_id").count().filter("count > 1"), "WINDOW_TWICE", "candidate_id"), as_rule(of_contig.filter(F.col("n") > rules.per_contig), "CONTIG_QUOTA", "context_id"),
        as_rule(selected.filter(F.col("contig").isin(*excluded)), "CONTIG_LEFT_OUT", "candidate_id"), as_rule(pairs.filter(same & (overlap > 0)).select("a.candidate_id"), "WITHIN_CONTEXT_OVERLAP", "candidate_id"),
        as_rule(pairs.filter(~same & (overlap >= rules.cross_overlap)).select("a.candidate_id"), "CROSS_CONTEXT_OVERLAP", "candidate_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def context_membership(windows: DataFrame, contexts: DataFrame, order: list[str], key: str = "candidate_id", own: str | None = None) -> DataFrame:
    """key, memberships (contexts with an overlap, in the given order, joined by ;) and the positions of each as JSON.

    ``own`` names the column of a window's own context, which is left out of its memberships.
    """
    merged = intervals.merge(contexts.select("context_id", "contig", "start", "end"), by=("context_id", "contig"))
    pairs = intervals.overlap_join(windows, merged)
    sums = pairs.groupBy(F.col(f"a_{key}").alias(key)).pivot("b_context_id", order).agg(F.sum(intervals.overlap_length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))))
    found = windows.select(key, *[own] * bool(own)).join(sums.withColumnRenamed(key, "k"), F.col(key) == F.col("k"), "left").drop("k")
    values = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in order}
    other = lambda c: F.lit(True) if own is None else ~F.col(own).eqNullSafe(F.lit(c))
    names = F.array_join(F.array_compact(F.array(*[F.when((values[c] > 0) & other(c), F.lit(c)) for c in order])), ";")
    return found.select(key, names.alias("memberships"), canonical.canonical_json(values).alias("overlap_json"))
