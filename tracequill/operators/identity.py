"""Deterministic identity: alleles, pair classification, event decisions, links and audits.

Nothing is guessed: what can't be decided is UNRESOLVED and carries its reason.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical

EXACT = "EXACT_NORMALIZED_ALLELE"
NON_EQUIVALENT = "NON_EQUIVALENT"
UNRESOLVED = "UNRESOLVED"
ALLELE = ("assembly", "contig", "start", "end", "ref", "alt")

#: About how many rows of a group meet as many others in one place, and how many pairs are a task's work.
TILE, SHARE = 2_048, 50_000_000


@dataclass(frozen=True)
class Method:
    """The constants that go into identities; equal constants give equal ids."""

    variant_schema: str = "1.0.0"
    link_schema: str = "1.0.0"
    name: str = "exact_normalized_allele"
    version: str = "1.0.0"


def allele_errors(assembly: Column, contig: Column, start: Column, end: Column, ref: Column, alt: Column) -> Column:
    """What is wrong with an allele, in a fixed order; an empty array for a valid one."""
    empty = lambda x, name: F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(f"{name} must not be empty"))
    return F.array_compact(F.array(
        empty(assembly, "assembly"),
        empty(contig, "contig"),
        empty(ref, "REF"),
        empty(alt, "ALT"),
        F.when(start.isNull() | end.isNull(), F.lit("start and end must be integers")),
        F.when(start < 0, F.lit("start must be >= 0")),
        F.when(end < start, F.lit("end must be >= start")),
    ))


def classify(a: str = "a_", b: str = "b_") -> Column:
    """Status of a pair of alleles whose columns carry the two prefixes."""
    at = lambda p, name: F.trim(F.col(f"{p}{name}")) if name not in ("start", "end") else F.col(f"{p}{name}")
    same = {name: at(a, name) == at(b, name) for name in ALLELE}
    span = same["start"] & same["end"]
    return (
        F.when(~same["assembly"] | ~same["contig"], F.lit(NON_EQUIVALENT))
        .when(span & same["ref"] & same["alt"], F.lit(EXACT))
        .when(span, F.lit(NON_EQUIVALENT))
        .otherwise(F.lit(UNRESOLVED))
    )


def pairs_within(rows: DataFrame, key: str, by: Sequence[str], tile: int = TILE, share: int = SHARE) -> DataFrame:
    """Each pair of rows with equal ``by`` and different keys once, columns a_* and b_*; which of the two is a_ is open.

    Every pair of a group is asked for, so the work is its square. A group is dealt to tiles of about ``tile`` rows by a hash of the
    key, and a pair of tiles, not a group, is what meets in one place; tasks are made for about ``share`` pairs each.
    """
    by, of = list(by), [F.col(c).alias(f"__of_{c}") for c in by]
    sizes = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("__n"))
    pairs = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n") / 2)).first()[0] or 0
    tiles = sizes.select(*[f"__of_{c}" for c in by], F.ceil(F.col("__n") / tile).alias("__tiles"))
    on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__of_{c}") for c in by])
    dealt = rows.join(tiles, on).withColumn("__tile", F.pmod(F.xxhash64(key), "__tiles"))
    first, last = F.lit(0).cast("long"), F.col("__tiles") - 1
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / share))

    def side(p: str, low: Column, high: Column) -> DataFrame:
        met = dealt.select(*[F.col(c).alias(f"{p}{c}") for c in rows.columns], low.alias(f"{p}low"), high.alias(f"{p}high"))
        return met.repartition(n, *[f"{p}{c}" for c in (*by, "low", "high")])

    a, b = side("a_", F.col("__tile"), F.explode(F.sequence(F.col("__tile"), last))), side("b_", F.explode(F.sequence(first, F.col("__tile"))), F.col("__tile"))
    met = reduce(lambda x, y: x & y, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*by, "low", "high")])
    return a.join(b, met & ((F.col("a_low") < F.col("a_high")) | (F.col(f"a_{key}") < F.col(f"b_{key}")))).drop("a_low", "a_high", "b_low", "b_high")


def structural_class(n_alleles: Column) -> Column:
    return F.when(n_alleles == 0, F.lit("NO_ALLELE")).when(n_alleles == 1, F.lit("SINGLE_ALLELE")).otherwise(F.lit("MULTIPLE_ALLELES"))


def allele_sets(observations: DataFrame, key: str = "event_id") -> DataFrame:
    """Per event: n_observations, n_complete, n_alleles and the allele, if there is just one."""
    fields = ("normalized_start_0based", "normalized_end_0based", "normalized_ref", "normalized_alt")
    complete = F.lit(True)
    for f in fields:
        complete &= F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
    # A coordinate that is no integer fails the query: it isn't a case for abstention.
    allele = F.when(complete, F.struct(F.col(fields[0]).cast("long").alias("start"), F.col(fields[1]).cast("long").alias("end"), F.col(fields[2]).alias("ref"), F.col(fields[3]).alias("alt")))
    rows = observations.select(key, allele.alias("allele"))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.count("allele").alias("n_complete"),
        F.count_distinct("allele").alias("n_alleles"),
        F.min("allele").alias("allele"),
    )


def decide(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Each event with its allele (start, end, ref, alt), status and reason.

    The first of these reasons that holds: MISSING_OBSERVATIONS, MISSING_EVENT_ASSEMBLY,
    MISSING_EVENT_CONTIG, MISSING_NORMALIZED_ALLELE_FIELD, MULTIPLE_NORMALIZED_ALLELES,
    LOOKUP_KEY_MISMATCH, INVALID_IDENTITY_FIELDS.
    """
    sets = allele_sets(observations)
    rows = events.join(sets.withColumnRenamed("event_id", "s_event"), F.col("event_id") == F.col("s_event"), "left").drop("s_event")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    expected = F.concat_ws("|", "assembly", "contig", (F.col("allele.start") + 1).cast("string"), F.upper("allele.ref"), F.upper("allele.alt"))
    errors = allele_errors(F.col("assembly"), F.col("contig"), F.col("allele.start"), F.col("allele.end"), F.col("allele.ref"), F.col("allele.alt"))
    reason = (
        F.when(F.coalesce("n_observations", F.lit(0)) == 0, F.lit("MISSING_OBSERVATIONS"))
        .when(blank("assembly"), F.lit("MISSING_EVENT_ASSEMBLY"))
        .when(blank("contig"), F.lit("MISSING_EVENT_CONTIG"))
        .when(F.col("n_complete") != F.col("n_observations"), F.lit("MISSING_NORMALIZED_ALLELE_FIELD"))
        .when(F.col("n_alleles") != 1, F.lit("MULTIPLE_NORMALIZED_ALLELES"))
        .when(~blank("normalized_allele_lookup_key") & (F.col("normalized_allele_lookup_key") != expected), F.lit("LOOKUP_KEY_MISMATCH"))
        .when(F.size(errors) > 0, F.lit("INVALID_IDENTITY_FIELDS"))
        .otherwise(F.lit(""))
    )
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", F.lit(EXACT)).otherwise(F.lit(UNRESOLVED)))
    return rows.withColumn("allele", F.when(F.col("reason") == "", F.col("allele")))


@dataclass
class Materialized:
    links: DataFrame
    accounting: DataFrame
    provenance: DataFrame
    variants: DataFrame


def materialize(events: DataFrame, observations: DataFrame, known: DataFrame, method: Method = Method()) -> Materialized:
    """Links, accounting, provenance and variant index of run-scoped events.

    ``known`` holds variant_id of an earlier registry: such variants are REUSED, others NEW.
    """
    a = F.col("allele")
    decided = decide(events, observations)
    variant = canonical.variant_id(method.variant_schema, F.col("assembly"), F.col("contig"), a["start"], a["end"], a["ref"], a["alt"])
    decided = decided.withColumn("variant_id", F.when(F.col("reason") == "", variant))
    earlier = known.select(F.col("variant_id").alias("k_variant")).distinct()
    decided = decided.join(earlier, F.col("variant_id") == F.col("k_variant"), "left")
    decided = decided.withColumn("origin", F.when(F.col("variant_id").isNull(), F.lit("NONE")).when(F.col("k_variant").isNotNull(), F.lit("REUSED")).otherwise(F.lit("NEW")))
    linked = decided.filter("variant_id is not null")
    link = canonical.link_id(F.col("event_id"), F.col("variant_id"), F.col("benchmark_run_id"), method.link_schema, EXACT, method.name, method.version)
    links = linked.select(link.alias("event_variant_link_id"), "event_id", "variant_id", "benchmark_run_id", F.lit(EXACT).alias("identity_status"), F.lit(method.name).alias("identity_method"), F.lit(method.version).alias("identity_method_version"))
    accounting = decided.select("event_id", "benchmark_run_id", "status", "reason", F.coalesce("n_observations", F.lit(0)).alias("n_observations"), F.coalesce("n_alleles", F.lit(0)).alias("n_alleles"), "variant_id", "origin")
    edge = lambda relation, kind, target: F.struct(F.lit("EVENT_VARIANT_LINK").alias("source_type"), F.lit(relation).alias("relation"), F.lit(kind).alias("target_type"), F.col(target).alias("target_id"))
    edges = F.explode(F.array(edge("DERIVED_FROM", "EVENT", "event_id"), edge("HAS_MEMBER", "VARIANT", "variant_id"), edge("GENERATED", "BENCHMARK_RUN", "benchmark_run_id")))
    provenance = links.select(F.col("event_variant_link_id").alias("source_id"), edges.alias("e")).select("source_id", "e.*")
    variants = linked.groupBy("variant_id").agg(
        F.min("assembly").alias("assembly"), F.min("contig").alias("contig"), F.min("allele").alias("allele"), F.count_distinct(F.struct("assembly", "contig", "allele")).alias("n_contents"),
        F.min("origin").alias("origin"), *support(),
    )
    return Materialized(links, accounting, provenance, variants)


def allele_text(assembly: Column, contig: Column, start: Column, end: Column, ref: Column, alt: Column) -> Column:
    """The canonical text of an allele: its parts joined by bars."""
    return F.concat_ws("|", F.trim(assembly), F.trim(contig), start.cast("string"), end.cast("string"), F.trim(ref), F.trim(alt))


@dataclass
class Endpoints:
    links: DataFrame
    variants: DataFrame
    accounting: DataFrame
    conflicts: DataFrame


def materialize_candidates(candidates: DataFrame, method: Method = Method()) -> Endpoints:
    """Links and variants of classified candidate pairs (candidate_number, status, a_ and b_ of event_id, benchmark_run_id and the allele).

    Each exact pair gives its two endpoints one variant; a pair with another status gives none and is accounted for with its
    status. conflicts (key, conflict) tells events with two variants or two runs, exact pairs whose ends differ, and
    candidates that come twice; rows in conflict give no link.
    """
    side = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("event_id", "benchmark_run_id", *ALLELE)])
    named = lambda e: canonical.variant_id(method.variant_schema, e["assembly"], e["contig"], e["start"], e["end"], e["ref"], e["alt"])
    rows = candidates.withColumn("really", classify())
    exact = rows.filter(F.col("status") == EXACT)
    ends = exact.filter(F.col("really") == EXACT).select("candidate_number", F.explode(F.array(side("a_"), side("b_"))).alias("e"))
    ends = ends.withColumn("variant_id", named(F.col("e"))).select("candidate_number", "variant_id", "e.*")
    per_event = ends.groupBy("event_id").agg(F.count_distinct("variant_id").alias("n_variants"), F.count_distinct("benchmark_run_id").alias("n_runs"))
    key = lambda df, k, what: df.select(F.col(k).cast("string").alias("key"), F.lit(what).alias("conflict"))
    conflicts = key(per_event.filter("n_variants > 1"), "event_id", "EVENT_HAS_TWO_VARIANTS").unionAll(key(per_event.filter("n_runs > 1"), "event_id", "EVENT_HAS_TWO_RUNS"))
    conflicts = conflicts.unionAll(key(exact.filter(~F.col("really").eqNullSafe(F.lit(EXACT))), "candidate_number", "EXACT_ENDS_DIFFER"))
    conflicts = conflicts.unionAll(key(rows.groupBy("candidate_number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "candidate_number", "CANDIDATE_TWICE"))
    good = ends.join(per_event.filter("n_variants = 1 and n_runs = 1").select(F.col("event_id").alias("g_event")), F.col("event_id") == F.col("g_event"), "left_semi")
    links = good.groupBy("event_id", "variant_id", "benchmark_run_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("candidate_number").cast("string"))), ";").alias("candidate_numbers"))
    link = canonical.link_id(F.col("event_id"), F.col("variant_id"), F.col("benchmark_run_id"), method.link_schema, EXACT, method.name, method.version)
    links = links.select(link.alias("event_variant_link_id"), "*", F.lit(EXACT).alias("identity_status"))
    variants = good.groupBy("variant_id").agg(*[F.min(c).alias(c) for c in ALLELE], *support())
    accounting = rows.groupBy("candidate_number").agg(F.min("status").alias("status"), F.count(F.lit(1)).alias("n"))
    return Endpoints(links, variants, accounting, conflicts)


def support() -> list[Column]:
    """Sorted sets of what stands behind a variant, joined by ;."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return [joined("event_id").alias("event_ids"), joined("benchmark_run_id").alias("benchmark_run_ids")]


def reuse(ids: DataFrame, known: DataFrame) -> DataFrame:
    """variant_id with origin REUSED where the earlier registry has it, else NEW."""
    earlier = known.select(F.col("variant_id").alias("k")).distinct()
    return ids.join(earlier, F.col("variant_id") == F.col("k"), "left").select("variant_id", F.when(F.col("k").isNull(), F.lit("NEW")).otherwise(F.lit("REUSED")).alias("origin"))


def event_identity(contig: Column, ordinal: Column, truth_group: Column, query_group: Column, run: Column, with_contig: bool = True) -> Column:
    """Event id of a comparator record: its superlocus if both sides agree on one, else the record itself."""
    agreed = truth_group.isNotNull() & (truth_group == query_group)
    place = [contig] if with_contig else []
    return F.when(agreed, F.concat_ws(":", run, F.lit("superlocus"), *place, truth_group.cast("string"))).otherwise(F.concat_ws(":", run, F.lit("record"), *place, ordinal.cast("string")))


def sides(records: DataFrame, columns: list[str]) -> DataFrame:
    """A TRUTH and a QUERY row for each record; columns truth_<c> and query_<c> become <c>."""
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in columns])
    rest = [c for c in records.columns if not c.startswith(("truth_", "query_"))]
    return records.select(*rest, F.explode(F.array(side("truth"), side("query"))).alias("o")).select(*rest, "o.*")


def event_bounds(observations: DataFrame, key: str = "event_id", start: str = "start", end: str = "end", contig: str = "contig", lookup: str = "lookup_key") -> DataFrame:
    """Bounds of each event; its lookup key only if all its rows have the same, a null counting as another."""
    one = lambda c: F.count_distinct(F.struct(c)) == 1
    return observations.groupBy(key).agg(
        F.min(start).alias("start"), F.max(end).alias("end"),
        F.when(one(contig), F.min(contig)).alias("contig"), F.when(one(lookup), F.min(lookup)).alias("lookup_key"), F.count(F.lit(1)).alias("n_rows"),
    )


def graph_audit(edges: DataFrame, left: str, right: str, more: str) -> DataFrame:
    """Per right node: its degree, distinct left nodes and a sorted list of a further key."""
    return edges.groupBy(right).agg(
        F.count_distinct(left).alias("n_linked"), F.count_distinct(more).alias("n_groups"), F.array_join(F.array_sort(F.collect_set(F.col(more).cast("string"))), ";").alias("groups")
    )


def degree_histogram(edges: DataFrame, left: str, right: str) -> DataFrame:
    degrees = edges.groupBy(right).agg(F.count_distinct(left).alias("degree"))
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def duplicate_edges(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
