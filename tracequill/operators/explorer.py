"""The unified explorer export: phases together, identity states, rollups, shards and its manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.operators import aggregates, evidence, gates, sets


@dataclass
class Model:
    events: DataFrame
    variants: DataFrame
    provenance: DataFrame


def build(first: DataFrame, second: DataFrame, observations: DataFrame, links: DataFrame, accounting: DataFrame, runs: DataFrame, experiments: DataFrame, provenance: DataFrame) -> Model:
    """Events of both phases with their states and rollups; first and second have event_id, benchmark_run_id and more.

    Ids of the phases must be disjoint; that, and names that the export must not have, are checked first.
    """
    if (shared := sets.shared_keys(first, second, "event_id").first()) is not None:
        raise ValueError(f"event {shared[0]} is in both phases")
    events = sets.union_by_phase({"1": first, "2": second}).withColumn("phase", F.col("phase").cast("int"))
    stated = evidence.with_identity_state(events, links, accounting)
    rows = stated.join(runs, "benchmark_run_id").join(experiments, "experiment_id")
    rows = aggregates.event_search_index(rows, observations).withColumn("shard", canonical.shard_key(F.col("event_id").cast("string")))
    if names := gates.forbidden_fields(rows):
        raise ValueError(f"forbidden fields: {names}")
    linked = rows.filter("variant_id is not null").select("event_id", "variant_id", "sample", "technology", "n_observations")
    variants = aggregates.variant_rollup(linked.select("variant_id", "event_id"), linked.drop("variant_id"))
    return Model(rows, variants, aggregates.provenance_index(provenance))


def manifest(model: Model) -> DataFrame:
    """identity_state, n_events, and the numbers of variants and of entities with provenance."""
    states = model.events.groupBy("identity_state").agg(F.count(F.lit(1)).alias("n"))
    return states.select(F.concat(F.lit("events:"), "identity_state").alias("name"), "n").unionAll(
        model.variants.agg(F.count(F.lit(1)).alias("n")).select(F.lit("variants").alias("name"), "n")
    ).unionAll(model.provenance.agg(F.count(F.lit(1)).alias("n")).select(F.lit("provenance_entities").alias("name"), "n"))


def example_rows(model: Model, links: DataFrame, variant_id: str) -> DataFrame:
    """The linked events of one variant with sample, technology, run and state, in a fixed order."""
    own = links.filter(F.col("variant_id") == variant_id).select(F.col("event_id").alias("l_event"), "event_variant_link_id")
    return model.events.join(own, F.col("event_id") == F.col("l_event")).drop("l_event").orderBy("technology", "sample", "benchmark_run_id", "event_id")


# The columns of the product query of the identity phase and of the validation phase, in order.
IDENTITY_COLUMNS = (
    "variant_id", "event_variant_link_id", "identity_status", "identity_method", "variant_origin", "sample_id", "technology", "experiment_id", "benchmark_run_id", "comparator", "comparator_version", "engine", "engine_version",
    "event_id", "observation_id", "side", "raw_decision", "raw_match_kind", "source_genotype", "source_filter", "source_output_artifact_id", "phase2c_archive_sha256",
)
VALIDATION_COLUMNS = (
    "variant_id", "event_variant_link_id", "identity_status", "identity_method", "identity_method_version", "source_selection_candidate_id", "sample_id", "technology", "platform", "pipeline_name", "experiment_id", "benchmark_run_id", "comparator", "comparator_version", "engine", "engine_version",
    "event_id", "observation_id", "side", "raw_decision", "raw_match_kind", "raw_variant_type", "source_genotype", "source_filter", "source_output_artifact_id", "reference_artifact_id", "phase1b_archive_sha256", "phase2c_archive_sha256", "admitted_sources_lock_sha256", "interval_panel_lock_sha256",
)
LOCKS = ("phase1b_archive_sha256", "phase2c_archive_sha256", "admitted_sources_lock_sha256", "interval_panel_lock_sha256")


def _product(links: DataFrame, events: DataFrame, runs: DataFrame, experiments: DataFrame, observations: DataFrame, largest_id: bool) -> DataFrame:
    """A row for each observation of the best-covered variant: one with the most samples, then technologies, then links.

    The variant is a row that the links are joined with; nothing of it comes to the driver.
    """
    c = F.col
    of_run = runs.join(experiments, "experiment_id")
    cover = links.join(of_run.select("benchmark_run_id", "sample_id", "technology"), "benchmark_run_id")
    best = aggregates.best_covered(cover, "variant_id", "sample_id", "technology", "event_variant_link_id", largest_id).select(c("variant_id").alias("best_variant"))
    own = links.join(best, c("variant_id") == c("best_variant"), "left_semi")
    rows = own.join(events.drop("benchmark_run_id"), "event_id").join(of_run, "benchmark_run_id")
    return rows.join(observations.drop("benchmark_run_id"), "event_id")


def identity_product(links: DataFrame, events: DataFrame, runs: DataFrame, experiments: DataFrame, observations: DataFrame, archive_sha256: str) -> DataFrame:
    """The identity phase's product query: IDENTITY_COLUMNS of every observation of the best variant (the largest id of equals)."""
    rows = _product(links, events.select("event_id"), runs, experiments, observations, largest_id=True).withColumn("phase2c_archive_sha256", F.lit(archive_sha256))
    return rows.select(*IDENTITY_COLUMNS)


def validation_product(links: DataFrame, events: DataFrame, runs: DataFrame, experiments: DataFrame, observations: DataFrame, admitted: DataFrame) -> DataFrame:
    """The validation phase's: VALIDATION_COLUMNS, with the source that was admitted for the sample and technology (sample_id, technology,
    candidate_id) and the locks that the link's provenance names. The smallest id of equals."""
    lock: dict[str, Column] = {n: F.get_json_object("provenance", f"$.{n}") for n in LOCKS}
    rows = _product(links, events.select("event_id", "reference_artifact_id"), runs, experiments, observations, largest_id=False).withColumns(lock)
    sources = admitted.select("sample_id", "technology", F.col("candidate_id").alias("source_selection_candidate_id"))
    return rows.join(sources, ["sample_id", "technology"]).select(*VALIDATION_COLUMNS)
