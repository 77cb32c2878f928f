"""Evidence queries: star joins of events with their observations, runs, experiments and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.sources.storage import cut


def _same(a: Column, b: Column) -> Column:
    """a = b as a range, which Spark takes for no key of a join: rows that lie dealt by the event aren't dealt again by event and run."""
    return a.between(b, b)


def _observed(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations with the columns of their event, where both name the same run."""
    own = observations.withColumnRenamed("benchmark_run_id", "__run")
    return events.join(own, "event_id").filter(_same(F.col("benchmark_run_id"), F.col("__run"))).drop("__run")


def event_evidence(events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, provenance: DataFrame, artifacts: DataFrame, event_id: str | None = None) -> DataFrame:
    """One row for each observation and source artifact of an event, or of all events; one event's rows are ordered.

    The filter stands on the event table, so it reaches the scan; small sides are broadcast by Spark
    where their statistics allow it. Runs and experiments are joined with the events, which are fewer than the observations.
    """
    chosen = events if event_id is None else events.filter(F.col("event_id") == event_id)
    lineage = provenance.filter(
        (F.col("target_entity_type") == "OBSERVATION") & (F.col("source_entity_type") == "SOURCE_ARTIFACT") & (F.col("relation") == "NORMALIZED_FROM")
    ).select("provenance_link_id", F.col("target_entity_id").alias("observation_id"), F.col("source_entity_id").alias("source_artifact_id"))
    rows = _observed(chosen.join(runs, "benchmark_run_id").join(experiments, "experiment_id"), observations)
    rows = rows.join(lineage, "observation_id").join(artifacts, "source_artifact_id")
    return rows if event_id is None else rows.orderBy("side", "source_record_ordinal", "observation_id")


def variant_evidence(variants: DataFrame, links: DataFrame, events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, variant_id: str | None = None) -> DataFrame:
    """One row for each observation of each event that is linked to a variant, or to any; one variant's rows are ordered."""
    chosen = variants if variant_id is None else variants.filter(F.col("variant_id") == variant_id)
    rows = chosen.join(links.select("variant_id", "event_id"), "variant_id").join(events, "event_id")
    rows = rows.join(observations, ["event_id", "benchmark_run_id"]).join(runs, "benchmark_run_id").join(experiments, "experiment_id")
    return rows if variant_id is None else rows.orderBy("technology", "benchmark_run_id", "event_id", "side", "source_record_ordinal", "observation_id")


def slim_events(events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame) -> DataFrame:
    rows = _observed(events.join(runs, "benchmark_run_id").join(experiments, "experiment_id"), observations)
    return rows.select("event_id", "observation_id", "side", "sample", "technology", "raw_decision")


def candidate_pairs(events: DataFrame, key: str, run: str, identity: str, same: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Unordered pairs of rows from different runs with an equal key and equal ``same`` columns, each once.

    Nothing is asserted about the pairs: they are candidates.
    """
    rows = events.filter(F.col(key).isNotNull())
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}{c}") for c in dict.fromkeys((key, run, identity, *same))])
    on = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col(f"a_{run}") < F.col(f"b_{run}"))
    for c in same:
        on &= F.col(f"a_{c}") == F.col(f"b_{c}")
    return side("a_").join(side("b_"), on).select(F.col(f"a_{key}").alias(key), f"a_{run}", f"b_{run}", f"a_{identity}", f"b_{identity}", F.lit(False).alias("equivalence_asserted"))


def candidate_events(pairs: DataFrame, events: DataFrame, key: str, run: str, identity: str) -> DataFrame:
    """Pairs with both events' columns (a_, b_) and what disagrees: an event that isn't there, its run, or its key."""
    names = [c for c in events.columns if c != identity]
    side = lambda p: events.select(F.col(identity).alias(f"__{p}"), *[F.col(c).alias(f"{p}_{c}_of_event") for c in names])
    rows = pairs
    for p in ("a", "b"):
        rows = rows.join(side(p), F.col(f"{p}_{identity}") == F.col(f"__{p}"), "left")
    checks = [F.when(F.col(f"__{p}").isNull(), F.lit(f"{p.upper()}_EVENT_MISSING")).when(F.col(f"{p}_{run}_of_event") != F.col(f"{p}_{run}"), F.lit(f"{p.upper()}_RUN_DIFFERS")) for p in ("a", "b")]
    if key in names:
        checks += [F.when(~F.col(f"{p}_{key}_of_event").eqNullSafe(F.col(key)), F.lit(f"{p.upper()}_KEY_DIFFERS")) for p in ("a", "b")]
    return rows.withColumn("inconsistencies", F.array_compact(F.array(*checks))).drop("__a", "__b")


def classified(candidates: DataFrame, classification: DataFrame, number: str = "candidate_number") -> DataFrame:
    """Candidates with their classification by number, and the shared columns in which the two differ, or that one is missing."""
    shared = [c for c in candidates.columns if c in classification.columns and c != number]
    other = classification.select(*[F.col(c).alias(f"c_{c}") if c in shared or c == number else F.col(c) for c in classification.columns])
    rows = candidates.join(other, F.col(number) == F.col(f"c_{number}"), "full_outer")
    differ = [F.when(~F.col(c).eqNullSafe(F.col(f"c_{c}")), F.lit(c)) for c in shared]
    what = F.when(F.col(f"c_{number}").isNull(), F.array(F.lit("NOT_CLASSIFIED"))).when(F.col(number).isNull(), F.array(F.lit("NO_CANDIDATE"))).otherwise(F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>"))
    return rows.withColumn("mismatches", what).withColumn(number, F.coalesce(number, f"c_{number}")).drop(*[f"c_{c}" for c in [*shared, number]])


def admitted_links(links: DataFrame, runs: DataFrame, experiments: DataFrame, admitted: DataFrame) -> DataFrame:
    """Links with the admitted source of their run's (sample, technology); a pair that is admitted twice fails the query."""
    once = admitted.groupBy("sample", "technology").agg(F.count(F.lit(1)).alias("__n"), F.min("candidate_id").alias("candidate_id"))
    refuse = F.raise_error(F.concat(F.lit("admitted twice: "), "sample", F.lit(" "), "technology")).cast(dict(admitted.dtypes)["candidate_id"])
    once = once.select("sample", "technology", F.when(F.col("__n") == 1, F.col("candidate_id")).otherwise(refuse).alias("candidate_id"))
    return links.join(runs, "benchmark_run_id").join(experiments, "experiment_id").join(once, ["sample", "technology"])


# The columns of the two evidence queries as table.column, with the names that they get; in the order they come.
EVENT_EVIDENCE = (
    "events.event_id", "events.identity_scope", "events.assembly", "events.contig", "events.start_0based", "events.end_0based", "events.source_event_id",
    "observations.observation_id", "observations.side", "observations.raw_decision", "observations.normalized_decision", "observations.raw_match_kind",
    "observations.region_status", "observations.source_contig", "observations.source_pos_1based", "observations.source_ref", "observations.source_alt",
    "observations.source_genotype", "observations.source_filter", "runs.benchmark_run_id", "runs.observation_origin", "runs.comparator", "runs.comparator_version", "runs.engine",
    "runs.engine_version", "runs.environment_lock_id", "runs.runtime_image_digest", "runs.query_artifact_id", "runs.truth_artifact_id", "runs.benchmark_bed_artifact_id",
    "runs.reference_artifact_id", "experiments.experiment_id", "experiments.source_submission_id", "experiments.sample_id", "experiments.technology", "experiments.platform",
    "experiments.coverage", "experiments.pipeline_name", "experiments.caller_names", "experiments.caller_versions", "provenance.provenance_link_id:raw_record_provenance_link_id",
    "artifacts.source_artifact_id:annotated_output_artifact_id", "artifacts.uri:annotated_output_uri", "artifacts.checksums:annotated_output_checksums",
)
VARIANT_EVIDENCE = (
    "variants.variant_id", "variants.assembly", "variants.contig", "variants.normalized_start_0based", "variants.normalized_end_0based", "variants.normalized_ref",
    "variants.normalized_alt", "links.event_variant_link_id", "links.identity_status", "links.identity_method", "links.identity_method_version",
    "links.provenance:phase1b_identity_provenance", "events.event_id", "events.identity_scope:event_identity_scope", "runs.benchmark_run_id", "runs.observation_origin",
    "runs.comparator", "runs.comparator_version", "runs.engine", "runs.engine_version", "runs.truth_artifact_id", "runs.benchmark_bed_artifact_id", "runs.reference_artifact_id",
    "experiments.experiment_id", "experiments.source_corpus", "experiments.source_submission_id", "experiments.sample_id", "experiments.technology", "experiments.platform",
    "experiments.coverage", "experiments.pipeline_name", "experiments.pipeline_version", "experiments.caller_names", "experiments.caller_versions", "observations.observation_id",
    "observations.side", "observations.raw_decision", "observations.normalized_decision", "observations.raw_match_kind", "observations.raw_variant_type",
    "observations.raw_location_type", "observations.source_contig", "observations.source_pos_1based", "observations.source_ref", "observations.source_alt",
    "observations.source_genotype", "observations.source_filter", "observations.source_output_artifact_id", "observations.source_record_ordinal",
    "observations.normalization_method:observation_normalization_method", "observations.normalization_version:observation_normalization_version",
)


def _projected(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """table.column or table.column:name of tables that were joined under their names."""
    pairs = [c.partition(":")[::2] for c in columns]
    return rows.select(*[F.col(of).alias(name or of.split(".")[1]) for of, name in pairs])


def event_evidence_columns(events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, provenance: DataFrame, artifacts: DataFrame, event_id: str | None = None) -> DataFrame:
    """The 44 columns of the event evidence query, of one event or of all; its order is left to the caller."""
    c = F.col
    chosen = events if event_id is None else events.filter(c("event_id") == event_id)
    edges = provenance.filter((c("target_entity_type") == "OBSERVATION") & (c("source_entity_type") == "SOURCE_ARTIFACT") & (c("relation") == "NORMALIZED_FROM"))
    rows = chosen.alias("events").join(runs.alias("runs"), c("runs.benchmark_run_id") == c("events.benchmark_run_id")).join(experiments.alias("experiments"), c("experiments.experiment_id") == c("runs.experiment_id"))
    rows = rows.join(observations.alias("observations"), (c("observations.event_id") == c("events.event_id")) & _same(c("observations.benchmark_run_id"), c("events.benchmark_run_id")))
    rows = rows.join(edges.alias("provenance"), c("provenance.target_entity_id") == c("observations.observation_id"))
    return _projected(rows.join(artifacts.alias("artifacts"), c("artifacts.source_artifact_id") == c("provenance.source_entity_id")), EVENT_EVIDENCE)


def variant_evidence_columns(variants: DataFrame, links: DataFrame, events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, variant_id: str | None = None) -> DataFrame:
    """The 51 columns of the variant evidence query, of one variant or of all; its order is left to the caller."""
    c = F.col
    chosen = variants if variant_id is None else variants.filter(c("variant_id") == variant_id)
    rows = chosen.alias("variants").join(links.alias("links"), c("links.variant_id") == c("variants.variant_id")).join(events.alias("events"), c("events.event_id") == c("links.event_id"))
    rows = rows.join(observations.alias("observations"), (c("observations.event_id") == c("events.event_id")) & (c("observations.benchmark_run_id") == c("events.benchmark_run_id")))
    rows = rows.join(runs.alias("runs"), c("runs.benchmark_run_id") == c("events.benchmark_run_id")).join(experiments.alias("experiments"), c("experiments.experiment_id") == c("runs.experiment_id"))
    return _projected(rows, VARIANT_EVIDENCE)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 1 in a total order without bringing them into one task.

    Rows are dealt by range and written once with their partition and place, partitions are counted, and rows
    take their number from both.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select(F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = dealt.join(F.broadcast(counts), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__p", "__first", "__before")


def search(events: DataFrame, *, event: str | None = None, variant: str | None = None, contig: str | None = None, position: int | None = None, ref: str | None = None, alt: str | None = None, sample: str | None = None, technology: str | None = None, state: str | None = None, raw_decision: str | None = None, raw_type: str | None = None) -> DataFrame:
    """Events that meet every given condition; position counts from 1."""
    conditions: list[Column] = []
    for name, value in (("event_id", event), ("variant_id", variant), ("contig", contig), ("normalized_ref", ref), ("normalized_alt", alt), ("sample", sample), ("technology", technology), ("identity_state", state)):
        if value is not None:
            conditions.append(F.col(name) == value)
    if position is not None:
        conditions.append((F.col("start_0based") <= position - 1) & (F.lit(position - 1) < F.col("end_0based")))
    for name, value in (("raw_decisions", raw_decision), ("raw_variant_types", raw_type)):
        if value is not None:
            conditions.append(F.array_contains(name, value))
    for condition in conditions:
        events = events.filter(condition)
    return events


def with_identity_state(events: DataFrame, links: DataFrame, accounting: DataFrame) -> DataFrame:
    """Identity state of events of both phases, nothing invented.

    First-phase events without a link are NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY; second-phase events have their accounting's status.
    """
    l = links.select(F.col("event_id").alias("l_event"), F.col("variant_id").alias("l_variant"), F.col("benchmark_run_id").alias("l_run"))
    a = accounting.select(F.col("event_id").alias("a_event"), F.col("status").alias("a_status"), F.col("reason").alias("a_reason"))
    rows = events.join(l, F.col("event_id") == F.col("l_event"), "left").join(a, F.col("event_id") == F.col("a_event"), "left")
    first = F.col("phase") == 1
    state = F.when(first & F.col("l_event").isNull(), F.lit("NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY")).when(first, F.lit("EXACT_NORMALIZED_ALLELE")).otherwise(F.col("a_status"))
    exact = F.col("identity_state") == "EXACT_NORMALIZED_ALLELE"
    rows = rows.withColumn("identity_state", state).withColumn("variant_id", F.when(exact, F.col("l_variant"))).withColumn("unresolved_reason", F.when(F.col("identity_state") == "UNRESOLVED", F.col("a_reason")))
    return rows.withColumn("run_matches", F.col("l_run").isNull() | (F.col("l_run") == F.col("benchmark_run_id"))).drop("l_event", "l_variant", "l_run", "a_event", "a_status", "a_reason")
