"""Data-quality gates: violations per rule, gate rows, verdicts, forbidden names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tracequill.sources.storage import cut

# Names that must not be columns or keys, of the explorer's export (also of its web delivery) and of the second phase's actions;
# parts of names that the identity phase must not write; names and values of genomic contexts; the artifacts that a run refers to.
FORBIDDEN = ("reliability_score", "trust_score", "confidence_score", "consensus", "consensus_decision", "trusted", "technology_winner", "caller_winner", "preferred_technology", "pathogenicity", "clinical_significance")
FORBIDDEN_ACTIONS = ("reliability_score", "trust_score", "confidence_score", "technology_rank", "consensus_label", "trusted_label")
FRAGMENTS = ("reliability", "confidence", "trusted", "ranking", "consensus")
CONTEXT_FIELDS = ("genomic_context", "genomic_contexts", "context_class", "context_classes", "context_label", "context_labels", "homopolymer", "tandem_repeat", "low_mappability", "segmental_duplication", "non_difficult")
CONTEXT_VALUES = ("HOMOPOLYMER", "TANDEM_REPEAT", "LOW_MAPPABILITY", "SEGMENTAL_DUPLICATION", "NON_DIFFICULT")
RUN_ARTIFACTS = ("query_artifact_id", "truth_artifact_id", "benchmark_bed_artifact_id", "reference_artifact_id")


def violation(df: DataFrame, rule: str, key: str | Column, bad: Column | None = None) -> DataFrame:
    """rule, key of the rows for which bad holds or can't be told; of all rows without one."""
    rows = df if bad is None else df.filter(F.coalesce(bad, F.lit(True)))
    return rows.select(F.lit(rule).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def together(violations: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def bundle_violations(events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, provenance: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Keys, references, run agreement, intervals, containment and lineage of a registry."""
    twice = lambda df, key, rule: violation(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), rule, key)
    lost = lambda df, key, to, to_key, rule, own: violation(df.join(to.select(F.col(to_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti"), rule, own)
    of_event = events.select(F.col("event_id").alias("e_id"), F.col("benchmark_run_id").alias("e_run"))
    used = provenance.filter((F.col("relation") == "NORMALIZED_FROM") & (F.col("target_entity_type") == "OBSERVATION"))
    return together([
        twice(events, "event_id", "EVENT_ID_UNIQUE"), twice(observations, "observation_id", "OBSERVATION_ID_UNIQUE"), twice(runs, "benchmark_run_id", "RUN_ID_UNIQUE"),
        twice(experiments, "experiment_id", "EXPERIMENT_ID_UNIQUE"), twice(artifacts, "source_artifact_id", "ARTIFACT_ID_UNIQUE"),
        lost(events, "benchmark_run_id", runs, "benchmark_run_id", "EVENT_RUN_EXISTS", "event_id"), lost(runs, "experiment_id", experiments, "experiment_id", "RUN_EXPERIMENT_EXISTS", "benchmark_run_id"),
        lost(observations, "event_id", events, "event_id", "OBSERVATION_EVENT_EXISTS", "observation_id"),
        violation(observations.join(of_event, F.col("event_id") == F.col("e_id")), "OBSERVATION_RUN_AGREES", "observation_id", F.col("benchmark_run_id") != F.col("e_run")),
        violation(events, "EVENT_INTERVAL", "event_id", (F.col("start_0based") < 0) | (F.col("end_0based") <= F.col("start_0based"))),
        violation(runs, "PADDED_HOLDS_CORE", "benchmark_run_id", (F.col("padded_start") > F.col("core_start")) | (F.col("padded_end") < F.col("core_end"))),
        lost(observations, "observation_id", used, "target_entity_id", "OBSERVATION_HAS_LINEAGE", "observation_id"),
        lost(used, "source_entity_id", artifacts, "source_artifact_id", "LINEAGE_ARTIFACT_EXISTS", "provenance_link_id"),
        lost(runs, "benchmark_run_id", events, "benchmark_run_id", "RUN_NOT_EMPTY", "benchmark_run_id"),
    ])


def reference_violations(events: DataFrame, observations: DataFrame, runs: DataFrame, experiments: DataFrame, provenance: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References of a registry's entities that lead nowhere, and runs whose intervals or evidence don't fit.

    runs have a field for each of RUN_ARTIFACTS, output_artifact_ids, run_status, and core and padded as structs of assembly, contig,
    start_0based, end_0based. A null reference leads nowhere; an entity type of a link that the registry hasn't leads nowhere too.
    """
    known = artifacts.select(F.col("source_artifact_id").cast("string").alias("__k")).distinct()

    def lost(df: DataFrame, rule: str, column: str, own: str, of: DataFrame = known) -> DataFrame:
        return violation(df.join(of, F.col(column).cast("string") == F.col("__k"), "left_anti"), rule, own)

    ids = {"EVENT": (events, "event_id"), "OBSERVATION": (observations, "observation_id"), "BENCHMARK_RUN": (runs, "benchmark_run_id"), "EXPERIMENT": (experiments, "experiment_id"), "SOURCE_ARTIFACT": (artifacts, "source_artifact_id"), "PROVENANCE_LINK": (provenance, "provenance_link_id")}
    entities = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("__type"), F.col(key).cast("string").alias("__id")) for kind, (df, key) in ids.items()])
    ends = [violation(provenance.join(entities, (F.col(f"{end}_entity_type") == F.col("__type")) & (F.col(f"{end}_entity_id").cast("string") == F.col("__id")), "left_anti"), f"LINK_{end.upper()}_EXISTS", "provenance_link_id") for end in ("source", "target")]
    no_order = lambda c: (F.col(f"{c}.start_0based") < 0) | (F.col(f"{c}.end_0based") <= F.col(f"{c}.start_0based"))
    apart = ~F.col("core.assembly").eqNullSafe(F.col("padded.assembly")) | ~F.col("core.contig").eqNullSafe(F.col("padded.contig"))
    seen = observations.select(F.col("benchmark_run_id").alias("__run")).distinct()
    return together([
        lost(events, "EVENT_REFERENCE_ARTIFACT", "reference_artifact_id", "event_id"), *[lost(runs, f"RUN_{f.upper()}", f, "benchmark_run_id") for f in RUN_ARTIFACTS], lost(runs.select("benchmark_run_id", F.explode("output_artifact_ids").alias("a")), "RUN_OUTPUT_ARTIFACT", "a", "benchmark_run_id"),
        lost(experiments.select("experiment_id", F.explode("metadata_artifact_ids").alias("a")), "EXPERIMENT_METADATA_ARTIFACT", "a", "experiment_id"), lost(observations, "OBSERVATION_RUN_EXISTS", "benchmark_run_id", "observation_id", runs.select(F.col("benchmark_run_id").cast("string").alias("__k")).distinct()),
        lost(observations, "OBSERVATION_OUTPUT_ARTIFACT", "source_output_artifact_id", "observation_id"), *ends, *[violation(runs.filter(F.col(c).isNotNull()), f"RUN_{c.upper()}_INTERVAL", "benchmark_run_id", no_order(c)) for c in ("core", "padded")],
        violation(runs.filter("core is not null and padded is not null"), "RUN_INTERVALS_AGREE", "benchmark_run_id", apart), violation(runs.filter("run_status = 'SUCCEEDED'").join(seen, F.col("benchmark_run_id") == F.col("__run"), "left_anti"), "SUCCEEDED_RUN_OBSERVED", "benchmark_run_id"),
    ])


def gates(spark: SparkSession, rules: list[str], violations: DataFrame) -> DataFrame:
    """gate, status, n_violations: a row for each rule, also for those without a violation."""
    counts = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    all_rules = spark.createDataFrame([(r,) for r in rules], "gate string")
    rows = all_rules.join(counts, F.col("gate") == F.col("rule"), "left")
    return rows.select("gate", F.when(F.col("n").isNull(), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"), F.coalesce("n", F.lit(0)).alias("n_violations"))


def verdict(rows: DataFrame, critical: list[str]) -> DataFrame:
    """PASS if all gates pass, STOP if a critical one fails, else MODIFY."""
    fails = F.col("status") != "PASS"
    return rows.agg(F.when(~F.bool_or(fails), F.lit("PASS")).when(F.bool_or(fails & F.col("gate").isin(critical)), F.lit("STOP")).otherwise(F.lit("MODIFY")).alias("verdict"))


def field_names(kind: DataType, prefix: str = "") -> list[str]:
    """All field names of a schema with their paths, structs inside arrays and maps included."""
    if isinstance(kind, StructType):
        return [n for f in kind.fields for n in (f"{prefix}{f.name}", *field_names(f.dataType, f"{prefix}{f.name}."))]
    if isinstance(kind, ArrayType):
        return field_names(kind.elementType, prefix)
    if isinstance(kind, MapType):
        return field_names(kind.valueType, prefix)
    return []


def forbidden_fields(df: DataFrame, names: tuple[str, ...] = FORBIDDEN, fragments: tuple[str, ...] = ()) -> list[str]:
    last = lambda path: path.rsplit(".", 1)[-1].lower()
    return [p for p in field_names(df.schema) if last(p) in names or any(x in last(p) for x in fragments)]


def json_walk(df: DataFrame, key: str, value: Column) -> DataFrame:
    """key, path and value (variant) of everything inside JSON values, at any depth, the values themselves at path "" included.

    A round opens what the last one found, objects by their names and lists by their places, until nothing opens; there are
    as many rounds as the deepest value has levels.
    """
    rows = level = cut(df.select(F.col(key).alias("key"), F.lit("").alias("path"), value.alias("value")).filter("value is not null"))
    while True:
        names = F.transform(F.map_entries(F.try_variant_get("value", "$", "map<string, variant>")), lambda e: F.struct(e["key"].alias("step"), e["value"].alias("value")))
        places = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("step"), v.alias("value")))
        inner = level.select("key", "path", F.explode(F.coalesce(names, places)).alias("x"))  # null for what is no object, and no list
        level = cut(inner.select("key", F.when(F.col("path") == "", F.col("x.step")).otherwise(F.concat("path", F.lit("/"), "x.step")).alias("path"), F.col("x.value").alias("value")))
        if level.isEmpty():
            return rows
        rows = rows.unionByName(level)


def forbidden_paths(df: DataFrame, key: str, value: Column, names: tuple[str, ...] = FORBIDDEN, fragments: tuple[str, ...] = ()) -> DataFrame:
    """key, path and name of every forbidden name inside JSON values (a variant column), at any depth."""
    found = json_walk(df, key, value).select("key", "path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return found.filter(F.col("name").isin(*names) | (F.array_contains(F.array(*[F.contains(F.lower("name"), F.lit(f)) for f in fragments]), True) if fragments else F.lit(False)))


def context_paths(df: DataFrame, key: str, value: Column) -> DataFrame:
    """key, path and what was found of genomic contexts inside JSON values: names in any case, and texts that are a context."""
    walked = json_walk(df, key, value)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.when(F.schema_of_variant("value") == "STRING", F.variant_get("value", "$", "string"))
    found = F.when(F.lower(name).isin(*CONTEXT_FIELDS), name).when(text.isin(*CONTEXT_VALUES), text)
    return walked.select("key", "path", found.alias("found")).filter("found is not null")


def forbidden_json_keys(json: Column, names: tuple[str, ...] = FORBIDDEN) -> Column:
    """Forbidden keys anywhere in a JSON text, by a pattern; ``forbidden_paths`` says where, and reads texts as what they are."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(rf'"({"|".join(names)})"\s*:'), F.lit(1)))


def forbidden_values(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, column, value of text values, in columns and in lists of text, that match a pattern (a genomic context, say)."""
    cells = [F.array(F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, kind in df.dtypes if kind == "string"]
    of = lambda c: lambda v: F.struct(F.lit(c).alias("column"), v.alias("value"))
    cells += [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), of(c)) for c, kind in df.dtypes if kind == "array<string>"]
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(F.concat(*cells)).alias("x")).select("key", "x.*")
    return rows.filter(F.col("value").rlike(pattern))


def reproducible(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that one of two builds has more often than the other."""
    return first.exceptAll(second).withColumn("only_in", F.lit("FIRST")).unionAll(second.exceptAll(first).withColumn("only_in", F.lit("SECOND")))
