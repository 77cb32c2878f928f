"""Public-metadata catalog: vocabulary ladder, list columns, record normalization, summary."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.functions import canonical, text

# Platform name -> technology and vendor.
PLATFORM_RULES = {
    "illumina": ("short_read_sbs", "illumina"),
    "oxford nanopore": ("nanopore", "oxford_nanopore"),
    "pacbio smrt": ("smrt", "pacbio"),
    "ion torrent": ("semiconductor", "thermo_ion_torrent"),
    "ls454": ("pyrosequencing", "roche_454"),
    "capillary": ("capillary_electrophoresis", "capillary_vendors"),
    "complete genomics": ("short_read_dnb", "mgi"),
    "bgiseq": ("short_read_dnb", "mgi"),
    "dnbseq": ("short_read_dnb", "mgi"),
    "element": ("short_read_avidity", "element"),
    "ultima": ("short_read_flow_sbs", "ultima"),
}


def resolved(raw: Column, value: Column, method: str) -> Column:
    """raw, value, method and confidence; UNKNOWN and UNRESOLVED where there is no value."""
    return F.struct(
        raw.alias("raw_value"), F.coalesce(value, F.lit("UNKNOWN")).alias("value"),
        F.when(value.isNull(), F.lit("UNRESOLVED")).otherwise(F.lit(method)).alias("method"), F.when(value.isNull(), F.lit(0.0)).otherwise(F.lit(1.0)).alias("confidence"),
    )


def from_source(raw: Column) -> Column:
    return resolved(raw, text.optional(raw), "SOURCE_CONTROLLED")


def vocabulary(spark: SparkSession, taxonomy: Mapping[str, Any]) -> DataFrame:
    """alias, model, family, technology, vendor: a row for each alias of a model or of a family."""
    families = {f["id"]: f for f in taxonomy["instrument_families"]}
    squash = lambda x: " ".join(x.strip().casefold().replace("_", " ").replace("-", " ").split())
    rows: dict[str, tuple] = {}
    for f in families.values():
        for alias in (f["label"], *f["family_level_aliases"]):
            rows[squash(alias)] = ("UNSPECIFIED", f["id"], f["technology_family_id"], f["vendor_id"])
    for m in taxonomy["instrument_models"]:
        f = families[m["instrument_family_id"]]
        for alias in (m["label"], *m["source_aliases"]):
            rows[squash(alias)] = (m["id"], f["id"], f["technology_family_id"], f["vendor_id"])
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "alias string, model string, family string, technology string, vendor string")


def with_technology(df: DataFrame, vocabulary_rows: DataFrame, platform: str = "instrument_platform", model: str = "instrument_model") -> DataFrame:
    """df with technology_family, vendor, instrument_family and instrument_model as resolved values.

    A model's alias decides, else a family's, else the platform's rule for technology and vendor alone.
    """
    raw_model, raw_platform = text.optional(F.col(model)), text.optional(F.col(platform))
    # The vocabulary is a fixed configuration of a few hundred aliases.
    rows = df.withColumn("__key", text.alias_key(raw_model)).join(F.broadcast(vocabulary_rows.select(*[F.col(c).alias(f"__{c}") for c in vocabulary_rows.columns])), F.col("__key") == F.col("__alias"), "left")
    key = text.alias_key(raw_platform)
    by_rule = lambda i: F.coalesce(*[F.when(key == name, F.lit(rule[i])) for name, rule in PLATFORM_RULES.items()])
    known = F.col("__family").isNotNull()
    of = lambda name, i: F.when(known, resolved(raw_model, F.col(name), "RULE_EXACT")).otherwise(resolved(raw_platform, by_rule(i), "RULE_EXACT"))
    rows = rows.withColumns({
        "technology_family": of("__technology", 0), "vendor": of("__vendor", 1),
        "instrument_family_value": resolved(raw_model, F.col("__family"), "RULE_EXACT"), "instrument_model_value": resolved(raw_model, F.col("__model"), "RULE_EXACT"),
    })
    return rows.drop("__key", "__alias", "__model", "__family", "__technology", "__vendor")


def _file_of(rank: int, label: str, kind: str, sums: Column, sizes: Column):
    """The i-th file of parallel lists as a function of its url and i (from 0)."""
    return lambda url, i: F.struct(
        F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), (i + 1).alias("index"), text.with_scheme(url).alias("uri"),
        F.lower(F.get(sums, i)).alias("md5"), text.non_negative(F.get(sizes, i)).alias("size_bytes"),
    )


def artifacts(df: DataFrame, key: str, specs: Mapping[str, tuple[str, str, str, str]]) -> DataFrame:
    """A row for each file in parallel ;-lists: key, label, kind, index (from 1), uri, md5, size_bytes, artifact_id.

    specs: label -> (kind, urls, checksums, sizes). A uri that was named before, in the specs' order, is dropped.
    """
    parts = []
    for rank, (label, (kind, urls, sums, sizes)) in enumerate(specs.items()):
        parts_of = [F.split(F.coalesce(F.col(c), F.lit("")), ";", -1) for c in (urls, sums, sizes)]
        one = _file_of(rank, label, kind, *parts_of[1:])
        parts.append(F.when(F.coalesce(F.col(urls), F.lit("")) != "", F.transform(parts_of[0], one)).otherwise(F.array().cast("array<struct<rank:int,label:string,kind:string,index:int,uri:string,md5:string,size_bytes:bigint>>")))
    # dealt by the key first: a task that reads many rows would hold all their files to aggregate them
    rows = df.repartition(key).select(key, F.explode(F.concat(*parts)).alias("a")).select(key, "a.*")
    best = rows.groupBy(key, "uri").agg(F.min(F.struct("rank", "index", "label", "kind", "md5", "size_bytes")).alias("a"))
    rows = best.select(key, "uri", "a.*").drop("rank").withColumn("md5", F.when(text.is_md5(F.col("md5")), F.col("md5")))
    return rows.withColumn("artifact_id", F.concat_ws(":", F.lit("artifact"), key, "label", F.col("index").cast("string"), canonical.artifact_token(F.col("uri"))))


def single(values: Column, kind: str) -> Column:
    """The one value of a list that is an accession of a kind; null for none or several."""
    fit = F.filter(values, lambda v: v.rlike(text.ACCESSIONS[kind]))
    return F.when(F.size(fit) == 1, fit[0])


def normalize_runs(rows: DataFrame, vocabulary_rows: DataFrame, response_sha256: str) -> DataFrame:
    """Catalog entities of source rows; rows without a run accession are left out (see rejected_runs)."""
    absent = [c for c in ("experiment_accession", "tax_id", "scientific_name") if c not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])
    df = with_technology(rows.filter(F.col("run_accession").rlike(text.ACCESSIONS["run"])), vocabulary_rows)
    token = F.lower("run_accession")
    samples, studies = text.split_distinct(F.col("sample_accession"), F.col("secondary_sample_accession")), text.split_distinct(F.col("study_accession"), F.col("secondary_study_accession"))
    bio = F.filter(samples, lambda v: v.rlike(text.ACCESSIONS["biosample"]))
    other = F.filter(samples, lambda v: ~v.rlike(text.ACCESSIONS["biosample"]))
    several = (F.size(bio) > 1) | ((F.size(bio) == 0) & (F.size(other) > 1))
    sample = F.when(~several, F.coalesce(F.when(F.size(bio) == 1, bio[0]), F.when(F.size(other) == 1, other[0])))
    study = F.coalesce(single(studies, "bioproject"), single(studies, "study"))
    named = lambda kind, x: F.coalesce(F.concat(F.lit(f"{kind}:"), F.lower(x)), F.concat(F.lit(f"{kind}:unknown:"), token))
    record = F.concat(F.lit("source-record:ena:"), token, F.lit(":" + response_sha256[:16]))
    of_kind = lambda values, kind: F.filter(values, lambda v: v.rlike(text.ACCESSIONS[kind]))
    only = lambda values: F.when(F.size(values) == 1, F.get(values, F.lit(0)))
    projects, insdc_studies = of_kind(studies, "bioproject"), of_kind(studies, "study")
    accessions = F.struct(
        text.optional(F.col("experiment_accession")).alias("experiment_accession"), only(insdc_studies).alias("study_accession"), only(projects).alias("bioproject_accession"), only(other).alias("sample_accession"),
        only(bio).alias("biosample_accession"), other.alias("sample_accessions"), bio.alias("biosample_accessions"), insdc_studies.alias("study_accessions"), projects.alias("bioproject_accessions"),
    )
    relationship = lambda v: F.struct(
        F.col("run_accession").alias("run_accession"), v.alias("sample_accession"), F.when(v.rlike(text.ACCESSIONS["biosample"]), F.lit("BIOSAMPLE")).otherwise(F.lit("INSDC_SAMPLE")).alias("accession_type"),
        F.lit("SOURCE_REPORTED_SAMPLE").alias("relationship"), F.lit("ena").alias("source"),
    )
    status = F.when(several, F.lit("MULTIPLE_SOURCE_SAMPLES")).when(sample.isNotNull(), F.lit("ONE_SOURCE_SAMPLE")).otherwise(F.lit("UNKNOWN"))
    cardinality = F.struct(F.size(bio).alias("biosample_accession_count"), F.size(other).alias("insdc_sample_accession_count"), status.alias("normalization_status"))
    tax = text.optional(F.col("tax_id"))
    tax_id = F.when(text.non_negative(tax) > 0, text.non_negative(tax).cast("string"))
    taxonomy = F.struct(tax.alias("raw_source_taxon_value"), resolved(tax, tax_id, "SOURCE_CONTROLLED").alias("normalized_ncbi_taxonomy_id"), text.optional(F.col("scientific_name")).alias("scientific_name"), record.alias("source_record_id"))
    out = df.select(
        "*", F.concat(F.lit("run:"), token).alias("run_id"), F.concat(F.lit("catalog-record:insdc:"), token).alias("catalog_record_id"),
        record.alias("source_record_id"), F.concat(F.lit("insdc-run:"), token).alias("duplicate_cluster_id"),
        named("sample", sample).alias("sample_id"), named("study", study).alias("study_id"), several.alias("multiple_samples"), accessions.alias("accessions"),
        F.transform(samples, relationship).alias("source_sample_relationships"), cardinality.alias("source_sample_cardinality"), taxonomy.alias("taxonomy"), sample.isNull().alias("__no_sample"),
        *[from_source(F.col(f"library_{c}")).alias(f"library_{c}_value") for c in ("strategy", "source", "selection", "layout")],
    )
    unknown = lambda column, name: F.when(F.col(f"{column}.value") == "UNKNOWN", F.lit(name))
    gates = F.array_sort(F.array_compact(F.array(
        F.lit("assembly_id"), F.when(F.col("__no_sample"), F.lit("sample_id")), unknown("technology_family", "technology_family_id"), unknown("vendor", "vendor_id"),
        unknown("instrument_family_value", "instrument_family_id"), unknown("library_strategy_value", "library_strategy"), unknown("library_source_value", "library_source"),
    )))
    out = out.withColumn("unresolved_hard_gate_fields", gates).withColumn("normalization_state", F.when(F.size("unresolved_hard_gate_fields") > 0, F.lit("PARTIAL")).otherwise(F.lit("NORMALIZED")))
    return out.drop("__no_sample").withColumn("read_type", text.read_type(F.col("library_layout_value.value"), F.col("technology_family.value")))


# The two groups of files of a source row; a file that both name counts for the first.
FILES = {"fastq": ("FASTQ", "fastq_ftp", "fastq_md5", "fastq_bytes"), "submitted": ("SUBMITTED", "submitted_ftp", "submitted_md5", "submitted_bytes")}


def bundles(rows: DataFrame, vocabulary_rows: DataFrame, response_sha256: str, files: Mapping[str, tuple[str, str, str, str]] = FILES) -> DataFrame:
    """normalize_runs() with each run's derived artifacts, in order of their group and place."""
    runs = normalize_runs(rows, vocabulary_rows, response_sha256)
    found = artifacts(runs.select("run_id", *[c for spec in files.values() for c in spec[1:]]), "run_id", files)
    order = {label: i for i, label in enumerate(files)}
    rank = F.coalesce(*[F.when(F.col("label") == label, F.lit(i)) for label, i in order.items()])
    lists = found.groupBy(F.col("run_id").alias("a_run")).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "index", F.struct("artifact_id", "kind", "uri", "md5", "size_bytes").alias("file")))), lambda x: x["file"]).alias("derived_artifacts"))
    out = runs.join(lists, F.col("run_id") == F.col("a_run"), "left").drop("a_run")
    none = F.array().cast("array<struct<artifact_id:string,kind:string,uri:string,md5:string,size_bytes:bigint>>")
    return out.withColumn("derived_artifacts", F.coalesce("derived_artifacts", none))


def rejected_runs(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce(F.col("run_accession").rlike(text.ACCESSIONS["run"]), F.lit(False)))


def unresolved_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_unresolved over resolved-value columns."""
    counts = df.agg(*[F.count_if(F.col(f"{f}.method") == "UNRESOLVED").alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_unresolved")) for f in fields])).alias("r")).select("r.*")
