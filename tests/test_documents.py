"""Schemas compiled to columns: each keyword, the entities and their mutations, against a plain validator."""

import copy
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracequill.functions import documents, entities
from tracequill.functions.documents import Compiler, Registry, SchemaError
from tracequill.plans import contracts, registered  # noqa: F401

DOCUMENTS = entities.catalog() | entities.registry()
SHA = "ab" * 32
T0 = "2026-01-02T03:04:05Z"


# a plain validator ------------------------------------------------------------------------------------------------------------------


def is_type(x, name):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {
        "object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "number": number, "integer": number and (isinstance(x, int) or x == math.floor(x)),
    }[name]


def same(a, b):
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def plain(schema, x, base, docs, place=""):
    """(path, keyword, detail) of every violation, keyword by keyword."""
    if schema is True:
        return []
    if schema is False:
        return [(place, "false", "")]
    at = lambda step: f"{place}/{step}" if place else str(step)
    shown = lambda k: json.dumps(schema[k], ensure_ascii=False, separators=(",", ":"))
    out = []
    obj, arr, text = isinstance(x, dict), isinstance(x, list), isinstance(x, str)
    number = is_type(x, "number")
    valid = lambda s: not plain(s, x, base, docs, place)
    props = schema.get("properties", {})
    others = sorted(n for n in x if n not in props and not any(re.search(p, n) for p in schema.get("patternProperties", {}))) if obj else []
    for k, v in schema.items():
        if k == "$ref":
            document, _, pointer = v.partition("#")
            base_ = document or base
            target = docs[base_]
            for step in pointer.split("/")[1:]:
                target = target[step]
            out += plain(target, x, base_, docs, place)
        elif k == "type":
            names = [v] if isinstance(v, str) else v
            out += [] if any(is_type(x, n) for n in names) else [(place, k, ",".join(names))]
        elif k == "enum":
            out += [] if any(same(x, y) for y in v) else [(place, k, shown(k))]
        elif k == "const":
            out += [] if same(x, v) else [(place, k, shown(k))]
        elif k == "required" and obj:
            out += [(place, k, n) for n in v if n not in x]
        elif k == "dependentRequired" and obj:
            out += [(place, k, o) for n, others_ in v.items() for o in others_ if n in x and o not in x]
        elif k == "properties" and obj:
            for n, s in v.items():
                out += plain(s, x[n], base, docs, at(n)) if n in x else []
        elif k == "patternProperties" and obj:
            out += [e for p, s in v.items() for n in sorted(x) if re.search(p, n) for e in plain(s, x[n], base, docs, at(n))]
        elif k == "propertyNames" and obj:
            out += [e for n in sorted(x) for e in plain(v, n, base, docs, at(n))]
        elif k == "additionalProperties":
            out += [(place, k, n) for n in others] if v is False else [] if v is True else [e for n in others for e in plain(v, x[n], base, docs, at(n))]
        elif k == "items" and arr:
            out += [e for i, y in enumerate(x) for e in plain(v, y, base, docs, at(i))]
        elif k == "uniqueItems" and arr and v:
            out += [(place, k, "")] if len({json.dumps(y, sort_keys=True) for y in x}) < len(x) else []
        elif k == "allOf":
            out += [e for s in v for e in plain(s, x, base, docs, place)]
        elif k == "anyOf":
            out += [] if any(valid(s) for s in v) else [(place, k, "")]
        elif k == "oneOf":
            out += [] if sum(valid(s) for s in v) == 1 else [(place, k, "")]
        elif k == "not":
            out += [(place, k, "")] if valid(v) else []
        elif k == "if":
            out += plain(schema.get("then" if valid(v) else "else", True), x, base, docs, place)
        elif k == "format" and text and v == "date-time":
            out += [] if re.search(documents.FORMATS[v], x) else [(place, k, v)]
        else:
            broken = {
                "minLength": lambda: text and len(x) < v, "maxLength": lambda: text and len(x) > v, "pattern": lambda: text and not re.search(v, x), "minimum": lambda: number and x < v, "maximum": lambda: number and x > v,
                "exclusiveMinimum": lambda: number and x <= v, "exclusiveMaximum": lambda: number and x >= v, "multipleOf": lambda: number and x % v != 0, "minItems": lambda: arr and len(x) < v, "maxItems": lambda: arr and len(x) > v,
                "minProperties": lambda: obj and len(x) < v, "maxProperties": lambda: obj and len(x) > v,
            }
            out += [(place, k, shown(k))] if k in broken and broken[k]() else []
    return out


def found(spark, compiler, name, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, doc string")
    out = {i: [] for i in range(len(values))}
    for r in documents.violations(rows.withColumn("v", F.parse_json("doc")), compiler, name, F.col("v"), "i").collect():
        out[r.i].append((r.path, r.keyword, r.detail))
    return [sorted(v) for v in out.values()]


# keywords ---------------------------------------------------------------------------------------------------------------------------

SCHEMAS = [
    {"type": ["integer", "null"]}, {"type": "number"}, {"enum": ["a", 1, None, True, [1, {"b": 2}]]}, {"const": 0}, {"const": False}, {"const": {"b": [1, 2]}}, {"minimum": 1.5, "exclusiveMaximum": 3}, {"multipleOf": 2},
    {"minLength": 2, "maxLength": 3, "pattern": "^[a-é]"}, {"minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "integer"}}, {"minProperties": 1, "maxProperties": 2, "required": ["a"]},
    {"properties": {"a": {"type": "string"}, "x/y \"z'": {"const": 1}}, "additionalProperties": False}, {"properties": {"a": True}, "patternProperties": {"^b": {"minimum": 2}}, "additionalProperties": {"type": "boolean"}},
    {"propertyNames": {"maxLength": 1}}, {"dependentRequired": {"a": ["b", "c"]}}, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, {"oneOf": [{"type": "number"}, {"minimum": 2}]}, {"not": {"type": "object"}},
    {"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"required": ["b"]}, "else": {"maxProperties": 1}}, {"allOf": [{"type": "object"}, {"required": ["q"]}]}, {"format": "date-time"}, False, True,
    {"items": {"properties": {"a": {"items": {"$ref": "#/$defs/deep"}}}}, "$defs": {"deep": {"required": ["k"], "additionalProperties": False, "properties": {"k": {"enum": ["é", 2]}}}}}, {"if": {"type": "string"}, "else": False},
]

VALUES = [
    None, True, False, 0, 1, 2, 1.0, 2.5, -3, 10**12, "", "a", "ab", "é", "abcd", T0, "2026-13-01T00:00:00Z", "2026-01-01 00:00:00", [], [1], [1, 1], [1, 2, 3], [1.0, "x"], [[1], [1]], {}, {"a": 1}, {"a": "s", "b": 1}, {"a": None}, {"b": 3, "c": True, "d": 4},
    {"a": 1, "b": 2, "c": 3}, {"x/y \"z'": 2}, {"b": [1, 2]}, {"a": 1, "q": 1}, [{"a": [{"k": "é"}, {"k": 1, "z": 1}, {}]}, {"a": 3}], [1, {"b": 2}], {"long name": 1}, "a\nb",
]


@pytest.mark.parametrize("schema", SCHEMAS, ids=lambda s: json.dumps(s)[:50])
def test_keyword(spark, schema):
    compiler = Compiler(Registry({"s": schema}), formats=("date-time",))
    assert found(spark, compiler, "s", VALUES) == [sorted(plain(schema, v, "s", {"s": schema})) for v in VALUES]


def test_what_is_refused():
    for schema in ({"typo": 1}, {"type": "text"}, {"$ref": "#/$defs/no"}, {"$ref": "other"}, {"properties": {"a": {"$ref": "#"}}}):
        with pytest.raises((SchemaError, Exception)) as e:
            Compiler(Registry({"s": schema})).violations("s", "v")
        assert isinstance(e.value, SchemaError)


def test_references_between_documents(spark):
    docs = {"one": {"$id": "http://x.example/a/one.json", "$ref": "defs.json#/$defs/n"}, "two": {"$id": "http://x.example/a/b/two.json", "items": {"$ref": "../defs.json#/$defs/n"}}, "defs": {"$id": "http://x.example/a/defs.json", "$defs": {"n": {"$ref": "#/$defs/m"}, "m": {"minimum": 3}}}}
    compiler = Compiler(Registry(docs))
    assert found(spark, compiler, "one", [2, 3]) == [[("", "minimum", "3")], []]
    assert found(spark, compiler, "two", [[2, 3, 1]]) == [[("0", "minimum", "3"), ("2", "minimum", "3")]]


def test_structs_as_documents(spark):
    rows = spark.sql("select 1 as i, named_struct('a', 1, 'b', cast(null as string), 'c', array(named_struct('d', 'x'))) as s union all select 2, null")
    schema = {"additionalProperties": False, "properties": {"a": {"minimum": 2}, "c": {"items": {"properties": {"d": {"minLength": 2}}}}}, "required": ["b"]}
    got = documents.violations(rows.withColumn("v", documents.document(F.col("s"))), Compiler(Registry({"s": schema})), "s", F.col("v"), "i").collect()
    assert sorted(tuple(r) for r in got) == [(1, "", "required", "b"), (1, "a", "minimum", "2"), (1, "c/0/d", "minLength", "2")]


def test_texts_that_are_no_documents(spark):
    rows = spark.createDataFrame([(1, "{"), (2, "{}"), (3, None), (4, "")], "i int, doc string")
    got = documents.text_violations(rows, Compiler(Registry({"s": {"required": ["a"]}})), "s", F.col("doc"), "i").collect()
    assert sorted(tuple(r) for r in got) == [(1, "", "json", ""), (2, "", "required", "a"), (4, "", "json", "")]


# entities ---------------------------------------------------------------------------------------------------------------------------


def value(v="x", method="RULE_EXACT", **more):
    extra = {"RULE_EXACT": {"normalizer": {"id": "r", "version": "1"}}, "SOURCE_CONTROLLED": {"normalizer": {"id": "r", "version": "1"}}, "ML_PROPOSED": {"ml": {"model_id": "m", "model_version": "1", "input_sha256": SHA}}, "UNRESOLVED": {}, "CURATED": {"curation": {"curator": "c", "decided_at": T0, "rationale": "r"}}}[method]
    return {"raw_value": "raw", "value": v, "method": method, "confidence": 1.0} | extra | more


def good():
    head, terms, ids = {"schema_version": entities.CATALOG_VERSION}, {"terms_id": "t", "compatibility": "COMPATIBLE", "snapshot_sha256": SHA, "snapshot_retrieved_at": T0}, ["src-1"]
    agent, entity = {"type": "SOFTWARE", "id": "a"}, {"kind": "SEQUENCING_RUN", "id": "run-1", "sha256": SHA}
    step = {"from_state": None, "to_state": "CATALOGUED", "at": T0, "actor": agent, "reason": "found", "policy_version": "1.0.0"}
    run = {
        "schema_version": "1.0.0", "benchmark_run_id": "r", "experiment_id": "e", "observation_origin": "REGENERATED", "query_artifact_id": "q", "truth_artifact_id": "t", "reference_artifact_id": "f", "comparator": "c", "comparator_version": "1", "engine": "e", "engine_version": "1",
        "environment_lock_id": "l", "run_status": "SUCCEEDED", "command_argv": ["x"], "output_artifact_ids": ["o"], "runtime_image_digest": "sha256:" + SHA, "started_at": T0, "completed_at": T0,
    }
    interval = {"assembly": "A", "contig": "1", "start_0based": 0, "end_0based": 5}
    variant = {"schema_version": "1.0.0", "variant_id": "variant:sha256:" + SHA, "assembly": "A", "contig": "1", "normalized_start_0based": 0, "normalized_end_0based": 1, "normalized_ref": "A", "normalized_alt": "T", "source_normalization_methods": "m", "source_normalization_versions": "1", "reference_artifact_id": "f", "identity_schema_version": "phase1b-variant-identity-v1"}
    link = {"schema_version": "1.0.0", "event_variant_link_id": "event-variant-link:sha256:" + SHA, "event_id": "e", "variant_id": variant["variant_id"], "benchmark_run_id": "r", "identity_status": "EXACT_NORMALIZED_ALLELE", "identity_method": "PHASE1B_EXACT_NORMALIZED_ALLELE_V1", "identity_method_version": "1.0.0", "evidence": "{}", "provenance": "{}"}
    return {
        "organism": head | {"organism_id": "taxon:9606", "ncbi_taxonomy_id": 9606, "scientific_name": "n", "rank": "species", "taxonomy_snapshot": {"source_id": "ncbi_taxonomy", "retrieved_at": T0}},
        "reference_assembly": head | {"assembly_id": "a", "ncbi_taxonomy_id": 1, "assembly_name": "A", "insdc_accession": "GCA_000001405.15", "refseq_accession": "GCF_000001405.26", "aliases": ["h"], "verification_status": "SOURCE_REPORTED_UNVERIFIED"},
        "reference_sequence_set": head | {"sequence_set_id": "s", "assembly_id": "a", "label": "l", "includes_alt_contigs": False, "includes_decoys": None, "contig_naming": "MIXED"},
        "study": head | {"study_id": "s", "accessions": {"bioproject": "PRJNA1"}, "title": "t", "source_record_ids": ids},
        "sample": head | {"sample_id": "s", "organism": value(9606), "aliases": [{"namespace": "n", "value": "v", "source_record_id": "r"}], "access_class": "OPEN", "source_record_ids": ids},
        "sequencing_run": head | {
            "run_id": "run-1", "run_accession": "SRR000001", "sample_id": "s", "study_id": "s", "library": {n: value() for n in ("strategy", "source", "selection", "layout")}, "assay": value(), "read_type": value("UNKNOWN", "UNRESOLVED", confidence=0), "basecaller": "NOT_APPLICABLE",
            "platform": {n: value() for n in ("technology_family", "vendor", "instrument_family", "instrument_model", "read_mode")} | {"chemistry": [value("c", "CURATED")]}, "coverage": {"status": "UNKNOWN", "value": None}, "public_file_artifact_ids": [], "source_record_ids": ids,
        },
        "source_record": head | {"source_record_id": "s", "source_id": "s", "source_accession": "x", "canonical_accession": "x", "mirror_group_id": None, "retrieved_at": T0, "query": {"endpoint": "https://h/x", "parameters": {"any": [1]}, "parameters_sha256": SHA}, "raw_snapshot_sha256": SHA, "raw_snapshot_uri": "u", "terms": terms},
        "publication": head | {"publication_id": "p", "title": "t", "identifiers": {"doi": "10.1234/x"}},
        "truth_source": head | {"truth_source_id": "t", "provider": "p", "release_version": "1", "sample_id": "s", "assembly_id": "a", "sequence_set_id": "s", "evidence_domain": "OTHER", "truth_artifact_id": "a", "confident_regions_artifact_id": "c", "terms": terms},
        "derived_artifact": head | {"artifact_id": "a", "artifact_kind": "VCF", "origin": "ATLAS_DERIVED", "uri": "s3://b/k", "size_bytes": 1, "checksum": {"algorithm": "sha256", "value": SHA, "source": "ATLAS_BUILD"}, "assembly_id": "a", "produced_by": {"pipeline": "p", "software": "s", "version": "1"}, "derived_from": [entity], "availability": "PUBLIC"},
        "provenance_activity": head | {"activity_id": "a", "activity_type": "VALIDATION", "started_at": T0, "ended_at": T0, "agent": agent, "used": [], "generated": [entity]},
        "catalog_record": head | {
            "record_id": "r", "record_version": 1, "record_kind": "STUDY", "entity_ref": entity, "layer": "VALIDATED_RELEASE", "eligibility_state": "RELEASED", "state_history": [step, step | {"from_state": "CATALOGUED"}], "normalization_state": "NORMALIZED",
            "normalization_confidence": {"minimum_hard_gate_confidence": 1, "ml_only_hard_gate_fields": [], "unresolved_hard_gate_fields": []}, "discovered_at": T0, "last_seen_at": T0, "source_record_ids": ids, "duplicate_cluster_id": "d", "canonical_in_cluster": True, "terms": terms, "release_memberships": ["1.0.0"],
        },
        "eligibility_assessment": head | {"assessment_id": "a", "record_id": "r", "record_version": 1, "policy_version": "1.0.0", "evaluated_at": T0, "evaluator": agent, "hard_gate_fields": [{"field": "f", "method": "CURATED"}], "criteria": [{"criterion_id": "E01", "decision": "PASS", "basis": "b"}], "outcome": "ELIGIBLE"},
        "release_manifest": head | {
            "release_version": "1.0.0", "release_kind": "MAJOR", "previous_release": None, "created_at": T0, "entity_schema_version": "1", "policy_versions": {n: "1.0.0" for n in entities.POLICIES}, "git": {"tag": "v1.0.0", "commit": "a" * 40},
            "source_snapshot": {"snapshot_id": "s", "taken_at": T0, "sources": [{"source_id": "s", "retrieved_at": T0, "raw_snapshot_sha256": SHA}]}, "records": [{"record_id": "r", "record_version": 1, "content_sha256": SHA}], "artifacts": [{"path": "p", "sha256": SHA, "size_bytes": 0}],
            "checksums_manifest": {"path": "p", "sha256": SHA}, "validation_report": {"path": "p", "sha256": SHA, "verdict": "PASS", "gates_passed": 1, "gates_total": 1}, "provenance": {"build_activity_id": "b", "workflow": "w"}, "zenodo": {"deposit_status": "NOT_DEPOSITED"}, "website": {"release_path": "/r", "is_latest_at_publication": True},
        },
        "event": {"schema_version": "1.0.0", "event_id": "e", "identity_scope": "COMPARATOR_SUPERLOCUS", "benchmark_run_id": "r", "reference_artifact_id": "f", "assembly": "A", "contig": "1", "start_0based": 0, "end_0based": 1, "source_event_id": "s", "derivation_method": "d", "cross_run_equivalence_asserted": False},
        "observation": {
            "schema_version": "1.0.0", "observation_id": "o", "benchmark_run_id": "r", "event_id": "e", "side": "TRUTH", "observation_origin": "REGENERATED", "raw_decision": "TP", "normalized_decision": "TP", "raw_match_kind": "gm", "region_status": "INSIDE", "source_output_artifact_id": "a", "source_record_ordinal": 1,
            "source_contig": "1", "source_pos_1based": 1, "source_ref": "A", "source_alt": "T", "source_filter": [], "quality_score": 1.5, "normalization_method": "m", "normalization_version": "1", "normalized_start_0based": None,
        },
        "experiment": {"schema_version": "1.0.0", "experiment_id": "e", "source_corpus": "c", "source_submission_id": "s", "sample_id": "s", "technology": "ONT", "platform": "p", "coverage": "30x", "pipeline_name": "p", "caller_names": ["c"], "caller_versions": ["1"], "reference_assembly": "A", "metadata_artifact_ids": ["m"], "performance_consulted_for_selection": False},
        "benchmark_run": run | {"benchmark_bed_artifact_id": "b", "core_interval": interval, "padded_interval": interval},
        "benchmark_run_2": run | {
            "schema_version": "2.0.0", "benchmark_region_set_artifact_id": "b", "benchmark_region_set_sha256": SHA, "retrieval_region_set_artifact_id": "r", "retrieval_region_set_sha256": SHA, "reference_assembly": "GRCh38", "retrieval_padding_bp": 0,
            "benchmark_region_set": {"assembly": "GRCh38", "coordinate_system": "0-based half-open", "selected_window_count": 1, "segment_count": 1, "context_count": 1, "chromosome_count": 1, "chromosomes": ["1"], "excluded_chromosomes": [], "assessable_bases": 1},
        },
        "source_artifact": {"schema_version": "1.0.0", "source_artifact_id": "a", "artifact_name": "n", "artifact_role": "OTHER", "uri": "u", "media_type": "m", "byte_size": None, "version": "1", "checksums": [{"algorithm": "md5", "value": "a" * 32, "source": "PUBLISHER"}], "checksum_status": "PUBLISHER_VERIFIED", "retrieval_status": "DOWNLOADED", "retrieved_at": T0, "license_expression": "l", "reuse_basis": "r", "derivation_state": "SOURCE"},
        "provenance_link": {"schema_version": "1.0.0", "provenance_link_id": "p", "source_entity_type": "EVENT", "source_entity_id": "e", "target_entity_type": "OBSERVATION", "target_entity_id": "o", "relation": "USED", "asserted_at": T0, "asserted_by": "a", "transformation": "t"},
        "variant": variant | {"normalization_method": "UPSTREAM_PHASE1A_NORMALIZED_FIELDS", "phase1b_origin": "GENERATED_FROM_EXACT_NORMALIZED_ALLELE"},
        "variant_2": variant | {"normalization_method": "UPSTREAM_PHASE2C_NORMALIZED_FIELDS", "phase2d_origin": "GENERATED_FROM_PHASE2C_EXACT_NORMALIZED_ALLELE", "phase2d_application_version": "1.0.0", "phase2c_archive_sha256": SHA},
        "event_variant_link": link | {"created_from_candidate": True, "candidate_id": "candidate:sha256:" + SHA, "candidate_number": 1, "phase1a_candidate_status": "CROSS_RUN_EQUIVALENCE_UNRESOLVED"},
        "event_variant_link_2": link | {"phase2d_application_version": "1.0.0", "variant_origin": "PHASE2D_NEW", "phase2c_archive_sha256": SHA, "admitted_sources_lock_sha256": SHA, "interval_panel_lock_sha256": SHA},
    }


def put(name, new, *path):
    doc = good()[name]
    at = doc
    for step in path[:-1]:
        at = at[step]
    if new is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = new
    return name, doc


#: A mutation and a violation that it must give.
MUTATIONS = [
    (put("organism", ..., "ncbi_taxonomy_id"), ("", "required", "ncbi_taxonomy_id")), (put("organism", "1.0.0", "schema_version"), ("schema_version", "const")), (put("reference_assembly", ..., "ncbi_taxonomy_id"), ("", "required", "ncbi_taxonomy_id")),
    (put("reference_assembly", "GCF_000001405.26", "insdc_accession"), ("insdc_accession", "pattern")), (put("reference_assembly", "VERIFIED_AGAINST_NCBI", "verification_status"), ("", "required", "verified_at")), (put("sequencing_run", ..., "platform", "vendor"), ("platform", "required", "vendor")),
    (put("sequencing_run", "Illumina NovaSeq 6000", "platform"), ("platform", "type", "object")), (put("sequencing_run", ..., "sample_id"), ("", "required", "sample_id")), (put("sequencing_run", "SAMN00000001", "run_accession"), ("run_accession", "pattern")),
    (put("sequencing_run", {"status": "UNKNOWN", "value": 30}, "coverage"), ("coverage/value", "type", "null")), (put("sequencing_run", {"status": "COMPUTED_FROM_BASES", "value": 30}, "coverage"), ("coverage", "required", "genome_size_assembly_id")),
    (put("sequencing_run", {"raw_value": "x", "value": "y", "method": "ML_PROPOSED", "confidence": 0.99}, "platform", "instrument_model"), ("platform/instrument_model", "required", "ml")), (put("sequencing_run", value("illumina", "UNRESOLVED", confidence=0), "platform", "vendor"), ("platform/vendor/value", "const")),
    (put("sequencing_run", value(confidence=1.5), "platform", "read_mode"), ("platform/read_mode/confidence", "maximum")), (put("sequencing_run", value(confidence=2), "platform", "chemistry", 0), ("platform/chemistry/0/confidence", "maximum")), (put("sequencing_run", {"name": value()}, "basecaller"), ("basecaller", "oneOf")),
    (put("sequencing_run", value(ml={"model_id": "m", "model_version": "1", "input_sha256": SHA}), "assay"), ("assay", "not")), (put("sample", ..., "access_class"), ("", "required", "access_class")), (put("sample", value("human"), "organism"), ("organism/value", "anyOf")), (put("source_record", ..., "raw_snapshot_sha256"), ("", "required", "raw_snapshot_sha256")),
    (put("source_record", {"terms_id": "t", "compatibility": "COMPATIBLE"}, "terms"), ("terms", "required", "snapshot_sha256")), (put("truth_source", ..., "assembly_id"), ("", "required", "assembly_id")), (put("derived_artifact", {"algorithm": "md5", "value": "0" * 32, "source": "ATLAS_BUILD"}, "checksum"), ("checksum/algorithm", "const")),
    (put("derived_artifact", "UNKNOWN", "checksum"), ("checksum", "type", "object")), (put("derived_artifact", ..., "assembly_id"), ("", "required", "assembly_id")), (put("derived_artifact", [], "derived_from"), ("derived_from", "minItems")), (put("provenance_activity", [], "generated"), ("generated", "minItems")),
    (put("catalog_record", "CATALOGUED", "eligibility_state"), ("layer", "const")), (put("catalog_record", "EVIDENCE_CANDIDATE", "layer"), ("layer", "const")), (put("catalog_record", ..., "release_memberships"), ("", "required", "release_memberships")),
    (put("catalog_record", {"terms_id": "t", "compatibility": "UNREVIEWED"}, "terms"), ("terms/compatibility", "const")), (put("catalog_record", False, "canonical_in_cluster"), ("canonical_in_cluster", "const")), (put("catalog_record", ["f"], "normalization_confidence", "ml_only_hard_gate_fields"), ("normalization_confidence/ml_only_hard_gate_fields", "maxItems")),
    (put("catalog_record", "NOWHERE", "state_history", 1, "to_state"), ("state_history/1/to_state", "enum")), (put("eligibility_assessment", ..., "hard_gate_fields"), ("", "required", "hard_gate_fields")), (put("eligibility_assessment", "VALIDATED", "outcome"), ("outcome", "enum")), (put("release_manifest", "FAIL", "validation_report", "verdict"), ("validation_report/verdict", "const")),
    (put("release_manifest", ..., "checksums_manifest"), ("", "required", "checksums_manifest")), (put("release_manifest", {"deposit_status": "DEPOSITED"}, "zenodo"), ("zenodo", "required", "version_doi")), (put("study", {}, "accessions"), ("accessions", "minProperties")), (put("publication", 1, "extra"), ("", "additionalProperties", "extra")),
    (put("event", ..., "source_event_id"), ("", "required", "source_event_id")), (put("event", True, "cross_run_equivalence_asserted"), ("cross_run_equivalence_asserted", "const")), (put("observation", 0, "source_record_ordinal"), ("source_record_ordinal", "minimum")), (put("benchmark_run", [], "command_argv"), ("command_argv", "minItems")),
    (put("benchmark_run", "yesterday", "started_at"), ("started_at", "format")), (put("benchmark_run_2", 0, "benchmark_region_set", "segment_count"), ("benchmark_region_set/segment_count", "minimum")), (put("source_artifact", [], "checksums"), ("checksums", "minItems")), (put("source_artifact", None, "retrieved_at"), ("retrieved_at", "type", "string")),
    (put("provenance_link", "RUN", "source_entity_type"), ("source_entity_type", "enum")), (put("variant", "v", "variant_id"), ("variant_id", "pattern")), (put("variant_2", ..., "phase2c_archive_sha256"), ("", "required", "phase2c_archive_sha256")), (put("event_variant_link", 1667, "candidate_number"), ("candidate_number", "maximum")), (put("event_variant_link_2", "OLD", "variant_origin"), ("variant_origin", "enum")),
]


def damaged(rng, doc):
    """A document with a random change somewhere."""
    doc = copy.deepcopy(doc)
    places = []

    def walk(x):
        for k in list(x) if isinstance(x, dict) else range(len(x)):
            places.append((x, k))
            if isinstance(x[k], (dict, list)):
                walk(x[k])

    walk(doc)
    at, k = rng.choice(places)
    kind = rng.randint(0, 3)
    if kind == 0:
        del at[k]
    elif kind == 1 and isinstance(at, dict):
        at["stray"] = 1
    else:
        at[k] = rng.choice([None, True, 0, -1, 1.5, "", "X", "UNKNOWN", [], ["a", "a"], {}, {"type": 1}])
    return doc


@pytest.mark.parametrize("name", sorted(set(DOCUMENTS) - {"shared"}))
def test_entity(spark, name):
    """The good document holds; listed mutations give their violation; random damage gives what the plain validator finds."""
    rng = random.Random(name)
    values = [good()[name], *[doc for (n, doc), _ in MUTATIONS if n == name], *[damaged(rng, good()[name]) for _ in range(12)]]
    got = found(spark, entities.compiler(), name, values)
    assert got[0] == []
    for (_, want), violations in zip([m for m in MUTATIONS if m[0][0] == name], got[1:], strict=False):
        assert any(v[: len(want)] == want for v in violations), (want, violations)
    assert got == [sorted(plain(DOCUMENTS[name], v, name, DOCUMENTS)) for v in values]


def test_a_small_file_is_work_for_all_tasks(spark):
    from tracequill.plans import contracts, registered  # noqa: F401

    parts = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    assert parts.rdd.getNumPartitions() == 1
    spread = documents.spread(parts, "p_partkey")
    assert spread.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and spread.exceptAll(parts).isEmpty() and spread.count() == parts.count()
    assert "REPARTITION_BY_NUM" in registered.queries()["run_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_structs_are_the_documents_that_json_makes_of_them(spark):
    inner = "struct<n: bigint, t: string, d: double, l: array<string>, x: decimal(10, 2)>"
    rows = spark.sql(f"""SELECT id, from_json(text, 's struct<n: bigint, b: boolean, d: double, f: float, t: string, `odd``"n`: int, o: {inner}, e: struct<>, l: array<bigint>, w: array<array<string>>, r: array<{inner}>, m: map<string, int>, Z: int>').s AS s FROM VALUES
        (1, '{{"s": {{}}}}'), (2, '{{"s": {{"n": 3, "b": true, "d": 1.0, "f": 0.1, "t": "SHIPPED", "o": {{}}, "e": {{}}, "l": [], "r": [], "m": {{}}}}}}'),
        (3, '{{"s": {{"n": -1, "b": false, "d": 2.5, "t": "", "odd`\\"n": 1, "o": {{"n": 1, "t": "ab", "d": 0.5, "l": ["a", "a", null], "x": 1.50}}, "l": [1, null, 1, 7], "w": [["a"], null, ["a"], [null]], "Z": 5}}}}'),
        (4, '{{"s": {{"n": 9007199254740993, "d": -0.0, "t": "x\\u00e9", "r": [null, {{"n": 2}}, {{"t": "SHIPPED", "l": []}}, {{"n": 2}}], "m": {{"k": 1, "t": 2}}, "l": [2, 3]}}}}'), (5, '{{"s": null}}') AS t(id, text)
        UNION ALL SELECT 6, named_struct('n', 1L, 'b', NULL, 'd', double('NaN'), 'f', float('Infinity'), 't', NULL, 'odd`"n', NULL, 'o', named_struct('n', 1L, 't', 't', 'd', double('-Infinity'), 'l', array('q'), 'x', 2.00), 'e', NULL, 'l', array(4L), 'w', NULL, 'r', NULL, 'm', NULL, 'Z', NULL)""")
    kinds = ("object", "array", "string", "boolean", "null", "number", "integer")
    of_any = [{"type": k} for k in kinds] + [{"const": x} for x in (1, 1.0, True, "SHIPPED", None, [], {}, [1, None, 1, 7], "NaN")] + [{"enum": [3, "SHIPPED", None, False]}, {"pattern": "^[A-Z]+$"}, {"minLength": 2}, {"maxLength": 2}, {"minimum": 2}]
    of_any += [{"maximum": 2}, {"exclusiveMinimum": 1}, {"exclusiveMaximum": 1}, {"multipleOf": 0.5}, {"multipleOf": 2}, {"minItems": 1}, {"maxItems": 1}, {"uniqueItems": True}, {"minProperties": 1}, {"maxProperties": 1}, False]
    of_any += [{"items": s} for s in of_any] + [{"anyOf": of_any[:3]}, {"oneOf": [{"type": "number"}, {"minimum": 2}]}, {"not": {"type": "string"}}, {"required": ["n", "gone"]}, {"properties": {"n": {"minimum": 2}, "x": {"type": "number"}, "l": {"items": {"const": "a"}}, "gone": False}}]
    of_any += [{"if": {"type": "array", "minItems": 1}, "then": {"items": {"required": ["n"]}}, "else": {"additionalProperties": False, "properties": {"n": True}}}]
    names = ["n", "b", "d", "f", "t", 'odd`"n', "o", "e", "l", "w", "r", "m", "Z", "z", "gone"]
    schemas = [{"properties": dict.fromkeys(names, s)} for s in of_any] + [{"required": names}, {"additionalProperties": False, "properties": {"n": True}}, {"additionalProperties": {"type": "number"}}, {"patternProperties": {"^[a-m]$": {"type": "number"}}, "additionalProperties": False}]
    schemas += [{"propertyNames": {"maxLength": 1}}, {"dependentRequired": {"n": ["t", "gone"], "gone": ["n"]}}, {"minProperties": 2}, {"const": {"n": 1}}, {"type": "object"}, {"type": "array"}, {"properties": {"r": {"items": {"additionalProperties": False, "required": ["n"], "properties": {"n": {"minimum": 3}}}}}}]
    compiler = Compiler(Registry({"all": {"allOf": schemas}}))
    of = lambda value: sorted((r.id, r.path, r.keyword, r.detail) for r in documents.violations(rows, compiler, "all", value, "id").collect())
    assert of(F.col("s")) == of(documents.document(F.col("s"))) and len(of(F.col("s"))) > 500


def test_fields_that_differ_in_case_alone(spark):
    rows = spark.sql("SELECT 1 AS i, named_struct('a', 1, 'A', 'x') AS s")
    got = documents.violations(rows, Compiler(Registry({"s": {"properties": {"a": {"type": "string"}, "A": {"type": "string"}}}})), "s", F.col("s"), "i").collect()
    assert [(r.path, r.keyword) for r in got] == [("a", "type")]


@pytest.mark.parametrize("name", ["event_documents", "run_documents", "catalog_documents"])
def test_tables_are_judged_without_making_documents_of_them(spark, name):
    plan = registered.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan and "json" not in plan.lower()
