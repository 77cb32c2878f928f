from pyspark.sql import functions as F

from tracequill.operators import catalog, gates, policy

POLICY = {
    "initial_state": "NEW",
    "layers": [{"layer_id": "L1", "states": ["NEW", "ELIGIBILITY_PENDING", "NEEDS_REVIEW", "INELIGIBLE"]}, {"layer_id": "L2", "states": ["ELIGIBLE", "RELEASED"]}],
    "transitions": {"NEW": ["ELIGIBILITY_PENDING"], "ELIGIBILITY_PENDING": ["ELIGIBLE", "NEEDS_REVIEW"], "NEEDS_REVIEW": ["ELIGIBLE"], "ELIGIBLE": ["RELEASED"], "RELEASED": []},
    "criteria": [{"id": "E1", "hard": True, "applicability": "ALWAYS"}, {"id": "E2", "hard": True, "applicability": "CONDITIONAL"}],
    "decision_values": ["PASS", "FAIL", "UNKNOWN", "NOT_APPLICABLE"],
    "hard_gate_fields": ["a", "b"],
    "hard_gate_accepted_methods": ["CURATED"],
}
STEP = "from_state string, to_state string, at string, actor_type string, assessment_id string, release_version string"
RECORD = f"record_id string, eligibility_state string, layer string, state_history array<struct<{STEP.replace(' string', ':string')}>>, release_memberships array<string>, discovered_at string, last_seen_at string"


def test_histories(spark):
    good = [(None, "NEW", "1", "BOT", None, None), ("NEW", "ELIGIBILITY_PENDING", "2", "BOT", None, None), ("ELIGIBILITY_PENDING", "NEEDS_REVIEW", "3", "BOT", "x", None), ("NEEDS_REVIEW", "ELIGIBLE", "4", "HUMAN", None, None), ("ELIGIBLE", "RELEASED", "5", "RELEASE_BUILD", None, "1.0.0")]
    bad = [("X", "NEW", "1", "BOT", None, None), ("OTHER", "RELEASED", "0", "BOT", None, None)]
    df = spark.createDataFrame([("good", "RELEASED", "L2", good, ["1.0.0"], "1", "2"), ("bad", "NEW", "L2", bad, None, "2", "1")], RECORD)
    got = sorted(tuple(r) for r in policy.record_violations(POLICY, df).collect())
    assert got == sorted(("bad", v) for v in ("BAD_START", "DISCONTINUITY", "NOT_CHRONOLOGICAL", "FORBIDDEN_TRANSITION", "BAD_RELEASE", "WRONG_LAYER", "STATE_NOT_LAST", "MEMBERSHIP_MISSING", "SEEN_BEFORE_DISCOVERED"))
    assert policy.reachable(POLICY) == {"NEW", "ELIGIBILITY_PENDING", "ELIGIBLE", "NEEDS_REVIEW", "RELEASED"}
    assert policy.transition_table(spark, POLICY).count() == 5


def test_eligibility_and_gates(spark):
    rows = [("fail", "E1", "FAIL"), ("fail", "E2", "UNKNOWN"), ("unknown", "E1", "UNKNOWN"), ("unknown", "E2", "PASS"), ("ok", "E1", "PASS"), ("ok", "E2", "NOT_APPLICABLE"), ("lack", "E1", "PASS"), ("na", "E1", "NOT_APPLICABLE"), ("na", "E2", "PASS")]
    df = spark.createDataFrame(rows, "record_id string, criterion_id string, decision string")
    got = {r.record_id: (r.outcome, r.errors) for r in policy.eligibility(POLICY, df).collect()}
    assert got == {"fail": ("INELIGIBLE", []), "unknown": ("NEEDS_REVIEW", []), "ok": ("ELIGIBLE", []), "lack": (None, ["NOT_EVALUATED"]), "na": (None, ["ALWAYS_APPLICABLE"])}
    values = spark.createDataFrame([("x", "a", "v", "CURATED"), ("x", "b", "v", "CURATED"), ("y", "a", "v", "ML_PROPOSED"), ("y", "b", "v", "CURATED")], "record_id string, field string, value string, method string")
    assert {r.record_id: r.decision for r in policy.derived_gate(POLICY, values).collect()} == {"x": "PASS", "y": "UNKNOWN"}
    c = spark.createDataFrame([(0.99,), (0.8,), (0.1,), (1.5,)], "c double")
    active = {"active": True, "provisional_values": {"accept_threshold": 0.95, "review_threshold": 0.7}}
    assert [r[0] for r in c.select(policy.ml_gate(active, F.col("c"))).collect()] == ["ACCEPT_NON_GATE", "REVIEW", "ABSTAIN", None]
    assert [r[0] for r in c.select(policy.ml_gate({"active": False}, F.col("c"))).collect()] == ["REVIEW", "REVIEW", "REVIEW", None]


def test_releases_and_freeze(spark):
    schema = "release_version string, git_tag string, gates_passed int, gates_total int, previous_release string, release_kind string, records array<struct<record_id:string>>, artifacts array<struct<path:string>>"
    df = spark.createDataFrame([("1.1.0", "v1.1.0", 3, 3, "1.0.0", "MINOR", [("a",)], [("p",)]), ("1.1.0", "x", 2, 3, "1.0.0", "MAJOR", [("a",), ("a",)], [("p",), ("p",)])], schema)
    assert sorted(r.violation for r in policy.release_violations(df).collect()) == ["GATES_NOT_PASSED", "PATH_TWICE", "RECORD_TWICE", "WRONG_KIND:MINOR", "WRONG_TAG"]
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string")
    assert sorted(tuple(r) for r in policy.frozen_violations(manifest, files).collect()) == [("b", "CHANGED"), ("c", "MISSING")]


TAXONOMY = {
    "instrument_families": [{"id": "nova", "label": "NovaSeq", "family_level_aliases": ["Nova Seq"], "technology_family_id": "short_read_sbs", "vendor_id": "illumina"}],
    "instrument_models": [{"id": "nova6000", "label": "NovaSeq 6000", "source_aliases": ["Illumina NovaSeq 6000"], "instrument_family_id": "nova"}],
}


def test_catalog(spark):
    schema = "run_accession string, instrument_platform string, instrument_model string, sample_accession string, secondary_sample_accession string, study_accession string, secondary_study_accession string, library_strategy string, library_source string, library_selection string, library_layout string, fastq_ftp string, fastq_md5 string, fastq_bytes string"
    md5 = "0" * 32
    rows = [
        ("SRR000001", "ILLUMINA", "illumina_novaseq 6000", "SAMN1", "SRS1", "PRJNA1", "", "WGS", "GENOMIC", "", "PAIRED", "h/a;h/b;h/a", f"{md5};bad", "5;x;7"),
        ("SRR000002", "ILLUMINA", "nova-seq", "SAMN1;SAMN2", "", "", "", "", "", "", "SINGLE", "", "", ""),
        ("SRR000003", "ls454", "other", "", "", "", "", "", "", "", "", None, None, None),
        ("bad", "x", "y", "", "", "", "", "", "", "", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.run_accession: r for r in catalog.normalize_runs(df, catalog.vocabulary(spark, TAXONOMY), "f" * 64).collect()}
    a, b, c = got["SRR000001"], got["SRR000002"], got["SRR000003"]
    assert (a.instrument_model_value.value, a.technology_family.value, a.read_type, a.sample_id, a.study_id) == ("nova6000", "short_read_sbs", "SHORT_PAIRED_END", "sample:samn1", "study:prjna1")
    assert (b.instrument_model_value.value, b.multiple_samples, b.sample_id, b.library_strategy_value.method) == ("UNSPECIFIED", True, "sample:unknown:srr000002", "UNRESOLVED")
    assert (c.instrument_family_value.value, c.technology_family.value, c.vendor.value) == ("UNKNOWN", "pyrosequencing", "roche_454")
    assert catalog.rejected_runs(df).count() == 1
    files = catalog.artifacts(df.select(F.col("run_accession").alias("run_id"), "fastq_ftp", "fastq_md5", "fastq_bytes"), "run_id", {"fastq": ("FASTQ", "fastq_ftp", "fastq_md5", "fastq_bytes")})
    assert sorted((r.uri, r["index"], r.md5, r.size_bytes) for r in files.collect()) == [("ftp://h/a", 1, md5, 5), ("ftp://h/b", 2, None, None)]
    assert {r.field: r.n_unresolved for r in catalog.unresolved_fields(catalog.normalize_runs(df, catalog.vocabulary(spark, TAXONOMY), "f" * 64), ["vendor", "library_strategy_value"]).collect()} == {"vendor": 0, "library_strategy_value": 2}


def test_gates(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "k long, v long")
    found = gates.together([gates.violation(df, "POSITIVE", "k", F.col("v") <= 0), gates.violation(df, "KEY", "k", F.col("k").isNull())])
    rows = gates.gates(spark, ["POSITIVE", "KEY"], found)
    assert sorted(tuple(r) for r in rows.collect()) == [("KEY", "PASS", 0), ("POSITIVE", "FAIL", 2)]
    assert gates.verdict(rows, ["POSITIVE"]).first()[0] == "STOP"
    assert gates.verdict(rows, ["KEY"]).first()[0] == "MODIFY"
    assert gates.forbidden_fields(spark.createDataFrame([], "a struct<trusted:int,x:array<struct<caller_winner:int>>>, b int, ranking int")) == ["a.trusted", "a.x.caller_winner"]
    assert gates.reproducible(df, df).count() == 0
    json = spark.createDataFrame([('{"a":{"consensus" : 1}}',)], "j string")
    assert json.select(gates.forbidden_json_keys(F.col("j"))).first()[0] == ["consensus"]


def test_input_errors_of_assessments(spark):
    rules = {"policy_version": "1", "criteria": [{"id": "E1", "hard": True, "applicability": "ALWAYS"}, {"id": "E2", "hard": True, "applicability": "CONDITIONAL"}], "decision_values": ["PASS", "FAIL", "UNKNOWN", "NOT_APPLICABLE"], "hard_gate_fields": ["f"], "hard_gate_accepted_methods": ["SOURCE"]}
    good = [("E1", "PASS"), ("E2", "NOT_APPLICABLE")]
    cases = {"good": good, "stray": [*good, ("E9", "PASS")], "lack": good[:1], "none": [], "invalid": [("E1", "MAYBE"), good[1]], "null": [("E1", None), good[1]], "always": [("E1", "NOT_APPLICABLE"), good[1]], "twice": [*good, good[1]], "outcome": [("E1", "FAIL"), good[1]]}
    schema = "id string, policy_version string, criteria array<struct<criterion_id:string,decision:string>>, hard_gate_fields array<struct<field:string,value:string,method:string,curation_ref:string>>, outcome string"
    df = spark.createDataFrame([(k, "1", v, [("f", "v", "SOURCE", None)], "ELIGIBLE") for k, v in cases.items()], schema)
    found = {}
    for r in policy.assessment_violations(rules, df, "id").collect():
        found.setdefault(r.id, []).append(r.violation)
    assert {k: sorted(v) for k, v in found.items()} == {"stray": ["UNKNOWN_CRITERION"], "lack": ["NOT_EVALUATED"], "none": ["NOT_EVALUATED"], "invalid": ["INVALID_DECISION"], "null": ["INVALID_DECISION"], "always": ["ALWAYS_APPLICABLE"], "twice": ["EVALUATED_TWICE"], "outcome": ["OUTCOME:INELIGIBLE"]}


def test_forbidden_names_of_every_family(spark):
    names = lambda schema, *a, **k: gates.forbidden_fields(spark.createDataFrame([], schema), *a, **k)
    assert names("reliability_score int, trusted int, technology_winner int, caller_winner int, preferred_technology int, consensus_decision int, technology_rank int, rank int") == ["reliability_score", "trusted", "technology_winner", "caller_winner", "preferred_technology", "consensus_decision"]
    assert names("technology_rank int, consensus_label int, trusted int", gates.FORBIDDEN_ACTIONS) == ["technology_rank", "consensus_label"]
    assert names("my_reliability int, trusted_x int, b int", (), fragments=gates.FRAGMENTS) == ["my_reliability", "trusted_x"]


def test_deep_scans(spark):
    docs = [(1, '{"a":[{"b":{"trusted":1}},{"Homopolymer":0}],"text":"consensus"}'), (2, '["LOW_MAPPABILITY",{"x/y":{"consensus":null}}]'), (3, '"consensus"'), (4, None), (5, '{"my_reliability_x":{"note":"\\"trusted\\": 1"}}')]
    df = spark.createDataFrame(docs, "k int, doc string").withColumn("v", F.parse_json("doc"))
    found = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert found(gates.forbidden_paths(df, "k", F.col("v"))) == [(1, "a/0/b/trusted", "trusted"), (2, "1/x/y/consensus", "consensus")]
    assert found(gates.forbidden_paths(df, "k", F.col("v"), (), gates.FRAGMENTS)) == [(1, "a/0/b/trusted", "trusted"), (2, "1/x/y/consensus", "consensus"), (5, "my_reliability_x", "my_reliability_x")]
    assert found(gates.context_paths(df, "k", F.col("v"))) == [(1, "a/1/Homopolymer", "Homopolymer"), (2, "0", "LOW_MAPPABILITY")]
    assert gates.json_walk(df.limit(0), "k", F.col("v")).count() == 0


def test_references(spark):
    make = spark.createDataFrame
    interval = "struct<assembly:string,contig:string,start_0based:long,end_0based:long>"
    good = {
        "events": ([["e1", "f"]], "event_id string, reference_artifact_id string"), "observations": ([["o1", "r1", "f"]], "observation_id string, benchmark_run_id string, source_output_artifact_id string"),
        "runs": ([["r1", "f", "f", "f", "f", ["f"], "SUCCEEDED", ("A", "1", 5, 9), ("A", "1", 0, 20)]], f"benchmark_run_id string, query_artifact_id string, truth_artifact_id string, benchmark_bed_artifact_id string, reference_artifact_id string, output_artifact_ids array<string>, run_status string, core {interval}, padded {interval}"),
        "experiments": ([["x1", ["f"]]], "experiment_id string, metadata_artifact_ids array<string>"), "provenance": ([["p1", "SOURCE_ARTIFACT", "f", "OBSERVATION", "o1"]], "provenance_link_id string, source_entity_type string, source_entity_id string, target_entity_type string, target_entity_id string"),
        "artifacts": ([["f"]], "source_artifact_id string"),
    }

    def rules(*changes):
        rows = {k: [list(r) for r in v] for k, (v, _) in good.items()}
        for table, column, value in changes:
            rows[table][0][column] = value
        return sorted(r.rule for r in gates.reference_violations(*[make([tuple(r) for r in rows[k]], good[k][1]) for k in ("events", "observations", "runs", "experiments", "provenance", "artifacts")]).collect())

    assert rules() == []
    changes = [("events", 1, "x"), *[("runs", i, None) for i in (1, 2, 3, 4)], ("runs", 5, ["f", "x"]), ("experiments", 1, ["x"]), ("observations", 1, "r9"), ("observations", 2, "x"), ("provenance", 1, "VARIANT"), ("provenance", 4, "o9"), ("runs", 7, ("A", "2", 9, 9)), ("runs", 8, ("A", "1", -1, 20))]
    assert rules(*changes) == [
        "EVENT_REFERENCE_ARTIFACT", "EXPERIMENT_METADATA_ARTIFACT", "LINK_SOURCE_EXISTS", "LINK_TARGET_EXISTS", "OBSERVATION_OUTPUT_ARTIFACT", "OBSERVATION_RUN_EXISTS", "RUN_BENCHMARK_BED_ARTIFACT_ID", "RUN_CORE_INTERVAL", "RUN_INTERVALS_AGREE", "RUN_OUTPUT_ARTIFACT", "RUN_PADDED_INTERVAL",
        "RUN_QUERY_ARTIFACT_ID", "RUN_REFERENCE_ARTIFACT_ID", "RUN_TRUTH_ARTIFACT_ID", "SUCCEEDED_RUN_OBSERVED",
    ]


def test_bundle(spark):
    make = spark.createDataFrame
    events = make([("e1", "r1", 0, 5), ("e2", "r9", 5, 5)], "event_id string, benchmark_run_id string, start_0based long, end_0based long")
    observations = make([("o1", "e1", "r1"), ("o2", "e1", "r2"), ("o3", "e7", "r1")], "observation_id string, event_id string, benchmark_run_id string")
    runs = make([("r1", "x1", 0, 9, 0, 9), ("r2", "x2", 0, 9, 1, 9)], "benchmark_run_id string, experiment_id string, core_start long, core_end long, padded_start long, padded_end long")
    experiments = make([("x1",)], "experiment_id string")
    links = make([("p1", "NORMALIZED_FROM", "OBSERVATION", "o1", "SOURCE_ARTIFACT", "a1"), ("p2", "NORMALIZED_FROM", "OBSERVATION", "o2", "SOURCE_ARTIFACT", "a2")], "provenance_link_id string, relation string, target_entity_type string, target_entity_id string, source_entity_type string, source_entity_id string")
    artifacts = make([("a1",)], "source_artifact_id string")
    got = sorted(tuple(r) for r in gates.bundle_violations(events, observations, runs, experiments, links, artifacts).collect())
    assert got == [
        ("EVENT_INTERVAL", "e2"), ("EVENT_RUN_EXISTS", "e2"), ("LINEAGE_ARTIFACT_EXISTS", "p2"), ("OBSERVATION_EVENT_EXISTS", "o3"), ("OBSERVATION_HAS_LINEAGE", "o3"),
        ("OBSERVATION_RUN_AGREES", "o2"), ("PADDED_HOLDS_CORE", "r2"), ("RUN_EXPERIMENT_EXISTS", "r2"), ("RUN_NOT_EMPTY", "r2"),
    ]
