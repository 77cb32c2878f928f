"""Delivery, panels over contexts and configurations: a good case without findings, and a defect for each rule."""

import hashlib
import json
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracequill.operators import configuration, delivery, selection

# delivery ---------------------------------------------------------------------------------------------------------------------------

EVENTS = "event_id string, identity_state string, variant_id string, observation_count long, phase_origin string, assembly string, contig string, start_0based long, end_0based long"
OBSERVATIONS = "observation_id string, event_id string, sample_id string, technology string, raw_decision string, raw_variant_type string"
VARIANTS = "variant_id string, normalized_start_0based long, normalized_end_0based long, normalized_ref string, normalized_alt string"


def parts():
    states = [delivery.EXACT, delivery.UNRESOLVED, delivery.NOT_EVALUATED]
    events = [[f"e{i}", states[i % 3], f"v{i % 4}" if i % 3 == 0 else None, 1 + i % 3, "PHASE2C", "A", "1", i, i + 1] for i in range(30)]
    observations = [[f"o{i}-{k}", f"e{i}", "S", "T", "é\"TP" if k else "FN", "SNP" if k % 2 else None] for i in range(30) for k in range(1 + i % 3)]
    return {"events": events, "observations": observations, "variants": [[f"v{i}", 5, 6, "A", "T"] for i in range(4)], "unresolved": [[e[0]] for e in events if e[1] == delivery.UNRESOLVED]}


def model(spark, p):
    of = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
    return delivery.Model(of(p["events"], EVENTS), of(p["observations"], OBSERVATIONS), of(p["variants"], VARIANTS), of(p["unresolved"], "event_id string"))


def test_delivered_files(spark, tmp_path):
    p = parts()
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    got = delivery.write(model(spark, p), one)
    by_shard = {}
    for o in sorted(p["observations"], key=lambda o: (o[1], o[0])):
        row = dict(zip(("observation_id", "event_id", "sample_id", "technology", "raw_decision", "raw_variant_type"), o, strict=True))
        by_shard.setdefault(hashlib.sha256(o[1].encode()).hexdigest()[:2], []).append(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n")
    want = {f"evidence/{k}.json": hashlib.sha256("".join(v).encode()).hexdigest() for k, v in by_shard.items()}
    assert {r.evidence_shard: r.sha256 for r in delivery.shard_digests(spark, one).collect()} == want
    assert {r.event_id: r.evidence_shard for r in got.shards.collect()} == {e[0]: f"evidence/{hashlib.sha256(e[0].encode()).hexdigest()[:2]}.json" for e in p["events"]}
    search = {r.event_id: r for r in got.search.collect()}
    assert search["e0"].normalized_ref == "A" and search["e1"].normalized_ref is None and search["e1"].variant_id is None and search["e2"].raw_decisions == ["FN", "é\"TP"] and search["e2"].raw_variant_types == ["SNP"]
    assert {r.name: r.value for r in got.manifest.collect()}["observation_count"] == str(len(p["observations"]))
    assert got.checksums.count() >= len(want) + 2
    delivery.write(model(spark, {k: random.Random(1).sample(v, len(v)) for k, v in p.items()}), two)
    assert delivery.build_differences(spark, one, two).count() == 0
    shard = sorted(by_shard)[0]
    shutil.rmtree(f"{two}/evidence/shard={shard}")
    assert [r.part for r in delivery.build_differences(spark, one, two).collect()] == [f"evidence/{shard}.json"]


def test_a_large_shard_is_divided_to_files(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    whole, got = delivery.write(model(spark, parts()), one), delivery.write(model(spark, parts()), many, digits=2, most_bytes=150, divide=True)
    files = [f for f in (tmp_path / "many" / "evidence").rglob("*.txt")]
    assert len(files) > len({f.parent for f in files}) and max(f.stat().st_size for f in files) <= 150
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(delivery.shard_digests(spark, many)) == key(delivery.shard_digests(spark, one))
    assert delivery.build_differences(spark, one, many).isEmpty()
    assert key(got.manifest) == key(whole.manifest) and key(got.search) == key(whole.search) and key(got.shards) == key(whole.shards)
    with pytest.raises(ValueError, match="in a line"):
        delivery.write(model(spark, parts()), str(tmp_path / "none"), most_bytes=50, divide=True)


def test_packed_shards_have_the_digests_of_their_lines(spark, tmp_path):
    one, packed = str(tmp_path / "one"), str(tmp_path / "packed")
    whole, got = delivery.write(model(spark, parts()), one), delivery.write(model(spark, parts()), packed, most_bytes=150, divide=True, compression="gzip")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert {f.suffix for f in (tmp_path / "packed").rglob("part-*")} == {".gz"}
    assert key(delivery.shard_digests(spark, packed)) == key(delivery.shard_digests(spark, one))  # sizes too
    assert delivery.build_differences(spark, one, packed).isEmpty()
    assert key(got.manifest) == key(whole.manifest) and key(got.search) == key(whole.search) and key(got.shards) == key(whole.shards)


def test_delivery_deals_events_once(spark, tmp_path):
    m = model(spark, parts())
    got = delivery.write(m, str(tmp_path / "d"), compression="gzip")
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert dealt(delivery._indices(m, got.evidence, got.search, got.shards, 2)) == 1
    defects = lambda search: {r.rule for r in delivery._indices(m, got.evidence, search, got.shards, 2).collect()}
    assert defects(got.search) == set()
    assert defects(got.search.filter("event_id <> 'e1'")) == {"SEARCH_INDEX_LACKS", "COUNT_DIFFERS"}
    assert defects(got.search.unionAll(got.search.filter("event_id = 'e1'"))) == {"SEARCH_INDEX_DOUBLED"}
    assert defects(got.search.withColumn("observation_count", F.lit(1).cast("long"))) == {"COUNT_DIFFERS"}
    assert defects(got.search.withColumn("evidence_shard", F.lit("x"))) == {"SEARCH_INDEX_SHARD"}
    assert defects(got.search.withColumn("event_id", F.when(F.col("event_id") == "e1", "ghost").otherwise(F.col("event_id")))) >= {"SEARCH_INDEX_LACKS", "SEARCH_INDEX_STRAY", "COUNT_DIFFERS"}


DEFECTS = {
    "OBSERVATION_WITHOUT_EVENT": lambda p: p["events"].pop(), "EVENT_WITHOUT_EVIDENCE": lambda p: p["observations"].pop(0), "OBSERVATION_COUNT": lambda p: p["observations"].pop(), "SAMPLES_DISAGREE": lambda p: p["observations"][-1].__setitem__(2, "other"),
    "TECHNOLOGIES_DISAGREE": lambda p: p["observations"][-1].__setitem__(3, None), "IDENTITY_STATE": lambda p: p["events"][2].__setitem__(1, "NEW"), "EXACT_WITHOUT_VARIANT": lambda p: p["events"][0].__setitem__(2, "none"), "VARIANT_WITHOUT_EXACT": lambda p: p["events"][1].__setitem__(2, "v1"),
    "UNRESOLVED_WITHOUT_EVENT": lambda p: p["unresolved"].append(["ghost"]), "UNRESOLVED_SET": lambda p: p["unresolved"].pop(), "DUPLICATE_EVENT": lambda p: p["events"].append(p["events"][0]), "DUPLICATE_OBSERVATION": lambda p: p["observations"].append(p["observations"][0]), "DUPLICATE_VARIANT": lambda p: p["variants"].append(p["variants"][0]),
}


def test_no_defect_passes_a_delivery(spark, tmp_path):
    assert delivery.model_violations(model(spark, parts())).count() == 0
    for rule, damage in DEFECTS.items():
        p = parts()
        damage(p)
        assert rule in {r.rule for r in delivery.model_violations(model(spark, p)).collect()}, rule
    p = parts()
    DEFECTS["UNRESOLVED_SET"](p)
    with pytest.raises(ValueError, match="UNRESOLVED_SET: 1, as e28"):
        delivery.write(model(spark, p), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="bytes"):
        delivery.write(model(spark, parts()), str(tmp_path / "none"), most_bytes=50)
    assert not (tmp_path / "none").exists()


def test_what_a_write_lost_is_found(spark, tmp_path):
    m, folder = model(spark, parts()), str(tmp_path / "d")
    delivery.write(m, folder)
    mark = F.xxhash64("shard", "value").cast("decimal(38,0)")
    back = delivery._read(spark, folder)
    seen = back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(mark).alias("checksum")).first().asDict()
    evidence = lambda b: b.select("shard", F.from_json("value", m.observations.schema).alias("o")).select("shard", "o.*")
    rules = lambda b: {r.rule for r in delivery._read_back(m, b, evidence(b), seen, mark, 2).collect()}
    assert rules(back) == set()
    assert rules(back.filter(~F.col("value").contains("\"o1-0\""))) == {"WRITTEN_DIFFERS", "OBSERVATION_LOST"}
    assert rules(back.unionAll(back.limit(1))) == {"WRITTEN_DIFFERS", "OBSERVATION_DOUBLED"}
    assert rules(back.withColumn("shard", F.when(F.col("value").contains('"e2"'), "zz").otherwise(F.col("shard")))) == {"WRITTEN_DIFFERS", "EVENT_SHARD"}
    assert rules(back.withColumn("value", F.regexp_replace("value", "o5-0", "o5-9"))) == {"WRITTEN_DIFFERS", "OBSERVATION_LOST", "OBSERVATION_STRAY"}


# panels -----------------------------------------------------------------------------------------------------------------------------

RULES = selection.Rules(per_contig=3, per_context=7, cross_overlap=50, least_contigs=2)
CANDIDATES = "context_id string, candidate_id string, selection_hash string, contig string, start long, end long"


def candidates(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randint(0, 900)
        rows.append((f"c{rng.randint(0, 2)}", f"w{i}", hashlib.sha256(f"{seed}|{i}".encode()).hexdigest(), rng.choice("abcd" if seed % 2 else "aaab"), start, start + 100))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_panel_is_the_greedy_choice(spark, seed):
    rules = RULES if seed % 2 else selection.Rules(per_contig=4, per_context=5, cross_overlap=50)
    rows = candidates(seed)
    got = selection.panel(spark.createDataFrame(rows, CANDIDATES).repartition(3), ["c1", "c0", "c2"], rules)
    earlier, chosen, seen = [], [], []
    for context in ("c1", "c0", "c2"):
        own = [dict(zip(("context_id", "candidate_id", "selection_hash", "contig", "start", "end"), r, strict=True)) for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[0] == context]
        selected, evaluated = selection.greedy(own, earlier, rules)
        earlier, chosen, seen = earlier + selected, chosen + selected, seen + evaluated
    assert {(r.context_id, r.candidate_id, r.selection_rank, r.chromosome_selection_rank) for r in got.selected.collect()} == {(c["context_id"], c["candidate_id"], c["selection_rank"], c["chromosome_selection_rank"]) for c in chosen}
    assert {(r.context_id, r.candidate_id, r.evaluation_rank, r.decision, r.rejection_reason) for r in got.evaluated.collect()} == {(e["context_id"], e["candidate_id"], e["evaluation_rank"], e["decision"], e["rejection_reason"]) for e in seen}
    assert seed != 1 or {e["rejection_reason"] for e in seen} >= {"CROSS_CONTEXT_OVERLAP_GE_50_PERCENT", "WITHIN_CONTEXT_OVERLAP"}
    assert selection.panel_violations(got.selected, ["c1", "c0", "c2"], rules).count() == 0


def test_a_panel_that_cant_be_filled_fails(spark):
    df = spark.createDataFrame(candidates(2), CANDIDATES)
    with pytest.raises(ValueError, match="of 99 windows"):
        selection.panel(df, ["c1"], selection.Rules(per_contig=1, per_context=99))
    with pytest.raises(ValueError, match="contigs"):
        selection.panel(df, ["c1"], selection.Rules(per_contig=2, per_context=2, least_contigs=5))


def test_panel_violations(spark):
    rows = [("c0", "w1", "h", "a", 0, 100), ("c0", "w2", "h", "a", 50, 150), ("c1", "w3", "h", "a", 60, 160), ("c1", "w3", "h", "b", 0, 100), ("c0", "w5", "h", "a", 900, 1000)]
    found = Counter(r.rule for r in selection.panel_violations(spark.createDataFrame(rows, CANDIDATES), ["c0", "c1", "c2"], selection.Rules(per_contig=2, per_context=3, cross_overlap=50, least_contigs=2), ("b",)).collect())
    assert found == {"CONTEXT_SIZE": 2, "FEW_CONTIGS": 2, "WINDOW_TWICE": 1, "CONTIG_QUOTA": 1, "CONTIG_LEFT_OUT": 1, "WITHIN_CONTEXT_OVERLAP": 1, "CROSS_CONTEXT_OVERLAP": 1}


# configurations ---------------------------------------------------------------------------------------------------------------------

SCHEMAS = {
    "technology_families": "id string, label string", "vendors": "id string, label string", "instrument_families": "id string, label string, vendor_id string, technology_family_id string, family_level_aliases array<string>",
    "instrument_models": "id string, label string, instrument_family_id string, source_aliases array<string>", "chemistries": "id string, vendor_id string, technology_family_id string", "basecallers": "id string, vendor_id string, technology_family_id string",
    "read_modes": "id string, technology_family_ids array<string>", "platform_terms": "term string, vendor_id string, technology_family_id string", "organisms": "taxonomy_id int, scientific_name string, rank string, parent_taxonomy_id int",
    "assemblies": "assembly_id string, taxonomy_id int, assembly_name string, insdc_accession string, refseq_accession string, ucsc_db string, insdc_status string, refseq_status string", "sequence_sets": "sequence_set_id string, assembly_id string",
    "organism_lookups": "taxonomy_id int, verdict string, failures array<string>, snapshot string, sha256 string, observed struct<name:string,rank:string,parent:int>",
    "assembly_lookups": "assembly_id string, verdict string, checks array<struct<accession:string,failures:array<string>,snapshot:string,sha256:string,observed:struct<name:string,taxonomy_id:int,status:string>>>, ucsc struct<ucsc_db:string,failures:array<string>>",
    "snapshots": "path string, sha256 string", "sources": "source_id string, mirror_group_id string", "mirror_groups": "mirror_group_id string, member_source_ids array<string>", "states": "state string", "layers": "layer string, state string", "transitions": "from_state string, to_state string",
    "criteria": "id string, hard boolean", "accepted_methods": "method string", "thresholds": "model string, review_threshold double, accept_threshold double, active boolean", "models": "model string", "prohibited_decisions": "decision string", "allowed_tasks": "task string", "methods": "method string, ml boolean",
}


def good():
    check = lambda a, s: (a, [], "f2", "d2", ("Asm", 1, s))
    steps = [("CATALOGUED", "ELIGIBLE"), ("ELIGIBLE", "VALIDATION_PENDING"), ("VALIDATION_PENDING", "VALIDATED"), ("VALIDATED", "RELEASED"), ("RELEASED", "WITHDRAWN"), ("WITHDRAWN", None)]
    return {
        "technology_families": [["short", "Short reads"], ["long", "Long reads"]], "vendors": [["acme", "Acme"], ["both", "Both"]], "instrument_families": [["i1", "I one", "acme", "short", ["I-one"]], ["i2", "I two", "both", "short", []], ["i3", "I three", "both", "long", []]],
        "instrument_models": [["m1", "M one", "i1", ["M-1"]], ["m2", "M two", "i2", []]], "chemistries": [["c1", "acme", "short"]], "basecallers": [["b1", "both", "long"]], "read_modes": [["r1", ["short", "long"]]], "platform_terms": [["ACME", "acme", "short"], ["BOTH", "both", None]],
        "organisms": [[1, "Homo", "species", None], [2, "Homo sub", "subspecies", 1]], "assemblies": [["a1", 1, "Asm", "GCA_000000001.1", "GCF_000000001.2", "hg", "current", "latest"], ["a2", 1, "Asm", "GCA_000000002.1", None, None, "current", None]], "sequence_sets": [["s1", "a1"]],
        "organism_lookups": [[1, "VERIFIED", [], "f1", "d1", ("Homo", "SPECIES", 9)], [2, "VERIFIED", [], "f1", "d1", ("Homo sub", "Subspecies", 1)]],
        "assembly_lookups": [["a1", "VERIFIED", [check("GCA_000000001.1", "current"), check("GCF_000000001.2", "latest")], ("hg", [])], ["a2", "VERIFIED", [check("GCA_000000002.1", "current")], None]], "snapshots": [["f1", "d1"], ["f2", "d2"]],
        "sources": [["s1", "g"], ["s2", "g"], ["s3", None]], "mirror_groups": [["g", ["s1", "s2"]]], "states": [[a] for a, _ in steps], "layers": [["l", a] for a, _ in steps], "transitions": [list(s) for s in steps], "criteria": [["E01", True], ["E13", True]], "accepted_methods": [["CURATED"]],
        "thresholds": [["m", 0.5, 0.9, True]], "models": [["m"]], "prohibited_decisions": [[p] for p in configuration.PROHIBITED], "allowed_tasks": [["suggest"]], "methods": [["ML_PROPOSED", True], ["CURATED", False]],
    }


def errors(spark, rows):
    t = {n: spark.createDataFrame([tuple(r) for r in v], SCHEMAS[n]) for n, v in rows.items()}
    parts = [configuration.taxonomy_errors(t), configuration.organism_errors(t), configuration.lookup_errors(t), configuration.source_errors(t), configuration.lifecycle_errors(t, "CATALOGUED"), configuration.model_policy_errors(t)]
    out = set()
    for p in parts:
        out |= {(r.rule, r.key) for r in p.collect()}
    return out


def put(table, row, column, value):
    return lambda g: g[table][row].__setitem__(column, value)


def add(table, row):
    return lambda g: g[table].append(row)


def drop(table, row=-1):
    return lambda g: g[table].pop(row)


def renamed(field, **new):
    def change(g):
        old = g["assembly_lookups"][0][2][0]
        values = dict(zip(("accession", "failures", "snapshot", "sha256", "observed"), old, strict=True)) | new
        g["assembly_lookups"][0][2][0] = tuple(values.values())

    return change


CASES = [
    (("DUPLICATE_ID", "vendors|acme"), add("vendors", ["acme", "Other"])), (("LEVEL_CONFLATED", "vendors|v"), add("vendors", ["v", "LONG READS"])), (("INSTRUMENT_VENDOR_UNKNOWN", "i1"), put("instrument_families", 0, 2, "x")), (("INSTRUMENT_TECHNOLOGY_UNKNOWN", "i1"), put("instrument_families", 0, 3, "x")),
    (("MODEL_FAMILY_UNKNOWN", "m1"), put("instrument_models", 0, 2, "x")), (("ALIAS_CLAIMED_TWICE", "m-1|model|m2"), put("instrument_models", 1, 3, ["m-1"])), (("ALIAS_CLAIMED_TWICE", "m two|family|i1"), put("instrument_families", 0, 4, ["M TWO"])), (("PAIR_WITHOUT_INSTRUMENT", "chemistries|c1"), put("chemistries", 0, 2, "long")),
    (("PAIR_WITHOUT_INSTRUMENT", "basecallers|b1"), put("basecallers", 0, 1, "acme")), (("READ_MODE_TECHNOLOGY_UNKNOWN", "r1|x"), put("read_modes", 0, 1, ["x"])), (("TERM_VENDOR_UNKNOWN", "ACME"), put("platform_terms", 0, 1, "x")), (("TERM_NULL_BUT_UNAMBIGUOUS", "ACME"), put("platform_terms", 0, 2, None)),
    (("TERM_TECHNOLOGY_OF_NO_INSTRUMENT", "ACME"), put("platform_terms", 0, 2, "long")), (("TERM_NAMES_ONE_OF_SEVERAL", "BOTH"), put("platform_terms", 1, 2, "long")), (("DUPLICATE_TERM", "ACME"), add("platform_terms", ["ACME", "acme", "short"])), (("DUPLICATE_TAXON", "1"), add("organisms", [1, "Again", "species", None])),
    (("PARENT_UNREGISTERED", "2|7"), put("organisms", 1, 3, 7)), (("PARENT_MISSING", "2"), put("organisms", 1, 3, None)), (("DUPLICATE_ASSEMBLY", "a1"), put("assemblies", 1, 0, "a1")), (("ACCESSION_REUSED", "GCA_000000001.1"), put("assemblies", 1, 3, "GCA_000000001.1")), (("UCSC_NAME_REUSED", "hg"), put("assemblies", 1, 5, "HG")),
    (("ASSEMBLY_ORGANISM_UNKNOWN", "a1"), put("assemblies", 0, 1, 5)), (("ASSEMBLY_NAMED_AS_ORGANISM", "homo"), put("assemblies", 1, 0, "homo")), (("ACCESSION_CORES_DIFFER", "a1"), put("assemblies", 0, 4, "GCF_000000009.2")), (("ACCESSION_SUPPRESSED", "a1"), put("assemblies", 0, 6, "suppressed")), (("SEQUENCE_SET_ASSEMBLY_UNKNOWN", "s1"), put("sequence_sets", 0, 1, "x")),
    (("ORGANISM_NOT_VERIFIED", "1"), put("organism_lookups", 0, 1, "FAILED")), (("ORGANISM_NOT_VERIFIED", "1"), put("organism_lookups", 0, 2, ["x"])), (("ORGANISM_NOT_VERIFIED", "2"), drop("organism_lookups")), (("ORGANISM_SNAPSHOT_ALTERED", "1"), put("snapshots", 0, 1, "new")), (("ORGANISM_DIFFERS", "1"), put("organisms", 0, 1, "Pan")), (("PARENT_DIFFERS", "2"), put("organism_lookups", 1, 5, ("Homo sub", "subspecies", 4))),
    (("ASSEMBLY_NOT_VERIFIED", "a2"), drop("assembly_lookups")), (("ACCESSION_NOT_VERIFIED", "a1|GCA_000000001.1"), renamed("failures", failures=["x"])), (("ACCESSION_NOT_VERIFIED", "a1|GCA_000000001.1"), renamed("accession", accession="GCA_9")), (("ACCESSION_SNAPSHOT_ALTERED", "a1|GCA_000000001.1"), renamed("snapshot", snapshot="gone")),
    (("ACCESSION_DIFFERS", "a1|GCA_000000001.1"), renamed("observed", observed=("Other", 1, "current"))), (("ACCESSION_STATUS_DIFFERS", "a1|GCA_000000001.1"), renamed("observed", observed=("Asm", 1, "old"))), (("UCSC_NAME_NOT_VERIFIED", "a1"), put("assembly_lookups", 0, 3, None)), (("DUPLICATE_SOURCE", "s1"), add("sources", ["s1", "g"])),
    (("MEMBER_UNKNOWN", "g|x"), put("mirror_groups", 0, 1, ["s1", "s2", "x"])), (("MEMBER_POINTS_ELSEWHERE", "g|s3"), put("mirror_groups", 0, 1, ["s1", "s2", "s3"])), (("GROUP_UNKNOWN", "s3|x"), put("sources", 2, 1, "x")), (("DUPLICATE_STATE", "ELIGIBLE"), add("states", ["ELIGIBLE"])), (("STATE_IN_TWO_LAYERS", "ELIGIBLE"), add("layers", ["k", "ELIGIBLE"])),
    (("STATE_WITHOUT_LAYER", "WITHDRAWN"), drop("layers")), (("LAYERED_STATE_UNDECLARED", "NEW"), add("layers", ["l", "NEW"])), (("STATE_WITHOUT_TRANSITIONS", "WITHDRAWN"), drop("transitions")), (("TRANSITIONS_OF_UNDECLARED", "NEW"), add("transitions", ["NEW", None])), (("TARGET_UNDECLARED", "ELIGIBLE|NEW"), add("transitions", ["ELIGIBLE", "NEW"])),
    (("SELF_TRANSITION", "ELIGIBLE"), add("transitions", ["ELIGIBLE", "ELIGIBLE"])), (("ENTERED_FROM", "RELEASED|ELIGIBLE,VALIDATED"), add("transitions", ["ELIGIBLE", "RELEASED"])), (("ENTERED_FROM", "VALIDATED|"), put("transitions", 2, 1, "WITHDRAWN")), (("ENTERED_FROM", "VALIDATION_PENDING|CATALOGUED,ELIGIBLE"), add("transitions", ["CATALOGUED", "VALIDATION_PENDING"])),
    (("LEFT_FOR", "WITHDRAWN|CATALOGUED"), put("transitions", 5, 1, "CATALOGUED")), (("LEFT_FOR", "RELEASED|ELIGIBLE,WITHDRAWN"), add("transitions", ["RELEASED", "ELIGIBLE"])), (("STATE_UNREACHABLE", "WITHDRAWN"), put("transitions", 4, 1, None)), (("DUPLICATE_CRITERION", "E01"), add("criteria", ["E01", False])), (("NO_HARD_CRITERION", "criteria"), lambda g: g["criteria"].clear()),
    (("DERIVED_CRITERION_NOT_HARD", "E13"), put("criteria", 1, 1, False)), (("METHOD_BACKS_NO_GATE", "ML_PROPOSED"), add("accepted_methods", ["ML_PROPOSED"])), (("REVIEW_NOT_BELOW_ACCEPT", "m"), put("thresholds", 0, 1, 0.9)), (("MODEL_WITHOUT_ACTIVE_THRESHOLDS", "m"), put("thresholds", 0, 3, False)), (("PROHIBITION_MISSING", "trust_score"), drop("prohibited_decisions")),
    (("TASK_PROHIBITED", "trust_score"), add("allowed_tasks", ["trust_score"])), (("METHOD_NOT_TO_BE_LEARNED", "CURATED"), put("methods", 1, 1, True)), (("LEARNED_METHOD_MISSING", "ML_PROPOSED"), put("methods", 0, 1, False)),
]


def test_configurations_without_errors(spark):
    assert errors(spark, good()) == set()


FAMILIES = {
    "taxonomy": (0, 15, configuration.taxonomy_errors), "organisms": (15, 26, configuration.organism_errors), "lookups": (26, 39, configuration.lookup_errors), "sources": (39, 43, configuration.source_errors),
    "lifecycle": (43, 61, lambda t: configuration.lifecycle_errors(t, "CATALOGUED")), "models": (61, 67, configuration.model_policy_errors),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_every_configuration_error(spark, name):
    """Defects are tried three at a time, and alone where they hide each other."""
    begin, end, check = FAMILIES[name]

    def found(cases):
        g = good()
        try:
            for _, damage in cases:
                damage(g)
        except IndexError:  # one has removed what the next would change
            return set()
        t = {n: spark.createDataFrame([tuple(r) for r in v], SCHEMAS[n]).coalesce(1) for n, v in g.items() if v or n == "criteria"}
        return {(r.rule, r.key) for r in check(t).collect()}

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for i in range(begin, end, 3):
            cases = CASES[i : min(i + 3, end)]
            together = found(cases)
            assert all(case[0] in together or case[0] in found([case]) for case in cases), [c[0] for c in cases]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_all_cases_have_a_family():
    assert len(CASES) == FAMILIES["models"][1]


def test_configuration_from_json(spark):
    text = json.dumps({"states": [{"state": "A"}, {"state": "B"}], "deep": {"list": [{"id": "x", "alias": ["p", "q"]}]}})
    doc = spark.createDataFrame([(text,)], "value string")
    assert [r.state for r in configuration.listed(doc, "states", "state string").collect()] == ["A", "B"]
    assert configuration.listed(doc, "deep.list", "id string, alias array<string>").first().alias == ["p", "q"]


# ordered hash trees -----------------------------------------------------------------------------------------------------------------


def test_hash_trees(spark):
    from tracequill.operators import hashtree

    df = spark.createDataFrame([(i, f"é{i % 7}", None if i % 5 else i) for i in range(100)], "k int, t string, n int")
    tree = lambda d: hashtree.hash_tree(d, "k", chunk=8, fan=3)
    one = tree(df)
    rows = {(r.level, r.node): r for r in one.collect()}
    lines = [json.dumps({"k": i, "t": f"é{i % 7}", "n": None if i % 5 else i}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i in range(100)]
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    level = [digest([hashlib.sha256(x.encode()).hexdigest() for x in lines[i : i + 8]]) for i in range(0, 100, 8)]
    for n in range(10):
        assert [rows[n, k].digest for k in range(len(level))] == level
        if len(level) == 1:
            break
        level = [digest(level[i : i + 3]) for i in range(0, len(level), 3)]
    assert len(rows) == 13 + 5 + 2 + 1 and rows[3, 0].n_rows == 100 and (rows[0, 12].first, rows[0, 12].last) == ('{"k":96}', '{"k":99}')
    differ = lambda d: [tuple(r) for r in hashtree.first_difference(one, tree(d), 3).collect()]
    assert differ(df.repartition(7)) == []
    assert differ(df.withColumn("t", F.when(F.col("k").isin(50, 90), "x").otherwise(F.col("t")))) == [(6, '{"k":48}', '{"k":55}', '{"k":48}', '{"k":55}')]
    assert differ(df.filter("k <> 20")) == [(2, '{"k":16}', '{"k":23}', '{"k":16}', '{"k":24}')]
    assert differ(df.filter("k < 96")) == [(12, '{"k":96}', '{"k":99}', None, None)]
    assert differ(df.filter("k < 20"))[0][0] == 2 and differ(df.limit(0))[0][0] == 0 and hashtree.first_difference(tree(df.limit(0)), tree(df.limit(0)), 3).count() == 0


def test_hash_tree_makes_digests_after_rows_are_dealt(spark, monkeypatch):
    """Dealing by range reads its rows twice, and moves them: not with their digests, and not by a few tasks."""
    from tracequill.operators import hashtree
    from tracequill.plans import contracts, registered  # noqa: F401

    dealt = []
    numbered = hashtree.numbered
    monkeypatch.setattr(hashtree, "numbered", lambda df, *names: dealt.append(df) or numbered(df, *names))
    assert registered.queries()["first_difference"](spark, "/root/testdata/sf0.001").count() <= 1
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in dealt]
    assert len(plans) == 2 and not [p for p in plans if "sha2" in p or "Repartition" in p]
