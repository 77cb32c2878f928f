import pytest
from pyspark.sql import functions as F

from tracequill.operators import identity, sets

ALLELE = "assembly string, contig string, start long, end long, ref string, alt string"
BASE = ("A", "chr1", 5, 6, "G", "T")


@pytest.mark.parametrize(
    ("change", "status"),
    [
        ({}, "EXACT_NORMALIZED_ALLELE"), ({0: "B"}, "NON_EQUIVALENT"), ({1: "chr2"}, "NON_EQUIVALENT"), ({4: "C"}, "NON_EQUIVALENT"), ({5: "A"}, "NON_EQUIVALENT"), ({5: "t"}, "NON_EQUIVALENT"),
        ({2: 4}, "UNRESOLVED"), ({3: 7}, "UNRESOLVED"), ({4: " G "}, "EXACT_NORMALIZED_ALLELE"), ({0: "B", 2: 4}, "NON_EQUIVALENT"), ({2: 1, 3: 2}, "UNRESOLVED"), ({2: 4, 4: "GG"}, "UNRESOLVED"),
    ],
)
def test_pairs(spark, change, status):
    other = [change.get(i, v) for i, v in enumerate(BASE)]
    names = ALLELE.split(", ")
    df = spark.createDataFrame([(*BASE, *other)], ", ".join(["a_" + n for n in names] + ["b_" + n for n in names]))
    assert df.select(identity.classify()).first()[0] == status


def _decide(spark, events, observations):
    e = spark.createDataFrame(events, "event_id string, benchmark_run_id string, assembly string, contig string, normalized_allele_lookup_key string")
    o = spark.createDataFrame(observations, "event_id string, normalized_start_0based string, normalized_end_0based string, normalized_ref string, normalized_alt string")
    return e, o


EVENTS = [("none", "r", "A", "c", ""), ("noasm", "r", "", "c", ""), ("nocontig", "r", "A", None, ""), ("hole", "r", "A", "c", ""), ("two", "r", "A", "c", ""), ("key", "r", "A", "c", "A|c|9|G|T"), ("bad", "r", "A", "c", ""), ("good", "r", "A", "c", "A|c|5|G|T"), ("again", "s", "A", "c", None)]
OBSERVATIONS = [
    ("noasm", "4", "5", "G", "T"), ("nocontig", "4", "5", "G", "T"), ("hole", "4", "5", "G", "T"), ("hole", "4", "5", "G", ""), ("two", "4", "5", "G", "T"), ("two", "4", "5", "G", "C"),
    ("key", "4", "5", "G", "T"), ("bad", "4", "3", "G", "T"), ("good", "4", "5", "G", "T"), ("good", "4", "5", "G", "T"), ("again", "4", "5", "G", "T"),
]


def test_reasons(spark):
    e, o = _decide(spark, EVENTS, OBSERVATIONS)
    got = {r.event_id: r.reason for r in identity.decide(e, o).collect()}
    assert got == {
        "none": "MISSING_OBSERVATIONS", "noasm": "MISSING_EVENT_ASSEMBLY", "nocontig": "MISSING_EVENT_CONTIG", "hole": "MISSING_NORMALIZED_ALLELE_FIELD", "two": "MULTIPLE_NORMALIZED_ALLELES",
        "key": "LOOKUP_KEY_MISMATCH", "bad": "INVALID_IDENTITY_FIELDS", "good": "", "again": "",
    }
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        identity.decide(*_decide(spark, EVENTS[:1], [("none", "x", "5", "G", "T")])).collect()


def test_materialization_is_reproducible_and_reuses(spark):
    e, o = _decide(spark, EVENTS, OBSERVATIONS)
    nothing = spark.createDataFrame([], "variant_id string")
    first = identity.materialize(e, o, nothing)
    assert first.links.count() == 2 and first.variants.count() == 1 and first.accounting.count() == len(EVENTS)
    row = first.variants.first()
    assert (row.event_ids, row.benchmark_run_ids, row.origin, row.n_contents) == ("again;good", "r;s", "NEW", 1)
    second = identity.materialize(e, o, first.variants)
    assert second.variants.first().origin == "REUSED"
    assert first.links.exceptAll(second.links).count() == 0
    assert first.provenance.count() == 6


def test_null_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([("e", 1, 2, "c", "k"), ("e", 0, 5, "c", None), ("f", 1, 2, "c", "k")], "event_id string, start long, end long, contig string, lookup_key string")
    got = {r.event_id: (r.start, r.end, r.contig, r.lookup_key) for r in identity.event_bounds(df).collect()}
    assert got == {"e": (0, 5, "c", None), "f": (1, 2, "c", "k")}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert [r.k for r in sets.missing(a, b, "k").orderBy("k").collect()] == [None, 1]
    assert sets.present(a, b, "k").count() == 2
    assert sorted(tuple(r) for r in sets.key_difference(a.filter("k is not null"), b, "k").collect()) == [(1, "LEFT"), (3, "RIGHT")]
    assert sorted(tuple(r) for r in sets.first_wins(a.filter("k = 2"), "k", "v").collect()) == [(2, "y", 1)]
    assert [r.n_contents for r in sets.content_conflicts(a, "k", ["v"]).collect()] == [2]


def test_schemas(spark):
    from tracequill.functions import schemas

    df = schemas.shaped(spark.createDataFrame([("e", "r", "A", "c", -1, 5, "COMPARATOR_SUPERLOCUS"), ("f", "r", "A", "", 1, 5, "X")], "event_id string, benchmark_run_id string, assembly string, contig string, start_0based long, end_0based long, identity_scope string"), "event")
    assert df.schema == schemas.schema("event") or df.columns == schemas.schema("event").names
    assert sorted(tuple(r) for r in schemas.row_violations(df, "event").collect()) == [("e", "START"), ("e", "SUPERLOCUS_SOURCE"), ("f", "ENUM:identity_scope"), ("f", "REQUIRED:contig")]
    for entity in schemas.ENTITIES:
        empty = spark.createDataFrame([], schemas.schema(entity))
        assert schemas.row_violations(empty, entity).count() == 0
    with pytest.raises(ValueError, match="hasn't"):
        schemas.shaped(spark.createDataFrame([(1,)], "score int"), "variant")
    a = spark.createDataFrame([("1", "UNKNOWN"), ("2", "x")], "k string, v string")
    b = spark.createDataFrame([("1", None), ("2", None)], "k string, v string")
    assert [r.k for r in schemas.unknown_kept(a, b, "k", ["v"]).collect()] == ["1"]


def test_freeze(spark):
    from tracequill.operators import freeze

    c = spark.createDataFrame([("a", 1)], "candidate_id string, n long")
    ok = spark.createDataFrame([("a", "ELIGIBLE")], "candidate_id string, status string")
    assert freeze.admitted(c, ok).first().candidate_id == "a"
    for bad in ([("a", "REVIEW")], [("a", "ELIGIBLE"), ("b", "ELIGIBLE")], []):
        with pytest.raises(Exception, match="not admitted"):
            freeze.admitted(c, spark.createDataFrame(bad, "candidate_id string, status string")).collect()
    cat = spark.createDataFrame([("x", "p1"), ("y", "p2"), ("z", "p3")], "context_id string, path string")
    md5 = spark.createDataFrame([("p1", "m1")], "path string, md5 string")
    frozen = freeze.context_sets(cat, md5, ["x", "y"])
    assert {r.context_id: r.status for r in frozen.collect()} == {"x": "FROZEN", "y": "NO_OFFICIAL_MD5"}
    assert {r.context_id: r.status for r in freeze.observed_md5(frozen, spark.createDataFrame([("p1", "zz")], "path string, md5 string")).collect()} == {"x": "CHANGED", "y": "MISSING"}
    a, b = spark.createDataFrame([("k", "1", "2")], "k string, u string, v string"), spark.createDataFrame([("k", "1", "3")], "k string, u string, v string")
    assert [tuple(r) for r in freeze.lookup_mismatches(a, b, "k", ["u", "v"]).collect()] == [("k", "v", "2", "3")]


def test_explorer(spark):
    from tracequill.operators import explorer

    make = spark.createDataFrame
    first = make([("e1", "r1"), ("e2", "r1")], "event_id string, benchmark_run_id string")
    second = make([("e3", "r2")], "event_id string, benchmark_run_id string")
    observations = make([("e1", "TP", "SNP"), ("e1", "FP", None), ("e3", "TP", "INDEL")], "event_id string, raw_decision string, raw_variant_type string")
    links = make([("l1", "e1", "v1", "r1")], "event_variant_link_id string, event_id string, variant_id string, benchmark_run_id string")
    accounting = make([("e3", "UNRESOLVED", "MULTIPLE_NORMALIZED_ALLELES")], "event_id string, status string, reason string")
    runs = make([("r1", "x"), ("r2", "x")], "benchmark_run_id string, experiment_id string")
    experiments = make([("x", "S", "ONT")], "experiment_id string, sample string, technology string")
    provenance = make([("p", "A", "1", "B", "2")], "provenance_link_id string, source_entity_type string, source_entity_id string, target_entity_type string, target_entity_id string")
    model = explorer.build(first, second, observations, links, accounting, runs, experiments, provenance)
    got = {r.event_id: (r.identity_state, r.raw_decisions, r.unresolved_reason) for r in model.events.collect()}
    assert got == {"e1": ("EXACT_NORMALIZED_ALLELE", "FP;TP", None), "e2": ("NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY", None, None), "e3": ("UNRESOLVED", "TP", "MULTIPLE_NORMALIZED_ALLELES")}
    assert {r.name: r.n for r in explorer.manifest(model).collect()} == {"events:EXACT_NORMALIZED_ALLELE": 1, "events:NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY": 1, "events:UNRESOLVED": 1, "variants": 1, "provenance_entities": 2}
    assert explorer.example_rows(model, links, "v1").count() == 1
    with pytest.raises(ValueError, match="both phases"):
        explorer.build(first, first, observations, links, accounting, runs, experiments, provenance)


def test_pairs_of_a_group_are_the_work_of_many_tasks(spark):
    from collections import Counter

    df = spark.createDataFrame([(i, "g" if i < 90 else "h" if i < 95 else None, i % 2 if i < 90 else 0) for i in range(99)], "id long, g string, s int")
    pairs = identity.pairs_within(df, "id", ["g", "s"], tile=8, share=50)
    got = Counter(tuple(sorted(r)) for r in pairs.select("a_id", "b_id").collect())
    want = {(a, b) for a in range(95) for b in range(a + 1, 95) if (a < 90) == (b < 90) and (a >= 90 or a % 2 == b % 2)}
    assert set(got) == want and set(got.values()) == {1}
    tasks = Counter(r[0] for r in pairs.select(F.spark_partition_id()).collect())
    assert len(tasks) > 10 and max(tasks.values()) < len(want) / 4


def test_pairs_are_classified_in_more_than_one_task(spark):
    from tracequill.plans import registered

    df = registered.queries()["pair_classification"](spark, "/root/testdata/sf0.01")
    assert df.select(F.spark_partition_id()).distinct().count() > 1
