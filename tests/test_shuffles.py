"""Rows are dealt no more often than a query needs."""

import re
from contextlib import contextmanager

import pytest

from tracequill.plans import registered, rules  # noqa: F401

SF = "/root/testdata/sf0.001"
SMALL = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def without_broadcasts(spark):
    """As for tables that are too large to be broadcast."""
    try:
        for name in SMALL:
            spark.conf.set(name, "-1")
        yield
    finally:
        for name in SMALL:
            spark.conf.unset(name)


def dealt(spark, name):
    """The columns by which the plan of a query deals rows, without their numbers, once for each exchange."""
    with without_broadcasts(spark):
        plan = registered.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)], plan


@pytest.mark.parametrize("name", ["event_evidence", "event_evidence_44"])
def test_evidence_deals_observations_by_event_and_by_id(spark, name):
    keys, _ = dealt(spark, name)
    assert "event_id, benchmark_run_id" not in keys  # once by the event is enough
    assert not [k for k in keys if "provenance_link_id" in k]  # links that differ have another observation or artifact
    assert keys.count("observation_id") == 2  # links, and observations
    assert keys.count("benchmark_run_id") == 2  # events and runs


def test_distinct_values_of_a_key_are_counted_where_its_rows_lie(spark):
    keys, plan = dealt(spark, "variant_topology")
    assert keys.count("variant_id") == 1 and not [k for k in keys if "variant_id, " in k] and "Expand" not in plan


def test_distinct_counts_of_odd_values(spark):
    from tracequill.operators import aggregates

    df = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 1, None, -0.0), ("a", 2, "x", 0.0), (None, None, "y", float("nan")), (None, None, "y", float("nan")), ("b", None, None, None)], "k string, i int, s string, d double")
    got = aggregates.distinct_counts(df, {"n_i": "i", "n_s": "s", "n_d": "d", "n_k": "k"}, by="k")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 2, 1, 2, 1), ("b", 0, 0, 0, 1), (None, 0, 1, 1, 0)], key=repr)


def test_rollup_collects_sets_of_values_told_apart(spark):
    keys, plan = dealt(spark, "variant_rollup")
    assert keys.count("variant_id") == 1 and "collect_set" not in plan and "variant_id, event_id" not in keys


def test_rollup_of_odd_rows(spark):
    from tracequill.operators import aggregates

    links = spark.createDataFrame([("v", 1), ("v", 2), ("v", 2), ("w", 3), ("none", 9)], "variant_id string, event_id int")
    events = spark.createDataFrame([(1, "s2", "t", 5), (1, "s1", "t", 1), (2, "s1", None, 7), (3, None, None, None)], "event_id int, sample string, technology string, n_observations long")
    got = {r[0]: tuple(r)[1:] for r in aggregates.variant_rollup(links, events).collect()}
    assert got == {"v": (2, 20, "s1;s2", "t"), "w": (1, None, "", "")}


def test_reconciliation_and_ends_of_links_deal_rows_once(spark):
    keys, plan = dealt(spark, "decision_reconciliation")
    assert keys == ["side, raw_decision"] and "Join" not in plan
    assert not [k for k in dealt(spark, "gates_1a")[0] if k.startswith(("k_type", "e.type", "e["))]


def test_ends_of_unknown_types_lead_nowhere(spark):
    from tracequill.operators import aggregates, criteria

    one = lambda name: spark.createDataFrame([("1",)], f"{name} string")
    links = [("both", "EVENT", "1", "OBSERVATION", "1"), ("type", "LINK", "1", "EVENT", "1"), ("null", None, "1", "SOURCE_ARTIFACT", None), ("lost", "BENCHMARK_RUN", "2", "EVENT", "1")]
    tables = {"artifacts": one("source_artifact_id"), "observations": one("observation_id"), "events": one("event_id"), "runs": one("benchmark_run_id")}
    tables["provenance"] = spark.createDataFrame(links, "provenance_link_id string, source_entity_type string, source_entity_id string, target_entity_type string, target_entity_id string")
    assert sorted(r.key for r in criteria.RULES["endpoints"](criteria.Registry(tables)).collect()) == ["lost", "null", "null", "type"]
    a, b = spark.createDataFrame([("x", None), ("x", None), ("y", "z")], "k string, l string"), spark.createDataFrame([("x", None), ("y", "z"), (None, None)], "k string, l string")
    assert sorted(map(tuple, aggregates.reconcile(a, b, "k", "l").collect()), key=repr) == sorted([("x", None, 2, 1), (None, None, 0, 1)], key=repr)


def test_walk_opens_objects_and_lists_alone(spark):
    from pyspark.sql import functions as F

    from tracequill.operators import gates

    texts = ['{"a": {"b": [1, "x", null, {"c": {}}]}, "d": []}', '"{\\"a\\": 1}"', "[[2.5], true]", "null", '{"e": null, "f": "[1]"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.key, r.path) for r in gates.json_walk(df, "id", F.parse_json("text")).collect()}
    inner = {(0, "a"), (0, "a/b"), (0, "a/b/0"), (0, "a/b/1"), (0, "a/b/2"), (0, "a/b/3"), (0, "a/b/3/c"), (0, "d"), (2, "0"), (2, "0/0"), (2, "1"), (4, "e"), (4, "f")}
    assert got == inner | {(i, "") for i in range(5)}


def test_little_is_put_together_for_a_task_of_a_large_table(spark):
    from tracequill.plans import roles

    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "64m")
        df = roles.table(spark, "/root/testdata/sf0.01", "lineitem")
        roles.sized(df)
        assert spark.conf.get(names[0]) == "64m"
        roles.sized(df, read=10_000)
        assert spark.conf.get(names[0]) == f"{roles.TOGETHER}b"
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_files_are_aggregated_where_their_runs_lie(spark):
    keys, plan = dealt(spark, "record_bundles")
    assert keys == ["run_id", "run_id"]  # runs, and their files; not again by the file
