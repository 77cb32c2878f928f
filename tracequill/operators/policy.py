"""Lifecycle, eligibility and release rules as columns and violation tables.

A policy is a plain dict (from its JSON file); its small tables become literals or broadcast rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequill.functions import text


def layer(policy: Mapping[str, Any], state: Column) -> Column:
    """The layer that holds a state; null for an unknown one."""
    out = F.lit(None).cast("string")
    for one in policy["layers"]:
        out = F.when(state.isin(one["states"]), F.lit(one["layer_id"])).otherwise(out)
    return out


def transition_allowed(policy: Mapping[str, Any], before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, following in policy["transitions"].items():
        if following:
            out = out | ((before == state) & after.isin(following))
    return F.coalesce(out, F.lit(False))


def transition_table(spark: SparkSession, policy: Mapping[str, Any]) -> DataFrame:
    rows = [(a, b) for a, following in policy["transitions"].items() for b in following]
    return spark.createDataFrame(rows, "from_state string, to_state string")


def reachable(policy: Mapping[str, Any], start: str | None = None) -> set[str]:
    """States that can follow from a start; the policy's graph is tiny."""
    found, waiting = set(), [start or policy["initial_state"]]
    while waiting:
        state = waiting.pop()
        if state not in found:
            found.add(state)
            waiting += policy["transitions"].get(state, [])
    return found


def history_steps(records: DataFrame, key: str = "record_id", history: str = "state_history") -> DataFrame:
    """One row for each step of each record's history: key, ordinal (from 0), the step's fields."""
    return records.select(key, F.posexplode(history).alias("ordinal", "step")).select(key, "ordinal", "step.*")


def history_violations(policy: Mapping[str, Any], steps: DataFrame, key: str = "record_id") -> DataFrame:
    """key, ordinal, violation of steps (from_state, to_state, at, actor_type, assessment_id, release_version)."""
    order = Window.partitionBy(key).orderBy("ordinal")
    rows = steps.withColumn("p_state", F.lag("to_state").over(order)).withColumn("p_at", F.lag("at").over(order))
    first, decided = F.col("ordinal") == 0, F.col("to_state").isin("ELIGIBLE", "INELIGIBLE")
    allowed = transition_allowed(policy, F.col("from_state"), F.col("to_state"))
    started = F.col("from_state").isNull() & (F.col("to_state") == policy["initial_state"])
    released = (F.col("actor_type") == "RELEASE_BUILD") & F.col("release_version").isNotNull()
    checks = F.array(
        F.when(first & ~started, F.lit("BAD_START")),
        F.when(~first & ~F.col("from_state").eqNullSafe(F.col("p_state")), F.lit("DISCONTINUITY")),
        F.when(~first & (F.col("at") < F.col("p_at")), F.lit("NOT_CHRONOLOGICAL")),
        F.when(~first & ~allowed, F.lit("FORBIDDEN_TRANSITION")),
        F.when(~first & (F.col("from_state") == "NEEDS_REVIEW") & decided & ~F.coalesce(F.col("actor_type") == "HUMAN", F.lit(False)), F.lit("REVIEW_NEEDS_HUMAN")),
        F.when(~first & (F.col("from_state") == "ELIGIBILITY_PENDING") & F.col("to_state").isin("ELIGIBLE", "INELIGIBLE", "NEEDS_REVIEW") & F.col("assessment_id").isNull(), F.lit("NO_ASSESSMENT")),
        F.when(~first & (F.col("to_state") == "RELEASED") & ~F.coalesce(released, F.lit(False)), F.lit("BAD_RELEASE")),
    )
    return rows.select(key, "ordinal", F.explode(F.array_compact(checks)).alias("violation"))


def record_violations(policy: Mapping[str, Any], records: DataFrame, key: str = "record_id") -> DataFrame:
    """key, violation of records (eligibility_state, layer, state_history, release_memberships, discovered_at, last_seen_at)."""
    last = F.element_at("state_history", -1)["to_state"]
    released = F.transform(F.filter("state_history", lambda s: s["to_state"] == "RELEASED"), lambda s: s["release_version"])
    member_of = F.coalesce("release_memberships", F.array().cast("array<string>"))
    checks = F.array(
        F.when(~F.col("layer").eqNullSafe(layer(policy, F.col("eligibility_state"))), F.lit("WRONG_LAYER")),
        F.when(~last.eqNullSafe(F.col("eligibility_state")), F.lit("STATE_NOT_LAST")),
        F.when(F.size(F.array_except(released, member_of)) > 0, F.lit("MEMBERSHIP_MISSING")),
        F.when(F.col("last_seen_at") < F.col("discovered_at"), F.lit("SEEN_BEFORE_DISCOVERED")),
    )
    own = records.select(key, F.explode(F.array_compact(checks)).alias("violation"))
    return own.unionAll(history_violations(policy, history_steps(records, key), key).select(key, "violation"))


def eligibility(policy: Mapping[str, Any], decisions: DataFrame, key: str = "record_id") -> DataFrame:
    """key, outcome, errors from rows (key, criterion_id, decision).

    A hard FAIL makes INELIGIBLE, else a hard UNKNOWN NEEDS_REVIEW, else ELIGIBLE; with errors there is no outcome.
    """
    ids = [c["id"] for c in policy["criteria"]]
    hard = [c["id"] for c in policy["criteria"] if c["hard"]]
    always = [c["id"] for c in policy["criteria"] if c["applicability"] != "CONDITIONAL"]
    is_hard, value = F.col("criterion_id").isin(hard), F.col("decision")
    rows = decisions.groupBy(key).agg(
        F.bool_or(is_hard & (value == "FAIL")).alias("fail"),
        F.bool_or(is_hard & (value == "UNKNOWN")).alias("unknown"),
        F.bool_or(~F.col("criterion_id").isin(ids)).alias("stray"),
        F.count_distinct(F.when(F.col("criterion_id").isin(ids), F.col("criterion_id"))).alias("n"),
        (F.count("criterion_id") > F.count_distinct("criterion_id")).alias("twice"),
        F.bool_or(~value.isin(list(policy["decision_values"]))).alias("invalid"),
        F.bool_or((value == "NOT_APPLICABLE") & F.col("criterion_id").isin(always)).alias("misapplied"),
    )
    errors = F.array_compact(F.array(
        F.when(F.col("stray"), F.lit("UNKNOWN_CRITERION")), F.when(F.col("n") < len(ids), F.lit("NOT_EVALUATED")), F.when(F.col("twice"), F.lit("EVALUATED_TWICE")),
        F.when(F.col("invalid"), F.lit("INVALID_DECISION")), F.when(F.col("misapplied"), F.lit("ALWAYS_APPLICABLE")),
    ))
    rows = rows.withColumn("errors", errors)
    outcome = F.when(F.size("errors") > 0, F.lit(None)).when(F.col("fail"), F.lit("INELIGIBLE")).when(F.col("unknown"), F.lit("NEEDS_REVIEW")).otherwise(F.lit("ELIGIBLE"))
    return rows.select(key, outcome.alias("outcome"), "errors")


def hard_gate(policy: Mapping[str, Any], value: Column, method: Column) -> Column:
    """PASS for a known value of an accepted method, else UNKNOWN: no proposal passes a hard gate."""
    return F.when((value != "UNKNOWN") & method.isin(list(policy["hard_gate_accepted_methods"])), F.lit("PASS")).otherwise(F.lit("UNKNOWN"))


def derived_gate(policy: Mapping[str, Any], values: DataFrame, key: str = "record_id") -> DataFrame:
    """key, decision of the criterion that all hard-gate fields (field, value, method) are backed; another field fails the query."""
    fields = list(policy["hard_gate_fields"])
    passed = F.when(hard_gate(policy, F.col("value"), F.col("method")) == "PASS", F.col("field"))
    refuse = F.raise_error(F.concat(F.lit("not a hard-gate field: "), F.coalesce("field", F.lit("null")))).cast("string")
    rows = values.withColumn("field", F.when(F.col("field").isin(fields), F.col("field")).otherwise(refuse))
    rows = rows.groupBy(key).agg(F.count_distinct(passed).alias("n"))
    return rows.select(key, F.when(F.col("n") == len(fields), F.lit("PASS")).otherwise(F.lit("UNKNOWN")).alias("decision"))


def evaluate(policy: Mapping[str, Any], decisions: DataFrame, values: DataFrame, key: str = "record_id", derived: str = "E13") -> DataFrame:
    """Eligibility whose derived criterion comes from the hard-gate values alone: decisions that assert it fail the query.

    A record without any value has it UNKNOWN.
    """
    refuse = F.raise_error(F.concat(F.lit(f"{derived} is derived and can't be supplied: "), F.col(key).cast("string"))).cast("string")
    own = decisions.select(key, F.when(F.col("criterion_id") == derived, refuse).otherwise(F.col("criterion_id")).alias("criterion_id"), "decision")
    found = derived_gate(policy, values, key).withColumnRenamed(key, "g_key").withColumnRenamed("decision", "g_decision")
    gate = decisions.select(key).distinct().join(found, F.col(key) == F.col("g_key"), "left")
    gate = gate.select(key, F.lit(derived).alias("criterion_id"), F.coalesce("g_decision", F.lit("UNKNOWN")).alias("decision"))
    return eligibility(policy, own.unionAll(gate), key)


def assessment_violations(policy: Mapping[str, Any], assessments: DataFrame, key: str = "assessment_id", derived: str = "E13") -> DataFrame:
    """key, violation of assessments (policy_version, criteria, hard_gate_fields, outcome); the outcome must be the aggregated one.

    Criteria that aren't the policy's, lack, or have a decision that they can't have are violations; nothing is aggregated from them.

    criteria: array of (criterion_id, decision); hard_gate_fields: array of (field, value, method, curation_ref).
    """
    hard = [c["id"] for c in policy["criteria"] if c["hard"]]
    wanted = F.array(*[F.lit(f) for f in policy["hard_gate_fields"]])
    ids, fields = F.transform("criteria", lambda c: c["criterion_id"]), F.transform("hard_gate_fields", lambda f: f["field"])
    having = lambda d: F.exists("criteria", lambda c: c["criterion_id"].isin(hard) & (c["decision"] == d))
    backed = F.forall("hard_gate_fields", lambda f: f["method"].isin(list(policy["hard_gate_accepted_methods"])))
    passed = F.exists("criteria", lambda c: (c["criterion_id"] == derived) & (c["decision"] == "PASS"))
    outcome = F.when(having("FAIL"), F.lit("INELIGIBLE")).when(having("UNKNOWN"), F.lit("NEEDS_REVIEW")).otherwise(F.lit("ELIGIBLE"))
    known = F.array(*[F.lit(c["id"]) for c in policy["criteria"]])
    always = [c["id"] for c in policy["criteria"] if c["applicability"] != "CONDITIONAL"]
    errors = {
        "UNKNOWN_CRITERION": F.size(F.array_except(ids, known)) > 0, "NOT_EVALUATED": F.size(F.array_except(known, ids)) > 0, "INVALID_DECISION": F.exists("criteria", lambda c: ~F.coalesce(c["decision"].isin(list(policy["decision_values"])), F.lit(False))),
        "ALWAYS_APPLICABLE": F.exists("criteria", lambda c: c["criterion_id"].isin(always) & (c["decision"] == "NOT_APPLICABLE")),
    }
    wrong = reduce(Column.__or__, errors.values())
    checks = F.array(
        *[F.when(broken, F.lit(name)) for name, broken in errors.items()],
        F.when(~F.col("policy_version").eqNullSafe(F.lit(policy["policy_version"])), F.lit("POLICY_VERSION")),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), F.lit("EVALUATED_TWICE")),
        F.when((F.size(fields) != F.size(wanted)) | (F.size(F.array_except(wanted, fields)) > 0), F.lit("HARD_GATE_FIELDS")),
        F.when(F.exists("hard_gate_fields", lambda f: (f["method"] == "CURATED") & f["curation_ref"].isNull()), F.lit("NO_CURATION_REF")),
        F.when(passed & ~backed, F.lit("NOT_BACKED")),
        F.when(~wrong & ~F.col("outcome").eqNullSafe(outcome), F.concat(F.lit("OUTCOME:"), outcome)),
    )
    return assessments.select(key, F.explode(F.array_compact(checks)).alias("violation"))


def ml_gate(thresholds: Mapping[str, Any], confidence: Column) -> Column:
    """Where a proposal goes; everything to REVIEW while thresholds are inactive, null if out of range."""
    fits = (confidence >= 0) & (confidence <= 1)
    if not thresholds["active"]:
        return F.when(fits, F.lit("REVIEW"))
    values = thresholds["provisional_values"]
    return F.when(fits, F.when(confidence >= values["accept_threshold"], F.lit("ACCEPT_NON_GATE")).when(confidence >= values["review_threshold"], F.lit("REVIEW")).otherwise(F.lit("ABSTAIN")))


def task_allowed(allowed: list[str], prohibited: list[str], task: Column) -> Column:
    return task.isin(allowed) & ~task.isin(prohibited)


def release_violations(manifests: DataFrame) -> DataFrame:
    """release_version, violation of manifests (git_tag, gates_passed, gates_total, previous_release, release_kind, records, artifacts)."""
    kind = text.release_kind(F.col("previous_release"), F.col("release_version"))
    ids = F.transform("records", lambda r: r["record_id"])
    paths = F.transform("artifacts", lambda a: a["path"])
    checks = F.array(
        F.when(F.col("git_tag") != F.concat(F.lit("v"), F.col("release_version")), F.lit("WRONG_TAG")),
        F.when(F.col("gates_passed") != F.col("gates_total"), F.lit("GATES_NOT_PASSED")),
        F.when(F.col("previous_release").isNotNull() & (F.col("release_kind") != kind), F.concat(F.lit("WRONG_KIND:"), kind)),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), F.lit("RECORD_TWICE")),
        F.when(F.size(paths) > F.size(F.array_distinct(paths)), F.lit("PATH_TWICE")),
    )
    return manifests.select("release_version", F.explode(F.array_compact(checks)).alias("violation"))


def frozen_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, violation: files of a manifest (path, sha256) that are MISSING or CHANGED."""
    rows = manifest.join(files.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha")), F.col("path") == F.col("f_path"), "left")
    what = F.when(F.col("f_path").isNull(), F.lit("MISSING")).when(F.col("f_sha") != F.col("sha256"), F.lit("CHANGED"))
    return rows.select("path", what.alias("violation")).filter("violation is not null")


def lock_violations(lock: DataFrame, files: DataFrame, status: str) -> DataFrame:
    """path, violation of a lock (key, value) with <path>_sha256 rows: its STATUS, its COUNT, its PROTOCOL, and files that are MISSING or CHANGED."""
    locked = lock.filter(F.col("key").endswith("_sha256") & F.col("key").contains("/")).select(F.expr("substring(key, 1, length(key) - 7)").alias("path"), F.col("value").alias("sha256"))
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    entries = F.map_from_entries(F.collect_list(F.when(F.col("key").endswith("_sha256") & F.col("key").contains("/"), F.struct("key", "value"))))
    facts = lock.agg(of("status").alias("status"), of("locked_file_count").alias("n"), of("protocol").alias("protocol"), of("protocol_sha256").alias("sha"), entries.alias("entries"))
    of_protocol = F.try_element_at(F.col("entries"), F.concat("protocol", F.lit("_sha256")))
    checks = F.array(
        F.when(~F.col("status").eqNullSafe(F.lit(status)), F.struct(F.lit("status").alias("path"), F.lit("STATUS").alias("violation"))),
        F.when(~F.col("n").eqNullSafe(F.size("entries").cast("string")), F.struct(F.lit("locked_file_count").alias("path"), F.lit("COUNT").alias("violation"))),
        F.when(F.col("protocol").isNull() | ~of_protocol.eqNullSafe(F.col("sha")), F.struct(F.lit("protocol").alias("path"), F.lit("PROTOCOL").alias("violation"))),
    )
    own = facts.select(F.explode(F.array_compact(checks)).alias("v")).select("v.*")
    return own.unionAll(frozen_violations(locked, files))


def admission(checks: dict[str, Column]) -> list[Column]:
    """eligible and reasons columns of a conjunction of named checks; a null check fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return [(F.size(failed) == 0).alias("eligible"), failed.alias("reasons")]


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unresolved_references(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    return df.filter(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias("__t")).distinct(), F.col(key) == F.col("__t"), "left_anti")
