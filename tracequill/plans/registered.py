"""Registered queries: each operator applied to the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequill.functions import canonical, text
from tracequill.operators import aggregates, evidence, gates, identity, intervals, policy, selection, sets
from tracequill.plans.roles import SQL, Roles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a function of roles under its name, with its SQL (after the role tables, unless plain)."""

    def register(f: Callable[[Roles], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql if plain else (SQL.replace("WITH ", "WITH RECURSIVE ", 1) if sql.startswith(",") else SQL) + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- evidence -------------------------------------------------------------------------------

EVIDENCE = "event_id, benchmark_run_id, experiment_id, sample, technology, run_kind, event_status, observation_id, side, raw_decision, source_record_ordinal, quantity"


def _cols(names: str) -> list[str]:
    return [n.strip() for n in names.split(",")]


@query(f"""SELECT {EVIDENCE}, provenance_link_id, source_artifact_id, artifact_name FROM registry_events JOIN observations o USING (event_id, benchmark_run_id) JOIN runs USING (benchmark_run_id)
JOIN experiments USING (experiment_id) JOIN (SELECT provenance_link_id, target_entity_id AS observation_id, source_entity_id AS a_id FROM provenance WHERE relation = 'NORMALIZED_FROM') USING (observation_id)
JOIN artifacts a ON a.source_artifact_id = a_id""".replace("provenance_link_id, source_artifact_id", "provenance_link_id, a.source_artifact_id"))
def event_evidence(r: Roles) -> DataFrame:
    rows = evidence.event_evidence(r.registry_events, r.observations.drop("source_artifact_id", "variant_id"), r.runs, r.experiments, r.provenance, r.artifacts)
    return rows.select(*_cols(EVIDENCE), "provenance_link_id", "source_artifact_id", "artifact_name")


@query(f"""SELECT v.variant_id, v.contig, v.size, v.kind, {EVIDENCE} FROM variants v JOIN links USING (variant_id) JOIN registry_events USING (event_id)
JOIN (SELECT * EXCLUDE (variant_id) FROM observations) USING (event_id, benchmark_run_id) JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id)
WHERE v.variant_id = (SELECT min(variant_id) FROM variants)""")
def variant_evidence(r: Roles) -> DataFrame:
    first = r.variants.agg(F.min("variant_id")).first()[0]
    rows = evidence.variant_evidence(r.variants, r.links, r.registry_events, r.observations.drop("variant_id", "source_artifact_id"), r.runs, r.experiments, first)
    return rows.select("variant_id", "contig", "size", "kind", *_cols(EVIDENCE))


@query("SELECT event_id, observation_id, side, sample, technology, raw_decision FROM registry_events JOIN observations USING (event_id, benchmark_run_id) JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id)")
def slim_event_query(r: Roles) -> DataFrame:
    return evidence.slim_events(r.registry_events, r.observations, r.runs, r.experiments)


@query("""SELECT a.variant_id, a.source_artifact_id AS a_source_artifact_id, b.source_artifact_id AS b_source_artifact_id, a.observation_id AS a_observation_id, b.observation_id AS b_observation_id,
false AS equivalence_asserted FROM items a JOIN items b ON a.variant_id = b.variant_id AND a.source_artifact_id < b.source_artifact_id AND a.quantity = b.quantity""")
def cross_run_candidates(r: Roles) -> DataFrame:
    return evidence.candidate_pairs(r.items, "variant_id", "source_artifact_id", "observation_id", same=("quantity",))


@query("""SELECT p.variant_id, p.a_source_artifact_id, p.b_source_artifact_id, x.event_status AS a_status, y.event_status AS b_status,
(x.benchmark_run_id = y.benchmark_run_id) AS same_run FROM (SELECT a.variant_id, a.source_artifact_id AS a_source_artifact_id, b.source_artifact_id AS b_source_artifact_id, a.event_id AS a_event_id, b.event_id AS b_event_id
FROM items a JOIN items b ON a.variant_id = b.variant_id AND a.source_artifact_id < b.source_artifact_id AND a.quantity = b.quantity) p
JOIN registry_events x ON x.event_id = p.a_event_id JOIN registry_events y ON y.event_id = p.b_event_id""")
def candidate_events(r: Roles) -> DataFrame:
    pairs = evidence.candidate_pairs(r.items, "variant_id", "source_artifact_id", "event_id", same=("quantity",))
    events = r.registry_events.select("event_id", "event_status", F.col("benchmark_run_id").alias("run"))
    rows = evidence.candidate_events(pairs.withColumns({"a_run": F.lit(0), "b_run": F.lit(0)}), events, "variant_id", "run", "event_id")
    return rows.select("variant_id", "a_source_artifact_id", "b_source_artifact_id", F.col("a_event_status_of_event").alias("a_status"), F.col("b_event_status_of_event").alias("b_status"), (F.col("a_run_of_event") == F.col("b_run_of_event")).alias("same_run"))


@query("SELECT row_number() OVER (ORDER BY event_id)::BIGINT AS candidate_number, event_id, event_status FROM registry_events")
def numbered_candidates(r: Roles) -> DataFrame:
    return evidence.numbered(r.registry_events.select("event_id", "event_status"), "candidate_number", "event_id")


@query("""SELECT event_id, benchmark_run_id, CASE WHEN event_id % 2 = 1 AND n IS NULL THEN 'NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY' WHEN event_id % 2 = 1 THEN 'EXACT_NORMALIZED_ALLELE' WHEN event_status = 'F' THEN 'EXACT_NORMALIZED_ALLELE' ELSE 'UNRESOLVED' END AS identity_state,
CASE WHEN event_id % 2 = 0 AND event_status <> 'F' THEN event_status END AS unresolved_reason FROM registry_events LEFT JOIN (SELECT event_id, count(*) AS n FROM items WHERE quantity > 25 GROUP BY event_id) USING (event_id)""")
def identity_state(r: Roles) -> DataFrame:
    events = r.registry_events.withColumn("phase", F.when(F.pmod("event_id", F.lit(2)) == 1, 1).otherwise(2))
    links = r.observations.filter("quantity > 25").groupBy("event_id").agg(F.min("variant_id").alias("variant_id"), F.min("benchmark_run_id").alias("benchmark_run_id"))
    accounting = r.registry_events.select("event_id", F.when(F.col("event_status") == "F", F.lit("EXACT_NORMALIZED_ALLELE")).otherwise(F.lit("UNRESOLVED")).alias("status"), F.col("event_status").alias("reason"))
    return evidence.with_identity_state(events, links, accounting).select("event_id", "benchmark_run_id", "identity_state", "unresolved_reason")


@query("""SELECT e.event_id, event_status, raw_decisions, sides, n_observations FROM registry_events e JOIN (SELECT event_id, string_agg(DISTINCT raw_decision, ';' ORDER BY raw_decision) AS raw_decisions, string_agg(DISTINCT side, ';' ORDER BY side) AS sides, count(*) AS n_observations
FROM items GROUP BY event_id) USING (event_id) WHERE event_status = 'F' AND list_contains(string_split(sides, ';'), 'A')""")
def event_search(r: Roles) -> DataFrame:
    index = aggregates.event_search_index(r.registry_events, r.items.withColumn("raw_variant_type", F.col("side"))).withColumn("raw_variant_types", F.split("raw_variant_types", ";"))
    found = evidence.search(index.filter("event_status = 'F'"), raw_type="A")
    return found.select("event_id", "event_status", "raw_decisions", F.array_join("raw_variant_types", ";").alias("sides"), "n_observations")


# ---- aggregates -----------------------------------------------------------------------------


@query("SELECT 'part' AS table_name, count(*) AS n_rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation", plain=True)
def registry_counts(r: Roles) -> DataFrame:
    return aggregates.table_counts({n: r.raw(n) for n in ("part", "orders", "lineitem", "customer", "nation")})


@query("SELECT count(DISTINCT event_id) AS n_events, count(DISTINCT observation_id) AS n_observations, count(DISTINCT benchmark_run_id) AS n_runs, count(DISTINCT experiment_id) AS n_experiments, count(DISTINCT technology) AS n_technologies FROM observations JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id)")
def linked_registry_totals(r: Roles) -> DataFrame:
    rows = r.located
    return aggregates.distinct_counts(rows, {"n_events": "event_id", "n_observations": "observation_id", "n_runs": "benchmark_run_id", "n_experiments": "experiment_id", "n_technologies": "technology"})


@query("SELECT variant_id, count(DISTINCT event_id) AS n_events, count(DISTINCT benchmark_run_id) AS n_runs, count(DISTINCT experiment_id) AS n_experiments, count(DISTINCT technology) AS n_technologies FROM observations JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id) GROUP BY variant_id")
def variant_topology(r: Roles) -> DataFrame:
    rows = r.located
    return aggregates.distinct_counts(rows, {"n_events": "event_id", "n_runs": "benchmark_run_id", "n_experiments": "experiment_id", "n_technologies": "technology"}, by="variant_id")


@query("SELECT r.benchmark_run_id, coalesce(n_events, 0) AS n_events, coalesce(n_observations, 0) AS n_observations FROM runs r LEFT JOIN (SELECT benchmark_run_id, count(*) AS n_events FROM registry_events GROUP BY 1) USING (benchmark_run_id) LEFT JOIN (SELECT benchmark_run_id, count(*) AS n_observations FROM observations GROUP BY 1) USING (benchmark_run_id)")
def run_counts_zero_filled(r: Roles) -> DataFrame:
    return aggregates.zero_filled(r.runs, "benchmark_run_id", {"n_events": r.registry_events, "n_observations": r.observations})


@query("SELECT coalesce(a.side, b.side) AS side, coalesce(a.raw_decision, b.raw_decision) AS raw_decision, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT side, raw_decision, count(*) AS n_a FROM items WHERE event_id % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT side, raw_decision, count(*) AS n_b FROM items WHERE event_id % 2 = 1 GROUP BY ALL) b ON a.side = b.side AND a.raw_decision = b.raw_decision WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)")
def decision_reconciliation(r: Roles) -> DataFrame:
    even = F.pmod("event_id", F.lit(2)) == 0
    return aggregates.reconcile(r.items.filter(even), r.items.filter(~even), "side", "raw_decision")


@query("""SELECT event_id, min(source_record_ordinal) AS start, max(quantity) AS "end", CASE WHEN count(DISTINCT side) = 1 THEN min(side) END AS contig, CASE WHEN count(DISTINCT raw_decision) + max((raw_decision IS NULL)::INT) = 1 THEN min(raw_decision) END AS lookup_key, count(*) AS n_rows FROM items GROUP BY event_id""")
def event_bounds_lookup(r: Roles) -> DataFrame:
    return identity.event_bounds(r.items, "event_id", "source_record_ordinal", "quantity", "side", "raw_decision")


@query("SELECT variant_id, count(DISTINCT event_id) AS n_linked, count(DISTINCT source_artifact_id) AS n_groups, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT unnest(list(source_artifact_id::VARCHAR)) AS x)) AS groups FROM items GROUP BY variant_id".replace("(SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT unnest(list(source_artifact_id::VARCHAR)) AS x))", "string_agg(DISTINCT source_artifact_id::VARCHAR, ';' ORDER BY source_artifact_id::VARCHAR)"))
def graph_audit(r: Roles) -> DataFrame:
    return identity.graph_audit(r.items, "event_id", "variant_id", "source_artifact_id")


@query("SELECT degree, count(*) AS n_nodes FROM (SELECT variant_id, count(DISTINCT event_id) AS degree FROM items GROUP BY 1) GROUP BY degree")
def degree_histogram(r: Roles) -> DataFrame:
    return identity.degree_histogram(r.items, "event_id", "variant_id")


@query("SELECT variant_id, source_artifact_id, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(r: Roles) -> DataFrame:
    return identity.duplicate_edges(r.items, "variant_id", "source_artifact_id")


_BEST = "SELECT variant_id, count(DISTINCT sample) AS n_samples, count(DISTINCT technology) AS n_technologies, count(DISTINCT observation_id) AS n_links FROM observations JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 {} LIMIT 1"


def _best(r: Roles, largest: bool) -> DataFrame:
    rows = r.located
    return aggregates.best_covered(rows, "variant_id", "sample", "technology", "observation_id", largest)


@query(_BEST.format("ASC"))
def best_variant_smallest_id(r: Roles) -> DataFrame:
    return _best(r, False)


@query(_BEST.format("DESC"))
def best_variant_largest_id(r: Roles) -> DataFrame:
    return _best(r, True)


@query("""SELECT l.variant_id, count(DISTINCT l.event_id) AS n_events, sum(n_observations)::BIGINT AS n_observations, string_agg(DISTINCT sample, ';' ORDER BY sample) AS samples, string_agg(DISTINCT technology, ';' ORDER BY technology) AS technologies
FROM links l JOIN (SELECT event_id, sample, technology, count(*) AS n_observations FROM observations JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id) GROUP BY ALL) USING (event_id) GROUP BY 1""")
def variant_rollup(r: Roles) -> DataFrame:
    counted = r.located.groupBy("event_id", "sample", "technology").agg(F.count(F.lit(1)).alias("n_observations"))
    return aggregates.variant_rollup(r.links, counted)


@query("SELECT e.*, raw_decisions, raw_variant_types, n_observations FROM registry_events e LEFT JOIN (SELECT event_id, string_agg(DISTINCT raw_decision, ';' ORDER BY raw_decision) AS raw_decisions, string_agg(DISTINCT side, ';' ORDER BY side) AS raw_variant_types, count(*) AS n_observations FROM items GROUP BY 1) USING (event_id)")
def event_search_index(r: Roles) -> DataFrame:
    return aggregates.event_search_index(r.registry_events, r.items.withColumn("raw_variant_type", F.col("side")))


@query("""SELECT entity_type, entity_id, string_agg(DISTINCT provenance_link_id, ';' ORDER BY provenance_link_id) AS provenance_link_ids FROM (SELECT provenance_link_id, source_entity_type AS entity_type, source_entity_id::VARCHAR AS entity_id FROM provenance
UNION ALL SELECT provenance_link_id, target_entity_type, target_entity_id FROM provenance) GROUP BY ALL""")
def provenance_index(r: Roles) -> DataFrame:
    return aggregates.provenance_index(r.provenance.withColumn("source_entity_id", F.col("source_entity_id").cast("string")))


@query("SELECT benchmark_run_id FROM observations GROUP BY 1 HAVING count(DISTINCT CASE WHEN side IN ('A', 'N', 'R') THEN side END) = 3")
def runs_with_all_sides(r: Roles) -> DataFrame:
    return aggregates.samples_with_all(r.observations, "benchmark_run_id", "side", ["A", "N", "R"])


@query("SELECT technology, count(*) AS n_rows, count(*) FILTER (WHERE quantity > 40) AS n_large, count(*) FILTER (WHERE side = 'R') AS n_returned FROM observations JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id) GROUP BY 1")
def conditional_counts(r: Roles) -> DataFrame:
    rows = r.located
    return aggregates.conditional_counts(rows, {"n_large": F.col("quantity") > 40, "n_returned": F.col("side") == "R"}, by="technology")


# ---- sets -----------------------------------------------------------------------------------


@query("SELECT benchmark_run_id, run_kind FROM runs WHERE benchmark_run_id NOT IN (SELECT benchmark_run_id FROM registry_events)")
def runs_without_events(r: Roles) -> DataFrame:
    return sets.missing(r.runs, r.registry_events, "benchmark_run_id").select("benchmark_run_id", "run_kind")


@query("SELECT event_id, benchmark_run_id FROM registry_events WHERE event_id NOT IN (SELECT event_id FROM items)")
def lineage_missing(r: Roles) -> DataFrame:
    return sets.missing(r.registry_events, r.items, "event_id").select("event_id", "benchmark_run_id")


@query("SELECT event_id, event_status FROM registry_events WHERE event_id IN (SELECT event_id FROM items WHERE quantity >= 45)")
def exportable_events(r: Roles) -> DataFrame:
    return sets.present(r.registry_events, r.items.filter("quantity >= 45"), "event_id").select("event_id", "event_status")


@query("SELECT coalesce(a.k, b.k) AS benchmark_run_id, CASE WHEN b.k IS NULL THEN 'LEFT' ELSE 'RIGHT' END AS only_in FROM (SELECT DISTINCT benchmark_run_id AS k FROM registry_events WHERE event_status = 'F') a FULL JOIN (SELECT DISTINCT benchmark_run_id AS k FROM registry_events WHERE event_status = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_difference(r: Roles) -> DataFrame:
    e = r.registry_events
    return sets.key_difference(e.filter("event_status = 'F'"), e.filter("event_status = 'O'"), "benchmark_run_id")


@query("SELECT variant_id FROM variants WHERE size <= 30 INTERSECT SELECT variant_id FROM items WHERE quantity > 48")
def shared_variants(r: Roles) -> DataFrame:
    return sets.shared_keys(r.variants.filter("size <= 30"), r.items.filter("quantity > 48"), "variant_id")


@query("SELECT *, 'first' AS phase FROM (SELECT event_id, benchmark_run_id, event_status FROM registry_events) WHERE event_id % 3 = 0 UNION ALL SELECT *, 'second' FROM (SELECT event_id, benchmark_run_id, NULL AS event_status FROM registry_events) WHERE event_id % 3 <> 0")
def union_of_phases(r: Roles) -> DataFrame:
    third, e = F.pmod("event_id", F.lit(3)) == 0, r.registry_events
    return sets.union_by_phase({"first": e.filter(third).select("event_id", "benchmark_run_id", "event_status"), "second": e.filter(~third).select("event_id", "benchmark_run_id")})


@query("""SELECT coalesce(a.variant_id, b.variant_id) AS variant_id, coalesce(a.contig, b.contig) AS contig, coalesce(a.size, b.size) AS size, CASE WHEN b.variant_id IS NULL THEN 'FIRST' WHEN a.variant_id IS NULL THEN 'SECOND' ELSE 'BOTH' END AS origin,
(a.variant_id IS NOT NULL AND b.variant_id IS NOT NULL AND a.size <> b.size) AS conflict FROM (SELECT * FROM variants WHERE size <= 30) a FULL JOIN (SELECT variant_id, contig, CASE WHEN variant_id % 10 = 0 THEN size + 1 ELSE size END AS size FROM variants WHERE size >= 20) b ON a.variant_id = b.variant_id""")
def variant_union(r: Roles) -> DataFrame:
    v = r.variants
    changed = v.filter("size >= 20").withColumn("size", F.when(F.pmod("variant_id", F.lit(10)) == 0, F.col("size") + 1).otherwise(F.col("size")))
    return sets.union_with_origin(v.filter("size <= 30"), changed, "variant_id", ["contig", "size"], ("FIRST", "SECOND", "BOTH"))


@query("SELECT sha256(text) AS content_key, min(doc_id) AS doc_id, count(*) - 1 AS n_duplicates FROM documents GROUP BY 1", plain=True)
def dedup_first_wins(r: Roles) -> DataFrame:
    return sets.first_wins(r.raw("documents").select(F.sha2("text", 256).alias("content_key"), "doc_id"), "content_key", "doc_id")


@query("SELECT event_id, count(DISTINCT (side, raw_decision)) AS n_contents FROM items GROUP BY 1 HAVING count(DISTINCT (side, raw_decision)) > 1")
def content_conflicts(r: Roles) -> DataFrame:
    return sets.content_conflicts(r.items, "event_id", ["side", "raw_decision"])


@query("SELECT benchmark_run_id, event_id, row_number() OVER (PARTITION BY benchmark_run_id ORDER BY event_id)::INT AS source_rank FROM registry_events")
def ranked_events(r: Roles) -> DataFrame:
    return sets.ranked(r.registry_events.select("benchmark_run_id", "event_id"), "source_rank", ["benchmark_run_id"], "event_id")


# ---- identities -----------------------------------------------------------------------------

_VARIANT = """'variant:sha256:' || sha256('{"assembly":"A1","contig":"' || contig || '","identity_schema_version":"1.0.0","normalized_alt":"' || kind || '","normalized_end_0based":' || (variant_id + size) || ',"normalized_ref":"R","normalized_start_0based":' || variant_id || '}')"""


def _variant(r: Roles) -> DataFrame:
    c = F.col
    return r.variants.select("*", canonical.variant_id("1.0.0", F.lit("A1"), c("contig"), c("variant_id"), c("variant_id") + c("size"), F.lit("R"), c("kind")).alias("content_id"))


@query(f"SELECT variant_id, {_VARIANT} AS content_id FROM variants")
def content_ids(r: Roles) -> DataFrame:
    return _variant(r).select("variant_id", "content_id")


@query("""SELECT event_id, variant_id, 'event-variant-link:sha256:' || sha256('{"benchmark_run_id":' || benchmark_run_id || ',"event_id":' || event_id || ',"identity_method":"exact_normalized_allele","identity_method_version":"1.0.0","identity_status":"EXACT_NORMALIZED_ALLELE","schema_version":"1.0.0","variant_id":' || variant_id || '}') AS link_id
FROM (SELECT DISTINCT event_id, variant_id, benchmark_run_id FROM observations)""")
def link_ids(r: Roles) -> DataFrame:
    c, m = F.col, identity.Method()
    rows = r.observations.select("event_id", "variant_id", "benchmark_run_id").distinct()
    return rows.select("event_id", "variant_id", canonical.link_id(c("event_id"), c("variant_id"), c("benchmark_run_id"), m.link_schema, identity.EXACT, m.name, m.version).alias("link_id"))


@query("""SELECT event_id, 'obs-' || left(sha256('{"event_id":' || event_id || ',"side":"' || event_status || '"}'), 32) AS stable_id, left(sha256(event_id::VARCHAR), 2) AS shard, sha256('salt|' || event_id) AS selection_hash, left(sha256(priority), 16) AS token, sha256('{"priority":"' || priority || '"}' || chr(10)) AS parameter_hash FROM registry_events""")
def stable_ids(r: Roles) -> DataFrame:
    e = F.col("event_id")
    return r.registry_events.select(
        "event_id", canonical.stable_id("obs", {"side": F.col("event_status"), "event_id": e}).alias("stable_id"), canonical.shard_key(e.cast("string")).alias("shard"), canonical.selection_hash("salt", e.cast("string")).alias("selection_hash"),
        canonical.artifact_token(F.col("priority")).alias("token"), canonical.parameter_hash({"priority": F.col("priority")}).alias("parameter_hash"),
    )


@query("""SELECT a.variant_id AS a_id, b.variant_id AS b_id, CASE WHEN a.kind <> b.kind THEN 'NON_EQUIVALENT' WHEN a.size = b.size AND a.variant_id % 5 = b.variant_id % 5 AND a.variant_id % 3 = b.variant_id % 3 THEN 'EXACT_NORMALIZED_ALLELE' WHEN a.size = b.size AND a.variant_id % 5 = b.variant_id % 5 THEN 'NON_EQUIVALENT' ELSE 'UNRESOLVED' END AS status
FROM variants a JOIN variants b ON a.contig = b.contig AND a.size = b.size AND a.variant_id < b.variant_id""")
def pair_classification(r: Roles) -> DataFrame:
    start = F.col("size") + F.pmod("variant_id", F.lit(5)) * 1000
    v = r.variants.select(F.col("variant_id").alias("id"), F.col("contig").alias("group"), "size", F.col("kind").alias("contig"), start.alias("start"), F.pmod("variant_id", F.lit(3)).cast("string").alias("ref"))
    pairs = identity.pairs_within(v, "id", ["group", "size"])
    fixed = {f"{p}{k}": x for p in ("a_", "b_") for k, x in (("assembly", F.lit("A1")), ("end", F.col(f"{p}start") + 1), ("alt", F.lit("T")))}
    status = identity.classify()  # the same whichever comes first
    return pairs.withColumns(fixed).select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), status.alias("status"))


def _identity_inputs(r: Roles) -> tuple[DataFrame, DataFrame]:
    c = F.col
    events = r.registry_events.select(c("event_id").cast("string").alias("event_id"), c("benchmark_run_id").cast("string").alias("benchmark_run_id"), F.when(c("event_status") == "P", F.lit("")).otherwise(F.lit("A1")).alias("assembly"), c("priority").alias("contig"), F.lit("").alias("normalized_allele_lookup_key"))
    observations = r.items.select(c("event_id").cast("string").alias("event_id"), c("source_record_ordinal").cast("string").alias("normalized_start_0based"), (c("source_record_ordinal") + 1).cast("string").alias("normalized_end_0based"), F.when(c("quantity") < 3, F.lit("")).otherwise(c("side")).alias("normalized_ref"), c("raw_decision").alias("normalized_alt"))
    return events, observations


_DECIDED = """SELECT e.event_id::VARCHAR AS event_id, e.benchmark_run_id::VARCHAR AS benchmark_run_id, e.priority, n, s, r, a, CASE WHEN n IS NULL THEN 'MISSING_OBSERVATIONS' WHEN event_status = 'P' THEN 'MISSING_EVENT_ASSEMBLY' WHEN n_complete <> n THEN 'MISSING_NORMALIZED_ALLELE_FIELD' WHEN n_alleles <> 1 THEN 'MULTIPLE_NORMALIZED_ALLELES' ELSE '' END AS reason
FROM registry_events e LEFT JOIN (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE quantity >= 3) AS n_complete, count(DISTINCT CASE WHEN quantity >= 3 THEN (source_record_ordinal, side, raw_decision) END) AS n_alleles, min(source_record_ordinal) AS s, min(side) AS r, min(raw_decision) AS a FROM items GROUP BY 1) USING (event_id)"""


@query(f"SELECT event_id, reason, CASE WHEN reason = '' THEN 'EXACT_NORMALIZED_ALLELE' ELSE 'UNRESOLVED' END AS status, coalesce(n, 0) AS n_observations FROM ({_DECIDED})")
def identity_decision(r: Roles) -> DataFrame:
    return identity.decide(*_identity_inputs(r)).select("event_id", "reason", "status", F.coalesce("n_observations", F.lit(0)).alias("n_observations"))


_LINKED = f"""SELECT *, 'variant:sha256:' || sha256('{{"assembly":"A1","contig":"' || priority || '","identity_schema_version":"1.0.0","normalized_alt":"' || a || '","normalized_end_0based":' || (s + 1) || ',"normalized_ref":"' || r || '","normalized_start_0based":' || s || '}}') AS variant_id FROM ({_DECIDED}) WHERE reason = ''"""


@query(f"SELECT variant_id, count(DISTINCT event_id) AS n_events, string_agg(DISTINCT benchmark_run_id, ';' ORDER BY benchmark_run_id) AS benchmark_run_ids FROM ({_LINKED}) GROUP BY 1")
def identity_materialization(r: Roles) -> DataFrame:
    events, observations = _identity_inputs(r)
    known = events.limit(0).select(F.col("event_id").alias("variant_id"))
    made = identity.materialize(events, observations, known)
    n = made.links.groupBy(F.col("variant_id").alias("v")).agg(F.count_distinct("event_id").alias("n_events"))
    return made.variants.join(n, F.col("variant_id") == F.col("v")).select("variant_id", "n_events", "benchmark_run_ids")


@query("SELECT event_id, CASE WHEN n = 1 THEN 'SINGLE_ALLELE' WHEN n = 0 THEN 'NO_ALLELE' ELSE 'MULTIPLE_ALLELES' END AS structure FROM (SELECT event_id, count(DISTINCT CASE WHEN quantity > 25 THEN variant_id END) AS n FROM items GROUP BY 1)")
def structural_class(r: Roles) -> DataFrame:
    n = r.items.groupBy("event_id").agg(F.count_distinct(F.when(F.col("quantity") > 25, F.col("variant_id"))).alias("n"))
    return n.select("event_id", identity.structural_class(F.col("n")).alias("structure"))


@query("SELECT variant_id, CASE WHEN variant_id IN (SELECT variant_id FROM items WHERE quantity = 50) THEN 'REUSED' ELSE 'NEW' END AS origin FROM variants")
def variant_reuse(r: Roles) -> DataFrame:
    return identity.reuse(r.variants, r.items.filter("quantity = 50"))


@query("SELECT observation_id, s AS side, v AS value FROM (SELECT observation_id, unnest([{'s': 'TRUTH', 'v': side}, {'s': 'QUERY', 'v': raw_decision}], recursive := true) FROM items)")
def two_sides(r: Roles) -> DataFrame:
    records = r.items.select("observation_id", F.col("side").alias("truth_value"), F.col("raw_decision").alias("query_value"))
    return identity.sides(records, ["value"]).select("observation_id", "side", "value")


# ---- intervals ------------------------------------------------------------------------------

_MERGED = """(SELECT contig{0}, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM (SELECT *, sum(is_new) OVER (PARTITION BY contig{0} ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS run FROM
(SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY contig{0} ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM intervals {1})) GROUP BY contig{0}, run)"""
_SIDE = [_MERGED.format("", f"WHERE side = {s}") for s in (0, 1)]


def _sides(r: Roles) -> tuple[DataFrame, DataFrame]:
    i = r.intervals
    return i.filter("side = 0"), i.filter("side = 1")


@query(f"SELECT contig, side, start, \"end\", n_merged FROM {_MERGED.format(', side', '')}")
def interval_merge(r: Roles) -> DataFrame:
    return intervals.merge(r.intervals, by=("contig", "side"))


_CUT = f'(SELECT a.contig, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM {_SIDE[0]} a JOIN {_SIDE[1]} b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start)'


@query(f'SELECT contig, start, "end" FROM {_CUT}')
def interval_intersect(r: Roles) -> DataFrame:
    return intervals.intersect(*_sides(r))


@query('SELECT count(*) AS n_intervals, sum("end" - start)::BIGINT AS n_bases, count(DISTINCT contig) AS n_contigs FROM intervals')
def interval_stats(r: Roles) -> DataFrame:
    return intervals.stats(r.intervals)


@query('SELECT a.id AS a_id, b.id AS b_id, least(a."end", b."end") - greatest(a.start, b.start) AS overlap FROM (SELECT * FROM intervals WHERE side = 0) a JOIN (SELECT * FROM intervals WHERE side = 1) b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start')
def interval_overlap_join(r: Roles) -> DataFrame:
    pairs = intervals.tiled_join(*[df.select("contig", "start", "end", "id") for df in _sides(r)], width=4000)
    return pairs.select("a_id", "b_id", intervals.overlap_length(*[F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]).alias("overlap"))


@query(f'SELECT a.id, a.contig, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end", row_number() OVER (PARTITION BY a.id ORDER BY greatest(a.start, b.start), least(a."end", b."end"))::INT AS segment_rank FROM (SELECT * FROM intervals WHERE side = 0) a JOIN {_SIDE[1]} b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start')
def interval_clip(r: Roles) -> DataFrame:
    a, b = _sides(r)
    return intervals.clip(a, intervals.merge(b), "id")


@query(f'SELECT a.id, coalesce(sum(CASE WHEN b.start IS NOT NULL THEN least(a."end", b."end") - greatest(a.start, b.start) END), 0)::BIGINT AS covered FROM (SELECT * FROM intervals WHERE side = 0) a LEFT JOIN {_SIDE[1]} b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start GROUP BY a.id')
def interval_coverage(r: Roles) -> DataFrame:
    return intervals.covered_length(*_sides(r), "id")


_PADDED = _MERGED.format("", "").replace("FROM intervals ", 'FROM (SELECT id, contig, greatest(0, start - 1000) AS start, least("end" + 1000, 2500000) AS "end" FROM intervals WHERE side = 0)')


@query(f'SELECT contig, start, "end" FROM {_PADDED}')
def interval_pad_merge(r: Roles) -> DataFrame:
    a, _ = _sides(r)
    return intervals.pad(a, 1000, a.select("contig").distinct().withColumn("length", F.lit(2_500_000).cast("long")))


@query(f"""SELECT a.id, CASE WHEN bool_or(b.start <= a.start AND a."end" <= b."end") THEN 'INSIDE' WHEN count(b.start) > 0 THEN 'BORDER' ELSE 'OUTSIDE' END AS status FROM (SELECT * FROM intervals WHERE side = 0) a LEFT JOIN {_SIDE[1]} b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start GROUP BY a.id""")
def region_status(r: Roles) -> DataFrame:
    return intervals.region_status(*_sides(r), "id")


@query("""SELECT a.id, CASE WHEN bool_or(b.start <= a.start AND a."end" <= b."end") THEN 'INSIDE' WHEN count(b.start) > 0 THEN 'BORDER' ELSE 'OUTSIDE' END AS status FROM (SELECT * FROM intervals WHERE side = 0) a LEFT JOIN (SELECT * FROM intervals WHERE side = 1) b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start GROUP BY a.id""")
def region_status_unmerged(r: Roles) -> DataFrame:
    return intervals.region_status(*_sides(r), "id", merged=False)


@query(f"""SELECT id FROM (SELECT a.id, bool_or(b.start <= a.start AND a."end" <= b."end") AS ok FROM (SELECT * FROM intervals WHERE side = 0) a LEFT JOIN {_SIDE[1]} b ON a.contig = b.contig AND a.start < b."end" AND a."end" > b.start GROUP BY a.id) WHERE ok IS NOT TRUE""")
def panel_not_contained(r: Roles) -> DataFrame:
    return intervals.not_contained(*_sides(r), "id").select("id")


@query('SELECT a.id AS a_id, b.id AS b_id, least(a."end", b."end") - greatest(a.start, b.start) AS overlap FROM intervals a JOIN intervals b ON a.contig = b.contig AND a.id < b.id AND a.side <> b.side AND a.start < b."end" AND a."end" > b.start AND least(a."end", b."end") - greatest(a.start, b.start) >= 900')
def crossing_pairs(r: Roles) -> DataFrame:
    return intervals.crossing_pairs(r.intervals, "id", 900, "side", width=4000)


_RULES = selection.Rules(half_window=3000, least_assessable=2000, per_contig=2, per_context=6, cross_overlap=3000, last_limit=400, least_contigs=3)


def _candidates(r: Roles) -> DataFrame:
    a, b = _sides(r)
    return selection.candidates(a.withColumn("ordinal", F.col("id")), b, {"assembly": "A1"}, "window", "salt", _RULES)


_CANDIDATES = f"""(SELECT c.*, covered AS assessable_bp FROM (SELECT *, 'window:sha256:' || sha256('{{"assembly":"A1","chromosome":"' || contig || '","nominal_end_0based":' || "end" || ',"nominal_start_0based":' || start || '}}') AS candidate_id FROM (SELECT contig, w AS start, w + 6000 AS "end", min(id) AS ordinal FROM
(SELECT id, contig, greatest(0, (start + "end") // 2 - 3000) AS w FROM intervals WHERE side = 0) GROUP BY ALL)) c JOIN LATERAL (SELECT coalesce(sum(least(c."end", b."end") - greatest(c.start, b.start)), 0)::BIGINT AS covered FROM {_SIDE[1]} b WHERE b.contig = c.contig AND b.start < c."end" AND b."end" > c.start) ON covered >= 2000)"""


@query(f"""SELECT candidate_id, sha256('salt|' || candidate_id) AS selection_hash, contig, start, "end", ordinal, assessable_bp FROM {_CANDIDATES}""")
def window_candidates(r: Roles) -> DataFrame:
    return _candidates(r).select("candidate_id", "selection_hash", "contig", "start", "end", "ordinal", "assessable_bp")


@query(f"""SELECT candidate_id, contig, start, assessable_bp FROM {_CANDIDATES} ORDER BY sha256('salt|' || candidate_id), candidate_id LIMIT 50""")
def frontier_topk(r: Roles) -> DataFrame:
    return selection.frontier(_candidates(r), 50).select("candidate_id", "contig", "start", "assessable_bp")


_GREEDY = f""", chosen_from AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY selection_hash, candidate_id) AS place FROM (SELECT candidate_id, contig, start, "end", sha256('salt|' || candidate_id) AS selection_hash FROM {_CANDIDATES}) ORDER BY place LIMIT {_RULES.last_limit}),
greedy AS (SELECT 0::BIGINT AS place, []::STRUCT(id VARCHAR, contig VARCHAR, s BIGINT, e BIGINT)[] AS chosen UNION ALL
SELECT c.place, CASE WHEN len(list_filter(g.chosen, lambda x: x.contig = c.contig)) < {_RULES.per_contig} AND len(list_filter(g.chosen, lambda x: x.contig = c.contig AND x.s < c."end" AND x.e > c.start)) = 0
THEN list_append(g.chosen, {{'id': c.candidate_id, 'contig': c.contig, 's': c.start, 'e': c."end"}}) ELSE g.chosen END FROM greedy g JOIN chosen_from c ON c.place = g.place + 1 WHERE len(g.chosen) < {_RULES.per_context}),
ended AS (SELECT unnest(chosen) AS w, generate_subscripts(chosen, 1) AS n FROM greedy WHERE place = (SELECT max(place) FROM greedy))
SELECT w.id AS candidate_id, w.contig AS contig, w.s AS start, w.e AS "end", n::INT AS selection_rank, row_number() OVER (PARTITION BY w.contig ORDER BY n)::INT AS chromosome_selection_rank FROM ended"""


@query(_GREEDY)
def greedy_selection(r: Roles) -> DataFrame:
    """Windows chosen one after the other; the SQL twin walks the ordered candidates by recursion."""
    chosen, _ = selection.select_context(_candidates(r).select("candidate_id", "selection_hash", "contig", "start", "end"), [], _RULES)
    rows = [(c["candidate_id"], c["contig"], c["start"], c["end"], c["selection_rank"], c["chromosome_selection_rank"]) for c in chosen]
    return r.spark.createDataFrame(rows, "candidate_id string, contig string, start long, end long, selection_rank int, chromosome_selection_rank int")


@query()
def greedy_evaluation(r: Roles) -> DataFrame:
    """How many candidates were looked at until the choice was full, by decision and reason; tests hold it against plain loops."""
    _, seen = selection.select_context(_candidates(r).select("candidate_id", "selection_hash", "contig", "start", "end"), [], _RULES)
    rows = r.spark.createDataFrame([(c["evaluation_rank"], c["decision"], c["rejection_reason"]) for c in seen], "evaluation_rank int, decision string, rejection_reason string")
    return rows.groupBy("decision", "rejection_reason").agg(F.count(F.lit(1)).alias("n"), F.max("evaluation_rank").alias("last_rank"))


@query("""SELECT w.id, coalesce(string_agg(c.side::VARCHAR, ';' ORDER BY c.side), '') AS memberships FROM intervals w LEFT JOIN (SELECT DISTINCT w.id AS w_id, m.side FROM intervals w JOIN """ + _MERGED.format(", side", "") + """ m ON m.contig = w.contig AND m.start < w."end" AND m."end" > w.start) c ON c.w_id = w.id GROUP BY w.id""")
def context_membership(r: Roles) -> DataFrame:
    """Memberships of all windows."""
    contexts = r.intervals.select(F.col("side").cast("string").alias("context_id"), "contig", "start", "end")
    return selection.context_membership(r.intervals.select("id", "contig", "start", "end"), contexts, ["0", "1"], key="id").select("id", "memberships")


# ---- text, lists, policy --------------------------------------------------------------------


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[\\s_-]+', ' ', 'g')) AS alias_key, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS token, CASE WHEN p_brand IN ('TP', 'FP', 'FN', 'N', 'UNK', 'IGN') THEN p_brand ELSE 'OTHER' END AS decision FROM part", plain=True)
def alias_normalization(r: Roles) -> DataFrame:
    return r.raw("part").select("p_partkey", text.alias_key(F.col("p_type")).alias("alias_key"), text.id_token(F.col("p_name")).alias("token"), text.decision(F.col("p_brand")).alias("decision"))


@query("SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE 'ftp://' || url END AS uri, left(sha256(url), 16) AS token FROM pages", plain=True)
def uri_tokens(r: Roles) -> DataFrame:
    return r.raw("pages").select("page_id", text.with_scheme(F.col("url")).alias("uri"), canonical.artifact_token(F.col("url")).alias("token"))


@query("SELECT o_orderkey, part_index::INT AS part_index, part FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS part_index FROM orders)", plain=True)
def list_explode(r: Roles) -> DataFrame:
    return r.raw("orders").select("o_orderkey", F.posexplode(F.split("o_orderpriority", "-")).alias("i", "part")).select("o_orderkey", (F.col("i") + 1).alias("part_index"), "part")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, (json_keys(props::JSON) = ['k']) AS exact_keys FROM events", plain=True)
def json_payload(r: Roles) -> DataFrame:
    return r.raw("events").select("event_id", text.json_value(F.col("props"), "k").cast("long").alias("k"), text.json_has_exactly(F.col("props"), ["k"]).alias("exact_keys"))


_POLICY = {"initial_state": "view", "transitions": {"view": ["click", "view", "cart"], "click": ["view", "purchase", "click"], "cart": ["purchase", "view"], "purchase": ["view"], "signup": ["view"], "logout": []}}
_ALLOWED = " OR ".join(f"(p = '{a}' AND event_type IN ({', '.join(repr(x) for x in b)}))" for a, b in _POLICY["transitions"].items() if b)


@query(f"""SELECT user_id, ordinal, violation FROM (SELECT user_id, ordinal, unnest([CASE WHEN ordinal = 0 AND event_type <> 'view' THEN 'BAD_START' END, CASE WHEN ordinal > 0 AND NOT ({_ALLOWED}) THEN 'FORBIDDEN_TRANSITION' END]) AS violation FROM
(SELECT user_id, event_type, lag(event_type) OVER w AS p, (row_number() OVER w - 1)::INT AS ordinal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE violation IS NOT NULL""", plain=True)
def history_violations(r: Roles) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = r.raw("events").select("user_id", (F.row_number().over(order) - 1).alias("ordinal"), F.lag("event_type").over(order).alias("from_state"), F.col("event_type").alias("to_state"), F.col("ts").cast("string").alias("at"))
    steps = steps.withColumns({c: F.lit(None).cast("string") for c in ("actor_type", "assessment_id", "release_version")})
    return policy.history_violations(_POLICY, steps, "user_id")


@query("SELECT p AS from_state, event_type AS to_state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY ALL", plain=True)
def transition_matrix(r: Roles) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = r.raw("events").select(F.lag("event_type").over(order).alias("from_state"), F.col("event_type").alias("to_state"))
    return steps.filter("from_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


_CRITERIA = {"criteria": [{"id": "E1", "hard": True, "applicability": "ALWAYS"}, {"id": "E2", "hard": True, "applicability": "CONDITIONAL"}, {"id": "E3", "hard": False, "applicability": "ALWAYS"}], "decision_values": ["PASS", "FAIL", "UNKNOWN", "NOT_APPLICABLE"]}


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'INELIGIBLE' WHEN toxic = 1 THEN 'NEEDS_REVIEW' ELSE 'ELIGIBLE' END AS outcome, 0 AS n_errors FROM labels", plain=True)
def eligibility_outcome(r: Roles) -> DataFrame:
    labels = r.raw("labels")
    row = lambda i, d: F.struct(F.lit(i).alias("criterion_id"), d.alias("decision"))
    decisions = labels.select("doc_id", F.explode(F.array(
        row("E1", F.when(F.col("quality") == 0, F.lit("FAIL")).otherwise(F.lit("PASS"))),
        row("E2", F.when(F.col("toxic") == 1, F.lit("UNKNOWN")).otherwise(F.lit("NOT_APPLICABLE"))),
        row("E3", F.lit("FAIL")),
    )).alias("d")).select("doc_id", "d.*")
    return policy.eligibility(_CRITERIA, decisions, "doc_id").select("doc_id", "outcome", F.size("errors").alias("n_errors"))


@query("SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount * 10 >= 0.95 THEN 'ACCEPT_NON_GATE' WHEN l_discount * 10 >= 0.7 THEN 'REVIEW' ELSE 'ABSTAIN' END AS route FROM lineitem WHERE l_discount * 10 <= 1", plain=True)
def ml_gate(r: Roles) -> DataFrame:
    c = F.col("l_discount") * 10
    route = policy.ml_gate({"active": True, "provisional_values": {"accept_threshold": 0.95, "review_threshold": 0.7}}, c)
    return r.raw("lineitem").filter(c <= 1).select("l_orderkey", "l_linenumber", "l_discount", route.alias("route"))


@query("""SELECT p_partkey, CASE WHEN b <= a THEN 'NOT_ADVANCING' WHEN a[1] <> b[1] AND b[2] = 0 AND b[3] = 0 THEN 'MAJOR' WHEN a[1] <> b[1] THEN 'MAJOR_MUST_RESET' WHEN a[2] <> b[2] AND b[3] = 0 THEN 'MINOR' WHEN a[2] <> b[2] THEN 'MINOR_MUST_RESET' ELSE 'PATCH' END AS kind
FROM (SELECT p_partkey, [1, p_size % 3, p_partkey % 2] AS a, [1 + p_partkey % 2, p_size % 4, p_partkey % 5] AS b FROM part)""", plain=True)
def release_kind(r: Roles) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    dotted = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    return r.raw("part").select("p_partkey", text.release_kind(dotted(F.lit(1), s % 3, k % 2), dotted(1 + k % 2, s % 4, k % 5)).alias("kind"))


@query("SELECT s_suppkey, (s_acctbal > 0 AND s_nationkey < 20) AS eligible, concat_ws(';', CASE WHEN s_acctbal <= 0 THEN 'balance' END, CASE WHEN s_nationkey >= 20 THEN 'nation' END) AS reasons FROM supplier", plain=True)
def source_admission(r: Roles) -> DataFrame:
    eligible, reasons = policy.admission({"balance": F.col("s_acctbal") > 0, "nation": F.col("s_nationkey") < 20})
    return r.raw("supplier").select("s_suppkey", eligible, reasons).withColumn("reasons", F.array_join("reasons", ";"))


@query("""SELECT gate, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS n_violations FROM (SELECT 'EVENT_HAS_OBSERVATIONS' AS gate, count(*) AS n FROM registry_events WHERE event_id NOT IN (SELECT event_id FROM items)
UNION ALL SELECT 'EVENT_RUN_EXISTS', count(*) FROM registry_events WHERE benchmark_run_id NOT IN (SELECT benchmark_run_id FROM runs) UNION ALL SELECT 'OBSERVATION_ID_UNIQUE', count(*) FROM (SELECT observation_id FROM items GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'QUANTITY_POSITIVE', count(*) FROM items WHERE quantity <= 0)""")
def quality_gates(r: Roles) -> DataFrame:
    events, items = r.registry_events, r.items
    found = gates.together([
        gates.violation(sets.missing(events, items, "event_id"), "EVENT_HAS_OBSERVATIONS", "event_id"),
        gates.violation(sets.missing(events, r.runs, "benchmark_run_id"), "EVENT_RUN_EXISTS", "event_id"),
        gates.violation(items.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "OBSERVATION_ID_UNIQUE", "observation_id"),
        gates.violation(items, "QUANTITY_POSITIVE", "observation_id", F.col("quantity") <= 0),
    ])
    return gates.gates(r.spark, ["EVENT_HAS_OBSERVATIONS", "EVENT_RUN_EXISTS", "OBSERVATION_ID_UNIQUE", "QUANTITY_POSITIVE"], found)
