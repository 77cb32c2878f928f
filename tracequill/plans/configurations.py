"""Registered queries over configurations: the driver's tables play their lists, and their values break the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.operators import configuration
from tracequill.plans.registered import query
from tracequill.plans.roles import Roles

_TAXONOMY = """WITH families AS (SELECT r_regionkey::VARCHAR AS id, r_name AS label FROM region WHERE r_name <> 'ASIA'), vendors AS (SELECT n_nationkey::VARCHAR AS id, n_name AS label FROM nation WHERE n_regionkey < 4),
instruments AS (SELECT s_suppkey::VARCHAR AS id, s_name AS label, s_nationkey::VARCHAR AS vendor, (CASE WHEN s_acctbal < 0 THEN 0 ELSE n_regionkey END)::VARCHAR AS technology, [s_name, 'Made in ' || n_name] AS aliases FROM supplier JOIN nation ON s_nationkey = n_nationkey),
models AS (SELECT p_partkey::VARCHAR AS id, p_name AS label, (p_size * 3)::VARCHAR AS family, [p_brand] AS aliases FROM part),
chemistries AS (SELECT c_custkey::VARCHAR AS id, c_nationkey::VARCHAR AS vendor, (CASE WHEN c_acctbal < 0 THEN 1 ELSE n_regionkey END)::VARCHAR AS technology FROM customer JOIN nation ON c_nationkey = n_nationkey),
modes AS (SELECT n_name AS id, [n_regionkey::VARCHAR, n_nationkey::VARCHAR] AS technologies FROM nation), terms AS (SELECT left(n_name, 8) AS term, n_nationkey::VARCHAR AS vendor, CASE WHEN n_nationkey < 12 THEN n_regionkey::VARCHAR END AS technology FROM nation),
tokens AS (SELECT lower(id) AS token FROM families UNION SELECT lower(label) FROM families), pairs AS (SELECT DISTINCT vendor, technology FROM instruments), of_vendor AS (SELECT vendor AS of, count(*) AS n FROM pairs GROUP BY 1),
claims AS (SELECT DISTINCT lower(alias) AS alias, place, owner FROM (SELECT label AS alias, 1 AS place, id AS owner FROM models UNION ALL SELECT unnest(aliases), 1, id FROM models UNION ALL SELECT unnest(aliases), 2, id FROM instruments)),
seen AS (SELECT t.*, coalesce(n, 0) AS n, p.technology AS has FROM terms t LEFT JOIN of_vendor ON of = t.vendor LEFT JOIN pairs p ON p.vendor = t.vendor AND p.technology = t.technology)
"""


@query(_TAXONOMY + """SELECT 'LEVEL_CONFLATED' AS rule, 'vendors|' || id AS key FROM vendors WHERE lower(id) IN (SELECT token FROM tokens) OR lower(label) IN (SELECT token FROM tokens)
UNION ALL SELECT 'LEVEL_CONFLATED', 'instrument_families|' || id FROM instruments WHERE lower(id) IN (SELECT token FROM tokens) OR lower(label) IN (SELECT token FROM tokens) UNION ALL SELECT 'LEVEL_CONFLATED', 'instrument_models|' || id FROM models WHERE lower(id) IN (SELECT token FROM tokens) OR lower(label) IN (SELECT token FROM tokens)
UNION ALL SELECT 'INSTRUMENT_VENDOR_UNKNOWN', id FROM instruments WHERE vendor NOT IN (SELECT id FROM vendors) UNION ALL SELECT 'INSTRUMENT_TECHNOLOGY_UNKNOWN', id FROM instruments WHERE technology NOT IN (SELECT id FROM families) UNION ALL SELECT 'MODEL_FAMILY_UNKNOWN', id FROM models WHERE family NOT IN (SELECT id FROM instruments)
UNION ALL SELECT 'ALIAS_CLAIMED_TWICE', alias || '|' || CASE place WHEN 1 THEN 'model' ELSE 'family' END || '|' || owner FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY place, owner) AS n FROM claims) WHERE n > 1
UNION ALL SELECT 'PAIR_WITHOUT_INSTRUMENT', 'chemistries|' || id FROM chemistries c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.vendor = c.vendor AND p.technology = c.technology)
UNION ALL SELECT 'READ_MODE_TECHNOLOGY_UNKNOWN', id || '|' || f FROM (SELECT id, unnest(technologies) AS f FROM modes) WHERE f NOT IN (SELECT id FROM families) UNION ALL SELECT 'TERM_VENDOR_UNKNOWN', term FROM terms WHERE vendor NOT IN (SELECT id FROM vendors)
UNION ALL SELECT 'TERM_NULL_BUT_UNAMBIGUOUS', term FROM seen WHERE technology IS NULL AND n < 2 UNION ALL SELECT 'TERM_TECHNOLOGY_OF_NO_INSTRUMENT', term FROM seen WHERE technology IS NOT NULL AND has IS NULL
UNION ALL SELECT 'TERM_NAMES_ONE_OF_SEVERAL', term FROM seen WHERE has IS NOT NULL AND n > 1 UNION ALL SELECT 'DUPLICATE_TERM', term FROM terms GROUP BY term HAVING count(*) > 1""", plain=True)
def taxonomy_integrity(r: Roles) -> DataFrame:
    c, text = F.col, lambda n: F.col(n).cast("string")
    nations = r.raw("nation").select(c("n_nationkey").alias("k"), "n_name", "n_regionkey")
    suppliers, customers = r.raw("supplier").join(nations, c("s_nationkey") == c("k")), r.raw("customer").join(nations, c("c_nationkey") == c("k"))
    technology = lambda balance, other: F.when(c(balance) < 0, other).otherwise(c("n_regionkey")).cast("string").alias("technology_family_id")
    return configuration.taxonomy_errors({
        "technology_families": r.raw("region").filter("r_name <> 'ASIA'").select(text("r_regionkey").alias("id"), c("r_name").alias("label")), "vendors": r.raw("nation").filter("n_regionkey < 4").select(text("n_nationkey").alias("id"), c("n_name").alias("label")),
        "instrument_families": suppliers.select(text("s_suppkey").alias("id"), c("s_name").alias("label"), text("s_nationkey").alias("vendor_id"), technology("s_acctbal", 0), F.array("s_name", F.concat(F.lit("Made in "), "n_name")).alias("family_level_aliases")),
        "instrument_models": r.raw("part").select(text("p_partkey").alias("id"), c("p_name").alias("label"), (c("p_size") * 3).cast("string").alias("instrument_family_id"), F.array("p_brand").alias("source_aliases")),
        "chemistries": customers.select(text("c_custkey").alias("id"), text("c_nationkey").alias("vendor_id"), technology("c_acctbal", 1)), "read_modes": r.raw("nation").select(c("n_name").alias("id"), F.array(text("n_regionkey"), text("n_nationkey")).alias("technology_family_ids")),
        "platform_terms": r.raw("nation").select(F.left("n_name", F.lit(8)).alias("term"), text("n_nationkey").alias("vendor_id"), F.when(c("n_nationkey") < 12, text("n_regionkey")).alias("technology_family_id")),
    })


_ORGANISMS = """WITH organisms AS (SELECT n_nationkey AS taxon, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'strain' ELSE 'species' END AS rank, CASE WHEN n_nationkey >= 20 THEN n_nationkey + 1 END AS parent FROM nation),
assemblies AS (SELECT CASE WHEN s_suppkey < 3 THEN 'nation_' || s_suppkey ELSE s_name END AS id, s_name, s_nationkey + CASE WHEN s_acctbal < 0 THEN 100 ELSE 0 END AS taxon, 'GCA_' || lpad((s_suppkey // 2)::VARCHAR, 9, '0') || '.1' AS insdc, CASE WHEN s_nationkey <> 3 THEN 'GCF_' || lpad(s_suppkey::VARCHAR, 9, '0') || '.1' END AS refseq,
  CASE WHEN s_nationkey < 20 THEN 'UC' || s_nationkey END AS ucsc, CASE WHEN s_acctbal > 9000 THEN 'suppressed' ELSE 'current' END AS status, s_acctbal, s_suppkey, s_nationkey FROM supplier),
sets AS (SELECT p_partkey::VARCHAR AS id, 'Supplier#' || lpad((p_size * 3)::VARCHAR, 9, '0') AS assembly FROM part)
"""


def _organisms(r: Roles) -> dict[str, DataFrame]:
    c = F.col
    key = lambda n: F.lpad(n.cast("string"), 9, "0")
    return {
        "organisms": r.raw("nation").select(c("n_nationkey").alias("taxonomy_id"), c("n_name").alias("scientific_name"), F.when(c("n_regionkey") == 0, "strain").otherwise("species").alias("rank"), F.when(c("n_nationkey") >= 20, c("n_nationkey") + 1).alias("parent_taxonomy_id")),
        "assemblies": r.raw("supplier").select(
            F.when(c("s_suppkey") < 3, F.concat(F.lit("nation_"), c("s_suppkey").cast("string"))).otherwise(c("s_name")).alias("assembly_id"), (c("s_nationkey") + F.when(c("s_acctbal") < 0, 100).otherwise(0)).alias("taxonomy_id"), c("s_name").alias("assembly_name"),
            F.concat(F.lit("GCA_"), key(F.floor(c("s_suppkey") / 2)), F.lit(".1")).alias("insdc_accession"), F.when(c("s_nationkey") != 3, F.concat(F.lit("GCF_"), key(c("s_suppkey")), F.lit(".1"))).alias("refseq_accession"),
            F.when(c("s_nationkey") < 20, F.concat(F.lit("UC"), c("s_nationkey").cast("string"))).alias("ucsc_db"), F.when(c("s_acctbal") > 9000, "suppressed").otherwise("current").alias("insdc_status"), F.lit("current").alias("refseq_status"),
        ),
        "sequence_sets": r.raw("part").select(c("p_partkey").cast("string").alias("sequence_set_id"), F.concat(F.lit("Supplier#"), key(c("p_size") * 3)).alias("assembly_id")),
    }


@query(_ORGANISMS + """SELECT 'PARENT_UNREGISTERED' AS rule, taxon || '|' || parent AS key FROM organisms WHERE parent NOT IN (SELECT taxon FROM organisms) UNION ALL SELECT 'PARENT_MISSING', taxon::VARCHAR FROM organisms WHERE rank <> 'species' AND parent IS NULL
UNION ALL SELECT 'ACCESSION_REUSED', a FROM (SELECT unnest([insdc, refseq]) AS a FROM assemblies) WHERE a IS NOT NULL GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'UCSC_NAME_REUSED', lower(ucsc) FROM assemblies WHERE ucsc IS NOT NULL GROUP BY lower(ucsc) HAVING count(*) > 1
UNION ALL SELECT 'ASSEMBLY_ORGANISM_UNKNOWN', id FROM assemblies WHERE taxon NOT IN (SELECT taxon FROM organisms) UNION ALL SELECT 'ASSEMBLY_NAMED_AS_ORGANISM', id FROM assemblies WHERE lower(id) IN (SELECT lower(name) FROM organisms)
UNION ALL SELECT 'ACCESSION_CORES_DIFFER', id FROM assemblies WHERE substr(insdc, 5, 9) <> substr(refseq, 5, 9) UNION ALL SELECT 'ACCESSION_SUPPRESSED', id FROM assemblies WHERE status = 'suppressed' UNION ALL SELECT 'SEQUENCE_SET_ASSEMBLY_UNKNOWN', id FROM sets WHERE assembly NOT IN (SELECT id FROM assemblies)""", plain=True)
def organism_integrity(r: Roles) -> DataFrame:
    return configuration.organism_errors(_organisms(r))


@query(_ORGANISMS + """, found AS (SELECT o.*, n_regionkey AS region FROM organisms o JOIN nation ON n_nationkey = taxon), ok AS (SELECT * FROM found WHERE region <> 1), of_supplier AS (SELECT * FROM assemblies WHERE s_suppkey % 10 <> 4),
wanted AS (SELECT id, s_name, taxon, s_acctbal, s_nationkey, insdc AS accession, status FROM of_supplier UNION ALL SELECT id, s_name, taxon, s_acctbal, s_nationkey, refseq, 'current' FROM of_supplier WHERE refseq IS NOT NULL), checked AS (SELECT * FROM wanted WHERE NOT (accession LIKE 'GCF%' AND s_acctbal < 500))
SELECT 'ORGANISM_NOT_VERIFIED' AS rule, taxon::VARCHAR AS key FROM found WHERE region = 1 UNION ALL SELECT 'ORGANISM_SNAPSHOT_ALTERED', taxon::VARCHAR FROM ok WHERE taxon >= 15 UNION ALL SELECT 'ORGANISM_DIFFERS', taxon::VARCHAR FROM ok WHERE region IN (0, 3) UNION ALL SELECT 'PARENT_DIFFERS', taxon::VARCHAR FROM ok WHERE parent <> 23
UNION ALL SELECT 'ASSEMBLY_NOT_VERIFIED', id FROM assemblies WHERE s_suppkey % 10 = 4 UNION ALL SELECT 'ACCESSION_NOT_VERIFIED', id || '|' || accession FROM wanted WHERE accession LIKE 'GCF%' AND s_acctbal < 500 UNION ALL SELECT 'ACCESSION_SNAPSHOT_ALTERED', id || '|' || accession FROM checked WHERE s_nationkey >= 15
UNION ALL SELECT 'ACCESSION_DIFFERS', id || '|' || accession FROM checked WHERE taxon >= 100 UNION ALL SELECT 'ACCESSION_STATUS_DIFFERS', id || '|' || accession FROM checked WHERE status = 'suppressed' UNION ALL SELECT 'UCSC_NAME_NOT_VERIFIED', id FROM of_supplier WHERE ucsc IS NOT NULL AND s_acctbal > 5000""", plain=True)
def recorded_lookups(r: Roles) -> DataFrame:
    """Nested lookup records made of nations and suppliers, whose values the registry's and the files' differ from."""
    c, tables = F.col, _organisms(r)
    none = F.array().cast("array<string>")
    failed = lambda bad: F.when(bad, F.array(F.lit("failed"))).otherwise(none)
    file = lambda n: F.concat(F.lit("snapshot-"), n.cast("string"))
    nation = r.raw("nation")
    organisms = nation.select(
        c("n_nationkey").alias("taxonomy_id"), F.lit("VERIFIED").alias("verdict"), failed(c("n_regionkey") == 1).alias("failures"), file(c("n_nationkey")).alias("snapshot"), F.sha2("n_name", 256).alias("sha256"),
        F.struct(F.when(c("n_regionkey") == 3, F.upper(F.concat("n_name", F.lit("x")))).otherwise(c("n_name")).alias("name"), F.lit("Species").alias("rank"), F.lit(23).alias("parent")).alias("observed"),
    )
    own = tables["assemblies"].join(r.raw("supplier").select(c("s_name").alias("s"), "s_suppkey", "s_acctbal", "s_nationkey"), c("assembly_name") == c("s"))
    observed = F.struct(c("assembly_name").alias("name"), F.pmod(c("taxonomy_id"), F.lit(100)).alias("taxonomy_id"), F.lit("current").alias("status"))
    check = lambda accession, bad: F.struct(accession.alias("accession"), failed(bad).alias("failures"), file(c("s_nationkey")).alias("snapshot"), F.sha2(F.concat(F.lit("NATION_"), c("s_nationkey").cast("string")), 256).alias("sha256"), observed.alias("observed"))
    assemblies = own.select(
        "assembly_id", F.when(c("s_suppkey") % 10 == 4, "FAILED").otherwise("VERIFIED").alias("verdict"), F.array(check(c("insdc_accession"), F.lit(False)), check(c("refseq_accession"), c("s_acctbal") < 500)).alias("checks"),
        F.when(c("s_acctbal") <= 5000, F.struct(c("ucsc_db").alias("ucsc_db"), none.alias("failures"))).alias("ucsc"),
    )
    snapshots = nation.filter("n_nationkey < 15").select(file(c("n_nationkey")).alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return configuration.lookup_errors(tables | {"organism_lookups": organisms, "assembly_lookups": assemblies, "snapshots": snapshots})


@query("""WITH sources AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN s_nationkey + CASE WHEN s_acctbal > 9000 THEN 50 ELSE 0 END END AS own FROM supplier), members AS (SELECT DISTINCT n_nationkey AS g, (p_size * 4 + n_nationkey)::BIGINT AS member FROM nation JOIN part ON p_partkey % 25 = n_nationkey WHERE p_size > 20)
SELECT 'MEMBER_UNKNOWN' AS rule, g || '|' || member AS key FROM members WHERE member NOT IN (SELECT id FROM sources) UNION ALL SELECT 'MEMBER_POINTS_ELSEWHERE', g || '|' || member FROM members JOIN sources ON id = member WHERE own IS DISTINCT FROM g
UNION ALL SELECT 'GROUP_UNKNOWN', id || '|' || own FROM sources WHERE own NOT IN (SELECT n_nationkey FROM nation)""", plain=True)
def source_integrity(r: Roles) -> DataFrame:
    """Suppliers as sources in mirror groups of nations, whose members come from parts."""
    c = F.col
    group = F.when(c("s_acctbal") > 0, c("s_nationkey") + F.when(c("s_acctbal") > 9000, 50).otherwise(0))
    parts = r.raw("part").filter("p_size > 20").select(F.pmod("p_partkey", F.lit(25)).cast("int").alias("mirror_group_id"), "p_size")
    groups = parts.groupBy("mirror_group_id").agg(F.collect_set((c("p_size") * 4 + c("mirror_group_id")).cast("long")).alias("member_source_ids"))
    groups = r.raw("nation").select(c("n_nationkey").alias("mirror_group_id")).join(groups, "mirror_group_id", "left").withColumn("member_source_ids", F.coalesce("member_source_ids", F.array().cast("array<bigint>")))
    return configuration.source_errors({"sources": r.raw("supplier").select(c("s_suppkey").alias("source_id"), group.alias("mirror_group_id")), "mirror_groups": groups})


_NAMES = {"view": "CATALOGUED", "click": "ELIGIBLE", "signup": "VALIDATION_PENDING", "purchase": "VALIDATED", "error": "RELEASED"}
_NAMED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


@query(f"""WITH RECURSIVE told AS (SELECT user_id, {_NAMED} AS state, value, lag({_NAMED}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), edges AS (SELECT DISTINCT before AS f, state AS t FROM told WHERE before IS NOT NULL AND value > 480),
states AS (SELECT DISTINCT state FROM told WHERE state <> 'VALIDATED' UNION ALL SELECT r_name FROM region), layers AS (SELECT DISTINCT state FROM told UNION ALL SELECT DISTINCT state FROM told WHERE value > 499),
reached AS (SELECT 'CATALOGUED' AS state UNION SELECT t FROM reached JOIN edges ON f = state), entered AS (SELECT t AS state, string_agg(f, ',' ORDER BY f) AS has FROM edges GROUP BY 1), gone AS (SELECT f AS state, string_agg(t, ',' ORDER BY t) AS has FROM edges GROUP BY 1)
SELECT 'STATE_IN_TWO_LAYERS' AS rule, state AS key FROM layers GROUP BY state HAVING count(*) > 1 UNION ALL SELECT 'STATE_WITHOUT_LAYER', state FROM states WHERE state NOT IN (SELECT state FROM layers) UNION ALL SELECT DISTINCT 'LAYERED_STATE_UNDECLARED', state FROM layers WHERE state NOT IN (SELECT state FROM states)
UNION ALL SELECT 'STATE_WITHOUT_TRANSITIONS', state FROM states WHERE state NOT IN (SELECT f FROM edges) UNION ALL SELECT DISTINCT 'TRANSITIONS_OF_UNDECLARED', f FROM edges WHERE f NOT IN (SELECT state FROM states) UNION ALL SELECT 'TARGET_UNDECLARED', f || '|' || t FROM edges WHERE t NOT IN (SELECT state FROM states)
UNION ALL SELECT 'SELF_TRANSITION', f FROM edges WHERE f = t UNION ALL SELECT 'ENTERED_FROM', s || '|' || coalesce(has, '') FROM (SELECT 'RELEASED' AS s, 'VALIDATED' AS need UNION ALL SELECT 'VALIDATED', 'VALIDATION_PENDING') LEFT JOIN entered ON s = state WHERE has IS DISTINCT FROM need
UNION ALL SELECT 'ENTERED_FROM', state || '|' || has FROM entered WHERE state = 'VALIDATION_PENDING' AND len(list_filter(string_split(has, ','), lambda x: x NOT IN ('ELIGIBLE', 'VALIDATION_FAILED'))) > 0 UNION ALL SELECT 'LEFT_FOR', state || '|' || has FROM gone WHERE state = 'RELEASED' AND has <> 'WITHDRAWN'
UNION ALL SELECT 'STATE_UNREACHABLE', state FROM states WHERE state NOT IN (SELECT state FROM reached) UNION ALL SELECT 'DUPLICATE_CRITERION', 'E' || lpad(p_size::VARCHAR, 2, '0') FROM part GROUP BY p_size HAVING count(*) > 1 UNION ALL SELECT 'DERIVED_CRITERION_NOT_HARD', 'E13' WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 13 AND p_type = 'LARGE' AND p_brand = 'Brand#0')""", plain=True)
def lifecycle_integrity(r: Roles) -> DataFrame:
    """A policy whose transitions are those that users' events show."""
    from pyspark.sql import Window

    c, named = F.col, F.expr(_NAMED)
    told = r.raw("events").select("user_id", named.alias("state"), "value", F.lag(named).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    edges = told.filter("before is not null and value > 480").select(c("before").alias("from_state"), c("state").alias("to_state")).distinct()
    states = told.filter("state <> 'VALIDATED'").select("state").distinct().unionAll(r.raw("region").select("r_name"))
    layers = told.select("state").distinct().unionAll(told.filter("value > 499").select("state").distinct()).withColumn("layer", F.lit("layer"))
    criteria = r.raw("part").select(F.concat(F.lit("E"), F.lpad(c("p_size").cast("string"), 2, "0")).alias("id"), ((c("p_type") == "LARGE") & (c("p_brand") == "Brand#0")).alias("hard"))
    criteria = criteria.unionAll(r.raw("region").filter("r_regionkey = 0").select(F.concat(F.lit("R-"), "r_name"), F.lit(True)))
    methods = r.raw("region").select(c("r_name").alias("method"))
    return configuration.lifecycle_errors({"states": states, "layers": layers, "transitions": edges, "criteria": criteria, "accepted_methods": methods}, "CATALOGUED")


@query("""WITH counts AS (SELECT n_name AS model, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS review, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS accept, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') > count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS active FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
must AS (SELECT unnest(['hard_eligibility_gate', 'biological_truth', 'benchmark_truth', 'validation_outcome', 'release_inclusion', 'clinical_interpretation', 'technology_ranking', 'caller_ranking', 'trust_score']) AS d), prohibited AS (SELECT DISTINCT p_type AS d FROM part WHERE p_size > 45 AND p_brand = 'Brand#3' UNION SELECT d FROM must WHERE d LIKE '%truth')
SELECT 'REVIEW_NOT_BELOW_ACCEPT' AS rule, model AS key FROM counts WHERE review >= accept UNION ALL SELECT 'MODEL_WITHOUT_ACTIVE_THRESHOLDS', n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000) AND n_name NOT IN (SELECT model FROM counts WHERE active)
UNION ALL SELECT 'PROHIBITION_MISSING', d FROM must WHERE d NOT LIKE '%truth' UNION ALL SELECT 'TASK_PROHIBITED', p_type FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 10) WHERE p_type IN (SELECT d FROM prohibited)
UNION ALL SELECT 'METHOD_NOT_TO_BE_LEARNED', r_name FROM region WHERE r_regionkey > 2 UNION ALL SELECT 'LEARNED_METHOD_MISSING', 'ML_PROPOSED'""", plain=True)
def model_policy_integrity(r: Roles) -> DataFrame:
    c = F.col
    of = lambda segment: F.count_if(c("c_mktsegment") == segment)
    customers = r.raw("customer").join(r.raw("nation"), c("c_nationkey") == c("n_nationkey")).groupBy(c("n_name").alias("model"))
    thresholds = customers.agg(of("BUILDING").alias("review_threshold"), of("MACHINERY").alias("accept_threshold"), (of("FURNITURE") > of("HOUSEHOLD")).alias("active"))
    models = r.raw("supplier").filter("s_acctbal < 1000").select("s_nationkey").distinct().join(r.raw("nation"), c("s_nationkey") == c("n_nationkey")).select(c("n_name").alias("model"))
    truths = r.spark.createDataFrame([(p,) for p in configuration.PROHIBITED if p.endswith("truth")], "decision string")
    prohibited = r.raw("part").filter("p_size > 45 and p_brand = 'Brand#3'").select(c("p_type").alias("decision")).distinct().unionAll(truths)
    tasks = r.raw("part").filter("p_size < 10").select(c("p_type").alias("task")).distinct()
    methods = r.raw("region").select(c("r_name").alias("method"), (c("r_regionkey") > 2).alias("ml"))
    return configuration.model_policy_errors({"thresholds": thresholds, "models": models, "prohibited_decisions": prohibited, "allowed_tasks": tasks, "methods": methods})


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT s_nationkey AS f, c_nationkey AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 48 AND l_discount = 0.1 AND s_nationkey < c_nationkey),
reached AS (SELECT 0::INTEGER AS state UNION SELECT t FROM reached JOIN edges ON f = state) SELECT state::VARCHAR AS state FROM reached""", plain=True)
def reachable_nations(r: Roles) -> DataFrame:
    """Nations that goods of the first can get to, from customer to supplier of the same nation, step by step."""
    c = F.col
    rows = r.raw("lineitem").filter("l_quantity >= 48 and l_discount = 0.1").join(r.raw("supplier"), c("l_suppkey") == c("s_suppkey")).join(r.raw("orders"), c("l_orderkey") == c("o_orderkey")).join(r.raw("customer"), c("o_custkey") == c("c_custkey"))
    edges = rows.filter("s_nationkey < c_nationkey").select(c("s_nationkey").cast("string").alias("from_state"), c("c_nationkey").cast("string").alias("to_state"))
    return configuration.reachable(edges, r.raw("nation").filter("n_nationkey = 0").select(c("n_nationkey").cast("string").alias("state")))
