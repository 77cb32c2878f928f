"""Registered queries over rules: casts and texts, catalogs, identities, policies, freezing and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical, schemas, text
from tracequill.operators import catalog, criteria, evidence, explorer, freeze, gates, identity, intervals, policy, sets
from tracequill.plans.registered import query
from tracequill.plans.roles import Roles

# ---- casts and texts ------------------------------------------------------------------------


@query("""SELECT p_partkey, nullif(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, '') AS optional_brand, p_size::BIGINT AS size, CASE WHEN p_size > 10 THEN p_size::BIGINT END AS optional_size, p_size / 4.0::DOUBLE AS optional_quarter,
CASE WHEN p_size - 20 >= 0 THEN (p_size - 20)::BIGINT END AS not_negative, p_size % 2 = 0 AS even, p_size % 3 = 0 AS snv, p_size % 3 <> 0 AS indel FROM part""", plain=True)
def typed_casts(r: Roles) -> DataFrame:
    size = F.col("p_size").cast("string")
    alt = F.when(F.col("p_size") % 3 == 0, F.lit("T")).otherwise(F.lit("TG"))
    return r.raw("part").select(
        "p_partkey", text.optional(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit(""))).alias("optional_brand"), text.integer(size).alias("size"),
        text.optional_integer(F.when(F.col("p_size") > 10, size).otherwise(F.lit(""))).alias("optional_size"), text.optional_float((F.col("p_size") / 4.0).cast("string")).alias("optional_quarter"),
        text.non_negative((F.col("p_size") - 20).cast("string")).alias("not_negative"), text.boolean(F.when(F.col("p_size") % 2 == 0, F.lit(" True ")).otherwise(F.lit("FALSE"))).alias("even"),
        text.is_snv(F.lit("A"), alt).alias("snv"), text.is_indel(F.lit("A"), alt).alias("indel"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'ERR' || (1000000 + s_suppkey) END AS run, CASE WHEN s_nationkey >= 10 THEN 'SAMEA' || s_suppkey END AS biosample, 's' || s_nationkey || CASE WHEN s_nationkey <> s_suppkey THEN ';s' || s_suppkey ELSE '' END AS parts,
CASE WHEN s_nationkey % 2 = 0 THEN 'A1|c' || s_nationkey || '|' || s_suppkey || '|AC|T' END AS allele_key, CASE WHEN s_nationkey = 3 THEN 'UNKNOWN' ELSE s_suppkey || '/.' END AS value_text, s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN '|.' ELSE '/.' END AS genotype,
'a1|c' || s_nationkey || '|1|2|A|T' AS allele_text FROM supplier""", plain=True)
def accessions_and_alleles(r: Roles) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    raw = F.when(n < 10, F.concat(F.lit("ERR"), (k + 1_000_000).cast("string"))).otherwise(F.concat(F.lit("SAMEA"), k.cast("string")))
    contig = F.concat(F.lit("c"), n.cast("string"))
    alts = F.when(n % 2 == 0, F.array(F.lit("t"))).otherwise(F.array(F.lit("T"), F.lit("G")))
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    values = F.when(n != 3, F.array(k.cast("string"), F.lit(None).cast("string")))
    return r.raw("supplier").select(
        "s_suppkey", text.accession(raw, "run").alias("run"), text.accession(raw, "biosample").alias("biosample"), F.array_join(text.split_distinct(F.concat(s(n), F.lit(";;"), s(k)), F.lit(None).cast("string"), s(n)), ";").alias("parts"),
        text.allele_lookup_key(F.lit("A1"), contig, k, F.lit("ac"), alts).alias("allele_key"), text.value_text(values).alias("value_text"),
        text.genotype_text(F.array(k.cast("string"), F.lit(None).cast("string")), n % 2 == 0).alias("genotype"),
        identity.allele_text(F.lit(" a1 "), contig, F.lit(1), F.lit(2), F.lit("A"), F.lit("T ")).alias("allele_text"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'application/gzip' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'text/tab-separated-values' WHEN 3 THEN 'application/zip' WHEN 4 THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type,
CASE p_partkey % 6 WHEN 0 THEN 'application/gzip' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'text/tab-separated-values' WHEN 3 THEN 'application/zip' ELSE 'application/octet-stream' END AS first_type,
CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'SHORT_PAIRED_END' WHEN p_size % 2 = 1 AND p_size % 3 = 1 THEN 'LONG_SINGLE_MOLECULE' WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN 'SHORT_SINGLE_END' ELSE 'UNKNOWN' END AS read_type,
p_partkey % 2 = 0 AS sha, p_partkey % 2 = 1 AS md5, 'a b;' || p_brand AS listed FROM part""", plain=True)
def media_and_reads(r: Roles) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.get(F.array(*[F.lit(x) for x in (".vcf.gz", ".tbi", ".bed", ".zip", ".fasta", ".BED")]), (k % 6).cast("int"))
    name = F.concat(F.lit("a"), suffix)
    digest = F.when(k % 2 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.md5(k.cast("string").cast("binary")))
    layout = F.when(F.col("p_size") % 2 == 0, F.lit("PAIRED")).otherwise(F.lit("SINGLE"))
    technology = F.get(F.array(F.lit("short_read_sbs"), F.lit("nanopore"), F.lit("UNKNOWN")), F.col("p_size") % 3)
    listed = F.concat(F.lit("['a b', \""), "p_brand", F.lit("\"]"))
    return r.raw("part").select(
        "p_partkey", text.media_type(name).alias("media_type"), text.media_type(name, text.MEDIA_TYPES_1A).alias("first_type"), text.read_type(layout, technology).alias("read_type"),
        text.is_sha256(digest).alias("sha"), text.is_md5(digest).alias("md5"), F.array_join(text.list_literal(listed), ";").alias("listed"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events", plain=True)
def utc_texts(r: Roles) -> DataFrame:
    return r.raw("events").select("event_id", text.utc_text(F.col("ts").cast("timestamp")).alias("at"))


@query(r"""SELECT n_nationkey, replace(lower(trim(n_name)), '_', ' ') AS alias, sha256('{"a":"' || chr(92) || 'u000b' || chr(92) || 'u007f' || chr(92) || 'u00e4' || chr(92) || 'ud83d' || chr(92) || 'ude00","name":"' || n_name || '"}') AS odd_hash FROM nation""", plain=True)
def odd_characters(r: Roles) -> DataFrame:
    """White space of all kinds around an alias, control characters and characters beyond ASCII in an identity."""
    odd = canonical.canonical_json({"name": F.col("n_name"), "a": F.lit("\x0b\x7fä\U0001f600")})
    return r.raw("nation").select("n_nationkey", text.alias_key(F.concat(F.lit("\t\x0b "), "n_name", F.lit("\n "))).alias("alias"), F.sha2(odd, 256).alias("odd_hash"))


@query("""SELECT variant_id, 'candidate:sha256:' || sha256('{"benchmark_run_id_a":1,"benchmark_run_id_b":2,"candidate_basis":"' || kind || '","event_id_a":' || variant_id || ',"event_id_b":' || size || ',"identity_status":"CANDIDATE"}') AS candidate_id FROM variants""")
def candidate_ids(r: Roles) -> DataFrame:
    lit = lambda n: F.lit(n).cast("int")
    made = canonical.candidate_id("candidate", lit(1), F.col("variant_id"), lit(2), F.col("size"), F.col("kind"), F.lit("CANDIDATE"))
    return r.variants.select("variant_id", made.alias("candidate_id"))


@query("SELECT event_id, props AS object, (props::JSON ->> 'k')::BIGINT AS k FROM events", plain=True)
def json_objects(r: Roles) -> DataFrame:
    return r.raw("events").select("event_id", text.json_object(F.col("props")).alias("object"), text.json_value(text.json_object(F.col("props")), "k").cast("long").alias("k"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'chrX' WHEN s_nationkey = 1 THEN 'chrM' WHEN s_nationkey = 2 THEN 'chrUn' ELSE 'chr' || s_nationkey END AS contig, CASE WHEN s_nationkey = 0 THEN 23 WHEN s_nationkey = 1 THEN 25 WHEN s_nationkey = 2 THEN 1000 ELSE s_nationkey END AS sex_rank,
(s_nationkey < 3)::INT AS text_rank, CASE WHEN s_nationkey < 3 THEN 1000 ELSE s_nationkey END AS last_rank FROM supplier""", plain=True)
def karyotype_orders(r: Roles) -> DataFrame:
    n = F.col("s_nationkey")
    contig = F.when(n == 0, F.lit("chrX")).when(n == 1, F.lit("chrM")).when(n == 2, F.lit("chrUn")).otherwise(F.concat(F.lit("chr"), n.cast("string")))
    key = lambda v: text.karyotype_key(F.col("contig"), v)["rank"].cast("int")
    rows = r.raw("supplier").select("s_suppkey", contig.alias("contig"))
    return rows.select("s_suppkey", "contig", key("sex").alias("sex_rank"), key("text").alias("text_rank"), key("last").alias("last_rank"))


# ---- evidence and identity ------------------------------------------------------------------


def _renamed(df: DataFrame, names: str, prefix: str) -> DataFrame:
    """df with the columns of an evidence query that it hasn't as constants of their names."""
    wanted = {x.split(":")[0].split(".")[1] for x in names if x.startswith(f"{prefix}.")}
    return df.select("*", *[F.lit(w).alias(w) for w in sorted(wanted - set(df.columns))])


def _wide(r: Roles, names: list[str]) -> dict[str, DataFrame]:
    c = F.col
    tables = {
        "events": r.registry_events.select("event_id", "benchmark_run_id", c("event_status").alias("identity_scope")), "observations": r.observations.select("observation_id", "event_id", "benchmark_run_id", "side", "raw_decision", "source_record_ordinal"),
        "runs": r.runs, "experiments": r.experiments, "provenance": r.provenance, "artifacts": r.artifacts.select("source_artifact_id", c("artifact_name").alias("uri")), "variants": r.variants, "links": r.links,
    }
    return {k: _renamed(v, names, k) for k, v in tables.items()}


def _constants(names: list[str], given: dict[str, str]) -> str:
    """The columns of an evidence query in SQL: given expressions, else constants of their names."""
    pairs = [n.partition(":")[::2] for n in names]
    return ", ".join(f"{given.get(of, repr(of.split('.')[1]))} AS {name or of.split('.')[1]}" for of, name in pairs)


_GIVEN = {
    "events.event_id": "e.event_id", "events.identity_scope": "e.event_status", "observations.observation_id": "o.observation_id", "observations.side": "o.side", "observations.raw_decision": "o.raw_decision",
    "observations.source_record_ordinal": "o.source_record_ordinal", "runs.benchmark_run_id": "r.benchmark_run_id", "experiments.experiment_id": "x.experiment_id", "experiments.technology": "x.technology", "variants.variant_id": "v.variant_id",
    "variants.contig": "v.contig", "provenance.provenance_link_id": "p.provenance_link_id", "artifacts.source_artifact_id": "a.source_artifact_id", "artifacts.uri": "a.artifact_name",
}
_STAR = "registry_events e JOIN observations o ON o.event_id = e.event_id AND o.benchmark_run_id = e.benchmark_run_id JOIN runs r ON r.benchmark_run_id = e.benchmark_run_id JOIN experiments x ON x.experiment_id = r.experiment_id"


@query(f"SELECT {_constants(evidence.EVENT_EVIDENCE, _GIVEN)} FROM {_STAR} JOIN provenance p ON p.target_entity_id = o.observation_id JOIN artifacts a ON a.source_artifact_id = p.source_entity_id")
def event_evidence_44(r: Roles) -> DataFrame:
    t = _wide(r, evidence.EVENT_EVIDENCE)
    return evidence.event_evidence_columns(*[t[n] for n in ("events", "observations", "runs", "experiments", "provenance", "artifacts")])


@query(f"SELECT {_constants(evidence.VARIANT_EVIDENCE, _GIVEN)} FROM variants v JOIN links l ON l.variant_id = v.variant_id JOIN {_STAR.replace('registry_events e', 'registry_events e ON e.event_id = l.event_id', 1)} WHERE v.variant_id = (SELECT max(variant_id) FROM variants)")
def variant_evidence_51(r: Roles) -> DataFrame:
    t = _wide(r, evidence.VARIANT_EVIDENCE)
    last = r.variants.agg(F.max("variant_id")).first()[0]
    return evidence.variant_evidence_columns(*[t[n] for n in ("variants", "links", "events", "observations", "runs", "experiments")], variant_id=last)


@query("""SELECT variant_id, a_observation_id, b_observation_id, concat_ws(';', CASE WHEN a_quantity > 45 THEN 'A_EVENT_MISSING' WHEN a_source_artifact_id % 5 = 0 THEN 'A_RUN_DIFFERS' END, CASE WHEN b_quantity > 45 THEN 'B_EVENT_MISSING' WHEN b_source_artifact_id % 5 = 0 THEN 'B_RUN_DIFFERS' END) AS inconsistencies FROM
(SELECT a.variant_id, a.source_artifact_id AS a_source_artifact_id, b.source_artifact_id AS b_source_artifact_id, a.observation_id AS a_observation_id, b.observation_id AS b_observation_id, a.quantity AS a_quantity, b.quantity AS b_quantity FROM items a JOIN items b ON a.variant_id = b.variant_id AND a.source_artifact_id < b.source_artifact_id AND a.quantity = b.quantity)""")
def candidate_consistency(r: Roles) -> DataFrame:
    pairs = evidence.candidate_pairs(r.items, "variant_id", "source_artifact_id", "observation_id", same=("quantity",))
    run = F.when(F.pmod("source_artifact_id", F.lit(5)) == 0, F.lit(-1).cast("long")).otherwise(F.col("source_artifact_id"))
    events = r.items.filter("quantity <= 45").select("observation_id", run.alias("source_artifact_id"))
    # A row comes once for each event: items have unique observation ids but for repeated lines, which this keeps apart.
    found = evidence.candidate_events(pairs, events.dropDuplicates(["observation_id"]), "variant_id", "source_artifact_id", "observation_id")
    return found.select("variant_id", "a_observation_id", "b_observation_id", F.array_join("inconsistencies", ";").alias("inconsistencies"))


@query("""SELECT o_orderkey AS candidate_number, CASE WHEN o_orderkey % 7 = 0 THEN 'NOT_CLASSIFIED' WHEN o_orderkey % 5 = 0 THEN 'o_orderstatus' ELSE '' END AS mismatches FROM orders UNION ALL SELECT -1, 'NO_CANDIDATE'""", plain=True)
def classified_candidates(r: Roles) -> DataFrame:
    o = r.raw("orders").select(F.col("o_orderkey").cast("long").alias("candidate_number"), "o_orderstatus", "o_custkey")
    k = F.col("candidate_number")
    status = F.when(k % 5 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))
    other = o.filter(k % 7 != 0).select("candidate_number", status.alias("o_orderstatus"), F.lit("EXACT").alias("class"))
    other = other.unionAll(r.spark.createDataFrame([(-1, "F", "EXACT")], "candidate_number long, o_orderstatus string, class string"))
    return evidence.classified(o, other).select("candidate_number", F.array_join("mismatches", ";").alias("mismatches"))


@query("SELECT DISTINCT l.variant_id, l.event_id, e.sample || '-' || e.technology AS candidate_id FROM links l JOIN registry_events USING (event_id) JOIN runs USING (benchmark_run_id) JOIN experiments e USING (experiment_id) WHERE e.technology <> 'ASIA'")
def admitted_links(r: Roles) -> DataFrame:
    admitted = r.experiments.filter("technology <> 'ASIA'").select("sample", "technology", F.concat_ws("-", "sample", "technology").alias("candidate_id"))
    links = r.links.join(r.registry_events.select("event_id", "benchmark_run_id"), "event_id")
    return evidence.admitted_links(links, r.runs, r.experiments, admitted).select("variant_id", "event_id", "candidate_id")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'assembly must not be empty' WHEN 1 THEN 'REF must not be empty;start must be >= 0;end must be >= start' WHEN 2 THEN 'start and end must be integers' WHEN 3 THEN 'ALT must not be empty;end must be >= start' ELSE '' END AS errors FROM part""", plain=True)
def allele_validation(r: Roles) -> DataFrame:
    m = F.col("p_partkey") % 5
    ref, alt = F.when(m == 1, F.lit(" ")).otherwise(F.lit("A")), F.when(m == 3, F.lit(None).cast("string")).otherwise(F.lit("T"))
    start, end = F.when(m == 1, -1).when(m == 2, F.lit(None).cast("int")).when(m == 3, 9).otherwise(1), F.when(m == 1, -2).otherwise(2)
    errors = identity.allele_errors(F.when(m == 0, F.lit("")).otherwise(F.lit("A1")), F.lit("c"), start, end, ref, alt)
    return r.raw("part").select("p_partkey", F.array_join(errors, ";").alias("errors"))


@query("""SELECT observation_id, CASE WHEN quantity % 3 = 0 THEN concat_ws(':', benchmark_run_id, 'superlocus', side, quantity) ELSE concat_ws(':', benchmark_run_id, 'record', side, source_record_ordinal) END AS event,
CASE WHEN quantity % 3 = 0 THEN concat_ws(':', benchmark_run_id, 'superlocus', quantity) ELSE concat_ws(':', benchmark_run_id, 'record', source_record_ordinal) END AS event_1a FROM observations""")
def event_identities(r: Roles) -> DataFrame:
    other = F.when(F.col("quantity") % 3 == 0, F.col("quantity")).when(F.col("quantity") % 3 == 1, F.col("quantity") + 1)
    made = lambda with_contig: identity.event_identity(F.col("side"), F.col("source_record_ordinal"), F.col("quantity"), other, F.col("benchmark_run_id"), with_contig)
    return r.observations.select("observation_id", made(True).alias("event"), made(False).alias("event_1a"))


_ENDS = """(SELECT o.*, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS number FROM orders o)"""


@query(f"""SELECT kind, count(*) AS n, count(DISTINCT key) AS n_keys FROM (SELECT 'variant' AS kind, o_orderpriority || o_orderkey % 50 AS key FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL
UNION ALL SELECT 'link', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'link', (-o_orderkey - 1)::VARCHAR FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT 'account', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'EXACT_ENDS_DIFFER', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 4 = 1) GROUP BY kind""", plain=True)
def candidate_materialization(r: Roles) -> DataFrame:
    """Two endpoints for each exact candidate; exact ones whose ends differ are conflicts."""
    k = F.col("o_orderkey").cast("long")
    side = lambda p, event, run, alt: [event.alias(f"{p}event_id"), run.alias(f"{p}benchmark_run_id"), F.lit("A1").alias(f"{p}assembly"), F.col("o_orderpriority").alias(f"{p}contig"), (k % 50).alias(f"{p}start"), (k % 50 + 1).alias(f"{p}end"), F.lit("A").alias(f"{p}ref"), alt.alias(f"{p}alt")]
    status = F.when(k % 4 < 2, F.lit(identity.EXACT)).otherwise(F.lit(identity.UNRESOLVED))
    rows = r.raw("orders").select(k.alias("candidate_number"), status.alias("status"), *side("a_", k, F.lit("run-a"), F.lit("T")), *side("b_", -k - 1, F.lit("run-b"), F.when(k % 4 == 1, F.lit("G")).otherwise(F.lit("T"))))
    made = identity.materialize_candidates(rows)
    key = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
    all_rows = key(made.variants, "variant", "variant_id").unionAll(key(made.links, "link", "event_id")).unionAll(key(made.accounting, "account", "candidate_number")).unionAll(made.conflicts.select(F.col("conflict").alias("kind"), "key"))
    return all_rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


@query("""SELECT event_id, status, reason, n_observations, CASE WHEN reason = '' THEN 'NEW' ELSE 'NONE' END AS origin, CASE WHEN reason = '' THEN 3 ELSE 0 END AS n_edges FROM (SELECT event_id::VARCHAR AS event_id, coalesce(n, 0) AS n_observations, CASE WHEN n IS NULL THEN 'MISSING_OBSERVATIONS' WHEN event_status = 'P' THEN 'MISSING_EVENT_ASSEMBLY'
WHEN n_complete <> n THEN 'MISSING_NORMALIZED_ALLELE_FIELD' WHEN n_alleles <> 1 THEN 'MULTIPLE_NORMALIZED_ALLELES' ELSE '' END AS reason, CASE WHEN reason = '' THEN 'EXACT_NORMALIZED_ALLELE' ELSE 'UNRESOLVED' END AS status
FROM registry_events LEFT JOIN (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE quantity >= 3) AS n_complete, count(DISTINCT CASE WHEN quantity >= 3 THEN (source_record_ordinal, side, raw_decision) END) AS n_alleles FROM items GROUP BY 1) USING (event_id))""")
def identity_accounting(r: Roles) -> DataFrame:
    """Accounting of all events, and the provenance edges that their links give."""
    from tracequill.plans.registered import _identity_inputs

    events, observations = _identity_inputs(r)
    made = identity.materialize(events, observations, events.limit(0).select(F.col("event_id").alias("variant_id")))
    edges = made.provenance.join(made.links.select(F.col("event_variant_link_id").alias("source_id"), F.col("event_id").alias("l_event")), "source_id").groupBy("l_event").agg(F.count(F.lit(1)).cast("int").alias("n_edges"))
    rows = made.accounting.join(edges, F.col("event_id") == F.col("l_event"), "left")
    return rows.select("event_id", "status", "reason", "n_observations", "origin", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


_STATED = """(SELECT event_id, v, CASE WHEN event_id % 2 = 1 AND v IS NULL THEN 'NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY' WHEN event_id % 2 = 1 OR event_status = 'F' THEN 'EXACT_NORMALIZED_ALLELE' ELSE 'UNRESOLVED' END AS state
FROM registry_events LEFT JOIN (SELECT event_id, min(variant_id) AS v FROM items WHERE quantity > 25 GROUP BY 1) USING (event_id))"""


def _explorer(r: Roles) -> tuple[explorer.Model, DataFrame]:
    c = F.col
    links = r.observations.filter("quantity > 25").groupBy("event_id").agg(F.min("variant_id").alias("variant_id"), F.min("benchmark_run_id").alias("benchmark_run_id"))
    accounting = r.registry_events.select("event_id", F.when(c("event_status") == "F", F.lit(identity.EXACT)).otherwise(F.lit(identity.UNRESOLVED)).alias("status"), c("event_status").alias("reason"))
    events, odd = r.registry_events.select("event_id", "benchmark_run_id", "event_status"), F.pmod("event_id", F.lit(2)) == 1
    observations = r.items.withColumn("raw_variant_type", c("side"))
    provenance = r.provenance.withColumn("source_entity_id", c("source_entity_id").cast("string"))
    return explorer.build(events.filter(odd), events.filter(~odd), observations, links, accounting, r.runs, r.experiments, provenance), links


@query(f"""SELECT 'events:' || state AS name, count(*) AS n FROM {_STATED} GROUP BY state UNION ALL SELECT 'variants', count(DISTINCT v) FROM {_STATED} WHERE state = 'EXACT_NORMALIZED_ALLELE'
UNION ALL SELECT 'provenance_entities', count(*) FROM (SELECT DISTINCT source_entity_id::VARCHAR FROM provenance UNION ALL SELECT DISTINCT target_entity_id FROM provenance)""")
def explorer_manifest(r: Roles) -> DataFrame:
    return explorer.manifest(_explorer(r)[0])


@query(f"""SELECT s.event_id, s.state AS identity_state, 'link-' || s.event_id AS event_variant_link_id, sample, technology, benchmark_run_id FROM {_STATED} s JOIN registry_events USING (event_id) JOIN runs USING (benchmark_run_id) JOIN experiments USING (experiment_id) WHERE s.v = (SELECT min(variant_id) FROM items WHERE quantity > 25)""")
def explorer_example(r: Roles) -> DataFrame:
    model, links = _explorer(r)
    named = links.withColumn("event_variant_link_id", F.concat(F.lit("link-"), F.col("event_id").cast("string")))
    first = r.items.filter("quantity > 25").agg(F.min("variant_id")).first()[0]
    return explorer.example_rows(model, named, first).select("event_id", "identity_state", "event_variant_link_id", "sample", "technology", "benchmark_run_id")


# ---- intervals ------------------------------------------------------------------------------


@query("""SELECT id, 'chr' || (id % 25 + 1) AS contig FROM intervals WHERE id % 25 + 1 <= 22 AND id % 25 + 1 <> 20""")
def eligible_scope(r: Roles) -> DataFrame:
    rows = r.intervals.select("id", F.concat(F.lit("chr"), (F.pmod("id", F.lit(25)) + 1).cast("string")).alias("contig"))
    return intervals.autosomes(rows, without=["chr20"])


_CORE = """(SELECT user_id, min(start) AS start, max("end") AS "end" FROM (SELECT user_id, start, (start + 600) AS "end" FROM raw_intervals) GROUP BY 1)"""


@query(f"""SELECT r.id, CASE WHEN b.start >= 100000 AND b."end" <= 2000000 THEN 'CORE_EXPORTED' WHEN r.start >= 100000 AND r.start + 600 <= 2000000 THEN 'BOUNDARY_EVENT_DIAGNOSTIC' ELSE 'PADDING_OR_OUTSIDE_CORE_DIAGNOSTIC' END AS classification FROM raw_intervals r JOIN {_CORE} b USING (user_id)""")
def boundary_diagnostics(r: Roles) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1_704_067_200
    records = r.raw("events").select(F.col("event_id").alias("id"), "user_id", F.lit("c").alias("contig"), start.alias("start"), (start + 600).alias("end"))
    core = r.spark.createDataFrame([("c", 100_000, 1_000_000), ("c", 900_000, 2_000_000)], "contig string, start long, end long")
    return intervals.boundary_diagnostics(records, core, "id", "user_id").select("id", "classification")


# ---- catalog --------------------------------------------------------------------------------

_TAXONOMY = {
    "instrument_families": [{"id": "hiseq", "label": "HiSeq", "family_level_aliases": ["AUTOMOBILE"], "technology_family_id": "short_read_sbs", "vendor_id": "illumina"}],
    "instrument_models": [{"id": "hiseq_2500", "label": "HiSeq 2500", "source_aliases": ["BUILD-ING"], "instrument_family_id": "hiseq"}],
}


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'short_read_sbs' WHEN 'BUILDING' THEN 'nanopore' WHEN 'MACHINERY' THEN 'nanopore' ELSE 'UNKNOWN' END AS technology, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RULE_EXACT' WHEN 'BUILDING' THEN 'RULE_EXACT' WHEN 'MACHINERY' THEN 'RULE_EXACT' ELSE 'UNRESOLVED' END AS method,
CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'UNSPECIFIED' ELSE 'UNKNOWN' END AS model, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hiseq' ELSE 'UNKNOWN' END AS family FROM customer""", plain=True)
def technology_ladder(r: Roles) -> DataFrame:
    platform = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit(" Oxford_Nanopore ")).otherwise(F.lit("?"))
    rows = r.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("instrument_model"), platform.alias("instrument_platform"))
    out = catalog.with_technology(rows, catalog.vocabulary(r.spark, _TAXONOMY))
    return out.select("c_custkey", F.col("technology_family.value").alias("technology"), F.col("technology_family.method").alias("method"), F.col("instrument_model_value.value").alias("model"), F.col("instrument_family_value.value").alias("family"))


def _runs(r: Roles) -> DataFrame:
    k, m = F.col("c_custkey"), F.col("c_custkey") % 4
    run = F.when(k % 11 == 0, F.lit("bad")).otherwise(F.concat(F.lit("SRR"), (k + 1_000_000).cast("string")))
    samples = F.when(m == 0, F.lit("SAMN1;SAMN2")).when(m == 1, F.concat(F.lit("SAMN"), k.cast("string"))).when(m == 2, F.lit("")).otherwise(F.concat(F.lit("SRS"), k.cast("string")))
    url = F.concat(F.lit("h/"), k.cast("string"), F.lit("_1.fq;ftp://h/x"))
    return r.raw("customer").select(
        run.alias("run_accession"), samples.alias("sample_accession"), F.lit("").alias("secondary_sample_accession"), F.when(m < 2, F.lit("PRJNA7")).otherwise(F.lit("SRP000007")).alias("study_accession"), F.lit(None).cast("string").alias("secondary_study_accession"),
        F.lit("SRX1").alias("experiment_accession"), F.lit("Illumina").alias("instrument_platform"), F.lit("").alias("instrument_model"), F.lit("WGS").alias("library_strategy"), F.lit("").alias("library_source"), F.lit("RANDOM").alias("library_selection"), F.lit("PAIRED").alias("library_layout"),
        F.when(m == 3, F.lit("x")).otherwise(F.lit("9606")).alias("tax_id"), F.lit("Homo sapiens").alias("scientific_name"), url.alias("fastq_ftp"), F.concat(F.md5(k.cast("string").cast("binary")), F.lit(";?")).alias("fastq_md5"), F.lit("5;-1").alias("fastq_bytes"),
        F.lit("ftp://h/x;s3://y").alias("submitted_ftp"), F.lit("").alias("submitted_md5"), F.lit("").alias("submitted_bytes"),
    )


_GATES = "'assembly_id,' || 'instrument_family_id,library_source' || CASE WHEN c_custkey % 4 IN (0, 2) THEN ',sample_id' ELSE '' END"


@query(f"""SELECT 'run:srr' || (c_custkey + 1000000) AS run_id, CASE c_custkey % 4 WHEN 1 THEN 'sample:samn' || c_custkey WHEN 3 THEN 'sample:srs' || c_custkey ELSE 'sample:unknown:srr' || (c_custkey + 1000000) END AS sample_id, CASE WHEN c_custkey % 4 < 2 THEN 'study:prjna7' ELSE 'study:srp000007' END AS study_id,
CASE c_custkey % 4 WHEN 0 THEN 'MULTIPLE_SOURCE_SAMPLES' WHEN 2 THEN 'UNKNOWN' ELSE 'ONE_SOURCE_SAMPLE' END AS samples, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n_relationships, CASE WHEN c_custkey % 4 = 3 THEN 'UNKNOWN' ELSE '9606' END AS tax_id, {_GATES} AS gates, 'PARTIAL' AS state, 'SHORT_PAIRED_END' AS read_type,
'ftp://h/' || c_custkey || '_1.fq ftp://h/x s3://y' AS uris, 5 AS first_bytes, CASE WHEN c_custkey % 4 < 2 THEN 'PRJNA7' END AS bioproject FROM customer WHERE c_custkey % 11 <> 0""", plain=True)
def record_bundles(r: Roles) -> DataFrame:
    b = catalog.bundles(_runs(r), catalog.vocabulary(r.spark, _TAXONOMY), "f" * 64)
    return b.select(
        "run_id", "sample_id", "study_id", F.col("source_sample_cardinality.normalization_status").alias("samples"), F.size("source_sample_relationships").alias("n_relationships"), F.col("taxonomy.normalized_ncbi_taxonomy_id.value").alias("tax_id"),
        F.array_join("unresolved_hard_gate_fields", ",").alias("gates"), F.col("normalization_state").alias("state"), "read_type", F.array_join(F.transform("derived_artifacts", lambda a: a["uri"]), " ").alias("uris"),
        F.get(F.col("derived_artifacts"), F.lit(0))["size_bytes"].cast("int").alias("first_bytes"), F.col("accessions.bioproject_accession").alias("bioproject"),
    )


@query("SELECT 'instrument_model_value' AS field, count(*) AS n_unresolved FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'library_source_value', count(*) FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'library_layout_value', 0 UNION ALL SELECT 'rejected', count(*) FROM customer WHERE c_custkey % 11 = 0", plain=True)
def catalog_summary(r: Roles) -> DataFrame:
    runs = catalog.normalize_runs(_runs(r), catalog.vocabulary(r.spark, _TAXONOMY), "f" * 64)
    rows = catalog.unresolved_fields(runs, ["instrument_model_value", "library_source_value", "library_layout_value"])
    return rows.unionAll(catalog.rejected_runs(_runs(r)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected"), "n"))


@query("SELECT n_regionkey, n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3", plain=True)
def bounded_pages(r: Roles) -> DataFrame:
    return sets.pages(r.raw("nation").select("n_regionkey", "n_nationkey"), "n_regionkey", 3, 5, "n_nationkey")


# ---- policies -------------------------------------------------------------------------------

_POLICY = {
    "policy_version": "1", "initial_state": "F", "layers": [{"layer_id": "CATALOG", "states": ["F", "O"]}, {"layer_id": "RELEASE", "states": ["P"]}], "transitions": {"F": ["O"], "O": ["P"], "P": []},
    "criteria": [{"id": "E1", "hard": True, "applicability": "ALWAYS"}, {"id": "E13", "hard": True, "applicability": "ALWAYS"}], "decision_values": ["PASS", "FAIL", "UNKNOWN"],
    "hard_gate_fields": ["assembly", "sample"], "hard_gate_accepted_methods": ["SOURCE", "CURATED"],
}


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'CATALOG' WHEN o_orderstatus = 'P' THEN 'RELEASE' END AS layer, o_orderpriority IN ('1-URGENT', '2-HIGH') AS allowed FROM orders", plain=True)
def layers_and_tasks(r: Roles) -> DataFrame:
    allowed = policy.task_allowed(["1-URGENT", "2-HIGH", "3-MEDIUM"], ["3-MEDIUM"], F.col("o_orderpriority"))
    return r.raw("orders").select("o_orderkey", policy.layer(_POLICY, F.col("o_orderstatus")).alias("layer"), allowed.alias("allowed"))


@query("SELECT * FROM (VALUES ('F', 'F;O;P'), ('O', 'O;P'), ('P', 'P')) t(state, reachable)", plain=True)
def reachable_states(r: Roles) -> DataFrame:
    rows = [(s, ";".join(sorted(policy.reachable(_POLICY, s)))) for s in "FOP"]
    return r.spark.createDataFrame(rows, "state string, reachable string")


@query("""SELECT o_custkey AS record_id, violation, count(*) AS n FROM (SELECT o_custkey, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'WRONG_LAYER' END, CASE WHEN o_orderkey % 5 = 0 THEN 'STATE_NOT_LAST' END, CASE WHEN o_orderkey % 7 = 0 THEN 'MEMBERSHIP_MISSING' END, CASE WHEN o_orderkey % 2 = 0 THEN 'SEEN_BEFORE_DISCOVERED' END]) AS violation FROM orders) WHERE violation IN ('WRONG_LAYER', 'STATE_NOT_LAST', 'MEMBERSHIP_MISSING', 'SEEN_BEFORE_DISCOVERED') GROUP BY ALL""", plain=True)
def record_violations(r: Roles) -> DataFrame:
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    step = lambda a, b, version=null: F.struct(a.cast("string").alias("from_state"), b.alias("to_state"), F.lit("2024").alias("at"), F.lit("RELEASE_BUILD").alias("actor_type"), null.alias("assessment_id"), version.alias("release_version"))
    last = F.when(k % 5 == 0, F.lit("O")).otherwise(F.lit("P"))
    history = F.array(step(null, F.lit("F")), step(F.lit("F"), F.lit("O")), step(F.lit("O"), F.lit("RELEASED"), F.lit("1.0.0")), step(F.lit("O"), last))
    rows = r.raw("orders").select(
        k.alias("id"), F.col("o_custkey").alias("record_id"), F.lit("P").alias("eligibility_state"), F.when(k % 3 == 0, F.lit("CATALOG")).otherwise(F.lit("RELEASE")).alias("layer"), history.alias("state_history"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1.0.0"))).alias("release_memberships"), F.lit("2024-02").alias("discovered_at"), F.when(k % 2 == 0, F.lit("2024-01")).otherwise(F.lit("2024-03")).alias("last_seen_at"),
    )
    found = policy.record_violations(_POLICY, rows.withColumn("record_id", F.struct("id", "record_id")))
    found = found.filter(F.col("violation").isin("WRONG_LAYER", "STATE_NOT_LAST", "MEMBERSHIP_MISSING", "SEEN_BEFORE_DISCOVERED"))
    return found.groupBy(F.col("record_id.record_id").alias("record_id"), "violation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'INELIGIBLE' WHEN toxic = 0 AND doc_id % 3 <> 0 THEN 'ELIGIBLE' ELSE 'NEEDS_REVIEW' END AS outcome, CASE WHEN toxic = 0 AND doc_id % 3 <> 0 THEN 'PASS' ELSE 'UNKNOWN' END AS gate FROM labels", plain=True)
def derived_eligibility(r: Roles) -> DataFrame:
    labels = r.raw("labels")
    decisions = labels.select("doc_id", F.lit("E1").alias("criterion_id"), F.when(F.col("quality") == 0, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("decision"))
    value = lambda f, v, m: F.struct(F.lit(f).alias("field"), v.alias("value"), m.alias("method"))
    fields = F.array(value("assembly", F.lit("A1"), F.when(F.col("toxic") == 0, F.lit("SOURCE")).otherwise(F.lit("ML"))), value("sample", F.when(F.col("doc_id") % 3 == 0, F.lit("UNKNOWN")).otherwise(F.lit("s")), F.lit("CURATED")))
    values = labels.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.*")
    gate = policy.derived_gate(_POLICY, values, "doc_id").select(F.col("doc_id").alias("g"), F.col("decision").alias("gate"))
    return policy.evaluate(_POLICY, decisions, values, "doc_id").join(gate, F.col("doc_id") == F.col("g")).select("doc_id", "outcome", "gate")


@query("""SELECT doc_id, violation FROM (SELECT doc_id, unnest([CASE WHEN doc_id % 11 = 0 THEN 'POLICY_VERSION' END, CASE WHEN doc_id % 13 = 0 THEN 'EVALUATED_TWICE' END, CASE WHEN doc_id % 7 = 0 THEN 'HARD_GATE_FIELDS' END, CASE WHEN doc_id % 5 = 0 THEN 'NO_CURATION_REF' END, CASE WHEN doc_id % 3 = 0 THEN 'NOT_BACKED' END,
CASE WHEN quality = 0 AND toxic = 1 THEN 'OUTCOME:INELIGIBLE' END]) AS violation FROM labels) WHERE violation IS NOT NULL""", plain=True)
def assessment_violations(r: Roles) -> DataFrame:
    k = F.col("doc_id")
    criterion = lambda i, d: F.struct(F.lit(i).alias("criterion_id"), d.alias("decision"))
    first = criterion("E1", F.when(F.col("quality") == 0, F.lit("FAIL")).otherwise(F.lit("PASS")))
    criteria = F.concat(F.array(first, criterion("E13", F.lit("PASS"))), F.when(k % 13 == 0, F.array(first)).otherwise(F.array().cast("array<struct<criterion_id:string,decision:string>>")))
    field = lambda f, m, c: F.struct(F.lit(f).alias("field"), F.lit("v").alias("value"), m.alias("method"), c.cast("string").alias("curation_ref"))
    fields = F.array(field("assembly", F.when(k % 3 == 0, F.lit("ML")).otherwise(F.lit("SOURCE")), F.lit(None)), field("sample", F.lit("CURATED"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("ref"))))
    fields = F.when(k % 7 == 0, F.concat(fields, F.array(field("other", F.lit("SOURCE"), F.lit(None))))).otherwise(fields)
    outcome = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("INELIGIBLE")).otherwise(F.lit("ELIGIBLE"))
    rows = r.raw("labels").select("doc_id", F.when(k % 11 == 0, F.lit("0")).otherwise(F.lit("1")).alias("policy_version"), criteria.alias("criteria"), fields.alias("hard_gate_fields"), outcome.alias("outcome"))
    return policy.assessment_violations(_POLICY, rows, "doc_id")


@query("""SELECT '1.' || (p_partkey + 1) || '.0' AS release_version, violation FROM (SELECT p_partkey, unnest([CASE WHEN p_size % 2 = 0 THEN 'WRONG_TAG' END, CASE WHEN p_size % 3 = 0 THEN 'GATES_NOT_PASSED' END, CASE WHEN p_size % 5 = 0 THEN 'WRONG_KIND:MINOR' END, CASE WHEN p_size % 7 = 0 THEN 'RECORD_TWICE' END, CASE WHEN p_size % 11 = 0 THEN 'PATH_TWICE' END]) AS violation FROM part) WHERE violation IS NOT NULL""", plain=True)
def release_violations(r: Roles) -> DataFrame:
    k, s = F.col("p_partkey") + 1, F.col("p_size")
    version = F.concat(F.lit("1."), k.cast("string"), F.lit(".0"))
    twice = lambda bad, name: F.when(bad, F.array(F.struct(F.lit("x").alias(name)), F.struct(F.lit("x").alias(name)))).otherwise(F.array(F.struct(F.lit("x").alias(name))))
    rows = r.raw("part").select(
        version.alias("release_version"), F.concat(F.when(s % 2 == 0, F.lit("r")).otherwise(F.lit("v")), version).alias("git_tag"), F.when(s % 3 == 0, 1).otherwise(2).alias("gates_passed"), F.lit(2).alias("gates_total"),
        F.concat(F.lit("1."), (k - 1).cast("string"), F.lit(".0")).alias("previous_release"), F.when(s % 5 == 0, F.lit("PATCH")).otherwise(F.lit("MINOR")).alias("release_kind"), twice(s % 7 == 0, "record_id").alias("records"), twice(s % 11 == 0, "path").alias("artifacts"),
    )
    return policy.release_violations(rows)


@query("SELECT 'd/' || s_suppkey AS path, CASE WHEN s_nationkey < 5 THEN 'MISSING' ELSE 'CHANGED' END AS violation FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT * FROM (VALUES ('status', 'STATUS'), ('locked_file_count', 'COUNT'), ('protocol', 'PROTOCOL')) t(path, violation)", plain=True)
def lock_verification(r: Roles) -> DataFrame:
    s = r.raw("supplier")
    path = F.concat(F.lit("d/"), F.col("s_suppkey").cast("string"))
    lock = s.select(F.concat(path, F.lit("_sha256")).alias("key"), F.sha2("s_name", 256).alias("value"))
    lock = lock.unionAll(r.spark.createDataFrame([("status", "OPEN"), ("locked_file_count", "0"), ("protocol", "d/0"), ("protocol_sha256", "x")], "key string, value string"))
    files = s.filter("s_nationkey >= 5").select(path.alias("path"), F.when(F.col("s_nationkey") < 10, F.lit("?")).otherwise(F.sha2("s_name", 256)).alias("sha256"))
    return policy.lock_violations(lock, files, "FROZEN")


@query("SELECT n_regionkey AS key, 'TWICE' AS what FROM nation GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT n_nationkey, 'NO_TARGET' FROM nation WHERE n_regionkey > 2", plain=True)
def configuration_integrity(r: Roles) -> DataFrame:
    n = r.raw("nation")
    twice = policy.duplicate_ids(n, "n_regionkey").select(F.col("n_regionkey").alias("key"), F.lit("TWICE").alias("what"))
    lost = policy.unresolved_references(n, "n_regionkey", r.raw("region").filter("r_regionkey <= 2"), "r_regionkey")
    return twice.unionAll(lost.select("n_nationkey", F.lit("NO_TARGET")))


# ---- freezing -------------------------------------------------------------------------------


@query("SELECT s_suppkey::VARCHAR AS candidate_id, s_name AS audit_by FROM supplier", plain=True)
def admitted_candidates(r: Roles) -> DataFrame:
    s = r.raw("supplier")
    audit = s.select(F.col("s_suppkey").cast("string").alias("candidate_id"), F.lit("ELIGIBLE").alias("status"), F.col("s_name").alias("by"))
    return freeze.admitted(s.select(F.col("s_suppkey").cast("string").alias("candidate_id")), audit).select("candidate_id", "audit_by")


@query("SELECT n_name AS context_id, CASE WHEN n_nationkey % 4 = 0 THEN 'MISSING' WHEN n_nationkey % 4 = 1 THEN 'CHANGED' ELSE 'VERIFIED' END AS status FROM nation WHERE n_regionkey = 1", plain=True)
def frozen_contexts(r: Roles) -> DataFrame:
    n = r.raw("nation")
    wanted = [x[0] for x in n.filter("n_regionkey = 1").select("n_name").collect()]
    path, digest = F.concat(F.lit("b/"), "n_name"), F.md5(F.col("n_name").cast("binary"))
    frozen = freeze.context_sets(n.select(F.col("n_name").alias("context_id"), path.alias("path")), n.select(path.alias("path"), digest.alias("md5")), wanted)
    seen = n.filter("n_nationkey % 4 <> 0").select(path.alias("path"), F.when(F.col("n_nationkey") % 4 == 1, F.lit("?")).otherwise(digest).alias("md5"))
    return freeze.observed_md5(frozen, seen)


@query("SELECT n_nationkey AS id, 'name' AS \"column\", n_name AS configured, n_name || '?' AS observed FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR, NULL FROM nation WHERE n_nationkey % 5 = 0", plain=True)
def lookup_verification(r: Roles) -> DataFrame:
    n = r.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    seen = n.select("id", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 5 != 0, F.col("region")).alias("region"))
    return freeze.lookup_mismatches(n, seen, "id", ["name", "region"])


@query("""SELECT s_name AS path, sha256(s_name) AS sha256, 'release-file:sha256:' || sha256('{"path":"' || s_name || '","release":"1.0.0","sha256":"' || sha256(s_name) || '"}') AS file_id FROM supplier""", plain=True)
def release_files(r: Roles) -> DataFrame:
    files = r.raw("supplier").select(F.col("s_name").alias("path"), F.sha2("s_name", 256).alias("sha256"), F.lit(1).cast("long").alias("size_bytes"))
    return freeze.release_manifest(files, "1.0.0").select("path", "sha256", "file_id")


@query("SELECT 'snap/' || n_nationkey AS snapshot_path FROM nation WHERE n_nationkey % 4 = 0", plain=True)
def snapshot_verification(r: Roles) -> DataFrame:
    n, path = r.raw("nation"), F.concat(F.lit("snap/"), F.col("n_nationkey").cast("string"))
    recorded = n.select(path.alias("snapshot_path"), F.sha2("n_name", 256).alias("snapshot_sha256"))
    files = n.filter("n_nationkey % 8 <> 0").select(path.alias("path"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("?")).otherwise(F.sha2("n_name", 256)).alias("sha256"))
    return freeze.snapshot_mismatches(recorded, files)


# ---- gates ----------------------------------------------------------------------------------

_KEYS = ("source", "run")


def _registry(r: Roles) -> criteria.Registry:
    """The driver's tables as a registry in which every kind of defect occurs."""
    c = F.col
    k = c("o_orderkey")
    o = r.raw("orders")
    events = o.select(
        k.alias("event_id"), F.when(k % 97 == 0, F.lit(-1)).otherwise(c("o_custkey")).cast("long").alias("benchmark_run_id"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("contig"), (k % 1000).cast("long").alias("start_0based"),
        (k % 1000 + c("o_custkey") % 3).cast("long").alias("end_0based"), (c("o_orderstatus") == "P").alias("cross_run_equivalence_asserted"),
    )
    origin = F.when(c("quantity") == 50, F.lit("ORIGINAL")).otherwise(F.lit("REGENERATED"))
    observations = r.items.join(o.select(k.alias("__e"), c("o_custkey").cast("long").alias("benchmark_run_id")), c("event_id") == c("__e")).select(
        "observation_id", "event_id", F.when(c("source_record_ordinal") == 7, F.lit(-2)).otherwise(c("benchmark_run_id")).cast("long").alias("benchmark_run_id"), "side", F.when(c("quantity") == 1, F.lit(None)).otherwise(c("raw_decision")).alias("raw_decision"),
        (c("source_record_ordinal") - 1).alias("source_record_ordinal"), origin.alias("observation_origin"), F.lit("A").alias("normalized_ref"), F.when(c("quantity") > 25, F.lit("T")).otherwise(F.lit("TG")).alias("normalized_alt"),
    )
    accounting = o.filter(k % 13 != 0).select(k.alias("event_id"), F.when(k % 2 == 0, F.lit(identity.EXACT)).when(k % 17 == 0, F.lit("?")).otherwise(F.lit(identity.UNRESOLVED)).alias("status"), F.when(k % 5 == 0, F.lit("v")).otherwise(F.lit("")).alias("variant_id"), (k % 3).alias("n_alleles"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("why")).alias("reason"))
    status = F.when(k % 19 == 0, F.lit("?")).otherwise(F.lit(identity.EXACT))
    provenance = F.when(k % 23 == 0, F.lit('{"source":"a"}')).otherwise(F.lit('{"run":"b","source":"a"}'))
    links = o.filter(k % 7 == 0).select(k.alias("event_id"), F.when(k % 11 == 0, F.lit(-3)).otherwise(c("o_custkey")).cast("long").alias("benchmark_run_id"), status.alias("identity_status"), provenance.alias("provenance"))
    links = links.unionAll(links.filter("event_id % 29 = 0"))
    p, s = c("p_partkey"), c("p_size").cast("long")
    made = canonical.variant_id("1.0.0", F.lit("A1"), c("p_brand"), p.cast("long"), p + s, F.lit("R"), c("p_type"))
    variants = r.raw("part").select(F.when(p % 10 == 0, F.lit("variant:sha256:0")).otherwise(made).alias("variant_id"), F.lit("A1").alias("assembly"), c("p_brand").alias("contig"), p.cast("long").alias("normalized_start_0based"), (p + s).alias("normalized_end_0based"), F.lit("R").alias("normalized_ref"), c("p_type").alias("normalized_alt"), "p_partkey")
    pairs = r.raw("part").select(p.cast("long").alias("candidate_number"), F.when(s % 5 == 0, F.lit("SAME")).otherwise(F.lit("CROSS_RUN_EQUIVALENCE_UNRESOLVED")).alias("status"))
    end = lambda n, alt: [F.lit("A1").alias(f"{n}assembly"), c("p_brand").alias(f"{n}contig"), s.alias(f"{n}start"), (s + 1).alias(f"{n}end"), F.lit("A").alias(f"{n}ref"), alt.alias(f"{n}alt")]
    classification = r.raw("part").filter(s % 7 != 0).select(p.cast("long").alias("candidate_number"), F.when(s % 2 == 0, F.lit(identity.EXACT)).otherwise(F.lit(identity.UNRESOLVED)).alias("status"), *end("a_", F.lit("T")), *end("b_", F.when(s % 6 == 0, F.lit("G")).otherwise(F.lit("T"))))
    n = c("n_nationkey")
    window = canonical.content_id("window", {"assembly": F.lit("A1"), "chromosome": c("n_name"), "nominal_start_0based": n.cast("long"), "nominal_end_0based": n.cast("long") + 5})
    windows = r.raw("nation").select(F.when(n % 6 == 0, F.lit("window:?")).otherwise(window).alias("candidate_id"), c("n_name").alias("contig"), n.cast("long").alias("start"), (n.cast("long") + 5).alias("end"), c("n_regionkey").cast("string").alias("context_id"))
    typed = o.select(k.cast("string").alias("event_id"), c("o_custkey").cast("string").alias("benchmark_run_id"), F.lit("A1").alias("assembly"), F.lit("c").alias("contig"), F.lit(0).cast("long").alias("start_0based"), F.lit(1).cast("long").alias("end_0based"), F.when(k % 31 == 0, F.lit("?")).otherwise(F.lit("SOURCE_RECORD_FALLBACK")).alias("identity_scope"))
    facts = [(i, "f", "a", "b" if at % 3 == 0 else "a") for rules in criteria.FAMILIES.values() for at, (i, rule) in enumerate(rules.items()) if rule == criteria.FACTS and at % 5 != 4]
    query = r.experiments.select("sample", "technology")
    again = r.raw("nation").join(r.raw("region"), c("n_regionkey") == c("r_regionkey")).select(F.when(n % 8 == 0, F.lit("?")).otherwise(c("n_name")).alias("sample"), c("r_name").alias("technology"))
    rows = r.spark.createDataFrame
    tables = {
        "events": events, "observations": observations, "runs": r.runs.select("benchmark_run_id", F.when(c("benchmark_run_id") % 41 == 0, F.lit(-4)).otherwise(c("experiment_id")).cast("long").alias("experiment_id"), F.lit("x").alias("region_set_sha256"), F.when(c("run_kind") == "BUILDING", F.lit("y")).otherwise(F.lit("x")).alias("locked_region_set_sha256")),
        "experiments": r.experiments, "provenance": r.provenance.filter("source_entity_id % 9 <> 0"), "artifacts": r.artifacts.filter("source_artifact_id % 8 <> 0").select("source_artifact_id", F.lit("DERIVED").alias("derivation_state"), F.when(c("source_artifact_id") % 3 != 0, F.lit("x")).alias("sha256")),
        "accounting": accounting, "links": links, "variants": variants, "known": variants.filter("p_partkey % 4 = 0").select("variant_id"), "candidates": pairs, "classification": classification, "windows": windows, "typed_events": typed,
        "states": o.select(k.alias("event_id"), (1 + k % 2).alias("phase"), F.when(k % 3 == 0, F.lit(identity.UNRESOLVED)).otherwise(F.lit("NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY")).alias("identity_state")),
        "annotated": observations.filter("event_id % 37 <> 0"), "regions": rows([("c0", 100, 500), ("c0", 500, 900), ("c1", 100, 900), ("c2", 100, 900), ("c3", 0, 9)], "contig string, start long, end long"),
        "facts": rows(facts, "rule string, name string, expected string, observed string"), "query": query, "query_again": again, "counts": rows([("events", 1, 1), ("links", 2, 3)], "table_name string, expected int, actual int"),
        "sources": r.raw("supplier").select(c("s_suppkey").alias("candidate_id"), F.when(c("s_nationkey") == 1, F.lit("REJECTED")).otherwise(F.lit("ELIGIBLE")).alias("status"), (c("s_nationkey") == 2).alias("performance_consulted")),
        "annotation_gates": r.raw("nation").select(c("n_name").alias("run"), (n % 5 != 0).alias("passed")), "scored": r.raw("nation").select(n.alias("trust_score")),
    }
    return criteria.Registry(tables, sides=("A", "N"), technologies=("ASIA",), least_samples=26, provenance_keys=_KEYS, panel=(5, 2409, 4), excluded=("c3",), window_prefix="window", window_constants={"assembly": "A1"})


#: How many violations each rule has in these tables.
_COUNT = {
    "event_keys": "0", "observation_keys": "SELECT count(*) FROM (SELECT observation_id FROM obs GROUP BY 1 HAVING count(*) > 1)", "observation_event": "0", "event_run": "SELECT count(*) FROM ev WHERE run NOT IN (SELECT c_custkey FROM customer)",
    "run_experiment": "SELECT count(*) FROM customer WHERE c_custkey % 41 = 0", "run_agreement": "0", "runs_have_events": "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT run FROM ev)", "runs_have_observations": "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT run FROM obs)",
    "event_observed": "SELECT count(*) FROM ev WHERE id NOT IN (SELECT event_id FROM obs)", "lineage": "SELECT count(*) FROM obs WHERE observation_id NOT IN (SELECT target_entity_id FROM prov)", "derived_artifacts": "SELECT count(*) FROM supplier WHERE s_suppkey % 8 <> 0 AND s_suppkey % 3 = 0",
    "endpoints": "SELECT count(*) FROM prov WHERE source_entity_id % 8 = 0", "contained": """SELECT count(*) FROM ev WHERE NOT (e > s AND id % 4 < 3 AND s >= 100 AND e <= 900)""", "not_asserted": "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'",
    "raw_kept": "SELECT count(*) FROM obs WHERE quantity = 1 OR source_record_ordinal = 1", "sides_apart": "SELECT count(*) FROM obs WHERE side NOT IN ('A', 'N')", "regenerated": "SELECT count(*) FROM obs WHERE quantity = 50",
    "decisions_reconcile": "SELECT count(*) FROM (SELECT run, side, d, count(*) AS n, count(*) FILTER (WHERE event_id % 37 <> 0) AS m FROM obs GROUP BY ALL) WHERE n <> m",
    "accounting": "SELECT count(*) FILTER (WHERE id % 13 = 0) + count(*) FILTER (WHERE id % 13 <> 0 AND id % 2 = 1 AND id % 17 = 0) FROM ev", "single_allele": "SELECT count(*) FROM ev WHERE id % 13 <> 0 AND id % 2 = 0 AND id % 3 <> 1",
    "abstention": "SELECT count(*) FILTER (WHERE id % 5 = 0) + count(*) FILTER (WHERE id % 7 = 0) FROM ev WHERE id % 13 <> 0 AND id % 2 = 1 AND id % 17 <> 0", "reason_given": "SELECT count(*) FROM ev WHERE id % 13 <> 0 AND id % 2 = 1 AND id % 17 <> 0 AND id % 3 = 0",
    "not_evaluated": "SELECT count(*) FROM ev WHERE id % 2 = 0 AND id % 3 = 0", "exact_links": "SELECT count(*) FROM li WHERE id % 19 = 0", "one_variant": "SELECT count(*) FROM ev WHERE id % 7 = 0 AND id % 29 = 0", "links_agree": "SELECT count(*) FROM li WHERE id % 11 = 0 OR id % 97 = 0",
    "variant_ids": "SELECT count(*) FROM part WHERE p_partkey % 10 = 0", "reuse": "SELECT count(*) FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 10 = 0", "link_provenance": "SELECT count(*) FROM li WHERE id % 23 = 0", "samples": "1",
    "technology_pairs": "SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", "snv_and_indel": "0", "product_query": "0", "reproduced": "SELECT 2 * count(*) FROM nation WHERE n_nationkey % 8 = 0", "forbidden": "1", "counts": "1", "panel_geometry": "1",
    "window_ids": "SELECT count(*) FROM nation WHERE n_nationkey % 6 = 0", "contexts": "0", "open_candidates": "SELECT count(*) FROM part WHERE p_size % 5 = 0", "classified_once": "SELECT count(*) FROM part WHERE p_size % 7 = 0",
    "exact_pairs": "SELECT count(*) FROM part WHERE p_size % 7 <> 0 AND p_size % 6 = 0", "event_schema": "SELECT count(*) FROM ev WHERE id % 31 = 0", "region_sets": "SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'",
    "sources_admitted": "SELECT count(*) FROM supplier WHERE s_nationkey IN (1, 2)", "gates_passed": "SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0", "event_interval": "SELECT count(*) FROM ev WHERE e <= s",
}


def _gate_sql(family: str) -> str:
    """Rows of a family's criteria: the sums of what their rules count."""
    rows = []
    for at, (gate, rules) in enumerate(criteria.FAMILIES[family].items()):
        n = str(int(at % 3 == 0 or at % 5 == 4)) if rules == criteria.FACTS else " + ".join(f"({_COUNT[rule]})" for rule in rules)
        rows.append(f"SELECT '{gate}' AS gate, ({n})::BIGINT AS n_violations")
    return f"""SELECT gate, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n_violations FROM ({' UNION ALL '.join(rows)})"""


_GATE_TABLES = """, ev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS run, o_orderkey % 1000 AS s, o_orderkey % 1000 + o_custkey % 3 AS e FROM orders),
obs AS (SELECT i.*, CASE WHEN source_record_ordinal = 7 THEN -2 ELSE o_custkey END AS run, CASE WHEN quantity = 1 THEN NULL ELSE raw_decision END AS d FROM items i JOIN orders ON o_orderkey = event_id), prov AS (SELECT * FROM provenance WHERE source_entity_id % 9 <> 0),
li AS (SELECT id FROM ev WHERE id % 7 = 0 UNION ALL SELECT id FROM ev WHERE id % 7 = 0 AND id % 29 = 0) """


@query(_GATE_TABLES + _gate_sql("1A"))
def gates_1a(r: Roles) -> DataFrame:
    return criteria.evaluate("1A", _registry(r))


@query(_GATE_TABLES + _gate_sql("1B"))
def gates_1b(r: Roles) -> DataFrame:
    return criteria.evaluate("1B", _registry(r))


@query(_GATE_TABLES + _gate_sql("2C"))
def gates_2c(r: Roles) -> DataFrame:
    return criteria.evaluate("2C", _registry(r))


@query(_GATE_TABLES + _gate_sql("2D"))
def gates_2d(r: Roles) -> DataFrame:
    return criteria.evaluate("2D", _registry(r))


@query(_GATE_TABLES + _gate_sql("2E"))
def gates_2e(r: Roles) -> DataFrame:
    return criteria.evaluate("2E", _registry(r))


@query(_GATE_TABLES + _gate_sql("EXPLORER"))
def gates_explorer(r: Roles) -> DataFrame:
    return criteria.evaluate("EXPLORER", _registry(r))


@query("SELECT '1B' AS family, 'STOP' AS verdict UNION ALL SELECT '2E', 'STOP' UNION ALL SELECT '2D', 'MODIFY' UNION ALL SELECT 'none', 'PASS'", plain=True)
def gate_verdicts(r: Roles) -> DataFrame:
    rows = lambda ids: r.spark.createDataFrame([(i, "FAIL" if i in ("1B-04", "P2-19", "D05") else "PASS", 0) for i in ids], "gate string, status string, n_violations long")
    parts = [criteria.verdict(f, rows(criteria.FAMILIES[f])).select(F.lit(f).alias("family"), "verdict") for f in ("1B", "2E", "2D")]
    return gates.together([*parts, criteria.verdict("1B", rows(["1B-01"])).select(F.lit("none").alias("family"), "verdict")])


@query("""SELECT gate, (n = 0) AS passed, n AS n_violations FROM (SELECT 'EVENT_ID_UNIQUE' AS gate, 0 AS n UNION ALL SELECT 'RUN_ID_UNIQUE', 0 UNION ALL SELECT 'EVENT_RUN_EXISTS', count(*) FROM ev WHERE run NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'RUN_EXPERIMENT_EXISTS', count(*) FROM customer WHERE c_custkey % 41 = 0
UNION ALL SELECT 'OBSERVATION_RUN_AGREES', count(*) FROM obs JOIN ev ON id = event_id WHERE obs.run <> ev.run UNION ALL SELECT 'EVENT_INTERVAL', count(*) FROM ev WHERE e <= s UNION ALL SELECT 'PADDED_HOLDS_CORE', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'OBSERVATION_HAS_LINEAGE', count(*) FROM obs WHERE observation_id NOT IN (SELECT target_entity_id FROM prov)
UNION ALL SELECT 'LINEAGE_ARTIFACT_EXISTS', count(*) FROM prov WHERE source_entity_id % 8 = 0 UNION ALL SELECT 'RUN_NOT_EMPTY', count(*) FROM customer WHERE c_custkey NOT IN (SELECT run FROM ev)
UNION ALL SELECT 'OBSERVATION_ID_UNIQUE', count(*) FROM (SELECT observation_id FROM obs GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'EXPERIMENT_ID_UNIQUE', count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'ARTIFACT_ID_UNIQUE', count(*) FROM (SELECT s_suppkey FROM supplier GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'OBSERVATION_EVENT_EXISTS', count(*) FROM obs WHERE event_id NOT IN (SELECT id FROM ev))""".join([_GATE_TABLES, ""]))
def registry_bundle(r: Roles) -> DataFrame:
    t = _registry(r).tables
    runs = t["runs"].withColumns({"core_start": F.lit(10), "core_end": F.lit(20), "padded_start": F.when(F.col("benchmark_run_id") % 3 == 0, 11).otherwise(0), "padded_end": F.lit(30)})
    found = gates.bundle_violations(t["events"], t["observations"], runs, t["experiments"], t["provenance"], t["artifacts"])
    names = ["OBSERVATION_ID_UNIQUE", "EXPERIMENT_ID_UNIQUE", "ARTIFACT_ID_UNIQUE", "OBSERVATION_EVENT_EXISTS", "EVENT_ID_UNIQUE", "RUN_ID_UNIQUE", "EVENT_RUN_EXISTS", "RUN_EXPERIMENT_EXISTS", "OBSERVATION_RUN_AGREES", "EVENT_INTERVAL", "PADDED_HOLDS_CORE", "OBSERVATION_HAS_LINEAGE", "LINEAGE_ARTIFACT_EXISTS", "RUN_NOT_EMPTY"]
    return gates.gates(r.spark, names, found).select("gate", (F.col("status") == "PASS").alias("passed"), "n_violations")


@query("SELECT n_nationkey::VARCHAR AS key, 'name' AS \"column\", n_name AS value FROM nation WHERE contains(n_name, '1') UNION ALL SELECT n_nationkey::VARCHAR, 'list', 'chr' || n_nationkey FROM nation UNION ALL SELECT 'field', 'trust_score', 'a.trust_score' UNION ALL SELECT 'json', 'consensus', '{\"a\":{\"consensus\":1}}'", plain=True)
def forbidden_content(r: Roles) -> DataFrame:
    n = r.raw("nation").select("n_nationkey", F.col("n_name").alias("name"), F.array(F.lit("ok"), F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))).alias("list"))
    values = gates.forbidden_values(n, "n_nationkey", "1|^chr")
    names = gates.forbidden_fields(r.spark.createDataFrame([], "a struct<trust_score:int,ok:int>, b array<struct<fine:int>>"))
    doc = r.spark.createDataFrame([('{"a":{"consensus":1}}',)], "value string").select("value", F.explode(gates.forbidden_json_keys(F.col("value"))).alias("column"))
    found = r.spark.createDataFrame([("field", f.rsplit(".", 1)[-1], f) for f in names], "key string, column string, value string")
    return values.unionAll(found).unionAll(doc.select(F.lit("json"), "column", "value"))


@query("SELECT 1 AS n_lost, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS n_unknown_lost FROM nation", plain=True)
def reproduced_tables(r: Roles) -> DataFrame:
    """A row of one build that another hasn't, and values whose UNKNOWN became null on the way."""
    n = r.raw("nation").select("n_nationkey", F.lit("UNKNOWN").alias("caller"))
    again = n.filter("n_nationkey <> 7")
    after = n.withColumn("caller", F.when(F.col("n_nationkey") % 2 == 1, F.col("caller")))
    lost = gates.reproducible(n, again).agg(F.count(F.lit(1)).cast("int").alias("n_lost"))
    unknown = schemas.unknown_kept(n, after, "n_nationkey", ["caller"]).agg(F.count(F.lit(1)).alias("n_unknown_lost"))
    return lost.select("n_lost", F.lit(unknown.first()[0]).alias("n_unknown_lost"))
