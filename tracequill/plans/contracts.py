"""Registered queries over contracts: schema documents, the explorer's delivery, and the panel of several contexts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import documents, entities
from tracequill.operators import delivery, explorer, gates, hashtree, intervals, selection
from tracequill.plans.registered import query
from tracequill.plans.roles import Roles
from tracequill.plans.stored import _path
from tracequill.sources.storage import stored


def _shown(value) -> str:
    """How a schema's value stands in a violation's detail, as an SQL literal."""
    return "'" + json.dumps(value, separators=(",", ":")).replace("'", "''") + "'"


def _text(df: DataFrame, *names: str) -> dict[str, Column]:
    return {n: df[n].cast("string") for n in names}


def _struct(**fields: Column | str | int | bool) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


# ---- schema documents -----------------------------------------------------------------------

_SCOPES = ("COMPARATOR_SUPERLOCUS", "SOURCE_RECORD_FALLBACK", "NORMALIZED_ALLELE_LOOKUP")
_EVENT = "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status, o_orderpriority AS priority, date_diff('day', DATE '1995-06-17', o_orderdate::DATE) AS start FROM orders"


@query(f"""WITH e AS ({_EVENT}) SELECT key, 'identity_scope' AS path, 'enum' AS keyword, {_shown(_SCOPES)} AS detail FROM e WHERE status = 'P'
UNION ALL SELECT key, 'start_0based', 'minimum', '0' FROM e WHERE start < 0 UNION ALL SELECT key, 'end_0based', 'minimum', '1' FROM e WHERE start + 1 < 1
UNION ALL SELECT key, 'cross_run_equivalence_asserted', 'const', 'false' FROM e WHERE priority = '5-LOW' UNION ALL SELECT key, '', 'additionalProperties', 'priority' FROM e WHERE priority = '2-HIGH'
UNION ALL SELECT key, '', 'required', 'source_event_id' FROM e WHERE status = 'F' AND priority = '1-URGENT'""", plain=True)
def event_documents(r: Roles) -> DataFrame:
    """Orders as event documents against the event's schema."""
    o = r.raw("orders")
    scope = F.when(F.col("o_orderstatus") == "F", _SCOPES[0]).when(F.col("o_orderstatus") == "O", _SCOPES[1]).otherwise("PENDING")
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date")).cast("long")
    key, urgent = F.col("o_orderkey").cast("string"), F.col("o_orderpriority") == "1-URGENT"
    doc = _struct(
        schema_version="1.0.0", event_id=key, identity_scope=scope, benchmark_run_id=F.col("o_custkey").cast("string"), reference_artifact_id="reference", assembly="A1", contig=F.col("o_orderpriority"), start_0based=start, end_0based=start + 1,
        source_event_id=F.when(~urgent, F.concat(F.lit("order-"), key)), derivation_method="orders", cross_run_equivalence_asserted=F.col("o_orderpriority") == "5-LOW", priority=F.when(F.col("o_orderpriority") == "2-HIGH", "high"),
    )
    rows = o.select(key.alias("key"), doc.alias("document"))
    return documents.violations(rows, entities.compiler(), "event", F.col("document"), "key")


_METHOD = "CASE p_type WHEN 'ECONOMY' THEN 'ML_PROPOSED' WHEN 'STANDARD' THEN 'UNRESOLVED' WHEN 'PROMO' THEN 'CURATED' ELSE 'RULE_EXACT' END"


@query(f"""WITH p AS (SELECT p_partkey::VARCHAR AS key, {_METHOD} AS method, p_size AS size, p_brand AS brand, floor(p_retailprice)::BIGINT AS price FROM part),
places AS (SELECT 'platform/vendor' AS place UNION ALL SELECT 'platform/chemistry/0' UNION ALL SELECT 'platform/chemistry/1')
SELECT key, place AS path, 'required' AS keyword, 'ml' AS detail FROM p, places WHERE method = 'ML_PROPOSED' UNION ALL SELECT key, place, 'required', 'curation' FROM p, places WHERE method = 'CURATED'
UNION ALL SELECT key, place || '/value', 'const', '"UNKNOWN"' FROM p, places WHERE method = 'UNRESOLVED' UNION ALL SELECT key, place || '/confidence', 'const', '0' FROM p, places WHERE method = 'UNRESOLVED' AND size > 0
UNION ALL SELECT key, place || '/confidence', 'maximum', '1' FROM p, places WHERE size > 40 UNION ALL SELECT key, 'run_accession', 'pattern', {_shown(entities.PATTERNS["run_accession"])} FROM p WHERE length(key) < 3
UNION ALL SELECT key, 'coverage/value', 'type', 'null' FROM p WHERE brand = 'Brand#1' UNION ALL SELECT key, 'coverage', 'required', 'genome_size_assembly_id' FROM p WHERE brand = 'Brand#2'
UNION ALL SELECT key, 'basecaller', 'oneOf', '' FROM p WHERE price % 2 = 1 UNION ALL SELECT key, 'source_record_ids', 'uniqueItems', '' FROM p WHERE size <= 10""", plain=True)
def run_documents(r: Roles) -> DataFrame:
    """Parts as sequencing runs: normalized values deep in records and lists, alternatives and conditions."""
    p, key, size = documents.spread(r.raw("part"), "p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size")
    tool = _struct(id="rules", version="1")
    good = _struct(raw_value="raw", value="known", method="RULE_EXACT", confidence=1.0, normalizer=tool)
    value = _struct(raw_value=F.col("p_brand"), value=F.col("p_brand"), method=F.expr(_METHOD), confidence=size / 40.0, normalizer=tool)
    whole = F.floor(F.col("p_retailprice"))
    status = F.when(F.col("p_brand") == "Brand#1", "UNKNOWN").when(F.col("p_brand") == "Brand#2", "COMPUTED_FROM_BASES").otherwise("SOURCE_REPORTED")
    record = F.concat(F.lit("src-"), key)
    doc = _struct(
        schema_version=entities.CATALOG_VERSION, run_id=F.concat(F.lit("run-"), key), run_accession=F.concat(F.lit("SRR"), F.when(F.length(key) < 3, key).otherwise(F.lpad(key, 9, "0"))), sample_id="sample", study_id="study",
        library=_struct(strategy=good, source=good, selection=good, layout=good), assay=good, read_type=_struct(raw_value="raw", value="LONG_SINGLE_MOLECULE", method="RULE_EXACT", confidence=1.0, normalizer=tool),
        platform=_struct(technology_family=good, vendor=value, instrument_family=good, instrument_model=good, chemistry=F.array(value, value), read_mode=good), basecaller=F.when(whole % 2 == 1, "dorado").otherwise("NOT_APPLICABLE"),
        coverage=_struct(status=status, value=size.cast("double") + 1), public_file_artifact_ids=F.array(F.lit("file")), source_record_ids=F.when(size <= 10, F.array(record, record)).otherwise(F.array(record)),
    )
    rows = p.select(key.alias("key"), doc.alias("document"))
    return documents.violations(rows, entities.compiler(), "sequencing_run", F.col("document"), "key")


_STATE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CATALOGUED' WHEN '2-HIGH' THEN 'ELIGIBLE' WHEN '3-MEDIUM' THEN 'RELEASED' WHEN '5-LOW' THEN 'LOST' ELSE 'WITHDRAWN' END"
_LAYER = f"CASE o_orderstatus WHEN 'F' THEN '{entities.LAYERS[0]}' WHEN 'O' THEN '{entities.LAYERS[1]}' ELSE '{entities.LAYERS[2]}' END"
_STEP = "CASE l_returnflag WHEN 'R' THEN 'CATALOGUED' WHEN 'A' THEN 'ELIGIBLE' ELSE 'SHIPPED' END"
_GATED = "state IN ('ELIGIBLE', 'RELEASED')"


@query(f"""WITH lines AS (SELECT l_orderkey, {_STEP} AS to_state, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
own AS (SELECT l_orderkey, count(*) AS n, list(to_state ORDER BY i) AS steps, count(*) FILTER (WHERE l_quantity > 40) AS marked, count(DISTINCT l_quantity) FILTER (WHERE l_quantity > 40) AS marks FROM lines GROUP BY 1),
r AS (SELECT o_orderkey::VARCHAR AS key, {_STATE} AS state, {_LAYER} AS layer, n, marked, marks, o_totalprice > 200000 AS partial FROM orders JOIN own ON o_orderkey = l_orderkey)
SELECT key, 'eligibility_state' AS path, 'enum' AS keyword, {_shown(entities.STATES)} AS detail FROM r WHERE state = 'LOST'
UNION ALL SELECT l_orderkey::VARCHAR, 'state_history/' || i || '/to_state', 'enum', {_shown(entities.STATES)} FROM lines JOIN orders ON o_orderkey = l_orderkey WHERE to_state = 'SHIPPED'
UNION ALL SELECT key, 'layer', 'const', '"{entities.LAYERS[0]}"' FROM r WHERE state IN ('CATALOGUED', 'WITHDRAWN') AND layer <> '{entities.LAYERS[0]}'
UNION ALL SELECT key, 'layer', 'const', '"{entities.LAYERS[1]}"' FROM r WHERE state = 'ELIGIBLE' AND layer <> '{entities.LAYERS[1]}'
UNION ALL SELECT key, 'layer', 'const', '"{entities.LAYERS[2]}"' FROM r WHERE state = 'RELEASED' AND layer <> '{entities.LAYERS[2]}'
UNION ALL SELECT key, '', 'required', 'release_memberships' FROM r WHERE state = 'RELEASED' UNION ALL SELECT key, 'normalization_state', 'const', '"NORMALIZED"' FROM r WHERE {_GATED} AND partial
UNION ALL SELECT key, 'canonical_in_cluster', 'const', 'true' FROM r WHERE {_GATED} AND n % 2 = 0 UNION ALL SELECT key, 'terms/compatibility', 'const', '"COMPATIBLE"' FROM r WHERE {_GATED} AND n > 4
UNION ALL SELECT key, 'normalization_confidence/ml_only_hard_gate_fields', 'maxItems', '0' FROM r WHERE {_GATED} AND marked > 0 UNION ALL SELECT key, 'normalization_confidence/ml_only_hard_gate_fields', 'uniqueItems', '' FROM r WHERE marked > marks""", plain=True)
def catalog_documents(r: Roles) -> DataFrame:
    """Orders with their items as catalog records: histories of any length, and rules between a record's state and its other fields."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.expr(_STEP).alias("to_state"))
    lines = r.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count(F.lit(1)).alias("n"))
    o, key = r.raw("orders"), F.col("o_orderkey").cast("string")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    agent = _struct(type="SOFTWARE", id="loader")
    step = lambda x: _struct(from_state="CATALOGUED", to_state=x["to_state"], at=at, actor=agent, reason="item", policy_version=F.concat(x["l_linenumber"].cast("string"), F.lit(".0.0")))
    marked = F.transform(F.filter("lines", lambda x: x["l_quantity"] > 40), lambda x: F.concat(F.lit("field_"), x["l_quantity"].cast("int").cast("string")))
    digest = F.sha2(key, 256)
    doc = _struct(
        schema_version=entities.CATALOG_VERSION, record_id=F.concat(F.lit("order-"), key), record_version=F.col("n"), record_kind="STUDY", entity_ref=_struct(kind="STUDY", id=F.concat(F.lit("order-"), key), sha256=digest),
        layer=F.expr(_LAYER), eligibility_state=F.expr(_STATE), state_history=F.transform("lines", step), normalization_state=F.when(F.col("o_totalprice") > 200000, "PARTIAL").otherwise("NORMALIZED"),
        normalization_confidence=_struct(minimum_hard_gate_confidence=0.5, ml_only_hard_gate_fields=marked, unresolved_hard_gate_fields=F.array().cast("array<string>")), discovered_at=at, last_seen_at=at,
        source_record_ids=F.array(F.concat(F.lit("src-"), key)), duplicate_cluster_id=F.concat(F.lit("cluster-"), F.col("o_custkey").cast("string")), canonical_in_cluster=F.col("n") % 2 == 1,
        terms=_struct(terms_id="terms", compatibility=F.when(F.col("n") > 4, "UNREVIEWED").otherwise("COMPATIBLE"), snapshot_sha256=digest, snapshot_retrieved_at=at),
    )
    rows = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(key.alias("key"), doc.alias("document"))
    return documents.violations(rows, entities.compiler(), "catalog_record", F.col("document"), "key")


# ---- delivery -------------------------------------------------------------------------------


def _model(r: Roles) -> delivery.Model:
    """Orders that have items, with their items; an item's id holds all its columns."""
    c, text = F.col, lambda n: F.col(n).cast("string")
    runs = r.runs.join(r.experiments, "experiment_id").select("benchmark_run_id", c("sample").alias("sample_id"), "technology")
    places = r.raw("orders").join(runs, c("o_custkey") == c("benchmark_run_id")).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").alias("place"), "sample_id", "technology")
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    items = r.raw("lineitem").select(*columns).repartition("l_orderkey").distinct().join(places, c("l_orderkey") == c("o_orderkey")).drop("o_orderkey")
    items = stored(items.sortWithinPartitions("l_orderkey"), _path(r, "web-items"))  # read several times; an event's rows stay together
    ids = F.concat_ws("-", *[c(n).cast("long").cast("string") if n == "l_quantity" else text(n) for n in columns])
    observations = items.select(ids.alias("observation_id"), text("l_orderkey").alias("event_id"), "sample_id", "technology", c("l_linestatus").alias("raw_decision"), F.nullif(c("l_returnflag"), F.lit("N")).alias("raw_variant_type"))
    fixed = ("o_orderstatus", "o_orderpriority", "place")
    of_order = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("observation_count"), F.min("l_partkey").cast("string").alias("least_part"), *[F.min(n).alias(n) for n in fixed])
    state = F.when(c("o_orderstatus") == "F", delivery.EXACT).when(c("o_orderstatus") == "O", delivery.UNRESOLVED).otherwise(delivery.NOT_EVALUATED)
    events = of_order.select(
        text("l_orderkey").alias("event_id"), state.alias("identity_state"), F.when(c("o_orderstatus") == "F", c("least_part")).alias("variant_id"), "observation_count", F.when(c("o_orderstatus") == "P", "PHASE1A").otherwise("PHASE2C").alias("phase_origin"),
        F.lit("A1").alias("assembly"), c("o_orderpriority").alias("contig"), c("place").alias("start_0based"), (c("place") + 1).alias("end_0based"),
    )
    events = stored(events, _path(r, "web-events"))
    size = c("p_size").cast("long")
    variants = r.raw("part").select(text("p_partkey").alias("variant_id"), size.alias("normalized_start_0based"), (size + 1).alias("normalized_end_0based"), c("p_brand").alias("normalized_ref"), c("p_type").alias("normalized_alt"))
    return delivery.Model(events, observations, variants, events.filter(c("identity_state") == delivery.UNRESOLVED).select("event_id"))


_ITEMS = """WITH places AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, floor(o_totalprice)::BIGINT AS place, n_name AS sample_id, r_name AS technology FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
items AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS l_quantity, l_returnflag, l_linestatus FROM lineitem),
evidence AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS observation_id, l_orderkey::VARCHAR AS event_id, sample_id, technology, l_linestatus AS raw_decision, nullif(l_returnflag, 'N') AS raw_variant_type, l_partkey, place, o_orderstatus, o_orderpriority,
  'evidence/' || left(sha256(l_orderkey::VARCHAR), 2) || '.json' AS evidence_shard FROM items JOIN places ON l_orderkey = o_orderkey),
search AS (SELECT event_id, any_value(evidence_shard) AS evidence_shard, CASE WHEN any_value(o_orderstatus) = 'F' THEN min(l_partkey)::VARCHAR END AS variant_id, CASE any_value(o_orderstatus) WHEN 'F' THEN 'EXACT_NORMALIZED_ALLELE' WHEN 'O' THEN 'UNRESOLVED' ELSE 'NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY' END AS identity_state,
  CASE WHEN any_value(o_orderstatus) = 'P' THEN 'PHASE1A' ELSE 'PHASE2C' END AS phase_origin, any_value(o_orderpriority) AS contig, any_value(place) AS start_0based, any_value(sample_id) AS sample_id, any_value(technology) AS technology, string_agg(DISTINCT raw_decision, ';' ORDER BY raw_decision) AS raw_decisions,
  coalesce(string_agg(DISTINCT raw_variant_type, ';' ORDER BY raw_variant_type), '') AS raw_variant_types, count(*) AS observation_count FROM evidence GROUP BY event_id)
"""


@query(_ITEMS + "SELECT search.*, p_size::BIGINT AS normalized_start_0based, (p_size + 1)::BIGINT AS normalized_end_0based, p_brand AS normalized_ref, p_type AS normalized_alt FROM search LEFT JOIN part ON variant_id = p_partkey::VARCHAR", plain=True)
def web_search_index(r: Roles) -> DataFrame:
    """The search index as it was delivered and read back."""
    found = delivery.write(_model(r), _path(r, "web-search"), divide=True, compression="gzip").search
    lists = {n: F.array_join(n, ";") for n in ("raw_decisions", "raw_variant_types")}
    return found.withColumns(lists).drop("assembly", "end_0based")


@query(_ITEMS + "SELECT event_id, evidence_shard FROM search", plain=True)
def web_shard_index(r: Roles) -> DataFrame:
    return delivery.write(_model(r), _path(r, "web-shards"), divide=True, compression="gzip").shards


@query(_ITEMS + """, lines AS (SELECT evidence_shard, event_id, observation_id, json_object('event_id', event_id, 'observation_id', observation_id, 'raw_decision', raw_decision, 'raw_variant_type', raw_variant_type, 'sample_id', sample_id, 'technology', technology)::VARCHAR || chr(10) AS line FROM evidence)
SELECT evidence_shard, sum(strlen(line))::BIGINT AS size_bytes, sha256(string_agg(line, '' ORDER BY event_id, observation_id)) AS sha256 FROM lines GROUP BY 1""", plain=True)
def web_evidence(r: Roles) -> DataFrame:
    """Size and digest of every shard's file, which are those of its lines in order."""
    path = _path(r, "web-evidence")
    delivery.write(_model(r), path, divide=True, compression="gzip")
    return delivery.shard_digests(r.spark, path)


@query(_ITEMS + """, sizes AS (SELECT evidence_shard, sum(strlen(json_object('event_id', event_id, 'observation_id', observation_id, 'raw_decision', raw_decision, 'raw_variant_type', raw_variant_type, 'sample_id', sample_id, 'technology', technology)::VARCHAR) + 1) AS n FROM evidence GROUP BY 1)
SELECT 'event_count' AS name, count(*)::VARCHAR AS value FROM search UNION ALL SELECT 'observation_count', count(*)::VARCHAR FROM evidence UNION ALL SELECT 'variant_count', count(*)::VARCHAR FROM part UNION ALL SELECT 'identity_state:' || identity_state, count(*)::VARCHAR FROM search GROUP BY identity_state
UNION ALL SELECT DISTINCT 'sample_id_value', sample_id FROM search UNION ALL SELECT DISTINCT 'technology_value', technology FROM search UNION ALL SELECT 'shard_count', count(*)::VARCHAR FROM sizes UNION ALL SELECT 'maximum_shard_byte_size', max(n)::BIGINT::VARCHAR FROM sizes""", plain=True)
def web_manifest(r: Roles) -> DataFrame:
    return delivery.write(_model(r), _path(r, "web-manifest"), divide=True, compression="gzip").manifest


@query("""SELECT rule, key FROM (SELECT 'EVENT_WITHOUT_EVIDENCE' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'OBSERVATION_WITHOUT_EVENT', l_orderkey::VARCHAR FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'OBSERVATION_COUNT', o_orderkey::VARCHAR FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n <> m
UNION ALL SELECT 'SAMPLES_DISAGREE', o_orderkey::VARCHAR FROM orders WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) > 1
UNION ALL SELECT 'TECHNOLOGIES_DISAGREE', o_orderkey::VARCHAR FROM orders WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey) > 1
UNION ALL SELECT 'IDENTITY_STATE', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'EXACT_WITHOUT_VARIANT', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'VARIANT_WITHOUT_EXACT', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'UNRESOLVED_SET', o_orderkey::VARCHAR FROM orders WHERE (o_orderstatus = 'O') <> (o_orderpriority = '1-URGENT')
UNION ALL SELECT 'DUPLICATE_OBSERVATION', i FROM (SELECT concat_ws('-', l_orderkey, l_linenumber) AS i FROM lineitem) GROUP BY i HAVING count(*) > 1)""", plain=True)
def delivery_violations(r: Roles) -> DataFrame:
    """What keeps orders and items as they are from being delivered."""
    text = lambda n: F.col(n).cast("string")
    most = r.raw("lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("observation_count"))
    state = F.when(F.col("o_orderstatus") == "F", delivery.EXACT).when(F.col("o_orderstatus") == "O", delivery.UNRESOLVED).otherwise("PENDING")
    events = r.raw("orders").join(most, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(text("o_orderkey").alias("event_id"), state.alias("identity_state"), text("o_custkey").alias("variant_id"), "observation_count")
    observations = r.raw("lineitem").select(F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("observation_id"), text("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("technology"), F.lit("x").alias("raw_decision"), F.lit("y").alias("raw_variant_type"))
    unresolved = r.raw("orders").filter("o_orderpriority = '1-URGENT'").select(text("o_orderkey").alias("event_id"))
    return delivery.model_violations(delivery.Model(events, observations, r.raw("supplier").select(text("s_suppkey").alias("variant_id")), unresolved))


# ---- panel of several contexts --------------------------------------------------------------

_RULES = selection.Rules(half_window=3000, least_assessable=2000, per_contig=4, per_context=16, cross_overlap=1500, least_contigs=3)
_ORDER = ["c2", "c0", "c1"]


def _contexts(r: Roles) -> DataFrame:
    """Every interval in one of three contexts."""
    return r.intervals.withColumn("context_id", F.concat(F.lit("c"), F.pmod("id", F.lit(3)).cast("string")))


def _candidates(r: Roles) -> DataFrame:
    """Windows around the intervals of each context; what can be assessed is the intervals of side 1."""
    cover = intervals.merge(r.intervals.filter("side = 1").select("contig", "start", "end"))
    of = lambda c: selection.candidates(_contexts(r).filter(F.col("context_id") == c).withColumn("ordinal", F.col("id")), cover, {"assembly": "A1", "context_id": c}, "window", "salt", _RULES).withColumn("context_id", F.lit(c))
    first, *rest = [of(c) for c in _ORDER]
    for rows in rest:
        first = first.unionByName(rows)
    return first


_PLACED = """, contexts AS (SELECT *, 'c' || (id % 3) AS context_id FROM intervals),
cover AS (SELECT contig, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start, "end", id) AS g FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY contig ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM intervals WHERE side = 1)) GROUP BY contig, g),
windows AS (SELECT DISTINCT context_id, contig, w AS start, w + 6000 AS "end" FROM (SELECT context_id, contig, greatest(0, (start + "end") // 2 - 3000) AS w FROM contexts)),
named AS (SELECT *, 'window:sha256:' || sha256('{"assembly":"A1","chromosome":"' || contig || '","context_id":"' || context_id || '","nominal_end_0based":' || "end" || ',"nominal_start_0based":' || start || '}') AS candidate_id FROM windows),
eligible AS (SELECT n.context_id, candidate_id, n.contig, n.start, n."end" FROM named n JOIN cover b ON b.contig = n.contig AND b.start < n."end" AND b."end" > n.start GROUP BY ALL HAVING sum(least(n."end", b."end") - greatest(n.start, b.start)) >= @least_assessable),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY list_position(['c2', 'c0', 'c1'], context_id), sha256('salt|' || candidate_id), candidate_id) AS place FROM eligible),
firsts AS (SELECT context_id, min(place) AS first, max(place) AS last FROM placed GROUP BY 1),
walk AS (SELECT 0::BIGINT AS place, ''::VARCHAR AS context_id, ''::VARCHAR AS candidate_id, ''::VARCHAR AS why, []::STRUCT(k VARCHAR, id VARCHAR, contig VARCHAR, s BIGINT, e BIGINT)[] AS chosen UNION ALL
SELECT place, context_id, candidate_id, why, CASE WHEN why = '' THEN list_append(chosen, {'k': context_id, 'id': candidate_id, 'contig': contig, 's': start, 'e': "end"}) ELSE chosen END FROM
(SELECT c.*, w.chosen, CASE WHEN len(list_filter(w.chosen, lambda x: x.k = c.context_id AND x.contig = c.contig)) >= @per_contig THEN 'MAX_WINDOWS_PER_CHROMOSOME' WHEN len(list_filter(w.chosen, lambda x: x.k = c.context_id AND x.contig = c.contig AND x.s < c."end" AND x.e > c.start)) > 0 THEN 'WITHIN_CONTEXT_OVERLAP'
WHEN len(list_filter(w.chosen, lambda x: x.k <> c.context_id AND x.contig = c.contig AND least(x.e, c."end") - greatest(x.s, c.start) >= @cross_overlap)) > 0 THEN 'CROSS_CONTEXT_OVERLAP_GE_50_PERCENT' ELSE '' END AS why
FROM walk w LEFT JOIN firsts f ON f.context_id = w.context_id JOIN placed c ON c.place = CASE WHEN len(list_filter(w.chosen, lambda x: x.k = w.context_id)) >= @per_context THEN f.last + 1 ELSE w.place + 1 END))
"""


for _name in ("per_contig", "per_context", "cross_overlap", "least_assessable"):
    _PLACED = _PLACED.replace(f"@{_name}", str(getattr(_RULES, _name)))


@query(_PLACED + """SELECT context_id, candidate_id, contig, start, "end", row_number() OVER (PARTITION BY context_id ORDER BY place)::INT AS selection_rank, row_number() OVER (PARTITION BY context_id, contig ORDER BY place)::INT AS chromosome_selection_rank
FROM walk JOIN placed USING (place, context_id, candidate_id) WHERE why = ''""")
def panel_selection(r: Roles) -> DataFrame:
    """The windows of three contexts, one after the other; the SQL twin walks all candidates by recursion."""
    return selection.panel(_candidates(r), _ORDER, _RULES).selected.drop("selection_hash")


@query(_PLACED + """SELECT context_id, candidate_id, (place - first + 1)::BIGINT AS evaluation_rank, CASE WHEN why = '' THEN 'SELECTED' ELSE 'REJECTED' END AS decision, why AS rejection_reason FROM walk JOIN firsts USING (context_id)""")
def panel_evaluation(r: Roles) -> DataFrame:
    """Every candidate that was looked at before its context was full, with the first reason against it."""
    return selection.panel(_candidates(r), _ORDER, _RULES).evaluated.select("context_id", "candidate_id", "evaluation_rank", "decision", "rejection_reason")


@query(_PLACED + """SELECT w.candidate_id, coalesce(string_agg(DISTINCT c.context_id, ';' ORDER BY c.context_id), '') AS memberships FROM eligible w LEFT JOIN contexts c ON c.contig = w.contig AND c.start < w."end" AND c."end" > w.start AND c.context_id <> w.context_id GROUP BY 1""")
def other_contexts(r: Roles) -> DataFrame:
    """The contexts that each candidate overlaps beside its own."""
    windows = _candidates(r).select("candidate_id", "context_id", "contig", "start", "end").withColumnRenamed("context_id", "own_context")
    return selection.context_membership(windows, _contexts(r), sorted(_ORDER), own="own_context").select("candidate_id", "memberships")


# ---- references and deep scans --------------------------------------------------------------


@query("""WITH runs AS (SELECT c_custkey AS id, c_nationkey AS q, c_nationkey + 10 AS t, c_nationkey * 5 AS b, c_custkey % 120 AS f, CASE WHEN c_acctbal < 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, c_mktsegment AS segment, floor(c_acctbal)::BIGINT AS place FROM customer), known AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0),
lines AS (SELECT DISTINCT l_orderkey, l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem), seen AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'EVENT_REFERENCE_ARTIFACT' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE o_custkey NOT IN (SELECT k FROM known) UNION ALL SELECT 'RUN_QUERY_ARTIFACT_ID', id::VARCHAR FROM runs WHERE q NOT IN (SELECT k FROM known) UNION ALL SELECT 'RUN_TRUTH_ARTIFACT_ID', id::VARCHAR FROM runs WHERE t NOT IN (SELECT k FROM known)
UNION ALL SELECT 'RUN_BENCHMARK_BED_ARTIFACT_ID', id::VARCHAR FROM runs WHERE b NOT IN (SELECT k FROM known) UNION ALL SELECT 'RUN_REFERENCE_ARTIFACT_ID', id::VARCHAR FROM runs WHERE f NOT IN (SELECT k FROM known) UNION ALL SELECT 'RUN_OUTPUT_ARTIFACT', id::VARCHAR FROM (SELECT id, unnest([q, t]) AS x FROM runs) WHERE x NOT IN (SELECT k FROM known)
UNION ALL SELECT 'EXPERIMENT_METADATA_ARTIFACT', n_nationkey::VARCHAR FROM nation WHERE n_nationkey NOT IN (SELECT k FROM known) UNION ALL SELECT 'OBSERVATION_RUN_EXISTS', o FROM lines JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT id FROM runs)
UNION ALL SELECT 'OBSERVATION_OUTPUT_ARTIFACT', o FROM lines JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey NOT IN (SELECT k FROM known) UNION ALL SELECT 'LINK_SOURCE_EXISTS', 'p-' || o FROM lines WHERE l_suppkey NOT IN (SELECT k FROM known) UNION ALL SELECT 'LINK_TARGET_EXISTS', 'p-' || o FROM lines WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'RUN_CORE_INTERVAL', id::VARCHAR FROM runs WHERE place < 0 UNION ALL SELECT 'RUN_INTERVALS_AGREE', id::VARCHAR FROM runs WHERE segment = 'BUILDING' UNION ALL SELECT 'SUCCEEDED_RUN_OBSERVED', id::VARCHAR FROM runs WHERE status = 'SUCCEEDED' AND id NOT IN (SELECT o_custkey FROM seen)""", plain=True)
def registry_references(r: Roles) -> DataFrame:
    """References of orders, items, customers and nations as a registry, in which artifacts are suppliers with a balance."""
    c = F.col
    artifacts = r.raw("supplier").filter("s_acctbal > 0").select(c("s_suppkey").alias("source_artifact_id"))
    interval = lambda contig, start: F.struct(F.lit("A1").alias("assembly"), contig.alias("contig"), start.alias("start_0based"), (F.greatest(start, F.lit(0)) + 1).alias("end_0based"))
    place, segment = F.floor("c_acctbal"), c("c_mktsegment")
    runs = r.raw("customer").select(
        c("c_custkey").alias("benchmark_run_id"), c("c_nationkey").alias("query_artifact_id"), (c("c_nationkey") + 10).alias("truth_artifact_id"), (c("c_nationkey") * 5).alias("benchmark_bed_artifact_id"), (c("c_custkey") % 120).alias("reference_artifact_id"), F.array("c_nationkey", c("c_nationkey") + 10).alias("output_artifact_ids"),
        F.when(c("c_acctbal") < 0, "FAILED").otherwise("SUCCEEDED").alias("run_status"), interval(segment, place).alias("core"), interval(F.when(segment == "BUILDING", "other").otherwise(segment), F.lit(0).cast("long")).alias("padded"),
    )
    items = r.observations.select("observation_id", "benchmark_run_id", c("source_artifact_id").alias("source_output_artifact_id")).distinct()
    experiments = r.raw("nation").select(c("n_nationkey").alias("experiment_id"), F.array("n_nationkey").alias("metadata_artifact_ids"))
    events = r.raw("orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("reference_artifact_id"))
    return gates.reference_violations(events, items, runs, experiments, r.provenance, artifacts)


@query("""WITH docs AS (SELECT o_orderkey AS key, o_orderpriority AS priority, n, lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n, list({'q': l_quantity, 'r': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
each AS (SELECT key, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM docs)
SELECT key, 'lines/' || i || '/deep/trusted' AS path, 'trusted' AS name FROM each WHERE x.q > 45 UNION ALL SELECT key, 'lines/' || i || '/consensus', 'consensus' FROM each WHERE x.r = 'R' UNION ALL SELECT key, 'preferred_technology', 'preferred_technology' FROM docs WHERE priority = '1-URGENT'""", plain=True)
def forbidden_paths(r: Roles) -> DataFrame:
    """Where JSON documents of orders and items have forbidden names, at any depth; texts that look like names aren't."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = r.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    item = lambda x: F.struct(F.struct(F.when(x["l_quantity"] > 45, 1).alias("trusted"), F.lit('"trusted": 1').alias("note")).alias("deep"), F.when(x["l_returnflag"] == "R", F.array(F.lit("TP"))).alias("consensus"))
    doc = F.struct(F.transform("lines", item).alias("lines"), F.when(F.col("o_orderpriority") == "1-URGENT", "x").alias("preferred_technology"), F.lit("consensus").alias("text"))
    rows = r.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("key"), documents.document(doc).alias("document"))
    return gates.forbidden_paths(rows, "key", F.col("document"))


# ---- product queries ------------------------------------------------------------------------

_PRODUCT = """WITH links AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS variant_id FROM lineitem WHERE l_quantity > 25), runs AS (SELECT c_custkey AS run, c_nationkey AS experiment, n_name AS sample_id, r_name AS technology, c_mktsegment, c_name, floor(c_acctbal)::BIGINT AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
linked AS (SELECT l.*, o_custkey AS run, o_orderpriority, o_orderstatus FROM links l JOIN orders ON event_id = o_orderkey), cover AS (SELECT variant_id, count(DISTINCT sample_id) AS s, count(DISTINCT technology) AS t, count(DISTINCT event_id) AS n FROM linked JOIN runs USING (run) GROUP BY 1),
items AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_id, l_orderkey AS event_id, l_returnflag AS side, l_linestatus AS raw_decision, l_linenumber::VARCHAR AS kind, l_suppkey AS artifact, l_quantity::BIGINT::VARCHAR AS genotype FROM lineitem)
"""


def _product_tables(r: Roles) -> tuple[DataFrame, ...]:
    c, text = F.col, lambda n: F.col(n).cast("string")
    orders = r.raw("orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("benchmark_run_id"), "o_orderstatus", "o_orderpriority")
    pairs = r.raw("lineitem").filter("l_quantity > 25").select(c("l_orderkey").alias("event_id"), c("l_partkey").alias("variant_id")).distinct()
    locks = F.to_json(F.struct(*[F.concat(F.lit(f"{n}-"), c("o_orderpriority")).alias(n) for n in explorer.LOCKS]))
    links = pairs.join(orders, "event_id").select(
        "event_id", "variant_id", "benchmark_run_id", F.concat_ws("-", text("event_id"), text("variant_id")).alias("event_variant_link_id"), F.lit("EXACT_NORMALIZED_ALLELE").alias("identity_status"), F.lit("exact").alias("identity_method"), F.lit("1.0.0").alias("identity_method_version"),
        F.when(c("o_orderstatus") == "F", "PHASE1B_REUSED").otherwise("PHASE2D_NEW").alias("variant_origin"), locks.alias("provenance"),
    )
    runs = r.raw("customer").select(c("c_custkey").alias("benchmark_run_id"), c("c_nationkey").alias("experiment_id"), c("c_mktsegment").alias("comparator"), c("c_name").alias("comparator_version"), c("c_mktsegment").alias("engine"), F.floor("c_acctbal").alias("engine_version"))
    experiments = r.experiments.select("experiment_id", c("sample").alias("sample_id"), "technology", c("sample").alias("platform"), c("technology").alias("pipeline_name"))
    observations = r.items.select("observation_id", "event_id", "side", "raw_decision", text("source_record_ordinal").alias("raw_match_kind"), c("side").alias("raw_variant_type"), text("quantity").alias("source_genotype"), c("raw_decision").alias("source_filter"), c("source_artifact_id").alias("source_output_artifact_id")).distinct()
    return links, orders.select("event_id", c("o_orderpriority").alias("reference_artifact_id")), runs, experiments, observations


@query(_PRODUCT + """SELECT l.variant_id, l.event_id || '-' || l.variant_id AS event_variant_link_id, 'EXACT_NORMALIZED_ALLELE' AS identity_status, 'exact' AS identity_method, CASE WHEN o_orderstatus = 'F' THEN 'PHASE1B_REUSED' ELSE 'PHASE2D_NEW' END AS variant_origin, sample_id, technology, experiment AS experiment_id, l.run AS benchmark_run_id,
c_mktsegment AS comparator, c_name AS comparator_version, c_mktsegment AS engine, balance AS engine_version, l.event_id, observation_id, side, raw_decision, kind AS raw_match_kind, genotype AS source_genotype, raw_decision AS source_filter, artifact AS source_output_artifact_id, 'archive' AS phase2c_archive_sha256
FROM linked l JOIN runs USING (run) JOIN items USING (event_id) WHERE l.variant_id = (SELECT variant_id FROM cover ORDER BY s DESC, t DESC, n DESC, variant_id DESC LIMIT 1)""", plain=True)
def identity_product(r: Roles) -> DataFrame:
    """Every observation of the best-covered variant, in the 22 columns of the identity phase."""
    return explorer.identity_product(*_product_tables(r), "archive")


@query(_PRODUCT + """SELECT l.variant_id, l.event_id || '-' || l.variant_id AS event_variant_link_id, 'EXACT_NORMALIZED_ALLELE' AS identity_status, 'exact' AS identity_method, '1.0.0' AS identity_method_version, candidate AS source_selection_candidate_id, sample_id, technology, sample_id AS platform, technology AS pipeline_name, experiment AS experiment_id,
l.run AS benchmark_run_id, c_mktsegment AS comparator, c_name AS comparator_version, c_mktsegment AS engine, balance AS engine_version, l.event_id, observation_id, side, raw_decision, kind AS raw_match_kind, side AS raw_variant_type, genotype AS source_genotype, raw_decision AS source_filter, artifact AS source_output_artifact_id,
o_orderpriority AS reference_artifact_id, 'phase1b_archive_sha256-' || o_orderpriority AS phase1b_archive_sha256, 'phase2c_archive_sha256-' || o_orderpriority AS phase2c_archive_sha256, 'admitted_sources_lock_sha256-' || o_orderpriority AS admitted_sources_lock_sha256, 'interval_panel_lock_sha256-' || o_orderpriority AS interval_panel_lock_sha256
FROM linked l JOIN runs USING (run) JOIN items USING (event_id) JOIN (SELECT s_nationkey, min(s_suppkey) AS candidate FROM supplier GROUP BY 1) ON s_nationkey = experiment WHERE l.variant_id = (SELECT variant_id FROM cover ORDER BY s DESC, t DESC, n DESC, variant_id LIMIT 1)""", plain=True)
def validation_product(r: Roles) -> DataFrame:
    """The same in the 30 columns of the validation phase, with the first supplier of a nation as its admitted source."""
    c = F.col
    admitted = r.raw("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("candidate_id")).join(r.experiments, c("s_nationkey") == c("experiment_id")).select(c("sample").alias("sample_id"), "technology", "candidate_id")
    return explorer.validation_product(*_product_tables(r), admitted)


# ---- ordered hash trees ---------------------------------------------------------------------

_LEAVES = """WITH rows AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, sha256(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus)::VARCHAR) AS digest FROM orders),
leaves AS (SELECT place // 256 AS node, sha256(string_agg(digest, '' ORDER BY place)) AS digest, count(*) AS n_rows, min(k) AS first, max(k) AS last FROM rows GROUP BY 1)
"""


def _ordered_orders(r: Roles) -> DataFrame:
    return r.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@query(_LEAVES + """SELECT node::BIGINT AS node, digest, n_rows, '{"o_orderkey":' || first || '}' AS first, '{"o_orderkey":' || last || '}' AS last FROM leaves""", plain=True)
def hash_tree_leaves(r: Roles) -> DataFrame:
    return hashtree.hash_tree(_ordered_orders(r), "o_orderkey", chunk=256, fan=4).filter("level = 0").drop("level")


@query(_LEAVES + """SELECT node::BIGINT AS node, '{"o_orderkey":' || first || '}' AS one_first, '{"o_orderkey":' || last || '}' AS one_last, '{"o_orderkey":' || first || '}' AS other_first, '{"o_orderkey":' || last || '}' AS other_last
FROM leaves WHERE node = (SELECT min(place // 256) FROM rows JOIN orders ON o_orderkey = k WHERE o_custkey = (SELECT max(o_custkey) FROM orders))""", plain=True)
def first_difference(r: Roles) -> DataFrame:
    """The range of keys in which a second build, with another priority for one customer's orders, first differs."""
    rows = _ordered_orders(r)
    last = rows.agg(F.max("o_custkey").alias("last"))
    other = rows.join(last, F.col("o_custkey") == F.col("last"), "left").withColumn("o_orderpriority", F.when(F.col("last").isNotNull(), "changed").otherwise(F.col("o_orderpriority"))).drop("last")
    trees = [hashtree.hash_tree(df, "o_orderkey", chunk=256, fan=4) for df in (rows, other)]
    return hashtree.first_difference(*trees, fan=4)
