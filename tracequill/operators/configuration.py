"""Integrity of configurations beyond their schemas: taxonomy, organisms and lookups, sources, lifecycle policy, model policy.

A configuration is a set of tables (``listed`` makes them from its JSON document). Each check returns rows (rule, key): key is the id
of what is wrong, with the value that makes it wrong after a bar where it isn't the id alone. Nothing is compared row by row on the
driver; checks are joins, groups and, for reachability, a frontier that grows until it stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.sources.storage import cut

Tables = dict[str, DataFrame]

# What models may never decide, and methods that never back a hard gate.
PROHIBITED = ("hard_eligibility_gate", "biological_truth", "benchmark_truth", "validation_outcome", "release_inclusion", "clinical_interpretation", "technology_ranking", "caller_ranking", "trust_score")
NON_AUTHORITATIVE = ("ML_PROPOSED", "UNRESOLVED")
#: The states that a state may be entered from (all of them), and those that it may be left for (at most).
ENTERED_EXACTLY = {"RELEASED": ("VALIDATED",), "VALIDATED": ("VALIDATION_PENDING",)}
ENTERED_AT_MOST = {"VALIDATION_PENDING": ("ELIGIBLE", "VALIDATION_FAILED")}
LEFT_AT_MOST = {"WITHDRAWN": (), "RELEASED": ("WITHDRAWN",)}
DERIVED_CRITERION = "E13"


def listed(document: DataFrame, path: str, schema: str) -> DataFrame:
    """The rows of a list in a configuration's JSON text (column value), as a table of this schema."""
    items = F.from_json(F.get_json_object("value", f"$.{path}"), f"array<struct<{schema}>>")
    return document.select(F.explode(items).alias("x")).select("x.*")


def _rows(df: DataFrame, rule: str, *key: str | Column) -> DataFrame:
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *parts).alias("key"))


def _lost(df: DataFrame, column: str, to: DataFrame, to_key: str, rule: str, *key: str) -> DataFrame:
    """Rows whose value isn't a key of the other table; null has none."""
    return _rows(df.join(to.select(F.col(to_key).alias("__k")), F.col(column) == F.col("__k"), "left_anti"), rule, *key)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- taxonomy ---------------------------------------------------------------------------------

LEVELS = ("technology_families", "vendors", "instrument_families", "instrument_models", "chemistries", "read_modes", "basecallers")


def taxonomy_errors(t: Tables) -> DataFrame:
    """Tables: the LEVELS (id, and by level label, vendor_id, technology_family_id, instrument_family_id, source_aliases, family_level_aliases,
    technology_family_ids) and platform_terms (term, vendor_id, technology_family_id).

    An alias belongs to the first that claims it, models before families, by id; each other claim is an error.
    """
    families, vendors, instruments, models = (t[n] for n in LEVELS[:4])
    parts = [_rows(t[n].groupBy("id").count().filter("count > 1"), "DUPLICATE_ID", F.lit(n), "id") for n in LEVELS if n in t]

    tokens = families.select(F.explode(F.array(F.lower(F.col("id").cast("string")), F.lower("label"))).alias("token")).distinct()
    for level in ("vendors", "instrument_families", "instrument_models"):
        own = t[level].select("id", F.explode(F.array(F.lower(F.col("id").cast("string")), F.lower("label"))).alias("token"))
        parts.append(_rows(own.join(tokens, "token", "left_semi").select("id").distinct(), "LEVEL_CONFLATED", F.lit(level), "id"))

    parts += [
        _lost(instruments, "vendor_id", vendors, "id", "INSTRUMENT_VENDOR_UNKNOWN", "id"), _lost(instruments, "technology_family_id", families, "id", "INSTRUMENT_TECHNOLOGY_UNKNOWN", "id"), _lost(models, "instrument_family_id", instruments, "id", "MODEL_FAMILY_UNKNOWN", "id"),
    ]

    claim = lambda df, place, aliases: df.select(F.explode(F.transform(aliases, F.lower)).alias("alias"), F.lit(place).alias("place"), F.col("id").alias("owner"))
    claims = claim(models, 1, F.concat(F.array("label"), "source_aliases")).unionByName(claim(instruments, 2, "family_level_aliases")).distinct()
    first = claims.groupBy("alias").agg(F.min(F.struct("place", "owner")).alias("first"))
    parts.append(_rows(claims.join(first, "alias").filter(F.struct("place", "owner") != F.col("first")), "ALIAS_CLAIMED_TWICE", "alias", F.when(F.col("place") == 1, "model").otherwise("family"), "owner"))

    pairs = instruments.select(F.col("vendor_id").alias("v"), F.col("technology_family_id").alias("f")).distinct()
    for level in ("chemistries", "basecallers"):
        if level in t:
            none = t[level].join(pairs, (F.col("vendor_id") == F.col("v")) & (F.col("technology_family_id") == F.col("f")), "left_anti")
            parts.append(_rows(none, "PAIR_WITHOUT_INSTRUMENT", F.lit(level), "id"))
    if "read_modes" in t:
        parts.append(_lost(t["read_modes"].select("id", F.explode("technology_family_ids").alias("f")), "f", families, "id", "READ_MODE_TECHNOLOGY_UNKNOWN", "id", "f"))
    if "platform_terms" in t:
        parts += _term_errors(t["platform_terms"], vendors, pairs)
    return _together(parts)


def _term_errors(terms: DataFrame, vendors: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """A term names a technology exactly if its vendor has that one alone."""
    of_vendor = pairs.groupBy(F.col("v").alias("of")).agg(F.count_distinct("f").alias("n"))
    seen = terms.join(of_vendor, F.col("vendor_id") == F.col("of"), "left").join(pairs, (F.col("vendor_id") == F.col("v")) & (F.col("technology_family_id") == F.col("f")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    named = F.col("technology_family_id").isNotNull()
    return [
        _lost(terms, "vendor_id", vendors, "id", "TERM_VENDOR_UNKNOWN", "term"), _rows(seen.filter(~named & (F.col("n") < 2)), "TERM_NULL_BUT_UNAMBIGUOUS", "term"), _rows(seen.filter(named & F.col("f").isNull()), "TERM_TECHNOLOGY_OF_NO_INSTRUMENT", "term"),
        _rows(seen.filter(named & F.col("f").isNotNull() & (F.col("n") > 1)), "TERM_NAMES_ONE_OF_SEVERAL", "term"), _rows(terms.groupBy("term").count().filter("count > 1"), "DUPLICATE_TERM", "term"),
    ]


# ---- organisms and lookups --------------------------------------------------------------------


def organism_errors(t: Tables) -> DataFrame:
    """Tables: organisms (taxonomy_id, scientific_name, rank, parent_taxonomy_id), assemblies (assembly_id, taxonomy_id, assembly_name, insdc_accession,
    refseq_accession, ucsc_db, insdc_status, refseq_status), sequence_sets (sequence_set_id, assembly_id)."""
    organisms, assemblies, sets = t["organisms"], t["assemblies"], t["sequence_sets"]
    accessions = assemblies.select(F.explode(F.array_compact(F.array("insdc_accession", "refseq_accession"))).alias("accession"))
    core = lambda c: F.substring(c, 5, 9)  # noqa: E731  of GCA_ and GCF_ accessions
    names = organisms.select(F.lower("scientific_name").alias("name")).distinct()
    return _together([
        _rows(organisms.groupBy("taxonomy_id").count().filter("count > 1"), "DUPLICATE_TAXON", "taxonomy_id"), _lost(organisms.filter("parent_taxonomy_id is not null"), "parent_taxonomy_id", organisms, "taxonomy_id", "PARENT_UNREGISTERED", "taxonomy_id", "parent_taxonomy_id"),
        _rows(organisms.filter("rank <> 'species' and parent_taxonomy_id is null"), "PARENT_MISSING", "taxonomy_id"), _rows(assemblies.groupBy("assembly_id").count().filter("count > 1"), "DUPLICATE_ASSEMBLY", "assembly_id"),
        _rows(accessions.groupBy("accession").count().filter("count > 1"), "ACCESSION_REUSED", "accession"), _rows(assemblies.filter("ucsc_db is not null").groupBy(F.lower("ucsc_db").alias("db")).count().filter("count > 1"), "UCSC_NAME_REUSED", "db"),
        _lost(assemblies, "taxonomy_id", organisms, "taxonomy_id", "ASSEMBLY_ORGANISM_UNKNOWN", "assembly_id"), _rows(assemblies.join(names, F.lower("assembly_id") == F.col("name"), "left_semi"), "ASSEMBLY_NAMED_AS_ORGANISM", "assembly_id"),
        _rows(assemblies.filter(core("insdc_accession") != core("refseq_accession")), "ACCESSION_CORES_DIFFER", "assembly_id"), _rows(assemblies.filter("insdc_status = 'suppressed'"), "ACCESSION_SUPPRESSED", "assembly_id"), _lost(sets, "assembly_id", assemblies, "assembly_id", "SEQUENCE_SET_ASSEMBLY_UNKNOWN", "sequence_set_id"),
    ])


def lookup_errors(t: Tables) -> DataFrame:
    """Every registered identifier against its recorded lookup, and every lookup's answer against the digest of its file.

    Tables beside those of ``organism_errors``: organism_lookups (taxonomy_id, verdict, failures, snapshot, sha256, observed: name, rank, parent),
    assembly_lookups (assembly_id, verdict, checks: list of accession, failures, snapshot, sha256, observed: name, taxonomy_id, status;
    ucsc: ucsc_db, failures) and snapshots (path, sha256: what the files have now). What isn't VERIFIED is not looked at further.
    """
    files = t["snapshots"].select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha")).distinct()
    altered = lambda df: df.join(files, (F.col("snapshot") == F.col("f_path")) & (F.col("sha256") == F.col("f_sha")), "left_anti")
    differ = lambda a, b: ~a.eqNullSafe(b)

    own, found = t["organisms"], t["organism_lookups"]
    seen = own.join(found.withColumnRenamed("taxonomy_id", "l_id"), F.col("taxonomy_id") == F.col("l_id"), "left")
    good = (F.col("verdict") == "VERIFIED") & (F.coalesce(F.size("failures"), F.lit(0)) == 0)
    verified = seen.filter(F.coalesce(good, F.lit(False)))
    parts = [
        _rows(seen.filter(~F.coalesce(good, F.lit(False))), "ORGANISM_NOT_VERIFIED", "taxonomy_id"), _rows(altered(verified), "ORGANISM_SNAPSHOT_ALTERED", "taxonomy_id"),
        _rows(verified.filter(differ(F.col("observed.name"), F.col("scientific_name")) | differ(F.lower("observed.rank"), F.lower("rank"))), "ORGANISM_DIFFERS", "taxonomy_id"),
        _rows(verified.filter(F.col("parent_taxonomy_id").isNotNull() & differ(F.col("parent_taxonomy_id"), F.col("observed.parent"))), "PARENT_DIFFERS", "taxonomy_id"),
    ]

    own, found = t["assemblies"], t["assembly_lookups"].select(F.col("assembly_id").alias("l_id"), "verdict", "checks", "ucsc")
    seen = own.join(found, F.col("assembly_id") == F.col("l_id"), "left")
    good = F.coalesce(F.col("verdict") == "VERIFIED", F.lit(False))
    verified = seen.filter(good)
    wanted = F.array(F.struct(F.col("insdc_accession").alias("accession"), F.col("insdc_status").alias("status")), F.struct(F.col("refseq_accession").alias("accession"), F.col("refseq_status").alias("status")))
    each = verified.select("assembly_id", "assembly_name", "taxonomy_id", "checks", F.explode(F.filter(wanted, lambda w: w["accession"].isNotNull())).alias("want"))
    check = F.element_at(F.filter("checks", lambda c: c["accession"] == F.col("want.accession")), -1)
    each = each.withColumn("check", F.when(F.coalesce(F.exists("checks", lambda c: c["accession"] == F.col("want.accession")), F.lit(False)), check))
    passed = F.col("check").isNotNull() & (F.coalesce(F.size("check.failures"), F.lit(0)) == 0)
    checked = each.filter(passed).select("*", "check.snapshot", "check.sha256")
    key = ("assembly_id", "want.accession")
    ucsc = F.col("ucsc").isNull() | (F.coalesce(F.size("ucsc.failures"), F.lit(0)) > 0) | differ(F.col("ucsc.ucsc_db"), F.col("ucsc_db"))
    return _together([
        *parts, _rows(seen.filter(~good), "ASSEMBLY_NOT_VERIFIED", "assembly_id"), _rows(each.filter(~passed), "ACCESSION_NOT_VERIFIED", *key), _rows(altered(checked), "ACCESSION_SNAPSHOT_ALTERED", *key),
        _rows(checked.filter(differ(F.col("check.observed.name"), F.col("assembly_name")) | differ(F.col("check.observed.taxonomy_id"), F.col("taxonomy_id"))), "ACCESSION_DIFFERS", *key),
        _rows(checked.filter(differ(F.col("check.observed.status"), F.col("want.status"))), "ACCESSION_STATUS_DIFFERS", *key), _rows(verified.filter(F.col("ucsc_db").isNotNull() & ucsc), "UCSC_NAME_NOT_VERIFIED", "assembly_id"),
    ])


# ---- sources ----------------------------------------------------------------------------------


def source_errors(t: Tables) -> DataFrame:
    """Tables: sources (source_id, mirror_group_id), mirror_groups (mirror_group_id, member_source_ids). Groups and members name each other."""
    sources, groups = t["sources"], t["mirror_groups"]
    members = groups.select("mirror_group_id", F.explode("member_source_ids").alias("member"))
    back = sources.select(F.col("source_id").alias("s_id"), F.col("mirror_group_id").alias("s_group"))
    elsewhere = members.join(back, F.col("member") == F.col("s_id")).filter(~F.col("s_group").eqNullSafe(F.col("mirror_group_id")))
    return _together([
        _rows(sources.groupBy("source_id").count().filter("count > 1"), "DUPLICATE_SOURCE", "source_id"), _lost(members, "member", sources, "source_id", "MEMBER_UNKNOWN", "mirror_group_id", "member"), _rows(elsewhere, "MEMBER_POINTS_ELSEWHERE", "mirror_group_id", "member"),
        _lost(sources.filter("mirror_group_id is not null"), "mirror_group_id", groups, "mirror_group_id", "GROUP_UNKNOWN", "source_id", "mirror_group_id"),
    ])


# ---- lifecycle policy -------------------------------------------------------------------------


def reachable(transitions: DataFrame, start: DataFrame) -> DataFrame:
    """state: all that edges (from_state, to_state) lead to from the states of ``start``, which are among them.

    Each round joins the newest states with the edges and keeps what is new; there are as many rounds as the longest of
    the shortest ways has edges.
    """
    edges = cut(transitions.select("from_state", "to_state").distinct())
    seen = frontier = cut(start.select("state").distinct())
    while True:
        step = frontier.join(edges, F.col("state") == F.col("from_state")).select(F.col("to_state").alias("state")).distinct()
        frontier = cut(step.join(seen, "state", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def predecessor_errors(transitions: DataFrame) -> DataFrame:
    """Sets of states that a state is entered from or left for, where a policy must have them so.

    A state that must be entered from some is wrong if it is entered from others, or not from all of them.
    """
    spark = transitions.sparkSession
    wanted = [(s, sorted(v), s in ENTERED_EXACTLY) for s, v in (ENTERED_EXACTLY | ENTERED_AT_MOST).items()]
    names = spark.createDataFrame(wanted, "state string, allowed array<string>, exact boolean")
    entered = transitions.groupBy(F.col("to_state").alias("state")).agg(F.collect_set("from_state").alias("has"))
    left = transitions.groupBy(F.col("from_state").alias("state")).agg(F.collect_set("to_state").alias("has"))
    none = F.array().cast("array<string>")
    enter = names.join(entered, "state", "left").withColumn("has", F.coalesce("has", none))
    leave = spark.createDataFrame([(s, sorted(v)) for s, v in LEFT_AT_MOST.items()], "state string, allowed array<string>").join(left, "state", "left").withColumn("has", F.coalesce("has", none))
    stray = F.size(F.array_except("has", "allowed")) > 0
    short = F.col("exact") & (F.size(F.array_except("allowed", "has")) > 0)
    return _rows(enter.filter(stray | short), "ENTERED_FROM", "state", F.array_join(F.array_sort("has"), ",")).unionByName(_rows(leave.filter(stray), "LEFT_FOR", "state", F.array_join(F.array_sort("has"), ",")))


def lifecycle_errors(t: Tables, initial: str) -> DataFrame:
    """Tables: states (state), layers (layer, state), transitions (from_state, to_state; to_state null where a state has none),
    criteria (id, hard) and accepted_methods (method)."""
    states, layers, table, criteria, methods = t["states"], t["layers"], t["transitions"], t["criteria"], t["accepted_methods"]
    spark, edges = states.sparkSession, table.filter("to_state is not null")
    known, layered, keys = states.select("state").distinct(), layers.select("state").distinct(), table.select(F.col("from_state").alias("state")).distinct()
    reached = reachable(edges, spark.createDataFrame([(initial,)], "state string"))
    hard = criteria.agg(F.coalesce(F.bool_or("hard"), F.lit(False)).alias("any"), F.coalesce(F.bool_or((F.col("id") == DERIVED_CRITERION) & F.col("hard")), F.lit(False)).alias("derived"))
    return _together([
        _rows(states.groupBy("state").count().filter("count > 1"), "DUPLICATE_STATE", "state"), _rows(layers.groupBy("state").count().filter("count > 1"), "STATE_IN_TWO_LAYERS", "state"),
        _rows(known.join(layered, "state", "left_anti"), "STATE_WITHOUT_LAYER", "state"), _rows(layered.join(known, "state", "left_anti"), "LAYERED_STATE_UNDECLARED", "state"),
        _rows(known.join(keys, "state", "left_anti"), "STATE_WITHOUT_TRANSITIONS", "state"), _rows(keys.join(known, "state", "left_anti"), "TRANSITIONS_OF_UNDECLARED", "state"),
        _rows(edges.join(known, F.col("to_state") == F.col("state"), "left_anti"), "TARGET_UNDECLARED", "from_state", "to_state"), _rows(edges.filter("from_state = to_state"), "SELF_TRANSITION", "from_state"), predecessor_errors(edges),
        _rows(known.join(reached, "state", "left_anti"), "STATE_UNREACHABLE", "state"), _rows(criteria.groupBy("id").count().filter("count > 1"), "DUPLICATE_CRITERION", "id"), _rows(hard.filter("not any"), "NO_HARD_CRITERION", F.lit("criteria")),
        _rows(hard.filter("not derived"), "DERIVED_CRITERION_NOT_HARD", F.lit(DERIVED_CRITERION)), _rows(methods.filter(F.col("method").isin(*NON_AUTHORITATIVE)), "METHOD_BACKS_NO_GATE", "method"),
    ])


# ---- model policy -----------------------------------------------------------------------------


def model_policy_errors(t: Tables) -> DataFrame:
    """Tables: thresholds (model, review_threshold, accept_threshold, active), models (model), prohibited_decisions (decision), allowed_tasks (task),
    methods (method, ml). A model is active if models has it; its thresholds must be active then."""
    thresholds, models, prohibited, tasks, methods = (t[n] for n in ("thresholds", "models", "prohibited_decisions", "allowed_tasks", "methods"))
    must = prohibited.sparkSession.createDataFrame([(p,) for p in PROHIBITED], "decision string")
    active = thresholds.filter("active").select(F.col("model").alias("t_model"))
    learned = methods.filter("ml")
    only = learned.agg(F.count_if(F.col("method") == NON_AUTHORITATIVE[0]).alias("n")).filter("n = 0")
    return _together([
        _rows(thresholds.filter(~F.coalesce(F.col("review_threshold") < F.col("accept_threshold"), F.lit(False))), "REVIEW_NOT_BELOW_ACCEPT", "model"), _rows(models.join(active, F.col("model") == F.col("t_model"), "left_anti"), "MODEL_WITHOUT_ACTIVE_THRESHOLDS", "model"),
        _rows(must.join(prohibited, "decision", "left_anti"), "PROHIBITION_MISSING", "decision"), _rows(tasks.join(prohibited, F.col("task") == F.col("decision"), "left_semi"), "TASK_PROHIBITED", "task"),
        _rows(learned.filter(F.col("method") != NON_AUTHORITATIVE[0]), "METHOD_NOT_TO_BE_LEARNED", "method"), _rows(only, "LEARNED_METHOD_MISSING", F.lit(NON_AUTHORITATIVE[0])),
    ])
