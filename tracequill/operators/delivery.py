"""Static delivery of the explorer: evidence shards, a shard index and a search index that agree with each other.

The evidence is written once, a file for each shard in a fixed order (or several that follow each other), and is read back; what a run of the write has seen
(rows and a checksum, observed at the write) must be what is read. Both indices are made from what was read back, so they
speak of files that are there, and are compared with the model that came in: no event or observation may be lost, doubled or
spread over shards. Everything is checked before a reader can see it; a finding fails the delivery.

The model's tables, beside other columns:
    events: event_id, identity_state, variant_id, observation_count, and EVENT_FIELDS
    observations: observation_id, event_id, sample_id, technology, raw_decision, raw_variant_type
    variants: variant_id and ALLELE_FIELDS
    unresolved: event_id
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.operators import gates
from tracequill.sources import readers, sinks

# The states of an event's identity, the fields of search records, and the most bytes of a file.
EXACT, UNRESOLVED, NOT_EVALUATED = "EXACT_NORMALIZED_ALLELE", "UNRESOLVED", "NOT_EVALUATED_FOR_CROSS_RUN_IDENTITY"
STATES = (EXACT, UNRESOLVED, NOT_EVALUATED)
EVENT_FIELDS = ("phase_origin", "assembly", "contig", "start_0based", "end_0based")
ALLELE_FIELDS = ("normalized_start_0based", "normalized_end_0based", "normalized_ref", "normalized_alt")
MOST_BYTES = 20 * 1024 * 1024


@dataclass
class Model:
    events: DataFrame
    observations: DataFrame
    variants: DataFrame
    unresolved: DataFrame


def evidence_shard(event_id: Column, digits: int = 2) -> Column:
    """The place of an event's evidence, which depends on its id alone."""
    return F.concat(F.lit("evidence/"), canonical.shard_key(event_id.cast("string"), digits), F.lit(".json"))


def _doubles(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).count().filter((F.col("count") > 1) | F.col("key").isNull()).select(F.lit(rule).alias("rule"), "key")


def _may_be_doubled(df: DataFrame, key: str) -> bool:
    """Whether two rows' keys share a hash, or one is null. Hashes are a fraction of long keys when they are dealt."""
    mark = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).alias("mark")
    return not df.select(mark).groupBy("mark").count().filter((F.col("count") > 1) | F.col("mark").isNull()).isEmpty()


def _of_events(observations: DataFrame) -> DataFrame:
    """What the observations of each event say together."""
    distinct = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    return observations.groupBy(F.col("event_id").alias("o_event")).agg(
        F.count(F.lit(1)).alias("n"), distinct("raw_decision").alias("raw_decisions"), distinct("raw_variant_type").alias("raw_variant_types"),
        *[f(F.col(c)).alias(f"{n}_{c}") for c in ("sample_id", "technology") for n, f in (("least", F.min), ("most", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("sample_id", "technology")],
    )


def model_violations(model: Model) -> DataFrame:
    """rule and key of everything that keeps a model from being delivered."""
    events, text = model.events, lambda c: F.col(c).cast("string")
    named = model.observations.withColumn("unresolved", F.lit(False)).unionByName(model.unresolved.select("event_id", F.lit(True).alias("unresolved")), allowMissingColumns=True)
    named = named.groupBy(F.col("event_id").alias("o_event")).agg(
        F.count_if(~F.col("unresolved")).alias("n"), F.bool_or("unresolved").alias("named"), *[f(F.col(c)).alias(f"{n}_{c}") for c in ("sample_id", "technology") for n, f in (("least", F.min), ("most", F.max))],
        *[F.count_if(~F.col("unresolved") & F.col(c).isNull()).alias(f"no_{c}") for c in ("sample_id", "technology")],
    )
    seen = events.join(named, F.col("event_id") == F.col("o_event"), "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "named": F.coalesce("named", F.lit(False))})
    here, state, some = F.col("event_id").isNotNull(), F.col("identity_state"), F.col("n") > 0
    uneven = lambda c: here & some & ((F.col(f"no_{c}") > 0) | ~F.col(f"least_{c}").eqNullSafe(F.col(f"most_{c}")))
    rules = {
        "OBSERVATION_WITHOUT_EVENT": ~here & some,
        "EVENT_WITHOUT_EVIDENCE": here & ~some,
        "OBSERVATION_COUNT": here & some & ~F.col("n").eqNullSafe(F.col("observation_count")),
        "SAMPLES_DISAGREE": uneven("sample_id"),
        "TECHNOLOGIES_DISAGREE": uneven("technology"),
        "IDENTITY_STATE": here & ~F.coalesce(state.isin(*STATES), F.lit(False)),
        "VARIANT_WITHOUT_EXACT": here & (state != EXACT) & F.col("variant_id").isNotNull(),
        "UNRESOLVED_WITHOUT_EVENT": ~here & F.col("named"),
        "UNRESOLVED_SET": here & ((F.coalesce(state, F.lit("")) == UNRESOLVED) != F.col("named")),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(rule)) for rule, broken in rules.items()])))
    parts = [seen.select(found.alias("rule"), F.coalesce(text("event_id"), text("o_event")).alias("key"))]
    exact = events.filter(here & (state == EXACT)).select("event_id", "variant_id").join(model.variants.select("variant_id"), "variant_id", "left_anti")
    parts += [exact.select(F.lit("EXACT_WITHOUT_VARIANT").alias("rule"), text("event_id").alias("key")), _doubles(events, "event_id", "DUPLICATE_EVENT"), _doubles(model.variants, "variant_id", "DUPLICATE_VARIANT")]
    if _may_be_doubled(model.observations, "observation_id"):
        parts.append(_doubles(model.observations, "observation_id", "DUPLICATE_OBSERVATION"))
    return reduce(DataFrame.unionByName, parts)


def search_records(model: Model, evidence: DataFrame, digits: int = 2) -> DataFrame:
    """A record an event: its place, state, what its evidence says, and its allele where it has an exact one."""
    exact = model.events.filter(F.col("identity_state") == EXACT).select(F.col("event_id").alias("x_event"), "variant_id")
    alleles = exact.join(model.variants.select("variant_id", *ALLELE_FIELDS), "variant_id").drop("variant_id")  # whole events are dealt by their id alone
    rows = model.events.join(_of_events(evidence), F.col("event_id") == F.col("o_event")).join(alleles, F.col("event_id") == F.col("x_event"), "left")
    return rows.select(
        "event_id", evidence_shard(F.col("event_id"), digits).alias("evidence_shard"), "variant_id", "identity_state", *EVENT_FIELDS,
        F.col("least_sample_id").alias("sample_id"), F.col("least_technology").alias("technology"), "raw_decisions", "raw_variant_types", F.col("n").alias("observation_count"), *ALLELE_FIELDS,
    )


@dataclass
class Delivered:
    """What a delivery wrote, read back: tables, the manifest's rows and its checksums."""

    search: DataFrame
    shards: DataFrame
    evidence: DataFrame
    manifest: DataFrame
    checksums: DataFrame


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """shard and value of each line of the evidence that is there; a shard's name is text, whatever it looks like."""
    return spark.read.schema("value string, shard string").text(f"{folder}/evidence")


def _ordered(df: DataFrame, path: str, *order: str, compression: str = "none") -> None:
    """Canonical JSON lines in files that follow each other by ``order``."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(canonical.row_json(df, ascii=False).alias("value")).write.text(path, compression=compression)


def _refuse(rows: DataFrame) -> None:
    """Fail with some of the findings and the number of each rule's."""
    if first := rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).orderBy("rule").limit(20).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.n}, as {r.key}" for r in first))


def write(model: Model, folder: str, digits: int = 2, most_bytes: int = MOST_BYTES, divide: bool = False, compression: str = "none") -> Delivered:
    """Check the model, write its evidence once, and make the indices from what was written.

    A shard of more than ``most_bytes`` fails before anything is written; more digits make more and smaller shards. With ``divide``
    such a shard is written to several files of ``most_bytes`` at most, and only a line of more fails. With ``compression`` (gzip) files are stored
    packed, as a web server hands them out; sizes and digests of shards stay those of their lines.
    """
    spark = model.events.sparkSession
    _refuse(model_violations(model))
    if names := sorted({n for df in (model.events, model.observations, model.variants) for n in gates.forbidden_fields(df)}):
        raise ValueError(f"forbidden fields: {names}")
    # Rows are dealt as columns; their text, which names every field, is made where it is written.
    columns = model.observations.columns
    rows = model.observations.select(canonical.shard_key(F.col("event_id").cast("string"), digits).alias("shard"), F.struct(*columns).alias("o"))
    lined = lambda df: df.select("shard", canonical.canonical_json({c: F.col("o")[c] for c in columns}, ascii=False).alias("value"))
    size = F.octet_length("value") + 1
    sizes = lined(rows).groupBy("shard").agg(F.sum(size).alias("n_bytes"), F.max(size).alias("n_line"))
    over = F.when(F.col("n_line" if divide else "n_bytes") > most_bytes, F.struct("shard", "n_bytes", "n_line"))
    large = sizes.agg(F.max("n_bytes").alias("n_bytes"), F.max("n_line").alias("n_line"), F.min(over).alias("over")).first()
    if (most := large["over"]) is not None:
        raise ValueError(f"shard {most['shard']} has {most['n_bytes']} bytes, {most['n_line']} of them in a line")
    lines = most_bytes // large["n_line"] if (large["n_bytes"] or 0) > most_bytes else 0  # 0: as many as there are
    seen, mark = Observation(), F.xxhash64("shard", "value").cast("decimal(38,0)")
    rows = lined(rows.repartition("shard").sortWithinPartitions("shard", "o.event_id", "o.observation_id"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(mark), F.lit(0).cast("decimal(38,0)")).alias("checksum"))
    rows.write.option("maxRecordsPerFile", lines).partitionBy("shard").text(f"{folder}/evidence", compression=compression)

    back = _read(spark, folder)
    evidence = back.select("shard", F.from_json("value", model.observations.schema).alias("o")).select("shard", "o.*")
    _refuse(_read_back(model, back, evidence, seen.get, mark, digits))
    search = search_records(model, evidence, digits)
    _ordered(search, f"{folder}/search_index", "event_id", compression=compression)
    read = lambda name, schema: spark.read.schema("value string").text(f"{folder}/{name}").select(F.from_json("value", schema).alias("s")).select("s.*")
    found = read("search_index", search.schema)
    _ordered(found.select("event_id", "evidence_shard"), f"{folder}/shard_index", "event_id", compression=compression)
    shards = read("shard_index", search.select("event_id", "evidence_shard").schema)
    _refuse(_indices(model, evidence, found, shards, digits))
    checksums = sinks.checksum_manifest(spark, folder)
    return Delivered(found, shards, evidence, manifest(model, found, back), checksums)


def _read_back(model: Model, back: DataFrame, evidence: DataFrame, seen: dict, mark: Column, digits: int) -> DataFrame:
    """rule and key: rows that differ from what the write has seen, lost and doubled observations, events in a wrong shard or in several."""
    now = back.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(mark), F.lit(0).cast("decimal(38,0)")).alias("checksum"))
    differs = now.filter((F.col("n_rows") != F.lit(seen["n_rows"])) | (F.col("checksum") != F.lit(seen["checksum"]).cast("decimal(38,0)"))).select(F.lit("WRITTEN_DIFFERS").alias("rule"), F.col("n_rows").cast("string").alias("key"))
    shard, own, there = F.col("shard"), model.observations.select("event_id", "observation_id"), evidence.select("event_id", "observation_id", "shard")
    rows = own.withColumn("side", F.lit(1)).unionByName(there.withColumn("side", F.lit(-1)), allowMissingColumns=True)
    places = rows.groupBy("event_id").agg(
        F.sum("side").alias("more"), F.bit_xor(F.xxhash64("observation_id")).alias("unlike"), F.bool_or(F.col("observation_id").isNull()).alias("unnamed"), F.min(shard).alias("least"), F.max(shard).alias("most"),
    )
    unlike = (F.col("more") != 0) | (F.col("unlike") != 0) | F.col("unnamed")
    spread = F.coalesce((F.col("least") != F.col("most")) | (F.col("least") != canonical.shard_key(F.col("event_id").cast("string"), digits)), F.lit(False))
    found = places.agg(F.bool_or(unlike).alias("unlike"), F.bool_or(spread).alias("spread")).first()
    parts = [differs]
    if found["spread"]:
        parts.append(places.filter(spread).select(F.lit("EVENT_SHARD").alias("rule"), F.col("event_id").cast("string").alias("key")))
    if found["unlike"]:  # some event's observations aren't those of the model: ids are compared one by one
        ids = own.select("observation_id")
        parts.append(ids.join(evidence, "observation_id", "left_anti").select(F.lit("OBSERVATION_LOST").alias("rule"), F.col("observation_id").cast("string").alias("key")))
        parts.append(evidence.join(ids, "observation_id", "left_anti").select(F.lit("OBSERVATION_STRAY").alias("rule"), F.col("observation_id").cast("string").alias("key")))
        parts.append(_doubles(evidence, "observation_id", "OBSERVATION_DOUBLED"))
    return reduce(DataFrame.unionByName, parts)


def _indices(model: Model, evidence: DataFrame, search: DataFrame, shards: DataFrame, digits: int) -> DataFrame:
    """rule and key of events that an index lacks, has twice or has with another shard, and of evidence that no record counts."""
    key, n = F.col("event_id").cast("string").alias("key"), lambda *names: [F.lit(int(x in names)).alias(x) for x in ("own", "in_search", "in_shard")]
    wrong = lambda name: F.coalesce(F.col("evidence_shard") != evidence_shard(F.col("event_id"), digits), F.lit(False)).alias(name)
    no = lambda name: F.lit(False).alias(name)
    rows = model.events.select(key, *n("own"), no("wrong_search"), no("wrong_shard"), F.lit(0).cast("long").alias("counted"))
    rows = rows.unionByName(search.select(key, *n("in_search"), wrong("wrong_search"), no("wrong_shard"), F.coalesce(F.col("observation_count").cast("long"), F.lit(-1)).alias("counted")))
    rows = rows.unionByName(shards.select(key, *n("in_shard"), no("wrong_search"), wrong("wrong_shard"), F.lit(0).cast("long").alias("counted")))
    rows = rows.unionByName(evidence.select(key, *n(), no("wrong_search"), no("wrong_shard"), F.lit(-1).cast("long").alias("counted")))
    events = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("own", "in_search", "in_shard", "counted")], *[F.bool_or(c).alias(c) for c in ("wrong_search", "wrong_shard")])
    rules = {"COUNT_DIFFERS": (F.col("in_search") < 2) & (F.col("counted") != 0)}
    for name, there, other in (("SEARCH", "in_search", "wrong_search"), ("SHARD", "in_shard", "wrong_shard")):
        rules |= {
            f"{name}_INDEX_LACKS": (F.col("own") > 0) & (F.col(there) == 0), f"{name}_INDEX_STRAY": (F.col("own") == 0) & (F.col(there) > 0),
            f"{name}_INDEX_DOUBLED": (F.col(there) > 1) | (F.col("key").isNull() & (F.col(there) > 0)), f"{name}_INDEX_SHARD": F.col(other),
        }
    return events.select(F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))).alias("rule"), "key")


def manifest(model: Model, search: DataFrame, back: DataFrame) -> DataFrame:
    """name and value of the delivery's counts, states, samples, technologies and the largest shard."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), "value")
    states = search.groupBy("identity_state").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("identity_state:"), "identity_state").alias("name"), "value")
    values = [search.select(F.lit(f"{c}_value").alias("name"), F.col(c).cast("string").alias("value")).distinct() for c in ("sample_id", "technology")]
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    largest = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most")).select(F.explode(F.create_map(F.lit("shard_count"), F.col("n").cast("string"), F.lit("maximum_shard_byte_size"), F.col("most").cast("string"))).alias("name", "value"))
    return reduce(DataFrame.unionByName, (count(search, "event_count"), count(back, "observation_count"), count(model.variants, "variant_count"), states, *values, largest))


def shard_digests(spark: SparkSession, folder: str) -> DataFrame:
    """evidence_shard, size_bytes and sha256 of each shard's file, or of its files as one."""
    shard = F.concat(F.lit("evidence/"), F.regexp_extract("path", "shard=([0-9a-f]+)/", 1), F.lit(".json")).alias("evidence_shard")
    place = F.regexp_extract("path", r"[.]c([0-9]+)[.][^/]*$", 1).try_cast("long").alias("place")
    rows = readers.joined_hashes(spark, f"{folder}/evidence", shard, place)
    return rows.select("evidence_shard", "size_bytes", "sha256")


def build_differences(spark: SparkSession, one: str, other: str) -> DataFrame:
    """Parts of two deliveries (evidence shards, and the indices as a whole) whose bytes differ or that one of them lacks."""
    def parts(folder: str) -> DataFrame:
        shards = shard_digests(spark, folder).select(F.col("evidence_shard").alias("part"), "sha256")
        lines = [spark.read.schema("value string").text(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("sum")).select(F.lit(n).alias("part"), F.concat_ws(":", "n", "sum").alias("sha256")) for n in ("search_index", "shard_index")]
        return reduce(DataFrame.unionByName, (shards, *lines))

    a, b = parts(one), parts(other).select(F.col("part").alias("b_part"), F.col("sha256").alias("b_sha"))
    return a.join(b, F.col("part") == F.col("b_part"), "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("b_sha"))).select(F.coalesce("part", "b_part").alias("part"))
