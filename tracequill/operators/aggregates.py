"""Counts, reconciliations and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of each table; one aggregation each, whose rows are put together."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def distinct_counts(df: DataFrame, columns: dict[str, str], by: str | None = None) -> DataFrame:
    """Exact numbers of distinct values: name -> column, over all rows or by a key.

    By a key, rows are dealt once by it, and their values are told apart where they lie.
    """
    if by is None:
        return df.agg(*[F.count_distinct(c).alias(name) for name, c in columns.items()])
    rows = _apart(df.repartition(by), by, {f"__v{i}": F.col(c) for i, c in enumerate(columns.values())}).distinct()
    return rows.groupBy(by).agg(*[F.count(f"__v{i}").alias(name) for i, name in enumerate(columns)])


def _apart(df: DataFrame, by: str, values: dict[str, Column]) -> DataFrame:
    """A row for each value of each row, with the other values null."""
    kinds = dict(df.select(*[c.alias(name) for name, c in values.items()]).dtypes)
    cells = [F.struct(*[(c if name == own else F.lit(None).cast(kinds[name])).alias(name) for name, c in values.items()]) for own in values]
    return df.select(by, F.explode(F.array(*cells)).alias("__x")).select(by, "__x.*")


def zero_filled(dimension: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """key of the dimension with each table's number of rows for it, 0 where it has none."""
    out = dimension.select(key)
    for name, df in counts.items():
        n = df.groupBy(F.col(key).alias(f"__{name}")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def reconcile(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, n_a, n_b of the groups whose numbers of rows differ; null keys count as equal."""
    one = lambda df, of_a: df.select(*keys, F.lit(of_a).alias("__a"))
    rows = one(a, True).unionByName(one(b, False)).groupBy(*keys)
    return rows.agg(F.count_if("__a").alias("n_a"), F.count_if(~F.col("__a")).alias("n_b")).filter("n_a <> n_b")


def joined_set(c: str | Column) -> Column:
    """Sorted distinct values, nulls left out, joined by ;."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ";")


def best_covered(df: DataFrame, key: str, samples: str, technologies: str, links: str, largest_id: bool) -> DataFrame:
    """The row of the key with the most samples, then technologies, then links; ties go to one end of the keys."""
    counts = df.groupBy(key).agg(F.count_distinct(samples).alias("n_samples"), F.count_distinct(technologies).alias("n_technologies"), F.count_distinct(links).alias("n_links"))
    tie = F.col(key).desc() if largest_id else F.col(key).asc()
    return counts.orderBy(F.desc("n_samples"), F.desc("n_technologies"), F.desc("n_links"), tie).limit(1)


def variant_rollup(links: DataFrame, events: DataFrame, key: str = "variant_id") -> DataFrame:
    """Per variant: linked events, observations, sorted sets of samples and technologies. Sets are collected of values that were told apart before."""
    texts = {f"__{c}": F.col(c).cast("string") for c in ("sample", "technology")}
    rows = _apart(links.join(events, "event_id").repartition(key), key, {"__event": F.col("event_id"), **texts, "__n": F.col("n_observations")})
    rows = rows.groupBy(key, "__event", *texts).agg(F.sum("__n").alias("__n"))
    sets = [F.array_join(F.array_sort(F.collect_list(c)), ";").alias(name) for c, name in zip(texts, ("samples", "technologies"), strict=True)]
    return rows.groupBy(key).agg(F.count("__event").alias("n_events"), F.sum("__n").alias("n_observations"), *sets)


def event_search_index(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Per event the sorted raw decisions and types of its observations, for search."""
    o = observations.groupBy(F.col("event_id").alias("o_event")).agg(joined_set("raw_decision").alias("raw_decisions"), joined_set("raw_variant_type").alias("raw_variant_types"), F.count(F.lit(1)).alias("n_observations"))
    return events.join(o, F.col("event_id") == F.col("o_event"), "left").drop("o_event")


def provenance_index(links: DataFrame) -> DataFrame:
    """Per entity, at either end of a link, the sorted distinct link ids."""
    ends = F.explode(F.array(F.struct(F.col("source_entity_type").alias("entity_type"), F.col("source_entity_id").alias("entity_id")), F.struct(F.col("target_entity_type").alias("entity_type"), F.col("target_entity_id").alias("entity_id"))))
    rows = links.select("provenance_link_id", ends.alias("e")).select("provenance_link_id", "e.*")
    return rows.groupBy("entity_type", "entity_id").agg(joined_set("provenance_link_id").alias("provenance_link_ids"))


def samples_with_all(df: DataFrame, sample: str, value: str, wanted: list[str]) -> DataFrame:
    """Samples whose set of values holds all wanted ones."""
    sets = df.groupBy(sample).agg(F.collect_set(value).alias("found"))
    return sets.filter(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "found")) == 0).select(sample)


def conditional_counts(df: DataFrame, conditions: dict[str, Column], by: str | None = None) -> DataFrame:
    found = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()]]
    return df.groupBy(by).agg(*found) if by else df.agg(*found)
