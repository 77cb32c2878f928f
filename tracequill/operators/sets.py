"""Set operations with the checks that registries want: disjoint ids, origins, conflicts, first wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_by_phase(parts: dict[str, DataFrame], name: str = "phase") -> DataFrame:
    """All rows with the name of the part they are from; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of a whose key b hasn't; a null key is missing."""
    return a.join(b.select(F.col(other or key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")


def present(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return a.join(b.select(F.col(other or key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which side."""
    left, right = a.select(F.col(key).alias("a")).distinct(), b.select(F.col(key).alias("b")).distinct()
    rows = left.join(right, F.col("a") == F.col("b"), "full_outer").filter("a is null or b is null")
    return rows.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), F.lit("LEFT")).otherwise(F.lit("RIGHT")).alias("only_in"))


def union_with_origin(a: DataFrame, b: DataFrame, key: str, content: list[str], names: tuple[str, str, str]) -> DataFrame:
    """key, content, origin (first, second, both) and conflict: rows of both sides with one key must agree."""
    x = a.select(F.col(key).alias("a_key"), F.struct(*content).alias("a_content"))
    y = b.select(F.col(key).alias("b_key"), F.struct(*content).alias("b_content"))
    rows = x.join(y, F.col("a_key") == F.col("b_key"), "full_outer")
    origin = F.when(F.col("b_key").isNull(), F.lit(names[0])).when(F.col("a_key").isNull(), F.lit(names[1])).otherwise(F.lit(names[2]))
    conflict = F.col("a_key").isNotNull() & F.col("b_key").isNotNull() & ~F.col("a_content").eqNullSafe(F.col("b_content"))
    content_of = F.coalesce("a_content", "b_content")
    return rows.select(F.coalesce("a_key", "b_key").alias(key), *[content_of[c].alias(c) for c in content], origin.alias("origin"), conflict.alias("conflict"))


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in a total order, with the number of rows that lost.

    A minimum of structs is aggregated before rows are dealt, so a hot key costs no sort.
    """
    names = [c for c in df.columns if c != key]
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    first = F.min(F.struct(*[r.alias(f"__{i}") for i, r in enumerate(ranks)], F.struct(*names).alias("row")))
    rows = df.groupBy(key).agg(first.alias("f"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return rows.select(key, "f.row.*", "n_duplicates")


def content_conflicts(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Keys that stand for more than one content."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*content)).alias("n_contents")).filter("n_contents > 1")


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def checked_limits(per_key: int, keys: int, most: int = 100, total: int = 400) -> int:
    """per_key, if it is from 1 to most and makes up total at most over all keys; else an error."""
    if not 1 <= per_key <= most:
        raise ValueError(f"a limit of {per_key} is not from 1 to {most}")
    if per_key * keys > total:
        raise ValueError(f"{keys} keys with {per_key} rows each are over {total}")
    return per_key


def pages(df: DataFrame, key: str, per_key: int, keys: int, *order: str | Column, most: int = 100, total: int = 400) -> DataFrame:
    """The first rows of each key in an order, so many as checked_limits() lets pass."""
    n = checked_limits(per_key, keys, most, total)
    return ranked(df, "__rank", [key], *order).filter(F.col("__rank") <= n).drop("__rank")


def ranked(df: DataFrame, name: str, by: list[str], *order: str | Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
