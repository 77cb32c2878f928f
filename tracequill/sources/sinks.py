"""Sinks: checked Parquet, ordered text forms, canonical JSON lines, hash shards, staged publication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.functions.text import karyotype_key

MOST_SHARD_BYTES = 20 << 20


def parquet(df: DataFrame, path: str, key: str | None = None) -> int:
    """Write zstd Parquet and count the rows that are read back; the counts must agree, and with a key its values."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path).count()
    if back != seen.get["n"]:
        raise ValueError(f"{seen.get['n']} rows written, {back} read")
    if key:
        read = df.sparkSession.read.parquet(path).select(key)
        if (lost := df.select(key).exceptAll(read).unionAll(read.exceptAll(df.select(key))).first()) is not None:
            raise ValueError(f"{key} {lost[0]} is not both written and read")
    return back


def _text(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")


def tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated text with the columns in a fixed order; nulls are empty, lists compact JSON."""
    if set(columns) != set(df.columns):
        raise ValueError(f"columns {df.columns} are not {columns}")
    kinds = dict(df.dtypes)
    cells = [F.coalesce(_text(F.col(c), kinds[c]), F.lit("")).alias(c) for c in columns]
    df.select(*cells).write.csv(path, sep="\t", header=True, emptyValue="", quote='"', escape='"')


def json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Canonical JSON, one row a line, in a total order over the files."""
    df.orderBy(*order).select(canonical.row_json(df, ascii=False).alias("value")).write.text(path)


def json_array(df: DataFrame, path: str, *order: str) -> int:
    """One canonical JSON array of all rows in a total order and a line end, in one file; the number of rows.

    The array is one value, so it is for bounded tables alone (a summary, an index); json_lines() takes any.
    """
    keys = F.struct(*[F.col(c) for c in order])
    rows = df.select(F.struct(keys.alias("key"), canonical.row_json(df, ascii=False).alias("value")).alias("r"))
    whole = rows.agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["value"]).alias("values"))
    whole.select(F.concat(F.lit("["), F.array_join("values", ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return df.count()


def json_summary(spark: SparkSession, summary: dict, path: str) -> str:
    """A small summary as indented JSON with sorted keys and a line end, in one file; its text."""
    import json

    text = json.dumps(summary, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return text + "\n"


def registry(spark: SparkSession, tables: dict[str, DataFrame], database: str) -> list[str]:
    """Tables of a database in Spark's catalog, zstd Parquet; their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").format("parquet").saveAsTable(f"`{database}`.`{name}`")
    return [f"{database}.{name}" for name in tables]


def bed(df: DataFrame, path: str) -> None:
    """contig, start, end in karyotype order."""
    rows = df.orderBy(karyotype_key(F.col("contig")), "start", "end")
    rows.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")).write.text(path)


def sharded_json(df: DataFrame, path: str, identity: str, most_bytes: int = MOST_SHARD_BYTES) -> DataFrame:
    """Canonical JSON lines by the first two hex digits of sha256(identity); n_rows and bytes of each shard.

    Too large a shard fails before anything is written.
    """
    rows = df.select(canonical.shard_key(F.col(identity)).alias("shard"), canonical.row_json(df, ascii=False).alias("value"), F.col(identity).alias("__id"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    if (large := sizes.filter(F.col("n_bytes") > most_bytes).first()) is not None:
        raise ValueError(f"shard {large['shard']} has {large['n_bytes']} bytes")
    rows.repartition("shard").sortWithinPartitions("shard", "__id").select("shard", "value").write.partitionBy("shard").text(path)
    return sizes


def checksum_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, path below the folder and size_bytes of every file in it, sorted by path."""
    from .readers import file_hashes, relative

    rows = file_hashes(spark, folder)
    return rows.select("sha256", relative(F.col("path"), folder).alias("path"), "size_bytes").orderBy("path")


def manifest_violations(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, violation of a folder against a manifest (path, sha256) that was stored: MISSING, CHANGED or UNLISTED files."""
    seen = checksum_manifest(spark, folder).select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"))
    rows = manifest.select("path", "sha256").join(seen, F.col("path") == F.col("f_path"), "full_outer")
    what = F.when(F.col("f_path").isNull(), F.lit("MISSING")).when(F.col("path").isNull(), F.lit("UNLISTED")).when(F.col("f_sha") != F.col("sha256"), F.lit("CHANGED"))
    return rows.select(F.coalesce("path", "f_path").alias("path"), what.alias("violation")).filter("violation is not null")


def publish(spark: SparkSession, target: str, build, validate) -> None:
    """Build into a staging folder, validate it, then put it in the target's place; on an error the target is as before."""
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging, previous = f"{target}.staging-{uuid.uuid4().hex}", f"{target}.previous-{uuid.uuid4().hex}"
    moved = False
    try:
        build(staging)
        validate(staging)
        if files.exists(path(target)):
            moved = files.rename(path(target), path(previous))
            if not moved:
                raise OSError(f"{target} couldn't be moved away")
        if files.exists(path(target)) or not files.rename(path(staging), path(target)):
            raise OSError(f"{staging} couldn't take the place of {target}")
    except BaseException:
        if moved:
            files.rename(path(previous), path(target))
        files.delete(path(staging), True)
        raise
    if moved:
        files.delete(path(previous), True)
