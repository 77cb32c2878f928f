"""Freezing and verification of sources: admitted candidates, context sets, recorded lookups, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical


def admitted(candidates: DataFrame, audit: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates with their audit; fails on the first action if a key is on one side only or not ELIGIBLE."""
    a = audit.select(F.col(key).alias("a_key"), F.col("status").alias("audit_status"), *[F.col(c).alias(f"audit_{c}") for c in audit.columns if c not in (key, "status")])
    rows = candidates.join(a, F.col(key) == F.col("a_key"), "full_outer")
    bad = F.col(key).isNull() | F.col("a_key").isNull() | (F.col("audit_status") != "ELIGIBLE")
    refuse = F.raise_error(F.concat(F.lit("not admitted: "), F.coalesce(F.col(key).cast("string"), F.col("a_key").cast("string"), F.lit("?"))))
    return rows.select(F.when(F.coalesce(bad, F.lit(True)), refuse.cast("string")).otherwise(F.col(key).cast("string")).alias(key), *[c for c in rows.columns if c not in (key, "a_key")])


def context_sets(catalogue: DataFrame, md5: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted strata of a catalogue (context_id, path) with their official md5; status tells what is missing."""
    m = md5.select(F.col("path").alias("m_path"), F.col("md5").alias("official_md5"))
    rows = catalogue.filter(F.col("context_id").isin(wanted)).join(m, F.col("path") == F.col("m_path"), "left").drop("m_path")
    return rows.withColumn("status", F.when(F.col("official_md5").isNull(), F.lit("NO_OFFICIAL_MD5")).otherwise(F.lit("FROZEN")))


def observed_md5(frozen: DataFrame, observed: DataFrame) -> DataFrame:
    """context_id, status: VERIFIED, CHANGED or MISSING by the md5 that was seen after download."""
    o = observed.select(F.col("path").alias("o_path"), F.col("md5").alias("o_md5"))
    rows = frozen.join(o, F.col("path") == F.col("o_path"), "left")
    return rows.select("context_id", F.when(F.col("o_md5").isNull(), F.lit("MISSING")).when(F.col("o_md5") == F.col("official_md5"), F.lit("VERIFIED")).otherwise(F.lit("CHANGED")).alias("status"))


def lookup_mismatches(config: DataFrame, recorded: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, configured, observed where a configuration differs from a recorded lookup, or has none."""
    r = recorded.select(F.col(key).alias("r_key"), *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    rows = config.join(r, F.col(key) == F.col("r_key"), "left")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("configured"), F.col(f"r_{c}").alias("observed")) for c in columns])
    return rows.select(key, F.explode(cells).alias("x")).select(key, "x.*").filter(~F.col("configured").eqNullSafe(F.col("observed")))


def snapshot_mismatches(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Lookups (snapshot_path, snapshot_sha256) whose snapshot isn't the file that it was."""
    f = files.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"))
    return recorded.join(f, F.col("snapshot_path") == F.col("f_path"), "left").filter(~F.col("f_sha").eqNullSafe(F.col("snapshot_sha256"))).select("snapshot_path")


def release_manifest(files: DataFrame, release: str) -> DataFrame:
    """release, path, sha256, size_bytes and an id of each file, in order of paths."""
    identity = canonical.content_id("release-file", {"release": F.lit(release), "path": F.col("path"), "sha256": F.col("sha256")})
    return files.select(F.lit(release).alias("release"), "path", "sha256", "size_bytes", identity.alias("file_id")).orderBy("path")


def duplicate_terms(taxonomy: DataFrame, key: str) -> DataFrame:
    """Terms of a vocabulary that mean more than one entry."""
    return taxonomy.groupBy(key).agg(F.count_distinct("entry_id").alias("n")).filter("n > 1").select(key)
