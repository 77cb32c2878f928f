"""The registry's roles played by the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1_704_067_200  # 2024-01-01 in seconds

#: About how many rows a task reads of a file, and gets of a table by a shuffle.
READ_ROWS, SHUFFLED_ROWS = 500_000, 250_000

#: How many bytes Spark may put together for a task of large tables: keys alone take about five bytes a row in a shuffle.
TOGETHER = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, read: int = READ_ROWS, shuffled: int = SHUFFLED_ROWS) -> DataFrame:
    """df, a Parquet table, after the session's tasks were made small enough for its rows.

    Columns of few values are small in a file, so a split of a fixed size may hold any number of rows, and a fixed number of
    shuffle partitions gets more of them with the table; what a task sorts and hashes would grow with it. Splits get smaller
    and shuffle partitions more as the table asks for it, never the other way; Spark puts small partitions together again, up to TOGETHER.
    """
    spark, n = df.sparkSession, df.count()  # of the files' footers
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    parts, split = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    if (wanted := -(-n // shuffled)) > int(spark.conf.get(parts)):
        spark.conf.set(parts, wanted)
    if n > read:
        if in_bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) > TOGETHER:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{TOGETHER}b")
        folder = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        size = max(1 << 20, sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in folder) * read // n)
        if size < in_bytes(spark.conf.get(split)):
            spark.conf.set(split, f"{size}b")
    return df


class Roles:
    """Entity tables by role; each is a projection, so pruning reaches the scans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self._sized = spark, sf_dir, set()

    def raw(self, name: str) -> DataFrame:
        df = table(self.spark, self.dir, name)
        if name not in self._sized:
            self._sized.add(name)
            sized(df)
        return df

    @property
    def experiments(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("experiment_id"), F.col("n_name").alias("sample"), F.col("r_name").alias("technology"))

    @property
    def runs(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("benchmark_run_id"), F.col("c_nationkey").alias("experiment_id"), F.col("c_mktsegment").alias("run_kind"))

    @property
    def registry_events(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("benchmark_run_id"), F.col("o_orderstatus").alias("event_status"), F.col("o_orderpriority").alias("priority"))

    @property
    def items(self) -> DataFrame:
        """Observations without their run."""
        c = F.col
        identity = F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
        return self.raw("lineitem").select(
            identity.alias("observation_id"), c("l_orderkey").alias("event_id"), c("l_partkey").alias("variant_id"), c("l_suppkey").alias("source_artifact_id"), c("l_returnflag").alias("side"),
            c("l_linestatus").alias("raw_decision"), c("l_linenumber").cast("long").alias("source_record_ordinal"), c("l_quantity").cast("long").alias("quantity"),
        )

    @property
    def observations(self) -> DataFrame:
        runs = self.registry_events.select(F.col("event_id").alias("e"), "benchmark_run_id")
        return self.items.join(runs, F.col("event_id") == F.col("e")).drop("e")

    @property
    def located(self) -> DataFrame:
        """Observations with their run and its experiment, which are joined with the events before the items are."""
        events = self.registry_events.select(F.col("event_id").alias("e"), "benchmark_run_id").join(self.runs, "benchmark_run_id").join(self.experiments, "experiment_id")
        return self.items.join(events, F.col("event_id") == F.col("e")).drop("e")

    @property
    def provenance(self) -> DataFrame:
        """Links are dealt by the observation that they name, which is what they are joined by; only what tells them apart is compared."""
        o = self.items.select("observation_id", "source_artifact_id").repartition("observation_id").distinct()
        return o.select(
            F.concat_ws("-", F.lit("p"), "observation_id").alias("provenance_link_id"), F.lit("SOURCE_ARTIFACT").alias("source_entity_type"), F.col("source_artifact_id").alias("source_entity_id"),
            F.lit("NORMALIZED_FROM").alias("relation"), F.lit("OBSERVATION").alias("target_entity_type"), F.col("observation_id").alias("target_entity_id"),
        )

    @property
    def artifacts(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("source_artifact_id"), F.col("s_name").alias("artifact_name"))

    @property
    def variants(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("variant_id"), F.col("p_brand").alias("contig"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("kind"))

    @property
    def links(self) -> DataFrame:
        """Links are dealt by the event, which is what they are joined by."""
        return self.items.select("variant_id", "event_id").repartition("event_id").distinct()

    @property
    def intervals(self) -> DataFrame:
        start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - BASE
        rows = self.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("contig"), F.pmod("user_id", F.lit(2)).cast("long").alias("side"), "user_id", start.alias("start"))
        return rows.select("id", "contig", "side", "start", (F.col("start") + 600 + F.pmod("user_id", F.lit(7)) * 300).alias("end"))


#: The same roles as common table expressions.
SQL = f"""WITH experiments AS (SELECT n_nationkey AS experiment_id, n_name AS sample, r_name AS technology FROM nation JOIN region ON n_regionkey = r_regionkey),
runs AS (SELECT c_custkey AS benchmark_run_id, c_nationkey AS experiment_id, c_mktsegment AS run_kind FROM customer),
registry_events AS (SELECT o_orderkey AS event_id, o_custkey AS benchmark_run_id, o_orderstatus AS event_status, o_orderpriority AS priority FROM orders),
items AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_id, l_orderkey AS event_id, l_partkey AS variant_id, l_suppkey AS source_artifact_id, l_returnflag AS side,
  l_linestatus AS raw_decision, l_linenumber::BIGINT AS source_record_ordinal, l_quantity::BIGINT AS quantity FROM lineitem),
observations AS (SELECT i.*, e.benchmark_run_id FROM items i JOIN registry_events e USING (event_id)),
provenance AS (SELECT DISTINCT 'p-' || observation_id AS provenance_link_id, 'SOURCE_ARTIFACT' AS source_entity_type, source_artifact_id AS source_entity_id, 'NORMALIZED_FROM' AS relation,
  'OBSERVATION' AS target_entity_type, observation_id AS target_entity_id FROM items),
artifacts AS (SELECT s_suppkey AS source_artifact_id, s_name AS artifact_name FROM supplier),
variants AS (SELECT p_partkey AS variant_id, p_brand AS contig, p_size::BIGINT AS size, p_type AS kind FROM part),
links AS (SELECT DISTINCT variant_id, event_id FROM items),
raw_intervals AS (SELECT event_id AS id, event_type AS contig, (user_id % 2)::BIGINT AS side, user_id, (epoch_us(ts) // 1000000 - {BASE})::BIGINT AS start FROM events),
intervals AS (SELECT id, contig, side, start, (start + 600 + (user_id % 7) * 300)::BIGINT AS "end" FROM raw_intervals)
"""
