"""Registered queries over files: tables are written by a sink to the shared folder and read back by a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.plans.registered import query
from tracequill.plans.roles import Roles
from tracequill.sources import readers, sinks
from tracequill.sources.storage import scratch


def _path(r: Roles, name: str) -> str:
    return f"{scratch(r.spark)}/tracequill-{r.spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def _lines(r: Roles, df: DataFrame, name: str, *order: str) -> str:
    """The path of df's value column as text; with an order, in one file in that order."""
    path = _path(r, name)
    rows = df.orderBy(*order).select("value").coalesce(1) if order else df.select("value")
    rows.write.text(path)
    return path


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", plain=True)
def parquet_view(r: Roles) -> DataFrame:
    readers.parquet_view(r.spark, f"{r.dir}/nation.parquet", "tq_nation")
    return r.spark.sql("SELECT n_nationkey, n_name FROM tq_nation WHERE n_regionkey = 1")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", plain=True)
def parquet_round_trip(r: Roles) -> DataFrame:
    path = _path(r, "supplier")
    sinks.parquet(r.raw("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, key="s_suppkey")
    return readers.parquet_view(r.spark, path)


@query("""SELECT p_partkey::VARCHAR AS p_partkey, p_name, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS brand, '["' || p_brand || '","' || p_type || '"]' AS kinds FROM part""", plain=True)
def tsv_round_trip(r: Roles) -> DataFrame:
    path = _path(r, "part")
    rows = r.raw("part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"), F.array("p_brand", "p_type").alias("kinds"))
    sinks.tsv(rows, path, ["p_partkey", "p_name", "brand", "kinds"])
    return readers.tsv(r.spark, path)


@query("SELECT * FROM (VALUES (1, 'a', NULL), (2, 'b', 7), (3, NULL, 9)) t(id, name, n)", plain=True)
def rows_view(r: Roles) -> DataFrame:
    rows = [{"id": 1, "name": "a"}, {"id": 2, "name": "b", "n": 7}, {"n": 9, "id": 3}]
    readers.rows_view(r.spark, rows, "id int, name string, n int", "tq_rows")
    return r.spark.sql("SELECT * FROM tq_rows")


@query('SELECT contig, start, "end" FROM intervals')
def bed_round_trip(r: Roles) -> DataFrame:
    path = _path(r, "bed")
    sinks.bed(r.intervals, path)
    return readers.bed(r.spark, path)


@query('SELECT count(*) AS n_intervals, sum("end" - start)::BIGINT AS n_bases, count(DISTINCT contig) AS n_contigs FROM (SELECT contig, start, CASE WHEN id % 5 = 0 THEN start ELSE "end" END AS "end" FROM intervals)')
def bed_statistics(r: Roles) -> DataFrame:
    path = _path(r, "bed")
    end = F.when(F.pmod("id", F.lit(5)) == 0, F.col("start")).otherwise(F.col("end"))
    sinks.bed(r.intervals.withColumn("end", end), path)
    return readers.bed_stats(r.spark, path)


@query("""SELECT 'c' || s_nationkey AS contig, (s_suppkey * 10)::BIGINT AS start, (s_suppkey * 10 + 5)::BIGINT AS "end", row_number() OVER (ORDER BY s_suppkey)::BIGINT AS ordinal FROM supplier QUALIFY s_nationkey < 15 AND s_suppkey % 7 <> 0""", plain=True)
def bed_lenient(r: Roles) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat_ws("\t", F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), F.when(k % 7 == 0, F.lit("?")).otherwise((k * 10).cast("string")), (k * 10 + 5).cast("string"))
    path = _lines(r, r.raw("supplier").select("s_suppkey", text.alias("value")), "bed", "s_suppkey")
    return readers.bed_lenient(r.spark, path, [f"c{i}" for i in range(15)])


@query("SELECT n_name AS contig, (n_nationkey * 1000 + 7)::BIGINT AS length FROM nation", plain=True)
def fasta_index(r: Roles) -> DataFrame:
    text = F.concat_ws("\t", "n_name", (F.col("n_nationkey") * 1000 + 7).cast("string"), F.lit("5"), F.lit("60"), F.lit("61"))
    return readers.fasta_index(r.spark, _lines(r, r.raw("nation").select(text.alias("value")), "fai"))


_VCF_HEADER = ["##fileformat=VCFv4.2", "##FORMAT=<ID=GT,Number=1,Type=String>", "##FORMAT=<ID=BD,Number=1,Type=String>", "##FORMAT=<ID=BK,Number=1,Type=String>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tTRUTH\tQUERY"]


def _vcf(r: Roles) -> str:
    c = lambda name: F.col(name).cast("string")
    record = F.concat_ws("\t", F.concat(F.lit("chr"), c("l_linenumber")), c("l_orderkey"), F.lit("."), c("l_returnflag"), F.concat(c("l_linestatus"), F.lit(",G")), c("l_quantity"), F.lit("q1;q2"), F.lit("BS=1"), F.lit("GT:BD:BK"), F.concat(F.lit("0/1:TP:"), c("l_linestatus")), F.concat(F.lit("1|1:"), c("l_returnflag")))
    header = r.spark.createDataFrame([(x,) for x in _VCF_HEADER], "value string")
    return _lines(r, header.unionAll(r.raw("lineitem").select(record.alias("value"))), "vcf")


@query("SELECT 'chr' || l_linenumber AS contig, l_orderkey::BIGINT AS pos, l_returnflag AS ref, l_linestatus || ';G' AS alts, l_quantity::DOUBLE AS qual, 'TP' AS truth_bd, l_returnflag AS query_bd, '1|1' AS query_gt, NULL::VARCHAR AS query_bk, 2 AS n_filters FROM lineitem", plain=True)
def vcf_records(r: Roles) -> DataFrame:
    rows = readers.vcf(r.spark, _vcf(r), formats=("BD", "BK"))
    get = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return rows.select("contig", "pos", "ref", F.array_join("alts", ";").alias("alts"), "qual", get("truth", "BD").alias("truth_bd"), get("query", "BD").alias("query_bd"), get("query", "GT").alias("query_gt"), get("query", "BK").alias("query_bk"), F.size("filters").alias("n_filters"))


@query("SELECT 'SAMPLES' AS \"check\", true AS passed, '' AS detail UNION ALL SELECT 'FORMATS', false, 'XX' UNION ALL SELECT 'RECORDS', true, count(*)::VARCHAR FROM lineitem", plain=True)
def vcf_gate(r: Roles) -> DataFrame:
    return readers.vcf_gate(r.spark, _vcf(r), formats=("BD", "BK", "XX"))


@query("SELECT s_suppkey::VARCHAR AS path, md5(CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END) AS md5 FROM supplier", plain=True)
def md5_manifest(r: Roles) -> DataFrame:
    s = r.raw("supplier")
    line = lambda name, order: F.concat(F.upper(F.md5(name)) if order else F.md5(name), F.lit("  ./x/G@all/"), F.col("s_suppkey").cast("string")).alias("value")
    first = s.select(F.lit(0).alias("o"), line(F.col("s_name"), 0))
    again = s.filter(F.pmod("s_suppkey", F.lit(3)) == 0).select(F.lit(1).alias("o"), line(F.concat("s_name", F.lit("!")), 1))
    return readers.md5_manifest(r.spark, _lines(r, first.unionAll(again), "md5", "o"), after="G@all/")


@query("SELECT 'a b/' || s_suppkey AS path, sha256(s_name) AS sha256 FROM supplier", plain=True)
def sha256_manifest(r: Roles) -> DataFrame:
    line = F.concat(F.sha2("s_name", 256), F.lit("  a b/"), F.col("s_suppkey").cast("string"))
    return readers.sha256_manifest(r.spark, _lines(r, r.raw("supplier").select(line.alias("value")), "sha256"))


@query("SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'later=' || n_name ELSE n_name END AS value FROM nation", plain=True)
def lock_last_wins(r: Roles) -> DataFrame:
    n = r.raw("nation")
    line = lambda v: F.concat(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("="), v).alias("value")
    rows = n.select(F.lit(1).alias("o"), line(F.col("n_name"))).unionAll(n.filter("n_nationkey % 4 = 0").select(F.lit(2).alias("o"), line(F.concat(F.lit("later="), "n_name"))))
    rows = rows.unionAll(r.spark.createDataFrame([(0, "# comment"), (0, "")], "o int, value string"))
    return readers.lock(r.spark, _lines(r, rows, "lock", "o"), last_wins=True)


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS name FROM nation UNION ALL SELECT 'id', 'name'", plain=True)
def strict_table(r: Roles) -> DataFrame:
    """A data line that equals the header stays."""
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.col("n_name")))
    rows = r.raw("nation").select(F.col("n_nationkey").alias("o"), line.alias("value"))
    rows = rows.unionAll(r.spark.createDataFrame([(-1, "id\tname"), (3, ""), (99, "id\tname")], "o long, value string").select(F.col("o").cast(dict(rows.dtypes)["o"]), "value"))
    return readers.strict_tsv(r.spark, _lines(r, rows, "table", "o", "value"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_comment_ END AS description, 'text' AS type FROM (SELECT *, 'about ' || n_name AS n_comment_ FROM nation)", plain=True)
def field_descriptions(r: Roles) -> DataFrame:
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws("\t", "n_name", F.lit("text"))).otherwise(F.concat_ws("\t", "n_name", F.concat(F.lit("about "), "n_name"), F.lit("text")))
    rows = r.raw("nation").select(F.col("n_nationkey").cast("long").alias("o"), line.alias("value")).unionAll(r.spark.createDataFrame([(-1, "columnId\tdescription\ttype")], "o long, value string"))
    return readers.field_descriptions(r.spark, _lines(r, rows, "fields", "o"))


@query("SELECT count(*) AS n FROM orders", plain=True)
def count_answer(r: Roles) -> DataFrame:
    rows = r.raw("orders").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(1).alias("o"), "value").unionAll(r.spark.createDataFrame([(0, "count")], "o int, value string"))
    return r.spark.createDataFrame([(readers.count_result(r.spark, _lines(r, rows, "count", "o")),)], "n long")


@query("SELECT 'r' || n_regionkey AS fixture, n_name AS name FROM nation", plain=True)
def recorded_answers(r: Roles) -> DataFrame:
    """Answers in a file each, told apart by their path."""
    path = _path(r, "answers")
    rows = r.raw("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("of"), F.lit(1).alias("o"), "n_name")
    rows = rows.unionAll(rows.select("of", F.lit(0), F.lit("name")).distinct())
    rows.repartition(1).sortWithinPartitions("of", "o", "n_name").select("of", F.col("n_name").alias("value")).write.partitionBy("of").text(path)
    found = readers.fixtures(r.spark, f"{path}/of=*", r"of=([^/]+)/")
    return found.select("fixture", F.col("cells")["name"].alias("name"))


@query("SELECT 'nation' AS name, 25 AS n_rows, 'b' AS last", plain=True)
def json_documents(r: Roles) -> DataFrame:
    path = _path(r, "summary")
    sinks.json_summary(r.spark, {"table": {"name": "nation", "n_rows": 25}, "list": ["a", "b"]}, path)
    rows = readers.json_documents(r.spark, path, "table struct<name:string,n_rows:int>, list array<string>")
    return rows.select("table.name", "table.n_rows", F.element_at("list", -1).alias("last"))


@query("SELECT * FROM (VALUES (1, 'the first item, which goes on'), (2, 'the second')) t(number, item)", plain=True)
def locked_criteria(r: Roles) -> DataFrame:
    text = "# Rules\n<begin>\n1. the first item,\n   which goes on\n\n2. the second\n<end>\n3. no item"
    return r.spark.createDataFrame(list(enumerate(readers.criteria(text, "<begin>", "<end>"), 1)), "number int, item string")


_NATION_JSON = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"none":null}'"""


def _nation(r: Roles) -> DataFrame:
    return r.raw("nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))


@query(f"SELECT {_NATION_JSON} AS value FROM nation", plain=True)
def json_lines(r: Roles) -> DataFrame:
    path = _path(r, "lines")
    sinks.json_lines(_nation(r), path, "n_nationkey")
    return readers.lines(r.spark, path).select("value")


@query(f"SELECT '[' || string_agg({_NATION_JSON}, ',' ORDER BY n_nationkey) || ']' AS value, 25 AS n FROM nation", plain=True)
def json_array(r: Roles) -> DataFrame:
    path = _path(r, "array")
    n = sinks.json_array(_nation(r), path, "n_nationkey")
    return r.spark.read.text(path).select("value", F.lit(n).alias("n"))


@query("SELECT left(sha256(event_id::VARCHAR), 2) AS shard, count(*) AS n_rows, sum(strlen('{\"event_id\":\"' || event_id || '\",\"event_status\":\"' || event_status || '\"}') + 1)::BIGINT AS n_bytes FROM registry_events GROUP BY 1")
def json_shards(r: Roles) -> DataFrame:
    path = _path(r, "shards")
    rows = r.registry_events.select(F.col("event_id").cast("string").alias("event_id"), "event_status")
    sinks.sharded_json(rows, path, "event_id")
    back = r.spark.read.text(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))


@query("SELECT s_suppkey, 'second' AS edition FROM supplier", plain=True)
def staged_publication(r: Roles) -> DataFrame:
    """A second edition takes the first one's place; one that isn't valid leaves it."""
    target = _path(r, "edition")
    build = lambda name: lambda path: r.raw("supplier").select("s_suppkey", F.lit(name).alias("edition")).write.parquet(path)

    def refuse(path: str) -> None:
        raise ValueError(path)

    sinks.publish(r.spark, target, build("first"), lambda path: None)
    sinks.publish(r.spark, target, build("second"), lambda path: None)
    try:
        sinks.publish(r.spark, target, build("third"), refuse)
    except ValueError:
        pass
    return r.spark.read.parquet(target)


def _folders(r: Roles) -> str:
    """A file in a folder for each nation."""
    path = _path(r, "files")
    r.raw("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition(1).write.partitionBy("k").text(path)
    return path


@query("SELECT sha256(n_name || chr(10)) AS sha256, 'k=' || n_nationkey AS folder, (strlen(n_name) + 1)::BIGINT AS size_bytes FROM nation", plain=True)
def checksum_manifest(r: Roles) -> DataFrame:
    rows = sinks.checksum_manifest(r.spark, _folders(r)).filter("path like 'k=%'")
    return rows.select("sha256", F.regexp_extract("path", r"^(k=\d+)/part-[^/]*$", 1).alias("folder"), "size_bytes")


@query("SELECT 'k=' || n_nationkey AS folder, CASE WHEN n_nationkey < 3 THEN 'CHANGED' ELSE 'UNLISTED' END AS violation FROM nation WHERE n_nationkey < 3 OR n_nationkey > 20 UNION ALL SELECT 'gone', 'MISSING'", plain=True)
def manifest_verification(r: Roles) -> DataFrame:
    path = _folders(r)
    key = F.regexp_extract("path", r"k=(\d+)", 1).try_cast("int")
    stored = sinks.checksum_manifest(r.spark, path).select("path", F.when(key < 3, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256")).filter(F.coalesce(key <= 20, F.lit(True)))
    stored = stored.unionAll(r.spark.createDataFrame([("gone/file", "1" * 64)], "path string, sha256 string"))
    found = sinks.manifest_violations(r.spark, path, stored)
    return found.select(F.regexp_extract("path", r"^([^/]+)/", 1).alias("folder"), "violation")


@query("SELECT sha256(n_name || chr(10)) AS sha256, md5(n_name || chr(10)) AS md5 FROM nation", plain=True)
def file_hashes(r: Roles) -> DataFrame:
    """Files over four bytes are hashed as streams."""
    path = _folders(r)
    only = lambda df: df.filter(F.col("path").contains("/k="))
    md5 = only(readers.file_hashes(r.spark, path, "md5", whole=4)).select(F.col("path").alias("m_path"), "md5")
    return only(readers.file_hashes(r.spark, path, whole=8)).join(md5, F.col("path") == F.col("m_path")).select("sha256", "md5")


@query("SELECT r_regionkey, r_name, n.n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) n ON n_regionkey = r_regionkey", plain=True)
def registry_tables(r: Roles) -> DataFrame:
    database = f"tq_{uuid.uuid4().hex}"
    sinks.registry(r.spark, {"region": r.raw("region"), "nation": r.raw("nation")}, database)
    return r.spark.sql(f"SELECT r_regionkey, r_name, count(*) AS n FROM {database}.region JOIN {database}.nation ON n_regionkey = r_regionkey GROUP BY ALL")


@query("SELECT 25 AS n_rows, sha256('[' || string_agg(" + _NATION_JSON + ", ',' ORDER BY n_nationkey) || ']') AS table_hash FROM nation", plain=True)
def table_hashes(r: Roles) -> DataFrame:
    return r.spark.createDataFrame([(25, canonical.table_hash(_nation(r), "n_nationkey"))], "n_rows int, table_hash string")
