import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tracequill.sources import readers, sinks


def _file(tmp_path, name, text):
    path = tmp_path / name
    (gzip.open if name.endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def test_beds(spark, tmp_path):
    good = _file(tmp_path, "a.bed.gz", "# c\ntrack x\n\nchr1 1 5 n\nchr2\t0\t7\n")
    assert sorted(tuple(r) for r in readers.bed(spark, good).collect()) == [("chr1", 1, 5), ("chr2", 0, 7)]
    bad = _file(tmp_path, "b.bed", "chr1\t5\t5\nchr1\tx\t7\nchr20\t1\t2\nchr3\t1\t2\n")
    with pytest.raises(Exception, match="bad BED row"):
        readers.bed(spark, bad).collect()
    assert [tuple(r)[:3] for r in readers.bed_lenient(spark, bad, ["chr1", "chr3"]).collect()] == [("chr3", 1, 2)]
    assert readers.bed(spark, _file(tmp_path, "c.bed", "chr1\t5\t5\n"), allow_empty=True, tabs_only=True).count() == 1
    assert readers.fasta_index(spark, _file(tmp_path, "x.fai", "chr1\t100\t5\t60\t61\n")).first() == ("chr1", 100)


def test_vcf(spark, tmp_path):
    text = "##FORMAT=<ID=BD,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tTRUTH\tQUERY\nchr1\t7\t.\tA\tT,G\t.\tq1;q2\tBS=5\tGT:BD\t0/1:TP\t1/1\nchr1\t9\tx\tA\t.\t3.5\tPASS\t.\tGT:BD\t.:.\t0/1:FP\n"
    path = _file(tmp_path, "a.vcf", text)
    a, b = readers.vcf(spark, path, formats=("BD",)).orderBy("pos").collect()
    assert (a.pos, a.id, a.alts, a.qual, a.filters, a.truth, a.query) == (7, None, ["T", "G"], None, ["q1", "q2"], {"GT": "0/1", "BD": "TP"}, {"GT": "1/1"})
    assert (b.id, b.alts, b.qual, b.filters, b.query["BD"]) == ("x", [], 3.5, [], "FP")
    with pytest.raises(ValueError, match="lacks"):
        readers.vcf(spark, path, formats=("BK",))


def test_manifests_and_locks(spark, tmp_path):
    d = "a" * 32
    md5 = readers.md5_manifest(spark, _file(tmp_path, "m.md5", f"{'b' * 32}  ./x/G@all/f\n{d}  x/G@all/f\nnoise\n"), after="G@all/")
    assert [tuple(r) for r in md5.collect()] == [("f", d)]
    sha = _file(tmp_path, "m.sha", f"{'c' * 64}  p q\n")
    assert readers.sha256_manifest(spark, sha).first() == ("p q", "c" * 64)
    with pytest.raises(Exception, match="malformed"):
        readers.sha256_manifest(spark, _file(tmp_path, "n.sha", "short  p\n")).collect()
    twice = _file(tmp_path, "a.lock", "# c\nA = 1\nB=x=y\nA=2\n")
    assert {r.key: r.value for r in readers.lock(spark, twice, last_wins=True).collect()} == {"A": "2", "B": "x=y"}
    with pytest.raises(Exception, match="duplicate key"):
        readers.lock(spark, twice).collect()


def test_portal_tables(spark, tmp_path):
    rows = readers.strict_tsv(spark, _file(tmp_path, "a.tsv", "a\tb\n1\t\n2\tx\n"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", ""), ("2", "x")]
    with pytest.raises(Exception, match="wrong number"):
        readers.strict_tsv(spark, _file(tmp_path, "b.tsv", "a\tb\n1\n")).collect()
    with pytest.raises(ValueError):
        readers.strict_tsv(spark, _file(tmp_path, "c.tsv", "\n1\n"))
    assert readers.count_result(spark, _file(tmp_path, "n.tsv", "count\n12\n")) == 12
    fields = readers.field_descriptions(spark, _file(tmp_path, "f.tsv", "columnId\tdescription\ttype\nx\ttext\ny\twhat it is\tnumber\n"))
    assert {tuple(r) for r in fields.collect()} == {("x", "", "text"), ("y", "what it is", "number")}
    with pytest.raises(ValueError, match="header"):
        readers.field_descriptions(spark, _file(tmp_path, "g.tsv", "columnId\ttype\tdescription\nx\ttext\n"))
    twice = readers.strict_tsv(spark, _file(tmp_path, "d.tsv", "a\tb\na\tb\n\n1\t2\n"))
    assert sorted(tuple(r) for r in twice.collect()) == [("1", "2"), ("a", "b")]
    with pytest.raises(ValueError):
        readers.criteria("<b>\n2. two\n<e>", "<b>", "<e>")
    assert readers.criteria("<b>\n1. one\n two\n2. three\n<e>\n3. x", "<b>", "<e>") == ["one two", "three"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("b", None, ["x"], 1), ("a", "", [], 2)], "id string, s string, l array<string>, n long")
    assert sinks.parquet(df, str(tmp_path / "p")) == 2
    sinks.tsv(df, str(tmp_path / "t"), ["id", "s", "l", "n"])
    back = {r.id: (r.s, r.l, r.n) for r in readers.tsv(spark, str(tmp_path / "t")).collect()}
    assert back == {"a": ("", "[]", "2"), "b": ("", '["x"]', "1")}
    with pytest.raises(ValueError):
        sinks.tsv(df, str(tmp_path / "u"), ["id"])
    sinks.json_lines(df, str(tmp_path / "j"), "id")
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).orderBy("value").collect()][0] == '{"id":"a","l":[],"n":2,"s":""}'
    ids = spark.createDataFrame([(f"e{i}",) for i in range(300)], "event_id string")
    sizes = sinks.sharded_json(ids, str(tmp_path / "s"), "event_id")
    got = spark.read.text(str(tmp_path / "s"))
    assert got.count() == 300 and sizes.agg(F.sum("n_rows")).first()[0] == 300
    shards = {r.shard for r in sizes.collect()}
    assert shards == {hashlib.sha256(f"e{i}".encode()).hexdigest()[:2] for i in range(300)}
    with pytest.raises(ValueError, match="shard"):
        sinks.sharded_json(ids, str(tmp_path / "v"), "event_id", most_bytes=5)
    manifest = sinks.checksum_manifest(spark, str(tmp_path / "j")).collect()
    assert manifest and all(len(r.sha256) == 64 for r in manifest)


def test_publish_restores(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.range(3)
    sinks.publish(spark, target, lambda p: df.write.parquet(p), lambda p: None)
    assert spark.read.parquet(target).count() == 3

    def refuse(path):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.publish(spark, target, lambda p: spark.range(9).write.parquet(p), refuse)
    assert spark.read.parquet(target).count() == 3
    assert len(list(tmp_path.iterdir())) == 1


def test_microbatches(spark, tmp_path):
    from tracequill.operators import gates
    from tracequill.streaming import microbatch

    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "in"))
    run = microbatch.gated(stream, lambda b: gates.violation(b, "SMALL", "k", F.col("v") > 1), "k", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    run.awaitTermination(60)
    assert [r.k for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert [r.key for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b"]


def test_order_of_lines_over_splits(spark, tmp_path):
    """One file in many splits, several of them in a partition."""
    path = _file(tmp_path, "many.txt", "".join(f"k{i % 50} = {i}\n" for i in range(4000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        numbered = {r.line: r.value for r in readers.numbered_lines(spark, path).collect()}
        assert numbered == {i + 1: f"k{i % 50} = {i}" for i in range(4000)}
        assert {r.key: r.value for r in readers.lock(spark, path, last_wins=True).collect()} == {f"k{i}": str(3950 + i) for i in range(50)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_trees_and_manifests(spark, tmp_path):
    for name, text in {"x/c/p": "1", "y/c/p": "2", "top": "3", "a.b": "4", "a/z": "5"}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    folder = str(tmp_path / "t")
    rows = {r.path: r.sha256 for r in sinks.checksum_manifest(spark, folder).collect()}
    assert rows == {n: hashlib.sha256(x.encode()).hexdigest() for n, x in {"x/c/p": "1", "y/c/p": "2", "top": "3", "a.b": "4", "a/z": "5"}.items()}
    digest = hashlib.sha256()
    for item in sorted(p for p in (tmp_path / "t").rglob("*") if p.is_file()):
        digest.update(str(item.relative_to(tmp_path / "t")).encode() + b"\0" + hashlib.sha256(item.read_bytes()).hexdigest().encode() + b"\n")
    assert readers.tree_hash(spark, folder) == readers.tree_hash(spark, f"file://{folder}/") == digest.hexdigest()
    stored = sinks.checksum_manifest(spark, folder).select("sha256", "path").filter("path <> 'top'")
    assert [tuple(r) for r in sinks.manifest_violations(spark, folder, stored).collect()] == [("top", "UNLISTED")]


def test_publish_refuses_what_stands_in_the_way(spark, tmp_path, monkeypatch):
    """A target that can't be moved away stays, and nothing is moved into it."""
    target = tmp_path / "held" / "out"
    spark.range(3).write.parquet(str(target))
    target.parent.chmod(0o500)
    try:
        if not __import__("os").access(target.parent, __import__("os").W_OK):
            with pytest.raises(Exception):
                sinks.publish(spark, str(target), lambda p: spark.range(9).write.parquet(p), lambda p: None)
    finally:
        target.parent.chmod(0o700)
    assert spark.read.parquet(str(target)).count() == 3


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from tracequill.sources import storage

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.scratch(Session())


def test_leading_lines(spark, tmp_path):
    """A header is read from the beginning of a file, compressed or not; what follows isn't looked at."""
    import gzip

    text = "##a\n##FORMAT=<ID=BD,x>\n#CHROM\té\nrow\n#later\n"
    (tmp_path / "a.vcf").write_text(text)
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(text + "row\n" * 100_000)
    (tmp_path / "empty.vcf").write_text("")
    want = ["##a", "##FORMAT=<ID=BD,x>", "#CHROM\té"]
    assert readers.leading_lines(spark, str(tmp_path / "a.vcf"), "#") == readers.leading_lines(spark, f"file://{tmp_path}/b.vcf.gz", "#") == want
    assert readers.leading_lines(spark, str(tmp_path / "a.v*"), "#") == want and readers.leading_lines(spark, str(tmp_path / "empty.vcf"), "#") == []
    with pytest.raises(FileNotFoundError):
        readers.leading_lines(spark, str(tmp_path / "none.vcf"), "#")
