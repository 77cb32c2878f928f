import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracequill.functions import canonical, text


def _python(payload, ascii=True):
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii)


def test_canonical_json(spark):
    payload = {"b": 'é"\\', "a": 7, "c": None, "d": "\U0001f600 字"}
    df = spark.createDataFrame([(payload["b"], 7, None, payload["d"])], "b string, a long, c string, d string")
    columns = {c: F.col(c) for c in "abcd"}
    got = df.select(canonical.canonical_json(columns), canonical.canonical_json(columns, ascii=False), canonical.content_id("x", columns), canonical.stable_id("y", columns), canonical.parameter_hash(columns)).first()
    digest = hashlib.sha256(_python(payload).encode()).hexdigest()
    assert got[0] == _python(payload)
    assert got[1] == _python(payload, False)
    assert got[2] == f"x:sha256:{digest}"
    assert got[3] == f"y-{digest[:32]}"
    assert got[4] == hashlib.sha256((_python(payload, False) + "\n").encode()).hexdigest()


def test_table_hash_follows_order_and_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i long, s string")
    want = hashlib.sha256(('[{"i":1,"s":"x"},{"i":2,"s":null}]').encode()).hexdigest()
    assert canonical.table_hash(a, "i") == canonical.table_hash(b, "i") == want
    assert canonical.table_fingerprint(a).first() == canonical.table_fingerprint(b).first()
    assert canonical.table_fingerprint(a.limit(0)).first().n_rows == 0


def _one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(c) for c in df.columns])).first()[0]


def test_text_functions(spark):
    assert _one(spark, text.alias_key, "  Illumina_Nova--Seq 6000 ") == "illumina nova seq 6000"
    assert _one(spark, lambda c: text.accession(c, "run"), "SRR123456") == "SRR123456"
    assert _one(spark, lambda c: text.accession(c, "run"), "SRR1") is None
    assert _one(spark, text.split_distinct, "b;a;;b", "c;a") == ["b", "a", "c"]
    assert _one(spark, text.with_scheme, "host/x") == "ftp://host/x"
    assert _one(spark, text.allele_lookup_key, "A", "chr1", 5, "a", ["t"]) == "A|chr1|5|A|T"
    assert _one(spark, text.allele_lookup_key, "A", "chr1", 5, "a", ["t", "g"]) is None
    assert _one(spark, text.allele_lookup_key, "A", "chr1", 5, "a", ["<DEL>"]) is None
    assert _one(spark, text.non_negative, "-4") is None
    assert _one(spark, text.non_negative, "x") is None
    assert _one(spark, text.non_negative, "12") == 12
    assert _one(spark, text.media_type, "a.vcf.gz") == "application/gzip"
    assert _one(spark, text.media_type, "a.bed") == "text/tab-separated-values" and _one(spark, text.media_type, "a.VCF.gz") == "application/octet-stream"
    assert _one(spark, lambda c: text.media_type(c, text.MEDIA_TYPES_1A), "a.fasta") == "application/octet-stream"
    assert _one(spark, text.list_literal, "['a' 'b', \"c\"]") == ["a", "b", "c"]
    assert _one(spark, text.list_literal, "[1, 2]") == ["1", "2"] and _one(spark, text.list_literal, """['it\\'s', "a, b"]""") == ["it's", "a, b"]
    assert _one(spark, text.list_literal, "('a', 'b',)") == ["a", "b"] and _one(spark, text.list_literal, "") == _one(spark, text.list_literal, "[]") == []
    for bad in ("['a'", "a", "{'a': 1}"):
        with pytest.raises(Exception, match="no list"):
            _one(spark, text.list_literal, bad)
    assert _one(spark, text.release_kind, "1.2.3", "1.2.4") == "PATCH"
    assert _one(spark, text.release_kind, "1.2.3", "1.3.1") == "MINOR_MUST_RESET"
    assert _one(spark, text.release_kind, "1.2.3", "2.0.0") == "MAJOR"
    assert _one(spark, text.release_kind, "1.2.3", "1.2.3") == "NOT_ADVANCING"
    assert _one(spark, text.read_type, "SINGLE", "nanopore") == "LONG_SINGLE_MOLECULE"
    assert _one(spark, lambda c: text.json_has_exactly(c, ["a", "b"]), '{"b":"1","a":"2"}')
    assert not _one(spark, lambda c: text.json_has_exactly(c, ["a"]), '{"b":"1","a":"2"}')
    contigs = spark.createDataFrame([(c,) for c in ("chrX", "chr10", "chr2", "chrM", "chrUn")], "c string")
    assert [r[0] for r in contigs.orderBy(text.karyotype_key(F.col("c"))).collect()] == ["chr2", "chr10", "chrX", "chrM", "chrUn"]


def test_canonical_json_of_all_characters(spark):
    import json

    texts = [chr(i) for i in range(0xA0)] + ["\\u000B", "\\\u000B", "\\\\u001F x", '"\\', "\u2028", "\ud7ff\ue000", "\U0001f600", "a\x0bb\x1fc\x7fd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    both = df.select("i", canonical.canonical_json({"s": F.col("s"), "k": F.col("s")}).alias("a"), canonical.canonical_json({"s": F.col("s")}, ascii=False).alias("u")).collect()
    for r in both:
        assert r.a == json.dumps({"k": texts[r.i], "s": texts[r.i]}, sort_keys=True, separators=(",", ":"))
        assert r.u == json.dumps({"s": texts[r.i]}, separators=(",", ":"), ensure_ascii=False)


def test_doubles_are_refused(spark):
    df = spark.range(1).select("id", F.lit(1.5).alias("x"))
    for payload in ({"x": F.col("x")}, {"x": F.array("x")}, {"x": F.struct("x")}):
        with pytest.raises(Exception, match="doubles"):
            df.select(canonical.canonical_json(payload)).collect()
    with pytest.raises(Exception, match="doubles"):
        df.select(canonical.row_json(df)).collect()
    assert df.select(canonical.canonical_json({"x": F.col("id")})).first()[0] == '{"x":0}'


def test_alias_keys(spark):
    texts = ["\tIllumina ", "\x0b HiSeq__2500\n", "_x", "a -\u00a0b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(text.alias_key(F.col("s"))).collect()]
    import re

    assert got == [re.sub(r"[\s_-]+", " ", x.strip().casefold()) for x in texts]


def test_json_objects(spark):
    df = lambda x: spark.createDataFrame([(x,)], "s string").select(text.json_object(F.col("s")))
    assert df(' {"a":1}').first()[0] == ' {"a":1}' and df(None).first()[0] is None
    for bad in ("[1]", "1", "", "{", "null"):
        with pytest.raises(Exception, match="not a JSON object"):
            df(bad).collect()
