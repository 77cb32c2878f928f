"""Nulls, empty and long texts, ties, repeated rows, empty tables and other columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tracequill.llm import classifier, language_id, media, mixing, near_dups, pieces, quality_rules, surrogates, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size long, copies string, score string, bucket string, label string"
ENGLISH = "The cat sat on the mat and it was the best of all the mats that we have seen in the house"
FRENCH = "Le chat est sur la table et il ne veut pas que nous le voyions dans la maison de la voisine"


def rows():
    texts = [
        (1, ENGLISH, "en", "a"), (2, ENGLISH, "en", "a"), (2, ENGLISH, "en", "a"), (3, FRENCH, "fr", "b"), (4, "", None, None), (5, None, "en", "b"), (6, " \n\t ", "fr", None),
        (None, "no id here, but words enough to be seen", "en", "a"), (7, "x" * 30_000, None, "c"), (8, (ENGLISH + " ") * 400, "en", "c"), (9, "12 34 !!", None, "c"), (10, "mail me@host.example.org \0 now", "en", None),
    ]
    return [(*t, 0, "w", 5, "c", "s", "b", "l") for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 1), (8, None, 0), (None, 1, 1), (7, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]


def test_mixing(docs, none):
    got = mixing.taken(docs)
    assert ids(got) == ALL
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("size").alias("most")).collect()
    for r in per:
        assert r.size == r.source_size and r.target <= 2 * r.source_size + 1e-9
        assert abs(r.taken - r.target) <= 2 * r.most
    assert got.filter("taken > 2 * size").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("doc_id = 2").count() % 2 == 0
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_language(docs, none):
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model, ("lang_pred", "share")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].share == 0 and got[i]["score"] == "s" for i in (4, 5, 6, 9))
    assert len(got) == 11 and set(r.lang_pred for r in got.values()) <= {"en", "fr", "und"}
    assert got[1].lang_pred == got[2].lang_pred
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), empty).collect()} == {"und"}
    assert language_id.predict(none.select("doc_id", "text"), model).count() == 0


def test_token_files(docs, none):
    got = token_files.round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(x for x in ALL if x)]
    total = 0
    for r in got:
        assert r.start == total and len(r.ids) == 4 * r.n_tokens
        total += r.n_tokens
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {1}
    assert token_files.round_trip(none).count() == 0


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[5].n_words == got[4].n_words == 0 and not got[5].kept
    assert got[8].n_repeat_words == got[8].n_words and got[8].base_failed
    assert quality_rules.judge(none).count() == 0


def test_near_dups(docs, none):
    got = sorted(((r.doc_id, r.class_id, r.copies) for r in near_dups.classes(docs).collect()), key=str)
    assert len(got) == 12
    assert (2, 1, 3) in got and (4, 4, 1) in got and (5, 5, 1) in got and (None, None, 1) in got and (8, 8, 1) in got
    kept = near_dups.deduplicate(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 4, 5, 6, 7, 8, 9, 10, None]
    assert near_dups.classes(none).count() == 0 and near_dups.deduplicate(none).count() == 0


def test_near_dups_in_other_partitions(spark, docs):
    rows = [(1, ENGLISH, "en", "b"), (1, ENGLISH, "en", "a"), (1, ENGLISH, None, "a"), (2, f"{ENGLISH} {ENGLISH}", "en", "a")]
    twice = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {tuple(near_dups.deduplicate(twice.repartition(n)).filter("doc_id = 1").first()) for n in (1, 2, 4)}
    assert len(kept) == 1
    found = [sorted(map(str, near_dups.classes(docs.repartition(n)).collect())) for n in (1, 5)]
    assert found[0] == found[1]


def test_pieces(docs, none):
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    assert len(got) == 11
    assert all(r.text_crc32 == r.decoded_crc32 for r in got.values())
    assert got[4].n_pieces == got[5].n_pieces == 0 and got[7].n_pieces > 1000
    assert pieces.round_trip(none).count() == 0


def test_token_counts(docs, none):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    assert got[4] == got[5] == got[6] == (0, 0) and got[1] == got[2] and got[7][0] == 1
    assert token_counts.count_tokens(none).count() == 0


def test_classifier(docs, none, labels):
    weights = classifier.train(docs, labels)
    got = {r.doc_id: r[-1] for r in classifier.score(docs.select("doc_id", "text"), weights).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and got[4] == got[5] == got[6] and got[1] == got[2]
    flat = classifier.train(docs, labels.limit(0))
    assert {r[-1] for r in classifier.score(docs.select("doc_id", "text"), flat).collect()} == {0.5}
    assert classifier.score(none.select("doc_id", "text"), weights).count() == 0


def test_media(docs, none):
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].payload_bytes == 64 and got[4].landmarks == []
    assert got[1].landmarks == got[2].landmarks and got[7].n_bytes == 30_000
    assert media.media_columns(none).count() == 0


def test_surrogates(docs, none):
    got = surrogates.replace(docs)
    assert got.columns == [*docs.columns, "n_entities"] and ids(got) == ALL
    texts = {r.doc_id: (r.text, r.n_entities) for r in got.collect()}
    assert texts[5] == (None, 0) and texts[1] == (ENGLISH, 0)
    assert texts[10][1] == 1 and "me@host" not in texts[10][0] and texts[10][0].endswith(" \0 now")
    assert surrogates.replace(none).count() == 0


def test_pipeline(spark, docs, none, tmp_path):
    """All stages over nulls, empty texts, repeated rows, long texts, extra columns with clashing names, and no rows."""
    import corpus_pipeline

    for name, df, least in (("rows", docs.filter("doc_id is null or doc_id <> 7").unionAll(docs.filter("doc_id = 7").withColumn("text", F.repeat(F.lit("longword"), 40_000))), 1), ("none", none, 0)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        stage_docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:-1]:
            after = function(spark, stage_docs, str(tmp_path / name))
            assert after.columns == df.columns, stage
            path = str(tmp_path / name / stage)
            after.write.parquet(path)
            stage_docs = spark.read.parquet(path)
        last = corpus_pipeline.STAGES[-1][1](spark, stage_docs, str(tmp_path / name)).collect()
        assert len(last) == stage_docs.count() >= least and all(r.text_crc32 == r.decoded_crc32 for r in last)
        whole = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert len(whole) >= least and all(r.text_crc32 == r.decoded_crc32 for r in whole)
        if name == "rows":
            assert all(r.doc_id not in (4, 5, 6, 9) for r in whole)


def test_a_very_long_text(spark):
    """A million characters without a space, and 200,000 words, for every operator."""
    texts = [(1, "abcdefghij" * 100_000, "en", "a"), (2, "one two three four five " * 40_000, "en", "a"), (3, ENGLISH, "en", "b"), (4, FRENCH, "fr", "b")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    sizes = {r.doc_id: r["size"] for r in mixing.taken(df).collect()}
    assert (sizes[1], sizes[2]) == (1, 200_000)
    predicted = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.train(df.filter("doc_id > 2"))).collect()}
    assert len(predicted) == 4 and predicted[1] != "und"
    assert {r.doc_id: r.n_tokens for r in token_files.round_trip(df).collect()}[1] > 100_000
    judged = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert judged[2].n_repeat_words == 200_000 and judged[1].word_chars == 1_000_000
    assert {r.doc_id: r.class_id for r in near_dups.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_words for r in token_counts.count_tokens(df).collect()}[2] == 200_000
    weights = classifier.train(df, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int"))
    assert classifier.score(df.select("doc_id", "text"), weights).count() == 4
    assert {r.doc_id: r.n_bytes for r in media.media_columns(df).collect()}[1] == 1_000_000
    assert surrogates.replace(df).filter("n_entities > 0").count() == 0
