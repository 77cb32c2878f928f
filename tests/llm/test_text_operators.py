"""Fill-in-middle, the filter audit and suffix-array dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequill.llm import fill_middle, filter_audit, queries, repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n string, output string, kept string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# fill-in-middle ---------------------------------------------------------------------------------------------------------------------


def by_plain_loops(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(sha(f"1:{doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", "a", ".", "The cat, the mat.", "no <P> here", "a<S>b<M>", "<P", "P>S<M", "été à l'école", "漢字 kana かな", "\n\t \0x", "aÀb", "🙂🙂ab🙂", "x" * 5000, "<<S", "a" * 3 + "?" * 70, "ſtraße K"]


def test_units_are_those_of_the_pattern():
    for text in TEXTS:
        units = fill_middle.Units(text)
        found = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        assert units.n == len(found)
        assert [units.end(k) for k in range(len(found) + 1)] == [len("".join(found[:k])) for k in range(len(found) + 1)]
        assert units.sentinel == any(m in text for m in ("<P>", "<S>", "<M>"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aPSMz<>. é漢\n", max_size=40), st.integers(1, 5))
def test_parts_of_a_text_change_nothing(text, part):
    before, fill_middle.PART = fill_middle.PART, part
    try:
        units = fill_middle.Units(text)
    finally:
        fill_middle.PART = before
    found = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    assert units.n == len(found) and [units.end(k) for k in range(len(found) + 1)] == [len("".join(found[:k])) for k in range(len(found) + 1)]
    assert units.sentinel == any(m in text for m in ("<P>", "<S>", "<M>"))


def test_fill_middle_by_plain_loops(spark):
    rows = [(i, t, "en", "x", "o", "k") for i, t in enumerate(TEXTS * 12)] + [(None, "no id", None, "x", "o", "k"), (7, None, "en", "x", "o", "k")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "text", "lang", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter(by_plain_loops("" if i is None else i, t or "") for i, t, *_ in rows)
    assert Counter((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back) == want
    assert all(r.back == (r.text or "") for r in back) and len({r.form for r in back}) == 3
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_fill_middle_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_fill_middle(spark, SF).collect():
        n, form, prefix, middle, output = by_plain_loops(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(texts[r.doc_id]))


# filter audit -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.adjacent_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def failures(doc_id, text, ids):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), any(i is not None and doc_id is not None and i < doc_id for i in ids)]


def audited(rows, labels):
    """Every order applied to every document."""
    ids = defaultdict(list)
    for i, text, *_ in rows:
        ids[text or ""].append(i)
    out = {}
    marks = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        marks[i] = [max(marks[i][0], q == 1), max(marks[i][1], t == 1)]
    docs = [(lang or "", dict(zip("ABCDE", failures(i, text or "", ids[text or ""]), strict=True)), marks[i] if i is not None else [0, 0]) for i, text, lang, *_ in rows]
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        sums = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fails = [d for d in own if d[1][f]]
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(d[1].values()) == 1 for d in fails), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
                sums[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(sums[f])
    return {k: tuple(map(int, v)) for k, v in out.items()}


def test_filter_audit_by_applying_every_order(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "DELTA", "x", "#1", "e|f", "plain"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "A" * 10, "x#"] + [" ".join(rng.choices(words[: rng.choice([3, 8, 308])], k=rng.choice([1, 150, 199, 200, 201, 320]))) for _ in range(60)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "x", "o", "k") for _ in range(150)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), *[(i, i % 2, i % 3 == 0) for i in range(5, 40)]]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.interactions(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(rows, labels)


def test_filter_audit_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", "x", "o", "k")], SCHEMA)
    assert filter_audit.interactions(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    sums = filter_audit.interactions(docs, labels).filter("step = 1").groupBy("filter_order").agg(F.sum("shapley").alias("s")).collect()
    assert sum(r.s for r in sums) == 120 * 24 and len(sums) == 120


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_filter_audit"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    sql = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(sql.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[sql.columns.index(c)] for c in columns) for r in sql.fetchall())


# suffix-array dedup -----------------------------------------------------------------------------------------------------------------


def without_repeats(texts, length):
    """(n_removed, n_spans, kept) of each text, by the windows of all."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(d))] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        out.append((int(flags.sum()), int((flags & ~np.concatenate([[False], flags[:-1]])).sum()) if len(d) else 0, bytes(np.frombuffer(d, np.uint8)[~flags])))
    return out


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = without_repeats([r.text for r in rows], 200)
    got = {r.doc_id: r for r in queries.op13_repeats(spark, SF).collect()}
    assert len(got) == len(rows) and sum(w[0] for w in want) > 0
    for r, (removed, spans, kept) in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len((r.text or "").encode()), removed, spans, sha(kept))


def shared_texts(rng, n):
    """Texts that share passages of many lengths, copies, runs of one character, periodic parts and bytes beyond ASCII."""
    letters = "abcdefghijklmnopqrstuvwxyz é漢\n\0"
    make = lambda k: "".join(rng.choices(letters, k=k))
    passages = [make(k) for k in (150, 199, 200, 201, 230, 400, 900)] + ["-" * 700, "ab" * 300, "xyz\n" * 120]
    out = []
    for _ in range(n):
        parts = [make(rng.choice([0, 3, 50, 300]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 1, 17])
            parts += [p[a : len(p) - rng.choice([0, 0, 2, 9])], make(rng.choice([0, 1, 40]))]
        out.append("".join(parts))
    return out + [out[0], out[0], None, "", "a" * 199, "é" * 100, "é" * 100, "q" * 201]


def checked(spark, texts, partitions=3):
    docs = spark.createDataFrame([(i % 50, t, "en", "n", "o", "k") for i, t in enumerate(texts)], SCHEMA).repartition(partitions)
    got = repeats.remove(docs)
    assert got.columns == ["doc_id", "text", "lang", "n", "output", "n_bytes", "n_removed", "n_spans", "kept"]
    want = without_repeats(texts, repeats.LENGTH)
    assert Counter((r.text, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == Counter((t, *w) for t, w in zip(texts, want, strict=True))
    return docs


def test_repeats_of_shared_passages(spark):
    checked(spark, shared_texts(random.Random(1), 60))


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    """Buckets of a few contexts are too large already, so hot anchors and all blocks are used."""
    monkeypatch.setattr(repeats, "MOST", 3)
    checked(spark, shared_texts(random.Random(2), 60))


def test_hot_anchor_with_different_neighbours(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", 8)
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    checked(spark, ["".join(rng.choices("ijklmnop ", k=150)) + passage + "".join(rng.choices("qrstuvw ", k=150)) for _ in range(80)])


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    checked(spark, shared_texts(random.Random(7), 25))


def test_no_rows_for_repeats(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repeats.digests(docs).count() == 0 and repeats.groups(docs).count() == 0 and repeats.remove(docs).count() == 0


def test_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    make = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage, copy = make(240), make(300)
    texts = [f"{make(50)}{i}{passage}{i}{make(50)}" for i in range(4)] + [copy, copy, copy, make(900)]
    docs = spark.createDataFrame([(i, t, "en", "n", "o", "k") for i, t in enumerate(texts)], SCHEMA)
    rows = repeats.groups(docs).collect()
    found = defaultdict(set)
    for r in rows:
        found[bytes(r.group), r.length].add((r.doc_id, r.begin))
    assert all(len({texts[d][b : b + n] for d, b in places}) == 1 for (_, n), places in found.items())
    places = list(found.values())
    assert {(i, 0) for i in (4, 5, 6)} in places
    assert all(len(p) >= 2 for p in places) and any({d for d, _ in p} == {0, 1, 2, 3} for p in places)
    covered = {k for (_, n), at in found.items() for d, b in at if d == 0 for k in range(b, b + n)}
    assert covered == set(range(51, 291))


def test_intervals_by_brute_force():
    for lcp in ([], [3], [1, 1, 1], [2, 5, 5, 1, 4], [4, 4, 2, 7, 2], [9, 8, 7], [1, 2, 3]):
        got = sorted(repeats.lcp_intervals(lcp))
        want = sorted({(min(lcp[a:b]), *reach(lcp, a, b)) for a in range(len(lcp)) for b in range(a + 1, len(lcp) + 1)})
        assert got == want


def reach(lcp, a, b):
    """The widest suffixes around lcp[a:b] that share its least prefix."""
    least = min(lcp[a:b])
    while a > 0 and lcp[a - 1] >= least:
        a -= 1
    while b < len(lcp) and lcp[b] >= least:
        b += 1
    return a, b


def test_prefixes_of_neighbours():
    """The induced prefixes are those of the sorted suffixes, at every offset."""
    rng = np.random.default_rng(4)
    contexts = [bytes(rng.integers(97, 99, 300).astype(np.uint8)) for _ in range(6)]
    contexts += [contexts[0][:100] + contexts[1][100:], contexts[0][:140] + contexts[2][140:]]
    off = np.full(len(contexts), 120)
    rows, begin, length, number = repeats.maximal_repeats(np.zeros(len(contexts), np.int64), off, np.ones(len(contexts), np.int64), pa.array(contexts, pa.binary()), every=True)
    for k in set(number.tolist()):
        strings = {contexts[r][b : b + n] for r, b, n in zip(rows[number == k], begin[number == k], length[number == k], strict=True)}
        assert len(strings) == 1 and (number == k).sum() >= 2
    covered = {(r, i) for r, b, n in zip(rows.tolist(), begin.tolist(), length.tolist(), strict=True) for i in range(b, b + n - 199)}
    windows = Counter((i, c[i : i + 200]) for c in contexts for i in range(101))
    assert covered == {(r, i) for r, c in enumerate(contexts) for i in range(101) if windows[i, c[i : i + 200]] > 1}
    assert len(covered) > 0


def test_periods_are_one_run():
    texts = ["x" * 5000, "ab" * 900, "abc" * 400 + "tail" * 60, "no period " + "".join(map(chr, range(97, 123))) * 8]
    batch = pa.record_batch({"text": pa.array(texts), "k1": pa.array(range(4), pa.int64()), "k2": pa.array([0] * 4, pa.int32())})
    runs = pa.Table.from_batches(repeats._runs(iter([batch]))).to_pylist()
    assert sum(r["starts"] * r["times"] for r in runs) == sum(len(t) - 199 for t in texts)
    assert len([r for r in runs if r["k1"] == 0]) == 1 and len(runs) < 100
    for r in runs:
        spans = {texts[r["k1"]][r["first"] + t * r["starts"] :][: r["starts"] + 199] for t in range(r["times"])}
        assert len(spans) == 1


def test_very_long_texts_and_odd_rows(spark):
    """A million characters without a space, 200,000 words, nulls, empty texts, repeated rows, no doc_id."""
    rng = random.Random(11)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    texts = [(1, noise), (2, "one two three four five " * 40_000), (3, noise[300_000:300_500] + "."), (4, None), (5, ""), (None, "short"), (6, "short"), (6, "short"), (7, "漢字" * 200_000)]
    df = spark.createDataFrame([(i, t, "en", "n", "o", "k") for i, t in texts], SCHEMA).repartition(3)
    cut = {r.doc_id: r for r in fill_middle.transform(df).collect()}
    assert (cut[1].n, cut[2].n, cut[7].n, cut[4].n) == (1, 400_000, 400_000, 0)
    back = fill_middle.transform(df).select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    audit = filter_audit.interactions(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).filter("filter_order = 'ABCDE'").collect()
    assert {r.step: (r.kept, r.removed) for r in audit} == {1: (1, 8), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    got = {(r.doc_id, r.text): r for r in repeats.remove(df).collect()}
    assert (got[1, noise].n_removed, got[1, noise].n_spans) == (500, 1) and got[3, texts[2][1]].n_removed == 500 and bytes(got[3, texts[2][1]].kept) == b"."
    assert got[2, texts[1][1]].n_removed == len(texts[1][1]) and got[7, texts[8][1]].n_removed == 1_200_000 and got[6, "short"].n_removed == 0 and got[4, None].n_bytes == 0
    assert repeats.digests(df).count() == 9
