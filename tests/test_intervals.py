import random
import re

import pytest
from pyspark.sql import functions as F

from tracequill.operators import intervals, selection

SCHEMA = "contig string, start long, end long"


def _random(seed, n=60, span=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(span)
        rows.append((rng.choice("ab"), s, s + rng.randint(1, 30)))
    return rows


def _positions(rows):
    return {(c, p) for c, s, e in rows for p in range(s, e)}


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", range(4))
def test_merge_and_intersect_against_positions(spark, seed):
    a, b = _random(seed), _random(seed + 100)
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    for block in (7, 50, 1_000_000):
        merged = _rows(intervals.merge(da, block=block), "contig", "start", "end")
        assert _positions(merged) == _positions(a)
        for x, y in zip(merged, merged[1:], strict=False):
            assert x[0] != y[0] or x[2] < y[1]
    both = _rows(intervals.intersect(da, db, width=16), "contig", "start", "end")
    assert _positions(both) == _positions(a) & _positions(b)


@pytest.mark.parametrize("width", [5, 64, 10_000])
def test_overlap_join_gives_each_pair_once(spark, width):
    a, b = _random(7), _random(8)
    da = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "id long, " + SCHEMA)
    db = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "id long, " + SCHEMA)
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert _rows(intervals.overlap_join(da, db, width=width), "a_id", "b_id") == want
    covered = dict(_rows(intervals.covered_length(da, db, "id", width=width), "id", "covered"))
    inside = _positions(b)
    assert covered == {i: sum((x[0], p) in inside for p in range(x[1], x[2])) for i, x in enumerate(a)}


def test_status_pad_and_errors(spark):
    regions = spark.createDataFrame([("a", 10, 20), ("a", 20, 30)], SCHEMA)
    records = spark.createDataFrame([(1, "a", 12, 28), (2, "a", 5, 15), (3, "b", 1, 2), (4, "a", 30, 31)], "id long, " + SCHEMA)
    assert _rows(intervals.region_status(records, regions, "id"), "id", "status") == [(1, "INSIDE"), (2, "BORDER"), (3, "OUTSIDE"), (4, "OUTSIDE")]
    assert _rows(intervals.region_status(records, regions, "id", merged=False), "id", "status")[0] == (1, "BORDER")
    lengths = spark.createDataFrame([("a", 33)], "contig string, length long")
    assert _rows(intervals.pad(regions, 12, lengths), "contig", "start", "end") == [("a", 0, 33)]
    bad = spark.createDataFrame([("a", 5, 5), ("a", -1, 3), (None, 1, 2), ("a", 1, 2)], SCHEMA)
    assert intervals.invalid(bad).count() == 3
    assert intervals.invalid(bad, allow_empty=True).count() == 2
    assert intervals.merge(regions.limit(0)).count() == 0


def test_greedy_reasons_in_order():
    rows = [{"contig": c, "start": s, "end": s + 100} for c, s in (("a", 0), ("a", 50), ("a", 300), ("a", 600), ("b", 0), ("b", 500))]
    rules = selection.Rules(per_contig=2, per_context=3, cross_overlap=50)
    chosen, seen = selection.greedy(rows, [{"contig": "b", "start": 40, "end": 140}], rules)
    assert [r["rejection_reason"] for r in seen] == ["", "WITHIN_CONTEXT_OVERLAP", "", "MAX_WINDOWS_PER_CHROMOSOME", "CROSS_CONTEXT_OVERLAP_GE_50_PERCENT", ""]
    assert [(r["contig"], r["start"], r["chromosome_selection_rank"]) for r in chosen] == [("a", 0, 1), ("a", 300, 2), ("b", 500, 1)]


def test_candidates_keep_the_first_anchor(spark):
    anchors = spark.createDataFrame([("a", 100, 110, 2), ("a", 101, 109, 1), ("a", 5, 9, 3)], SCHEMA + ", ordinal long")
    cover = spark.createDataFrame([("a", 0, 1000)], SCHEMA)
    rows = selection.candidates(anchors, cover, {"assembly": "A"}, "w", "s", selection.Rules(half_window=50, least_assessable=10))
    assert _rows(rows, "start", "end", "ordinal", "assessable_bp") == [(0, 100, 3, 100), (55, 155, 1, 100)]
    assert rows.filter(F.sha2(F.concat(F.lit("s|"), "candidate_id"), 256) != F.col("selection_hash")).count() == 0


@pytest.mark.parametrize("width", [5, 64])
def test_ordered_pairs_are_all_pairs_by_position(spark, width):
    frames = [spark.createDataFrame([(i, *r) for i, r in enumerate(_random(seed, 200))], "id long, " + SCHEMA) for seed in (7, 8)]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")  # as for tables that are too large to be broadcast
        parts = intervals.overlap_join(*frames, width=width, ordered=True).rdd.glom().collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sorted((r.a_id, r.b_id) for p in parts for r in p) == _rows(intervals.overlap_join(*frames, width=width), "a_id", "b_id")
    for part in parts:
        of_bins = {}
        for r in part:
            of_bins.setdefault((r.a_contig, max(r.a_start, r.b_start) // width), []).append((r.a_start, r.a_end, r.a_id, r.b_start, r.b_end))
        for rows in of_bins.values():
            assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)  # a's pairs come by position,
            runs = [i for i, r in enumerate(rows) if i == 0 or r[2] != rows[i - 1][2]]
            assert len(runs) == len({r[2] for r in rows})  # follow each other,
            for i, j in zip(runs, [*runs[1:], len(rows)], strict=True):
                assert [r[3:] for r in rows[i:j]] == sorted(r[3:] for r in rows[i:j])  # and come by b's position


@pytest.mark.parametrize(("width", "least", "tile"), [(5, 1, 4), (64, 1, 4), (64, 9, 2), (10_000, 3, 128)])
def test_tiles_give_each_pair_once(spark, width, least, tile):
    a, b = _random(7, 90), [*_random(8, 90), *[("a", 50, 70)] * 20]
    da, db = [spark.createDataFrame([(i, i % 3, *r) for i, r in enumerate(rows)], "id long, g long, " + SCHEMA) for rows in (a, b)]
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= least)
    assert _rows(intervals.tiled_join(da, db, width=width, least=least, tile=tile), "a_id", "b_id") == want
    apart = [(i, j) for i, j in want if i % 3 != j % 3]
    assert _rows(intervals.tiled_join(da, db, width=width, least=least, tile=tile, group="g"), "a_id", "b_id") == apart
    own = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(b) for j, y in enumerate(b) if i < j and x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= least)
    assert _rows(intervals.crossing_pairs(db, "id", least, width=width), "a_id", "b_id", "overlap") == own
    assert _rows(intervals.crossing_pairs(db, "id", least, "g", width=width), "a_id", "b_id", "overlap") == [r for r in own if r[0] % 3 != r[1] % 3]


def test_tiles_meet_intervals_by_their_bounds(spark):
    """What is joined is tiles of rows; they are opened behind the join."""
    df = spark.range(3000).selectExpr("id", "id % 2 g", "'a' contig", "id div 5 start", "id div 5 + 5 + id % 6 `end`")
    plan = intervals.crossing_pairs(df, "id", 9, "g", width=40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and re.search(r"Join Inner, .*__most", plan)
