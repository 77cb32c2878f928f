"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import numpy as np
import pytest

from tracequill.plans import registered, rules, stored  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registered.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    twin = duck.sql(registered.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    assert not [t for t in twin.types if "HUGEINT" in str(t)]
    assert rows == sorted(twin.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)


def test_greedy_selection(spark):
    from tracequill.operators import selection

    rows = [r.asDict() for r in registered.queries()["greedy_selection"](spark, SF).collect()]
    rules = registered._RULES
    assert 0 < len(rows) <= rules.per_context
    assert [r["selection_rank"] for r in rows] == list(range(1, len(rows) + 1))
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            assert selection._overlap(a, b) == 0


def test_greedy_evaluation(spark):
    from tracequill.operators import selection

    rows = registered._candidates(registered.Roles(spark, SF)).select("candidate_id", "selection_hash", "contig", "start", "end").collect()
    rules, chosen, seen = registered._RULES, [], {}
    for rank, c in enumerate(sorted(rows, key=lambda r: (r.selection_hash, r.candidate_id)), 1):
        same = [w for w in chosen if w.contig == c.contig]
        why = "MAX_WINDOWS_PER_CHROMOSOME" if len(same) >= rules.per_contig else "WITHIN_CONTEXT_OVERLAP" if any(w.start < c.end and c.start < w.end for w in same) else ""
        n, _ = seen.get(why, (0, 0))
        seen[why] = (n + 1, rank)
        if not why:
            chosen.append(c)
        if len(chosen) == rules.per_context:
            break
    got = {r.rejection_reason: (r.n, r.last_rank) for r in registered.queries()["greedy_evaluation"](spark, SF).collect()}
    assert got == seen
    with pytest.raises(ValueError, match="of 99 windows"):
        selection.select_context(registered._candidates(registered.Roles(spark, SF)), [], selection.Rules(per_context=99, per_contig=1))
