"""An ordered hash tree of a table: whether two builds are the same, and if not, in which range of keys they first differ.

Rows are numbered in a total order without meeting in one task. CHUNK rows that follow each other are a leaf, FAN nodes that
follow each other a node above; a node's digest is that of its parts' digests in order. Trees of equal tables are equal however the
tables are partitioned. Differences are looked for from the root down, so that a level's part below nodes that are equal isn't
looked at. Nothing but node numbers comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.operators.evidence import numbered
from tracequill.sources.storage import cut

CHUNK = 1024
FAN = 64


def _combined(rows: DataFrame, node: Column, level: int) -> DataFrame:
    """The nodes of parts (at, digest, n_rows, first, last), whose number within a node is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("at", "digest", "first", "last")))
    nodes = rows.groupBy(node.alias("node")).agg(parts.alias("parts"), F.sum("n_rows").alias("n_rows"))
    digest = F.sha2(F.array_join(F.col("parts.digest"), ""), 256)
    return nodes.select(F.lit(level).alias("level"), "node", digest.alias("digest"), "n_rows", F.element_at("parts", 1)["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"))


def hash_tree(df: DataFrame, *order: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """level (leaves are 0), node, digest, n_rows, and the first and last key of each node, as canonical JSON of ``order``.

    ``order`` must be total. The highest level has one node; an empty table has no node.
    """
    key = canonical.canonical_json({c: F.col(c) for c in order}, ascii=False)
    rows = numbered(df, "__place", *order)  # before digests are made: dealing by range reads its rows twice
    rows = rows.select(F.col("__place").alias("at"), F.sha2(canonical.row_json(df, ascii=False), 256).alias("digest"), key.alias("first"))
    rows = rows.select("at", "digest", "first", F.col("first").alias("last"), F.lit(1).cast("long").alias("n_rows"))
    level, n = cut(_combined(rows, F.floor((F.col("at") - 1) / chunk), 0)), 0
    tree = level
    while level.select("node").limit(2).count() > 1:
        n += 1
        level = cut(_combined(level.withColumnRenamed("node", "at"), F.floor(F.col("at") / fan), n))
        tree = tree.unionByName(level)
    return tree


def first_difference(one: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """The first leaf in which two trees differ: node, and the first and last key that it has in either; no row if they are equal.

    Trees of different heights are compared from the lower root on. A leaf that one tree lacks has null keys there.
    """
    top = min(t.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] for t in (one, other))
    a, b = (t.select("level", "node", *[F.col(c).alias(f"{name}_{c}") for c in ("digest", "first", "last")]) for t, name in ((one, "one"), (other, "other")))
    both = a.join(b, ["level", "node"], "full_outer").filter(~F.col("one_digest").eqNullSafe(F.col("other_digest")))
    within = F.lit(True)
    for level in range(max(top, 0), -1, -1):
        node = both.filter((F.col("level") == level) & within).agg(F.min("node")).first()[0]
        if node is None:
            return both.limit(0).drop("level", "one_digest", "other_digest")
        within = F.col("node").between(node * fan, node * fan + fan - 1)
    return both.filter((F.col("level") == 0) & (F.col("node") == node)).drop("level", "one_digest", "other_digest")
