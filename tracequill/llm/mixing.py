"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's target
divided by its source's words. The whole part is taken; the fractional parts are rounded
dependently: two documents meet, words of probability move at random from one to the other
until the probability of one is 0 or 1, and the other goes on to the next meeting. Documents
meet in groups of bounded size; what is left fractional in a group (one document) meets the
others' rests one level up, until one document of each source is left, which a keyed coin
decides. The taken words of a source are thus off its target by one document at most.

Cases: a null text has 0 words, and a document without words takes nothing; null sources are a
source of their own (last); rows that agree in doc_id, source and size are one unit, taken or
left together; an empty table gives no rows; other columns of the input are kept by mix()
and may have any names but those it adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
GROUP = 1_000
FAN = 256
SEED = 20_240_601
_UNIT = "unit binary, source string, grp long, size double, p double"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: one row for each source.

    target = least of most * source_size and level * weight, with the level at which all targets
    make up share of all words. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    per = per.withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        / F.sum("w").over(onward),
    )
    open_level = F.min(F.when(F.col("ceiling") / F.col("w") >= F.col("level"), F.struct(F.col("ceiling") / F.col("w"), "level"))).over(everything)
    per = per.withColumn("at", open_level["level"])
    target = F.when(F.col("at").isNull(), F.col("ceiling")).otherwise(F.least("ceiling", F.col("at") * F.col("w")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Round the probabilities p of units of so many words; one of them at most stays fractional.

    sum(p * sizes) stays as it is, and so does the expected value of each p.
    """
    p = p.copy()
    held = -1
    draws = random.random(len(p))
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        sa, sb = sizes[a], sizes[b]
        up, down = min((1 - p[a]) * sa, p[b] * sb), min(p[a] * sa, (1 - p[b]) * sb)
        if draws[i] * (up + down) < down:
            moved, ends = up, (1.0, 0.0)
            fills_a = (1 - p[a]) * sa <= p[b] * sb
        else:
            moved, ends = -down, (0.0, 1.0)
            fills_a = p[a] * sa <= (1 - p[b]) * sb
        if fills_a:
            p[b] = min(1.0, max(0.0, p[b] - moved / sb))
            p[a] = ends[0]
            held = b if 0.0 < p[b] < 1.0 else -1
        else:
            p[a] = min(1.0, max(0.0, p[a] + moved / sa))
            p[b] = ends[1]
            held = a if 0.0 < p[a] < 1.0 else -1
    return p


def _round_group(seed: int, level: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("size", "descending"), ("unit", "ascending")])
        grp = rows.column("grp")[0].as_py()
        name = rows.column("source")[0].as_py()
        random = np.random.default_rng([seed, level, grp, *(name or "\0").encode("utf-8", "surrogatepass")])
        p = pivot(rows.column("size").to_numpy(), rows.column("p").to_numpy(), random)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return run


def _copies(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """unit, doc_id, source, size, m, source_size, target, copies: a row for each unit."""
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    name = F.sha2(F.to_json(F.struct("doc_id", "source", "size"), {"ignoreNullFields": "false"}), 256)
    units = units.withColumn("unit", F.unhex(name))
    units = units.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("whole", F.floor(rate + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-12)))
    units = units.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP)))
    units = materialize(units, "mix-units")
    deal = F.pmod(F.xxhash64(F.lit(seed), "unit"), F.col("groups"))
    level_rows = units.filter("rest > 0 and size > 0").select("unit", "source", deal.alias("grp"), (F.col("size") * F.col("m")).cast("double").alias("size"), F.col("rest").alias("p"))
    most = units.agg(F.max("groups")).first()[0] or 1
    settled, level = [], 0
    while True:
        rounded = materialize(level_rows.groupBy("source", "grp").applyInArrow(_round_group(seed, level), _UNIT), f"mix-level{level}")
        settled.append(rounded.filter("p = 0 or p = 1").select("unit", F.col("p").cast("long").alias("extra")))
        level_rows = rounded.filter("p > 0 and p < 1").withColumn("grp", F.expr(f"grp div {FAN}"))
        if most <= 1:
            break
        most, level = -(-most // FAN), level + 1
    coin = F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.lit(1 << 40)) / float(1 << 40)
    settled.append(level_rows.select("unit", (coin < F.col("p")).cast("long").alias("extra")))
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionAll(more)
    return units.join(extra, "unit", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def taken(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of docs."""
    sizes = materialize(sized(docs), "mix-sizes")
    units = _copies(sizes, source_targets(sizes, **targets), seed)
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0, 1 or more times).

    Documents without words are kept once if the source's rate is 1 or more, else left.
    """
    sizes = materialize(sized(docs), "mix-sizes")
    units = _copies(sizes, source_targets(sizes, **targets), seed).filter("copies > 0")
    units = units.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").cast("int").alias("__copies"))
    rows = docs.withColumn("__n", word_count(F.col("text")))
    joined = rows.join(units, rows["doc_id"].eqNullSafe(units["__id"]) & rows["source"].eqNullSafe(units["__source"]) & (rows["__n"] == units["__size"]))
    repeated = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[docs[c] for c in docs.columns])
