"""Interval algebra over half-open intervals (contig, start, end).

Tables may carry other keys beside contig (a sample, a context): pass them as ``by``. Overlap
joins deal intervals to bins of a fixed width and join on (keys, bin); a pair is kept in its first
common bin only, so no distinct is needed and no contig is compared with itself as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 25_000
BLOCK = 1_000_000
#: About how many intervals of one side a task pairs where pairs are ordered: a file's dictionary of ids then holds them all.
PAIRED_ROWS = 50_000
#: How many intervals of a bin's one side are paired with the other side as a whole.
TILE = 128
Keys = Sequence[str]


def invalid(df: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Rows that are no intervals: a null, a negative start, or an end before (or at) the start."""
    short = (F.col("end") < F.col("start")) if allow_empty else (F.col("end") <= F.col("start"))
    bad = F.col("contig").isNull() | F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | short
    return df.filter(bad)


def merge(df: DataFrame, by: Keys = ("contig",), block: int = BLOCK) -> DataFrame:
    """Maximal runs of intervals that overlap or touch: by, start, end, n_merged.

    A contig may hold a large part of all rows, so the sweep runs in blocks of positions: what reaches
    into a block from before, and how many runs began before it, are prefix values over the blocks.
    """
    keys = list(by)
    rows = df.select(*keys, "start", "end", F.floor(F.col("start") / block).alias("__block"))
    inside = Window.partitionBy(*keys, "__block").orderBy("start", "end")
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "__block").agg(F.max("end").alias("__most")).withColumn("__before", F.max("__most").over(earlier)).drop("__most")
    rows = _with_blocks(rows, ends, keys, "__before")
    reach = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    rows = rows.withColumn("__new", (reach.isNull() | (F.col("start") > reach)).cast("long"))
    begun = rows.groupBy(*keys, "__block").agg(F.sum("__new").alias("__n")).withColumn("__runs", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    rows = _with_blocks(rows, begun, keys, "__runs")
    run = F.col("__runs") + F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("__run", run).groupBy(*keys, "__run")
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_merged")).drop("__run")


def _with_blocks(rows: DataFrame, values: DataFrame, keys: list[str], name: str) -> DataFrame:
    renamed = values.select(*[F.col(k).alias(f"__v_{k}") for k in (*keys, "__block")], name)
    on = F.lit(True)
    for k in (*keys, "__block"):
        on &= F.col(k).eqNullSafe(F.col(f"__v_{k}"))
    return rows.join(renamed, on, "left").drop(*[f"__v_{k}" for k in (*keys, "__block")])


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _binned(df: DataFrame, width: int, prefix: str) -> DataFrame:
    renamed = df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])
    start, end = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    bins = F.sequence(F.floor(start / width), F.floor((end - 1) / width))
    return renamed.filter(end > start).withColumn(f"{prefix}bin", F.explode(bins))


def _in_order(df: DataFrame, by: Keys, prefix: str, tasks: int) -> DataFrame:
    """Rows dealt by their bins and ordered by position in each. A window orders them, since Spark drops a plain sort below a join."""
    bins = [f"{prefix}{k}" for k in (*by, "bin")]
    place = F.row_number().over(Window.partitionBy(*bins).orderBy(f"{prefix}start", f"{prefix}end"))
    return df.repartition(tasks, *bins).withColumn("__place", place).filter("__place > 0").drop("__place")


def overlap_join(a: DataFrame, b: DataFrame, by: Keys = ("contig",), width: int = BIN, ordered: bool = False) -> DataFrame:
    """All pairs of a and b that share a position; columns a_* and b_*, each pair once.

    ordered: a bin's pairs come by the positions of a, then of b, and by as many tasks as a and b ask for. Neighbours share most of
    their partners, so a columnar file of all pairs holds runs and repeats instead of each pair by itself.
    """
    x, y = _binned(a, width, "a_"), _binned(b, width, "b_")
    if ordered:
        spark = a.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(a.count(), b.count()) // PAIRED_ROWS))
        x, y = _in_order(x, by, "a_", tasks), _in_order(y, by, "b_", tasks)
    on = F.col("a_bin") == F.col("b_bin")
    for k in by:
        on &= F.col(f"a_{k}") == F.col(f"b_{k}")
    on &= (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return x.join(y, on & (F.col("a_bin") == first)).drop("a_bin", "b_bin")


def _dealt(df: DataFrame, by: Keys, width: int, least: int, prefix: str, tasks: int) -> DataFrame:
    """Rows with the end that an interval of the other side must begin before, dealt by the bins that they touch up to there."""
    start, short = F.col("start"), F.col("end") - (least - 1)
    rows = df.filter(short > start).select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns], short.alias(f"{prefix}short"))
    bins = F.sequence(F.floor(F.col(f"{prefix}start") / width), F.floor((F.col(f"{prefix}short") - 1) / width))
    return rows.withColumn(f"{prefix}bin", F.explode(bins)).repartition(tasks, *[f"{prefix}{k}" for k in (*by, "bin")])


def tiled_join(a: DataFrame, b: DataFrame, by: Keys = ("contig",), width: int = BIN, least: int = 1, group: str | None = None, tile: int = TILE) -> DataFrame:
    """All pairs of a and b that share ``least`` positions, each once; columns a_* and b_* (by as a_* alone).

    With a group column a pair's groups differ. The intervals of b in a bin (and group) are put to tiles by position; a tile meets each
    interval of a as one row, if their bounds do, and is opened then. So little is compared one by one that isn't kept, a task holds a
    bin's rows of a and one tile, and a tile's pairs follow each other by a's position: a columnar file of them holds runs and repeats.
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(a.count() + b.count()) // PAIRED_ROWS))
    keys, groups = [*by, "bin"], [group] if group else []
    x, y = _dealt(a, by, width, least, "a_", tasks), _dealt(b, by, width, least, "b_", tasks)
    place = F.row_number().over(Window.partitionBy(*[f"a_{k}" for k in keys]).orderBy("a_start", "a_end"))
    x = x.withColumn("__place", place).filter("__place > 0").drop("__place")  # in order of position; Spark drops a plain sort below a join
    place = F.row_number().over(Window.partitionBy(*[f"b_{k}" for k in (*keys, *groups)]).orderBy("b_start", "b_end"))
    fields = [c for c in y.columns if c not in {f"b_{k}" for k in (*keys, *groups, "start")}]
    y = y.withColumn("__tile", F.floor((place - 1) / tile)).groupBy(*[F.col(f"b_{k}").alias(f"__{k}") for k in (*keys, *groups)], "__tile")
    y = y.agg(F.min("b_start").alias("__least"), F.max("b_short").alias("__most"), F.sort_array(F.collect_list(F.struct("b_start", *sorted(fields)))).alias("__rows"))
    on = (F.col("a_start") < F.col("__most")) & (F.col("a_short") > F.col("__least"))
    for k in keys:
        on &= F.col(f"a_{k}") == F.col(f"__{k}")
    if group:
        on &= F.col(f"a_{group}") != F.col(f"__{group}")
    met = y.join(x, on).select(*x.columns, *[F.col(f"__{g}").alias(f"b_{g}") for g in groups], F.inline("__rows"))
    both = (F.col("a_start") < F.col("b_short")) & (F.col("a_short") > F.col("b_start"))
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return met.filter(both & (F.col("a_bin") == first)).drop("a_bin", "a_short", "b_short")


def intersect(a: DataFrame, b: DataFrame, by: Keys = ("contig",), width: int = BIN) -> DataFrame:
    """Positions in both: the sets are merged, intersected and merged again."""
    pairs = overlap_join(merge(a, by), merge(b, by), by, width)
    cut = pairs.select(*[F.col(f"a_{k}").alias(k) for k in by], F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    return merge(cut, by).drop("n_merged")


def clip(windows: DataFrame, intervals: DataFrame, key: str, by: Keys = ("contig",), width: int = BIN) -> DataFrame:
    """The parts of intervals inside each window: key, by, start, end, segment_rank (from 1 by start)."""
    pairs = overlap_join(windows, intervals, by, width)
    parts = pairs.select(F.col(f"a_{key}").alias(key), *[F.col(f"a_{k}").alias(k) for k in by], F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start", "end"))
    return parts.withColumn("segment_rank", rank)


def covered_length(windows: DataFrame, intervals: DataFrame, key: str, by: Keys = ("contig",), width: int = BIN) -> DataFrame:
    """key and covered, the positions of each window that intervals (merged first) cover; 0 for none."""
    pairs = overlap_join(windows, merge(intervals, by), by, width)
    sums = pairs.groupBy(F.col(f"a_{key}").alias("__key")).agg(F.sum(overlap_length(*[F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")])).alias("c"))
    return windows.select(key).join(sums, F.col(key) == F.col("__key"), "left").select(key, F.coalesce("c", F.lit(0)).cast("long").alias("covered"))


def pad(df: DataFrame, by: int, lengths: DataFrame | None = None) -> DataFrame:
    """Intervals widened on both sides, kept within their contigs (contig, length), and merged."""
    wide = df.select("contig", F.greatest(F.lit(0), F.col("start") - by).cast("long").alias("start"), (F.col("end") + by).cast("long").alias("end"))
    if lengths is not None:
        own = lengths.select(F.col("contig").alias("__contig"), "length")
        wide = wide.join(own, F.col("contig") == F.col("__contig")).select("contig", "start", F.least("end", "length").alias("end"))
    return merge(wide).drop("n_merged")


def region_status(records: DataFrame, regions: DataFrame, key: str, merged: bool = True, width: int = BIN) -> DataFrame:
    """key and status of each record: INSIDE one region, OUTSIDE of all, else BORDER.

    merged tells whether touching regions count as one; records without extent are OUTSIDE.
    """
    sets = merge(regions) if merged else regions
    pairs = overlap_join(records, sets, ("contig",), width)
    within = (F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end"))
    found = pairs.groupBy(F.col(f"a_{key}").alias("__key")).agg(F.bool_or(within).alias("inside"))
    status = F.when(F.col("inside").isNull(), F.lit("OUTSIDE")).when(F.col("inside"), F.lit("INSIDE")).otherwise(F.lit("BORDER"))
    return records.select(key).join(found, F.col(key) == F.col("__key"), "left").select(key, status.alias("status"))


def not_contained(panel: DataFrame, cover: DataFrame, key: str) -> DataFrame:
    """Intervals of the panel that no merged interval of the cover holds whole."""
    return region_status(panel, cover, key).filter("status <> 'INSIDE'")


def stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_intervals"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_bases"), F.countDistinct("contig").alias("n_contigs"))


def windows_at(anchors: DataFrame, half: int, keep: Sequence[str] = ()) -> DataFrame:
    """The window of 2 * half positions around the middle of each anchor, moved right at the contig's start."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    start = F.greatest(F.lit(0).cast("long"), middle - half)
    return anchors.select(*keep, "contig", F.col("start").alias("anchor_start"), F.col("end").alias("anchor_end"), start.alias("start"), (start + 2 * half).alias("end"))


def autosomes(df: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    names = [f"chr{i}" for i in range(1, 23) if f"chr{i}" not in without]
    return df.filter(F.col("contig").isin(names))


def crossing_pairs(df: DataFrame, key: str, least: int, group: str | None = None, width: int = BIN) -> DataFrame:
    """Pairs of intervals (of different groups, if a group column is given) that share ``least`` positions or more, the lesser key first."""
    rows = df.select(*dict.fromkeys(("contig", "start", "end", key, *([group] if group else []))))
    pairs = tiled_join(rows, rows, width=width, least=least, group=group).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))
    length = overlap_length(*[F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")])
    return pairs.select(f"a_{key}", f"b_{key}", length.alias("overlap"))


def boundary_diagnostics(records: DataFrame, core: DataFrame, key: str, event: str) -> DataFrame:
    """Records with their classification: CORE_EXPORTED if their event's bounds as a whole lie in the merged core.

    A record of another event is BOUNDARY_EVENT_DIAGNOSTIC if it lies in the core itself, else PADDING_OR_OUTSIDE_CORE_DIAGNOSTIC.
    """
    bounds = records.groupBy(event).agg(F.min("contig").alias("contig"), F.max("contig").alias("__other"), F.min("start").alias("start"), F.max("end").alias("end"))
    of_event = region_status(bounds.filter(F.col("contig") == F.col("__other")), core, event).withColumnRenamed(event, "__event").withColumnRenamed("status", "__of_event")
    own = region_status(records, core, key).withColumnRenamed(key, "__key").withColumnRenamed("status", "__own")
    rows = records.join(of_event, F.col(event) == F.col("__event"), "left").join(own, F.col(key) == F.col("__key"))
    what = F.when(F.col("__of_event") == "INSIDE", F.lit("CORE_EXPORTED")).when(F.col("__own") == "INSIDE", F.lit("BOUNDARY_EVENT_DIAGNOSTIC")).otherwise(F.lit("PADDING_OR_OUTSIDE_CORE_DIAGNOSTIC"))
    return rows.withColumn("classification", what).drop("__event", "__of_event", "__key", "__own")
