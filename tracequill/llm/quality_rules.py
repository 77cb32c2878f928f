"""Quality rules with thresholds that the data set: mergeable quantile sketches by language and source.

Measures of each text are taken by built-in functions alone. A KLL sketch of each measure is
built for each (lang, source) over the documents that pass the base rules, and merged into one
for each language and one for all. A rate's threshold in a group is its quantile HIGH plus SPREAD times that
quantile's distance from the median, so a source whose texts are full of symbols or refrains sets its own;
mean word length has two, SPREAD times the distance of its quartiles from the outer one. Where a rate is 0 in most
of a group its threshold is 0 or little more; then single occurrences would decide, so a rate counts only with more than
EVENTS occurrences in the document (symbols, repeated lines, repeated phrases of six words). Groups of under LEAST
documents use their language's sketch, small languages the global one. Documents are then joined with their group's thresholds.

Cases: a null text has no words, so it fails the base rules; null lang or source is a group of
its own; sketches keep every value while a group has up to SKETCH_K documents and are within
rank error of about 1/SKETCH_K beyond; repeated rows count each time; an empty table gives no
rows. Equality of word triples is that of a 64-bit hash of the three words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED = 50
SKETCH_K = 4096
LEAST = 50
SPREAD = 3.0
HIGH = 0.9
EVENTS = 5
#: measure: quantiles (of the inner and the outer end of its spread) and how many occurrences its rate counts
MEASURES = {"symbol_rate": (0.5, HIGH), "dup_line_rate": (0.5, HIGH), "repeat_rate": (0.5, HIGH), "word_length": (0.25, 0.75)}
OCCURRENCES = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words / 6"}


def words_of(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def _found(sorted_values: Column, x: Column) -> Column:
    """Whether the sorted array holds x: straight for a few values, by bisection for many."""
    n = F.size(sorted_values)
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(26, -1, -1)]), lambda s: s < n)
    at = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(((lo + s) < n) & (F.get(sorted_values, lo + s) <= x), lo + s).otherwise(lo))
    return F.when(n <= 24, F.array_contains(sorted_values, x)).otherwise(F.get(sorted_values, at) == x)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every text, in one pass without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    base = base.withColumn("words", words_of(F.col("text")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    counted = base.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    words = F.col("words")
    grams = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    rows = counted.withColumn("grams", grams).drop("words")
    rows = rows.withColumn("ordered", F.sort_array("grams"))
    ordered = F.col("ordered")
    rows = rows.withColumn("twice", F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1))))).drop("ordered")
    grams, twice = F.col("grams"), F.col("twice")
    at = F.filter(F.transform(grams, lambda x, i: F.when(_found(twice, x), i)), lambda i: i.isNotNull())
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    repeats = F.when(F.size(twice) == 0, F.lit(0)).otherwise(covered).cast("long")
    return rows.withColumn("n_repeat_words", repeats).drop("grams", "twice")


def rated(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumns({
        "base_failed": failed,
        "symbol_rate": F.col("n_symbols") * 100.0 / n,
        "dup_line_rate": F.col("n_dup_lines") * 100.0 / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") * 100.0 / n,
        "word_length": F.col("word_chars") * 1.0 / n,
    })


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and for each measure its fences: a row for each group of rows."""
    good = rows.groupBy("lang", "source").agg(
        F.count_if(~F.col("base_failed")).alias("n"),
        *[F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(m)), F.lit(SKETCH_K)).alias(m) for m in MEASURES],
    )
    good = materialize(good, "rules-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]]
    fences = lambda df: df.select(*[c for c in df.columns if c not in MEASURES], *[x for m in MEASURES for x in _fences(m)])
    own = fences(good)
    by_lang = fences(good.groupBy(F.col("lang").alias("g_lang")).agg(*merged))
    overall = fences(good.agg(*merged)).first()  # one row of the whole data set
    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    of_all = lambda n: F.lit(overall[n]).cast("double")
    pick = lambda n: F.when(F.col("own.n") >= LEAST, F.col(f"own.{n}")).when(F.col("of_lang.n") >= LEAST, F.col(f"of_lang.{n}")).otherwise(of_all(n))
    rows = own.alias("own").join(by_lang.alias("of_lang"), F.col("own.lang").eqNullSafe(F.col("of_lang.g_lang")))
    return rows.select(F.col("own.lang").alias("t_lang"), F.col("own.source").alias("t_source"), *[pick(n).alias(n) for n in names])


def _fences(measure: str) -> list[Column]:
    known = F.when(F.col("n") > 0, F.col(measure))
    inner, outer = (F.kll_sketch_get_quantile_double(known, F.lit(q)) for q in MEASURES[measure])
    reach = SPREAD * (outer - inner)
    lower = inner - reach if measure == "word_length" else F.lit(None).cast("double")
    return [lower.alias(f"{measure}_low"), (outer + reach).alias(f"{measure}_high")]


def judge(docs: DataFrame) -> DataFrame:
    """The measures, thresholds, base_failed and kept of every row of docs."""
    rows = materialize(rated(measures(docs)), "rules-measures")
    limits = thresholds(rows)
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        below = F.col(m) <= F.col(f"{m}_high")
        if m in OCCURRENCES:
            below |= F.expr(OCCURRENCES[m]) <= EVENTS
        inside &= F.coalesce(below, F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    kept = ~F.col("base_failed") & inside
    return joined.withColumn("kept", kept).drop("t_lang", "t_source")
