"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

All columns are DataFrame expressions. A sketch is a histogram over whole numbers whose bucket widths grow with
the value (at most 1/16 of it), so sketches of any two row sets merge by adding counts, every error is bounded
and any engine gets the same quantiles. Sketches are per (lang, source, measure); each rolls up into its
language and into the whole, which stand in where a group has too few documents for a quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm import common

#: Symbols counted as noise (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Measures, whole numbers each: (name, units of a document that it counts in, units by which one document may be off by chance).
MEASURES = (("word_len_pct", "n_words", 0), ("symbol_pmil", "word_chars", 10), ("dup_line_pmil", "n_lines", 2), ("repeat_pmil", "n_words", 10))
#: A fence stands beyond the outer tenth of a group by so many times that tenth's distance from the median.
FENCE = 2
#: The mean word length of a short text is uncertain: its fences widen by this over the root of the number of words.
WORD_LEN_NOISE = 1500
#: Documents a group needs for thresholds of its own.
LEAST_DOCS = 100
#: Values below this have a bucket each; above, each power of two has 16 buckets.
EXACT_BELOW = 16


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_columns(docs: DataFrame) -> DataFrame:
    """All columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed.

    Null text counts as empty: zeros, and base_failed, since it has fewer than 10 words.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed")
    text = F.coalesce(F.col("text"), F.lit(""))
    blanked = F.trim(F.translate(text, common.SPACES, " " * len(common.SPACES)))
    rows = docs.drop(*added).withColumn("_words", F.when(blanked == "", F.array().cast("array<string>")).otherwise(F.split(blanked, " +")))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("word_chars", F.length(_without(text, common.SPACES)).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: _without(x, common.SPACES) != ""))
    rows = rows.withColumn("n_lines", F.size("_lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    window_hash = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(5)))
    )
    rows = rows.withColumn("_windows", F.when(F.size("_words") >= 5, window_hash).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    rows = rows.withColumn("_placed", F.when(F.col("_repeats"), placed))
    twice = F.filter(
        "_placed",
        lambda x, i: F.coalesce(F.get("_placed", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_placed", i + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["p"])))
    new_words = F.transform("_starts", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_starts", i + 1) - p, F.lit(5))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(new_words, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(*(c for c in docs.columns if c not in added), *added)


def measures(rows: DataFrame) -> DataFrame:
    """Adds the whole-number measures; rows without words or lines have zeros."""

    def per(a: str, b: str, scale: int) -> Column:
        return F.coalesce(F.floor(scale * F.col(a) / F.when(F.col(b) > 0, F.col(b))), F.lit(0)).cast("long")

    return rows.withColumns(
        {
            "word_len_pct": per("word_chars", "n_words", 100),
            "symbol_pmil": per("n_symbols", "word_chars", 1000),
            "dup_line_pmil": per("n_dup_lines", "n_lines", 1000),
            "repeat_pmil": per("n_repeat_words", "n_words", 1000),
        }
    )


def bucket_floor(value: Column) -> Column:
    """Least value of the bucket that a value of at least 0 falls in."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.when(value < EXACT_BELOW, value).otherwise(value - F.pmod(value, width))


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket); adding the counts of equal keys merges two sketch tables.

    Rows that base rules reject don't say what a group looks like and are left out.
    """
    names = [m for m, _, _ in MEASURES]
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in names))
    long = rows.select("lang", "source", "base_failed", F.explode(pairs).alias("x")).select("lang", "source", "base_failed", "x.measure", "x.value")
    counts = long.groupBy("lang", "source", "measure", bucket_floor(F.col("value")).alias("bucket")).agg(F.count_if(~F.col("base_failed")).alias("n"))
    return counts.where("n > 0")


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with low_<measure> and high_<measure>.

    A group under LEAST_DOCS documents takes the sketch of its language, and a language under it that of all rows.
    """
    leveled = sketch.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))

    def fences(keys: list[str]) -> DataFrame:
        counts = leveled.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        up = Window.partitionBy(*keys, "measure").orderBy("bucket")
        counts = counts.select(
            *keys, "measure", "bucket", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy(*keys, "measure")).alias("docs")
        )

        def at(tenth: int) -> Column:
            return F.min(F.when(10 * F.col("upto") >= tenth * F.col("docs"), F.col("bucket")))

        stats = counts.groupBy(*keys, "measure").agg(at(1).alias("q10"), at(5).alias("q50"), at(9).alias("q90"), F.max("docs").alias("docs"))
        low, high = F.col("q10") - FENCE * (F.col("q50") - F.col("q10")), F.col("q90") + FENCE * (F.col("q90") - F.col("q50"))
        return stats.groupBy(*keys).agg(
            F.max("docs").alias("docs"),
            *(F.max(F.when(F.col("measure") == m, f)).alias(f"{side}_{m}") for f, side in ((low, "low"), (high, "high")) for m, _, _ in MEASURES),
        )

    sides = [f"{side}_{m}" for side in ("low", "high") for m, _, _ in MEASURES]
    own, by_lang, whole = fences(["lang", "source"]), fences(["lang"]), fences([])
    of_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("docs").alias("_lang_docs"), *(F.col(c).alias(f"_l_{c}") for c in sides))
    of_all = whole.select(*(F.col(c).alias(f"_a_{c}") for c in sides))
    rows = own.join(of_lang, own["lang"].eqNullSafe(of_lang["_lang"])).withColumn("_one", F.lit(1))
    rows = rows.join(of_all.withColumn("_one", F.lit(1)), "_one")

    def pick(c: str) -> Column:
        return F.when(F.col("docs") >= LEAST_DOCS, F.col(c)).when(F.col("_lang_docs") >= LEAST_DOCS, F.col(f"_l_{c}")).otherwise(F.col(f"_a_{c}"))

    return rows.select("lang", "source", *(pick(c).alias(c) for c in sides))


def judge(docs: DataFrame) -> DataFrame:
    """Measure, sketch, derive thresholds and filter by join: doc_id, the base columns, measures and kept.

    Null lang and null source are groups of their own. Repeated rows are judged row by row. The measured rows
    (a few numbers each) are written once, so texts are read once. An empty table gives no rows.
    """
    measured = measures(base_columns(docs.select("doc_id", "text", "lang", "source"))).drop("text")
    measured = common.materialise(measured)
    limits = thresholds(sketches(measured)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"])
    inside = F.lit(True)
    for m, units, chance in MEASURES:
        per_unit = 1000 * chance / F.greatest(F.col(units), F.lit(1))
        noise = F.floor(WORD_LEN_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))) if m == "word_len_pct" else per_unit)
        inside = inside & F.col(m).between(F.col(f"low_{m}") - noise, F.col(f"high_{m}") + noise)
    rows = measured.join(limits, same, "left").withColumn("kept", ~F.col("base_failed") & inside)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(m for m, _, _ in MEASURES)
    )
