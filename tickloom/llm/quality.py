"""Quality rules with thresholds that adapt to language and source.

All in SQL expressions. Base rules hold everywhere; beyond them each (language, source)
group gets its own fences from the quartiles of mergeable KLL sketches. Sketches are made
once per group and then merged upwards: a group with few documents uses its language's
fences, a small language those of the whole corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, spare_name

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: (metric, least width of the quartile range): a document is an outlier beyond
#: FENCE widths above the upper quartile; word length also below the lower one.
METRICS = {"symbols_per_word": 0.05, "mean_word_chars": 0.5, "dup_line_share": 0.05, "caps_per_word": 0.05, "bangs_per_word": 0.05}
TWO_SIDED = ("mean_word_chars",)
FENCE = 6.0
#: Documents that a group needs for fences of its own.
LEAST_DOCS = 100
SKETCH_K = 1024
MIN_WORDS = 50
#: Groups up to which the table of fences is broadcast; beyond, it is joined by shuffle.
BROADCAST_GROUPS = 50_000


def _without(text: Column, signs: str) -> Column:
    return reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit("")), signs, text)


def cheap_features(docs: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    """Counts that need no word windows. The words stay in a column for what follows."""
    docs = docs.withColumn("_t", F.coalesce(text, F.lit("")))
    docs = docs.withColumn("_trim", F.btrim("_t", F.lit(WHITE)))
    docs = docs.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", "[ \\t-\\r]+")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    docs = docs.withColumns({"_lines": lines, "n_words": F.size("_words").cast("long"), "word_chars": F.length(_without(F.col("_t"), WHITE)).cast("long")})
    docs = docs.withColumns(
        {
            "n_symbols": (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_caps": F.regexp_count("_t", F.lit("\\p{Lu}{3,}")),
            "_bangs": F.octet_length("_t") - F.octet_length(_without(F.col("_t"), "!")),
        }
    )
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    docs = docs.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / words,
            "mean_word_chars": F.col("word_chars") / words,
            "dup_line_share": F.col("n_dup_lines") / F.nullif(F.col("_n_lines"), F.lit(0)).cast("double"),
            "caps_per_word": F.col("_caps") / words,
            "bangs_per_word": F.col("_bangs") / words,
        }
    )
    return docs, ["_t", "_trim", "_lines", "_n_lines", "_caps", "_bangs", *METRICS]


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words that lie in a window of three words found twice or more.

    Windows are compared by 64-bit hashes inside the row: equal ones are neighbours once
    sorted, so the cost is n log n for any text, and nothing is shuffled.
    """
    docs = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))
    docs = docs.withColumn("_w", F.when(F.col("n_words") >= 3, F.slice(F.transform("_h", window), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_sorted", F.when(F.size("_w") > F.size(F.array_distinct("_w")), F.sort_array("_w")))
    docs = docs.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: x == F.get("_sorted", i - 1))))
    few = F.size("_twice") <= 64
    # few repeated windows: look each window up; many: sort windows with their places
    docs = docs.withColumn("_pairs", F.when(F.col("_twice").isNotNull() & ~few, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i: F.get("_pairs", i)["h"]
    by_sort = F.transform(F.filter("_pairs", lambda x, k: F.coalesce(x["h"] == near(k - 1), F.lit(False)) | F.coalesce(x["h"] == near(k + 1), F.lit(False))), lambda x: x["i"])
    by_look = F.filter(F.transform("_w", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull())
    docs = docs.withColumn("_at", F.when(F.col("_twice").isNull(), F.lit(None)).when(few, by_look).otherwise(by_sort))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    docs = docs.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return docs.drop("_h", "_w", "_sorted", "_twice", "_pairs", "_at")


def fences(docs: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """One row for each (lang, source): bounds low_<metric> and high_<metric> (null: none)."""
    base, _ = cheap_features(docs.select(lang.alias("g_lang"), source.alias("g_source"), text.alias("_text")), F.col("_text"))
    # conditions inside the aggregates: a filter would have the words split twice
    long = F.col("n_words") >= MIN_WORDS
    sketches = {m: F.kll_sketch_agg_double(F.when(long, F.col(m)), F.lit(SKETCH_K)) for m in METRICS}
    groups = cut_lineage(base.groupBy("g_lang", "g_source").agg(F.count(F.when(long, 1)).alias("n"), *(s.alias(m) for m, s in sketches.items())))

    def level(keys: list[str], name: str) -> DataFrame:
        merged = groups.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(F.col(m)).alias(m) for m in METRICS))
        out = merged.filter(F.col("n") > 0)
        columns = {}
        for m, least in METRICS.items():
            q1, q3 = (F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in (0.25, 0.75))
            reach = FENCE * F.greatest(q3 - q1, F.lit(least))
            columns[f"low_{m}"] = (q1 - reach) if m in TWO_SIDED else F.lit(None).cast("double")
            columns[f"high_{m}"] = q3 + reach
        return out.select(*keys, F.struct(F.col("n"), *(c.alias(k) for k, c in columns.items())).alias(name))

    own, language, all_ = level(["g_lang", "g_source"], "own"), level(["g_lang"], "language"), level([], "whole")
    language = language.withColumnRenamed("g_lang", "l_lang")
    joined = own.join(language, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").drop("l_lang")
    joined = joined.withColumn("k", F.lit(1)).join(F.broadcast(all_.withColumn("k", F.lit(1))), "k", "left")  # one row
    pick = F.when(F.col("own.n") >= LEAST_DOCS, F.col("own")).when(F.col("language.n") >= LEAST_DOCS, F.col("language")).otherwise(F.col("whole"))
    return joined.select("g_lang", "g_source", pick.alias("fence"))


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns."""
    judged = judge(docs, text_col, lang_col, source_col)
    name, row = judged.columns[-1], spare_name(judged, "row_number")
    # The row number keeps the filter above the counts: pushed down, it would repeat all their expressions.
    judged = judged.withColumn(row, F.monotonically_increasing_id())
    return judged.filter(F.col(f"`{name}`.kept") & (F.col(row) >= 0)).drop(name, row)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``quality``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    Null text counts as empty and fails the base rules. Null language or source is a group of
    its own. Repeated rows are judged alike. A group without any document of ``MIN_WORDS`` words
    has no fences. An empty table gives no rows. Columns of ``docs`` may have any names; one
    named ``quality`` is not replaced: the result then ends in an underscore.
    """
    name = spare_name(docs, "quality")
    bounds = cut_lineage(fences(docs, F.col(text_col), F.col(lang_col), F.col(source_col)))
    row = docs.select(F.struct("*").alias("row"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    base, spare = cheap_features(row, F.col(f"row.`{text_col}`"))
    base = repeated_words(base.drop("_t", "_trim", "_lines")).drop("_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    side = F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds
    out = base.join(side, F.col("_lang").eqNullSafe(F.col("g_lang")) & F.col("_source").eqNullSafe(F.col("g_source")), "left")
    inside = [F.coalesce(F.col(m) <= F.col(f"fence.high_{m}"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"fence.low_{m}"), F.lit(True)) for m in METRICS]
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = ~failed & reduce(lambda a, b: a & b, inside)
    return out.select("row.*", F.struct(*fields, failed.alias("base_failed"), kept.alias("kept")).alias(name))
