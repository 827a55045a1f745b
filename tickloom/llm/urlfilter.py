"""URL filters: rules for hosts and paths, and logistic regression for the rest.

All in SQL expressions. The model is fitted to a small labelled table (at most
``LABELLED_ROWS`` rows) in the dual form: the Gram matrix of the labelled rows' hashed
character n-grams comes from an equi-join on the buckets, gradient steps on one coefficient
per labelled row run inside one ``aggregate``, and the weights by bucket are a grouped sum.
Scoring looks the n-grams of host and path up in the array of weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound on the labelled table.
LABELLED_ROWS = 1_000
BUCKETS = 8_192
SIZES = (3, 4)
STEPS, RATE, DECAY = 300, 1.0, 0.002

#: Fixed values: (verdict, host/path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

_UNWANTED = (
    "casino-win free-bets adult-x spam-farm ads-track cheap-pills casino-royal bet-win adult-cams spam-links poker-win free-casino"
    " xxx-adult farm-spam ad-track track-ads pills-shop cheap-meds click-ads free-spins lottery-win win-bets spam-mail adult-chat"
).split()
_PLAIN = (
    "ththre therin blog.tionsh thernt blog.ththan theron tionble ththth thersh m.theror ththnt ththed news.library weather-report"
    " city-council school.garden bread-recipes thersea ththwh tiontion history-museum river-guide open-archive ththou"
).split()
#: The labelled table: plain and unwanted hosts under the same endings and paths.
LABELLED = tuple(
    (f"https://{sub}{host}.example.{end}/{lang}/{n}{tail}", label)
    for label, hosts in ((1, _UNWANTED), (0, _PLAIN))
    for k, host in enumerate(hosts)
    for sub, end, lang, n, tail in ((("www.", "m.", "blog.", "")[k % 4], "net", "en", 196, "#top"), ("", ("com", "org")[k % 2], ("es", "en", "de", "fr")[k % 4], 27, ".html"))
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def buckets_of(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of both fields; digits count alike."""
    parts = []
    for field, value in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), F.regexp_replace(value, "[0-9]", "0"), F.lit("$"))
        for n in SIZES:
            parts.append(_grams(text, n, f"{field}{n}"))
    return F.concat(*parts)


def _grams(text: Column, n: int, salt: str) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    grams = F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)))
    return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<bigint>"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> list[float]:
    """Weights by bucket, the intercept last. Rows with a null label or without a host are left out."""
    base = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y"))
    base = base.filter(F.col("y").isNotNull() & (host_of(F.col("url")) != "")).orderBy("url", "y").limit(LABELLED_ROWS)
    one = base.groupBy().agg(F.collect_list(F.struct("url", "y")).alias("rows"))
    rows = one.select(F.posexplode("rows").alias("i", "r")).select("i", "r.y", F.array_distinct(buckets_of(host_of(F.col("r.url")), path_of(F.col("r.url")))).alias("b"))
    x = rows.select("i", "y", F.explode("b").alias("d"), (1 / F.sqrt(F.size("b"))).alias("v"))
    left, right = x.select("i", "d", "v"), x.select(F.col("i").alias("j"), "d", F.col("v").alias("u"))
    gram = left.join(right, "d").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    # every row shares the intercept, a feature of value 1
    whole = gram.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("k"))
    whole = rows.select("i", "y").join(whole, "i", "left").groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "k"))).alias("rows"))
    whole = whole.withColumn("n", F.size("rows")).withColumn("y", F.transform("rows", lambda r: r["y"]))
    index = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))
    whole = whole.withColumn("k", F.transform("rows", lambda r: F.transform(index, lambda j: 1.0 + F.coalesce(F.try_element_at(F.map_from_entries(r["k"]), j), F.lit(0.0)))))
    dot = lambda row, a: F.aggregate(F.zip_with(row, a, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def update(a: Column, _: Column) -> Column:
        return F.transform(a, lambda own, i: own * (1 - DECAY) + RATE / F.col("n") * 4 * (F.get("y", i) - 1 / (1 + F.exp(-dot(F.get("k", i), a)))))

    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda r: F.lit(0.0)), update)
    solved = whole.filter(F.col("n") > 0).select(F.posexplode(alpha).alias("i", "a"))
    weights = x.join(solved, "i").groupBy("d").agg(F.sum(F.col("a") * F.col("v")).alias("w"))
    out = [0.0] * (BUCKETS + 1)
    for d, w in weights.union(solved.select(F.lit(BUCKETS).cast("bigint"), "a").groupBy().agg(F.lit(BUCKETS).cast("bigint"), F.sum("a"))).collect():  # BUCKETS + 1 rows at most
        out[d] = float(w or 0.0)
    return out


def score_of(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Probability of the label 1; a half where there is no host."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    buckets = F.array_distinct(buckets_of(host, path))
    total = F.aggregate(buckets, F.lit(0.0), lambda s, d: s + F.get(table, d.cast("int")))
    return F.when(host == "", F.lit(0.5)).otherwise(1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + weights[-1]))))


def labelled_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``pages`` and host, path, rule, verdict, score (probability of block).

    A url that is null or has no ``://`` has an empty host and path and is allowed, as no rule
    fits and the model has nothing to go by. Repeated rows are judged alike, empty tables give
    none. A column of ``pages`` with one of the new names is replaced.
    """
    weights = fit(labelled_table(pages.sparkSession) if labelled is None else labelled)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "score": score_of(F.col("host"), F.col("path"), weights), "verdict": verdict})
    return pages.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")))
