"""How filters on documents interact, told from a histogram of failure masks.

Native expressions give every document a mask with one bit a filter. Whether a text is an
exact copy of one with a smaller id is told from the least id of its text. Counted by part
and mask, the documents become at most 2**k cells a part; every order in which the filters
can be applied, and the filters' Shapley values, follow from the cells alone.

Scale: texts stay where they are read, only their SHA-256 digests move. The rows of a text,
however many, are summed before each shuffle: by (digest, part, label) there is one row a
task, with the least id and how often it occurs. The copies of a text that fail the copy
filter are the rest of these counts, so nothing is joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import WHITE

#: One letter a filter, in the order of the mask's bits; the last one is the copy filter.
LETTERS = "ABCDE"


def conditions(text: Column, words: Column) -> list[Column]:
    """The failure conditions A to D; ``words`` is an array."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask.

    A null text is an empty one, a null part the part "". Copies are compared over the whole
    table. A null id is no smaller than any other and has no label, so such a row neither
    fails E nor makes another fail. Rows with equal id and text are documents of their own
    that don't fail because of each other. A document is good (toxic) if any of its labels
    has quality (toxic) 1.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("trimmed", F.btrim("t", F.lit(WHITE)))
    base = base.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[ \\t-\\r]+")))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("t"), F.col("words")))), F.lit(0))
    narrow = base.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))
    rows = narrow.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(known, "id", "left").fillna(0, ["good", "toxic"])
    # within a group ids differ, so the least id's count is one row's
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    some = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    some = some.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    passing = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copy = 1 << (len(LETTERS) - 1)
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), passing.alias("k")), F.struct((F.col("mask") + copy).alias("m"), (F.col("n") - passing).alias("k"))))
    both = some.select("part", "good", "toxic", split.alias("c")).select("part", F.col("c.m").alias("mask"), F.col("c.k").alias("n"), "good", "toxic")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``cells``; zeros included.

    kept: documents left after the step; removed: those that go here; redundant: those that
    fail the step's filter and went before; unique_fails: those that fail no other filter;
    good_lost and toxic_lost: of the removed; shapley: the filter's removed, summed over all
    orders. A document that fails k filters meets each of them first in a k-th of the orders.
    """
    letters = list(letters)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    bit = lambda letter: sum((F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    rows = counted.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    chars = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: bit(F.substring("filter_order", i, F.lit(1))))
    rows = rows.withColumn("bits", chars).withColumn("own", F.element_at("bits", -1))
    rows = rows.withColumn("before", F.aggregate("bits", F.lit(0), lambda s, b: s + b) - F.col("own"))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    share = factorial(len(letters)) / F.bit_count("mask")
    count = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over whole texts; no rows for an empty table."""
    return interactions(cells(docs, labels))


#: The same for DuckDB, straight from the definitions.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
k AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first_id < w.doc_id, false)::INT AS mask
    FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e
    WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r
"""
