"""Mixing sources to target weights, with DataFrame functions only.

Every source has a weight and may be taken ``epochs`` times at most. Water is filled in by weight: the level is what is left over for
the sources below their cap, divided by their weights; sources that the level lifts above their cap are clamped to it and the rest is
shared again, until no source is above. Levels only rise, so that a clamped source stays clamped. All of it is in whole
numbers. A target then is taken as whole repetitions of the source and a fraction of one more: documents in a seeded order,
the last one in part, until the fraction is full.

Texts are read once, for their sizes. Sources stay distributed, a round is one aggregate over them; what each document gets follows from its
place among ``BUCKETS`` ranges of the seeded order, and only the range that the fraction ends in is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Ranges of the seeded order: three hexadecimal digits of the digest.
BUCKETS = 1 << 12
EXACT = "decimal(38,0)"


def words(text: Column) -> Column:
    """How many runs of characters other than space, tab, line feed, vertical tab, form feed and return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their place ``at`` from 0 by code point, null last: sorted by ranges, of which only the sizes are put together."""
    placed = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33)))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a range
    return placed.join(F.broadcast(starts), "part").withColumn("at", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).cast("long")).drop("part", "start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and, by capped water-filling, ``share`` / ``parts``: the target is share / parts
    words, whole numbers both. Sources at their cap have their cap over 1. The targets' sum is that of all sizes."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("at", F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighted = checkpointed(numbered(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")))
    exact = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(19,0)")
    left, parts, clamped = 0, 1, F.lit(False)
    while True:
        found = weighted.agg(F.sum("source_size").alias("t"), F.sum(F.when(clamped, F.col("cap"))).alias("c"), F.sum(F.when(~clamped, F.col("weight"))).alias("w")).first()
        level = ((found["t"] or 0) - (found["c"] or 0), found["w"] or 1)
        if level == (left, parts):
            break
        left, parts = level
        clamped = exact("weight") * exact(left) > exact("cap") * exact(parts)  # weight * level > cap
    share = F.when(clamped, F.col("cap").cast(EXACT)).otherwise((exact("weight") * exact(left)).cast(EXACT))
    return weighted.select("source", "source_size", "weight", share.alias("share"), F.when(clamped, F.lit(1)).otherwise(F.lit(parts)).cast("long").alias("parts"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 13) -> DataFrame:
    """(key, size, source_size, target, taken, source): a row a document; ``taken`` words of it go into the mix.

    Every document is taken as often as its target holds the source whole; one more time go those first in the order of the md5 of
    "seed:key", until the words left are used up, of the last of them only its beginning. Taken words of a source add up to its target, rounded
    down. Reruns agree whatever the partitions: rows with one key follow each other by size, and rows alike in both are alike in the answer
    but for which of them is cut. A null text has size 0; a null source is a source of its own, the last; a null key counts as the text "null". Sources
    without words have target 0, as has every source if no document has any. An empty table gives an empty one.
    """
    # rows alike are one row with their number, so that no key is one task's work
    rows = docs.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    rows = rows.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("null"))).cast("binary")))
    rows = checkpointed(rows.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    sums = checkpointed(rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words")))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    # whole repetitions, and the words left for one more
    goals = goals.withColumn("goal", F.expr("share div parts")).withColumn("whole", F.expr("goal div greatest(source_size, 1)"))
    goals = goals.select("source", "source_size", (F.col("share").cast("double") / F.col("parts").cast("double")).alias("target"), "whole", F.expr("goal - whole * source_size").alias("rest"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("range"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    placed = sums.join(goals, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    within = W.partitionBy("source", "bucket").orderBy("h", F.col("doc").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("range")))
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))
    rows = rows.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), F.col("rest") - start)))
    # of the copies, some are taken once more, one in part, the others not
    rows = rows.withColumn("full", F.expr("more div greatest(size, 1)")).withColumn("part", F.expr("more % greatest(size, 1)"))
    kinds = F.array(
        F.struct(F.col("full").alias("copies"), F.col("size").alias("extra")), F.struct((F.col("part") > 0).cast("long").alias("copies"), F.col("part").alias("extra")),
        F.struct((F.col("n") - F.col("full") - (F.col("part") > 0).cast("long")).alias("copies"), F.lit(0).cast("long").alias("extra")),
    )
    rows = rows.withColumn("kind", F.explode(F.filter(kinds, lambda k: k["copies"] > 0)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(kind.copies - 1) div 10000"))))
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(10000), F.col("kind.copies") - F.col("chunk") * 10000).cast("int"))))
    return rows.select(F.col("doc").alias(key), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("kind.extra")).alias("taken"), "source")


def mixing_query(documents: DataFrame) -> DataFrame:
    return mixed(documents)


MIXING_SQL = r"""
WITH rows AS MATERIALIZED (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5('13:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM rows GROUP BY source),
ordered AS (SELECT *, row_number() OVER o AS r, coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c,
  ((SELECT sum(w) FROM sources) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS rest_w, (SELECT sum(s) FROM sources)::HUGEINT AS t FROM sources WINDOW o AS (ORDER BY s * (10 // w), source NULLS LAST)),
level AS (SELECT r AS full_from, (t - c)::HUGEINT AS water, rest_w AS parts FROM ordered WHERE (t - c) * w <= 3 * s * rest_w ORDER BY r LIMIT 1),
goals AS (SELECT source, s, CASE WHEN r < full_from THEN 3 * s ELSE (w * water) // parts END AS goal, CASE WHEN r < full_from THEN (3 * s)::DOUBLE ELSE (w * water)::DOUBLE / parts::DOUBLE END AS target FROM ordered, level),
placed AS (SELECT rows.*, s, target, goal // greatest(s, 1) AS whole, goal - goal // greatest(s, 1) * s AS rest,
  sum(size) OVER (PARTITION BY rows.source ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM rows JOIN goals ON rows.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source FROM placed
"""
