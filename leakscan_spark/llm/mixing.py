"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects target / source size copies. The copies are
prefix-summed over the source in the order of size, one offset is added, and a
document is emitted once per integer the sum crosses. Ordering by size makes
neighbours alike, so the words taken stay close to the target.

The order is dealt out by range of (source, size, hash), so a source with any
share of the rows spans many tasks: ranks are counted inside each range and
shifted by the rows of the source in earlier ranges.

Null texts and texts without words have size 0 and may be taken, which adds no
words. A null source is a source of its own, last in the order. Repeated rows
are sampled separately. A source of size 0 has target 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table, unused, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources take the weights in turn. Targets share the whole by weight; one that
    would pass ``most`` times its source stops there, and the others share the
    rest. With sources ordered by most * size / weight, the full ones come first,
    so one running sum finds the common level: the largest that its own source still has room for.
    The windows have one row per source.
    """
    c = F.col
    turn = Window.orderBy(c("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (c("turn") % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("turn", F.row_number().over(turn) - 1).withColumn("weight", weight)
    by_room = Window.orderBy(c("room"), c("turn"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    level = (
        weighed.withColumn("room", most * c("source_size") / c("weight"))
        .withColumn("full", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (c("total") - c("full")) / (c("weights") - c("used")))
        .withColumn("shared", F.max(F.when(c("room") >= c("level"), c("level"))).over(everything))
    )
    target = F.least(c("shared") * c("weight"), (most * c("source_size")).cast("double"))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One offset per source, strictly between 0 and 1, exact in binary."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))))
    return (F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") + 0.5) / 65536


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``documents``.

    mix_id and mix_text, the id with null as -1 and a hash of the text, find the row again.
    """
    c = F.col
    ordered = [c("source").asc_nulls_last(), c("size").desc(), F.md5(c("doc_id").cast("string")), c("doc_id")]
    sized = documents.select(
        "doc_id", "source", word_count(c("text")).alias("size"),
        F.coalesce(c("doc_id"), F.lit(-1)).alias("mix_id"), F.xxhash64("text").alias("mix_text"),
    )
    sized = saved(sized, "mixing-sizes")
    dealt = sized.repartitionByRange(*ordered).withColumn("range", F.spark_partition_id())
    dealt = saved(dealt, "mixing-ranges")
    counts = dealt.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = shifts.join(goals, shifts["source"].eqNullSafe(goals["source"])).select(
        shifts["source"].alias("of"), "range", "shift", "source_size", "target"
    )
    inside = Window.partitionBy("range", "source").orderBy(*ordered[1:])
    ranked = dealt.withColumn("rank", F.row_number().over(inside))
    joined = ranked.alias("r").join(plan.alias("p"), (c("r.range") == c("p.range")) & c("r.source").eqNullSafe(c("p.of")))
    expected = F.when(c("source_size") > 0, c("target") / c("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(offset(c("source"), seed) + expected * rank)
    copies = (upto(c("shift") + c("rank")) - upto(c("shift") + c("rank") - 1)).cast("int")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "mix_id", "mix_text"
    )


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, numbered in ``copy`` from 1.

    A column of that name, in any case, stays, and the number is called ``copy_``.
    Texts move once, to meet their plan by id and text hash; rows alike in both take their copies in turn.
    """
    c = F.col
    mix_id, mix_text, copies = (unused(n, documents) for n in ("mix_id", "mix_text", "mix_copies"))
    plan = mix(documents, **settings).groupBy("mix_id", "mix_text").agg(F.collect_list("copies").alias(copies))
    plan = plan.withColumnsRenamed({"mix_id": mix_id, "mix_text": mix_text})
    key = [F.coalesce(c("doc_id"), F.lit(-1)).alias(mix_id), F.xxhash64("text").alias(mix_text)]
    rows = documents.select("*", *key).join(plan, [mix_id, mix_text])
    nth = F.row_number().over(Window.partitionBy(mix_id, mix_text).orderBy(mix_id))
    emitted = rows.withColumn(copies, F.element_at(copies, nth)).where(c(copies) > 0)
    return emitted.select(*documents.columns, F.explode(F.sequence(F.lit(1), c(copies))).alias(unused("copy", documents)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies for all documents."""
    c = F.col
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (c("copies") * c("size")).cast("long").alias("taken"), "copies"
    )


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sizes
), roomy AS (
  SELECT source, source_size, w, 3 * source_size / w AS room, turn
  FROM (SELECT *, CAST(CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM weighed)
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM roomy WINDOW b AS (ORDER BY room, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(w * (SELECT max(level) FROM levels WHERE room >= level), CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels
), ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    (CAST(('0x' || substr(md5('7:' || coalesce(s.source, chr(0))), 1, 4)) AS INTEGER) + 0.5::DOUBLE) / 65536 AS u,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, md5(CAST(s.doc_id AS VARCHAR)), s.doc_id) AS r
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(u + e * r) - floor(u + e * (r - 1))) * size AS BIGINT) AS taken,
  CAST(floor(u + e * r) - floor(u + e * (r - 1)) AS INTEGER) AS copies
FROM ranked
"""
