"""Mix sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
#: Key space is cut in so many slices a source; only the slice where the budget ends is sorted for its sums.
SLICES = 4096


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) by a digest of the id, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Targets of (source, source_size): the total shared by weight, none above cap times its size.

    Sources take the weights in code-point order, null last. Water filling in closed form: in the
    order of cap over weight, a source is full if the level that is left by those before reaches it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    filling = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    levelled = ranked.withColumn("level", (total - before) / left).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        levelled.withColumn("target", target)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    docs: doc_id, text, source; other columns are ignored. quality: (doc_id, quality), of which a
    document takes the largest; quality 1 weighs 2, 0 weighs 0.5, anything else 1. A source is
    read whole for as many epochs as fit its target; of the rest, documents are taken in the
    order of their exponential keys until their sizes reach it, the last one if at least half of
    it fits. A null text has size 0 and takes nothing. Null sources form a source of their own.
    Ties in the key (repeated rows) are ordered by doc_id and size; rows that agree in those are
    alike. An empty table gives an empty result.

    The only rows sorted together are those of one source and one of SLICES slices of key space,
    so that a source with a third of all rows is spread; sources are summed before any window.
    """
    weight = F.lit(1.0)
    rows = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "source")
    if quality is not None:
        best = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        rows = rows.join(best, "doc_id", "left")
        weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    rows = rows.withColumn("key", exponential_key(F.col("doc_id"), weight, seed))
    rows = rows.withColumn("slice", F.least(F.floor(SLICES * (1 - F.exp(-F.col("key")))), F.lit(SLICES - 1)).cast("int"))
    rows = checkpointed(rows.select("doc_id", "size", "source", "key", "slice"))

    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    sums = sums.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.*", "source_size", "target", "epochs", "rest")

    within = Window.partitionBy("r.source", "r.slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / F.lit(2.0)
    picked = (reached <= F.col("rest")).cast("long")
    return (
        rows.alias("r")
        .join(sums.alias("m"), F.expr("r.source <=> m.source AND r.slice = m.slice"))
        .select(
            "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "epochs",
            (F.col("size") * (F.col("epochs") + picked)).alias("taken"),
            (F.col("epochs") + picked).alias("copies"),
        )
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("copies")


OP10_SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (CASE b.q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap
    ELSE weight * max(level) FILTER (WHERE cap / weight > level) OVER () END AS target FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT b.doc_id, b.source, b.size, e.source_size, e.target, e.epochs,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + b.size / 2.0::DOUBLE AS reached
  FROM base b JOIN epochs e ON b.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, epochs,
  (size * (epochs + CASE WHEN reached <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
