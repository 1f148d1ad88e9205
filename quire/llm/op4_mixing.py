"""Mixing sources to target weights with a time-varying curriculum.

1. Targets: sources get shares of a token budget by weight, no source more than ``max_epochs`` times its size; what is
   above goes to the others by weight (water filling, in closed form over the sources sorted by capacity per weight).
2. Stream: each source's documents stand in a fixed pseudo-random order; its stream repeats them until its target of
   words is met, the last document only in part; ``training_sequence`` rounds to whole copies.
3. Schedule: a source's weight varies linearly over training time t in [0, 1]: from (1 - slope) to (1 + slope) times
   its mean. The integral is its cumulative demand; inverting it at the offset of a document's first word gives the time
   of each copy. A copy's position is the share of all sources' demand that is consumed by then, and rows are range-sorted by it.

Offsets are prefix sums over (source, bucket of the order) and then within the bucket, so no source goes to one task; the
length of a bucket's prefix follows the number of rows. All of this is done on thin rows; texts meet their positions at the end.

Nulls: a null source is a source of its own, sorted last; a null text has size 0, is never taken by the plan, and in the
sequence stands once where it was placed. Very long texts count whole; the last of a source is taken in part. An
empty table gives no rows. Rows that agree in doc_id, source and text are interchangeable: the sequence repeats one of them.
Ties in the order go by doc_id, size and text. The plan has its own columns only; in the sequence other columns pass
through, and one named ``position`` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import SPACE, own_prefix, settle, small_side, table

WEIGHTS = (5, 2, 1)
#: Of the schedules, in the order of WEIGHTS: fading out, level, fading in.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], slopes: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """sizes: source, source_size. Adds target and slope. One row per source, so the one-partition windows are small."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    ranked = sizes.withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place), "slope": F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), place)})
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(max_epochs))})
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy()
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    first_open = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"]
    ranked = ranked.withColumn("level", level).withColumn("water", first_open)
    return ranked.select("source", "source_size", "slope", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def position_of(share: Column, slope: Column) -> Column:
    """The time t at which a source has met a share of its demand: (1 - s) t + s t^2 = share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def curriculum_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, budget: float = 1.5, max_epochs: float = 2.0, bucket_rows: int = 1 << 16) -> DataFrame:
    """A thin row for each row: doc_id, source, text_hash, size, source_size, target, taken (words), first_position and second_position (null: no such copy)."""
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _text_hash(text).alias("text_hash"), word_count(text).alias("size"), order.alias("order"))
    digits = max(3, math.ceil(math.log(max(1, docs.count() / bucket_rows), 16)))  # of the order, that a bucket shares
    rows = settle(rows.withColumn("bucket", F.substring("order", 1, digits)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, budget, max_epochs).withColumn("goal", F.round("target").cast("long"))
    every = Window.partitionBy()  # a row per source
    targets = targets.withColumn("tilt", F.coalesce(F.sum(F.col("goal") * F.col("slope")).over(every) / F.sum("goal").over(every), F.lit(0.0)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).select("source", "bucket", "before").alias("b")
    buckets = buckets.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("of"), F.col("bucket").alias("part"), "before", "source_size", "target", "goal", "slope", "tilt")
    within = Window.partitionBy("of", "part").orderBy("order", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(buckets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
    placed = joined.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start)).cast("long")
    again = F.col("start") + F.col("source_size")
    time = lambda start: position_of(F.least(F.lit(1.0), start / F.col("target")), F.col("slope"))
    timed = placed.withColumns({"taken": part(F.col("start")) + part(again), "t1": F.when(F.col("start") < F.col("goal"), time(F.col("start"))), "t2": F.when(part(again) > 0, time(again))})
    consumed = lambda t: (1 - F.col("tilt")) * F.col(t) + F.col("tilt") * F.col(t) * F.col(t)
    return timed.select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken", consumed("t1").alias("first_position"), consumed("t2").alias("second_position"))


def training_sequence(docs: DataFrame, plan: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs, once for each whole copy that the plan takes at least half of, with ``position``, range-sorted by position."""
    plan = settle(plan)
    first = F.least(F.col("taken"), F.col("size"))
    copies = F.array(F.when(2 * first >= F.col("size"), F.col("first_position")), F.when(2 * (F.col("taken") - first) >= F.col("size"), F.col("second_position")))
    docs = docs.drop("position")
    keys, mine = ["doc_id", "source", "text_hash"], own_prefix(docs)
    placed = plan.select(*[F.col(k).alias(mine + k) for k in keys], F.explode(F.filter(copies, lambda p: p.isNotNull())).alias("position"))
    rows = docs.withColumn(f"{mine}hash", _text_hash(text))
    if plan.groupBy(*keys).count().where("count > 1").take(1):  # rows that agree in these stand for each other
        rows = rows.dropDuplicates([doc_id, source, f"{mine}hash"])
    same = F.col(doc_id).eqNullSafe(F.col(f"{mine}doc_id")) & F.col(source).eqNullSafe(F.col(f"{mine}source")) & (F.col(f"{mine}hash") == F.col(f"{mine}text_hash"))
    taken = rows.join(small_side(placed, 500_000), same).orderBy("position", f"{mine}text_hash", f"{mine}doc_id")
    return taken.drop(f"{mine}hash", *[mine + k for k in keys])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_plan(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position", "second_position").orderBy("first_position", "doc_id")


QUERIES = {"op4_mixing": op4_mixing}
SQL = {
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c FROM s),
v AS (SELECT *, [5.0, 2.0, 1.0][c + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][c + 1]::DOUBLE AS slope, source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT *, (SELECT level FROM l WHERE cap > level * weight ORDER BY cap / weight, level LIMIT 1) AS water FROM l),
f AS (SELECT source, source_size, slope, coalesce(least(cap, water * weight), cap) AS target FROM t),
g AS (SELECT *, coalesce(sum(round(target)::BIGINT * slope) OVER () / sum(round(target)::BIGINT) OVER (), 0.0::DOUBLE) AS tilt FROM f),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.slope, g.tilt, round(g.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, greatest(0, least(size, goal - a)) AS one, greatest(0, least(size, goal - a - source_size)) AS two,
             least(1.0::DOUBLE, a::DOUBLE / target) AS x, least(1.0::DOUBLE, (a + source_size)::DOUBLE / target) AS y FROM p),
r AS (SELECT *, CASE WHEN a < goal THEN CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END END AS t1,
             CASE WHEN two > 0 THEN CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END END AS t2 FROM q)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, (1 - tilt) * t1 + tilt * t1 * t1 AS first_position, (1 - tilt) * t2 + tilt * t2 * t2 AS second_position
FROM r""",
}
