"""Timings, rates, hashes and integrity of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import ANY_MARK
from quire.plans.scratch import settle


GROUP = 1 << 16  # values of a group up to which its quantiles are one task's state
BINS = 32


def order_statistics(values: DataFrame, value: str, by: tuple[str, ...], wanted: DataFrame, small: int = GROUP, bins: int = BINS) -> DataFrame:
    """by, rank, found: the value of each rank (from 1) of each group, exact, by rounds of counts.

    wanted: by, rank. A range of a group's values holds the rank. Each round cuts it at approximate quantiles of what is in it, counts
    the values of each bin exactly, and goes on with the bin that holds the rank, from its least to its greatest value, so that equal
    values end a search however many they are. A range of at most ``small`` values is sorted. No task holds more, and the ranges are
    a row per group and rank.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = values.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ranks = wanted.select(group.alias("g"), F.col("rank").cast("long").alias("rank"))
    bounds = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    todo = settle(ranks.join(bounds, "g").where("rank BETWEEN 1 AND n").withColumn("below", F.lit(0).cast("long")))
    found = []
    while True:
        found.append(todo.where("lo = hi").select("g", "rank", F.col("lo").alias("found")))
        ranges = lambda df: df.select("g", "lo", "hi").distinct()
        inside = lambda df: rows.join(ranges(df), "g").where("v BETWEEN lo AND hi")
        few, many = todo.where(f"lo < hi AND n <= {small}"), todo.where(f"lo < hi AND n > {small}")
        held = inside(few).groupBy("g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found.append(few.join(held, ["g", "lo", "hi"]).select("g", "rank", F.element_at("vs", (F.col("rank") - F.col("below")).cast("int")).alias("found")))
        if not many.take(1):
            break
        cuts = F.array_distinct(F.percentile_approx("v", [k / bins for k in range(1, bins)], 20 * bins))
        edges = inside(many).groupBy("g", "lo", "hi").agg(cuts.alias("edges"), F.max(F.when(F.col("v") < F.col("hi"), F.col("v"))).alias("under"))
        # no bin is the whole range: where nearly all values are the greatest one, it is a bin by itself
        edges = edges.select("g", "lo", "hi", F.when(F.col("edges")[0] < F.col("hi"), F.col("edges")).otherwise(F.array("under")).alias("edges"))
        binned = rows.join(edges, "g").where("v BETWEEN lo AND hi").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("v"))))
        counts = binned.groupBy("g", "lo", "hi", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("bin"))  # a row per bin
        counts = counts.withColumn("upto", upto)
        hit = many.select("g", "lo", "hi", "rank", "below").join(counts, ["g", "lo", "hi"]).where("rank > below + upto - n AND rank <= below + upto")
        todo = settle(hit.select("g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), "n", (F.col("below") + F.col("upto") - F.col("n")).alias("below")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "rank", "found")


def timings(values: DataFrame, seconds: str, *by: str, small: int = GROUP) -> DataFrame:
    """count, least, median, nearest-rank 95th percentile and most of the values from 0 up; nulls where there are none.

    Groups of more than ``small`` values find their quantiles by rounds of counts.
    """
    clean = F.when(F.col(seconds) >= 0, F.col(seconds))
    text = f"CASE WHEN `{seconds}` >= 0 THEN `{seconds}` END"
    sums = [F.count(clean).alias("n"), F.min(clean).alias("least"), F.max(clean).alias("most")]
    exact = [F.expr(f"percentile({text}, 0.5)").alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {text})").alias("p95")]
    columns = [*by, "n", "least", "median", "p95", "most"]
    totals = settle(values.groupBy(*by).agg(*sums))
    large = totals.where(F.col("n") > small)
    if not large.take(1):
        return values.groupBy(*by).agg(*sums, *exact).select(*columns)
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in by]
    names = large.select(*[F.col(c).alias(f"l_{c}") for c in by], F.lit(True).alias("l_all"))
    match = F.lit(True)
    for c in same:
        match = match & c
    rest = values.join(F.broadcast(names), match, "left_anti").groupBy(*by).agg(*sums, *exact).select(*columns) if by else None
    if rest is not None:  # groups of few values, also those that have none from 0 up
        rest = rest.where(F.col("n") <= small)
    kept = values.where(clean.isNotNull())
    ranks = large.select(*by, F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.ceil(F.col("n") * F.lit(0.95)))).alias("rank")).distinct()
    at = settle(order_statistics(kept, seconds, by, ranks, small))
    n = F.col("n")
    pick = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("found")))
    joined = large.join(at.select(*[F.col(c).alias(f"a_{c}") for c in by], "rank", "found"), _all_same(by), "inner") if by else large.crossJoin(at)
    got = joined.groupBy(*by, "n", "least", "most").agg(((pick(F.floor((n + 1) / 2)) + pick(F.floor(n / 2) + 1)) / 2).alias("median"), pick(F.ceil(n * F.lit(0.95))).alias("p95")).select(*columns)
    return got if rest is None else got.unionByName(rest)


def _all_same(by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"a_{c}"))
    return out


def rate(count: Column, seconds: Column) -> Column:
    return F.when((seconds <= 0) | (count <= 0), F.lit(0.0)).otherwise(count / seconds)


def best_batch(runs: DataFrame) -> DataFrame:
    """The batch size of the best median rate, warm-ups aside; the earlier one of equals. runs: batch, place, warmup, n, seconds."""
    medians = runs.where("NOT warmup").groupBy("batch", "place").agg(F.expr("percentile(CASE WHEN seconds <= 0 OR n <= 0 THEN 0.0D ELSE n / seconds END, 0.5)").alias("rate"))
    return medians.agg(F.max_by("batch", F.struct("rate", -F.col("place"))).alias("batch"), F.max("rate").alias("rate"))


def stage_durations(events: DataFrame, run: str, stage: str, ts: str) -> DataFrame:
    """How long each stage of a run took, till the next began."""
    after = F.lead(ts).over(Window.partitionBy(run).orderBy(ts, stage))
    return events.select(run, stage, ts, (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))).alias("micros"))


def stage_results(events: DataFrame, runs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """A row per run and stage: passed, reused, failed or not_run, and its seconds. events: run, stage, ts, reused. runs: run, ended, failed and failed_stage (null: the one that was running)."""
    after = F.lead("ts").over(Window.partitionBy("run").orderBy("ts"))
    met = events.withColumn("after", after).select("run", "stage", "ts", "after", "reused")
    rows = runs.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages]))).join(met, ["run", "stage"], "left")
    running = F.col("ts").isNotNull() & F.col("after").isNull()
    failed = F.col("failed") & F.coalesce(F.col("stage") == F.col("failed_stage"), running)
    status = F.when(failed, "failed").when(F.col("ts").isNull(), "not_run").when(F.col("reused"), "reused").otherwise("passed")
    took = F.greatest(F.lit(0.0), F.coalesce("after", "ended") - F.col("ts"))
    return rows.select("run", "stage", status.alias("status"), F.when(F.col("ts").isNull() | (failed & ~running), 0.0).otherwise(took).alias("seconds"))


def ordered_hash(rows: DataFrame, text: str, order: str, *by: str) -> DataFrame:
    """The hash of a group's texts in order."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(items, lambda x: F.coalesce(x[text], F.lit(""))), "\n"), 256).alias("hash"), F.count("*").alias("n"))


def content_hash(binary: Column) -> Column:
    return F.sha2(binary, 256)


def same_outputs(hashes: DataFrame, *by: str) -> DataFrame:
    return hashes.groupBy(*by).agg((F.count_distinct("hash") == 1).alias("identical"))


def integrity(outputs: DataFrame) -> DataFrame:
    """Leaked marks, lost tokens and missing outputs. outputs: text, translated, tokens array<string>."""
    lost = F.size(F.filter("tokens", lambda t: F.contains(F.col("text"), t) & ~F.contains(F.coalesce("translated", F.lit("")), t)))
    sums = outputs.agg(F.count("*").alias("n_units"), F.count("translated").alias("n_outputs"), F.count_if(F.col("translated").rlike(ANY_MARK)).alias("n_leaks"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("n_lost"))
    return sums.withColumn("passed", (F.col("n_units") == F.col("n_outputs")) & (F.col("n_leaks") == 0) & (F.col("n_lost") == 0))
