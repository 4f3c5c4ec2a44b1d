"""Counters, latency histograms, recording rules, alerts and dashboard series over samples (ts seconds, metric, labels, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.numbers import quantile_at

#: Upper bounds in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def latency(published: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored messages with ``latency_ms`` from publishing to storing; keys as in both inputs."""
    return stored.join(published, ["device_id", "seq"]).withColumn("latency_ms", F.col("stored_ms") - F.col("published_ms"))


def latency_summary(lat: DataFrame, started_ms: Column) -> DataFrame:
    """One row: number, nearest-rank quantiles, maximum, mean, and rows a second up to the last stored."""
    return lat.agg(
        F.count(F.lit(1)).alias("stored"), *(quantile_at("latency_ms", q).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))), F.max("latency_ms").alias("max"), F.avg("latency_ms").alias("mean"),
        (F.count(F.lit(1)) / ((F.max("stored_ms") - F.min(started_ms)) / 1000)).alias("rows_per_s"),
    )


def outcome_counts(raw: DataFrame, fresh: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One row of ingest counters from validated messages (``error``), first arrivals (``late``) and, where given, closed trips."""
    r = raw.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("error").isNotNull()).alias("invalid"))
    f = fresh.agg(F.count(F.lit(1)).alias("stored"), F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("applied"))
    out = r.crossJoin(f).withColumn("duplicates", F.col("received") - F.col("invalid") - F.col("stored"))  # one row each
    return out if closed is None else out.crossJoin(closed.agg(F.count(F.lit(1)).alias("trips_closed")))


def increases(samples: DataFrame, *keys: str) -> DataFrame:
    """Adds ``delta``: by how much a total has risen since the sample before, never below zero; the first counts from zero."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return samples.withColumn("delta", F.greatest(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), F.lit(0.0)))


def last_values(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max_by("value", "ts").alias("value"))


def histogram(values: DataFrame, seconds: Column, *keys: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """(keys, le, n): cumulative counts by upper bound, the last infinite. Values below zero count as zero. One pass, one row a group."""
    x = F.greatest(seconds, F.lit(0.0))
    wide = values.groupBy(*keys).agg(*(F.count_if(x <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(x).alias(f"b{len(bounds)}"))
    every = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])))
    return wide.select(*keys, F.explode(every).alias("b")).select(*keys, "b.le", "b.n")


def within(samples: DataFrame, at: DataFrame, seconds: int) -> DataFrame:
    """The samples with the ``eval_ts`` of each evaluation whose window, of ``seconds`` up to it, they are in."""
    # a window has parts of two numbers only: equality on window numbers, then the exact test; evaluations grow with time, so none are broadcast
    number = F.floor(F.col("eval_ts") / seconds)
    wanted = at.select("eval_ts", F.explode(F.array(number - 1, number)).alias("slot"))
    inside = samples.withColumn("slot", F.floor(F.col("ts") / seconds)).join(wanted.hint("merge"), "slot")
    return inside.filter((F.col("ts") <= F.col("eval_ts")) & (F.col("ts") > F.col("eval_ts") - seconds)).drop("slot")


def rates(samples: DataFrame, at: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """(eval_ts, keys, rate): rise of a total a second over the window before each evaluation, counter resets taken as new starts. The first
    sample of a window has no rise, so the samples of each window are all that is sorted."""
    before = F.lag("value").over(Window.partitionBy("eval_ts", *keys).orderBy("ts"))
    stepped = within(samples, at, seconds).withColumn("before", before)
    rise = F.when(F.col("before").isNull(), 0.0).when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))
    return stepped.groupBy("eval_ts", *keys).agg((F.sum(rise) / seconds).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, *keys: str, value: str = "n") -> DataFrame:
    """(keys, quantile) by linear interpolation inside the bucket in which the rank falls; the last finite bound where that is the
    infinite one, null without observations."""
    w = Window.partitionBy(*keys).orderBy("le")
    total = F.max(value).over(Window.partitionBy(*keys)) if keys else F.max(value).over(Window.partitionBy(F.lit(1)))
    b = buckets.withColumn("below", F.coalesce(F.lag(value).over(w), F.lit(0.0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("rank", total * q)
    hit = (F.col(value) >= F.col("rank")) & (F.col("rank") > 0)
    inside = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * F.when(F.col(value) > F.col("below"), (F.col("rank") - F.col("below")) / (F.col(value) - F.col("below"))).otherwise(F.lit(1.0)))
    return b.groupBy(*keys).agg(F.min_by(inside, F.when(hit, F.col("le"))).alias("quantile"))


def latency_p95(scrapes: DataFrame, at: DataFrame, seconds: int, *pods: str) -> DataFrame:
    """(eval_ts, p95): the 95th percentile of the rates, over the window before each evaluation, of cumulative bucket counts (pods, le, ts,
    value) of all pods together; null where nothing was observed."""
    rise = rates(scrapes, at, seconds, *pods, "le").groupBy("eval_ts", "le").agg(F.sum("rate").alias("rate"))
    return histogram_quantile(rise, 0.95, "eval_ts", value="rate").withColumnRenamed("quantile", "p95")


def observed_p95(observed: DataFrame, at: DataFrame, seconds: int, *pods: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """``latency_p95`` of the scrapes that pods give after each of their observations (pods, ts, s).

    A rate takes differences inside its window alone, so counts may begin anew with it: observations are dealt by evaluation, and of each
    one row is shuffled instead of one a bound. The rise of a count that is never reset is its last value without the first.
    """
    w = Window.partitionBy("eval_ts", *pods).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    les = [*map(float, bounds), float("inf")]
    inside = within(observed.select(*pods, "ts", "s"), at, seconds).repartition("eval_ts")
    counted = inside.select("eval_ts", *pods, *(F.count_if(F.col("s") <= le).over(w).alias(f"n{i}") for i, le in enumerate(les)))
    rise = counted.groupBy("eval_ts", *pods).agg(*((F.max(f"n{i}") - F.min(f"n{i}")).alias(f"n{i}") for i in range(len(les))))
    rate = rise.groupBy("eval_ts").agg(*((F.sum(f"n{i}") / seconds).alias(f"n{i}") for i in range(len(les))))
    buckets = rate.select("eval_ts", F.explode(F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"n{i}").alias("rate")) for i, le in enumerate(les)))).alias("b")).select("eval_ts", "b.*")
    return histogram_quantile(buckets, 0.95, "eval_ts", value="rate").withColumnRenamed("quantile", "p95")


def windowed_error_ratio(batches: DataFrame, seconds: int) -> DataFrame:
    """(until, ratio): share of failed batches (ts, failed) in each window of ``seconds``."""
    until = (F.floor(F.col("ts") / seconds) * seconds + seconds).alias("until")
    failed = F.count_if("failed").cast("double")
    return batches.groupBy(until).agg(error_ratio(failed, F.count(F.lit(1)) - failed).alias("ratio"))


def error_ratio(failed: Column, done: Column) -> Column:
    """Share of failed batches, zero where there were none."""
    return failed / F.greatest(failed + done, F.lit(1e-9))


def saturation(samples: DataFrame) -> DataFrame:
    """(ts, saturation): greatest depth as part of capacity over the pods."""
    return samples.groupBy("ts").agg(F.max(F.col("depth") / F.greatest(F.col("capacity"), F.lit(1))).alias("saturation"))


def alerts(series: DataFrame, condition: Column, for_s: int | Column, *keys: str) -> DataFrame:
    """(ts, keys, firing): the condition has held without a break for at least ``for_s`` seconds. A missing value breaks it. Without keys
    the series is one task's, so it should be one of evaluations and not of samples."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow) if keys else Window.partitionBy(F.lit(1)).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = series.withColumn("holds", F.coalesce(condition, F.lit(False)))
    s = s.withColumn("broken_at", F.max(F.when(~F.col("holds"), F.col("ts"))).over(w))
    s = s.withColumn("since", F.min(F.when(F.col("holds"), F.col("ts"))).over(Window.partitionBy(*(keys or (F.lit(1),)), "broken_at")))
    return s.select("ts", *keys, (F.col("holds") & (F.col("ts") - F.col("since") >= for_s)).alias("firing"))


#: The alerts, with name, condition over a column of its series, seconds that it must hold, severity.
ALERTS = (
    ("FleetIngestLatencyP95High", "p95 > 2", 300, "warning"),
    ("FleetIngestConsumerLagging", "saturation > 0.8 OR paused > 0", 120, "warning"),
    ("FleetIngestErrorRatioHigh", "ratio > 0.05", 300, "critical"),
    ("FleetPartitionsUnowned", "unowned_s > 30", 0, "critical"),
    ("FleetIngestTargetDown", "up = 0", 60, "warning"),
)


def every_alert(series: DataFrame, *keys: str) -> DataFrame:
    """(alert, severity, keys, ts, firing) of the fixed alerts over a table with a column for each series; ``keys`` (a pod, a job) deal
    the series, so that no task has all of them."""
    rules = F.array(*(F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.lit(held).alias("held"), F.coalesce(F.expr(condition), F.lit(False)).alias("met")) for name, condition, held, severity in ALERTS))
    each = series.select("ts", *keys, F.explode(rules).alias("rule")).select("ts", *keys, "rule.*")
    by = ["alert", "severity", "held", *keys]
    lasting = alerts(each, F.col("met"), F.col("held"), *by)
    return lasting.select("alert", "severity", *keys, "ts", "firing")


def sliding(events: DataFrame, window: str, slide: str, *keys: str) -> DataFrame:
    """Dashboard series: number, rate a second, sum and greatest value by sliding window. ``events`` has ts (timestamp) and value."""
    w = F.window("ts", window, slide)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select(F.unix_millis("w.start").alias("start_ms"), *keys, "n", (F.col("n") / seconds).alias("rate"), "total", "top")


def exposition(samples: DataFrame) -> DataFrame:
    """Prometheus text lines of (metric, labels map, value)."""
    label = lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    inside = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("labels")), label))
    return samples.select(F.concat("metric", F.when(inside != "", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), F.col("value").cast("string")).alias("line"))
