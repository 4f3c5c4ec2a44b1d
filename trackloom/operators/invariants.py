"""Checks that nothing is lost, stored twice or made up, and differences between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["device_id", "seq"]
NUMBERS = ("distance_m", "duration_s", "idle_s", "start_lat", "start_lon", "end_lat", "end_lon", "max_speed_kph", "point_count", "end_seq")


def key_text(first: str = "device_id", second: str = "seq") -> Column:
    return F.concat_ws("#", F.col(first), F.col(second).cast("string"))


def lost(delivered: DataFrame, stored: DataFrame) -> DataFrame:
    return delivered.select(*KEY).distinct().join(stored.select(*KEY), KEY, "left_anti")


def phantom(delivered: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select(*KEY).distinct().join(delivered.select(*KEY), KEY, "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*(key or KEY)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeated_trips(t: DataFrame, idle: DataFrame) -> DataFrame:
    """Trips and idle segments stored more than once."""
    keys = t.select(key_text("device_id", "start_seq").alias("key")).unionAll(idle.select(F.concat(F.lit("idle:"), key_text("device_id", "start_seq")).alias("key")))
    return repeated(keys, "key")


def close(a: Column, b: Column) -> Column:
    """Equal to nine significant digits."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def trip_differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(difference) lines between two sets of trips by (device_id, start_seq): missing, unexpected, or a column that differs."""
    columns = [c for c in expected.columns if c not in ("device_id", "start_seq")]
    side = lambda df: df.select("device_id", "start_seq", F.struct(*columns).alias("t"))
    e, g = side(expected).withColumnRenamed("t", "e"), side(got).withColumnRenamed("t", "g")
    both = e.join(g, ["device_id", "start_seq"], "full_outer")
    name = F.concat(F.lit("trip "), key_text("device_id", "start_seq"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))

    def differs(c: str) -> Column:
        a, b = F.col(f"e.{c}"), F.col(f"g.{c}")
        same = close(a.cast("double"), b.cast("double")) if c in NUMBERS else a.eqNullSafe(b)
        return F.when(F.col("e").isNotNull() & F.col("g").isNotNull() & ~F.coalesce(same, a.isNull() & b.isNull()), F.concat(name, F.lit(f" {c}: expected "), text(a), F.lit(", got "), text(b)))

    lines = F.array(F.when(F.col("g").isNull(), F.concat(name, F.lit(" missing"))), F.when(F.col("e").isNull(), F.concat(name, F.lit(" unexpected"))), *(differs(c) for c in columns))
    return both.select(F.explode(F.array_compact(lines)).alias("difference"))


def idle_differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    value = F.concat_ws("|", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.col("duration_s").cast("string"))
    side = lambda df, n: df.select(key_text("device_id", "start_seq").alias("key"), value.alias(n))
    both = side(expected, "e").join(side(got, "g"), "key", "full_outer").filter(~F.col("e").eqNullSafe(F.col("g")))
    return both.select(F.when(F.col("e").isNull(), F.concat(F.lit("idle segment "), "key", F.lit(" unexpected"))).otherwise(F.concat(F.lit("idle segment "), "key", F.lit(": expected "), "e", F.lit(", got "), F.coalesce("g", F.lit("none")))).alias("difference"))


def key_differences(label: str, expected: DataFrame, got: DataFrame) -> DataFrame:
    one = lambda a, b, word: a.select(*KEY).distinct().join(b.select(*KEY), KEY, "left_anti").select(F.concat(F.lit(f"{label} "), key_text(), F.lit(f" {word}")).alias("difference"))
    return one(expected, got, "missing").unionAll(one(got, expected, "unexpected"))


def verdict(delivered: DataFrame, stored: DataFrame, t: DataFrame, idle: DataFrame, differences: DataFrame | None = None) -> DataFrame:
    """One row: expected, stored, lost, duplicates, duplicate_trips, phantom, differences and ``ok``."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    extra = lambda df, name: df.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))
    out = n(delivered.select(*KEY).distinct(), "expected").crossJoin(n(stored, "stored")).crossJoin(n(lost(delivered, stored), "lost"))  # one row each
    out = out.crossJoin(extra(repeated(stored), "duplicates")).crossJoin(extra(repeated_trips(t, idle), "duplicate_trips")).crossJoin(n(phantom(delivered, stored), "phantom"))
    out = out.crossJoin(n(differences, "differences")) if differences is not None else out.withColumn("differences", F.lit(0).cast("bigint"))
    return out.withColumn("ok", (F.col("lost") + F.col("duplicates") + F.col("duplicate_trips") + F.col("phantom") + F.col("differences")) == 0)


def recovery(samples: DataFrame, healed: DataFrame) -> DataFrame:
    """Times to the first commit and to a cleared backlog after a fault.

    ``samples`` has run, t and stored; ``healed`` has run, healed_at and ``before``, the number of messages published by then.
    """
    s = samples.join(healed, "run")
    at_heal = s.groupBy("run").agg(F.max("healed_at").alias("healed_at"), F.max("before").alias("before"), F.coalesce(F.max_by("stored", F.when(F.col("t") <= F.col("healed_at"), F.col("t"))), F.lit(0)).alias("at_heal"))
    after = samples.join(at_heal, "run", "right").withColumn("later", F.col("t") > F.col("healed_at"))
    first = lambda test: F.min(F.when(F.col("later") & test, F.col("t") - F.col("healed_at")))
    return after.groupBy("run").agg(first(F.col("stored") > F.col("at_heal")).alias("recovery_ms"), first(F.col("stored") >= F.col("before")).alias("catch_up_ms"))


def scenario_summary(results: DataFrame, order: list[str]) -> DataFrame:
    """A row for each scenario, in the given order and then by name: runs, passes, losses and medians (the lower of two)."""
    rank = F.coalesce(*(F.when(F.col("scenario") == s, F.lit(i)) for i, s in enumerate(order)), F.lit(len(order)))
    lower = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    out = results.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("passed"), F.sum("lost").alias("lost"), F.sum("duplicates").alias("duplicates"), F.bool_and("trips_match").alias("trips_match"),
        lower("recovery_ms").alias("median_recovery_ms"), F.max("recovery_ms").alias("max_recovery_ms"), lower("catch_up_ms").alias("median_catch_up_ms"), F.expr("percentile(recovery_ms, 0.5)").alias("plotted_recovery_ms"), F.max("peak_queue").alias("max_peak_queue"),
    )
    return out.withColumn("rank", rank).orderBy("rank", "scenario")
