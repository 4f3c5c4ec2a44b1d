"""Partition leases as projections of a table (partition, owner, holder, token, expires_ms); ``now`` in ms is a parameter.

Executors need no leases in Spark: the scheduler assigns partitions and a sink keyed by natural keys makes a repeated batch harmless.
These answer the same questions over lease tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("partition", "owner", "holder", "token", "expires_ms")


def with_partitions(leases: DataFrame, n: int, now: int) -> DataFrame:
    """Adds free rows for those of 0..n-1 that are missing."""
    new = leases.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(leases.select("partition"), "partition", "left_anti")
    return leases.select(*COLUMNS).unionByName(new.select("partition", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("holder"), F.lit(0).cast("bigint").alias("token"), F.lit(now).cast("bigint").alias("expires_ms")))


def may_take(owner: str, holder: str, now: int) -> Column:
    """Free, expired, or held by an earlier incarnation of the same holder."""
    return F.col("owner").isNull() | (F.col("expires_ms") <= now) | F.coalesce((F.col("holder") == holder) & (F.col("owner") != owner), F.lit(False))


def acquired(leases: DataFrame, partition: int, owner: str, holder: str, ttl_ms: int, now: int) -> DataFrame:
    """The table after an attempt to take a partition; ``token`` rises by one where it succeeded."""
    takes = (F.col("partition") == partition) & may_take(owner, holder, now)
    new = {"owner": F.lit(owner), "holder": F.lit(holder), "token": F.col("token") + 1, "expires_ms": F.lit(now + ttl_ms).cast("bigint")}
    return leases.select("partition", *(F.when(takes, v).otherwise(F.col(c)).alias(c) for c, v in new.items()))


def holds(owner: str, now: int) -> Column:
    return (F.col("owner") == owner) & (F.col("token") == F.col("h_token")) & (F.col("expires_ms") > now)


def against(leases: DataFrame, held: DataFrame) -> DataFrame:
    """Leases with the token expected for them, if any; ``held`` has partition and token."""
    return leases.join(held.select("partition", F.col("token").alias("h_token")), "partition", "left")


def renewed(leases: DataFrame, held: DataFrame, owner: str, ttl_ms: int, now: int) -> DataFrame:
    """The table after a renewal, with ``renewed``."""
    ok = F.coalesce(holds(owner, now), F.lit(False))
    return against(leases, held).select("partition", "owner", "holder", "token", F.when(ok, F.lit(now + ttl_ms).cast("bigint")).otherwise(F.col("expires_ms")).alias("expires_ms"), ok.alias("renewed"))


def released(leases: DataFrame, held: DataFrame, owner: str, now: int) -> DataFrame:
    gives = F.coalesce((F.col("owner") == owner) & (F.col("token") == F.col("h_token")), F.lit(False))
    none = F.lit(None).cast("string")
    return against(leases, held).select("partition", F.when(~gives, F.col("owner")).otherwise(none).alias("owner"), F.when(~gives, F.col("holder")).otherwise(none).alias("holder"), "token", F.when(gives, F.lit(now).cast("bigint")).otherwise(F.col("expires_ms")).alias("expires_ms"))


def fenced_off(leases: DataFrame, held: DataFrame, owner: str, now: int) -> DataFrame:
    """Partitions of ``held`` whose lease is missing or no longer held with that token."""
    ok = leases.join(held.select("partition", F.col("token").alias("h_token")), "partition").filter(holds(owner, now))
    return held.select("partition").join(ok.select("partition"), "partition", "left_anti")


def heartbeat(members: DataFrame, member: str, ttl_ms: int, now: int) -> DataFrame:
    """``members`` (member_id, expires_ms) with this one alive until ``now + ttl_ms``."""
    spark: SparkSession = members.sparkSession
    mine = spark.createDataFrame([(member, now + ttl_ms)], "member_id string, expires_ms bigint")
    return members.select("member_id", "expires_ms").filter(F.col("member_id") != member).unionByName(mine)


def live_members(members: DataFrame, member: str, holder: str, now: int) -> DataFrame:
    """One row: members alive, without earlier incarnations of this holder."""
    return members.filter(F.col("expires_ms") > now).filter((F.col("member_id") == member) | ~F.col("member_id").startswith(F.lit(f"{holder}~"))).agg(F.count(F.lit(1)).alias("n"))


def listed(leases: DataFrame, now: int) -> DataFrame:
    return leases.select("partition", "owner", "holder", "token", (F.col("expires_ms") - now).cast("double").alias("expires_in_ms")).orderBy("partition")


def unowned(leases: DataFrame, now: int) -> DataFrame:
    """One row: partitions without a live owner, and for how many seconds the longest."""
    free = F.col("owner").isNull() | (F.col("expires_ms") <= now)
    return leases.agg(F.count_if(free).alias("unowned"), F.coalesce(F.max(F.when(free, F.greatest((F.lit(now) - F.col("expires_ms")) / 1000, F.lit(0.0)))), F.lit(0.0)).alias("max_unowned_s"))


def ownership(leases: DataFrame, now: int) -> DataFrame:
    """By owner, the number of leases and of live ones."""
    return leases.filter("owner is not null").groupBy("owner").agg(F.count(F.lit(1)).alias("leases"), F.count_if(F.col("expires_ms") > now).alias("live"))


def rebalance(leases: DataFrame, owner: str, holder: str, members: int, now: int) -> DataFrame:
    """(partition, action): what one pod does in a round. Its share is an equal part, rounded up: what it owns beyond that is released,
    highest partitions first to go; below it, free partitions are acquired in order."""
    mine = (F.col("owner") == owner) & (F.col("expires_ms") > now)
    every = Window.partitionBy(F.lit(1))  # a table of partitions has as many rows as there are partitions
    order = Window.partitionBy("kind").orderBy("partition")
    kind = F.when(mine, "mine").when(may_take(owner, holder, now), "free").otherwise("other")
    t = leases.withColumn("kind", kind).withColumn("total", F.count(F.lit(1)).over(every)).withColumn("owned", F.count_if(F.col("kind") == "mine").over(every)).withColumn("nth", F.row_number().over(order))
    share = F.ceil(F.col("total") / F.lit(max(1, members)))
    action = F.when((F.col("kind") == "mine") & (F.col("nth") > share), "release").when((F.col("kind") == "free") & (F.col("nth") <= share - F.col("owned")), "acquire")
    return t.select("partition", action.alias("action")).filter("action is not null")
