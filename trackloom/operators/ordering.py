"""First-arrival dedup and lateness: what a per-device reorder buffer would make of messages in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.fold import Point, ReorderBuffer
from trackloom.schemas import ReorderConfig
from trackloom.shipping import ship


def first_arrivals(messages: DataFrame, *tie_break) -> DataFrame:
    """One row for each (device_id, seq): the first by ``arrival``, then by ``tie_break``; what else a copy says is ignored.

    The rank limit is pushed below the shuffle, so a key with very many copies sends one row from each task.
    """
    w = Window.partitionBy("device_id", "seq").orderBy("arrival", *tie_break)
    return messages.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def unseen(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages whose key isn't stored yet."""
    return messages.join(stored.select("device_id", "seq"), ["device_id", "seq"], "left_anti")


def with_lateness(fresh: DataFrame, cfg: ReorderConfig = ReorderConfig()) -> DataFrame:
    """Adds ``late`` in closed form, for devices whose event time rises with the sequence number and whose buffers never fill up.

    ``fresh`` has one row for each key and a distinct ``arrival`` within a device. A message falls out of the window once it has arrived
    and so has one whose event time is ``window_ms`` later; from then on every lower number is late. So each message gets the arrival at
    which it falls out, and a running maximum over arrivals and fall-outs together tells how far the buffer has gone. Three sorts of the
    device's rows, linear otherwise, and one shuffle.
    """
    later = Window.partitionBy("device_id").orderBy(-F.col("ts_ms")).rangeBetween(Window.unboundedPreceding, -cfg.window_ms)
    known = fresh.withColumn("falls_out", F.greatest(F.min("arrival").over(later), F.when(F.min("arrival").over(later).isNotNull(), F.col("arrival"))))
    came = F.struct(F.col("arrival").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("gone"))
    fell = F.when(F.col("falls_out").isNotNull(), F.struct(F.col("falls_out").alias("at"), F.lit(1).alias("kind"), F.col("seq").alias("gone")))
    steps = known.withColumn("step", F.explode(F.array_compact(F.array(came, fell))))
    in_time = Window.partitionBy("device_id").orderBy("step.at", "step.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = steps.withColumn("passed", F.max("step.gone").over(in_time)).filter("step.kind = 0")
    return gone.select(*fresh.columns, F.coalesce(F.col("passed") > F.col("seq"), F.lit(False)).alias("late"))


def offered(messages: DataFrame, cfg: ReorderConfig = ReorderConfig()) -> DataFrame:
    """(device_id, seq, arrival, outcome, released_at): every message through its device's buffer, without any precondition.

    A device's messages are read in arrival order in bounded batches, so memory holds one buffer and not the device. ``released_at`` is
    the arrival that released it, null for those that only the final flush releases.
    """
    ship(messages.sparkSession)
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, buffer = None, ReorderBuffer(cfg)
        waiting: dict[int, list] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.device_id != device:
                    out += waiting.values()
                    device, buffer, waiting = row.device_id, ReorderBuffer(cfg), {}
                outcome, released = buffer.offer(Point(row.seq, row.ts_ms, row.lat, row.lon, row.speed_kph, row.ignition))
                line = [device, row.seq, row.arrival, outcome, None]
                if outcome == "accepted":
                    waiting[row.seq] = line
                else:
                    out.append(line)
                for p in released:
                    done = waiting.pop(p.seq)
                    done[4] = row.arrival
                    out.append(done)
            yield pd.DataFrame(out, columns=["device_id", "seq", "arrival", "outcome", "released_at"]).astype({"seq": "int64", "arrival": "int64", "released_at": "Int64"})
        yield pd.DataFrame(list(waiting.values()), columns=["device_id", "seq", "arrival", "outcome", "released_at"]).astype({"seq": "int64", "arrival": "int64", "released_at": "Int64"})

    columns = ["device_id", "seq", "ts_ms", "lat", "lon", "speed_kph", "ignition", "arrival"]
    return messages.select(*columns).repartition(parts, "device_id").sortWithinPartitions("device_id", "arrival").mapInPandas(run, "device_id string, seq bigint, arrival bigint, outcome string, released_at bigint")
