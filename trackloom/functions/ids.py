"""Topics, partitions and the hash that assigns devices to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a, and the form of a device id.
FNV_OFFSET, FNV_PRIME = 2_166_136_261, 16_777_619
DEVICE_ID = r"^[A-Za-z0-9_.-]{1,64}$"


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    every = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(every, F.lit(FNV_OFFSET).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def partition_of(device_id: Column, partitions: int) -> Column:
    if partitions < 1 or partitions != int(partitions):
        raise ValueError("the number of partitions must be a positive integer")
    return (fnv1a32(device_id) % partitions).cast("int")


def topic_parts(topic: Column) -> Column:
    return F.split(topic, "/", -1)


def topic_partition(topic: Column) -> Column:
    """k of ``telemetry/p<k>/<id>``, else null."""
    found = F.regexp_extract(topic, r"^telemetry/p(\d{1,5})/[^/]+$", 1)
    return F.when(found != "", found.cast("int"))


def topic_device(topic: Column) -> Column:
    """The id of ``fleet/<id>/telemetry`` or ``telemetry/p<k>/<id>``, else null."""
    flat, dealt = F.regexp_extract(topic, r"^fleet/([^/]+)/telemetry$", 1), F.regexp_extract(topic, r"^telemetry/p\d{1,5}/([^/]+)$", 1)
    return F.when(flat != "", flat).when(dealt != "", dealt)


def fleet_topic(device_id: Column) -> Column:
    return F.concat(F.lit("fleet/"), device_id, F.lit("/telemetry"))


def partition_topic(device_id: Column, partitions: int) -> Column:
    return F.concat(F.lit("telemetry/p"), partition_of(device_id, partitions).cast("string"), F.lit("/"), device_id)


def partition_filter(partition: int) -> str:
    return f"telemetry/p{partition}/+"


def partition_client(prefix: str, partition: int) -> str:
    return f"{prefix}-p{partition}"


def starts_with(column: Column, prefix: str) -> Column:
    """Prefix test in which ``%``, ``_`` and backslash stand for themselves."""
    return column.startswith(F.lit(prefix))
