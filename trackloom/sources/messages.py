"""Raw messages: strict validation of topic and payload, and the file sources that stand for a broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.ids import DEVICE_ID, partition_of, topic_device, topic_partition
from trackloom.schemas import ENVELOPE

FIELDS = ("deviceId", "seq", "ts", "lat", "lon", "speedKph", "ignition")
#: Inclusive ranges of the numeric fields.
RANGES = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "speedKph": (0.0, 400.0)}
GREATEST_SEQ = 2**53 - 1


def validated(raw: DataFrame, partitions: int | None = None) -> DataFrame:
    """``raw`` (topic, payload, …) with the telemetry columns and ``error``, null for a valid message.

    Tests in order: shape of the topic, partition (with ``partitions``, for topics that name one), JSON, exactly the known fields with
    their exact types and ranges, id in the payload equal to the topic's. Types come from the parsed JSON value, so "10" is no number;
    a JSON object that repeats a key is refused.
    """
    v = raw.withColumn("v", F.try_parse_json("payload")).withColumn("topic_id", topic_device(F.col("topic")))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    v = v.withColumns({f"k_{f}": kind(f) for f in FIELDS})
    number = lambda f: F.col(f"k_{f}").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = lambda f: F.try_variant_get("v", f"$.{f}", "double")
    whole = lambda f: number(f) & (value(f) == F.floor(value(f)))
    known = F.array_sort(F.json_object_keys("payload")) == F.array(*(F.lit(f) for f in sorted(FIELDS)))
    device = F.try_variant_get("v", "$.deviceId", "string")
    tests: list[tuple[Column, Column]] = [(F.col("topic_id").isNull(), F.concat(F.lit("unexpected topic "), F.coalesce("topic", F.lit(""))))]
    if partitions is not None:
        own = partition_of(F.col("topic_id"), partitions)
        wrong = F.coalesce(topic_partition(F.col("topic")) != own, F.lit(False))
        tests.append((wrong, F.concat(F.lit("device "), F.col("topic_id"), F.lit(" belongs to partition "), own.cast("string"), F.lit(", not "), topic_partition(F.col("topic")).cast("string"))))
    tests += [
        (F.col("v").isNull(), F.lit("payload is not valid JSON")),
        (~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)) | ~F.coalesce(known, F.lit(False)), F.lit("fields are missing or unknown")),
        ((F.col("k_deviceId") != "STRING") | ~device.rlike(DEVICE_ID), F.lit("deviceId is not valid")),
        (~(whole("seq") & value("seq").between(0, GREATEST_SEQ)), F.lit("seq is not valid")),
        (~(whole("ts") & (value("ts") > 0)), F.lit("ts is not valid")),
        *((~(number(f) & value(f).between(a, b)), F.lit(f"{f} is not valid")) for f, (a, b) in RANGES.items()),
        (F.col("k_ignition") != "BOOLEAN", F.lit("ignition is not valid")),
        (device != F.col("topic_id"), F.concat(F.lit("deviceId "), device, F.lit(" does not match topic "), "topic")),
    ]
    error = F.lit(None).cast("string")
    for test, text in reversed(tests):
        error = F.when(F.coalesce(test, F.lit(True)), text).otherwise(error)
    v = v.withColumn("error", error)
    good = lambda f, t: F.when(F.col("error").isNull(), F.try_variant_get("v", f"$.{f}", t))
    return v.select(
        *raw.columns, good("deviceId", "string").alias("device_id"), good("seq", "double").cast("bigint").alias("seq"), good("ts", "double").cast("bigint").alias("ts_ms"),
        good("lat", "double").alias("lat"), good("lon", "double").alias("lon"), good("speedKph", "double").alias("speed_kph"), good("ignition", "boolean").alias("ignition"), "error",
    )


def payload_of(telemetry: DataFrame) -> Column:
    """The JSON text of a telemetry row."""
    return F.to_json(F.struct(F.col("device_id").alias("deviceId"), "seq", F.col("ts_ms").alias("ts"), "lat", "lon", F.col("speed_kph").alias("speedKph"), "ignition"))


def message_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Envelopes from JSON-line files as they appear; offsets are kept by the query's checkpoint, so a file counts once it commits."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", max_files).json(path)


def broker_stream(spark: SparkSession, servers: str, topics: str, max_offsets: int = 100_000) -> DataFrame:
    """Envelopes from Kafka, where its connector is on the class path; the topic is the message key."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", max_offsets).load()
    return raw.select(F.col("key").cast("string").alias("topic"), F.col("value").cast("string").alias("payload"), F.unix_millis("timestamp").alias("published_at"), F.col("offset").alias("arrival"))
