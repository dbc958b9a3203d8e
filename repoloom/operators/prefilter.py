"""A filter of fixed size in front of a join, for wide rows that should not be shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 23


def likely_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in `wanted`, and few others.

    A bitmap of the wanted keys' hashes is broadcast; it has a fixed size (1 MB in 256
    rows), however many keys there are. With very many keys it lets more rows pass. So a
    join or semi-join has to follow, at the latest when the rows are narrow.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1
    bitmap = (
        wanted.select(place.alias("__place"))
        .groupBy(F.bitmap_bucket_number("__place").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    )
    at = F.bitmap_bit_position("__place")
    byte = F.substring(F.col("__bits"), F.expr("int(bitmap_bit_position(__place) div 8) + 1"), F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.call_function("shiftright", number, (at % 8).cast("int")).bitwiseAND(F.lit(1))
    return (
        rows.withColumn("__place", place)
        .withColumn("__bucket", F.bitmap_bucket_number("__place"))
        .join(F.broadcast(bitmap), "__bucket")
        .filter(bit == 1)
        .select(*rows.columns)
    )
