"""Seeded synthetic triples and query workloads, generated on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys and query patterns of the benchmark.
COMMON_KEYS = ("StageX", "StageY", "StageZ", "creation_date", "microscope")
RARE_KEYS = (
    "FILE_PATH", "AUXILIARY_FILE", "coordinate_x", "coordinate_y", "coordinate_z", "temperature", "pressure", "humidity", "light_intensity",
    "duration", "researcher", "project", "sample_id", "protocol", "magnification", "resolution", "wavelength",
)
HOT_PATTERNS = tuple(f"{k}=*" for k in COMMON_KEYS)
COLD_PATTERNS = (
    "FILE_PATH=*", "AUXILIARY_FILE=*", "coordinate*=*", "temperature=*", "pressure=*", "humidity=*", "light_intensity=*", "duration=*",
    "researcher=*", "project=*", "sample_id=*", "protocol=*", "magnification=*", "resolution=*", "wavelength=*",
)


def draw(seed: int, *parts) -> Column:
    """A number in [0, 1) from a row's own values: the same however rows are dealt out."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def six(column: Column) -> Column:
    return F.format_string("%.6f", column)


def objects(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` objects with every common key and two (even id) or three (odd id) draws of rare keys."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "object_id")
    between = lambda name, low, high: (draw(seed, "object_id", F.lit(name)) * (high - low + 1)).cast("int") + low
    date = F.concat_ws("-", between("year", 2020, 2023), between("month", 1, 12), between("day", 1, 28))
    values = {k: six(1000 * draw(seed, "object_id", F.lit(k))) for k in COMMON_KEYS[:3]}
    values |= {"creation_date": date, "microscope": F.concat(F.lit("LLSM-"), (1 + F.col("object_id") % 5).cast("string"))}
    common = ids.select("object_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))).alias("p"))
    draws = ids.select("object_id", F.explode(F.sequence(F.lit(0), (1 + F.col("object_id") % 2).cast("int"))).alias("i"))
    rare = draws.withColumn("key", F.element_at(F.array(*map(F.lit, RARE_KEYS)), (draw(seed, "object_id", "i", F.lit("rare")) * len(RARE_KEYS)).cast("int") + 1))
    path = F.concat(F.lit("/data/object_"), F.col("object_id").cast("string"), F.lit("/file_"), F.col("i").cast("string"), F.lit(".tif"))
    value = F.when(F.col("key").isin("FILE_PATH", "AUXILIARY_FILE"), path).otherwise(six(1000 * draw(seed, "object_id", "i", F.lit("value"))))
    return common.select("object_id", "p.key", "p.value").unionByName(rare.select("object_id", "key", value.alias("value")))


def workload(spark: SparkSession, n: int = 1000, hot: float = 0.8, seed: int = 0) -> DataFrame:
    """``n`` queries (seq, pattern): a hot pattern with probability ``hot``, else a cold one."""
    rows = spark.range(n).withColumnRenamed("id", "seq")
    pick = lambda items, name: F.element_at(F.array(*map(F.lit, items)), (draw(seed, "seq", F.lit(name)) * len(items)).cast("int") + 1)
    return rows.select("seq", F.when(draw(seed, "seq", F.lit("hot")) < hot, pick(HOT_PATTERNS, "h")).otherwise(pick(COLD_PATTERNS, "c")).alias("pattern"))
