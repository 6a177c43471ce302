"""Typed readers: JSONL snapshots (traffic, weather, news), CSV/Parquet Bronze loads, dataset
registry, road-edge files, percentile lookups and suffix dispatch. All reads use explicit
schemas where the layout is known (no inference on large inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import materialize
from .sinks import load_stamps

TRAFFIC_RAW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("segment_id", T.StringType()), T.StructField("segment_name", T.StringType()),
    T.StructField("weather_cell_id", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("event_time", T.StringType()), T.StructField("time_bucket", T.StringType()),
    T.StructField("currentSpeed", T.DoubleType()), T.StructField("freeFlowSpeed", T.DoubleType()),
    T.StructField("jamFactor", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("roadClosure", T.BooleanType()), T.StructField("geometry", T.StringType()),
    T.StructField("raw", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])
WEATHER_RAW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("weather_cell_id", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("event_time", T.StringType()), T.StructField("temp", T.DoubleType()), T.StructField("feels_like", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()), T.StructField("pressure", T.DoubleType()), T.StructField("visibility", T.DoubleType()),
    T.StructField("rain_1h", T.DoubleType()), T.StructField("wind_speed", T.DoubleType()), T.StructField("wind_deg", T.DoubleType()),
    T.StructField("weather_main", T.StringType()), T.StructField("weather_desc", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("_corrupt_record", T.StringType()),
])
NEWS_RAW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("external_id", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("source_url", T.StringType()),
    T.StructField("published_at", T.StringType()), T.StructField("city_hint", T.StringType()),
    T.StructField("ingestion_time", T.StringType()), T.StructField("doc_id", T.LongType()),
])


def _jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
          .json(path))
    # blank lines are skipped by the reader; malformed lines land in _corrupt_record
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_traffic_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSONL traffic snapshots -> typed rows; malformed lines dropped; geometry lifted from
    ``raw.flowSegmentData.coordinates`` when the record has none."""
    df = _jsonl(spark, path, TRAFFIC_RAW)
    lifted = F.get_json_object(F.col("raw"), "$.flowSegmentData.coordinates")
    return df.withColumn("geometry", F.coalesce(F.col("geometry"), lifted))


def read_weather_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark, path, WEATHER_RAW)


def read_news_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw article lines with file name; record id = sha1(file name + raw line); identical
    lines of one file get an ordinal so ids stay unique."""
    lines = spark.read.text(path).select(F.col("value").alias("raw_line"), F.col("_metadata.file_name").alias("file_name"))
    lines = lines.filter(F.trim("raw_line") != "")
    # lines are told apart by a digest and parsed after the sort, which then moves each line once
    w = Window.partitionBy("file_name", F.sha2("raw_line", 256)).orderBy(F.lit(1))
    parsed = lines.withColumn("_ord", F.row_number().over(w))
    parsed = parsed.withColumn("r", F.from_json("raw_line", NEWS_RAW)).filter(F.col("r").isNotNull())
    rid = F.sha1(F.concat_ws(":", F.col("file_name"), F.col("raw_line"), F.col("_ord").cast("string")))
    return parsed.select(rid.alias("record_id"), "file_name", "r.*")


def read_csv_bronze(spark: SparkSession, path: str, source: str, clock: str) -> DataFrame:
    """Header + inferred-schema CSV, load-stamped (small reference files only)."""
    return load_stamps(spark.read.option("header", True).option("inferSchema", True).csv(path), source, clock)


def read_parquet_bronze(spark: SparkSession, path: str, source: str, clock: str) -> DataFrame:
    return load_stamps(spark.read.parquet(path), source, clock)


def import_dataset(spark: SparkSession, registry: dict[str, dict], clock: str) -> dict[str, DataFrame]:
    """Named dataset registry -> DataFrames tagged with their ``_source`` name.

    Each entry: {"format": "csv"|"parquet", "path": path-or-glob}."""
    out = {}
    for name, spec in registry.items():
        if spec["format"] == "csv":
            out[name] = read_csv_bronze(spark, spec["path"], name, clock)
        else:
            out[name] = read_parquet_bronze(spark, spec["path"], name, clock)
    return out


def load_road_edges(spark: SparkSession, path: str, city: str, order: str = "edge_order") -> DataFrame:
    """Edge file of one city -> segment_id = city slug + '_' + index in file order, keeping
    road class and WKT, stamped with the source."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    slug = city.lower().replace(" ", "_")
    # an index in file order without one task for the whole file: rows are dealt by range of the order and
    # kept; what earlier ranges hold (one count per range) is added to the row number in the own range
    ranged = materialize(df.repartitionByRange(F.col(order)).withColumn("_rl_range", F.spark_partition_id()))
    ahead = Window.orderBy("_rl_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_rl_range").agg(F.count(F.lit(1)).alias("_n")).select("_rl_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rl_before"))
    nth = F.row_number().over(Window.partitionBy("_rl_range").orderBy(order))
    indexed = ranged.withColumn("_rl_nth", nth).join(F.broadcast(before), "_rl_range").withColumn("_idx", F.col("_rl_before") + F.col("_rl_nth") - 1)
    return indexed.withColumn("segment_id", F.concat(F.lit(slug + "_"), F.col("_idx").cast("string"))).drop("_idx", "_rl_range", "_rl_before", "_rl_nth") \
        .withColumn("city", F.lit(slug)).withColumn("_source", F.lit("road_edges"))


def load_percentile_lookup(df: DataFrame, source: str, clock: str) -> DataFrame:
    """Stats per (segment, hour, dow) -> typed lookup with load stamps."""
    typed = df.select(F.col("segment_id").cast("string"), F.col("hour_of_day").cast("int"), F.col("day_of_week").cast("int"),
                      F.col("p15").cast("double"), F.col("p50").cast("double"), F.col("p85").cast("double"))
    return load_stamps(typed, source, clock)


def read_dataset(spark: SparkSession, base: str) -> DataFrame:
    """Resolve a dataset base path by suffix: the first of parquet, csv, jsonl that exists is read (and must be
    readable as such); none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    readers = {".parquet": spark.read.parquet, ".csv": spark.read.option("header", True).option("inferSchema", True).csv, ".jsonl": spark.read.json}
    for suffix, reader in readers.items():
        here = path(base + suffix)
        if here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here):
            return reader(base + suffix)
    raise FileNotFoundError(f"no parquet/csv/jsonl dataset at {base}")
