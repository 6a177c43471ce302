"""Writers and table maintenance: modes and partitions, dual format, partitioned copies,
upsert (anti-join + union, written beside the table and swapped in), load stamps and a run
manifest whose row counts come from ``observe`` (no extra passes)."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def load_stamps(df: DataFrame, source: str, clock: str) -> DataFrame:
    """_ingested_at, _source, _year, _month, _day; the clock is injected so loads repeat."""
    ts = F.lit(clock).cast("timestamp_ntz")
    return df.withColumns({"_ingested_at": ts, "_source": F.lit(source), "_year": F.year(ts), "_month": F.month(ts), "_day": F.dayofmonth(ts)})


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=(), fmt: str = "parquet") -> None:
    if mode not in ("overwrite", "append", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_dual_format(df: DataFrame, base: str) -> tuple[str, str]:
    """Same rows as CSV and Parquet (complex columns are JSON-encoded for CSV)."""
    write_table(df, base + ".parquet")
    flat = df.select(*[F.to_json(F.col(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    write_table(flat, base + ".csv", fmt="csv")
    return base + ".parquet", base + ".csv"


def write_partitioned(df: DataFrame, path: str, wanted=("city", "date")) -> list[str]:
    parts = [c for c in wanted if c in df.columns]
    write_table(df, path, partition_by=parts)
    return parts


def upsert(spark: SparkSession, target_path: str, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched keys take the source row, unmatched source rows are inserted, other target rows
    stay; the table at ``target_path`` is updated and returned. Source keys must be unique.

    The merged table is written beside the target first and then takes its place by two renames, so a
    job that dies while writing leaves the old table whole (no transactional table format is available
    here; with a catalog that supports it this is ``MERGE INTO t USING s ON keys WHEN MATCHED
    UPDATE SET * WHEN NOT MATCHED INSERT *``)."""
    repeated = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"upsert source repeats a key of {keys}")
    target = spark.read.parquet(target_path)
    merged = target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))
    stamp = uuid.uuid4().hex[:8]
    fresh, old = f"{target_path}.new-{stamp}", f"{target_path}.old-{stamp}"
    merged.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.rename(path(target_path), path(old)) and fs.rename(path(fresh), path(target_path))):
        raise OSError(f"could not put {fresh} in the place of {target_path}")
    fs.delete(path(old), True)
    spark.catalog.refreshByPath(target_path)
    return spark.read.parquet(target_path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:10]}"


MANIFEST_SCHEMA = ("run_id string, stage string, status string, start_time timestamp, duration_s double, inputs array<string>, "
                   "outputs array<string>, rows bigint, error string")


def run_manifest(spark: SparkSession, stages: list[tuple], path: str | None = None, run_id: str | None = None) -> DataFrame:
    """Run stages ``(name, fn)`` or ``(name, fn, inputs, outputs)``, fn -> (input DataFrame, output
    writer), and record one row per stage: status, start, duration, input and output paths, rows
    (counted with ``observe`` during the write), error. Rows are appended to the manifest table at
    ``path`` (by default a fresh one in the shared folder) stage by stage; a failing stage is recorded there before its
    error is raised again. Returns this run's rows."""
    path = path or scratch_dir(spark, "manifest")
    run_id = run_id or uuid.uuid4().hex

    def record(name, start, inputs, outputs, status, rows, error):
        row = (run_id, name, status, dt.datetime.fromtimestamp(start, dt.timezone.utc), round(time.time() - start, 3), list(inputs), list(outputs), rows, error)
        spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(path)

    for name, fn, *ends in stages:
        inputs, outputs = ends if ends else ((), ())
        start = time.time()
        try:
            df, write = fn()
            obs = Observation(name)
            write(df.observe(obs, F.count(F.lit(1)).alias("rows")))
            rows = int(obs.get["rows"])
        except Exception as exc:
            record(name, start, inputs, outputs, "failed", None, f"{type(exc).__name__}: {exc}")
            raise
        record(name, start, inputs, outputs, "success", rows, None)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path).filter(F.col("run_id") == run_id)
