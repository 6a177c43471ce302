"""Tables that readers see whole: immutable data files, one list of folders per version, an exclusive rename as the commit.

Rows lie in buckets by a hash of their key.  ``_versions/<n>.json`` names the schema, the keys and, for every bucket, the folders
that make it up; the greatest number is the table.  A commit writes new folders, then a list beside the others, then renames the list
to the next number, which fails if that number is taken.  So a reader has the old version or the new one, a job that dies before the
rename leaves the table as it was (its folders are named by no version and go with ``expire_snapshots``), and of two writers
that start from one version the second gets ``CommitConflict``.

The list has one entry a bucket, and a bucket should hold what one task writes, so the list is small beside the data (100,000 buckets at 100 TB).
Where the catalog has a transactional table format, ``MERGE INTO`` does this work."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET = "__bucket"


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(conf), conf


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, ascending; empty if there is no table."""
    jvm, _, fs, _ = _files(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _list_of(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/_versions/{version:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    jvm, _, fs, conf = _files(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    folder = at(f"{path}/_versions")
    fs.mkdirs(folder)
    draft, place = at(f"{path}/_versions/_{uuid.uuid4().hex}"), at(f"{path}/_versions/{version:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    try:  # without OVERWRITE a rename fails if the place is taken
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as exc:
        fs.delete(draft, False)
        if fs.exists(place):
            raise CommitConflict(f"version {version} of {path} is taken") from exc
        raise


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[int, str]:
    """Write rows by bucket into a fresh folder; {bucket: folder below the table}."""
    spark = df.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    # keys are unique and hashed, so buckets are even and one task can write each
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
    jvm, _, fs, _ = _files(spark, path)
    folders = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")) if s.isDirectory()]
    return {int(f.split("=")[1]): f"{name}/{f}" for f in folders if f.startswith(BUCKET + "=")}


def _no_repeats(df: DataFrame, keys: list[str]) -> None:
    repeated = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"rows repeat a key of {keys}")


def create_snapshot_table(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Version 0 of a table at ``path`` (which has none yet); keys are unique.  Returns the version."""
    _no_repeats(df, keys)
    if versions(df.sparkSession, path):
        raise CommitConflict(f"{path} holds a table already")
    folders = _write(df, path, keys, buckets)
    _commit(df.sparkSession, path, 0, {"schema": df.schema.jsonValue(), "keys": keys, "buckets": buckets, "folders": {k: [f] for k, f in folders.items()}})
    return 0


def _read(spark: SparkSession, path: str, content: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    folders = [f"{path}/{f}" for k, fs in content["folders"].items() if buckets is None or int(k) in buckets for f in fs]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the last one by default).  Later commits don't change the frame's rows."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a table at {path}")
    return _read(spark, path, _list_of(spark, path, known[-1] if version is None else version))


def upsert_snapshot(source: DataFrame, path: str) -> dict[str, int]:
    """Rows of ``source`` take the place of those with their key, or are added; commits one version.

    Only buckets that hold a matched key are read whole and rewritten; rows with new keys are added as new files; all other files are
    named by the new version as they are.  A null in a key matches nothing.  Source keys must be unique (``ValueError``, nothing written); columns
    go by name.  Returns ``version``, ``buckets_rewritten`` and ``buckets_added_to``."""
    spark = source.sparkSession
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no table at {path}")
    content = _list_of(spark, path, known[-1])
    keys, buckets = content["keys"], content["buckets"]
    source = source.select(*[F.col(f"`{f['name']}`") for f in content["schema"]["fields"]])
    _no_repeats(source, keys)
    names = [f"`{k}`" for k in keys]
    asked = {r[0] for r in source.select(_bucket(keys, buckets).alias(BUCKET)).distinct().collect()}  # at most one row a bucket
    target = _read(spark, path, content, asked)
    matched = target.select(*names).join(source.select(*names), keys, "left_semi").select(_bucket(keys, buckets).alias(BUCKET))
    rewritten = {r[0] for r in matched.distinct().collect()}
    stay = _read(spark, path, content, rewritten).join(source.select(*names), keys, "left_anti").select(source.columns)
    fresh = _write(stay.unionByName(source), path, keys, buckets)
    folders = {int(k): f for k, f in content["folders"].items()}
    folders = {k: ([] if k in rewritten else folders.get(k, [])) + ([fresh[k]] if k in fresh else []) for k in folders.keys() | fresh.keys()}
    version = known[-1] + 1
    _commit(spark, path, version, {**content, "folders": folders})
    return {"version": version, "buckets_rewritten": len(rewritten), "buckets_added_to": len(fresh.keys() - rewritten)}


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Let go of all but the last ``keep`` versions and of data folders that none of these names; returns the folders removed.  Run it
    while no writer is at work: its folders are not named yet."""
    if keep < 1:
        raise ValueError("keep at least one version")
    known = versions(spark, path)
    jvm, _, fs, _ = _files(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    used = {f for v in known[-keep:] for folders in _list_of(spark, path, v)["folders"].values() for f in folders}
    for v in known[:-keep]:
        fs.delete(at(f"{path}/_versions/{v:012d}.json"), False)
    gone = 0
    for load in fs.listStatus(at(f"{path}/data")) if known else []:
        name = f"data/{load.getPath().getName()}"
        for part in fs.listStatus(load.getPath()):
            if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in used:
                gone += bool(fs.delete(part.getPath(), True))
        if not any(f.startswith(name + "/") for f in used):
            fs.delete(load.getPath(), True)
    return gone
