"""Tables in hash buckets, of which a change rewrites the touched ones only, and
all of whose new folders become visible at once.

Below the root lie ``data/<table>/v=<n>/bucket=<b>`` and one small manifest per
version, which names the version that every bucket of every table was last
written by. Readers go by the newest manifest; it appears by a rename, after all
it names is written. A run that dies before leaves folders that nobody names,
which the next run overwrites. One writer at a time."""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.session import delete_path

BUCKETS = 64  # of a new store; a manifest has at most this many entries per table


@dataclass(frozen=True)
class Version:
    """What a manifest says. ``where``: table to bucket to the version that wrote
    it; buckets without rows are absent. ``derived``: the version whose derived
    tables are the newest, 0 if there are none."""

    number: int = 0
    buckets: int = BUCKETS
    derived: int = 0
    where: dict[str, dict[int, int]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


def _folders(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name) for name in _folders(spark, f"{root}/manifest") if name.isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> Version:
    said = json.loads(spark.read.text(f"{root}/manifest/{number:010d}", wholetext=True).first()[0])
    where = {t: {int(b): v for b, v in at.items()} for t, at in said.pop("where").items()}
    return Version(**said, where=where)


def latest(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Version:
    """The newest version. Where nothing is stored yet, number 0 with the given number of buckets."""
    numbers = _manifests(spark, root)
    return _manifest(spark, root, numbers[-1]) if numbers else Version(buckets=buckets)


def commit(spark: SparkSession, root: str, version: Version) -> None:
    """Make a version the newest one, by one rename."""
    part = f"{root}/manifest/_{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(version.__dict__),)], "value string").coalesce(1).write.text(part)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, f"{root}/manifest/{version.number:010d}"))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"version {version.number} of {root} was written by another run")


def bucket_of(key: Column, version: Version) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(version.buckets)).cast("int")


def schema_of(version: Version, table: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(version.schemas[table]))


def with_schema(version: Version, table: str, rows: DataFrame) -> Version:
    return replace(version, schemas={**version.schemas, table: rows.schema.json()})


def read_table(spark: SparkSession, root: str, version: Version, table: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table in a version, all or those of some buckets."""
    at = version.where.get(table, {})
    paths = [f"{root}/data/{table}/v={v}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
    schema = schema_of(version, table)
    if not paths:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema).option("basePath", f"{root}/data/{table}").parquet(*paths)
    return stored.select(*[F.col(f"`{c}`") for c in schema.names])


def touched_buckets(keys: DataFrame, key: str, version: Version) -> list[int]:
    """Buckets that hold any of the keys; at most ``version.buckets`` numbers reach the driver."""
    return sorted(r[0] for r in keys.select(bucket_of(F.col(key), version)).distinct().collect())


def rewrite(
    spark: SparkSession, root: str, version: Version, table: str, rows: DataFrame, gone: DataFrame,
    touched: list[int], key: str, scope: tuple[str, ...] = (),
) -> Version:
    """The version after this one, not committed, with the touched buckets of
    ``table`` written anew: without the keys in ``gone``, with ``rows``. Columns
    in ``scope`` become folders inside a bucket. A bucket of very many rows is
    written by several tasks."""
    number = version.number + 1
    fresh = version if table in version.schemas else with_schema(version, table, rows)
    stays = read_table(spark, root, fresh, table, touched).join(gone.select(key).distinct(), key, "left_anti")
    written = stays.unionByName(rows).withColumn("bucket", bucket_of(F.col(key), version))
    target = f"{root}/data/{table}/v={number}"
    written.hint("rebalance", "bucket", *scope).write.mode("overwrite").partitionBy("bucket", *scope).parquet(target)
    now = {int(name.split("=")[1]): number for name in _folders(spark, target) if name.startswith("bucket=")}
    kept = {b: v for b, v in version.where.get(table, {}).items() if b not in touched}
    return replace(fresh, where={**fresh.where, table: {**kept, **now}})


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete the folders that none of the last ``keep`` versions names, and the
    older manifests. No reader may be at work on these."""
    numbers = _manifests(spark, root)
    old, new = numbers[:-keep], [_manifest(spark, root, n) for n in numbers[-keep:]]
    for number in old:
        delete_path(spark, f"{root}/manifest/{number:010d}")
    for path in _unnamed(spark, root, new):
        delete_path(spark, path)


def _unnamed(spark: SparkSession, root: str, versions: list[Version]) -> Iterator[str]:
    for table in _folders(spark, f"{root}/data"):
        named = {(v, b) for version in versions for b, v in version.where.get(table, {}).items()}
        for folder in _folders(spark, f"{root}/data/{table}"):
            at = int(folder.split("=")[1])
            for bucket in _folders(spark, f"{root}/data/{table}/{folder}"):
                if bucket.startswith("bucket=") and (at, int(bucket.split("=")[1])) not in named:
                    yield f"{root}/data/{table}/{folder}/{bucket}"
    derived = {version.derived for version in versions}
    for folder in _folders(spark, f"{root}/derived"):
        if int(folder.split("=")[1]) not in derived:
            yield f"{root}/derived/{folder}"
