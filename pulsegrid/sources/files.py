"""Files: journals by day, estate snapshots, tiered metric history, retention, exports and walks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import since


def write_journal(df: DataFrame, path: str, ts: str, tasks_per_day: int = 8) -> None:
    """Rows as JSON lines in one folder for each UTC day, compressed; up to tasks_per_day tasks write a day's files."""
    day = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd")
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(tasks_per_day))
    df.withColumn("day", day).repartition("day", salt).write.mode("append").partitionBy("day").option("compression", "gzip").json(path)


def read_journal(spark: SparkSession, path: str, schema: StructType, first: str, last: str) -> DataFrame:
    """Rows of the days first to last: other days' folders aren't opened, lines that don't parse are skipped."""
    rows = spark.read.schema(StructType(list(schema.fields)).add("day", "string")).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("day").between(first, last))


def export_estate(sites: DataFrame, devices: DataFrame, interfaces: DataFrame, path: str) -> None:
    """The estate as JSON objects, one for each device with its ports, and one for each site that has none: no object grows with a site."""
    ports = interfaces.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("if_index", "name"))).alias("interfaces"))
    own = devices.join(ports, "device_id", "left").select("site_id", F.struct("device_id", "name", "interfaces").alias("device"))
    rows = sites.join(own, "site_id", "left")
    rows.select(F.to_json(F.struct("site_id", "name", "device")).alias("value")).write.text(path)


ESTATE = "site_id long, name string, device struct<device_id: long, name: string, interfaces: array<struct<if_index: long, name: string>>>"


def read_estate(spark: SparkSession, path: str) -> DataFrame:
    """One row for each port of an export: site, device, if_index, name."""
    rows = spark.read.schema(ESTATE).json(path)
    return rows.select(F.col("name").alias("site"), F.col("device.device_id").alias("device_id"), F.explode_outer("device.interfaces").alias("i")).select("site", "device_id", "i.if_index", "i.name")


def write_tiers(raw: DataFrame, rolled: DataFrame, path: str, tasks_per_day: int = 8) -> None:
    """Metric history by tier and day, sorted by series in each file, so that row groups hold few series; series share out a day's files."""
    rows = raw.withColumns({"tier": F.lit("raw"), "min": F.col("v"), "max": F.col("v")}).unionByName(rolled.withColumn("tier", F.lit("rollup")))
    day = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")
    rows.withColumn("day", day).repartition("tier", "day", F.pmod(F.xxhash64("series"), F.lit(tasks_per_day))).sortWithinPartitions("tier", "day", "series", "t").write.partitionBy("tier", "day").parquet(path)


def read_tiers(spark: SparkSession, path: str, tier: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("tier") == tier) & F.col("day").between(first, last))


class Store:
    """Files of a folder, by the file system that Spark reads it with."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.files.exists(self.of(path))

    def delete(self, path: str) -> None:
        self.files.delete(self.of(path), True)

    def mark(self, path: str) -> None:
        self.files.create(self.of(path), True).close()

    def folders(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self.of(path)) if f.isDirectory()) if self.exists(path) else []


def _swap_in(spark: SparkSession, path: str, job: str) -> None:
    """Puts a committed job's days in the place of the stored ones; may be done again."""
    staged = f"{path}/_staging/{job}"
    rows = spark.read.parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    store = Store(spark, path)
    store.mark(f"{path}/_staging/{job}.done")
    store.delete(staged)


def replace_buckets(fresh: DataFrame, path: str, keys: list[str], job: str) -> bool:
    """Fresh buckets (keys, t, values) into a table stored by day (of t): each takes the place of the stored one with its keys, the others stay. Whether the job did anything.

    Only the days of fresh buckets are read and written. They are merged into a staging folder first; its _SUCCESS file is the commit record, after which the days are
    swapped in. A job that was ended before its record begins again, one ended after it is carried on by the next job on the table
    (or by recover()), and one that is done does nothing, so a job may be run any number of times. One writer at a time.
    """
    spark = fresh.sparkSession
    store = Store(spark, path)
    recover(spark, path)
    if store.exists(f"{path}/_staging/{job}.done"):
        return False
    rows = fresh.withColumn("day", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"))
    if [x for x in store.folders(path) if x.startswith("day=")]:
        stored = spark.read.schema(rows.schema).parquet(path).join(rows.select("day").distinct(), "day", "left_semi")
        rows = rows.unionByName(stored.join(rows.select(*keys, "t"), [*keys, "t"], "left_anti"))
    rows.write.mode("overwrite").parquet(f"{path}/_staging/{job}")
    _swap_in(spark, path, job)
    return True


def recover(spark: SparkSession, path: str) -> list[str]:
    """Carries on the committed jobs that were ended before their days were in place; their names."""
    store = Store(spark, path)
    left = [j for j in store.folders(f"{path}/_staging") if store.exists(f"{path}/_staging/{j}/_SUCCESS")]
    for job in left:
        _swap_in(spark, path, job)
    return left


#: Days that each dataset keeps.
RETENTION = {"events": 365, "logs": 30, "flows": 90, "raw": 14, "rollup": 400, "endpoints": 90}


def retained(df: DataFrame, ts: str, dataset: str, now: int, days: dict[str, int] = RETENTION) -> DataFrame:
    """Rows of a dataset not older than its days, counted from the start of the oldest kept day."""
    start = (now // 86400 - days[dataset]) * 86400
    return df.where(since(ts, start))


def prune_days(spark: SparkSession, path: str, dataset: str, now: int, days: dict[str, int] = RETENTION) -> int:
    """Deletes the day folders of a journal or tier that are older than its dataset's days; returns their number. Other days aren't read or written."""
    first = datetime.fromtimestamp((now // 86400 - days[dataset]) * 86400, UTC).strftime("%Y-%m-%d")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in store.listStatus(root) if f.getPath().getName().startswith("day=") and f.getPath().getName()[4:] < first]
    for folder in old:
        store.delete(folder, True)
    return len(old)


def write_findings(df: DataFrame, path: str) -> None:
    """One JSON object for each row and line; keys without value are left out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("append").text(path)


def deliver(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch as JSON lines in a folder of its own. The folder's _SUCCESS file is the ledger: a batch that has one isn't written again."""

    def write(rows: DataFrame, batch: int) -> None:
        folder = f"{path}/batch={batch}"
        if not Store(rows.sparkSession, path).exists(f"{folder}/_SUCCESS"):
            rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(folder)

    return write


def write_table(df: DataFrame, path: str) -> None:
    """A report's table as CSV with a header."""
    df.write.option("header", True).csv(path)


def pivot_walk(walk: DataFrame, base: str, columns: dict[int, str]) -> DataFrame:
    """One row for each device and table index of a walk (device, oid, value): oid is base.column.index."""
    rest = F.expr(f"substring(oid, {len(base) + 2})")
    rows = walk.where(F.col("oid").startswith(base + ".")).select("device", F.substring_index(rest, ".", 1).try_cast("int").alias("c"), F.regexp_replace(rest, r"^\d+\.", "").alias("idx"), "value")
    wide = rows.where(F.col("c").isin(*columns)).groupBy("device", "idx").pivot("c", list(columns)).agg(F.first("value"))
    return wide.select("device", "idx", *[F.col(str(k)).alias(v) for k, v in columns.items()])
