"""Imports, exports, append logs and snapshots as plain files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet", ".gz": "jsonl"}


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for end, kind in FORMATS.items():
        if name.endswith(end):
            return kind
    raise ValueError(f"unknown format: {path}")


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """Records of JSON, JSON lines or Parquet. With a schema, lines that can't be read keep their text in ``_corrupt_record``."""
    kind = kind or format_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("multiLine", kind == "json").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def split_valid(records: DataFrame, required: list[str], checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows name what is wrong with them in ``errors``."""
    rules = {f"{c} is missing": F.col(c).isNull() for c in required} | {name: ~F.coalesce(ok, F.lit(False)) for name, ok in (checks or {}).items()}
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    marked = records.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def export(records: DataFrame, path: str, kind: str = "parquet", where: Column | None = None, max_records: int = 0, compression: str | None = None) -> None:
    """Writes records, filtered if asked, in files of at most ``max_records``."""
    writer = (records if where is None else records.where(where)).write.mode("overwrite").option("maxRecordsPerFile", max_records)
    writer = writer.option("compression", compression) if compression else writer
    writer.parquet(path) if kind == "parquet" else writer.json(path)


def append_days(records: DataFrame, path: str, at: str, batch: str | None = None) -> None:
    """Appends records to an archive of compressed JSON lines by UTC day.

    With ``batch`` the records get a folder of that name, which a retry replaces instead of appending twice.
    """
    dated = records.withColumn("day", F.to_date(at))
    if batch is None:
        dated.write.mode("append").partitionBy("day").option("compression", "gzip").json(path)
    else:
        dated.write.mode("overwrite").partitionBy("day").option("compression", "gzip").json(f"{path.rstrip('/')}/batch={batch}")


class Snapshots:
    """Versioned snapshots of a table: ``version=N`` folders and a catalog of one row each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def catalog(self) -> DataFrame:
        fs, p = self._fs(f"{self.path}/catalog")
        schema = "version int, created_at timestamp_ntz, n bigint, checksum decimal(38,0), parent int"
        if not fs.exists(p) and fs.exists(self._fs(f"{self.path}/catalog.old")[1]):
            fs.rename(self._fs(f"{self.path}/catalog.old")[1], p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/catalog") if fs.exists(p) else self.spark.createDataFrame([], schema)

    @staticmethod
    def summary(table: DataFrame) -> tuple:
        """(rows, checksum) of a table, in any order of rows."""
        h = F.xxhash64(*[c for c, t in table.dtypes if not t.startswith("map")]).cast("decimal(38,0)")
        return tuple(table.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)")).first())

    def create(self, table: DataFrame, at: datetime) -> int:
        last = self.catalog().agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        n, checksum = self.summary(self.read(version, verify=False))
        row = self.spark.createDataFrame([(version, at, n, checksum, last)], self.catalog().schema)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")
        return version

    def read(self, version: int, verify: bool = True) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/version={version}")
        if verify:
            want = self.catalog().where(F.col("version") == version).select("n", "checksum").first()
            if want is None or tuple(want) != self.summary(table):
                raise ValueError(f"snapshot {version} is damaged")
        return table

    def changes(self, old: int, new: int, key: str) -> DataFrame:
        """(key, change): rows inserted, updated or deleted between two versions."""
        side = lambda v, name: self.read(v).select(key, F.xxhash64("*").alias(name))
        both = side(old, "a").join(side(new, "b"), key, "full")
        change = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated")
        return both.select(key, change.alias("change")).where("change is not null")

    def expire(self, now: datetime, keep: int, days: int) -> list[int]:
        """Deletes all but the newest ``keep`` versions and those older than ``days``; the newest always stays."""
        rows = sorted(self.catalog().collect(), key=lambda r: -r["version"])  # a row a snapshot
        gone = [r["version"] for i, r in enumerate(rows) if i and (i >= keep or r["created_at"] < now - timedelta(days=days))]
        kept = self.catalog().where(~F.col("version").isin(gone)).collect()
        self.spark.createDataFrame(kept, self.catalog().schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalog.new")
        fs, p = self._fs(f"{self.path}/catalog")
        old, new = (self._fs(f"{self.path}/catalog.{end}")[1] for end in ("old", "new"))
        fs.delete(old, True)
        # a crash between the renames leaves catalog.old, from which the catalog is read
        fs.rename(p, old)
        fs.rename(new, p)
        fs.delete(old, True)
        for v in gone:
            fs.delete(self._fs(f"{self.path}/version={v}")[1], True)
        return gone
