"""Table writes: upserts, append by batch, a current table by key of which a batch writes what it changes, payloads kept once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where it is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scopes: list[list[str]] = []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads; a missing one is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what materialise wrote within it: for work whose results are written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_folder(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: df written as Parquet in the shared folder and reread."""
    return _saved(df, _scopes)


def materialise_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """materialise(make()), of which nothing else is left: what make saved on its way is deleted once the result is written."""
    with scratch(spark):
        return _saved(make(), _scopes[:-1])


def _saved(df: DataFrame, scopes: list[list[str]]) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], protect_null: bool = True) -> DataFrame:
    """target with updates: present keys are updated, others inserted; with protect_null a null never replaces a value.

    Of several updates of one key the last by its JSON counts, so that reruns agree.
    """
    values = [c for c in target.columns if c not in keys]
    a = target.withColumn("__a", F.lit(True)).alias("a")
    row = F.struct(*[c for c in values if c in updates.columns], F.lit(True).alias("__b"))
    b = updates.groupBy(*keys).agg(F.max_by(row, F.to_json(row)).alias("__row")).select(*keys, "__row.*").alias("b")
    both = a.join(b, keys, "full")

    def value(c: str):  # noqa: ANN202
        if c not in updates.columns:
            return F.col(f"a.{c}")
        if protect_null:
            return F.coalesce(f"b.{c}", f"a.{c}").alias(c)
        return F.when(F.col("__b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return both.select(*keys, *[value(c) for c in values])


def write_tables(tables: dict[str, DataFrame], path: str, batch_id: str, rewritten: tuple[str, ...] = ("opportunities",)) -> None:
    """Histories get one partition for each batch, overwritten when a batch is replayed; current tables are rewritten.

    A current table may be computed from the one it replaces, so it is written to a folder of its batch.
    """
    for name, df in tables.items():
        if name in rewritten:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        else:
            df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")


@dataclass
class KeyedTable:
    """The current rows of a table by key, in hash buckets; a batch writes its changed rows and no others.

    A batch's rows are a part of each bucket that they fall in. The parts of a bucket are one base, whose keys are
    distinct, and later ones, whose rows replace it; once those hold more than `most` times the base's rows, that bucket
    alone is rewritten as a new base, so what is written stays in proportion to what changed. The manifest of a batch
    lists the parts that count then; it is written last, and a batch reads the one before its own. A batch that is
    replayed, or that failed half-way, starts from the same manifest and overwrites its own folders. Parts and manifests
    that neither a batch nor its replay can need are deleted. Batches are numbered from 0 without gaps; the columns
    `bucket` and `batch` are the table's own.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    buckets: int = 64
    most: float = 0.5

    def parts(self, batch: int) -> list[Row]:
        """(bucket, part, rows, base) of the manifest of a batch; nothing before the first."""
        return self.spark.read.parquet(f"{self.path}/manifest/batch={batch}").collect() if batch >= 0 else []

    def read(self, batch: int) -> DataFrame | None:
        """The rows after a batch, or None if there were none yet."""
        return self._rows(self.parts(batch))

    def _rows(self, parts: list[Row]) -> DataFrame | None:
        bases, later = ([f"{self.path}/{p.part}" for p in parts if p.base == base] for base in (True, False))
        if not bases:
            return None
        rows = self.spark.read.parquet(*bases)
        if not later:
            return rows
        newer = self._later(later)
        if len({p.bucket for p in parts if not p.base}) < len(later):  # else keys are distinct, as they are within a part
            n = F.row_number().over(W.partitionBy(self.key).orderBy(F.col("batch").desc()))
            newer = newer.withColumn("__n", n).where("__n = 1")
        newer = newer.select(*rows.columns)
        return rows.join(newer.select(self.key), self.key, "left_anti").unionByName(newer)

    def _later(self, paths: list[str]) -> DataFrame:
        """Rows of later parts, with the batch that wrote them."""
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths)

    def _newest(self, parts: list[Row], bucket: Column) -> DataFrame:
        """The rows of parts that have later ones, dealt by bucket: the last of each key is found within its bucket."""
        bases, later = ([f"{self.path}/{p.part}" for p in parts if p.base == base] for base in (True, False))
        rows = self.spark.read.parquet(*bases)
        every = rows.withColumn("batch", F.lit(-1)).unionByName(self._later(later).select(*rows.columns, F.col("batch").cast("int").alias("batch")))
        n = F.row_number().over(W.partitionBy("bucket", self.key).orderBy(F.col("batch").desc()))
        return every.withColumn("bucket", bucket).repartition("bucket").withColumn("__n", n).where("__n = 1").drop("__n", "batch")

    def write(self, changed: DataFrame, batch: int) -> None:
        """The rows of a batch, one for each key, that are new or replace those of their key."""
        before = {p.part: p for p in self.parts(batch - 1)}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        self._put(changed.withColumn("bucket", bucket).repartition("bucket"), f"data/batch={batch}")
        schema = StructType([*changed.schema.fields, StructField("bucket", IntegerType())])
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/data/batch={batch}").groupBy("bucket").count().collect()
        held = {r["bucket"]: [p for p in before.values() if p.bucket == r["bucket"]] for r in counts}
        now = [p for p in before.values() if p.bucket not in held]
        full = []
        for bucket_id, n in counts:
            part = Row(bucket=bucket_id, part=f"data/batch={batch}/bucket={bucket_id}", rows=n, base=not held[bucket_id])
            own = [*held[bucket_id], part]
            if sum(p.rows for p in own if not p.base) > self.most * sum(p.rows for p in own if p.base):
                full.append(own)
            else:
                now += own
        if full:
            self._put(self._newest([p for own in full for p in own], bucket), f"rewritten/batch={batch}")
            again = self.spark.read.schema(schema).parquet(f"{self.path}/rewritten/batch={batch}").groupBy("bucket").count().collect()
            now += [Row(bucket=b, part=f"rewritten/batch={batch}/bucket={b}", rows=n, base=True) for b, n in again]
        rows = self.spark.createDataFrame([tuple(p) for p in now], "bucket int, part string, rows bigint, base boolean")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        for own in full:  # its new rows are in the base that was just made
            remove_folder(self.spark, f"{self.path}/{own[-1].part}")
        self._forget(batch, {p.part for p in now} | set(before))

    def _put(self, df: DataFrame, folder: str) -> None:
        """A file for each bucket; df is dealt by bucket."""
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _forget(self, batch: int, needed: set[str]) -> None:
        """Deletes the manifest before the last, and the parts of it that are no more."""
        if batch >= 2:
            try:
                old = self.parts(batch - 2)
            except Exception as e:  # forgotten already, by the first run of a batch that is replayed
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                return
            for p in old:
                if p.part not in needed:
                    remove_folder(self.spark, f"{self.path}/{p.part}")
            remove_folder(self.spark, f"{self.path}/manifest/batch={batch - 2}")


def offload_payload(df: DataFrame, column: str, limit: int = 64 * 1024) -> tuple[DataFrame, DataFrame]:
    """(df with payloads over the limit replaced by their key, the distinct payloads by key)."""
    large = F.octet_length(column) > limit
    key = F.when(large, F.sha2(column, 256))
    store = df.where(large).select(F.sha2(column, 256).alias("payload_key"), F.col(column).alias("payload")).dropDuplicates(["payload_key"])
    return df.withColumn("payload_key", key).withColumn(column, F.when(~F.coalesce(large, F.lit(False)), F.col(column))), store
