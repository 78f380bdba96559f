"""A change feed applied to a bucketed table by copy-on-write.

The table is a folder: ``data/gen=G/bucket=B/`` holds immutable files, ``manifest/N.json``
names the number of buckets and the generation that is current for every bucket. Applying
a slice of the feed reduces it to one decisive change per key, routes these by key hash, reads
only the buckets they touch, merges both sides sorted by key, writes replacements under a new
generation and commits by creating the next manifest, which fails if another writer has
created it. Readers see the old or the new state, never a mix; a failed or repeated
attempt leaves only unreferenced files, which :meth:`BucketedTable.vacuum` removes.

A null project_id is a project of its own, apart from the empty one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.paths import plain_path

STATE = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("source", T.StringType()),
    ]
)

#: Rows of the feed for which a table gets one more bucket when it is made.
ROWS_PER_BUCKET = 200_000


def buckets_for(n_rows: int, least: int = 8) -> int:
    """Number of buckets for so many rows: a power of two, so that growing splits every bucket evenly."""
    n = least
    while n * ROWS_PER_BUCKET < n_rows:
        n *= 2
    return n


def decisive_changes(feed: DataFrame) -> DataFrame:
    """One row per project_id and plain path: the change that stands after the whole slice.

    A change applies only if its version is above all versions applied before it, in
    order of change_id. So the highest version stands, and of several changes with that
    version the first to arrive. This is a maximum, so it needs no order, is combined
    before the shuffle and stays right for repeated rows and hot keys. Null deleted is
    false, null source an empty file; rows without version or path are not applied. A
    null change_id arrives after all others; of several such changes with that version
    one stands by the hash of its content, the same in every run. A null project_id is a
    project of its own.
    """
    unplaced = F.when(F.col("change_id").isNull(), F.xxhash64("deleted", "source"))
    return (
        feed.select(
            "project_id",
            plain_path(F.col("path")).alias("path"),
            "version",
            F.coalesce("deleted", F.lit(False)).alias("deleted"),
            F.coalesce("source", F.lit("")).alias("source"),
            "change_id",
        )
        .where("version is not null and path is not null")
        .groupBy("project_id", "path")
        .agg(F.max_by(F.struct("version", "deleted", "source"), F.struct("version", -F.col("change_id"), unplaced)).alias("c"))
        .select("project_id", "path", "c.version", "c.deleted", "c.source")
    )


class BucketedTable:
    """Current files by (project_id, path), deletions kept as versions.

    The number of buckets is fixed when the table is made and kept in its manifests: a table that exists is
    opened with the number it has, and asking for another one is an error. :meth:`resize` changes it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        kept = self._last()[2]
        if kept and buckets is not None and buckets != kept["buckets"]:
            raise ValueError(f"{self.root} has {kept['buckets']} buckets, not {buckets}")
        self.buckets = kept["buckets"] if kept else buckets or 32

    def _last(self) -> tuple[int, int, dict | None]:
        """The highest manifest number in use, and number and content of the last manifest that was written to its end."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0, 0, None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        for n in numbers:
            first = self.spark.read.text(f"{self.root}/manifest/{n}.json", wholetext=True).first()
            try:
                return numbers[0], n, json.loads(first[0])
            except (TypeError, ValueError):
                continue  # a writer was lost before it had committed
        return (numbers[0] if numbers else 0), 0, None

    def manifest(self) -> tuple[int, dict[int, int]]:
        """The last number in use and the generation of every bucket that has files."""
        number, _, kept = self._last()
        return number, {int(b): g for b, g in kept["parts"].items()} if kept else {}

    def _commit(self, number: int, parts: dict[int, int]) -> None:
        text = json.dumps({"buckets": self.buckets, "parts": {str(b): g for b, g in sorted(parts.items())}})
        try:
            out = self._fs.create(self._path(f"{self.root}/manifest/{number}.json"), False)
        except Exception as e:
            raise RuntimeError(f"manifest {number} was committed by another writer") from e
        out.write(bytearray(text.encode()))
        out.close()

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("project_id", "path"), F.lit(self.buckets)).cast("int")

    def _read(self, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STATE).withColumn("bucket", F.lit(0))
        places = [f"{self.root}/data/gen={g}/bucket={b}" for b, g in sorted(parts.items())]
        schema = T.StructType([*STATE.fields, T.StructField("gen", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*places).drop("gen")

    def _check_count(self) -> None:
        kept = self._last()[2]
        if kept and kept["buckets"] != self.buckets:
            raise RuntimeError(f"{self.root} was resized to {kept['buckets']} buckets; open it anew")

    def apply(self, feed: DataFrame) -> list[int]:
        """Apply one slice of the feed; gives the buckets that were rewritten."""
        self._check_count()
        number, parts = self.manifest()
        changes = decisive_changes(feed).withColumn("bucket", self._bucket())
        routed = f"{self.root}/routed/{number + 1}"
        changes.repartitionById(self.buckets, F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(routed)  # one file per bucket
        statuses = self._fs.listStatus(self._path(routed))
        touched = sorted(int(s.getPath().getName()[7:]) for s in statuses if s.getPath().getName().startswith("bucket="))
        if touched:
            schema = T.StructType([*STATE.fields, T.StructField("bucket", T.IntegerType())])
            new = self.spark.read.schema(schema).parquet(routed)
            old = self._read({b: parts[b] for b in touched if b in parts})
            self._rewrite(number + 1, old.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False))))
        self._commit(number + 1, parts | {b: number + 1 for b in touched})
        self._fs.delete(self._path(routed), True)
        return touched

    def _rewrite(self, generation: int, rows: DataFrame) -> None:
        """Sort both sides by key, merge equal keys to the highest version (of equal ones the base's) and write each bucket as one file.

        The rows are shuffled once, by bucket; sorting, merging and writing use that partitioning.
        """
        state = F.max(F.struct("version", "base", "deleted", "source")).alias("s")
        merged = rows.repartition(self.buckets, "bucket").groupBy("bucket", "project_id", "path").agg(state)
        merged = merged.select("project_id", "path", "s.version", "s.deleted", "s.source", "bucket").sortWithinPartitions("bucket", "project_id", "path")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/gen={generation}")

    def resize(self, buckets: int) -> None:
        """Another number of buckets: all rows are routed anew and committed at once; other handles must be opened again."""
        self._check_count()
        number, parts = self.manifest()
        rows, self.buckets = self._read(parts).drop("bucket"), buckets
        self._rewrite(number + 1, rows.withColumns({"bucket": self._bucket(), "base": F.lit(True)}))
        statuses = self._fs.listStatus(self._path(f"{self.root}/data/gen={number + 1}"))
        made = [int(s.getPath().getName()[7:]) for s in statuses if s.getPath().getName().startswith("bucket=")]
        self._commit(number + 1, {b: number + 1 for b in made})

    def vacuum(self) -> list[int]:
        """Remove generations that the last manifest doesn't name, and older manifests; gives their numbers. Readers of older states must be done."""
        _, number, kept = self._last()
        parts = kept["parts"] if kept else {}
        folder, gone = self._path(f"{self.root}/data"), []
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            g = int(s.getPath().getName()[4:])
            if g <= number and g not in parts.values():
                self._fs.delete(s.getPath(), True)
                gone.append(g)
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")) if number else []:
            n = s.getPath().getName()[:-5]
            if n.isdigit() and int(n) < number:
                self._fs.delete(s.getPath(), False)
        return sorted(gone)

    def rows(self) -> DataFrame:
        """All versions that stand, deletions included."""
        return self._read(self.manifest()[1]).drop("bucket")

    def current(self) -> DataFrame:
        """The files that exist."""
        return self.rows().where("not deleted").select("project_id", "path", "version", "source")
