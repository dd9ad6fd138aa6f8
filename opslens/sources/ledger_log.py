"""The processed-item ledger on disk: appended deltas, and a compacted base that is one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators.ledger import COLUMNS, ledger_latest

SCHEMA = "key STRING, processed_at TIMESTAMP, status STRING, seq BIGINT, metadata STRING"


class LedgerLog:
    """Folders `delta=N` of appended versions and `base=N`, the last version of every key up to delta N, by bucket of the key.

    A folder counts once Spark has marked it complete, so a killed append or compaction leaves nothing that is read, and
    deltas go only when a complete base covers them. One writer at a time. A base forgets earlier versions: questions
    about attempts (`retry_outcome`) want the log before it is compacted. A null key is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self, kind: str, marker: str = "/_SUCCESS") -> list[int]:
        found = self._store.globStatus(self._path(f"{self.root}/{kind}=*{marker}"))
        folders = [str(s.getPath().getParent().getName() if marker else s.getPath().getName()) for s in found or []]
        return sorted(int(name.partition("=")[2]) for name in folders)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _base(self, upto: int | None = None) -> int | None:
        return max((n for n in self._numbers("base") if upto is None or n <= upto), default=None)

    def append(self, rows: DataFrame) -> int:
        """Add versions; the number of their delta."""
        number = 1 + max(self._numbers("delta", "") + self._numbers("base", ""), default=0)
        rows.select("key", *COLUMNS).write.mode("overwrite").parquet(f"{self.root}/delta={number}")
        return number

    def read(self, keys: Sequence[str] | None = None) -> DataFrame:
        """The newest base and the deltas after it; for a short list of `keys` only their buckets of the base."""
        base = self._base()
        deltas = [f"{self.root}/delta={n}" for n in self._numbers("delta") if base is None or n > base]
        reader = self.spark.read.schema(SCHEMA)
        rows = reader.parquet(*deltas) if deltas else self.spark.createDataFrame([], SCHEMA)
        if base is not None:
            kept = self.spark.read.schema(f"{SCHEMA}, bucket INT").parquet(f"{self.root}/base={base}")
            if keys is not None:
                asked = self.spark.range(1).select(*[self._bucket(F.lit(k)).alias(f"b{i}") for i, k in enumerate(keys)]).first()
                kept = kept.where(F.col("bucket").isin(sorted(set(asked))))
            rows = kept.drop("bucket").unionByName(rows)
        return rows if keys is None else rows.where(F.col("key").isin(list(keys)))

    def latest(self, columns: Sequence[str] = COLUMNS) -> DataFrame:
        return ledger_latest(self.read(), columns)

    def compact(self) -> int | None:
        """Write the base of all deltas there are; its number, None for an empty log. A base once complete is never rewritten."""
        upto = max(self._numbers("delta") + self._numbers("base"), default=None)
        if upto is None or upto in self._numbers("base"):
            return upto
        current = self.latest().withColumn("bucket", self._bucket(F.col("key")))
        sorted_rows = current.repartitionById(self.buckets, "bucket").sortWithinPartitions("key")
        sorted_rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base={upto}")
        return upto

    def vacuum(self) -> None:
        """Delete what the newest complete base covers; readers of older bases must have ended."""
        base = self._base()
        if base is None:
            return
        for kind in ("delta", "base"):
            for number in self._numbers(kind, ""):
                if number < base or (kind == "delta" and number == base):
                    self._store.delete(self._path(f"{self.root}/{kind}={number}"), True)
