"""The event log on storage: hourly partitions, insert-ignore appends, pruned range reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.functions.scalars import bucket_start
from bookweave.operators.ingest import COLD_NS, HOT_NS, WARM_NS, new_events, with_tier
from bookweave.schemas import HOUR_NS, table_schema
from bookweave.session import cut_lineage


class EventLog:
    """Market events under ``path``, partitioned by ``hour_bucket`` and sorted by (symbol, time, seq)
    inside a file, so time ranges prune folders and symbol filters prune row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """Events with ``start <= ts < end``, with the bucket range the time range implies."""
        schema = table_schema("market_events").add("hour_bucket", T.LongType())
        try:
            log = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        ts, bucket = F.col("ts_exchange_ns"), F.col("hour_bucket")
        if start_ns is not None:
            log = log.filter((bucket >= start_ns // HOUR_NS * HOUR_NS) & (ts >= start_ns))
        if end_ns is not None:
            log = log.filter((bucket <= (end_ns - 1) // HOUR_NS * HOUR_NS) & (ts < end_ns))
        return log

    def append(self, batch: DataFrame) -> int:
        """Append the events the log lacks; gives their number. Only the buckets between the first and
        the last one of the batch are read."""
        bucketed = batch.withColumn("hour_bucket", bucket_start(F.col("ts_exchange_ns"), HOUR_NS))
        log = self.read()
        first, last = bucketed.agg(F.min("hour_bucket"), F.max("hour_bucket")).first()
        if first is not None:
            log = log.filter(F.col("hour_bucket").between(first, last))
        # written out first: the new rows are counted and appended from the same result
        fresh = cut_lineage(new_events(log, bucketed))
        (
            fresh.repartitionByRange("hour_bucket", "symbol_id", "ts_exchange_ns")
            .sortWithinPartitions("hour_bucket", "symbol_id", "ts_exchange_ns", "seq")
            .write.mode("append")
            .partitionBy("hour_bucket")
            .parquet(self.path)
        )
        return fresh.count()

    def tiered(self, now_ns: int, folder: str) -> dict[str, str]:
        """Write a copy of the log by retention tier (hot, warm, cold); purged rows are left out. ``TieredLog``
        keeps a log in tiers without copies."""
        aged = with_tier(self.read(), "ts_exchange_ns", now_ns).filter("tier <> 'purge'")
        aged.write.mode("overwrite").partitionBy("tier", "hour_bucket").parquet(folder)
        return {tier: f"{folder}/tier={tier}" for tier in ("hot", "warm", "cold")}


class TieredLog:
    """An event log whose hourly buckets move through retention tiers: ``folder/tier=T/hour_bucket=B``.

    New events go to the hot tier. ``age`` moves whole buckets by renaming their folders, so only buckets that
    change tier are touched and no row is written again. A bucket ages with its last moment. A run that is cut
    off leaves every bucket in one tier; the next run moves the rest."""

    #: Tiers with the age at which a bucket leaves them.
    LIMITS = {"hot": HOT_NS, "warm": WARM_NS, "cold": COLD_NS}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, tiers: list[str] | None = None) -> DataFrame:
        """Events with their tier and bucket."""
        schema = table_schema("market_events").add("tier", T.StringType()).add("hour_bucket", T.LongType())
        try:
            log = self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        return log if tiers is None else log.filter(F.col("tier").isin(*tiers))

    def append(self, batch: DataFrame) -> int:
        """Append the events that no tier has; gives their number."""
        known = self.read().select("ts_exchange_ns", "event_id")
        low, high = batch.agg(F.min("ts_exchange_ns"), F.max("ts_exchange_ns")).first()
        if low is not None:
            first, last = low // HOUR_NS * HOUR_NS, high // HOUR_NS * HOUR_NS
            known = self.read().filter(F.col("hour_bucket").between(first, last)).select("ts_exchange_ns", "event_id")
        return EventLog(self.spark, f"{self.folder}/tier=hot").append(batch.join(known, ["ts_exchange_ns", "event_id"], "left_anti"))

    def age(self, now_ns: int) -> list[tuple[int, str, str]]:
        """Move every bucket to the tier of its age; (bucket, from, to) of those that moved. Purged ones go."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        moved = []
        for tier in self.LIMITS:
            here = path(f"{self.folder}/tier={tier}")
            if not fs.exists(here):
                continue
            for status in fs.listStatus(here):
                name = status.getPath().getName()
                if not name.startswith("hour_bucket="):
                    continue
                bucket = int(name.split("=")[1])
                age = now_ns - (bucket + HOUR_NS - 1)
                to = next((t for t, limit in self.LIMITS.items() if age < limit), "purge")
                if to == tier or list(self.LIMITS).index(tier) > [*self.LIMITS, "purge"].index(to):
                    continue
                if to == "purge":
                    fs.delete(status.getPath(), True)
                else:
                    self._move(fs, path, status.getPath(), f"{self.folder}/tier={to}", name)
                moved.append((bucket, tier, to))
        return moved

    @staticmethod
    def _move(fs, path, source, folder: str, name: str) -> None:
        target = path(f"{folder}/{name}")
        fs.mkdirs(path(folder))
        if not fs.exists(target):
            fs.rename(source, target)
            return
        for part in fs.listStatus(source):  # late events of a bucket that has moved before
            fs.rename(part.getPath(), path(f"{folder}/{name}/{part.getPath().getName()}"))
        fs.delete(source, True)
