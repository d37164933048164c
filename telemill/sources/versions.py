"""A Parquet table that a stream merges into, with a commit log written last.

Rows live in parts (a function of their key). A batch rewrites the parts it touches into a folder of its own and then appends one file to the
commit log: a row per part with the folder that holds it now. Readers follow the log, so a batch that was cut off before its
commit leaves only an unused folder, and a batch that comes again after its commit is left out. Delivery at least once plus this log gives
every row once, over restarts of the driver. A table has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "source string, batch_id long, version long, part string, folder string, committed_at timestamp"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class VersionedTable:
    """``part``: a column over the rows, of few distinct values, that stays the same for a key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column, source: str = "stream") -> None:
        self.spark, self.path, self.schema, self.part, self.source = spark, path.rstrip("/"), schema, part.cast("string"), source

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def folders(self) -> dict[str, str]:
        """The folder that holds each part now; a row per part."""
        return {r["part"]: r["folder"] for r in self.commits().groupBy("part").agg(F.max_by("folder", "version").alias("folder")).collect()}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows as of the last commit, of some parts or of all."""
        found = [f"{folder}/_part={part}" for part, folder in self.folders().items() if parts is None or part in parts]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, batch_id: int, merge: Merge, before_commit: Callable[[int], None] | None = None) -> DataFrame | None:
        """Merge a batch: ``merge(stored rows of the touched parts, batch)`` gives these parts' new rows, with further columns if it likes, which are returned
        as written. None for a batch that was committed before. ``before_commit`` is called between writing and committing."""
        log = self.commits()
        last = log.agg(F.max(F.when(F.col("source") == self.source, F.col("batch_id"))).alias("batch"), F.max("version").alias("version")).first()
        if last["batch"] is not None and batch_id <= last["batch"]:
            return None
        parts = [r[0] for r in batch.select(self.part).distinct().collect()]  # the parts that the batch touches
        if not parts:
            return None
        folder = f"{self.path}/data/{self.source}-{batch_id}-{uuid.uuid4().hex}"
        merge(self.read(parts), batch).withColumn("_part", self.part).write.partitionBy("_part").parquet(folder)
        if before_commit:
            before_commit(batch_id)
        version = (last["version"] or 0) + 1
        rows = self.spark.createDataFrame([(self.source, batch_id, version, p, folder) for p in parts], COMMITS.rpartition(",")[0])
        rows.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")  # one file: all parts or none
        return self.spark.read.parquet(folder).drop("_part")

    def __call__(self, merge: Merge, before_commit: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, batch_id: (self.apply(batch, batch_id, merge, before_commit), None)[1]
