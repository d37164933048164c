"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word: \x20 and \x09-\x0D. ``bytes.split()`` cuts at the same bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder serves in local mode; on a
    cluster the setting is required.
    """
    # texts may be long: fewer rows go to Python at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or _local.get(sc.applicationId)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """64-bit key of a row's identifier and text; rows that agree in both share it."""
    return F.xxhash64(F.col(id_column), text_of(text_column))


def crc_bucket(id_column: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus`` (a null identifier counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """Uniform in (0, 1), a function of the columns and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (h.cast("double") + 0.5) / float(2**53)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all of ``taken``, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def finite_vectors(vectors: DataFrame, vector_column: str, columns: dict[str, Column]) -> tuple[DataFrame, int]:
    """The given columns and ``v`` (array<double>) of the rows whose vector has no null and no component that is null or not finite, and the dimension.

    Vectors of another dimension than most take no part; of equally frequent dimensions the smaller one holds. 0 for an empty table.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(*[c.alias(name) for name, c in columns.items()], v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0)), most["d"] if most else 0
