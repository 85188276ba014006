"""Cutting lineage through tables in the folder that the cluster shares, and bounds of what tasks and broadcasts hold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (rows times the width of a row) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Bits of a sieve, which is broadcast as 16 bytes for 64 of them.
SIEVE_BITS = 1 << 25
#: Bytes of an Arrow batch that a Python worker is sent at once.
ARROW_BYTES = 4 << 20

#: Bytes of a value of fixed width.
_WIDTHS = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors must share; without one, a new folder if Spark is one local process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_bytes(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes too, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(ARROW_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back.

    Later stages reread the files, so a lost executor costs the rows in flight
    and never the stages before.
    """
    by_bytes(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def sieved(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``df`` with the column ``maybe``: false only where ``key`` is none of ``keys``' longs (null: false).

    Each long sets one of 8 to 16 bits a long, ``SIEVE_BITS`` at most, and the bits are broadcast, so that most
    rows without a partner need no shuffle. With more keys than that more rows are let through.
    """
    bits = 1 << min(max(8 * keys.count(), 1 << 10).bit_length(), SIEVE_BITS.bit_length() - 1)
    slot = F.col("slot").bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    own = keys.select(keys[0].alias("slot")).select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask"))
    own = F.broadcast(own.groupBy("word").agg(F.bit_or("mask").alias("mask")))
    out = df.withColumn("slot", key).withColumn("word", word).join(own, "word", "left")
    maybe = F.call_function("shiftrightunsigned", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("slot", "word", "mask")


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcast if it has numbers and strings only and they take at most ``most`` bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if not all(k in _WIDTHS or k == "string" for k in kinds.values()):
        return df
    texts = [F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c, k in kinds.items() if k == "string"]
    n, *lengths = df.agg(F.count("*"), *texts).first()
    return F.broadcast(df) if n * sum(_WIDTHS.get(k, 16) for k in kinds.values()) + sum(lengths) <= most else df
